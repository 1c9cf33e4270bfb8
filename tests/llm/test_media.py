import hashlib
import html
import re
import zlib

import pytest

from tallyvane.llm import media as m


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_png_round_trip(n):
    payload = m.padded(bytes(i % 251 for i in range(n)))
    assert len(payload) % 576 == 0 and len(payload) > 0
    assert m.decode_png(m.encode_png(payload)).tobytes() == payload
    assert len(m.feature(m.decode_png(m.encode_png(payload)))) == 64


def test_damage_is_noticed():
    data = bytearray(m.encode_png(m.padded(b"x" * 3000)))
    data[-20] ^= 1
    with pytest.raises(ValueError):
        m.decode_png(bytes(data))


def test_items_stay_in_order_with_captions():
    html = "<body><script>no</script><p>One &amp; <b>two</b></p><figure><img src='a' alt='alt'><figcaption>Cap <i>x</i></figcaption></figure>tail<img src=b alt=only><p>end"
    assert m.items_of(html) == [["text", "One & two", None, None], ["image", None, "a", "Cap x"], ["text", "tail", None, None], ["image", None, "b", "only"], ["text", "end", None, None]]
    assert m.items_of("") == [] and m.items_of("<p><<< broken")[0][0] == "text"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<img src=a><figcaption>stray</figcaption>", [("image", "a", None), ("text", "stray", None)]),
        ("<figure><figcaption>above</figcaption><img src=a></figure>", [("image", "a", "above")]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure><img src=c>", [("image", "a", "out"), ("image", "b", "in"), ("image", "c", None)]),
        ("<figure><figure><img src=a></figure><figcaption>outer</figcaption></figure>", [("image", "a", "outer")]),
        ("<figure><img src=a><figcaption>open", [("image", "a", "open")]),
        ("<noscript><img src=a>x</noscript><template><video src=b></video></template>c", [("text", "c", None)]),
        ("<title>never closed<p>text</p>", [("text", "text", None)]),
        ("<picture><source srcset='big 2x, small'><img alt=x></picture>", [("image", "big", "x")]),
        ("<picture><source srcset='big'><img src=own></picture>", [("image", "own", None)]),
        ("<video><source src=v.mp4><source src=v.ogg></video><source src=none>", [("video", "v.mp4", None)]),
        ("</figure></figcaption></video>", []),
        ("<img srcset='\n  small.jpg 1x,\n big.jpg 2x'>", [("image", "small.jpg", None)]),
        ("<img srcset='a,b 2x'><img src='  '>", [("image", "a", None), ("image", None, None)]),
        ("<img src='data:image/gif;base64,R0' data-src=lazy.jpg><noscript><img src=lazy.jpg></noscript>", [("image", "lazy.jpg", None)]),
        ("<img data-srcset=' l.jpg 2x '><img src='data:image/png;base64,x,y'>", [("image", "l.jpg", None), ("image", "data:image/png;base64,x,y", None)]),
        ("<iframe src=f title=film></iframe><object data=o.svg>else</object>", [("frame", "f", "film"), ("object", "o.svg", None), ("text", "else", None)]),
        ("<figure><video poster=p.jpg src=v></video><figcaption>c</figcaption></figure>", [("image", "p.jpg", "c"), ("video", "v", "c")]),
    ],
)
def test_captions_and_sources(page, want):
    assert [(k, t if k == "text" else r, c) for k, t, r, c in m.items_of(page)] == want


def test_sequences_of_pages_equal_plain_cutting(spark):
    from tallyvane.llm.queries import media_sequences, table

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in table(spark, sf, "pages").collect():
        text = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|title)\b.*?</\1>", "", r.html or "")
        pieces = re.split(r"</?(?:p|div|article|section|h[1-6]|li|ul|nav|body|footer|br)(?:\s[^>]*)?>", text)
        blocks = [" ".join(html.unescape(re.sub(r"</?\w+[^>]*>", "", p)).split()) for p in pieces]
        want |= {(r.page_id, pos, "text", t, None, None) for pos, t in enumerate(b for b in blocks if b)}
    got = [tuple(r) for r in media_sequences(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def brute_media(text):
    """The same PNG by definition: one byte a sample, rows of 576, no filter."""
    data = (text or "").encode()
    payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
    rows = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + b"\x08\0\0\0\0"), (b"IDAT", zlib.compress(rows, 1)), (b"IEND", b"")):
        out += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(out), hashlib.sha256(out).hexdigest()


def test_query_equals_brute_force(spark):
    from tallyvane.llm.queries import op9_media, table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op9_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == brute_media(text)
        assert r.pos == sum(bool(line.split()) for line in (text or "").split("\n")) and r.caption == f"document {r.doc_id}"
    by_text = {}
    assert all(by_text.setdefault(texts[r.doc_id], r.feature) == r.feature for r in got)


@pytest.mark.parametrize("name", ["kind", "pos", "digest", "ref", "caption", "text"])
def test_names_that_clash(spark, name):
    media = m.read_back(m.stored(spark.createDataFrame([("hello",)], "text string")))
    key = hashlib.sha256(b"hello").hexdigest()
    pages = spark.createDataFrame([(7, f"<p>a</p><img src='sha256:{key}'>")], f"`{name}` long, html string")
    found = m.resolved(m.sequences(pages, name), media, name)
    assert sorted(r.n_bytes or 0 for r in found.collect()) == [0, 5] and len(set(found.columns)) == len(found.columns)
    docs = spark.createDataFrame([(7, "hello")], f"`{name}` long, body string")
    assert [(r[name], r.n_bytes) for r in m.document_media(docs, name, "body").collect()] == [(7, 5)]


def test_resolve_keeps_unknown_references(spark):
    media = m.read_back(m.stored(spark.createDataFrame([("hello",), ("hello",), (None,)], "text string")))
    assert media.count() == 2
    key = hashlib.sha256(b"hello").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{key}'><img src='x.png'><p>b"), (2, None)], "page_id long, html string")
    rows = m.resolved(m.sequences(pages), media).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.kind, r.n_bytes) for r in rows] == [(1, 0, "text", None), (1, 1, "image", 5), (1, 2, "image", None), (1, 3, "text", None)]


def test_document_media_by_definition(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (1, "héllo"), (None, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    got = m.document_media(docs).collect()
    assert len(got) == len(rows)
    want = {i: (t or "").encode() for i, t in rows}
    for r in got:
        text = want[r.doc_id]
        payload = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
    assert m.document_media(docs.limit(0)).collect() == []

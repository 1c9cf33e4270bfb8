"""Media columns: interleaved document sequences and a media store.

`sequences` parses HTML into ordered items: text blocks and media references with their
captions. A figcaption, wherever it stands in its figure, is the caption of that figure's
media but for those of inner figures with a caption of their own; else alt is. Media in
silent elements are not shown, so they are no items. `source` elements name what their
picture, video or audio shows if that has no reference itself. An image that is loaded
later refers to what its data-src or data-srcset says, in place of a `data:` stand-in; a
video's poster is an image before it. Frames and objects are media too. `stored` keeps payloads as
8-bit greyscale PNG images, one byte a sample, WIDTH samples a row, and `read_back` decodes
what was stored and measures it. `resolved` joins references to media by digest; every item
keeps its document, position and caption, whether or not its media is known.

`document_media` shows each text as a page of its lines and one figure that refers to the
stored payload, and reads it back by way of parse and join.

Defined cases: null HTML or text is an empty one (a document without items; a payload of
padding alone). A reference that is no digest, or is unknown, resolves to nulls. Equal
payloads share one media row, so copies in thousands join one row each. Repeated documents
keep their own items. Broken HTML gives the items that can be read; a title ends at the
first block, a figure at the end of the page at last. A caption outside figures is text.
Other columns are ignored; an item column with the id column's name is returned with
"item_" before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "embed": "embed", "iframe": "frame", "object": "object"}
#: Attributes that say what a medium shows, the first one that does; those of sets name several, by widths.
REFERENCES = ["src", "data", "data-src", "srcset", "data-srcset"]
#: Media elements that source elements belong to.
HOLDERS = {"picture", "video", "audio"}
BLOCK_TAGS = set("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre figure figcaption br hr header footer nav main body".split())
SILENT_TAGS = {"script", "style", "template", "noscript"}
REF = "sha256:"


def joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def reference(found: dict[str, str | None]) -> str | None:
    """What an element's attributes refer to; a `data:` stand-in only if nothing else is named."""
    named = []
    for name in REFERENCES:
        for value in (found.get(name) or "").split()[:1]:
            # An address of a set ends at white space; a comma after it parts it from the next.
            named.append(value.split(",")[0] if name.endswith("srcset") and not value.startswith("data:") else value)
    named = [n for n in named if n]
    return next((n for n in named if not n.startswith("data:")), named[0] if named else None)


class _Items(HTMLParser):
    """Ordered items of a page: [kind, text, ref, caption]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.title = [], [], 0, False
        self.figures = []  # open ones: [their media, caption]
        self.caption = None  # parts of the caption that is being read
        self.holders = []  # open ones: [item or None, first source]

    def flush(self):
        if text := joined(self.text):
            self.items.append(["text", text, None, None])
        self.text = []

    def end_caption(self):
        if self.caption is not None:
            self.figures[-1][1] = self.figures[-1][1] or joined(self.caption) or None
            self.caption = None

    def end_figure(self):
        self.end_caption()
        media, caption = self.figures.pop()
        if caption:
            for item in media:
                item[3] = caption
        elif self.figures:
            self.figures[-1][0] += media

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            self.silent += 1
        if self.silent:
            return
        if tag == "title":
            self.title = True
        elif tag in BLOCK_TAGS or tag in MEDIA_TAGS:
            self.title = False
            self.flush()
        found = dict(attrs)
        ref = reference(found)
        if tag in MEDIA_TAGS:
            if tag == "img" and self.holders:
                ref = ref or self.holders[-1][1]
            item = [MEDIA_TAGS[tag], None, ref, found.get("alt") or found.get("title") or None]
            poster = [["image", None, found["poster"].strip(), item[3]]] if tag == "video" and (found.get("poster") or "").strip() else []
            self.items += [*poster, item]
            if self.figures:
                self.figures[-1][0] += [*poster, item]
            if tag in HOLDERS:
                self.holders.append([item, None])
        elif tag == "picture":
            self.holders.append([None, None])
        elif tag == "source" and self.holders:
            item, first = self.holders[-1]
            self.holders[-1][1] = first or ref
            if item:
                item[2] = item[2] or ref
        elif tag == "figure":
            self.end_caption()
            self.figures.append([[], None])
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.caption = []

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "title":
            self.title = False
        elif tag in HOLDERS and self.holders:
            self.holders.pop()
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.silent and not self.title:
            (self.text if self.caption is None else self.caption).append(data)


def items_of(html: str) -> list[list]:
    """Items of a page in order, as [kind, text, ref, caption]; an empty page has none."""
    parser = _Items()
    parser.feed(html)
    parser.close()
    while parser.figures:
        parser.end_figure()
    parser.flush()
    return parser.items


ITEM = "pos int, kind string, text string, ref string, caption string"


def sequences(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """(id, items): items is an array of structs (pos, kind, text, ref, caption) in document order."""
    source = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))

    def run(batches):
        for batch in slices(batches):
            found = [
                [{"pos": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(items_of(html))]
                for html in batch.column("html").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "items"])

    id_type = source.schema["id"].dataType.simpleString()
    fields = ITEM.replace(" ", ":").replace(",:", ",")
    return source.mapInArrow(run, f"id {id_type}, items array<struct<{fields}>>").withColumnRenamed("id", id_col)


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def encode_png(payload: bytes) -> bytes:
    """8-bit greyscale PNG of WIDTH samples a row, unfiltered rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    framed = np.zeros((len(rows), WIDTH + 1), np.uint8)
    framed[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(framed.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples (rows, WIDTH) of an image that encode_png made; its checksums are tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, parts, shape = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum does not fit")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    framed = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if framed[:, 0].any():
        raise ValueError("a filtered row")
    return framed[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean level of 16 column bands, then of 16 row bands, as 64 hex digits."""
    columns = samples.mean(axis=0).reshape(16, -1).mean(axis=1)
    edges = np.linspace(0, len(samples), 17).astype(int)
    by_row = samples.mean(axis=1)
    rows = np.array([by_row[a : max(b, a + 1)].mean() if a < len(by_row) else 0 for a, b in zip(edges, edges[1:], strict=False)])
    return np.concatenate((columns, rows)).round().astype(np.uint8).tobytes().hex()


def digest_of(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def stored(docs: DataFrame, text_col="text") -> DataFrame:
    """(digest, n_bytes, media) of every row's text, written to the shared folder and read from there."""
    source = docs.select(digest_of(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            media = [encode_png(padded(t)) for t in texts]
            columns = [batch.column("digest"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_bytes", "media"])

    return written(source.mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


MEASURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def read_back(media: DataFrame) -> DataFrame:
    """One row per digest: n_bytes and MEASURES of the stored bytes, decoded."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for data in batch.column("media").to_pylist():
                samples = decode_png(data)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (1, 4, 5) else pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), *columns], ["digest", "n_bytes", *MEASURES])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    measured = media.mapInArrow(run, schema)
    return written(measured.groupBy("digest").agg(*[F.first(c).alias(c) for c in ["n_bytes", *MEASURES]]), "measures")


def named(df: DataFrame, id_col: str) -> DataFrame:
    """df with its column __id called id_col; another column of that name gets "item_" before it."""
    return df.withColumnRenamed(id_col, f"item_{id_col}").withColumnRenamed("__id", id_col)


def _resolved(found: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    items = found.select(F.col(id_col).alias("__id"), F.col("items").alias("__items")).select("__id", F.inline("__items"))
    wanted = F.when(F.col("ref").startswith(REF), F.substring("ref", len(REF) + 1, 64)).alias("wanted")
    return items.select("*", wanted).join(media, F.col("wanted") == F.col("digest"), "left").drop("wanted")


def resolved(found: DataFrame, media: DataFrame, id_col="page_id") -> DataFrame:
    """One row per item of `sequences`, with the columns of the media (by digest) its reference names."""
    return named(_resolved(found, media, id_col), id_col)


def page_of(id_col: str, text_col: str):
    """A page of a document's lines, and its text as one captioned figure, by reference."""
    escaped = F.coalesce(F.col(text_col), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(entity))
    return F.concat(
        F.lit("<article><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit('</p><figure><img src="' + REF), digest_of(text_col),
        F.lit('"><figcaption>document '), F.coalesce(F.col(id_col).cast("string"), F.lit("without id")), F.lit("</figcaption></figure></article>"),
    )


def document_media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row of docs: its id, n_bytes and MEASURES, and the figure's pos and caption in the page, by way of store, page, parse and join."""
    media = read_back(stored(docs, text_col))
    pages = docs.select(F.col(id_col).alias("__page"), page_of(id_col, text_col).alias("html"))
    figures = sequences(pages, "__page", "html").select("__page", F.filter("items", lambda item: item["kind"] == "image").alias("items"))
    found = _resolved(figures, media, "__page")
    return named(found.select("__id", "n_bytes", *MEASURES, "pos", "caption"), id_col)

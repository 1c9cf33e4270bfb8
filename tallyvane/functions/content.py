"""Content classes, scripts and detectors of text, as Column factories.

Patterns are ASCII-cased. Java look-arounds stand for the word boundaries, so that
letters beyond ASCII never count as word characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file formats of each extension class.
EXTENSION_CLASSES = {
    "table": ["csv", "tsv", "jsonl", "ndjson", "parquet"],
    "json": ["json"],
    "source_code": ["go", "py", "cpp", "c", "h", "java", "js", "ts", "rs", "rb", "sh", "cs", "sql"],
    "markdown": ["md", "markdown"],
    "text": ["txt", "text", "in", "out"],
    "html_xml": ["html", "htm", "xml"],
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "svg"],
    "archive_zip": ["zip"],
    "archive_tar_gz": ["tar.gz", "tgz"],
}
#: Archive kinds by format.
ARCHIVES = {"zip": "zip", "tar.gz": "tar.gz", "tgz": "tar.gz"}
#: File extensions by media type, for neutral display names.
MEDIA_EXTENSIONS = {"text/csv": "csv", "text/tab-separated-values": "tsv", "application/x-ndjson": "jsonl", "application/vnd.apache.parquet": "parquet"}
#: Beginnings of source code.
CODE_STARTS = ["package ", "import ", "def ", "function ", "#include", "//", "#!/"]
#: Top-level domains of the email detector, in order.
TLDS = "com|org|net|edu|gov|mil|io|ai|co|uk|de|fr|es|info|biz|dev|app|me"
#: The characters of an address's local part, and what a domain looks like.
LOCAL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]"
DOMAIN = rf"^[A-Za-z0-9][A-Za-z0-9.-]{{0,180}}\.(?i:{TLDS})(?![A-Za-z0-9_])"
#: Phone candidates, and what excludes a line.
PHONE = r"\+?[0-9][0-9 ().-]{6,40}[0-9]"
PHONE_EXCLUDED = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?<![a-z0-9_])[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]|(?<![a-z0-9_])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|(?<![a-z0-9_])0x[0-9a-f]+(?![a-z0-9_]))"
#: Credential shapes.
CREDENTIAL = (
    r"(?:(?<![A-Za-z0-9_])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_])"
    r"|-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_])(?:ghp_|github_pat_|sk_live_|sk_test_|sk-proj-|xoxb-|xoxp-|glpat-)[A-Za-z0-9_-]{16,200}"
    r"|(?<![A-Za-z0-9_])(?i:key|secret|token|password)(?![A-Za-z0-9_])[ \t]{0,16}[=:][ \t\"']{0,16}[A-Za-z0-9_+/=-]{20,200})"
)
MIN_ENTROPY = 3.5
#: Fixed value: bytes of a file that tell its class.
PREFIX = 4096
#: Licence families and their texts.
LICENCES = {
    "mit": r"permission is hereby granted,? free of charge|(?<!\w)MIT License(?!\w)",
    "apache_2": r"Apache License[ ,\r\n]+(?:Version )?2\.0|SPDX-License-Identifier: Apache-2\.0",
    "bsd": r"redistribution and use in source and binary forms|(?<!\w)BSD-[23]-Clause(?!\w)",
    "gpl": r"GNU GENERAL PUBLIC LICENSE|SPDX-License-Identifier: GPL-",
    "lgpl": r"GNU LESSER GENERAL PUBLIC LICENSE|SPDX-License-Identifier: LGPL-",
    "agpl": r"GNU AFFERO GENERAL PUBLIC LICENSE|SPDX-License-Identifier: AGPL-",
    "mpl": r"Mozilla Public License|SPDX-License-Identifier: MPL-",
    "cc_by": r"(?<!\w)CC-BY-[1-4]|Creative Commons Attribution [1-4]",
    "cc_by_sa": r"CC-BY-SA|Attribution-ShareAlike",
    "cc_by_nc": r"CC-BY-NC|Attribution-NonCommercial",
    "cc0": r"(?<!\w)CC0(?!\w)",
    "unlicense": r"(?<!\w)Unlicense(?!\w)|free and unencumbered software released into the public domain",
    "proprietary_notice": r"all rights reserved|confidential and proprietary",
    "unknown_licence_text": r"(?<!\w)licen[cs]e(?!\w)|(?<!\w)copyright(?!\w)",
}


#: Literals in lower case, one of which every match holds.
LICENCE_HINTS = {
    "mit": ["permission is hereby granted", "mit license"], "apache_2": ["apache license", "identifier: apache-2.0"], "bsd": ["redistribution and use in source", "bsd-"],
    "gpl": ["gnu general public license", "identifier: gpl-"], "lgpl": ["gnu lesser general", "identifier: lgpl-"], "agpl": ["gnu affero general", "identifier: agpl-"],
    "mpl": ["mozilla public license", "identifier: mpl-"], "cc_by": ["cc-by-", "creative commons attribution"], "cc_by_sa": ["cc-by-sa", "attribution-sharealike"],
    "cc_by_nc": ["cc-by-nc", "attribution-noncommercial"], "cc0": ["cc0"], "unlicense": ["unlicense", "unencumbered software"],
    "proprietary_notice": ["all rights reserved", "confidential and proprietary"], "unknown_licence_text": ["license", "licence", "copyright"],
}
CREDENTIAL_HINTS = ["akia", "asia", "-----begin ", "ghp_", "github_pat_", "sk_live_", "sk_test_", "sk-proj-", "xoxb-", "xoxp-", "glpat-", "key", "secret", "token", "password"]


def lookup(key: Column, mapping: dict[str, str], default: str | None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def format_of(key: Column) -> Column:
    """Format of an object's key: its last extension; ndjson is jsonl; none is other."""
    name = F.lower(F.regexp_extract(key, r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(name.endswith(".tar.gz"), "tar.gz").when(ext == "ndjson", "jsonl").when(ext == "", "other").otherwise(ext)


def extension_class(fmt: Column) -> Column:
    return lookup(F.regexp_replace(F.lower(fmt), r"^\.", ""), {f: k for k, fs in EXTENSION_CLASSES.items() for f in fs}, "other")


def archive_format(fmt: Column) -> Column:
    """Archive kind by format, or null."""
    return lookup(F.lower(fmt), ARCHIVES, None)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _json(text: Column) -> Column:
    """Whether a text is a JSON object or list; only what begins like one is parsed."""
    return F.when(text.rlike(r"^\s*[{\[]"), F.try_parse_json(text).isNotNull()).otherwise(False)


def unmarked(text: Column) -> Column:
    """text without a byte-order mark."""
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 1 << 30)).otherwise(text)


def trimmed(text: Column) -> Column:
    """text without a byte-order mark and white space around."""
    return F.btrim(unmarked(text), F.lit(" \t\n\x0b\f\r"))


def media_type(text: Column) -> Column:
    """Media type of a content prefix, never of a name."""
    line = F.regexp_replace(first_line(unmarked(text)), r"\r$", "")
    return (
        F.when(text.startswith("PAR1"), "application/vnd.apache.parquet")
        .when((F.length(line) == 0) | text.contains("\x00"), "application/octet-stream")
        .when(_json(line), "application/x-ndjson")
        .when(line.contains("\t"), "text/tab-separated-values")
        .when(line.contains(","), "text/csv")
        .otherwise("application/octet-stream")
    )


def media_type_named(text: Column, name: Column) -> Column:
    """media_type, with .csv and .tsv names deciding for what content calls plain text."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    named = F.when(ext == "csv", "text/csv").when(ext == "tsv", "text/tab-separated-values")
    plain = (media_type(text) == "application/octet-stream") & named.isNotNull() & (trimmed(text) != "") & (content_class(text, F.lit("")) == "plain_text")
    return F.when(plain, named).otherwise(media_type(text))


def content_class(text: Column, name: Column, s: Column | None = None, line: Column | None = None) -> Column:
    """Class of a text; magic numbers first, the name only breaks ties.

    s and line: `trimmed` text and its first line, where a caller has them as columns.
    """
    s = trimmed(text) if s is None else s
    line = first_line(s) if line is None else line
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    starts = lambda words: s.rlike("^(" + "|".join(w.replace("#", r"\#").replace("/", r"\/") for w in words) + ")")
    return (
        F.when(F.length(text) == 0, "empty")
        .when(text.startswith("PAR1") | text.startswith("PK\x03\x04") | text.startswith("PK\x05\x06"), "other_binary")
        .when(text.startswith("%PDF-"), "pdf")
        .when(text.startswith("GIF87a") | text.startswith("GIF89a") | text.startswith("RIFF"), "image")
        .when(text.contains("\x00"), "other_binary")
        .when(_json(line), F.when(s.contains("\n"), "table_like_jsonl").otherwise("json_document"))
        .when(_json(s), "json_document")
        .when(s.startswith("<"), "html_xml")
        .when(line.contains("\t"), "table_like_tsv")
        .when(line.contains(","), "table_like_csv")
        .when(ext.isin(".md", ".markdown") | s.startswith("# ") | s.startswith("## "), "markdown")
        .when(ext.isin(*["." + e for e in EXTENSION_CLASSES["source_code"]]) | starts(CODE_STARTS), "source_code")
        .otherwise("plain_text")
    )


def whole_characters(content: Column) -> Column:
    """Bytes of a prefix without the last character, if the end of the PREFIX bytes cuts it."""
    # Up to three bytes of a character that goes on.
    cut = F.regexp_extract(F.hex(F.substring(content, -3, 3)), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", 0)
    whole = (F.octet_length(content) != PREFIX) | F.is_valid_utf8(content.cast("string"))
    return F.when(whole, content).otherwise(F.substring(content, F.lit(1), (F.octet_length(content) - F.length(cut) / 2).cast("int")))


def wide_text(content: Column) -> Column:
    """Text of UTF-16 bytes, known by their mark; else null."""
    hexed = F.hex(F.substring(content, 1, 2))
    return F.when(hexed.isin("FFFE", "FEFF"), F.try_validate_utf8(F.decode(content, "UTF-16")))


def narrow_text(content: Column) -> Column:
    """Text of UTF-8 bytes, or bytes read one to one as Latin-1 characters where they are none."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def magic_class(content: Column) -> Column:
    """Class by magic numbers and, of bytes that are no UTF-8, by their printable share; else null."""
    hexed = F.hex(F.substring(content, 1, 8))
    printable = F.length(F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]+", ""))
    return (
        F.when(hexed.startswith("1F8B"), "other_binary")
        .when(hexed.startswith("89504E470D0A1A0A") | hexed.startswith("FFD8FF"), "image")
        .when(~F.is_valid_utf8(content.cast("string")) & (printable * 100 < F.octet_length(content) * 90), "other_binary")
    )


def content_class_bytes(content: Column, name: Column) -> Column:
    """content_class of bytes: UTF-16 by its mark, binary by magic numbers and printable share.

    `census.classified` does the same for a table, in steps, and minds cut characters.
    """
    wide = wide_text(content)
    return F.coalesce(F.when(wide.isNotNull(), content_class(wide, name)), magic_class(content), content_class(narrow_text(content), name))


def encoding(content: Column, kind: Column) -> Column:
    """Encoding label of bytes with a known content class."""
    hexed = F.hex(F.substring(content, 1, 3))
    return (
        F.when(hexed.startswith("FFFE") | hexed.startswith("FEFF"), "utf16")
        .when(hexed == "EFBBBF", "utf8_bom")
        .when(kind.isin("other_binary", "image", "pdf"), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "latin1_like")
        .otherwise("utf8")
    )


#: Scripts in order of precedence at ties, with their letters.
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "arabic": r"\p{IsArabic}"}


def letters(text: Column) -> Column:
    """Letters per script, and all of them, as a struct; null for a text of ASCII alone."""
    count = lambda cls: F.length(text) - F.length(F.regexp_replace(text, f"[{cls}&&[\\p{{L}}]]+", ""))
    counts = [count(cls).alias(name) for name, cls in {**SCRIPTS, "all": r"\p{L}"}.items()]
    return F.when(F.octet_length(text) != F.char_length(text), F.struct(*counts))


def script(text: Column, encoding_label: Column, counts: Column | None = None) -> Column:
    """Dominant script of the letters; ties go to the one named first.

    counts: `letters` of the text, where a caller has them as a column.
    """
    n = letters(text) if counts is None else counts
    other = n["all"]
    for name in SCRIPTS:
        other = other - n[name]
    # The greatest count, and of equal ones that of the first name.
    ranked = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("place")) for i, c in enumerate([*(n[k] for k in SCRIPTS), other])]))
    told = F.when(ranked["n"] == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, [*SCRIPTS, "other"])), F.lit(1) - ranked["place"]))
    return (
        F.when(encoding_label == "binary", "non_text")
        .when(n.isNull(), F.when(text.rlike("[A-Za-z]"), "latin").otherwise("other"))
        .otherwise(told)
    )


def emails(text: Column) -> Column:
    """Number of addresses: per @, at most 64 local and 186 domain characters around it."""
    parts = F.split(text, "@")
    local = lambda left: F.regexp_extract(left, f"({LOCAL}{{1,64}})$", 1)
    cut = lambda left: (F.length(local(left)) == 64) & F.substring(left, -65, 1).rlike("^[A-Za-z0-9_]") & (F.length(left) > 64)
    hit = lambda left, right: (local(left) != "") & ~cut(left) & F.substring(right, 1, 186).rlike(DOMAIN)
    around = F.sequence(F.lit(0), F.size(parts) - 2)
    found = F.filter(around, lambda i: hit(F.get(parts, i), F.get(parts, i + 1)))
    return F.when(text.contains("@"), F.size(found)).otherwise(0)


def _tagged(text: Column, pattern: str) -> Column:
    """All leftmost matches whose neighbours are no word characters, as an array."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), f"({pattern})", "\x01$1\x02")
    return F.regexp_extract_all(marked, F.lit("(?<![A-Za-z0-9_]\\x02?)\\x01([^\\x02]*)\\x02(?!\\x01?[A-Za-z0-9_])"), F.lit(1))


def phone_shape(match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return digits.between(8, 15) & match.rlike(r"^\+|[ ().-]")


def phones(text: Column) -> Column:
    """Number of phone numbers on lines without ids, dates, versions and hex numbers."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[0-9]") & ~line.rlike(PHONE_EXCLUDED))
    found = F.filter(F.flatten(F.transform(lines, lambda line: _tagged(line, PHONE))), phone_shape)
    return F.when(text.rlike("[0-9]"), F.size(found)).otherwise(0)


def entropy_bits(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def _secret_value(match: Column) -> Column:
    at = F.when(match.contains("="), F.instr(match, "=")).otherwise(F.instr(match, ":"))
    return F.regexp_replace(match.substr(at + 1, F.length(match)), "^[ \\t\"']+|[ \\t\"']+$", "")


def _any_of(low: Column, literals: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(x) for x in literals])


def credentials(text: Column, low: Column | None = None) -> Column:
    """Number of credentials; assigned values need 3.5 bits of entropy. low: the text in lower case, if it is there."""
    real = lambda m: ~m.rlike("[=:]") | (entropy_bits(_secret_value(m)) >= MIN_ENTROPY)
    hinted = _any_of(F.lower(text) if low is None else low, CREDENTIAL_HINTS)
    return F.when(hinted, F.size(F.filter(_tagged(text, CREDENTIAL), real))).otherwise(0)


def licence_families(text: Column, low: Column | None = None) -> Column:
    """Families whose texts occur, in their fixed order; each pattern is tried where one of its literals stands. low: the text in lower case, if it is there."""
    low = F.lower(text) if low is None else low
    flags = [F.when(_any_of(low, LICENCE_HINTS[k]), F.when(text.rlike(f"(?i)(?:{p})"), F.lit(k))) for k, p in LICENCES.items()]
    return F.array_compact(F.array(*flags))


def size_bucket(n: Column) -> Column:
    kb = 1 << 10
    return (
        F.when(n == 0, "0").when(n < kb, "<1KB").when(n < 10 * kb, "<10KB").when(n < 100 * kb, "<100KB")
        .when(n < kb * kb, "<1MB").when(n < 10 * kb * kb, "<10MB").when(n < 100 * kb * kb, "<100MB").otherwise(">=100MB")
    )


def count_band(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").when(n < 1000, "100-999").otherwise("1000+")


def request_band(n: Column) -> Column:
    """count_band below 1000, then doubling bands up to 1,023,999."""
    low = (1000 * F.pow(F.lit(2), F.floor(F.log2(n / 1000)))).cast("bigint")
    return F.when(n < 1000, count_band(n)).when(n < 1_024_000, F.concat(low.cast("string"), F.lit("-"), (2 * low - 1).cast("string"))).otherwise("")


def size_class(total: Column) -> Column:
    return F.when(total < 10_000_000, "small").when(total < 100_000_000, "medium").otherwise("large")

"""Keyed identifiers as Columns: HMAC-SHA-256 out of Spark's own sha2."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .content import MEDIA_EXTENSIONS, lookup

#: Derivation labels of the two keys; another system's labels can be passed instead.
ID_LABEL, COMMITMENT_LABEL = "file-id/v1", "content-commitment/v1"


def derive_keys(secret: bytes, labels: tuple[str, str] = (ID_LABEL, COMMITMENT_LABEL)) -> tuple[str, str]:
    """(id key, commitment key) as hex, by HKDF-SHA-256 without salt; once, on the driver."""
    if len(secret) != 32:
        raise ValueError("the secret must have 32 bytes")
    root = hmac.digest(bytes(32), secret, "sha256")
    return tuple(hmac.digest(root, label.encode() + b"\x01", "sha256").hex() for label in labels)


def pads(key_hex: str) -> tuple[str, str]:
    """The key's inner and outer pad as hex."""
    key = bytes.fromhex(key_hex)
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """Hex HMAC of a binary message; both passes stay in generated code."""
    inner, outer = pads(key_hex)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)


def joined(*parts: Column) -> Column:
    """Parts joined by zero bytes, as binary."""
    out = parts[0].cast("binary")
    for p in parts[1:]:
        out = F.concat(out, F.unhex(F.lit("00")), p.cast("binary"))
    return out


def file_id(id_key: str, source: Column, relative: Column) -> Column:
    return F.substring(hmac_sha256(id_key, joined(source, relative)), 1, 32)


def content_commitment(commitment_key: str, sha256_hex: Column) -> Column:
    return hmac_sha256(commitment_key, F.unhex(sha256_hex))


def object_id(key_hex: str, kind: str, scope: str, identity: Column, sha256_hex: Column) -> Column:
    return hmac_sha256(key_hex, joined(F.lit("object"), F.lit(kind), F.lit(scope), identity, sha256_hex))


def locator_commitment(key_hex: str, kind: str, scope: str, manifest_hash: Column) -> Column:
    return hmac_sha256(key_hex, joined(F.lit(kind), F.lit(scope), manifest_hash))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. All rows go through Arrow, ASCII too: `identities` parts them first."""
    return _composed(text)


def identity(key: Column, etag: Column, version: Column, ascii_only: bool = False) -> Column:
    """Key and pin joined by a zero character; a version wins over the etag, "null" is no version."""
    pin = F.coalesce(F.nullif(F.nullif(version, F.lit("null")), F.lit("")), etag)
    compose = (lambda c: c) if ascii_only else nfc
    return F.when((key != "") & (pin != "") & ~F.contains(F.concat(key, pin), F.lit("\x00")), F.concat(compose(key), F.lit("\x00"), compose(pin)))


def identities(df: DataFrame, key: str, etag: str, version: str, name: str = "identity") -> DataFrame:
    """df with the identity of its columns key, etag and version; only rows with letters beyond ASCII leave the JVM."""
    c, all_text = F.col, F.concat_ws("", key, etag, version)
    plain = F.octet_length(all_text) == F.char_length(all_text)
    near = df.where(plain).withColumn(name, identity(c(key), c(etag), c(version), ascii_only=True))
    far = df.where(~plain).withColumn(name, identity(c(key), c(etag), c(version)))
    return near.unionByName(far)


def display_name(id_: Column, media_type: Column, alias_full: Column | None = None, alias_rel: Column | None = None) -> Column:
    """The alias of source/path, else of the path, else a neutral name."""
    neutral = F.when(F.length(id_) >= 8, F.concat(F.lit("file-"), F.lower(F.substring(id_, 1, 8)), F.lit("."), lookup(media_type, MEDIA_EXTENSIONS, "bin")))
    given = [F.nullif(a, F.lit("")) for a in (alias_full, alias_rel) if a is not None]
    return F.coalesce(*given, neutral)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the row as JSON with sorted keys; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def is_utc_micros(text: Column) -> Column:
    """RFC 3339 in UTC, at most microseconds."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$")
    return F.coalesce(shape & F.try_to_timestamp(text).isNotNull(), F.lit(False))

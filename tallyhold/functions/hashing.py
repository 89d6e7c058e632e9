"""Column functions: hashes, hex, path keys, object keys, saturating ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhold.schemas import BODY


def content_hash(data: Column) -> Column:
    """SHA-256 of bytes (or of a text's UTF-8), in lower-case hex."""
    return F.sha2(data, 256)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def is_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def sized(value: Column) -> Column:
    """The value's text with its length before it, '-' for null: a row of such fields has one reading only."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def body_hash(*columns: str) -> Column:
    """Hash of an event's own fields, without its predecessor."""
    return F.sha2(F.concat(*(sized(F.col(c)) for c in columns or BODY)), 256)


def link_hash(prev: Column, body: Column) -> Column:
    """An event's hash: that of its predecessor's hash and its own body's."""
    return F.sha2(F.concat(prev, body), 256)


def path_key(raw: Column) -> Column:
    """A path's bytes as text: as they are if they are UTF-8 that doesn't begin with NUL, else NUL and their hex."""
    text = raw.cast("string")
    plain = F.is_valid_utf8(text) & ~F.coalesce(F.substring(to_hex(raw), 1, 2) == "00", F.lit(False))
    return F.when(plain, text).otherwise(F.concat(F.char(F.lit(0)), to_hex(raw)))


def is_escaped(key: Column) -> Column:
    return F.startswith(key, F.char(F.lit(0)))


def path_bytes(key: Column) -> Column:
    """The bytes that a path key stands for."""
    return F.when(is_escaped(key), F.unhex(F.substring(key, 2, 2**30))).otherwise(key.cast("binary"))


def path_display(key: Column) -> Column:
    return F.when(is_escaped(key), F.concat(F.lit("<bytes:"), F.substring(key, 2, 2**30), F.lit(">"))).otherwise(key)


def under(path: Column, root: str) -> Column:
    """The root itself or anything below it; ``/data`` doesn't hold ``/data2``."""
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def chunk_key(chunk_id: Column) -> Column:
    return F.concat(F.lit("chunks/"), chunk_id)


def manifest_key(content: Column) -> Column:
    return F.concat(F.lit("manifests/"), content)


def segment_key(machine: Column, seq_start: Column) -> Column:
    return F.concat(F.lit("log/"), machine, F.lit("/"), F.lpad(seq_start.cast("string"), 20, "0"), F.lit(".seg"))


def snapshot_key(state_hash: Column) -> Column:
    return F.concat(F.lit("snapshots/"), state_hash)


def parse_segment_key(key: Column) -> Column:
    """struct(machine, seq_start) of ``log/<machine>/<20 digits>.seg``; null for any other key."""
    form = r"^log/([0-9a-f]{64})/([0-9]{20})\.seg$"
    return F.when(key.rlike(form), F.struct(F.regexp_extract(key, form, 1).alias("machine"), F.regexp_extract(key, form, 2).cast("long").alias("seq_start")))


def age(now: Column, then: Column) -> Column:
    """``now - then``, 0 at least."""
    return F.greatest(now - then, F.lit(0).cast("long"))


def seconds(n: Column) -> Column:
    """Seconds in nanoseconds, at most what a LONG holds."""
    most = 2**63 - 1
    return F.when(n > most // 10**9, F.lit(most)).otherwise(n * F.lit(10**9))


def supported(version: Column) -> Column:
    """The manifest's version, which must be 1."""
    return F.when(version == 1, version).otherwise(F.raise_error(F.concat(F.lit("manifest version "), version.cast("string"), F.lit(" isn't supported"))).cast("int"))

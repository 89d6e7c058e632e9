"""Table schemas of the inventory: hashes are lower-case hex strings, instants are nanoseconds in LONG."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: An event of a machine's log. Which columns are set depends on ``action``.
LOG = (
    "machine string, seq long, hlc long, action string, content string, path string, size long, mtime long, last_content string, "
    "root string, files_seen long, bytes_seen long, state_hash string, prev string, hash string, sig string"
)
#: What each row of a pushed segment says of the segment.
SEGMENT = "seq_start long, seq_end long, tip_hash string"
SYNCED = "machine string, last_seq long, hash string"
ACTIONS = ("observed", "vanished", "backed", "pass_completed", "snapshot")
#: Columns that an event's own hash covers, in order.
BODY = ("machine", "seq", "hlc", "action", "content", "path", "size", "mtime", "last_content", "root", "files_seen", "bytes_seen", "state_hash")
ZERO_HASH = "0" * 64
CATALOG = "path string, content string, size long, mtime long, file_id long, last_scan long"
WALK = "path string, size long, mtime long, file_id long, error string"
CHUNK_REFS = "content string, ordinal int, chunk_id string, offset long, size long, total_size long, version int, created_at long"
CHUNKS = "chunk_id string, data binary"

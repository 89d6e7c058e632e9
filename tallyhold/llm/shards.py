"""Training-order materialisation: fixed-stride shards in a keyed pseudo-random order.

Documents (token ids and an end id) run on through sequences of ``size`` tokens within each input partition; the
last sequence of a partition is padded. A keyed Feistel network with cycle-walking permutes [0, n): the i-th
sequence goes to the global slot P(i), each slot gets one sequence, and P needs no table. Shard k holds the
slots from k * per_shard on, in order; every record has the same stride, so slot s is the bytes from
(s mod per_shard) * stride of its shard, and a reader that stopped goes on from any slot.

Scale. The texts are tokenised once; their sequences are staged, compressed in groups, with their partition and number
there. The number of sequences of each partition (a row a partition comes to the driver) gives every sequence its index,
and the permutation its slot. Sequences go, in compressed groups for each task and shard, to the task that writes their
shard. Slots are uniform, so shards and tasks are even whatever the input's skew. A shard is held and written by one task,
under a name of its attempt that is then moved, so a lost executor's shard is simply written again.

Edge cases. A null or empty text is the end id alone; repeated rows are kept; very long texts run over many
sequences; an empty table writes no shard and returns no row; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import fresh_path, small_batches, staged, tidy
from tallyhold.llm.tokens import DEFAULT_RANKS, ROOM, pieces


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of [0, n)."""

    n: int
    key: bytes
    rounds: int = 6

    def _round(self, r: int, half: np.ndarray) -> np.ndarray:
        a, b = np.frombuffer(hashlib.blake2b(bytes([r]), key=self.key[:64], digest_size=16).digest(), "<u8")
        x = (half + a) * (b | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def __call__(self, index: np.ndarray) -> np.ndarray:
        """Slots of these indices: a balanced network on the next even number of bits, walked until inside."""
        half = max(1, (max(1, self.n - 1).bit_length() + 1) // 2)
        mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
        x = np.array(index, np.uint64)
        out, todo = x.copy(), np.arange(len(x))
        while len(todo):
            left, right = x >> shift, x & mask
            for r in range(self.rounds):
                left, right = right, left ^ (self._round(r, right) & mask)
            x = (left << shift) | right
            inside = x < np.uint64(self.n)
            out[todo[inside]] = x[inside]
            todo, x = todo[~inside], x[~inside]
        return out.astype(np.int64)


def sequences(batches: Iterator[pa.RecordBatch], path: str, width: int, size: int, end_id: int, pad_id: int, keep: int) -> Iterator[tuple[bytes, int, list]]:
    """Of one partition's (doc_id, text) rows: ids of each sequence, its number of real tokens, its doc_ids."""
    cache = pieces(path, width, max(keep, ROOM // 4))
    end, stride, held, docs = cache.pack([end_id]), size * width, bytearray(), []
    for b in small_batches(batches, 1024):
        for doc_id, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist()), strict=True):
            held += ids + end
            docs.append(doc_id)
            at = 0
            while len(held) - at >= stride:
                yield bytes(held[at : at + stride]), size, docs
                at += stride
                docs = [doc_id] if len(held) > at else []
            del held[:at]
    cache.rest(keep)
    if held:
        yield bytes(held) + cache.pack([pad_id]) * (size - len(held) // width), len(held) // width, docs


def materialise(docs: DataFrame, path: str | None = None, *, size: int = 2048, per_shard: int = 4096, key: bytes = b"training order", end_id: int = 1, pad_id: int = 0, width: int = 2, tokenizer: str | None = None, group: int = 64, keep: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path`` and return a row for each sequence.

    slot, shard, byte_offset, n_tokens (without padding), ids_crc32 (of the record), doc_ids (in order), file.
    A worker keeps about ``keep`` bytes of encoded parts of text from task to task.
    """
    spark, tok = docs.sparkSession, tokenizer or public_tokenizers.path(DEFAULT_RANKS)
    path = path or fresh_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = pa.list_(pa.list_(pa.int64()))

    @tidy
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, first = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3), 0
        found = sequences(batches, tok, width, size, end_id, pad_id, keep)
        while held := list(islice(found, group)):
            ids, real, docs_of = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), pa.array([list(real)], pa.list_(pa.int64())), pa.array([docs_of], members), pa.array([packer.compress(b"".join(ids))], pa.binary())], names=["part", "first", "n_tokens", "doc_ids", "ids"])
            first += len(held)

    held = staged(rows.mapInArrow(tokenise, "part long, first long, n_tokens array<long>, doc_ids array<array<long>>, ids binary"), "sequences")
    counts = {r.part: r.n for r in held.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n")).collect()}
    start, total = {}, 0
    for part in sorted(counts):
        start[part], total = total, total + counts[part]
    order, stride, shards = Feistel(max(1, total), key), size * width, -(-total // per_shard)
    schema = "slot long, shard int, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>, file string"
    if not total:
        return spark.createDataFrame([], schema)

    @tidy
    def place(batches: Iterator[pa.RecordBatch], most: int = 12_000) -> Iterator[pa.RecordBatch]:
        opener, packer, slots, real, docs_of, records = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            slot = np.array(slots, np.int64)
            by = np.argsort(slot)
            for own in np.split(by, np.flatnonzero(np.diff(slot[by] // per_shard)) + 1):
                pick = own.tolist()
                blob = packer.compress(b"".join(records[i] for i in pick))
                yield pa.RecordBatch.from_arrays([pa.array([slots[pick[0]] // per_shard], pa.int32()), pa.array([[slots[i] for i in pick]], pa.list_(pa.int64())), pa.array([[real[i] for i in pick]], pa.list_(pa.int64())), pa.array([[docs_of[i] for i in pick]], members), pa.array([blob], pa.binary())], names=["shard", "slots", "n_tokens", "doc_ids", "ids"])

        for b in small_batches(batches, 16):
            for part, first, tokens, docs_in, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, n = opener.decompress(ids, max_output_size=group * stride), len(tokens)
                slots += order(np.arange(start[part] + first, start[part] + first + n)).tolist()
                real += tokens
                docs_of += docs_in
                records += [raw[i * stride : (i + 1) * stride] for i in range(n)]
            if len(slots) >= most:
                yield from out()
                for kept in (slots, real, docs_of, records):
                    kept.clear()
        if slots:
            yield from out()

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        opener = zstandard.ZstdDecompressor()

        def finish(shard: int, slots: list, real: list, docs_of: list, records: list) -> pa.RecordBatch:
            by = np.argsort(np.array(slots, np.int64)).tolist()
            name = f"shard-{shard:07d}.bin"
            own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as file:
                for i in by:
                    file.write(records[i])
            store.move(own, f"{root}/{name}")
            slot = np.array(slots, np.int64)[by]
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(np.full(len(by), shard), pa.int32()), pa.array(slot % per_shard * stride), pa.array([real[i] for i in by], pa.int64()), pa.array([zlib.crc32(records[i]) for i in by], pa.int64()), pa.array([docs_of[i] for i in by], pa.list_(pa.int64())), pa.array([name] * len(by), pa.string())],
                names=["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids", "file"],
            )

        groups = (r for b in small_batches(batches, 16) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, parts in groupby(groups, lambda r: r[0]):
            slots, real, docs_of, records = [], [], [], []
            for _, slot, tokens, docs_in, ids in parts:
                raw = opener.decompress(ids, max_output_size=per_shard * stride)
                slots += slot
                real += tokens
                docs_of += docs_in
                records += [raw[i * stride : (i + 1) * stride] for i in range(len(slot))]
            yield finish(shard, slots, real, docs_of, records)

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    placed = held.mapInArrow(place, "shard int, slots array<long>, n_tokens array<long>, doc_ids array<array<long>>, ids binary")
    return staged(placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(write, schema), "shard-index")


def read(path: str, shard: int, start: int, n: int, *, size: int = 2048, width: int = 2) -> np.ndarray:
    """``n`` records of a shard from its ``start``-th on: one seek, one sequential read."""
    store, root = fs.FileSystem.from_uri(path)
    stride = size * width
    with store.open_input_file(f"{root}/shard-{shard:07d}.bin") as f:
        f.seek(start * stride)
        return np.frombuffer(f.read(n * stride), f"<u{width}").reshape(-1, size)

"""Exact Jaccard self-join of shingle sets by a size-aware heavy-light join, down to its components.

Small (light) sets meet by enumeration: a pair of sizes n <= m links just if they share at least
c = ceil(t (n + m) / (1 + t)) shingles, so each set emits its subsets of size c for each partner size, and sets that emit
the same subset are candidates. Large (heavy) sets meet by scanning inverted lists: of each set the rarest shingles are listed,
as many as two linked sets can't both miss (n - ceil(t n) + 1). The boundary between light and heavy is the size at which
enumeration would cost more than scanning and checking, by the measured share of shingles that repeat. Sets on both sides
of the boundary that can link emit both.

Every list names its least member as its lead. The members of all lists of one lead are brought together, in blocks, and
checked there by their whole sets: first against the lead; members that link to it are in one component already, so only
those that don't are checked against all others. Links between all pairs of a group of copies are thus never enumerated
and yet no component is lost: two sets that share a list share a lead.

Scale. Equal sets become one within each task before anything is shuffled by shingle. The counts of all shingles are
taken by a shuffle of packed, sorted, difference-coded hashes; the order of listing needs their magnitude only, which is
broadcast in a table of fixed size (``CELLS`` half bytes, the most frequent shingle of each cell; a cell that shingles share
changes work, never results). Where more shingles repeat than half of the cells, nothing is broadcast: each partition of the texts
is sent the magnitudes of its own shingles that repeat, in a file that its task reads, so their rank is kept however large the
corpus. Postings are shuffled packed, a blob for each task and bucket; buckets are cut to ``bucket_rows`` postings, and lists of
shingles that 2^``hot_level`` sets or more have are spread over buckets, and met by an aggregate and a join.
Packed hashes are deleted once they are counted, and files of a shuffle once what is made of it is written.
Whole sets are fetched only for texts that have a candidate (a broadcast of their places up to ``BROADCAST_BYTES``, a shuffle beyond).
Members of a lead are met in blocks of about ``block_bytes`` of sets. Components are found by alternating large and small stars
(Kiveris et al., "Connected components in MapReduce and beyond", SoCC 2014), in a number of rounds that grows with the logarithm
of the links, whatever a component's diameter; each round is a written table, and the one before it is deleted. What a component
is called (its least doc_id) and which row it keeps both come from its least row (by doc_id, null last, then row number).

Edge cases. Null texts, empty texts and texts without words have the empty set and link with nothing, not even each
other. Texts of fewer than ``n`` words have one shingle, all their words. Repeated rows are equal sets. Equal doc_ids in
several rows, or null ones, don't make a component: only links do. Ties of frequency are listed by hash. Very long texts are
sets like any other, read whole. Other columns are never read. An empty table gives an empty result. ``docs`` must be a table as
read, so that its rows have the same numbers each time. Sets are told apart by 64 bits of a hash; two different ones that share
these are found by 64 further bits, and then all begins again with another seed, so they are never taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, groupby
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import dropped, freed, give_back, small_batches, staged, tidy, without

BROADCAST_BYTES = 32_000_000
SALTS = 64
#: Cells of the space of hashes in which levels are kept.
CELL_BITS = 26
CELLS = 1 << CELL_BITS
#: What checking a candidate costs, in postings.
CHECK = 50.0


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles of ``n`` words; white space is ASCII, A-Z is lower-cased."""

    def __init__(self, n: int, cap: int = 150_000):
        self.n, self.cap = n, cap
        self.seen = _Hashes()
        self.factor = np.random.default_rng(20240607).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > self.cap:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:
            short = (h * self.factor[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
            return _mix(np.array([short], np.uint64))
        count = len(h) - self.n + 1
        total = np.zeros(count, np.uint64)
        for i in range(self.n):
            total += h[i : i + count] * self.factor[i]
        total = _mix(total)
        total.sort()
        return total[np.r_[True, total[1:] != total[:-1]]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def identity(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A signed 64-bit id of a set, and 64 bits more to tell apart sets of one id."""
    h = hashlib.blake2b(tokens.tobytes(), digest_size=16, key=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def least_overlap(n: int, m: int, t: int) -> int:
    """Least intersection with which sizes n and m reach the similarity t per cent."""
    return -(-t * (n + m) // (100 + t))


def partners(n: int, t: int) -> range:
    """Sizes that a set of size n can link with."""
    return range(-(-t * n // 100), 100 * n // t + 1)


def prefix(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def boundary(t: int, repeats: float, limit: int = 40) -> int:
    """The size from which sets are heavy: the first at which subsets cost more than lists and checks.

    ``repeats``: the share of shingles that other sets have too, as measured.
    """
    n = 1
    while n < limit:
        subsets = sum(comb(n, least_overlap(n, m, t)) for m in partners(n, t))
        if subsets > prefix(n, t) * (1 + CHECK * repeats):
            break
        n += 1
    return n


def subset_keys(tokens: np.ndarray, t: int, below: int) -> list[int]:
    """Keys of the subsets that a light set emits for its light partner sizes."""
    n, own, out = len(tokens), tokens.tolist(), []
    for m in partners(n, t):
        if m < below:
            c = least_overlap(n, m, t)
            sizes = (min(n, m) << 20) + max(n, m)
            out += [(sum(s) + sizes * 0x9E3779B97F4A7C15) & (2**64 - 1) for s in combinations(own, c)]
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The values' bytes, all lowest first: the high ones of small values compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _bits(texts: DataFrame) -> tuple[int, int]:
    """Of the shingles' hashes the bits that are counted, so many that few shingles share them, and the bits of them that
    name a bucket, so many that a bucket has the shingles of about 8 MB of text."""
    volume = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    return min(62, max(40, 18 + volume.bit_length())), min(20, max(2, (volume // 8_000_000).bit_length()))


def _members(texts: DataFrame, n: int, bits: int, part_bits: int, seed: int) -> DataFrame:
    """(uid, doc_id, size, kid, more) of each row; and, in rows of their own and ``counted``, (bucket, part, blob) of counted shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, held, size, part = Shingler(n), set(), [], 0, 0
        packer = zstandard.ZstdCompressor(level=1)
        names = ["uid", "doc_id", "size", "kid", "more", "bucket", "part", "blob", "counted"]

        def counted() -> pa.RecordBatch:
            tokens = np.concatenate([*held, np.zeros(0, np.uint64)])
            tokens.sort()
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            sets = np.diff(np.r_[first, len(tokens)])
            tokens = tokens[first] >> np.uint64(64 - bits)
            cuts = np.searchsorted(tokens, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(bits - part_bits))
            bucket, blob = [], []
            for k in np.flatnonzero(np.diff(cuts)):
                own, times = tokens[cuts[k] : cuts[k + 1]], np.minimum(sets[cuts[k] : cuts[k + 1]], 65535)
                more = np.flatnonzero(times > 1)
                raw = len(own).to_bytes(4, "little") + len(more).to_bytes(4, "little") + _planes(np.diff(own, prepend=np.uint64(0)), 8) + more.astype("<u4").tobytes() + times[more].astype("<u2").tobytes()
                bucket.append(int(k))
                blob.append(packer.compress(raw))
            none = pa.nulls(len(bucket), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(bucket, pa.int32()), pa.array([part] * len(bucket), pa.int32()), pa.array(blob, pa.binary()), pa.array([True] * len(bucket), pa.bool_())], names=names)

        for b in small_batches(batches):
            sizes, kids, more = [], [], []
            part = part_of(b)
            for text in b.column(2).to_pylist():
                tokens = shingler(text)
                kid, rest = identity(tokens, seed)
                sizes.append(len(tokens))
                kids.append(kid)
                more.append(rest)
                if len(tokens) and kid not in known:
                    known.add(kid)
                    held.append(tokens)
                    size += len(tokens)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(kids, pa.int64()), pa.array(more, pa.int64()), pa.nulls(len(kids), pa.int32()), pa.nulls(len(kids), pa.int32()), pa.nulls(len(kids), pa.binary()), pa.array([False] * len(kids), pa.bool_())], names=names)
            if size > 2_000_000:
                yield counted()
                known.clear()
                held.clear()
                size = 0
        yield counted()

    return staged(texts.mapInArrow(run, "uid long, doc_id long, size long, kid long, more long, bucket int, part int, blob binary, counted boolean"), "sets", partitionBy="counted")


def _counted(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed shingles: the shingles, the sets that have them, and how many each blob has."""
    opener, tokens, sets = zstandard.ZstdDecompressor(), [], []
    for blob in blobs:
        raw = opener.decompress(blob)
        n, m = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
        tokens.append(np.cumsum(_unplanes(raw[8 : 8 + 8 * n], 8)))
        times = np.ones(n, np.int64)
        times[np.frombuffer(raw, "<u4", m, 8 + 8 * n)] = np.frombuffer(raw, "<u2", m, 8 + 8 * n + 4 * m)
        sets.append(times)
    return np.concatenate(tokens), np.concatenate(sets), np.array([len(x) for x in tokens])


def _levels(blobs: DataFrame, bits: int, part_bits: int) -> tuple[np.ndarray | None, float]:
    """The table of levels (none, if it had more than half of its cells used), and the share of shingles that several sets have.

    A cell is half a byte: the log2 of the most sets that one of its shingles is in; 0 if no other set has one. A set lists a quarter
    of its shingles, so while half of the cells are free enough of those that no other set has keep the level 0.
    """

    def run(group: pa.Table) -> pa.Table:
        token, times, _ = _counted(group.column("blob").to_pylist())
        by = np.argsort(token)
        token, times = token[by], times[by]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        times = np.add.reduceat(times, first)
        several = times > 1
        bucket = group.column("bucket")[0].as_py()
        cell = (token[first[several]] >> np.uint64(bits - CELL_BITS)).astype(np.int64) - (bucket << (CELL_BITS - part_bits))
        level = np.zeros(CELLS >> part_bits, np.uint8)
        np.maximum.at(level, cell, np.log2(times[several]).astype(np.uint8))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "levels": pa.array([zstandard.compress(level.tobytes(), 1)], pa.binary()), "used": pa.array([int(several.sum())], pa.int64()), "several": pa.array([int(times[several].sum())], pa.int64()), "all": pa.array([int(times.sum())], pa.int64())})

    with freed(blobs.sparkSession):
        found = blobs.groupBy("bucket").applyInArrow(run, "bucket int, levels binary, used long, several long, all long").collect()
    used, several, whole = (sum(r[c] for r in found) for c in ("used", "several", "all"))
    table, part = None, CELLS >> part_bits
    if used <= CELLS // 2:
        table = np.zeros(CELLS, np.uint8)
        for r in found:
            table[r.bucket * part : (r.bucket + 1) * part] = np.frombuffer(zstandard.decompress(r["levels"]), np.uint8)
        for i in range(0, CELLS, 1 << 22):
            np.minimum(table[i : i + (1 << 22)], 15, out=table[i : i + (1 << 22)])
        table = table[::2] | (table[1::2] << 4)
    return table, several / max(1, whole)


def _level(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    # two cells a byte
    cell = tokens >> np.uint64(64 - len(table).bit_length())
    return (table[cell >> np.uint64(1)] >> ((cell & np.uint64(1)).astype(np.uint8) << 2)) & np.uint8(15)


def part_of(batch: pa.RecordBatch) -> int:
    """The partition whose rows these are, by the number of the first (``monotonically_increasing_id``); 0 without rows."""
    return batch.column(0)[0].as_py() >> 33 if batch.num_rows else 0


def _own_levels(blobs: DataFrame) -> str:
    """Where a file for each partition of the texts has the levels of those of its shingles that several sets have."""

    def run(group: pa.Table) -> pa.Table:
        token, times, sizes = _counted(group.column("blob").to_pylist())
        token, at = np.unique(token, return_inverse=True)
        times = np.bincount(at, times).astype(np.int64)
        part = np.repeat(group.column("part").to_numpy(), sizes)
        several = times[at] > 1
        part, at = part[several], at[several]
        by = np.lexsort((at, part))
        part, at = part[by], at[by]
        rows = []
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
            some = np.unique(at[own])
            raw = _planes(np.diff(token[some], prepend=np.uint64(0)), 8) + np.log2(times[some]).astype(np.uint8).tobytes()
            rows.append((int(part[own[0]]), len(some), zstandard.compress(raw, 1)))
        part, n, blob = zip(*rows, strict=True) if rows else ((), (), ())
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array([bucket] * len(part), pa.int32()), "n": pa.array(n, pa.int32()), "blob": pa.array(blob, pa.binary())})

    rows = blobs.groupBy("bucket").applyInArrow(run, "part int, bucket int, n int, blob binary")
    return staged(rows.repartition("part").sortWithinPartitions("part", "bucket"), "own-levels", partitionBy="part").staged_at


def _read_levels(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The counted bits, ascending, of the shingles that ``_own_levels`` has written for a partition, and their levels."""
    store, at = fs.FileSystem.from_uri(f"{path}/part={part}")
    tokens, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    rows = []
    for file in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as f:
                got = pa.parquet.ParquetFile(f).read(["bucket", "n", "blob"])
            rows += zip(*(got.column(c).to_pylist() for c in ("bucket", "n", "blob")), strict=True)
    for _, n, blob in sorted(rows, key=lambda r: r[0]):
        raw = zstandard.decompress(blob)
        tokens.append(np.cumsum(_unplanes(raw[: 8 * n], 8)))
        levels.append(np.frombuffer(raw, np.uint8, n, 8 * n))
    return np.concatenate(tokens), np.concatenate(levels)


#: Marks the postings of very long lists, which lie in several buckets.
HOT = np.uint32(1 << 31)


def _postings(texts: DataFrame, n: int, t: int, light: int, levels: np.ndarray | str, bits: int, buckets: int, very: int, seed: int) -> DataFrame:
    """Packed postings: bucket, keys, ids of the sets that have any, and a blob of each posting's set.

    ``levels``: the table, or where the levels of each partition lie. Lists of shingles of the level ``very``, or more, are spread
    over buckets by their sets.
    """
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sent.value, None
        shingler, known, keys, ids, hot, held = Shingler(n), set(), [], [], [], 0
        packer = zstandard.ZstdCompressor(level=1)

        def out() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key = np.concatenate(keys)
            of = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
            kid, often = np.array(ids, np.int64), np.concatenate(hot)
            bucket = ((key >> np.uint64(40)) + np.where(often, kid[of].view(np.uint64) >> np.uint64(44), np.uint64(0))) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(starts)):
                part = by[starts[k] : starts[k + 1]]
                sets, at = np.unique(of[part], return_inverse=True)
                rows.append((int(k), key[part].tobytes(), kid[sets].tobytes(), packer.compress((at.astype("<u4") | np.where(often[part], HOT, np.uint32(0))).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "kids", "blob"])

        def level_of(tokens: np.ndarray) -> np.ndarray:
            if own is None:
                return _level(table, tokens)
            counted = tokens >> np.uint64(64 - bits)
            at = np.searchsorted(own[0], counted)
            at[at == len(own[0])] = 0
            return np.where(own[0][at] == counted, own[1][at], np.uint8(0)) if len(own[0]) else np.zeros(len(tokens), np.uint8)

        for b in small_batches(batches):
            if isinstance(table, str) and own is None and b.num_rows:
                own = _read_levels(table, part_of(b))
            for text in b.column(2).to_pylist():
                tokens = shingler(text)
                size = len(tokens)
                kid, _ = identity(tokens, seed)
                if not size or kid in known:
                    continue
                known.add(kid)
                mine = subset_keys(tokens, t, light) if size < light else []
                often = np.zeros(len(mine), bool)
                if max(partners(size, t)) >= light:
                    level = level_of(tokens)
                    # tokens ascend, and a stable sort keeps that within a level
                    pick = np.argsort(level, kind="stable")[: prefix(size, t)]
                    mine = np.concatenate([np.array(mine, np.uint64), tokens[pick]])
                    often = np.concatenate([often, level[pick] >= very])
                keys.append(np.array(mine, np.uint64))
                ids.append(kid)
                hot.append(often)
                held += len(mine)
            if held > 1_000_000:
                yield from out()
                keys.clear(), ids.clear(), hot.clear(), known.clear()
                held = 0
        yield from out()

    return texts.mapInArrow(run, "bucket int, keys binary, kids binary, blob binary")


def _leads(postings: DataFrame) -> DataFrame:
    """(lead, kid): the other members of each list beside its least member, once each.

    Very long lists come in pieces: of these the least member is found by an aggregate, and met by a join.
    """

    def run(group: pa.Table) -> pa.Table:
        keys, kids, hots = [], [], []
        opener = zstandard.ZstdDecompressor()
        for key, kid, blob in zip(*(group.column(c).to_pylist() for c in ("keys", "kids", "blob")), strict=True):
            at = np.frombuffer(opener.decompress(blob), "<u4")
            keys.append(np.frombuffer(key, np.uint64))
            kids.append(np.frombuffer(kid, np.int64)[at & ~HOT])
            hots.append(at >= HOT)
        key, kid, hot = np.concatenate(keys), np.concatenate(kids), np.concatenate(hots)
        pieces = np.unique(np.stack([key[hot].view(np.int64), kid[hot]], 1), axis=0)
        key, kid = key[~hot], kid[~hot]
        by = np.argsort(key, kind="stable")
        key, kid = key[by], kid[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(key)])
        several = np.repeat(length > 1, length)
        lead = np.repeat(np.minimum.reduceat(kid, first), length)[several] if len(key) else kid
        pairs = np.unique(np.stack([lead, kid[several]], 1)[lead != kid[several]], axis=0)
        out = pa.table(
            {
                "lead": pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), pa.nulls(len(pieces), pa.int64())]),
                "kid": pa.array(np.r_[pairs[:, 1], pieces[:, 1]], pa.int64()),
                "key": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pieces[:, 0], pa.int64())]),
            }
        )
        del key, kid, keys, kids, several, lead, hots, hot
        give_back()
        return out

    found = staged(postings.groupBy("bucket").applyInArrow(run, "lead long, kid long, key long"), "lists")
    long = found.where("key is not null").select("key", "kid")
    least = long.groupBy("key").agg(F.min("kid").alias("lead"))
    long = long.join(least, "key").where(F.col("kid") != F.col("lead")).select("lead", "kid")
    return staged(found.where("key is null").select("lead", "kid").unionByName(long).distinct(), "leads")


def _streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with equal first ``keys`` columns, of batches that are sorted by them."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


class _Joined:
    """Union-find over the sets at hand; ``join`` says whether it has joined what was apart."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = self.top
        while (y := top.setdefault(x, x)) != x:
            top[x] = top[y]
            x = top[y]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.top[a] = b
        return a != b


class _Lists:
    """Inverted lists over the whole sets of some members."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.kids = [m[0] for m in members]
        self.sizes = np.array([len(m[1]) for m in members], np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *(m[1] for m in members)])
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by], np.repeat(np.arange(len(members)), self.sizes)[by]

    def links(self, kid: int, own: np.ndarray, t: int) -> Iterator[int]:
        """Members other than ``kid`` that reach the similarity with its set."""
        low, high = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.kids))
        for k in np.flatnonzero(100 * both >= t * (self.sizes + len(own) - both)):
            if self.kids[k] != kid:
                yield self.kids[k]


def _joining(head: int, linked: list[tuple[int, np.ndarray]], apart: list[tuple[int, np.ndarray]], t: int) -> Iterator[tuple[int, int]]:
    """Links that join the sets of one block, beyond those to its lead: of a component that grows no more are given than join it.

    One component is fixed, the lead's or that of the first set apart, whichever is larger once that set has been held
    against all. Sets in it needn't be held against the others: any set outside it is, and so are those that link to the lead
    where the lead's component isn't the fixed one, until it joins that.
    """
    if not apart:
        return
    lists, joined, home = _Lists([*linked, *apart]), _Joined(), None
    for kid, _ in linked:
        joined.join(kid, head)
    for kid, own in [*apart, *linked]:
        if home is not None and joined.find(kid) == joined.find(home):
            continue
        near = [m for m in lists.links(kid, own, t) if joined.join(kid, m)]
        yield from ((kid, m) for m in near)
        if home is None:
            home = head if len(linked) >= len(near) else kid


def _links(leads: DataFrame, texts: DataFrame, kinds: DataFrame, n: int, t: int, block_bytes: int) -> DataFrame:
    """(a, b): links that join up all sets that link at all."""
    sized = staged(leads.join(kinds.select("kid", (F.col("size") * 8 + 64).alias("bytes")), "kid"), "sized-leads")
    blocks = sized.groupBy("lead").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("blocks"))
    spread = sized.drop("bytes").join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("kid"), F.col("blocks")).cast("int"))
    spread = staged(spread, "blocks")
    to = F.struct("lead", "block", "blocks", F.lit(1).alias("role")).alias("to")
    heads = spread.select("lead", "block", "blocks").distinct().select(F.col("lead").alias("kid"), F.struct("lead", "block", "blocks", F.lit(0).alias("role")).alias("to"))
    first = _sent(spread.select("kid", to).unionByName(heads), texts, kinds, n)

    @tidy
    def against_lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead, _block, n), rows in _streamed(batches, 3):
            got = [(kid, np.frombuffer(tokens, np.uint64)) for _, kid, tokens in rows]
            head, members = got[0], got[1:]
            linked, apart = [], []
            for m in members:
                both = overlap(head[1], m[1])
                (linked if 100 * both >= t * (len(head[1]) + len(m[1]) - both) else apart).append(m)
            out = [(lead, kid, None) for kid, _ in linked]
            if n == 1:
                out += [(a, b, None) for a, b in _joining(lead, linked, apart, t)]
            else:
                out += [(lead, kid, n) for kid, _ in apart]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "blocks"])

    sort = ["lead", "block", "blocks", "role", "kid"]
    first = first.repartition("lead", "block").sortWithinPartitions(*sort).mapInArrow(against_lead, "a long, b long, blocks int")
    first = staged(first, "links")
    apart = first.where("blocks is not null").select(F.col("a").alias("lead"), F.col("b").alias("kid"), "blocks")
    done = first.where("blocks is null").select("a", "b")

    if apart.isEmpty():
        return done
    # leads of several blocks: what isn't linked to the lead is checked against each block
    probes = apart.select("kid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "lead", "blocks").select("kid", F.struct("lead", "block", "blocks", F.lit(0).alias("role")).alias("to"))
    targets = spread.join(apart.select("lead").distinct(), "lead", "left_semi").select("kid", to)
    more = _sent(targets.unionByName(probes), texts, kinds, n)

    @tidy
    def against_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches, 3):
            got = [(role, kid, np.frombuffer(tokens, np.uint64)) for role, kid, tokens in rows]
            lists, joined = _Lists([r[1:] for r in got if r[0]]), _Joined()
            out = [(kid, m) for role, kid, own in got if not role for m in lists.links(kid, own, t) if joined.join(kid, m)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    more = more.repartition("lead", "block").sortWithinPartitions(*sort).mapInArrow(against_block, "a long, b long")
    return done.unionByName(staged(more, "more-links"))


def _sent(wanted: DataFrame, texts: DataFrame, kinds: DataFrame, n: int) -> DataFrame:
    """(lead, block, blocks, role, kid, tokens): the whole set of each kid, at each of the places it is wanted."""
    places = staged(wanted.groupBy("kid").agg(F.collect_list("to").alias("places")).join(kinds.select("kid", "uid"), "kid"), "places")
    if places.agg(F.coalesce(F.sum(F.size("places") * 32 + 48), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        places = F.broadcast(places)

    @tidy
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in small_batches(batches, 64):
            tokens = [shingler(x).tobytes() for x in b.column(2).to_pylist()]
            to = b.column(1)
            at = pa.compute.list_parent_indices(to)
            yield pa.RecordBatch.from_arrays([*to.flatten().flatten(), b.column(0).take(at), pa.array(tokens, pa.binary()).take(at)], names=["lead", "block", "blocks", "role", "kid", "tokens"])

    return texts.select("uid", "text").join(places, "uid").select("kid", "places", "text").mapInArrow(fetch, "lead long, block int, blocks int, role int, kid long, tokens binary")


def _stars(links: DataFrame) -> DataFrame:
    """a, b: for each kid a that has links the least kid b that links lead to, where that isn't a itself."""

    def both(edges: DataFrame) -> DataFrame:
        return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(edges: DataFrame, least: DataFrame) -> DataFrame:
        """Each neighbour b of a kid a joined to the least around a."""
        return edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))

    def least_of(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))

    def sum_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(links.where("a != b").distinct(), "edges")
    before = None
    while (got := sum_of(now)) != before:
        before = got
        two_ways = both(now)
        # large star: neighbours above a kid go to the least around it; small star: the kid and those below it do
        large = staged(star(two_ways.where("b > a"), least_of(two_ways)).distinct(), "large-stars")
        least = least_of(large)
        small = star(large, least).unionByName(least.select("a", F.col("low").alias("b")))
        small = staged(small.where("a != b").distinct(), "small-stars")
        dropped(now, large)
        now = small
    return now


def _labelled(docs: DataFrame, *, n: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 400_000, block_bytes: int = 2_000_000, hot_level: int = 15) -> DataFrame:
    """uid, doc_id, size, label of every row: the least row (no_id, doc_id, uid) that links of similarity t per cent reach; null for empty sets."""
    texts = _texts(docs, id_col, text_col)
    bits, part_bits = _bits(texts)
    for seed in range(4):
        both = _members(texts, n, bits, part_bits, seed)
        members = both.where("not counted").select("uid", "doc_id", "size", "kid", "more").withColumn("salt", F.when(F.col("size") > 0, F.pmod(F.xxhash64("uid"), F.lit(SALTS))))
        by_salt = members.where("size > 0").groupBy("kid", "salt").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("label"), F.first("size").alias("size"), F.min("more").alias("least"), F.max("more").alias("most"))
        kinds = staged(by_salt.groupBy("kid").agg(F.min("label").alias("label"), F.first("size").alias("size"), (F.min("least") != F.max("most")).alias("mixed")).withColumn("uid", F.col("label.uid")), "kinds")
        if kinds.where("mixed").isEmpty():
            break
        dropped(both, kinds)
    else:
        raise ValueError("different sets share their 64-bit ids with each of four seeds")
    postings = kinds.agg(F.coalesce(F.sum(F.floor(F.col("size") * (100 - t) / 100) + 1), F.lit(0))).first()[0]
    blobs = both.where("counted").select("bucket", "part", "blob")
    levels, repeats = _levels(blobs, bits, part_bits)
    if levels is None:
        levels = _own_levels(blobs)
    dropped(both, below="counted=true")
    light = boundary(t, repeats)
    hot = min(15, max(1, hot_level))
    packed = _postings(texts, n, t, light, levels, bits, max(1, -(-int(postings) // bucket_rows)), hot, seed)
    leads = _leads(packed)
    roots = _stars(_links(leads, texts, kinds, n, t, block_bytes))
    own = kinds.select("kid", "label").join(roots.select(F.col("a").alias("kid"), F.col("b").alias("root")), "kid", "left").withColumn("root", F.coalesce("root", "kid"))
    own = staged(own, "roots")
    # only components of several kinds need to be brought together
    several = own.where(F.col("root") != F.col("kid")).select("root", "label").unionByName(roots.select(F.col("b").alias("kid")).distinct().join(kinds, "kid").select(F.col("kid").alias("root"), "label"))
    least = several.groupBy("root").agg(F.min("label").alias("least"))
    final = own.join(least, "root", "left").select("kid", F.coalesce("least", "label").alias("label"))
    final = by_salt.select("kid", "salt").join(final, "kid")
    return members.join(final, ["kid", "salt"], "left").select("uid", "doc_id", "size", "label")


def components(docs: DataFrame, **how) -> DataFrame:
    """uid, doc_id, n_shingles, component_id of every row: the least doc_id that links of similarity t per cent reach."""
    return _labelled(docs, **how).select("uid", "doc_id", F.col("size").alias("n_shingles"), F.coalesce("label.doc_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the row of the least doc_id stays (null last). Empty sets stay."""
    return without(docs, _labelled(docs, **how).where(F.col("uid") != F.col("label.uid")))

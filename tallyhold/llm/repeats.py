"""Removal of byte strings of ``size`` bytes that occur more than once in a corpus, by suffix arrays over what may repeat.

Every ``size``-byte window of a text has an anchor: the least hash of its ``gram``-byte strings. Equal windows have equal
anchors, so windows whose anchor occurs once are unique, and all windows that could be equal meet at their anchor. The
stretch of text that the windows of one anchor cover is a segment; equal segments are one, with a weight. Segments of
weight two or more repeat whole. The others are compared in suffix arrays (``suffixes``) over the segments of many
anchors at a time. The result are the starts of repeated windows, and so the spans of bytes to remove, of each text.

Scale. Anchors are one in about 70 bytes; they are shuffled packed, to count them, then only segments of repeated anchors
are shuffled, packed. What a run of texts in one task already shows to repeat, an anchor or a whole segment, is settled there:
its places stay with their texts, and one entry with a number goes on, so an anchor or a passage that a third of all texts have
sends an entry for each such run, not for each text. A bucket's anchors, and its segments, are cut to a set size by the
number of buckets. An anchor that occurs more than ``hot`` times (the edge of a passage that a large part of all texts share,
each with other text around it) doesn't bring its segments together: its windows meet one by one, by 128 bits of their own hashes, and
equal ones are counted; there are ``MOST_HOT`` such anchors at most, the most frequent ones. Texts meet their repeated anchors, and
later their spans, by a join: a broadcast of these packed rows up to ``BROADCAST_BYTES``, as measured, and a shuffle of the texts beyond.

Edge cases. Null texts are empty; texts shorter than ``size`` have no window and stay whole. A repeated row repeats all
of its windows, so all of both rows goes if they are long enough. Matches never cross texts. Long runs of one byte or
period are one segment and repeat within themselves. Very long texts are read whole, and have as many segments as they need.
Of equal strings none is spared, first or last. Other columns are never read. An empty table gives an empty result. ``docs``
must be a table as read, so that its rows have the same numbers each time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import dropped, give_back, numbered, small_batches, staged, tidy
from tallyhold.llm.suffixes import repeated_starts

BROADCAST_BYTES = 32_000_000
#: Anchors whose windows meet one by one, at most; and bytes of text for each anchor, about.
MOST_HOT, SPACING = 500_000, 70


def _hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, k a power of two, by doubling."""
    h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    mult, step = 0x9E3779B97F4A7C15, 1
    while step < k:
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult, step = mult * mult % 2**64, 2 * step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slide(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least (or most) of each ``width`` neighbours, by doubling."""
    n, step = len(h) - width + 1, 1
    while step * 2 <= width:
        h = pick(h[:-step], h[step:])
        step *= 2
    return pick(h[:n], h[width - step : width - step + n]) if width > step else h


def anchors(text: bytes, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, occurrences of the hash there) of each run of windows with one anchor."""
    if len(text) < size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, width = _hashes(np.frombuffer(text, np.uint8), gram), size - gram + 1
    low = _slide(h, width, np.minimum)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    last = np.r_[first[1:] - 1, len(low) - 1]
    # places of anchors: where a hash is the least of some window that holds it
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)
    ends = np.searchsorted(places, [first, last + width])
    # where a run's hash isn't the place's, another run's anchor lies in its reach
    count = ends[1] - ends[0]
    several = np.flatnonzero(count > 1)
    for i in several.tolist():
        count[i] = np.count_nonzero(h[places[ends[0][i] : ends[1][i]]] == low[first[i]])
    return low[first], first, last, count


def _packed(rows: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, keys, blob, uid): anchors to be counted, and, where keys is null, what a task knows of a text already.

    Of a run of texts: keys are those anchors that occur once in it, with their uid and first window, then those that occur
    several times, with their number. The latter's first windows go to rows of their uids.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, n = zstandard.ZstdCompressor(level=1), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([h[1] for h in held])
            uid = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            first, again = np.concatenate([h[2] for h in held]).astype("<u4"), np.concatenate([h[3] for h in held])
            by = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
            count = np.maximum(np.diff(np.r_[begin, len(by)]), 1 + np.maximum.reduceat(again[by].astype(np.int64), begin))
            several = np.zeros(len(by), bool)
            several[by] = np.repeat(count > 1, np.diff(np.r_[begin, len(by)]))
            one, many = np.flatnonzero(~several), by[begin[count > 1]]
            sums = count[count > 1].astype("<u4")
            keys = np.concatenate([key[one], key[many]])
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            found = []
            for k in np.flatnonzero(np.diff(cuts)):
                part = by[cuts[k] : cuts[k + 1]]
                lone, more = one[part[part < len(one)]], part[part >= len(one)] - len(one)
                found.append((int(k), keys[part].tobytes(), packer.compress(uid[lone].tobytes() + first[lone].tobytes() + sums[more].tobytes()), None))
            told = _by_uid(uid[several], first[several])
            found += [(u % buckets, None, blob, u) for u, blob in zip(*(c.to_pylist() for c in told.columns), strict=True)]
            for i in range(0, len(found), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found[i : i + 1024]), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["bucket", "keys", "blob", "uid"])

        for b in small_batches(batches):
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, first, _, count = anchors(text, size, gram)
                if len(key):
                    held.append((uid, key, first, count > 1))
                    n += len(key)
            if n > 1_000_000:
                yield from out()
                held.clear()
                n = 0
        if held:
            yield from out()

    return rows.mapInArrow(run, "bucket int, keys binary, blob binary, uid long")


def _repeated(packed: DataFrame, hot: int) -> DataFrame:
    """(uid, blob): the first windows of those runs whose anchor occurs elsewhere, or again within the run; and with a null
    uid the anchors that occur more than ``hot`` times."""

    def run(group: pa.Table) -> pa.Table:
        opener, keys, uids, firsts, counts, told = zstandard.ZstdDecompressor(), [], [], [], [], []
        for key, blob, uid in zip(*(group.column(c).to_pylist() for c in ("keys", "blob", "uid")), strict=True):
            if key is None:
                told.append((uid, blob))
                continue
            n, raw = len(key) // 8, opener.decompress(blob)
            lone = (len(raw) - 4 * n) // 8
            keys.append(np.frombuffer(key, np.uint64))
            none = np.zeros(n - lone, np.int64)
            uids.append(np.r_[np.frombuffer(raw, np.int64, lone), none - 1])
            firsts.append(np.r_[np.frombuffer(raw, "<u4", lone, 8 * lone), none.astype("<u4")])
            counts.append(np.r_[np.ones(lone, np.int64), np.frombuffer(raw, "<u4", n - lone, 12 * lone)])
        if not keys:
            return pa.table({"uid": pa.array([u for u, _ in told], pa.int64()), "blob": pa.array([x for _, x in told], pa.binary())})
        key, uid, first, count = (np.concatenate(x) for x in (keys, uids, firsts, counts))
        by = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        total = np.add.reduceat(count[by], begin)
        often = np.repeat(total, np.diff(np.r_[begin, len(by)]))
        ask = by[(often > 1) & (uid[by] >= 0)]
        ask = ask[np.lexsort((first[ask], uid[ask]))]
        own = _by_uid(uid[ask], first[ask])
        very = key[by[begin[total > hot]]]
        return pa.table(
            {
                "uid": pa.concat_arrays([own.column("uid").combine_chunks(), pa.array([u for u, _ in told], pa.int64()), pa.nulls(int(len(very) > 0), pa.int64())]),
                "blob": pa.concat_arrays([own.column("blob").combine_chunks(), pa.array([x for _, x in told], pa.binary()), pa.array([very.tobytes()] if len(very) else [], pa.binary())]),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, "uid long, blob binary")


def _by_uid(uid: np.ndarray, value: np.ndarray) -> pa.Table:
    """A row for each uid (equal ones adjacent) with the packed values of its rows."""
    first = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, np.int64)
    return pa.table({"uid": pa.array(uid[first], pa.int64()), "blob": pa.array([v.tobytes() for v in np.split(value.astype("<u4"), first[1:])] if len(uid) else [], pa.binary())})


def _with(rows: DataFrame, blobs: DataFrame, how: str) -> DataFrame:
    """Rows beside the packed values of their uid, of which ``blobs`` has one row each."""
    size = blobs.agg(F.coalesce(F.sum(F.octet_length("blob") + 48), F.lit(0))).first()[0]
    return rows.join(F.broadcast(blobs) if size <= BROADCAST_BYTES else blobs, "uid", how)


def _one_each(blobs: DataFrame, parts: int, merge: Callable[[list[bytes]], bytes], name: str) -> DataFrame:
    """The packed values of each uid in one row."""

    def run(group: pa.Table) -> pa.Table:
        own: dict[int, list[bytes]] = defaultdict(list)
        for uid, blob in zip(group.column("uid").to_pylist(), group.column("blob").to_pylist(), strict=True):
            own[uid].append(blob)
        return pa.table({"uid": pa.array(list(own), pa.int64()), "blob": pa.array(map(merge, own.values()), pa.binary())})

    return staged(blobs.groupBy(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part")).applyInArrow(run, "uid long, blob binary"), name)


def _segments(rows: DataFrame, repeated: DataFrame, hot: np.ndarray, size: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, segments, uid, blob): of a run's segments at repeated anchors each distinct one once; and, where segments is
    null, the spans of a text that are known to repeat because the run has their segment several times.

    A segment that the run has once comes with its place. ``hot`` anchors' windows are segments each, by their hashes.
    """
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, volume, very = zstandard.ZstdCompressor(level=3), defaultdict(dict), 0, sent.value

        def out() -> Iterator[pa.RecordBatch]:
            names = ["bucket", "segments", "uid", "blob"]
            told: dict[int, list[int]] = defaultdict(list)
            for bucket, own in held.items():
                keys = np.array([k for k, _ in own], np.uint64).tobytes()
                bodies, places = [c for _, c in own], list(own.values())
                lone = [p[0] for p in places if len(p) == 1]
                for body, at in zip(bodies, places, strict=True):
                    if len(at) > 1:
                        for uid, start in at:
                            told[uid] += (start, start + max(len(body), size))
                head = np.array([len(c) for c in bodies], "<u4").tobytes() + np.array([len(p) == 1 for p in places], "<u4").tobytes()
                raw = len(bodies).to_bytes(4, "little") + head + keys + np.array(lone, np.int64).tobytes() + b"".join(bodies)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packer.compress(raw)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=names)
            uids = list(told)
            for i in range(0, len(uids), 1024):
                some = uids[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([u % buckets for u in some], pa.int32()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64()), pa.array([np.array(told[u], "<u4").tobytes() for u in some], pa.binary())], names=names)

        for b in small_batches(batches):
            for uid, text, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wanted = np.frombuffer(blob, "<u4")
                key, first, last, _ = anchors(text, size, gram)
                pick = np.searchsorted(first, wanted)
                for k, low, high, often in zip(key[pick].tolist(), first[pick].tolist(), last[pick].tolist(), np.isin(key[pick], very).tolist(), strict=True):
                    # the windows of a very frequent anchor meet by their own hashes, one by one
                    parts = [(int.from_bytes(h[:8], "little"), h, s) for s in range(low, high + 1) for h in (xxhash.xxh3_128_digest(text[s : s + size]),)] if often else [(k, text[low : high + size], low)]
                    for own, content, start in parts:
                        at = held[(own >> 32) % buckets]
                        volume += 16
                        if (own, content) in at:
                            at[own, content].append((uid, start))
                        else:
                            at[own, content] = [(uid, start)]
                            volume += len(content) + 200
            if volume > 24_000_000:
                yield from out()
                held.clear()
                volume = 0
        yield from out()

    return _with(rows, repeated, "inner").select("uid", "text", "blob").mapInArrow(run, "bucket int, segments binary, uid long, blob binary")


def _spans(segments: DataFrame, size: int, chunk: int) -> DataFrame:
    """(uid, blob): starts and ends of repeated bytes, flat pairs, overlapping ones still apart."""

    def run(group: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        places: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
        known: set[tuple[int, bytes]] = set()
        told = []
        for blob, uid, spans in zip(*(group.column(c).to_pylist() for c in ("segments", "uid", "blob")), strict=True):
            if blob is None:
                told.append((uid, spans))
                continue
            raw = opener.decompress(blob)
            n = int.from_bytes(raw[:4], "little")
            length, lone = np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u4", n, 4 + 4 * n)
            key = np.frombuffer(raw, np.uint64, n, 4 + 8 * n).tolist()
            flat = np.frombuffer(raw, np.int64, 2 * int(lone.sum()), 4 + 16 * n).reshape(-1, 2).tolist()
            at, place = 4 + 16 * n + 16 * len(flat), iter(flat)
            for k, c, single in zip(key, length.tolist(), lone.tolist(), strict=True):
                own = k, raw[at : at + c]
                at += c
                places[own] += [next(place)] if single else []
                if not single:
                    known.add(own)
        groups: dict[int, list[bytes]] = defaultdict(list)
        for k, content in places:
            groups[k].append(content)
        uid, low, high = [], [], []

        def whole(k: int, content: bytes, starts: np.ndarray) -> None:
            cut = np.flatnonzero(np.diff(starts) > size)
            begin, end = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + size
            p = np.array(places[k, content], np.int64).reshape(-1, 2)
            uid.append(np.repeat(p[:, 0], len(begin)))
            low.append((p[:, 1:] + begin).ravel())
            high.append((p[:, 1:] + end).ravel())

        todo: list[tuple[int, bytes]] = []
        for k, contents in groups.items():
            several = [len(places[k, c]) > 1 or (k, c) in known for c in contents]
            for c, all_of_it in zip(contents, several, strict=True):
                if all_of_it and places[k, c]:
                    whole(k, c, np.arange(max(1, len(c) - size + 1)))
            # a lone window has nothing to be compared with, nor has one that is here by its hash
            bodies = [c for c in contents if len(c) >= size]
            if not all(several) and bodies and (len(bodies) > 1 or len(bodies[0]) > size):
                todo += [(k, c) for c in bodies]
        # chunks of whole anchors: equal windows are always in one
        start, volume = 0, 0
        for i, (k, c) in enumerate(todo):
            volume += len(c)
            if i + 1 == len(todo) or (volume > chunk and todo[i + 1][0] != k):
                part = todo[start : i + 1]
                for (own, content), starts in zip(part, repeated_starts([c for _, c in part], size), strict=True):
                    if len(starts) and len(places[own, content]) == 1 and (own, content) not in known:
                        whole(own, content, starts)
                start, volume = i + 1, 0
        uid += [np.repeat(u, len(x) // 8) for u, x in told]
        pairs = np.concatenate([np.stack([np.concatenate([*low, none]), np.concatenate([*high, none])], 1) for none in (np.zeros(0, np.int64),)] + [np.frombuffer(x, "<u4").reshape(-1, 2) for _, x in told])
        of = np.concatenate([*uid, np.zeros(0, np.int64)])
        by = np.lexsort((pairs[:, 0], of))
        del places, groups, todo
        give_back()
        return _by_uid(of[by], pairs[by])

    return segments.groupBy("bucket").applyInArrow(run, "uid long, blob binary")


def merged(blobs: list[bytes]) -> np.ndarray:
    """Disjoint ascending spans (start, end) of packed overlapping or touching ones."""
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[first, 0], reach[np.r_[first[1:] - 1, len(pairs) - 1]]], 1)


def _found(rows: DataFrame, size: int, gram: int, bucket_bytes: int, chunk: int, hot: int) -> DataFrame:
    """Spans (uid, blob) of the rows' (uid, text) repeated bytes, disjoint and ascending."""
    if size <= 16:
        raise ValueError("strings have more than 16 bytes, those of a hash")
    volume = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-volume // bucket_bytes))
    hot = max(hot, volume // (SPACING * MOST_HOT))
    counted = staged(_repeated(_packed(rows, size, gram, buckets), hot), "anchors")
    very = np.unique(np.frombuffer(b"".join(bytes(r.blob) for r in counted.where("uid is null").collect()), np.uint64))
    repeated = _one_each(counted.where("uid is not null"), buckets, b"".join, "repeated-anchors")
    spans = _spans(_segments(rows, repeated, very, size, gram, buckets), size, chunk)
    found = _one_each(spans, buckets, lambda blobs: merged(blobs).astype("<u4").tobytes(), "spans")
    dropped(counted, repeated)
    return found


def cut(text: bytes, blob: bytes | None) -> tuple[bytes, np.ndarray]:
    """The text without the packed spans, and the spans."""
    gone = np.frombuffer(blob or b"", "<u4").reshape(-1, 2).astype(np.int64)
    edges = [0, *gone.ravel().tolist(), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)), gone


def remove(docs: DataFrame, *, size: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6_000_000, chunk: int = 400_000, hot: int = 20_000) -> DataFrame:
    """uid, doc_id, n_bytes, spans (array of start and end), kept (binary) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    spans = _found(rows.select("uid", "text"), size, gram, bucket_bytes, chunk, hot)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            got = [cut(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            found = [[{"start": s, "end": e} for s, e in gone.tolist()] for _, gone in got]
            size_of = pa.compute.cast(pa.compute.binary_length(b.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size_of, pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([kept for kept, _ in got], pa.binary())], names=["uid", "doc_id", "n_bytes", "spans", "kept"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _with(rows, spans, "left").select("uid", "doc_id", "text", "blob").mapInArrow(run, f"uid long, doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def clean(docs: DataFrame, *, size: int = 200, gram: int = 64, text_col: str = "text", chars_col: str | None = "n_chars", bucket_bytes: int = 6_000_000, chunk: int = 400_000, hot: int = 20_000) -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts; bytes of characters that a cut has split go with it.

    Texts without a repeat, null ones among them, are as they were. ``chars_col``, if the table has it, is counted anew.
    """
    rows = numbered(docs)
    texts = rows.select("uid", F.coalesce(F.col("row")[text_col].cast("string").cast("binary"), F.lit(b"")).alias("text"))
    spans = _found(texts, size, gram, bucket_bytes, chunk, hot)

    @F.pandas_udf("string")
    @tidy
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, blob in batches:
            yield pd.Series([t if f is None else cut(t.encode(), f)[0].decode("utf-8", "ignore") for t, f in zip(text, blob, strict=True)], dtype=object)

    out = _with(rows, spans, "left").withColumn("cut", kept(F.col("row")[text_col].cast("string"), "blob"))

    def column(name: str) -> Column:
        was = F.col("row")[name]
        if name == text_col:
            return F.col("cut").alias(name)
        if name == chars_col:
            return F.when(F.col("blob").isNull(), was).otherwise(F.length("cut").cast(docs.schema[name].dataType)).alias(name)
        return was.alias(name)

    return out.select(*map(column, docs.columns))


def digest(found: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

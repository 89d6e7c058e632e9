"""Sum-of-squares online packing of documents into fixed windows of tokens.

Each document is its token ids and an end id. Whole windows are cut off first; the rest, shorter than a window,
is placed at once: of all fill levels with an open window that has room, and the empty window, that one is
taken which makes the sum of the squared counts of partially filled windows least (Csirik et al., "On the
sum-of-squares algorithm for bin packing", 2006). A level array holds the counts. When the input of a task ends,
the windows still open are closed by cutting the pieces of the emptiest into the gaps of the fullest, so that
one window at most for each task is left with padding.

Scale. No shuffle: every task packs its own rows, holds the open windows only and emits a window when it is full.
Where documents don't fit together (each a little longer than half a window, say) windows would stay open without end:
beyond ``most_open`` of them the same cutting closes the fullest until half as many are left, so a task holds that many
windows at most, whatever its input. A sequence id is the task's number and a counter, so a task that runs again gives the same ids.

Edge cases. A null or empty text is the end id alone. Repeated rows are packed each, under the same doc_id. Very
long texts fill windows of their own. Other columns are never read. An empty table gives no piece. Equal sums
go to the fullest level.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import small_batches, tidy
from tallyhold.llm.tokens import DEFAULT, ROOM, pieces

#: doc_id, start, ids, doc_tokens
Piece = tuple[int, int, bytes, int]
WIDTH = 4


class Packer:
    """Places pieces into windows of ``size`` tokens; ``full`` collects closed windows, ``most_open`` bounds the others."""

    def __init__(self, size: int, most_open: int = 4096):
        self.size, self.most_open, self.n_open = size, most_open, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: defaultdict[int, list[list[Piece]]] = defaultdict(list)
        self.full: list[list[Piece]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        total, start = len(ids) // WIDTH, 0
        while total - start >= self.size:
            self.full.append([(doc_id, start, ids[start * WIDTH : (start + self.size) * WIDTH], total)])
            start += self.size
        if start < total:
            self._place((doc_id, start, ids[start * WIDTH :], total))

    def level(self, length: int) -> int:
        """The fill level for a piece of this length that makes the sum of squares least."""
        count, size = self.count, self.size
        room = size - length
        change = 1 - 2 * count[: room + 1]
        change[0] = 0
        change[:room] += 2 * count[length:size] + 1
        usable = count[: room + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return int(room - change[::-1].argmin())

    def _place(self, piece: Piece) -> None:
        length = len(piece[2]) // WIDTH
        at = self.level(length)
        window = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        self.n_open -= at > 0
        window.append(piece)
        if at + length == self.size:
            self.full.append(window)
        else:
            self._reopen(at + length, window)
            if self.n_open > self.most_open:
                self.close(self.most_open // 2)

    def _reopen(self, fill: int, window: list[Piece]) -> None:
        self.open[fill].append(window)
        self.count[fill] += 1
        self.n_open += 1

    def close(self, leave: int = 0) -> None:
        """Cut the pieces of the emptiest windows into the gaps of the fullest, until ``leave`` windows are open; with none
        left open, one window at most stays partial."""
        left = deque((fill, w) for fill in sorted(self.open, reverse=True) for w in self.open[fill])
        self.open.clear()
        self.count[:] = self.n_open = 0
        while len(left) > leave:
            fill, window = left.popleft()
            while fill < self.size and left:
                other_fill, other = left.pop()
                doc_id, start, ids, total = other.pop()
                take = min(self.size - fill, len(ids) // WIDTH)
                keep = len(ids) - take * WIDTH
                window.append((doc_id, start + keep // WIDTH, ids[keep:], total))
                fill += take
                if keep:
                    other.append((doc_id, start, ids[:keep], total))
                if other:
                    left.append((other_fill - take, other))
            self.full.append(window)
        for fill, window in left:
            self._reopen(fill, window)


def pack(docs: DataFrame, *, size: int = 2048, end_id: int = 1, tokenizer: str | None = None, room: int = ROOM, keep: int = ROOM, most_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` file, the public byte-level BPE by default. A worker keeps about ``room``
    bytes of encoded parts at most, and ``keep`` bytes of them from task to task: fewer cost time, more cost memory.
    """
    path = tokenizer or public_tokenizers.path(DEFAULT)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = pieces(path, WIDTH, room), Packer(size, most_open)
        end, base, n = cache.pack([end_id]), TaskContext.get().partitionId() << 32, 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal n
            rows = []
            for window in packer.full:
                offset = 0
                for doc_id, start, ids, total in window:
                    rows.append((doc_id, start, len(ids) // WIDTH, ids, total, base + n, offset))
                    offset += len(ids) // WIDTH
                n += 1
            packer.full.clear()
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000]), kinds, strict=True)], names=names)

        for b in small_batches(batches, 1024):
            for doc_id, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + end)
            yield from closed()
        cache.rest(keep)
        packer.close()
        yield from closed()

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

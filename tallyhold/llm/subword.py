"""Hashed character n-grams of words, and the sparse batches that linear models train on."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np

EDGE = " .,;:!?\"'()[]{}<>|/\\*_-–—«»…“”„"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space, without the punctuation at their ends."""
    return [w for w in (x.strip(EDGE) for x in (text or "").lower().split()) if w]


def gram_ids(word: str, low: int, high: int, buckets: int) -> list[int]:
    """Buckets of the word with its edges marked, and of its n-grams of ``low`` to ``high`` characters.

    Of a word of over 64 characters every gram counts as well: the list is as long as the word.
    """
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode("utf-8", "replace")) % buckets]
    for n in range(low, high + 1):
        if n >= len(marked):
            break
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % buckets for i in range(len(marked) - n + 1)]
    return out


class Bags:
    """Documents as sparse relative counts of gram buckets.

    Buckets of fewer than ``least`` documents are left out (``known`` marks the others): a bucket that one
    document alone has says nothing about a class.
    """

    def __init__(self, texts: list[str | None], low: int, high: int, buckets: int, least: int = 1):
        seen: dict[str, np.ndarray] = {}
        self.ids: list[np.ndarray] = []
        self.share: list[np.ndarray] = []
        for text in texts:
            parts, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
            for word, n in Counter(words_of(text)).items():
                if word not in seen:
                    seen[word] = np.array(gram_ids(word, low, high, buckets), np.int32)
                parts.append(seen[word])
                weights.append(np.full(len(seen[word]), n, np.float32))
            ids, at = np.unique(np.concatenate(parts), return_inverse=True)
            count = np.bincount(at, np.concatenate(weights), len(ids)).astype(np.float32)
            self.ids.append(ids)
            self.share.append(count / max(1.0, float(count.sum())))
        docs = np.bincount(np.concatenate([*self.ids, np.zeros(0, np.int32)]), minlength=buckets)
        self.known = docs >= least
        for i, ids in enumerate(self.ids):
            keep = self.known[ids]
            self.ids[i], self.share[i] = ids[keep], self.share[i][keep]

    def batches(self, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of each batch, the buckets that occur in it, and a dense matrix rows x buckets."""
        order = rng.permutation(len(self.ids))
        for start in range(0, len(order), size):
            rows = order[start : start + size]
            cols = np.unique(np.concatenate([self.ids[r] for r in rows]))
            x = np.zeros((len(rows), len(cols)), np.float32)
            for i, r in enumerate(rows):
                x[i, np.searchsorted(cols, self.ids[r])] = self.share[r]
            yield rows, cols, x

"""Suffix arrays by linear grouping (after Baier, "Linear-time suffix sorting", CPM 2016), and repeats found with them.

First the suffixes are grouped by their longest Lyndon prefix: groups begin as the symbols and are processed in
descending order; each suffix of the group at hand points to the nearest suffix before it of a lower group (its previous
smaller), and the suffixes pointed at move, within their own groups, to a new group right after what stays there, by how
often they are pointed at. Then the groups' orders are emitted in one ascending pass: a suffix that is put down lets those
whose next smaller suffix it is take the next free place of their groups. Nothing is renamed and nothing recurses.

The symbols here are pieces of bytes that end after a byte of ``ENDS``, ranked as bytes: no piece but a cut-off last one is
the beginning of another, so the order of piece sequences is that of their bytes (Ferragina and Fischer, "Suffix arrays on
words", CPM 2007), at a fraction of the suffixes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` (integers >= 0) in ascending order."""
    n = len(s)
    size, group = [0] * max(n, max(s, default=0) + 1), [0] * n
    for x in s:
        size[x] += 1
    # a counting sort: each symbol's suffixes are a group, which is named by its first slot
    first, at = [0] * len(size), 0
    for x, m in enumerate(size):
        first[x], at = at, at + m
    slot, place, filled = [0] * n, [0] * n, first.copy()
    for i, x in enumerate(s):
        k = filled[x]
        slot[k], place[i], group[i] = i, k, first[x]
        filled[x] = k + 1
    size = [0] * n
    for g in group:
        size[g] += 1
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    unknown = -2
    smaller = [unknown] * n
    top = n
    while top:
        # before and after link the suffixes of unprocessed groups, so a lower one is a step away
        at = group[slot[top - 1]]
        if top - at == 1:
            i = slot[at]
            p, q = before[i], after[i]
            smaller[i] = p
            if q < n:
                before[q] = p
            if p >= 0:
                after[p] = q
                g = group[p]
                m = size[g]
                if m > 1:
                    e, k = g + m - 1, place[p]
                    o = slot[e]
                    slot[k], slot[e], place[o], place[p] = o, p, k, e
                    size[g], size[e], group[p] = m - 1, 1, e
            top = at
            continue
        own = slot[at:top]
        count: dict[int, int] = {}
        for i in own:
            if smaller[i] != unknown:
                continue
            # neighbours in one group share what is smaller than all of them
            run, p = [i], before[i]
            while p >= 0 and group[p] == at and smaller[p] == unknown:
                run.append(p)
                p = before[p]
            if p >= 0 and group[p] == at:
                p = smaller[p]
            for j in run:
                smaller[j] = p
            if p >= 0:
                count[p] = count.get(p, 0) + len(run)
        for i in own:
            p, q = before[i], after[i]
            if q < n:
                before[q] = p
            if p >= 0:
                after[p] = q
        top = at
        if not count:
            continue
        # no count is above the group's size, so going through all of them downwards is linear too
        sets: list[list[int]] = [[] for _ in range(max(count.values()))]
        for p, c in count.items():
            sets[-c].append(p)
        for chosen in sets:
            moved: dict[int, int] = {}
            for p in chosen:
                g = group[p]
                m = moved.get(g, 0)
                e, k = g + size[g] - 1 - m, place[p]
                o = slot[e]
                slot[k], slot[e], place[o], place[p] = o, p, k, e
                moved[g] = m + 1
            for g, m in moved.items():
                rest = size[g] - m
                if rest:
                    e = g + rest
                    size[g], size[e] = rest, m
                    for k in range(e, e + m):
                        group[slot[k]] = e
    free, placed, out = list(range(n)), bytearray(n), [0] * n
    k, i = -1, n
    while True:
        p = i - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = smaller[p]
        k += 1
        if k == n:
            return out
        i = out[k]


#: White space, punctuation and digits end a piece, and of the bytes beyond ASCII every eighth.
ENDS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *(b for b in range(0x80, 0x100) if b % 8 == 1)])
PIECE = re.compile(b"[^%b]*[%b]|[^%b]+" % ((re.escape(ENDS),) * 3), re.S)
LONGEST = 64


def repeated_starts(contents: list[bytes], size: int) -> list[np.ndarray]:
    """For each of these distinct byte strings, the ascending starts of ``size``-byte strings that start anywhere else too.

    Elsewhere: in another of them, or in the same one at another start. A start's string has an end of a piece in it, the
    first of which lies ``o`` bytes on; two starts are alike if the ``o`` bytes up to there are, and the suffixes from
    there share ``size - o`` bytes, which the suffix array's order and its neighbours' common lengths tell. Where a piece
    would be longer than ``LONGEST`` bytes, every byte is a piece.
    """
    pieces = [PIECE.findall(c) for c in contents]
    if any(len(p) > min(LONGEST, size - 1) for ps in pieces for p in ps):
        pieces = [[c[i : i + 1] for i in range(len(c))] for c in contents]
    rank = {p: k for k, p in enumerate(sorted({p for ps in pieces for p in ps}), 1)}
    symbols: list[int] = []
    for ps in pieces:
        symbols += map(rank.__getitem__, ps)
        symbols.append(0)
    order = np.array(suffix_array(symbols), np.int64)
    # byte position of each symbol's start; separators take no byte
    width = np.array([n for ps in pieces for n in (*map(len, ps), 0)], np.int64)
    begin = np.cumsum(width) - width
    ends = np.repeat(np.cumsum([len(c) for c in contents]), [len(ps) + 1 for ps in pieces])
    heads = np.repeat(np.cumsum([0, *(len(c) for c in contents[:-1])]), [len(ps) + 1 for ps in pieces])
    text = np.frombuffer(b"".join(contents) + bytes(size + 8), np.uint8)
    prior = np.r_[0, width[:-1]]
    prior[begin == heads] = 0
    room = ends - begin
    longest = int(prior.max(initial=0))
    # a boundary counts if a window whose first piece ends there fits; separators stand at the last boundary of their text
    real = (prior > 0) & (room + prior >= size)
    order = order[real[order]]
    at, left, prior = begin[order], room[order], prior[order]
    common = np.minimum(_common(text, at[:-1], at[1:], size), np.minimum(left[:-1], left[1:]))
    found = []
    key = np.zeros(len(at), np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    for o in range(1, longest + 1):
        if o > size:
            break
        with np.errstate(over="ignore"):
            key = (key + text[np.maximum(at - o, 0)].astype(np.uint64) + np.uint64(1)) * mult
            key ^= key >> np.uint64(32)
        block = np.r_[0, np.cumsum(common < size - o)] if len(at) else np.zeros(0, np.int64)
        fit = np.flatnonzero((prior >= o) & (left >= size - o))
        if not len(fit):
            continue
        with np.errstate(over="ignore"):
            code = (key[fit] ^ (block[fit].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
            code ^= code >> np.uint64(29)
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        again = by[np.r_[False, same] | np.r_[same, False]]
        start = at[fit[again]] - o
        # what the block doesn't say, the bytes up to the boundary, is compared: equal hashes alone decide nothing
        pairs = np.flatnonzero(same)
        one, other = fit[by[pairs]], fit[by[pairs + 1]]
        if (block[one] != block[other]).any() or (_common(text, at[one] - o, at[other] - o, o) < o).any():
            start = _truly_repeated(text, start, size)
        found.append(start)
    starts = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cuts = np.cumsum([0, *(len(c) for c in contents)])
    return [part - cut for part, cut in zip(np.split(starts, np.searchsorted(starts, cuts[1:-1])), cuts[:-1], strict=True)]


def _truly_repeated(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Of these starts those whose ``size`` bytes another one has too, by the bytes themselves."""
    strings = [text[i : i + size].tobytes() for i in starts.tolist()]
    often = Counter(strings)
    return starts[np.array([often[x] > 1 for x in strings], bool)]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common length of the bytes from a and from b on, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    todo = np.arange(len(a))
    for k in range(0, most, 8):
        differ = words[a[todo] + k] != words[b[todo] + k]
        some = differ.any(1)
        out[todo[some]] = k + differ[some].argmax(1)
        todo = todo[~some]
        if not len(todo):
            return out
        # text is padded by a window's length, so that k never runs out of it
    out[todo] = most
    return np.minimum(out, most)

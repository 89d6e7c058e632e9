"""Token ids of texts by a public byte-level BPE, with each distinct piece of text encoded once.

The pre-tokenizer of this kind of vocabulary always cuts before a space that stands between two characters that
aren't white space, and around a line end that stands so; merges never cross a cut. So a text's ids are, in order, the
ids of its parts between such spaces and line ends, each with the space or line end before it. Parts repeat a lot: their
packed ids are kept, and only new ones go to the library. Texts in which a space meets other white space go to the
library whole; those with empty lines are cut at spaces only.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Collection
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers

#: The same vocabulary for two libraries, ``tokenizers`` and ``tiktoken``.
DEFAULT, DEFAULT_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """A function from texts to ids, without special tokens, and the bytes of each id; the library goes by the file's ending."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts], sorted(ranks, key=ranks.get)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], [tok.decode([i], skip_special_tokens=False).encode() for i in range(tok.get_vocab_size())]


#: Before the line end that a part begins with.
LINE = "\x01"
#: Bytes of a worker's cache, and those that each entry takes beside its characters and ids.
ROOM, EACH = 320_000_000, 180


class PieceCache:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes; what it keeps of parts takes about ``room`` bytes at most."""

    def __init__(self, path: str, width: int = 4, room: int = ROOM):
        self.ids_of, strings = encoder(path)
        self.opens = np.array([x.startswith(b" ") for x in strings])
        if len(strings) > 256**width:
            raise ValueError(f"ids of {path} don't fit in {width} bytes")
        self.kind = np.dtype(f"<u{width}")
        #: None: a part whose edge isn't a cut
        self.known: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}
        self.room, self.size, self.head_size = room, 0, 0

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def rest(self, keep: int) -> None:
        """Keep about so many bytes of the first, frequent parts: what the next task begins with, and all that a worker holds
        between tasks."""
        if self.size > keep:
            self.known = dict(islice(self.known.items(), len(self.known) * keep // self.size))
            self.size = keep
        self.heads.clear()
        self.head_size = 0

    @staticmethod
    def _bytes(parts: Collection[str]) -> int:
        """What the parts take as keys, with their ids and the table's own share."""
        return sum(map(len, parts)) * 3 + len(parts) * EACH

    def _learn(self, parts: list[str], run: int = 1000) -> None:
        """Encode parts without white space; only a part's first id begins with a space, so one call takes many."""
        for i in range(0, len(parts), run):
            some = parts[i : i + run]
            ids = np.array(self.ids_of([f" {' '.join(some)}"])[0], self.kind)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):
                raise ValueError("ids that don't begin where their parts do")
            packed, ends = ids.tobytes(), [*(at * self.kind.itemsize).tolist(), len(ids) * self.kind.itemsize]
            self.known.update(zip(some, map(packed.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))

    @staticmethod
    def _cut(text: str) -> list[str]:
        if LINE in text:
            return [text, ""]  # an empty part sends the text to the library whole
        return (text if "\n\n" in text else text.replace("\n", f" {LINE}\n")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.size > self.room:
            # the parts that came first are the frequent ones
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.size //= 2
        if self.head_size > self.room // 10:
            self.heads.clear()
            self.head_size = 0
        cut = [self._cut(t or "") for t in texts]
        get, ids, lacking, new = self.known.get, [], [], set()
        for parts in cut:
            rest = list(map(get, islice(parts, 1, None)))
            lack = [i for i, r in enumerate(rest) if r is None] if None in rest else []
            new.update([parts[i + 1] for i in lack])
            ids.append(rest)
            lacking.append(lack)
        # difference_update would go through all that is known, each time
        new = {p for p in new if p not in self.known}
        self.size += self._bytes(new)
        opening = [p for p in new if p[:1] == LINE]
        whole = [p for p in new.difference(opening) if p and not p[0].isspace() and not p[-1].isspace()]
        self.known.update(dict.fromkeys(new))
        opening = [p for p in opening if p[1:2] == "\n" and len(p) > 2 and not p[2].isspace() and not p[-1].isspace()]
        self.known.update(zip(opening, map(self.pack, self.ids_of([p[1:] for p in opening])), strict=True))
        self._learn([p for p in whole if "<|" not in p])
        odd = [p for p in whole if "<|" in p]
        self.known.update(zip(odd, map(self.pack, self.ids_of([f" {p}" for p in odd])), strict=True))
        heads = list({parts[0] for parts in cut}.difference(self.heads))
        self.heads.update(zip(heads, map(self.pack, self.ids_of(heads)), strict=True))
        self.head_size += self._bytes(heads)
        out = []
        for text, parts, rest, lack in zip(texts, cut, ids, lacking, strict=True):
            for i in lack:
                rest[i] = self.known[parts[i + 1]]
            head = parts[0]
            if (lack and None in rest) or (rest and (not head or head[-1].isspace())):
                out.append(self.pack(self.ids_of([text])[0]))
            else:
                out.append(self.heads[head] + b"".join(rest))
        return out


@lru_cache(maxsize=1)
def pieces(path: str, width: int = 4, room: int = ROOM) -> PieceCache:
    """The cache of this worker process: it lives on from task to task."""
    return PieceCache(path, width, room)

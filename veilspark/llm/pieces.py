"""Encoding whole columns of text with a public tokenizer, each distinct piece once for a worker's chunk.

Both vocabularies split a text by a pattern no match of which goes from a character that is not white space to white
space. A text may thus be cut before any ASCII white space that follows another character, and the ids of the text are
the ids of its pieces one after the other. Pieces are found and hashed with numpy, and a worker encodes each new one
once; the numbers of the others come from sorted arrays. Texts that hold a special token's text, or white space outside
ASCII where that matters, go to the library as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from veilspark.llm import text

#: Bytes of piece ids and hashes that a worker keeps before it starts anew.
MEMORY = 64 << 20
#: White space outside ASCII, as UTF-8. Next to a cut it may belong to a match that goes over it.
OTHER_SPACE = [re.compile(p) for p in (b"\xc2[\x85\xa0]", b"\xe1\x9a\x80", b"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", b"\xe2\x81\x9f", b"\xe3\x80\x80")]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values())


def texts_with(raw: bytes, bounds: np.ndarray, path: str, other_space: bool) -> np.ndarray:
    """Which texts hold a special token's text or, if asked for, white space outside ASCII."""
    out = np.zeros(len(bounds) - 1, bool)
    for p in [*(re.compile(re.escape(s)) for s in special_strings(path)), *(OTHER_SPACE if other_space else ())]:
        at = [m.start() for m in p.finditer(raw)]
        out[np.searchsorted(bounds, at, "right") - 1] = True
    return out


class Encoder:
    """Ids of pieces, remembered by hash; a hash stands for its piece together with the length in bytes."""

    def __init__(self, path: str, keep_ids: bool):
        self.library, self.keep = tokenizer(path), keep_ids
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """hashes: ascending, none known."""
        counts, ids = [], []
        for i in range(0, len(pieces), 4096):
            for e in self.library.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False):
                counts.append(len(e.ids))
                if self.keep:
                    ids.extend(e.ids)
        counts = np.array(counts, np.int32)
        at = np.searchsorted(self.hashes, hashes)
        starts = len(self.ids) + np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int64)
        self.hashes, self.counts, self.starts = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.counts, counts), (self.starts, starts)))
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint16)])

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For every piece of a chunk its place among those known."""
        h = text.hash_spans(data, starts, ends)
        if self.hashes.nbytes + self.counts.nbytes + self.starts.nbytes + self.ids.nbytes > MEMORY:
            self.forget()
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != unique[~new]
        if new.any():
            raw = data.tobytes()
            self.learn(unique[new], [raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            at = np.searchsorted(self.hashes, unique)
        return at[back]


def pieces(data: np.ndarray, bounds: np.ndarray, with_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first piece: words, or words with the white space before them (and the rest)."""
    starts, ends, ptr = text.split_words(data, bounds)
    if not with_space:
        return starts, ends, ptr
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    own = np.flatnonzero(np.diff(ptr) > 0)
    begin[ptr[own]] = bounds[own]
    last = np.array(bounds[:-1])
    last[own] = ends[ptr[own + 1] - 1]
    tail = np.flatnonzero(last < bounds[1:])
    at = ptr[tail + 1]
    return np.insert(begin, at, last[tail]), np.insert(ends, at, bounds[tail + 1]), ptr + np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(bounds) - 1))])

"""Cutting texts into pieces at places that no pre-token of byte-level BPE crosses.

Byte-level BPE first splits a text by a pattern whose matches start with at most one space and
otherwise never hold a space next to a character that is not white space. Cutting before each run
of spaces (together with the word it leads) therefore never cuts a match in two, except inside
longer runs of mixed white space; texts with those are cut only after printable ASCII characters.
Pieces repeat far more often than texts, so a tokenizer need only see the distinct ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the space itself, anywhere in a word (a superset is harmless).
_SOME_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_SAFE = re.compile(r"(?<=[!-~])(?= )")


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def chunks(b: pa.RecordBatch, text: int, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        hi = max(hi, lo + 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece of each place, and each text's first place (one more at the end)."""
    words = pc.split_pattern(texts, " ")
    flat, first = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = flat.dictionary_encode()
    idx, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), strings(coded.dictionary)
    n = len(known)
    empty, begins, ends = (np.zeros(n, bool) for _ in range(3))
    for i in np.flatnonzero(pc.or_(pc.match_substring_regex(coded.dictionary, _SOME_SPACE), pc.equal(coded.dictionary, "")).to_numpy(zero_copy_only=False)).tolist():
        w = known[i]
        empty[i], begins[i], ends[i] = not w, not w or w[0].isspace(), w != "" and w[-1].isspace()
    keep = ~empty[idx]
    keep[first[:-1]] = True
    keep[first[1:] - 1] = True
    at = np.flatnonzero(keep)
    idx, first = idx[at], np.searchsorted(at, first)
    spaces = np.diff(at, prepend=0)
    spaces[first[:-1]] = 0
    # a run of white space that goes on over a cut
    bad = np.zeros(len(idx), bool)
    bad[1:] = ends[idx[:-1]] & ((spaces[1:] > 1) | begins[idx[1:]])
    bad[first[:-1]] = False
    pieces = strings(pc.binary_join_element_wise("", coded.dictionary, " "))
    odd = np.flatnonzero(spaces != 1)
    codes = idx.copy()
    more, inv = np.unique(spaces[odd] * n + idx[odd], return_inverse=True)
    codes[odd] = n + inv
    pieces += [" " * int(k // n) + known[k % n] for k in more.tolist()]
    if bad.any():
        texts_bad = np.unique(np.searchsorted(first, np.flatnonzero(bad), "right") - 1)
        place = {}
        parts, lengths, last = [], np.diff(first), 0
        for t in texts_bad.tolist():
            own = _SAFE.split(texts[t].as_py())
            parts += [codes[first[last] : first[t]], np.array([place.setdefault(p, len(pieces) + len(place)) for p in own], np.int64)]
            lengths[t], last = len(own), t + 1
        codes = np.concatenate([*parts, codes[first[last] :]])
        pieces += place
        first = np.concatenate([[0], np.cumsum(lengths)])
    return pieces, codes, first


class IdStore:
    """Ids of pieces seen by this worker; emptied when it holds more than `most` pieces."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def codes(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.place]
        if new:
            ids, lengths = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def gather(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all places one after another, and the number of ids of each text."""
        lengths = self.starts[codes + 1] - self.starts[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[take], np.diff(ends[first])

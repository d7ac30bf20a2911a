"""Vectorised word and shingle hashes of whole texts (numpy, on Arrow batches)."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a longer text is cut at white space, so memory doesn't grow with a text.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: As above, and ASCII punctuation.
SEPARATOR = SPACE.copy()
SEPARATOR[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


#: What the operator that a worker runs keeps between its tasks. Spark gives a worker to any stage, so another operator's goes first.
_kept: dict[str, dict] = {}
#: Rows whose texts are held as Python objects at once.
ROWS = 500


def kept_by(operator: str) -> dict:
    """The operator's cache in this worker; those of other operators are dropped."""
    for other in [name for name in _kept if name != operator]:
        del _kept[other]
    if operator not in _kept:
        _kept[operator] = {}
        freed()
    return _kept[operator]


def freed() -> None:
    """Gives the memory that this worker no longer uses back to the system: it lives on beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(texts: list[bytes], overlap: int, limit: int | None = None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Joins texts to buffers of about ``limit`` bytes: (buffer, where each piece begins, the text that it is of).

    A text over the limit comes in several pieces cut at white space, each repeating the last ``overlap`` words of
    the one before, so that every run of ``overlap + 1`` words lies whole in a piece.
    """
    limit = limit or CHUNK
    parts: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush():
        sizes = np.array([len(p) + 1 for p in parts])
        return b" ".join(parts), np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array(owner)

    for i, text in enumerate(texts):
        if len(text) <= limit:
            pieces: Iterable[bytes] = (text,)
        else:
            pieces = cut(text, overlap, limit)
        for piece in pieces:
            if parts and held + len(piece) > limit:
                yield flush()
                parts, owner, held = [], [], 0
            parts.append(piece)
            owner.append(i)
            held += len(piece) + 1
    if parts:
        yield flush()


def cut(text: bytes, overlap: int, limit: int) -> Iterator[bytes]:
    """Pieces of a long text, cut between words (see ``chunks``).

    Each piece but an only one holds more than ``overlap`` words, and each but the first at least one new word: what is too
    short goes on to the next.
    """
    at, carry = 0, b""
    begun = False
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            back = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back > at:
                end = back
            else:  # one word longer than the limit stays whole
                found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, end)) >= 0]
                end = min(found) if found else len(text)
        fresh = text[at:end]
        at = end
        if not fresh.strip():
            continue
        piece = carry + fresh
        if overlap:
            last = piece.rsplit(None, overlap)
            if len(last) <= overlap or (len(last) == overlap + 1 and not last[0].strip()):
                carry = piece
                continue
            carry = b" ".join(last[-overlap:]) + b" "
        begun = True
        yield piece
    if not begun and carry:
        yield carry


class Words:
    """The words of a buffer: byte ranges, and hashes of any prefix of them."""

    def __init__(self, buffer: bytes, begins: np.ndarray, space: np.ndarray = SPACE, fold: bool = True):
        self.bytes = np.frombuffer(buffer, np.uint8)
        if fold:
            upper = (self.bytes >= 65) & (self.bytes <= 90)
            self.bytes = self.bytes + (upper.astype(np.uint8) << 5)
        blank = np.ones(len(self.bytes) + 2, bool)
        blank[1:-1] = space[self.bytes]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(begins, self.start, side="right") - 1
        up, self._down = _grown(len(self.bytes) + 1)
        self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], dtype=np.uint64, out=self._sums[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte range: alike wherever the bytes stand."""
        start, end = self.start if start is None else start, self.end if end is None else end
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, hash) of every run of ``k`` words in a piece; of a piece with fewer, one of all its words."""
        words, piece = self.hashes(), self.piece
        factor = np.uint64(_BASE)
        n = max(0, len(words) - k + 1)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * factor + words[j : j + n]
        whole = piece[:n] == piece[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
        out_piece, out = piece[:n][whole], total[whole]
        counts = np.bincount(piece) if len(piece) else np.zeros(0, int)
        for p in np.flatnonzero((counts > 0) & (counts < k)):
            own = words[np.searchsorted(piece, p) : np.searchsorted(piece, p, side="right")]
            h = np.zeros(1, np.uint64)
            for x in own:
                h = h * factor + x
            out_piece, out = np.append(out_piece, p), np.append(out, h + np.uint64(len(own)))
        return out_piece, mix(out)

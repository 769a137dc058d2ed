"""Words of a batch of texts as numpy arrays: places, hashes and the text each is in."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BATCH_BYTES = 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 2**64)


def mix(z: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per range of values; equal ranges have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(values) + 1, _BASE, np.uint64))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1])])
        length = (ends - starts).astype(np.uint64)
        back = np.cumprod(np.full(len(values) + 1, _UNDO, np.uint64))  # takes the range to the same place
        return mix((run[ends] - run[starts]) * back[starts] + length)


@dataclass
class Words:
    buf: np.ndarray  #: bytes of all texts, each followed by a newline
    at: np.ndarray  #: first byte of each text, and the end
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  #: which text each word is in
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.at) - 1)


def split_words(texts: list[str], lower: bool = False) -> Words:
    """Runs of bytes other than white space; ``lower`` folds A-Z."""
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    white = np.concatenate([[True], _WHITE[buf]])
    start = np.flatnonzero(white[:-1] & ~white[1:])
    end = np.flatnonzero(~white[:-1] & white[1:])
    text = np.searchsorted(at, start, side="right") - 1
    return Words(buf, at, start, end, text, range_hashes(_VALUE[buf], start, end))


def batches_of(frame, column: str = "text", limit: int = BATCH_BYTES):
    """Slices of a pandas frame whose texts hold about ``limit`` characters."""
    size = frame[column].str.len().cumsum().to_numpy()
    edges = np.unique(np.append(np.searchsorted(size, np.arange(limit, (size[-1] if len(size) else 0), limit)), len(frame)))
    lo = 0
    for hi in edges:
        if hi > lo:
            yield frame.iloc[lo:hi]
            lo = hi


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a shorter text is one run of all its words."""
    counts = w.counts
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(int))
    text = np.repeat(np.arange(len(counts)), runs)
    start = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    size = np.minimum(counts, width)[text]
    return text, range_hashes(w.hash, start, start + size)


_LETTER = np.ones(256, bool)
_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = False


def trimmed(w: Words) -> Words:
    """The words without ASCII punctuation at their ends; words of nothing else go."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(int((end - start).max()) if len(start) else 0):
        cut = (start < end) & ~_LETTER[w.buf[np.minimum(start, len(w.buf) - 1)]]
        if not cut.any():
            break
        start[cut] += 1
    while (cut := (start < end) & ~_LETTER[w.buf[end - 1]]).any():
        end[cut] -= 1
    left = start < end
    start, end = start[left], end[left]
    return Words(w.buf, w.at, start, end, w.text[left], range_hashes(_VALUE[w.buf], start, end))

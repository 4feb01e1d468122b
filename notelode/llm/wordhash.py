"""64-bit hashes of words and of runs of words, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n += n // 4
        for name, base in (("up", FACTOR), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs of other than the six ASCII white-space characters), and each text's number."""
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)  # one gap after each text
    n = len(data)
    up, down = powers(n + 1)
    gap = _GAP[data]
    before = np.append(True, gap[:-1]) if n else gap
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:n])))
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([len(x) + 1 for x in raws]) if raws else np.zeros(0, np.int64)
    text = np.searchsorted(bounds, starts, side="right")
    return hashes, np.bincount(text, minlength=len(raws)).astype(np.int64)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbouring words; by doubling, so in log k passes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out, size = None, 0
    part, width, scale = words, 1, int(STEP)  # hashes of runs of width words; scale: STEP ** width
    while True:
        if k & width:
            if out is None:
                out, size = part, width
            else:  # the run found so far goes first
                out = out[: len(out) - width] * np.uint64(scale) + part[size : size + len(out) - width]
                size += width
        if size == k:
            return mixed(out)
        part = part[: len(part) - width] * np.uint64(scale) + part[width:]
        scale = scale * scale % (1 << 64)
        width *= 2

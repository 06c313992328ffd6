"""Content-chosen anchors for strings of a fixed length.

A string of ``length`` bytes is anchored at the place of its smallest
``GRAM``-byte hash (the first, if several are equal).  Equal strings have their
anchor at the same offset, wherever they stand, so repeats are found by
comparing anchors: about one for every ``length / 3`` bytes of text.
Neighbouring strings mostly share their anchor; a run of them is one row.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
#: String starts that are hashed at once.
STEP = 1 << 18
_BITS = np.uint64(21)  # places within a step and its overhang


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h, k = _BYTE[data], 1
    while k < GRAM:
        h = _mix(h[:-k] * np.uint64(0xFF51AFD7ED558CCD) + h[k:])
        k *= 2
    return h


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor, over texts ``data[offsets[i]:offsets[i + 1]]``.

    ``text``: its number; ``first``, ``last``: the run's first and last string, within the
    text; ``at``: the anchor, within the text; ``mark``: the anchor's hash; ``all``: a hash
    of everything the run's strings cover.
    """
    if length < GRAM + 1 or length > STEP // 2:
        raise ValueError(f"length must be {GRAM + 1} to {STEP // 2}")
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "first", "last", "at", "mark", "all")}
    width = length - GRAM + 1
    for begin in range(0, max(0, len(data) - length + 1), STEP):
        part = data[begin:begin + STEP + length - 1]
        h = gram_hashes(part)
        low = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[:len(low) - (width - k)], low[width - k:])
        starts = np.arange(begin, begin + len(low))
        text = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + length <= offsets[text + 1]
        starts, text = starts[inside], text[inside]
        at = (low[inside] & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        if not len(starts):
            continue
        head = np.ones(len(starts), bool)
        head[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(head)
        tails = np.concatenate((heads[1:], [len(starts)])) - 1
        first, last, at, text = starts[heads], starts[tails], at[heads], text[heads]
        mark, span = h[at], last - first + length
        whole = _mix(mark ^ ((at + begin - first).astype(np.uint64) << np.uint64(20)) ^ span.astype(np.uint64))
        for j in range(-(-(length + width - 1) // GRAM)):
            whole = _mix(whole * np.uint64(0xC4CEB9FE1A85EC53)
                         + h[first - begin + np.minimum(j * GRAM, span - GRAM)])
        base = offsets[text]
        for name, value in (("text", text), ("first", first - base), ("last", last - base),
                            ("at", at + begin - base), ("mark", mark), ("all", whole)):
            out[name].append(value)
    empty = {"mark": np.uint64, "all": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, empty.get(k, np.int64)) for k, v in out.items()}

"""Deep-shallow sorting of suffixes, over numpy arrays.

``sort_suffixes`` orders suffixes of one text by their first ``depth`` bytes.

* Shallow: multikey quicksort down to ``shallow`` bytes.  Its characters are
  words of eight bytes, and all groups of a level are split at once.
* Deep: groups that still agree go into blind tries.  A group's pivot spells
  out a path; every other suffix is compared with it once, which gives the
  depth where it leaves the path and the byte it leaves by.  Depth and byte
  are all that is kept, as in a blind trie, and they order the group around
  the pivot.  Suffixes that leave together form the next group, whose trie
  begins one byte deeper.

Both parts treat all groups of a level in one numpy operation; the number of
levels is bounded by ``depth``.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
WORD = 8


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian eight bytes from each place (zeros behind the end)."""
    padded = np.concatenate((text, np.zeros(WORD, np.uint8)))
    view = np.lib.stride_tricks.as_strided(padded, (len(text), WORD), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _groups(head: np.ndarray) -> np.ndarray:
    """Number of the group of each element, from marks of the first ones."""
    return np.cumsum(head) - 1


def _tied(head: np.ndarray) -> np.ndarray:
    """Elements whose group has more than one."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return ~alone


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int,
                  shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): places in ``starts`` sorted by the ``depth`` bytes from each start,
    and for each place of that order whether its string differs from the one before.

    Every start has ``depth`` bytes of text.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = _words(text)
    offsets = list(range(0, depth - WORD + 1, WORD))
    if depth % WORD:
        offsets.append(depth - WORD)  # overlaps the one before
    if depth < WORD:
        raise ValueError(f"depth must be at least {WORD}")
    near = [o for o in offsets if o + WORD <= max(shallow, WORD)]
    order = np.argsort(words[starts], kind="stable")
    key = words[starts[order]]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    for o in near[1:]:
        some = np.flatnonzero(_tied(head))
        if not len(some):
            return order, head
        group = _groups(head)[some]
        key = words[starts[order[some]] + o]
        move = np.lexsort((key, group))
        order[some] = order[some][move]
        key = key[move]
        head[some[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    _tries(words, starts, offsets[len(near):], depth, order, head)
    return order, head


def _tries(words: np.ndarray, starts: np.ndarray, offsets: list[int], depth: int,
           order: np.ndarray, head: np.ndarray) -> None:
    """Order the groups that are left, in place."""
    if not offsets:
        return
    open_ = _tied(head)  # places whose group still needs a trie
    while True:
        some = np.flatnonzero(open_)
        if not len(some):
            return
        first = head[some]
        group = _groups(first)
        member = starts[order[some]]
        pivot = member[first][group]
        # depth at which each member leaves its pivot's path, and the byte it leaves by
        leave = np.full(len(some), depth, np.int64)
        byte = np.zeros(len(some), np.int64)
        side = np.zeros(len(some), np.int64)
        alike = np.flatnonzero(member != pivot)
        for o in offsets:
            if not len(alike):
                break
            mine, theirs = words[member[alike] + o], words[pivot[alike] + o]
            differ = mine != theirs
            gone = alike[differ]
            if len(gone):
                x, y = mine[differ], theirs[differ]
                k = _leading_equal_bytes(x ^ y)
                leave[gone] = o + k
                byte[gone] = (x >> (np.uint64(56) - np.uint64(8) * k.astype(np.uint64))).astype(np.int64) & 255
                side[gone] = np.where(x < y, -1, 1)
                alike = alike[~differ]
        around = np.where(side < 0, leave, -leave)
        move = np.lexsort((byte, around, side, group))
        order[some] = order[some][move]
        group, side, leave, byte = group[move], side[move], leave[move], byte[move]
        fresh = np.ones(len(some), bool)
        fresh[1:] = ((group[1:] != group[:-1]) | (side[1:] != side[:-1])
                     | (leave[1:] != leave[:-1]) | (byte[1:] != byte[:-1]))
        head[some] = fresh
        left = np.zeros(len(head), bool)
        left[some[side != 0]] = True  # the pivot's own leaf is done
        open_ = left & _tied(head)


def _leading_equal_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the top of each (nonzero) word."""
    out = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        high = (x >> np.uint64(64 - bits)) == 0
        out += np.where(high, bits // 8, 0)
        x = np.where(high, x << np.uint64(bits), x)
    return out

"""Columns of text as blocks of words, without a Python object for each word.

A column of strings is one UTF-8 buffer.  ``split_words`` lower-cases A-Z,
finds the words by byte class (bytes from 0x80 up are never separators, so
UTF-8 sequences stay whole) and dictionary-encodes them.
"""

from __future__ import annotations

import ctypes
import multiprocessing
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 4 << 20


def byte_table(separators: set[int]) -> bytes:
    """Translation: separators to a blank, A-Z to a-z, others unchanged."""
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words of 0-9, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = byte_table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words of letters: the same without digits.
LETTERS = byte_table({*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words between white space.
SPACED = byte_table({0x20, *range(0x09, 0x0E)})


@dataclass
class Words:
    codes: np.ndarray    # for each word its place in ``terms``
    offsets: np.ndarray  # for each text its first word; one more entry at the end
    terms: pa.BinaryArray


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, start = len(column), column.offset
    buffers = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64)[start:start + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def split_words(column: pa.Array, table: bytes) -> Words:
    offsets, data = buffer_of(column)
    data = np.frombuffer(data.tobytes().translate(table), np.uint8)
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]  # a text never continues the word before it
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) - starts + 1)))
    packed = data[inside]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
    return Words(words.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                 np.searchsorted(starts, offsets), words.dictionary.cast(pa.binary()))


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1,
           limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold ``limit`` bytes or are a single row."""
    for batch in batches:
        offsets, _ = buffer_of(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` between offsets; empty stretches are 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[offsets[1:]] - total[offsets[:-1]]


def trim() -> None:
    """Give memory that a task has freed back to the system: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def in_child(work: Callable[[], bytes]) -> bytes:
    """What ``work`` returns, from a process of its own: all the memory that it took ends with it.

    A child that dies fails the task, which Spark runs again.
    """
    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(duplex=False)
    child = context.Process(target=lambda: send.send_bytes(work()))
    child.start()
    send.close()
    try:
        return receive.recv_bytes()
    except EOFError:
        raise RuntimeError("the task's child process died; its error is in the executor's log") from None
    finally:
        receive.close()
        child.join()

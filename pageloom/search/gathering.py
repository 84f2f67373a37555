"""Numbers of patterns met by documents, put together a batch at a time.

A common pattern meets a document in many words. Over Arrow batches the numbers a document met become one sorted list, written as its gaps in
one or two bytes each, so what is moved by document is a small part of the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Hits that are put together at once.
GATHERED_HITS = 1 << 22
#: Documents and pairs of a document and a number that leave a task at once.
KEY_ROWS, PAIR_ROWS = 1 << 14, 1 << 17
#: Bytes of seven bits that the largest number takes.
_MOST = 5


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each and a sign that more follow; and how many bytes each takes."""
    sizes = 1 + sum((numbers >> (7 * k) > 0).astype(np.int64) for k in range(1, _MOST))
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for k in range(_MOST):
        here = sizes > k
        out[start[here] + k] = (numbers[here] >> (7 * k) & 127) | ((sizes[here] > k + 1).astype(np.int64) << 7)
    return out, sizes


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``packed`` bytes, and where each begins."""
    last = np.flatnonzero(data < 128)
    start = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(_MOST):
        here = start + k <= last
        out[here] |= (data[start[here] + k].astype(np.int64) & 127) << (7 * k)
    return out, start


def _unique_pairs(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, in order."""
    span = int(number.max()) + 1 if len(number) else 1
    return np.divmod(np.unique(owner.astype(np.int64) * span + number), span)


def _lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row per key of these batches ``(key, numbers)``: its different numbers as gaps."""
    rows = pa.Table.from_batches(held).combine_chunks()
    keys, numbers = rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode"), rows.column("numbers").combine_chunks()
    sizes = pc.list_value_length(numbers).to_numpy(zero_copy_only=False)
    code, number = _unique_pairs(np.repeat(keys.indices.to_numpy(zero_copy_only=False), sizes), numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, dtype=np.int64)
    gaps = np.diff(number, prepend=0)
    gaps[first] = number[first]
    data, taken = packed(gaps)
    ends = np.append(0, np.cumsum(taken))
    offsets = np.append(ends[first], len(data)).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[first])), blobs], names=["key", "met"])


def _pairs(keys: pa.Array, parts: pa.Array) -> pa.RecordBatch:
    """(number, key), each once, of keys with all their lists of gaps."""
    owner = np.repeat(np.arange(len(keys)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    blobs = parts.flatten()
    taken = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint8)
    gaps, start = unpacked(data)
    row = np.repeat(np.arange(len(blobs)), taken)[start]
    total = np.cumsum(gaps)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
    # Gaps start anew with every list.
    number = total - np.repeat((total - gaps)[first], np.diff(np.append(first, len(row))))
    code, number = _unique_pairs(owner[row], number)
    return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), keys.take(pa.array(code))], names=["number", "key"])


def gathered(hits: DataFrame) -> DataFrame:
    """(number, key), each once, of ``hits(key, numbers array<int>)``; a key is a string or NULL.

    A task brings the numbers of a key together before they are moved by key. Numbers are whole and small, so they pair with keys in 64 bits.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("numbers").flatten())
            if n >= GATHERED_HITS:
                yield from _sliced(_lists(held), KEY_ROWS)
                held, n = [], 0
        if held:
            yield from _sliced(_lists(held), KEY_ROWS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _sliced(_pairs(batch.column("key"), batch.column("parts")), PAIR_ROWS)

    met = hits.select("key", "numbers").mapInArrow(lists, "key string, met binary")
    return met.groupBy("key").agg(F.collect_list("met").alias("parts")).mapInArrow(pairs, "number int, key string")


def _sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)

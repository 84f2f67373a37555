"""Tokens of documents to postings, a batch at a time.

Runs of equal (document, term) pairs need a sort inside each document. Catalyst does that with interpreted lambdas, a token at a time; over Arrow
batches it is one sort of integers for all documents of a slice, about four times as fast in whole. No row is shuffled for it.
The sort goes by bucket, term and document, the order in which an index files them, so a task that files postings has only a few runs to merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens that are sorted at once.
SLICE_TOKENS = 1 << 19
#: Fields a composition of three is split by: what is in neither is in the last.
SPLIT_FIELDS = 2

_DDL = "field string, bucket int, term string, key string, block long, tf int, dl int, positions array<int>"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
_SPLIT_DDL = "".join(f", tf_{k} int, dl_{k} int" for k in range(SPLIT_FIELDS))
_SCHEMA = pa.schema(list(zip((c.split()[0] for c in _DDL.split(", ")), _TYPES)))


def _in_order(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each term, as ``index.term_bucket`` has it, and its place in the order of buckets and terms."""
    bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in terms.to_pylist()), dtype=np.int32, count=len(terms))
    order = pc.sort_indices(pa.table({"bucket": bucket, "term": terms}), sort_keys=[("bucket", "ascending"), ("term", "ascending")]).to_numpy()
    place = np.empty(len(terms), dtype=np.int64)
    place[order] = np.arange(len(terms))
    return bucket, place


def _runs(
    field: str, doc: np.ndarray, code: np.ndarray, place: np.ndarray, lengths: np.ndarray, terms: pa.Array, bucket: np.ndarray, docs: pa.RecordBatch,
    parts: tuple[np.ndarray, list[np.ndarray]] | None = None, split: bool = False,
) -> pa.RecordBatch:
    """Postings of one field from tokens in order of term, document and place.

    With ``split`` each also has, of the first fields it is composed of, how many of its places lie in them and their lengths: ``parts`` has
    the number of the field for every token and the lengths of all of them; without it these are NULL.
    """
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(doc))
    owner = doc[first]
    columns = [
        pa.repeat(pa.scalar(field), len(first)),
        pa.array(bucket[code[first]]),
        terms.take(pa.array(code[first])),
        docs.column("key").take(pa.array(owner)),
        docs.column("block").take(pa.array(owner)),
        pa.array(np.diff(ends).astype(np.int32)),
        pa.array(lengths[owner].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
    ]
    if not split:
        return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
    for k in range(SPLIT_FIELDS):
        if parts is None:
            columns += [pa.nulls(len(first), pa.int32())] * 2
        else:
            tag, sizes = parts
            columns += [pa.array(np.add.reduceat(tag == k, first, dtype=np.int32)), pa.array(sizes[k][owner].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[*_SCHEMA.names, *(f"{x}_{k}" for k in range(SPLIT_FIELDS) for x in ("tf", "dl"))])


def _slice_postings(docs: pa.RecordBatch, fields: tuple[str, ...], composed: tuple[str, ...], buckets: int, split: bool) -> Iterator[pa.RecordBatch]:
    """Postings of a few documents: those of the composed fields and of their composition come from one sort."""
    n = docs.num_rows
    whole = "composite_text" in fields
    alone = [f for f in fields if f != "composite_text" and not (whole and f in composed)]
    for group in ([composed] if whole else []) + [(f,) for f in alone]:
        lengths = [pc.list_value_length(docs.column(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in group]
        tokens = pa.concat_arrays([docs.column(f).flatten() for f in group]).dictionary_encode()
        if not len(tokens):
            continue
        code, terms = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
        bucket, rank = _in_order(terms, buckets)
        doc = np.concatenate([np.repeat(np.arange(n), x) for x in lengths])
        place = np.concatenate([np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x) for x in lengths])
        # Stable, so a document's tokens of one term stay in the order of fields and places.
        order = np.argsort(rank[code] * n + doc, kind="stable")
        doc, code = doc[order], code[order]
        tag = np.repeat(np.arange(len(group)), [int(x.sum()) for x in lengths])[order]
        if whole and group is composed:
            before = np.concatenate([np.repeat(b, x) for b, x in zip(np.cumsum([np.zeros(n, dtype=np.int64), *lengths[:-1]], axis=0), lengths)])
            parts = (tag, lengths) if split else None
            yield _runs("composite_text", doc, code, (place + before)[order], np.sum(lengths, axis=0), terms, bucket, docs, parts, split)
            if split:
                continue
        place = place[order]
        for k, field in enumerate(group):
            if field in fields:
                mine = tag == k
                if mine.any():
                    yield _runs(field, doc[mine], code[mine], place[mine], lengths[k], terms, bucket, docs, split=split)


def grouped(analysed: DataFrame, fields: tuple[str, ...], composed: tuple[str, ...], buckets: int, split: bool = False) -> DataFrame:
    """(field, bucket, term, key, block, tf, dl, positions) of ``analysed(key, block, <field> array<string>, ...)``.

    The composite text's tokens are those of ``composed`` in a row. With ``split`` its postings stand for those of the composed fields too: they have
    no rows, and ``tf_0, dl_0, tf_1, dl_1`` say how many of the places are in the first and second of them, and how long these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.schema.names[2:]
            sizes = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            start = held = 0
            for k, size in enumerate(sizes.tolist()):
                if k > start and held + size > SLICE_TOKENS:
                    yield from _slice_postings(batch.slice(start, k - start), fields, composed, buckets, split)
                    start, held = k, 0
                held += size
            if batch.num_rows:
                yield from _slice_postings(batch.slice(start), fields, composed, buckets, split)

    return analysed.mapInArrow(run, _DDL + _SPLIT_DDL if split else _DDL)


_IMPACTS_DDL = "field string, bucket int, term string, block long, tf int, n long, min_dl int, max_dl int"


def impacts_of(postings: DataFrame) -> DataFrame:
    """(field, bucket, term, block, tf, n, min_dl, max_dl) of postings that lie in order of field, bucket, term and block, as an index files them.

    Rows of a term and block stand together, so they are summed up where they lie. Where a file or a batch ends between them there are two rows,
    whose ``n`` add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tf, dl, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tf", "dl", "block"))
            new = np.ones(len(tf), dtype=bool)
            new[1:] = block[1:] != block[:-1]
            for c in ("field", "bucket", "term"):
                column = batch.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(tf) - 1)).to_numpy(zero_copy_only=False)
            place = np.cumsum(new)
            order = np.lexsort((tf, place))
            same = np.ones(len(tf), dtype=bool)
            same[1:] = (place[order][1:] != place[order][:-1]) | (tf[order][1:] != tf[order][:-1])
            first = np.flatnonzero(same)
            taken, lengths = pa.array(order[first]), dl[order]
            columns = [batch.column(c).take(taken) for c in ("field", "bucket", "term", "block", "tf")]
            sums = [np.diff(np.append(first, len(tf))), np.minimum.reduceat(lengths, first), np.maximum.reduceat(lengths, first)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in sums], names=[c.split()[0] for c in _IMPACTS_DDL.split(", ")])

    return postings.select("field", "bucket", "term", "block", "tf", "dl").mapInArrow(run, _IMPACTS_DDL)

"""An index on disk, made of segments.

A segment holds documents and everything that follows from them, and is never changed. A manifest names the segments that count, with their numbers of
documents and tokens; writing it is the commit. Adding documents writes a segment of them alone: what it costs follows from what is
added. Document frequencies, corpus sizes and so the scores are summed over segments when the index is opened. Segments of like size are merged once
there are several, so a document is rewritten about as often as the logarithm of the corpus is long.

Documents of a segment are numbered in the order of keys, in blocks of ``1 << BLOCK_BITS``; postings lie by term and block. A task files the postings of the
documents it reads, a run of consecutive keys, so no posting is shuffled; a folder of a field and bucket holds a file per run, in order of terms.

The composite text is title, content and summary in a row. Its postings say how many of their places are in each, so the three fields have no rows
of their own on disk: they are read off those of the composite text, and only when they are asked for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.joins import concerned
from pageloom.operators.numbering import first_per
from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most, small_side
from pageloom.search.analysis import MIN_LENGTH, STOP_WORDS
from pageloom.search.grouping import impacts_of
from pageloom.search.index import COMPOSED, DOC_COLUMNS, FIELDS, TERM_BUCKETS, Index, postings_of, term_bucket
from pageloom.session import staged
from pageloom.sources import manifest

#: Documents of a block: 2 to this power.
BLOCK_BITS = 7
#: Segments of one size class that are merged, and folders of lookups.
FAN_IN, LOOKUP_FAN_IN = 4, 8
DOC_GROUP_BYTES = 16 << 20
#: Bytes of documents, of postings to sum up and of rows to merge that a task reads: what it puts in order fits its memory.
POSTED_BYTES, SUMMED_BYTES, MERGED_BYTES = DOC_GROUP_BYTES, 64 << 20, 24 << 20
#: Hashes of keys that are broadcast at most: 8 bytes each.
HASHED_ROWS = 4_000_000
#: Words whose lookups a task makes, some fifty rows each.
TASK_WORDS = 200_000
DICTIONARY_BYTES = 4 << 20
#: Letters at the head of a word from which letters are left out, and how many of them at most.
HEAD_LETTERS, MAX_DELETIONS = 7, 2
#: Signs before and after a word in its grams; no token holds them.
HEAD, TAIL = "\x02", "\x03"
GRAM = 3

DDL = {
    "docs": ", ".join(f"{c} STRING" for c in DOC_COLUMNS) + ", block BIGINT",
    "postings": "field STRING, bucket INT, term STRING, key STRING, tf INT, dl INT, positions ARRAY<INT>, block BIGINT, tf_0 INT, dl_0 INT, tf_1 INT, dl_1 INT",
    "impacts": "field STRING, bucket INT, term STRING, block BIGINT, tf INT, n BIGINT, min_dl INT, max_dl INT",
    "vocabulary": "field STRING, bucket INT, term STRING, df BIGINT",
    "deletions": "bucket INT, cut STRING, d INT, head STRING",
    "heads": "bucket INT, head STRING, term STRING",
    "grams": "bucket INT, gram STRING, term STRING",
}
_LOOKUPS = ("deletions", "heads", "grams")
_FILED = {"postings": ("field", "bucket"), "impacts": ("field", "bucket"), "vocabulary": ("field", "bucket"), "deletions": ("bucket",), "heads": ("bucket",), "grams": ("bucket",)}
_ORDER = {"postings": ("term", "block"), "impacts": ("term", "block"), "vocabulary": ("term",), "deletions": ("cut",), "heads": ("head",), "grams": ("gram",)}
#: What the buckets and rows on disk mean; an index written otherwise is not read.
LAYOUT = 2


def _folder(path: str, table: str, segment: str) -> str:
    return f"{path}/{table}/seg={segment}"


def _read(spark: SparkSession, path: str, table: str, segments: list[str]) -> DataFrame:
    """Rows of a table in these segments, with their ``seg``."""
    schema = f"{DDL[table]}, seg STRING"
    if not segments:
        return spark.createDataFrame([], schema)
    folders = [_folder(path, table, s) for s in segments]
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*folders)


@contextmanager
def _reading(spark: SparkSession, size: int) -> Iterator[None]:
    """Tasks that start in here read at most so many bytes of files."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _write_filed(rows: DataFrame, path: str, table: str, segment: str) -> None:
    """Write by field and bucket, terms in order, so a search skips what its terms do not touch.

    Every task files its own rows: a folder has a file per task that held some of it, and nothing is moved.
    """
    filed = _FILED[table]
    ordered = rows.sortWithinPartitions(*filed, *_ORDER[table])
    # Few different keys and words come to a task; a dictionary that holds them all makes a row of two or three bytes.
    packed = ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY_BYTES)
    packed.partitionBy(*filed).parquet(_folder(path, table, segment))


def _left_out(word: Column) -> Column:
    """The word with each of its letters left out once."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - F.lit(1)), F.substring(word, i + F.lit(1), F.length(word))))


def deletion_cuts(word: Column, most: int = MAX_DELETIONS) -> Column:
    """array<struct<cut, d>>: the head of a word (or the word that is one) with up to ``most`` letters left out.

    Of two words within k edits, some cut of one head with at most k letters out equals one of the other: the edits of the heads
    alone leave a common text, and what one head reaches further into its word goes too.
    """
    head = F.left(word, F.lit(HEAD_LETTERS))
    layers, layer = [F.array(head)], F.array(head)
    for _ in range(most):
        longer = F.filter(layer, lambda c: F.length(c) > 0)
        layer = F.array_distinct(F.flatten(F.transform(longer, _left_out)))
        layers.append(layer)
    return F.concat(*(_tagged(found, d) for d, found in enumerate(layers)))


def _tagged(cuts: Column, d: int) -> Column:
    return F.transform(cuts, lambda c: F.struct(c.alias("cut"), F.lit(d).alias("d")))


def word_grams(word: Column) -> Column:
    """Runs of one to three letters of a word; those of three also with the signs of its head and tail, so they say where they stand."""
    framed = F.concat(F.lit(HEAD * (GRAM - 1)), word, F.lit(TAIL * (GRAM - 1)))
    return F.array_distinct(F.concat(_runs(framed, GRAM), *(_runs(word, size) for size in range(1, GRAM))))


def _runs(text: Column, size: int) -> Column:
    """All runs of so many letters."""
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(text, i, F.lit(size)))


def _lookups(words: DataFrame, buckets: int) -> dict[str, DataFrame]:
    """Deletions, heads and grams of ``words(term)``. Every word has the empty gram, filed by the word, for patterns without letters.

    Many words share a head, and a growing vocabulary brings few new ones, so letters are left out of each head once.
    """
    headed = words.select(F.left("term", F.lit(HEAD_LETTERS)).alias("head"), "term")
    # Cuts of one head with different numbers of letters out differ in length, so each is there once.
    cuts = headed.select("head").distinct().select("head", F.explode(deletion_cuts(F.col("head"))).alias("c")).select("head", "c.*")
    grams = words.select("term", F.explode(F.concat(F.array(F.lit("")), word_grams(F.col("term")))).alias("gram"))
    by = F.when(F.col("gram") == "", F.col("term")).otherwise(F.col("gram"))
    return {
        "deletions": cuts.select(term_bucket(F.col("cut"), buckets).alias("bucket"), "cut", "d", "head"),
        "heads": headed.select(term_bucket(F.col("head"), buckets).alias("bucket"), "head", "term"),
        "grams": grams.select(term_bucket(by, buckets).alias("bucket"), "gram", "term"),
    }


def write_segment(
    docs: DataFrame, path: str, buckets: int = TERM_BUCKETS, fields=FIELDS, stop_words=STOP_WORDS, min_len: int = MIN_LENGTH, older: list[str] = ()
) -> tuple[dict, list[dict]]:
    """Write documents as a segment, of those with one key the first by ``pos`` where there is one; what the manifest says about it and its lookups.

    Words of the ``older`` segments have their lookups; those of other words are filed with this one.
    """
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    # Keys in order over all files; what has one key is in one task, so the first of it is found without moving texts again.
    ranged = docs.repartitionByRange("key")
    unique = first_per(ranged, "key", F.col("pos")) if "pos" in docs.columns else ranged
    # Numbers count up inside a task, its own number in front, so blocks are runs of consecutive keys.
    ordered = unique.select(*DOC_COLUMNS).sortWithinPartitions("key")
    numbered = ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    _write_docs(numbered, path, segment)

    def written(table: str) -> DataFrame:
        return _read(spark, path, table, [segment]).drop("seg")

    with _reading(spark, POSTED_BYTES):
        split = {"composite_text", *COMPOSED} <= set(fields)
        _write_filed(postings_of(written("docs"), fields, stop_words, min_len, buckets, split), path, "postings", segment)
    with _reading(spark, SUMMED_BYTES):
        _write_filed(impacts_of(written("postings")), path, "impacts", segment)
    return _finished(spark, path, segment, buckets, older)


def _write_docs(numbered: DataFrame, path: str, segment: str) -> None:
    packed = numbered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", DOC_GROUP_BYTES)
    packed.parquet(_folder(path, "docs", segment))


def _finished(spark: SparkSession, path: str, segment: str, buckets: int, older: list[str] = ()) -> tuple[dict, list[dict]]:
    """Write the vocabulary of a segment from its postings and the lookups of words that ``older`` segments do not have, and count it."""
    postings = _read(spark, path, "postings", [segment])
    frequencies = {f: F.count_if(_split(k)[0] > 0) for k, f in enumerate(COMPOSED)}
    counted = postings.groupBy("field", "bucket", "term").agg(F.count(F.lit(1)).alias("df"), *(n.alias(f"df_{f}") for f, n in frequencies.items()))
    by_field = F.array(F.struct("field", "df"), *(F.struct(F.lit(f).alias("field"), F.col(f"df_{f}").alias("df")) for f in COMPOSED))
    vocabulary = counted.select("bucket", "term", F.explode(by_field).alias("v")).where("v.df > 0").select("v.field", "bucket", "term", "v.df")
    _write_filed(vocabulary, path, "vocabulary", segment)
    words = _read(spark, path, "vocabulary", [segment]).select("term")
    if older:
        words = staged(words.distinct().join(_read(spark, path, "vocabulary", list(older)).select("term"), "term", "left_anti"), "new-words")
    n_words = words.count()
    if n_words or not older:
        for table, rows in _lookups(words.repartition(math.ceil(n_words / TASK_WORDS) or 1, "term").distinct(), buckets).items():
            _write_filed(rows, path, table, segment)
    sums = postings.groupBy("field").agg(F.sum("tf").alias("n"), *(F.sum(_split(k)[0]).alias(f) for k, f in enumerate(COMPOSED))).collect()
    n_tokens = {r["field"]: r["n"] for r in sums} | {f: r[f] for r in sums for f in COMPOSED if r[f]}
    n_docs, blocks = _read(spark, path, "docs", [segment]).agg(F.count(F.lit(1)), F.max("block")).first()
    lookups = [{"name": segment, "words": n_words}] if n_words or not older else []
    return {"name": segment, "n_docs": n_docs, "n_tokens": n_tokens, "blocks": (blocks or 0) + 1}, lookups


def _split(k: int) -> tuple[Column, Column, Column]:
    """Of a posting of the composite text, what is in the field ``COMPOSED[k]``: its frequency there, the length of the field, and what lies before: places, then length."""
    tf, dl = [F.col("tf_0"), F.col("tf_1")], [F.col("dl_0"), F.col("dl_1")]
    tf.append(F.col("tf") - tf[0] - tf[1])
    dl.append(F.col("dl") - dl[0] - dl[1])
    zero = F.lit(0)
    return tf[k], dl[k], F.struct(sum(tf[:k], zero).alias("places"), sum(dl[:k], zero).alias("length"))


def _unfolded(filed: DataFrame) -> DataFrame:
    """Postings of all fields: those on disk, and those of title, content and summary that stand in them. Who asks for one field reads it alone."""
    shown = ["field", "bucket", "term", "key", "tf", "dl", "positions", "block", "seg"]
    parts = [filed.select(*shown)]
    composed = filed.where("field = 'composite_text'")
    for k, field in enumerate(COMPOSED):
        tf, dl, before = _split(k)
        places = F.slice("positions", before["places"] + 1, tf)
        if k:
            places = F.transform(places, lambda p: p - before["length"])
        inside = {"field": F.lit(field), "tf": tf, "dl": dl, "positions": places}
        parts.append(composed.where(tf > 0).select(*[inside[c].alias(c) if c in inside else c for c in shown]))
    return reduce(DataFrame.unionByName, parts)


def _all_impacts(filed: DataFrame, postings: DataFrame) -> DataFrame:
    """Impacts on disk, and those of the fields that have no rows there, from their postings."""
    summed = postings.where(F.col("field").isin(*COMPOSED)).groupBy("field", "bucket", "term", "seg", "block", "tf")
    inside = summed.agg(F.count(F.lit(1)).alias("n"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))
    return filed.unionByName(inside)


def _known(content: dict) -> dict:
    if content.get("segments") and content.get("layout") != LAYOUT:
        raise ValueError("this index was written by another version: build it anew")
    # Where the manifest does not name them, every segment has the lookups of all its words.
    every = [{"name": s["name"], "words": s["n_docs"]} for s in content.get("segments", [])]
    return {"lookups": every, **content, "layout": LAYOUT}


def build_index(docs: DataFrame, path: str, buckets: int = TERM_BUCKETS, **options) -> Index:
    """Build an index anew: its first segment. Of documents with one key the first counts."""
    spark = docs.sparkSession
    number, _ = manifest.newest(spark, path)
    segment, lookups = write_segment(docs, path, buckets, **options)
    manifest.commit(spark, path, number + 1, {"layout": LAYOUT, "buckets": buckets, "segments": [segment], "lookups": lookups, "added": []})
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open an index: its segments as one."""
    content = _known(manifest.newest(spark, path)[1])
    segments, buckets = content.get("segments", []), content.get("buckets", TERM_BUCKETS)
    names = [s["name"] for s in segments]
    looked = [s["name"] for s in content["lookups"]]
    tables = {t: _read(spark, path, t, looked if t in _LOOKUPS else names) for t in DDL}
    vocabulary = tables["vocabulary"].drop("seg")
    if len(names) > 1:
        vocabulary = vocabulary.groupBy("field", "bucket", "term").agg(F.sum("df").alias("df"))
    n_docs = sum(s["n_docs"] for s in segments)
    n_tokens: dict[str, int] = {}
    for s in segments:
        for field, n in s["n_tokens"].items():
            n_tokens[field] = n_tokens.get(field, 0) + n
    sizes = [(field, n_docs, n / n_docs) for field, n in sorted(n_tokens.items())]
    corpus = spark.createDataFrame(sizes, "field STRING, n_docs BIGINT, avg_len DOUBLE")
    postings = _unfolded(tables["postings"])
    return Index(
        tables["docs"].drop("seg", "block"), postings, vocabulary, corpus, buckets, _all_impacts(tables["impacts"], postings),
        tables["deletions"].drop("seg"), tables["grams"].drop("seg"), tables["heads"].drop("seg"),
    )


def index_append(docs: DataFrame, path: str, name: str | None = None, merge: bool = True, buckets: int = TERM_BUCKETS, **options) -> Index:
    """Add the documents whose key the index does not have yet, as a segment of their own; those that are there stay as they were.

    With a ``name`` an addition that was committed before under it changes nothing, so a batch may run again. Like segments are merged
    after it unless ``merge`` is off. Without an index this builds one, with so many ``buckets``.
    """
    spark = docs.sparkSession
    number, content = manifest.newest(spark, path)
    content = _known(content) if number else {"layout": LAYOUT, "buckets": buckets, "segments": [], "lookups": [], "added": []}
    if name is not None and name in content["added"]:
        return read_index(spark, path)
    kept = [c for c in (*DOC_COLUMNS, "pos") if c in docs.columns]
    docs = docs.select(*kept)
    if number:
        # First the keys alone: of what is there already no text is moved or written. A small batch picks its keys where the documents lie.
        known = _read(spark, path, "docs", [s["name"] for s in content["segments"]]).select("key")
        asked = staged(docs.select("key").distinct(), "asked-keys")
        new = staged(asked.join(concerned(known, asked, "key"), "key", "left_anti"), "new-keys").withColumnRenamed("key", "_new")
        if not (few := holds_at_most(new, BROADCAST_ROWS)) and holds_at_most(new, HASHED_ROWS):
            # Too many keys to broadcast, but not their hashes: of what is there already next to no text is moved.
            hashes = new.select(F.xxhash64("_new").alias("_hash")).distinct()
            docs = docs.join(F.broadcast(hashes), F.xxhash64("key") == F.col("_hash"), "left_semi")
        docs = docs.join(small_side(new, small=few), F.col("key").eqNullSafe(F.col("_new")), "left_semi")
    fresh = staged(docs, "new-documents")
    added = [*content["added"], *([name] if name is not None else [])]
    if fresh.take(1):
        segment, lookups = write_segment(fresh, path, content["buckets"], older=[s["name"] for s in content["segments"]], **options)
        grown = {"segments": [*content["segments"], segment], "lookups": [*content["lookups"], *lookups], "added": added}
        manifest.commit(spark, path, number + 1, {**content, **grown})
    elif name is not None or not number:
        manifest.commit(spark, path, number + 1, {**content, "added": added})
    return index_merge(spark, path) if merge else read_index(spark, path)


def _size_class(size: int, fan_in: int) -> int:
    return int(math.log(max(size, 1), fan_in) + 1e-9)


def _alike(of: list[dict], size: str, fan_in: int) -> list[dict]:
    """Those of the smallest size class that has ``fan_in`` of them, or none."""
    classes: dict[int, list[dict]] = {}
    for s in of:
        classes.setdefault(_size_class(s[size], fan_in), []).append(s)
    ready = [c for c in sorted(classes) if len(classes[c]) >= fan_in]
    return classes[ready[0]] if ready else []


def index_merge(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> Index:
    """Merge segments wherever ``fan_in`` of one size class have come together, until none have.

    Nothing is analysed again: rows are filed anew, frequencies added, and blocks keep their documents under new numbers. Lookups say what words there
    are, whichever segment has them, so they stay; their folders are merged by themselves, less often.
    """
    while True:
        number, content = manifest.newest(spark, path)
        content = _known(content)
        if old := _alike(content.get("segments", []), "n_docs", fan_in):
            merged = _merged(spark, path, old)
            names = {s["name"] for s in old}
            changed = {"segments": [*(s for s in content["segments"] if s["name"] not in names), merged]}
        elif old := _alike(content["lookups"], "words", LOOKUP_FAN_IN):
            names = {s["name"] for s in old}
            changed = {"lookups": [*(s for s in content["lookups"] if s["name"] not in names), _merged_lookups(spark, path, old)]}
        else:
            return read_index(spark, path)
        manifest.commit(spark, path, number + 1, {**content, **changed})


def _merged_lookups(spark: SparkSession, path: str, old: list[dict]) -> dict:
    name = uuid.uuid4().hex
    with _reading(spark, MERGED_BYTES):
        for table in _LOOKUPS:
            _write_filed(_read(spark, path, table, [s["name"] for s in old]).drop("seg"), path, table, name)
    return {"name": name, "words": sum(s["words"] for s in old)}


def _merged(spark: SparkSession, path: str, old: list[dict]) -> dict:
    names, segment = [s["name"] for s in old], uuid.uuid4().hex
    # Blocks of one segment come behind those of the one before.
    starts, at = {}, 0
    for s in old:
        starts[s["name"]] = at
        at += s["blocks"]
    start = reduce(lambda out, s: F.when(F.col("seg") == s, F.lit(starts[s])).otherwise(out), names, F.lit(0)).cast("bigint")

    def moved(table: str) -> DataFrame:
        return _read(spark, path, table, names).withColumn("block", F.col("block") + start).drop("seg")

    _write_docs(moved("docs").repartitionByRange("key").sortWithinPartitions("key"), path, segment)
    with _reading(spark, MERGED_BYTES):
        for table in ("postings", "impacts"):
            _write_filed(moved(table), path, table, segment)
    # A document is in one segment, so frequencies and sizes are sums.
    vocabulary = _read(spark, path, "vocabulary", names).groupBy("field", "bucket", "term").agg(F.sum("df").alias("df"))
    _write_filed(vocabulary, path, "vocabulary", segment)
    fields = sorted({f for s in old for f in s["n_tokens"]})
    n_tokens = {f: sum(s["n_tokens"].get(f, 0) for s in old) for f in fields}
    return {"name": segment, "n_docs": sum(s["n_docs"] for s in old), "n_tokens": n_tokens, "blocks": at}

"""The inverted index as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.text import composite_text, cut, strip
from pageloom.functions.urls import search_key
from pageloom.operators.joins import index_update_antijoin
from pageloom.operators.numbering import first_per
from pageloom.search.analysis import MIN_LENGTH, STOP_WORDS, tokens
from pageloom.search.grouping import grouped

FIELDS = ("title", "url", "content", "summary", "composite_text")
COMPOSED = ("title", "content", "summary")
TERM_BUCKETS = 32


@dataclass(frozen=True)
class Index:
    """``docs(key, title, url, content, summary, composite_text)``,
    ``postings(field, bucket, term, key, tf, dl, positions)``,
    ``vocabulary(field, bucket, term, df)`` and ``corpus(field, n_docs, avg_len)``.

    ``dl`` is the length of the document's field. Having it in the postings
    saves the ranking a join with a table of lengths.

    An index on disk (``pageloom.search.segments``) has more: postings know their ``seg`` and ``block`` of documents,
    ``impacts(field, bucket, term, seg, block, tf, n, min_dl, max_dl)`` say what a block can score, and ``deletions(bucket, cut, d, head)``,
    ``heads(bucket, head, term)`` and ``grams(bucket, gram, term)`` lead from parts of words to words.
    """

    docs: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    corpus: DataFrame
    buckets: int = TERM_BUCKETS
    impacts: DataFrame | None = None
    deletions: DataFrame | None = None
    grams: DataFrame | None = None
    heads: DataFrame | None = None


def term_bucket(term, buckets: int):
    """The bucket a term is filed under."""
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def search_doc_prepare(store: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Stored rows to search documents; ``pos`` is the store key. Contents stay whole unless ``max_chars`` is given."""
    blank = F.lit("")
    content = F.concat(F.coalesce("content", blank), F.lit("\n\n"), F.coalesce("description", blank))
    title = F.coalesce(F.nullif(F.col("title"), blank), F.col("name"), blank)
    prepared = store.select(
        F.col("key").alias("pos"),
        search_key(F.col("guid"), F.col("id"), F.col("url")).alias("key"),
        strip(title).alias("title"),
        strip(F.coalesce("url", blank)).alias("url"),
        cut(content, max_chars).alias("content"),
        strip(F.coalesce("summary", blank)).alias("summary"),
    )
    return prepared.withColumn("composite_text", composite_text(F.col("title"), F.col("content"), F.col("summary")))


def postings_of(
    docs: DataFrame, fields=FIELDS, stop_words=STOP_WORDS, min_len: int = MIN_LENGTH, buckets: int = TERM_BUCKETS, split: bool = False
) -> DataFrame:
    """Postings of documents with unique keys; a ``block`` of the documents goes along.

    Tokens are made by column functions and grouped where the document is. With ``split`` those of the composite text stand for its fields, as an
    index files them; ``segments`` says how they are read.
    """
    needed = dict.fromkeys(f for f in (*fields, *COMPOSED) if f in COMPOSED and "composite_text" in fields or f in fields and f != "composite_text")
    block = F.col("block") if "block" in docs.columns else F.lit(0)
    analysed = docs.select("key", block.cast("bigint").alias("block"), *[tokens(F.col(f), stop_words, min_len).alias(f) for f in needed])
    found = grouped(analysed, tuple(fields), COMPOSED, buckets, split)
    return found if "block" in docs.columns else found.drop("block")


def vocabulary_of(postings: DataFrame) -> DataFrame:
    """Document frequency per field and term."""
    return postings.groupBy("field", "bucket", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Number of documents and average length per field."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    lengths = postings.groupBy("field").agg(F.sum("tf").alias("n_tokens"))
    return lengths.select("field", n_docs.alias("n_docs"), (F.col("n_tokens") / n_docs).alias("avg_len"))


def corpus_stats(postings: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inputs of the ranking: vocabulary with document frequencies, and corpus sizes."""
    return vocabulary_of(postings), corpus_of(docs, postings)


DOC_COLUMNS = ("key", "title", "url", "content", "summary", "composite_text")


def postings_build(
    docs: DataFrame, fields=FIELDS, stop_words=STOP_WORDS, min_len: int = MIN_LENGTH, buckets: int = TERM_BUCKETS
) -> Index:
    """Index of search documents; of several with one key the first counts."""
    unique = first_per(docs, "key", F.col("pos")) if "pos" in docs.columns else docs
    unique = unique.select(*DOC_COLUMNS)
    postings = postings_of(unique, fields, stop_words, min_len, buckets)
    return Index(unique, postings, *corpus_stats(postings, unique), buckets)


def index_update(index: Index, docs: DataFrame) -> Index:
    """The index with the documents whose key it does not have yet, as a plan; ``segments.index_append`` adds them on disk.

    Only new documents are analysed. Document frequencies add up; the corpus
    sizes follow from both parts.
    """
    unique = first_per(docs, "key", F.col("pos")) if "pos" in docs.columns else docs
    fresh = index_update_antijoin(unique, index.docs).select(*DOC_COLUMNS)
    added = postings_of(fresh, buckets=index.buckets)
    all_docs = index.docs.select(*DOC_COLUMNS).unionByName(fresh)
    postings = index.postings.select(*added.columns).unionByName(added)
    vocabulary = (
        index.vocabulary.unionByName(vocabulary_of(added))
        .groupBy("field", "bucket", "term")
        .agg(F.sum("df").alias("df"))
    )
    return Index(all_docs, postings, vocabulary, corpus_of(all_docs, postings), index.buckets)


def write_index(index: Index, path: str) -> None:
    """Write an index as one segment."""
    from pageloom.search import segments

    segments.build_index(index.docs, path, buckets=index.buckets)


def build_index(docs: DataFrame, path: str, **options) -> Index:
    """Build an index on disk, anew."""
    from pageloom.search import segments

    return segments.build_index(docs, path, **options)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open a written index."""
    from pageloom.search import segments

    return segments.read_index(spark, path)


def index_scan_count(index: Index) -> DataFrame:
    """Documents in the index."""
    return index.docs.agg(F.count(F.lit(1)).alias("n_docs"))

"""BM25 search over postings.

``by`` names columns that split the corpus into parts with statistics of their own, such
as time buckets; without any there is one part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from recollect.functions.scores import bm25_term, idf, rounded
from recollect.functions.text import token_counts, tokens
from recollect.operators.ranking import top_k
from recollect.shipping import ship
from recollect.sources.tables import numbered

#: Documents whose counts leave a task at once.
PIECE = 256


@dataclass
class Index:
    by: list[str]
    #: by, id, length (documents without tokens have length 0 and count)
    lengths: DataFrame
    #: by, n, mean_length
    corpus: DataFrame
    #: by, term, id, length, tf, weight (the BM25 contribution)
    postings: DataFrame
    #: by, term, df, idf
    terms: DataFrame


def term_counts(docs: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """by, id, length, term, n; of the wanted terms where they are given"""
    return (_counted(docs, by) if wanted is None else _counted_wanted(docs, by, wanted)).where("n > 0")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the words of the first column, with an empty term (-1) for the document, and repeats the others."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            texts, *others = batch.slice(start, PIECE).columns
            found = [token_counts(text) for text in texts.to_pylist()]
            rows = np.array([1 + len(f) for f in found])
            document = np.repeat(np.arange(len(found)), rows)
            lengths = np.array([f.total() for f in found], np.int64)
            terms = pa.array((term for f in found for term in ("", *f)), pa.string())
            times = np.fromiter((n for f in found for n in (-1, *f.values())), np.int64, len(document))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(document)) for c in others), pa.array(lengths[document]), terms, pa.array(times)], names=[*batch.schema.names[1:], "length", "term", "n"])


def _counted(docs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, id, length, term, n (times in the document): words are found once for everything that an index needs.

    An empty term stands for the document (n -1).  A row counts its own words; rows meet only if an id repeats.
    """
    ship(docs.sparkSession)
    keys = [*by, "id"]
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *keys)
    said = rows.mapInArrow(_counter, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "length bigint, term string, n bigint"]))
    # never null, and known to be: no reader filters its own way
    said = said.select(*keys, *(F.coalesce(c, F.lit(nothing)).alias(c) for c, nothing in (("length", 0), ("term", ""), ("n", 0))))
    if docs.groupBy(*keys).count().where("count > 1").isEmpty():
        return said
    return said.groupBy(*keys, "length", "term").agg(F.sum("n").alias("n"))


def _counted_wanted(docs: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``_counted`` of wanted terms.  They go with their documents: what is counted, and later summed, by document is then in one place.

    The number of partitions is named, so that Spark doesn't merge them: postings are small, but their pairs with queries are not.
    """
    said = docs.select(*by, "id", tokens("text").alias("_tokens"))
    said = said.select(*by, "id", F.size("_tokens").cast("bigint").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.col("_tokens"))).alias("term"))
    said = said.withColumn("term", F.coalesce("term", F.lit("")))  # never null, and known to be: no reader filters its own way
    said = said.join(wanted.select("term", F.lit(True).alias("_wanted")), "term", "left").where("_wanted or term = ''").drop("_wanted").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return said.groupBy(*by, "id", "length", "term").agg(F.sum(F.when(F.col("term") != "", 1).otherwise(-1)).alias("n"))


def build_index(docs: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None) -> Index:
    """docs: id, text and the columns of ``by``.  ``wanted`` (distinct term) leaves other terms' postings out; the statistics are those of all.

    Wanted terms are those of queries, and go to all tasks with their statistics; postings stay with their documents.
    All terms are dealt by term, once: postings and statistics meet there and aren't sorted.
    """
    by = list(by)
    counted = _counted(docs, by) if wanted is None else _counted_wanted(docs, by, wanted)
    lengths = counted.where("n < 0").select(*by, "id", "length")
    if wanted is None:
        counted = counted.repartition(*by, "term")
    # the documents of a row that stands for them, else 0
    own = F.when(F.col("n") < 0, -F.col("n")).otherwise(0)
    # reads all columns, so that all readers share one shuffle
    whole = F.max(F.hash(*by, "id", "length", "term", "n")).alias("_whole")
    corpus = counted.groupBy(*by).agg(F.sum(own).alias("n"), (F.sum(F.col("length") * own) / F.sum(own)).alias("mean_length"), whole).where("_whole is not null").drop("_whole")
    df = counted.groupBy(*by, "term").agg(F.count(F.when(F.col("n") > 0, 1)).alias("df"), whole).where("df > 0 and _whole is not null").drop("_whole")
    # one row without `by`, else a row for each part
    terms = (df.join(F.broadcast(corpus), by) if by else df.crossJoin(F.broadcast(corpus))).withColumn("idf", idf(F.col("n"), F.col("df")))
    known = terms.drop("n").hint("shuffle_hash" if wanted is None else "broadcast")
    # the empty term has no df: it leaves with the join
    found = counted.join(known, [*by, "term"]).withColumn("tf", F.col("n").cast("double") / F.col("length"))
    postings = found.withColumn("weight", bm25_term(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean_length")))
    return Index(by, lengths, corpus, postings.select(*by, "term", "id", "length", "tf", "weight"), terms.select(*by, "term", "df", "idf"))


def query_terms(queries: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """query_id, carried columns, term, times: a term that a query repeats counts as often."""
    return queries.select("query_id", *carry, F.explode(tokens("text")).alias("term")).groupBy("query_id", *carry, "term").agg(F.count("*").alias("times"))


def bm25_scores(queries: DataFrame, index: Index) -> DataFrame:
    """by, query_id, id, score: every document that shares a term with a query.

    Pairs are many times the postings, so they are made and summed where a document's postings
    are, and aren't shuffled: an index of wanted terms has them there.
    """
    found = query_terms(queries).join(index.postings, "term")
    return found.groupBy(*index.by, "query_id", "id").agg(rounded(F.sum(F.col("times") * F.col("weight"))).alias("score"))


def bm25(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best documents of every query (and part), with rank."""
    return top_k(bm25_scores(queries, index).where("score > 0"), [*index.by, "query_id"], k)


def search(queries: DataFrame, docs: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """bm25 without a ready index: only postings of the queries' terms are made and shuffled."""
    wanted = query_terms(queries).select("term").distinct()
    return bm25(queries, build_index(docs, by, wanted), k)


def max_weights(index: Index) -> DataFrame:
    """by, term, max_score: the most that a term adds to any document."""
    return index.postings.groupBy(*index.by, "term").agg(rounded(F.max("weight")).alias("max_score"))


def csr(index: Index) -> DataFrame:
    """term, term_id, df, first: terms in order, and where each one's postings begin."""
    start = F.substring("term", 1, 3)
    terms = numbered(index.terms.select("term", "df"), start, ["term"], "term_id", top=F.substring("_bucket", 1, 1)).withColumn("_start", start)
    sums = terms.groupBy("_start").agg(F.sum("df").alias("_sum"))
    before = sums.select("_start", (F.sum("_sum").over(Window.orderBy("_start")) - F.col("_sum")).alias("_before"))
    own = F.sum("df").over(Window.partitionBy("_start").orderBy("term")) - F.col("df")
    return terms.withColumn("_own", own).join(before, "_start").select("term", "term_id", "df", (F.col("_before") + F.col("_own")).cast("bigint").alias("first"))


def skip_stats(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, postings, skipped, skip_rate: of a query's postings those that can't bring a new document among its k best.

    They are those of the terms whose bound (from that term on) is below the k-th score.
    """
    last = bm25(queries, index, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_last"))
    rows = remaining_bounds(queries, index).join(index.terms.select("term", "df"), "term").join(last, "query_id", "left")
    skipped = F.sum(F.when(F.col("bound") < F.coalesce("_last", F.lit(0.0)), F.col("df")).otherwise(0))
    out = rows.groupBy("query_id").agg(F.sum("df").alias("postings"), skipped.alias("skipped"))
    return out.withColumn("skip_rate", rounded(F.col("skipped") / F.col("postings")))


def remaining_bounds(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, place, bound: a query's terms by the most they can add, and the most that terms from here on add together."""
    terms = query_terms(queries).join(max_weights(index), "term").withColumn("most", rounded(F.col("times") * F.col("max_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return terms.select("query_id", "term", F.row_number().over(order).cast("bigint").alias("place"), rounded(F.sum("most").over(rest)).alias("bound"))

"""The corpus pipeline: stages that each write their documents before the next one reads them.

All stages but the last return the columns of documents, whatever these are besides doc_id
and text.  Rows without a doc_id pass every stage on their own text; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm import byte_bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from recollect.llm.queries import TOXIC_FROM, rank_file, toxicity_model
from recollect.llm.shared import folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a string that counts as repeated.  Of passages of 51 words in the test tables' four languages one in a
#: thousand is shorter than 246, and documents that share no passage share less: boilerplate lines have 60 to 130.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled documents of sf_dir.

    Null and empty texts score the model's bias; rows that repeat go or stay together.
    """
    name = "score"
    while name in docs.columns:
        name += "_"
    scores = toxicity.scored(docs, toxicity_model(spark, sf_dir), carry=docs.columns, name=name)
    return scores.where(F.col(name) < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id; rows without an id stay.

    Of rows that repeat a doc_id and its text one stays, with the least of the other columns.
    Documents without words (null or empty texts) are similar to nothing and stay.
    """
    groups = jaccard_join.similar_groups(docs)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("copy"))
    known = docs.where("doc_id is not null")
    single = known.join(copies, known["doc_id"] == copies["copy"], "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = single.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *others)).alias("others"))
    once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns))
    return once.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of byte strings of PASSAGE_BYTES or more go from the texts; n_chars follows.

    The first copy is that of the least doc_id.  Null texts stay null, and a text of which
    nothing is left is empty; rows that repeat whole don't count as copies of each other.
    """
    renamed = docs.select(*(F.col(c).alias(f"own_{c}") for c in docs.columns), F.col("text").isNotNull().alias("has_text"))
    kept = suffix_dedup.without_repeats(renamed, key="own_doc_id", text="own_text", length=PASSAGE_BYTES, keep="first", as_text=True, carry=[c for c in renamed.columns if c != "own_text"])
    text = F.when(F.col("has_text"), F.col("kept"))
    changed = {"text": text, "n_chars": F.when(F.size("removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own_n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return kept.select(*(changed.get(c, F.col(f"own_{c}")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth; those without words stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (none of a null or empty one), with what is known of the document."""
    return byte_bpe.encoded(docs, rank_file(), carry=["doc_id", "lang", "source"], outputs=["ids", "n_tokens"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: The first stage's learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{shared}/{k}-{name}")
            docs = spark.read.parquet(f"{shared}/{k}-{name}")
    return docs

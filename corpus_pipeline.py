"""From raw documents to packed training sequences.

Quality rules drop documents, SimHash keeps one document of each group of
near copies, secrets are blanked out, sources are mixed to their targets
(a document may leave or come twice), and what remains is packed.  Each
stage works on all that the one before it kept; its result is written as
Parquet and read again.  Packing has no SQL form, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigila.llm import mixing, quality, secrets, simhash
from vigila.llm.common import table, text_of, written
from vigila.llm.queries import packed


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's cutoffs."""
    return quality.quality_rules(docs).where("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: its smallest doc_id."""
    return simhash.one_of_each(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; n_chars follows the text."""
    found = secrets.find_secrets(docs)
    hit = F.size("spans") > 0
    clean = F.when(hit, secrets.redacted(text_of(F.col("doc.text")), F.col("spans"))).otherwise(F.col("doc.text"))
    out = found.select(F.col("doc").withField("text", clean).alias("doc"), hit.alias("hit"))
    if "n_chars" in docs.columns:
        out = out.withColumn("doc", F.col("doc").withField("n_chars", F.when(
            F.col("hit"), F.length("doc.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))))
    return out.select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mix_sources(docs).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with a checksum of their ids."""
    return packed(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash", drop_near_copies),
    ("secret_scan", blank_secrets),
    ("mix_sources", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

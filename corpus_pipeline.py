"""The corpus pipeline: documents pass quality, near-dedup, decontamination, mixing and sharding, each written as Parquet.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of documents.  Mixing returns a document as often
as the mix takes it, and a document taken in part with the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, table, written
from helixframe.llm.decontaminate import decontaminated
from helixframe.llm.mixing import mix_sources
from helixframe.llm.near_dedup import near_components
from helixframe.llm.quality import classify
from helixframe.llm.sharding import hilbert_shards

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays; of rows that repeat an id and text, one stays."""
    stay = near_components(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("stays")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("print"))
    return packed.join(stay, F.col("own").eqNullSafe(F.col("stays")), "left_semi").dropDuplicates(["own", "print"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    full, part = F.expr("taken div size"), F.expr("taken % size")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), 1)
    cut = F.concat_ws(" ", F.slice(words, F.lit(1), part.cast("int")))
    turn = F.explode(F.sequence(F.lit(1), F.expr("cast(ceil(taken / size) AS int)")))
    taken = mix_sources(docs).where("taken > 0").withColumn("whole", full).withColumn("turn", turn)
    text = F.when(F.col("turn") <= F.col("whole"), F.col("row.text")).otherwise(cut)
    taken = taken.withColumn("cut_text", text)
    own = {"text": F.col("cut_text"), "n_chars": F.when(F.col("turn") <= F.col("whole"), F.col("row.n_chars")).otherwise(F.length("cut_text").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("cut_text")}
    return taken.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, text_crc32, shard and slot along the Hilbert curve; columns of documents that have these names go on as ``<name>_before``."""
    own = ("size", "text_crc32", "shard", "slot")
    kept = [F.col("row")[c].alias(f"{c}_before" if c in own else c) for c in docs.columns]
    return hilbert_shards(docs).select(*kept, *own)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

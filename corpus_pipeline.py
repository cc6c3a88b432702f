"""The corpus pipeline: from documents to packed sequences.

Each stage works on all that its predecessor kept and, but for the last, returns
the columns of documents.  Null texts stay null until they are packed (as empty
texts).  Near copies are decided by row: of each class one row is kept, the first
by doc_id and digest of the text, and so is each row whose text is in no class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, near_dup, packing, substring, toxicity

#: A repeated passage goes if it has so many bytes, or so many words, cut at blanks.
REPEAT_BYTES, REPEAT_WORDS = 256, 51


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with those of its columns renamed that bear a name an operator gives its results, and how to name them back."""
    clash = {f"_own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: n for n, c in clash.items()}), clash


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 or more."""
    model = toxicity.trained_on(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    own, back = _aside(docs, "score")
    return toxicity.score(own, model).where("score < 0.5").drop("score").withColumnsRenamed(back).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies and all rows whose text is in none."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").take(1):
        found = near_dup.near_duplicates(docs.select("doc_id", "text"), by_text=True).where("root IS NOT NULL")
        first = found.groupBy("root").agg(F.min(F.struct("doc_id", F.col("key").alias("_key"))).alias("one")).select("one.*")
        keyed = docs.withColumn("_key", F.sha2("text", 256))
        kept = keyed.join(first, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
        alone = keyed.join(found.select("doc_id", F.col("key").alias("_key")).distinct(), ["doc_id", "_key"], "left_anti")
        return kept.unionByName(alone).select(docs.columns)
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat out of the texts."""
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "_row", "_at", "_none")
    own, back = _aside(docs, *results)
    left = substring.remove_repeats(own.withColumn("_none", F.col("text").isNull()), REPEAT_BYTES, with_text=True, words=REPEAT_WORDS)
    text = F.when(~F.col("_none"), F.col("kept"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("text", text).withColumn("n_chars", size).drop(*results).withColumnsRenamed(back).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    own, back = _aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "_row")
    found = decontaminate.contamination(own, common.table(spark, sf_dir, "benchmark"))
    clean = found.where("NOT contaminated").drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return clean.withColumnsRenamed(back).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written table of the one before."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

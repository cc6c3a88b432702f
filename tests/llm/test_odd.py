"""One odd table for all operators and pipeline stages: nulls, empties, a very long text, ties, repeats, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, lm, maxscore, near_dup, packing, sharding, substring, toxicity

ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "the same text here, twice and once more in full"), (5, "the same text here, twice and once more in full"), (5, "another row of the same id"),
    (6, "w " * 60_000), (7, "x" * 120_000), (None, "a row without an id"), (8, "ünï códé <|endoftext|> \u0000 end"), (9, "one"), (10, "a passage " + "of words that repeat and go on " * 20),
]
EXTRA = {"score": 0.5, "kept": True, "class_id": 7, "digest": "d", "row": 1, "size": 2, "shard": 3, "n_words": 4, "contaminated": False, "held_out": True, "root": 1, "key": "k", "rid": 5, "n": 6, "words": "w", "found": 1, "h": 2, "base": 0, "a": 1, "b": 2}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(v).alias(c) for c, v in EXTRA.items()])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "a passage of words that repeat and go on of words that repeat")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_they_got(spark, odd, folder, name, stage):
    out = stage(spark, odd, folder)
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r.score == 0.5 and r.kept and r["class_id"] == 7 and r.shard == 3 and r.words == "w" and r.key == "k" for r in rows)
    ids = [r.doc_id for r in rows]
    assert {1, 2, 3, 6, 7, 8}.issubset(ids) and None in ids and (9 in ids) == (name != "decontamination")  # 9 is an item of one word
    if name == "near_dedup":
        assert ids.count(4) + ids.count(5) == 2  # of the two equal rows one, and the other row of id 5
    assert stage(spark, odd.where("false"), folder).count() == 0


def test_the_last_stage_packs_them(spark, odd, folder):
    out = corpus_pipeline.STAGES[-1][1](spark, odd, folder)
    assert out.agg(F.count_distinct("doc_id")).first()[0] == 10 and out.where("doc_id IS NULL").count() >= 1


def test_operators_take_them(spark, odd, folder):
    n = len(ROWS)
    assert near_dup.near_duplicates(odd).count() == n
    assert sharding.assign(odd, 5).count() == n
    scored = lm.score(odd.withColumn("trains", F.col("doc_id") % 2 == 0).fillna({"trains": False}), "trains")
    assert scored.count() == n and scored.where("score < 0 AND base_score < 0").count() == n
    model = toxicity.train(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == n
    assert decontaminate.contamination(odd, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == n
    assert packing.pack(odd, 64).agg(F.sum("length")).first()[0] > n
    assert substring.remove_repeats(odd, 400).count() == n
    got = maxscore.search(odd, spark.read.parquet(f"{folder}/benchmark.parquet").withColumn("score", F.lit(1))).collect()
    assert got and all(r.score > 0 and r.doc_id is not None for r in got)

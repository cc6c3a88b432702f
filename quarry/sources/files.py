"""Files as tables, and tables as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest source file and the largest expanded one, in bytes, and the most impl blocks of an expanded one.
MOST_BYTES, MOST_EXPANDED, MOST_BLOCKS = 10 << 20, 2 << 20, 500
CASE = "id string, repo string, pr int, expected_outcome string, weight double, tags array<string>"


def source_files(spark: SparkSession, root: str, pattern: str = "*.rs", most: int = MOST_BYTES) -> DataFrame:
    """path, bytes, content_hash, text of files below root that aren't too large; the size is tested before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.where(F.col("length") <= most)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def within_expansion(files: DataFrame, expanded: str = "expanded", text: str = "text", most: int = MOST_EXPANDED, blocks: int = MOST_BLOCKS, head: str = "impl ") -> DataFrame:
    """files with the text to parse: the expanded one, unless it is missing, over `most` bytes, or holds `head` more than `blocks` times."""
    heads = (F.length(expanded) - F.length(F.replace(expanded, F.lit(head), F.lit("")))) / len(head)
    return files.withColumn(text, F.when((F.octet_length(expanded) <= most) & (heads <= blocks), F.col(expanded)).otherwise(F.col(text)))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def documents(spark: SparkSession, root: str, skip_names: tuple[str, ...] = (), skip_folders: tuple[str, ...] = (), pattern: str = "*.md") -> DataFrame:
    """path (below root), text of Markdown files, without those whose name holds one of skip_names or whose path begins with one of skip_folders."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    below = F.regexp_replace(F.col("_metadata.file_path"), "^(file:)?/*" + re.escape(re.sub("^(file:)?/*", "", root).rstrip("/")) + "/", "")
    rows = files.select(below.alias("path"), F.col("value").alias("text"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    for s in skip_names:
        rows = rows.where(~stem.contains(s))
    for f in skip_folders:
        rows = rows.where(~F.col("path").startswith(f))
    return rows


def suite(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Evaluation cases (as a suite file lists them) as rows; weight is 1 if not given."""
    rows = [(c["id"], c.get("repo"), c.get("pr"), c.get("expected_outcome"), float(c.get("weight", 1.0)), list(c.get("tags") or [])) for c in cases]
    return spark.createDataFrame(rows, CASE)


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    return {"null": None, "~": None, "": None, "true": True, "false": False}.get(text, text)


def suite_cases(text: str) -> list[dict]:
    """The cases of a suite file: the list under `cases:` of flat maps, whose values are scalars, lists in brackets or lists of lines that begin with a dash."""
    cases, indent, key = [], None, None
    lines = [re.sub(r"(^|\s)#.*$", "", x).rstrip() for x in text.split("\n")]
    at = next((i + 1 for i, x in enumerate(lines) if x.strip() == "cases:"), len(lines))
    for line in lines[at:]:
        if not line.strip():
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- ") and (indent is None or depth == indent):
            indent, key = depth, None
            cases.append({})
            body = body[2:].strip()
        elif indent is None or depth <= indent:
            break
        elif body.startswith("- ") and key:
            cases[-1][key] = [*(cases[-1][key] or []), _scalar(body[2:])]
            continue
        name, _, value = body.partition(":")
        key = name.strip()
        cases[-1][key] = _scalar(value)
    return cases


def suite_file(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the suite files at a path, which Spark reads; a suite is small, its text comes to the driver."""
    texts = spark.read.text(path, wholetext=True).collect()
    return suite(spark, [c for t in texts for c in suite_cases(t[0])])


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def as_json(df: DataFrame, most: int = 500) -> DataFrame:
    return df.limit(most).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))

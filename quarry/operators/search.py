"""Search by vector and by keyword, and its enrichment by relational and graph data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip_bytes, cosine_to


def semantic(points: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, where: Column | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest points by cosine; filters come before the top-k, a bounded sort in each partition."""
    rows = points if where is None else points.where(where)
    scored = rows.withColumn("score", cosine_to(embedding, query)).where(F.col("score").isNotNull())
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.drop(embedding).orderBy(F.desc("score"), key).limit(int(k))


def keyword(items: DataFrame, query: str, fields: tuple[str, ...], name: str, fqn: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """Rows whose fields hold the query (% and _ in it are wildcards), names first; score falls by a hundredth a rank."""
    like = f"%{query}%"
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    rows = items.where(hit if where is None else hit & where)
    order = [F.when(F.col(name).ilike(like), 0).otherwise(1), F.when(F.col(fqn).ilike(like), 0).otherwise(1), F.col(name), F.col(fqn)]
    top = rows.withColumn("_a", order[0]).withColumn("_b", order[1]).orderBy("_a", "_b", name, fqn).limit(int(k))
    w = Window.orderBy("_a", "_b", name, fqn)  # over k rows
    return top.withColumn("score", F.round(F.lit(1.0) - F.lit(0.01) * (F.row_number().over(w) - 1), 2)).drop("_a", "_b")


def docs(points: DataFrame, texts: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    top = semantic(points, query, k, threshold, key=key)
    return top.join(texts, key).select(key, "source_file", clip_bytes("text").alias("content_preview"), "score")


def aggregate(points: DataFrame, items: DataFrame, edges: DataFrame | None, query: list[float], k: int = 10, threshold: float | None = None, key: str = "vec_id", source: str | None = None) -> DataFrame:
    """Top-k with columns of items, and sorted neighbour lists from edges(src, dst); one plan instead of lookups for each hit.

    A column that points and items both have is that of the item, where there is
    one.  Without edges no lists are added; items' body_source is left out unless
    `source` names it.
    """
    top = semantic(points, query, k, threshold, key=key)
    items = items.drop("body_source") if source is None else items
    both = [c for c in items.columns if c in top.columns and c != key]
    out = top.withColumnsRenamed({c: f"_{c}" for c in both}).join(items, key, "left")
    out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in both}).drop(*[f"_{c}" for c in both])
    if edges is not None:
        for a, b, name in (("dst", "src", "callers"), ("src", "dst", "callees")):
            near = edges.join(top.select(F.col(key).alias(a)), a, "left_semi").groupBy(F.col(a).alias(key)).agg(F.array_sort(F.collect_set(b)).alias(name))
            out = out.join(near, key, "left").withColumn(name, F.coalesce(name, F.array().cast(near.schema[name].dataType)))
    return out


def complete(hits: DataFrame, needed: tuple[str, ...] = ("fqn", "name", "score")) -> DataFrame:
    """Hits that have all they need; others are dropped."""
    return hits.dropna(subset=list(needed))


def semantic_or_keyword(points: DataFrame, vector, items: DataFrame, query: str, fields: tuple[str, ...], name: str, fqn: str, k: int = 10, threshold: float | None = None) -> DataFrame:
    """semantic(), or keyword() if the query has no vector, as when it could not be embedded."""
    return keyword(items, query, fields, name, fqn, k) if vector is None else semantic(points, vector, k, threshold)


def cache_key(model: str, text) -> Column:
    return F.concat(F.lit(f"{model}:"), F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def cached(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """texts with cache_key and the vector that cache(cache_key, vector) holds for it; null where it must be embedded."""
    return texts.withColumn("cache_key", cache_key(model, text)).join(cache.select("cache_key", "vector").dropDuplicates(["cache_key"]), "cache_key", "left")


def embedded(texts: DataFrame, embed, text: str = "text", batch: int = 32) -> DataFrame:
    """texts with vector, made by embed(list of texts) for `batch` texts at a time; nulls are embedded as empty texts."""
    import pandas as pd

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches):
        for pdf in batches:
            every = pdf[text].fillna("").tolist()
            made = [v for i in range(0, len(every), batch) for v in embed(every[i : i + batch])]
            yield pdf.assign(vector=pd.Series([list(map(float, v)) for v in made], dtype=object, index=pdf.index))

    return texts.mapInPandas(run, kinds + ", vector array<double>")


def collections(points: DataFrame, *by: str, embedding: str = "embedding") -> DataFrame:
    """Points and dimensions of each collection."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.max(F.size(embedding)).alias("dims"))

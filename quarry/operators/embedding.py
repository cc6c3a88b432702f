"""From items to points of a vector store: their texts and the chunks of their documentation, embedded in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks, itemtext
from ..functions.scalar import uuid5
from . import search

#: Texts that a model takes at once.
BATCH = 32


def item_points(items: DataFrame, embed, batch: int = BATCH) -> DataFrame:
    """id, vector and payload of each item; the id comes from its name, so embedding again overwrites."""
    rows = items.withColumn("text", itemtext.item_text()).select(uuid5("fqn").alias("id"), "text", itemtext.payload(F.col("text")).alias("payload"))
    return search.embedded(rows, embed, "text", batch).select("id", "vector", "payload")


def doc_points(items: DataFrame, embed, batch: int = BATCH) -> DataFrame:
    """id, vector, source_fqn, source_item_type, chunk_index and text of each chunk of documentation."""
    rows = chunks.exploded(items.select("fqn", F.trim("doc_comment").alias("doc_comment")), "fqn", "doc_comment", chunks.text_chunks)
    rows = rows.join(items.select("fqn", "item_type"), "fqn")
    key = F.concat("fqn", F.lit(":doc:"), F.col("chunk_index").cast("string"))
    rows = rows.select(uuid5(key).alias("id"), F.col("fqn").alias("source_fqn"), F.col("item_type").alias("source_item_type"), "chunk_index", F.col("chunk").alias("text"))
    return search.embedded(rows, embed, "text", batch)

"""Items that two finders saw in the same files, joined by where they stand.

Ranges of lines overlap if one of them begins inside the other.  So each range is put
into the one or two bins of its own size class that it touches, and looked for from the
starts of the others, which lie in one bin of each class: a file's ranges are never
held against each other pairwise, and long ones cost no more than short ones.  Classes
are powers of BASE lines: ranges of up to BASE lines share one, so a start is sent once
where all ranges are short, and is held against those of its BASE lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 64


def _class(start: Column, end: Column) -> Column:
    """The size class of a range: the least positive power of BASE that isn't under its lines."""
    lines = end.cast("long") - start + 1
    power = F.greatest(F.ceil(F.log(float(BASE), F.greatest(lines, F.lit(1)))).cast("int"), F.lit(1))
    return power + F.when(lines > F.pow(F.lit(float(BASE)), power), 1).otherwise(0)  # a logarithm may fall short by rounding


def _binned(ranges: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ranges(..., s, e) and points(..., p) with `size` and `bin`: a range in each bin of its class that it touches, two at most, a point in its bin of each class."""
    ranges = ranges.withColumn("size", _class(F.col("s"), F.col("e")))
    classes = ranges.select("size").distinct()  # a row for each power
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(BASE)), F.col("size"))).cast("long")
    return ranges.withColumn("bin", F.explode(F.sequence(at("s"), at("e")))), points.join(F.broadcast(classes)).withColumn("bin", at("p"))


def _holding(ranges: DataFrame, points: DataFrame, own: bool, *by: str) -> DataFrame:
    """Rows of points(by, ..., p) with those of ranges(by, ..., s, e) that hold them; where a range begins at the point only with `own`."""
    bins, spots = _binned(ranges, points)
    hits = spots.join(bins.hint("merge"), [*by, "size", "bin"])
    return hits.where((F.col("p") <= F.col("e")) & ((F.col("p") >= F.col("s")) if own else (F.col("p") > F.col("s"))))


def _spans(items: DataFrame, file: str, start: str, end: str, **more: str) -> DataFrame:
    """file, s, e and further columns by their new names, of the items whose ranges hold a line."""
    return items.select(F.col(file).alias("file"), F.col(start).alias("s"), F.col(end).alias("e"), *[F.col(c).alias(n) for n, c in more.items()]).where("e >= s")


def _begins(spans: DataFrame) -> DataFrame:
    """Spans as points where they begin, their ends as `q`."""
    return spans.withColumnsRenamed({"s": "p", "e": "q"})


def overlaps(first: DataFrame, second: DataFrame, file: str = "file_path", start: str = "start_line", end: str = "end_line", one: str = "id", two: str = "id", with_file: bool = False) -> DataFrame:
    """(i, j): ids of rows of first and second whose ranges of lines in one file share a line, behind `file` if asked for. Ranges that end before they begin hold nothing."""
    a, b = _spans(first, file, start, end, i=one), _spans(second, file, start, end, j=two)
    cols = ["file", "i", "j"] if with_file else ["i", "j"]
    # Of two ranges that begin at one line the second one's start is looked for, so that no pair is found twice.
    return _holding(a, _begins(b), True, "file").select(*cols).union(_holding(b, _begins(a), False, "file").select(*cols))


def _met(items: DataFrame, others: DataFrame) -> DataFrame:
    """key of each of items(file, s, e, key) that shares a line with one of others(file, s, e): no pairs are made."""
    own, starts = _binned(items, _begins(others).select("file", "p"))
    by = lambda x, y, held: (x["file"] == y["file"]) & (x["size"] == y["size"]) & (x["bin"] == y["bin"]) & held
    hold = own.join(starts.hint("merge"), by(own, starts, starts["p"].between(own["s"], own["e"])), "left_semi").select("key")
    bins, spots = _binned(others, _begins(items).select("file", "p", "key"))
    lie = spots.join(bins.hint("merge"), by(spots, bins, spots["p"].between(bins["s"], bins["e"])), "left_semi").select("key")
    return hold.union(lie)


def merged(preferred: DataFrame, other: DataFrame, file: str = "file_path", start: str = "start_line", end: str = "end_line", key: str = "id") -> DataFrame:
    """Items of two finders as one set: all of the preferred one, and those of the other whose lines it has nothing in.

    An item of the preferred finder takes properties it lacks (null, or an empty
    text or list) from the other's item of its name that shares most of its lines, the first by key of
    equals.  `partial` tells that only the other finder saw an item.
    """
    rest = [c for c in preferred.columns if c in other.columns and c not in (file, start, end, key, "name")]
    a = _spans(preferred, file, start, end, i=key, name="name")
    b = _spans(other.withColumn("_rest", F.struct(F.lit(0), *rest)), file, start, end, j=key, name="name", o="_rest")
    # Only items of one name can fill each other, so names are keys of the search.
    shared = lambda s, e, p, q: (F.least(e, q) - F.greatest(s, p)).alias("shared")
    by = [F.col(c) for c in ("s", "e", "p", "q")]
    pairs = [_holding(x, _begins(y), own, "file", "name").select("i", "j", "o", shared(*by)) for x, y, own in ((a, b, True), (b, a, False))]
    best = pairs[0].union(pairs[1]).groupBy("i").agg(F.max_by("o", F.struct("shared", F.negative("j"))).alias("_o"))
    own = preferred.join(best, F.col(key) == F.col("i"), "left")

    def filled(c):
        kind = preferred.schema[c].dataType.typeName()
        lacks = F.col(c) == "" if kind == "string" else F.size(c) == 0 if kind == "array" else F.lit(False)
        return F.coalesce(F.when(F.coalesce(~lacks, F.lit(False)), F.col(c)), F.col(f"_o.{c}"), F.col(c)).alias(c)

    own = own.select(*[filled(c) if c in rest else F.col(c) for c in preferred.columns], F.lit(False).alias("partial"))
    alone = other.join(_met(_spans(other, file, start, end, key=key), a).withColumnRenamed("key", key), key, "left_anti").withColumn("partial", F.lit(True))
    return own.unionByName(alone.select([c for c in own.columns if c in alone.columns]), allowMissingColumns=True)

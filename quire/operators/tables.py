"""Grids, occupancies and their projections and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = r"^-?[0-9]+([.][0-9]+)?$"


def frequency_model(cells: DataFrame, key: str, pattern: str) -> DataFrame:
    """AG-23: (key, value, frequency): of tables with a header in row 0 that matches and only numbers below it, the first
    column's values with that column's numbers."""
    heads = cells.where((F.col("r") == 0) & F.lower("text").rlike(pattern)).select(key, "c")
    numbers = cells.where("r > 0").join(heads, [key, "c"], "left_semi")
    ok = numbers.groupBy(key, "c").agg(F.bool_and(F.col("text").rlike(NUMERIC)).alias("ok")).where("ok")
    data = numbers.join(ok, [key, "c"], "left_semi").select(key, "r", F.col("text").cast("double").alias("frequency"))
    return data.join(cells.where("c = 0").select(key, "r", F.col("text").alias("value")), [key, "r"]).select(key, "value", "frequency")


def projections(cells: DataFrame, key: str) -> DataFrame:
    """AG-28: (key, view, a, b, height, n) of occupied cells(key, x, y, z): from above with the height, from the front and
    the side, and one row of all, by GROUPING SETS."""
    found = cells.sparkSession.sql(
        f"""SELECT {key}, grouping_id() AS g, x, y, z, max(z) + 1 AS height, count(*) AS n FROM {{cells}} GROUP BY GROUPING SETS (({key}, x, y), ({key}, x, z), ({key}, y, z), ({key}))""", cells=cells
    )
    top, front, side = F.col("z").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("y").isNull() & F.col("z").isNotNull(), F.col("x").isNull() & F.col("z").isNotNull()
    view = F.when(top, "top").when(front, "front").when(side, "side").otherwise("all")
    a, b = F.when(side, F.col("y")).otherwise(F.col("x")), F.when(top, F.col("y")).otherwise(F.col("z"))
    return found.select(key, view.alias("view"), F.coalesce(a, F.lit(-1)).alias("a"), F.coalesce(b, F.lit(-1)).alias("b"), "height", "n")


def table_issues(cells: DataFrame, key: str, header_rows: int) -> DataFrame:
    """AG-37: (key, issue): rows of unequal length, more header rows than rows, numeric text other than the stored value."""
    width = cells.groupBy(key, "r").agg(F.count("*").alias("_w")).groupBy(key).agg(F.count_distinct("_w").alias("widths"), F.count("*").alias("rows"))
    ragged = width.where("widths > 1").select(key, F.lit("ragged").alias("issue"))
    headers = width.where(F.col("rows") <= header_rows).select(key, F.lit("headers").alias("issue"))
    off = cells.where(F.col("text").try_cast("double") != F.col("value")).select(key).distinct().select(key, F.lit("value").alias("issue"))
    return ragged.unionByName(headers).unionByName(off)


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """SO-01: (key, added, removed, class) of rows, repeats counted."""
    gone = before.exceptAll(after).groupBy(key).agg(F.count("*").alias("removed"))
    new = after.exceptAll(before).groupBy(key).agg(F.count("*").alias("added"))
    keys = before.select(key).union(after.select(key)).distinct()
    both = keys.join(new, key, "left").join(gone, key, "left").fillna(0, ["added", "removed"])
    kind = F.when((F.col("added") == 0) & (F.col("removed") == 0), "UNCHANGED").when(F.col("removed") == 0, "ADDED").when(F.col("added") == 0, "REMOVED").otherwise("MIXED_DELTA")
    return both.select(key, "added", "removed", kind.alias("class"))


def view_impact(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """SO-02: (key, view, changed) of the three projections: whether any of their cells differs."""
    a, b = projections(before, key).drop("n"), projections(after, key).drop("n")
    changed = a.exceptAll(b).unionAll(b.exceptAll(a)).select(key, "view").distinct().withColumn("changed", F.lit(True))
    views = a.select(key, "view").union(b.select(key, "view")).distinct().where("view <> 'all'")
    return views.join(changed, [key, "view"], "left").fillna(False, ["changed"])


def inventory_diff(source: DataFrame, spec: DataFrame, key: str) -> DataFrame:
    """SO-06: (key, label, side): labels of one side only; primes are ignored on the spec's."""
    plain = lambda rows: rows.select(key, F.col("label").alias("label")).distinct()
    bare = spec.select(key, F.regexp_replace("label", "'+$", "").alias("label")).distinct()
    return plain(source).join(bare, [key, "label"], "left_anti").withColumn("side", F.lit("source")).unionByName(bare.join(plain(source), [key, "label"], "left_anti").withColumn("side", F.lit("spec")))

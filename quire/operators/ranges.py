"""Range, interval and as-of joins as equi-joins on buckets, so that they never become nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def near_join(a: DataFrame, b: DataFrame, keys: list[str], at_a: Column, at_b: Column, tolerance: float) -> DataFrame:
    """Pairs of equal keys whose positions differ by the tolerance at most. a is dealt to the cell of its position and b
    to that and both neighbours, so each pair meets once. Other columns of a and b must have names of their own."""
    cell = lambda at: F.floor(at / tolerance)
    left = a.withColumn("_at", at_a).withColumn("_cell", cell(at_a))
    right = b.withColumn("_to", at_b).withColumn("_cell", F.explode(F.sequence(cell(at_b) - 1, cell(at_b) + 1)))
    return left.join(right, [*keys, "_cell"]).where(F.abs(F.col("_at") - F.col("_to")) <= tolerance).drop("_at", "_to", "_cell")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], span_a: tuple[str, str], span_b: tuple[str, str], cell: int) -> DataFrame:
    """Pairs of equal keys whose half-open spans overlap. Both sides are dealt to all cells that they touch; a pair is kept
    in the cell where its overlap begins. Choose the cell about as long as a usual span."""

    def dealt(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(span[0]) / cell), F.floor(F.col(span[1]) / cell))))

    begin = F.greatest(span_a[0], span_b[0])
    pairs = dealt(a, span_a).join(dealt(b, span_b), [*keys, "_cell"])
    return pairs.where((begin < F.least(span_a[1], span_b[1])) & (F.floor(begin / cell) == F.col("_cell"))).drop("_cell")


def as_of(items: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """items plus `value`, that of the last mark of its key at or before it; null before the first. One sort of both."""
    both = items.withColumns({"_at": F.col(at), "_item": F.lit(1), value: F.lit(None)}).unionByName(
        marks.select(key, F.col(mark_at).alias("_at"), F.lit(0).alias("_item"), value), allowMissingColumns=True
    )
    last = Window.partitionBy(key).orderBy("_at", "_item", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(last)).where("_item = 1").drop("_at", "_item")

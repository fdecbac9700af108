"""Page documents in JSON: the fixed schema, flattening, and page selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<type:string,value:string,bold:boolean,underline:boolean>"
PAGE = (
    "page_id bigint, page_type string, blocks array<struct<kind:string,label:string,level:int,"
    f"lines:array<array<{SEGMENT}>>,paragraphs:array<array<array<{SEGMENT}>>>,rows:array<array<array<{SEGMENT}>>>>>"
)


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Page JSON by the fixed schema; nothing is inferred."""
    return spark.read.schema(PAGE).option("multiLine", multi_line).json(path)


def segments(pages: DataFrame, *carried: str) -> DataFrame:
    """SRC-01: (carried..., page_id, page_type, block, par, line, seg, type, value, bold, underline), one row a segment: the lines
    of a block (par -1), of its figure's paragraphs, and of its table's rows, whose cells are lines. Carried columns of the
    page go with each of its rows."""
    of_page = [*carried, "page_id", "page_type"]
    blocks = pages.select(*of_page, F.posexplode("blocks").alias("block", "b"))
    lines = blocks.select(*of_page, "block", F.lit(-1).alias("par"), F.posexplode("b.lines").alias("line", "l"))
    nested = [
        blocks.select(*of_page, "block", F.posexplode(f"b.{name}").alias("par", "p")).select(*of_page, "block", "par", F.posexplode("p").alias("line", "l"))
        for name in ("paragraphs", "rows")
    ]
    every = reduce(DataFrame.unionByName, nested, lines)
    return every.select(*of_page, "block", "par", "line", F.posexplode("l").alias("seg", "s")).select(*of_page, "block", "par", "line", "seg", "s.*")


def select_ranges(df: DataFrame, column: str, spec: str) -> DataFrame:
    """SRC-02: the rows whose number is in a list such as "4-7,10". The list is joined as ranges, not as numbers, so it is as
    short as its text."""
    ends = [part.strip().partition("-") for part in spec.split(",") if part.strip()]
    try:
        ranges = [(int(a), int(b) if dash else int(a)) for a, dash, b in ends]
    except ValueError:
        raise ValueError(f"not a list of page ranges: {spec!r}") from None
    if not ranges:
        raise ValueError("no page ranges")
    return df.where(reduce(lambda x, y: x | y, [F.col(column).between(a, b) for a, b in ranges]))


def include_types(df: DataFrame, column: str, types: list[str], all_pages: bool = False, extra: tuple[str, ...] = ("cover", "instructions", "blank")) -> DataFrame:
    """SRC-03: rows of the types, and with all_pages of three more. The filter reaches the scan."""
    return df.where(F.col(column).isin(*types, *(extra if all_pages else ())))

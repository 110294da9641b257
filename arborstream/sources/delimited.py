"""Delimited text in and out: cells are echoed and results appended, as the command line tools need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "NA"


def read(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, key: int | None = None) -> DataFrame:
    """Columns line (the order), cells (array of strings), v (array of doubles; NA and empty cells are null) and stream.

    stream is the trimmed text of cell number `key` (from 0), which v leaves
    out; without a key it is empty.

    The first line sets the number of cells; a line with another number fails
    the read.
    """
    text = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("line"))
    rows = text.where(F.length(F.trim("value")) > 0)
    first = rows.orderBy("line").limit(1).first()
    if first is None:
        return spark.createDataFrame([], "line long, cells array<string>, v array<double>, stream string")
    width = len(first["value"].split(delimiter))
    if key is not None and not 0 <= key < width:
        raise ValueError(f"no cell {key} in lines of {width}")
    if header:
        rows = rows.where(F.col("line") != first["line"])
    cells = F.split("value", "\\Q" + delimiter + "\\E")
    checked = F.when(F.size(cells) == width, cells).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} cells: "), F.col("value"))))
    split = rows.select("line", checked.alias("cells"))
    values = F.col("cells") if key is None else F.filter("cells", lambda _, i: i != key)
    number = F.transform(values, lambda c: F.when(F.trim(c).isin(MISSING, ""), None).otherwise(F.trim(c).cast("double")))
    return split.withColumn("v", number).withColumn("stream", F.lit("") if key is None else F.trim(F.get("cells", F.lit(key))))


def lines(df: DataFrame, results: list[Column], delimiter: str = ",", order: str = "line") -> DataFrame:
    """Text lines: the input cells, then the results, nulls as NA."""
    shown = [F.coalesce(r.cast("string"), F.lit(MISSING)) for r in results]
    return df.select(F.col(order), F.concat_ws(delimiter, "cells", *shown).alias("value"))


def write(text: DataFrame, path: str, order: str = "line") -> None:
    """Sorted part files of lines."""
    text.sort(order).select("value").write.mode("overwrite").text(path)

"""Elements of JSON arrays that are larger than a task.

A file is read in stretches that end at some character, in parallel. Whether a
stretch begins within a string, and how deep in brackets, is composed over
splits as for delimited text. Where a stretch ends at depth one and outside
strings, an element has ended, so what stands between two such places is parsed
on its own, as an array of one element or several. Any character that no number
or word has gives the same elements; a closing brace gives few stretches where
the elements are objects, a comma cuts arrays of anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.sources.records import in_split, lines, past_splits, states

_INSIDE = r'(?:[^"\\]++|\\.)*+'


def _opens(text: Column) -> Column:
    """Whether text, which begins outside strings, ends within one."""
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(F.contains(text, F.lit("\\")), text.rlike(rf'(?s)\A(?:[^"]++|"{_INSIDE}")*+"{_INSIDE}\z')).otherwise(odd)


def _brackets(text: Column) -> Column:
    """The brackets and braces of text outside its strings."""
    return F.regexp_replace(text, rf'(?s)"{_INSIDE}(?:"|\z)|[^"\[\]{{}}]++', "")


def _least(brackets: Column) -> Column:
    """The least depth that a closing bracket leads to, from depth zero on."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(1 << 30).alias("least"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(c.isin("]", "}"), F.least(a["least"], depth)).otherwise(a["least"]).alias("least"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda a: a["least"])


def element_groups(spark: SparkSession, path: str, end: str) -> DataFrame:
    """_f, _g, rows: file, a number that grows in it, and elements in their order; rows is null where no array can be read.

    What follows the array is ignored; a blank file has no elements. Commas
    between elements may be repeated or stand at the end.
    """
    found = lines(spark, path, "UTF-8", end).select("_f", "_s", "_m", F.concat("value", F.lit(end)).alias("value"))
    found = states(found.withColumns({"out": _opens(F.col("value")), "in": _opens(F.concat(F.lit('"'), F.col("value")))}))
    marks = _brackets(F.when(F.col("within"), F.concat(F.lit('"'), F.col("value"))).otherwise(F.col("value")))
    found = found.select("_f", "_s", "_m", "value", F.when(F.col("within"), F.col("in")).otherwise(F.col("out")).alias("open"), marks.alias("marks"))
    found = found.withColumn("delta", 2 * F.length(F.translate("marks", "]}", "")) - F.length("marks")).withColumn("rel", F.sum("delta").over(in_split()))

    depths = found.groupBy("_f", "_s").agg(F.sum("delta").alias("delta"))
    depths = depths.select("_f", "_s", F.coalesce(F.sum("delta").over(past_splits()), F.lit(0)).alias("deep"))
    found = found.join(depths, ["_f", "_s"]).withColumn("after", F.col("deep") + F.col("rel"))
    found = found.select(
        "_f", "_s", "_m", "value", (~F.col("open") & (F.col("after") == 1)).cast("long").alias("ended"),
        (F.col("after") - F.col("delta") + _least(F.col("marks")) <= 0).alias("last"),
    )

    # where the array ends, and how many groups have ended before a split
    place = F.struct("_s", "_m")
    ends = found.groupBy("_f", "_s").agg(F.sum("ended").alias("n"), F.min(F.when(F.col("last"), place)).alias("stop"))
    file = Window.partitionBy("_f")
    ends = ends.select("_f", "_s", F.coalesce(F.sum("n").over(past_splits()), F.lit(0)).alias("past"), F.min("stop").over(file).alias("stop"))
    found = found.join(ends, ["_f", "_s"]).withColumn("_g", F.col("past") + F.sum("ended").over(in_split()) - F.col("ended"))
    found = found.filter(F.col("stop").isNull() | (place <= F.col("stop")))

    parts = F.array_sort(F.collect_list(F.struct("_s", "_m", "value")))
    groups = found.groupBy("_f", "_g").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("text"), F.bool_or(F.col("stop").isNull()).alias("endless"))
    text, first = F.col("text"), F.col("_g") == 0
    blank = first & text.rlike(rf"\A\s*+\Q{end}\E\z")
    body = F.regexp_replace(F.when(first, F.regexp_replace(text, r"\A\s*+\[", "")).otherwise(text), r"\A[\s,]++|\s*+,\s*+\z", "")
    rows = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    none = F.array().cast("array<string>")
    bad = F.col("endless") | (first & ~text.rlike(r"\A\s*+\["))
    return groups.select("_f", "_g", F.when(blank, none).when(~bad, rows).alias("rows"))

"""Columns with clashing names, long texts, nulls, repeats and empty tables, for every operator that reads documents."""

import pytest
from pyspark.sql import functions as F

from rowlens.llm import exact_dedup, html_text, jaccard_join, mixing, packing, quality, repeats, secret_scan, syncmers, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string"
#: Names that operators use within, and names that differ in case only.
CLASHES = ["DOC_ID", "Text", "SOURCE", "digest", "row", "key", "n_points", "part", "tie", "slot", "class", "copies", "_c0", "_text", "own", "stays", "group", "label"]
LONG = "a long text goes on and on with many words " * 20_000
ROWS = [(1, "some text here", "a"), (2, None, None), (None, "some text here", "a"), (1, "some text here", "a"), (3, "", "b"), (4, LONG, "a"), (5, "x", None)]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (4, 0, 0, "z"), (5, None, 0, "z"), (None, 1, 0, "z")], "doc_id long, quality int, toxic int, QUALITY string")


OPERATORS = {
    "op1": lambda d: exact_dedup.groups(d),
    "op2": lambda d: packing.pack(d, BYTE),
    "op3": lambda d: repeats.remove(d),
    "op4": lambda d: mixing.mix(d),
    "op5": lambda d: wavelet.round_trip(d, WORD, keeps_spaces=False),
    "op6": lambda d: syncmers.neighbours(d),
    "op7": lambda d: jaccard_join.groups(d),
    "op8": lambda d: quality.score(d, labels(d.sparkSession)),
    "op9": lambda d: secret_scan.find(d),
    "op10": lambda d: html_text.main_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "text").withColumnRenamed("text", "html")),
}
KEEPERS = {
    "exact": lambda d: exact_dedup.dedup(d),
    "near": lambda d: jaccard_join.dedup(d),
    "mix": lambda d: mixing.mix(d, keep=True),
    "quality": lambda d: quality.keep(d, labels(d.sparkSession)),
}


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def collected(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "op10"])
def test_further_columns_change_nothing(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = collected(OPERATORS[name](docs))
    assert len(plain) >= len(ROWS) and collected(OPERATORS[name](clashing(docs))) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", KEEPERS)
def test_stages_keep_all_columns(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain, more = KEEPERS[name](docs), KEEPERS[name](clashing(docs))
    assert plain.columns == docs.columns and more.columns == docs.columns + CLASHES
    first = more.toDF(*[f"x{i}" for i in range(len(more.columns))]).select("x0", "x1", "x2").toDF(*docs.columns)
    assert collected(first) == collected(plain)
    assert KEEPERS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_pages_with_further_columns(spark):
    rows = [(1, "u", "<p>text</p>"), (None, None, None), (1, "u", "<p>text</p>"), (2, "v", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = collected(html_text.main_text(pages))
    assert len(plain) == 4
    assert collected(html_text.main_text(pages.select("*", F.lit("<p>no</p>").alias("HTML"), F.lit(7).alias("Page_ID"), F.lit("no").alias("text")))) == plain

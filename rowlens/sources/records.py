"""Records of text files: lines made into records, their ordinals, and an index that is kept.

A file is read by lines, in parallel. A rule says which records a line holds:
for NDJSON the line unless it is blank, for delimited text what stands between
the line's carriage returns outside quotes. Whether a line ends within quotes
follows from the state that it begins in; for each line both answers are known
from its own text, so states are found by composing these answers over the
lines of a split, and over splits, without one task that sees a whole file.
Files in which no record goes on over a line's end need none of that. Line ends
at the end of a file belong to no record, even if its last quote is never closed.

The index has a row for every ANCHOR lines: how many records, ragged ones and
bytes, and from that the ordinal and the byte offset at which they begin. It
is kept as Parquet, under a key of the files' sizes and modification times, the
rule, and what decides Spark's splits; any difference is a miss. With it, an
open counts nothing and a window of the source reads only the bytes it needs.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.functions.text import stable_hash
from rowlens.model import RID

#: Lines per row of the index.
ANCHOR = 1 << 16
#: Splits up to which their table, some 100 bytes a row, is broadcast; records per bucket where they are numbered anew.
MOST_SPLITS, BUCKET = 100_000, 100_000
#: Bytes that the driver reads for a window; beyond, the cluster does.
MOST_LOCAL = 64 << 20
MARK = "﻿"


def code(c: str) -> str:
    """A character in a regular expression."""
    return f"\\x{{{ord(c):x}}}"


@dataclass(frozen=True)
class Rule:
    """How lines become records. delimiter and quote: of delimited text; without them a line that isn't blank is a record."""

    delimiter: str | None = None
    quote: str = '"'
    width: int = 0

    def _field(self, end: str) -> str:
        """One field; end: what may stand at the end of a quoted one in place of its closing quote."""
        q, stop = code(self.quote), f"{code(self.delimiter)}\\r"
        return f"(?:{q}(?:[^{q}]++|{q}{q})*+(?:{q}[^{stop}]*+{end})|[^{stop}{q}][^{stop}]*+|)"

    def opens(self, text: Column) -> Column:
        """Whether text, which begins outside quotes, ends within them."""
        if self.delimiter is None:
            return F.lit(False)
        q = code(self.quote)
        return F.contains(text, F.lit(self.quote)) & text.rlike(f"\\A(?:{self._field('')}[{code(self.delimiter)}\\r])*+{q}(?:[^{q}]++|{q}{q})*+\\z")

    def records(self, text: Column) -> Column:
        """The records of text as an array."""
        if self.delimiter is None:
            return F.when(text.rlike(r"\A[\x00-\x20]*\z"), F.array().cast("array<string>")).otherwise(F.array(text))
        field = self._field("|\\z")
        every = F.filter(F.regexp_extract_all(text, F.lit(f"{field}(?:{code(self.delimiter)}{field})*+"), F.lit(0)), lambda x: x != "")
        plain = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
        return F.when(F.contains(text, F.lit("\r")), every).otherwise(plain)

    def fields(self, record: Column) -> Column:
        """The raw fields of a record, each with the delimiter before it."""
        return F.regexp_extract_all(F.concat(F.lit(self.delimiter), record), F.lit(code(self.delimiter) + self._field("|\\z")), F.lit(0))

    def ragged(self, record: Column) -> Column:
        """Whether a record's width isn't the schema's."""
        if self.delimiter is None:
            return F.lit(False)
        plain = F.length(record) - F.length(F.replace(record, F.lit(self.delimiter), F.lit(""))) + 1
        return F.when(F.contains(record, F.lit(self.quote)), F.size(self.fields(record))).otherwise(plain) != self.width


def lines(spark: SparkSession, path: str, encoding: str, end: str = "\n") -> DataFrame:
    """_f, _s, _m, _bytes, value: file, its split's start, a number that grows within a split, the line's bytes, and the line without a mark."""
    if encoding.startswith("UTF-16"):  # a line's end is two bytes, so a file is one split
        whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_f"), F.decode("content", encoding).alias("value"))
        split = F.posexplode(F.split("value", "\n", -1))
        found = whole.select("_f", F.monotonically_increasing_id().alias("file"), split.alias("i", "value"))
        found = found.select("_f", F.lit(0).cast("long").alias("_s"), (F.shiftleft("file", 31) + F.col("i")).alias("_m"), "value")
    else:
        value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
        found = spark.read.option("lineSep", end).text(path)
        found = found.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"), value.alias("value"))
    found = found.withColumn("_bytes", F.octet_length("value").cast("long") + 1)
    value = F.when((F.col("_s") == 0) & F.startswith("value", F.lit(MARK)), F.ltrim("value", F.lit(MARK))).otherwise(F.col("value"))
    return found.withColumn("value", value)


def _ended(text: Column) -> Column:
    """A line whose end is \\r\\n without that \\r."""
    return F.when(F.endswith(text, F.lit("\r")), F.rtrim(text, F.lit("\r"))).otherwise(text)


# The kept index


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and modification time of a source's files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    found = fs.listStatus(where) if fs.getFileStatus(where).isDirectory() else [fs.getFileStatus(where)]
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._")


def _split_bytes(spark: SparkSession, files: list[tuple[str, int, int]]) -> list[int]:
    """What Spark cuts files by: its limits, and the tasks that it aims at."""
    number = lambda key: int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    most, cost = number("spark.sql.files.maxPartitionBytes"), number("spark.sql.files.openCostInBytes")
    tasks = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    return [min(most, max(cost, sum(n + cost for _, n, _ in files) // int(tasks))), cost]


def index_folder(spark: SparkSession) -> str:
    """spark.rowlens.index.dir, else a folder beside the checkpoints, else (in local sessions only) one for temporary files."""
    own = spark.conf.get("spark.rowlens.index.dir", None)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if own or shared:
        return own or f"{shared.rstrip('/')}/rowlens-index"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.rowlens.index.dir or spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/rowlens-index"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def index_bytes(spark: SparkSession) -> int:
    where, fs = _fs(spark, index_folder(spark))
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def clear_index(spark: SparkSession) -> None:
    where, fs = _fs(spark, index_folder(spark))
    fs.delete(where, True)


def _count(spark: SparkSession, path: str, encoding: str, rule: Rule) -> DataFrame:
    """The index's rows: _f, _s, _m, n_lines, n_records, n_ragged, n_bytes, opens, record, offset, least."""
    found = lines(spark, path, encoding)
    rows = F.col("rows")
    ragged = F.when(F.size(rows) == 1, rule.ragged(rows[0]).cast("int")).otherwise(F.aggregate(rows, F.lit(0), lambda n, x: n + rule.ragged(x).cast("int"))) if rule.delimiter else F.lit(0)
    found = found.select(
        "_f", "_s", "_m", F.shiftright("_m", 33).alias("part"), rule.opens(F.col("value")).alias("opens"), "_bytes",
        rule.records(_ended(F.col("value"))).alias("rows"),
    )
    anchor = F.shiftright(F.col("_m").bitwiseAND((1 << 33) - 1), ANCHOR.bit_length() - 1)
    table = found.groupBy("_f", "_s", "part", anchor.alias("anchor")).agg(
        F.min("_m").alias("_m"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("rows")).alias("n_records"), F.sum(ragged).cast("long").alias("n_ragged"),
        F.sum("_bytes").alias("n_bytes"), F.bool_or("opens").alias("opens"),
    )
    earlier = lambda column, order: F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_order = Window.orderBy("_f", "_s", "_m")  # one row per ANCHOR lines
    return table.select(
        "_f", "_s", "_m", "n_lines", "n_records", "n_ragged", "n_bytes", "opens", earlier("n_records", in_order).alias("record"),
        earlier("n_bytes", Window.partitionBy("_f").orderBy("_s", "_m")).alias("offset"),
        (F.shiftleft("part", 33) + earlier("n_records", Window.partitionBy("part").orderBy("_m"))).alias("least"),
    )


def kept(spark: SparkSession, path: str, how: list, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives of a source, from where it is kept if neither the source nor how it is read has changed since."""
    files = _files(spark, path)
    key = json.dumps([spark.version, files, _split_bytes(spark, files), *how])
    source = f"{stable_hash(path):016x}"
    name = f"{source}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    folder = index_folder(spark)
    place, fs = _fs(spark, f"{folder}/{name}")
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        return spark.read.parquet(place.toString())
    made, _ = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    try:
        make().write.parquet(made.toString())
    except Exception:
        fs.delete(made, True)
        raise
    for old in fs.listStatus(made.getParent()):
        if old.getPath().getName().startswith(f"{source}-"):  # of the same source as it was, or read otherwise
            fs.delete(old.getPath(), True)
    if not fs.rename(made, place):
        return spark.read.parquet(made.toString())
    return spark.read.parquet(place.toString())


def index(spark: SparkSession, path: str, encoding: str, rule: Rule) -> DataFrame:
    """The index of a source."""
    return kept(spark, path, [ANCHOR, encoding, rule.delimiter, rule.quote, rule.width], lambda: _count(spark, path, encoding, rule))


# Records with their ordinals


def states(found: DataFrame) -> DataFrame:
    """found (_f, _s, _m, out, in) with within: whether each line begins within quotes.

    out and in say how a line ends that begins outside quotes, or within them.
    """
    fixed = F.col("out") == F.col("in")
    found = found.withColumn("swap", (F.col("out") & ~F.col("in")).cast("int"))
    split = Window.partitionBy("_f", "_s").orderBy("_m")
    until, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("swaps", F.sum("swap").over(until))
    last = F.max(F.when(fixed, F.struct("_m", "out", "swaps")))
    found = found.withColumns({"last": last.over(before), "earlier": F.coalesce(F.max("swaps").over(before), F.lit(0))})
    # what a split does to the state that it begins with
    ends = found.groupBy("_f", "_s").agg(last.alias("last"), F.sum("swap").alias("swaps"))
    ends = ends.select("_f", "_s", F.col("last.out").alias("sets"), (F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))).alias("turns"))
    splits = Window.partitionBy("_f").orderBy("_s")
    ends = ends.withColumn("total", F.sum("turns").over(splits.rowsBetween(Window.unboundedPreceding, 0)))
    past = splits.rowsBetween(Window.unboundedPreceding, -1)
    set_last = F.max(F.when(F.col("sets").isNotNull(), F.struct("_s", "sets", (F.col("total") - F.col("turns")).alias("total"))))
    ends = ends.withColumns({"set_last": set_last.over(past), "so_far": F.coalesce(F.max("total").over(past), F.lit(0))})
    odd = lambda n: n % 2 == 1
    begin = F.coalesce(F.col("set_last.sets"), F.lit(False)) != odd(F.col("so_far") - F.coalesce(F.col("set_last.total"), F.lit(0)))
    found = found.join(ends.select("_f", "_s", begin.alias("begin")), ["_f", "_s"])
    within = F.coalesce(F.col("last.out"), F.col("begin")) != odd(F.col("earlier") - F.coalesce(F.col("last.swaps"), F.lit(0)))
    return found.withColumn("within", within).drop("swap", "swaps", "last", "earlier", "begin")


def in_split() -> Window:
    return Window.partitionBy("_f", "_s").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)


def past_splits() -> Window:
    """Of a row per split, those before it in its file."""
    return Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)


def _joined(found: DataFrame, rule: Rule) -> DataFrame:
    """_f, _g, value: the lines of each record put together; _g numbers them in their file."""
    opens, closed = rule.opens(F.col("value")), rule.opens(F.concat(F.lit(rule.quote), F.col("value")))
    found = states(found.withColumns({"out": opens, "in": closed}))
    found = found.select("_f", "_s", "_m", "value", (~F.col("within")).cast("long").alias("starts"))
    starts = found.groupBy("_f", "_s").agg(F.sum("starts").alias("n"))
    starts = starts.select("_f", "_s", F.coalesce(F.sum("n").over(past_splits()), F.lit(0)).alias("past"))
    found = found.join(starts, ["_f", "_s"]).withColumn("_g", F.col("past") + F.sum("starts").over(in_split()) - 1)
    parts = F.array_sort(F.collect_list(F.struct("_s", "_m", "value")))
    return found.groupBy("_f", "_g").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))


def numbered_anew(rows: DataFrame) -> DataFrame:
    """rows (_f, _g, rows) as _f, _n, value: one row per record, numbered over all files in their order."""
    rows = rows.withColumns({"_b": F.floor(F.col("_g") / BUCKET), "size": F.size("rows")})
    sums = rows.groupBy("_f", "_b").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per BUCKET lines
    within = F.coalesce(F.sum("size").over(Window.partitionBy("_f", "_b").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("within", within).join(sums.select("_f", "_b", before.alias("before")), ["_f", "_b"])
    return rows.select("_f", (F.col("before") + F.col("within")).alias("at"), F.posexplode("rows").alias("i", "value")).select("_f", (F.col("at") + F.col("i")).alias("_n"), "value")


def _headless(rows: DataFrame, firsts: DataFrame, header: bool) -> DataFrame:
    """rows (_f, _n, value) as RID, value; firsts: _f and the number of its first record. With a header, each file's first record is none."""
    if not header:
        return rows.select(F.col("_n").alias(RID), "value")
    places = firsts.select("_f", "first", F.row_number().over(Window.orderBy("_f")).alias("files"))  # a row per file
    rows = rows.join(F.broadcast(places) if places.count() <= MOST_SPLITS else places, "_f").filter(F.col("_n") != F.col("first"))
    return rows.select((F.col("_n") - F.col("files")).cast("long").alias(RID), "value")


@dataclass(frozen=True)
class Records:
    """RID and value of every record; the other members serve counts and windows without reading all."""

    data: DataFrame
    #: Known from the index, else None.
    n_records: int | None
    n_ragged: int | None
    #: RID, value of the records from one ordinal to another, or None where they are too many, or the file can't be cut by lines.
    window: Callable[[int, int], DataFrame | None]


def read_records(spark: SparkSession, path: str, encoding: str, rule: Rule, header: bool = False) -> Records:
    """The records of a text source."""
    if encoding.startswith("UTF-16"):
        rows = _joined(lines(spark, path, encoding), rule) if rule.delimiter else lines(spark, path, encoding).select("_f", F.col("_m").alias("_g"), "value")
        return _unindexed(rows, rule, header)
    table = index(spark, path, encoding, rule)
    seen = table.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_records").alias("n"), F.sum("n_ragged").alias("ragged"), F.bool_or("opens").alias("opens")).first()
    if seen["opens"]:
        return _unindexed(_joined(lines(spark, path, encoding), rule), rule, header)
    splits = table.groupBy("_f", "_s").agg(F.min("record").alias("record"), F.min("least").alias("least"), F.sum("n_records").alias("n"))
    found = lines(spark, path, encoding).select("_f", "_s", F.explode(rule.records(_ended(F.col("value")))).alias("value"))
    found = found.withColumn("_m", F.monotonically_increasing_id())
    found = found.join(F.broadcast(splits) if seen["rows"] <= MOST_SPLITS else splits, ["_f", "_s"], "left")
    place = F.col("_m") - F.col("least")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("record") + place).otherwise(F.raise_error(F.lit(f"{path} was cut differently when it was indexed")).cast("long"))
    rows = found.select("_f", number.alias("_n"), "value")
    firsts = table.filter("n_records > 0").groupBy("_f").agg(F.min("record").alias("first"))
    files = firsts.count() if header else 0
    data = _headless(rows, firsts, header)

    def window(start: int, end: int) -> DataFrame | None:
        if files > 1 or encoding != "UTF-8":
            return None  # ordinals and numbers differ from file to file
        a, b = start + files, end + files
        rows = table.filter((F.col("record") < b) & (F.col("record") + F.col("n_records") > a)).orderBy("record").select("_f", "offset", "n_bytes", "record")
        some = rows.limit(MOST_LOCAL // ANCHOR + 1).collect()
        if len({r["_f"] for r in some}) > 1 or sum(r["n_bytes"] for r in some) > MOST_LOCAL:
            return None
        return _sliced(spark, some, rule, a, b, files)

    return Records(data, (seen["n"] or 0) - files, seen["ragged"] or 0, window)


def _sliced(spark: SparkSession, anchors: list, rule: Rule, start: int, end: int, files: int) -> DataFrame:
    """RID, value of the records numbered from start to end, out of the lines of these rows of the index, which follow each other."""
    schema = f"{RID} long, value string"
    if not anchors:
        return spark.createDataFrame([], schema)
    where, fs = _fs(spark, anchors[0]["_f"])
    io = spark.sparkContext._jvm.org.apache.commons.io

    def read(offset: int, size: int) -> bytes:
        stream = fs.open(where)
        try:
            stream.seek(offset)
            return bytes(io.IOUtils.toByteArray(io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()

    mark = len(MARK.encode()) if read(0, 3) == MARK.encode() else 0  # which Spark's lines don't have
    raw = read(anchors[0]["offset"] + mark, sum(r["n_bytes"] for r in anchors))
    text = raw.decode("utf-8", "replace").removesuffix("\n").split("\n")
    found = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i long, value string").coalesce(1)
    found = found.select(F.posexplode(rule.records(_ended(F.col("value")))).alias("k", "value"), "i")
    number = F.row_number().over(Window.orderBy("i", "k")) - 1 + anchors[0]["record"]  # the lines of a window
    return found.select((number - files).cast("long").alias(RID), "value").filter((F.col(RID) >= start - files) & (F.col(RID) < end - files))


def _unindexed(rows: DataFrame, rule: Rule, header: bool) -> Records:
    """Records (_f, _g, value) whose lines had to be put together."""
    made = numbered_anew(rows.select("_f", "_g", rule.records(_ended(F.col("value"))).alias("rows")))
    data = _headless(made, made.groupBy("_f").agg(F.min("_n").alias("first")), header)
    return Records(data, None, None, lambda start, end: None)

"""Helpers that the corpus operators share: code shipping, the shared scratch folder, lineage cuts, columns by name."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)

_SHIPPED: set[str] = set()
_OWN_SCRATCH: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers then import the operators by name, whatever PYTHONPATH they
    were started with, and keep their caches between tasks. What a worker gets
    at once is bounded in bytes, as rows can be long.
    """
    if spark.conf.get(_BATCH_CONF).rstrip("b") == _BATCH_DEFAULT:  # else the session has its own bound
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # this code runs from a zip already: it has been shipped
        return
    out = Path(tempfile.mkdtemp(prefix="rowlens-")) / "rowlens_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(os.path.realpath(out))
    _SHIPPED.add(app)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local session gets a folder of its own, which goes
    with the process; on a cluster, that would be many folders, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _OWN_SCRATCH:
            own = tempfile.mkdtemp(prefix="rowlens-scratch-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN_SCRATCH[sc.applicationId] = "file://" + own
        base = _OWN_SCRATCH[sc.applicationId]
    return f"{base.rstrip('/')}/rowlens-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Ends the lineage (a lost executor costs a reread, not a recomputation) and
    fixes what partitioning-dependent expressions such as row ids returned.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote. Whatever read them must have been written by now."""
    for t in tables:
        spark = t.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._rowlens_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aliased(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """docs with its columns called _c0, _c1, ..., and a function that finds one of them by its name.

    A name that is equal goes before one that differs in case, and an earlier
    column before later ones of the same name, so no further column gets in the
    way, whatever it is called.
    """
    names = docs.columns

    def column(name: str) -> Column:
        found = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name}, only {', '.join(names)}")
        return F.col(f"_c{found[0]}")

    return docs.toDF(*[f"_c{i}" for i in range(len(names))]), column


def fields(docs: DataFrame, *names: str) -> DataFrame:
    """Just these columns, as ``aliased`` finds them."""
    rows, column = aliased(docs)
    return rows.select(*[column(n).alias(n) for n in names])


def plain(text: Column) -> Column:
    """A text column, null counting as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_of(docs: DataFrame) -> Column:
    """The text column, null counting as empty; of what ``fields`` returned."""
    return plain(docs["text"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retain(docs: DataFrame, by: Callable[[Callable[[str], Column]], dict[str, Column]], marks: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    by: gives, from a function that finds columns, names and expressions that
    identify a document. marks: those names, stays, and copies, the number of
    rows; rows without a mark stay. Of several rows with one identity that
    stays, one does, chosen by a partial aggregate rather than a window.
    """
    rows, column = aliased(docs)
    own = rows.columns
    names = by(column)
    rows = rows.select(*own, *[e.alias(f"_by_{n}") for n, e in names.items()])
    same = None
    for n in names:
        one = F.col(f"_by_{n}").eqNullSafe(F.col(n))
        same = one if same is None else same & one
    once = rows.join(marks.filter("not stays or copies > 1"), same, "left_anti")
    again = rows.join(marks.filter("stays and copies > 1"), same, "left_semi").dropDuplicates([f"_by_{n}" for n in names])
    return once.unionByName(again).select(*own).toDF(*docs.columns)


_holder: tuple[str, Callable[[], None]] | None = None


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Called by what keeps a large table in a worker: the table of any other owner goes.

    Workers outlive stages, and so would the tables of all operators that have
    run in them.
    """
    global _holder
    if _holder is not None and _holder[0] != owner:
        _holder[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries can give memory back
            ctypes.CDLL(None).malloc_trim(0)
    _holder = owner, clear


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to so many bytes of a text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        i = 0
        while i < len(batch):
            j = max(i + 1, int(sizes.searchsorted((sizes[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j

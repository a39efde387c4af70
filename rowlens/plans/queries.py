"""The registered queries: each operator over a table of the driver's, and the same in SQL.

Positions are returned as a column, since results are compared without order.
Source ordinals are the leading ids of these tables, which the SQL uses.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.model import RID, Dialect, Direction, FilterSpec, RowRange, SortKey, ViewSpec
from rowlens.operators.export import ExportKind, Scope, csv_lines, export, json_lines, text_table
from rowlens.operators.view import TableView, column_stats, open_view
from rowlens.sources import readers
from rowlens.sources.readers import infer_types, json_field, json_key_union

#: Columns of the driver's tables, in order.
COLUMNS = {
    "nation": "n_nationkey n_name n_regionkey".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
    "supplier": "s_suppkey s_name s_nationkey s_acctbal".split(),
    "events": "event_id ts user_id event_type value props".split(),
}


def view(spark, sf_dir: str, table: str) -> TableView:
    return open_view(spark, f"{sf_dir}/{table}.parquet")


def named(df: DataFrame, v: TableView, columns: list[int] | None = None) -> DataFrame:
    """v0..vN under the source's names, without the ordinal."""
    ids = range(len(v.source.schema)) if columns is None else columns
    names = {f"v{i}": v.source.schema.columns[c].name for i, c in enumerate(ids)}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns if c != RID])


def _at(table: str, *names: str) -> list[int]:
    return [COLUMNS[table].index(n) for n in names]


def _filtered(table: str, query: str, **flags):
    def run(spark, sf_dir):
        v = view(spark, sf_dir, table).filtered(query, **flags)
        return named(v.project(), v)

    return run


def _sorted(table: str, column: str, direction: Direction, shown: list[str]):
    def run(spark, sf_dir):
        v = view(spark, sf_dir, table).sorted(SortKey(_at(table, column)[0], direction))
        return named(v.numbered(ids := _at(table, *shown)), v, ids)

    return run


def _text(table: str, *names: str) -> str:
    return ", ".join(f"cast({n} AS varchar) AS {n}" for n in (names or COLUMNS[table]))


def _any(table: str, test: str) -> str:
    return "(" + " OR ".join(test.format(f"cast({n} AS varchar)") for n in COLUMNS[table]) + ")"


def _sorted_sql(table: str, column: str, direction: str, shown: list[str]) -> str:
    by = column if column in ("o_totalprice", "o_custkey", "p_size", "c_acctbal") else f"cast({column} AS varchar)"
    return f"SELECT {_text(table, *shown)}, row_number() OVER (ORDER BY {by} {direction}, {COLUMNS[table][0]}) - 1 AS view_pos FROM {table}"


_Q: dict = {}
_SQL: dict[str, str] = {}


def _register(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql:
        _SQL[name] = sql


# Scans, projections, windows, counts


def scan_rows(spark, sf_dir):
    v = view(spark, sf_dir, "nation")
    return named(v.project(), v)


def project_reorder(spark, sf_dir):
    v = view(spark, sf_dir, "part")
    ids = _at("part", "p_brand", "p_partkey", "p_name")
    return named(v.project(ids), v, ids)


def window_identity(spark, sf_dir):
    v = view(spark, sf_dir, "orders")
    return named(v.window(RowRange(100, 50)), v)


def window_past_end(spark, sf_dir):
    v = view(spark, sf_dir, "nation")
    return named(v.window(RowRange(20, 50)), v)


def row_count(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").rows().agg(F.count(F.lit(1)).alias("n_rows"))


_register("scan_rows", scan_rows, f"SELECT {_text('nation')} FROM nation")
_register("project_reorder", project_reorder, f"SELECT {_text('part', 'p_brand', 'p_partkey', 'p_name')} FROM part")
_register("window_identity", window_identity, f"SELECT {_text('orders')} FROM orders WHERE o_orderkey BETWEEN 100 AND 149")
_register("window_past_end", window_past_end, f"SELECT {_text('nation')} FROM nation WHERE n_nationkey >= 20")
_register("row_count", row_count, "SELECT count(*) AS n_rows FROM lineitem")

# Filters

for _name, _table, _query, _flags, _test in (
    ("filter_literal_ci", "customer", "build", {}, "contains(lower({}), 'build')"),
    ("filter_literal_cs", "customer", "BUILD", {"case_sensitive": True}, "contains({}, 'BUILD')"),
    ("filter_literal_special", "part", "#1", {}, "contains({}, '#1')"),
    ("filter_regex", "orders", "^1996-0[1-3]", {"regex": True, "case_sensitive": True}, "regexp_matches({}, '^1996-0[1-3]')"),
    ("filter_regex_ci", "events", "(CLICK|error)", {"regex": True}, "regexp_matches({}, '(?i)(CLICK|error)')"),
    ("filter_regex_end", "events", r"\d7$", {"regex": True}, r"regexp_matches({}, '\d7$')"),
    ("filter_numeric_text", "part", r"^9[0-9]{2}\.0", {"regex": True}, r"regexp_matches({}, '^9[0-9]{{2}}\.0')"),
    ("filter_invert", "orders", "HIGH", {"invert": True, "case_sensitive": True}, "contains({}, 'HIGH')"),
):
    _where = _any(_table, _test)
    _register(_name, _filtered(_table, _query, **_flags), f"SELECT {_text(_table)} FROM {_table} WHERE {'NOT ' if _flags.get('invert') else ''}{_where}")

# Sorts

for _name, _table, _column, _down, _shown in (
    ("sort_numeric_asc", "orders", "o_totalprice", False, ["o_orderkey", "o_totalprice"]),
    ("sort_numeric_desc", "orders", "o_totalprice", True, ["o_orderkey", "o_totalprice"]),
    ("sort_text_asc", "customer", "c_mktsegment", False, ["c_custkey", "c_mktsegment"]),
    ("sort_text_desc", "customer", "c_mktsegment", True, ["c_custkey", "c_mktsegment"]),
    ("sort_int_exact", "orders", "o_custkey", False, ["o_orderkey", "o_custkey"]),
    ("sort_int_desc_ties", "part", "p_size", True, ["p_partkey", "p_size"]),
    ("sort_timestamp_text", "orders", "o_orderdate", False, ["o_orderkey", "o_orderdate"]),
):
    _register(_name, _sorted(_table, _column, Direction.DESCENDING if _down else Direction.ASCENDING, _shown), _sorted_sql(_table, _column, "DESC" if _down else "ASC", _shown))


def filter_sort_window(spark, sf_dir):
    v = view(spark, sf_dir, "orders")
    v = v.with_spec(ViewSpec(FilterSpec("URGENT"), SortKey(3, Direction.DESCENDING)))
    return named(v.window(RowRange(20, 20)), v)


def deep_window(spark, sf_dir):
    """Rows far down a sorted view, which are fetched by ordinal."""
    v = view(spark, sf_dir, "lineitem").sorted(SortKey(5))
    found = v.placed(RowRange(v.count() * 5 // 6, 100), [5])
    return found.select(F.col("v0").alias("l_extendedprice"), "view_pos")


def topk(spark, sf_dir):
    v = view(spark, sf_dir, "orders").sorted(SortKey(3, Direction.DESCENDING))
    return named(v.window(RowRange(0, 10)), v)


_register(
    "filter_sort_window",
    filter_sort_window,
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders
        WHERE {_any("orders", "contains(lower({}), 'urgent')")})
        SELECT {_text("orders")} FROM f WHERE pos BETWEEN 20 AND 39""",
)
_register(
    "deep_window",
    deep_window,
    """WITH s AS (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS view_pos, count(*) OVER () AS n FROM lineitem)
       SELECT cast(l_extendedprice AS varchar) AS l_extendedprice, view_pos FROM s WHERE view_pos >= n * 5 // 6 AND view_pos < n * 5 // 6 + 100""",
)
_register("topk", topk, f"SELECT {_text('orders')} FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")

# Matches


def _find(forward: bool):
    def run(spark, sf_dir):
        v = view(spark, sf_dir, "events").sorted(SortKey(4, Direction.DESCENDING))
        return spark.createDataFrame([(v.find(FilterSpec("purchase"), [3, 5], 500, forward),)], "position long")

    return run


_HITS = """WITH s AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos FROM events)
    SELECT {} AS position FROM s WHERE contains(lower(event_type), 'purchase') OR contains(lower(props), 'purchase')"""
_register("find_next", _find(True), _HITS.format("min(CASE WHEN pos >= 500 THEN pos END)"))
_register("find_prev", _find(False), _HITS.format("max(CASE WHEN pos <= 500 THEN pos END)"))


def highlight_cells(spark, sf_dir):
    found = view(spark, sf_dir, "customer").highlights(FilterSpec("9"))
    return found.select(F.col(RID).alias("row"), *[F.col(f"m{i}").alias(f"{n}_hit") for i, n in enumerate(COLUMNS["customer"])])


_register(
    "highlight_cells",
    highlight_cells,
    "SELECT c_custkey AS row, " + ", ".join(f"contains(cast({n} AS varchar), '9') AS {n}_hit" for n in COLUMNS["customer"]) + " FROM customer",
)

# Text forms and exports


def copy_tsv(spark, sf_dir):
    return view(spark, sf_dir, "part").lines().select("line")


def export_text_view(spark, sf_dir):
    v = view(spark, sf_dir, "customer").filtered("AUTO")
    return text_table(v, _at("customer", "c_name", "c_mktsegment", "c_custkey"))


def export_csv_lines(spark, sf_dir):
    v = view(spark, sf_dir, "events")
    return csv_lines(v, list(range(6)), ",", COLUMNS["events"])


def export_ndjson_lines(spark, sf_dir):
    return json_lines(view(spark, sf_dir, "nation"), [0, 1])


_register("copy_tsv", copy_tsv, f"SELECT concat_ws(chr(9), {', '.join(f'cast({n} AS varchar)' for n in COLUMNS['part'])}) AS line FROM part")
_register(
    "export_text_view",
    export_text_view,
    f"SELECT {_text('customer', 'c_name', 'c_mktsegment', 'c_custkey')} FROM customer WHERE {_any('customer', chr(123) + chr(125) + ' ILIKE ' + chr(39) + '%auto%' + chr(39))}",
)
_QUOTED = """CASE WHEN contains({0}, ',') OR contains({0}, '"') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""
_register(
    "export_csv_lines",
    export_csv_lines,
    f"SELECT concat_ws(',', {', '.join(_QUOTED.format(f'cast({n} AS varchar)') for n in COLUMNS['events'])}) AS line FROM events UNION ALL SELECT '{','.join(COLUMNS['events'])}'",
)
_register("export_ndjson_lines", export_ndjson_lines, """SELECT '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '"}' AS line FROM nation""")


def _scratch(spark) -> str:
    """A new folder that all executors see: beside the session's checkpoints, or, in a local session, a temporary one."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowlens-")
    return f"{base.rstrip('/')}/export-{uuid.uuid4().hex}"


def _round_trip(table: str, kind: ExportKind, suffix: str, read):
    def run(spark, sf_dir):
        path = f"{_scratch(spark)}/out{suffix}"
        export(view(spark, sf_dir, table), path, kind, Scope.SOURCE, single_file=kind is not ExportKind.PARQUET)
        back = TableView(read(spark, path))
        return named(back.project(), back)

    return run


_register("delimited_roundtrip", _round_trip("customer", ExportKind.CSV, ".csv", readers.open_source), f"SELECT {_text('customer')} FROM customer")
_register("tsv_roundtrip", _round_trip("supplier", ExportKind.TSV, ".tsv", readers.open_source), f"SELECT {_text('supplier')} FROM supplier")
_register("ndjson_roundtrip", _round_trip("part", ExportKind.NDJSON, ".ndjson", readers.open_source), f"SELECT {_text('part')} FROM part")
_register("parquet_roundtrip", _round_trip("supplier", ExportKind.PARQUET, ".parquet", readers.read_parquet), f"SELECT {_text('supplier')} FROM supplier")


def ragged_count(spark, sf_dir):
    """Nations as delimited text, one field short where the region is 1 and one too many where it is 2."""
    v = view(spark, sf_dir, "nation")
    rows = v.ordered()
    cells = F.when(F.col("v2") == "1", F.concat_ws("|", "v0", "v1")).when(F.col("v2") == "2", F.concat_ws("|", "v0", "v1", "v2", F.lit("x"))).otherwise(F.concat_ws("|", "v0", "v1", "v2"))
    path = f"{_scratch(spark)}/ragged"
    rows.orderBy(RID).select(cells).coalesce(1).write.text(path)
    read = readers.read_delimited(spark, path, Dialect("|", '"', False))
    return read.data.agg(F.count(F.when(read.ragged(), 1)).alias("ragged_rows"))


_register(
    "ragged_count",
    ragged_count,
    """WITH n AS (SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS width FROM nation)
       SELECT count(*) FILTER (WHERE width <> (SELECT width FROM n ORDER BY n_nationkey LIMIT 1)) AS ragged_rows FROM n""",
)

# Text files of all shapes, written from a table and read back


def _file(spark, table: DataFrame, line, name: str, encoding: str = "UTF-8") -> str:
    """A text file of one line per row, in the order of RID."""
    path = f"{_scratch(spark)}/{name}"
    one = table.orderBy(RID).select(line.alias("line")).coalesce(1)
    if encoding == "UTF-8":
        one.write.text(path)
    else:
        one.write.options(encoding=encoding, quote="", sep="\x01", emptyValue="").csv(path)
    return path


def _nation_lines(spark, sf_dir):
    """Nations by line: cells in quotes with a line end in them, blank-looking records, records of other widths."""
    rows = view(spark, sf_dir, "nation").ordered()
    region = F.col("v2")
    name = F.concat(F.lit('"'), F.col("v1"), F.lit('\n""x"""'))
    line = (
        F.when(region == "0", F.concat_ws("|", "v0", name, "v2")).when(region == "1", F.concat_ws("|", "v0", "v1")).when(region == "2", F.concat_ws("|", "v0", "v1", "v2", F.lit("surplus")))
        .when(region == "3", F.lit(" | | ")).otherwise(F.concat_ws("|", "v0", "v1", "v2"))
    )
    return _file(spark, rows, line, "nations.txt")


def records_over_lines(spark, sf_dir):
    v = TableView(readers.read_delimited(spark, _nation_lines(spark, sf_dir), Dialect("|", '"', False)))
    return v.project().select(F.col(RID).alias("row"), F.col("v0").alias("key"), F.col("v1").alias("name"), F.col("v2").alias("region"))


def ragged_scope(spark, sf_dir):
    """A filter also looks at fields beyond the schema."""
    v = TableView(readers.read_delimited(spark, _nation_lines(spark, sf_dir), Dialect("|", '"', False)))
    return v.filtered("SURPLUS").project().select(F.col(RID).alias("row"), F.col("v1").alias("name"))


def lines_quality(spark, sf_dir):
    """Records, ragged ones and those that look blank, counted from the index of a large file's kind: one record per line."""
    rows = view(spark, sf_dir, "customer").ordered()
    key = F.col("v0").cast("long")
    line = F.when(key % 7 == 0, F.lit(",")).when(key % 7 == 1, F.lit("")).when(key % 7 == 2, F.col("v0")).when(key % 7 == 3, F.lit(" ")).otherwise(F.concat_ws(",", "v0", "v4"))
    v = TableView(readers.read_delimited(spark, _file(spark, rows.filter(key >= 4), line, "customers.csv"), Dialect(",", '"', False)))
    blank = v.project().filter("trim(v0) = '' and trim(v1) = ''").count()
    return spark.createDataFrame([(v.count(), v.data_quality().ragged_rows, blank)], "n_records long, n_ragged long, n_blank long")


def utf16_roundtrip(spark, sf_dir):
    path = _file(spark, view(spark, sf_dir, "nation").ordered(), F.concat_ws(";", "v0", "v1", F.lit("é漢")), "nations.csv", "UTF-16")
    v = TableView(readers.read_delimited(spark, path, Dialect(";", '"', False)))
    return v.project().select(F.col("v0").alias("key"), F.col("v1").alias("name"), F.col("v2").alias("mark"))


def json_array(spark, sf_dir):
    rows = view(spark, sf_dir, "part").ordered()
    one = rows.select(RID, F.to_json(F.struct(F.col("v0").cast("long").alias("key"), F.col("v1").alias("name"))).alias("v"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(RID, "v"))), lambda x: x["v"])
    whole = one.agg(F.concat(F.lit("[ "), F.array_join(parts, " ,\n"), F.lit(" ]")).alias("line"), F.lit(0).alias(RID))
    v = TableView(readers.open_source(spark, _file(spark, whole, F.col("line"), "parts.json")))
    return v.project().select(F.col(RID).alias("row"), F.col("v0").alias("key"), F.col("v1").alias("name"))


def _events_json(spark, sf_dir):
    """Events as NDJSON: whole values, nested ones, numbers, and lines that are no single value."""
    rows = view(spark, sf_dir, "events").filtered("purchase").ordered()
    key = F.col("v0").cast("long")
    whole = F.to_json(F.struct(key.alias("id"), F.struct(F.col("v2").cast("long").alias("user")).alias("who"), (F.col("v4").cast("double") > 50).alias("high")))
    line = F.when(key % 5 == 0, F.concat(whole, F.lit(" x"))).when(key % 5 == 1, F.lit("  ")).otherwise(whole)
    return _file(spark, rows, line, "events.ndjson")


def json_strict(spark, sf_dir):
    """Nested values as compact JSON; a record that something follows has empty cells; blank lines are none."""
    v = TableView(readers.open_source(spark, _events_json(spark, sf_dir)))
    return v.project().select(F.col("v0").alias("id"), F.col("v1").alias("who"), F.col("v2").alias("high"))


def json_scope(spark, sf_dir):
    """A filter over rendered JSON cells."""
    v = TableView(readers.open_source(spark, _events_json(spark, sf_dir)))
    return v.filtered('"user":1', case_sensitive=True).project([0]).select(F.col("v0").alias("id"))


def json_types(spark, sf_dir):
    v = TableView(readers.open_source(spark, _events_json(spark, sf_dir)))
    return spark.createDataFrame([(c.id, c.name, c.inferred.value) for c in v.source.schema.columns], "id int, name string, inferred string")


def sort_mixed(spark, sf_dir):
    """Empty cells, numbers of all kinds and words in one column of text."""
    rows = view(spark, sf_dir, "customer").ordered()
    key = F.col("v0").cast("long")
    cell = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, (key * 7 % 100).cast("string")).when(key % 4 == 2, F.concat((key % 90).cast("string"), F.lit(".50"))).otherwise(F.col("v4"))
    v = TableView(readers.read_delimited(spark, _file(spark, rows, F.concat_ws(",", "v0", cell), "mixed.csv"), Dialect(",", '"', False))).sorted(SortKey(1))
    return v.numbered([0, 1]).select(F.col("v0").alias("key"), F.col("v1").alias("cell"), "view_pos")


_LINES = """n AS (SELECT n_nationkey, n_regionkey, n_name, n_nationkey AS row FROM nation)"""
_register(
    "records_over_lines",
    records_over_lines,
    f"""WITH {_LINES} SELECT row,
        CASE n_regionkey WHEN 3 THEN ' ' ELSE cast(n_nationkey AS varchar) END AS key,
        CASE n_regionkey WHEN 0 THEN n_name || chr(10) || '"x"' WHEN 3 THEN ' ' ELSE n_name END AS name,
        CASE n_regionkey WHEN 1 THEN '' WHEN 3 THEN ' ' ELSE cast(n_regionkey AS varchar) END AS region FROM n""",
)
_register("ragged_scope", ragged_scope, f"WITH {_LINES} SELECT row, n_name AS name FROM n WHERE n_regionkey = 2")
_register(
    "lines_quality",
    lines_quality,
    """WITH c AS (SELECT c_custkey % 7 AS k, CASE c_custkey % 7 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS width, c_custkey FROM customer WHERE c_custkey >= 4 AND c_custkey % 7 <> 1)
       SELECT count(*) AS n_records, count(*) FILTER (WHERE width <> (SELECT width FROM c ORDER BY c_custkey LIMIT 1)) AS n_ragged, count(*) FILTER (WHERE k IN (0, 3)) AS n_blank FROM c""",
)
_register("utf16_roundtrip", utf16_roundtrip, "SELECT cast(n_nationkey AS varchar) AS key, n_name AS name, 'é漢' AS mark FROM nation")
_register("json_array", json_array, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, cast(p_partkey AS varchar) AS key, p_name AS name FROM part")
_EVENTS = "SELECT event_id, user_id, value FROM events WHERE contains(lower(event_type), 'purchase') OR contains(lower(props), 'purchase')"
_STRICT = f"""SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE cast(event_id AS varchar) END AS id,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '{{"user":' || user_id || '}}' END AS who,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN value > 50 THEN 'true' ELSE 'false' END AS high FROM ({_EVENTS}) WHERE event_id % 5 <> 1"""
_register("json_strict", json_strict, _STRICT)
_register("json_scope", json_scope, f"SELECT id FROM ({_STRICT}) WHERE contains(who, '\"user\":1')")
_register("json_types", json_types, "SELECT * FROM (VALUES (0, 'id', 'integer'), (1, 'who', 'text'), (2, 'high', 'boolean')) t(id, name, inferred)")
_register(
    "sort_mixed",
    sort_mixed,
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN cast(c_custkey * 7 % 100 AS varchar) WHEN 2 THEN (c_custkey % 90) || '.50' ELSE c_mktsegment END AS cell FROM customer)
       SELECT cast(c_custkey AS varchar) AS key, cell,
              row_number() OVER (ORDER BY cell <> '', try_cast(cell AS double) IS NULL, try_cast(cell AS double), cell, c_custkey) - 1 AS view_pos FROM c""",
)

# Rendering and inference


def json_fields(spark, sf_dir):
    v = view(spark, sf_dir, "events")
    return v.source.data.select(F.col("c0").alias("event_id"), json_field(F.col("c5"), "k").alias("k"))


def json_keys(spark, sf_dir):
    v = view(spark, sf_dir, "events")
    return json_key_union(v.source.data, F.col("c5"))


def column_types(spark, sf_dir):
    v = view(spark, sf_dir, "orders")
    return infer_types(v.source.data, v.source.cells())


def stats(spark, sf_dir):
    return column_stats(view(spark, sf_dir, "nation"))


def fetch_source(spark, sf_dir):
    """Source rows of a table whose view is sorted and filtered."""
    v = view(spark, sf_dir, "customer").filtered("BUILDING").sorted(SortKey(3))
    return named(v.cleared().window(RowRange(10, 5)), v)


_register("json_fields", json_fields, "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
_register(
    "json_key_union",
    json_keys,
    """WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, generate_subscripts(json_keys(props), 1) AS p FROM events WHERE event_id < 200),
       f AS (SELECT key, min(event_id * 1000 + p) AS first FROM k GROUP BY key)
       SELECT key, row_number() OVER (ORDER BY first) - 1 AS position FROM f""",
)
_TYPE = """SELECT {1} AS id, CASE WHEN bool_and(regexp_full_match(trim({0}), '[+-]?[0-9]+') AND try_cast({0} AS bigint) IS NOT NULL) THEN 'integer'
    WHEN bool_and(regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'float'
    WHEN bool_and(lower(trim({0})) IN ('true', 'false')) THEN 'boolean' ELSE 'text' END AS inferred FROM (SELECT * FROM orders WHERE o_orderkey < 200)"""
_register("infer_types", column_types, " UNION ALL ".join(_TYPE.format(f"cast({n} AS varchar)", i) for i, n in enumerate(COLUMNS["orders"])))
_STAT = "SELECT {1} AS id, {2} AS least, {3} AS greatest, count(DISTINCT {0}) AS n_distinct, 0 AS n_empty FROM nation"
_register(
    "column_stats",
    stats,
    " UNION ALL ".join(_STAT.format(n, i, f"cast(min({n}) AS varchar)", f"cast(max({n}) AS varchar)") for i, n in enumerate(COLUMNS["nation"])),
)
_register("fetch_source", fetch_source, f"SELECT {_text('customer')} FROM customer WHERE c_custkey BETWEEN 10 AND 14")


def flagship(spark, sf_dir):
    """A filter over all fields, a numeric sort with stable ties, and a window of the view."""
    v = view(spark, sf_dir, "orders").with_spec(ViewSpec(FilterSpec("urgent"), SortKey(3, Direction.DESCENDING)))
    return named(v.window(RowRange(0, 100)), v)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

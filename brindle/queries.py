"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import registry
from .operators import maintenance, relational
from .operators.filters import Filter
from .operators.rollup import rollup
from .plans.rql import rql
from .schema import AggSpec, ColumnSpec, Metric, TableSpec
from .sources import csvio, storage
from .streaming import realtime
from .streaming.ingest import IngestSpec, csv_messages, ingest_json, normalise

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- the query dialect: (name, table, text, SQL where it isn't the same text)
def _rql(spark, sf_dir, *, on, text, precedence="flat"):
    return rql(text, table(spark, sf_dir, on), precedence=precedence)


RQL = [
    ("scan_star", "region", "SELECT * FROM region", None),
    ("project_alias", "orders", "SELECT o_orderkey AS k, o_totalprice AS 'price' FROM orders", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders"),
    ("auto_alias", "nation", "SELECT n_name, n_nationkey + 1 FROM nation", 'SELECT n_name, n_nationkey + 1::BIGINT AS _c1 FROM nation'),
    ("arith_mix", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) AS v, l_linenumber - 3 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS v, l_linenumber - 3::BIGINT AS d FROM lineitem"),
    ("arith_flat_precedence", "nation", "SELECT n_nationkey, 1 + n_nationkey * 2 AS v FROM nation", "SELECT n_nationkey, (1 + n_nationkey) * 2::BIGINT AS v FROM nation"),
    ("bitwise_ops", "nation", "SELECT n_nationkey & 5 AS a, n_nationkey | 8 AS o, n_nationkey ^ 3 AS x FROM nation", "SELECT n_nationkey & 5::BIGINT AS a, n_nationkey | 8::BIGINT AS o, xor(n_nationkey::BIGINT, 3::BIGINT) AS x FROM nation"),
    ("remainder", "orders", "SELECT o_orderkey, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m FROM orders"),
    ("divide_double", "lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber / 4 AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE / 4::DOUBLE AS q FROM lineitem"),
    ("cast_types", "orders", "SELECT o_orderkey, CAST(o_totalprice, int) AS i, CAST(o_orderkey, string) AS s, CONVERT(o_custkey, double) AS d FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::INT AS i, o_orderkey::VARCHAR AS s, o_custkey::DOUBLE AS d FROM orders"),
    ("if_expr", "lineitem", "SELECT l_orderkey, l_linenumber, IF((l_quantity > 25.0), 1, 0) AS big FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1::BIGINT ELSE 0::BIGINT END AS big FROM lineitem"),
    ("one_expr", "nation", "SELECT ONE(n_nationkey) AS i, ONE(n_name) AS s FROM nation", "SELECT 1::INT AS i, '1' AS s FROM nation"),
    ("filter_eq", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    ("filter_ne", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'", None),
    ("filter_cmp", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45.0 AND l_discount < 0.02 AND l_tax > 0.01 AND l_linenumber <= 3", None),
    ("filter_and_or", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR l_linenumber = 2 AND l_quantity > 40.0", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 OR l_linenumber = 2) AND l_quantity > 40"),
    ("filter_in", "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 7)", None),
    ("filter_not_in", "part", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 7)", None),
    ("filter_between", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 50000.0", None),
    ("filter_is_null", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey % (o_custkey % 3) IS NOT NULL", "SELECT o_orderkey FROM orders WHERE o_orderkey % nullif(o_custkey % 3, 0) IS NOT NULL"),
    ("filter_is_missing", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey % (o_custkey % 3) IS NULL", "SELECT o_orderkey FROM orders WHERE o_orderkey % nullif(o_custkey % 3, 0) IS NULL"),
    ("filter_in_set", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 4, 9, 16, 25, 36, 49, 64, 81, 100, 121, 144, 169, 196, 225, 256)", None),
    ("bitwise_not", "nation", "SELECT n_nationkey, ~n_nationkey AS v, ~(n_nationkey + 1) AS w FROM nation", "SELECT n_nationkey, ~n_nationkey AS v, ~(n_nationkey + 1::BIGINT) AS w FROM nation"),
    ("one_row", "region", "SELECT 1 + 2 AS v, 'x' AS s", "SELECT 3::BIGINT AS v, 'x' AS s"),
    ("library_functions", "nation", "SELECT UPPER(n_name) AS u, LENGTH(n_name) AS n FROM nation", "SELECT upper(n_name) AS u, length(n_name)::INT AS n FROM nation"),
    ("agg_group_empty", "orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", None),
    ("date_between", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN 820454400000 AND 852076800000 AND o_orderdate != 820627200000", "SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' AND o_orderdate <> TIMESTAMP '1996-01-03'"),
    ("predicate_expr", "lineitem", "SELECT l_orderkey, l_linenumber, (l_quantity > 10.0) AS p FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity > 10 AS p FROM lineitem"),
    ("agg_global", "lineitem", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, AVG(l_linenumber) AS m FROM lineitem", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS m FROM lineitem"),
    ("agg_empty", "lineitem", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem WHERE l_linenumber > 1000", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_linenumber > 1000"),
    ("agg_group", "lineitem", "SELECT l_linenumber, COUNT(*) AS n, SUM(l_suppkey) AS s FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, count(*) AS n, sum(l_suppkey)::BIGINT AS s FROM lineitem GROUP BY l_linenumber"),
    ("agg_group_expr", "orders", "SELECT o_custkey % 10 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1"),
    ("agg_group_string", "lineitem", "SELECT l_returnflag, l_linestatus, MIN(l_quantity) AS lo, MAX(l_returnflag) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    ("agg_group_only", "lineitem", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag", None),
    ("having_alias", "orders", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    ("having_agg", "orders", "SELECT o_custkey AS k FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    ("order_by", "nation", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name", None),
    ("order_by_hidden", "nation", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 10", None),
    ("order_by_agg", "orders", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 3", None),
    ("limit_offset", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5, 7", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5"),
    ("top_n", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey TOP 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    ("dates_as_numbers", "events", "SELECT event_id, ts FROM events WHERE ts >= 1704067200000", "SELECT event_id, epoch_us(ts) // 1000 AS ts FROM events WHERE epoch_us(ts) // 1000 >= 1704067200000"),
]
for _name, _table, _text, _sql in RQL:
    QUERIES[_name] = partial(_rql, on=_table, text=_text)
    SQL[_name] = _sql or _text
QUERIES["arith_sql_precedence"] = partial(_rql, on="nation", text="SELECT n_nationkey, 1 + n_nationkey * 2 AS v FROM nation", precedence="sql")
SQL["arith_sql_precedence"] = "SELECT n_nationkey, 1 + n_nationkey * 2::BIGINT AS v FROM nation"


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_linenumber)::BIGINT AS lines, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    return rql("SELECT l_returnflag, l_linestatus, SUM(l_linenumber) AS lines, COUNT(*) AS n, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high FROM lineitem WHERE l_shipdate <= 904694400000 GROUP BY l_returnflag, l_linestatus", table(spark, sf_dir, "lineitem"))


# ---- filter trees
FILTERS = {
    "filter_tree_like": (Filter("like", "p_type", ("%M",)), "part", "p_partkey", "p_type LIKE '%M'"),
    "filter_tree_not_like": (Filter("not_like", "p_type", ("S%",)), "part", "p_partkey", "p_type NOT LIKE 'S%'"),
    "filter_tree_not": (~(Filter("greater", "l_quantity", (10.0,)) & Filter("in", "l_linenumber", (1, 2))), "lineitem", "l_orderkey", "NOT (l_quantity > 10 AND l_linenumber IN (1, 2))"),
    "filter_tree_not_equal": (Filter("not_equal", "p_type", ("SMALL",)), "part", "p_partkey", "p_type <> 'SMALL'"),
    "filter_tree_unknown": (~(Filter("unknown") & Filter("less", "p_size", (10,))) & Filter("greater", "p_size", (4,)), "part", "p_partkey", "p_size > 4"),
    "filter_tree_or_equals": (Filter("equal", "p_size", (3,)) | Filter("equal", "p_size", (9,)) | Filter("equal", "p_size", (11,)), "part", "p_partkey", "p_size IN (3, 9, 11)"),
    "filter_tree_not_between": (Filter("not_between", "p_retailprice", (950.0, 1500.0)), "part", "p_partkey", "p_retailprice NOT BETWEEN 950 AND 1500"),
    "filter_tree_range": (Filter("greater_equal", "o_totalprice", (9000.0,)) & Filter("less_equal", "o_totalprice", (90000.0,)), "orders", "o_orderkey", "o_totalprice BETWEEN 9000 AND 90000"),
}
for _name, (_f, _table, _col, _where) in FILTERS.items():
    QUERIES[_name] = lambda spark, sf_dir, f=_f, t=_table, c=_col: table(spark, sf_dir, t).where(Filter.from_json(f.to_json()).optimize().to_column()).select(c)
    SQL[_name] = f"SELECT {_col} FROM {_table} WHERE {_where}"


# ---- rollup
EVENTS = TableSpec([ColumnSpec("user_id", "BIGINT"), ColumnSpec("event_type", "VARCHAR", index=True), ColumnSpec("n", "BIGINT"), ColumnSpec("low", "DOUBLE"), ColumnSpec("high", "DOUBLE"), ColumnSpec("first_value", "DOUBLE"), ColumnSpec("last_value", "DOUBLE")],
    AggSpec(True, ["user_id", "event_type"], [Metric("n", "sum"), Metric("low", "min"), Metric("high", "max"), Metric("first_value", "first"), Metric("last_value", "last")]))
_EVENTS_SQL = "SELECT user_id, event_type, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(1).cast("bigint").alias("n"), *[F.col("value").alias(c) for c in ("low", "high", "first_value", "last_value")])


@query("rollup_all", _EVENTS_SQL)
def rollup_all(spark, sf_dir):
    return rollup(_events(spark, sf_dir), EVENTS.agg, seq=F.col("event_id"))


@query("rollup_remerge", _EVENTS_SQL)
def rollup_remerge(spark, sf_dir):
    ev = _events(spark, sf_dir)
    parts = [rollup(ev.where(F.col("event_id") % 3 == i), EVENTS.agg, seq=F.col("event_id"), keep_seq=True) for i in range(3)]
    return rollup(parts[0].unionByName(parts[1]).unionByName(parts[2]), EVENTS.agg)


# ---- ingestion
PROPS = TableSpec([ColumnSpec("event_id", "BIGINT"), ColumnSpec("k", "BIGINT", default=-1), ColumnSpec("missing", "VARCHAR", default="none")])


@query("ingest_json_defaults", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id WHEN event_id % 5 = 1 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, 'none' AS missing FROM events")
def ingest_json_defaults(spark, sf_dir):
    # a fifth of the messages has the key by its alias, a fifth has neither
    other = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"kk": '), F.col("user_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 5 == 1, F.lit('{"more": 1}'))
    ev = table(spark, sf_dir, "events").select("event_id", F.coalesce(other, "props").alias("props"))
    spec = TableSpec([c for c in PROPS.columns if c.name != "event_id"])
    return ingest_json(ev, spec, IngestSpec(alias={"k": "kk"}), body="props", keep=("event_id",)).drop("_pos")


_TAGGED = "concat('{\"key\":', cast({id} AS {s}), ',\"tag\":\"', event_type, ', x\"},{\"key\":', cast(user_id AS {s}), '}')"


@query("ingest_tag_filter", "SELECT event_id, event_id AS key FROM events WHERE event_type IN ('click', 'view')")
def ingest_tag_filter(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.expr(_TAGGED.replace("{id}", "event_id").replace("{s}", "STRING")).alias("value"))
    return ingest_json(ev, TableSpec([ColumnSpec("key", "BIGINT")]), IngestSpec(tag_field="tag", accept_tags=("click", "view")), keep=("event_id",)).drop("_pos")


@query("ingest_tag_accept_none", "SELECT event_id, event_id AS key FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, user_id AS key FROM events")
def ingest_tag_accept_none(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.expr(_TAGGED.replace("{id}", "event_id").replace("{s}", "STRING")).alias("value"))
    return ingest_json(ev, TableSpec([ColumnSpec("key", "BIGINT")]), IngestSpec(tag_field="tag", accept_tags=("click", "view"), accept_none=True), keep=("event_id",)).drop("_pos")


@query("ingest_ignore_empty", "SELECT event_id, event_type AS d FROM events WHERE event_id % 2 = 0")
def ingest_ignore_empty(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("d")))).otherwise(F.lit('{"other": 1}')).alias("value"))
    spec = TableSpec([ColumnSpec("d", "VARCHAR")], AggSpec(False, ["d"]))
    return ingest_json(ev, spec, IngestSpec(ignore_empty=True), keep=("event_id",)).drop("_pos")


@query("ingest_bad_messages", "SELECT event_id, user_id AS k FROM events WHERE event_id % 3 <> 0")
def ingest_bad_messages(spark, sf_dir):
    good = F.concat(F.lit('{"k": "'), F.col("user_id").cast("string"), F.lit('"}'))
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(good, F.lit(',{"k": {"a": 1}}'))).otherwise(good).alias("value"))
    return ingest_json(ev, TableSpec([ColumnSpec("k", "BIGINT")]), keep=("event_id",)).drop("_pos")


@query("ingest_csv", "SELECT event_id, event_type AS t, user_id AS u FROM events")
def ingest_csv(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", "event_type", "user_id").alias("value"))
    return normalise(csv_messages(ev, ["t", "u"], keep=("event_id",)), TableSpec([ColumnSpec("t", "VARCHAR"), ColumnSpec("u", "BIGINT")]), keep=("event_id",))


# ---- storage and maintenance; written to a folder of their own
def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ("file://" + tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir"))
    path = f"{base.rstrip('/')}/brindle-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query("write_rollup_read", _EVENTS_SQL)
def write_rollup_read(spark, sf_dir):
    path = _folder(spark)
    storage.write(_events(spark, sf_dir), path, EVENTS, seq=F.col("event_id"))
    return storage.read(spark, path, EVENTS)


@query("compaction_equivalence", _EVENTS_SQL)
def compaction_equivalence(spark, sf_dir):
    path, ev = _folder(spark), _events(spark, sf_dir)
    for i in range(3):
        storage.write(ev.where(F.col("event_id") % 3 == i), path, EVENTS, seq=F.col("event_id"), keep_seq=True)
    maintenance.compact(spark, path, EVENTS)
    return storage.read(spark, path, EVENTS).select(*[c.name for c in EVENTS.columns])


@query("prune_equivalence", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900")
def prune_equivalence(spark, sf_dir):
    path = _folder(spark)
    spec = TableSpec([ColumnSpec("l_orderkey", "BIGINT"), ColumnSpec("l_linenumber", "INT"), ColumnSpec("l_quantity", "DOUBLE")], AggSpec(False, ["l_orderkey"]))
    storage.write(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, spec, file_rows=20_000, manifest=True)
    return storage.read(spark, path, spec, Filter("between", "l_orderkey", (100, 900)))


def _as_json():
    return F.to_json(F.struct("user_id", "event_type", F.lit(1).alias("n"), *[F.col("value").alias(c) for c in ("low", "high", "first_value", "last_value")]))


def _streamed(spark, sf_dir, make=None, **how):
    """Events through ingestion: three files of messages, a batch each; the table's location."""
    path = _folder(spark)
    messages = table(spark, sf_dir, "events").select(F.col("event_id").alias("_at"), (_as_json() if make is None else make).alias("value"))
    fetch = {"type": "json", "path": f"{path}/in", "max.files": 1} | how.pop("fetch", {})
    total = messages.count()
    for i in range(3):  # a file at a time, so that arrival follows the ids
        own = messages.where(F.floor(F.col("_at") * 3 / total) == i)
        own.coalesce(1).sortWithinPartitions("_at").select("value").write.mode("append").text(f"{path}/in")
        realtime.start(realtime.source(spark, fetch), EVENTS, f"{path}/t", f"{path}/check", fetch=fetch, available_now=True, **how).awaitTermination()
    return f"{path}/t"


def _summed(df):
    return df.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


_SUMMED_SQL = "SELECT user_id, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL"


@query("rt_hybrid", _SUMMED_SQL)
def rt_hybrid(spark, sf_dir):
    return _summed(realtime.hybrid(spark, _streamed(spark, sf_dir), EVENTS))


@query("rt_merge_hybrid", _EVENTS_SQL)
def rt_merge_hybrid(spark, sf_dir):
    at = _streamed(spark, sf_dir)
    realtime.merge(spark, at, EVENTS, "merged")
    return realtime.hybrid(spark, at, EVENTS)


@query("rt_mergefrag_hybrid", _SUMMED_SQL)
def rt_mergefrag_hybrid(spark, sf_dir):
    at = _streamed(spark, sf_dir)
    realtime.merge(spark, at, EVENTS, "merged")
    maintenance.compact(spark, f"{at}/hist", EVENTS)
    return _summed(realtime.hybrid(spark, at, EVENTS))


@query("ingest_csv_stream", _SUMMED_SQL)
def ingest_csv_stream(spark, sf_dir):
    line = F.concat_ws(",", "user_id", "event_type", F.lit("1"), *["value"] * 4)
    at = _streamed(spark, sf_dir, line, fetch={"type": "csv", "header": [c.name for c in EVENTS.columns]})
    return _summed(realtime.hybrid(spark, at, EVENTS))


@query("ingest_stats", "SELECT count(*)::BIGINT AS consumed, count(*)::BIGINT AS produced FROM events")
def ingest_stats(spark, sf_dir):
    got: list = []
    _streamed(spark, sf_dir, stats=got)
    return spark.createDataFrame([(sum(x["consumed"] for x in got), sum(x["produced"] for x in got))], "consumed bigint, produced bigint")


@query("rt2his_select_where", "SELECT user_id, event_type, sum(n) AS n, min(low) AS low, kind FROM (SELECT user_id, event_type, 2::BIGINT AS n, value AS low, 'type=' || event_type AS kind FROM events WHERE user_id > 10) GROUP BY ALL")
def rt2his_select_where(spark, sf_dir):
    at, his = _streamed(spark, sf_dir), _folder(spark)
    realtime.to_history(spark, at, EVENTS, his, "kind", "concat('type=', event_type)", select={"n": "n * 2"}, where="user_id > 10")
    if realtime.groups(spark, at, "rt"):
        raise AssertionError("rows that moved are still there")
    return storage.read(spark, his, EVENTS).select("user_id", "event_type", "n", "low", "kind")


@query("watermark_window", "SELECT day, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS day FROM events) WHERE day + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '36 hours' GROUP BY day")
def watermark_window(spark, sf_dir):
    """Counts by day in append mode: a day comes out when the watermark has passed its end."""
    path = _folder(spark)
    ev = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    w = ev.withWatermark("ts", "36 hours").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")
    w.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day timestamp_ntz, n bigint").parquet(f"{path}/out")


@query("own_functions", "SELECT o_orderstatus, max(o_orderkey * 3 + 1) AS high FROM orders GROUP BY o_orderstatus")
def own_functions(spark, sf_dir):
    def triple(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    registry.register(spark, "brindle_triple", triple, "bigint")
    return rql("SELECT o_orderstatus, MAX(BRINDLE_TRIPLE(o_orderkey)) AS high FROM orders GROUP BY o_orderstatus", table(spark, sf_dir, "orders"))


@query("csv_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_roundtrip(spark, sf_dir):
    path = _folder(spark)
    csvio.export(table(spark, sf_dir, "orders"), path, columns=("o_orderkey", "o_orderstatus", "o_totalprice"), sep="|")
    return csvio.load(spark, path, TableSpec([ColumnSpec("o_orderkey", "BIGINT"), ColumnSpec("o_orderstatus", "VARCHAR"), ColumnSpec("o_totalprice", "DOUBLE")]), sep="|")


@query("null_policy_default", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'unknown') AS lang, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, 0) AS n_chars FROM documents")
def null_policy_default(spark, sf_dir):
    spec = TableSpec([ColumnSpec("doc_id", "BIGINT"), ColumnSpec("lang", "VARCHAR", default="unknown"), ColumnSpec("n_chars", "BIGINT")])
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("n_chars"))
    return storage.fill_nulls(d, spec)


@query("add_column", "SELECT o_orderkey, o_custkey, o_orderkey + o_custkey AS total, CASE WHEN o_custkey > 100 THEN 100 ELSE 10 END::INT AS flag, DATE '2015-09-12' AS day FROM orders")
def add_column(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return maintenance.add_columns(d, [(ColumnSpec("total", "BIGINT"), "o_orderkey + o_custkey"), (ColumnSpec("flag", "INT"), "if((o_custkey > 100), 100, 10)"), (ColumnSpec("day", "DATE"), "'2015-09-12'"), (ColumnSpec("o_custkey", "INT"), "1")])


@query("drop_column", "SELECT n_nationkey, n_name FROM nation")
def drop_column(spark, sf_dir):
    return maintenance.drop_columns(table(spark, sf_dir, "nation"), ["N_REGIONKEY", "unknown"])


@query("alter_column", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey FROM nation")
def alter_column(spark, sf_dir):
    return maintenance.alter_columns(table(spark, sf_dir, "nation"), [(ColumnSpec("n_nationkey", "VARCHAR"), "cast(n_nationkey, string)")])


@query("update_column_job", "SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 2::BIGINT AS twice FROM nation")
def update_column_job(spark, sf_dir):
    path = _folder(spark)
    storage.write(table(spark, sf_dir, "nation"), path)
    maintenance.rewrite(spark, path, lambda df: maintenance.add_columns(df, [(ColumnSpec("twice", "BIGINT"), "n_nationkey * 2")]))
    return spark.read.parquet(path)


@query("rt_to_history", "SELECT user_id, event_type, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, strftime(ts, '%Y%m%d') AS day FROM events GROUP BY user_id, event_type, day")
def rt_to_history(spark, sf_dir):
    path = _folder(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "ts").join(_events(spark, sf_dir), "event_id")
    keyed = ev.withColumn("_seq_first", F.col("event_id")).withColumn("_seq_last", F.col("event_id"))
    maintenance.to_history(keyed, EVENTS, path, "day", F.date_format("ts", "yyyyMMdd"))
    return spark.read.schema(spark.read.parquet(path).drop("day").schema.add("day", "string")).parquet(path)


@query("hybrid_union", "SELECT o_orderkey, o_orderkey % 4 AS rt_group, CASE WHEN o_orderkey % 4 < 2 THEN 'rt' ELSE 'hist' END AS side FROM orders")
def hybrid_union(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("rt_group"))
    return storage.hybrid(d.where("rt_group < 2").withColumn("side", F.lit("rt")), d.where("rt_group > 0").withColumn("side", F.lit("hist")), "rt_group")


# ---- what Spark SQL supplies
def _sql_query(name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    def run(spark, sf_dir):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    SQL[name] = oracle or text.replace("{", "").replace("}", "")


_sql_query("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey", tables=("orders", "customer"))
_sql_query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000", tables=("orders", "customer"))
_sql_query("join_full", "SELECT s.s_suppkey, n.n_name FROM {supplier} s FULL OUTER JOIN {nation} n ON s.s_nationkey = n.n_nationkey", tables=("supplier", "nation"))
_sql_query("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", tables=("nation",))
_sql_query("semi_join", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)", tables=("orders", "customer"))
_sql_query("anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", tables=("orders", "customer"))
_sql_query("window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM {orders}", tables=("orders",))
_sql_query("window_frame", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM {events}", tables=("events",))
_sql_query("set_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey AS k FROM {region}", tables=("nation", "region"))
_sql_query("set_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey AS k FROM {customer}", tables=("orders", "customer"))
_sql_query("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 400000", tables=("orders", "customer"))
_sql_query("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", tables=("lineitem",))
_sql_query("rollup_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", tables=("lineitem",))
_sql_query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))", tables=("lineitem",))
_sql_query("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type", tables=("events",))
_sql_query("subquery_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT o_custkey, n FROM big WHERE n = (SELECT max(n) FROM big)", tables=("orders",))


@query("tumbling_window", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("sliding_window", "SELECT d + INTERVAL (i) HOUR * -12 AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '12 hours', ts) AS d FROM events), (SELECT unnest([0, 1]) AS i) GROUP BY 1")
def sliding_window(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("session_window", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_window(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("asof_join", "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    right = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return relational.asof_join(ev.where("event_type = 'click'"), right, by="user_id", left_time="ts", right_time="ts", value="last_purchase").select("event_id", "last_purchase")


@query("range_join", "SELECT p.p_partkey, r.k FROM part p JOIN (SELECT n_nationkey AS k, 900.0 + n_nationkey * 40 AS low, 930.0 + n_nationkey * 40 AS high FROM nation) r ON p.p_retailprice BETWEEN r.low AND r.high")
def range_join(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (900.0 + F.col("n_nationkey") * 40).alias("low"), (930.0 + F.col("n_nationkey") * 40).alias("high"))
    return relational.range_join(table(spark, sf_dir, "part"), r, point="p_retailprice", low="low", high="high", width=40.0).select("p_partkey", "k")


@query("interval_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey * 3 % 40 <= b.n_nationkey * 3 % 40 + 2 AND b.n_nationkey * 3 % 40 <= a.n_nationkey * 3 % 40 + 4")
def interval_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    low = F.col("n_nationkey") * 3 % 40
    a = n.select(F.col("n_name").alias("x"), low.alias("a0"), (low + 4).alias("a1"))
    b = n.select(F.col("n_name").alias("y"), low.alias("b0"), (low + 2).alias("b1"))
    return relational.interval_join(a, b, low="a0", high="a1", b_low="b0", b_high="b1", width=5.0).select("x", "y")


@query("theta_join", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_acctbal < s.s_acctbal AND c.c_nationkey <> s.s_nationkey WHERE s.s_suppkey < 5")
def theta_join(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier").where("s_suppkey < 5")
    return relational.theta_join(c, s, (c.c_acctbal < s.s_acctbal) & (c.c_nationkey != s.s_nationkey)).select("c_custkey", "s_suppkey")


@query("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")

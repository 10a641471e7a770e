import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from brindle import cli
from brindle.catalog import Catalog
from brindle.operators import maintenance
from brindle.operators.filters import ALL, NONE, SOME, Filter
from brindle.operators.rollup import rollup
from brindle.plans.rql import Parser, RQLError, rql
from brindle.schema import AggSpec, ColumnSpec, Metric, TableSpec, time_millis, time_text
from brindle.sources import csvio, storage
from brindle.streaming import realtime
from brindle.streaming.ingest import IngestSpec, ingest_json

#: Readings of meters: a table with a default, an alias and every kind of column.
SPEC = TableSpec(
    [ColumnSpec("meter", "VARCHAR", default="unnamed"), ColumnSpec("zone", "BIGINT", default=7), ColumnSpec("day", "DATE"), ColumnSpec("at", "TIME"), ColumnSpec("units", "INT"), ColumnSpec("peak", "INT"), ColumnSpec("level", "FLOAT", default=0.5), ColumnSpec("cost", "DOUBLE")],
    AggSpec(True, ["meter", "zone", "day", "at"], [Metric("units", "sum"), Metric("peak", "max"), Metric("level", "last"), Metric("cost", "min")]),
)
HOW = IngestSpec(alias={"level": "fill", "meter": "device"})


def numbers(spark):
    return spark.createDataFrame([(1, 2.5, "a", True), (2, -0.5, "b", False), (0, 0.0, None, None)], "i int, d double, s string, b boolean")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 1 + i * 2 AS v FROM t", [4, 6, 2]),
        ("SELECT i AS v FROM t WHERE i = 1 OR i = 2 AND i = 2", [2]),
        ("SELECT s AS v FROM t WHERE s IS NOT NULL", ["a", "b"]),
        ("SELECT i AS v FROM t WHERE i NOT IN (1, 2)", [0]),
        ("SELECT i AS v FROM t WHERE d = 0", [0]),
        ("SELECT CAST(i > 0, string) AS v FROM t", None),
        ("SELECT CAST((i > 0), string) AS v FROM t", ["true", "true", "false"]),
        ("SELECT CAST(4294967297, int) AS v FROM t LIMIT 1", [1]),
        ("SELECT CAST(100000000000000000000.0, int) AS v FROM t LIMIT 1", [2147483647]),
        ("SELECT CAST('x', int) AS v FROM t LIMIT 1", [None]),
        ("SELECT MAX(d) AS v FROM t WHERE d < 0.0", [-0.5]),
        ("SELECT i AS v FROM a, b", None),
        ("SELECT i -1 AS v FROM t", None),
        ("SELECT SUM(i) AS v FROM t HAVING SUM(i) > 100", []),
        ("SELECT i AS v FROM t ORDER BY d TOP 1", [2]),
    ],
)
def test_dialect(spark, text, want):
    if want is None:
        with pytest.raises(RQLError):
            rql(text, numbers(spark))
    else:
        assert [r.v for r in rql(text, numbers(spark)).collect()] == want


def test_division_and_options(spark):
    got = [r.v for r in rql("SELECT d / 0 AS v FROM t", numbers(spark)).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])
    assert rql("SELECT SUM(i) AS v FROM t WHERE i > 9", numbers(spark), empty_as_default=True).first().v == 0
    assert rql("SELECT 1 + i * 2 AS v FROM t", numbers(spark), precedence="sql").first().v == 3
    assert Parser("SELECT a-b FROM t", "flat").query().columns[0][0] == ("column", "a-b")


def test_filter_trees(spark):
    f = ~(Filter("equal", "i", (1,)) | Filter("less", "i", (1,)))
    assert f.optimize().type in ("and", "greater") and Filter.from_json(f.to_json()) == f
    assert [r.i for r in numbers(spark).where(f.optimize().to_column()).collect()] == [2]
    assert (Filter("greater_equal", "i", (1,)) & Filter("less_equal", "i", (5,))).optimize().type == "between"
    assert (Filter("equal", "i", (3,)) | Filter("greater", "i", (3,))).optimize().type == "greater_equal"
    stats = {"x": (10, 40)}
    assert [Filter("equal", "x", (v,)).rough_check(stats) for v in (9, 10, 25, 41)] == [NONE, SOME, SOME, NONE]
    assert Filter("greater", "x", (40,)).rough_check(stats) == NONE and Filter("not_in", "x", (50,)).rough_check(stats) == ALL
    assert Filter("like", "x", ("zz%",)).rough_check({"x": ("a", "b")}) == NONE
    assert numbers(spark).where((~Filter("unknown")).to_column()).count() == 3


def test_pruning_never_changes_results(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).cast("string").alias("v"))
    path, spec = str(tmp_path / "t"), TableSpec([ColumnSpec("k", "BIGINT"), ColumnSpec("v", "VARCHAR")], AggSpec(False, ["k", "v"]))
    storage.write(df, path, spec, file_rows=50, manifest=True)
    storage.write(df.withColumn("k", F.col("k") + 5000), path, spec, file_rows=500, manifest=True)
    whole = df.unionByName(df.withColumn("k", F.col("k") + 5000))
    for f in (Filter("between", "k", (10, 120)), Filter("in", "k", (5, 999)), ~Filter("greater", "k", (30,)), Filter("equal", "v", ("3",)) & Filter("less", "k", (200,)), Filter("like", "v", ("1%",)), Filter("not_between", "k", (3, 5990)), ~Filter("equal", "k", (4,)), Filter("unknown") | Filter("less", "k", (3,))):
        assert sorted(storage.read(spark, path, spec, f).collect()) == sorted(whole.where(f.to_column()).collect())
    total = len(storage.read(spark, path, spec).inputFiles())
    assert len(storage.read(spark, path, spec, Filter("less", "k", (50,))).inputFiles()) < total / 4
    assert storage.read(spark, path, spec, Filter("less", "k", (-1,))).count() == 0


def test_dates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(400).selectExpr("id", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS d", "timestamp_micros(id * 1500 + 1577836800000000) AS t", "CAST(timestamp_micros(id * 1500 + 1577836800000000) AS TIMESTAMP_NTZ) AS n").write.parquet(path)
    df = spark.read.parquet(path)
    plain = {r.id: r for r in rql("SELECT id, d, t, n FROM x", df).collect()}
    for c, at in (("d", 1577836800000 + 86400000 * 30), ("d", 1577836800000 + 86400000 * 30 + 5), ("t", 1577836800060), ("n", 1577836800061)):
        for op, same in (("<", lambda a, b: a < b), ("<=", lambda a, b: a <= b), (">", lambda a, b: a > b), (">=", lambda a, b: a >= b), ("=", lambda a, b: a == b), ("!=", lambda a, b: a != b)):
            got = rql(f"SELECT id FROM x WHERE {c} {op} {at}", df)
            assert {r.id for r in got.collect()} == {i for i, r in plain.items() if same(r[c], at)}, (c, op)
            if op != "!=":
                filters = next(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in x)
                assert f"({c}," in filters, filters


def test_rollup_wraps_and_remerges(spark):
    df = spark.createDataFrame([("a", 2147483647, 1), ("a", 1, 2), ("b", 5, 3)], "d string, m int, t int")
    agg = AggSpec(True, ["d"], [Metric("m", "sum")])
    assert {r.d: r.m for r in rollup(df, agg).collect()} == {"a": -2147483648, "b": 5}
    agg = AggSpec(True, ["d"], [Metric("m", "first")])
    with pytest.raises(ValueError):
        rollup(df, agg)
    one = rollup(df, agg, seq=F.col("t"), keep_seq=True)
    assert {r.d: r.m for r in rollup(one, agg).collect()} == {"a": 2147483647, "b": 5}


def test_ingestion(spark):
    msgs = ['{"meter": "m1", "zone": 2, "units": 5, "peak": 9, "level": 1.5, "cost": 0.25}, {"meter": "m1", "units": 6, "peak": 4, "more": true}', '{"device": "m1", "zone": 2, "units": 10, "fill": 2.5, "cost": 0.125, "at": "1:02:03"}', '{"units": "many"}', '{"units": [1]}', '{"peak": null}', "", '{"day": "2021-13-01"}', '{"day": "2021-12-01", "at": "0:00:00"}']
    rows = ingest_json(spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "n int, value string"), SPEC, HOW, keep=("n",)).orderBy("n", "_pos").collect()
    assert [(r.n, r.meter, r.zone, r.units) for r in rows] == [(0, "m1", 2, 5), (0, "m1", 7, 6), (1, "m1", 2, 10), (7, "unnamed", 7, 0)]
    assert rows[1].level == 0.5 and rows[2].level == 2.5 and rows[3].day == dt.date(2021, 12, 1)
    more = [*[r.asDict() for r in rows], rows[0].asDict() | {"n": 9, "units": 1, "peak": 30, "level": 8.0, "cost": 3.0}]
    merged = rollup(spark.createDataFrame(more), SPEC.agg, seq=F.col("n")).where("zone = 2 and at = 0").first()
    assert (merged.units, merged.peak, merged.level, merged.cost) == (6, 30, 8.0, 0.25)
    long = spark.createDataFrame([('{"meter": "' + "y" * 65_536 + '"}',), ('{"meter": "fine"}',), ('{"units": ""}',)], "value string")
    assert ingest_json(long, SPEC, HOW).count() == 1
    assert ingest_json(long, SPEC, IngestSpec(empty_as_zero=True)).count() == 2


def test_times(spark):
    df = spark.createDataFrame([("3:12:56",), ("23:59:59.5",), ("24:00:00",), ("x",), (None,)], "t string").select(time_millis(F.col("t")).alias("ms"))
    assert [r.ms for r in df.collect()] == [11576000, 86399500, None, None, None]
    assert df.where("ms is not null").select(time_text(F.col("ms")).alias("t")).first().t == "03:12:56"


def test_schema_rules():
    text = json.dumps({"schema": {"columns": [{"name": "d", "dataType": "string", "index": True}, {"name": "m", "dataType": "long"}]}, "agg": {"grouping": True, "dims": ["d"], "metrics": [{"name": "m", "agg": "sum"}]}})
    spec = TableSpec.from_json(text)
    assert TableSpec.from_json(spec.to_json()).columns == spec.columns and spec.agg.grouping
    for agg in (AggSpec(True), AggSpec(False, [], [Metric("m", "sum")]), AggSpec(True, ["d"], [Metric("d", "sum")]), AggSpec(True, ["d", "d"]), AggSpec(True, ["m"], [Metric("d", "sum")])):
        with pytest.raises(ValueError):
            TableSpec(spec.columns, agg)


def test_csv_and_nulls(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,,x\n2,5.5,\n")
    spec = TableSpec([ColumnSpec("a", "INT"), ColumnSpec("b", "DOUBLE"), ColumnSpec("c", "VARCHAR", default="none"), ColumnSpec("d", "DATE")])
    rows = csvio.load(spark, str(tmp_path / "in.csv"), spec, header=["a", "b", "c"]).orderBy("a").collect()
    assert [(r.a, r.b, r.c, r.d) for r in rows] == [(1, 0.0, "x", dt.date(1970, 1, 1)), (2, 5.5, "none", dt.date(1970, 1, 1))]


def test_streaming_hybrid_and_recovery(spark, tmp_path):
    src, loc, ck = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "ck")
    src.mkdir()
    spec = TableSpec([ColumnSpec("d", "VARCHAR"), ColumnSpec("m", "BIGINT"), ColumnSpec("l", "BIGINT")], AggSpec(True, ["d"], [Metric("m", "sum"), Metric("l", "last")]))

    def ingest(name, lines):
        (src / name).write_text("\n".join(lines))
        realtime.start(realtime.source(spark, {"type": "text", "path": str(src)}), spec, loc, ck, available_now=True).awaitTermination()

    ingest("a", ['{"d": "x", "m": 1, "l": 1},{"d": "x", "m": 2, "l": 2}', '{"d": "y", "m": 5, "l": 3}'])
    ingest("b", ['{"d": "x", "m": 10, "l": 9}', '{"d": {"bad": 1}}'])
    total = {r.d: r.m for r in realtime.hybrid(spark, loc, spec).groupBy("d").agg(F.sum("m").alias("m")).collect()}
    assert total == {"x": 13, "y": 5}
    total_now = lambda: {r.d: r.m for r in realtime.hybrid(spark, loc, spec).groupBy("d").agg(F.sum("m").alias("m")).collect()}
    assert realtime.merge(spark, loc, spec, "h1", clean=False) == ["batch-000000000000", "batch-000000000001"]
    assert total_now() == total and realtime.groups(spark, loc, "rt") == []  # the batches still lie there but are replaced
    realtime.settle(spark, loc)
    assert total_now() == total and not (tmp_path / "t" / "rt" / "rt_group=batch-000000000000").exists()
    got = {r.d: (r.m, r.l) for r in spark.read.parquet(f"{loc}/hist").collect()}
    assert got == {"x": (13, 9), "y": (5, 3)}
    ingest("c", ['{"d": "x", "m": 100, "l": 50}'])
    # a merge that breaks off before its commit: its group isn't read, and settling undoes it
    from brindle.sources import files

    files.put_json(spark, f"{loc}/_pending/h2", ["batch-000000000002"])
    realtime.fresh(spark, loc, spec).drop("rt_group").write.parquet(f"{loc}/hist/rt_group=h2")
    assert total_now() == {"x": 113, "y": 5}
    realtime.settle(spark, loc)
    assert total_now() == {"x": 113, "y": 5} and realtime.groups(spark, loc, "hist") == ["h1"]
    realtime.merge(spark, loc, spec, "h3")
    maintenance.compact(spark, f"{loc}/hist", spec)
    assert total_now() == {"x": 113, "y": 5} and realtime.groups(spark, loc, "hist") == ["h1", "h3"]


def test_a_batch_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    src, loc, ck = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a").write_text("p;1\nq;2\n;3\n")
    spec = TableSpec([ColumnSpec("d", "VARCHAR", default="none"), ColumnSpec("m", "BIGINT")], AggSpec(True, ["d"], [Metric("m", "sum")]))
    fetch, stats = {"type": "csv", "path": str(src), "separator": ";"}, []
    go = lambda: realtime.start(realtime.source(spark, fetch), spec, loc, ck, fetch=fetch, available_now=True, stats=stats, name="one").awaitTermination()
    real = realtime.rollup

    def broken(rows, *more, **how):
        real(rows, *more, **how).write.mode("overwrite").parquet(f"{loc}/rt/rt_group=batch-000000000000")
        raise RuntimeError("lost")

    monkeypatch.setattr(realtime, "rollup", broken)
    with pytest.raises(Exception, match="lost"):
        go()
    monkeypatch.setattr(realtime, "rollup", real)
    go()
    assert sorted((r.d, r.m) for r in realtime.hybrid(spark, loc, spec).collect()) == [("none", 3), ("p", 1), ("q", 2)]
    assert stats == [{"batch": 0, "consumed": 3, "produced": 3}] and not realtime.stop(spark, "one")


def test_catalog_and_cli(spark, tmp_path):
    root, conf = str(tmp_path / "cat"), tmp_path / "spec.json"
    conf.write_text(SPEC.to_json())
    run = lambda *a: cli.run(["--root", root, *a], spark)
    assert run("settb", "-t", "t1", "-c", str(conf)) == "OK" and run("listtb") == "t1"
    run("addrtt", "-t", "t1", "-n", "node1")
    assert run("rttnode", "-t", "t1") == "node1" and run("nodertt", "-n", "node1") == "t1"
    run("stopnode", "-n", "node1")
    assert run("listnode") == "" and "CREATE TABLE" in run("hivesql", "-t", "t1")
    run("upmode", "-t", "t1", "-m", "basic")
    assert Catalog(root).get("t1").mode == "basic"
    hist = f"{Catalog(root).location('t1')}/hist"
    spark.createDataFrame([("a", 1, dt.date(2020, 1, 1), 0, 3, 4, 1.0, 2.0)], SPEC.schema).write.parquet(f"{hist}/rt_group=g")
    assert Catalog(root).query(spark, "SELECT COUNT(*) AS n FROM t1").first().n == 1
    assert run("lisths", "-t", "t1").endswith(".parquet")
    (tmp_path / "rows.csv").write_text("b,9\nc,8\n")
    run("loadcsv", "-t", "t1", "-s", "csv1", "--path", str(tmp_path / "rows.csv"), "--header", "meter,units")
    assert Catalog(root).query(spark, "SELECT SUM(units) AS n FROM t1").first().n == 20
    run("exportcsv", "-t", "t1", "--path", str(tmp_path / "out"), "--header", "meter,units")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a,3", "b,9", "c,8"]
    (tmp_path / "change.json").write_text(json.dumps({"alter": [{"name": "units", "dataType": "bigint", "value": "units * 2"}], "delete": ["peak"]}))
    run("updatecols", "-t", "t1", "-c", str(tmp_path / "change.json"))
    assert Catalog(root).query(spark, "SELECT SUM(units) AS n FROM t1").first().n == 40 and "peak" not in run("dctb", "-t", "t1")
    run("mergefrag", "-t", "t1")
    assert Catalog(root).query(spark, "SELECT SUM(units) AS n FROM t1").first().n == 40
    assert run("startrt", "-t", "t1", "-n", "node1") == "no fetcher"
    run("rmseg", "-t", "t1", "-s", "g")
    run("rmtb", "-t", "t1")
    assert run("listtb") == ""


def test_column_updates(spark):
    df = spark.createDataFrame([(120, 2)], "c0 int, c1 bigint")
    out = maintenance.add_columns(df, [(ColumnSpec("a", "FLOAT"), "c0 + c1"), (ColumnSpec("t", "TIME"), "'23:59:59'"), (ColumnSpec("ts", "DATETIME"), "'2015-09-12T23:59:59'"), (ColumnSpec("i", "INT"), "if((c0 > 100), 100, 10)")]).first()
    assert (out.a, out.t, out.ts, out.i) == (122.0, 86399000, dt.datetime(2015, 9, 12, 23, 59, 59), 100)

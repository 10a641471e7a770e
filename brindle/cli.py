"""Table administration and jobs: python -m brindle.cli --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import maintenance
from .schema import ColumnSpec, TableSpec
from .sources import csvio, files, storage
from .streaming import realtime

# The commands.
COMMANDS = ("listtb", "settb", "rmtb", "dctb", "lisths", "listrs", "rmseg", "dchs", "stoprt", "startrt", "stopnode", "listnode", "nodertt", "rttnode", "addrtt", "rmrtt", "notifysu", "hivesql", "upmode", "mergefrag")
JOBS = ("loadcsv", "exportcsv", "updatecols", "rt2his", "mergert")


def _spark():
    from .session import session

    return session("brindle-cli")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--root", required=True)
    p.add_argument("command", choices=(*COMMANDS, *JOBS))
    p.add_argument("-t", "--table")
    p.add_argument("-c", "--config", help="table specification (JSON file); for updatecols the changes: add, alter (name, type, value) and delete (names)")
    p.add_argument("-n", "--node")
    p.add_argument("-m", "--mode")
    p.add_argument("-s", "--segment", help="group of files")
    p.add_argument("--column", help="partition column of the DDL or of rt2his")
    p.add_argument("--value", help="rt2his: the partition, an SQL expression")
    p.add_argument("--where", help="rt2his: rows that go over")
    p.add_argument("--select", help="rt2his: JSON object, SQL expressions by column")
    p.add_argument("--path", help="files to load, folder to export to, or history of rt2his")
    p.add_argument("--header", help="column names of CSV files, by commas")
    p.add_argument("--sep", default=",")
    return p


def run(argv: list[str] | None = None, spark=None) -> str:
    """Carry out one command and return what it says."""
    a = parser().parse_args(argv)
    cat, c = Catalog(a.root), a.command
    if c == "listtb":
        return "\n".join(cat.tables())
    if c == "settb":
        cat.put(a.table, TableSpec.from_json(Path(a.config).read_text()))
        return "OK"
    if c == "rmtb":
        cat.remove(a.table)
        return "OK"
    if c == "dctb":
        return cat.get(a.table).to_json()
    if c in ("listnode", "nodertt", "rttnode"):
        return "\n".join(cat.nodes() if c == "listnode" else cat.tables_of(a.node) if c == "nodertt" else cat.nodes(a.table))
    if c in ("addrtt", "rmrtt"):
        (cat.add_node if c == "addrtt" else cat.remove_node)(a.table, a.node)
        return "OK"
    if c == "upmode":
        cat.set_mode(a.table, a.mode)
        return "OK"
    if c == "hivesql":
        return maintenance.hive_ddl(a.table, cat.get(a.table), cat.location(a.table), (a.column, "string") if a.column else None)
    if c == "startrt" and a.node not in cat.nodes(a.table):
        cat.add_node(a.table, a.node)
    spark = spark or _spark()
    if c == "startrt":
        return start(cat, a.table, spark)
    if c == "stoprt":
        realtime.stop(spark, ingestion(a.table))
        cat.remove_node(a.table, a.node)
        return "OK"
    if c == "stopnode":
        for t in cat.tables_of(a.node):
            realtime.stop(spark, ingestion(t))
            cat.remove_node(t, a.node)
        return "OK"
    spec, where = cat.get(a.table), cat.location(a.table)
    if c == "rmseg":
        if not files.delete(spark, f"{where}/hist/{realtime.GROUP}={a.segment}"):
            raise KeyError(f"no group {a.segment}")
        return "OK"
    if c in ("lisths", "listrs"):
        return "\n".join(cat.history_files(spark, a.table, "hist" if c == "lisths" else "rt"))
    if c == "dchs":
        return "\n".join(f"{n} {k}" for n, k in spark.read.parquet(f"{where}/hist").dtypes)
    if c == "notifysu":
        spark.catalog.refreshByPath(where)
        return "OK"
    if c == "mergert":
        return "\n".join(realtime.merge(spark, where, spec, a.segment))
    if c == "loadcsv":
        rows = csvio.load(spark, a.path.split(";"), spec, header=a.header.split(",") if a.header else None, sep=a.sep)
        group, how = f"{where}/hist/{realtime.GROUP}={a.segment}", {}
        if spec.agg.grouping:  # the order of the files' rows is that of arrival
            rows, how = rows.withColumn("_arrival", F.monotonically_increasing_id().cast("decimal(38,0)")), {"seq": F.col("_arrival"), "keep_seq": True}
        storage.write(rows, group, spec, **how)
        return "OK"
    if c == "exportcsv":
        csvio.export(cat.read(spark, a.table), a.path, columns=tuple(a.header.split(",")) if a.header else (), sep=a.sep)
        return "OK"
    if c == "updatecols":
        return update_columns(cat, a.table, json.loads(Path(a.config).read_text()), spark)
    if c == "rt2his":
        return "\n".join(realtime.to_history(spark, where, spec, a.path or f"{where}/his", a.column, a.value, select=json.loads(a.select) if a.select else None, where=a.where))
    realtime.settle(spark, where)
    maintenance.compact(spark, f"{where}/hist", spec)  # mergefrag
    return "OK"


def ingestion(table: str) -> str:
    """Name of the streaming query that fills a table."""
    return f"ingest-{table}"


def start(cat: Catalog, table: str, spark) -> str:
    """Start a table's ingestion by the fetcher of its settings, from where it stopped; it runs as long as the session."""
    spec, where = cat.get(table), cat.location(table)
    fetch = spec.realtime.get("fetcher")
    if not fetch:
        return "no fetcher"
    if any(q.name == ingestion(table) for q in spark.streams.active):
        return "running"
    realtime.start(realtime.source(spark, fetch), spec, where, f"{where}/_checkpoint", name=ingestion(table), period=f"{spec.realtime.get('save.period.minutes', 20)} minutes")
    return "OK"


def update_columns(cat: Catalog, table: str, change: dict, spark) -> str:
    """Add, delete and alter columns of a table's history files and of its specification."""
    spec, where = cat.get(table), f"{cat.location(table)}/hist"
    new = lambda key: [(ColumnSpec(x["name"], x["dataType"]), x["value"]) for x in change.get(key, [])]
    gone, added, altered = [x.lower() for x in change.get("delete", [])], new("add"), new("alter")
    if files.exists(spark, where):
        maintenance.rewrite(spark, where, lambda df: maintenance.alter_columns(maintenance.drop_columns(maintenance.add_columns(df, added), gone), altered))
    by = {x.name.lower(): x for x, _ in altered}
    columns = [by.get(x.name.lower(), x) for x in spec.columns if x.name.lower() not in gone]
    columns += [x for x, _ in added if x.name.lower() not in {y.name.lower() for y in columns}]
    spec.agg.dims = [d for d in spec.agg.dims if d.lower() not in gone]
    spec.agg.metrics = [m for m in spec.agg.metrics if m.name.lower() not in gone]
    cat.put(table, TableSpec(columns, spec.agg, spec.mode, spec.location, spec.realtime))
    return "OK"


if __name__ == "__main__":
    print(run())

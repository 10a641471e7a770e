"""Table specifications: columns, aggregation, realtime settings, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types with their other names, Spark types and values that stand for NULL.
TYPES = {
    "INT": (T.IntegerType(), 0),
    "BIGINT": (T.LongType(), 0),
    "FLOAT": (T.FloatType(), 0.0),
    "DOUBLE": (T.DoubleType(), 0.0),
    "VARCHAR": (T.StringType(), ""),
    "DATE": (T.DateType(), "1970-01-01"),
    "TIME": (T.IntegerType(), 0),  # milliseconds of the day
    "DATETIME": (T.TimestampNTZType(), "1970-01-01 00:00:00"),
}
ALIASES = {"LONG": "BIGINT", "STRING": "VARCHAR", "TIMESTAMP": "DATETIME"}
AGGREGATIONS = ("sum", "min", "max", "first", "last")
NUMERIC = ("INT", "BIGINT", "FLOAT", "DOUBLE")
# Storage modes with their other names.
MODES = {"basic": "basic", "fast": "basic", "balance": "basic", "performance": "basic", "vlt": "vlt", "storage": "vlt"}


def type_name(name: str) -> str:
    up = name.upper()
    up = ALIASES.get(up, up)
    if up not in TYPES:
        raise ValueError(f"unknown column type {name}")
    return up


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    index: bool = field(default=False, compare=False)
    default: object = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "type", type_name(self.type))

    @property
    def spark_type(self) -> T.DataType:
        return TYPES[self.type][0]

    def value(self, given: object) -> Column:
        """A value of this column from its text or number form."""
        if self.type == "TIME" and isinstance(given, str):
            return time_millis(F.lit(given))
        return F.lit(given).cast(self.spark_type)

    def filler(self) -> Column:
        """What stands in for a missing value: the default, or zero of the type."""
        return self.value(self.default if self.default is not None else TYPES[self.type][1])


def time_millis(text: Column) -> Column:
    """Milliseconds of the day from HH:mm:ss[.fraction]; NULL if it isn't one. One-digit hours are read."""
    m = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d+)?\s*$", i)
    n = lambda i: m(i).try_cast("int")
    ms = (n(1) * 3600 + n(2) * 60 + n(3)) * 1000
    frac = F.when(m(4) == "", 0).otherwise(F.floor(F.concat(F.lit("0"), m(4)).try_cast("double") * 1000 + 1e-6)).cast("int")
    return F.when((n(1) < 24) & (n(2) < 60) & (n(3) < 60), ms + frac)


def time_text(millis: Column) -> Column:
    """HH:mm:ss[.fff] from milliseconds of the day."""
    s = F.floor(millis / 1000)
    part = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    frac = F.when(millis % 1000 != 0, F.concat(F.lit("."), F.lpad((millis % 1000).cast("string"), 3, "0"))).otherwise("")
    return F.concat(part(F.floor(s / 3600)), F.lit(":"), part(F.floor(s / 60) % 60), F.lit(":"), part(s % 60), frac)


def parse_text(text: Column, kind: str) -> Column:
    """A column of ``kind`` from text; NULL where the text isn't a value of it."""
    kind = type_name(kind)
    if kind == "VARCHAR":
        return text
    if kind == "DATE":
        return F.try_to_date(F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), F.trim(text)), "yyyy-M-d")
    if kind == "TIME":
        return time_millis(text)
    if kind == "DATETIME":
        return F.try_to_timestamp(F.translate(F.trim(text), "T", " ")).cast("timestamp_ntz")
    return F.trim(text).try_cast(TYPES[kind][0])


@dataclass(frozen=True)
class Metric:
    name: str
    agg: str


@dataclass
class AggSpec:
    grouping: bool = False
    dims: list[str] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)

    @classmethod
    def of(cls, d: dict | None) -> AggSpec:
        d = d or {}
        return cls(bool(d.get("grouping", False)), list(d.get("dims") or []), [Metric(m["name"], m["agg"].lower()) for m in d.get("metrics") or []])

    def to_dict(self) -> dict:
        return {"grouping": self.grouping, "dims": self.dims, "metrics": [{"name": m.name, "agg": m.agg} for m in self.metrics]}


def validate(columns: list[ColumnSpec], agg: AggSpec) -> None:
    """Raise ValueError, with the rule that is broken, unless columns and aggregation fit together."""
    names = [c.name.lower() for c in columns]
    dims, metrics = [d.lower() for d in agg.dims], [m.name.lower() for m in agg.metrics]
    for what, xs in (("column", names), ("dim", dims), ("metric", metrics)):
        if len(set(xs)) < len(xs):
            raise ValueError(f"duplicate {what}")
    if agg.grouping and not dims:
        raise ValueError("grouping needs dims")
    if not agg.grouping and metrics:
        raise ValueError("metrics need grouping")
    if both := set(dims) & set(metrics):
        raise ValueError(f"both dim and metric: {sorted(both)}")
    if missing := (set(dims) | set(metrics)) - set(names):
        raise ValueError(f"no such column: {sorted(missing)}")
    if agg.grouping and (rest := set(names) - set(dims) - set(metrics)):
        raise ValueError(f"neither dim nor metric: {sorted(rest)}")
    kinds = {c.name.lower(): c.type for c in columns}
    for m in agg.metrics:
        if m.agg not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {m.agg}")
        if kinds[m.name.lower()] not in NUMERIC:
            raise ValueError(f"metric {m.name} is not a number")


@dataclass
class TableSpec:
    """A table: columns, mode, aggregation of its files, realtime settings."""

    columns: list[ColumnSpec]
    agg: AggSpec = field(default_factory=AggSpec)
    mode: str = "vlt"
    location: str | None = None
    realtime: dict = field(default_factory=dict)

    def __post_init__(self):
        self.mode = mode_name(self.mode)
        validate(self.columns, self.agg)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True, {"index": c.index, "sql_type": c.type}) for c in self.columns])

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name.lower() == name.lower())

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        """Reads schema.columns (name, dataType, index, default), mode, location, agg, realtime, and the older sort.columns.

        The aggregation is that of ``agg``, else of the realtime settings, else the sort columns without grouping.
        """
        d = json.loads(text)
        cols = [ColumnSpec(c["name"], c.get("dataType") or c.get("type"), bool(c.get("index", False)), c.get("default")) for c in d["schema"]["columns"]]
        realtime = d.get("realtime") or {}
        own = d.get("agg") or ({k: realtime[k] for k in ("grouping", "dims", "metrics") if k in realtime} or None)
        own = own or {"dims": d.get("sort.columns") or []}
        return cls(cols, AggSpec.of(own), d.get("mode", "vlt"), d.get("location"), realtime)

    def to_json(self) -> str:
        cols = [{"name": c.name, "dataType": c.type} | ({"index": True} if c.index else {}) | ({"default": c.default} if c.default is not None else {}) for c in self.columns]
        return json.dumps({"schema": {"columns": cols}, "mode": self.mode, "location": self.location, "agg": self.agg.to_dict(), "realtime": self.realtime}, indent=2)


def mode_name(name: str) -> str:
    if name.lower() not in MODES:
        raise ValueError(f"unknown mode {name}")
    return MODES[name.lower()]

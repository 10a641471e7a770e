"""Events into rows: JSON messages with aliases, defaults, tags and ignore rules.

Works the same on batch and streaming DataFrames of messages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NUMERIC, TableSpec, parse_text

#: Bytes of a string at most; a longer one drops its row.
LONGEST = 65_535


@dataclass
class IngestSpec:
    alias: dict[str, str] = field(default_factory=dict)  # column -> other key
    tag_field: str | None = None
    accept_tags: tuple[str, ...] = ()
    accept_none: bool = False
    empty_as_zero: bool = False
    ignore_empty: bool = False

    @classmethod
    def of(cls, realtime: dict) -> IngestSpec:
        tag = realtime.get("tag.setting") or {}
        fetcher = realtime.get("fetcher") or {}
        return cls(dict(realtime.get("name.alias") or {}), tag.get("tag.field"), tuple(tag.get("accept.tags") or ()), bool(tag.get("accept.none", False)), bool(fetcher.get("number.empty.as.zero", False)), bool(realtime.get("ignoreEmpty", False)))


def messages_to_events(messages: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an object: event map<string,string> and its pos. A message with any bad or nested object gives none."""
    parsed = F.from_json(F.concat(F.lit("["), F.trim(F.regexp_replace(F.col(body), r"^[,\s]+|[,\s]+$", "")), F.lit("]")), "array<map<string,string>>")
    nested = F.exists("__all", lambda m: m.isNull() | F.exists(F.map_values(m), lambda v: F.ltrim(v).rlike(r"^[\[{]")))
    rows = messages.select(*keep, parsed.alias("__all")).where(F.col("__all").isNotNull() & ~nested)
    return rows.select(*keep, F.posexplode("__all").alias("pos", "event"))


def normalise(events: DataFrame, spec: TableSpec, how: IngestSpec | None = None, *, event: str = "event", message: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of the table's columns from event maps.

    A key counts by the column's name, else by its alias. Absent keys become the
    default; a present number that is none (or null, or empty unless empty_as_zero)
    drops the row. Tag filter: the tag field, split at commas, must hold an accepted
    tag; without the field the event stays only with accept_none. ignore_empty drops
    events without any dim, or with grouping without any metric.
    """
    how = how or IngestSpec()
    e = F.col(event)
    has = lambda k: F.coalesce(F.map_contains_key(e, k), F.lit(False))
    cols, good, seen = [], F.lit(True), {}
    for c in spec.columns:
        other = how.alias.get(c.name)
        own = has(c.name)
        present = own | has(other) if other else own
        raw = F.when(own, F.element_at(e, c.name)).otherwise(F.element_at(e, other) if other else F.lit(None).cast("string"))
        seen[c.name.lower()] = present
        if c.type in NUMERIC and how.empty_as_zero:
            raw = F.when(F.trim(raw) == "", F.lit("0")).otherwise(raw)
        value = parse_text(raw, c.type)
        if c.type == "VARCHAR":
            value = F.coalesce(raw, F.lit(""))
            good = good & (~present | (F.octet_length(value) <= LONGEST))
        else:
            good = good & (~present | value.isNotNull())
        cols.append(F.when(present, value).otherwise(c.filler()).cast(c.spark_type).alias(c.name))
    out = events.where(F.coalesce(good, F.lit(False)))
    if how.tag_field:
        tags = F.transform(F.split(F.element_at(e, how.tag_field), ","), F.trim)
        accepted = F.arrays_overlap(tags, F.array(*map(F.lit, how.accept_tags))) if how.accept_tags else F.lit(False)
        out = out.where(F.when(has(how.tag_field), F.coalesce(accepted, F.lit(False))).otherwise(F.lit(how.accept_none)))
    if how.ignore_empty:
        some = lambda names: any_of([seen[n.lower()] for n in names])
        if spec.agg.dims:
            out = out.where(some(spec.agg.dims))
        if spec.agg.grouping and spec.agg.metrics:
            out = out.where(some([m.name for m in spec.agg.metrics]))
    return out.select(*keep, *cols)


def any_of(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def ingest_json(messages: DataFrame, spec: TableSpec, how: IngestSpec | None = None, *, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """From messages of JSON objects to rows, with the columns of ``keep`` and the object's place in its message (_pos)."""
    ev = messages_to_events(messages, body, keep).withColumnRenamed("pos", "_pos")
    return normalise(ev, spec, how, keep=(*keep, "_pos"))


def csv_messages(lines: DataFrame, header: list[str], sep: str = ",", body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV lines as event maps; empty fields count as absent."""
    parts = F.split(F.col(body), sep if sep not in "|.*+?^$()[]{}\\" else "\\" + sep, -1)
    pairs = F.filter(F.zip_with(F.array(*map(F.lit, header)), parts, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda p: p["key"].isNotNull() & (F.coalesce(p["value"], F.lit("")) != ""))
    return lines.select(*keep, F.map_from_entries(pairs).alias("event"))

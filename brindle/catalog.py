"""A catalog of tables in a folder of JSON files, and plugins."""

from __future__ import annotations

import json
import uuid
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import schema
from .plans.rql import rql
from .schema import TableSpec, mode_name
from .sources import files, storage
from .streaming import realtime


class Catalog:
    """Declared tables: <root>/tables/<name>.json; which node runs a table's realtime part: <root>/realtime.json."""

    def __init__(self, root: str):
        self.root = Path(root)
        (self.root / "tables").mkdir(parents=True, exist_ok=True)

    def _file(self, name: str) -> Path:
        return self.root / "tables" / f"{name}.json"

    def tables(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "tables").glob("*.json"))

    def get(self, name: str) -> TableSpec:
        if not self._file(name).exists():
            raise KeyError(f"no table {name}")
        return TableSpec.from_json(self._file(name).read_text())

    def put(self, name: str, spec: TableSpec) -> None:
        self._write(self._file(name), spec.to_json())

    @staticmethod
    def _write(file: Path, text: str) -> None:
        """Moved into place, so that a reader sees the old or the new text."""
        new = file.with_name(f"{file.name}.{uuid.uuid4().hex}.new")
        new.write_text(text)
        new.replace(file)

    def remove(self, name: str) -> None:
        self._file(name).unlink(missing_ok=True)
        for node in self.nodes(name):
            self.remove_node(name, node)

    def set_mode(self, name: str, mode: str) -> None:
        """Metadata only; files written later follow it."""
        spec = self.get(name)
        spec.mode = mode_name(mode)
        self.put(name, spec)

    def location(self, name: str) -> str:
        return self.get(name).location or str(self.root / "data" / name)

    def _rt(self) -> dict:
        f = self.root / "realtime.json"
        return json.loads(f.read_text()) if f.exists() else {}

    def nodes(self, name: str | None = None) -> list[str]:
        return sorted(self._rt().get(name, [])) if name else sorted({n for ns in self._rt().values() for n in ns})

    def tables_of(self, node: str) -> list[str]:
        return sorted(t for t, ns in self._rt().items() if node in ns)

    def add_node(self, name: str, node: str) -> None:
        rt = self._rt()
        rt[name] = sorted({*rt.get(name, []), node})
        self._write(self.root / "realtime.json", json.dumps(rt))

    def remove_node(self, name: str, node: str) -> None:
        rt = self._rt()
        rt[name] = [n for n in rt.get(name, []) if n != node]
        self._write(self.root / "realtime.json", json.dumps(rt))

    def history_files(self, spark: SparkSession, name: str, side: str = "hist") -> list[str]:
        where = self.location(name)
        return sorted(f"{where}/{side}/{realtime.GROUP}={g}/{x}" for g in realtime.groups(spark, where, side) for x in files.children(spark, f"{where}/{side}/{realtime.GROUP}={g}") if x.endswith(".parquet"))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return realtime.hybrid(spark, self.location(name), self.get(name))

    def query(self, spark: SparkSession, text: str, **options) -> DataFrame:
        return rql(text, lambda name: self.read(spark, name), **options)


def load_plugins(group: str = "brindle.plugins") -> list[str]:
    """Call every registered plugin; one may register modes with ``register_mode``."""
    done = []
    for e in entry_points(group=group):
        e.load()()
        done.append(e.name)
    return done


def register_mode(name: str, like: str = "basic", options: dict | None = None) -> None:
    schema.MODES[name.lower()] = name.lower() if options else mode_name(like)
    if options:
        storage.MODE_OPTIONS[name.lower()] = options

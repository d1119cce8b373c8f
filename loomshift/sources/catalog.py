"""Catalogs: what a side's tables look like, from Parquet schemas and a constraint manifest next to them.

A manifest is a JSON object: table name -> {primary_key, unique, foreign_keys: [{name, columns, parent, parent_columns,
trusted}], checks, not_null, identity, computed, rowversion, max_length, triggers, temporal, heap, collation, types, defaults}.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that tools leave in a database.
TOOL_TABLES = re.compile(r"^(sysdiagrams$|__)")


@dataclass
class Column:
    name: str
    ordinal: int
    data_type: str
    nullable: bool = True
    identity: bool = False
    computed: bool = False
    rowversion: bool = False
    max_length: int = 0
    collation: str | None = None
    description: str | None = None
    default: str | None = None


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    trusted: bool = True


@dataclass
class Table:
    key: str
    columns: list[Column]
    rows: int | None = None
    size_mb: float | None = None
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    triggers: list[str] = field(default_factory=list)
    temporal: str | None = None
    heap: bool = False

    def best_key(self) -> list[str] | None:
        """The primary key, or the first unique index without a nullable column."""
        if self.primary_key:
            return self.primary_key
        required = {c.name for c in self.columns if not c.nullable}
        return next((u for u in self.unique if set(u) <= required), None)


@dataclass
class Catalog:
    side: str
    tables: dict[str, Table]
    server: dict = field(default_factory=dict)


def size_mb(spark: SparkSession, path: str) -> float | None:
    """What a table's files take, by the file system; None where it does not say."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return round(system.getContentSummary(where).getLength() / 1e6, 3)
    except Py4JJavaError:
        return None


def read_catalog(spark: SparkSession, side: str, folder: str, manifest: dict, count_rows: bool = True) -> Catalog:
    """The catalog of the manifest's tables, each ``folder/<table>.parquet``. Counts come from the files' footers."""
    tables = {}
    for name, told in sorted(manifest.items()):
        if TOOL_TABLES.search(name):
            continue
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        required, lengths = set(told.get("not_null", [])) | set(told.get("primary_key", [])), told.get("max_length", {})
        columns = [Column(f.name, k, told.get("types", {}).get(f.name, f.dataType.simpleString()), f.name not in required, f.name in told.get("identity", []), f.name in told.get("computed", []), f.name in told.get("rowversion", []), lengths.get(f.name, 0), told.get("collation", {}).get(f.name), default=told.get("defaults", {}).get(f.name)) for k, f in enumerate(df.schema.fields)]
        keys = [ForeignKey(k.get("name", f"FK{n}"), k["columns"], k["parent"], k["parent_columns"], k.get("trusted", True)) for n, k in enumerate(told.get("foreign_keys", []))]
        tables[name] = Table(name, columns, df.count() if count_rows else None, size_mb(spark, f"{folder}/{name}.parquet"), told.get("primary_key", []), told.get("unique", []), keys, told.get("checks", []), told.get("triggers", []), told.get("temporal"), told.get("heap", False))
    return Catalog(side, tables, {"version": spark.version, "major": int(spark.version.split(".")[0])})


def fingerprint(catalog: Catalog) -> str:
    """SHA-256 of the structure: what profiles, counts and trust flags say does not matter, nor the order of tables and indexes."""

    def bare(table: Table) -> dict:
        out = asdict(table)
        for k in ("rows", "size_mb"):
            out.pop(k)
        out["columns"] = [{k: v for k, v in c.items() if k != "description"} for c in out["columns"]]
        out["foreign_keys"] = sorted(({k: v for k, v in f.items() if k != "trusted"} for f in out["foreign_keys"]), key=lambda f: f["name"])
        out["unique"] = sorted(out["unique"])
        return out

    shape = [bare(catalog.tables[k]) for k in sorted(catalog.tables)]
    return hashlib.sha256(json.dumps(shape, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def catalog_json(catalog: Catalog) -> dict:
    """A catalog as it is stored."""
    return asdict(catalog)


def catalog_of(told: dict) -> Catalog:
    """A stored catalog."""
    tables = {}
    for key, t in told["tables"].items():
        parts = {"columns": [Column(**c) for c in t["columns"]], "foreign_keys": [ForeignKey(**k) for k in t["foreign_keys"]]}
        tables[key] = Table(**{**t, **parts})
    return Catalog(told["side"], tables, told["server"])


def drifted(saved: str | None, current: Catalog | None) -> bool:
    """False without a saved fingerprint; an error, never "no drift", without a current catalog to compare with."""
    if saved is None:
        return False
    if current is None:
        raise ConnectionError("the catalog cannot be read, so drift is unknown")
    return fingerprint(current) != saved


def columns_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(catalog.side, t.key, c.name, c.ordinal, c.data_type, c.nullable) for t in catalog.tables.values() for c in t.columns]
    return spark.createDataFrame(rows, "side string, table_key string, column string, ordinal int, data_type string, nullable boolean")


def orphans(child: DataFrame, key: ForeignKey, parent: DataFrame) -> DataFrame:
    """The key columns of the child rows that have all of these and no parent."""
    wanted = parent.select(*(F.col(p).alias(c) for p, c in zip(key.parent_columns, key.columns)))
    return child.select(*key.columns).dropna().join(wanted, key.columns, "left_anti")


def orphan_count(child: DataFrame, key: ForeignKey, parent: DataFrame) -> int:
    return orphans(child, key, parent).count()

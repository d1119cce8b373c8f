"""Constraints of a target table from its catalog, and the parents that its store holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.load import Constraints, ForeignKey
from ..sources.catalog import Catalog, Table
from .plan import Plan, Task
from .store import Store

#: Types that a value may fail to be cast to.
CAST = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")


def _parent(spark: SparkSession, store: Store, table: Table) -> DataFrame:
    """What the store holds of a table; no rows where it holds nothing."""
    there = store.read(table.key)
    if there is not None:
        return there
    return spark.createDataFrame([], ", ".join(f"`{c.name}` {c.data_type if c.data_type in CAST else 'string'}" for c in table.columns))


def constraints_of(spark: SparkSession, store: Store, target: Catalog, task: Task, plan: Plan) -> Constraints:
    """What the target demands of a task's rows. Foreign keys that the load order cut are verified after the load instead."""
    table = target.tables[task.target]
    loaded = {c.name: c for c in table.columns if c.name in task.columns}
    keys = [k for k in table.foreign_keys if set(k.columns) <= set(loaded) and (table.key, k.parent) not in plan.cut and k.parent != table.key]
    return Constraints(
        types={c.name: c.data_type for c in loaded.values() if c.data_type in CAST},
        max_length={c.name: c.max_length for c in loaded.values() if c.max_length > 0},
        not_null=[c.name for c in loaded.values() if not c.nullable],
        checks=table.checks,
        foreign_keys=[ForeignKey(k.columns, _parent(spark, store, target.tables[k.parent]), k.parent_columns, k.name) for k in keys],
        primary_key=table.primary_key if set(table.primary_key) <= {*loaded, task.identity} else [],
    )


def rules_from(spark: SparkSession, target: Catalog, plan: Plan):
    """The rules_of that ``run_plan`` takes."""
    return lambda task, store: constraints_of(spark, store, target, task, plan)

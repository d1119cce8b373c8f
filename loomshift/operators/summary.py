"""Sums that a report gives of tables, findings and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a load is reckoned to copy in a second.
ROWS_A_SECOND = 50_000


def minutes(rows: Column) -> Column:
    """Up to the next tenth of a minute."""
    return (F.ceil(rows / ROWS_A_SECOND / 60 * 10) / 10).cast("double")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_key, rows) of every table, each counted by itself."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(key).alias("table_key"), "rows") for key, df in tables.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionAll(one)
    return out


def volume_estimate(counts: DataFrame) -> DataFrame:
    """(rows, minutes) over (table_key, rows)."""
    return counts.agg(F.sum("rows").alias("rows"), minutes(F.sum("rows")).alias("minutes"))


def database_summary(counts: DataFrame) -> DataFrame:
    """(tables, rows, empty, largest) over (table_key, rows); of equally large tables the first by name."""
    return counts.agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.count(F.when(F.col("rows") == 0, 1)).alias("empty"), F.max_by("table_key", F.struct("rows", F.expr("-ascii(table_key)"))).alias("largest"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def by_rule(findings: DataFrame, examples: int = 3) -> DataFrame:
    """(rule, findings, examples): the first objects of each rule by name."""
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("object"))
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= examples, F.col("object"))))
    return findings.withColumn("rank", rank).groupBy("rule").agg(F.count("*").alias("findings"), few.alias("examples"))


def largest(rows: DataFrame, by: str, size: Column, most: int = 15) -> DataFrame:
    """The keys with the largest sums of size, and how many rows each has; the limit is the report's."""
    return rows.groupBy(by).agg(F.round(F.sum(size), 2).alias("total"), F.count("*").alias("lines")).orderBy(F.desc("total"), by).limit(most)


def latest(rows: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """Of each key the row with the highest order."""
    return rows.groupBy(by).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in columns))


def first_of_each(rows: DataFrame, by: str, order: Column, name: str, most: int) -> DataFrame:
    """At most so many rows of each key, numbered in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col(name) <= most)


def least_child(parents: DataFrame, key: str, children: DataFrame, child_key: str, value: str, name: str) -> DataFrame:
    """parents with the least value of their children; null without any."""
    first = children.groupBy(F.col(child_key).alias("__child")).agg(F.min(value).alias(name))
    return parents.join(first, F.col(key) == F.col("__child"), "left").drop("__child")

"""Reconciling source and target after a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(value: Column) -> Column:
    """The first eight hex digits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")


def column_checksums(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """(column, values, checksum): order-independent sums over the values cast to the target's types; nulls add nothing."""
    cast = lambda c: F.expr(f"try_cast(`{c}` as {types[c]})") if types and c in types else F.col(c)
    one = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(cast(c)).alias(f"n{i}"), F.sum(text_hash(cast(c))).alias(f"s{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("values"), F.col(f"s{i}").alias("checksum")) for i, c in enumerate(columns)))))


def compare_checksums(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column, matched): sums that are both null match."""
    t = target.select(F.col("column"), F.col("values").alias("t_values"), F.col("checksum").alias("t_checksum"))
    return source.join(t, "column", "full").select("column", (F.col("checksum").eqNullSafe(F.col("t_checksum")) & F.col("values").eqNullSafe(F.col("t_values"))).alias("matched"))


def row_diff(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """(side, rows): rows of either side that the other does not have, as sets. Both sides are grouped once, together."""
    here, there = (df.select(*columns, F.lit(side).alias("__side")) for df, side in ((source, "source"), (target, "target")))
    only = here.union(there).groupBy(*columns).agg(F.min("__side").alias("a"), F.max("__side").alias("b")).where("a = b")
    found = only.agg(*(F.count(F.when(F.col("a") == side, 1)).alias(side) for side in ("source", "target")))
    return found.select(F.inline(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("rows")) for side in ("source", "target")))))


def count_match(source: int | None, rejected: int, before: int | None, after: int | None) -> tuple[bool | None, str | None]:
    """(matched, note): unknown, and said why, unless every number is known. A missing number is never zero."""
    missing = [n for n, v in (("source", source), ("before", before), ("after", after)) if v is None]
    if missing:
        return None, f"not compared: {', '.join(missing)} unknown"
    return source - rejected == after - before, None


def checksum_gate(enabled: bool, finished: bool, before: int | None, rejected: int) -> str | None:
    """Why checksums are skipped, or None."""
    if not enabled:
        return "disabled"
    if not finished:
        return "the task did not finish"
    if before is None:
        return "the row count before the run is unknown"
    if before:
        return "the target held rows before the run"
    return "rows were rejected" if rejected else None

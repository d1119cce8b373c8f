"""Loading with reject isolation.

Constraints are evaluated as predicates and joins in one pass, so the cost of rejects does not depend on how many there are.
Of several faults of a row the first counts, in the order conversion, truncation, not_null, check, fk, duplicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import key_json
from ..sources.scratch import durable

#: The error numbers of faults that are a row's own; others have none.
NUMBERS = {"check": 547, "fk": 547, "duplicate": 2627}
SMALL_CHUNK, SMALL_CHUNKS = 1000, 3


@dataclass
class ForeignKey:
    columns: list[str]
    parent: DataFrame
    parent_columns: list[str]
    name: str = "fk"


@dataclass
class Constraints:
    """What a target table demands. Checks are SQL conditions; one that is null passes."""

    types: dict[str, str] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)


def convert(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with columns cast, and __conversion where a value is lost by that."""
    lost = [F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull() for c, t in types.items()]
    df = df.withColumn("__conversion", reduce(lambda a, b: a | b, lost, F.lit(False)))
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in types.items()})


def fault_of(rules: Constraints) -> Column:
    """The first row-local fault; null if there is none."""
    out = F.when(F.col("__conversion"), "conversion")
    if rules.max_length:
        out = out.when(reduce(lambda a, b: a | b, (F.length(F.rtrim(c)) > n for c, n in rules.max_length.items())), "truncation")
    if rules.not_null:
        out = out.when(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in rules.not_null)), "not_null")
    if rules.checks:
        out = out.when(reduce(lambda a, b: a | b, (~F.coalesce(F.expr(c), F.lit(True)) for c in rules.checks)), "check")
    return out


def mark_rejects(df: DataFrame, rules: Constraints, chunk_key: list[str], existing: DataFrame | None = None) -> DataFrame:
    """df converted, with a column ``reason``: null for rows that load.

    A foreign key with a null column is not checked. Of rows with equal primary key the first in chunk-key order loads, of
    those that pass everything else, unless the key is in ``existing``.
    """
    rows = convert(df, rules.types).withColumn("reason", fault_of(rules)).drop("__conversion")
    for n, fk in enumerate(rules.foreign_keys):
        parent = fk.parent.select(*(F.col(p).alias(f"__p{n}_{k}") for k, p in enumerate(fk.parent_columns))).distinct().withColumn(f"__found{n}", F.lit(True))
        same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{n}_{k}") for k, c in enumerate(fk.columns)))
        given = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fk.columns))
        rows = rows.join(parent, same, "left").withColumn("reason", F.coalesce("reason", F.when(given & F.col(f"__found{n}").isNull(), "fk")))
        rows = rows.drop(f"__found{n}", *(f"__p{n}_{k}" for k in range(len(fk.columns))))
    if rules.primary_key:
        # rows already at fault stand after all others of their key, so they take nobody's place
        order = Window.partitionBy(*rules.primary_key).orderBy(F.col("reason").isNotNull(), *chunk_key)
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(order) > 1), "duplicate").otherwise(F.col("reason")))
        if existing is not None:
            there = existing.select(*(F.col(c).alias(f"__t_{c}") for c in rules.primary_key)).distinct().withColumn("__there", F.lit(True))
            same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__t_{c}") for c in rules.primary_key))
            rows = rows.join(there, same, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__there"), "duplicate"))).drop("__there", *(f"__t_{c}" for c in rules.primary_key))
    return rows


def accepted(marked: DataFrame) -> DataFrame:
    return marked.where("reason is null").drop("reason")


def rejects(marked: DataFrame, chunk_key: list[str]) -> DataFrame:
    """(key_json, row_json, reason, number) of the rows that do not load; values are cut at 200 characters."""
    values = [F.substring(F.col(c).cast("string"), 1, 200).alias(c) for c in marked.columns if c != "reason"]
    number = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))[F.col("reason")]
    return marked.where("reason is not null").select(key_json(chunk_key).alias("key_json"), F.to_json(F.struct(*values)).alias("row_json"), "reason", number.alias("number"))


def reject_summary(rejected: DataFrame) -> DataFrame:
    """(number, reason, rows): null numbers are a group of their own."""
    return rejected.groupBy("number", "reason").agg(F.count("*").alias("rows"))


def most_common_number(rejected: DataFrame) -> DataFrame:
    """The error number of the most rows; ties go to the lowest, and no number wins only with strictly more."""
    return rejected.groupBy("number").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.col("number").isNull(), "number").limit(1)


def chunk_of(rn: Column, size: int) -> Column:
    """The chunk of the rn-th row: the first three are small, so that a bad plan shows early."""
    small = min(size, SMALL_CHUNK)
    first = SMALL_CHUNKS * small
    return F.when(rn <= first, F.ceil(rn / small)).otherwise(SMALL_CHUNKS + F.ceil((rn - first) / size)).cast("long")


def row_numbers(df: DataFrame, keys: list[str], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 1 in key order, without a task that sees them all.

    Ranges of the key are stored once, each row with its range and its place in it; the offsets come from those stored rows,
    so both sides speak of the same ranges. What is broadcast has a row a range.
    """
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    placed = durable(ranged.sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__part").alias("__range"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = placed.join(F.broadcast(before), part == F.col("__range"))
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn(name, place + 1 + F.col("__before")).drop("__place", "__range", "__before")


def assert_accounted(attempted: int, loaded: int, failed: int) -> None:
    if attempted != loaded + failed:
        raise AssertionError(f"{attempted} rows were attempted, {loaded} loaded and {failed} failed")

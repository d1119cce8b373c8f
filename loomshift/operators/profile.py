"""Column profiles: counts, bounds, lengths, value shapes and semantic classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import semantic_class, shortened, text_length, value_pattern

#: Columns that one aggregate covers, sampled rows, and rows that shapes are taken from.
BATCH, SAMPLE_ROWS, PATTERN_ROWS = 100, 100_000, 1000


def sample(df: DataFrame, rows: int = SAMPLE_ROWS, keys: list[str] | None = None) -> DataFrame:
    """The first rows; with keys the same ones every time, by a bounded heap in each partition."""
    return df.orderBy(*keys).limit(rows) if keys else df.limit(rows)


def bound(value, kind: str):
    """A bound as text: bits as numbers, bytes in hexadecimal digits."""
    if kind == "boolean":
        return value.cast("tinyint").cast("string")
    return F.concat(F.lit("0x"), F.hex(value)) if kind == "binary" else value.cast("string")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values): values of all columns one under another, so a row grows by its values and no more.

    Zeros of either sign are one value.
    """
    kinds = dict(df.dtypes)
    plain = df.select(*((F.col(c) + 0.0 if kinds[c] in ("float", "double") else F.col(c)).alias(c) for c in columns))
    return long_values(plain, columns).groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("distinct_values"))


def column_profiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: column, sampled_rows, nulls, distinct_values, min_text, max_text, max_len, avg_len.

    All columns of a batch come from one aggregate over one scan, but for the distinct values; the long form is made from
    its single row.
    """
    columns, kinds = columns or df.columns, dict(df.dtypes)
    parts = []
    for k in range(0, len(columns), BATCH):
        some = columns[k : k + BATCH]
        text = {c: df.schema[c].dataType.simpleString() == "string" for c in some}
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(some):
            aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls{i}"), bound(F.min(c), kinds[c]).alias(f"min{i}"), bound(F.max(c), kinds[c]).alias(f"max{i}")]
            if text[c]:
                aggs += [F.max(text_length(F.col(c))).alias(f"len{i}"), F.round(F.avg(text_length(F.col(c))), 6).alias(f"avg{i}")]
        rows = []
        for i, c in enumerate(some):
            lengths = [(F.col(f"{n}{i}") if text[c] else F.lit(None)).cast(kind).alias(name) for n, kind, name in (("len", "int", "max_len"), ("avg", "double", "avg_len"))]
            bounds = [shortened(F.col(f"{n}{i}")).alias(f"{n}_text") for n in ("min", "max")]
            rows.append(F.struct(F.lit(c).alias("column"), F.col("n").alias("sampled_rows"), F.col(f"nulls{i}").alias("nulls"), *bounds, *lengths))
        one = df.agg(*aggs).select(F.inline(F.array(*rows)))
        # a row a column on both sides
        parts.append(one.join(F.broadcast(distinct_counts(df, some)), "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long"))))
    order = ["column", "sampled_rows", "nulls", "distinct_values", "min_text", "max_text", "max_len", "avg_len"]
    return reduce(DataFrame.unionByName, parts).select(*order)


def with_ratios(profiles: DataFrame) -> DataFrame:
    n = F.col("sampled_rows")
    return profiles.withColumn("null_ratio", F.when(n == 0, 0.0).otherwise(F.col("nulls") / n)).withColumn("distinct_ratio", F.when(n > 0, F.col("distinct_values") / n))


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with values as text; null values are left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value is not null")


def top_patterns(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(column, pattern, n, rank): the k most frequent shapes of the first 64 characters, ties by the shape."""
    counted = long_values(df, columns).where("trim(value) <> ''").groupBy("column", value_pattern(F.substring("value", 1, 64)).alias("pattern")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "pattern"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def pattern_rows(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """The rows that shapes are taken from: the first so many, as texts of at most 200 characters."""
    return sample(df, PATTERN_ROWS, keys).select(*(F.substring(F.col(c).cast("string"), 1, 200).alias(c) for c in columns))


def first_samples(df: DataFrame, column: str, keys: list[str], k: int = 3) -> DataFrame:
    """The first k different non-empty values in key order."""
    place = F.struct(*keys)
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.min(place).alias("place")).orderBy("place").limit(k).select(F.col(column).alias("value"))


def semantic_classes(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*(semantic_class(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("class")) for i, c in enumerate(columns)))))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def has_duplicate_key(df: DataFrame, keys: list[str]) -> bool:
    return bool(duplicate_keys(df, keys).take(1))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant,
and a variant has at most as many fingerprints as its own ball, so no group grows with the data however many copies a
document has. Pairs that meet are deduplicated, verified by their differing bits and merged into components.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, field, packed
from .components import connected_components

SEED = 42


def fingerprint(text: str | None, width: int = 3, fold_case: bool = True) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 for a text without words."""
    data = (text or "").encode("utf-8")
    words = (data.lower() if fold_case else data).split()  # bytes: folds A-Z only and splits on the six ASCII blanks
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else iter([words])
    ones, total = np.zeros(64, dtype=np.int64), 0
    while part := [digest(join(x), SEED) for x in islice(shingles, 65536)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > total))


def fingerprints(docs: DataFrame, width: int = 3, fold_case: bool = True) -> DataFrame:
    """(doc_id, row, fingerprint): row is a hash of the text, the fingerprint a signed long."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, width, fold_case) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["doc_id", "row", "fingerprint"])

    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return named.mapInArrow(run, "doc_id long, row long, fingerprint long")


def ball_masks(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed longs, in order of their bits."""
    masks = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) node ids of the distinct fingerprints in ``prints`` (node, fingerprint) that differ in 1..radius bits."""
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks((radius + 1) // 2)))
    spread = prints.select("node", "fingerprint", F.explode(masks).alias("mask")).select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), F.struct("node", "fingerprint").alias("one"))
    # At most as many entries as the ball has fingerprints, 65 for radius 2: the list is bounded.
    met = spread.groupBy("variant").agg(F.sort_array(F.collect_list("one")).alias("all")).where(F.size("all") > 1)
    met = met.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    met = met.where((F.col("x.node") < F.col("y.node")) & (F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= radius))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _components(docs: DataFrame, width: int, radius: int, fold_case: bool) -> DataFrame:
    """(doc_id, row, fingerprint, component_id) for every row of docs."""
    prints = cut(fingerprints(docs, width, fold_case))
    # dealt out anew, as each fingerprint grows to all its variants in the next step
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "fingerprint"))
    members = connected_components(fingerprint_links(nodes.where("node is not null"), radius))
    named = nodes.join(members, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "row", "fingerprint", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, fold_case: bool = True) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint is 16 lowercase hex digits, component_id the smallest doc_id that links reach, itself included.
    Null and blank texts have fingerprint zero and link like any other. Repeated rows come back as often as they came.
    A null doc_id keeps its row; it takes part under the other ids of its fingerprint and has a null component if alone.
    Other columns of docs are ignored; an empty table gives an empty result. Texts may be of any length.
    """
    out = _components(docs, width, radius, fold_case)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, one row of each component: that with the smallest doc_id.

    Of several texts of that doc_id the one with the smallest hash stays, and of rows equal in both the first by the other
    columns. Rows without doc_id cannot be named as anyone's copy and stay. The columns of docs stay as they are, whatever
    their names.
    """
    found = _components(docs, width, radius, True).where("doc_id is not null")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row"), F.lit(True).alias("keep"))
    rows = packed(docs, docs.columns, doc=F.col("doc_id").cast("long"), row=F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(keep, ["doc", "row"], "left").where("keep or doc is null")
    others = F.to_json(F.struct(*(field(c) for c in docs.columns if c.lower() != "text")))
    copy = F.row_number().over(Window.partitionBy("doc", "row").orderBy(others))
    return kept.withColumn("copy", copy).where("copy = 1 or doc is null").select(*(field(c) for c in docs.columns))

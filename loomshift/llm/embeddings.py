"""Near-duplicate vectors by an exact metric range join.

Vectors of equal components are one class. Pivots, chosen farthest first from a bounded sample, split the unit sphere into
cells of nearest pivot. By the triangle inequality a vector can link into another cell only if the plane between the two
pivots is within the range, so it is replicated to just those cells. A cell then joins on its own: its vectors against all
that are in or near it. Cells are cut into blocks of bounded size, so no task grows with a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Vectors that pivots are chosen from; pivots at most; vectors of a cell aimed at; vectors of a block.
SAMPLE, MAX_PIVOTS, CELL, BLOCK = 2048, 1024, 8192, 8192
SLACK = 1e-9


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of equal length, scaled to length one in double precision."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, matrix of the cells each belongs to or can link into); reach: the range as a distance."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    # y of cell j has y.p_j >= y.p_home; |x - y| <= reach then gives x.p_home - x.p_j <= reach * |p_home - p_j|
    into = near[np.arange(len(x)), home][:, None] - near <= reach * gap[home] + SLACK
    return home, into


def block_links(homes: np.ndarray, others: np.ndarray, min_cosine: float, step: int = 1024):
    """Yield (rows of homes, rows of others) of the pairs with cosine of at least min_cosine: single precision rejects what is far below, double precision decides."""
    h32, o32 = homes.astype(np.float32), others.astype(np.float32)
    slack = np.float32(min_cosine - 1e-6 * (8 + homes.shape[1] ** 0.5))
    for k in range(0, len(homes), step):
        rows, cols = np.nonzero(h32[k : k + step] @ o32.T >= slack)
        rows += k
        for m in range(0, len(rows), 1 << 18):
            r, c = rows[m : m + (1 << 18)], cols[m : m + (1 << 18)]
            good = np.einsum("ij,ij->i", homes[r], others[c]) >= min_cosine
            yield r[good], c[good]


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give both ends of each pair, and all that shares their labels, the smallest label; in place."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _packed(vectors: DataFrame) -> DataFrame:
    """(node, weight, vec as little-endian doubles) from (node, weight, vec array<double>)."""

    def run(batches):
        for batch in batches:
            column = batch.column("vec")
            ends = np.asarray(column.offsets) * 8
            data = np.asarray(column.values, dtype="<f8").tobytes()
            raw = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array(raw, pa.binary())], ["node", "weight", "vec"])

    return vectors.mapInArrow(run, "node long, weight long, vec binary")


def _by_length(raw: list[bytes]) -> dict[int, np.ndarray]:
    lengths = np.array([len(r) // 8 for r in raw])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def range_join(classes: DataFrame, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (node long, weight long, vec binary): how many rows of other nodes each links with, and links.

    Returns (node, n_links) and (a, b). The links are those of a spanning forest of each block: they connect what links
    connect, and there are fewer of them than vectors in the block however dense it is. Vectors of different lengths
    never link.
    """
    spark = classes.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    total = classes.count()
    wanted = max(1, min(MAX_PIVOTS, round(total / CELL)))
    sample = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").collect()]
    pivots = {n: farthest_first(unit([sample[i] for i in rows]), wanted) for n, rows in _by_length(sample).items()} if sample else {}
    known = spark.sparkContext.broadcast(pivots)

    def assigned(raw):
        """(rows, length of their vectors, home, into) for each length."""
        for n, rows in _by_length(raw).items():
            if n in known.value:
                yield rows, n, *cells_of(unit([raw[i] for i in rows]), known.value[n], reach)
            else:  # a length that the sample does not have is one cell
                yield rows, n, np.zeros(len(rows), int), np.ones((len(rows), 1), bool)

    def count(batches):
        for batch in batches:
            for _, n, home, into in assigned(batch.column("vec").to_pylist()):
                k = into.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(n * MAX_PIVOTS + np.arange(k)), pa.array(np.bincount(home, minlength=k)), pa.array(into.sum(axis=0))], ["cell", "homes", "members"])

    sizes = classes.mapInArrow(count, "cell long, homes long, members long").groupBy("cell").agg(F.sum("homes"), F.sum("members")).collect()
    cuts = spark.sparkContext.broadcast({r[0]: (-(-r[1] // BLOCK), -(-r[2] // BLOCK)) for r in sizes})

    def spread(batches):
        for batch in batches:
            node, weight, raw = np.asarray(batch.column("node")), np.asarray(batch.column("weight")), batch.column("vec").to_pylist()
            out = [[] for _ in range(5)]  # cell, home block, other block, is home, row
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for rows, n, home, into in assigned(raw):
                for i, h, cells in zip(rows.tolist(), home.tolist(), into):
                    for j in np.flatnonzero(cells).tolist():
                        cell = n * MAX_PIVOTS + j
                        a_blocks, b_blocks = cuts.value[cell]
                        mine = int(mixed[i])
                        places = [(a, mine % b_blocks, False) for a in range(a_blocks)]
                        if j == h:
                            places += [(mine % a_blocks, b, True) for b in range(b_blocks)]
                        for a, b, is_home in places:
                            for column, value in zip(out, (cell, a, b, is_home, i)):
                                column.append(value)
            rows = out[4]
            for k in range(0, len(rows), 20000):
                part = rows[k : k + 20000]
                arrays = [pa.array(out[c][k : k + 20000]) for c in range(4)]
                arrays += [pa.array(node[part]), pa.array(weight[part]), pa.array([raw[i] for i in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "a", "b", "home", "node", "weight", "vec"])

    def join(frame):
        import pandas as pd

        home, other = frame[frame["home"]], frame[~frame["home"]]
        if home.empty or other.empty:
            return pd.DataFrame({"node": [], "links": [], "other": []})
        x, y = unit(home["vec"].tolist()), unit(other["vec"].tolist())
        x_node, y_node, weight = (c.to_numpy() for c in (home["node"], other["node"], other["weight"]))
        names, index = np.unique(np.concatenate((x_node, y_node)), return_inverse=True)
        x_at, y_at = index[: len(x_node)], index[len(x_node) :]
        labels, links = np.arange(len(names)), np.zeros(len(x_node), np.int64)
        for r, c in block_links(x, y, min_cosine):
            own = x_node[r] == y_node[c]
            r, c = r[~own], c[~own]
            links += np.bincount(r, weights=weight[c], minlength=len(links)).astype(np.int64)
            merge_labels(labels, x_at[r], y_at[c])
        found, below = links > 0, np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"node": np.concatenate((x_node[found], names[below])), "links": np.concatenate((links[found], np.zeros(len(below), np.int64))), "other": pd.array([pd.NA] * int(found.sum()) + names[labels[below]].tolist(), dtype="Int64")})

    placed = classes.mapInArrow(spread, "cell long, a long, b long, home boolean, node long, weight long, vec binary")
    met = cut(placed.groupBy("cell", "a", "b").applyInPandas(join, "node long, links long, other long"))
    return met.groupBy("node").agg(F.sum("links").alias("n_links")), met.where("other is not null").select(F.col("other").alias("a"), F.col("node").alias("b"))


def embedding_near_dedup(vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows whose cosine with this one, in double precision, is at least min_cosine; component_id is
    the smallest id that links reach, the row's own included; kept marks vec_id = component_id. Vectors that are null,
    empty or zero, hold null or non-finite components, or have no id, link with nothing; without an id the component is null
    and the row not kept. Equal vectors link with each other; repeated rows count as rows, and rows of one id
    with different vectors are judged on their own. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("vec"))).withColumn("hash", F.xxhash64("vec"))
    valid = rows.where("vec is not null")
    # classes have numbers of their own, as an id may come with several vectors; the checkpoint keeps the numbers
    named = cut(valid.groupBy("hash", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    packed = cut(_packed(named.select("node", "weight", "vec")))
    links, edges = range_join(packed, min_cosine)
    found = named.join(links, "node", "left").join(connected_components(edges).withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    found = found.select("hash", "vec", "least_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    found = found.join(found.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").drop("least_id", "component")
    out = rows.join(found, ["hash", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits the space again and again at the median of a random direction; vectors within
``SPILL`` of a split go to both sides. How likely a split parts a pair at the threshold is worked out
from the density at the median, and a branch ends before these chances add up to ``RISK``. Trees are
added until all of them part such a pair with a chance of ``MISSED`` at most, so a vector has a dozen
copies, whose number hardly grows with the table: a wider spill in few trees doubles it with every five
times the vectors. The split points are fitted on a bounded sample of ``SAMPLE`` vectors; every vector
is placed in the leaves of every tree. Vectors are compared in double precision within a leaf and label.
A pair that meets in several leaves counts in the first of them only, so tasks return one row per vector
and no pairs.

Leaves that hold more than ``BLOCK`` vectors of a label are cut into blocks, and each pair of blocks
is a group of its own: a very common vector widens no task. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, connected_components, small, width

#: Width of the spill, in standard deviations of a threshold pair's difference along a random direction.
SPILL = 0.4
#: Chance of being parted that a branch of a tree ends before, and chance that all trees part a pair.
RISK, MISSED = 0.3, 1e-6
#: Vectors that split points are fitted on, at most.
SAMPLE = 20_000
#: Vectors a leaf should hold over all labels.
LEAF = 2_000
BLOCK = 1_024


def _beyond(z: float) -> float:
    """Expected excess of a standard normal variable's size over z."""
    return 2 * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * math.erfc(z / math.sqrt(2)) / 2)


class Tree:
    """Random directions and their medians; leaves are numbered from ``first``. ``risk``: the largest chance that a pair at the threshold is parted."""

    def __init__(self, sample: np.ndarray, leaf: float, rng: np.random.Generator, first: int, threshold: float):
        self.directions, self.medians, self.children = [], [], []
        self.leaves, self.risk = first, 0.0
        # A pair at the threshold is sqrt(2 - 2 t) apart; along a random direction this has such a deviation.
        self.deviation = max(math.sqrt(max(0.0, 2 - 2 * threshold) / sample.shape[1]), 1e-9)
        self.spill = SPILL * self.deviation
        self.root = self._grow(sample, leaf, rng, 0, 0.0)

    def _grow(self, sample, leaf, rng, depth, risk):
        if len(sample) > leaf and depth < 24:
            direction = rng.standard_normal(sample.shape[1])
            direction /= np.linalg.norm(direction)
            at = sample @ direction
            low, median, high = (float(x) for x in np.quantile(at, (0.3, 0.5, 0.7)))
            parted = 0.4 / (high - low) * self.deviation * _beyond(2 * SPILL) if high > low else 1.0
            lower, upper = sample[at <= median + self.spill], sample[at >= median - self.spill]
            if risk + parted <= RISK and max(len(lower), len(upper)) <= 0.9 * len(sample):
                node = len(self.children)
                self.directions.append(direction)
                self.medians.append(median)
                self.children.append(None)
                self.children[node] = tuple(self._grow(side, leaf, rng, depth + 1, risk + parted) for side in (lower, upper))
                return node
        self.risk = max(self.risk, risk)
        self.leaves += 1
        return -self.leaves

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) of each leaf that a vector is in."""
        todo, vectors, leaves = [(self.root, np.arange(len(unit)))], [], []
        while todo:
            node, rows = todo.pop()
            if node < 0:
                vectors.append(rows)
                leaves.append(np.full(len(rows), -node, np.int32))
                continue
            at = unit[rows] @ self.directions[node]
            lower, upper = self.children[node]
            todo.append((lower, rows[at <= self.medians[node] + self.spill]))
            todo.append((upper, rows[at >= self.medians[node] - self.spill]))
        return np.concatenate(vectors), np.concatenate(leaves)


def forest(sample: np.ndarray, leaf: float, threshold: float) -> list[Tree]:
    """Trees over a sample of unit vectors that part a pair at the threshold all together with a chance of ``MISSED`` at most."""
    rng, trees, missed = np.random.default_rng(7), [], 1.0
    while missed > MISSED:
        trees.append(Tree(sample, leaf, rng, trees[-1].leaves if trees else 0, threshold))
        missed *= trees[-1].risk
    return trees


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _placed(trees, dim):
    def run(batches):
        for batch in batches:
            usual = batch.column("dim").to_numpy() == dim
            vectors, leaves = [np.flatnonzero(~usual)], [np.zeros(np.count_nonzero(~usual), np.int32)]
            if usual.any():
                mine = np.flatnonzero(usual)
                unit = _unit(_matrix(batch.column("embedding").take(pa.array(mine))))
                for tree in trees.value:
                    at, own = tree.place(unit)
                    vectors.append(mine[at])
                    leaves.append(own)
            vector, leaf = np.concatenate(vectors), np.concatenate(leaves)
            order = np.lexsort((leaf, vector))
            offsets = np.append(0, np.cumsum(np.bincount(vector, minlength=batch.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(leaf[order], pa.int32()))], names=[*batch.schema.names, "leaves"])

    return run


def _compare(threshold: float):
    def run(key, table):
        leaf, lo, hi = key[0].as_py(), key[3].as_py(), key[4].as_py()
        ids, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        block, unit = table["block"].to_numpy(), _unit(_matrix(table["embedding"]))
        lists = table["leaves"].to_pylist()
        leaves = np.full((len(ids), max(map(len, lists))), -1, np.int32)
        for i, x in enumerate(lists):
            leaves[i, : len(x)] = x
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            a, b = np.nonzero(unit[rows] @ unit[right].T >= threshold)
            a, b = rows[a], right[b]
            if lo == hi:
                a, b = a[a < b], b[a < b]
            for start in range(0, len(a), 65536):
                x, y = a[start : start + 65536], b[start : start + 65536]
                first = np.full(len(x), np.iinfo(np.int32).max, np.int32)
                for k in range(leaves.shape[1]):
                    mine = leaves[x, k]
                    met = (mine >= 0) & (leaves[y] == mine[:, None]).any(axis=1)
                    np.minimum(first, np.where(met, mine, first), out=first)
                x, y = x[first == leaf], y[first == leaf]
                np.add.at(count, x, weight[y])
                np.add.at(count, y, weight[x])
                for i, j in np.unique(np.stack([x, y], 1), axis=0):
                    i, j = find(i), find(j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
        linked = np.flatnonzero(count)
        return pa.table({"node": ids[linked], "count": count[linked], "other": ids[[find(i) for i in linked]]}) if len(linked) else _EMPTY

    return run


_EMPTY = pa.table({"node": pa.array([], pa.int64()), "count": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked when their labels are equal and not null and their cosine in double precision
    is at least ``threshold``. ``component_id`` is the smallest id reachable by links.

    A vector that is null, empty, zero or holds null or non-finite components is linked with nothing,
    and so is one with a null label; vectors of different length are never linked. Rows that repeat an
    id are vectors of their own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(sound, F.col("embedding")))
    nodes = scratch.save(
        rows.filter("embedding is not null")
        .groupBy("label", "embedding")
        .agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
        .withColumns({"node": F.xxhash64("label", "embedding"), "dim": F.size("embedding")})
    )
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim, total = common["dim"], common["count"]
    same = nodes.filter(F.col("dim") == dim)
    chosen = same.select("embedding", F.xxhash64("node").alias("order")).orderBy("order").limit(SAMPLE).select("embedding").toArrow()
    sample = _unit(_matrix(chosen["embedding"]))
    shared = spark.sparkContext.broadcast(forest(sample, LEAF * len(sample) / total, threshold))

    schema = "label {}, embedding array<double>, node bigint, weight bigint, dim int, leaves array<int>".format(nodes.schema["label"].dataType.simpleString())
    placed = scratch.save(nodes.select("label", "embedding", "node", "weight", "dim").mapInArrow(_placed(shared, dim), schema))
    spots = placed.select("node", "label", "dim", F.explode("leaves").alias("leaf"))
    sizes = spots.groupBy("leaf", "label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = scratch.save(sizes.filter("blocks > 1"))
    dealt = (
        placed.withColumn("leaf", F.explode("leaves"))
        .join(small(large), ["leaf", "label", "dim"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select("leaf", "label", "dim", "lo", "hi", "block", "node", "weight", "embedding", "leaves")
    )
    dealt = dealt.repartition(width(spark, 2), "leaf", "label", "dim", "lo", "hi")
    found = scratch.save(dealt.groupBy("leaf", "label", "dim", "lo", "hi").applyInArrow(_compare(threshold), "node bigint, count bigint, other bigint"))
    counts = found.groupBy("node").agg(F.sum("count").alias("links"))
    component = connected_components(found.select(F.col("node").alias("src"), F.col("other").alias("dst")), scratch)
    grouped = (
        nodes.join(counts, "node", "left")
        .join(component, "node", "left")
        .withColumns({"component": F.coalesce("component", "node"), "n_links": F.coalesce("links", F.lit(0)) + F.col("weight") - 1})
    )
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "component").select("label", "embedding", "n_links", "component_id")
    out = rows.join(named, ["label", "embedding"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))

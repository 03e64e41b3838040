"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue per query.

All nodes of one level of a tree split by the same random direction, each at its own median in a bounded sample; deeper than the
sample can tell, at the level's median. So trees are as deep as the rows ask for, while what is sent to the tasks stays small. Every
row goes to one leaf of each tree. A query goes down all trees through one queue ordered by the probability that a near vector is
there, given its distance to every cut on the way, and visits the likeliest leaves until they should hold 6 n^0.75 of the n rows,
counted once for each tree. Neighbouring leaves are one task's group of bounded size, joined with the queries that visit some of
them, and the rows of those leaves are ranked by their exact inner products, in double precision.

Equal vectors are indexed once with the k+1 smallest ids, which is all that any k nearest can need, and equal queries are searched
once; so a vector with very many copies costs no more than another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, map_batches, prepare

#: Rows of the sample that a node must have for a cut of its own.
OWN_CUT = 64


@dataclass
class Forest:
    """Complete binary trees of one depth: directions, spread and level_cuts by [tree, level], cuts [tree, node] of the first `top`
    levels; node 1 is the root. sizes: the rows below each node of level `top`, by [tree, node]."""

    directions: np.ndarray
    spread: np.ndarray
    level_cuts: np.ndarray
    cuts: np.ndarray
    depth: int
    top: int
    sizes: np.ndarray | None = None

    @cached_property
    def cut_lists(self) -> list[list[float]]:
        return self.cuts.tolist()

    @cached_property
    def size_lists(self) -> list[list[float]]:
        return self.sizes.tolist()

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: [n, tree]."""
        out = np.empty((len(x), len(self.directions)), np.int64)
        for t, directions in enumerate(self.directions):
            p, node = x @ directions.T, np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (p[:, level] > (self.cuts[t][node] if level < self.top else self.level_cuts[t, level]))
            out[:, t] = node - (1 << self.depth)
        return out

    def visit(self, q: np.ndarray, wanted: float, alike: float) -> list[tuple[int, int]]:
        """(tree, leaf) from the likeliest on, until `wanted` rows should be in them, a row counted for each tree.

        alike: the cosine that a near vector is taken to have to the query.
        """
        p = np.einsum("tld,d->tl", self.directions, q) * alike
        scale = 1.702 / (np.sqrt(1 - alike * alike) * self.spread)  # the logistic curve that is closest to the normal one
        depth, top, inner, below = self.depth, self.top, 1 << self.depth, 1 << (self.depth - self.top)
        z = ((p - self.level_cuts) * scale).tolist()  # distances to the cuts, in that curve's units
        p, scale, cuts, sizes = p.tolist(), scale.tolist(), self.cut_lists, self.size_lists
        far = [[abs(x) for x in row] for row in z]
        # below the nodes with cuts of their own, the likelier way is the same from every node
        tails = [[sum((x > 0) << (depth - 1 - level - i) for i, x in enumerate(row[level:])) for level in range(depth + 1)] for row in z]
        queue, out, held = [], [], 0.0
        push, pop = heapq.heappush, heapq.heappop

        def down(t: int, node: int, level: int) -> tuple[int, list[float]]:
            """The leaf at the end of the likelier way from a node, and the distances to the cuts on it."""
            way = []
            while level < top:
                x = (p[t][level] - cuts[t][node]) * scale[t][level]
                node = 2 * node + (x > 0)
                level += 1
                way.append(abs(x))
            return (node << (depth - level)) | tails[t][level], way + far[t][level:]

        for t in range(len(p)):  # minus the logarithm of the likeliest leaf's probability; another side adds its distance to that
            queue.append((float(np.log1p(np.exp(-np.array(down(t, 1, 0)[1]))).sum()), t, 1, 0))
        heapq.heapify(queue)
        while queue and held < wanted:
            cost, t, node, level = pop(queue)
            leaf, way = down(t, node, level)
            for x in way:
                level += 1
                push(queue, (cost + x, t, (leaf >> (depth - level)) ^ 1, level))
            out.append((t, leaf - inner))
            held += sizes[t][leaf >> (depth - top)] / below
        return out


def plant(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, sample.shape[1])).astype(np.float32)
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    p = np.einsum("tld,nd->ntl", directions, sample) if depth else np.zeros((len(sample), trees, 0), np.float32)
    top = min(depth, max(0, int(np.log2(max(1, len(sample) / OWN_CUT)))))
    level_cuts, spread = np.median(p, axis=0), p.std(axis=0) + 1e-9
    cuts = np.zeros((trees, 1 << top), np.float32)
    for t in range(trees):
        members = {1: np.arange(len(sample))}
        for node in range(1, 1 << top):
            rows = members.pop(node)
            level = node.bit_length() - 1
            side = p[rows, t, level]
            cuts[t, node] = np.median(side) if len(side) >= OWN_CUT // 2 else level_cuts[t, level]
            members[2 * node], members[2 * node + 1] = rows[side <= cuts[t, node]], rows[side > cuts[t, node]]
    return Forest(directions, spread, level_cuts, cuts, depth, top)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def budget(n: int) -> float:
    """Rows that a query's leaves should hold, a row counted for each tree."""
    return 6 * n**0.75


def search(rows: DataFrame, is_query: Column, k: int = 20, trees: int = 14, leaf_rows: int = 24, cell_rows: int = 4096, alike: float = 0.4, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows of (vec_id, embedding).

    Nearness is the inner product; equal ones go to the smaller vec_id. Vectors are lifted by one component to equal norms before
    they are split, so that the largest inner product is the smallest angle. Rows whose vector is null, zero, or holds null or
    non-finite components take no part, nor do those with a null vec_id or another length than the most frequent one (the
    larger of equally frequent). Of repeated rows of a vec_id, that with the smallest vector counts. No usable vectors: no rows.
    The trees' cuts are taken from at most `sample` vectors, which are all of the corpus that is sent to the driver. cell_rows:
    rows that a task compares with queries at a time, about; leaves of more rows are dealt to several tasks.
    """
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "ann")
    vector = F.col("embedding").cast("array<double>")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    once = Window.partitionBy("vec_id").orderBy("embedding")
    valid = valid.where(F.size("embedding") == lengths[0]["n"]).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    # the k+1 smallest ids of each vector; Spark limits each task's rows before the shuffle too
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = valid.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    index = scratch.keep(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.element_at("ids", 1)), "index")
    asked = valid.where("q").select(F.col("vec_id").alias("query_id"), "embedding")
    n, norm = index.agg(F.count("*"), F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)"))).first()
    norm = float(norm)
    some = index.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).select("key", "embedding").limit(sample).collect()
    points = np.array([r["embedding"] for r in sorted(some, key=lambda r: r["key"])] or [[0.0] * lengths[0]["n"]])
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    forest = plant(_lift(points, norm), trees, depth)
    below = depth - min(depth, max(0, int(np.ceil(np.log2(max(1, n / cell_rows))))))  # levels below a cell's node
    planted = spark.sparkContext.broadcast(forest)  # trees * (depth * dim + 2 ** top) numbers

    def place(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "ids": batch.column("ids"), "embedding": batch.column("embedding"), "leaves": list(planted.value.leaves(_lift(_matrix(batch.column("embedding")), norm)))}

    placed = scratch.keep(map_batches(index.select("key", "ids", "embedding"), place, "key long, ids array<long>, embedding array<double>, leaves array<long>"), "placed")
    at = placed.select("key", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 2 << forest.top), np.float64)
    for t, node, size in at.groupBy("tree", F.shiftright("leaf", depth - forest.top).alias("node")).count().collect():  # as many as there are cuts
        sizes[t, (1 << forest.top) + node] = size
    forest.sizes = sizes
    where = spark.sparkContext.broadcast(forest)

    def route(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("embedding"))
        lifted = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(norm), np.zeros((len(x), 1))], axis=1).astype(np.float32)
        return {"key": batch.column("key"), "embedding": batch.column("embedding"), "cells": [_cells(where.value.visit(q, budget(n), alike), below) for q in lifted]}

    queries = placed.join(asked.select("embedding").distinct(), "embedding", "left_semi").select("key", "embedding")
    routed = map_batches(queries, route, "key long, embedding array<double>, cells array<struct<tree: int, node: long, leaves: array<long>>>")
    visits = routed.select("key", "embedding", F.explode("cells").alias("c")).select(F.col("c.tree").alias("tree"), F.col("c.node").alias("node"), "key", "embedding", F.col("c.leaves").alias("leaves"))
    held = placed.select(F.posexplode("leaves").alias("tree", "leaf"), "key", "embedding", "ids").withColumn("node", F.shiftright("leaf", below))
    # cells of many more rows than meant are dealt to several tasks
    large = at.groupBy("tree", F.shiftright("leaf", below).alias("node")).count().where(F.col("count") > 2 * cell_rows)
    large = scratch.keep(large.select("tree", "node", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")), "large", small=True)
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(large, ["tree", "node"], "left").withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    visits = visits.join(large, ["tree", "node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    none = F.lit(None).cast("array<long>")
    both = held.select("tree", "node", "part", F.lit(0).alias("side"), "key", "embedding", "ids", F.array("leaf").alias("leaves"))
    both = both.unionByName(visits.select("tree", "node", "part", F.lit(1).alias("side"), "key", "embedding", none.alias("ids"), "leaves"))
    cell = ["tree", "node", "part"]
    found = "key long, found array<struct<less: double, vec_id: long>>"
    met = both.repartition(*cell).sortWithinPartitions(*cell, "side").mapInArrow(_Cells(k + 1).run, found)
    # copies of a query's own vector stand beside it, so k+1 are enough to leave itself out
    nearest = met.repartition("key").sortWithinPartitions("key").mapInArrow(_merged(k + 1), found)
    own = asked.join(index.select("key", "embedding"), "embedding").select("query_id", "key").join(nearest, "key")
    kept = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def _cells(visits: list[tuple[int, int]], below: int) -> list[dict]:
    """The visits by the node, `below` levels above the leaves, that they are in."""
    cells: dict[tuple[int, int], list[int]] = {}
    for t, leaf in visits:
        cells.setdefault((t, leaf >> below), []).append(leaf)
    return [{"tree": t, "node": node, "leaves": leaves} for (t, node), leaves in cells.items()]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that all squared norms are `norm`."""
    rest = np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


FOUND = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))


def _merged(k: int):  # noqa: ANN202
    """Of rows (key, found) sorted by key: the k first of each key's (less, vec_id), each vec_id once. Merges every few rows."""

    def best(found: list[pa.ListScalar | pa.Array]) -> pa.Array:
        every = pa.concat_arrays([x.values if isinstance(x, pa.ListScalar) else x for x in found])
        less, ids = (every.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        ids, first = np.unique(ids, return_index=True)
        return every.take(pa.array(first[np.lexsort((ids, less[first]))[:k]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys, done = batch.column("key").to_pylist(), []
            for one, found in zip(keys, batch.column("found"), strict=True):
                if one != key and held:
                    done.append((key, best(held)))
                    held = []
                key = one
                held.append(found)
                if len(held) >= 512:
                    held = [best(held)]
            if done:
                yield _rows(done)
        if held:
            yield _rows([(key, best(held))])

    def _rows(done: list[tuple[int, pa.Array]]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(x) for _, x in done]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([key for key, _ in done], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([x for _, x in done])).cast(FOUND)], names=["key", "found"])

    return run


class _Cells:
    """For rows sorted by (cell, side): each query's k best rows of those of its leaves that are in the cell."""

    def __init__(self, k: int):
        self.k = k

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("tree", "node", "part", "side")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                now, side = tuple(marks[:3, a]), marks[3, a]
                if now != cell:
                    cell, held, ready = now, [], None
                part = batch.slice(a, b - a)
                if side == 0:
                    held.append(part)
                elif held:
                    ready = ready or self.ordered(held)
                    yield self.rank(part, *ready)

    @staticmethod
    def ordered(held: list[pa.RecordBatch]) -> tuple:
        """The cell's vectors in the order of their leaves, these leaves, and each vector's ids."""
        x, leaf = np.concatenate([_matrix(p.column("embedding")) for p in held]), np.concatenate([p.column("leaves").flatten().to_numpy() for p in held])
        counts = np.concatenate([np.diff(p.column("ids").offsets.to_numpy()) for p in held])
        ids = np.concatenate([p.column("ids").flatten().to_numpy() for p in held])
        order = np.argsort(leaf, kind="stable")
        return x[order], leaf[order], (np.cumsum(counts) - counts)[order], counts[order], ids

    def rank(self, queries: pa.RecordBatch, x: np.ndarray, leaf: np.ndarray, first: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        q, wanted = _matrix(queries.column("embedding")), queries.column("leaves")
        owner = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
        asked = wanted.flatten().to_numpy()
        order = np.argsort(asked, kind="stable")
        owner, asked = owner[order], asked[order]
        begins = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1])))
        scored = []
        for a, b in zip(begins, [*begins[1:], len(asked)], strict=True):
            low, high = np.searchsorted(leaf, (asked[a], asked[a] + 1))
            if low < high:
                scores = q[owner[a:b]] @ x[low:high].T
                if high - low > 4 * self.k:  # of a large leaf, its own best are enough
                    edge = np.partition(scores, -self.k, axis=1)[:, -self.k]
                    i, j = np.nonzero(scores >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
                    scored.append((owner[a:b][i], low + j, scores[i, j]))
                else:
                    scored.append((np.repeat(owner[a:b], high - low), np.tile(np.arange(low, high), b - a), scores.ravel()))
        if not scored:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], FOUND)], names=["key", "found"])
        who, row, score = (np.concatenate(c) for c in zip(*scored, strict=True))
        order = np.lexsort((-score, who))
        who, row, score = who[order], row[order], score[order]
        start = np.maximum.accumulate(np.where(np.concatenate(([True], who[1:] != who[:-1])), np.arange(len(who)), 0))
        size = np.bincount(who, minlength=len(q))[who]
        edge = score[start + np.minimum(self.k, size) - 1]
        near = score >= edge - 1e-9 * (1 + np.abs(edge))  # products of matrices are not exactly those of vectors
        who, row = who[near], row[near]
        exact = np.einsum("ij,ij->i", x[row], q[who])
        # every id of a vector's copies
        copies = counts[row]
        back = np.repeat(np.arange(len(row)), copies)
        every = ids[first[row][back] + np.arange(len(back)) - np.repeat(np.cumsum(copies) - copies, copies)]
        who, less = who[back], -exact[back]
        order = np.lexsort((every, less, who))
        who, less, every = who[order], less[order], every[order]
        start = np.maximum.accumulate(np.where(np.concatenate(([True], who[1:] != who[:-1])), np.arange(len(who)), 0))
        best = np.arange(len(who)) - start < self.k
        who, less, every = who[best], less[best], every[best]
        some, sizes = np.unique(who, return_counts=True)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(less), pa.array(every)], names=["less", "vec_id"]))
        return pa.RecordBatch.from_arrays([queries.column("key").take(pa.array(some)), found.cast(FOUND)], names=["key", "found"])

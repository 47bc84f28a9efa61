"""Nearest neighbours by a forest of random-projection trees searched through one shared priority queue.

Trees are fitted on a hashed sample of at most ``sample`` vectors (and 16 million numbers): a node splits its part at the
middle of two random members, along their difference, until a leaf would hold about ``leaf_rows`` of all rows, or
``least_leaf`` of the sample. Every row is then put in its leaf of each tree. A query walks all trees at once: one queue
holds the open branches of every tree by the worst margin on the way to them, and leaves are opened until they hold
``search`` rows together, or ``search_share`` of all rows if that is more, and every tree was entered. Vectors without
structure need a large share: it is what recall costs there. The candidates are the rows of the opened leaves; they are
ranked by exact cosine in double precision.

A leaf's rows are dealt to blocks of about ``block`` rows and its queries to blocks of about ``query_block``, and each
pair of blocks meets in a task of its own, so a crowded leaf, as of many equal vectors, is no larger task. A pair of
blocks sends on at most ``k`` candidates a query. Vectors travel in the type they are stored in.

Lengths are taken after division by a power of two, so huge and tiny components neither overflow nor vanish. Vectors
that are null or empty, zero, of another dimension than the table's commonest one, or hold null or non-finite components
take no part, as rows or as queries. Rows without id take no part. Equal scores go by smaller id; rows that share an id
are rows and queries of their own, and each is a candidate for the others; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .runtime import ready, table, uniform


@dataclass(frozen=True)
class Settings:
    k: int = 5
    trees: int = 12
    sample: int = 50_000
    leaf_rows: int = 256
    search: int = 6000
    search_share: float = 0.5
    least_leaf: int = 8
    block: int = 2048
    query_block: int = 1024
    seed: int = 31


class Tree:
    """Planes of a binary tree: children >= 0 are nodes, a leaf x is -1 - x."""

    def __init__(self, x: np.ndarray, leaf: int, rs: np.random.RandomState) -> None:
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            plane = self._split(x[rows], rs) if len(rows) > leaf else None
            if plane is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                me = len(self.normal)
                left = plane[2]
                self.normal.append(plane[0]), self.offset.append(plane[1]), self.child.append([0, 0])
                todo += [(rows[left], me, 0), (rows[~left], me, 1)]
            if parent >= 0:
                self.child[parent][side] = me
            else:
                self.root = me
        self.planes = np.array(self.normal, np.float32).reshape(len(self.normal), x.shape[1])
        self.offsets, self.children = np.array(self.offset), np.array(self.child, np.int64).reshape(-1, 2)

    @staticmethod
    def _split(x: np.ndarray, rs: np.random.RandomState) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(4):
            a, b = x[rs.randint(len(x))], x[rs.randint(len(x))]
            normal = a - b
            if (length := np.linalg.norm(normal)) < 1e-12:
                continue
            normal = normal / length
            at = x @ normal
            offset = float(np.median(at))
            left = at <= offset
            if 0.05 < left.mean() < 0.95:
                return normal, offset, left
        return None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            for part in range(0, len(open_), 4096):
                rows, n = open_[part : part + 4096], node[part : part + 4096]
                right = np.einsum("ij,ij->i", x[rows], self.planes[n]) > self.offsets[n]
                at[rows] = self.children[n, right.astype(np.int64)]
        return -1 - at


def _plain(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is between 0.5 and 1: cosines stay the same bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _plain(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(trees: list[Tree], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(2), dim))
            leaves = np.stack([t.leaf_of(x) for t in trees], axis=1).ravel()
            each = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(trees)), pa.array(leaves))
            yield pa.RecordBatch.from_arrays([*batch.columns, each], ["row", "vec_id", "v", "leaves"])

    return run


def walk(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, search: int) -> list[tuple[int, int]]:
    """The (tree, leaf) that a query opens, in order."""
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(trees)]
    margins = [tree.planes @ q - tree.offsets if len(tree.planes) else None for tree in trees]
    heapq.heapify(queue)
    out, held, entered = [], 0, set()
    while queue and (held < search or len(entered) < len(trees)):
        worst, t, node = heapq.heappop(queue)
        tree = trees[t]
        while node >= 0:
            m = margins[t][node]
            near, far = (tree.children[node][1], tree.children[node][0]) if m > 0 else (tree.children[node][0], tree.children[node][1])
            heapq.heappush(queue, (max(worst, abs(m)), t, int(far)))
            node = int(near)
        out.append((t, -1 - node))
        entered.add(t)
        held += int(sizes[t][-1 - node])
    return out


def _probe(trees: list[Tree], sizes: list[np.ndarray], search: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [[t << 32 | leaf for t, leaf in walk(trees, sizes, q, search)] for q in _unit(_matrix(batch.column(2), dim))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["row", "vec_id", "v", "keys"])

    return run


_FOUND = ["query_row", "query_id", "row", "vec_id", "score"]


def _rank(k: int):
    """The ``k`` best rows of a block for each query of a block: a product of matrices finds those that can be among them,
    the plain measure decides."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        kinds = {c: np.float64 if c == "score" else np.int64 for c in _FOUND}
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: np.zeros(0, t) for c, t in kinds.items()})
        x, q = (_plain(np.stack(f["v"].to_numpy()).astype(np.float64)) for f in (rows, queries))
        at, ids = rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        size, qsize = (np.sqrt((m * m).sum(axis=1)) for m in (x, q))
        near = (q / qsize[:, None]) @ (x / size[:, None]).T
        out = []
        for n, (own, qid) in enumerate(zip(queries["query_row"].tolist(), queries["query_id"].tolist())):
            near[n, at == own] = -9.0
            least = np.partition(near[n], len(ids) - k)[len(ids) - k] if len(ids) > k else -8.0
            some = np.flatnonzero(near[n] >= max(least, -8.0) - 1e-9)
            # Sums by row depend on the row alone, so equal vectors score alike in every block.
            score = (x[some] * q[n]).sum(axis=1) / (size[some] * qsize[n])
            best = np.lexsort((at[some], ids[some], -score))[:k]
            some, score = some[best], score[best]
            out.append((np.full(len(some), own), np.full(len(some), qid), at[some], ids[some], score))
        return pd.DataFrame({c: np.concatenate(v).astype(kinds[c]) for c, v in zip(_FOUND, zip(*out))})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, every: int, cfg: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row whose id is divisible by ``every``.

    vectors: (vec_id long, embedding array of numbers).
    """
    ready(spark)
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    good = good.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    dims = good.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = max(dims, key=lambda r: (r["n"], -r["dim"]))
    dim, n = top["dim"], top["n"]
    good = good.filter(F.size("v") == dim)
    most = min(cfg.sample, max(1, 16_000_000 // dim))
    sample = good.filter(uniform(cfg.seed, F.col("vec_id")) < min(1.0, most / n)).select("vec_id", "v").orderBy("vec_id", "v").limit(2 * most).toArrow()
    x = _unit(_matrix(sample.column(1).combine_chunks(), dim)) if len(sample) else np.ones((1, dim))
    leaf = max(1, min(len(x), cfg.least_leaf) if n > len(x) else 1, int(len(x) * cfg.leaf_rows / n))
    trees = [Tree(x, leaf, np.random.RandomState(cfg.seed + t)) for t in range(cfg.trees)]
    kind = good.schema["v"].dataType.simpleString()
    # A row's number is any distinct one: it stays what it is once the table is written.
    placed = good.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v").mapInArrow(_assign(trees, dim), f"row long, vec_id long, v {kind}, leaves array<long>")
    placed = table(spark, placed, "leaves")
    leaves = placed.select("row", "vec_id", F.posexplode("leaves").alias("tree", "leaf"))
    leaves = leaves.withColumn("key", F.shiftleft(F.col("tree").cast("long"), 32).bitwiseOR(F.col("leaf")))
    counts = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = [np.zeros(t.leaves, np.int64) for t in trees]
    for r in counts.collect():  # as many as the sample's leaves
        sizes[r["key"] >> 32][r["key"] & 0xFFFFFFFF] = r["n"]
    search = max(cfg.search, int(cfg.search_share * n), (cfg.k + 1) * cfg.trees)
    asked = placed.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v").mapInArrow(_probe(trees, sizes, search, dim), f"row long, vec_id long, v {kind}, keys array<long>")
    asked = table(spark, asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "keys"), "asked")
    opened = asked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cfg.query_block).alias("_asks"))
    # Leaves are as many as the sample's: the table of their parts is small whatever the input.
    parts = F.broadcast(counts.select("key", F.ceil(F.col("n") / cfg.block).alias("_parts")).join(F.broadcast(opened), "key"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    dealt = lambda seed, row, c: F.floor(uniform(seed, F.col(row), F.col("key")) * F.col(c))
    keyed = placed.select("row", "vec_id", "v", F.posexplode("leaves").alias("tree", "leaf")).withColumn("key", F.shiftleft(F.col("tree").cast("long"), 32).bitwiseOR(F.col("leaf")))
    rows = keyed.join(parts, "key").withColumn("part", dealt(cfg.seed + 7, "row", "_parts")).withColumn("ask", F.explode(upto("_asks"))).select("key", "part", "ask", "row", "vec_id", "v")
    queries = asked.select("query_row", "query_id", "v", F.explode("keys").alias("key")).join(parts, "key").withColumn("ask", dealt(cfg.seed + 8, "query_row", "_asks"))
    queries = queries.withColumn("part", F.explode(upto("_parts"))).select("key", "part", "ask", "query_row", "query_id", "v")
    block = ["key", "part", "ask"]
    found = rows.groupBy(*block).cogroup(queries.groupBy(*block)).applyInPandas(_rank(cfg.k), "query_row long, query_id long, row long, vec_id long, score double")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    # A row comes once from each tree at most, so its copies go after a first cut.
    some = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.k * cfg.trees).drop("rank").distinct()
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")

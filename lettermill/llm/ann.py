"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts by recursive bisection, and a small
network learns to tell in which parts a vector's neighbours are. Every vector is filed under its most probable part;
a query goes to its several most probable parts and is compared exactly with all that is filed there. How many parts a
query visits is the least that surely found `RECALL` of the neighbours of sample rows that the network has not seen, and
more where these hold fewer than twice the rows that are asked for.

Fitted on `SAMPLE_ROWS` rows at most, chosen by a hash of the id. Parts grow with the rows up to `MOST_PARTS`; a part of
any size is filed in blocks and queries come in chunks, so no task holds a whole part.

Vectors that are null, zero, hold null or non-finite components or have not the commonest length take no part, nor do
rows without an id. Rows with the query's id are its own; repeated rows count once; equal distances go to the smaller
id. A table without vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 8_192
ROWS_PER_PART, FEWEST_PARTS, MOST_PARTS = 512, 8, 256
GRAPH_NEIGHBOURS = 10
RECALL = 0.94
HIDDEN = 96
#: Vectors of a part in one block, and queries in one chunk.
BLOCK_ROWS, CHUNK_ROWS = 16_384, 2_048


@dataclass(frozen=True)
class Router:
    """Network weights; probes: parts that a query visits."""

    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.centre) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each, the best first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :n].astype(np.int32)

    def visited(self, vectors: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each visits: `probes`, and more until these hold `least` rows. held: rows of each part."""
        order = self.parts(vectors, len(held))
        upto = np.cumsum(held[order], axis=1)
        enough = np.minimum((upto < least).sum(axis=1) + 1, len(held))
        return [row[:n] for row, n in zip(order, np.maximum(enough, self.probes), strict=True)]


# --- fitting on the sample -------------------------------------------------------------


def nearest(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    k = min(k, len(vectors) - 1)
    norms = (vectors**2).sum(axis=1)
    out = np.empty((len(vectors), k), np.int64)
    for start in range(0, len(vectors), 1024):
        part = vectors[start : start + 1024]
        far = norms[None, :] - 2 * part @ vectors.T
        far[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        out[start : start + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def bisected(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """True for half of the nodes, with few of the edges (a, b) between the halves.

    Starts from the median of the slowest vector of a random walk on the graph, then swaps the nodes that gain most.
    """
    n = len(nodes)
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = vectors[nodes] - vectors[nodes].mean(axis=0)
    value = x @ x[np.argmax((x**2).sum(axis=1))]
    for _ in range(40):
        value = value - (value * degree).sum() / degree.sum()
        value = 0.5 * value + 0.5 * np.bincount(a, value[b], minlength=n) / degree
        value /= np.abs(value).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(value, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        outside = np.bincount(a, side[a] != side[b], minlength=n)
        gain = 2 * outside - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 20))
        swaps = int((gain[left[:m]] + gain[right[:m]] > 2).sum())
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def balanced_parts(vectors: np.ndarray, neighbours: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row; parts, a power of two, of sizes that differ by few."""
    a = np.repeat(np.arange(len(vectors)), neighbours.shape[1])
    b = neighbours.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(len(vectors), np.int64)
    for _ in range(parts.bit_length() - 1):
        new = 2 * part
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(len(vectors), -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            new[nodes] += bisected(nodes, place[a[inside]], place[b[inside]], vectors)
        part = new
    return part


def fit(vectors: np.ndarray, parts: int, k: int, seed: int = 7, epochs: int = 40) -> Router:
    random = np.random.default_rng(seed)
    centre, n = vectors.mean(axis=0), len(vectors)
    scale = float(np.sqrt(((vectors - centre) ** 2).mean())) or 1.0
    if n < 4 * parts:  # too few to learn from: one part
        zero = np.zeros((vectors.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)
        return Router(centre, scale, *zero, 1)
    tested = random.permutation(n)[: n // 8]
    seen = np.setdiff1d(np.arange(n), tested)
    neighbours = nearest(vectors[seen], GRAPH_NEIGHBOURS)
    part = balanced_parts(vectors[seen], neighbours, parts)
    # A vector's aim: its own part and those of its neighbours.
    aims = np.zeros((len(seen), parts))
    np.add.at(aims, (np.arange(len(seen))[:, None], part[np.column_stack([np.arange(len(seen)), neighbours])]), 1.0)
    aims /= aims.sum(axis=1, keepdims=True)
    x = (vectors[seen] - centre) / scale
    weights = [
        random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        random.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)),
        np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - aims[rows]) / len(rows)
            back = (error @ weights[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(centre, scale, *weights, parts)
    # Recall of the tested rows' neighbours among all sample rows, by the number of parts visited.
    filed, order = router.parts(vectors, 1)[:, 0], router.parts(vectors[tested], parts)
    truth = nearest(vectors, k)[tested]
    place = np.argsort(order, axis=1)  # place of each part in the query's order
    needed = place[np.arange(len(tested))[:, None], filed[truth]]
    each = [(needed < t).mean(axis=1) for t in range(1, parts + 1)]
    # Two standard errors below the mean, as few rows are tested in a small table.
    recall = [x.mean() - 2 * x.std() / np.sqrt(len(x)) for x in each]
    probes = next(t for t in range(1, parts + 1) if recall[t - 1] >= RECALL or t == parts)
    return Router(centre, scale, *weights, probes)


# --- search ----------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Nearest:
    """The k nearest found so far of each of some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compares all queries with these rows; only rows that may be among the nearest are measured exactly."""
        norms = (vectors**2).sum(axis=1)
        for start in range(0, len(self.ids), 256):
            queries = self.vectors[start : start + 256]
            own = (queries**2).sum(axis=1)
            far = own[:, None] + norms[None, :] - 2 * queries @ vectors.T
            far[self.ids[start : start + 256, None] == ids[None, :]] = np.inf
            # Repeated rows may take places, so as many more are looked at as there are.
            k = min(self.k + len(ids) - len(np.unique(ids)), len(ids)) - 1
            bound = np.partition(far, k, axis=1)[:, k] if k < len(ids) else np.full(len(queries), np.inf)
            slack = 1e-10 * (own + norms.max())
            row, column = np.nonzero((far <= (bound + slack)[:, None]) & np.isfinite(far))
            score = np.sqrt(((queries[row] - vectors[column]) ** 2).sum(axis=1))
            self.row = np.concatenate([self.row, row + start])
            self.id = np.concatenate([self.id, ids[column]])
            self.score = np.concatenate([self.score, score])
        order = np.lexsort((self.id, self.score, self.row))
        row, found, score = self.row[order], self.id[order], self.score[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])
        row, found, score = row[new], found[new], score[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.id, self.score = row[keep], found[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def _compare(k: int):
    """Function of mapInArrow over rows (part, block, chunk, side, vec_id, v) sorted so: queries, then rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("part", "block", "chunk", "side")])
            ids, vectors = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in itertools.pairwise(starts):
                *now, side = keys[low].tolist()
                if now != key:
                    if best:
                        yield best.batch()
                    key, waiting, best = now, [], None
                if side == 0:
                    waiting.append((ids[low:high], vectors[low:high]))
                elif waiting:
                    if best is None:
                        _, first = np.unique(np.concatenate([i for i, _ in waiting]), return_index=True)
                        best = Nearest(np.concatenate([i for i, _ in waiting])[first], np.concatenate([v for _, v in waiting])[first], k)
                    best.see(ids[low:high], vectors[low:high])
        if best:
            yield best.batch()

    return run


def usable(rows: DataFrame) -> DataFrame:
    """vec_id (long) and v (array<double>) of the rows that take part."""
    v = F.col("v")
    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = cast.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (length["n"] if length else 0))


def fit_router(rows: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> Router | None:
    """From usable rows; None if there are none."""
    n = rows.count()
    order = F.xxhash64("vec_id", F.lit(3))
    share = min(1.0, 2.0 * sample_rows / max(1, n))
    sample = rows.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).orderBy(order, "vec_id", "v").limit(sample_rows)
    vectors = np.array([r["v"] for r in sample.select("v").collect()], np.float64)
    if not len(vectors):
        return None
    wanted = min(MOST_PARTS, max(FEWEST_PARTS, n // ROWS_PER_PART))
    return fit(vectors, 1 << (wanted.bit_length() - 1), k)


def search(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each query row.

    rows: vec_id, embedding. is_query: a condition on vec_id. All distances are Euclidean, in double precision.
    """
    good = usable(rows)
    router = fit_router(good, k)
    if router is None:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = good.sparkSession.sparkContext.broadcast(router)

    def route(choose: Callable[[np.ndarray], list[np.ndarray]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("parts", pa.array(choose(matrix(batch.column("v"))), pa.list_(pa.int32())))

        return run

    schema = "vec_id long, v array<double>, parts array<int>"
    filed = good.mapInArrow(route(lambda v: list(sent.value.parts(v, 1))), schema).select("vec_id", "v", F.col("parts")[0].alias("part"))
    # A row for each part: bounded by MOST_PARTS. Repeated rows are one, so distinct ids are counted, by a sketch that
    # may be out by some hundredths.
    filled = {r["part"]: r for r in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("vec_id").alias("ids")).collect()}
    held = np.array([filled[p]["ids"] if p in filled else 0 for p in range(router.b2.shape[0])], np.int64)
    routed = good.where(is_query).mapInArrow(route(lambda v: sent.value.visited(v, held, 2 * (k + 1))), schema)
    routed = routed.select("vec_id", "v", F.explode("parts").alias("part"))
    asked = {r["part"]: r["q"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("q")).collect()}
    cells = [(p, -(-filled[p]["n"] // BLOCK_ROWS), -(-q // CHUNK_ROWS)) for p, q in asked.items() if p in filled]
    cells = F.broadcast(good.sparkSession.createDataFrame(cells, "part int, blocks int, chunks int"))
    spot = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = routed.join(cells, "part").select("part", each("blocks").alias("block"), spot("chunks", 1).alias("chunk"), F.lit(0).alias("side"), "vec_id", "v")
    points = filed.join(cells, "part").select("part", spot("blocks", 2).alias("block"), each("chunks").alias("chunk"), F.lit(1).alias("side"), "vec_id", "v")
    dealt = queries.unionByName(points).repartition("part", "block", "chunk").sortWithinPartitions("part", "block", "chunk", "side", "vec_id", "v")
    found = dealt.mapInArrow(_compare(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

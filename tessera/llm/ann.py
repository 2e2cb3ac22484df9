"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by balanced bisection: a part is split in the middle along the axis of its two
means, until parts are small; there are more lists the more vectors there are. They form a graph in memory, on which the
lists near a vector are found. Every vector is put into the list of its nearest centroid. A vector near a boundary,
with further centroids at most CLOSURE times as far, is put into up to COPIES lists. A query
reads the lists whose centroids are at most a ratio times as far as the nearest one. The ratio is measured on the
sample: the least by which RECALL of the neighbours of its queries are found. It reads few lists where vectors are
clustered, and most of them where they fill all directions alike, as nothing less finds the neighbours there.
Nearness within a list is computed exactly, in double precision.

Lists are dealt by an equi-join on list, block and group of queries; a list longer than BLOCK vectors is cut into blocks
by a hash of the id, and its queries go to all of them, QUERIES at a time. Each returns its nearest K, ties to smaller
ids, and the K least of these are the result. With so few vectors that one list holds them, the search is exact.

Defined results: vectors that are null, zero or of another length than most, or hold null or non-finite components take
no part; rows with the same id are one row, with equal scores counted once; a query is no candidate of itself; with
fewer candidates all are returned; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

#: Vectors from which centroids are made, at most; vectors of a list, about; lists, at most.
SAMPLE, LIST, LISTS = 65_536, 512, 16_384
#: Lists of a vector at most, and how much further their centroids may be than the nearest.
COPIES, CLOSURE = 4, 1.003
#: Share of the neighbours of sampled queries that the lists they read must hold, and the number of these queries.
RECALL, TRIALS = 0.95, 512
#: Vectors of a block, and queries that it is compared with at a time.
BLOCK, QUERIES = 20_000, 2000
#: Neighbours of a centroid in the graph, and centroids at which a search begins.
DEGREE, ENTRIES = 24, 32


def _bisect(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of `lists` parts of nearly equal size."""
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        halves = []
        for part in parts:
            own = x[part]
            far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            a, b = far, own[((own - far) ** 2).sum(axis=1).argmax()]
            for _ in range(6):
                side = ((own - a) ** 2).sum(axis=1) <= ((own - b) ** 2).sum(axis=1)
                if side.all() or not side.any():
                    break
                a, b = own[side].mean(axis=0), own[~side].mean(axis=0)
            order = np.argsort(own @ (b - a), kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = halves
    return np.stack([x[p].mean(axis=0) for p in parts])


class Centroids:
    """Centroids with a graph of near neighbours."""

    def __init__(self, x: np.ndarray, lists: int) -> None:
        self.points = _bisect(x, lists).astype(np.float32)
        k = len(self.points)
        square = (self.points**2).sum(axis=1)
        links = []
        degree = min(DEGREE, k - 1)
        for i in range(0, k, 512):
            d = square + square[i : i + 512, None] - 2 * self.points[i : i + 512] @ self.points.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links.append(np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(d), 0), np.int64))
        self.links = np.concatenate(links)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, ENTRIES)).astype(np.int64))

    def near(self, x: np.ndarray, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row the centroids at most `ratio` times as far as the nearest, nearest first, and their distances.

        A search on the graph: centroids within the ratio of the best so far are opened, their neighbours come next.
        """
        k = len(self.points)
        out = []
        for i in range(0, len(x), 64):
            own = x[i : i + 64].astype(np.float32)
            n = len(own)
            best = np.full(n, np.inf, np.float32)
            seen = np.zeros(n * k, bool)
            fresh = (np.arange(n)[:, None] * k + self.entries).ravel()
            found, distances = [], []
            while len(fresh):
                seen[fresh] = True
                row, col = fresh // k, fresh % k
                d = np.sqrt(((own[row] - self.points[col]) ** 2).sum(axis=1))
                np.minimum.at(best, row, d)
                found.append(fresh)
                distances.append(d)
                opened = d <= ratio * best[row] + 1e-6
                after = np.zeros(n * k, bool)
                after[(row[opened, None] * k + self.links[col[opened]]).ravel()] = True
                fresh = np.flatnonzero(after & ~seen)
            at, d = np.concatenate(found), np.concatenate(distances)
            keep = d <= ratio * best[at // k] + 1e-6
            at, d = at[keep], d[keep]
            order = np.lexsort((at, d, at // k))
            at, d = at[order], d[order]
            edge = np.searchsorted(at // k, np.arange(1, n))
            out += zip(np.split(at % k, edge), np.split(d, edge), strict=True)
        return out

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each row: those of the nearest centroid and of nearly as near ones."""
        return [at[:COPIES].astype(np.int32) for at, _ in self.near(x, CLOSURE)]


    def ratio(self, x: np.ndarray, k: int) -> float:
        """How much further than the nearest centroid lists must be read so that RECALL of the k nearest rows of x are in them, for TRIALS rows."""
        trials = np.linspace(0, len(x) - 1, min(len(x), TRIALS)).astype(np.int64)
        square = (x**2).sum(axis=1)
        needed = []
        for i in range(0, len(trials), 64):
            own = trials[i : i + 64]
            d = square - 2 * x[own] @ x.T
            d[np.arange(len(own)), own] = np.inf
            few = np.argpartition(d, k - 1, axis=1)[:, :k] if len(x) > k + 1 else np.argsort(d, axis=1)[:, :-1]
            if not few.size:
                return 1.0
            lists = self.homes(x[few.ravel()])
            far = np.sqrt(((x[own, None] - self.points) ** 2).sum(axis=2))
            row = np.repeat(np.arange(len(own)), few.shape[1])
            needed += [far[r, at].min() / max(far[r].min(), 1e-12) for r, at in zip(row.tolist(), lists, strict=True)]
        return float(np.quantile(needed, RECALL))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vec", lambda v: v != 0)
    )
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (usual.n if usual else 0))


def _nearest(key: tuple, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of a block for each of its queries."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and rows.num_rows:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        ids, x = rows["id"].to_numpy()[order], _matrix(rows["vec"].combine_chunks())[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # rows with the same id are one
        ids, last = ids[first], np.append(first[1:], len(ids))
        asked, q = queries["id"].to_numpy(), _matrix(queries["vec"].combine_chunks())
        square = (x**2).sum(axis=1)
        for i in range(0, len(q), 128):
            own = q[i : i + 128]
            size = (own**2).sum(axis=1)[:, None]
            # Squares by one product choose the ids; a rounding error can't drop any, as all within its reach are measured again.
            about = np.minimum.reduceat(square + size - 2 * own @ x.T, first, axis=1)
            about[ids == asked[i : i + 128, None]] = np.inf
            limit = np.partition(about, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(own), np.inf)
            slack = 1e-9 * (size[:, 0] + square.max())
            for j, name in enumerate(asked[i : i + 128].tolist()):
                few = np.flatnonzero((about[j] <= limit[j] + slack[j]) & (about[j] < np.inf))
                d = np.array([np.sqrt(((x[first[f] : last[f]] - own[j]) ** 2).sum(axis=1)).min() for f in few.tolist()])
                few, d = (v[np.argsort(d, kind="stable")[:k]] for v in (few, d))  # ids ascend, so ties go to smaller ids
                out["query_id"] += [name] * len(few)
                out["vec_id"] += ids[few].tolist()
                out["score"] += d.tolist()
    return pa.Table.from_pydict(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query (of the column `id`) the k nearest other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    lists = 1
    while lists < LISTS and total > 2 * LIST * lists:
        lists *= 2
    share = min(1.0, SAMPLE / max(total, 1))
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if lists > 1 else rows.limit(1)
    sample = sampled.select("vec").toArrow()["vec"].combine_chunks()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    centroids = Centroids(_matrix(sample), min(lists, 1 << (len(sample).bit_length() - 1)))
    ratio = centroids.ratio(_matrix(sample), k)
    shared = spark.sparkContext.broadcast(centroids)

    def placed(choose: Callable[[Centroids, np.ndarray], list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = choose(shared.value, _matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["id", "vec", "lists"])

        return run

    kinds = "id long, vec array<double>, lists array<int>"
    postings = written(rows.mapInArrow(placed(Centroids.homes), kinds)).select("id", "vec", F.explode("lists").alias("list"))
    asked = written(rows.where(is_query).mapInArrow(placed(lambda c, x: [at.astype(np.int32) for at, _ in c.near(x, ratio)]), kinds)).select("id", "vec", F.explode("lists").alias("list"))
    # One row a list: at most LISTS of them, so they can be sent everywhere. Long lists are cut, and so are their queries.
    parts = lambda df, size, name: F.broadcast(df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)))
    blocks, groups = parts(postings, BLOCK, "blocks"), parts(asked, QUERIES, "groups")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = postings.join(blocks, "list").join(groups, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), every("groups").alias("group"), "id", "vec")
    asking = asked.join(groups, "list").join(blocks, "list").select("list", every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"), "id", "vec")
    keys = ["list", "block", "group"]
    near = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(lambda key, q, r: _nearest(key, q, r, k), "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

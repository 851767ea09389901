"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are ordered by length, the longest first, and cut into buckets of bounded size. The longest of all, few enough
to be sent to every task, give each query its first k scores, and so a lower bound of its k-th best. A bucket whose longest
vector can't reach that bound is never paired with the query. In a bucket the bound becomes a cosine threshold: the score divided
by the lengths of the query and of the bucket's longest vector. While it is low, a prefix of the bucket is compared, down to the
length that may still reach it (length pruning). Where it is high, each coordinate of a match must lie near the query's: with a
as the angle of the threshold and b as that between query and axis, within [cos(b + a), cos(b - a)]. The coordinate
that leaves the fewest is looked up in a sorted list, and others thin them out (coordinate pruning). Every product is then
computed in whole numbers; nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes of a bucket's numbers, and vectors at most; ranges of lengths at most, each of one or more buckets.
BUCKET_BYTES, BUCKET_ROWS, MOST_RANGES = 8 << 20, 4096, 4096
#: Cosine thresholds from which on coordinates prune, and how many of the query's largest ones are tried.
COORDINATE_FROM, FOCUS = 0.7, 4
#: What rounding may take off a bound.
SLACK = 1e-9
#: Up to here sums of products of doubles are exact.
EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def whole_numbers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """id, v (floor(scale * x) of each component) and norm of the rows that have an id and only finite components."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        keep = np.array([i is not None and v is not None for i, v in zip(ids.to_pylist(), lists.is_valid().to_pylist(), strict=True)], bool)
        keep &= lists.is_valid().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * scale)
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep &= np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0
        some = flat[keep[row]]
        sizes = sizes[keep]
        with np.errstate(over="ignore"):
            norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), some * some, len(sizes)))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.ListArray.from_arrays(ends, some), pa.array(norms)], names=["id", "v", "norm"])


def matrix(lists: list[np.ndarray] | pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    rows = [np.asarray(v, np.float64) for v in (lists.to_pylist() if isinstance(lists, pa.Array) else lists)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _fitted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def products(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray) -> np.ndarray:
    """All inner products of rows, as the nearest longs: by doubles where no sum can pass EXACT, else by Python's whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not len(a) or not len(b) or norms_a.max() * norms_b.max() < EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[min(_MOST, max(_LEAST, sum(map(int.__mul__, x, y)))) for y in right] for x in left], np.int64)


class Bucket:
    """Vectors in the order of falling length, with sorted lists of coordinates made when they are asked for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.norms, self.v = rows, ids, norms, v
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, their values) by coordinate f of the vectors at length 1."""
        if f not in self.lists:
            unit = self.v[:, f] / np.where(self.norms > 0, self.norms, 1)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = order, unit[order]
        return self.lists[f]

    def prefix(self, bound: float, norm: float) -> int:
        """Length pruning: how many of the longest may reach the bound."""
        if bound <= 0 or norm == 0 or not np.isfinite(norm):
            return 0 if norm == 0 and bound > 0 else len(self.norms)
        return int(np.searchsorted(-self.norms, -bound * (1 - SLACK) / norm, side="right"))

    def near(self, q: np.ndarray, norm: float, bound: float) -> np.ndarray | None:
        """Coordinate pruning: the places that may reach the bound; None where the threshold is too low for it."""
        longest = self.norms[0] if len(self.norms) else 0.0
        cosine = bound / (norm * longest) if norm * longest > 0 and np.isfinite(norm * longest) else 0.0
        if cosine < COORDINATE_FROM:
            return None
        angle = np.arccos(min(1.0, cosine * (1 - SLACK)))
        d = min(len(q), self.v.shape[1])
        unit = q[:d] / norm
        best = None
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            axis = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, axis + angle)) - SLACK, np.cos(max(0.0, axis - angle)) + SLACK
            order, values = self.sorted_by(int(f))
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            ranges.append((f, low, high))
            if best is None or b - a < len(best[1]):
                best = f, order[a:b]
        if best is None:
            return None
        places = best[1]
        for f, low, high in ranges:
            if f != best[0] and len(places):
                unit_f = self.v[places, f] / np.where(self.norms[places] > 0, self.norms[places], 1)
                places = places[(unit_f >= low) & (unit_f <= high)]
        return places

    def best(self, rows: np.ndarray, q: np.ndarray, norms: np.ndarray, bounds: list[float | None], k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query, (score, id) of its best k of this bucket that reach its bound, itself left out. bounds: None where any score counts."""
        limits = [-np.inf if b is None else float(b) - abs(float(b)) * SLACK for b in bounds]
        by_list = [None if b == -np.inf else self.near(x, n, b) for x, n, b in zip(q, norms, limits, strict=True)]
        spans = [self.prefix(b, n) for b, n in zip(limits, norms, strict=True)]
        dense = [i for i, places in enumerate(by_list) if places is None and spans[i]]
        scores = {}
        if dense:
            most = max(spans[i] for i in dense)
            scores = dict(zip(dense, products(q[dense], self.v[:most], norms[dense], self.norms[:most]), strict=True))
        for i, places in enumerate(by_list):
            if places is not None:
                places = places[places < spans[i]]
                got = products(q[i : i + 1], self.v[places], norms[i : i + 1], self.norms[places])[0] if len(places) else np.zeros(0, np.int64)
            else:
                places, got = np.arange(spans[i]), scores[i][: spans[i]] if i in scores else np.zeros(0, np.int64)
            fits = self.rows[places] != rows[i]
            if bounds[i] is not None:
                fits &= got >= bounds[i]
            places, got = places[fits], got[fits]
            if len(got) > 4 * k:  # ties of the k-th stay
                least = np.partition(got, len(got) - k)[len(got) - k]
                places, got = places[got >= least], got[got >= least]
            order = np.lexsort((self.ids[places], ~got))[:k]
            yield [(int(got[x]), int(self.ids[places[x]])) for x in order]


def _seeded(longest: Bucket, norms: np.ndarray, ends: np.ndarray, k: int):
    """Adds to each query its bound, the k-th best score with the longest vectors (null where there are fewer), and the number of buckets that may reach it.

    norms: of the longest vector of each range; ends: how many buckets come before each, and in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own, v = batch.column(0).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(2))
            bounds: list[int | None] = []
            for a in range(0, len(rows), 256):
                part = slice(a, a + 256)
                found = longest.best(rows[part], v[part], own[part], [None] * len(rows[part]), k)
                bounds += [f[-1][0] if len(f) == k else None for f in found]
            with np.errstate(over="ignore", invalid="ignore"):
                met = [len(norms) if b is None or b <= 0 else int((norms * x >= b * (1 - 2 * SLACK)).sum()) for b, x in zip(bounds, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.int64()), pa.array(ends[met], pa.int64())], names=["row", "id", "v", "norm", "bound", "buckets"])

    return run


def _searched(k: int):
    """Each bucket's vectors, then the queries that it may answer, a block at a time; rows come ordered by bucket, and vectors first."""

    def answers(bucket: Bucket, block: list[tuple]) -> pa.RecordBatch:
        rows = np.array([r[0] for r in block], np.int64)
        norms, v = np.array([r[3] for r in block]), matrix([r[2] for r in block])
        out = [(r[0], r[1], vec, score) for r, best in zip(block, bucket.best(rows, v, norms, [r[4] for r in block], k), strict=True) for score, vec in best]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vectors, bucket, block = None, [], None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)]
            lists = batch.column(4)
            for i, (b, kind, row, id_, norm, bound) in enumerate(zip(*columns, strict=True)):
                if b != current:
                    if block:
                        yield answers(bucket, block)
                    current, vectors, bucket, block = b, [], None, []
                v = lists[i].values.to_numpy()
                if kind == 0:
                    vectors.append((row, id_, v, norm))
                    continue
                if bucket is None:
                    bucket = Bucket(np.array([x[0] for x in vectors], np.int64), np.array([x[1] for x in vectors], np.int64), np.array([x[3] for x in vectors]), matrix([x[2] for x in vectors]))
                    vectors = []
                block.append((row, id_, v, norm, bound))
                if len(block) == 256:
                    yield answers(bucket, block)
                    block = []
        if block:
            yield answers(bucket, block)

    return run


def exact_top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Of each query its k highest scores, or all if there are fewer: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own, so rows that repeat
    an id or a vector are candidates like any other, and each repeated query is answered. The score is the inner product of
    floor(scale * x) of all components, exact; a shorter vector counts as if filled with zeros. Ties go to the smaller id. Vectors that are null
    or hold null or non-finite components (also when scaled) take no part, nor do rows without an id. An empty vector
    scores 0 with all. A score beyond 64 bits counts as the nearest long. Other columns are not looked at.
    """
    given = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    vectors = given.mapInArrow(lambda batches: whole_numbers(batches, scale), "id long, v array<double>, norm double")
    vectors = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v", "norm"), "search-vectors")
    n, widest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    each = max(2 * k, min(BUCKET_ROWS, BUCKET_BYTES // (8 * max(1, widest or 1))))
    order = [F.desc("norm"), F.asc("row")]
    ranged = vectors.repartitionByRange(max(1, min(MOST_RANGES, -(-n // each))), *order).withColumn("range", F.spark_partition_id())
    piece = F.floor((F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1) / each).cast("int")
    ranged = materialize(ranged.withColumn("piece", piece), "search-ranges")
    # of each range the number of buckets and the longest vector; MOST_RANGES rows at most
    table = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.max("piece") + 1, F.max("norm")).collect())
    ends = np.concatenate([[0], np.cumsum([r[1] for r in table])]).astype(np.int64)
    starts = df.sparkSession.createDataFrame([(r[0], b) for r, b in zip(table, ends.tolist(), strict=False)], "range int, start long")
    placed = ranged.join(F.broadcast(starts), "range").withColumn("bucket", F.col("start") + F.col("piece"))
    head = ranged.filter((F.col("range") == (table[0][0] if table else 0)) & (F.col("piece") == 0)).toArrow()  # a bucket
    longest = Bucket(*(head[c].to_numpy() for c in ("row", "id", "norm")), matrix(head["v"].to_pylist()))
    seeded = _seeded(longest, np.array([r[2] for r in table]), ends, k)
    asked = vectors.filter(F.col("id") % every == 0).mapInArrow(seeded, "row long, id long, v array<double>, norm double, bound long, buckets long")
    asked = asked.filter("buckets > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    both = placed.select("bucket", F.lit(0).alias("kind"), "row", "id", "v", "norm", F.lit(None).cast("long").alias("bound"))
    both = both.unionByName(asked.select("bucket", F.lit(1).alias("kind"), "row", "id", "v", "norm", "bound"))
    both = both.repartition("bucket").sortWithinPartitions("bucket", "kind", F.desc("norm"), "row")
    found = both.mapInArrow(_searched(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

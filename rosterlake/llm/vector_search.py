"""Exact top-k search for inner products by buckets of vectors of similar length.

Vectors are turned into whole numbers, so scores are exact, and the table is ranged by
descending length over all tasks. Each Arrow batch of it is a bucket: vectors of nearly
one length. A query whose k-th best score so far is t needs, of a bucket with greatest
length l, cosines of t / (|q| l) at least: its local threshold.

* Above 1 the query is done with the bucket.
* Below ``COORDINATES_FROM`` length prunes: only vectors of length t / |q| or more, a
  prefix of the bucket, are multiplied with the query.
* From it on coordinates prune: with the cosine bounded, each coordinate of the unit vector must
  lie in a range around the query's. For the ``FOCUS`` greatest coordinates of the query
  the bucket's sorted lists are cut to that range; the shortest gives candidates, the
  others thin them out, and the products of what remains are verified.

Queries go to the tasks in slices of at most ``SLICE_BYTES``, read by page in order of
row. Vectors are scanned in rounds, longest first, each ``GROWTH`` times as large as all
before; after a round the k-th best scores are the thresholds that the next one starts with,
so a task hands over only what can still be among the best. No vector is shuffled for a
query, and no pair is written but those candidates.

Products are computed in the narrowest type whose whole numbers are proven wide enough by the lengths
(|sum of products| <= |q| |p|): 32-bit or 64-bit floating point, else Python's integers.

* Vectors that are null, or hold null or non-finite components, take no part. Vectors
  are compared with those of as many components; empty ones have score 0 with each other.
* A row is a query by ``is_query``; null is none. Each repeated row is a query of its own and a candidate for the
  other ones. Ties go to the smaller id, null last.
* Scores beyond 64 bits count as the greatest or least long.
* An empty table, or one without queries, gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import StepTables

K = 5
SCALE = 256.0
#: Vectors in a range of lengths, on average; a round is a number of ranges.
RANGE_ROWS = 16384
GROWTH = 15
#: Rows of a bucket at most, and scores that one step computes.
BUCKET_ROWS = 16384
STEP_SCORES = 1 << 22
#: Local threshold from which coordinates prune better than length, and coordinates looked at.
COORDINATES_FROM = 0.8
FOCUS = 3
#: Of the queries that the tasks hold at a time.
SLICE_BYTES = 32 << 20

VECTORS = "row long, id long, asks boolean, size int, length double, wide boolean, v binary"
FOUND = "query long, query_id long, row long, id long, score long"
#: Relative and absolute slack of comparisons with rounded lengths and unit vectors.
SLACK, UNIT_SLACK = 1e-9, 1e-5
LONGEST, LEAST = (1 << 63) - 1, -(1 << 63)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _whole_vectors(scale: float):
    schema = _schema(VECTORS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").cast(pa.large_list(pa.float64()))
            rows, ids, asks = (batch.column(c).to_pylist() for c in ("row", "id", "asks"))
            offsets = vectors.offsets.to_numpy()
            values = vectors.values.to_numpy(zero_copy_only=False)  # nulls as nan
            out = []
            for i in np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False)):
                own = values[offsets[i] : offsets[i + 1]]
                if np.isfinite(own).all():
                    with np.errstate(over="ignore"):
                        own = np.floor(scale * own)
                    if not np.isfinite(own).all():
                        continue  # beyond doubles
                    wide = bool(len(own) and np.abs(own).max() > 32767)
                    length = math.hypot(*own.tolist())
                    raw = own.astype("<f8" if wide else "<i2").tobytes()
                    out.append((rows[i], ids[i], asks[i], len(own), length, wide, raw))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return whole


def _matrix(raw: list[bytes], wide: np.ndarray, size: int) -> np.ndarray:
    out = np.empty((len(raw), size))
    for kind, name in ((False, "<i2"), (True, "<f8")):
        of = np.flatnonzero(wide == kind)
        if len(of) and size:
            out[of] = np.frombuffer(b"".join(raw[i] for i in of), name).reshape(-1, size)
    return out


def _at_most(score) -> float:
    """A double that isn't above the score."""
    return float(score) if abs(score) < 1 << 53 else math.nextafter(float(score), -math.inf)


class Queries:
    """Queries of one number of components, with the score each has to reach."""

    def __init__(self, row, ids, no_id, length, matrix) -> None:
        self.row, self.ids, self.no_id, self.length, self.matrix = row, ids, no_id, length, matrix
        self.reach = np.full(len(row), -np.inf)


class Bucket:
    """Vectors by descending length, and what the two ways of pruning need."""

    def __init__(self, row, ids, no_id, length, matrix, k: int) -> None:
        # of equal vectors only the first k + 1 by id can be among the best k of any query
        order = np.lexsort((row, ids, no_id))
        keys = np.ascontiguousarray(matrix[order]).view(np.dtype((np.void, max(1, matrix.shape[1]) * 8))).ravel() if matrix.shape[1] else np.zeros(len(row), "V1")
        _, group = np.unique(keys, return_inverse=True)
        by = np.argsort(group, kind="stable")
        first = np.concatenate(([0], np.flatnonzero(np.diff(group[by])) + 1))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        order = order[by[place <= k]]
        order = order[np.argsort(-length[order], kind="stable")]
        self.row, self.ids, self.no_id = row[order], ids[order], no_id[order]
        self.length, self.matrix = length[order], matrix[order]
        self._single = self._unit = None
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def typed(self, bound: float) -> np.ndarray:
        """The vectors in a type that holds products of at most ``bound`` exactly."""
        if bound < 2.0**24:
            if self._single is None:
                self._single = self.matrix.astype(np.float32)
            return self._single
        return self.matrix

    def unit(self, coordinate: int) -> np.ndarray:
        return self.matrix[:, coordinate] / np.maximum(self.length, 1e-300)

    def sorted_by(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinate of the unit vectors in ascending order, and whose it is."""
        if coordinate not in self._sorted:
            values = self.unit(coordinate)
            order = np.argsort(values)
            self._sorted[coordinate] = values[order], order
        return self._sorted[coordinate]

    def feasible(self, query: np.ndarray, length: float, threshold: float) -> np.ndarray:
        """Places of vectors whose cosine with the query may reach the threshold."""
        unit = query / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        spread = np.sqrt(np.maximum(0, (1 - unit[focus] ** 2) * (1 - threshold**2)))
        low = np.where(-unit[focus] >= threshold, -1.0, unit[focus] * threshold - spread) - UNIT_SLACK
        high = np.where(unit[focus] >= threshold, 1.0, unit[focus] * threshold + spread) + UNIT_SLACK
        cuts = []
        for f, a, b in zip(focus, low, high, strict=True):
            values, _ = self.sorted_by(int(f))
            cuts.append((np.searchsorted(values, a), np.searchsorted(values, b, "right")))
        shortest = int(np.argmin([b - a for a, b in cuts]))
        places = self.sorted_by(int(focus[shortest]))[1][slice(*cuts[shortest])]
        for i, f in enumerate(focus):
            if i != shortest and len(places):
                values = self.matrix[places, f] / np.maximum(self.length[places], 1e-300)
                places = places[(values >= low[i]) & (values <= high[i])]
        return places


def _products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    if bound < 2.0**53:
        return (queries.astype(vectors.dtype) @ vectors.T).astype(np.float64)
    whole = [[int(x) for x in v] for v in vectors]
    exact = [[sum(int(x) * y for x, y in zip(q, v, strict=True)) for v in whole] for q in queries]
    return np.array([[min(max(x, LEAST), LONGEST) for x in row] for row in exact], object).reshape(len(queries), len(vectors))


class Best:
    """The k best candidates so far of each query, in flat arrays."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.queries, self.k = queries, k
        self.kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, object)]
        self.reach = queries.reach.copy()

    def take(self, found: list[tuple[np.ndarray, Bucket, np.ndarray, np.ndarray]]) -> None:
        if not found:
            return
        query = np.concatenate([f[0] for f in found])
        row, ids, no_id = (np.concatenate([getattr(f[1], c)[f[2]] for f in found]) for c in ("row", "ids", "no_id"))
        score = np.concatenate([f[3] for f in found])
        other = row != self.queries.row[query]
        new = [a[other] for a in (query, row, ids, no_id, score)]
        query, row, ids, no_id, score = (np.concatenate((a, b)) for a, b in zip(self.kept, new, strict=True))
        order = np.lexsort((row, ids, no_id, -score, query)) if score.dtype != object else np.array(
            sorted(range(len(query)), key=lambda i: (query[i], -score[i], no_id[i], ids[i], row[i])), np.int64
        )
        group = query[order]
        first = np.searchsorted(group, group, "left")
        place = np.arange(len(order)) - first
        order = order[place < self.k]
        self.kept = [a[order] for a in (query, row, ids, no_id, score)]
        last = order[place[place < self.k] == self.k - 1]
        self.reach[query[last]] = np.maximum(self.reach[query[last]], [_at_most(x) for x in score[last].tolist()])

    def search(self, bucket: Bucket) -> None:
        q, longest = self.queries, float(bucket.length[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(self.reach > 0, self.reach / q.length * (1 - SLACK), -np.inf)
        threshold = needed / longest if longest else np.where(needed > 0, np.inf, -np.inf)
        bound = float(q.length.max(initial=0)) * longest * (1 + SLACK)
        vectors = bucket.typed(bound)
        found = []
        by_length = np.flatnonzero(threshold < COORDINATES_FROM)
        ends = np.searchsorted(-bucket.length, -needed[by_length], "right")
        by_length, ends = by_length[order := np.argsort(ends, kind="stable")], ends[order]
        rows = max(1, STEP_SCORES // len(bucket.row))
        for low in range(0, len(by_length), rows):
            some, end = by_length[low : low + rows], int(ends[low : low + rows][-1])
            if not end:
                continue
            scores = _products(q.matrix[some], vectors[:end], bound)
            hit = scores >= self.reach[some][:, None]
            many = np.flatnonzero(hit.sum(axis=1) > 4 * (self.k + 1))
            if len(many):  # one more than k: the query's own row may be among them
                kth = np.partition(scores[many], end - self.k - 1, axis=1)[:, end - self.k - 1]
                hit[many] &= scores[many] >= kth[:, None]
            i, place = np.nonzero(hit)
            found.append((some[i], bucket, place, scores[i, place]))
        for i in np.flatnonzero((threshold >= COORDINATES_FROM) & (threshold <= 1)):
            places = bucket.feasible(q.matrix[i], q.length[i], float(threshold[i]))
            if len(places):
                scores = _products(q.matrix[i : i + 1], vectors[places], bound)[0]
                hit = np.flatnonzero(scores >= self.reach[i])
                found.append((np.full(len(hit), i), bucket, places[hit], scores[hit]))
        self.take(found)


def _scanner(broadcast, k: int, bucket_rows: int):
    schema = _schema(FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, Queries] = broadcast.value
        best = {size: Best(queries, k) for size, queries in slices.items()}
        for batch in batches:
            row, length, sizes = (batch.column(c).to_numpy() for c in ("row", "length", "size"))
            wide, no_id = batch.column("wide").to_numpy(zero_copy_only=False), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            for size in np.unique(sizes):
                if int(size) not in best:
                    continue
                of = np.flatnonzero(sizes == size)
                of = of[np.argsort(-length[of], kind="stable")]
                for low in range(0, len(of), bucket_rows):
                    some = of[low : low + bucket_rows]
                    raw = batch.column("v").take(pa.array(some)).to_pylist()
                    matrix = _matrix(raw, wide[some], int(size))
                    best[int(size)].search(Bucket(row[some], ids[some], no_id[some], length[some], matrix, k))
        for state in best.values():
            q, (query, found, ids, no_id, score) = state.queries, state.kept
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q.row[query]),
                    pa.array(q.ids[query], mask=q.no_id[query]),
                    pa.array(found),
                    pa.array(ids, pa.int64(), mask=no_id),
                    pa.array([int(s) for s in score], pa.int64()),
                ],
                schema=schema,
            )

    return scan


def _slice(rows: list) -> dict[int, Queries]:
    out = {}
    for size in {r["size"] for r in rows}:
        own = [r for r in rows if r["size"] == size]
        ids = np.array([r["id"] or 0 for r in own], np.int64)
        none = np.array([r["id"] is None for r in own], bool)
        matrix = _matrix([bytes(r["v"]) for r in own], np.array([r["wide"] for r in own], bool), size)
        out[size] = Queries(np.array([r["row"] for r in own], np.int64), ids, none, np.array([r["length"] for r in own]), matrix)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(ranges: int) -> Iterator[tuple[int, int]]:
    low, high = 0, 1
    while low < ranges:
        yield low, min(high, ranges)
        low, high = high, high * (GROWTH + 1)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = K,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    scale: float = SCALE,
    slice_bytes: int = SLICE_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is a query the ``k`` other rows of
    greatest inner product, after floor(``scale`` * component)."""
    spark = rows.sparkSession
    tables = StepTables(spark)
    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    whole = tables.write("whole", numbered.mapInArrow(_whole_vectors(scale), VECTORS))  # rows keep their numbers from here on
    ranges = max(1, math.ceil(whole.count() / RANGE_ROWS))
    by_length = whole.repartitionByRange(ranges, F.desc("length"), F.col("row")).sortWithinPartitions(F.desc("length"), "row")
    vectors = tables.write("vectors", by_length.withColumn("range", F.spark_partition_id()))
    asked = vectors.where("asks").drop("asks", "range")
    vectors = vectors.drop("asks")
    widest, ranges = asked.agg(F.max("size")).first()[0], vectors.agg(F.max("range")).first()[0]
    if widest is None:
        return _ranked(vectors.where("false").select(*[F.lit(None).cast("long").alias(c.split()[0]) for c in FOUND.split(", ")]), k).select(
            F.col("query_id"), "rank", F.col("id").alias("vec_id"), "score"
        )
    page, last = max(1, slice_bytes // (8 * widest + 256)), -1
    while True:
        own = asked.where(F.col("row") > last).orderBy("row").limit(page).collect()
        if not own:
            break
        last = own[-1]["row"]
        queries = _slice(own)
        found = []
        for low, high in _rounds(ranges + 1):
            shared = spark.sparkContext.broadcast(queries)
            part = vectors.where((F.col("range") >= low) & (F.col("range") < high)).drop("range")
            found.append(tables.write("found", part.mapInArrow(_scanner(shared, k, bucket_rows), FOUND)))
            shared.unpersist()
            if high <= ranges:
                so_far = found[0]
                for more in found[1:]:
                    so_far = so_far.unionByName(more)
                reached = _ranked(so_far, k).where(F.col("rank") == k).select("query", "score").collect()
                reached = {r["query"]: _at_most(r["score"]) for r in reached}
                for q in queries.values():
                    q.reach = np.array([reached.get(int(r), -np.inf) for r in q.row])
    found = _ranked(tables.union("found"), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

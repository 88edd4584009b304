"""Centroid clustering with scalar lookup tables.

Vectors become whole numbers and are kept in blocks: for each dimension of a block the different
values that occur, and for each vector their places among these. A round tabulates, for each
dimension, occurring value and centroid, the squared difference; the distance of a vector is then
a sum of table entries gathered by its places. Nothing is multiplied for a vector itself.

Sums are whole numbers of any size: a task gives them out in limbs of LIMB bits, which Spark adds
up, so every centroid and distance is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexsieve.llm.common import named, packed, unpacked
from lexsieve.sources.shared import settle

OUTPUTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
BLOCK_ROWS = 8_192
LIMB = 36
MOST = 2**63 - 1
COUNT, INERTIA = -1, -2


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null, infinite or no number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they fit and else as Python's."""
    if np.abs(x).max(initial=0.0) < 2.0**40 / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.tolist()], object)


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    place = 0
    while not -(1 << LIMB) <= number < 1 << LIMB:
        yield place, number & ((1 << LIMB) - 1)
        number >>= LIMB
        place += 1
    yield place, number


def blocks(df: DataFrame, vector: Column, size: int, scale: int) -> DataFrame:
    """(rows, places, values): blocks of up to BLOCK_ROWS packed rows.

    ``values`` holds the different values of each dimension, as floor(scale * x) / scale, which a
    double holds exactly; ``places`` their numbers for each vector, dimension by dimension.
    """
    schema = StructType([
        StructField("rows", df.select(F.array("row")).schema[0].dataType),
        *df.sparkSession.createDataFrame([], "places array<int>, values array<array<double>>").schema,
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                n = part.num_rows
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
                large = np.abs(x) >= 2.0**53 / scale
                x = np.where(large, x, np.floor(np.where(large, 0, x) * scale) / scale)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(size)]
                values = pa.array([v for v, _ in found], pa.list_(pa.float64()))
                places = np.concatenate([p for _, p in found]).astype(np.int32) if size else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("row")),
                    pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places)),
                    pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), values),
                ], ["rows", "places", "values"])

    return settle(df.select("row", vector.alias("vector")).mapInArrow(build, schema))


def nearest(
    places: np.ndarray, values: list[np.ndarray], centroids: list[list[int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of ties, and the squared distance to it."""
    most = max([abs(c) for row in centroids for c in row] + [int(np.abs(v).max(initial=0)) for v in values] + [0])
    kind = np.int64 if (2 * most) ** 2 * max(len(values), 1) < 2**63 else object
    centre = np.array(centroids, dtype=object).astype(kind)
    total = np.zeros((places.shape[1], len(centroids)), kind)
    for d, value in enumerate(values):
        table = (value.astype(kind)[:, None] - centre[None, :, d]) ** 2
        total += table[places[d]]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def _opened(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(row in the batch, places by dimension, whole values by dimension) of each block."""
    for i in range(batch.num_rows):
        values = [whole(np.asarray(v, float), scale) for v in batch.column("values")[i].as_py()]
        places = batch.column("places")[i].values.to_numpy(zero_copy_only=False)
        yield i, places.reshape(len(values), -1), values


def _totals(blocked: DataFrame, centroids: list[list[int]], scale: int) -> dict[tuple[int, int], int]:
    """Sums by (cluster, dimension), and under COUNT and INERTIA numbers of vectors and distances.

    A task gives out one set of sums for all its blocks.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        k = len(centroids)
        for batch in batches:
            for _, places, values in _opened(batch, scale):
                best, distance = nearest(places, values, centroids)
                told = [(c, COUNT, int(n)) for c, n in enumerate(np.bincount(best, minlength=k))]
                told += [(c, INERTIA, sum(distance[best == c].tolist())) for c in range(k)]
                for d, value in enumerate(values):
                    seen = np.bincount(places[d] * k + best, minlength=len(value) * k).reshape(len(value), k)
                    told += [(c, d, int(s)) for c, s in enumerate(value @ seen.astype(value.dtype))]
                for c, d, s in told:
                    sums[c, d] = sums.get((c, d), 0) + s
        rows = [(c, d, i, limb) for (c, d), s in sums.items() for i, limb in _limbs(s)]
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "dimension", "place", "limb"])

    told = blocked.select("places", "values").mapInArrow(summed, "cluster int, dimension int, place int, limb long")
    totals: dict[tuple[int, int], int] = {}
    for c, d, place, limb in told.groupBy("cluster", "dimension", "place").agg(F.sum("limb")).collect():
        totals[c, d] = totals.get((c, d), 0) + (limb << (LIMB * place))
    return totals


KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 8, rounds: int = 10,
    size: int = 64, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """The usable rows with ``cluster``, squared ``distance`` to its centroid, ``cluster_inertia`` and
    ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``.

    Usable are vectors of ``size`` components, none null or non-finite; others are left out. A component x
    is floor(scale * x), ``scale`` being a power of two. Centroids start as the ``clusters`` vectors with the
    least hash of seed and key (a null key is "null"; of equal keys the smaller vector is first), or all
    where there are fewer, and become the floor of their vectors' mean in each of ``rounds`` rounds; one
    without vectors stays. Repeated rows are vectors of their own. Distances and inertias beyond a
    64-bit integer are given as the greatest one; centroids and the choice among them are exact all the
    same. An empty table gives an empty result; columns of the outputs' names give way.

    Only ``clusters`` times ``size`` numbers pass through the driver in a round; each round reads the
    blocks from the shared folder, so a lost executor costs its own blocks' work alone.
    """
    components = named(vector).cast("array<double>")
    rows = packed(df, OUTPUTS, key=named(key), vector=components).filter(usable(F.col("vector"), size))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    first = rows.select("vector", hashed.alias("hash")).orderBy("hash", "vector").limit(clusters).collect()
    centroids = [[int(v) for v in whole(np.array(r["vector"], float), scale).tolist()] for r in first]
    blocked = blocks(rows, F.col("vector"), size, scale)
    for _ in range(rounds if centroids else 0):
        totals = _totals(blocked, centroids, scale)
        moved = [
            [totals[c, d] // totals[c, COUNT] for d in range(size)] if totals.get((c, COUNT)) else old
            for c, old in enumerate(centroids)
        ]
        if moved == centroids:  # later rounds would not move them either
            break
        centroids = moved
    totals = _totals(blocked, centroids, scale) if centroids else {}
    inertias = [totals.get((c, INERTIA), 0) for c in range(len(centroids))]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    added = StructType.fromDDL(
        "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = pa.array([min(x, MOST) for x in inertias], pa.int64()), pa.array(digests, pa.string())
        for batch in batches:
            for i, places, values in _opened(batch, scale):
                best, distance = nearest(places, values, centroids)
                own = pa.array(best, pa.int32())
                distance = distance if distance.dtype != object else [min(x, MOST) for x in distance.tolist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("rows")[i].values, own, pa.array(distance, pa.int64()), told[0].take(own),
                    pa.array(np.full(len(best), min(sum(inertias), MOST)), pa.int64()), told[1].take(own),
                ], ["row", *OUTPUTS])

    assigned = blocked.mapInArrow(assign, StructType([rows.schema["row"], *added]))
    return unpacked(assigned, *OUTPUTS)

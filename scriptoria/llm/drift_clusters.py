"""Centroid clustering in whole numbers, with bounds that drift by geometry.

Vectors are turned into whole numbers, floor(256 x) in each component, and clustered by Lloyd's rounds: every vector goes to its nearest centroid, then every centroid that has vectors moves to the componentwise floor of
their mean. Each vector keeps an upper bound on the distance to its own centroid and a lower bound on that to all others. While the upper one is below the lower one, or below half the distance of its centroid to the next one, the
vector stays where it is. Otherwise the upper bound is worked out anew, and if that doesn't settle it, the vector is ambiguous and is scanned: all distances exactly, ties to the smaller number.

When centroids move, an upper bound grows by its own centroid's drift. A lower bound would lose the largest drift of the others. But the vectors of cluster i lie in the sphere around its old centroid with their largest upper bound
as radius. While centroid j moves by ds in direction e, the distance to a point falls by cos(e, point) ds. In the plane of the sphere's centre and the path of j, the centre is seen under an angle that only grows on the way, and
the sphere's half width under the arcsine of its radius over the least distance; so the fall is at most the integral of cos(max(0, angle - half width)), bounded here piece by piece. The bounds of cluster i lose the largest fall among the
other centroids, which is less than the full drift, and below zero where all of them move away.

Spark deals out the rows; nothing of them is shuffled. A round writes the rows with their bounds once. Sums of each cluster are taken in the tasks and added by groupBy; the driver holds the centroids and sums, whose size is clusters x
components, and nothing else.

Defined results: vectors of another length, or with null or non-finite components, take no part; rows that repeat are vectors each; a row without vec_id takes part, but is the last to become a first centroid. With fewer vectors than
clusters there are as many centroids as vectors. Whole numbers are exact at any size; a distance or inertia beyond 2^63 - 1 is null. Components from 2^22 on are worked out in Python's whole numbers, more slowly, and their rows always scanned.
An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CLUSTERS, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: Components below this are exact in double precision, with their squared distances, for up to 64 components.
NARROW = 1 << 22
#: Pieces of a centroid's path that are bounded each; by how much bounds are widened against rounding.
PIECES, SLACK = 8, 1e-9
STATE = "vec_id long, x binary, cluster int, upper double, lower double"


def whole(x: float) -> int:
    """floor(256 x), of any double."""
    return int(x) * 256 if abs(x) >= 1 << 52 else math.floor(x * 256)


def root(n: int) -> float:
    return math.sqrt(n) if n < 1 << 1000 else math.inf


class Centroids:
    """Centroids in whole numbers, and how bounds move from the ones before to them."""

    def __init__(self, exact: list[list[int]]) -> None:
        self.exact, k = exact, len(exact)
        self.narrow = all(abs(c) < NARROW for row in exact for c in row)
        self.flat = np.array(exact, np.float64).reshape(k, DIM) if self.narrow else None
        self.norms = (self.flat**2).sum(1) if self.narrow else None
        self.grow, self.loosen = np.full(k, math.inf), np.full(k, math.inf)
        self.half = np.zeros(k)
        if self.narrow and k > 1:
            between = np.sqrt(((self.flat[:, None] - self.flat[None]) ** 2).sum(2))
            np.fill_diagonal(between, math.inf)
            self.half = between.min(1) / 2 * (1 - SLACK)

    def moved(self, exact: list[list[int]], reach: np.ndarray) -> Centroids:
        """The next centroids. reach: of each cluster the largest upper bound."""
        out = Centroids(exact)
        if self.narrow and out.narrow:
            out.grow = np.sqrt(((out.flat - self.flat) ** 2).sum(1)) * (1 + SLACK)
            fall = falls(self.flat, out.flat, reach)
            np.fill_diagonal(fall, -math.inf)
            out.loosen = fall.max(1) if len(exact) > 1 else np.zeros(1)
        return out

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the nearest centroid, and the distances to it and to the next one."""
        if self.narrow and x.dtype != object:
            d = (x**2).sum(1)[:, None] - 2 * x @ self.flat.T + self.norms
        else:
            held = x if x.dtype == object else x.astype(np.int64).astype(object)
            d = np.stack([((held - np.array(c, object)) ** 2).sum(1) for c in self.exact], 1)
        near = d.argmin(1).astype(np.int64)
        two = np.sort(d, axis=1)[:, :2]
        ends = [np.array([root(int(v)) for v in c]) if d.dtype == object else np.sqrt(c) for c in two.T]
        return near, ends[0], ends[1] if len(ends) > 1 else np.full(len(x), 1e300)

    def squared(self, x: np.ndarray, cluster: np.ndarray) -> list[int | None]:
        """Exact squared distances to the given centroids; None beyond a long."""
        if self.narrow and x.dtype != object:
            return ((x - self.flat[cluster]) ** 2).sum(1).astype(np.int64).tolist()
        out = [sum((int(v) - c) ** 2 for v, c in zip(row, self.exact[k], strict=True)) for row, k in zip(x, cluster, strict=True)]
        return [d if d < 1 << 63 else None for d in out]


def falls(old: np.ndarray, new: np.ndarray, reach: np.ndarray, pieces: int = PIECES) -> np.ndarray:
    """Entry (i, j): by how much the distance to centroid j falls at most, for any point of the sphere around old centroid i."""
    path = new - old
    drift = np.sqrt((path**2).sum(1))
    way = path / np.maximum(drift, 1e-300)[:, None]
    apart = old[:, None, :] - old[None, :, :]  # from j to i
    along = np.einsum("ijd,jd->ij", apart, way)
    aside = np.sqrt(np.maximum((apart**2).sum(2) - along**2, 0.0))
    out, step = np.zeros_like(along), drift / pieces
    for k in range(pieces):
        ahead = along - k * step
        angle = np.arctan2(aside, ahead) - 1e-6  # rounding where the three are nearly in line
        least = np.hypot(aside, np.where(ahead < 0, ahead, np.maximum(ahead - step, 0.0)))
        width = np.where(reach[:, None] < least, np.arcsin(np.minimum(1.0, reach[:, None] / np.maximum(least, 1e-300))), math.pi)
        out += step * (np.cos(np.maximum(0.0, angle - width)) + SLACK)
    return out


def _packed(v: Iterable[Iterable[float]]) -> list[bytes]:
    """Whole numbers as 32-bit ones, or, for rows with large components, the components themselves as doubles."""
    given = np.array([np.asarray(r, np.float64) for r in v]).reshape(-1, DIM)
    small = (np.abs(given) < NARROW / 256).all(1)
    ints = np.floor(np.where(small[:, None], given, 0.0) * 256).astype("<i4")
    return [i.tobytes() if s else g.astype("<f8").tobytes() for s, i, g in zip(small, ints, given, strict=True)]


def _unpacked(x: list[bytes]) -> np.ndarray:
    """Rows of one width: doubles that hold whole numbers, or whole numbers as objects."""
    if len(x[0]) == 4 * DIM:
        return np.frombuffer(b"".join(x), "<i4").reshape(-1, DIM).astype(np.float64)
    return np.array([[whole(v) for v in np.frombuffer(r, "<f8").tolist()] for r in x], object).reshape(-1, DIM)


def _by_width(x: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of narrow rows and of wide ones, and their whole numbers."""
    wide = np.array([len(r) != 4 * DIM for r in x], bool)
    held = x.to_numpy()
    for at in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(at):
            yield at, _unpacked(held[at].tolist())


def _assigned(b: pd.DataFrame, to: Centroids) -> pd.DataFrame:
    cluster, upper, lower = (b[c].to_numpy().copy() for c in ("cluster", "upper", "lower"))
    for at, x in _by_width(b["x"]):
        if x.dtype == object:  # these have no bounds, and don't widen their cluster's sphere
            cluster[at], upper[at], lower[at] = to.scan(x)[0], 0.0, 0.0
            continue
        own = cluster[at]
        u, low = np.full(len(at), math.inf), np.full(len(at), -math.inf)
        held = np.flatnonzero(own >= 0)
        u[held] = upper[at][held] * (1 + SLACK) + to.grow[own[held]]
        low[held] = lower[at][held] - to.loosen[own[held]] - SLACK * np.abs(lower[at][held])
        bound = np.full(len(at), -math.inf)
        bound[held] = np.maximum(low[held], to.half[own[held]])
        near = held[u[held] >= bound[held]]  # settled by the distance itself, perhaps
        if len(near) and to.narrow:
            u[near] = np.sqrt(((x[near] - to.flat[own[near]]) ** 2).sum(1)) * (1 + SLACK)
        open_ = np.flatnonzero(~(u < bound))
        if len(open_):
            own[open_], u[open_], low[open_] = to.scan(x[open_])
            u[open_] *= 1 + SLACK
            low[open_] *= 1 - SLACK
        cluster[at], upper[at], lower[at] = own, u, low
    return pd.DataFrame({"vec_id": b["vec_id"], "x": b["x"], "cluster": cluster, "upper": upper, "lower": lower})


def limbs(n: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as numbers whose sums stay longs: n is the sum of part << 30 * place."""
    place = 0
    while not -(1 << 40) <= n < 1 << 40:
        yield place, n & (1 << 30) - 1
        n, place = n >> 30, place + 1
    yield place, n


def assign(rows: DataFrame, to: Centroids) -> DataFrame:
    """Rows (STATE) with their cluster and bounds after the move to the given centroids, written once."""
    sent = rows.sparkSession.sparkContext.broadcast(to)

    def step(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["vec_id"] = b["vec_id"].astype("Int64")
                yield _assigned(b, sent.value)

    return checkpointed(rows.mapInPandas(step, STATE))


def totals(rows: DataFrame, k: int) -> tuple[list[int], list[list[int]], np.ndarray]:
    """How many rows each cluster has, the sums of their components, and the largest upper bound."""

    def parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, sums, reach = np.zeros(k, np.int64), np.zeros((k, DIM), object), np.zeros(k)
        for b in batches:
            if not len(b):
                continue
            cluster = b["cluster"].to_numpy()
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(reach, cluster, b["upper"].to_numpy())
            for at, x in _by_width(b["x"]):
                own, x = cluster[at], x if x.dtype == object else x.astype(np.int64)
                some = np.zeros((k, DIM), x.dtype)
                np.add.at(some, own, x)
                sums = sums + some.astype(object)
        out = [(c, DIM, 0, int(count[c]), float(reach[c])) for c in range(k) if count[c]]
        out += [(c, i, place, part, 0.0) for c in range(k) if count[c] for i in range(DIM) for place, part in limbs(int(sums[c, i]))]
        yield pd.DataFrame(out, columns=["cluster", "i", "place", "part", "reach"])

    added = rows.select("x", "cluster", "upper").mapInPandas(parts, "cluster int, i int, place int, part long, reach double").groupBy("cluster", "i", "place").agg(F.sum("part").alias("part"), F.max("reach").alias("reach"))
    sizes, sums, reach = [0] * k, [[0] * DIM for _ in range(k)], np.zeros(k)
    for r in added.collect():  # clusters x components
        if r["i"] == DIM:
            sizes[r["cluster"]], reach[r["cluster"]] = r["part"], r["reach"]
        else:
            sums[r["cluster"]][r["i"]] += r["part"] << 30 * r["place"]
    return sizes, sums, reach


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, Centroids]:
    """Rows (STATE) with the cluster of each kept vector, and the centroids."""
    spark, v = vectors.sparkSession, F.col("v")
    fine = F.coalesce(F.size(v) == DIM, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(v.isNotNull()).filter(fine)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(by.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    if not first:
        return spark.createDataFrame([], STATE), Centroids([])

    def begin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "x": _packed(b["v"]), "cluster": np.full(len(b), -1), "upper": math.inf, "lower": -math.inf})

    at = Centroids([[whole(x) for x in r["v"]] for r in first])
    held = assign(rows.mapInPandas(begin, STATE), at)
    for _ in range(rounds):
        sizes, sums, reach = totals(held, len(first))
        at = at.moved([[s // n for s in row] if n else old for n, row, old in zip(sizes, sums, at.exact, strict=True)], reach)
        held = assign(held, at)
    return held, at


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept vector."""
    held, at = cluster(vectors, clusters, rounds, seed)
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(at)

    def measured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own, distance = b["cluster"].to_numpy(), np.zeros(len(b), object)
                for places, x in _by_width(b["x"]):
                    distance[places] = sent.value.squared(x, own[places])
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "cluster": own, "distance": pd.array(distance.tolist(), "Int64")})

    rows = held.select("vec_id", "x", "cluster").mapInPandas(measured, "vec_id long, cluster int, distance long")
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda n: int(n) if n is not None and n < 1 << 63 else None
    inertia = fits(None if None in sums.values() else sum(sums.values()))
    named = [(c, fits(s), inertia, hashlib.sha256(",".join(map(str, at.exact[c])).encode()).hexdigest()) for c, s in sums.items()]
    of = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same table in SQL, for components whose squares and sums are exact in double precision."""
    out = [
        f"WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INT) AS c, v FROM k ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        near = "min(CAST(list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * 64 + c.c)"
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(k.v) AS v, CAST({near} % 64 AS INT) AS c, {near} // 64 AS d FROM k, c{i} c GROUP BY vec_id)")
        if i < rounds:
            parts = f"SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY 1, 2"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(any_value(n.v), any_value(c{i}.v)) AS v FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM ({parts}) GROUP BY 1) n ON n.c = c{i}.c GROUP BY 1)")
    r = rounds
    return ", ".join(out) + (
        f" SELECT vec_id, a{r}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{r}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(list_transform(c{r}.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{r} JOIN c{r} USING (c)"
    )

"""Exact top-k inner products by an index of pivots and distances.

Index: a bounded sample of vectors is clustered into `PIVOTS` pivots. Every vector is keyed by its
nearest pivot and its distance to it, the distance cut into `RINGS` rings; rings that hold many
vectors are dealt into slices of about `SLICE` rows by a hash of the id, so one vector that
is repeated very often is spread as well. A directory of at most PIVOTS x RINGS rows holds each
ring's distances, largest norm and number of slices.

Search: in a first pass a query meets only the ring whose bound is best, which gives it a
threshold that its k-th best score cannot be below. The second pass sends it to every other ring
that the triangle inequality cannot exclude: with |d(q, p) - d(x, p)| <= d(q, x),
    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2  and  q.x <= q.p + |q| d(x, p).
Inside a slice the vectors are sorted by distance and cut into annuli; each query expands them
from the best bound down and stops when the bound falls below its k-th best score. Queries are
dealt into blocks of about `QUERIES`, so a task holds one slice and one block. The k best of all
slices are then merged.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; an empty vector is a vector of zeros; ids that repeat are
separate rows, and a query never meets candidates with its own id; rows with a null id take no part; equal scores go by the
smaller id; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_analytics.llm.tables import hash_sample, shared, written

K = 5
PIVOTS = 32
RINGS = 8
SAMPLE = 4_096
SLICE = 8_192
QUERIES = 2_048
ANNULUS = 256
LOW, HIGH = -2 ** 63 + 1, 2 ** 63 - 1


def floored(vectors: DataFrame) -> DataFrame:
    """vec_id and v: floor(256 x) of every component of the vectors that take part."""
    each = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(each, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        "vec_id", F.transform(each, lambda x: F.floor(x * 256)).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of numbers as a matrix, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, :len(row)] = row
    return out


def find_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Far points first, then a few rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < pivots and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    centres = sample[chosen]
    for _ in range(5):
        cell = distances(sample, centres).argmin(1)
        centres = np.stack([sample[cell == c].mean(0) if (cell == c).any() else centres[c]
                            for c in range(len(centres))])
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def bounds(norm2, to_pivot, with_pivot, near, far, largest2):
    """The largest inner product that a ring of distances [near, far] and norms up to the root of
    `largest2` can hold for a query, with some room for rounding."""
    gap = np.maximum(0, np.maximum(near - to_pivot, to_pivot - far))
    by_distance = (norm2 + largest2 - gap ** 2) / 2
    by_pivot = with_pivot + np.sqrt(norm2) * far
    by_norm = np.sqrt(norm2 * largest2)
    least = np.minimum(np.minimum(by_distance, by_pivot), by_norm)
    return least + 1e-9 * (norm2 + largest2) + 0.5


class Geometry:
    """Pivots and the directory of rings."""

    def __init__(self, pivots: np.ndarray, width: int, step: float = 1.0):
        self.pivots, self.width, self.step = pivots, width, step
        self.rings: np.ndarray | None = None

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, ring, distance) of every vector."""
        d = distances(x, self.pivots)
        cell = d.argmin(1)
        own = d[np.arange(len(x)), cell]
        return cell, np.minimum(own / self.step, RINGS - 1).astype(int), own

    def ring_bounds(self, x: np.ndarray) -> np.ndarray:
        """Queries x rings: the bound of every ring of the directory."""
        d, norm2 = distances(x, self.pivots), (x ** 2).sum(1)
        cell = self.rings[:, 0].astype(int)
        return bounds(norm2[:, None], d[:, cell], (x @ self.pivots.T)[:, cell],
                      self.rings[:, 2], self.rings[:, 3], self.rings[:, 4])


def index(vectors: DataFrame) -> tuple[DataFrame, Geometry]:
    """The keyed vectors, written to the shared folder, and the geometry with its directory."""
    spark = vectors.sparkSession
    floors = floored(vectors)
    width = floors.agg(F.max(F.size("v"))).first()[0] or 0
    sample = hash_sample(floors, "vec_id", SAMPLE).collect()
    points = matrix([r["v"] for r in sample], width)
    geometry = Geometry(find_pivots(points, PIVOTS), width)
    if len(points):
        geometry.step = max(1.0, distances(points, geometry.pivots).min(1).max() / RINGS)
    get = shared(spark, geometry)

    def key(frames):
        own = get()
        for frame in frames:
            x = matrix(frame["v"], own.width)
            cell, ring, distance = own.key(x)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": frame["v"], "cell": cell,
                                "ring": ring, "distance": distance, "norm2": (x ** 2).sum(1)})
    keyed = written(floors.mapInPandas(
        key, "vec_id long, v array<long>, cell int, ring int, distance double, norm2 double"))
    rings = keyed.groupBy("cell", "ring").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"),
        F.max("norm2").alias("largest2"), F.count("*").alias("n")).orderBy("cell", "ring").collect()
    geometry.rings = np.array([[r["cell"], r["ring"], r["near"], r["far"], r["largest2"],
                                -(-r["n"] // SLICE)] for r in rings], float).reshape(-1, 6)
    return keyed, geometry


def best_of(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query, ties to the smaller id."""
    frame = frame.sort_values(["query_id", "query_row", "score", "vec_id"],
                              ascending=[True, True, False, True], kind="stable")
    return frame.groupby(["query_id", "query_row"], sort=False).head(k)


def search_slice(queries: pd.DataFrame, rows: pd.DataFrame, geometry: Geometry,
                 k: int) -> pd.DataFrame:
    """The k best rows of one slice for each of some queries, above their thresholds."""
    rows = rows.sort_values("distance", kind="stable")
    x, q = matrix(rows["v"], geometry.width), matrix(queries["v"], geometry.width)
    ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    exact = np.abs(x).max(initial=1) * np.abs(q).max(initial=1) * max(1, geometry.width) < 2 ** 53
    pivot = geometry.pivots[int(rows["cell"].iloc[0])]
    begins = np.arange(0, len(x), ANNULUS)
    ends = np.minimum(begins + ANNULUS, len(x))
    distance, norm2 = rows["distance"].to_numpy(), rows["norm2"].to_numpy()
    room = bounds((q ** 2).sum(1)[:, None], np.linalg.norm(q - pivot, axis=1)[:, None],
                  (q @ pivot)[:, None], distance[begins], distance[ends - 1],
                  np.maximum.reduceat(norm2, begins))
    order = np.argsort(-room, axis=1, kind="stable")
    least = queries["least"].to_numpy().astype(float)
    best = np.full((len(q), k), LOW)
    best_ids = np.full((len(q), k), HIGH)
    for turn in range(len(begins)):
        ring = order[:, turn]
        alive = np.flatnonzero(room[np.arange(len(q)), ring] >= least)
        for a in np.unique(ring[alive]):
            who = alive[ring[alive] == a]
            part = x[begins[a]:ends[a]]
            scores = (np.rint(q[who] @ part.T).astype(np.int64) if exact else
                      q[who].astype(np.int64) @ part.T.astype(np.int64))
            part_ids = np.broadcast_to(ids[begins[a]:ends[a]], scores.shape)
            same = part_ids == own[who][:, None]
            scores = np.concatenate([best[who], np.where(same, LOW, scores)], 1)
            part_ids = np.concatenate([best_ids[who],
                                       np.where(same, HIGH, part_ids)], 1)
            # only what may reach the k best is sorted in full
            if scores.shape[1] > 4 * k:
                cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
                keep = scores >= cut
                part_ids = np.where(keep, part_ids, HIGH)
                scores = np.where(keep, scores, LOW)
            top = np.lexsort((part_ids, -scores.astype(float) if exact else -scores), axis=1)[:, :k]
            best[who] = np.take_along_axis(scores, top, 1)
            best_ids[who] = np.take_along_axis(part_ids, top, 1)
            least[who] = np.maximum(least[who], np.where(
                best[who, -1] > LOW, best[who, -1].astype(float), -np.inf))
        if not len(alive):
            break
    query, place = np.nonzero(best_ids < HIGH)
    return pd.DataFrame({"query_id": own[query], "query_row": queries["query_row"].to_numpy()[query],
                         "vec_id": best_ids[query, place], "score": best[query, place]})


FOUND = "query_id long, query_row long, vec_id long, score long"


def visit(queries: DataFrame, keyed: DataFrame, geometry: Geometry, k: int, blocks: int,
          first: bool) -> DataFrame:
    """The k best of every slice that the queries visit: in the first pass each only meets
    the ring with the best bound, afterwards all others that its threshold does not exclude."""
    get = shared(keyed.sparkSession, geometry)

    def route(frames):
        own = get()
        for frame in frames:
            if not len(frame):
                continue
            room = own.ring_bounds(matrix(frame["v"], own.width))
            best = room.argmax(1)
            if first:
                where = (np.arange(len(frame)), best)
            else:
                wanted = room >= frame["least"].to_numpy()[:, None]
                wanted[np.arange(len(frame)), best] = False
                where = np.nonzero(wanted)
            slices = own.rings[where[1], 5].astype(int)
            row, ring = np.repeat(where[0], slices), np.repeat(where[1], slices)
            part = np.arange(len(row)) - np.repeat(np.cumsum(slices) - slices, slices)
            out = frame.iloc[row][["query_id", "query_row", "v", "least", "block"]].copy()
            out["cell"], out["ring"] = own.rings[ring, 0].astype(int), own.rings[ring, 1].astype(int)
            out["part"] = part
            yield out

    def meet(key, own_queries, rows):
        if not len(own_queries) or not len(rows):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
        return search_slice(own_queries, rows, get(), k)

    sent = queries.mapInPandas(route, "query_id long, query_row long, v array<long>, least double, "
                                      "block int, cell int, ring int, part int")
    slices = keyed.sparkSession.createDataFrame(
        [(int(r[0]), int(r[1]), int(r[5])) for r in geometry.rings],
        "of_cell int, of_ring int, slices int")
    placed = keyed.join(F.broadcast(slices), (F.col("cell") == F.col("of_cell"))
                        & (F.col("ring") == F.col("of_ring"))).select(
        "vec_id", "v", "distance", "norm2", "cell", "ring",
        F.pmod(F.xxhash64("vec_id", "v"), F.col("slices")).cast("int").alias("part"))
    # repeated rows share id and vector; their own slice would not be bounded
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("cell", "ring", "part", "block")
    return sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(meet, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row for which the
    condition `is_query` on vec_id holds, with every row of another id."""
    keyed, geometry = index(vectors)
    if not len(geometry.rings):
        return keyed.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long")
    asked = keyed.where(is_query)
    blocks = -(-asked.count() // QUERIES) or 1
    queries = asked.select(
        F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("query_row"), "v",
        F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.lit(float("-inf")).alias("least"))
    queries = written(queries)
    seeds = written(visit(queries, keyed, geometry, k, blocks, True))
    own = ("query_id", "query_row")
    least = seeds.groupBy(*own).agg(F.sort_array(F.collect_list("score"), False).alias("s")).select(
        F.col("query_id").alias("i"), F.col("query_row").alias("r"),
        F.when(F.size("s") >= k, F.element_at("s", k)).cast("double").alias("found"))
    ready = queries.join(least, (F.col("query_id") == F.col("i")) & (F.col("query_row") == F.col(
        "r")), "left").select(*own, "v", "block", F.coalesce("found", "least").alias("least"))
    rest = visit(ready, keyed, geometry, k, blocks, False)
    order = Window.partitionBy(*own).orderBy(F.desc("score"), "vec_id")
    return seeds.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


TOPK_SQL = """
with v as (
    select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
    where embedding is not null and vec_id is not null
      and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
pairs as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
    from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5"""

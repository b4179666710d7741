"""Approximate nearest neighbours by inner product in vantage-point trees.

Space: with M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes
(q M / |q|, 0), so both lie on a sphere of radius M and the largest inner product is the smallest
distance: d^2 = 2 M^2 - 2 (q.x) M / |q|. Distances obey the triangle inequality, inner products do not.

Shards: a vantage-point tree of a bounded sample cuts the space into at most 2^`LEVELS` regions; every row
is indexed in its region, a region of many rows is cut into shards of about `SHARD` by a hash of
the row. A directory holds for each region the range of distances to every vantage point above it.
Each shard builds a vantage-point tree of its own rows when it is searched: a node splits its rows at the
median distance to a vantage point, and both halves keep their range of distances.

Search: every query first meets one shard of its own region and so has a k-th best distance t. It then
goes to all shards of regions that may hold a nearer row, and down their trees, near side first. A region
or subtree is left out if factor * b > t, where b is the bound that the triangle inequality gives.
With factor 1 that is exact. A larger factor leaves out more: in many dimensions distances lie close
together and b is far below the distance of any row. Without a factor given, the largest of `FACTORS` is
taken that still finds `TARGET` of what an exact search finds for `TRIALS` rows of the sample. Candidates
are found by matrix products, those that come near the k-th best get the score of one row's own sum, so
equal vectors have equal scores.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; ids that repeat are separate rows, and a query never meets candidates with its
own id; rows with a null id take no part; equal scores go by the smaller id; an empty table gives no
rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_analytics.llm.tables import give_back, hash_sample, shared, written
from capture_analytics.llm.topk import matrix

K = 20
FACTORS = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
TARGET = 0.99
TRIALS = 48
SAMPLE = 16_384
LEVELS = 10           # at most so many levels above the shards
SHARD = 4_096
LEAF = 64
VANTAGES = 5          # rows that are tried as vantage point of a node
ASKED = 4_096         # queries that are searched together
ASKED_BLOCK = 1 << 16  # queries of a region that one task answers
EPS = 1e-9
HIGH = 2 ** 63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, as doubles, of the rows that take part."""
    each = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(each, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), each.alias("v"),
                          fine.alias("fine")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.col("fine")
        & F.exists("v", lambda x: x != 0)).select("vec_id", "v")


# ---- space and trees ------------------------------------------------------------------

class Space:
    """Vectors and queries as points of one sphere."""

    def __init__(self, width: int, norm: float):
        self.width, self.norm = width, norm

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.norm / np.linalg.norm(q, axis=1))[:, None]
        return np.concatenate([scaled, np.zeros((len(q), 1))], 1)

    def distance(self, scores: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The distance that belongs to an inner product of each query."""
        scaled = scores * self.norm / np.linalg.norm(q, axis=1)
        return np.sqrt(np.maximum(2 * self.norm ** 2 - 2 * scaled, 0))


def far(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vantage) ** 2).sum(1))


class Tree:
    """A vantage-point tree. `order` holds the rows leaf by leaf; a node is a run of it with a vantage
    point, the middle, and the range of distances of either half."""

    def __init__(self, points: np.ndarray, leaf: int, levels: int = 64):
        self.points, self.leaf, self.levels = points, leaf, levels
        self.order = np.arange(len(points))
        self.nodes: dict[tuple[int, int], tuple] = {}
        self._split(0, len(points), 0)
        self.points = points[self.order]

    def _split(self, begin: int, end: int, level: int) -> None:
        if end - begin <= self.leaf or level == self.levels:
            return
        rows = self.order[begin:end]
        best = None
        for k in range(VANTAGES):
            vantage = self.points[rows[k * (len(rows) - 1) // max(1, VANTAGES - 1)]]
            d = far(self.points[rows], vantage)
            if best is None or d.std() > best[1].std():
                best = vantage, d
        vantage, d = best
        half = len(rows) // 2
        side = np.argpartition(d, half)
        self.order[begin:end], d = rows[side], d[side]
        middle = begin + half
        self.nodes[begin, end] = (vantage, middle, (d[:half].min(), d[:half].max()),
                                  (d[half:].min(), d[half:].max()))
        self._split(begin, middle, level + 1)
        self._split(middle, end, level + 1)


class Best:
    """The k best rows that each of some queries has met."""

    def __init__(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, space: Space):
        self.q, self.own, self.k, self.space = q, own, k, space
        self.least, self.reach = least, space.distance(least, q)
        self.scores = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), HIGH)

    def meet(self, who: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Some queries meet all of some rows."""
        room = EPS * (1 + np.abs(self.q[who]).max() * np.abs(x).max() * x.shape[1])
        near = self.q[who] @ x.T
        near[ids[None, :] == self.own[who][:, None]] = -np.inf
        cut = np.maximum(self.least[who], np.partition(near, -self.k, axis=1)[:, -self.k]
                         if len(x) >= self.k else -np.inf)
        a, b = np.nonzero((near >= cut[:, None] - room) & (near > -np.inf))
        if not len(a):
            return
        # a row's own sum: the same for equal vectors, whatever they are met with
        exact = (self.q[who[a]] * x[b]).sum(1)
        query = np.concatenate([np.repeat(who, self.k), who[a]])
        scores = np.concatenate([self.scores[who].ravel(), exact])
        found = np.concatenate([self.ids[who].ravel(), ids[b]])
        order = np.lexsort((found, -scores, query))
        query, scores, found = query[order], scores[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.scores[query[kept], place[kept]] = scores[kept]
        self.ids[query[kept], place[kept]] = found[kept]
        self.least[who] = np.maximum(self.least[who], self.scores[who, -1])
        self.reach[who] = self.space.distance(self.least[who], self.q[who])


def search_tree(tree: Tree, x: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
    """All queries go down the tree, the near half first, and leave out halves that are too far."""
    asked = best.space.asked(best.q)
    room = EPS * (1 + best.space.norm)
    stack = [(0, len(x), np.arange(len(best.q)), np.zeros(len(best.q)))]
    while stack:
        begin, end, who, bound = stack.pop()
        alive = factor * (bound - room) <= best.reach[who]
        who, bound = who[alive], bound[alive]
        if not len(who):
            continue
        node = tree.nodes.get((begin, end))
        if node is None:
            best.meet(who, x[begin:end], ids[begin:end])
            continue
        vantage, middle, inner, outer = node
        d = far(asked[who], vantage)
        gaps = [np.maximum(bound, np.maximum(low - d, d - high)) for low, high in (inner, outer)]
        halves = [(begin, middle), (middle, end)]
        inside = gaps[0] < gaps[1]
        inside |= (gaps[0] == gaps[1]) & (d <= inner[1])
        for first in (0, 1):
            mine = inside if first == 0 else ~inside
            stack.append((*halves[1 - first], who[mine], gaps[1 - first][mine]))
        for first in (0, 1):
            mine = inside if first == 0 else ~inside
            stack.append((*halves[first], who[mine], gaps[first][mine]))


def calibrated(x: np.ndarray, space: Space, k: int) -> float:
    """The largest factor with which a tree of some rows finds nearly all neighbours of a few of them."""
    tree = Tree(space.points(x), LEAF)
    x, ids = x[tree.order], np.arange(len(x))
    trials = np.unique(np.linspace(0, len(x) - 1, TRIALS).astype(int))

    def scores(factor: float) -> np.ndarray:
        best = Best(x[trials], ids[trials], np.full(len(trials), -np.inf), k, space)
        search_tree(tree, x, ids, best, factor)
        return best.scores
    exact = scores(FACTORS[0])[:, -1:]
    good, bad = 0, len(FACTORS)
    while bad - good > 1:
        middle = (good + bad) // 2
        # equal scores are equally good
        found = (scores(FACTORS[middle]) >= exact).mean() >= TARGET
        good, bad = (middle, bad) if found else (good, middle)
    return FACTORS[good]


# ---- regions and shards -----------------------------------------------------------------

class Regions:
    """The tree above the shards: `paths[i]` lists the vantage points above region i with its side of
    each; `near` and `far` hold the range of distances that the region's rows have to them."""

    def __init__(self, space: Space, sample: np.ndarray, levels: int):
        self.space = space
        tree = Tree(space.points(sample), 1, levels)
        self.vantages, self.cuts, self.paths = [], [], []
        self._walk(tree, 0, len(sample), [], levels)
        self.near = self.far = self.shards = None
        self.factor = 1.0

    def _walk(self, tree: Tree, begin: int, end: int, path: list, levels: int) -> None:
        node = tree.nodes.get((begin, end))
        if node is None:
            self.paths.append(path)
            return
        vantage, middle, inner, outer = node
        number = len(self.vantages)
        self.vantages.append(vantage)
        self.cuts.append((inner[1] + outer[0]) / 2)
        self._walk(tree, begin, middle, [*path, (number, 0)], levels)
        self._walk(tree, middle, end, [*path, (number, 1)], levels)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Points x vantage points."""
        if not self.vantages:
            return np.zeros((len(points), 0))
        return np.stack([far(points, v) for v in self.vantages], 1)

    def region(self, d: np.ndarray) -> np.ndarray:
        """The region of each row of distances."""
        out = np.zeros(len(d), np.int64)
        outside = d > np.array(self.cuts)
        for i, path in enumerate(self.paths):
            mine = np.ones(len(d), bool)
            for number, side in path:
                mine &= outside[:, number] == bool(side)
            out[mine] = i
        return out

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Queries x regions that hold rows: the least distance that the directory leaves."""
        out = np.zeros((len(d), len(self.paths)))
        for i, path in enumerate(self.paths):
            for level, (number, _) in enumerate(path):
                gap = np.maximum(self.near[i, level] - d[:, number], d[:, number] - self.far[i, level])
                out[:, i] = np.maximum(out[:, i], gap)
        out[:, self.shards == 0] = np.inf
        return out


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> tuple[DataFrame, Regions | None]:
    """Every usable row with its number and region, written to the shared folder, and the regions."""
    spark, rows = vectors.sparkSession, usable(vectors)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    width, n, largest2 = rows.agg(F.max(F.size("v")), F.count("*"), F.max(norm2)).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("row"), "v",
                           F.lit(0).alias("region")), None
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(n / shard)))))
    sample = matrix([r["v"] for r in hash_sample(rows, "vec_id", SAMPLE).collect()], width)
    regions = Regions(Space(width, float(np.sqrt(largest2))), sample, levels)
    regions.factor = calibrated(sample, regions.space, k)
    get = shared(spark, regions)

    def place(batches):
        own = get()
        for batch in batches:
            d = own.distances(own.space.points(dense(batch["v"], own.space.width)))
            region = own.region(d)
            path = [[float(d[i, number]) for number, _ in own.paths[r]] for i, r in enumerate(region)]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(region.astype(np.int32)),
                 pa.array(path, pa.list_(pa.float64()))], ["vec_id", "v", "region", "path"])
    placed = written(rows.mapInArrow(
        place, "vec_id long, v array<double>, region int, path array<double>").withColumn(
        "row", F.monotonically_increasing_id()))
    ends = [f(F.try_element_at("path", F.lit(k + 1))) for k in range(levels) for f in (F.min, F.max)]
    found = placed.groupBy("region").agg(F.count("*").alias("n"), *ends).collect()
    regions.near = np.zeros((len(regions.paths), levels))
    regions.far = np.zeros((len(regions.paths), levels))
    regions.shards = np.zeros(len(regions.paths), np.int64)
    for r in found:
        regions.shards[r[0]] = -(-r[1] // shard)
        for k in range(len(regions.paths[r[0]])):
            regions.near[r[0], k], regions.far[r[0], k] = r[2 + 2 * k], r[3 + 2 * k]
    return placed.select("vec_id", "row", "v", "region"), regions


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as a matrix, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


# ---- search -----------------------------------------------------------------------------

FOUND = "query_id long, query_row long, vec_id long, score double"


def routed(queries: DataFrame, regions: Regions, factor: float, first: bool) -> DataFrame:
    """The queries (vec_id, row, v, region, least) with each shard that they visit: first one of
    their own region, then all others within reach."""
    get = shared(queries.sparkSession, regions)

    def route(batches):
        own = get()
        for batch in batches:
            q = dense(batch["v"], own.space.width)
            row, region = batch["row"].to_numpy(), batch["region"].to_numpy()
            home = row % own.shards[region]
            if first:
                which, at, shard = np.arange(len(q)), region, home
            else:
                bounds = own.bounds(own.distances(own.space.asked(q)))
                reach = own.space.distance(batch["least"].to_numpy(), q)
                room = EPS * (1 + own.space.norm)
                which, at = np.nonzero(factor * (bounds - room) <= reach[:, None])
                n = own.shards[at]
                shard = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                which, at = np.repeat(which, n), np.repeat(at, n)
                other = (at != region[which]) | (shard != home[which])
                which, at, shard = which[other], at[other], shard[other]
            taken = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(shard.astype(np.int32)), taken["vec_id"],
                 taken["row"], taken["least"], taken["v"]],
                ["region", "shard", "id", "row", "least", "v"])
    return queries.mapInArrow(
        route, "region int, shard int, id long, row long, least double, v array<double>")


def answer(batches, space: Space, factor: float, k: int):
    """Rows of shards, stored ones before queries, as the k best that each query meets there."""
    current, stored, tree, asked = None, [], None, []

    def found():
        nonlocal asked
        if tree is not None and asked:
            ids, rows, least, q = (np.concatenate([a[i] for a in asked]) for i in range(4))
            best = Best(q, ids, least.copy(), k, space)
            search_tree(tree, tree.x, tree.ids, best, factor)
            query, place = np.nonzero((best.ids < HIGH) & (best.scores >= least[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[query]), pa.array(rows[query]), pa.array(best.ids[query, place]),
                 pa.array(best.scores[query, place])], [c.split()[0] for c in FOUND.split(", ")])
        asked = []

    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("region", "shard", "block", "asks")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            rows = tuple(part[c].to_numpy() for c in ("id", "row", "least"))
            rows += (dense(part["v"], space.width),)
            if tuple(keys[begin, :3]) != current:
                yield from found()
                current, stored, tree = tuple(keys[begin, :3]), [], None
            if not keys[begin, 3]:
                stored.append(rows)
                continue
            if tree is None and stored:
                x = np.concatenate([s[3] for s in stored])
                tree = Tree(space.points(x), LEAF)
                tree.x = x[tree.order]
                tree.ids = np.concatenate([s[0] for s in stored])[tree.order]
            asked.append(rows)
            if sum(len(a[0]) for a in asked) >= ASKED:
                yield from found()
    yield from found()
    give_back()


def visit(queries: DataFrame, placed: DataFrame, regions: Regions, factor: float, k: int,
          first: bool) -> DataFrame:
    """The k best of each shard that the queries visit, above what they have."""
    spark = placed.sparkSession
    sent = routed(queries, regions, factor, first)
    # one task answers a bounded number of queries; a shard is copied for more
    load = {r[0]: r[1] for r in sent.where("shard = 0").groupBy("region").count().collect()}
    blocks = spark.createDataFrame(
        [(i, int(n), -(-load.get(i, 0) // ASKED_BLOCK) or 1) for i, n in enumerate(regions.shards)],
        "at int, shards int, blocks int")
    here = F.col("region") == F.col("at")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
    asked = sent.join(F.broadcast(blocks), here).select(
        "region", "shard", block.alias("block"), F.lit(1).alias("asks"), "id", "row", "least", "v")
    rows = placed.join(F.broadcast(blocks), here).select(
        "region", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("asks"),
        F.col("vec_id").alias("id"), "row", F.lit(0.0).alias("least"), "v")
    get = shared(spark, regions.space)
    keys = ("region", "shard", "block")
    return rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(
        lambda batches: answer(batches, get(), factor, k), FOUND)


def nearest(vectors: DataFrame, is_query, k: int = K, factor: float | None = None,
            shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row for which the
    condition `is_query` on vec_id holds, among all rows of another id; exact with factor 1. Without a
    factor it is calibrated on the sample."""
    placed, regions = index(vectors, k, shard)
    spark = placed.sparkSession
    if regions is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    factor = regions.factor if factor is None else factor
    queries = placed.where(is_query).withColumn("least", F.lit(float("-inf")))
    seeds = written(visit(queries, placed, regions, factor, k, True))
    kth = seeds.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    ready = queries.drop("least").join(
        kth, F.col("row") == F.col("query_row"), "left").select(
        "vec_id", "row", "v", "region",
        F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("least"))
    rest = visit(ready, placed, regions, factor, k, False)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return seeds.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

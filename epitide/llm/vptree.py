"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality.

Vectors are compared on the unit sphere, where the straight distance sqrt(2 - 2 cos) is a metric and the largest cosine
is the smallest distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epitide.llm.caps import units
from epitide.session import cut

#: Vectors that a shard's tree holds about; a shard of the router beyond twice as many is cut into pieces.
SHARD_ROWS = 4096
#: Bounds of the sample that fits the router and the factor, for each vector length.
SAMPLE, SAMPLE_BYTES, SHARDS_AT_MOST = 4096, 16 << 20, 256
#: Vectors in a leaf, candidates for a vantage point, and queries that search a tree at a time.
LEAF, CANDIDATES, QUERIES_AT_ONCE = 32, 8, 512
#: Distances are right to about this much (their squares to 1e-15).
EXACT = 1e-7
#: Tried factors, largest first.
FACTORS = tuple(float(x) for x in np.round(np.geomspace(64, 1, 37), 3))


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


@dataclass(frozen=True)
class Tree:
    """Points in tree order. Node i covers the rows ``spans[i]``; its vantage point is row ``centres[i]``, its
    children are ``kids[i]`` (near, far; -1 in a leaf), whose distances from it lie in ``rims[i]`` (near low, high, far low, high)."""

    points: np.ndarray
    spans: np.ndarray
    centres: np.ndarray
    kids: np.ndarray
    rims: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> tuple[Tree, np.ndarray]:
        """The tree and the order in which it holds the points. Halves are equal in size, also among equal distances."""
        rng = np.random.default_rng(seed)
        order = np.arange(len(points))
        spans, centres, kids, rims = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, up, side = todo.pop()
            me = len(spans)
            spans.append((a, b))
            centres.append(a)
            kids.append([-1, -1])
            rims.append((0.0, 0.0, 0.0, 0.0))
            if up >= 0:
                kids[up][side] = me
            if b - a <= leaf:
                continue
            here = order[a:b].copy()
            tried = rng.choice(b - a, min(CANDIDATES, b - a), replace=False)
            far = distance(points[here] @ points[here[tried]].T)
            best = int(np.argmax(far.std(axis=0)))
            middle = (b - a) // 2
            by = np.argpartition(far[:, best], middle)
            d = far[by, best]
            order[a:b] = here[by]
            centres[me] = here[tried[best]]
            rims[me] = (d[:middle].min(), d[:middle].max(), d[middle:].min(), d[middle:].max())
            todo += [(a + middle, b, me, 1), (a, a + middle, me, 0)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        inner = [place[c] if k[0] >= 0 else c for c, k in zip(centres, kids)]
        return cls(points[order], np.array(spans).reshape(-1, 2), np.array(inner), np.array(kids).reshape(-1, 2), np.array(rims)), order

    def children(self, node: int, queries: np.ndarray, least: np.ndarray):
        """For both children: the node, and the distance that the triangle inequality leaves between it and each query at least."""
        d = distance(queries @ self.points[self.centres[node]])
        low, high, far_low, far_high = self.rims[node]
        return ((self.kids[node, 0], np.maximum(least, np.maximum(low - d, d - high))),
                (self.kids[node, 1], np.maximum(least, np.maximum(far_low - d, d - far_high))))

    def homes(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query falls into, going to the nearer child at every node."""
        out = np.zeros(len(queries), dtype=np.int64)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node, 0] < 0 or not len(rows):
                out[rows] = node
                continue
            (near, a), (far, b) = self.children(node, queries[rows], np.full(len(rows), -4.0))
            todo += [(near, rows[a <= b]), (far, rows[a > b])]
        return out

    def search(self, queries: np.ndarray, k: int, factor: float, reach: np.ndarray | None = None):
        """Rows and cosines of the ``k`` nearest points found for each query (-1 and -inf where there are fewer), and the points compared.

        A branch is passed over if ``factor`` times the least distance that the triangle inequality leaves
        exceeds the query's reach: the k-th distance so far, or what it came with. With factor 1
        nothing nearer can lie there, so the search is exact; larger factors pass over more.
        """
        n = len(queries)
        best, rows = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        reach = np.full(n, np.inf) if reach is None else reach.copy()
        compared = 0
        homes = self.homes(queries)
        for leaf in np.unique(homes):
            mine = np.flatnonzero(homes == leaf)
            a, b = self.spans[leaf]
            if b - a >= k:
                cosines = np.partition(queries[mine] @ self.points[a:b].T, b - a - k, axis=1)[:, b - a - k]
                reach[mine] = np.minimum(reach[mine], distance(cosines))
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            node, active, least = todo.pop()
            open_ = factor * least <= reach[active] + EXACT
            active, least = active[open_], least[open_]
            if not len(active):
                continue
            if self.kids[node, 0] < 0:
                a, b = self.spans[node]
                compared += len(active) * (b - a)
                cosines = np.concatenate([best[active], queries[active] @ self.points[a:b].T], axis=1)
                ids = np.concatenate([rows[active], np.broadcast_to(np.arange(a, b), (len(active), b - a))], axis=1)
                top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                best[active] = np.take_along_axis(cosines, top, axis=1)
                rows[active] = np.take_along_axis(ids, top, axis=1)
                reach[active] = np.minimum(reach[active], distance(np.maximum(best[active].min(axis=1), -1.0)) + 4 * np.isinf(best[active]).any(axis=1))
                continue
            (near, d_near), (far, d_far) = self.children(node, queries[active], least)
            both = [(far, active, d_far), (near, active, d_near)]
            todo += both if (d_near <= d_far).mean() >= 0.5 else both[::-1]
        return rows, best, compared


@dataclass(frozen=True)
class Router:
    """The upper part of the trees: which shard a vector belongs to, and which shards a query can pass over."""

    tree: Tree
    factor: float

    @classmethod
    def fit(cls, sample: np.ndarray, shards: int, k: int, recall: float) -> Router:
        """From a bounded sample: median splits down to ``shards`` leaves, and the largest factor with which the
        sample's own tree finds ``recall`` of the k nearest of 128 of its vectors."""
        tree, _ = Tree.build(sample, leaf=max(1, -(-len(sample) // shards)))
        fine, _ = Tree.build(sample, leaf=8)
        asked = sample[np.linspace(0, len(sample) - 1, min(128, len(sample))).astype(int)]
        k = min(k, len(sample))
        exact = -np.partition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
        want = exact.min(axis=1) - 1e-12
        for factor in FACTORS:
            _, found, _ = fine.search(asked, k, factor)
            if (found >= want[:, None]).mean() >= recall:
                return cls(tree, factor)
        return cls(tree, 1.0)

    def shards(self, vectors: np.ndarray, reach: np.ndarray | None = None, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and shards (leaf nodes). Without ``reach`` the one shard of each vector; with it, every shard that
        the relaxed triangle inequality does not rule out. A child takes what lies on its side of the middle of
        the gap between the two, so the bounds hold for vectors outside the sample as well."""
        tree, out_rows, out_shards = self.tree, [], []
        todo = [(0, np.arange(len(vectors)), np.zeros(len(vectors)))]
        while todo:
            node, rows, least = todo.pop()
            if not len(rows):
                continue
            if tree.kids[node, 0] < 0:
                out_rows.append(rows)
                out_shards.append(np.full(len(rows), node))
                continue
            d = distance(vectors[rows] @ tree.points[tree.centres[node]])
            middle = (tree.rims[node, 1] + tree.rims[node, 2]) / 2
            if reach is None:
                near = d <= middle
                far = ~near
                near_least = far_least = least
            else:
                near_least, far_least = np.maximum(least, d - middle), np.maximum(least, middle - d)
                near, far = (factor * x <= reach[rows] + EXACT for x in (near_least, far_least))
            todo += [(tree.kids[node, 0], rows[near], near_least[near]), (tree.kids[node, 1], rows[far], far_least[far])]
        if not out_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_rows), np.concatenate(out_shards)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, added up in order, within [-1, 1]."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)

    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def per_size(table: pa.Table):
    size = table["size"].to_numpy()
    for d in np.unique(size):
        yield int(d), np.flatnonzero(size == d)


def matrix(column, rows) -> np.ndarray:
    return units(column.take(pa.array(rows)))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, recall: float = 0.98, factor: float | None = None,
            shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for every row whose id is divisible by ``every``.

    Candidates are all rows but the query's own, nearness the cosine in double precision; ties go to the smaller
    id, rows without id last. If fewer than k candidates exist, all are returned. NULL, empty or zero vectors and those with NULL or non-finite
    components take no part; vectors of different length never meet. A row without id is a candidate
    and no query. Repeated rows are rows of their own. An empty table gives an empty table; other columns are not read.

    Equal vectors are indexed once, with their k + 1 smallest ids. The router is fitted on a sample
    (``SAMPLE`` vectors of a length, 16 MB at most); every vector is indexed, in a tree of about ``shard_rows``.
    Queries search their own shard first; what they find there rules out most others. ``factor`` relaxes the triangle
    inequality: 1 makes the search exact, more prunes more. By default it is the largest that finds ``recall``
    of the true neighbours within the sample.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    ranked = rows.withColumn("asks", asks).withColumn(
        "at", F.row_number().over(Window.partitionBy("vector", "asks").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("at") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))), 1, k + 1)["vec_id"]
    classes = cut(ranked.groupBy("vector").agg(ids.alias("ids"), F.max("asks").alias("asks")).select(
        F.monotonically_increasing_id().alias("cid"), F.size("vector").alias("size"), "vector", "ids", "asks"), "classes")

    counts = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}
    routers = {}
    for d, n in counts.items():
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
        drawn = classes.where(F.col("size") == d).orderBy(F.xxhash64("vector")).limit(most).select("vector").toArrow()
        sample = matrix(drawn["vector"].combine_chunks(), np.arange(len(drawn)))
        shards = 1 << int(np.ceil(np.log2(max(1, min(SHARDS_AT_MOST, len(sample) // 16, n / shard_rows)))))
        routers[d] = Router.fit(sample, shards, k + 1, recall)
    relaxed = {d: r.factor if factor is None else float(factor) for d, r in routers.items()}
    shared = spark.sparkContext.broadcast(routers)

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard = np.zeros(len(table), dtype=np.int32)
            for d, at in per_size(table):
                own, nodes = shared.value[d].shards(matrix(batch.column("vector"), at))
                shard[at[own]] = nodes
            yield batch.append_column("shard", pa.array(shard))

    placed = cut(classes.select("cid", "size", "vector", "asks")
                 .mapInArrow(place, "cid long, size int, vector array<double>, asks boolean, shard int"), "placed")
    pieces = cut(placed.groupBy("size", "shard").agg(
        F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / shard_rows)).cast("int").alias("pieces")), "pieces")
    index = placed.join(F.broadcast(pieces), ["size", "shard"]).select(
        "size", "shard", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int").alias("piece"), "cid", "vector")
    queries = cut(placed.where("asks").select("cid", "size", "vector", "shard", F.lit(None).cast("double").alias("reach")), "queries")
    keep = k + 4  # its own class, k others, and some that may come before these by the last bit of a cosine

    def found(visits: DataFrame) -> DataFrame:
        """The nearest classes of every visit (a query in a shard), searched in blocks of queries against the shard's trees."""
        blocks = visits.groupBy("size", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("blocks")).join(
            F.broadcast(pieces), ["size", "shard"])
        left = index.join(F.broadcast(blocks.select("size", "shard", "blocks")), ["size", "shard"]).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = visits.join(F.broadcast(blocks), ["size", "shard"]).withColumn(
            "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

        def search(points: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(points) or not len(asked):
                return pa.table({"cid": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
            points = points.sort_by("cid")
            x, q = (units(t["vector"].combine_chunks()) for t in (points, asked))
            tree, order = Tree.build(x)
            reach = asked["reach"].to_numpy(zero_copy_only=False).astype(np.float64)
            got, cosines, _ = tree.search(q, min(keep, len(x)), relaxed[x.shape[1]], np.where(np.isnan(reach), np.inf, reach))
            of, column = np.nonzero(got >= 0)
            near = points["cid"].to_numpy()[order[got[of, column]]]
            return pa.table({"cid": asked["cid"].to_numpy()[of], "near": near, "cosine": cosines[of, column]})

        key = ["size", "shard", "piece", "block"]
        each = left.select(*key, "cid", "vector").groupBy(*key).cogroup(right.select(*key, "cid", "vector", "reach").groupBy(*key)).applyInArrow(
            search, "cid long, near long, cosine double")
        return best(each)

    def best(candidates: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cosine"), "near"))
        return candidates.withColumn("at", at).where(F.col("at") <= keep)

    home = cut(found(queries), "home")
    reach = home.where(F.col("at") == k + 1).select("cid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("reach"))
    known = queries.drop("reach").join(reach, "cid", "left")

    def visit(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)
            for d, at in per_size(table):
                far = np.where(np.isnan(reach[at]), np.inf, reach[at])
                of, nodes = shared.value[d].shards(matrix(batch.column("vector"), at), far, relaxed[d])
                away = nodes != batch.column("shard").to_numpy()[at[of]]
                part = batch.take(pa.array(at[of[away]]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nodes[away].astype(np.int32)), part.columns[4]], batch.schema.names)

    kinds = "cid long, size int, vector array<double>, shard int, reach double"
    visits = cut(known.select("cid", "size", "vector", "shard", "reach").mapInArrow(visit, kinds), "visits")
    near = cut(best(home.drop("at").unionByName(found(visits).drop("at"))).select("cid", "near"), "near")

    asked = classes.where("asks").select("cid", F.col("vector").alias("q"))
    scored = near.join(asked, "cid").join(classes.select(F.col("cid").alias("near"), "vector", "ids"), "near").select(
        "cid", (F.col("near") == F.col("cid")).alias("own"), cosine(F.col("q"), F.col("vector")).alias("score"), F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    listed = scored.withColumn("at", order).where(F.col("at") <= k + 1).groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("at", "vec_id", "score", "own"))).alias("listed"))
    answers = cut(asked.join(listed, "cid").select("q", "listed"), "answers")
    out = rows.where(asks).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")).join(answers, "q")
    mine = F.array_position(F.transform("listed", lambda x: F.coalesce(x["own"] & (x["vec_id"] == F.col("query_id")), F.lit(False))), True)
    others = F.slice(F.filter("listed", lambda x, i: i + 1 != mine), 1, k)
    return out.select("query_id", F.posexplode(others).alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))

"""Embedding near-duplicates by spherical caps: product codes, joined on shared filters, verified."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import components
from epitide.session import cut

#: Vectors decoded, and pairs verified at a time.
VECTORS_AT_ONCE, PAIRS_AT_ONCE = 2048, 1 << 19


@dataclass(frozen=True)
class Caps:
    """Random product codes. A filter is a pair of codewords, one for each half of the rotated vector.

    ``codes`` independent codes of ``words`` codewords a half give codes * words^2 filters; a vector
    belongs to all whose direction it exceeds by ``height``. More words with a larger height make caps
    smaller (fewer chance meetings) at the same recall.
    """

    codes: int
    words: int
    height: float
    seed: int = 7

    @classmethod
    def of(cls, size: int, threshold: float, miss: float = 0.001, pairs: int = 1000, codes: int = 4, seed: int = 7) -> Caps:
        """The highest caps that miss no more than ``miss`` of random pairs just at ``threshold``.

        Found by trial on ``pairs`` seeded pairs of the vectors' length, so it costs the same on any table.
        Closer pairs are missed less. Short vectors have fewer codewords.
        """
        words = next(w for s, w in ((48, 2048), (24, 512), (12, 64), (0, 8)) if size >= s)
        rng = np.random.default_rng([seed, size])
        a = rng.normal(size=(pairs, size))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(pairs, size))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = threshold * a + np.sqrt(max(0.0, 1 - threshold ** 2)) * b if size > 1 else a
        height = min(0.9, 4.6 / np.sqrt(size))
        while True:
            caps = cls(codes, words, round(float(height), 3), seed)
            (rows_a, filters_a), (rows_b, filters_b) = caps.decode(a), caps.decode(b)
            space = codes * words * words
            met = np.unique(np.intersect1d(rows_a * space + filters_a, rows_b * space + filters_b) // space)
            if len(met) >= (1 - miss) * pairs or height < -1:
                return caps
            height -= 0.01

    def code(self, number: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, number, size])
        rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        halves = []
        for width in (size - size // 2, size // 2):
            words = rng.normal(size=(self.words, max(width, 1)))
            halves.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(2))
        return rotation, halves[0], halves[1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` (unit vectors) and the filters they belong to.

        List decoding: a half scores each of its codewords once; only words that can reach the
        height with the best word of the other half are combined.
        """
        rows, filters = [], []
        half = x.shape[1] - x.shape[1] // 2
        for number in range(self.codes):
            rotation, first, second = self.code(number, x.shape[1])
            turned = x @ rotation
            a = turned[:, :half] @ first.T
            b = turned[:, half:] @ second.T if x.shape[1] > 1 else np.zeros((len(x), self.words))
            need_a, need_b = self.height - b.max(axis=1), self.height - a.max(axis=1)
            for i in range(len(x)):
                u, v = np.flatnonzero(a[i] >= need_a[i]), np.flatnonzero(b[i] >= need_b[i])
                if len(u) and len(v):
                    p, q = np.nonzero(a[i, u][:, None] + b[i, v][None, :] >= self.height)
                    filters.append((number * self.words + u[p]) * self.words + v[q])
                    rows.append(np.full(len(p), i))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(filters)


def units(column) -> np.ndarray:
    """Matrix of unit vectors in double precision from an Arrow list column of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def first_common(flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First common value of two sorted lists of ``flat`` that start at ``a`` and ``b`` and share one."""
    a, b, out = a.copy(), b.copy(), np.empty(len(a), dtype=flat.dtype)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = flat[a[open_]], flat[b[open_]]
        met = x == y
        out[open_[met]] = x[met]
        a[open_] += x < y
        b[open_] += y < x
        open_ = open_[~met]
    return out


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number that each of ``size`` numbers reaches by the links (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside the buckets of ``table``, whose rows are sorted by bucket.

    A pair of classes is counted in the first filter that both share, so each link counts once. Output:
    for each class of a link, the class it hangs on within the bucket and the vectors it links to.
    """
    bucket = np.zeros(len(table), dtype=np.int64)
    for name in ("label", "size", "filter", "i", "j"):
        c = table[name].combine_chunks().to_numpy(zero_copy_only=False)
        bucket[1:] += c[1:] != c[:-1]
    bucket = np.cumsum(bucket > 0)
    ends = np.searchsorted(bucket, bucket, side="right")
    cid, weight = table["cid"].to_numpy(), table["n"].to_numpy()
    side, i, j, own = (table[c].to_numpy() for c in ("side", "i", "j", "filter"))
    sizes = table["size"].to_numpy()
    lists = table["filters"].combine_chunks()
    flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    vectors, place = table["vector"].combine_chunks(), np.zeros(len(table), dtype=np.int64)
    unit = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        place[rows] = np.arange(len(rows))
        unit[d] = units(vectors.take(pa.array(rows)))
    count = ends - np.arange(len(table)) - 1
    links = np.zeros(len(table), dtype=np.int64)
    found_a, found_b = [], []
    bound = np.cumsum(count)
    at = 0
    while at < len(table):
        done = bound[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(bound, done + PAIRS_AT_ONCE, side="right")))
        a = np.repeat(np.arange(at, stop), count[at:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(bound[at:stop] - count[at:stop] - done, count[at:stop])
        across = (i[a] == j[a]) | (side[a] != side[b])
        a, b = a[across], b[across]
        close = np.zeros(len(a), dtype=bool)
        for d, u in unit.items():
            of = np.flatnonzero(sizes[a] == d)
            close[of] = np.einsum("nk,nk->n", u[place[a[of]]], u[place[b[of]]]) >= threshold
        a, b = a[close], b[close]
        mine = first_common(flat, starts[a], starts[b]) == own[a]
        a, b = a[mine], b[mine]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        found_a.append(a)
        found_b.append(b)
        at = stop
    root = roots(len(table), np.concatenate(found_a), np.concatenate(found_b)) if found_a else np.arange(len(table))
    some = np.flatnonzero(links)
    return pa.table({"cid": cid[some], "root": cid[root[some]], "links": links[some]})


def same_bucket(table: pa.Table, a: int, b: int) -> bool:
    return all(table[c][a] == table[c][b] for c in ("label", "size", "filter", "i", "j"))


def verified(threshold: float):
    """For ``mapInArrow``: whole buckets of sorted rows at a time; an unfinished bucket waits for its rest."""

    def run(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([waiting, now]) if waiting is not None else now
            last, low, high = len(now) - 1, 0, len(now) - 1
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if same_bucket(now, middle, last) else (middle + 1, high)
            if low:
                yield from verify(now.slice(0, low), threshold).to_batches()
            waiting = now.slice(low)
        if waiting is not None and len(waiting):
            yield from verify(waiting, threshold).to_batches()

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, caps: Caps | None = None, block: int = 512,
                     vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector.

    Vectors link if their labels are equal and their cosine, in double precision, is at least
    ``threshold``. Both must share a filter of ``caps`` to be found; by default the caps are those that
    miss about one in a thousand of pairs just at the threshold, and closer pairs less. Vectors that are NULL, empty, zero or
    hold NULL or non-finite components, and those without label, link with nothing. Vectors
    of different length never link. Equal vectors of a label are one class, whatever their number:
    they link with each other, and their links count their rows. A vector without vec_id links, but
    names no component; its ``kept`` is false. Repeated rows count as vectors of their own. An
    empty table gives an empty table; other columns are not read.

    A bucket of more than ``block`` classes is cut into blocks, and pairs of blocks meet in tasks of
    their own. Pairs are never written: a bucket gives one row for each class that has a link.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = (F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))
             & F.exists("vector", lambda x: x != 0))
    valid = F.coalesce(valid, F.lit(False))
    classes = cut(rows.where(valid).groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
                  .select("label", F.size("vector").alias("size"), "vector", "least", "n",
                          F.monotonically_increasing_id().alias("cid")), "classes")

    sizes = [r[0] for r in classes.select("size").distinct().collect()]
    of = {d: caps or Caps.of(d, threshold) for d in sizes}

    def decode(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                for a in range(0, len(rows), VECTORS_AT_ONCE):
                    part = batch.take(pa.array(rows[a:a + VECTORS_AT_ONCE]))
                    at, filters = of[int(d)].decode(units(part.column("vector")))
                    picked = part.select(["label", "size", "cid"]).take(pa.array(at))
                    yield picked.append_column("filter", pa.array(filters.astype(np.int32)))

    kind = classes.schema["label"].dataType.simpleString()
    index = cut(classes.select("label", "size", "vector", "cid").repartition("cid")
                .mapInArrow(decode, f"label {kind}, size int, cid long, filter int"), "index")
    key = ["label", "size", "filter"]
    shared = index.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(index.join(shared, key), "members")
    lists = cut(members.groupBy("cid").agg(F.sort_array(F.collect_list("filter")).alias("filters")), "lists")
    points = cut(classes.select("cid", "vector", "n").join(lists, "cid"), "points")
    number = F.ceil(F.col("m") / block).cast("int")
    blocks = (members.withColumn("blocks", number)
              .withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", "size", "filter", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                      "side", "cid"))
    full = (blocks.join(points, "cid")
            .repartition("label", "size", "filter", "i", "j").sortWithinPartitions("label", "size", "filter", "i", "j", "cid"))
    found = cut(full.select("label", "size", "filter", "i", "j", "side", "cid", "n", "vector", "filters")
                .mapInArrow(verified(threshold), "cid long, root long, links long"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(found.select("cid", "root")).withColumnRenamed("node", "cid")
    reached = cut(classes.select("cid", "least").join(reached, "cid"), "reached")
    least = reached.groupBy("component").agg(F.min("least").alias("smallest"))
    reached = cut(reached.select("cid", "component").join(least, "component").select("cid", "smallest").join(counts, "cid"), "reached")
    answers = cut(classes.join(reached, "cid", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), F.coalesce("smallest", "least").alias("_component"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links")), "answers")
    linked = rows.where(valid).join(answers, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))).select(
        "vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

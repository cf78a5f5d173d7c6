"""SimHash near-duplicates by an inverted index over byte positions with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import components, free
from epitide.session import cut

BYTES = 8
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than this.
SHINGLES_AT_ONCE = 1 << 16
#: Postings of up to this many fingerprints are compared pair by pair, larger ones by masks.
POSTING_PAIRS = 128


def bit_majority(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a text: bit set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = starts[:n].tolist()
    digest, seed, ones = xxhash.xxh64_intdigest, SEED, np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = zip(first[at:at + SHINGLES_AT_ONCE], last[at:at + SHINGLES_AT_ONCE])
        h = np.fromiter((digest(whole[a:b], seed) for a, b in part), dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(shingle: int):
    """Column function: text to SimHash. ASCII letters in lower case, words by ASCII white space."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([bit_majority(t.as_py(), shingle) for t in texts], pa.int64())

    return of


def index_slots(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions left out of the key, so that any ``distance`` positions lie in one of them.

    A slot leaves out one position more than two fingerprints can differ in; sets are taken
    greedily until each choice of ``distance`` positions is covered.
    """
    width = min(BYTES, distance + 1)
    open_ = set(combinations(range(BYTES), min(distance, BYTES)))
    slots = []
    while open_:
        best = max(combinations(range(BYTES), width),
                   key=lambda s: sum(c in open_ for c in combinations(s, min(distance, BYTES))))
        slots.append(best)
        open_ -= set(combinations(best, min(distance, BYTES)))
    return slots


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int, pairs_up_to: int = POSTING_PAIRS) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints at most ``distance`` bits apart.

    ``prints`` has one column ``fp`` of distinct fingerprints. Each is entered in the index once
    for each slot, under its bytes at the slot's positions. Fingerprints of one posting are
    candidates: the equal bytes of a pair are tallied over all eight positions, pairs with at
    least 8 - ``distance`` of them stay, and the differing bits decide. A pair counts only in the
    first slot that both share.

    A large posting is not paired. Its fingerprints are grouped under every choice of
    ``distance`` free bits, blanked: a group holds 2^distance fingerprints at most, any two within
    reach, so links to the smallest one connect it. Work grows with the posting, not its square,
    and no pair within reach is lost: it shares a group in the slot that owns its two bits.
    """
    slots = index_slots(distance)
    masks = [sum(0xFF << (8 * p) for p in range(BYTES) if p not in s) for s in slots]
    entries = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                        for i, m in enumerate(masks)])
    index = prints.select("fp", F.explode(entries).alias("e")).select("fp", "e.slot", "e.key")
    sizes = cut(index.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "postings")

    def byte(x, p):
        return F.shiftright(x, 8 * p).bitwiseAND(F.lit(255))

    a, b = F.col("a"), F.col("b")
    tally = sum((F.when(byte(a, p) == byte(b, p), 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    owner = F.lit(len(slots))
    for i in reversed(range(len(slots))):
        m = F.lit(signed(masks[i]))
        owner = F.when(a.bitwiseAND(m) == b.bitwiseAND(m), i).otherwise(owner)
    listed = (index.join(sizes.where(F.col("n") <= pairs_up_to), ["slot", "key"])
              .groupBy("slot", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    pairs = (listed
             .select("slot", "fps", F.posexplode("fps").alias("at", "a"))
             .select("slot", "a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
             .where(tally >= BYTES - distance)
             .where(F.bit_count(a.bitwiseXOR(b)) <= distance)
             .where(owner == F.col("slot")).select("a", "b"))

    owned: dict[int, list[int]] = {i: [] for i in range(len(slots))}
    for bits in combinations(range(64), distance):
        positions = {x // 8 for x in bits}
        owned[next(i for i, s in enumerate(slots) if positions <= set(s))].append(signed(sum(1 << x for x in bits)))
    blanks = F.create_map(*[x for i, v in owned.items() for x in
                            (F.lit(i), F.array(*[F.lit(m) for m in v]) if v else F.array().cast("array<bigint>"))])
    groups = (index.join(sizes.where(F.col("n") > pairs_up_to), ["slot", "key"])
              .select("fp", F.explode(blanks[F.col("slot")]).alias("blank"))
              .groupBy("blank", F.col("fp").bitwiseAND(F.bitwise_not("blank")).alias("rest"))
              .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))
    stars = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def grouped(rows: DataFrame, doc_id: str, distance: int) -> DataFrame:
    """``fp`` and ``component_id`` for every fingerprint of ``rows`` (columns doc_id, ``_fp``)."""
    prints = cut(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("least")), "prints")
    found = components(links(prints.select("fp"), distance))
    joined = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint and group of every document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links reach. NULL and empty texts have
    fingerprint 0, which links like any other; a text of fewer words than a shingle is one
    shingle. Documents without doc_id belong to groups but name none: a group of only such
    documents has a NULL component_id. Repeated documents give repeated rows. An empty table gives
    an empty table; other columns of ``docs`` are not read.

    Equal fingerprints are one entry of the index, so copies of any number cost one.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(shingle)(F.col(text)).alias("_fp")), "simhash")
    groups = grouped(rows, "doc_id", distance)
    return rows.join(groups, rows["_fp"] == groups["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text",
                         doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id, with the columns it came with.

    Of repeated rows one stays. Of a group in which no document has a doc_id one row stays. Columns may have any names.
    """
    names = docs.columns
    fp, one = free(docs, "_fp", "_one")
    rows = cut(docs.withColumn(fp, fingerprint(shingle)(F.col(text))), "simhash")
    ids = rows.select(F.col(doc_id).alias("_id"), F.col(fp).alias("_fp"))
    groups = grouped(ids, "_id", distance)
    counts = (ids.groupBy("_id", "_fp").agg(F.count(F.lit(1)).alias("_n")).join(groups, F.col("_fp") == F.col("fp"))
              .select("_id", "_fp", "_n", F.col("component_id").alias("_of")))
    counts = cut(counts.where(~F.col("_id").eqNullSafe(F.col("_of")) | F.col("_of").isNull() | (F.col("_n") > 1)),
                 "decided")
    match = (F.col(f"r.{fp}") == F.col("c._fp")) & F.col(f"r.{doc_id}").eqNullSafe(F.col("c._id"))
    plain = rows.alias("r").join(counts.alias("c"), match, "left_anti")
    several = (rows.alias("r").join(counts.where(F.col("_id").eqNullSafe(F.col("_of"))).alias("c"), match)
               .join(groups.alias("g"), F.col(f"r.{fp}") == F.col("g.fp"))
               .select("r.*", F.coalesce(F.col("c._of").cast("string"), F.hex(f"r.{fp}")).alias(one))
               .dropDuplicates([one]))
    return plain.select(*names).unionByName(several.select(*names))

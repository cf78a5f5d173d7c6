"""Conversation prefix trie by whole-sequence collapse: identical conversations first, then weighted prefixes.

A sequence of turns is known by the lane-wise sums of its turns' digests, each taken with its place: sums
over ranges add up, so no conversation has to lie in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.operators.spread import lay_out, running
from epitide.session import cut

#: A key is four sums of 32-bit digests, which stay below 2^63 for 2^31 turns.
LANES = ["k0", "k1", "k2", "k3"]
#: Node keys: the depth and the sums up to it.
NODE = ["depth", *LANES]
#: End lists travel in pieces of ids that agree but for their last three digits.
PIECE = 1000
#: A conversation begins with this many turns of another at most.
HEAD_AT_MOST = 8


def lanes(place: Column, digest: Column) -> list[Column]:
    at = F.md5(F.concat_ws(":", place.cast("string"), digest).cast("binary"))
    return [F.conv(F.substring(at, 8 * i + 1, 8), 16, 10).cast("long").alias(k) for i, k in enumerate(LANES)]


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   texts: bool = False) -> DataFrame:
    """conv_id, no (from 1), digest of role and text, bytes of the text; with ``texts`` also role and text.

    Ordered by turn (NULL first); equal turns by role, the first 64 characters of the text and its MD5. NULL role
    or text counts as empty. Rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    The order goes by ranges, which cut through long conversations.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.md5(text.cast("binary")).alias("own"), F.octet_length(text).cast("long").alias("bytes"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        *([text.alias("text")] if texts else []))
    order = ["turn", "role", "head", "own"]
    ranges = lay_out(rows, ["conv_id"], order)
    return running(ranges, ["conv_id"], order, sums={"no": F.lit(1)}).select(
        "conv_id", "no", "digest", "bytes", *(["role", "text"] if texts else []))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD_AT_MOST + 1)


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its head from conversation c - c % 5, and the ids of all conversations.

    The first h turns of that conversation (fewer if it has fewer, none if it is absent) are followed by c's own
    turns after its first h. Rows: conv_id, depth (from 1), digest, bytes, and source and no, where the turn
    stands in ``turns``. A conversation that comes out without turns has no row here.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = cut(counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"), borrowed(F.col("conv_id")).alias("h"))
                .join(firsts, "first", "left")
                .select("conv_id", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken")), "convs")
    heads = turns.where(F.col("no") <= HEAD_AT_MOST).select(F.col("conv_id").alias("first"), "no", "digest", "bytes")
    head = convs.join(heads, "first").where("no <= h").select(
        "conv_id", F.col("no").alias("depth"), "digest", "bytes", F.col("first").alias("source"), "no")
    own = turns.join(convs, "conv_id").where("no > h").select(
        "conv_id", (F.col("no") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", F.col("conv_id").alias("source"), "no")
    return head.unionByName(own), convs.select("conv_id")


@dataclass(frozen=True)
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the node's key.

    ends: the end lists, in pieces that follow each other by ``piece``: the node's key, piece, ids (ascending).
    """

    nodes: DataFrame
    ends: DataFrame

    def digests(self) -> DataFrame:
        """The nodes with ends_sha256, the SHA-256 of their end lists as comma-joined text."""
        return (self.nodes.join(list_digests(self.ends), NODE, "left")
                .withColumn("ends_sha256", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha256", *LANES)
                .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def list_digests(ends: DataFrame) -> DataFrame:
    """A node's key and the SHA-256 of its whole end list. The pieces stream through; a task holds one batch of them."""
    rows = (ends.select(*NODE, "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
            .repartition(*NODE).sortWithinPartitions(*NODE, "piece"))

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            keys = zip(*(batch.column(c).to_pylist() for c in NODE))
            for now, ids in zip(keys, batch.column("ids").to_pylist()):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*NODE, "sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], [*NODE, "sha256"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> Trie:
    """The trie of all prefixes of the sequences of ``convs`` (conv_id), whose turns are the rows of ``sequences``.

    ``sequences`` has conv_id, depth (1, 2, ... without a gap), digest and bytes; a conversation without rows is the
    empty sequence, which ends at the root (depth 0). The trie of an empty table has no nodes.

    Identical sequences are one weighted sequence, kept under the smallest conv_id; only these are cut into
    prefixes. Those that are a proper prefix of another drop out by an anti-join, the others are the leaves. Every
    node is saved once, on the sequence that names it, and summed towards the root along that sequence.
    All groupings combine map-side; what is joined has one row a key on one side, so large keys can be split.
    """
    tagged = cut(sequences.select("conv_id", "depth", "bytes", *lanes(F.col("depth"), F.col("digest"))), "turns")
    zero = F.lit(0).cast("long")
    totals = tagged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), *[F.sum(k).alias(k) for k in LANES])
    whole = cut(convs.join(totals, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE]), "whole")
    weighted = cut(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "weighted")
    ends = whole.groupBy(*NODE, (F.col("conv_id") - F.pmod("conv_id", F.lit(PIECE))).alias("piece")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"))

    kept = tagged.join(weighted.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id")
    upto = {f"u{k}": F.col(k) for k in LANES}
    summed = running(lay_out(kept, ["conv_id"], ["depth"]), ["conv_id"], ["depth"], sums=upto)
    prefixes = cut(summed.select("conv_id", "depth", *[F.col(f"u{k}").alias(k) for k in LANES], "bytes", "weight", "length", "_part",
                                 *[(F.col(f"u{k}") - F.col(k)).alias(f"p{k}") for k in LANES]), "prefixes")

    at_root = [zero.alias(k) for k in NODE]
    proper = (prefixes.where("depth < length").select(*NODE)
              .unionByName(weighted.where("depth > 0").select(*at_root)).distinct())
    leaves = cut(weighted.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf")), "leaves")
    marked = prefixes.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", zero))
    top = weighted.join(leaves, "conv_id", "left").select(
        "conv_id", *at_root, zero.alias("bytes"), "weight", F.coalesce("leaf", zero).alias("leaf"),
        *[zero.alias(f"p{k}") for k in LANES])
    nodes = cut(marked.select(top.columns).unionByName(top).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        ((F.sum("weight") - 1) * F.max("bytes")).alias("own"), *[F.max(f"p{k}").alias(f"p{k}") for k in LANES]), "nodes")

    placed = cut(prefixes.select(*NODE, "conv_id", "_part").join(
        nodes.where("depth > 0").select("conv_id", "depth", "own"), ["conv_id", "depth"], "left").fillna(0, ["own"]), "placed")
    below = running(placed, ["conv_id"], ["depth"], sums={"before": F.col("own")}, totals={"all": F.col("own")})
    saved = below.select(*NODE, (F.col("all") - F.col("before") + F.col("own")).alias("saved_tokens"))
    under = nodes.where("depth > 0")
    parts = [
        nodes.select(*NODE, "conv_id", "n_convs", "n_leaves", *[f"p{k}" for k in LANES]),
        under.select((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(k) for k in LANES], F.lit(1).cast("long").alias("n_children")),
        saved,
        under.select(*at_root, F.col("own").alias("saved_tokens")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    figures = every.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), zero).alias("n_children"),
        F.max("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"),
        *[F.max(f"p{k}").alias(f"p{k}") for k in LANES])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{k}") for k in LANES], F.col("conv_id").alias("parent_conv_id"))
    return Trie(figures.join(parents, ["depth", *[f"p{k}" for k in LANES]], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", *LANES), ends)


def last_turns(nodes: DataFrame, rebuilt: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes below the root with role and text of their last turn; ``turns`` are numbered turns with texts."""
    where = rebuilt.select("conv_id", "depth", "source", "no")
    said = turns.select(F.col("conv_id").alias("source"), "no", "role", "text")
    return nodes.join(where, ["conv_id", "depth"]).join(said, ["source", "no"]).drop("source", "no")


def conversation_trie(conversations: DataFrame) -> Trie:
    """The trie of all rebuilt conversations; see :func:`numbered_turns` for the order and for edge rows."""
    turns = cut(numbered_turns(conversations), "numbered")
    return prefix_trie(*rebuilt_turns(turns))

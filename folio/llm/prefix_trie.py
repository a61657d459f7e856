"""Conversation prefix trie: what conversations share from their first turn on, and the tokens that sharing saves.

A conversation's turns are streamed in order through its task, and each prefix gets the digest of the prefix before it and
the turn: one chain of digests for each conversation, one node of the trie for each distinct digest. Nodes are counted with
partial sums before they are shuffled, so a prefix that a third of all conversations share is one row for each task.

The trie is cut into prefix shards of at most ``SHARD`` turns (one conversation alone may be longer). A shard's nodes become
a succinct level-order trie (LOUDS): numpy arrays of labels in breadth-first order and a bitvector with a one for each child
and a zero after each node's children. A node's parent is the number of zeros before its one, and rollups of leaves and saved
tokens add each level to the one above it, from the last level back.

Nodes above all shards ("heavy" ones, of more turns than a shard) are merged apart: the shards' roots are summed into their
parents, and sums travel up by pointer doubling, so the number of joins is the logarithm of the longest shared prefix.

Members that end at a node are digested in order from sorted partitions, one at a time, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, cut

SHARD = 20_000
FAMILY, LENT = 20, 4
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def labelled(turns: DataFrame, id_col: str) -> DataFrame:
    """conv, pos (from 1), label (16 bytes of a digest of role and text), tokens (words of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    raw = lambda c: F.col(c).cast("binary")
    label = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(" ").cast("binary"), raw("role"), raw("text")), 256), 1, 32))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    return given.withColumn("pos", pos).select("conv", "pos", label.alias("label"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens"))


def lent_turns(conv: Column) -> Column:
    """How many of its first turns a conversation takes from its family's first one: crc32 of the decimal id, modulo ``LENT``."""
    return F.crc32(conv.cast("string").cast("binary")) % LENT


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, part, pos, label, tokens: the lent turns (part 0) before the conversation's own from there on (part 1)."""
    h = lent_turns(F.col("conv"))
    own = turns.where(F.col("pos") > h).select("conv", F.lit(1).alias("part"), "pos", "label", "tokens")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < LENT)).withColumnRenamed("conv", "base")
    convs = turns.where("pos = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h.alias("h")).where("h > 0")
    lent = convs.join(heads, "base").where("pos <= h").select("conv", F.lit(0).alias("part"), "pos", "label", "tokens")
    return own.unionByName(lent)


def chains(rows: DataFrame) -> DataFrame:
    """conv, depth, length, node, up (the node before; empty at depth 1), top (the node at depth 1), tokens."""
    w = Window.partitionBy("conv")
    ordered = rows.withColumn("length", F.count("*").over(w)).sortWithinPartitions("conv", "part", "pos").select("conv", "length", "label", "tokens")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, depth, node, top = None, 0, b"", b""
        for b in batches:
            depths, nodes, ups, tops = [], [], [], []
            for conv, label in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if conv != last:
                    last, depth, node = conv, 0, b""
                up, node, depth = node, hashlib.sha256(node + label).digest()[:16], depth + 1
                top = node if depth == 1 else top
                depths.append(depth)
                nodes.append(node)
                ups.append(up)
                tops.append(top)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, pa.int64()), b.column(1), *(pa.array(x, pa.binary()) for x in (nodes, ups, tops)), b.column(3)], ["conv", "depth", "length", "node", "up", "top", "tokens"])

    return ordered.mapInArrow(chain, "conv long, depth long, length long, node binary, up binary, top binary, tokens long")


def level_order(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Nodes of a forest (parent: places, -1 at roots) breadth first, siblings by label, and where each level ends."""
    by_parent = np.lexsort((label, parent))
    at = np.searchsorted(parent[by_parent], np.arange(-1, len(parent)))
    ends = np.r_[at[1:], len(parent)]
    level, order, stops = by_parent[: ends[0]], [], []
    while len(level):
        order.append(level)
        stops.append(len(level) + (stops[-1] if stops else 0))
        first, n = at[level + 1], (ends - at)[level + 1]
        level = by_parent[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    return np.concatenate(order) if order else np.zeros(0, np.int64), stops


def louds(degrees: np.ndarray, roots: int) -> np.ndarray:
    """The bitvector of a forest in level order: a one for each child and a zero after them, for a node above the roots first."""
    n = np.r_[roots, degrees]
    bits = np.ones(n.sum() + len(n), bool)
    bits[np.cumsum(n + 1) - 1] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """Each node's parent in level order, -1 at roots: the zeros before its one, less the node above the roots."""
    return np.cumsum(~bits)[bits] - 1


def rollup(nodes: pa.Table) -> pa.Table:
    """Children, leaves and saved tokens of a shard's nodes, and the first member of each one's parent."""
    names = ["node", "up", "depth", "conv_id", "n_convs", "n_ends", "end_conv"]
    label = pc.rank(nodes.column("node"), tiebreaker="dense").to_numpy()
    up = pc.fill_null(pc.index_in(nodes.column("up"), value_set=nodes.column("node").combine_chunks()), -1).to_numpy().astype(np.int64)
    order, stops = level_order(up, label)
    bits = louds(np.bincount(up[up >= 0], minlength=len(up))[order], stops[0])
    parent, degree = parents(bits), np.diff(np.flatnonzero(~bits)) - 1
    held = nodes.take(pa.array(order))
    n, tokens, conv = (held.column(c).to_numpy() for c in ("n_convs", "tokens", "conv_id"))
    leaves, saved = (degree == 0).astype(np.int64), (n - 1) * tokens
    for a, z in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        np.add.at(leaves, parent[a:z], leaves[a:z])
        np.add.at(saved, parent[a:z], saved[a:z])
    above = pa.array(conv[parent], mask=parent < 0)
    return pa.table([*(held.column(c) for c in names), above, *(pa.array(x) for x in (degree, leaves, saved))], [*names, "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])


def shards(nodes: DataFrame, heavy: DataFrame, chain: DataFrame, shard: int) -> DataFrame:
    """The rollups of all nodes that aren't heavy; a shard's root is the first such node on the way down, and its parent's member is null."""
    deep = chain.join(heavy.select("node"), "node", "left_semi").groupBy("conv").agg(F.count("*").alias("above"))
    roots = chain.join(deep, "conv", "left").where(F.col("depth") == F.coalesce("above", F.lit(0)) + 1).select(F.col("conv").alias("conv_id"), F.col("node").alias("shard"))
    light = nodes.join(heavy.select("node"), "node", "left_anti").join(roots, "conv_id") if heavy.limit(1).count() else nodes.withColumn("shard", F.col("top"))
    many = max(1, -(-nodes.count() // shard))
    kind = "node binary, up binary, depth long, conv_id long, n_convs long, n_ends long, end_conv long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    return light.groupBy(F.pmod(F.xxhash64("shard"), F.lit(many)).alias("bucket")).applyInArrow(rollup, kind)


def merged(heavy: DataFrame, below: DataFrame) -> DataFrame:
    """The rollups of heavy nodes from those of their light children."""
    fed = below.where("parent_conv_id is null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("light"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kin = heavy.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("dark"))
    above = heavy.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    base = heavy.join(fed, "node", "left").join(kin, "node", "left").join(above, "up", "left").na.fill(0, ["light", "leaves", "saved", "dark"])
    children = F.col("light") + F.col("dark")
    base = cut(base.select("node", "up", "depth", "conv_id", "n_convs", "n_ends", "end_conv", "parent_conv_id", children.alias("n_children"), (F.col("leaves") + (children == 0).cast("long")).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens")))
    now = base.select("node", F.when(F.col("parent_conv_id").isNotNull(), F.col("up")).alias("jump"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    while now.where("jump is not null").limit(1).count():
        add = now.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("l").alias("al"), F.sum("s").alias("as"))
        far = now.select(F.col("node").alias("jump"), F.col("jump").alias("far"))
        now = cut(now.join(add, "node", "left").join(far, "jump", "left").select("node", F.col("far").alias("jump"), (F.col("l") + F.coalesce("al", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("as", F.lit(0))).alias("s")))
    sums = now.select("node", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"))
    return base.drop("n_leaves", "saved_tokens").join(sums, "node").select(*below.columns)


def digests(ends: DataFrame) -> DataFrame:
    """node, ends: the digest of each node's members (node, conv) that end there, in order, joined by commas."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends"])

    return ends.select("node", "conv").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(digest, "node binary, ends string")


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", shard: int = SHARD) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null roles and texts are empty, rows with a null id are left
    out, and repeated rows are turns of their own. Conversations without turns of their own left end at the root. Remainders of
    negative ids are negative, so these belong to the family nearer to 0. Turns are the same if 128 bits of their digests are.
    A conversation's turns are in one task, as a text's words are. Other columns are ignored; without rows the result is empty.
    """
    given = cut(labelled(turns, id_col))
    chain = cut(chains(rebuilt(given)))
    last = F.col("depth") == F.col("length")
    nodes = chain.groupBy("node", "up", "top", "depth", "tokens").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("turns"), F.count(F.when(last, 1)).alias("n_ends"), F.min(F.when(last, F.col("conv"))).alias("end_conv"))
    nodes = cut(nodes)
    heavy = cut(nodes.where((F.col("turns") > shard) & (F.col("n_convs") > 1)))
    below = cut(shards(nodes, heavy, chain, shard))
    upper = merged(heavy, below)
    above = heavy.select(F.col("node").alias("up"), F.col("conv_id").alias("near"))
    # all but the children of heavy nodes know their parent's member
    placed = below.join(above, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "near")).drop("near").unionByName(upper)
    placed = cut(placed)
    convs = given.where("pos = 1").select("conv")
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    empty = convs.join(chain.where("depth = 1").select("conv"), "conv", "left_anti").select(F.lit(b"/").alias("node"), "conv")
    turnless = digests(empty).first()
    first = placed.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).first()
    shared = placed.where("n_ends > 1").select("node")
    ends = digests(chain.where(last).select("node", "conv").join(shared, "node", "left_semi"))
    told = F.when(F.col("n_ends") == 0, NO_ENDS).when(F.col("n_ends") == 1, F.sha2(F.col("end_conv").cast("string").cast("binary"), 256)).otherwise(F.col("ends"))
    parent = F.coalesce("parent_conv_id", F.lit(whole.conv_id).cast("long")).alias("parent_conv_id")
    out = placed.join(ends, "node", "left").select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", told.alias("ends_sha256"))
    root = (whole.conv_id, 0, None, whole.n_convs, first.n_children, first.n_leaves or 1, first.saved_tokens or 0, turnless.ends if turnless else NO_ENDS)
    return out.unionByName(turns.sparkSession.createDataFrame([root] if whole.n_convs else [], RESULT))

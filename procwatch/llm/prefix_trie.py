"""The prefix trie of conversations from vertical bitmaps.

Conversations are numbered, and cut into shards of `SHARD` numbers and `BLOCK` turns.
Within such a group, an index gives for each position and turn the bitset of the
conversations that have it there. Depth first, a node's bitset is intersected with the
bitsets of the turns that its conversations have next; each intersection is a child, its
popcount the child's conversations, and those that end there its end list. A node is
known by its depth and a 128-bit hash of its path, so the parts that shards have of a
node are added up by Spark, and a shard's later blocks start where its earlier ones ended.

What a node's subtree holds is a sum over its conversations, too. Call the smallest
conversation of a node its owner. A childless node has one owner, and two have not the
same, so the leaves below a node are those of its conversations that own one. A
conversation's turn is stored once where it is owned, so what sharing saves below a node
is the bytes of the turns, from there on, that its conversations do not own. These sums
come from a second walk over the shared part of the trie.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.operators.ordering import number_rows
from procwatch.session import materialize

GROUP = 5         # conversations c with one c - c % GROUP share a beginning
MAX_SHARED = 9    # of so many turns, less one, at most
SHARD = 640       # conversations of a group
BLOCK = 256       # turns of a conversation in a group

_KEY = ["depth", "x1", "x2"]
_NODES = ("depth long, x1 long, x2 long, p1 long, p2 long, bytes long, n_convs long, conv_id long, "
          "shard long, ends array<long>")
_SUMS = "depth long, x1 long, x2 long, n_leaves long, saved_tokens long"


# ---- rebuilt conversations ------------------------------------------------------

def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, p, k, bytes): a turn's place, the hash of its role and text, and its size."""
    said, by = (F.coalesce(F.col(c), F.lit("")) for c in (text, role))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("t"),
        F.md5(F.concat(F.md5(by), F.md5(said))).alias("k"), F.octet_length(said).cast("long").alias("bytes"))
    return number_rows(rows, ["conv"], ["t", "k"]).select("conv", F.col("_idx").alias("p"), "k", "bytes")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, no, depth, x1, x2, bytes, n_turns): the textless start at depth 0, then the turns.

    x1 and x2 are two hashes of a turn together with its depth.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = materialize(number_rows(sizes, [], ["conv"]).select(
        "conv", F.col("_idx").alias("no"), "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"),
        (F.crc32(F.col("conv").cast("string")) % MAX_SHARED).alias("h")), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = (convs.join(bases, "base", "left")
             .withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
             .withColumn("n_turns", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    starts = (turns.where((F.col("conv") % GROUP == 0) & (F.col("p") < MAX_SHARED - 1))
              .withColumnRenamed("conv", "base"))
    known = ["conv", "no", "n_turns"]
    heads = convs.join(starts, "base").where("p < h").select(*known, (F.col("p") + 1).alias("depth"), "k", "bytes")
    own = convs.join(turns, "conv").where("p >= h").select(
        *known, (F.col("p") - F.col("h") + F.col("shared") + 1).alias("depth"), "k", "bytes")
    rows = heads.unionByName(own).select(
        *known, "depth", F.xxhash64("depth", "k").alias("x1"), F.xxhash64("k", "depth").alias("x2"), "bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select(*known, zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("bytes"))
    return rows.unionByName(roots)


# ---- groups of a shard and a block ------------------------------------------------

def _block(depth: Column) -> Column:
    return F.floor(depth / BLOCK).cast("long")


def _with_carry(rows: DataFrame) -> DataFrame:
    """`rows` and, for each later block of a conversation, a row with what lies before and after it.

    The row has the hash of the path so far, at the depth before the block. `unowned` (if there)
    is summed over the later blocks.
    """
    later = "unowned" in rows.columns
    value = F.col("unowned") if later else F.lit(0)
    sums = (rows.where(F.col("n_turns") >= BLOCK).withColumn("block", _block(F.col("depth")))
            .groupBy("conv", "no", "n_turns", "block")
            .agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum(value).alias("unowned")))
    order = Window.partitionBy("conv").orderBy("block")
    before, after = (order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing))
    carried = sums.select(
        "conv", "no", "n_turns", "block", (F.col("block") * BLOCK - 1).alias("depth"),
        *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).cast("long").alias(x) for x in ("x1", "x2")],
        F.coalesce(F.sum("unowned").over(after), F.lit(0)).cast("long").alias("unowned"))
    extra = {c: F.lit(0).cast("long") for c in rows.columns if c not in carried.columns}
    carried = carried.withColumns(extra) if extra else carried
    both = (rows.withColumn("block", _block(F.col("depth"))).withColumn("carry", F.lit(False))
            .unionByName(carried.select(*rows.columns, "block").withColumn("carry", F.lit(True))))
    return both.withColumn("shard", F.floor(F.col("no") / SHARD).cast("long"))


class _Group:
    """Bitsets of the conversations of a shard over one block of depths."""

    def __init__(self, table: pa.Table):
        columns = {c: table[c].to_numpy() for c in table.column_names}
        order = np.lexsort((columns["depth"], columns["no"]))
        self.columns = {c: v[order] for c, v in columns.items()}
        no, depth, carry = (self.columns[c] for c in ("no", "depth", "carry"))
        first = np.flatnonzero(np.diff(no, prepend=no[0] - 1))
        last = np.append(first[1:], len(no))
        self.conv = self.columns["conv"][first]
        self.local = np.repeat(np.arange(len(first)), last - first)
        for raw, path in (("x1", "path1"), ("x2", "path2")):
            running = np.bitwise_xor.accumulate(self.columns[raw])
            before = np.where(first > 0, running[first - 1], 0)
            self.columns[path] = running ^ before[self.local]
        # a conversation's rows have successive depths: row = offset + depth
        self.offset = (first - depth[first]).tolist()
        self.last = last.tolist()
        real = np.flatnonzero(~carry)
        keys = np.stack([depth[real], self.columns["x1"][real], self.columns["x2"][real]], axis=1)
        _, codes = np.unique(keys, axis=0, return_inverse=True)
        self.code = np.full(len(no), -1)
        self.code[real] = codes.ravel()
        self.posting = [0] * (int(codes.max()) + 1 if len(real) else 0)
        self.alive: dict[int, int] = {}
        for code, at, who in zip(codes.ravel().tolist(), depth[real].tolist(), self.local[real].tolist()):
            self.posting[code] |= 1 << who
            self.alive[at] = self.alive.get(at, 0) | 1 << who
        # a block starts at the nodes that its conversations reached before
        self.roots: dict[tuple, int] = {}
        paths = zip(self.columns["path1"][first].tolist(), self.columns["path2"][first].tolist())
        for who, (has_past, at, path) in enumerate(zip(carry[first].tolist(), depth[first].tolist(), paths)):
            root = (at, *path) if has_past else (at - 1, 0, 0)
            self.roots[root] = self.roots.get(root, 0) | 1 << who
        self.code = self.code.tolist()

    def nodes(self) -> Iterator[tuple[int, int]]:
        """(row, bitset) of every node of the block, depth first; the row is one of the node's.

        Where one conversation is left, (its row, 0) stands for the node and all below it.
        """
        stack = [(root[0], members) for root, members in self.roots.items()]
        while stack:
            depth, members = stack.pop()
            depth += 1
            left = members & self.alive.get(depth, 0)
            while left:
                who = (left & -left).bit_length() - 1
                row = self.offset[who] + depth
                child = members & self.posting[self.code[row]]
                left &= ~child
                if child & (child - 1):
                    yield row, child
                    stack.append((depth, child))
                else:
                    yield row, 0

    def members(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(low.bit_length() - 1)
            bits ^= low
        return found


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a group: conversations, smallest one, and those that end at the node."""
    group = _Group(table)
    c = group.columns
    ending: dict[int, int] = {}
    ends_here = (c["depth"] == c["n_turns"]) & ~c["carry"]
    for row in np.flatnonzero(ends_here).tolist():
        at = int(c["depth"][row])
        ending[at] = ending.get(at, 0) | 1 << int(group.local[row])
    rows, counts, ends = [], [], []
    for row, bits in group.nodes():
        if bits:
            rows.append(np.array([row]))
            counts.append(np.array([bits.bit_count()]))
            ends.append([int(group.conv[i]) for i in group.members(bits & ending.get(int(c["depth"][row]), 0))])
        else:
            who = int(group.local[row])
            chain = np.arange(row, group.last[who])
            rows.append(chain)
            counts.append(np.ones(len(chain), np.int64))
            ends += [[int(group.conv[who])] if e else [] for e in ends_here[chain]]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    n = np.concatenate(counts) if rows else np.zeros(0, np.int64)
    shard = int(table["shard"][0].as_py())
    return pa.table({
        "depth": c["depth"][at], "x1": c["path1"][at], "x2": c["path2"][at],
        "p1": c["path1"][at] ^ c["x1"][at], "p2": c["path2"][at] ^ c["x2"][at], "bytes": c["bytes"][at],
        "n_convs": n, "conv_id": group.conv[group.local[at]], "shard": np.full(len(at), shard),
        "ends": pa.array(ends, pa.list_(pa.int64()))})


def _shard_sums(table: pa.Table) -> pa.Table:
    """Per node of a group: its conversations that own a leaf, and their bytes that they do not own."""
    group = _Group(table)
    c = group.columns
    leaf, unowned = 0, c["unowned"]
    later = np.zeros(len(group.conv), np.int64)
    np.add.at(later, group.local[c["carry"]], unowned[c["carry"]])
    own = np.where(c["carry"], 0, unowned)
    # bytes not owned from each row on: those of the block, and of later blocks
    upto = np.cumsum(own)
    total = upto[np.array(group.last) - 1]
    rest = (total[group.local] - upto + own + later[group.local]).tolist()
    for who in np.unique(group.local[c["is_leaf"] > 0]).tolist():
        leaf |= 1 << who
    rows, leaves, saved = [], [], []
    for row, bits in group.nodes():
        depth = int(c["depth"][row])
        if bits:
            rows.append(row)
            leaves.append((bits & leaf).bit_count())
            saved.append(sum(rest[group.offset[who] + depth] for who in group.members(bits)))
        else:
            who = int(group.local[row])
            chain = range(row, group.last[who])
            rows += chain
            leaves += [leaf >> who & 1] * len(chain)
            saved += rest[row:group.last[who]]
    at = np.array(rows, np.int64)
    return pa.table({"depth": c["depth"][at], "x1": c["path1"][at], "x2": c["path2"][at],
                     "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})


# ---- end lists ------------------------------------------------------------------

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its end lists in order, whatever their number."""
    node, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())],
                                          names=[*_KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*[batch[c].to_pylist() for c in (*_KEY, "ids")]):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield out()
        done.clear()
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield out()


def _end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: shards follow one another in order."""
    lists = parts.where(F.size("ends") > 0).select(
        *_KEY, "shard", F.array_join(F.array_sort("ends").cast("array<string>"), ",").alias("ids"))
    return (lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "shard")
            .mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string"))


# ---- the trie -------------------------------------------------------------------

def build(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A null role or text is empty; a null turn comes first; rows of one conversation with
    equal turns, repeated rows among them, are turns of their own, in order of a hash of role
    and text. Rows without a conversation are left out. Texts count whole, however long, and
    conversations may have any number of turns. Columns with other names are not looked at.
    No rows give no nodes, not even a root.
    """
    rows = materialize(_rebuilt(_turns(conversations, conv, turn, role, text)), "rebuilt-turns")
    grouped = _with_carry(rows).groupBy("shard", "block")
    parts = materialize(grouped.applyInArrow(_shard_nodes, _NODES), "trie-parts")
    merged = parts.groupBy(*_KEY).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"))
    merged = materialize(merged, "trie-nodes")
    children = merged.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(merged.join(children, _KEY, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes-children")

    # which part of its path a conversation owns, which part it has alone, whether it owns a leaf
    owners = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("owned"), F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone"),
        F.max((F.col("n_children") == 0).cast("long")).alias("is_leaf"))
    shared = (rows.join(owners, "conv", "left")
              .where(F.col("alone").isNull() | (F.col("depth") < F.col("alone")))
              .select(*rows.columns, F.coalesce("is_leaf", F.lit(0)).alias("is_leaf"),
                      F.when(F.col("owned").isNull() | (F.col("depth") < F.col("owned")), F.col("bytes"))
                      .otherwise(0).alias("unowned")))
    sums = (_with_carry(materialize(shared, "shared-turns")).groupBy("shard", "block").applyInArrow(_shard_sums, _SUMS)
            .groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))

    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, _KEY, "left").join(_end_digests(parts), _KEY, "left")
            .join(parents, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),  # a node of one conversation
                    F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))

"""The trie of conversation prefixes, and its subtree totals by parallel tree contraction.

A node is a distinct sequence of first d turns.  It is named by its depth and the sum of its turns'
hashes, each of 93 bits and taken over the place, role and text; sums run in parallel over slices of long
conversations, and the parent's name is the sum without the last turn.

Totals of subtrees come by contraction.  A round rakes all leaves, whose totals are known, into their
parents, and then compresses: of chains of nodes with a single child, a random set without neighbours is
taken out, the child is tied to the grandparent, and the edge carries what the node has of its own.  A
constant share of the leaves and chain nodes goes in each round, so rounds grow with the logarithm of the
nodes, for deep chains as well as for wide stars.  Then the nodes taken out are put back: the total of one
is its own share plus that of the child it was joined to, which went later or was raked.

No group is collected: children reach their parent as partial sums, a parent of many children is
joined to them by broadcast of counted rows, and the digest over the conversations that end at a node
is fed from a stream sorted by id.

Defined results: a null role or text is empty; null turns come first, equal turns follow their role and
text; rows without a conv_id belong to no conversation; repeated rows are turns of their own; a conversation
whose rebuilt sequence is empty ends at the root; an empty table has no root and gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.running import running_total
from shelfcast.llm.common import joined_apart, stored

GROUP, MOST_SHARED = 5, 9
# conversations of more turns are numbered and summed in slices
LONG = 10_000
NAME = "decimal(38,0)"


# ------------------------------------------------------------------ rebuilt conversations


def shared_turns(conv: Column, most: int = MOST_SHARED) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv.cast("string")) % most).cast("int")


def in_slices(df: DataFrame, group: str, order: list[Column], value: str, out: str, kind: str) -> DataFrame:
    """`out`: the running sum of `value` per group; groups of more than `LONG` rows are cut over tasks."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > LONG)
    long = stored(sizes.select(group), "long")
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if long.isEmpty():
        return df.withColumn(out, F.sum(value).over(window).cast(kind))
    short = df.join(long, group, "left_anti").withColumn(out, F.sum(value).over(window).cast(kind))
    cut = running_total(df.join(long, group, "left_semi"), [group], order, value, out)
    return short.unionByName(cut.withColumn(out, F.col(out).cast(kind)))


def rebuilt(conversations: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, role, text) of the rebuilt conversations, and all conv_ids."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    rows = stored(rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)), "turns")
    placed = stored(in_slices(rows, "conv_id", order, "_one", "place", "int").select("conv_id", "place", "role", "text"), "placed")
    convs = stored(placed.select("conv_id").distinct(), "convs")
    own = placed.withColumn("h", shared_turns(F.col("conv_id"), most)).filter("place > h").drop("h")
    # of the first conversation of a group at most `most` - 1 turns are read, by at most `group` others
    taking = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("first"), shared_turns(F.col("conv_id"), most).alias("h")).filter("h > 0")
    heads = placed.filter(F.col("place") < most).filter(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "first")
    given = taking.join(heads, "first").filter("place <= h").select("conv_id", "place", "role", "text")
    # a first conversation of fewer than h turns leaves a gap: what follows moves up
    had = given.groupBy("conv_id").agg(F.max("place").alias("had"))
    base = convs.withColumn("h", shared_turns(F.col("conv_id"), most)).join(had, "conv_id", "left")
    gap = base.select("conv_id", (F.col("h") - F.coalesce("had", F.lit(0))).alias("gap")).filter("gap > 0")
    moved = own.join(gap, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("gap", F.lit(0))).alias("place"), "role", "text")
    return given.unionByName(moved).withColumnRenamed("place", "depth"), convs


# ------------------------------------------------------------------ nodes


def turn_hash(depth: Column, role: Column, text: Column) -> Column:
    """A turn at its place, as a number of 93 bits: sums of up to 10^10 fit into 38 digits."""
    digest = F.sha2(F.concat_ws("\x00", depth.cast("string"), F.sha2(role, 256), F.sha2(text, 256)), 256)
    high, low = F.conv(F.substring(digest, 1, 12), 16, 10), F.conv(F.substring(digest, 13, 11), 16, 10)
    return (high.cast("decimal(15,0)") * F.lit(1 << 45).cast("decimal(14,0)") + low.cast("decimal(14,0)")).cast(NAME)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name, up (the parent's name) and bytes for each turn."""
    own = turn_hash(F.col("depth"), F.col("role"), F.col("text"))
    rows = stored(turns.select("conv_id", "depth", own.alias("own"), F.octet_length("text").cast("long").alias("bytes")), "hashed")
    summed = in_slices(rows, "conv_id", [F.col("depth")], "own", "name", NAME)
    return summed.select("conv_id", "depth", "name", (F.col("name") - F.col("own")).cast(NAME).alias("up"), "bytes")


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, bytes, name), and (conv_id, depth, name) of
    the node where each conversation ends.  A node is known by its smallest member and its depth."""
    zero = F.lit(0).cast(NAME)
    root = convs.select("conv_id", F.lit(0).alias("depth"), zero.alias("name"), F.lit(None).cast(NAME).alias("up"), F.lit(0).cast("long").alias("bytes"))
    steps = stored(paths(turns).unionByName(root), "steps")
    ends = stored(steps.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"), F.max("depth").alias("depth")), "ends")
    nodes = steps.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("up").alias("up"), F.min("bytes").alias("bytes"))
    nodes = stored(nodes, "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    above = nodes.filter("n_children > 0").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("up"), F.col("n_children").alias("fan"))
    tops = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    joined = joined_apart(nodes.filter("depth > 0"), above, ["depth", "up"], "fan").drop("fan").unionByName(tops)
    return stored(joined.drop("up"), "nodes"), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, name and ends_sha256: of the decimal conv_ids in numerical order, joined by commas.

    First ids are joined in slices of the sorted whole, then each node's slices run through one digest in
    order; a task keeps one state and one piece of text."""
    node = ["depth", "name"]
    piece = 1 << 12

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            made = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.string()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())]
            return pa.RecordBatch.from_arrays(made, [*node, "first", "ids"])

        for batch in batches:
            for depth, name, conv in zip(*[batch.column(c).to_pylist() for c in (*node, "conv_id")], strict=True):
                if (depth, name) != now or size > piece:
                    if held:
                        yield out()
                    now, first, held, size = (depth, name), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def made() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*node, "ends_sha256"])

        for batch in batches:
            for depth, name, ids in zip(*[batch.column(c).to_pylist() for c in (*node, "ids")], strict=True):
                if (depth, name) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, name), hashlib.sha256(ids.encode())
                if len(out) >= 10_000:
                    yield made()
                    out = []
        if now:
            out.append((*now, state.hexdigest()))
            yield made()

    rows = ends.select("depth", F.col("name").cast("string").alias("name"), "conv_id")
    pieces = rows.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").mapInArrow(joined, "depth int, name string, first long, ids string")
    whole = pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(digested, "depth int, name string, ends_sha256 string")
    return whole.withColumn("name", F.col("name").cast(NAME))


# ------------------------------------------------------------------ contraction


def subtree_sums(tree: DataFrame, values: list[str], seed: int = 0) -> DataFrame:
    """conv_id, depth and, for each of `values`, its sum over the subtree of each node of `tree`
    (conv_id, depth, up_conv, up_depth, n_children and the values; up_conv is null at the root)."""
    zero, node = F.lit(0).cast("long"), ["conv_id", "depth"]
    nothing = [F.lit(None).cast("long").alias("gone_conv"), F.lit(None).cast("int").alias("gone_depth"), *[zero.alias(f"gone_{v}") for v in values]]
    state = tree.select(*node, "up_conv", "up_depth", F.col("n_children").alias("open"), *[F.col(v).cast("long").alias(v) for v in values], *[zero.alias(f"edge_{v}") for v in values], *nothing)
    state = stored(state, "contracted")
    raked, taken = [], []
    while not state.isEmpty():
        turn = len(raked)
        leaf = F.col("open") == 0
        raked.append(state.filter(leaf).select(*node, *values))
        # rake: totals of leaves go to their parents; `kid` is the only child that is left, where there is one
        sums = [F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(f"edge_{v}"))), zero).alias(f"got_{v}") for v in values]
        stays = F.when(~leaf, F.col("conv_id"))
        up = state.filter("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"))
        up = up.agg(*sums, F.count(stays).alias("left"), F.max(stays).alias("kid"), F.max(F.when(~leaf, F.col("depth"))).alias("kid_depth"))
        now = state.filter(~leaf).select(*node, "up_conv", "up_depth", *values, *[f"edge_{v}" for v in values]).join(up, node)
        now = now.withColumns({v: F.col(v) + F.col(f"got_{v}") for v in values})
        # compress: a chain node goes if its coin shows and its child's doesn't, so no two neighbours go
        coin = lambda a, b, turn=turn: F.xxhash64(F.lit(seed), F.lit(turn), a, b).bitwiseAND(1) == 1
        goes = (F.col("left") == 1) & F.col("up_conv").isNotNull() & coin("conv_id", "depth") & ~coin("kid", "kid_depth")
        now = now.withColumn("goes", F.coalesce(goes, F.lit(False)))
        gone = now.filter("goes").select(
            F.col("kid").alias("conv_id"), F.col("kid_depth").alias("depth"), F.col("up_conv").alias("to_conv"), F.col("up_depth").alias("to_depth"),
            F.col("conv_id").alias("gone_conv"), F.col("depth").alias("gone_depth"), *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(f"edge_{v}").alias(f"was_{v}") for v in values],
        )
        moved = F.col("gone_conv").isNotNull()
        more = [F.when(moved, F.col(f"own_{v}") + F.col(f"was_{v}")).otherwise(zero) for v in values]
        state = now.filter("not goes").join(gone, node, "left").select(
            *node, F.when(moved, F.col("to_conv")).otherwise(F.col("up_conv")).alias("up_conv"), F.when(moved, F.col("to_depth")).otherwise(F.col("up_depth")).alias("up_depth"),
            F.col("left").alias("open"), *values, *[(F.col(f"edge_{v}") + m).alias(f"edge_{v}") for v, m in zip(values, more, strict=True)],
            "gone_conv", "gone_depth", *[(F.col(f"own_{v}") + F.col(f"edge_{v}")).alias(f"gone_{v}") for v in values],
        )
        state = stored(state, "contracted")
        # a node that went gets its total from its child: its own share and the child's edge before, plus the child's total
        taken.append(state.filter("gone_conv is not null").select(F.col("gone_conv").alias("conv_id"), F.col("gone_depth").alias("depth"), F.col("conv_id").alias("kid"), F.col("depth").alias("kid_depth"), *[F.col(f"gone_{v}").alias(v) for v in values]))
    # expand: nodes that went follow their children, which went later or were raked; each step doubles how far
    totals, links = reduce(DataFrame.unionByName, raked), stored(reduce(DataFrame.unionByName, taken), "taken")
    while True:
        ahead = links.select(F.col("conv_id").alias("kid"), F.col("depth").alias("kid_depth"), F.col("kid").alias("far"), F.col("kid_depth").alias("far_depth"), *[F.col(v).alias(f"of_{v}") for v in values])
        went = F.col("far").isNotNull()
        step = links.join(ahead, ["kid", "kid_depth"], "left").select(
            *node, went.alias("went"), F.coalesce("far", "kid").alias("kid"), F.coalesce("far_depth", "kid_depth").alias("kid_depth"), *[(F.col(v) + F.coalesce(f"of_{v}", zero)).alias(v) for v in values]
        )
        step = stored(step, "followed")
        if step.filter("went").isEmpty():
            break
        links = step.drop("went")
    known = totals.select(F.col("conv_id").alias("kid"), F.col("depth").alias("kid_depth"), *[F.col(v).alias(f"of_{v}") for v in values])
    back = links.join(known, ["kid", "kid_depth"]).select(*node, *[(F.col(v) + F.col(f"of_{v}")).alias(v) for v in values])
    return totals.unionByName(back)


def prefix_trie(conversations: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every
    node of the trie of the rebuilt conversations of `conversations` (conv_id, turn, role, text)."""
    nodes, ends = trie(*rebuilt(conversations, group, most))
    tree = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"), "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"]) if not tree.isEmpty() else tree.select("conv_id", "depth", "n_leaves", "saved_tokens")
    named = nodes.join(sums, ["conv_id", "depth"]).join(end_digests(ends), ["depth", "name"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )

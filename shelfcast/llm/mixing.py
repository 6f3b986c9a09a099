"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree of columns (domain, language, source).  A node's budget is dealt to its
children by weight; a child whose documents, repeated at most `max_epochs` times, hold less than
its share is filled, and its siblings share the rest by weight.  Only what a whole family lacks is
dealt to the family's own siblings, because a child's capacity is that of its subtree.  A leaf
takes whole epochs first and then the prefix of the next one, in an order seeded per epoch, up to
its token budget; the last document of the prefix is cut to fit.

Only aggregates per leaf and per bucket of the order are shuffled.  The cut of a leaf is found in
its one bucket that holds it, so no task ever sorts a leaf.  All arithmetic is in whole tokens.

Defined results: a null in a tree column is a value of its own; null text counts no tokens, and
documents without tokens are in no mix; repeated ids are documents of their own, but share their
place in the order (ties go by token count); weights that are missing are 1, weights of 0 or less
exclude; budgets above all capacity give every document `max_epochs` times; an empty table gives an
empty result; other columns pass through `mixed_documents` and are ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

TREE = ("domain", "lang", "source")
BUCKETS_HEX = 3  # buckets of the order: 16 ** 3 for each leaf
BROADCAST_LEAVES = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """32 hex digits that order the documents of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`got` for each row of `children` (parent columns, `name`, weight, capacity, budget): the
    parent's `budget` by weight, no child above its capacity.

    Children are filled in order of capacity per weight; the level after k full ones is
    (budget - their capacity) / (weight of the others), and a child is full while its own ratio is
    not above it.
    """
    order = [(F.col("capacity") / F.col("weight")).asc(), F.col("capacity").asc(), F.col(name).asc_nulls_first()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    levelled = children.withColumns({"_left": left, "_others": F.sum("weight").over(rest)})
    full = F.col("capacity") * F.col("_others") <= F.col("_left") * F.col("weight")
    levelled = levelled.withColumn("_full", full)
    # the first child that isn't full sets the level of all that follow
    first = Window.partitionBy(*parent)
    level = F.min(F.when(~F.col("_full"), F.struct((-F.col("_others")).alias("w"), F.col("_left").alias("b")))).over(first)
    levelled = levelled.withColumn("_level", level)
    share = F.expr("(_level.b * weight) div (-_level.w)")
    return levelled.withColumn("got", F.when(F.col("_full"), F.col("capacity")).otherwise(share).cast("long"))


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict[str, Column], tree: tuple[str, ...], max_epochs: int) -> DataFrame:
    """Token budgets of leaves (tree columns, tokens).  `weights` gives, by tree column, the weight
    of a node as a whole number, from the columns down to its own."""
    level = leaves.select(*tree, (F.col("tokens") * max_epochs).alias("capacity"))
    levels = [level]
    for depth in range(len(tree) - 1, 0, -1):
        level = level.groupBy(*tree[:depth]).agg(F.sum("capacity").alias("capacity"))
        levels.append(level)
    above: DataFrame | None = None
    for depth, level in enumerate(reversed(levels), 1):
        weight = F.coalesce(weights.get(tree[depth - 1], F.lit(1)), F.lit(1)).cast("long")
        level = level.withColumn("weight", weight).filter("weight > 0 and capacity > 0")
        up = list(tree[: depth - 1])
        if above is None:
            level = level.withColumn("budget", F.lit(budget).cast("long"))
        else:
            level = joined(level, above.select(*up, F.col("got").alias("budget")), up)
        above = water_fill(level, up, tree[depth - 1])
    return joined(leaves.select(*tree, "tokens"), above.select(*tree, F.col("got").alias("budget")), list(tree))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys`, with null equal to null."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])


def cuts(
    docs: DataFrame, share: float, weights: dict[str, Column], tree: tuple[str, ...] = TREE, max_epochs: int = 4, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (tree, doc_id, tokens) and per leaf: tokens, budget, epochs (whole ones),
    cut_key, cut_id, cut_tokens and cut_take (place and share of the document that is cut).

    `docs` has the tree columns, doc_id and text; the budget is `share` of all its tokens.
    """
    if share < 0 or max_epochs < 1:
        raise ValueError("share must not be negative and max_epochs at least 1")
    narrow = stored(docs.select(*tree, "doc_id", tokens_of(F.col("text")).alias("tokens")).filter("tokens > 0"), "tokens")
    leaves = stored(narrow.groupBy(*tree).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaf_budgets(leaves, int(total * share), weights, tree, max_epochs)
    budgets = budgets.withColumns({"epochs": F.expr("budget div tokens").cast("int"), "rest": F.col("budget") % F.col("tokens")})
    budgets = stored(budgets, "budgets")
    placed = with_leaf(narrow, budgets, tree).filter("rest > 0").withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    bucket = F.left("key", F.lit(BUCKETS_HEX)).alias("bucket")
    sums = placed.groupBy(*tree, bucket).agg(F.sum("tokens").alias("held"))
    upto = Window.partitionBy(*tree).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    crossed = joined(sums, budgets.select(*tree, "rest"), list(tree)).filter("before < rest and rest <= before + held")
    crossed = crossed.select(*tree, F.col("bucket").alias("cut_bucket"), "before", F.col("rest").alias("wanted"))
    inside = with_leaf(placed, crossed, tree).filter(bucket == F.col("cut_bucket"))
    ties = inside.groupBy(*tree, "before", "wanted", "key", "doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*tree).orderBy("key", F.col("doc_id").asc_nulls_first(), "tokens")
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("start", start)
    at = ties.filter("start < wanted and wanted <= start + n * tokens").select(
        *tree, F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("tokens").alias("cut_tokens"), F.expr("(wanted - start) div n").alias("cut_take")
    )
    named = at.select(*[F.col(c).alias(f"_r_{c}") for c in tree], "cut_key", "cut_id", "cut_tokens", "cut_take")
    same = F.lit(True)
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    found = budgets.join(named, same, "left").drop(*[f"_r_{c}" for c in tree])
    return narrow, stored(found, "cuts")


def with_leaf(rows: DataFrame, leaves: DataFrame, tree: tuple[str, ...]) -> DataFrame:
    """Rows with their leaf's columns; leaves are broadcast only after they were counted."""
    if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    return joined(rows, leaves.drop("tokens"), list(tree))


def taken(rows: DataFrame, leaves: DataFrame, tree: tuple[str, ...], seed: int) -> DataFrame:
    """`rows` (tree, doc_id, tokens, more) once for each epoch that takes them, with `epoch` and
    `taken` tokens."""
    placed = with_leaf(rows, leaves, tree).withColumn("_key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    place = F.struct("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("i"), F.col("tokens").alias("t"))
    cut = F.struct(F.col("cut_key").alias("_key"), F.coalesce(F.col("cut_id").cast("long"), F.lit(-(2**63))).alias("i"), F.col("cut_tokens").alias("t"))
    part = F.when(F.col("cut_key").isNull(), 0).when(place < cut, F.col("tokens")).when(place == cut, F.col("cut_take")).otherwise(0)
    placed = placed.withColumn("_part", part.cast("long"))
    last = F.col("epochs") - F.when(F.col("_part") > 0, 0).otherwise(1)
    drawn = placed.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    drawn = drawn.withColumn("taken", F.when(F.col("epoch") < F.col("epochs"), F.col("tokens")).otherwise(F.col("_part")))
    return drawn.select(*rows.columns, "epoch", "taken")


def mix(docs: DataFrame, share: float, weights: dict[str, Column], tree: tuple[str, ...] = TREE, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """Tree columns, doc_id, tokens, epoch and taken: one row for each time a document is used."""
    narrow, leaves = cuts(docs, share, weights, tree, max_epochs, seed)
    return taken(narrow, leaves, tree, seed)


def mixed_documents(docs: DataFrame, share: float, weights: dict[str, Column], tree: tuple[str, ...] = TREE, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """All columns of `docs` with epoch and taken, which replace such columns; texts aren't shuffled."""
    _, leaves = cuts(docs, share, weights, tree, max_epochs, seed)
    kept = F.struct(*[F.col(c) for c in docs.columns if c not in ("epoch", "taken")]).alias("_doc")
    counted = docs.select(*tree, "doc_id", tokens_of(F.col("text")).alias("tokens"), kept).filter("tokens > 0")
    return taken(counted, leaves, tree, seed).select("_doc.*", "epoch", "taken")

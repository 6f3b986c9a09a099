"""Boosted trees for many groups in one job, from histograms.

Features are cut into bins once.  A level of all groups' trees takes one pass: every task adds up, for each
(group, node, feature, bin), the rows and what the trees so far leave over, in arrays whose size doesn't
depend on its rows; Spark adds up the tasks' arrays, and the best split of each node is looked for in the
sums alone.  So all groups grow together, however different their sizes, and no group's rows meet in a task.

Groups have no row-count rules.  Trees over all rows come first, and a group's own trees explain what those
leave over; a leaf's value is its sum over its rows plus `shrink`, so a group of few rows stays near
the pooled model and one without rows has it.

A model is a table with a row per group: `base` and `trees`, each the features, cuts and values of a tree of
fixed depth in heap order.  `tree_score` is its prediction as an expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.durable import cut as stored

MODEL = "base double, trees array<struct<feature:array<int>,cut:array<double>,value:array<double>>>"


@dataclass(frozen=True)
class Plan:
    """How trees are grown: rounds over all rows, then rounds by group."""

    pooled_rounds: int = 12
    group_rounds: int = 8
    depth: int = 3
    bins: int = 32
    rate: float = 0.25
    shrink: float = 20.0
    least_rows: float = 20.0  # weight on both sides of a split


@dataclass
class Trees:
    """Trees of one stage: per round, arrays (group, node) of split features (-1: none), bins and (group, leaf) of values."""

    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)


def walk(bins: np.ndarray, group: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node (in heap order, from 0) that rows reach after `levels` levels; a node without a split sends all left.
    `bins` has a row per feature."""
    node = np.zeros(len(group), np.int64)
    every, flat = np.arange(len(group)), bins.ravel()
    first = group * feature.shape[1]
    for _ in range(levels):
        f, c = feature.ravel()[first + node], cut.ravel()[first + node]
        right = (f >= 0) & (flat[np.maximum(f, 0) * len(group) + every] > c)
        node = 2 * node + 1 + right
    return node


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to `bins` - 1 distinct quantiles of each feature; values above the k-th are beyond it."""
    share = [k / bins for k in range(1, bins)]
    found = rows.approxQuantile(features, share, 1.0 / (8 * bins))
    return [sorted(set(f)) for f in found]


BLOCK = "_g array<{}>, _c binary, _y binary, _w binary, _b binary, w double, wy double"


def binned(rows: DataFrame, group: str, features: list[str], cuts: list[list[float]], label: str, weight: str | None) -> DataFrame:
    """Blocks of some thousand rows, packed, as every pass reads them again: the distinct groups, and for each row the
    place of its group there, label, weight and, feature by feature, how many cuts a value lies above (null is in the
    lowest bin); with the block's sums of weight and weight x label."""
    edges = [np.array(c, float) for c in cuts]
    kind = np.min_scalar_type(max(map(len, cuts), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("_g").dictionary_encode(null_encoding="encode")
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
            bins = [np.searchsorted(e, batch.column(f"_x{k}").to_numpy(zero_copy_only=False)).astype(kind) for k, e in enumerate(edges)]
            given = batch.column("_w").is_valid().to_numpy(zero_copy_only=False)
            columns = {
                "_g": pa.array([names.dictionary.to_pylist()], pa.list_(names.dictionary.type)),
                "_c": pa.array([names.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], pa.binary()),
                "_y": pa.array([y.astype(float).tobytes()], pa.binary()),
                "_w": pa.array([w.astype(float).tobytes()], pa.binary()),
                "_b": pa.array([b"".join(b.tobytes() for b in bins)], pa.binary()),
                "w": pa.array([float(w[given].sum())], pa.float64()),
                "wy": pa.array([float((w * y)[given].sum())], pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    values = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias(f"_x{k}") for k, f in enumerate(features)]
    plain = rows.select(F.col(group).alias("_g"), F.col(label).cast("double").alias("_y"), w.alias("_w"), *values)
    return plain.mapInArrow(run, BLOCK.format(rows.schema[group].dataType.simpleString()))


def _read(batch: pa.RecordBatch, places: dict, width: int, all_rows: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, bins, label and weight of each block's rows; without those of no group unless `all_rows`."""
    for k in range(batch.num_rows):
        names, c, y, w, b = (batch.column(n)[k].as_py() for n in ("_g", "_c", "_y", "_w", "_b"))
        code, y, w = np.frombuffer(c, np.int32), np.frombuffer(y), np.frombuffer(w)
        bins = np.frombuffer(b, f"u{len(b) // (width * len(code))}").reshape(width, -1)
        if not all_rows and None in names:
            has = code != names.index(None)
            code, y, w, bins = code[has], y[has], w[has], np.ascontiguousarray(bins[:, has])
        yield np.array([places.get(v, 0) for v in names], np.int64)[code], bins, y, w


def _sums(held: DataFrame, places: dict, width: int, size: int, stages: list[tuple[Trees, bool]], pooled: bool, base: float, depth: int, level: int, grown: tuple) -> np.ndarray:
    """(group, node of the level, feature, bin, [weight, weight x rest]) over all rows."""
    groups, nodes = 1 if pooled else len(places), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, groups * nodes * size))
        seen = False
        for batch in batches:
            for code, bins, y, w in _read(batch, places, width, pooled):
                rest = y - base
                for trees, over_all in stages:
                    own = np.zeros_like(code) if over_all else code
                    for f, c, v in zip(trees.feature, trees.bin, trees.value, strict=True):
                        rest -= v[own, walk(bins, own, f, c, depth) - ((1 << depth) - 1)]
                own = np.zeros_like(code) if pooled else code
                at = (own * nodes + walk(bins, own, *grown, level) - (nodes - 1)) * size
                for k in range(width):
                    total[0, k] += np.bincount(at + bins[k], w, total.shape[2])
                    total[1, k] += np.bincount(at + bins[k], w * rest, total.shape[2])
                seen = seen or len(code) > 0
        if seen:
            flat = total.reshape(2, width, -1, size).swapaxes(1, 2).reshape(2, -1)
            full = np.flatnonzero(flat[0])
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[0][full]), pa.array(flat[1][full])], ["cell", "w", "s"])

    parts = held.select("_g", "_c", "_y", "_w", "_b").mapInArrow(run, "cell long, w double, s double")
    added = parts.groupBy("cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).toArrow()  # a row per cell: groups x nodes x features x bins
    out = np.zeros((2, groups * nodes * width * size))
    cell = added.column("cell").to_numpy()
    out[0][cell], out[1][cell] = added.column("w").to_numpy(), added.column("s").to_numpy()
    return out.reshape(2, groups, nodes, width, size)


def best_splits(sums: np.ndarray, shrink: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per (group, node): feature (-1: none), bin, and the sums (weight, rest) of its left and right side;
    `shrink` and `least` have an entry a group."""
    shrink, least = shrink[:, None, None, None], least[:, None, None, None]
    weight, rest = np.cumsum(sums[0], -1), np.cumsum(sums[1], -1)
    whole_w, whole_r = weight[..., :1, -1:], rest[..., :1, -1:]
    left_w, left_r = weight[..., :-1], rest[..., :-1]
    right_w, right_r = whole_w - left_w, whole_r - left_r
    gain = left_r**2 / (left_w + shrink) + right_r**2 / (right_w + shrink) - whole_r**2 / (whole_w + shrink)
    gain = np.where((left_w >= least) & (right_w >= least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(-1)
    feature, place = np.divmod(best, gain.shape[-1])
    none = ~(np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-12)
    pick = lambda a: np.take_along_axis(a.reshape(*a.shape[:2], -1), best[..., None], -1)[..., 0]
    w = np.stack([pick(left_w), pick(right_w)], -1)
    r = np.stack([pick(left_r), pick(right_r)], -1)
    whole = np.concatenate([whole_w[:, :, 0], np.zeros_like(whole_w[:, :, 0])], -1), np.concatenate([whole_r[:, :, 0], np.zeros_like(whole_r[:, :, 0])], -1)
    return np.where(none, -1, feature), np.where(none, sums.shape[-1], place), np.where(none[..., None], whole[0], w), np.where(none[..., None], whole[1], r)


def fit_boosted(rows: DataFrame, group: str, features: list[str], label: str, plan: Plan | None = None, weight: str | None = None, cuts: list[list[float]] | None = None, settings: dict | None = None) -> DataFrame:
    """A model per value of `group`, a row (group, base, trees) each, and the pooled one with a null group, for
    rows without a group or of groups that training didn't hold.

    Rows without a label are left out; a null feature is below every cut.  `settings` may give groups a plan of
    their own, of which `rate`, `shrink` and `least_rows` hold for the group's own trees.  The model's numbers (groups x rounds x
    nodes) are held by the driver and by each task; rows never are.
    """
    plan = plan or Plan()
    rows = rows.filter(F.col(label).isNotNull())
    cuts = cuts or cut_points(rows, features, plan.bins)
    held = stored(binned(rows, group, features, cuts, label, weight))
    totals = held.agg(F.sum("w"), F.sum("wy")).first()
    base = float(totals[1] / totals[0]) if totals[0] else 0.0
    names = sorted(r[0] for r in held.select(F.explode("_g")).distinct().collect() if r[0] is not None)
    places = {v: k for k, v in enumerate(names)}
    width, size, nodes = len(features), max(map(len, cuts), default=0) + 1, (1 << plan.depth) - 1
    stages: list[tuple[Trees, bool]] = []
    for rounds, pooled in ((plan.pooled_rounds, True), (plan.group_rounds, False)):
        groups = 1 if pooled else len(names)
        plans = [plan] if pooled else [(settings or {}).get(v, plan) for v in names]
        shrink, least, rate = (np.array([getattr(p, c) for p in plans], float) for c in ("shrink", "least_rows", "rate"))
        stages.append((Trees(), pooled))
        for _ in range(rounds if groups and totals[0] and width else 0):
            feature, place = np.full((groups, nodes), -1), np.full((groups, nodes), size)
            for level in range(plan.depth):
                sums = _sums(held, places, width, size, stages, pooled, base, plan.depth, level, (feature, place))
                f, b, w, s = best_splits(sums, shrink, least)
                first = (1 << level) - 1
                feature[:, first : 2 * first + 1], place[:, first : 2 * first + 1] = f, b
            # s and w are (group, node, side): the leaves in order
            value = (rate[:, None, None] * s / (w + shrink[:, None, None])).reshape(groups, -1)
            for column, made in zip((stages[-1][0].feature, stages[-1][0].bin, stages[-1][0].value), (feature, place, value), strict=True):
                column.append(made)
    return model_table(rows.sparkSession, rows.schema[group].dataType.simpleString(), group, names, base, stages, cuts)


def model_table(spark: SparkSession, kind: str, group: str, names: list, base: float, stages: list[tuple[Trees, bool]], cuts: list[list[float]]) -> DataFrame:
    def tree(f: np.ndarray, b: np.ndarray, v: np.ndarray) -> dict:
        # without a split all rows go left
        points = [float("inf") if k < 0 else cuts[k][j] for k, j in zip(f.tolist(), b.tolist(), strict=True)]
        return {"feature": [max(k, 0) for k in f.tolist()], "cut": points, "value": v.tolist()}

    def all_of(place: int | None) -> list[dict]:
        out = []
        for trees, pooled in stages:
            at = 0 if pooled else place
            if at is not None:
                out += [tree(f[at], b[at], v[at]) for f, b, v in zip(trees.feature, trees.bin, trees.value, strict=True)]
        return out

    # the last row is for rows without a group, and for groups that training didn't hold
    data = [*[(v, base, all_of(k)) for k, v in enumerate(names)], (None, base, all_of(None))]
    return spark.createDataFrame(data, f"{group} {kind}, {MODEL}")


def tree_score_of(values: Column, tree: Column, depth: int) -> Column:
    """The leaf of one tree that an array of features reaches."""
    node = F.lit(0)
    for _ in range(depth):
        right = F.get(values, F.get(tree["feature"], node)) > F.get(tree["cut"], node)
        node = node * 2 + 1 + right.cast("int")
    return F.get(tree["value"], node - ((1 << depth) - 1))


def tree_score(features: list[Column], base: Column, trees: Column, depth: int = Plan.depth) -> Column:
    """Prediction of a model row's `base` and `trees` for a row's features; null is below every cut."""
    x = F.array(*[F.coalesce(f.cast("double"), F.lit(float("-inf"))) for f in features])
    # the features are put together once, not once a tree
    both = F.transform(F.array(x), lambda values: F.aggregate(trees, base, lambda s, t: s + tree_score_of(values, t, depth)))
    return F.element_at(both, 1)


def with_tree_score(rows: DataFrame, models: DataFrame, group: str, features: list[str], out: str, depth: int = Plan.depth) -> DataFrame:
    """Add `out`, the score of each row by its group's model, or by the one of no group."""
    rest = models.filter(F.col(group).isNull())
    own = models.filter(F.col(group).isNotNull()).select(F.col(group), F.col("base").alias("_base1"), F.col("trees").alias("_trees1"))
    pooled = {f"_{c}0": rest.agg(F.first(c)).scalar() for c in ("base", "trees")}
    score = tree_score([F.col(f) for f in features], F.coalesce("_base1", "_base0"), F.coalesce("_trees1", "_trees0"), depth)
    return rows.join(own, group, "left").withColumns(pooled).withColumn(out, score).drop("_base0", "_trees0", "_base1", "_trees1")


def staged_losses(rows: DataFrame, models: DataFrame, group: str, features: list[str], label: str, weight: str | None = None, depth: int = Plan.depth) -> DataFrame:
    """group, rounds and loss (weighted mean square) after each round of a group's trees, 0 rounds first, in one pass."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features])
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    joined = rows.join(models.select(group, "base", "trees"), group).withColumns({"_x": x, "_w": w, "_y": F.col(label).cast("double")})
    one = lambda t: tree_score_of(F.col("_x"), t, depth)
    # rest[k] is what k trees leave over
    rest = F.aggregate(F.transform("trees", one), F.array(F.col("_y") - F.col("base")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) - v)))
    each = joined.select(group, "_w", F.posexplode(rest).alias("rounds", "_rest"))
    return each.groupBy(group, "rounds").agg((F.sum(F.col("_w") * F.col("_rest") ** 2) / F.sum("_w")).alias("loss"))

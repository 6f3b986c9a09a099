"""Toxicity scores from the nearest labelled examples by TF-IDF cosine.

Terms are words and their first letters, as features: a term's hash has `BITS` bits, so document
frequencies, taken over all documents, are one vector of a fixed size, and every word of a text, known to
an example or not, counts in its length.  Cosines are exact over these features.

Examples are rows of four fifths of the labelled training rows: `EXAMPLES` of each label, those with the
smallest text hash, and votes are weighted back to the number that each label has.  They stand in an
inverted index whose postings are cut into blocks of `BLOCK` neighbouring examples; examples with the same
most frequent feature are neighbours.  The postings of the `HEAD` most frequent features, which are nearly all that a
text meets, are kept as a matrix by block with the largest weight of each (feature, block); those of the others are
short and added up in full.  Both together bound what a block's examples can reach.  The `FIRST` blocks by bound are scored first, then those whose bound isn't below the
`NEAREST`-th best cosine of these, so the neighbours found are exactly those of a full search.

Cosine-weighted votes are calibrated by isotonic regression on the last fifth, of which `EXAMPLES` of each
label are scored; between its steps the score rises evenly.

Defined results: null and empty texts, and texts that share no feature with an example, have no
neighbours, and their vote is the rate of label 1; of several labels for an id the largest counts, null
labels don't; without labels, or with one label only, every score is the rate of label 1, and 0.5 without
any; ties between neighbours go by their order in the index (most frequent feature, text hash, id);
repeated rows are scored alike; a run of letters longer than `PIECE` bytes counts as several words; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.chunks import planes, scrambled, unplanes
from shelfcast.llm.common import joined_small, stored

FOLDS = 5
PRIOR = 2.0  # weight of the base rate among the votes
STEM = 5
BITS = 20
EXAMPLES, NEAREST = 4000, 50
BLOCK, HEAD = 64, 1024
FIRST = 8  # blocks scored before the bounds are compared
TOGETHER = 64  # texts scored at once
MARGIN = 1e-5  # more than single precision is off by
PIECE = 1 << 20  # bytes hashed at once
SLICE = 1 << 12  # features that are added up in one group
BROADCAST_LABELS = 300_000
SPACED = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))


# ------------------------------------------------------------------ features


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Features:
    """Hashed terms of texts: runs of ASCII letters, in lower case, and other characters, and the first
    `STEM` bytes of longer ones."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.power = powers(self.BASE, PIECE + 1)
        self.back = powers(pow(self.BASE, -1, 1 << 64), PIECE + 1)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in at most `PIECE` bytes, and the features of words and of their stems;
        a word without a stem has its own feature twice, the second one to be left out."""
        held = np.concatenate([[False], data != 0x20, [False]])
        edge = np.flatnonzero(held[1:] != held[:-1])
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
        shift = np.uint64(64 - self.bits)
        whole = scrambled((sums[stop] - sums[start]) * self.back[start]) >> shift
        long = stop - start > STEM
        stem = scrambled((sums[start[long] + STEM] - sums[start[long]]) * self.back[start[long]] ^ np.uint64(0x5DEECE66D)) >> shift
        return np.concatenate([start, start[long]]), np.concatenate([whole, stem])

    def counted(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts (first, last + 1): the text, feature and count of each feature a text holds,
        in the order of both."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size + len(texts[last] or b"") + 1 <= PIECE or last == first):
                size += len(texts[last] or b"") + 1
                last += 1
            run = [t or b"" for t in texts[first:last]]
            if size > PIECE:  # one long text
                found = np.concatenate([self.words(p)[1] for p in pieces(run[0].translate(SPACED))])
                owner = np.zeros(len(found), np.uint64)
            else:
                data = np.frombuffer(b" ".join(run).translate(SPACED), np.uint8)
                at, found = self.words(data) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                owner = np.searchsorted(np.cumsum([len(t) + 1 for t in run]), at, "right").astype(np.uint64)
            keys, counts = np.unique((owner << np.uint64(self.bits)) | found, return_counts=True)
            yield first, last, (keys >> np.uint64(self.bits)).astype(np.int64), (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64), counts
            first = last


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """A long text in pieces of at most `PIECE` bytes, cut between words where there is a gap."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        if stop < len(text):
            gap = text.rfind(b" ", at, stop)
            stop = gap if gap > at else stop
        yield np.frombuffer(text[at:stop], np.uint8)
        at = stop


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts of `docs` (text) each feature occurs, and the number of texts.

    A task adds up all it reads and hands on packed slices, so what moves is a fixed amount a task."""
    size, each = 1 << bits, min(SLICE, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, rows = Features(bits), np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, feature, _ in made.counted(batch.column("text").cast(pa.binary()).to_pylist()):
                held += np.bincount(feature, minlength=size)
        if rows:
            parts = [*held.reshape(-1, each), np.array([rows])]
            full = [k for k, p in enumerate(parts) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([planes(parts[k]) for k in full], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unplanes(x) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([planes(total)], pa.binary())})

    found = docs.select("text").mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    out, rows = np.zeros(size, np.int64), 0
    for r in found.collect():  # size / SLICE + 1 rows
        if r["part"] == size // each:
            rows = int(unplanes(r["counts"])[0])
        else:
            out[r["part"] * each : (r["part"] + 1) * each] = unplanes(r["counts"])
    return out, rows


def weighted(owner: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length by owner."""
    value = (1 + np.log(count)) * idf[feature]
    return value / np.sqrt(np.bincount(owner, value * value))[owner]


# ------------------------------------------------------------------ the index


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k] .. start[k] + size[k] - 1 for each k, in a row."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Unit vectors in blocks of neighbours: by block a matrix for the `head` most frequent features with the largest
    weight of each in the block, and postings by feature for the others.

    What travels are the vectors; the rest is made from them where it is used first.  The matrix is in single
    precision: it finds the candidates, whose cosines are then computed from the vectors."""

    def __init__(self, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, block: int = BLOCK, head: int = HEAD):
        self.n, self.block, self.blocks, self.head_size = n, block, -(-n // block), head
        if (owner[1:] < owner[:-1]).any():
            order = np.argsort(owner, kind="stable")
            owner, feature, value = owner[order], feature[order], value[order]
        self.terms = np.unique(feature)
        self.term, self.weight = np.searchsorted(self.terms, feature).astype(np.int32), value
        self.vector = np.searchsorted(owner, np.arange(n + 1))
        self.scored = 0  # blocks that were scored so far
        self.made = False

    def make(self) -> None:
        owner, term = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.vector)), self.term
        often = np.argsort(-np.bincount(term, minlength=len(self.terms)), kind="stable")[: self.head_size]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        row = self.row[term]
        at = np.flatnonzero(row >= 0)
        self.head = np.zeros((self.blocks, len(often), self.block), np.float32)
        self.head[owner[at] // self.block, row[at], owner[at] % self.block] = self.weight[at]
        self.head_most = self.head.max(axis=2).T if self.n else np.zeros((len(often), 0), np.float32)
        self.head_row, self.head_weight, self.head_start = row[at], self.weight[at], np.searchsorted(owner[at], np.arange(self.n + 1))
        rest = np.flatnonzero(row < 0)
        rest = rest[np.argsort(term[rest], kind="stable")]
        term, self.place, self.value = term[rest], owner[rest], self.weight[rest]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.made = True

    def cosines(self, head: np.ndarray, rest: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Cosines with the examples at `places`, from a vector's weights by head row and its sums over the others."""
        size = self.head_start[places + 1] - self.head_start[places]
        at = expanded(self.head_start[places], size)
        return rest[places] + np.bincount(np.repeat(np.arange(len(places)), size), self.head_weight[at] * head[self.head_row[at]], len(places))

    def sums(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A vector's products with every example over features that aren't in the head."""
        size = self.start[term + 1] - self.start[term]
        at = expanded(self.start[term], size)
        return np.bincount(self.place[at], self.value[at] * np.repeat(value, size), self.blocks * self.block)

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], wanted: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the nearest examples of each unit vector (features, values), best first."""
        if not self.made:
            self.make()
        m = len(queries)
        query = np.repeat(np.arange(m), [len(f) for f, _ in queries])
        feature, value = (np.concatenate([q[j] for q in queries]) for j in (0, 1))
        term = np.minimum(np.searchsorted(self.terms, feature), max(len(self.terms) - 1, 0))
        known = self.terms[term] == feature if len(self.terms) else np.zeros(len(feature), bool)
        query, term, value = query[known], term[known], value[known]
        row = self.row[term]
        often, rare = row >= 0, row < 0
        exact = np.zeros((m, self.head.shape[1]))
        exact[query[often], row[often]] = value[often]
        vectors = exact.astype(np.float32)
        # one vector at a time, whose postings stay in cache
        ends = np.searchsorted(query[rare], np.arange(m + 1))
        term, value = term[rare], value[rare]
        rest = np.array([self.sums(term[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]).reshape(m, self.blocks, self.block)
        bound = vectors @ self.head_most + rest.max(axis=2, initial=0.0)
        found = np.zeros((m, self.blocks, self.block), np.float32)
        few = rest.astype(np.float32)

        def score(need: np.ndarray) -> None:
            for k in np.flatnonzero(need.any(axis=0)):
                some = np.flatnonzero(need[:, k])
                found[some, k] = vectors[some] @ self.head[k] + few[some, k]
            self.scored += int(need.sum())

        # the blocks of the highest bounds first; then those that can still hold one of the best
        first = min(FIRST, self.blocks)
        top = np.argpartition(-bound, first - 1, axis=1)[:, :first] if self.blocks else np.zeros((m, 0), int)
        need = np.zeros((m, self.blocks), bool)
        np.put_along_axis(need, top, True, axis=1)
        score(need & (bound > 0))
        least = np.zeros(m)
        if first * self.block >= wanted:
            least = np.partition(found[np.arange(m)[:, None], top].reshape(m, -1), -wanted, axis=1)[:, -wanted]
        score(~need & (bound > 0) & (bound >= least[:, None] - MARGIN))
        out = []
        for k in range(m):
            all_of = found[k].ravel()
            places = np.flatnonzero((all_of > 0) & (all_of >= least[k] - MARGIN))
            if len(places) > wanted:
                near = all_of[places]
                places = places[near >= np.partition(near, -wanted)[-wanted] - MARGIN]
            cosines = np.round(self.cosines(exact[k], rest[k].ravel(), places), 12)
            best = np.lexsort((places, -np.round(cosines, 9)))[:wanted]
            out.append((places[best], cosines[best]))
        return out

    def nearest(self, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(feature, value)])[0]


class Voter:
    """All that scores a text before calibration."""

    def __init__(self, index: Index, idf: np.ndarray, labels: np.ndarray, weights: np.ndarray, ids: list, rate: float, bits: int = BITS):
        self.index, self.idf, self.labels, self.weights, self.ids, self.rate, self.bits = index, idf, labels, weights, ids, rate, bits

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among neighbours, by cosine and weight, and the base rate by `PRIOR`."""
        w = cosines * self.weights[places]
        return float((w @ self.labels[places] + PRIOR * self.rate) / (w.sum() + PRIOR))

    def votes(self, texts: list[bytes | None], made: Features) -> Iterator[tuple[float, list, list]]:
        """Vote, nearest examples and their cosines for each text."""
        for first, last, owner, feature, count in made.counted(texts):
            value = weighted(owner, feature, count, self.idf) if len(owner) else np.zeros(0)
            at = np.searchsorted(owner, np.arange(last - first + 1))
            queries = [(feature[a:b], value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            for k in range(0, len(queries), TOGETHER):
                for places, cosines in self.index.nearest_of(queries[k : k + TOGETHER]):
                    yield self.vote(places, cosines), [self.ids[p] for p in places[:3]], [float(c) for c in cosines[:3]]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (x, level) of a rising step function."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for k in order:
        pools.append([x[k], y[k] * w[k], w[k]])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    xs = np.array([p[0] for p in pools])
    return xs, np.array([p[1] / p[2] for p in pools])


def calibration(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the line that turns a vote into a chance: the isotonic steps at their upper ends, a little off 0
    and 1, between these, so that a higher vote is a higher chance."""
    xs, levels = isotonic(x, y, w)
    off = 0.5 / (w.sum() + 1)
    return np.array([0.0, *xs, 1.0]), np.array([0.0, *(off + (1 - 2 * off) * levels), 1.0])


# ------------------------------------------------------------------ examples


def vectors_of(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """`rows` (doc_id, one, hash, text) with the text's features and their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(bits)
        for batch in batches:
            features, counts = [], []
            for first, last, owner, feature, count in made.counted(batch.column("text").cast(pa.binary()).to_pylist()):
                at = np.searchsorted(owner, np.arange(last - first + 1))
                features += [feature[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                counts += [count[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            out = batch.select(["doc_id", "one", "hash"])
            yield out.append_column("features", pa.array(features, pa.binary())).append_column("counts", pa.array(counts, pa.binary()))

    return rows.select("doc_id", "one", "hash", "text").mapInArrow(run, "doc_id long, one int, hash long, features binary, counts binary")


def sampled(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """`EXAMPLES` rows of each (part, label) that hold a word, by the smallest text hash, and how many there are."""
    worded = rows.filter(F.col("text").rlike(r"[^\x00-@\[-`{-\x7F]"))
    short = stored(worded.select("part", "one", "hash"), "labelled")
    there = {(r["part"], r["one"]): r["n"] for r in short.groupBy("part", "one").agg(F.count(F.lit(1)).alias("n")).collect()}
    group = lambda key: (F.col("part") == key[0]) & (F.col("one") == key[1])
    chosen = F.lit(False)
    for key in there:
        last = short.filter(group(key)).orderBy("hash").limit(EXAMPLES).agg(F.max("hash")).first()[0]
        chosen |= group(key) & (F.col("hash") <= last)
    return stored(worded.filter(chosen), "examples"), there


def first_of(rows: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """At most `EXAMPLES` rows of each key of `rows`, whose last hash may be that of several rows."""
    parts = [rows.filter((F.col("part") == p) & (F.col("one") == o)).orderBy("hash", "doc_id").limit(EXAMPLES) for p, o in keys]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def voter_of(examples: DataFrame, there: dict, idf: np.ndarray, rate: float) -> Voter:
    """The index over the examples, built from their packed vectors."""
    table = vectors_of(examples).toArrow()
    features = [np.frombuffer(x, "<u4") for x in table.column("features").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    ids, one, text = table.column("doc_id").to_pylist(), table.column("one").to_numpy(), table.column("hash").to_numpy()
    del table
    # neighbours share their most frequent feature, the smallest of several
    most = np.array([int(f[np.argmax(c)]) for f, c in zip(features, counts, strict=True)])
    order = np.lexsort((np.array([-1 if i is None else i for i in ids]), text, most))
    owner = np.repeat(np.arange(len(order), dtype=np.int32), [len(features[k]) for k in order])
    feature = np.concatenate([features[k] for k in order])
    del features
    count = np.concatenate([counts[k] for k in order])
    del counts
    value = weighted(owner, feature, count, idf)
    del count
    labels = one[order].astype(float)
    taken = {o: int((one == o).sum()) for o in (0, 1)}
    weights = np.array([there[0, int(o)] / taken[int(o)] for o in labels])
    return Voter(Index(owner, feature, value, len(order)), idf, labels, weights, [ids[k] for k in order], rate)


RESULT = "doc_id long, score double, evidence array<long>, cosines array<double>"


def toxicity(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id, score (calibrated chance of label 1), evidence (nearest examples) and their cosines
    for each row of `docs` (doc_id, text); `labels` (doc_id, toxic) are read where `train`, a
    condition on doc_id, holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("doc_id is not null and toxic is not null").filter(train)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("one"))
    rows = joined_small(docs, known, ["doc_id"], "inner", BROADCAST_LABELS)
    rows = rows.select("doc_id", "text", "one", F.xxhash64("text").alias("hash"))
    # part 1 is held out for calibration
    rows = rows.withColumn("part", (F.pmod("hash", F.lit(FOLDS)) == 0).cast("int"))
    sizes = {(r["part"], r["one"]): r["n"] for r in rows.groupBy("part", "one").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    rate = ones / (ones + zeros) if ones + zeros else 0.5
    chosen, there = sampled(rows) if ones and zeros else (None, {})
    if not there.get((0, 0)) or not there.get((0, 1)):
        none = [F.array().cast(f"array<{k}>").alias(n) for n, k in (("evidence", "bigint"), ("cosines", "double"))]
        return docs.select("doc_id", F.lit(float(rate)).alias("score"), *none)
    held, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + held)) + 1
    voter = spark.sparkContext.broadcast(voter_of(first_of(chosen, [(0, 0), (0, 1)]), there, idf, rate))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            found = [v for v, _, _ in voter.value.votes(batch.column("text").cast(pa.binary()).to_pylist(), made)]
            yield pa.RecordBatch.from_arrays([batch.column("one"), pa.array(found, pa.float64())], ["one", "vote"])

    levels = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    others = [key for key in ((1, 0), (1, 1)) if there.get(key)]
    if len(others) == 2:
        # at most `EXAMPLES` votes of each label
        spread = first_of(chosen, others).select("one", "text").repartition(spark.sparkContext.defaultParallelism)
        held_out = spread.mapInArrow(vote, "one int, vote double").toArrow()
        y, x = held_out.column("one").to_numpy().astype(float), held_out.column("vote").to_numpy()
        w = np.array([there[1, o] / (y == o).sum() for o in (0, 1)])[y.astype(int)]
        order = np.lexsort((y, x))
        levels = calibration(x[order], y[order], w[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            votes, evidence, cosines = zip(*voter.value.votes(batch.column("text").cast(pa.binary()).to_pylist(), made), strict=True) if batch.num_rows else ((), (), ())
            scores = np.interp(np.array(votes), *levels)
            made_of = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(made_of, names=["doc_id", "score", "evidence", "cosines"])

    return docs.mapInArrow(run, RESULT)

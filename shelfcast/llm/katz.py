"""Language-model scores by Katz backoff.

Counts of every order are added up over key ranges (see `chunks.exchange`), Good-Turing discounts
follow from the counts of counts, and the mass a context loses to them goes to the words it was
never followed by, in proportion to their probability one order down:

    P(w | u) = d(c) c(u w) / c(u)           where the training texts hold u w
    P(w | u) = alpha(u) P(w | shorter u)    elsewhere
    alpha(u) = (1 - sum of the seen P(w | u)) / (1 - sum of the same words' P(w | shorter u))

so the probabilities after a context add up to 1, one word that was never seen included.  Counts
above `LARGEST` lose as much as `LARGEST` does, so every context has mass left.  What is kept in
the shared folder are the answers to each chunk for its own keys, so other texts can't be scored from
it, and backoff sums are made only for contexts that these documents lack; a token takes the longest known n-gram and
walks down through the weights, all tokens of a chunk at a time.

The longest n-grams are counted first.  Chunks that hold n-grams which training lacks ask for their contexts along
with the counts of the next shorter order, and owners learn there which contexts anybody asked for, so only sums over
those are sent.  Shuffle files go as soon as the table they were written for is stored, and the large tables once the
last step that reads them is.

Defined results: a null text is empty, and an empty text is one end token; documents with a null id
or flag are not trained on if the flag isn't true; repeated rows count and are scored as often as
they occur; with nothing to train on every token has probability 1; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.chunks import (
    SENT, Chunk, chained, chunked, distinct_of, distinct_places, exchange, floats, planes, ranges_for, rows_of, sent, starts_of_equal, unfloats,
    unplanes,
)
from shelfcast.llm.common import release, stored

ORDER, LARGEST = 3, 5
WAVES = 4
BITS = 56
END, BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
COUNTS = ", ".join(["tokens long", "types long", *[f"n{r} long" for r in range(1, LARGEST + 2)]])
SHIFT = np.uint64(64 - BITS)


class Text:
    """Tokens of a chunk with their contexts: `grams[m]` hashes the last m tokens up to each place."""

    def __init__(self, row: dict, order: int):
        chunk = Chunk(row)
        self.ids, self.train = chunk.ids, chunk.flags
        self.n = chunk.lens + 1
        self.token = np.insert(chunk.hashes[chunk.codes], chunk.starts[1:], END)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        first = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.place = place = np.arange(len(self.token)) - np.repeat(first, self.n)
        self.grams, self.contexts = [None, self.token], [None, None]
        before = [self.token]
        for m in range(2, order + 1):
            prior = np.roll(before[-1], 1)
            prior[place == 0] = BEGIN
            before.append(prior)
            self.contexts.append(chained(*reversed(before[1:])) if m > 2 else prior)
            self.grams.append(chained(*reversed(before)))

    def keys(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of order m, the first place of each, and the key of each place."""
        return distinct_places(self.grams[m] >> SHIFT)


def counted(chunks: DataFrame, m: int, ranges: int) -> DataFrame:
    """Rows that send the training counts of a chunk's m-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                text = Text(row, m)
                keys, _, at = text.keys(m)
                n = np.bincount(at[text.train[text.doc]], minlength=len(keys))
                yield pa.RecordBatch.from_pydict(sent(row["chunk"], keys, lambda s, n=n: planes(n[s]), ranges, BITS))

    return chunks.mapInArrow(run, SENT)


def asking(chunks: DataFrame, longer: DataFrame, m: int, ranges: int) -> DataFrame:
    """Rows without values that send the m-grams before the words of which a chunk lacks the `longer` n-gram; the start
    of a text is no n-gram."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.concatenate([unplanes(x["got"]) for x in sorted(rows_of(right), key=lambda x: x["r"])]) >> 2
        out = []
        for row in rows_of(left):
            text = Text(row, m + 1)
            lacks = (total[text.keys(m + 1)[2]] == 0) & (text.place > 0)
            keys = distinct_of(text.grams[m][np.flatnonzero(lacks) - 1] >> SHIFT)
            out.append(pa.table(sent(row["chunk"], keys, lambda s: b"", ranges, BITS)))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(longer.groupBy("chunk")).applyInArrow(run, SENT)


def added(rows: DataFrame) -> DataFrame:
    """Answers of four times the total count, plus 2 if any chunk asks for the key, plus 1 for the one chunk that owns
    it.  Rows of `asking` get none."""

    def answer(keys: list, vals: list, distinct: np.ndarray, index: np.ndarray) -> tuple[list, dict]:
        asks = np.repeat([not v for v in vals], [len(k) for k in keys])
        count = np.concatenate([unplanes(v) if v else np.zeros(len(k), np.uint64) for k, v in zip(keys, vals, strict=True)])
        total = np.bincount(index, count.astype(np.float64), len(distinct)).astype(np.int64)
        asked = np.bincount(index[asks], minlength=len(distinct)) > 0
        counts = np.flatnonzero(~asks)[::-1]
        first = np.full(len(distinct), -1)
        first[index[counts]] = counts  # of equal places the last one written stays
        got = (4 * total + 2 * asked)[index]
        got[first[first >= 0]] += 1
        by_count = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)
        more = {"tokens": int(total.sum()), "types": int((total > 0).sum())} | {f"n{r}": int(by_count[r]) for r in range(1, LARGEST + 2)}
        parts = np.split(got, np.cumsum([len(k) for k in keys])[:-1])
        return [planes(g) if v else None for g, v in zip(parts, vals, strict=True)], more

    return exchange(rows, answer, COUNTS)


def in_waves(chunks: DataFrame, answers: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], tag: str) -> DataFrame:
    """`step` of the chunks and their answers, stored a part of the chunks at a time, so no more than that is shuffled
    at once."""
    out = None
    for k in range(WAVES):
        part = F.pmod("chunk", F.lit(WAVES)) == k
        rows = stored(step(chunks.filter(part), answers.filter(part)), tag, keep_shuffles=False)
        out = rows if out is None else out.unionByName(rows)
    return out


def discounts(n: dict) -> np.ndarray:
    """d(c) c for c = 0 .. LARGEST; beyond, c less the loss at LARGEST."""
    kept = np.zeros(LARGEST + 1)
    common = (LARGEST + 1) * n[f"n{LARGEST + 1}"] / n["n1"] if n["n1"] else 1.0
    for r in range(1, LARGEST + 1):
        turing = (r + 1) * n[f"n{r + 1}"] / n[f"n{r}"] if n[f"n{r}"] else 0.0
        d = (turing / r - common) / (1 - common) if common != 1 else 0.0
        kept[r] = r * d if 0 < d < 1 else r - 0.5  # too few counts for an estimate
    return kept


def kept_counts(c: np.ndarray, kept: np.ndarray) -> np.ndarray:
    out, large = kept[np.minimum(c, LARGEST)], np.flatnonzero(c > LARGEST)
    out[large] = c[large] - (LARGEST - kept[-1])
    return out


class Model:
    """Discounts of all orders and the probability of a word that training never saw."""

    def __init__(self, stats: list[dict], documents: int):
        self.kept = [None, *[discounts(s) for s in stats]]
        self.tokens, self.types, self.documents = stats[0]["tokens"], stats[0]["types"], documents
        lost = sum(stats[0][f"n{r}"] * (r - self.kept[1][r]) for r in range(1, LARGEST + 1))
        lost += (self.types - sum(stats[0][f"n{r}"] for r in range(1, LARGEST + 1))) * (LARGEST - self.kept[1][-1])
        self.unseen = lost / self.tokens if self.tokens else 1.0


def packed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpacked(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


SCORED = pa.schema(
    [("r", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("scores", pa.binary())]
)
SCORED_SQL = "r int, chunk long, keys binary, vals binary, ids array<long>, train binary, scores binary"
RESULT = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def scored_so_far(chunks: DataFrame, answers: DataFrame, model: Model, order: int, ranges: int) -> DataFrame:
    """Per chunk a row r = -1 with what its documents score without backoff weights and which
    weights they lack, and rows that send sums over the contexts of the n-grams it owns, if anybody asks for them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for x in sorted(rows_of(right), key=lambda x: (x["m"], x["r"])):
            got.setdefault(x["m"], []).append(unplanes(x["got"]))
        out = [SCORED.empty_table()]
        for row in rows_of(left):
            text = Text(row, order)
            size = len(text.n)
            none = np.zeros(0)
            mine, lost, low, lacking, of, totals = [none.astype(np.uint64)], [none], [none], [none.astype(np.uint64)], [none.astype(np.int64)], [none.astype(np.int64)]
            for m in range(1, order + 1):
                _, first, at = text.keys(m)
                both = np.concatenate(got[m]).astype(np.int64)
                count, owner = both >> 2, (both & 1).astype(bool)
                c, left_over = count[at], kept_counts(count, model.kept[m])
                if m == 1:
                    n_known = np.bincount(text.doc[c > 0], minlength=size)
                    base = np.bincount(text.doc, np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[at], size)
                    p = np.where(count > 0, left_over / max(model.tokens, 1), model.unseen)[at]
                else:
                    # a context occurred as often as the shorter n-gram that it is
                    total = np.where(text.place == 0, model.documents, np.roll(below, 1))
                    key = text.contexts[m] >> SHIFT
                    has = np.flatnonzero(owner & (count > 0))
                    own = first[has]
                    # the start of a text is no n-gram, so nobody could ask for it
                    wanted = (text.place[own] == 0) | asked_for[own - 1]
                    own, has = own[wanted], has[wanted]
                    mine.append(key[own])
                    lost.append((count - left_over)[has])
                    low.append(lower[own])
                    lacks = (c == 0) & (total > 0)
                    lacking.append(key[lacks])
                    of.append(text.doc[lacks])
                    totals.append(total[lacks])
                    p = np.where(c > 0, left_over[at] / np.maximum(total, 1), lower)
                lower, below, asked_for = p, c, (both >> 1 & 1).astype(bool)[at]
            own_keys, ask_keys = np.concatenate(mine), np.concatenate(lacking)
            asked, first, which = distinct_places(ask_keys)
            keys, _, at = distinct_places(np.concatenate([own_keys, asked]))
            sums = [np.bincount(at[: len(own_keys)], np.concatenate(w), len(keys)) for w in (lost, low)]
            wants = np.zeros(len(keys), bool)
            wants[at[len(own_keys) :]] = True
            pack = lambda s, w=wants, x=sums: packed(planes(w[s].astype(np.uint64)), floats(x[0][s]), floats(x[1][s]))
            rows = sent(row["chunk"], keys, pack, ranges, BITS)
            k = len(rows["r"])
            out.append(pa.table(rows | {f: pa.nulls(k, SCORED.field(f).type) for f in ("ids", "train", "scores")}).select(SCORED.names))
            pairs = np.sort(which * size + np.concatenate(of))
            begin = np.flatnonzero(starts_of_equal(pairs))
            which, doc = np.divmod(pairs[begin], size)
            times = np.diff(begin, append=len(pairs))
            needs = packed(planes(np.concatenate(totals)[first]), planes(which), planes(doc), planes(times))
            scores = packed(*[floats(x) for x in (text.n, n_known, base, np.bincount(text.doc, np.log10(lower), size))])
            train = text.train.astype(np.uint8).tobytes()
            out.append(pa.Table.from_pylist([{"r": -1, "chunk": row["chunk"], "vals": needs, "ids": text.ids, "train": train, "scores": scores}], SCORED))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORED_SQL)


def context_sums(rows: DataFrame) -> DataFrame:
    """Answers with the sums of all chunks for the contexts that each one asked for."""

    def answer(keys: list, vals: list, distinct: np.ndarray, index: np.ndarray) -> tuple[list, dict]:
        parts = [unpacked(v) for v in vals]
        sums = [np.bincount(index, np.concatenate([unfloats(p[j]) for p in parts]), len(distinct)) for j in (1, 2)]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        got = []
        for place, part in zip(np.split(index, ends), parts, strict=True):
            place = place[unplanes(part[0]).astype(bool)]
            got.append(packed(floats(sums[0][place]), floats(sums[1][place])))
        return got, {}

    return exchange(rows, answer)


def finished(waiting: DataFrame, answers: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = [unpacked(x["got"]) for x in sorted(rows_of(right), key=lambda x: x["r"])]
        lost, low = (np.concatenate([np.zeros(0), *[unfloats(g[j]) for g in given]]) for j in (0, 1))
        out = []
        for row in rows_of(left):
            total, which, doc, times = (unplanes(x).astype(np.int64) for x in unpacked(row["vals"]))
            n, known, base, score = (unfloats(x) for x in unpacked(row["scores"]))
            weight = np.log10(lost / total / (1 - low))
            score = score + np.bincount(doc, weight[which] * times, len(n))
            train = np.frombuffer(row["train"], np.uint8).astype(bool)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["ids"], pa.int64()), "train": train, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64),
                        "base_score": base, "score": score,
                    }
                )
            )
        return pa.concat_tables(out)

    return waiting.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RESULT)


def scores(docs: DataFrame, train: Column, order: int = ORDER) -> tuple[DataFrame, int]:
    """doc_id, train, n_tokens, n_known, base_score and score for each row of `docs` (doc_id, text),
    learned from the rows where `train` holds, and the number of training tokens."""
    if order < 1:
        raise ValueError("order must be at least 1")
    chunks = stored(chunked(docs, train), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    ranges = ranges_for(size[0] + size[1])
    answered = lambda t: t.filter("chunk <> -1 AND got IS NOT NULL").select("r", "chunk", "got")
    tables: list[DataFrame] = []
    for m in range(order, 0, -1):
        rows = counted(chunks, m, ranges)
        if tables:
            rows = rows.unionByName(in_waves(chunks, answered(tables[0]), lambda c, a, m=m: asking(c, a, m, ranges), f"katz-asks-{m}"))
        tables.insert(0, stored(added(rows), f"katz-{m}", keep_shuffles=False))
    names = [c.split()[0] for c in COUNTS.split(", ")]
    stats = [t.filter("chunk = -1").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict() for t in tables]
    trained = docs.filter(train).count()
    model = Model(stats, trained)
    answers = None
    for m, t in enumerate(tables, 1):
        rows = answered(t).select(F.lit(m).alias("m"), "r", "chunk", "got")
        answers = rows if answers is None else answers.unionByName(rows)
    partly = in_waves(chunks, answers, lambda c, a: scored_so_far(c, a, model, order, ranges), "katz-contexts")
    release(chunks, *tables)
    weights = context_sums(partly.filter("r >= 0").select("r", "chunk", "keys", "vals"))
    waiting = partly.filter("r = -1").select("chunk", "vals", "ids", "train", "scores")
    return finished(waiting, weights), model.tokens

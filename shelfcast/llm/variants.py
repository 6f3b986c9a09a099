"""Spelling variants: words that differ by one code point, found with bit-sliced position indexes.

The index of a vocabulary holds, for every (position, letter), the set of its words with that letter
there, as a bitset of one bit per word.  A query word runs over its letters once and keeps four sets of
words for all of the vocabulary at a time, with and, or and shifted positions only: those that agree so
far, and those with one error so far, which was a replaced, an inserted or a deleted letter (so the
word is read at the same place, one further or one back).

A word of 2h letters or more that differs from another one by one code point agrees with it in its
first h or in its last h letters.  So the vocabulary is cut by (shorter length of the two, first or last
half), and each part is indexed alone; a part of more than `BLOCK` words is cut into blocks, and its
queries go to each of them.

Words are maximal runs of letters of the documents, counted over all of them.  A run whose hash with its
document's id is divisible by `DAMAGE` loses one code point, as given by the task that this operator
serves; `occurrences` takes other numbers, 0 for none.

Defined results: a null text has no words; a null id is written as nothing in the hash; repeated rows
count as often as they occur; of equally frequent near words the first in code-point order is the form;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO, DAMAGE = 7, 2, 10, 31
BLOCK = 16_384
# different words that a task counts before it hands them on
HELD = 200_000


# ------------------------------------------------------------------ words


def damaged(doc_id: int | None, word: str, every: int) -> str:
    """`word`, or `word` less one code point where the hash says so."""
    if every:
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
        if h % every == 0:
            k = h % len(word)
            return word[:k] + word[k + 1 :]
    return word


def occurrences(docs: DataFrame, shortest: int = SHORTEST, every: int = DAMAGE) -> DataFrame:
    """word and n, over all of `docs` (doc_id, text), for words of at least `shortest` code points."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            texts = batch.column("text")
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[k].as_py()
                if not text:
                    continue
                # A-Z alone to lower case
                found = Counter(runs.findall(text.encode("utf-8", "replace").lower().decode()))
                for word, n in found.items():
                    held[damaged(doc, word, every)] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.char_length("word") >= shortest)


# ------------------------------------------------------------------ the index


class BitIndex:
    """Bitsets by (position, letter) over a list of words: bit k stands for word k."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: dict[tuple[int, str], int] = {}
        self.long: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.long[len(word)] = self.long.get(len(word), 0) | bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit

    def near(self, word: str, lengths: tuple[int, ...]) -> Iterator[int]:
        """Places of the words of these lengths that differ from `word` by exactly one inserted,
        deleted or replaced code point."""
        n, at = len(word), self.at.get
        same = self.long.get(n, 0) if n in lengths else 0
        longer = self.long.get(n + 1, 0) if n + 1 in lengths else 0
        shorter = self.long.get(n - 1, 0) if n - 1 in lengths else 0
        # sets after i letters: no error; one replaced; one more letter in the word; one fewer
        none, swapped, more, fewer = same | longer | shorter, 0, longer, 0
        for i, letter in enumerate(word):
            here = at((i, letter), 0)
            swapped = (swapped & here) | (none & same & ~here)
            fewer = (fewer & at((i - 1, letter), 0)) | (none & shorter)
            none &= here
            more = (more & at((i + 1, letter), 0)) | (none & longer)
            if not (none or swapped or more or fewer):
                return
        found = swapped | more | fewer
        while found:
            low = found & -found
            yield low.bit_length() - 1
            found ^= low


# ------------------------------------------------------------------ pairs

PART = ["m", "side", "piece", "block"]


def parts(words: DataFrame, shortest: int) -> DataFrame:
    """m (length of the shorter word of a pair), side and piece (its half) for each place of a word."""
    long = F.char_length("word")
    lengths = F.filter(F.array(long, long - 1), lambda m: m >= shortest)
    at = words.select("word", "n", F.explode(lengths).alias("m")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.floor(F.col("m") / 2).cast("int")
    return at.withColumn("piece", F.when(F.col("side") == 0, F.left("word", half)).otherwise(F.right("word", half)))


def near_pairs(words: DataFrame, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """word, n, other and n_other, both ways, for words of `words` (word, n; distinct, at least
    `shortest` code points) that differ by one code point."""
    places = parts(words, shortest)
    sizes = places.groupBy("m", "side", "piece").agg(F.count(F.lit(1)).alias("size"))
    # a part of one word has no pairs
    large = stored(sizes.filter(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"), "large")
    if large.isEmpty():
        cut = places.withColumn("blocks", F.lit(1))
    else:
        side = F.broadcast(large) if large.limit(100_001).count() <= 100_000 else large
        cut = places.join(side, ["m", "side", "piece"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # words of a part of one block ask themselves; those of several also go to each block to ask
    several = F.col("blocks") > 1
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = cut.select("m", "side", "piece", own.alias("block"), F.lit(0).alias("role"), "word", "n", (~several).alias("alone"))
    if not large.isEmpty():
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        rows = rows.unionByName(cut.filter(several).select("m", "side", "piece", each, F.lit(1).alias("role"), "word", "n", F.lit(False).alias("alone")))
    dealt = rows.repartition(*PART).sortWithinPartitions(*PART, "role", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*PART, "role", "word", "n", "alone"]

        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)

        out: list[tuple] = []
        for (m, side, _, _), group in groupby(stream(), key=lambda r: r[:4]):
            half, held, index = m // 2, [], None

            def ask(word: str, n: int, index: BitIndex, held: list, m: int = m, side: int = side, half: int = half) -> Iterator[tuple]:
                for k in index.near(word, (m, m + 1) if len(word) == m else (m,)):
                    other, count = held[k]
                    # pairs that agree in both halves are found by the first one
                    if not (side and other[:half] == word[:half]):
                        yield word, n, other, count

            # words that are indexed come first, then those that only ask
            for *_, role, word, n, alone in group:
                if role == 0:
                    held.append((word, n))
                else:
                    index = index or BitIndex([w for w, _ in held])
                    out.extend(ask(word, n, index, held))
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            if index is None and alone and len(held) > 1:
                index = BitIndex([w for w, _ in held])
                for word, n in held:
                    out.extend(ask(word, n, index, held))
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, "word string, n long, other string, n_other long")


def batch_of(pairs: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), kinds, strict=True)], ["word", "n", "other", "n_other"])


# ------------------------------------------------------------------ forms


def grouped_variants(words: DataFrame, shortest: int = SHORTEST, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root for each row of `words` (word, n): the form is the most
    frequent near word if it is `ratio` times as frequent, the root is what forms lead to."""
    pairs = near_pairs(words, shortest, block)
    # structs compare by count, then by the word: the first in order wins where the count is negated
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    ok = form_n >= F.col("n") * ratio
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best.form")).alias("form"), F.when(ok, form_n).alias("form_n")
    )
    found = stored(found, "forms")
    # every step is `ratio` times as frequent, so chains are short; each round doubles what is known of them
    chains = stored(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if moved.filter("went").isEmpty():
            break
        chains = moved.select("word", "root")
    return found.join(chains, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, every: int = DAMAGE, block: int = BLOCK) -> DataFrame:
    """`grouped_variants` of the words of `docs` (doc_id, text) that occur at least `least` times."""
    words = stored(occurrences(docs, shortest, every).filter(F.col("n") >= least), "words")
    return grouped_variants(words, shortest, ratio, block)

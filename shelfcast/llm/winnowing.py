"""Benchmark decontamination by winnowing, in DataFrame operations only.

From every run of `WINDOW - K + 1` neighbouring k-grams the leftmost one with the smallest hash is
kept as a fingerprint, so two texts that share `WINDOW` words in a row share a fingerprint at the
same place of that run.  Fingerprints of documents meet those of the benchmark, and each hit is
extended word by word to both sides; where `WINDOW` words agree, all of them are hit.  Items of
fewer words are one window each and are looked up as whole n-grams of their own length.

Each word is hashed once, n-grams are hashes of word hashes, and documents are looked up by (place,
hash) alone.  Only documents that meet a benchmark hash are read again, to cut out and compare the
words around the places they met it at; equal hashes of different words decide nothing.

Defined results: null and empty texts, and texts without words, have no words and hit nothing;
items without words can't be found; repeated items count once; a null id is an id like others;
rows that share an id and a text share their hits; empty tables give an empty result, or documents
without hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import ascii_lower, let, stored, text_key, without

WINDOW, K = 10, 5
# benchmark fingerprints (about 300 bytes each) and places met are broadcast up to this number, joined by shuffle beyond
BROADCAST_ROWS = 100_000
MARK = "array<struct<n:int,pos:int,hash:bigint>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def grams(hashes: Column, n: int) -> Column:
    """Hashes of the n-grams of an array of at least n word hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[hashes[i + j] for j in range(n)]))


def minima(values: Column, span: int) -> Column:
    """The least of every `span` neighbours; runs of doubled length are put together from shorter ones."""
    width, out = 1, values
    while width < span:
        step = min(width, span - width)
        longer = lambda v, step=step: F.zip_with(v, F.slice(v, step + 1, F.greatest(F.size(v) - step, F.lit(0))), lambda a, b: F.least(a, b))
        out, width = let(out, longer), width + step
    return F.slice(out, 1, F.size(values) - span + 1)


def winnowed(hashes: Column, window: int = WINDOW, k: int = K) -> Column:
    """Fingerprints (n = 0, place, hash) of at least `window` word hashes."""

    def of(g: Column) -> Column:
        # 31 bits of hash above the place: the least number is the leftmost of the least hashes
        ranked = F.transform(g, lambda h, i: F.shiftleft(h.bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(i.cast("long")))
        places = F.array_distinct(let(ranked, lambda v: minima(v, window - k + 1)))

        def mark(v: Column) -> Column:
            pos = v.bitwiseAND(0xFFFFFFFF).cast("int")
            return F.struct(F.lit(0).alias("n"), pos.alias("pos"), g[pos].alias("hash"))

        return F.transform(places, mark)

    return let(grams(hashes, k), of)


def marks(hashes: Column, lengths: list[int], window: int = WINDOW, k: int = K) -> Column:
    """Fingerprints, and the n-grams of each of `lengths`, of an array of word hashes."""
    none = F.array().cast(MARK)

    def whole(n: int) -> Column:
        each = F.transform(grams(hashes, n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), h.alias("hash")))
        return F.when(F.size(hashes) >= n, each).otherwise(none)

    long = F.when(F.size(hashes) >= window, winnowed(hashes, window, k)).otherwise(none)
    return F.concat(long, *[whole(n) for n in lengths])


def around(w: Column, mark: Column, window: int = WINDOW, k: int = K) -> Column:
    """The words of a mark and, of a fingerprint, up to `window - k` words on both sides, those of
    `left` in reverse."""
    reach = F.when(mark["n"] == 0, F.lit(window - k)).otherwise(F.lit(0))
    size = F.when(mark["n"] == 0, F.lit(k)).otherwise(mark["n"])
    start = F.greatest(mark["pos"] - reach, F.lit(0))
    return F.struct(
        mark["n"].alias("n"),
        mark["pos"].alias("pos"),
        mark["hash"].alias("hash"),
        F.reverse(F.slice(w, start + 1, mark["pos"] - start)).alias("left"),
        F.slice(w, mark["pos"] + 1, size).alias("mid"),
        F.slice(w, mark["pos"] + size + 1, reach).alias("right"),
    )


def agreeing(a: Column, b: Column) -> Column:
    """How many words `a` and `b` share from their start on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.element_at(differs, 1)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, keyed: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text) against `items` (item_id, text): doc_id, n_words,
    n_hit, n_items, items (sorted array), contaminated, and the text's digest _key if `keyed`."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), text_key(F.col("text")).alias("_key"))
    items = stored(items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").distinct(), "items")
    lengths = sorted(r[0] for r in items.select(F.size("w")).filter(F.size("w") < window).distinct().collect())  # fewer than `window` numbers

    # an item of fewer words than a window has one mark, itself
    fits = lambda w: lambda m: (F.size(w) >= window) == (m["n"] == 0)
    of_item = let(word_hashes(F.col("w")), lambda h: marks(h, lengths, window, k))
    own = F.filter(F.filter(of_item, fits(F.col("w"))), lambda m: (m["n"] == 0) | (m["n"] == F.size("w")))
    whole = items.select("item_id", F.explode(F.transform(own, lambda m: around(F.col("w"), m, window, k))).alias("f"))
    # equal surroundings are checked once, for all items that have them
    places = whole.groupBy("f.n", "f.hash", "f.left", "f.mid", "f.right").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    places = stored(places.select("n", "hash", *[F.col(c).alias(f"i_{c}") for c in ("left", "mid", "right")], "ids"), "places")
    wanted = places.select("n", "hash").distinct().withColumn("_met", F.lit(True))
    if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        places, wanted = F.broadcast(places), F.broadcast(wanted)

    # one pass over the documents: a row that counts the words, with n = -1, and the marks that the benchmark has too
    def of_text(w: Column) -> Column:
        count = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("pos"), F.size(w).cast("long").alias("hash"))
        return F.concat(F.array(count), let(word_hashes(w), lambda h: marks(h, lengths, window, k)))

    spans = docs.select("doc_id", "_key", F.explode(let(words(F.col("_text")), of_text)).alias("m")).select("doc_id", "_key", "m.*")
    seen = stored(spans.join(wanted, ["n", "hash"], "left").filter("n < 0 or _met").drop("_met"), "met")
    met = seen.filter("n >= 0").groupBy("doc_id", "_key").agg(F.collect_set(F.struct("n", "pos", "hash")).alias("_marks"))
    met = stored(met.withColumnsRenamed({"doc_id": "_doc", "_key": "_same"}), "met")
    if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = F.broadcast(met)
    again = docs.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_same")))
    cut = let(words(F.col("_text")), lambda w: F.transform("_marks", lambda m: around(w, m, window, k)))
    near = again.select("doc_id", "_key", F.explode(cut).alias("f")).select("doc_id", "_key", "f.*")
    near = near.join(places, ["n", "hash"]).filter(F.col("mid") == F.col("i_mid"))
    near = near.withColumns({"_l": agreeing(F.col("left"), F.col("i_left")), "_r": agreeing(F.col("right"), F.col("i_right"))})
    hits = near.filter((F.col("n") > 0) | (F.col("_l") + F.col("_r") + k >= window)).select(
        "doc_id", "_key", (F.col("pos") - F.col("_l")).alias("start"), (F.col("pos") + F.size("mid") + F.col("_r")).alias("stop"), "ids"
    )

    # what is gathered for a document is bounded by its own length and its own items
    per_doc = hits.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"), F.collect_set("ids").alias("_ids"))
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))
    found = per_doc.select(
        F.col("doc_id").alias("_doc"), F.col("_key").alias("_same"), F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_ids"))).alias("items")
    )
    counted = seen.filter("n < 0").select("doc_id", "_key", F.col("hash").alias("n_words"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_same")), "left")
    none = F.array().cast(found.schema["items"].dataType)
    return joined.select(
        "doc_id",
        *([F.col("_key")] if keyed else []),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ).withColumn("n_items", F.size("items").cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs."""
    gone = contamination(docs, items, keyed=True).filter("contaminated").select("doc_id", "_key")
    return without(docs, gone, [F.col("doc_id"), text_key(F.col("text"))])

"""Language identification by Bayesian evidence fusion.

    log P(lang | all) = text + log P(declared | lang) + log P(suffix | lang) + log P(lang | host) + c

Text likelihoods come from byte trigrams, counted over all rows whose language is given.  The other
three are learned from grouped counts of the language that the text alone suggests: how often each
declared markup language and address suffix goes with a language, and how often a host has it, with
a host's counts smoothed by those of its domain and these by the whole table.  A row's own count is
taken out of its priors.  Neighbouring trigrams depend on each other, so a text counts as
`EVIDENCE` trigrams at most.

Languages are primary subtags in lower case, so `EN`, `en-US` and `en` are one; there may be any number,
and tags that are none count as not given.  `held_out_accuracy` measures the text model and the fusion on
rows that it wasn't fitted on.

Only narrow rows (ids, likelihoods, keys) are shuffled.  Grouped counts are combined map-side; key
tables are broadcast after their rows were counted, and joined by shuffle beyond that.

Defined results: a null or empty text, and one without letters, gives no text evidence and is
rejected; a null or malformed declaration, suffix or host is a value of its own; ties go to the first
language by name; repeated rows are judged alike; with no language given anywhere every row is
rejected with a null language; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import joined_small, stored, text_key, without

GRAMS = 1 << 15
EVIDENCE = 60
SMOOTHING = 0.5
STRENGTH = 10.0  # rows that a broader prior counts as
LEAST = 0.5  # posterior below which a language is rejected
KEY_ROWS = 50_000
TOGETHER = 64  # languages whose counts reach the driver at once
SPACED = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))


def grams(text: bytes | None) -> np.ndarray:
    """Hashed trigrams of the letters of a text, words parted by one space."""
    if not text:
        return np.zeros(0, np.int64)
    words = text.translate(SPACED).split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    return (b[:-2] * 7919 + b[1:-1] * 104_729 + b[2:] * 1_299_709) % GRAMS


def subtag(tag: Column) -> Column:
    """The primary subtag of a language tag, empty for what is no tag."""
    return F.regexp_extract(F.lower(F.coalesce(tag, F.lit(""))), "^([a-z]{2,3})(?:[-_].*)?$", 1)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # GRAMS x languages, log likelihoods


def fit(rows: DataFrame) -> Model:
    """Trigram likelihoods from all `rows` (text, lang) that have a language.

    The model has `GRAMS` numbers a language, and primary subtags have two or three letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), (x.as_py() for x in texts), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(GRAMS, np.int64)
                counts[lang] += np.bincount(grams(text), minlength=GRAMS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    known = rows.select(subtag(F.col("lang")).alias("lang"), "text").filter("lang <> ''")
    counted = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "trigrams")
    # a language may have no text
    languages = tuple(sorted(r[0] for r in known.select("lang").distinct().collect()))
    table = np.full((GRAMS, len(languages)), SMOOTHING)
    for k in range(0, len(languages), TOGETHER):
        some = languages[k : k + TOGETHER]
        found = counted.filter(F.col("lang").isin(*some)).toArrow()  # at most `GRAMS` rows for each language
        place = {lang: k + j for j, lang in enumerate(some)}
        table[found["gram"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] += found["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)) if languages else table)


def text_likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` without text, with `trigrams` and `likelihoods`, an entry per language."""
    keys = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, logs = [], []
            for text in batch.column("text").cast(pa.binary()):
                g = grams(text.as_py())
                n.append(len(g))
                mean = model.weights[g].mean(axis=0) if len(g) else np.zeros(len(model.languages))
                logs.append((mean - mean.max()) * min(len(g), EVIDENCE))
            made = [pa.array(n, pa.int64()), pa.array([x.tolist() for x in logs], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *made], names=[*keys, "trigrams", "likelihoods"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)
    return rows.select(*keys, "text").mapInArrow(run, f"{kinds}, trigrams long, likelihoods array<double>")


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """id, lang, posterior, text_lang, trigrams and rejected for each of `rows` (id, text, declared,
    suffix, host, domain)."""
    size = len(model.languages)
    if not size:
        return rows.select(
            "id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"),
            F.lit(0).cast("long").alias("trigrams"), F.lit(True).alias("rejected"),
        )
    clean = rows.select(
        "id", "text", subtag(F.col("declared")).alias("declared"), *[F.coalesce(F.lower(c), F.lit("")).alias(c) for c in ("suffix", "host", "domain")]
    )
    scored = stored(text_likelihoods(clean, model), "likelihoods")
    best = F.array_position("likelihoods", F.array_max("likelihoods")) - 1
    scored = scored.withColumn("own", F.when(F.col("trigrams") > 0, best.cast("int")))

    def table(keys: list[str], name: str) -> DataFrame:
        """How many rows of a key have a text of each language: a map of at most one entry a language."""
        each = scored.groupBy(*keys, "own").agg(F.count(F.lit(1)).cast("double").alias("n"))
        entry = F.when(F.col("own").isNotNull(), F.struct("own", "n"))
        return each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))

    # all counts of the table follow from those of its declarations
    declared, suffix = stored(table(["declared"], "by_declared"), "declared"), stored(table(["suffix"], "by_suffix"), "suffix")
    sums = declared.select(F.explode("by_declared").alias("own", "n")).groupBy("own").agg(F.sum("n").alias("n"))
    by_language = {r["own"]: r["n"] for r in sums.collect()}  # a row a language
    every, whole = F.array(*[F.lit(by_language.get(k, 0.0)) for k in range(size)]), sum(by_language.values())
    n_declared, n_suffix = declared.count(), suffix.count()

    held = joined_small(scored, declared, ["declared"], "inner", KEY_ROWS)
    held = joined_small(held, suffix, ["suffix"], "inner", KEY_ROWS)
    held = joined_small(held, table(["domain"], "by_domain"), ["domain"], "inner", KEY_ROWS)
    held = joined_small(held, table(["host", "domain"], "by_host"), ["host", "domain"], "inner", KEY_ROWS)
    mine = F.col("own").isNotNull().cast("double")
    for name in ("by_domain", "by_host"):
        held = held.withColumn(f"all_{name}", F.aggregate(F.map_values(name), F.lit(0.0), lambda a, x: a + x) - mine)

    def fused_log(k: Column) -> Column:
        """The evidence for language k; the row itself is left out of all counts."""
        here = F.coalesce((F.col("own") == k).cast("double"), F.lit(0.0))
        rest = lambda name: F.coalesce(F.element_at(F.col(name), k), F.lit(0.0)) - here
        total = F.get(every, k) - here
        root = (total + 1.0) / (F.lit(float(whole)) - mine + float(size))
        domain = (rest("by_domain") + STRENGTH * root) / (F.col("all_by_domain") + STRENGTH)
        host = (rest("by_host") + STRENGTH * domain) / (F.col("all_by_host") + STRENGTH)
        by_declared, by_suffix = (rest("by_declared") + 1.0) / (total + float(n_declared)), (rest("by_suffix") + 1.0) / (total + float(n_suffix))
        return F.get("likelihoods", k) + F.log(by_declared) + F.log(by_suffix) + F.log(host)

    fused = held.withColumn("logs", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), fused_log)).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in model.languages])
    return fused.select(
        "id",
        F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int")).alias("lang"),
        (1.0 / mass).alias("posterior"),
        F.get(names, F.col("own")).alias("text_lang"),
        "trigrams",
        ((F.col("trigrams") == 0) | (1.0 / mass < LEAST)).alias("rejected"),
    )


def held_out_accuracy(docs: DataFrame, every: int = 10) -> DataFrame:
    """On the rows of `docs` (doc_id, text, lang, source) whose crc32(doc_id) is divisible by `every`, with the
    model fitted on the others: n (rows with a language and letters), and the shares of them whose language is found by the text
    alone, by all evidence but the declaration, and by all evidence."""
    out = F.crc32(F.col("doc_id").cast("string")) % every == 0
    model = fit(docs.filter(~out))
    rows, given = document_rows(docs), docs.select(F.col("doc_id").cast("long").alias("id"), subtag(F.col("lang")).alias("given"))
    given = given.filter((F.crc32(F.col("id").cast("string")) % every == 0) & (F.col("given") != ""))
    blank = rows.withColumn("declared", F.when(F.crc32(F.col("id").cast("string")) % every != 0, F.col("declared")))
    right = lambda c: F.avg(F.coalesce((F.col(c) == F.col("given")).cast("double"), F.lit(0.0)))
    without_it = identify(blank, model).select("id", "text_lang", F.col("lang").alias("undeclared"), "trigrams").join(given, "id").filter("trigrams > 0")
    first = without_it.agg(F.count(F.lit(1)).alias("n"), right("text_lang").alias("by_text"), right("undeclared").alias("without_declaration"))
    second = identify(rows, model).select("id", "lang", "trigrams").join(given, "id").filter("trigrams > 0").agg(right("lang").alias("with_declaration"))
    return first.join(second)  # a row each


def page_rows(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) as rows for `identify`: visible text, markup language, address."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source) as rows for `identify`: a source stands for a host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain")
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (documents' columns) whose language isn't rejected."""
    # the evidence of a row, which may share its id with others
    evidence = F.struct(text_key(F.col("text")).alias("text"), "declared", "host")
    found = identify(document_rows(docs).withColumn("id", evidence), fit(docs))
    return without(docs, found.filter("rejected").select("id.*"), [text_key(F.col("text")), F.col("lang"), F.col("source")])

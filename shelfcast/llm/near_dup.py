"""N-gram Jaccard join by prefixes of token combinations.

The tokens of a document are its distinct word shingles.  Tokens are ordered by document
frequency, rarest first, and only a prefix of each document is indexed: long enough that two
documents above the threshold must meet in it.  Tokens of few documents are indexed alone.  Frequent
ones are split into classes, a document's prefix is extended by one token for every class it uses,
and pairs of tokens of one class are indexed: with p_c tokens of class c in the prefix, a partner
can miss all keys only by missing p_c - 1 tokens of each class.  The shorter document of a pair
needs a shorter prefix than the longer one, so passages that many documents share rarely get in.
Lengths are cut into bands of 1.08; a document is indexed in its own band as the shorter one, and as
the longer one in every band of a possible partner, each with the prefix that partners of that length
call for.  The number of classes grows with the band, which keeps combinations in proportion to
prefixes.

Documents of equal token sets are one node.  Keys of few nodes compare all of them; for a larger key
every node is compared with a few hubs first (the node with the smallest share of tokens of its own,
which a group of edited copies has at its centre, and some others), and then only with nodes that are
not yet connected with it, so copies never make all pairs and no link between components is lost.  Candidates are
verified by the exact size of their intersection.

Tokens are 64-bit hashes; sets are equal when their sizes and two 64-bit sums agree.

Defined results: null and empty texts have no tokens and link with nothing; texts of fewer words
than a shingle are one token; repeated rows are linked; rows that share an id but not a text are
different nodes; a null id sorts lowest; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.chunks import SENT, Chunk, chained, chunked, exchange, planes, ranges_for, rows_of, scrambled, sent, unplanes
from shelfcast.llm.common import once, release, stored, text_key, without
from shelfcast.llm.components import components

SHINGLE, PERCENT = 5, 80
FREQUENT = 64  # nodes; tokens of more are indexed in combinations
PER_CLASS = 8  # prefix tokens that a class of frequent tokens gets about
SMALL_KEY, HUBS = 8, 3
CHUNK_TOKENS, RANGE_KEYS = 300_000, 600_000  # what a task holds at once
KEY_BITS = 48  # of the hashes that frequencies are counted by
SALTS = 32
NO_ID = -(2**63)

# lower ends of the length bands
BANDS = [4]
while BANDS[-1] < 2**40:
    BANDS.append(BANDS[-1] * 27 // 25 + 1)


def tokens_of(chunk: Chunk, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    words = chunk.hashes[chunk.codes]
    n = len(words) - size + 1
    grams = chained(*[words[j : j + n] for j in range(size)]) if n > 0 else np.zeros(0, np.uint64)
    for start, length in zip(chunk.starts, chunk.lens, strict=False):
        if length >= size:
            yield np.unique(grams[start : start + length - size + 1])
        elif length:
            whole = chained(*[words[start + j : start + j + 1] for j in range(length)])
            yield scrambled(whole + np.uint64(length))
        else:
            yield np.zeros(0, np.uint64)


def set_sums(tokens: np.ndarray) -> tuple[int, int]:
    a, b = scrambled(tokens), scrambled(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def sets(chunks: DataFrame) -> DataFrame:
    """chunk, at (place in it), doc_id, digest (if kept), n (tokens), node and check (sums over the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk(row)
                found = [(len(t), *set_sums(t)) for t in tokens_of(chunk)]
                n, node, check = zip(*found, strict=True) if found else ((), (), ())
                k = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(chunk.ids, pa.int64()), pa.array(chunk.digests or [None] * k, pa.string())]
                    + [pa.array(x, pa.int64()) for x in (n, node, check)],
                    names=["chunk", "at", "doc_id", "digest", "n", "node", "check"],
                )

    return chunks.mapInArrow(run, "chunk long, at int, doc_id long, digest string, n long, node long, check long")


def distinct_keys(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct key hashes of documents, and in how many of them each is."""
    every = np.concatenate([np.zeros(0, np.uint64), *tokens]) >> np.uint64(64 - KEY_BITS)
    return np.unique(every, return_counts=True)


def frequency_code(n: np.ndarray) -> np.ndarray:
    """Frequencies on a logarithmic scale of one byte; 0 is a single document."""
    return np.minimum(255, np.floor(8 * np.log2(n))).astype(np.uint8)


FREQUENT_CODE = int(frequency_code(np.array([FREQUENT]))[0])


def frequencies(chunks: DataFrame, total: int) -> DataFrame:
    """Answers to each chunk: the frequency codes of its distinct tokens, over all documents.

    Copies count as often as they occur; any frequency that is the same for all holders of a token
    gives a valid order.
    """
    ranges = ranges_for(total, RANGE_KEYS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                keys, n = distinct_keys(list(tokens_of(Chunk(row))))
                yield pa.RecordBatch.from_pydict(sent(row["chunk"], keys, lambda s, n=n: planes(n[s]), ranges, KEY_BITS))

    def answer(keys: list, vals: list, distinct: np.ndarray, index: np.ndarray) -> tuple[list, dict]:
        counts = np.bincount(index, np.concatenate([unplanes(v) for v in vals]).astype(np.float64), len(distinct))
        codes = frequency_code(counts)[index]
        return [planes(c) for c in np.split(codes, np.cumsum([len(k) for k in keys])[:-1])], {}

    return exchange(chunks.mapInArrow(send, SENT), answer)


INDEXED = "node long, n long, held long, tokens array<long>, keys array<long>, roles array<tinyint>"


def indexed(chunks: DataFrame, nodes: DataFrame, total: int, percent: int) -> DataFrame:
    """Per node that others may match: tokens that others hold too, and its keys with their roles
    (1: it may be the shorter one of a pair, 2: the longer one, 3: both)."""
    own = nodes.groupBy("chunk").agg(F.collect_list(F.struct("at", "node")).alias("own"))  # bounded by a chunk
    own = own.select("chunk", F.lit(-1).alias("r"), F.lit(None).cast("binary").alias("got"), "own")
    answers = frequencies(chunks, total)
    side = answers.select("chunk", "r", "got", F.lit(None).cast(own.schema["own"].dataType).alias("own")).unionByName(own)

    def receive(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {c.split()[0]: [] for c in INDEXED.split(", ")}
        given = sorted(rows_of(right), key=lambda x: x["r"])
        mine = {x["at"]: x["node"] for row in given if row["own"] for x in row["own"]}
        for row in rows_of(left) if mine else ():
            every = list(tokens_of(Chunk(row)))
            keys, _ = distinct_keys(every)
            codes = np.concatenate([np.zeros(0, np.uint64), *[unplanes(x["got"]) for x in given if x["got"] is not None]]).astype(np.uint8)
            for k, node in mine.items():
                tokens, n = every[k], len(every[k])
                if n < BANDS[0]:
                    continue
                code = codes[np.searchsorted(keys, tokens >> np.uint64(64 - KEY_BITS))]
                tokens, code = tokens[code > 0], code[code > 0]
                order = np.lexsort((tokens, code))
                low, up = document_keys(tokens[order], code[order], n, percent)
                both = np.union1d(low, up)
                if len(both):
                    values = node, n, len(tokens), tokens.view(np.int64), both.view(np.int64), (np.isin(both, low) + 2 * np.isin(both, up)).astype(np.int8)
                    for name, value in zip(cols, values, strict=True):
                        cols[name].append(value)
        kinds = {"node": pa.int64(), "n": pa.int64(), "held": pa.int64(), "tokens": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "roles": pa.list_(pa.int8())}
        return pa.table({name: pa.array(cols[name], kind) for name, kind in kinds.items()})

    return chunks.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(receive, INDEXED)


# ------------------------------------------------------------------ keys


def longer_prefix(n: int, percent: int, shortest: int = 0) -> int:
    """Tokens in which a document must meet a partner of `shortest` .. n tokens."""
    shortest = max(shortest, -(-percent * n // 100))
    return n - -(-percent * (n + shortest) // (100 + percent)) + 1


def shorter_prefix(n: int, percent: int) -> int:
    """Tokens in which a document must meet a longer partner."""
    return longer_prefix(n, percent, n)


def band_of(n: int) -> int:
    return bisect_right(BANDS, n) - 1


def prefix_keys(tokens: np.ndarray, codes: np.ndarray, n: int, length: int, band: int) -> np.ndarray:
    """Keys of a prefix of `length` of a document: `tokens` in order, after n - len(tokens) that
    no other document has."""
    need = length - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)
    rare = int(np.searchsorted(codes, FREQUENT_CODE, "right"))
    salt = np.uint64(band + 1)
    single = scrambled(tokens[: min(rare, need)] * np.uint64(2 * band + 3))
    if need <= rare:
        return single
    classes = max(1, BANDS[band] // 5 // PER_CLASS)
    frequent = tokens[rare:]
    group = frequent % np.uint64(classes)
    _, firsts = np.unique(group, return_index=True)
    again = np.ones(len(frequent), np.int64)
    again[firsts] = 0
    stop = int(np.searchsorted(np.cumsum(again), need - rare)) + 1
    frequent, group = frequent[:stop], group[:stop]
    out = [single]
    order = np.argsort(group, kind="stable")
    for part in np.split(frequent[order], np.flatnonzero(np.diff(group[order])) + 1):
        i, j = np.triu_indices(len(part), 1)
        mixed = scrambled(part)
        out.append(scrambled((mixed[i] + mixed[j]) ^ (salt << np.uint64(40))))
    return np.unique(np.concatenate(out))


def document_keys(tokens: np.ndarray, codes: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a document as the shorter one of a pair, and as the longer one."""
    low = prefix_keys(tokens, codes, n, shorter_prefix(n, percent), band_of(n))
    bands = range(max(0, band_of(-(-percent * n // 100))), band_of(n) + 1)
    up = [prefix_keys(tokens, codes, n, longer_prefix(n, percent, BANDS[b]), b) for b in bands]
    return low, np.concatenate(up)


def signatures(held: DataFrame) -> DataFrame:
    """key, node, n, held, lower and upper for each key of `indexed` rows."""
    zipped = F.explode(F.arrays_zip("keys", "roles")).alias("_k")
    role = F.col("_k.roles")
    return held.select(zipped, "node", "n", "held").select(
        F.col("_k.keys").alias("key"), "node", "n", "held", (role.bitwiseAND(1) > 0).alias("lower"), (role.bitwiseAND(2) > 0).alias("upper")
    )


# ------------------------------------------------------------------ candidates


def fits(a: str, b: str, percent: int):
    """Whether `a` may be the shorter and `b` the longer one of a pair."""
    rank = F.struct(F.col(f"{a}.n"), F.col(f"{a}.node")) < F.struct(F.col(f"{b}.n"), F.col(f"{b}.node"))
    most = F.least(f"{a}.held", f"{b}.held")
    enough = most * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent
    return F.col(f"{a}.lower") & F.col(f"{b}.upper") & rank & enough & (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent)


def pair(a: str, b: str):
    return [F.col(f"{a}.node").alias("a"), F.col(f"{b}.node").alias("b")]


def small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of keys of at most `SMALL_KEY` nodes."""
    few = members.filter(F.col("size") <= SMALL_KEY)
    return few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & fits("x", "y", percent)).select(*pair("x", "y"))


def hub_pairs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of larger keys with the hubs of their key."""
    hub = hubs.select("key", F.explode(F.array(*[F.col(f"hub{j}") for j in range(HUBS)])).alias("h")).select("key", "h.n", "h.node", "h.held", "h.lower", "h.upper").distinct()
    met = members.filter(F.col("size") > SMALL_KEY).alias("x").join(hub.alias("y"), F.col("x.key") == F.col("y.key"))
    down = met.filter(fits("x", "y", percent)).select(*pair("x", "y"))
    up = met.filter(fits("y", "x", percent)).select(*pair("y", "x"))
    return down.unionByName(up)


def crossing_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of larger keys whose nodes are not connected yet."""
    big = members.filter(F.col("size") > SMALL_KEY).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = big.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).filter("_l != _h").select("key")
    big = big.join(several, "key", "left_semi")
    apart = F.col("x.label") != F.col("y.label")
    return big.alias("x").join(big.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & fits("x", "y", percent)).select(*pair("x", "y"))


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose intersection is large enough."""
    side = held.select("node", "n", "tokens")
    one = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a")), "a")
    two = one.join(side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b")
    same = F.size(F.array_intersect("t_a", "t_b"))
    return two.filter(same * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def linked_sets(docs: DataFrame, percent: int = PERCENT, digest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of `sets` for `docs` (doc_id, text), and (node, label) for nodes that have links."""
    if not 80 <= percent < 100:
        raise ValueError("percent must lie between 80 and 99")
    chunks = stored(chunked(docs, tokens=CHUNK_TOKENS, digest=digest), "chunks")
    found = stored(sets(chunks), "sets")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "chunk", "at")).alias("first")
    nodes = found.filter("n > 0").groupBy("n", "node", "check").agg(first).select("node", "first.chunk", "first.at")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = stored(indexed(chunks, nodes, total, percent), "indexed")
    release(chunks)
    keys = signatures(held)
    # most keys are held by one node; what follows sees only the others
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(keys.join(sizes, "key"), "members")
    lone = F.lit(1.0) - F.col("held") / F.col("n")
    hub = lambda j: F.min_by(F.struct("n", "node", "held", "lower", "upper"), F.struct(lone if j == 0 else F.lit(0.0), F.xxhash64(F.lit(j), "node"))).alias(f"hub{j}")
    hubs = members.filter(F.col("size") > SMALL_KEY).groupBy("key").agg(*[hub(j) for j in range(HUBS)])
    pairs = small_pairs(members, percent).unionByName(hub_pairs(members, hubs, percent)).distinct()
    edges = stored(verified(pairs, held, percent), "edges")
    labels = components(edges)
    more = stored(crossing_pairs(members, labels, percent).distinct(), "crossing")
    release(members)
    if not more.isEmpty():
        extra = stored(verified(more, held, percent), "edges")
        if not extra.isEmpty():
            # what is connected already enters as stars
            labels = components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(extra))
    release(held)
    return found, labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, digest: Column | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id it reaches) for each row of `docs`,
    and, if a `digest` is given, this and `class`, the same for all of a component and null for rows that are alone."""
    found, labels = linked_sets(docs, percent, digest)
    rows = found.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    classes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size"))
    classes = classes.join(labels, "node", "left")
    lowest = classes.filter("label is not null").groupBy("label").agg(F.min("low").alias("least"))
    # only sets of several rows or with links are joined; large groups of copies are spread by salt
    named = classes.filter("size > 1 or label is not null").join(lowest, "label", "left")
    named = named.select("node", F.coalesce("least", "low").alias("component"), F.coalesce("label", "node").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("chunk", "at"), F.lit(SALTS)).cast("int"))
    out = salted.join(named, ["node", "salt"], "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    back = F.when(F.col("component") != NO_ID, F.col("component"))
    more = [] if digest is None else ["digest", F.when(F.col("class").isNotNull() & (F.col("n") > 0), F.col("class")).alias("class")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), back.alias("component_id"), *more)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay, one of each component: that with the smallest id (null ids come last), and
    of several with this id that with the smallest digest of its text, then the smallest hash of all its columns.
    Rows without words stay."""
    keys = [F.col("doc_id").cast("long"), text_key(F.col("text"))]
    found = stored(near_duplicates(docs, percent, keys[1]).filter("class IS NOT NULL").select("doc_id", "digest", "class"), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    kept = found.groupBy("class").agg(F.min(first).alias("kept"), F.count(F.lit(1)).alias("n"))
    one = kept.select("kept.doc_id", "kept.digest")
    # copies that share an id and a text share their fate here; all but one of them go below
    of_all = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    gone = of_all.join(one.withColumns({"_d": F.col("doc_id"), "_t": F.col("digest")}).select("_d", "_t"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_t")), "left_anti")
    again = of_all.filter("n > 1").select("doc_id", "digest")
    return once(without(docs, gone.select("doc_id", "digest"), keys), again, keys)

"""SimHash near duplicates by fuzzy hashing with the binary Golay code.

A fingerprint is cut into three segments of 22, 21 and 21 bits.  Two fingerprints that differ in at
most four bits differ, once the segment with most differences is left out, in at most two bits of the
other two segments together.

A segment, padded to 23 bits, is decoded by the perfect Golay code [23, 12, 7] to the indices of all
codewords at a distance of at most four: one if the nearest codeword is at a distance of at most two,
six if it is at three (the nearest one and the five on blocks of the Steiner system S(4, 7, 23) that
hold the three error places).  Two segments that differ in at most two bits share one of these
indices; if they differ in at most one, the nearest codeword of each is among the indices of the other.

A fingerprint's keys are, for each two segments, all pairs of their indices.  By the above, linked
fingerprints share a key whose parts are, both sides together, at least twice a nearest codeword;
only such pairs are verified.

Documents of one fingerprint are one node.  Keys of many fingerprints (`CROWD`) compare them with a few
hubs first and then, in salted blocks, only with fingerprints that are not connected yet, so a group of
edited copies makes no pairs of all with all and no link between components is lost.

Defined results: a null or empty text has fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle; repeated rows and rows that share an id are linked by their
fingerprints; a null id never names a component that holds another id; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import joined_apart, stored
from shelfcast.llm.components import components

WORDS, SEED = 4, 42
MOST_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
CROWD = 256
# shingles hashed, and fingerprints given keys, at a time
BLOCK, FEW = 1 << 16, 1 << 13


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in its order, in arrays of at most `BLOCK`."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(words, len(parts))
    of = xxhash.xxh64_intdigest
    first, last = starts[: len(parts) - n + 1], ends[n - 1 :]
    for k in range(0, len(first), BLOCK):
        here = zip(first[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist(), strict=True)
        yield np.array([of(whole[a:b], seed) for a, b in here], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, lowest first, is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words, seed):
        n, ones = n + len(hashes), ones + bit_counts(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp, a fingerprint's 64 bits as a signed long, for each row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            made = np.fromiter((fingerprint(texts[k].as_py(), words, seed) for k in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ the Golay code


class Golay:
    """The perfect binary code [23, 12, 7]: codewords are multiples of x^11+x^9+x^7+x^6+x^5+x+1, a
    codeword's index is its upper 12 bits."""

    GENERATOR = 0b101011100011

    def __init__(self):
        words = np.arange(1 << 11, dtype=np.uint32)
        # remainders of the low 11 bits are themselves; the others follow bit by bit
        rest = [1 << k for k in range(11)]
        for k in range(11, 23):
            r = rest[k - 1] << 1
            rest.append(r ^ self.GENERATOR if r >> 11 else r)
        self.rest = np.array(rest, np.uint32)
        self.low = words
        self.high = np.zeros(1 << 12, np.uint32)
        for k in range(12):
            self.high[1 << k : 2 << k] = self.high[: 1 << k] ^ self.rest[11 + k]
        # every remainder belongs to exactly one error of at most three bits
        self.error = np.zeros(1 << 11, np.uint32)
        for size in range(1, 4):
            for places in combinations(range(23), size):
                self.error[np.bitwise_xor.reduce(self.rest[list(places)])] = sum(1 << p for p in places)
        codewords = (np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)) ^ self.high
        blocks: dict[int, list[int]] = {}
        for block in codewords[np.bitwise_count(codewords) == 7].tolist():
            for places in combinations([p for p in range(23) if block >> p & 1], 3):
                blocks.setdefault(sum(1 << p for p in places), []).append(block)
        # by remainder: index parts of the five blocks that hold its three error places, else none
        self.others = np.zeros((1 << 11, 5), np.uint32)
        self.is_far = np.bitwise_count(self.error) == 3
        for r in np.flatnonzero(self.is_far).tolist():
            self.others[r] = sorted(b >> 11 for b in blocks[int(self.error[r])])

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per 23-bit word six codeword indices, the nearest one first, and how many of them hold (1 or 6)."""
        rest = self.high[words >> np.uint32(11)] ^ (words & np.uint32((1 << 11) - 1))
        nearest = (words ^ self.error[rest]) >> np.uint32(11)
        return np.concatenate([nearest[:, None], nearest[:, None] ^ self.others[rest]], axis=1), np.where(self.is_far[rest], 6, 1)


def keys_of(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints: place of the fingerprint, key, and how many of the key's two
    parts are the nearest codeword."""
    found = []
    for start, bits in SEGMENTS:
        found.append(code.indices(((fps >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.uint32)))
    at, keys, near = [], [], []
    column = np.arange(6)
    for p, (a, b) in enumerate(PAIRS):
        (ia, na), (ib, nb) = found[a], found[b]
        holds = (column < na[:, None])[:, :, None] & (column < nb[:, None])[:, None, :]
        key = (np.int64(p) << 24) | (ia.astype(np.int64)[:, :, None] << 12) | ib.astype(np.int64)[:, None, :]
        row, ca, cb = np.nonzero(holds)
        at.append(row)
        keys.append(key[row, ca, cb])
        near.append((ca == 0).astype(np.int64) + (cb == 0))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(near)


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """key, fp and near for every key of every row of `nodes` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), FEW):
                part = fps[k : k + FEW]
                at, keys, near = keys_of(part.view(np.uint64), code)
                made = [pa.array(keys.astype(np.int32)), pa.array(part[at]), pa.array(near.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(made, ["key", "fp", "near"])

    return nodes.select("fp").mapInArrow(run, "key int, fp long, near tinyint")


# ------------------------------------------------------------------ links


def sized(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """`table`, read from storage, for a join: broadcast if counted as at most `rows`, else neither side is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def close(most_bits: int):
    return F.expr(f"a.near + b.near >= 2 AND bit_count(a.fp ^ b.fp) <= {most_bits}")


def links(nodes: DataFrame, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect what the links of `nodes` (fp, distinct) connect: every link between
    fingerprints of keys of at most `crowd`, and enough of those of larger keys."""
    if most_bits > MOST_BITS:
        raise ValueError(f"keys are shared up to {MOST_BITS} differing bits")
    keys = fuzzy_keys(nodes)
    crowded = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd), "crowded")
    none = crowded.isEmpty()
    sparse = keys if none else keys.join(sized(crowded.select("key")), "key", "left_anti")
    # Spark takes the keys to be as many as `nodes`, of which each has some 85, and would broadcast them
    pairs = sparse.alias("a").join(sparse.alias("b").hint("merge"), "key").filter("a.fp < b.fp").filter(close(most_bits))
    edges = stored(pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct(), "near")
    if none:
        return edges
    dense = stored(keys.join(sized(crowded), "key"), "dense")
    hubs = dense.groupBy("key").agg(F.min("fp").alias("h0"), F.min_by("fp", F.xxhash64("fp")).alias("h1"), F.max_by("fp", F.xxhash64("fp")).alias("h2"))
    hubs = stored(hubs.select("key", F.explode(F.array_distinct(F.array("h0", "h1", "h2"))).alias("hub")), "hubs")
    near_hub = dense.join(sized(hubs), "key").filter(f"fp <> hub AND bit_count(fp ^ hub) <= {most_bits}")
    edges = stored(edges.unionByName(near_hub.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()), "near")
    label = components(edges).withColumnRenamed("node", "fp")
    known = stored(dense.join(sized(label), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    # in a key, what isn't of its largest component is compared with all, block by block
    shares = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = shares.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count(F.lit(1)).alias("k"))
    open_keys = stored(largest.filter("k > 1").select("key", "largest"), "open")
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    left = known.join(sized(open_keys), "key")
    all_of = left.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    few = left.filter("label <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    across = few.alias("a").join(all_of.alias("b"), ["key", "block"]).filter("a.label <> b.label").filter(close(most_bits))
    found = across.select(F.least("a.label", "b.label").alias("a"), F.greatest("a.label", "b.label").alias("b")).distinct()
    return edges.unionByName(stored(found, "across"))


def near_fingerprints(docs: DataFrame, most_bits: int = MOST_BITS, words: int = WORDS, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, for
    every row of `docs` (doc_id, text)."""
    rows = stored(fingerprints(docs, words, seed), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    label = components(links(nodes, most_bits, crowd)).withColumnRenamed("node", "fp")
    labelled = stored(nodes.join(sized(label), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    least = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    of_fp = stored(labelled.join(sized(least), "label").select("fp", "n", "component_id"), "of-fp")
    return joined_apart(rows, sized(of_fp), ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

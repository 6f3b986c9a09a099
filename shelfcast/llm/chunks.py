"""Documents as packed chunks of word codes, and sums over keys between chunks.

A chunk row holds the words of some thousand documents as codes into the chunk's own list of
64-bit word hashes.  Chunks are written once to the shared folder, so every later pass sees the
same ones.  `exchange` adds up values of equal keys over all chunks: each chunk sends its distinct
keys, sorted, packed and cut into key ranges; a task per range adds them up and answers each chunk
for the keys it sent.  A key that every chunk holds sends one value per chunk, never one per
document, and the number of ranges follows the number of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

CHUNK_TOKENS = 500_000
RANGE_KEYS = 1_000_000
FEWEST_RANGES = 32
MASK = (1 << 64) - 1


# ------------------------------------------------------------------ packing


SQUEEZER, UNSQUEEZER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # a context costs more than a small piece


def squeezed(data: bytes) -> bytes:
    return SQUEEZER.compress(data)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(UNSQUEEZER.decompress(data), np.uint8)


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the leading ones that are all zero, compressed."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + squeezed(np.ascontiguousarray(raw.T).tobytes())


def unplanes(data: bytes) -> np.ndarray:
    width, raw = data[0], unsqueezed(memoryview(data)[1:])
    if width == 1:
        return raw.astype("<u8")
    out = np.zeros((raw.size // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def ascending(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as steps."""
    return planes(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def unascending(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def floats(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.astype("<f8")).view(np.uint8).reshape(-1, 8)
    return squeezed(np.ascontiguousarray(raw.T).tobytes())


def unfloats(data: bytes) -> np.ndarray:
    raw = unsqueezed(data)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<f8")


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_places(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of unsigned keys.  A plain sort is several times faster than an argsort, so keys are sorted with
    their places in the low bits; where bits of the keys had to go for that and keys came out of order, argsort it is."""
    if not len(keys):
        return np.zeros(0, np.int64)
    least, low = keys.min(), max(1, (len(keys) - 1).bit_length())
    gone = max(0, int(keys.max() - least).bit_length() + low - 64)
    mixed = ((keys - least) >> np.uint64(gone)) << np.uint64(low)
    mixed |= np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << low) - 1)).astype(np.int64)
    if gone:
        ordered = keys[order]
        if (ordered[1:] < ordered[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def starts_of_equal(ordered: np.ndarray) -> np.ndarray:
    """Which sorted values differ from the one before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def distinct_of(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    ordered = np.sort(keys)
    return ordered[starts_of_equal(ordered)]


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct unsigned keys, the first place of each, and for each key its place in them."""
    order = sorted_places(keys)
    ordered = keys[order]
    new = starts_of_equal(ordered)
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(new) - 1
    return ordered[new], order[new], index


def chained(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, element by element."""
    h = first.copy()
    for m in more:
        h = scrambled(h * np.uint64(0x9E3779B97F4A7C15) + m)
    return h


# ------------------------------------------------------------------ chunks

CHUNK = "chunk long, n_tokens long, ids array<long>, flags binary, lens binary, codes binary, hashes binary, digests array<string>"


word_hash = xxhash.xxh3_64_intdigest


def chunked(docs: DataFrame, flag: Column | None = None, tokens: int = CHUNK_TOKENS, digest: Column | None = None) -> DataFrame:
    """Chunk rows of `docs` (doc_id, text) with a `flag` for each document: A-Z in lower case,
    words between ASCII white space; a null text has no words, a null flag is false.  A `digest` of
    each text is kept if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        flags = bytearray()
        digests: list[str] = []
        lens: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def done() -> pa.RecordBatch:
            # codes go by the word's first place, so frequent words have small ones
            distinct, first, index = distinct_places(np.concatenate(parts))
            order = sorted_places(first.astype(np.uint64))
            code = np.empty(len(order), np.uint32)
            code[order] = np.arange(len(order), dtype=np.uint32)
            hashes, codes = distinct[order], code[index]
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    "n_tokens": pa.array([held], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "flags": pa.array([bytes(flags)], pa.binary()),
                    "lens": [planes(np.asarray(lens, np.uint64))],
                    "codes": [planes(codes)],
                    "hashes": pa.array([hashes.tobytes()], pa.binary()),
                    "digests": pa.array([digests], pa.list_(pa.string())),
                }
            )

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            marks = batch.column("flag").to_pylist()
            named = batch.column("digest").to_pylist() if kept else None
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[k].as_py()
                words = text.lower().split() if text else []
                ids.append(doc)
                flags.append(bool(marks[k]))
                if named:
                    digests.append(named[k])
                lens.append(len(words))
                parts.append(np.fromiter(map(word_hash, words), np.uint64, len(words)))
                held += len(words)
                if held >= tokens or len(ids) >= tokens:
                    yield done()
                    ids, flags, digests, lens, parts, held = [], bytearray(), [], [], [], 0
        if ids:
            yield done()

    flag, kept = F.lit(False) if flag is None else flag, digest is not None
    more = [] if digest is None else [digest.alias("digest")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("flag"), *more).mapInArrow(run, CHUNK)


class Chunk:
    """A chunk row unpacked: word hashes of all documents in a row, and where each one starts."""

    def __init__(self, row: dict):
        self.ids, self.digests = row["ids"], row.get("digests")
        self.flags = np.frombuffer(row["flags"], np.uint8).astype(bool)
        self.lens = unplanes(row["lens"]).astype(np.int64)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.codes = unplanes(row["codes"]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    names = batch.schema.names
    columns = [batch.column(n) for n in names]
    for k in range(batch.num_rows):
        yield {n: c[k].as_py() for n, c in zip(names, columns, strict=True)}


# ------------------------------------------------------------------ sums over keys

SENT = "r int, chunk long, keys binary, vals binary"


def ranges_for(keys: int, each: int = RANGE_KEYS) -> int:
    return max(FEWEST_RANGES, -(-keys // each))


def cut(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range starts in sorted keys of `bits` bits."""
    edges = np.array([-(-(r << bits) // ranges) for r in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def sent(chunk: int, keys: np.ndarray, pack: Callable[[slice], bytes], ranges: int, bits: int) -> dict:
    """Columns of the rows that send sorted `keys` and what `pack` makes of the values of a slice."""
    at = cut(keys, ranges, bits)
    full = [r for r in range(ranges) if at[r] < at[r + 1]]
    return {
        "r": pa.array(full, pa.int32()),
        "chunk": pa.array([chunk] * len(full), pa.int64()),
        "keys": pa.array([ascending(keys[at[r] : at[r + 1]]) for r in full], pa.binary()),
        "vals": pa.array([pack(slice(at[r], at[r + 1])) for r in full], pa.binary()),
    }


def exchange(rows: DataFrame, answer: Callable[[list[np.ndarray], list[bytes], np.ndarray, np.ndarray], tuple[list[bytes], dict]], extra: str = "") -> DataFrame:
    """Answers to rows of `SENT`, a row (r, chunk, got) each.

    `answer(keys, vals, distinct, index)` gets, for one range, the keys and packed values of each
    chunk, the sorted distinct keys and, for all keys in a row, their place in `distinct`; it
    returns the bytes for each chunk and the columns `extra`, which stand in a row with chunk -1.
    """
    names = [c.split()[0] for c in extra.split(", ")] if extra else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        keys = [unascending(k) for k in pdf["keys"]]
        distinct, _, index = distinct_places(np.concatenate(keys))
        got, more = answer(keys, list(pdf["vals"]), distinct, index)
        out = pd.DataFrame({"r": pdf["r"], "chunk": pdf["chunk"], "got": got})
        for n in names:
            out[n] = None
        if names:
            out.loc[len(out) + len(pdf)] = {"r": pdf["r"].iloc[0], "chunk": -1, "got": b""} | more
        return out

    return rows.groupBy("r").applyInPandas(run, "r int, chunk long, got binary" + (", " + extra if extra else ""))

"""WARC archives compressed record by record with a dictionary of their own.

The dictionary is trained on a bounded sample of the records (`SAMPLE_RECORDS` with the smallest
hash, `SAMPLE_BYTES` of each) and stands in a skippable frame at the head of every archive, so a
file can be read alone and any record from its offset.  Each archive is made by one task from the
rows dealt to it and rolled at `ROLL_BYTES`; archives are the binary rows of a table in the shared
folder, so Spark's committer decides which attempt of a task counts, and `export` writes them as
files.  Equal payloads are found by SHA-256 and length in a grouped aggregation.

Defined results: null html is an empty payload; a null url becomes `urn:page:<id>`; line ends in a
url are percent-encoded; a null page id is archived as such, sorts lowest, and is no target of a
revisit unless all copies lack an id, in which case all of them are responses; repeated ids are
records of their own; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

# --- fixed values of the formats: skippable frame that holds a dictionary, zstd frame, profile
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SMALLEST_REVISIT = 1000
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16_384, 65_536
ROLL_BYTES, LEVEL = 8_000_000, 3
DATE = "2020-01-01T00:00:00Z"
ARCHIVES = "archive string, n_records long, data binary"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, record_id string, offset long, payload binary"


def planned(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """`pages` (page_id, url, html) with payload, digest and `refers_to`: the largest id among
    equal payloads, null for the record that keeps the payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html")
    rows = rows.withColumns({"_key": F.when(size >= smallest, F.sha2("html", 256)), "_size": size})
    last = F.max(F.struct("page_id", "url")).alias("_last")
    keep = rows.filter(F.col("_key").isNotNull()).groupBy("_key", "_size").agg(last, F.count(F.lit(1)).alias("_n"))
    keep = keep.filter("_n > 1").select("_key", "_size", F.col("_last.page_id").alias("_keep"), F.col("_last.url").alias("_url"))
    # ids meet their copies without the html, which moves once, by page id
    ids = rows.filter(F.col("_key").isNotNull()).select("page_id", "_key", "_size").join(keep, ["_key", "_size"])
    revisits = ids.filter("page_id < _keep or (page_id is null and _keep is not null)")
    revisits = revisits.groupBy("page_id", "_key").agg(F.max(F.struct("_keep", "_url")).alias("_to"))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("_key").alias("_of"), F.col("_to._keep").alias("refers_to"), F.col("_to._url").alias("refers_url"))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))
    return rows.join(revisits, same, "left").select("page_id", "url", "html", "refers_to", "refers_url")


def trained(pages: DataFrame, records: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from the records with the smallest hashes; empty where they are too few."""
    hashed = pages.filter(F.octet_length("html") > 0).withColumn("_h", F.xxhash64("page_id", "html"))
    # first the hashes alone, in tasks; then the texts up to the last of them
    last = hashed.select("_h").orderBy("_h").limit(records).agg(F.max("_h")).first()[0]
    if last is None:
        return b""
    sample = hashed.filter(F.col("_h") <= last).select("_h", F.left("html", F.lit(SAMPLE_BYTES)).alias("_t")).orderBy("_h", "_t").limit(records)
    texts = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {DATE}\r\n\r\n{r['_t']}".encode() for r in sample.collect()]
    if len(texts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # the samples have too little in common
        return b""


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def target(page_id: int | None, url: str | None) -> tuple[str, str]:
    """A page's address and record id."""
    uri = f"urn:page:{page_id}" if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    return uri, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uri}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    digest = hashlib.sha1(payload)
    uri, own = target(page_id, url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest.digest()).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        to_uri, to_id = target(refers_to, refers_url)
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to_id), ("WARC-Refers-To-Target-URI", to_uri), ("WARC-Refers-To-Date", DATE)]
        fields += [("X-Refers-To-Page-ID", str(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    return header([*fields, ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def archives(pages: DataFrame, dictionary: bytes, roll: int = ROLL_BYTES) -> DataFrame:
    """Archives of `planned` rows: name, number of records, bytes of the file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        info = squeeze.compress(
            header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>"), ("WARC-Date", DATE), ("Content-Length", "0")])
            + b"\r\n\r\n"
        )
        parts, size, n = [head, info], 0, 0

        def done() -> pd.DataFrame:
            data = b"".join(parts)
            return pd.DataFrame({"archive": [f"pages-{hashlib.sha1(data).hexdigest()[:16]}.warc.zst"], "n_records": [n], "data": [data]})

        for batch in batches:
            empty = zip(batch["page_id"].isna(), batch["url"].isna(), batch["refers_to"].isna(), batch["refers_url"].isna(), strict=True)
            for row, (no_id, no_url, first, bare) in zip(batch.itertuples(index=False), empty, strict=True):
                made = squeeze.compress(
                    record(None if no_id else int(row.page_id), None if no_url else row.url, row.html.encode(), None if first else int(row.refers_to), None if bare else row.refers_url)
                )
                parts.append(made)
                size, n = size + len(made), n + 1
                if size >= roll:
                    yield done()
                    parts, size, n = [head, info], 0, 0
        if n:
            yield done()

    return pages.mapInPandas(write, ARCHIVES)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive, one at a time."""
    at, known = 0, None
    if len(data) >= 8:
        magic, length = struct.unpack_from("<II", data)
        if magic == DICTIONARY_MAGIC:
            known, at = zstandard.ZstdCompressionDict(data[8 : 8 + length]), 8 + length
    view = memoryview(data)
    opener = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        one = opener.decompressobj()
        pieces, start = [], at
        while not one.eof:
            step = view[at : at + 65_536]
            pieces.append(one.decompress(step))
            at += len(step) - (len(one.unused_data) if one.eof else 0)
        yield start, b"".join(pieces)


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (`archive`, `data`) but for their warcinfo."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                rows, held = [], 0
                for offset, raw in frames(bytes(data)):
                    top, _, block = raw.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    block = block[: int(fields["Content-Length"])]
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, target = fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} at {offset} is damaged")
                    n = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                    rows.append(
                        (
                            int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None,
                            kind, int(target) if target else None, n, digest, fields["WARC-Target-URI"], fields["WARC-Record-ID"], offset,
                            payload if payloads else None,
                        )
                    )
                    held += len(payload) if payloads else 200
                    if held > 8_000_000:
                        yield shaped(rows)
                        rows, held = [], 0
                if rows:
                    yield shaped(rows)

    def shaped(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
        return made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(parse, RECORDS)


def write_archives(pages: DataFrame, roll: int = ROLL_BYTES) -> DataFrame:
    """Archive `pages` (page_id, url, html); returns the table of archives in the shared folder."""
    return stored(archives(planned(pages), trained(pages), roll), "warc")


def export(files: DataFrame, folder: str) -> None:
    """Write each archive as a file, by the tasks that hold them; `folder` is any URI that
    pyarrow's file systems open, and must be shared by the executors."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch["archive"], batch["data"], strict=True):
                part = f"{base}/{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(bytes(data))
                store.move(part, f"{base}/{name}")
            yield batch[["archive"]]

    files.select("archive", "data").mapInPandas(put, "archive string").count()

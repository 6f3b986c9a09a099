"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where a short local pattern ends, so equal passages are cut alike wherever they
stand.  A chunk is named by a 64-bit hash; distinct chunks are gathered once, with map-side
combining, to prove that a hash stands for one text only.  Hashes that stand for several texts
get a number for each of them.  Equal ordered identifier lists then mean equal texts, and only
these short lists are grouped and joined: a document's text leaves its task once, as chunks.

Defined results: a null text is empty and equals other empty texts; a null id counts in its
group and sorts lowest; repeated ids are rows of their own, of which `drop_exact_duplicates` keeps one
for each text; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import once, stored, text_key, without

# letters and characters of several scripts, about one in seven of running text
EDGE = r"aAhHmMéäаеноاما-ヲ一-七0-1"
SHORTEST, LONGEST = 512, 4096
SALTS = 32


def chunked(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Chunks of a text, which joined are the text.  A cut follows an edge character, another one
    and an edge character, at the first such place past `shortest`, at `longest` at the latest."""
    here = rf"(?<=[{EDGE}][^{EDGE}][{EDGE}])"
    pattern = rf"(?s).{{{shortest},{longest}}}?(?:{here}|\z)|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    """Fewer bits are for tests, in which hashes must collide."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, recipe (array of verified chunk identifiers) and text_sha256 for each row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.select(F.explode(chunked(F.col("text"))).alias("chunk"))
    distinct = chunks.groupBy(chunk_hash(F.col("chunk"), bits).alias("hash"), "chunk").agg(F.count(F.lit(1)).alias("_n"))
    unclear = stored(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("hash"), "unclear")
    digest = F.sha2("text", 256).alias("text_sha256")
    plain = F.transform(chunked(F.col("text")), lambda c: F.struct(chunk_hash(c, bits).alias("hash"), F.lit("").alias("variant")))
    named = docs.select("doc_id", plain.alias("recipe"), digest)
    if unclear.isEmpty():
        return named
    # the digest tells the chunks of one hash apart, in the documents that hold such a hash
    full = F.transform(
        chunked(F.col("text")), lambda c: F.struct(chunk_hash(c, bits).alias("hash"), F.sha2(c, 256).alias("variant"))
    )
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", full.alias("_all"), digest)
    rows = stored(rows, "recipes")
    parts = rows.select("_row", F.posexplode("_all").alias("_pos", "_c")).select("_row", "_pos", "_c.hash", "_c.variant")
    marked = parts.join(unclear.withColumn("_unclear", F.lit(True)), "hash", "left")
    part = F.struct("_pos", F.struct("hash", F.when(F.col("_unclear"), F.col("variant")).otherwise(F.lit("")).alias("variant")).alias("id"))
    lists = marked.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["id"]).alias("recipe"))
    joined = rows.select("_row", "doc_id", "text_sha256").join(lists, "_row", "left")
    return joined.select("doc_id", F.coalesce("recipe", F.array().cast(lists.schema["recipe"].dataType)).alias("recipe"), "text_sha256")


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs` (doc_id, text)."""
    listed = stored(recipes(docs, bits), "recipes")
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # texts that occur once need no partner; groups of copies are spread over salts
    copies = groups.filter("group_size > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = listed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return salted.join(copies, ["recipe", "_salt"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each text: that with the largest id, and of several rows with this
    id that with the smallest hash of all its columns."""
    found = stored(exact_duplicates(docs).select("doc_id", "text_sha256", "kept"), "kept")
    keys = [F.col("doc_id"), text_key(F.col("text"))]
    gone = found.filter(~F.col("kept")).select("doc_id", "text_sha256")
    again = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id", "text_sha256")
    return once(without(docs, gone, keys), again, keys)

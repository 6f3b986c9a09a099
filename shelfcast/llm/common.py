"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.durable import shared_dir

# lower-casing of the contracts touches these letters only
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, keep_shuffles: bool = True) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends at files any executor can read.  The shuffle
    files of the job are deleted when it ends, unless `keep_shuffles`."""
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    was = conf.get(CLEANUP)
    if not keep_shuffles:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete `stored` tables that no plan will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, even where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; text of ASCII only takes the faster built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def joined_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join; `small` is broadcast only after counting that it has at most `rows` rows."""
    if small.count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def joined_apart(big: DataFrame, small: DataFrame, on: list[str], weight: str, heavy: int = 1000, rows: int = 200_000) -> DataFrame:
    """Inner join of `big` with `small`, whose rows are unique by `on` and say in `weight` how many
    partners they have.  Keys of more than `heavy` partners are broadcast, if counted as at most
    `rows`, so their partners stay spread as they are; the rest is shuffled.  Both sides should be stored."""
    hot = small.filter(F.col(weight) > heavy)
    if hot.limit(rows + 1).count() > rows:
        return big.join(small, on)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(weight) <= heavy), on)
    return cold.unionByName(big.join(F.broadcast(hot), on))


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: the digest of the text, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], rows: int = 200_000) -> DataFrame:
    """Rows of `docs` whose `keys` aren't a row of `gone`, which has a column for each of them in
    order; null equals null.  Keys are broadcast only after they were counted."""
    name = "_gone"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    gone = stored(gone.toDF(*[f"{name}{k}" for k in range(len(keys))]).distinct(), "gone")
    if gone.limit(rows + 1).count() <= rows:
        gone = F.broadcast(gone)
    same = [key.eqNullSafe(F.col(f"{name}{k}")) for k, key in enumerate(keys)]
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def once(docs: DataFrame, repeated: DataFrame, keys: list[Column], rows: int = 200_000) -> DataFrame:
    """`docs`, but of the rows whose `keys` are a row of `repeated` (a column for each, null equals null)
    one for each: that with the smallest hash of all columns."""
    names = [f"_again{k}" for k in range(len(keys))]
    repeated = stored(repeated.toDF(*names).distinct(), "again")
    if repeated.isEmpty():
        return docs
    rest = without(docs, repeated, keys, rows)
    small = F.broadcast(repeated) if repeated.limit(rows + 1).count() <= rows else repeated
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns).alias("_whole")
    held = docs.select(whole, F.xxhash64(*columns).alias("_hash"), *[k.alias(f"_key{i}") for i, k in enumerate(keys)])
    same = [F.col(f"_key{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    kept = held.join(small, same, "left_semi").groupBy(*[f"_key{i}" for i in range(len(keys))]).agg(F.min_by("_whole", "_hash").alias("_whole"))
    return rest.unionByName(kept.select("_whole.*"))

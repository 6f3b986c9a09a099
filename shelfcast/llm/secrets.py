"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (`BASE`) are reported wherever they match.  Weak ones (`WEAK`: bare secrets, other
account identifiers, endpoints) match much harmless text, so one is reported only if the parts that
complete it co-occur with it: a secret needs an identifier, an identifier a secret, an endpoint both.
Two parts are linked if at most `SCOPE` characters lie between them.  A part that completes another one
must be linked to it, or to a part that is.

Links come from an interval join of the parts of a document: each part goes to the bins that it covers, and,
to look for others, to the bins that it covers with its scope on both sides.  So a document of many parts
is many small groups, and what is made grows with the parts that lie close together.

Places follow from the lengths of the pieces between matches; all counts are code points.

Defined results: a null text is empty; empty texts and texts without matches give a row without
spans; repeated rows each get a row; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import let, stored

# --- fixed values: patterns of the scan, in the order of their kinds
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 8
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
WEAK = {
    "secret": "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "ident": "(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x20\x09-\x0D\"'<>]*)?",
}
SCOPE = 200
BIN = 1000
KINDS = [*BASE, *WEAK]


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, nth, gap, size, kept): a match, its length and that of the text before it."""
    ordinal = KINDS.index(kind)

    def listed(gaps: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            enough = F.length(F.regexp_extract(hit, pattern, 2)) >= ASSIGN_VALUE if kind == "assign" else F.lit(True)
            return F.struct(
                F.lit(ordinal).alias("kind"), i.alias("nth"), F.length(gaps[i]).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), enough.alias("kept")
            )

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    found = let(F.split(text, pattern, -1), listed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:bigint,size:bigint,kept:boolean>>"))


PART = ["_row", "kind", "nth"]


def of_kind(*names: str) -> Column:
    return F.col("kind").isin([KINDS.index(n) for n in names])


def near(parts: DataFrame, others: DataFrame, scope: int, found: dict[str, Column], bin_size: int = BIN) -> DataFrame:
    """For each of `parts` that has others (_row, start, stop) within `scope`: `found`, each an aggregate over
    the columns of the pair, those of the part under `_a`."""

    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / bin_size), F.floor(last / bin_size))).alias("_bin")

    a = parts.select(F.struct(*parts.columns).alias("_a"), "_row", bins(F.col("start") - scope, F.col("stop") + scope))
    b = others.select("*", bins(F.col("start"), F.col("stop")))
    pairs = a.join(b, ["_row", "_bin"]).filter((F.col("start") <= F.col("_a.stop") + scope) & (F.col("_a.start") <= F.col("stop") + scope))
    # a pair may meet in several bins; what is asked for is whether there is one
    return pairs.groupBy(*[F.col(f"_a.{c}").alias(c) for c in PART]).agg(*[c.alias(n) for n, c in found.items()])


def reported(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak ones of `parts` (_row, kind, nth, start, stop) that are complete and not covered whole by a
    strong one."""
    roles = parts.withColumns({"_id": of_kind("access", "ident"), "_secret": of_kind("assign", "secret"), "_strong": of_kind(*BASE)})
    weak = roles.filter(of_kind(*WEAK))
    some = weak.select("_row").distinct()
    roles = roles.join(some, "_row", "left_semi").select(*PART, "start", "stop", "_id", "_secret", "_strong")
    linked = near(roles, roles, scope, {"_ids": F.bool_or("_id"), "_secrets": F.bool_or("_secret")})
    by_way = roles.join(linked, PART)
    covered = F.bool_or(F.col("_strong") & (F.col("start") <= F.col("_a.start")) & (F.col("stop") >= F.col("_a.stop")))
    around = near(weak.select(*PART, "start", "stop"), by_way, scope, {"_ids": F.bool_or("_ids"), "_secrets": F.bool_or("_secrets"), "_covered": covered})
    return around.filter("_ids AND _secrets AND NOT _covered").select(*PART)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and `spans`, an array of (start, kind, stop) in order, for each row of `docs`
    (doc_id, text); `kind` is a place in `KINDS`."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[matches(F.col("_text"), k, p) for k, p in (BASE | WEAK).items()])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("_text"))
    # rows without matches go along with nulls
    rows = rows.select("_row", "doc_id", F.explode_outer(found).alias("m")).select("_row", "doc_id", "m.*")
    before = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("stop") - F.col("size"))
    placed = stored(placed.select(*PART, "doc_id", "start", "stop", "kept"), "parts")
    complete = reported(placed.filter("kept").select(*PART, "start", "stop"), scope).withColumn("_report", F.lit(True))
    marked = placed.join(complete, PART, "left")
    span = F.when(F.col("kept") & (of_kind(*BASE) | F.col("_report")), F.struct("start", "kind", "stop"))
    grouped = marked.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return grouped.select("doc_id", "spans")


def written(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

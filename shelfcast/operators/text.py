"""Conversation rules as table jobs: history limits, token budget, number grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import (
    CHARS_PER_TOKEN,
    CHAT_ROLES,
    CHAT_TOKEN_BUDGET,
    NUMBER_PATTERN,
)
from shelfcast.functions.expr import check_count
from shelfcast.functions.ranking import top_k

EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def token_estimate(text: Column) -> Column:
    """Careful estimate: one token per 2.5 characters, plus one."""
    return (F.floor(F.char_length(text) / CHARS_PER_TOKEN) + 1).cast("int")


def sanitize_history(
    messages: DataFrame, max_messages: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Usable turns of each conversation: other roles and empty texts go.

    With `max_chars` longer texts are cut, with `max_messages` only the newest stay; that limit is
    pushed below the shuffle, so a huge conversation costs no more than a small one.
    """
    text = stripped(F.col("text"))
    if max_chars is not None:
        text = F.substring(text, 1, check_count(max_chars, "max_chars"))
    kept = (
        messages.filter(F.col("role").isin(CHAT_ROLES))
        .withColumn("text", text)
        .filter(F.char_length("text") > 0)
    )
    if max_messages is None:
        return kept
    limit = check_count(max_messages, "max_messages")
    return top_k(kept, ["conv_id"], [F.desc("turn")], limit, "_newest").drop("_newest")


def trim_to_budget(history: DataFrame, budget: int = CHAT_TOKEN_BUDGET) -> DataFrame:
    """Newest turns whose estimates fit the budget; a single too long newest turn is cut.

    A turn costs a token at least, so no more than `budget` turns of a conversation can fit; the
    rest is left out below the shuffle.
    """
    if budget <= 0:
        return history.withColumn("tokens", token_estimate(F.col("text"))).limit(0)
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    newest = top_k(history, ["conv_id"], [F.desc("turn")], budget, "_newest").drop("_newest")
    numbered = newest.withColumn("_place", F.row_number().over(newest_first))
    too_long = (F.col("_place") == 1) & (token_estimate(F.col("text")) > budget)
    text = F.when(too_long, F.substring("text", 1, int(budget * CHARS_PER_TOKEN))).otherwise(F.col("text"))
    costed = numbered.withColumn("text", text).withColumn("tokens", token_estimate(F.col("text")))
    summed = costed.withColumn("_used", F.sum("tokens").over(so_far))
    fits = (F.col("_place") == 1) | (F.col("_used") <= budget)
    return summed.filter(fits).drop("_place", "_used")


def _number(text: Column) -> Column:
    return F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")


def number_tokens(text: Column) -> Column:
    """Number-like tokens without trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_PATTERN), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))


def readings(token: Column) -> Column:
    """Values a token may stand for: comma or point as thousands separator, sign ignored."""
    comma_thousands = _number(F.replace(token, F.lit(","), F.lit("")))
    point_thousands = _number(F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    values = F.array(comma_thousands, point_thousands)
    both = F.concat(values, F.transform(values, lambda v: F.abs(v)))
    return F.array_distinct(F.array_compact(both))


def evidence_values(text: Column) -> Column:
    """Numbers of the evidence as written, without sign, and rounded to 0, 1 and 2 places."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_PATTERN), F.lit(1))
    read = F.array_compact(F.transform(found, lambda t: _number(F.replace(t, F.lit(","), F.lit("")))))
    signed = F.flatten(F.transform(read, lambda v: F.array(v, F.abs(v))))
    forms = F.transform(signed, lambda v: F.array(v, F.bround(v, 0), F.bround(v, 1), F.bround(v, 2)))
    return F.array_distinct(F.flatten(forms))


def grounding(df: DataFrame, answer: str, evidence: str, least: int = 3) -> DataFrame:
    """Share of an answer's numbers (10 or more in any reading) found in the evidence.

    Answers with fewer than `least` such numbers count as grounded.
    """
    tokens = F.filter(
        number_tokens(F.col(answer)), lambda t: F.coalesce(F.array_max(readings(t)) >= 10, F.lit(False))
    )
    matched = F.filter("_tokens", lambda t: F.arrays_overlap(readings(t), F.col("_evidence")))
    counted = df.withColumns({"_tokens": tokens, "_evidence": evidence_values(F.col(evidence))}).withColumns(
        {"number_tokens": F.size("_tokens"), "matched_tokens": F.size(matched)}
    )
    share = F.col("matched_tokens") / F.col("number_tokens")
    return counted.withColumn(
        "grounding_ratio", F.when(F.col("number_tokens") < least, 1.0).otherwise(share)
    ).drop("_tokens", "_evidence")


def with_previous_text(messages: DataFrame) -> DataFrame:
    """Each assistant turn next to the turn before it, joined by (conversation, turn), so no
    conversation is gathered."""
    before = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    answers = messages.filter(F.col("role") == "assistant")
    return answers.join(before, ["conv_id", "turn"], "left")

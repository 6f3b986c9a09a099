"""Conversation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import text
from shelfcast.plans.registry import query, r
from shelfcast.plans.serving import RetailTables

CLEAN_SQL = r"""
    kept AS (SELECT conv_id, turn, role, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text
             FROM conversations WHERE role IN ('user', 'assistant')),
    clean AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM kept
              WHERE length(text) > 0)
"""


@query("chat_history", "X1", f"WITH {CLEAN_SQL} SELECT conv_id, turn, role, text FROM clean")
def chat_history(t: RetailTables):
    return text.sanitize_history(t.source.conversations)


@query(
    "chat_history_within_budget",
    "X2",
    f"""
    WITH {CLEAN_SQL},
    cost AS (SELECT *, CASE WHEN place = 1 AND CAST(floor(length(text) / 2.5) AS INTEGER) + 1 > 300
                            THEN left(text, 750) ELSE text END AS cut_text FROM clean),
    c AS (SELECT *, CAST(floor(length(cut_text) / 2.5) AS INTEGER) + 1 AS tokens FROM cost),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM c)
    SELECT conv_id, turn, role, cut_text AS text, tokens FROM s WHERE place = 1 OR used <= 300
    """,
)
def chat_history_within_budget(t: RetailTables):
    return text.trim_to_budget(text.sanitize_history(t.source.conversations), 300)


NUMBER_SQL = r"regexp_extract_all({}, '-?[0-9][0-9.,]*')"


def grounding_sql(source: str, keys: str) -> str:
    """Grounding of `answer` in `evidence` for rows of `source`."""
    us = "TRY_CAST(replace(t, ',', '') AS DOUBLE)"
    vn = "TRY_CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE)"
    return f"""
    tok AS (SELECT {keys}, id, regexp_replace(u, '^[.,]+|[.,]+$', '', 'g') AS t
            FROM (SELECT {keys}, generate_subscripts(n, 1) AS id, unnest(n) AS u
                  FROM (SELECT {keys}, {NUMBER_SQL.format("coalesce(answer, '')")} AS n FROM {source}))),
    rd AS (SELECT {keys}, id, v FROM (
               SELECT {keys}, id, unnest([{us}, {vn}, abs({us}), abs({vn})]) AS v FROM tok) WHERE v IS NOT NULL),
    sig AS (SELECT {keys}, id FROM rd GROUP BY ALL HAVING max(v) >= 10),
    ev0 AS (SELECT {keys}, TRY_CAST(replace(u, ',', '') AS DOUBLE) AS v
            FROM (SELECT {keys}, unnest({NUMBER_SQL.format("coalesce(evidence, '')")}) AS u FROM {source})),
    ev1 AS (SELECT {keys}, v FROM ev0 WHERE v IS NOT NULL UNION ALL SELECT {keys}, abs(v) FROM ev0 WHERE v IS NOT NULL),
    ev AS (SELECT DISTINCT {keys}, unnest([v, round_even(v, 0), round_even(v, 1), round_even(v, 2)]) AS v FROM ev1),
    hit AS (SELECT DISTINCT {keys}, id FROM sig JOIN rd USING ({keys}, id) JOIN ev USING ({keys}, v)),
    n AS (SELECT {keys}, count(*) AS number_tokens FROM sig GROUP BY ALL),
    m AS (SELECT {keys}, count(*) AS matched_tokens FROM hit GROUP BY ALL),
    g AS (SELECT {keys}, coalesce(number_tokens, 0) AS number_tokens, coalesce(matched_tokens, 0) AS matched_tokens
          FROM {source} LEFT JOIN n USING ({keys}) LEFT JOIN m USING ({keys}))
    """


RATIO = r("CASE WHEN number_tokens < 3 THEN 1.0 ELSE matched_tokens / number_tokens END")


@query(
    "chat_grounding",
    "X3",
    f"""
    WITH src AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS evidence
                 FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn
                 WHERE a.role = 'assistant'),
    {grounding_sql("src", "conv_id, turn")}
    SELECT conv_id, turn, CAST(number_tokens AS INTEGER) AS number_tokens,
           CAST(matched_tokens AS INTEGER) AS matched_tokens, {RATIO} AS grounding_ratio FROM g
    """,
)
def chat_grounding(t: RetailTables):
    """Each answer against the turn before it."""
    pairs = text.with_previous_text(t.source.conversations)
    return text.grounding(pairs, "text", "evidence").select(
        "conv_id", "turn", "number_tokens", "matched_tokens", "grounding_ratio"
    )


@query(
    "report_grounding",
    "X3",
    f"""
    WITH b AS (SELECT store_nbr, strftime(date, '%Y-%m') AS month, sum(n_invoices) AS n FROM v_transactions GROUP BY ALL),
    u AS (SELECT store_nbr, strftime(date, '%Y-%m') AS month, CAST(sum(unit_sales) AS BIGINT) AS units
          FROM v_sales GROUP BY ALL),
    src AS (SELECT store_nbr, month,
                   'Month ' || month || ': sold ' || CAST(units AS VARCHAR) || ' units, ' || CAST(n AS VARCHAR) ||
                   ' invoices, about ' || CAST(units // 1000 AS VARCHAR) || '.' ||
                   right('000' || CAST(units % 1000 AS VARCHAR), 3) || ' in all; next month ' ||
                   CAST(units + 77 AS VARCHAR) || ' (up ' || CAST(n % 40 AS VARCHAR) || ',50%).' AS answer,
                   '{{"units": ' || CAST(units AS VARCHAR) || '.0, "invoices": -' || CAST(n AS VARCHAR) ||
                   ', "growth": ' || CAST(n % 40 AS VARCHAR) || '.5}}' AS evidence
            FROM u JOIN b USING (store_nbr, month)),
    {grounding_sql("src", "store_nbr, month")}
    SELECT store_nbr, month, CAST(number_tokens AS INTEGER) AS number_tokens,
           CAST(matched_tokens AS INTEGER) AS matched_tokens, {RATIO} AS grounding_ratio FROM g
    """,
)
def report_grounding(t: RetailTables):
    """Monthly report sentences per store, with one invented number, against their figures."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    invoices = t.transactions.groupBy("store_nbr", month).agg(F.sum("n_invoices").alias("n"))
    units = t.sales.groupBy("store_nbr", month).agg(F.sum("unit_sales").cast("long").alias("units"))
    rows = units.join(invoices, ["store_nbr", "month"])

    def s(column):
        return column.cast("string")

    u, n = F.col("units"), F.col("n")
    grouped = F.concat(s(F.floor(u / 1000)), F.lit("."), F.right(F.concat(F.lit("000"), s(u % 1000)), F.lit(3)))
    answer = F.concat(
        F.lit("Month "), "month", F.lit(": sold "), s(u), F.lit(" units, "), s(n), F.lit(" invoices, about "),
        grouped, F.lit(" in all; next month "), s(u + 77), F.lit(" (up "), s(n % 40), F.lit(",50%)."),
    )
    evidence = F.concat(
        F.lit('{"units": '), s(u), F.lit('.0, "invoices": -'), s(n), F.lit(', "growth": '), s(n % 40), F.lit(".5}")
    )
    said = rows.withColumns({"answer": answer, "evidence": evidence})
    return text.grounding(said, "answer", "evidence").select(
        "store_nbr", "month", "number_tokens", "matched_tokens", "grounding_ratio"
    )

"""Chat formatting: conversations rendered by a compiled template, with a loss mask.

Turns are dealt by conversation, sorted inside each task and rendered as they stream by, so a
task holds one conversation at a time.  Texts are escaped so that no control string of the
template occurs inside them, and `unescape` gets the original back.

Defined results: a null text or role is empty; a null conversation id is a conversation of its
own; turns with equal numbers (or none, which come first) follow in order of role, then text;
repeated rows are repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.chat_template import compile_template

CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
)
FORMATTED = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,stop:long>>"


def escaper(controls: tuple[str, ...]):
    """Doubles backslashes and puts one after the first character of each control string."""
    if any("\\" in c or len(c) < 2 for c in controls):
        raise ValueError("control strings need two characters and no backslash")
    at = re.compile("(?=" + "|".join(re.escape(c) for c in controls) + ")(.)", re.S)
    return lambda text: at.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): formatted text and the
    spans, in code points, that the template marks as generated.  `template` sees `messages`, a
    list of {role, text}, and the filter `escape`."""
    compile_template(template, {"escape": str})  # a bad template fails here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template, {"escape": escaper(controls)})
        key, turns, out, held = None, [], [], 0

        def done() -> None:
            nonlocal held
            text, spans = render(messages=turns)
            out.append((key, len(turns), text, [{"start": a, "stop": b} for a, b in spans]))
            held += len(text)

        def flush() -> pd.DataFrame:
            nonlocal out, held
            made = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "spans"])
            out, held = [], 0
            return made.astype({"conv_id": "Int64"})

        for batch in batches:
            for conv, missing, role, text in zip(batch["conv_id"], batch["conv_id"].isna(), batch["role"], batch["text"], strict=True):
                this = None if missing else int(conv)
                if turns and this != key:
                    done()
                    turns = []
                    if held > 4_000_000:
                        yield flush()
                key = this
                turns.append({"role": role, "text": text})
        if turns:
            done()
        if out:
            yield flush()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(run, FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text made by `TEMPLATE`: only its own marks are unescaped in it."""
    turns = []
    for piece in formatted.split("<|turn|>")[1:]:
        role, _, rest = piece.partition("<|text|>")
        turns.append((unescape(role), unescape(rest.removesuffix("<|end|>"))))
    return turns

"""The corpus pipeline on small tables: odd rows, repeated rows, other columns, nothing at all."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, _gone int, domain string"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, items):
        spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string, hash long").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_stages_drop_what_they_should(spark, folder):
    rng = random.Random(5)
    words = {"en": "the cat and dog were on that mat with some more".split(), "de": "der hund und die katze sind auf einem haus mit".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "e", "er"]) for _ in range(n))
    own = {k: text("en" if k % 2 else "de", 60) for k in range(40)}
    row = lambda d, t, lang="en", source="src1": (d, t, lang, source, 0, "x", 1, "y")
    rows = [row(k, t, "en" if k % 2 else "de", f"src{k % 4}") for k, t in own.items()]
    passage = text("en", 25)
    near = own[1].split()
    rows += [row(100, own[0], "de", "src0"), row(100, own[0], "de", "src0"), row(101, " ".join([*near[:-1], "other"])), row(102, f"{text('en', 20)} {passage} {text('en', 20)}")]
    rows += [row(103, None), row(104, ""), row(105, "12 34 ??"), (None, text("en", 50), None, None, None, None, None, None), (None, text("de", 50), "de", None, 1, None, None, None)]
    where = folder(rows, [(1, passage, 5), (2, None, None), (2, "", 1)])
    docs = corpus_pipeline.table(spark, where, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, where), name)
        kept[name] = docs.collect()
        if name != "mix_sources":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert not {103, 104, 105} & set(ids["language_id"]) and len(ids["language_id"]) == len(rows) - 3
    assert 0 not in ids["exact_dedup"] and ids["exact_dedup"].count(100) == 1 and len(ids["exact_dedup"]) == len(rows) - 5
    assert 101 not in ids["near_dedup"] and 1 in ids["near_dedup"] and len(ids["near_dedup"]) == len(rows) - 6
    assert 102 not in ids["decontaminate"] and len(ids["decontaminate"]) == len(rows) - 7 and ids["decontaminate"].count(None) == 2
    mixed = kept["mix_sources"]
    assert mixed and {r["doc_id"] for r in mixed} <= set(ids["decontaminate"]) and all(r["taken"] > 0 for r in mixed)


def test_no_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [(1, "an item", 2)])).count() == 0

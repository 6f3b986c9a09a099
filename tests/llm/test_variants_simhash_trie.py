"""SimHash by Golay keys, spelling variants and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import prefix_trie, simhash, variants
from shelfcast.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def roots(pairs, nodes):
    low = {x: x for x in nodes}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


# ------------------------------------------------------------------ 11 SimHash


def plain_fingerprint(text: str | None) -> int:
    w = brute.SPACE_WORD.findall((text or "").translate(brute.LOWER))
    grams = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
    h = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows: list) -> list:
    """(doc_id, fingerprint, component) of rows with ids."""
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    of = roots(pairs, range(len(rows)))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[of[i]].append(d)
    return sorted((d, f"{fps[i]:016x}", min(least[of[i]])) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["Straße", "ÉTÉ", "日本"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(d, " ".join(make(rng.randint(1, 60)))) for d in range(120)]
    base = make(150)
    for d in range(200, 330):  # a group of edited copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((d, " ".join(w)))
    rows += [(d + 400, rows[d][1].upper()) for d in range(10)]
    return rows + [(500, None), (501, ""), (502, " \t\r\n"), (503, "one"), (504, "One"), (504, "one two three"), (505, "a " * 70_000), (7, rows[9][1]), (7, rows[9][1])]


@pytest.mark.parametrize("crowd", [256, 8, 2])
def test_simhash(spark, prose, crowd):
    """Small crowds send most keys through hubs and blocks."""
    df = spark.createDataFrame(prose, DOCS).withColumns({"fp": F.lit("x"), "n": F.lit(1), "key": F.lit(2), "label": F.lit(3)}).repartition(3)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_fingerprints(df, crowd=crowd).collect())
    assert got == plain_simhash(prose)


def test_simhash_without_ids_and_rows(spark):
    rows = [(None, "x y z a b"), (None, "x y z a b"), (3, "x y z a b"), (None, "quite another text here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}
    assert simhash.near_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_fingerprints(spark.createDataFrame(rows, DOCS), most_bits=5)


def test_golay_code():
    code = simhash.Golay()
    assert sorted(np.bitwise_count(code.error).tolist()) == sorted([0] + [1] * 23 + [2] * 253 + [3] * 1771)
    words = np.random.default_rng(2).integers(0, 1 << 23, 200).astype(np.uint32)
    index, held = code.indices(words)
    codewords = (np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)) ^ code.high
    for w, row, n in zip(words, index, held, strict=True):
        assert set(row[:n].tolist()) == set(np.flatnonzero(np.bitwise_count(codewords ^ w) <= 4).tolist())


def test_keys_of_fingerprints_within_four_bits_meet():
    code, rng = simhash.Golay(), np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    best = defaultdict(int)
    held = {(i, k): n for i, k, n in zip(*simhash.keys_of(a, code), strict=True)}
    for i, k, n in zip(*simhash.keys_of(b, code), strict=True):
        if (i, k) in held:
            best[i] = max(best[i], n + held[i, k])
    assert all(best[i] >= 2 for i in range(len(a)))


# ------------------------------------------------------------------ 12 spelling variants


def are_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows: list) -> dict:
    counts: Counter = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if are_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(12)
    letters = "abcdé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(40)]

    def slip(w):
        k, c = rng.randrange(len(w) + 1), rng.choice(letters)
        return rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])

    rows = []
    for d in range(300):
        words = [rng.choice(base) for _ in range(40)]
        rows.append((d % 250, " ".join(w if rng.random() > 0.06 else slip(slip(w) if rng.random() < 0.2 else w) for w in words)))
    rows += [(1000 + k, "aaaaaaa aaaaaab aaaaaac") for k in range(5)] + [(2000, "aaaaaaab " * 1200), (2001, "aaaaaaabb " * 60 + "aaaaaabbb " * 3)]
    return rows + [(3000, None), (3001, ""), (None, "ABCDABCD abcdabcd ÀBCDABC×÷ àbcdabc×÷"), (3002, "short é1é 12"), (2000, "aaaaaaab")]


@pytest.mark.parametrize("block", [16_384, 8])
def test_variants(spark, spelled, block):
    """Small blocks send words to several parts of the index."""
    df = spark.createDataFrame(spelled, DOCS).withColumns({"word": F.lit("x"), "n": F.lit(1), "root": F.lit(2)}).repartition(3)
    got = variants.spelling_variants(df, block=block).collect()
    want = plain_variants(spelled)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(f and r != f for f, r, *_ in want.values()), "the fixture should hold a chain of forms"


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "few words")], DOCS)).count() == 0


def test_bit_index():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    index = variants.BitIndex(words)
    for w in [*words, "", "abababa"]:
        n = len(w)
        assert sorted(words[k] for k in index.near(w, (n - 1, n, n + 1))) == [x for x in words if are_near(w, x)]
        assert sorted(words[k] for k in index.near(w, (n + 1,))) == [x for x in words if len(x) == n + 1 and are_near(w, x)]


def test_damage_is_by_document_and_word():
    hit = next(d for d in range(1000) if zlib.crc32(f"{d}:example".encode()) % 31 == 0)
    assert len(variants.damaged(hit, "example", 31)) == 6 and variants.damaged(hit, "example", 0) == "example"


# ------------------------------------------------------------------ 13 prefix trie


def plain_trie(rows: list) -> list:
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = own.get(first, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    leaves, total = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            total[k[:d]] += saved[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df) -> list:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(6)
    say = lambda: rng.choice(["hi", "hé", "", None, "ok"])
    rows = []
    for c in [*range(60), *range(-7, 0)]:
        rows += [(c, t, rng.choice(["user", "bot", None]) if t else "user", say()) for t in range(rng.choice([1, 2, 3, 6, 12]))]
    rows += [(100, None, "user", "first"), (100, 0, "bot", "x"), (100, 0, "bot", "x"), (100, 0, "bot", "a"), (101, 1, None, None), (None, 0, "user", "lost"), (73, 0, "user", "no first one")]
    long = [(t, "user" if t % 2 else "bot", f"t{t}") for t in range(70)]
    return rows + [(c, *t) for c in (205, 206, 207) for t in long] + [(c, 0, "user", "same") for c in range(300, 400)]


def test_prefix_trie(spark, chats):
    df = spark.createDataFrame(chats, TURNS).withColumns({"depth": F.lit("x"), "name": F.lit(1), "kid": F.lit(2), "place": F.lit(3)}).repartition(3)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(chats)


def test_long_conversations_are_cut(spark, chats, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LONG", 5)
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(chats, TURNS))) == plain_trie(chats)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0
    gone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(gone, 0, "user", "taken away")], TURNS)).collect()
    assert [(r["conv_id"], r["depth"], r["n_leaves"], r["ends_sha256"]) for r in got] == [(gone, 0, 1, hashlib.sha256(str(gone).encode()).hexdigest())]


def test_contraction_of_a_deep_chain_and_a_star(spark):
    """A chain of 300 nodes with a star of 200 at its end, by depth alone."""
    rows = [(0, d, 0 if d else None, d - 1, 1 if d < 299 else 200, d) for d in range(300)] + [(c, 300, 0, 299, 0, c) for c in range(1, 201)]
    tree = spark.createDataFrame(rows, "conv_id long, depth int, up_conv long, up_depth int, n_children long, v long")
    got = {(r["conv_id"], r["depth"]): r["v"] for r in prefix_trie.subtree_sums(tree, ["v"]).collect()}
    star = sum(range(1, 201))
    assert got == {(0, d): sum(range(d, 300)) + star for d in range(300)} | {(c, 300): c for c in range(1, 201)}


def test_queries_are_registered():
    assert {"op11_simhash_golay", "op12_spelling_variants", "op13_prefix_trie"} <= set(QUERIES)

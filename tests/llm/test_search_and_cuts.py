"""The shingle join, fill-in-middle and the dual-tree search against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import dual_tree, fim, shingle_join

LONG = "word " * 400_000


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- 11


def brute_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_join(docs):
    sets = brute_sets(docs)
    root = {i: i for i in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, len(sets[i]), top(i)) for i in ids}


def family(seed, n=260, bases=14):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[draw.choice(words) for _ in range(draw.randrange(3, 90))] for _ in range(bases)]
    out = []
    for k in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(4)):
            at, how = draw.randrange(len(w)), draw.random()
            w[at : at + (how < 0.4) + (how > 0.7) * draw.randrange(1, 8)] = [draw.choice(words)] * (how <= 0.7)
            w = w or ["x"]
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 9), (2, 7)])
def test_shingle_join_against_brute_force(spark, monkeypatch, seed, hot):
    """With small parts, hot units are cut and their pairs of parts searched."""
    monkeypatch.setattr(shingle_join, "HOT", hot)
    docs = [*family(seed), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one\ttwo")]
    got = shingle_join.mark(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_join(docs)


def test_unit_search_finds_all_partners():
    sets = [shingle_join.shingle_set(t.encode().split()) for _, t in family(5, 150, 5)]
    unit = shingle_join.Unit(sets, 80)
    for k, own in enumerate(sets):
        want = {j for j, other in enumerate(sets) if j != k and 100 * len(np.intersect1d(own, other)) >= 80 * len(np.union1d(own, other))}
        assert set(unit.partners(k)) == want


def test_shingle_join_edges(spark):
    rows = [(1, LONG, "x"), (2, LONG + "end", "y"), (None, "a b", "z"), (7, "a b", "z"), (7, "a b", "z"), (8, None, "q"), (8, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("token", F.lit(1)).withColumn("component_id", F.lit("old"))
    got = Counter(tuple(r) for r in shingle_join.mark(docs).collect())
    assert got == Counter({(1, 1, 1): 1, (2, 2, 2): 1, (None, 1, 7): 1, (7, 1, 7): 2, (8, 0, 8): 2})
    assert shingle_join.mark(docs.limit(0)).count() == 0


# --- 12


def brute_fim(text, doc_id):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_against_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abZ  <PSM>é€\U0001f600\nń漢") for _ in range(draw.randrange(70))) for _ in range(600)] + ["", None, "<P", "a<S>b", "é" * 40_000 + "x" * 9000]
    rows = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, doc string")
    out = fim.transform(rows)
    assert out.columns == ["doc_id", "text", "doc", *fim.ADDED]
    got = {r["doc_id"]: r for r in out.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(t, k)
        assert r["restored"] == (t or "") and r["text"] == t and r["doc"] == "kept"
    monkeypatch.setattr(fim, "BLOCK", 7)
    assert all(fim.rearranged((t or "").encode(), str(k))[:4] == brute_fim(t, k)[:4] for k, t in enumerate(texts[:300]))


def test_exception_index_converts_both_ways():
    text = "aé€b\U0001f600\U0001f600 漢字 plain"
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert len(index.at) == 6
    for k in range(len(text) + 1):
        byte = len(text[:k].encode())
        assert index.byte_of(k) == byte and index.chars_before(byte) == k


def test_fim_in_chars_and_edges(spark):
    texts = spark.createDataFrame([(None, "aé€b" * 50, 1), (3, LONG, 2), (3, LONG, 2)], "doc_id long, text string, n int")
    for units, n in (("words", 151), ("chars", 200)):
        rows = fim.transform(texts, units=units, fim_percent=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == 3 and all(r["back"] == r["text"] and r["form"] != "plain" for r in rows) and {r["n"] for r in rows if r["doc_id"] is None} == {n}
    assert fim.transform(texts.limit(0)).count() == 0


# --- 13


def brute_search(items, docs, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t or ""))
    each = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in each), sum(sum(c.values()) for _, c in each)
    df = Counter(w for _, c in each for w in c)
    out = set()
    for item, t in items:
        scores = []
        for i, c in each:
            m = 50 + 50 * sum(c.values()) * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(t)) if c[w])
            scores += [(-score, i)] * (score > 0)
        out |= {(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["Ünï", "é1", "ABC", "abc", "x_y"]
    text = lambda most: " ".join(draw.choice(words[: draw.randrange(2, len(words))]) for _ in range(draw.randrange(most)))
    return [(k, text(60)) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "...")], [(k, text(12)) for k in range(25)] + [(90, None), (91, "no such words")]


@pytest.mark.parametrize(("pairs", "k"), [(1 << 15, 9), (20, 3)])
def test_dual_tree_against_brute_force(spark, monkeypatch, pairs, k):
    """Also with several blocks of items and small batches."""
    monkeypatch.setattr(dual_tree, "PAIRS", pairs)
    docs, items = corpus(7, 400)
    got = dual_tree.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), k)
    assert {tuple(r) for r in got.collect()} == brute_search(items, docs, k)


def test_dual_tree_prunes_batches():
    """Two groups without common terms: of the other group's documents none is scored."""
    draw = np.random.default_rng(1)
    s = np.zeros((40, 512), np.float32)
    s[:20, :256], s[20:, 256:] = draw.integers(1, 900_000, (20, 256)), draw.integers(1, 900_000, (20, 256))
    w = np.full(40, 10.0)
    best = dual_tree.Best(np.ones(2), 5)
    import pyarrow as pa

    scored = dual_tree.search_batch(dual_tree.item_tree([np.arange(20), np.arange(20, 40)]), w, s, pa.array(range(512)), best)
    assert scored <= 512 and [len(r) for r in best.rows] == [5, 5]
    assert [r[3] for r in best.rows[0]] == np.argsort(-s[:20].sum(0, dtype=np.float64), kind="stable")[:5].tolist()


def test_dual_tree_edges(spark):
    docs = spark.createDataFrame([(5, "red hen", 1), (5, "red hen", 1), (2, "red hen", 1), (None, "red hen", 1), (9, LONG, 1)], "doc_id long, text string, s int")
    items = spark.createDataFrame([(1, "red"), (1, "Hen!"), (None, "word"), (3, "")], "item_id long, text string")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"]) for r in dual_tree.search(items, docs).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 2, 5), (1, 3, 5), (1, 4, None), (None, 1, 9)], key=str)
    assert dual_tree.search(items.limit(0), docs).count() == 0 and dual_tree.search(items, docs.limit(0)).count() == 0

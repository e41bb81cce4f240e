"""The operators of the list against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import ctw, exact_dedup, imatch, license_rules, ordinal_toxicity, packing, poisson_mix, ri_quality, simhash_trie, url_cascade
from foliospark.llm.common import fold, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def docs(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else first + k, None if t == "NULL" else t, "en", ["a", "b", None][k % 3], 1) for k, t in enumerate(texts)], DOCS)


ODD = ["NULL", "", "NOID", " \n ", "a", "a b", LONG, "a b", "Ünï ©", "NULL"]


# --- 1


def brute_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """Textbook context-tree weighting, one tree per bit position and prefix, by recursion."""
    counts: dict = defaultdict(lambda: [0, 0])

    def each(t: bytes):
        line = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(line)):
            for bit in range(8):
                yield line[i - depth : i], (bit, line[i] >> (8 - bit)), line[i] >> (7 - bit) & 1

    children: dict = defaultdict(set)
    for t in train:
        for context, node, b in each(t):
            for d in range(depth + 1):
                counts[node, context[depth - d :]][b] += 1
                if d:
                    children[node, context[depth - d + 1 :]].add(context[depth - d :])

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def pw(node, s):
        own = pe(*counts[node, s])
        if len(s) == depth:
            return own
        below = sum(pw(node, c) for c in children[node, s])
        return math.log(0.5) + np.logaddexp(own, below)

    total = 0.0
    memo: dict = {}
    for context, node, b in each(text):
        p = None
        for d in range(depth, -1, -1):
            s = context[depth - d :]
            n0, n1 = counts[node, s]
            kt = (n1 + 0.5) / (n0 + n1 + 1)
            if d == depth:
                p = kt
            else:
                if (node, s) not in memo:
                    memo[node, s] = math.exp(math.log(0.5) + pe(n0, n1) - pw(node, s))
                stop = memo[node, s]
                p = stop * kt + (1 - stop) * p
        total += math.log10(p if b else 1 - p)
    return total


def test_ctw_against_brute_force(spark):
    texts = ["banana band", "Bandana ban", "NULL", "", "xyz quux", "ban ban é", "banana band", "NOID"]
    d = docs(spark, texts)
    held = fold("doc_id") == 1
    got = {r["doc_id"]: r for r in ctw.score(d, held, depth=3, block_bytes=20).collect()}
    norm = {k: ("" if t == "NULL" else t).lower().encode() for k, t in enumerate(texts)}
    norm[None] = norm.pop(7)
    is_held = {k: zlib.crc32(str(k).encode() if k is not None else b"") % 5 == 1 for k in norm}
    train = [t for k, t in norm.items() if not is_held[k]]
    words = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    for k, t in norm.items():
        r = got[k]
        tokens = [*t.split(), None]
        assert r["held_out"] == is_held[k] and r["n_tokens"] == len(tokens) and r["train_tokens"] == n and r["n_known"] == sum(words[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r["score"] == pytest.approx(brute_ctw(train, t, 3), rel=1e-8)


def test_ctw_pieces_equal_whole_texts(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("abé \n") for _ in range(draw.randrange(60))) for _ in range(25)] + ["x" * 500 + " y " + "z" * 300, "NULL", "NOID", "NOID", "a" * 99]
    d = docs(spark, texts).unionByName(docs(spark, texts[:3]))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])
    whole, cut = (sorted(ctw.score(d, fold("doc_id") == 1, depth=3, piece_bytes=size).collect(), key=key) for size in (1 << 20, 7))
    assert len(whole) == len(cut) == len(texts) + 3
    for a, b in zip(whole, cut, strict=True):
        assert a[:5] == b[:5] and a["n_bytes"] == b["n_bytes"] and a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])


def test_ctw_random_letters_in_one_row(spark):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 3_000_000, np.uint8).tobytes().decode()
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").unionByName(spark.createDataFrame([(7, text)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in ctw.score(d, F.lit(False), block_grams=1 << 20).collect()}  # blocks are made smaller
    assert got[7]["n_tokens"] == 2 and got[7]["n_bytes"] == len(text) and got[7]["bits_per_byte"] < math.log2(26) + 0.2 and got[7]["train_tokens"] == 6


def test_ctw_hot_subtrees_are_cut_again(spark):
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"ab c", np.uint8), 4000, p=[0.6, 0.2, 0.1, 0.1]).astype(np.int64)
    code = sum(data[j : len(data) - 5 + j] << 8 * (5 - j) for j in range(6))
    grams, n = np.unique(code, return_counts=True)
    rows = stored(spark.createDataFrame([(int(c), int(k)) for c, k in zip(grams, n, strict=True)], "code long, n long"), "codes")
    whole, cut = ({r["code"]: r["value"] for r in ctw.code_values(rows, 5, 50, most).collect()} for most in (1 << 21, 20))
    sizes = Counter((grams >> 8 & 0xFFFFFF).tolist()).values()
    assert min(sizes) <= 20 < max(sizes) and set(whole) == set(cut) == set(grams.tolist())
    assert all(cut[c] == pytest.approx(v, rel=1e-12) for c, v in whole.items())


def test_ctw_edges(spark):
    assert ctw.score(docs(spark, []), F.lit(False)).count() == 0
    rows = ctw.score(docs(spark, ODD), F.lit(True), depth=2).collect()  # nothing to learn from
    assert len(rows) == len(ODD) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


# --- 2


def test_poisson_inverse_and_mix(spark):
    u = [(random.Random(7).random() if k else 0.999999, r) for k in range(40) for r in (0.1, 1.0, 4.5, 60.0)]
    got = spark.createDataFrame(u, "u double, r double").select("u", "r", poisson_mix.poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect()
    for x in got:
        cdf = lambda k, r=x["r"]: sum(math.exp(i * math.log(r) - r - math.lgamma(i + 1)) for i in range(k + 1))
        assert cdf(x["k"]) >= x["u"] - 1e-12 and (x["k"] == 0 or cdf(x["k"] - 1) < x["u"] + 1e-12)
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 3 > 0, "big").alias("source"), F.lit(1).alias("copy"))
    out = poisson_mix.mix(many, {"big": 1.0, None: 3.0, "absent": 1.0}, epochs=2.0)
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(by["big"] / 12000 - 0.2) < 0.03 and abs(by[None] / 12000 - 0.6) < 0.03 and out.columns.count("copy") == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, poisson_mix.mix(many.repartition(7), {"big": 1.0, None: 3.0, "absent": 1.0}, epochs=2.0).collect()))
    assert poisson_mix.mix(docs(spark, [])).count() == 0 and poisson_mix.mix(docs(spark, ODD), epochs=3.0).count() >= 0


def test_a_small_source_beside_many_rows(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") == 7, "rare").when(F.col("id").between(10, 12), "few").otherwise("big").alias("source"))
    out = poisson_mix.mix(many).select("doc_id", "source", "rate", "copies", "copy", "shuffle_key")
    by = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(by[s] - 10_000) < 600 for s in ("rare", "few", "big"))
    rare = out.filter("source = 'rare'")
    assert rare.first()["rate"] == 10_000 and {r["copy"] for r in rare.collect()} == set(range(by["rare"])) and rare.select("shuffle_key").distinct().count() == by["rare"] == rare.first()["copies"]
    ids = spark.range(2000).select(poisson_mix.drawn(F.lit(1300.0), F.col("id").cast("string")).alias("k")).agg(F.avg("k").alias("m"), F.variance("k").alias("v")).first()
    assert abs(ids["m"] - 1300) < 5 and abs(ids["v"] / 1300 - 1) < 0.15


# --- 3, 8


def test_classifiers_learn(spark):
    draw = random.Random(3)
    good = [" ".join(draw.choice("the of and river house tree walks runs sees blue".split()) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(draw.choice("the of and river house tree".split()) + "%%%" for _ in range(60)) for _ in range(100)]
    mean = [x.replace("river", draw.choice(["idiot", "idiotic"]), 2) for x in good[:70]]
    d = docs(spark, good + junk + mean)
    labels = spark.createDataFrame([(k, int(not 150 <= k < 250), int(k >= 250)) for k in range(320)] + [(None, 1, 1), (9999, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    held = fold("doc_id") == 0
    rows = ri_quality.classify(d, labels, held).collect()
    assert len(rows) == 320 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.5) == (not 150 <= r["doc_id"] < 250) for r in rows if r["held_out"]]) > 0.95
    model = ordinal_toxicity.train(d, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    graded = ordinal_toxicity.grade(d.withColumn("toxic", F.lit("clash")), model).collect()
    assert np.mean([r["toxic"] == (r["doc_id"] >= 250) for r in graded]) > 0.95 and all(0 <= r["severity"] <= 3 for r in graded)
    odd = docs(spark, ODD)
    assert ri_quality.classify(odd, labels.filter("doc_id < 0"), held).count() == len(ODD)
    assert [r["toxic"] for r in ordinal_toxicity.grade(odd, ordinal_toxicity.train(odd, labels.filter("doc_id < 0"))).collect()] == [False] * len(ODD)
    assert ri_quality.classify(docs(spark, []), labels, held).count() == 0 and ordinal_toxicity.grade(docs(spark, []), model).count() == 0


def brute_vectors(texts: list[str]) -> dict[int, np.ndarray]:
    """Word vectors by slot, one token and neighbour at a time."""
    place, sign = ri_quality.index_vectors(42)
    out: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(ri_quality.DIM))
    for t in texts:
        line = [zlib.crc32(w) % ri_quality.SLOTS for w in re.findall(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x20\x09-\x0d]+", t.encode().lower())]
        for i, own in enumerate(line):
            for j in range(max(0, i - 2), min(len(line), i + 3)):
                if j != i:
                    for at, s in zip(place[line[j]], sign[line[j]], strict=True):
                        out[own][at] += s
    return {k: v / (np.linalg.norm(v) or 1) for k, v in out.items()}


def test_quality_vectors_and_features_against_brute_force(spark):
    texts = ["The old house, the OLD tree", "é© é x", "", "one", "NULL", "a b %% c a", "a b %% c a"]
    d = docs(spark, texts)
    vectors = ri_quality.word_vectors(d)
    want = brute_vectors(["" if t == "NULL" else t for t in texts])
    assert set(np.flatnonzero(np.abs(vectors).sum(1))) == {k for k, v in want.items() if v.any()}
    for k, v in want.items():
        assert vectors[k] == pytest.approx(v, abs=1e-6)
    got = {r["doc_id"]: np.frombuffer(r["features"], np.float32) for r in ri_quality.features(d, vectors).collect()}
    for k, t in enumerate(texts):
        line = [zlib.crc32(w) % ri_quality.SLOTS for w in re.findall(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x20\x09-\x0d]+", ("" if t == "NULL" else t).encode().lower())]
        own = np.array([vectors[x] for x in line]).reshape(-1, ri_quality.DIM)
        assert got[k] == pytest.approx(np.concatenate([own.mean(0), own.std(0)]) if len(own) else np.zeros(2 * ri_quality.DIM), abs=1e-5)
    x, y = np.random.default_rng(1).normal(size=(300, 2 * ri_quality.DIM)), np.arange(300) % 2
    net = ri_quality.fit(x, y.astype(float), epochs=3)
    one = [1 / (1 + math.exp(-(sum(math.tanh(sum((row[i] - net.centre[i]) / net.scale[i] * net.w1[i, h] for i in range(len(row))) + net.b1[h]) * net.w2[h] for h in range(len(net.b1))) + net.b2) / net.temperature)) for row in x[:3]]
    assert net.probability(x[:3]) == pytest.approx(one)


def test_quality_repeated_ids_with_other_texts(spark):
    d = docs(spark, [f"word{k} the tree {'%% ' * (k % 2) * 9}" for k in range(40)])
    twice = d.unionByName(d.withColumn("text", F.reverse("text")))
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    runs = [sorted((r["doc_id"], round(r["score"], 9)) for r in ri_quality.classify(x, labels, F.lit(False)).collect()) for x in (twice, twice.orderBy(F.desc("text")))]
    assert runs[0] == runs[1] and len(runs[0]) == 80


def test_toxicity_against_brute_force(spark):
    words = np.array(sorted(zlib.crc32(w) for w in (b"vile", b"vile-", b"tree")), np.uint32)
    weights = {zlib.crc32(b"vile"): 1.5, zlib.crc32(b"vile-"): 0.25, zlib.crc32(b"tree"): -0.5}
    model = ordinal_toxicity.Model(words, np.array([weights[int(w)] for w in words]), np.array([0.5, 1.0, 2.5]))
    texts = ["vile Vile tree", "vileness", "a tree", "", "NULL", "vile " * 50]
    got = {r["doc_id"]: r for r in ordinal_toxicity.grade(docs(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        n = Counter(re.findall("[a-z0-9]+", "" if t == "NULL" else t.lower()))
        beginnings = Counter()
        for w, c in n.items():
            for size in (4, 5, 6):
                if len(w) >= size:
                    beginnings[w[:size] + "-"] += c
        x = sum(weights.get(zlib.crc32(w.encode()), 0) * (1 + math.log(c)) for w, c in (n + beginnings).items())
        p = [1 / (1 + math.exp(t_ - x)) for t_ in (0.5, 1.0, 2.5)]
        each = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        r = got[k]
        assert r["severity"] == pytest.approx(sum(i * q for i, q in enumerate(each))) and r["grade"] == int(np.argmax(each)) and r["p_toxic"] == pytest.approx(p[0]) and r["toxic"] == (p[0] >= 0.5)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    d = docs(spark, [("vile " if k % 2 else "tree ") * 200 for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert len(ordinal_toxicity.train(d, labels, sample_bytes=10).words) == 0 and len(ordinal_toxicity.train(d, labels, sample_bytes=1 << 20).words) > 0


# --- 4


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,), ("",)], "key string"))
    listed = universe.filter("key IS NOT NULL").filter(F.xxhash64("key") % 7 == 0)
    want = {r["key"] for r in listed.collect()}
    for most in (1 << 26, 1000):  # one cascade, and several shards
        got = {r["key"] for r in url_cascade.mark_listed(universe, listed.unionByName(listed), "key", "hit", most).filter("hit").collect()}
        assert got == want
    assert len(url_cascade.cascade(universe, listed)) > 1 and url_cascade.cascade(universe, listed.limit(0)) == []
    empty = url_cascade.mark_listed(universe.limit(0), listed, "key", "hit", 1000)
    assert empty.columns == ["key", "hit"] and empty.count() == 0
    outside = listed.unionByName(spark.createDataFrame([("not in the universe",), (None,)], "key string"))
    assert {r["key"] for r in url_cascade.mark_listed(universe, outside, "key", "hit").filter("hit").collect()} == want


def test_url_rules(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "com/de/": "block"}
    rows = [(1, "http://a.EXAMPLE.org/es/x?y", "h"), (2, "http://notexample.org/es/x", "g"), (3, "https://b.com/de/1#t", "m"), (4, "https://c.net/copy", "m"), (5, "https://c.net", "z"), (6, None, None), (7, "no url", "q"), (8, "http://de.com", "w"), (9, "x://h.com?a=://z/de/", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge(pages.withColumn("rule", F.lit("clash")), rules, url_cascade.mirrored(pages, rules)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4] == ("c.net", "/copy", None, "block") and got[5] == ("c.net", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][1:] == ("", None, "allow") and got[9][:2] == ("h.com", "")


def test_pages_without_url_share_no_verdict(spark):
    rules = {"com/de/": "block"}
    pages = spark.createDataFrame([(1, "https://b.com/de/1", "m"), (2, None, "m"), (3, None, "q"), (4, "no url", "r")], "page_id long, url string, html string")
    listed = url_cascade.mirrored(pages, rules)
    assert {r["key"] for r in listed.collect()} == {"b.com/de/1"}
    for some in (listed, listed.unionByName(spark.createDataFrame([("",)], "key string"))):
        assert {r["page_id"]: r["verdict"] for r in url_cascade.judge(pages, rules, some).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


# --- 5


def brute_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def test_license_rules(spark):
    texts = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. CC-BY-NC cc by nc", "under the KIT license", "x " * 500 + "UNDER\nTHE (MIT) license under the mit license",
        "SPDX-License-Identifier: GPL-3.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "ünder the mit license", "cc bync", "NULL", "", LONG,
        "under the mit\u212aicense license", "licensed under CC BY NC-SA 4.0", "Released\nunder MIT", "All\nrights reserved", "governed by (the) ISC",
    ]
    got = {r["doc_id"]: r for r in license_rules.scan(docs(spark, texts)).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for k, t in enumerate(texts):
        w = brute_words("" if t == "NULL" else t)
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[4]["labels"] == "gpl-3" and got[5]["labels"] == "mit" and got[12]["labels"] == "cc-by-nc,cc-by-nc-sa" and got[0]["labels"] == got[13]["labels"] == "mit"
    assert got[14]["labels"] == "" and got[15]["labels"] == "isc"
    assert len(license_rules.rules()) > 300 and license_rules.scan(docs(spark, [])).count() == 0


#: Notices as projects carry them, and the one label of each.
NOTICES = (
    ("mit", "Copyright (c) 2020 A. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Copyright 2019 B. All rights reserved. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd", "Copyright (c) 2001, C. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl-2", "This program is licensed under the terms of the GNU General Public License version 2."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "released under the ISC licence"),
    ("mit", "licensed under MIT"),
    ("", "All rights reserved. This end user license agreement is long."),
    ("", "distributed under the Apache Foundation; licensed under MIT guidance; governed by Ruby and friends; available under X11 forwarding"),
)


def test_notices_have_one_label(spark):
    got = {r["doc_id"]: r["labels"] for r in license_rules.scan(docs(spark, [t for _, t in NOTICES])).collect()}
    assert got == {k: label for k, (label, _) in enumerate(NOTICES)}


def test_inner_names_clash_with_no_column(spark):
    """Inputs with columns named like anything that op4, op5 and op8 use inside keep their values."""
    names = ["_hits", "_base", "_kept", "_n", "_words", "_evidence", "evidence", "doc", "page", "key", "is_listed", "_is_listed", "content", "c", "c0"]
    rows = docs(spark, ["under the mit license", "fine words"]).withColumns({n: F.lit(f"own {n}") for n in names})
    toxic = ordinal_toxicity.train(rows, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    pages = rows.withColumns({"url": F.lit("http://a.com/de/x"), "html": F.lit("h")})
    for out in (license_rules.scan(rows), ordinal_toxicity.grade(rows, toxic), url_cascade.judge(pages, {"com/de/": "block"}, url_cascade.mirrored(pages, {"com/de/": "block"}))):
        found = out.select(*names).collect()
        assert len(found) == 2 and all(tuple(r) == tuple(f"own {n}" for n in names) for r in found)


def test_empty_pages_copy_nothing(spark):
    rules = {"com/de/": "block"}
    pages = spark.createDataFrame([(1, "http://a.com/de/x", ""), (2, "http://b.net/y", ""), (3, "http://c.net/z", None), (4, "http://a.com/de/w", "t"), (5, "http://d.net/v", "t")], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_cascade.judge(pages, rules, url_cascade.mirrored(pages, rules)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block"}
    none = pages.limit(0)
    assert url_cascade.mirrored(none, rules).count() == 0 and url_cascade.judge(none, rules, url_cascade.mirrored(none, rules)).count() == 0


def sample(draw, parsed) -> str:
    """A text that a rule's regular expression matches."""
    out = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op in ("NOT_LITERAL", "ANY"):
            out.append("q")
        elif op == "IN":
            kind, x = draw.choice(arg)
            out.append("q" if str(kind) == "NEGATE" or str(arg[0][0]) == "NEGATE" else chr(draw.randint(*x) if str(kind) == "RANGE" else x))
        elif op == "BRANCH":
            out.append(sample(draw, draw.choice([b for b in arg[1] if not any("ASSERT" in str(x) for x, _ in b)])))
        elif op == "SUBPATTERN":
            out.append(sample(draw, arg[3]))
        elif op == "MAX_REPEAT":
            out += [sample(draw, arg[2]) for _ in range(draw.randint(arg[0], min(arg[1], arg[0] + 1)))]
        else:
            raise ValueError(op)
    return "".join(out)


def test_gates_drop_no_match(spark):
    draw = random.Random(11)
    for rule in license_rules.rules():
        for _ in range(60):
            text = sample(draw, re._parser.parse(rule.regex))
            assert re.fullmatch(rule.regex, text) and any(w in text for w in rule.keyword.split("|")), (rule, text)
            assert any(a in text for a in license_rules.ANCHORS) or re.search(license_rules.CC, text), (rule, text)
    texts = ["To the extent possible under law, X has waived all copyright and related or neighboring rights to Y", "subject to the terms of the MPL 2.0", "this work is under CC BY-SA 4.0", "governed by the GNU GPL v3", "a simple example under review"]
    got = {r["doc_id"]: r["labels"] for r in license_rules.scan(docs(spark, texts)).collect()}
    assert got == {0: "cc0-1.0", 1: "mpl-2.0", 2: "cc-by-sa", 3: "gpl-3", 4: ""}


def brute_detections(text: str) -> list[tuple[int, int, int]]:
    """first and last word and number of the rule, for every rule's places in reading order."""
    line = " " + " ".join(brute_words(text)) + " "
    return [(line[: m.start()].count(" "), line[: m.end()].count(" ") - 1, k) for k, r in enumerate(license_rules.rules()) for m in re.finditer(f"(?:{r.regex})(?= )", line)]


def test_license_rules_against_brute_force(spark):
    these, draw = license_rules.rules(), random.Random(17)
    texts = []
    for _ in range(40):  # matches of rules, within other words and within each other
        parts = [sample(draw, re._parser.parse(draw.choice(these).regex)) for _ in range(draw.randrange(1, 5))]
        texts.append(draw.choice([" ", " and the ", ". Then, "]).join(parts).replace(" ", draw.choice([" ", "-", ", "])).title())
    texts += ["under the mit license " * 700, "licensed under the apache license version 2 0 " * 300 + "x", "they met under the ruby sky", "under vim and under the artistic roof", "subject to postgresql limits"]
    got = {r["doc_id"]: r for r in license_rules.scan(docs(spark, texts).withColumn("labels", F.lit("clash")).withColumn("N_Words", F.lit(1))).collect()}
    for k, t in enumerate(texts):
        hits = brute_detections(t)
        beats = lambda g, h: g[0] <= h[0] and g[1] >= h[1] and (g[:2] != h[:2] or (-these[g[2]].priority, g[2]) < (-these[h[2]].priority, h[2]))
        kept = [h for h in hits if not any(beats(g, h) for g in hits)] if len(hits) < 1000 else None
        if kept is not None:
            assert sorted((d["first"], d["last"], d["label"]) for d in got[k]["detections"]) == sorted((a, b, these[r].label) for a, b, r in kept), t
        assert got[k]["n_base"] == sum(these[r] in license_rules.BASE_RULES for _, _, r in hits)
    assert got[40]["n_base"] == 700 and got[40]["last_word"] == 4 * 699 and [got[k]["labels"] for k in (42, 43, 44)] == ["", "", ""]


# --- 6


def test_exact_dedup(spark):
    texts = ["a  b", "a b", "a\n\tb", "c", "NULL", "", " ", "NOID", "c "]
    d = docs(spark, texts).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.mark(d).collect()}
    assert {k: v[:3] for k, v in got.items()} == {0: (0, 3, True), 1: (0, 3, False), 2: (0, 3, False), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False), 6: (6, 1, True), None: (None, 1, True), 8: (8, 1, True)}
    assert got[1][3] == hashlib.sha256(b"a b").hexdigest()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in exact_dedup.drop(d.unionByName(d)).collect()) == [-1, 0, 3, 4, 6, 8]
    assert exact_dedup.mark(docs(spark, [])).count() == 0 and exact_dedup.drop(docs(spark, [])).count() == 0


# --- 7


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["Don't", "tree.", "éa", "x<|endoftext|>", "ﬁne", "12"]) for _ in range(draw.choice([1, 30, 300, 5000]))) for _ in range(40)] + ODD
    d = docs(spark, texts)
    rows = packing.pack(d, path, block_tokens=30_000).collect()
    tokenizer = Tokenizer.from_file(path)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        if t == "NOID":
            continue
        ids = tokenizer.encode("" if t == "NULL" else t, add_special_tokens=False).ids + [2]
        pieces = sorted(by[k], key=lambda r: r["start"])
        assert [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids and {r["doc_tokens"] for r in pieces} == {len(ids)}
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)]).tolist()[:-1]
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        used = sum(r["length"] for r in w)
        assert [r["offset"] for r in w] == np.cumsum([0, *(r["length"] for r in w)]).tolist()[:-1] and used <= 4096 and used & (used - 1) == 0
    assert packing.pack(docs(spark, []), path).count() == 0


def test_every_letter_before_punctuation():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path, 2)
    words = [f"{before}{chr(c)}{closing}" for c in range(0x80, 0x30000) if chr(c).isalpha() and not 0x4E00 < c < 0x9F00 and not 0x20000 < c < 0x2A000 for before, closing in (("a", "."), ("e\u0301", "?!"))]
    differ = [w for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True) if np.frombuffer(encode(w), "<u4").tolist() != [*e.ids, 2]]
    assert not differ, differ[:20]


def test_best_fit_takes_the_tightest_window():
    draw = random.Random(1)
    lengths = [draw.choice([1, 7, 500, 4096, 9000, draw.randint(1, 4000)]) for _ in range(400)]
    open_: list[int] = []
    for n in sorted((x % 4096 for x in lengths if x % 4096), reverse=True):
        fit = [c for c in open_ if c >= n]
        open_.append(min(fit) - n if fit else 4096 - n)
        if fit:
            open_.remove(min(fit))
    assert len(packing.best_fit(lengths, 4096)) == len(open_) + sum(x // 4096 for x in lengths)


# --- 9


def test_imatch(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(300)]) for _ in range(80)) for _ in range(60)]
    texts += [texts[3], "NULL", "", "ab"]
    got = {r["doc_id"]: r for r in imatch.compare_with_next(docs(spark, texts), 0.01, 0.9).collect()}
    plain = ["" if t == "NULL" else t for t in texts]
    for k, t in enumerate(plain):
        following = plain[k - 1] if k else plain[-1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[k]["near_edited"] <= 1
    assert got[3]["fingerprint"] == got[60]["fingerprint"] != got[4]["fingerprint"] and len(got) == len(texts)
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])
    band = {r["term"] for r in imatch.lexicon(docs(spark, texts), 0.01, 0.9).collect()}
    df = Counter(w for t in plain for w in set(t.split()))
    assert {bytes(b).decode() for b in band} == {w for w, n in df.items() if 0.01 * len(texts) <= n <= 0.9 * len(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs(spark, texts), 0.01, 0.9).collect()} == {k: r["fingerprint"] for k, r in got.items()}
    assert imatch.compare_with_next(docs(spark, [])).count() == 0 and imatch.compare_with_next(docs(spark, ["NOID"])).count() == 1


def test_imatch_band_with_a_hot_text(spark):
    draw = random.Random(12)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(1500)]) for _ in range(80)) for _ in range(600)]
    short = ["A.", "De.", "This.", "!", "?", "A.", "NULL", ""]
    alone = {bytes(r["term"]) for r in imatch.lexicon(docs(spark, texts + short)).collect()}
    many = docs(spark, texts + short + [texts[3]] * 400)
    assert {bytes(r["term"]) for r in imatch.lexicon(many).collect()} == alone and len(alone) > 1000
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(many).collect()}
    assert got[600] == got[605] and len({got[k] for k in range(600, 605)} | {got[3]}) == 6 and got[3] == got[700]
    none = f"{0:016x}" * imatch.SIZE
    assert {got[606], got[607]} == {none} and none not in {v for k, v in got.items() if k not in (606, 607)}


def test_imatch_signatures_against_brute_force(spark, monkeypatch):
    draw = random.Random(31)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(40)]) for _ in range(draw.randrange(1, 40))) for _ in range(30)] + ["", "NULL", "zz zz", LONG, "NOID", "NOID"]
    plain = ["" if t == "NULL" else t for t in texts]
    df = Counter(w for t in set(plain) for w in set(re.findall("[a-z0-9]+", t.lower())))
    band = {w for w, n in df.items() if 0.1 * len(set(plain)) <= n <= 0.9 * len(set(plain))}

    def kept(word: str, k: int) -> bool:
        digest = b"".join(xxhash.xxh64_digest(word.encode(), 42 + i) for i in range(-(-2 * imatch.SIZE // 8)))
        return int.from_bytes(digest[2 * k : 2 * k + 2], "little") < 65536 >> (k // imatch.EACH + 1)

    def signatures(t: str) -> list[int]:
        own = sorted(set(re.findall("[a-z0-9]+", t.lower())))
        lists = [[w for w in own if w in band and kept(w, k)] for k in range(imatch.SIZE)]
        if t and not any(lists):
            line = b"\0" + (" ".join(own).encode() or b"\0" + t.encode())
            return [xxhash.xxh64_intdigest(line, 42 + k) % (2**64 - 1) + 1 for k in range(imatch.SIZE)]
        return [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) % (2**64 - 1) + 1 if x else 0 for x in lists]

    for most in (imatch.MOST_TERMS, 0):  # the lexicon as it is, and hashed
        monkeypatch.setattr(imatch, "MOST_TERMS", most)
        got = imatch.compare_with_next(docs(spark, texts), 0.1, 0.9).collect()
        by = {r["doc_id"]: r for r in got}
        assert len(got) == len(texts)
        for k, t in enumerate(plain[:-2]):
            own, other = signatures(t), signatures(plain[k - 1]) if k else None
            assert by[k]["fingerprint"] == "".join(f"{x:016x}" for x in own)
            if other is not None:
                some = [(x, y) for x, y in zip(own, other, strict=True) if x or y]
                assert by[k]["near_next"] == pytest.approx(sum(x == y for x, y in some) / len(some) if some else 1.0)


# --- 10


def brute_print(text: str) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark):
    draw = random.Random(4)
    base = [" ".join(draw.choice([f"w{k}" for k in range(500)]) for _ in range(200)) for _ in range(20)]
    texts = base + [b.replace(" w1", " v1", 1) for b in base for _ in range(2)] + ["NULL", "", "A  b", "a b", "NOID"]
    d = docs(spark, texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_trie.mark(d).collect()}
    prints = {(k if t != "NOID" else None): brute_print("" if t == "NULL" else t) for k, t in enumerate(texts)}
    ids = [k for k in prints if k is not None]
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {k: got[k] for k in ids} == {k: (f"{prints[k]:016x}", find(k)) for k in ids}
    assert simhash_trie.mark(docs(spark, [])).count() == 0


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)

    def some(n):
        x = base[rng.integers(0, 20, n)]
        for _ in range(3):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        return np.sort(x)

    a, b = some(600), some(500)
    for right in (None, b):
        got = {p for x, y in simhash_trie.trie_join(a, right, 3) for p in zip(x.tolist(), y.tolist(), strict=True)}
        other = a if right is None else b
        near = np.bitwise_count(a[:, None] ^ other[None, :]) <= 3
        deep = {p for x, y in simhash_trie.trie_join(a, right, 3, 7) for p in zip(x.tolist(), y.tolist(), strict=True)}
        assert deep == {(i, j) for i, j in got if a[i] >> np.uint64(57) == other[j] >> np.uint64(57)}
        assert got == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True) if right is not None or i < j}


def test_full_subtries_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "HOT", 20)
    rng = np.random.default_rng(5)
    near = [int(x) for x in np.unique(np.concatenate([rng.integers(0, 1 << 12, 120), (np.int64(1) << 40) + rng.integers(0, 1 << 10, 60), rng.integers(0, 1 << 62, 60)]))]
    got = {r["node"]: r["label"] for r in simhash_trie.components(simhash_trie.links(spark.createDataFrame([(x,) for x in near], "fp long"))).collect()}
    root = list(range(len(near)))
    for i in range(len(near)):
        for j in range(i):
            if bin(near[i] ^ near[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == {near[i]: near[r] for i, r in enumerate(root) if root.count(r) > 1}


def test_near_copies_in_full_subtries(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "HOT", 12)
    draw = random.Random(21)
    base = [f"w{draw.randrange(3000)}" for _ in range(300)]
    family = [" ".join([*base[:k], f"z{k}", *base[k + 1 :]]) for k in range(40)]
    other = [" ".join(f"w{draw.randrange(3000)}" for _ in range(200)) for _ in range(30)]
    assert {r["doc_id"] for r in simhash_trie.drop(docs(spark, family + other + ["NULL", LONG])).select("doc_id").collect()} == {0, *range(40, 72)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7000)]
    got = {r["node"]: r["label"] for r in simhash_trie.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in [*range(61), 7000]}, 100: 100, 150: 100, 200: 100}


def test_sets_that_share_64_bits_stay_apart(spark):
    rows = [(1, b"t1", 7, 5), (2, b"t2", 7, 9), (3, b"t3", 7, 9), (4, b"t4", 8, 5), (None, b"t1", 7, 5)]
    table = spark.createDataFrame([(i, bytearray(t), n, m, [n], bytearray(24)) for i, t, n, m in rows], "id long, th binary, node long, more long, keys array<long>, fp binary")
    prints, nodes = simhash_trie.set_nodes(stored(table, "prints"))
    of = {r["id"]: r["node"] for r in prints.collect()}
    assert of[1] == of[None] == 7 and of[2] == of[3] not in (7, 8) and of[4] == 8
    assert {r["node"]: bytes(r["rep"]) for r in nodes.collect()} == {7: b"t1", of[2]: b"t2", 8: b"t4"}


def test_equal_sets_of_shingles_are_one_node(spark):
    cycle = "one two three four five six seven eight nine ten ".split()
    texts = [" ".join((cycle * 4)[k : k + 20]) for k in range(3)] + [" ".join(cycle * 3), "a a a a a", "A a a a a a a", "a a a a", "", " \n", "NULL"]
    kept = sorted(r["doc_id"] for r in simhash_trie.drop(docs(spark, texts)).select("doc_id").collect())
    assert kept == [0, 4, 6, 7]


def test_near_copies_are_dropped(spark):
    draw = random.Random(6)
    base = [" ".join(draw.choice([f"w{k}" for k in range(3000)]) for _ in range(300)) for _ in range(15)]
    edited = [" ".join("zz" if k in {10, 100, 200} else w for k, w in enumerate(b.split())) for b in base]  # 0.90 of the five-word shingles stay
    d = docs(spark, base + edited + base[:3] + ["NULL", "NOID"])
    kept = {r["doc_id"] for r in simhash_trie.drop(d.unionByName(d.filter("doc_id = 0"))).collect()}
    assert kept == {*range(15), 33, None}
    assert simhash_trie.drop(docs(spark, [])).count() == 0


def changed(draw, words, how, likeness):
    """A copy with one passage changed, of about that five-word Jaccard likeness."""
    n, fresh = len(words), lambda k: [f"n{draw.randrange(10**6)}" for _ in range(k)]
    at = draw.randrange(n // 2)
    if how == "appended":
        return words + fresh(int(n * (1 / likeness - 1)))
    if how == "cut":
        return words[: int(n * likeness) + 3]
    k = int(n * (1 - likeness) / (1 + likeness)) - 4
    return words[:at] + fresh(k) + words[at + k :]


def test_near_copies_by_likeness(spark):
    draw = random.Random(9)
    texts, pairs = [], []
    for how in ("appended", "cut", "replaced"):
        for k in range(200):
            base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(150, 600))]
            texts += [" ".join(base), " ".join(changed(draw, base, how, (0.74, 0.805, 0.83)[k % 3]))]
            pairs.append((len(texts) - 2, how))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    kept = {r["doc_id"] for r in simhash_trie.drop(docs(spark, texts)).select("doc_id").collect()}
    found = Counter()
    for i, how in pairs:
        near = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8
        found[how, near, i + 1 not in kept] += 1
        assert i in kept and (near or i + 1 in kept)
    for how in ("appended", "cut", "replaced"):
        assert found[how, True, True] >= 100 and found[how, True, False] == 0 and found[how, False, False] >= 50, found


def test_failed_pair_hides_no_other(spark):
    draw = random.Random(10)
    base = [f"w{draw.randrange(3000)}" for _ in range(400)]
    halves = [base[:200] + [f"x{k}_{draw.randrange(9**9)}" for _ in range(60)] + base[260:] for k in range(12)]  # 0.74 to base, less to each other
    texts = [" ".join(x) for h in halves for x in (h, h[:390])]
    kept = {r["doc_id"] for r in simhash_trie.drop(docs(spark, [" ".join(base), *texts])).select("doc_id").collect()}
    assert kept == {0, *range(1, 25, 2)}


@pytest.mark.parametrize("limits", [{"MEET": 4}, {"HOT": 1}, {"ROUND": 3}])
def test_near_copies_in_cut_groups(spark, monkeypatch, limits):
    for k, v in limits.items():  # a group in parts, in more parts than there are tries, tries in rounds
        monkeypatch.setattr(simhash_trie, k, v)
    test_failed_pair_hides_no_other(spark)


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    many = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(many(), False, False, sc._gateway.new_array(sc._jvm.double, 0), many())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_are_not_sent_for_each_trie(spark):
    draw = random.Random(12)
    word = lambda: f"{draw.randrange(36**3):x}"
    texts = []
    for _ in range(10):
        base = [word() for _ in range(1200)]
        texts += [" ".join(base), *(" ".join(base[:500] + [word() for _ in range(180)] + base[680:]) for _ in range(14))]  # all of them proposed, none alike
    before, (_, tries) = shuffled(spark), simhash_trie.tries_for(len(texts))
    assert simhash_trie.drop(docs(spark, texts)).count() == len(texts)
    sets = 8 * sum(len(simhash_trie.shingles(t.encode().split(), 5)) for t in texts)
    assert 2 * sets < shuffled(spark) - before < tries / 2 * sets


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    draw = random.Random(8)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(2000)]) for _ in range(120)) for _ in range(60)]
    toxic = [t.replace("w1", "idiot w1", 3) for t in texts[:15]]
    d = docs(spark, texts + toxic + texts[:5] + ["NULL"]).withColumn("kept", F.lit("mine")).withColumn("toxic", F.lit(7)).withColumn("copy", F.lit(None).cast("int"))
    folder = stored(spark.createDataFrame([(k, 1, int(60 <= k < 75)) for k in range(81)], "doc_id long, quality int, toxic int"), "labels")
    path = folder.inputFiles()[0].rpartition("/")[0]
    where = path.rpartition("/")[0] + "/sf"
    folder.write.mode("overwrite").parquet(f"{where}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near-dedup", "mixing", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = stored(stage(spark, d, where), name.replace(" ", "-"))
        seen.append({r["doc_id"] for r in d.select("doc_id").collect()})
        assert name == "packing" or d.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "toxic", "copy"] and d.filter("kept <> 'mine' OR toxic <> 7 OR copy IS NOT NULL").isEmpty()
    assert not seen[0] & set(range(60, 75)) and set(range(60)) <= seen[0]  # toxic ones go, clean ones stay
    assert seen[1] == seen[0] - set(range(75, 80)) and seen[2] == seen[1] and seen[4] == seen[3] <= seen[2]

from __future__ import annotations

import random

import pytest

from foliospark.operators import best, index, search

TEXTS, QUERIES = "id long, body string", "query_id long, text string"


def compared(spark, texts, queries, kept, most):
    body = spark.createDataFrame(texts, TEXTS)
    cat = spark.createDataFrame([(i,) for i in kept], "id long")
    q, post, stats = search.parsed(spark.createDataFrame(queries, QUERIES)), index.postings(body).cache(), index.doc_stats(body)
    entries = best.lists(body).cache()
    hits, cost = best.best(q, entries, best.maxima(entries), best.prefix_counts(body), stats, post, cat, most)
    got = {(r["query_id"], r["id"], r["rank"], round(r["bm25"], 9)) for r in hits.collect()}
    want = {(r["query_id"], r["id"], r["rank"], round(r["bm25"], 9)) for r in search.content_hits(q, post, stats, cat).collect() if r["rank"] < most}
    assert got == want
    return got, {r["query_id"]: (r["rows"], r["rows_read"]) for r in cost.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_random_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioklrst") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(vocabulary[: rng.choice((5, 60))]) for _ in range(rng.randrange(1, 80)))) for i in range(300)]
    texts += [(1000 + i, texts[0][1]) for i in range(20)] + [(2000, ""), (2001, None)]  # ties, and texts without tokens
    begun = sorted({w[:k] for w in vocabulary for k in (1, 2, 3, 4)})
    queries = [(i, " ".join(rng.choice(begun) for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [(90, "zzz"), (91, ""), (92, "ka-lo"), (93, "te te")]
    got, cost = compared(spark, texts, queries, [i for i, _ in texts if i % 7], 10)
    assert {g[0] for g in got} - {92} and 90 not in cost


def test_few_rows_of_a_frequent_prefix_are_read(spark):
    rng = random.Random(5)
    texts = [(i, "tern " * rng.randrange(1, 9) + "gull " * rng.randrange(0, 200)) for i in range(3000)]
    got, cost = compared(spark, texts, [(1, "ter"), (2, "te gu")], range(3000), 20)
    assert len(got) == 40 and cost[1][0] == 3000 and cost[1][1] < 300 and cost[2][1] < cost[2][0] / 2


def test_nothing(spark):
    assert compared(spark, [], [(1, "te")], [], 5)[0] == compared(spark, [(1, "tern")], [], [1], 5)[0] == set()


def test_lists_and_counts_of_asked_prefixes_are_those_of_all(spark):
    body = spark.createDataFrame([(i, "tern tarn gullery gull gu é étude t" * (i % 3)) for i in range(9)], "id long, body string")
    asked = best.prefixes_of(search.parsed(spark.createDataFrame([(1, "ét gul"), (2, "gull t"), (3, "te")], "query_id long, text string")))
    every, some = ({tuple(r) for r in f.collect()} for f in (best.lists(body), best.lists(body, asked)))
    assert some < every and {r[:2] for r in some} == {(best.BEGUN, p) for p in ("et", "gul", "te")} | {(best.WORD, w) for w in ("gull", "gullery")}
    assert some == {r for r in every if r[:2] in {x[:2] for x in some}}
    every, some = (dict(map(tuple, f.collect())) for f in (best.prefix_counts(body), best.prefix_counts(body, asked)))
    assert some == {p: every[p] for p in ("et", "gul", "gull", "te")}

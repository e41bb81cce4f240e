"""What jobs move: rows that a query doesn't need aren't shuffled, and nothing is run that has nothing to do."""

from __future__ import annotations

from collections import defaultdict

from foliospark.operators import index, search
from foliospark.sources import catalog as c
from foliospark.sources import work
from foliospark.streaming import changes

DATA = "/root/testdata/sf0.001"


def test_a_launcher_without_terms_searches_nothing(spark, monkeypatch):
    monkeypatch.setattr(search, "all_hits", lambda *a: (_ for _ in ()).throw(AssertionError("searched")))
    blank = spark.createDataFrame([(-1, "  "), (-2, "")], "query_id long, text string")
    shown = search.launcher(blank, c.derived(spark, DATA), None, None, c.NOW_MS, 3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in shown) == [(q, k) for q in (-2, -1) for k in (1, 2, 3)]


def test_postings_are_made_where_texts_are_read(spark):
    rows = [(i, "Tern  gull, TERN; é e " * (i % 3)) for i in range(20)]
    made = index.postings(spark.createDataFrame(rows, "id long, body string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["token"]): (r["tf"], list(r["positions"])) for r in made.collect()}
    want = defaultdict(list)
    for i, body in rows:
        for pos, w in enumerate(body.lower().replace("é", "e").replace(",", " ").replace(";", " ").split()):
            want[i, w].append(pos)
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "tern gull"), (2, "tern"), (1, "gull auk"), (None, "auk"), (None, "auk tern"), (3, None), (4, "")]
    got = {(r["id"], r["token"]): (r["tf"], list(r["positions"])) for r in index.postings(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got == {(1, "tern"): (1, [0]), (1, "gull"): (2, [0, 1]), (1, "auk"): (1, [1]), (2, "tern"): (1, [0]), (None, "auk"): (2, [0, 0]), (None, "tern"): (1, [1])}


def test_few_and_many_queries_find_the_same(spark, monkeypatch):
    body = c.table(spark, DATA, "documents").selectExpr("doc_id AS id", "text AS body")
    cat, post, q = c.derived(spark, DATA).cache(), index.postings(body).cache(), search.parsed(c.query_table(spark, DATA)).limit(20)
    both = [search.content_matches, search.candidates]
    few = [sorted(map(tuple, f(q, t).collect())) for f, t in zip(both, (post, cat))]
    plan = search.content_matches(q, post)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and few[0]
    monkeypatch.setattr("foliospark.sources.work.FEW", 0)
    assert [sorted(map(tuple, f(q, t).collect())) for f, t in zip(both, (post, cat))] == few


def test_a_listing_is_read_once_for_a_batch_of_folder_events(spark, monkeypatch):
    rows = "id long, path string, name string, size long, modified_at long"
    known = spark.createDataFrame([(k, f"/r/a/{k}.pdf", f"{k}.pdf", 5, 0) for k in range(6)], rows)
    listing = spark.createDataFrame([(f"/r/a/{k}.pdf", 5 + k % 2, 0) for k in range(8)], "path string, size long, modified_at long")
    ops = spark.createDataFrame([(1, "upsert", "/r/a", None, None, None)], "seq long, op string, path string, path_to string, size long, modified_at long")
    kept = []
    monkeypatch.setattr(changes, "stored", lambda df, name: (kept.append(name), work.stored(df, name))[1])
    out, _ = changes.apply_batch(known, ops, listing)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan and "last-write" in kept
    assert sorted((r["path"], r["size"], r["change"]) for r in out.collect()) == [(f"/r/a/{k}.pdf", 6, "updated") for k in (1, 3, 5)] + [("/r/a/6.pdf", 5, "added"), ("/r/a/7.pdf", 6, "added")]


def test_ids_of_changed_texts_are_sent_to_old_postings(spark):
    body = spark.createDataFrame([(i, f"tern gull {i}") for i in range(20)] + [(None, "auk")], "id long, body string")
    changed = body.selectExpr("id", "CASE WHEN id % 3 = 1 THEN 'New ' || body END AS body").filter("id % 3 < 2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = index.refreshed(index.postings(body), changed)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        got = sorted((r["id"] if r["id"] is not None else -1, r["token"], r["tf"]) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = {-1: "auk"} | {i: f"{'new ' * (i % 3 == 1)}tern gull {i}" for i in range(20) if i % 3}
    assert got == sorted((i, w, 1) for i, t in texts.items() for w in t.split())


def test_equal_queries_are_looked_for_once(spark, monkeypatch):
    monkeypatch.setattr(search, "DEALT", 7)
    rows = [(i, ("wihch", "ohter", "Wihch")[i % 3]) for i in range(30)] + [(None, "wihch")]
    asked = search.parsed(spark.createDataFrame(rows, "query_id long, text string"))
    texts, same = search.each_once(asked)
    assert sorted((r["query_id"], r["phrase"]) for r in texts.collect()) == [(0, "wihch"), (1, "ohter")]
    hits = spark.createDataFrame([(0, id, float(id)) for id in range(5)] + [(1, 9, 2.0)], "query_id long, id long, score double")
    got = sorted(map(tuple, search.for_each(hits, same).select("query_id", "id", "score").collect()))
    assert got == sorted([(q, id, float(id)) for q in range(30) if q % 3 != 1 for id in range(5)] + [(q, 9, 2.0) for q in range(30) if q % 3 == 1])
    assert search.for_each(hits.limit(0), same).count() == 0


GROWING = {"catalog", "doc_stats", "postings", "begun", "name-grams", "path-grams"}


def sent(df, growing=GROWING):
    """Of the tables that grow with the documents those that df's plan reads below a broadcast, unless one row is made of them there."""
    found, below, one_row = set(), None, None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        below, one_row = (None if at is not None and depth <= at else at for at in (below, one_row))
        if below is None and node.startswith("BroadcastExchange"):
            below = depth
        if one_row is None and node.startswith("HashAggregate(keys=[],"):
            one_row = depth
        if below is not None and one_row is None:
            found |= {name for name in growing if f"/{name}-" in node}
    return found


def searched(spark):
    body = c.table(spark, DATA, "documents").selectExpr("doc_id AS id", "text AS body")
    more = spark.createDataFrame([(-1, "  "), (-2, "th"), (-3, "e"), (-4, "wihch")], "query_id long, text string")  # of unknown size to Spark
    asked = search.parsed(c.query_table(spark, DATA).unionByName(more))
    return asked, work.stored(c.derived(spark, DATA), "catalog"), work.stored(index.postings(body), "postings"), work.stored(index.doc_stats(body), "doc_stats")


def test_no_table_of_all_documents_goes_through_the_driver(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        asked, cat, post, stats = searched(spark)
        exact, content = search.exact_hits(asked, cat, c.NOW_MS), search.content_hits(asked, post, stats, cat)
        assert not sent(search.candidates(asked, cat)) and not sent(exact) and not sent(content)
        assert not sent(search.merged(exact, content, cat, c.NOW_MS)) and not sent(search.ranked(exact, cat)) and exact.count()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_queries_with_typos_are_read_once_and_sent_instead_of_names(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        asked, cat, _, _ = searched(spark)
        found = work.stored(search.exact_hits(asked, cat, c.NOW_MS), "found")
        hits = search.fuzzy_hits(search.needy(asked, found), cat, c.NOW_MS)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert not sent(hits) and "/found-" not in plan and "/needy-" in plan and hits.count()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_postings_are_met_by_whole_words(spark, monkeypatch):
    """Queries that share a head don't each look at all postings of that head."""
    plans, rows = {}, [(i, f"tern{i % 4} terns gull") for i in range(12)]
    monkeypatch.setattr(search, "HEADS", 3)
    monkeypatch.setattr(search, "stored", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), work.stored(df, name))[1])
    post = work.stored(index.postings(spark.createDataFrame(rows, "id long, body string")), "postings")
    asked = spark.createDataFrame([(x,) for x in ("tern", "tern1", "te", "g", "gulls")], "begin string")
    got = sorted(map(tuple, search.begun_by(asked, post).collect()))
    assert got == sorted([(b, i, 2) for b in ("tern", "te") for i in range(12)] + [("tern1", i, 1) for i in range(12) if i % 4 == 1] + [("g", i, 1) for i in range(12)])
    assert "Generate" not in plans["begun"] and "SortMergeJoin" not in plans["begun"]

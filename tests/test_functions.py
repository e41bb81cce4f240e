from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliospark.functions import formats, paths, text


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[v.alias(k) for k, v in columns.items()]).collect()]


def osa(a: str, b: str) -> int:
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_osa_distance(spark):
    pairs = [("havrest", "harvest"), ("ca", "abc"), ("", "abc"), ("abc", ""), ("", ""), ("havrest", "ledger"), ("résumé", "resume"), ("a", "a"), ("kitten", "sitting")]
    got = values(spark, pairs, "a string, b string", d=text.osa_distance(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [osa(a, b) for a, b in pairs]


def test_typo_budget_and_edit_match(spark):
    rows = [(["havrest"], "harvest.pdf"), (["arves"], "harvest.pdf"), (["havrest"], "board minutes.pdf"), (["recipess"], "recipes.pdf"), (["registrtaoin"], "kx registration.pdf")]
    got = values(spark, rows, "t array<string>, n string", m=text.edit_match(F.col("t"), F.col("n")))
    assert [g[0] for g in got] == [11.0, 15.0, None, 11.0, 7.0]


def test_trigrams_and_similarity(spark):
    got = values(spark, [("abab",), ("ab",), ("",)], "s string", g=text.trigrams(F.col("s")), k=text.similarity(text.trigrams(F.col("s")), F.lit("xabay")))
    assert got == [(["aba", "bab"], 0.5), ([], 0.0), ([], 0.0)]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 10239, 10240, 1 << 20, (1 << 20) - 1, 3 << 40, 5000 << 40]
    got = values(spark, [(s,) for s in sizes], "s long", h=text.human_size(F.col("s")))
    assert [g[0] for g in got] == ["0 B", "1023 B", "1.0 KB", "10.0 KB", "10 KB", "1.0 MB", "1024 KB", "3.0 TB", "5000 TB"]


def test_relative_time(spark):
    now = 1_000_000_000
    got = values(spark, [(now - 44_000,), (now - 120_000,), (now + 7_200_000,), (now - 86_400_000 * 3,), (1,), (None,), (0,)], "m long", a=text.relative_time(F.col("m"), now))
    assert [tuple(g[0]) if g[0] else None for g in got] == [(0, "now"), (-2, "minute"), (2, "hour"), (-3, "day"), (-12, "day"), None, None]


def test_marked_spans(spark):
    got = values(spark, [("Harvest in HARVEST", ["harvest", "rvest i"]), ("abc", ["x"]), ("a.*b", [".*"])], "t string, q array<string>", m=text.marked_spans(F.col("t"), F.col("q")))
    assert [[tuple(x) for x in g[0]] for g in got] == [[(0, 7), (7, 9), (11, 18)], [], [(1, 3)]]


def test_normalized_text(spark):
    got = values(spark, [("  a\t\n b \u0007c ",), ("word " * 60_000,), ("",), (None,)], "t string", n=text.normalized(F.col("t")))
    assert got[0][0] == "a b c" and 199_990 < len(got[1][0]) <= 200_000 and not got[1][0].endswith(" ") and got[2][0] == "" and got[3][0] is None


@pytest.mark.parametrize(("name", "other"), [("a.tmp", True), ("a.log", True), ("v1.2", False), ("a.PDF", False), ("folder", False), (".gitignore", False), ("x.longext", False), ("a.7z", True)])
def test_other_files(spark, name, other):
    assert values(spark, [(name,)], "n string", o=formats.is_other_file(F.col("n"))) == [(other,)]


def test_formats(spark):
    rows = [("pdf",), ("txt",), ("exe",), ("docx",)]
    got = values(spark, rows, "e string", a=formats.is_enabled(F.col("e")), b=formats.is_enabled(F.col("e"), ("pdf", "zzz"), ("txt",)), k=formats.kind_of(F.col("e")))
    assert got == [(True, False, "pdf"), (False, True, "text"), (False, False, None), (True, True, "word")]


def test_paths(spark):
    rows = [("/a/B/c", "/A/b"), ("/a/bc", "/a/b"), ("/a/b", "/a/b/"), ("/x", "/")]
    assert [g[0] for g in values(spark, rows, "c string, p string", w=paths.is_within(F.col("c"), F.col("p")))] == [True, False, True, True]
    assert [g[0] for g in values(spark, [(" /a/b// ",), ("/",), ("//",), ("a",)], "p string", n=paths.normalize_root(F.col("p")))] == ["/a/b", "/", "/", "a"]
    assert values(spark, [("/a/b/c",)], "p string", a=paths.ancestors(F.col("p")), w=paths.below(F.lit("/a"), F.col("p"))) == [(["/a", "/a/b"], ["b"])]
    low, high = paths.prefix_bounds("/A/b/")
    assert low <= "/a/b/x" < high and not low <= "/a/bc" < high and not low <= "/a/b" < high


def test_normalized_query_keeps_whole_texts(spark, tmp_path):
    from foliospark.plans import search_queries

    rows = [(1, "word  " * 400), (2, "x" * 200_001)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["body"] for r in search_queries.Q["txt1_normalized"](spark, str(tmp_path)).collect()}
    assert got == {1: ("word " * 400).strip(), 2: "x" * 200_000}


def test_distances_within_typos_are_those_of_all_pairs(spark):
    import random

    from foliospark.functions import text as t

    rng, rows = random.Random(7), []
    for _ in range(3000):
        a = "".join(rng.choice("abé中") for _ in range(rng.choice((3, 4, 5, 8, 9, 12))))
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) or 1)
            b[i : i + 2] = rng.choice((b[i : i + 2][::-1], b[i : i + 1], [*b[i : i + 2], "é"], ["x", *b[i + 1 : i + 2]]))
        rows.append((a, "".join(b)))
    df = spark.createDataFrame([*rows, ("abcd", None), ("abcdefgh", ""), ("", "")], "a string, b string")
    all_of = t.osa_distance(df.a, df.b)
    got = df.select(t.within_typos(df.a, df.b).alias("x"), all_of.alias("d"), t.allowed_typos(df.a).alias("k")).collect()
    assert all(r["x"] == (r["d"] if r["d"] is not None and r["d"] <= r["k"] else None) for r in got) and {r["x"] for r in got} == {None, 0, 1, 2}
    plan = df.select(t.within_typos(df.a, df.b))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import aggregates, annotations, browse, duplicates, extraction, index, scope, search, sync, versions
from foliospark.sources import catalog as c
from foliospark.sources.work import stored
from foliospark.streaming import changes

ROW = "id long, path string, name string, ext string, kind string, dir string, size long, modified_at long, is_favourite boolean, open_count long, last_opened_at long"


def catalog(spark, *names, size=10):
    rows = []
    for k, path in enumerate(names, 1):
        folder, _, name = path.rpartition("/")
        rows.append((k, path, name, name.rpartition(".")[2].lower(), None, folder, size, 0, False, 0, None))
    return spark.createDataFrame(rows, ROW)


SOME = ("/x/y/a.pdf", "/x/z/b.docx")
SYLLABLES = ("ka", "lo", "mi", "ter", "ven", "os", "pru", "di", "gan", "sel")


def coined(draw, most=3):
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, most)))


def tree(draw, n):
    """n paths of coined folders and names; half of the words come from a small stock, so that names share some."""
    stock = [coined(draw) for _ in range(12)]
    word = lambda: draw.choice(stock) if draw.random() < 0.5 else coined(draw)
    return [f"/{word()}/{word()}/{draw.choice((' ', '-', '')).join(word() for _ in range(draw.randint(1, 3)))}{k if draw.random() < 0.3 else ''}.pdf" for k in range(n)]


def asked(draw, paths, n):
    """Queries made of pieces of names: prefixes, inner parts, two terms, and words with a swapped, dropped or doubled letter."""
    out = []
    for _ in range(n):
        words_ = draw.choice(paths).rpartition("/")[2][:-4].replace("-", " ").split()
        w = draw.choice(words_)
        how, at = draw.randrange(5), draw.randrange(max(1, len(w) - 1))
        out.append((w[: draw.randint(1, len(w))], w[at:], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :], w[:at] + w[at:at + 1] + w[at:], " ".join(x[: draw.randint(2, 6)] for x in words_))[how])
    return sorted({q for q in out if q.strip()}) + ['"^', "50%", "%_", "   "]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def name_score(terms, path):
    """The relevance of a name and its folder, or None."""
    folder, _, name = path.lower().rpartition("/")
    total = 0.0
    for t in terms:
        at = name.find(t)
        if at < 0 and t not in folder:
            return None
        total += 3 if at < 0 else 13 if at == 0 or not re.match("[0-9A-Za-z]", name[at - 1]) else 8
    phrase, base = " ".join(terms), name.rpartition(".")[0]
    whole = 100 if base == phrase else 60 if base.startswith(phrase) else 40 if phrase in name else 25 if all(t in name for t in terms) else 0
    return 50 + total + whole - min(len(name) / 20, 5)


def typo_score(terms, path):
    """The relevance of a name with typos, or None."""
    name = path.lower().rpartition("/")[2]
    grams = lambda x: {x[k : k + 3] for k in range(len(x) - 2)}
    flat = grams("".join(terms))
    shared = len(flat & grams(name))
    if not shared:
        return None
    allowed = lambda t: 0 if len(t) <= 4 else 1 if len(t) <= 8 else 2
    typos = [0 if t in name else min((d for w in re.findall("[a-z0-9]+", name) if (d := osa(t, w)) <= allowed(t)), default=None) for t in terms]
    return 15 - 4 * sum(typos) if None not in typos else 12 * shared / len(flat) if shared / len(flat) >= 0.75 else None


def text_ranks(terms, texts):
    """Documents whose text has a word that begins with each term, best first."""
    words_ = {i: re.findall(r"\w+", t.lower()) for i, t in texts}
    mean = sum(map(len, words_.values())) / max(1, len(words_))
    if any(len(t) < 2 for t in terms):
        return []
    tf = {t: {i: n for i, ws in words_.items() if (n := sum(w.startswith(t) for w in ws))} for t in terms}
    idf = {t: max(math.log((len(words_) - len(tf[t]) + 0.5) / (len(tf[t]) + 0.5)), 1e-6) for t in terms}
    part = lambda t, i: idf[t] * tf[t][i] * 2.2 / (tf[t][i] + 1.2 * (0.25 + 0.75 * len(words_[i]) / mean))
    both = [i for i in words_ if all(i in tf[t] for t in terms)]
    return sorted(both, key=lambda i: (-round(sum(part(t, i) for t in terms), 9), i))[:300]


def brute_search(query, paths, texts):
    """(id, score) of a query's hits, for a catalog without times, favourites and opens."""
    terms = query.lower().split()
    if not terms:
        return set()
    hits = {k: x for k, p in enumerate(paths, 1) if (x := name_score(terms, p)) is not None}
    ranks = text_ranks(terms, texts) if all(re.fullmatch("[a-z0-9]+", t) for t in terms) else []
    for n, i in enumerate(ranks):
        hits[i] = hits[i] + 10 if i in hits else 25 + 10 * (1 - n / len(ranks))
    if len(hits) < 5 and len(" ".join(terms)) >= 4:
        hits |= {k: x for k, p in enumerate(paths, 1) if k not in hits and (x := typo_score(terms, p)) is not None}
    return {(k, round(x, 6)) for k, x in hits.items()}


@pytest.mark.parametrize("seed", [11, 12])
def test_search_against_brute_force(spark, seed):
    """Names, folders, texts and typos of coined words: hits, scores, order and totals of many queries at once."""
    draw = random.Random(seed)
    paths = tree(draw, 90)
    texts = [(k, " ".join(coined(draw) for _ in range(draw.randrange(1, 30)))) for k in range(1, 91, 3)]
    queries_ = asked(draw, paths, 45)
    cat, body = catalog(spark, *paths), spark.createDataFrame(texts, "id long, body string")
    q = spark.createDataFrame(list(enumerate(queries_)), "query_id long, text string")
    rows = search.search(q, cat, index.postings(body), index.doc_stats(body), 10**12, 1000).collect()
    for k, text in enumerate(queries_):
        own = [r for r in rows if r["query_id"] == k]
        want = brute_search(text, paths, texts)
        assert {(r["id"], round(r["score"], 6)) for r in own} == want, text
        assert [r["id"] for r in sorted(own, key=lambda r: r["rank"])] == [r["id"] for r in sorted(own, key=lambda r: (-r["score"], r["id"]))]
        assert {r["total"] for r in own} <= {len(want)}


def test_typo_hits_exist_in_the_random_trees():
    """The seeds above do reach the third stage, by edits and by shared trigrams."""
    draw = random.Random(11)
    paths = tree(draw, 90)
    found = [typo_score(q.split(), p) for q in asked(draw, paths, 45) if q.split() for p in paths]
    assert any(x in (7, 11) for x in found) and any(x is not None and x < 12 and x not in (7, 11) for x in found)


def test_near_words_against_brute_force(spark):
    """All pairs of words of two letters and many lengths; and what two words have in common that are within two typos."""
    draw = random.Random(3)
    words_ = sorted({"".join(draw.choice("abñ") for _ in range(draw.randint(1, 11))) for _ in range(260)})
    terms_ = words_[::3]
    allowed = lambda t: 0 if len(t) <= 4 else 1 if len(t) <= 8 else 2
    got = search.near_words(spark.createDataFrame([(t,) for t in terms_], "term string"), spark.createDataFrame([(w,) for w in words_], "word string"))
    assert {tuple(r) for r in got.collect()} == {(t, w) for t in terms_ for w in words_ if allowed(t) and osa(t, w) <= allowed(t)}


def test_typo_candidates_are_few(spark):
    """One word in all names: names that share its trigrams alone aren't looked at."""
    cat = catalog(spark, *[f"/d/common {k:03d}lorries.pdf" for k in range(200)], "/d/common terrace.pdf")
    q = search.parsed(spark.createDataFrame([(1, "common terrcae")], "query_id long, text string"))
    q = q.withColumn("grams", text.trigrams(F.replace("phrase", F.lit(" "), F.lit(""))))
    assert [r["id"] for r in search.typo_candidates(q, cat).collect()] == [201] == [r["id"] for r in search.fuzzy_hits(q, cat, 0).collect()]


def test_phrases_and_passages(spark):
    body = spark.createDataFrame([(1, "the upper-lockgate leaks"), (2, "lockgate upper"), (3, "upper locks")], "id long, body string")
    cat = catalog(spark, "/p/one.pdf", "/p/two.pdf", "/p/three.pdf")
    q = spark.createDataFrame([(1, "upper-lock")], "query_id long, text string")
    page = search.search(q, cat, index.postings(body), index.doc_stats(body), 10**12)
    got = {r["id"]: r["snippet"] for r in search.with_snippets(page, search.parsed(q), body).collect()}
    assert set(got) == {1, 3} and got[3] == "\u0002upper\u0003 \u0002locks\u0003"


def test_candidates_by_weight(spark):
    cat = catalog(spark, "/x/barley/one.pdf", "/x/y/barley two.pdf", "/x/y/barley barley.pdf", "/x/y/rye.pdf", "/x/y/oat.pdf", "/x/y/hay.pdf", "/x/y/hop.pdf")
    q = search.parsed(spark.createDataFrame([(1, "barley"), (2, "ba"), (3, "bar zz"), (4, "barley absent")], "query_id long, text string"))
    got = search.capped_by_weight(q, search.candidates(q, cat), cat, 3).collect()
    best = {(r["query_id"], r["n"]): r["id"] for r in got}
    assert [best[1, n] for n in (1, 2, 3)] == [3, 2, 1] and {k[0] for k in best} == {1, 2}  # in a name twice, once, in a folder
    assert all((r["bm25"] is None) == (r["query_id"] == 2) for r in got)
    few = search.capped_by_weight(q, search.candidates(q, cat), cat, 1).collect()
    assert {(r["query_id"], r["id"]) for r in few if r["query_id"] == 1} == {(1, 3)}
    assert search.capped_by_weight(q, search.candidates(q, cat.limit(0)), cat.limit(0)).count() == 0


def test_folder_bounds_reach_the_scan(spark):
    cat = catalog(spark, "/a/B/x.pdf", "/a/b/c/y.pdf", "/a/b.pdf", "/a/bc/z.pdf", "/a/B")
    kept = stored(browse.keyed(cat), "keyed")
    for table in (cat, kept):
        assert {r["id"] for r in browse.under(table, "/A/b/").collect()} == {1, 2}
    assert "GreaterThanOrEqual(path_key" in browse.under(kept, "/A/b/")._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_sync_of_random_listings(spark, seed):
    """Each file of the second listing is as before, grown, touched, renamed in case, new, or no document at all; some files are missing."""
    draw = random.Random(seed)
    first = {f"/v/{coined(draw)}/{coined(draw)}{k}.{draw.choice(('pdf', 'docx', 'xlsx'))}": (draw.randrange(99), draw.randrange(9)) for k in range(120)}
    second, want = {}, Counter()
    for path, (size, at) in first.items():
        what = draw.choice(("same", "same", "updated", "updated", "gone"))
        want[what] += 1
        if what != "gone":
            folder, _, name = path.rpartition("/")
            second[path if what == "same" else draw.choice((path, path, f"{folder}/{name.upper()}"))] = (size, at) if what == "same" else (size + 1, at + draw.randrange(2))
    for k in range(40):
        kind = draw.choice(("added", "lock", "other"))
        want[kind] += 1
        second[{"added": f"/v/{coined(draw)}/n{k}.pdf", "lock": f"/v/~$n{k}.docx", "other": f"/v/n{k}.bin"}[kind]] = (1, 1)
    listing = lambda rows: c.to_records(spark.createDataFrame([(p, *x) for p, x in rows.items()], "path string, size long, modified_at long"))
    known = listing(first).withColumn("id", F.xxhash64("path"))
    count = lambda rows: tuple(sync.summary(sync.diff(sync.snapshot(known), listing(rows))).first())
    assert count(first) == (120, 0, 0, 0)
    assert count(second) == (want["same"] + want["updated"] + want["added"], want["added"], want["updated"], want["gone"])


def test_exclusions(spark):
    rules = scope.compile_exclusions(spark.createDataFrame([("build_cache",), ("/srv/u/Hidden/",), ("/opt",), ("/",), ("  ",)], "pattern string"))
    paths = [("/srv/u/a.pdf", "/srv/u"), ("/srv/u/hidden/x.pdf", "/srv/u"), ("/srv/u/hiddenite/x.pdf", "/srv/u"), ("/srv/u/p/Build_Cache/r/x.pdf", "/srv/u"), ("/srv/u/.old/x.pdf", "/srv/u"), ("/opt/web/x.pdf", "/opt/web"), ("/srv/u/$t/x.pdf", "/srv/u"), ("/srv/u/build_cache", "/srv/u")]
    gone = {r[0] for r in scope.excluded(spark.createDataFrame(paths, "path string, root string"), rules).collect()}
    assert gone == {"/srv/u/hidden/x.pdf", "/srv/u/p/Build_Cache/r/x.pdf", "/srv/u/.old/x.pdf", "/srv/u/$t/x.pdf"}


def test_deepest_root(spark):
    roots = spark.createDataFrame([(1, "/a", True), (2, "/A/b/", True), (3, "/", False)], "id long, path string, enabled boolean")
    got = {r["path"]: r["root_id"] for r in scope.owning_root(spark.createDataFrame([("/a/x",), ("/a/B/c/x",), ("/z",)], "path string"), roots).collect()}
    assert got == {"/a/x": 1, "/a/B/c/x": 2, "/z": None}


def test_change_events(spark):
    """One batch; each case has documents of its own."""
    paths = ["/r/1/Plan.xlsx", "/r/2/Half.xlsx", "/r/3/Safe.xlsx", "/r/4/Move.xlsx", "/r/5/Back.xlsx", "/r/6/Old/Report.pdf", "/r/7/Gone/Report7.pdf", "/r/8/Again.pdf", "/r/9/Lost.xlsx", "/r/10/Kept.pdf"]
    events = [
        ("rename_both", "/r/1/Plan.xlsx", "/r/1/Plan B.xlsx", 10),  # a rename keeps the id
        ("rename_from", "/r/2/Half.xlsx", None, None), ("rename_to", "/r/2/Whole.xlsx", None, 10),  # also in two halves
        ("create", "/r/3/1234.tmp", None, 11), ("rename_from", "/r/3/Safe.xlsx", None, None), ("rename_to", "/r/3/old.tmp", None, 10), ("rename_from", "/r/3/1234.tmp", None, None), ("rename_to", "/r/3/Safe.xlsx", None, 10), ("remove", "/r/3/old.tmp", None, None),  # saved by way of a temporary file
        ("remove", "/r/4/Move.xlsx", None, None), ("create", "/r/4/in/Move.xlsx", None, 10), ("create", "/r/5/in/Back.xlsx", None, 10), ("remove", "/r/5/Back.xlsx", None, None),  # a move, in either order
        ("rename_both", "/r/6/Old", "/r/6/New", None), ("remove", "/r/7/Gone", None, None),  # folders
        ("remove", "/r/8/Again.pdf", None, None), ("create", "/r/8/Again.pdf", None, 10),  # gone and back
        ("rename_both", "/r/9/Lost.xlsx", "/r/9/Lost.bak", 10),  # no document any more
        ("create", "/r/11/In", None, None),  # a folder arrives
        ("create", "/r/12/brief.pdf", None, 1), ("remove", "/r/12", None, None),  # came and went
    ]
    e = spark.createDataFrame([(k, kind, path, to, size, 0) for k, (kind, path, to, size) in enumerate(events)], "seq long, kind string, path string, path_to string, size long, modified_at long")
    files = spark.createDataFrame([("/r/11/In/a.pdf", 1, 1), ("/r/11/In/b/c.docx", 1, 1), ("/r/Other/d.pdf", 1, 1)], "path string, size long, modified_at long")
    cat = catalog(spark, *paths)
    out, applied = changes.apply_batch(cat, changes.to_ops(e.withColumn("batch", F.lit(1)), ("batch",)), files)
    out = stored(out, "changes")
    assert {(r["id"], r["path"], r["change"]) for r in out.collect()} - {(3, "/r/3/Safe.xlsx", "moved")} == {
        (1, "/r/1/Plan B.xlsx", "moved"), (2, "/r/2/Whole.xlsx", "moved"), (4, "/r/4/in/Move.xlsx", "moved"), (5, "/r/5/in/Back.xlsx", "moved"), (6, "/r/6/New/Report.pdf", "moved"),
        (7, "/r/7/Gone/Report7.pdf", "removed"), (9, "/r/9/Lost.xlsx", "removed"), (None, "/r/11/In/a.pdf", "added"), (None, "/r/11/In/b/c.docx", "added"),
    }
    after = {r["id"]: r["path"] for r in changes.updated_catalog(cat, out).collect()}
    assert set(after) == {1, 2, 3, 4, 5, 6, 8, 10, 11, 12} and after[3] == "/r/3/Safe.xlsx" and applied.columns == ["added", "updated", "moved", "removed"]


@pytest.mark.parametrize("head", [4, 64])
def test_duplicates_of_random_contents(spark, head):
    """Contents of two letters and few lengths, so that sizes, heads and whole contents coincide often; sets and spare bytes against a dictionary."""
    draw = random.Random(head)
    data = [(k, bytes(draw.choice(b"ab") for _ in range(draw.choice((0, 1, 4, 5, 6, 9))))) for k in range(200)] + [(500, b"alone in its size")]
    rows = spark.createDataFrame([(k, len(x), 1) for k, x in data], "id long, size long, modified_at long")
    content = spark.createDataFrame([(k, bytearray(x)) for k, x in data], "id long, content binary")
    alike = defaultdict(set)
    for k, x in data:
        alike[x].add(k)
    want = {frozenset(ids) for x, ids in alike.items() if len(ids) > 1 and x}
    hashed = duplicates.with_hashes(rows, content, head=head)
    sets = defaultdict(set)
    for r in duplicates.groups(hashed).collect():
        sets[r["group_id"]].add(r["id"])
    assert {frozenset(x) for x in sets.values()} == want
    assert tuple(duplicates.summary(duplicates.groups(hashed)).first()) == (len(want), sum(len(x) * (len(ids) - 1) for x, ids in alike.items() if len(ids) > 1))
    heads = Counter((len(x), x[:head]) for _, x in data)
    sizes = Counter(len(x) for _, x in data)
    assert {r["id"] for r in hashed.collect()} == {k for k, x in data if x and sizes[len(x)] > 1 and (len(x) <= head or heads[len(x), x[:head]] > 1)}


@pytest.mark.parametrize("few", [0, 1000])
def test_contents_are_hashed_where_they_are_scanned(spark, tmp_path, monkeypatch, few):
    """No exchange carries contents, whether ids are sent to the scan or meet the hashes; of cached documents no whole content is asked for."""
    monkeypatch.setattr(duplicates, "FEW", few)
    data = [(k, b"head" + bytes([k % 3])) for k in range(9)]
    spark.createDataFrame([(k, bytearray(x)) for k, x in data], "id long, content binary").write.parquet(f"{tmp_path}/contents")
    contents, asked = spark.read.parquet(f"{tmp_path}/contents"), []
    hashed_of = duplicates.of_contents

    def watched(contents, ids, value, name):
        out = hashed_of(contents, ids, value, name)
        plan = out._jdf.queryExecution().executedPlan().toString()
        asked.append((name, {r["id"] for r in ids.collect()}))
        moved = [x for part in plan.split("Exchange")[1:] for x in part.split("Scan")[:1] if "content#" in x.split("Project")[0]]
        assert not moved, plan
        return out

    monkeypatch.setattr(duplicates, "of_contents", watched)
    rows = spark.createDataFrame([(k, len(x), 1) for k, x in data], "id long, size long, modified_at long")
    cache = rows.filter("id < 4").select("id", "size", "modified_at", F.concat(F.lit("cached"), F.col("id")).alias("hash"))
    got = {r["id"]: r["hash"] for r in duplicates.with_hashes(rows, contents, cache, head=4).collect()}
    assert set(got) == set(range(9)) and got[2] == "cached2" and got[5] == got[8] and dict(asked) == {"head_hash": set(range(9)), "hash": set(range(4, 9))}


def test_many_duplicate_sets_are_numbered_in_order(spark):
    rows = spark.range(900).select("id", (F.col("id") % 300 % 40 + 1).alias("size"), F.sha2((F.col("id") % 300).cast("string"), 256).alias("hash"), F.lit(1).alias("modified_at"))
    got = sorted({(r["group_id"], -r["size"], r["hash"], r["n"]) for r in duplicates.groups(rows).collect()})
    assert [g[0] for g in got] == list(range(1, 301)) and [g[1:3] for g in got] == sorted(g[1:3] for g in got) and {g[3] for g in got} == {3}


def test_extraction(spark):
    files = [(1, "csv", b"word " * 50_000), (2, "docx", b"x"), (3, "pdf", b"x"), (4, "txt", b"na\xc3\xafve \xff"), (5, "txt", None), (6, None, b"x"), (7, "md", b" \n")]
    got = {r["id"]: (r["status"], r["text"]) for r in extraction.extract(spark.createDataFrame(files, "id long, ext string, content binary")).collect()}
    assert got[2] == got[3] == got[5] == got[6] == (2, None) and got[4] == (1, "na\u00efve \ufffd") and got[7] == (1, "")
    assert got[1][0] == 1 and 199_990 < len(got[1][1]) <= 200_000


def test_markup_references(spark):
    rows = [("a&#66;c &#x2603; &#X1f600;",), ("&#0; &#55296; &#x110000; &#99999999999999;",), ("&amp;#65; &amp;amp; &lt;p&gt;",), ("no reference",), (None,), ("&#00065;&#x000041;",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(extraction.markup_to_text(F.col("h"))).collect()]
    assert got == ["aBc \u2603 \U0001f600", "&#0; &#55296; &#x110000; &#99999999999999;", "&#65; &amp; <p>", "no reference", None, "AA"]


def test_quarantine(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "id long")
    attempts = spark.createDataFrame([], "id long, n int")
    for _ in range(2):
        todo, attempts = extraction.begin(jobs, attempts)
        assert todo.count() == 2
        attempts = extraction.finished(attempts, spark.createDataFrame([(2,)], "id long"))
    todo, attempts = extraction.begin(jobs, attempts)
    assert [r["id"] for r in todo.collect()] == [2] and [r["id"] for r in extraction.quarantined(attempts).collect()] == [1]


def test_tags(spark):
    tags = spark.createDataFrame([(1, "Boat 1987", "brick")], "id long, name string, color string")
    made = annotations.create_tags(tags, spark.createDataFrame([(1, "  boat   1987 "), (2, "New"), (3, " "), (4, "new")], "seq long, name string"))
    assert {tuple(r) for r in made.collect()} == {(1, "Boat 1987", "brick", False), (2, "New", "slate", True)}
    bridge = spark.createDataFrame([(7, 1)], "file_id long, tag_id long")
    edits = spark.createDataFrame([(1, 7, 1, True), (2, 8, 1, True), (3, 8, 1, True), (4, 7, 1, False)], "seq long, file_id long, tag_id long, on boolean")
    assert {tuple(r) for r in annotations.set_tags(bridge, edits).collect()} == {(8, 1)}
    left, links = annotations.delete_tag(tags, bridge, 1)
    assert left.count() == 0 and links.count() == 0


def test_pages_and_totals_of_empty_catalog(spark):
    none = catalog(spark, *SOME).filter("id < 0")
    assert tuple(aggregates.totals(none).first()[:4]) == (0, 0, 0, 0) and browse.page(none, browse.sort_key("name", False)).count() == 0
    assert browse.page(catalog(spark, *SOME), browse.sort_key("name", False), 0, -3).count() == 1


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.current(spark, path) is None
    assert versions.commit(spark.range(3), path, 1) and not versions.commit(spark.range(9), path, 1)
    assert versions.commit(spark.range(5), path, 2) and versions.current(spark, path).count() == 5


def test_text_store(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, body string")
    new = spark.createDataFrame([(1, "b b"), (2, None), (3, "d")], "id long, body string")
    assert {tuple(r) for r in index.set_texts(old, new).collect()} == {(1, "b b"), (3, "d")}
    assert {(r["id"], r["token"], r["tf"]) for r in index.refreshed(index.postings(old), new).collect()} == {(1, "b", 2), (3, "d", 1)}

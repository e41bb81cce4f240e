from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import versions
from foliospark.operators.numbering import numbered
from foliospark.streaming import reconcile

CATALOG = "id long, path string, name string, ext string, kind string, dir string, root_id long, size long, modified_at long, content_status int, hash string, last_seen_at long"
LISTING = "path string, name string, ext string, kind string, dir string, size long, modified_at long"


def row(path, size):
    folder, _, name = path.rpartition("/")
    return path, name, name.rpartition(".")[2], "pdf", folder, size, 1


def test_lost_events_bring_their_roots_in_step(spark, tmp_path):
    table = f"file://{tmp_path}/catalog"
    old = [(1, "/A/same.pdf", 1, 5), (2, "/A/grown.pdf", 1, 5), (3, "/A/gone.pdf", 1, 5), (9, "/B/other.pdf", 2, 5)]
    cat = spark.createDataFrame([(i, *row(p, size)[:5], root, size, 1, 1, f"h{i}", 0) for i, p, root, size in old], CATALOG)
    versions.commit(cat, table, 0)
    roots = spark.createDataFrame([(1, "/A", True), (2, "/B", True), (3, "/C", False)], "id long, path string, enabled boolean")
    seen = [row("/A/SAME.pdf", 5), row("/A/grown.pdf", 6), row("/A/b.pdf", 7), row("/A/a.pdf", 8), row("/B/new.pdf", 1), row("/C/x.pdf", 1)]
    asked = []

    def listing(flagged):
        asked.append(sorted(r["path"] for r in flagged.collect()))
        return spark.createDataFrame(seen[: len(seen) if len(asked) == 1 else 1], LISTING)

    run = reconcile.on_batch(table, roots, listing, 77)
    event = lambda kind, path: spark.createDataFrame([(kind, path)], "kind string, path string")
    run(event("create", "/A/q.pdf"), 0)
    assert asked == [] and versions.current(spark, table).count() == 4
    for _ in range(2):  # the second time nothing happens, whatever a walk would see now
        run(event("lost", "/a/deep/in"), 1)
        got = {(r["id"], r["path"], r["size"], r["content_status"], r["hash"], r["last_seen_at"]) for r in versions.current(spark, table).collect()}
        assert got == {(1, "/A/same.pdf", 5, 1, "h1", 77), (2, "/A/grown.pdf", 6, 0, None, 77), (9, "/B/other.pdf", 5, 1, "h9", 0), (10, "/A/a.pdf", 8, 0, None, 77), (11, "/A/b.pdf", 7, 0, None, 77)}
    assert asked[0] == ["/A"]
    run(event("lost", None), 2)  # no path: all enabled roots
    assert asked[-1] == ["/A", "/B"]


def test_numbers_go_on_over_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    got = {(r["x"], r["nth"]) for r in numbered(rows, F.desc("x")).collect()}
    assert got == {(x, 500 - x) for x in range(500)} and numbered(rows.limit(0), F.desc("x")).count() == 0

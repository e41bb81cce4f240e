"""Change events applied to a catalog, keeping documents' identity.

Events have seq (arrival number, which decides the order), kind (create, modify, remove, rename_from, rename_to, rename_both, access, other, lost), path,
path_to, size and modified_at. A micro-batch is applied as sets, not event by event: documents follow the renames along their path, the last
removal and the last write of each path decide, and a document that vanished and one that appeared with equal name and size in one batch are the same. Paths are
exploded to their folders wherever a folder's event reaches everything below it, so all joins are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import extension, is_enabled, is_lock_file, is_other_file, kind_of
from ..functions.paths import parent, with_ancestors
from ..operators.numbering import numbered
from ..operators.scope import in_scope
from ..sources.work import few, stored

WRITES, RENAMES = ("create", "modify"), ("rename_from", "rename_to", "rename_both")


def relevant(events: DataFrame, roots: DataFrame, rules: DataFrame) -> DataFrame:
    """Without accesses and unknown events, other file types and paths out of scope; a rename stays if either of its paths is in scope."""
    rows = events.filter(F.col("kind").isin(*WRITES, *RENAMES, "remove", "lost"))
    rows = rows.filter(F.col("kind").isin(*RENAMES, "lost") | ~is_other_file(F.regexp_extract("path", "([^/]*)$", 1)))
    paths = rows.select("path").unionByName(rows.select(F.col("path_to").alias("path"))).filter("path IS NOT NULL").distinct()
    inside = in_scope(paths, roots, rules).select("path")
    hit = rows.select("seq", F.explode(F.array_compact(F.array("path", "path_to"))).alias("path")).join(inside, "path", "left_semi").select("seq").distinct()
    return rows.join(hit, "seq", "left_semi")


def to_ops(events: DataFrame, batch: tuple[str, ...]) -> DataFrame:
    """seq, op (upsert, remove, rename), path, path_to, size, modified_at. A rename_from pairs with the next rename event if that is a rename_to; alone it is a removal, and a lone rename_to an upsert. batch: columns that tell batches apart; halves pair within one."""
    w = Window.partitionBy(*[F.col(c) for c in batch]).orderBy("seq")
    keep = [F.col(c) for c in batch]
    halves = events.filter(F.col("kind").isin("rename_from", "rename_to"))
    near = halves.select("*", F.lead(F.struct("kind", "path", "size", "modified_at")).over(w).alias("after"), F.lag("kind").over(w).alias("before"))
    paired = F.col("after.kind") == "rename_to"
    froms = near.filter("kind = 'rename_from'").select(*keep, "seq", F.when(paired, "rename").otherwise("remove").alias("op"), "path", F.when(paired, F.col("after.path")).alias("path_to"), F.when(paired, F.col("after.size")).alias("size"), F.when(paired, F.col("after.modified_at")).alias("modified_at"))
    tos = near.filter("kind = 'rename_to' AND NOT before <=> 'rename_from'").select(*keep, "seq", F.lit("upsert").alias("op"), "path", F.lit(None).cast("string").alias("path_to"), "size", "modified_at")
    op = F.when(F.col("kind").isin(*WRITES), "upsert").when(F.col("kind") == "remove", "remove").otherwise("rename")
    plain = events.filter(F.col("kind").isin(*WRITES, "remove", "rename_both")).select(*keep, "seq", op.alias("op"), "path", F.when(F.col("kind") == "rename_both", F.col("path_to")).alias("path_to"), "size", "modified_at")
    return plain.unionByName(froms).unionByName(tos)


def _is_document(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return is_enabled(extension(name), opted_in=("txt", "md")) & ~is_lock_file(name)


def move_prefix(catalog: DataFrame, source: str, target: str) -> DataFrame:
    """A folder was renamed: path and dir of everything inside are rewritten, ids stay."""
    inside = F.startswith(F.lower("path"), F.lit(source.lower().rstrip("/") + "/"))
    cut = len(source.rstrip("/")) + 1
    new = F.concat(F.lit(target.rstrip("/")), F.substring("path", cut, 1 << 30))
    return catalog.withColumn("path", F.when(inside, new).otherwise(F.col("path"))).withColumn("dir", parent(F.col("path")))


def follow_renames(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """id, path, since: where each document (id, path) is after the renames (seq, path, path_to) of itself or a folder around it, and the last one's seq. One round per rename that a document goes through."""
    at = rows.select("id", "path", F.lit(-1).cast("long").alias("since"))
    moves, _ = few(renames.select(F.col("seq").alias("m_seq"), F.lower("path").alias("m_from"), F.col("path").alias("m_path"), "path_to"), "moves")
    done: DataFrame | None = None
    while True:
        each = at.withColumn("m_from", F.explode(with_ancestors(F.lower("path"))))
        hit = each.join(moves, "m_from").filter("m_seq > since").groupBy("id").agg(F.min_by(F.struct("m_seq", "path", "since", F.length("m_path").alias("cut"), "path_to"), "m_seq").alias("m"))
        moved = hit.select("id", F.concat("m.path_to", F.expr("substring(m.path, m.cut + 1)")).alias("path"), F.col("m.m_seq").alias("since"))
        moved = stored(moved, "moved")
        rest = at.join(moved.select("id"), "id", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if moved.isEmpty():
            return done
        at = moved


def apply_batch(catalog: DataFrame, ops: DataFrame, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, applied): changes has id (null for new documents), path, name, ext, kind, dir, size, modified_at, change (moved, updated, added, removed), for the documents that the batch touches; applied counts them.

    ops: of to_ops(), in scope. Writes of folders (paths in listing's folders) bring everything below them, from listing (path, size, modified_at).
    """
    ops, known = stored(ops, "ops"), stored(catalog.select("id", "path", "name", "size", "modified_at"), "known")
    writes = ops.filter("op = 'upsert'").select("seq", "path", "size", "modified_at")
    renames, removes = ops.filter("op = 'rename'"), ops.filter("op = 'remove'").select("seq", "path")
    renamed, _ = few(renames.select(F.lower("path").alias("key")).distinct(), "renamed")  # few paths are sent to the catalog, which is exploded to folders where it is read
    # A rename whose source isn't known is a write of its target.
    sources = known.select(F.explode(with_ancestors(F.lower("path"))).alias("key")).join(renamed, "key", "left_semi").distinct()
    unknown = renames.withColumn("key", F.lower("path")).join(sources, "key", "left_anti").select("seq", F.col("path_to").alias("path"), "size", "modified_at")
    writes = writes.unionByName(unknown)
    if listing is not None:
        below = listing.select(F.col("path").alias("l_path"), F.col("size").alias("l_size"), F.col("modified_at").alias("l_at"), F.explode(with_ancestors(F.lower("path"))).alias("key"))
        written, _ = few(writes.select("seq", F.lower("path").alias("key")), "written")
        writes = writes.unionByName(written.join(below, "key").select("seq", F.col("l_path").alias("path"), F.col("l_size").alias("size"), F.col("l_at").alias("modified_at")))
    last_write = writes.filter(_is_document(F.col("path"))).groupBy(F.lower("path").alias("key")).agg(F.max("seq").alias("w_seq"), F.max_by(F.struct("path", "size", "modified_at"), "seq").alias("w"))
    last_write = stored(last_write, "last-write")  # read by several joins; a listing is derived once
    now = follow_renames(known, renames)
    placed = known.select("id", F.col("path").alias("old_path"), F.col("name").alias("old_name"), F.col("size").alias("old_size"), F.col("modified_at").alias("old_at")).join(now, "id").withColumn("key", F.lower("path"))
    gone_at, _ = few(removes.groupBy(F.lower("path").alias("folder")).agg(F.max("seq").alias("r_seq")), "gone")

    def removal(rows: DataFrame) -> DataFrame:
        """key, r_seq: the last removal of the path or a folder around it."""
        return rows.select("key").distinct().withColumn("folder", F.explode(with_ancestors(F.col("key")))).join(gone_at, "folder").groupBy("key").agg(F.max("r_seq").alias("r_seq"))

    docs = placed.join(removal(placed), "key", "left").join(last_write, "key", "left")
    written = F.coalesce(F.col("w_seq") > F.greatest("since", F.coalesce("r_seq", F.lit(-1))), F.lit(False))
    is_gone = (F.coalesce("r_seq", F.lit(-1)) > F.col("since")) & ~written | ~_is_document(F.col("path"))
    docs = docs.withColumns({"is_gone": is_gone, "new_path": F.when(written, F.col("w.path")).otherwise(F.col("path")), "size": F.when(written, F.col("w.size")).otherwise(F.col("old_size")), "modified_at": F.when(written, F.col("w.modified_at")).otherwise(F.col("old_at"))})
    taken = docs.filter("NOT is_gone").select("key")
    fresh = last_write.join(taken, "key", "left_anti")
    fresh = fresh.join(removal(fresh), "key", "left").filter(F.coalesce("r_seq", F.lit(-1)) < F.col("w_seq")).select("w.*")
    # Deferred deletes: what is gone may have turned up elsewhere under the same name and size.
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    pair = lambda order: F.row_number().over(Window.partitionBy("m_name", "m_size").orderBy(order))
    lost = docs.filter("is_gone").select("id", "old_path", F.lower("old_name").alias("m_name"), F.col("old_size").alias("m_size")).withColumn("nth", pair("old_path"))
    came = fresh.select("*", F.lower(name("path")).alias("m_name"), F.col("size").alias("m_size")).withColumn("nth", pair("path"))
    claimed = came.join(lost, ["m_name", "m_size", "nth"], "left")
    kept = docs.filter("NOT is_gone")
    same = F.col("new_path").eqNullSafe(F.col("old_path")) & F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified_at").eqNullSafe(F.col("old_at"))
    change = F.when(F.col("new_path") != F.col("old_path"), "moved").otherwise("updated")
    touched = kept.filter(~same).select("id", F.col("new_path").alias("path"), "size", "modified_at", change.alias("change"))
    arrived = claimed.select("id", "path", "size", "modified_at", F.when(F.col("id").isNotNull(), "moved").otherwise("added").alias("change"))
    dropped = lost.join(claimed.filter("id IS NOT NULL").select("id"), "id", "left_anti").select("id", F.col("old_path").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("modified_at"), F.lit("removed").alias("change"))
    out = touched.unionByName(arrived).unionByName(dropped)
    out = out.withColumns({"name": name("path"), "dir": parent(F.col("path"))}).withColumn("ext", extension(F.col("name"))).withColumn("kind", kind_of(F.col("ext")))
    applied = out.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "moved", "removed")])
    return out, applied


def updated_catalog(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog's listing columns after a batch. New documents are numbered after the largest id, by path."""
    cols = ["id", "path", "name", "ext", "kind", "dir", "size", "modified_at"]
    rest = catalog.select(*cols).join(changes.filter("id IS NOT NULL").select("id"), "id", "left_anti")
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = numbered(changes.filter("change = 'added'"), F.col("path")).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("nth"))
    return rest.unionByName(changes.filter("change IN ('moved', 'updated')").select(*cols)).unionByName(new.select(*cols))


def lost_roots(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots that need a full reconcile, as events around them were lost: a path's own root, or all roots where the path is null."""
    lost = events.filter("kind = 'lost'")
    up = lost.filter("path IS NOT NULL").select(F.explode(with_ancestors(F.lower("path"))).alias("key")).distinct()
    every = lost.filter("path IS NULL").select(F.lit(1).alias("one")).limit(1)
    named = roots.withColumn("key", F.lower("path")).join(up, "key", "left_semi").drop("key")
    return named.unionByName(roots.crossJoin(F.broadcast(every)).drop("one")).distinct()  # at most one row


def latest(events: DataFrame) -> DataFrame:
    """For a stream or a table: each path's last event by seq. As a stream it keeps one row of state per path and emits changed paths."""
    return events.groupBy(F.lower("path").alias("path_key")).agg(F.max_by(F.struct("seq", "kind", "path", "size", "modified_at"), "seq").alias("last")).select("path_key", "last.*")


def open_counts(opens: DataFrame) -> DataFrame:
    """For a stream or a table of opens: file_id, open_count, last_opened_at."""
    return opens.groupBy("file_id").agg(F.count("*").alias("open_count"), F.max("at").alias("last_opened_at"))


def run_stream(events: DataFrame, checkpoint: str, on_batch) -> None:
    """All available events of a stream through on_batch(batch, batch_id), once each: the batch's number makes retries harmless for writers that remember it."""
    events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Lost events start a reconcile: the roots around them are brought in step with a fresh listing, the others stay as they are.

The catalog is a versioned table, and the version that a micro-batch makes carries the batch's number: a batch that is run again finds its version and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scope, sync, versions
from ..operators.numbering import numbered
from .changes import lost_roots


def reconciled(catalog: DataFrame, listing: DataFrame, flagged: DataFrame, now_ms: int) -> DataFrame:
    """catalog after the flagged roots (id, path, enabled) were walked again: known documents refreshed, what wasn't seen again gone, new ones numbered by path after the largest id.

    catalog: columns of the listing and id, root_id, content_status, hash, last_seen_at; annotations are kept by id elsewhere. Rows of other roots are passed through.
    """
    few = F.broadcast(flagged.select(F.col("id").alias("root_id")))  # what people set up by hand
    seen = scope.owning_root(listing.drop("root_id", "root"), flagged).filter("root_id IS NOT NULL")
    known, others = catalog.join(few, "root_id", "left_semi"), catalog.join(few, "root_id", "left_anti")
    changed = sync.upsert_on_path(known, seen, now_ms)
    names = [c for c in changed.columns if c not in ("id", "outcome")]
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = numbered(changed.filter("outcome = 'added'").select(*names), F.lower("path"), F.col("path"))
    new = new.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("nth")).alias("id"), *names)  # one row
    return others.select("id", *names).unionByName(changed.filter("outcome = 'updated'").select("id", *names)).unionByName(new)


def on_batch(table: str, roots: DataFrame, listing: Callable[[DataFrame], DataFrame], now_ms: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of events: reconciles the roots that the batch's lost events flag. table: a versioned catalog, with a version 0; listing: what a walk of the given roots sees now."""

    def run(batch: DataFrame, number: int) -> None:
        spark, events = batch.sparkSession, batch.filter("kind = 'lost'").select("kind", "path")
        if events.isEmpty():
            return
        flagged = lost_roots(events, roots.filter("enabled"))
        versions.commit(reconciled(versions.current(spark, table), listing(flagged), flagged, now_ms), table, number + 1)

    return run

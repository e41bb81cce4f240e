"""Locations, exclusions and formats: which paths belong to the catalog.

Rules are tables that users write by hand. Where a rule table meets a table of paths, the paths are exploded to their folders first, so that the
join is an equi-join on a folder's lower-case path or name and Spark picks its form from the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import is_enabled
from ..functions.paths import SEP, is_within, normalize_root, parent, with_ancestors


def compile_exclusions(patterns: DataFrame) -> DataFrame:
    """pattern -> rule (lower case, no separator at the end) and is_path: path rules have a separator, the others are names of folders. The root alone and empty patterns are left out."""
    rule = F.lower(F.regexp_replace(F.trim("pattern"), "/+$", ""))
    return patterns.select(rule.alias("rule"), F.contains(rule, F.lit(SEP)).alias("is_path")).filter("rule <> ''").distinct()


def folders(dirs: DataFrame) -> DataFrame:
    """dirs (dir, root) with each folder strictly below the root, down to dir itself: folder, folder_name."""
    each = dirs.withColumn("folder", F.explode(with_ancestors(F.col("dir"))))
    inside = is_within(F.col("folder"), F.col("root")) & (F.length("folder") > F.length(F.regexp_replace("root", "/+$", "")))
    return each.filter(inside).withColumn("folder_name", F.regexp_extract("folder", "([^/]*)$", 1))


def excluded_dirs(dirs: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct dir, root of those in an excluded folder below their root. A path rule that covers the root itself doesn't count there: a rule equal to a folder below the root can't cover the root."""
    key = lambda is_path, c: F.struct(F.lit(is_path).alias("is_path"), F.lower(c).alias("rule"))
    each = folders(dirs.select("dir", "root").distinct()).withColumn("is_hidden", F.startswith("folder_name", F.lit("$")) | F.startswith("folder_name", F.lit(".")))
    keyed = each.select("dir", "root", "is_hidden", F.inline(F.array(key(True, "folder"), key(False, "folder_name"))))
    hit = keyed.join(rules.select("is_path", "rule", F.lit(True).alias("is_ruled")), ["is_path", "rule"], "left")
    return hit.filter("is_hidden OR is_ruled").select("dir", "root").distinct()


def excluded(paths: DataFrame, rules: DataFrame, root_col: str = "root", path_col: str = "path") -> DataFrame:
    """Distinct path of those with an excluded folder between their root and their last part. Rules meet the distinct folders, not the paths."""
    each = paths.select(F.col(path_col).alias("path"), F.col(root_col).alias("root"), parent(F.col(path_col)).alias("dir"))
    return each.join(excluded_dirs(each, rules), ["dir", "root"], "left_semi").select("path").distinct()


def owning_root(paths: DataFrame, roots: DataFrame, path_col: str = "path") -> DataFrame:
    """paths with root_id and root of the deepest enabled root around each (null without one). Roots meet the distinct folders, and paths that are roots themselves."""
    root = F.struct(F.col("id").alias("root_id"), F.col("path").alias("root"))
    known = roots.filter("enabled").groupBy(F.lower(F.regexp_replace("path", "/+$", "")).alias("_f")).agg(F.max(root).alias("_r"))
    dirs = paths.select(parent(F.col(path_col)).alias("_d")).distinct()
    each = dirs.withColumn("_f", F.explode(F.array_prepend(with_ancestors(F.lower("_d")), F.lit(""))))  # "" is the bare root
    around = each.join(known, "_f").groupBy("_d").agg(F.max_by("_r", F.length("_f")).alias("_around"))
    itself = known.select(F.col("_f").alias("_self"), F.col("_r").alias("_own"))
    met = paths.join(around, parent(F.col(path_col)) == F.col("_d"), "left").join(itself, F.lower(F.regexp_replace(path_col, "/+$", "")) == F.col("_self"), "left")
    best = F.coalesce("_own", "_around")
    return met.select(*[F.col(f"`{c}`") for c in paths.columns], best["root_id"].alias("root_id"), best["root"].alias("root"))


def in_scope(paths: DataFrame, roots: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows of paths that have a root and no excluded folder below it, with root_id and root."""
    owned = owning_root(paths, roots, path_col).filter("root_id IS NOT NULL")
    gone = excluded_dirs(owned.select(parent(F.col(path_col)).alias("dir"), "root"), rules).select(F.col("dir").alias("_dir"), F.col("root").alias("_root"))
    return owned.join(gone, (parent(F.col(path_col)) == F.col("_dir")) & (F.col("root") == F.col("_root")), "left_anti")


def admit_roots(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Of the new paths: path (normalised) and what becomes of each, covered (by the existing root covered_by) or added; and of existing roots, replaced (by the new path around them)."""
    fresh = new.select(normalize_root(F.col("path")).alias("path")).filter("path <> ''").distinct()
    old = roots.select("id", F.col("path").alias("old"))
    up = fresh.withColumn("f", F.explode(with_ancestors(F.lower("path"))))
    covers = up.join(old.withColumn("f", F.lower("old")), "f").groupBy("path").agg(F.max_by("old", F.length("old")).alias("by"))
    judged = fresh.join(covers, "path", "left").select("path", F.when(F.col("by").isNotNull(), "covered").otherwise("added").alias("outcome"), "by")
    added = judged.filter("outcome = 'added'").select(F.col("path").alias("parent"))
    inner = old.withColumn("f", F.explode(with_ancestors(F.lower("old")))).join(added.withColumn("f", F.lower("parent")), "f").groupBy("id", "old").agg(F.min_by("parent", F.length("parent")).alias("by"))
    return judged.unionByName(inner.select(F.col("old").alias("path"), F.lit("replaced").alias("outcome"), "by"))


def without_root(catalog: DataFrame, roots: DataFrame, root_id: int) -> tuple[DataFrame, DataFrame]:
    """The root and its documents are gone."""
    return catalog.filter(~F.col("root_id").eqNullSafe(root_id)), roots.filter(F.col("id") != root_id)


def set_enabled(roots: DataFrame, root_id: int, enabled: bool) -> DataFrame:
    """A paused root keeps its documents; scans pass it by."""
    return roots.withColumn("enabled", F.when(F.col("id") == root_id, F.lit(enabled)).otherwise(F.col("enabled")))


def excludable(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth, folder: the folders below a document's root down to its own, outermost first."""
    owned = owning_root(catalog.select("id", "dir"), roots.withColumn("enabled", F.lit(True)), "dir").filter("root_id IS NOT NULL")
    inside = F.filter(with_ancestors(F.regexp_replace("dir", "/+$", "")), lambda f: F.length(f) > F.length(F.regexp_replace(F.col("root"), "/+$", "")))
    return owned.select("id", F.posexplode(inside).alias("depth", "folder"))


def no_longer_covered(catalog: DataFrame, roots: DataFrame, rules: DataFrame, disabled: tuple[str, ...] = (), opted_in: tuple[str, ...] = ()) -> DataFrame:
    """id of documents whose format is off or that now lie in an excluded folder. Documents outside all roots go for their format alone."""
    off = catalog.filter(~is_enabled(F.col("ext"), disabled, opted_in)).select("id")
    owned = owning_root(catalog.select("id", "path"), roots.withColumn("enabled", F.lit(True))).filter("root_id IS NOT NULL")
    hidden = owned.join(excluded(owned, rules), "path", "left_semi").select("id")
    return off.unionByName(hidden).distinct()

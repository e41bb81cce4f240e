"""Paths as column expressions. Paths are kept as written and compared in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "/"


def normalize_root(path: Column) -> Column:
    """Trimmed, without separators at the end; the bare root stays."""
    trimmed = F.trim(path)
    cut = F.regexp_replace(trimmed, "/+$", "")
    return F.when((cut == "") & F.startswith(trimmed, F.lit(SEP)), F.lit(SEP)).otherwise(cut)


def is_within(child: Column, parent: Column) -> Column:
    """The folder itself or anything inside it, whatever the case."""
    c, p = F.lower(child), F.regexp_replace(F.lower(parent), "/+$", "")
    return (c == p) | F.startswith(c, F.concat(p, F.lit(SEP)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every proper prefix of whole folders, outermost first: /a/b/c gives /a, /a/b. Turns prefix joins into equi-joins."""
    parts = F.split(path, SEP)
    inner = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda n: F.array_join(F.slice(parts, 1, n), SEP))


def with_ancestors(path: Column) -> Column:
    return F.array_append(ancestors(path), path)


def below(root: Column, path: Column) -> Column:
    """Of a path inside root: the names of the folders strictly between root and its last part."""
    rest = F.filter(F.split(F.substring(path, F.length(F.regexp_replace(root, "/+$", "")) + 2, 1 << 30), SEP), lambda x: x != "")
    return F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))


def prefix_bounds(folder: str) -> tuple[str, str]:
    """low <= key < high holds for exactly the lower-case paths inside the folder; a stored lower-case path column lets the scan skip by them."""
    low = folder.lower().rstrip(SEP) + SEP
    return low, low[:-1] + chr(ord(SEP) + 1)

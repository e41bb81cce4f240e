"""URL filters by a Bloom filter cascade.

A list of keys is encoded against the complete key universe of the corpus. The first Bloom filter holds the listed keys; those unlisted keys that it
takes for listed ones go into a second filter, the listed keys that this one takes for such go into a third, and so on until a level has no
false positive. A key of the universe is listed if the first level that doesn't hold it is of odd number (from 0), so membership is exact, and judging
a table of keys needs no join: the cascade is broadcast.

Only listed keys and the first level's false positives are ever shuffled; the other keys of the universe are probed where they are. A level has ``BITS`` bits for each
key it holds, so a cascade's size follows from the number of listed keys. Keys are dealt by hash into as many shards as keep a shard's first level within
``max_bytes``; a shard is a cascade of its own, and each row is held against its key's shard. With more than one, shards are built and applied one after another, so that
driver and executors hold one at a time. Levels are built by Spark: keys are hashed natively, tasks set bits in partial bitmaps, which are merged
by pieces.

Rules on hosts and paths come before the list: the longest rule that fits decides.

Edge cases: a null url, or one without ://, has an empty host and path, and the empty key; null keys are in no list; keys may be listed or occur more than
once; keys outside the universe that was given may be judged wrongly (that is the method's premise); empty tables give empty tables; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, discard, stored, unboxed, without

BITS, PROBES, PIECE = 8, 5, 1 << 16
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ADDED = ("host", "path", "rule", "verdict")


class Level(NamedTuple):
    size: int
    bits: np.ndarray  # uint8

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = probes(h1, h2, self.size)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def probes(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Double hashing: PROBES places for each key."""
    return ((h1.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * (h2.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _hashes(key: Column, level: int) -> list[Column]:
    """Two hashes of a level. The number comes first: it seeds the key's hash, so keys that are alike in one level's bits are not so in the next one's."""
    return [F.xxhash64(F.lit(2 * level), key).alias("h1"), F.xxhash64(F.lit(2 * level + 1), key).alias("h2")]


def _bitmap(keys: DataFrame, size: int) -> np.ndarray:
    """Of h1, h2: the filter's bytes. Each task makes one bitmap of the checked size; pieces are or-ed where they meet."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(-(-size // 8), np.uint8)
        for b in batches:
            at = probes(b.column(0).to_numpy(), b.column(1).to_numpy(), size).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(bits), PIECE):
            if bits[k : k + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits[k : k + PIECE].tobytes()], pa.binary())], ["piece", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(x, np.uint8)
                held[k] = held[k] | new if k in held else new
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["piece", "bits"])

    schema = "piece long, bits binary"
    bits = np.zeros(-(-size // 8), np.uint8)
    for r in keys.mapInArrow(fill, schema).repartition("piece").mapInArrow(merge, schema).collect():
        bits[r["piece"] : r["piece"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _held_by(levels: list[Level], first: int, columns: list[tuple[Column, Column]]) -> Column:
    """How many of the levels from first on hold the key, one after another (stops at the first that doesn't)."""

    @F.pandas_udf("int")
    def count(*hashes):
        import pandas as pd

        n, alive = np.zeros(len(hashes[0]), np.int32), np.ones(len(hashes[0]), bool)
        for k, level in enumerate(levels):
            alive &= level.holds(hashes[2 * k].to_numpy(), hashes[2 * k + 1].to_numpy())
            n += alive
        return pd.Series(n)

    return count(*[h for pair in columns for h in pair])


def cascade(universe: DataFrame, listed: DataFrame, key: str = "key") -> list[Level]:
    """The levels for the listed keys against the universe's (repeated and null keys are allowed in both)."""
    names = listed.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    keys = universe.select(F.col(key).alias("key")).filter("key IS NOT NULL")
    inside = kept = stored(names, "listed")
    outside: DataFrame | None = None
    used, levels = [kept], []
    while n := inside.count():
        hashes, size = _hashes(F.col("key"), len(levels)), max(64, n * BITS)
        level = Level(size, _bitmap(inside.select(*hashes), size))
        held = _held_by([level], len(levels), [tuple(hashes)]) == 1
        wrong = stored(keys.filter(held).distinct().join(kept, "key", "left_anti") if outside is None else outside.filter(held), f"level{len(levels)}")
        levels.append(level)
        used.append(wrong)
        inside, outside = wrong, inside
    discard(*used)
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    if not levels:
        return F.lit(False)
    return key.isNotNull() & (_held_by(levels, 0, [tuple(_hashes(key, k)) for k in range(len(levels))]) % 2 == 1)


def mark_listed(rows: DataFrame, listed: DataFrame, key: str, out: str, max_bytes: int = 1 << 26) -> DataFrame:
    """rows (whose keys are the universe) with a boolean column out."""
    names = stored(listed.select(F.col(key).alias(key)).filter(F.col(key).isNotNull()).distinct(), "names")
    shards = max(1, -(-names.count() * BITS // (8 * max_bytes)))
    if shards == 1:
        marked = rows.withColumn(out, is_listed(cascade(rows, names, key), F.col(key)))
    else:
        shard = F.pmod(F.xxhash64(F.lit(-1), F.col(key)), F.lit(shards))
        parts = [rows.filter(shard == k) for k in range(shards)]
        marked = functools.reduce(DataFrame.unionByName, [stored(part.withColumn(out, is_listed(cascade(part, names.filter(shard == k), key), F.col(key))), f"shard{k}") for k, part in enumerate(parts)])
    discard(names)
    return marked


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def matched_rule(rules: dict[str, str], host_: Column, path_: Column) -> Column:
    """The longest rule ("host/path prefix") that fits the host or a domain above it; null if none."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit(f".{name}"))) & F.startswith(path_, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and the rule's verdict (allow or block; null without a rule)."""
    rows = pages.select(*without(pages, *ADDED), host(F.col(f"`{url_col}`")).alias("host"), path(F.col(f"`{url_col}`")).alias("path"))
    rows = rows.withColumn("rule", matched_rule(rules, F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return rows.withColumn("verdict", verdict)


def mirrored(pages: DataFrame, rules: dict[str, str], url_col: str = "url", content_col: str = "html") -> DataFrame:
    """key (host and path) of all urls that a rule blocks, and of those whose content is that of a blocked one, byte by byte. Pages without content, or with an empty one, are nobody's copies."""
    content = F.col(f"`{content_col}`").cast("binary")
    rows = pages.select(F.col(f"`{url_col}`").alias("url"), F.when(F.octet_length(content) > 0, F.sha2(content, 256)).alias("content"))
    rows = with_rules(rows, rules).select(F.concat("host", "path").alias("key"), "verdict", "content")
    blocked = rows.filter("verdict = 'block'")
    same = rows.join(blocked.filter("content IS NOT NULL").select("content").distinct(), "content", "left_semi")
    return blocked.select("key").unionByName(same.select("key")).filter("key <> ''").distinct()  # pages without a url share the empty key


def judge(pages: DataFrame, rules: dict[str, str], listed: DataFrame, url_col: str = "url", max_bytes: int = 1 << 26) -> DataFrame:
    """pages with host, path, rule and verdict: the rule's, else block for keys (host and path) that are listed, else allow. listed: column key."""
    rows = pages.select(boxed(pages, *ADDED).alias("page"), F.col(f"`{url_col}`").alias("url"))
    rows = with_rules(rows, rules).withColumn("key", F.concat("host", "path"))
    found = mark_listed(rows, listed, "key", "is_listed", max_bytes)
    verdict = F.coalesce("verdict", F.when(F.col("is_listed") & (F.col("key") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(*unboxed(pages, "page", *ADDED), "host", "path", "rule", verdict.alias("verdict"))

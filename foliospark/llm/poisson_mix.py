"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is (its target share) / (its share of the corpus) times ``epochs``. Each document draws its
number of copies from a Poisson distribution with that mean: a uniform number seeded by md5(seed, id, text hash) is put through the inverse
distribution function, so reruns and lost executors give the same copies; a mean over 700 is drawn in parts, as a sum of Poisson numbers is one. Copies are exploded and the rows are dealt over the
cluster in the order of a second hash: random partition, random place in it.

All steps are rows and aggregates by source (partial sums before the shuffle). The rates, one row per source, are broadcast up to 100,000 sources; beyond
that they are joined, and Spark splits a hot source's side. Nothing is collected.

Edge cases: a null source is a source of its own; targets None means equal shares for all sources present; a source
that the targets don't name has weight 0 and gives no copies; repeated rows draw alike, so their copies are told apart by
``copy`` alone; empty tables give empty tables; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, text_of, without

ADDED = ("rate", "copies", "copy", "shuffle_key")
#: Of a hexadecimal md5, so many digits make the uniform number: 52 bits.
DIGITS = 13
#: exp(-rate) must be a normal double. A larger rate is drawn as a sum of independent draws of equal rates up to PIECE.
MOST_RATE, PIECE = 700.0, 500.0


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) >= u for X of mean rate, up to MOST_RATE. The walk ends at mean + 12 sigma + 30, past which no double below 1 reaches."""
    most = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        return F.when(a["cdf"] >= u, a).otherwise(F.struct(p.alias("p"), (a["cdf"] + p).alias("cdf"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"])


def drawn(rate: Column, *parts: Column) -> Column:
    """A Poisson number of mean rate, seeded by the parts; beyond MOST_RATE a sum of such numbers, each with a seed of its own."""
    pieces = F.ceil(rate / PIECE)
    several = F.transform(F.sequence(F.lit(1).cast("long"), pieces), lambda j: poisson_inverse(uniform(*parts, F.concat(F.lit("part"), j.cast("string"))), rate / pieces))
    total = F.aggregate(several, F.lit(0).cast("long"), lambda a, k: a + k)
    return F.when(rate > MOST_RATE, total).otherwise(poisson_inverse(uniform(*parts), rate).cast("long"))


def rates(docs: DataFrame, targets: Mapping[str | None, float] | None, epochs: float, source_col: str = "source") -> DataFrame:
    """One row per source: source, n, rate."""
    by = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("all"), F.count("*").alias("sources"))
    weight = F.lit(1.0) / F.col("sources")
    if targets is not None:
        known = {k: v / sum(targets.values()) for k, v in targets.items()}
        weight = F.lit(known.get(None, 0.0))
        for name, share in known.items():
            if name is not None:
                weight = F.when(F.col("source") == name, F.lit(share)).otherwise(weight)
    return by.crossJoin(F.broadcast(total)).select("source", "n", (weight * F.col("all") * F.lit(float(epochs)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, targets: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = 42, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", shuffle: bool = True) -> DataFrame:
    """docs' rows as often as they were drawn, with rate, copies, copy (from 0) and shuffle_key (rising within each partition)."""
    ident = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary"))]
    by = sized(stored(rates(docs, targets, epochs, source_col), "rates"), 100_000)
    rows = docs.select(F.struct(*without(docs, *ADDED)).alias("row"), F.col(f"`{source_col}`").cast("string").alias("s"), *[c.alias(f"i{k}") for k, c in enumerate(ident)])
    rated = rows.join(by, F.col("s").eqNullSafe(F.col("source"))).withColumn("copies", drawn(F.col("rate"), F.lit(str(seed)), F.col("i0"), F.col("i1")).cast("int")).filter("copies > 0")
    copies = rated.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "i0", "i1", F.col("copy").cast("string"))))
    out = keyed.select("row.*", "rate", "copies", "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out

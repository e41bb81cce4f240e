"""Tokens, trigrams, edit distance and display forms as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT_CHARS = 200_000
DAY_MS = 86_400_000


def normalized(text: Column, cap: int = MAX_TEXT_CHARS) -> Column:
    """White space and control characters as single spaces, none at either end, at most cap characters."""
    one = F.regexp_replace(text, r"[\s\p{Z}\p{Cc}]+", " ")
    return F.rtrim(F.substring(F.trim(one), 1, cap))


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with diacritics and what they are without, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    return "".join(a for a, d in pairs if len(d) > 1), "".join(d[0] for a, d in pairs if len(d) > 1)


def folded(text: Column) -> Column:
    """Lower case, diacritics of Latin letters removed."""
    return F.translate(F.lower(text), *_accents())


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def terms(query: Column, most: int = 8) -> Column:
    return F.slice(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""), 1, most)


def trigrams(text: Column) -> Column:
    n = F.length(text) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def similarity(query_grams: Column, name: Column) -> Column:
    """Share of the query's trigrams that the name has."""
    return F.when(F.size(query_grams) == 0, 0.0).otherwise(F.size(F.array_intersect(query_grams, trigrams(name))) / F.size(query_grams))


def allowed_typos(term: Column) -> Column:
    return F.when(F.length(term) <= 4, 0).when(F.length(term) <= 8, 1).otherwise(2)


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment: insertions, deletions, substitutions, swaps of neighbours. Row by row over a, keeping two rows."""
    first = F.sequence(F.lit(0), F.length(b))
    start = F.struct(first.alias("before"), first.alias("row"))

    def next_row(state: Column, i: Column) -> Column:
        ca, pa = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(row: Column, j: Column) -> Column:
            cb, pb = F.substring(b, j, F.lit(1)), F.substring(b, j - 1, F.lit(1))
            plain = F.least(F.element_at(row, -1) + 1, F.get(state["row"], j) + 1, F.get(state["row"], j - 1) + (ca != cb).cast("int"))
            swap = (i > 1) & (j > 1) & (ca == pb) & (pa == cb)
            return F.array_append(row, F.when(swap, F.least(plain, F.get(state["before"], j - 2) + 1)).otherwise(plain))

        row = F.when(F.length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(i), cell)).otherwise(F.array(i))
        return F.struct(state["row"].alias("before"), row.alias("row"))

    rows = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), start, next_row, lambda s: F.element_at(s["row"], -1))
    return F.when(F.length(a) == 0, F.length(b)).otherwise(rows)


def within_typos(term: Column, word: Column) -> Column:
    """Distance if it is within the term's budget (2 at most), else null. Lengths are looked at first, then the distance without swaps, which is at most twice this one and far quicker."""
    near = (F.abs(F.length(term) - F.length(word)) <= allowed_typos(term)) & F.levenshtein(term, word, 4).between(0, 2 * allowed_typos(term))
    distance = F.when(near, F.when(term == word, 0).when(allowed_typos(term) == 0, F.lit(None)).otherwise(osa_distance(term, word)))
    return F.when(distance <= allowed_typos(term), distance)


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without up to most (0 to 2) characters. Two words within that many typos have one in common."""
    fewer = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    if most:
        out = F.concat(out, fewer(word))
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(fewer(word), fewer)))
    return F.array_distinct(out)


def edit_match(query_terms: Column, name: Column) -> Column:
    """15 - 4 * typos if each term is in the name or within its budget of one of its words, else null. name: lower case."""
    typos = F.transform(query_terms, lambda t: F.when(F.contains(name, t), 0).otherwise(F.array_min(F.filter(F.transform(words(name), lambda w: within_typos(t, w)), lambda d: d.isNotNull()))))
    total = F.aggregate(typos, F.lit(0), lambda s, d: s + d)
    return 15.0 - 4.0 * total


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def human_size(size: Column) -> Column:
    """B, KB ... TB; one decimal below 10."""
    unit = F.least(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double"))), F.lit(4)).cast("int")
    unit = F.when(size >= F.pow(F.lit(1024.0), unit + 1), F.least(unit + 1, F.lit(4))).when(size < F.pow(F.lit(1024.0), unit), unit - 1).otherwise(unit)  # rounding of the logarithm
    value = size / F.pow(F.lit(1024.0), unit)
    number = F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.floor(value + 0.5).cast("string"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1)))


def relative_time(ms: Column, now_ms: int) -> Column:
    """struct(value, unit): now within 45 s, then minute, hour, day up to 30 days, else date. Null without a time (or time 0)."""
    diff = (ms - now_ms) / 1000.0
    away = F.abs(diff)
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    value = F.when(away < 45, 0).when(away < 3600, rounded(diff / 60)).when(away < 86400, rounded(diff / 3600)).when(away < 86400 * 30, rounded(diff / 86400))
    unit = F.when(away < 45, "now").when(away < 3600, "minute").when(away < 86400, "hour").when(away < 86400 * 30, "day").otherwise("date")
    return F.when(ms.isNotNull() & (ms != 0), F.struct(value.cast("long").alias("value"), unit.alias("unit")))


def occurrences(text: Column, term: Column) -> Column:
    """Starts (from 0) of non-overlapping occurrences, left to right."""
    n = F.size(F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)) - 1
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        found = F.call_function("locate", term, text, s["at"])
        return F.struct((found + F.length(term)).alias("at"), F.array_append(s["out"], found - 1).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda s: s["out"])).otherwise(F.array().cast("array<int>"))


def marked_spans(text: Column, query_terms: Column) -> Column:
    """Where a display marks text: array of struct(start, stop), in order and without overlap, case ignored."""
    low = F.lower(text)
    hits = F.flatten(F.transform(query_terms, lambda t: F.transform(occurrences(low, t), lambda s: F.struct(s.alias("start"), (s + F.length(t)).alias("stop")))))
    none = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        more = F.struct(h["stop"].alias("pos"), F.array_append(a["out"], F.struct(F.greatest(h["start"], a["pos"]).alias("start"), h["stop"].alias("stop"))).alias("out"))
        return F.when(h["stop"] <= a["pos"], a).otherwise(more)

    return F.aggregate(F.array_sort(hits), none, step, lambda a: a["out"])

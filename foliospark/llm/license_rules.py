"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over a text's words (letters, digits and all beyond ASCII, A-Z lower-cased, one space between
words), gated by keywords of which every match of it holds one. Over two hundred signatures of texts, headers and notices are written by hand (``license_signatures``); references to a license by
its name come from a table of names and a few phrasings, in which a name that is an ordinary word needs a verb of licensing, "terms of" or "license" beside it. Detections are intervals of words. Of two detections, the one whose interval lies within the
other's is suppressed; of equal intervals the rule of higher priority stays, then the earlier rule: detections are sorted by start, and swept with the largest end so far. Three base phrases are
always reported.

Everything for one document happens within its row: no shuffle, join or Python. Documents without any anchor word skip the rules, and rules are tried by groups of one keyword.

Edge cases: a null text counts as empty (no words, no labels, score 0); very long texts are scanned whole, and their detections are handled in lumps of 256; places of one rule don't overlap each other, and phrases
may not overlap themselves either; input columns named like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, text_of, unboxed
from .license_signatures import FAINT, TEXTS

ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
#: Word characters: 0-9, A-Z, a-z and all beyond ASCII. The first is for texts in either case.
NOT_WORD, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The contract's phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Every match of a rule holds one of these (or two words of CC), lower-cased; single words, as anything may stand between words.
ANCHORS = (
    "licen", "under", "governed", "covered", "terms", "permission", "warrant", "redistribut", "copyright", "domain", "reserved", "identifier", "creative", "software", "advertising", "endorse", "liable", "acknowledg",
    "exception", "invariant", "mozilla", "eclipse", "cc0", "fuck", "beer", "altered", "remotely", "propagate", "bzip2", "illinois", "etalab", "cecill", "mulan", "confidential", "unauthorized", "png", "policies", "postgresql",
)
CC = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


class Rule(NamedTuple):
    label: str
    keyword: str  # or several, with | between them
    regex: str
    priority: int
    weight: float


#: Label, words of the name as a pattern, a word that every match has. Longer names beat shorter ones by containment.
NAMES = (
    ("mit", "mit", "mit"), ("mit-0", "mit (?:0|no attribution)", "mit"), ("x11", "x11", "x11"), ("expat", "expat", "expat"),
    ("isc", "isc", "isc"), ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("bsd-2-clause", "(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)", "bsd"),
    ("bsd-3-clause", "(?:(?:modified|new|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)", "bsd"),
    ("bsd-4-clause", "(?:(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause)", "bsd"), ("bsd", "bsd", "bsd"),
    ("apache-1.1", "apache (?:software )?license(?: version)? 1 1", "apache"), ("apache-1", "apache (?:software )?license(?: version)? 1 0", "apache"),
    ("apache-2", "(?:apache (?:software )?license(?: version)? (?:v2|2)(?: 0)?|apache 2(?: 0)?)", "apache"), ("apache", "apache", "apache"),
    ("gpl-1", "(?:gnu )?(?:general public license|gpl)(?: version| v)? (?:v1|1)(?: 0)?", "g"), ("gpl-2", "(?:gnu )?(?:general public license|gpl)(?: version| v)? (?:v2|2)(?: 0)?", "g"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl)(?: version| v)? (?:v3|3)(?: 0)?", "g"), ("gpl", "(?:gnu general public license|gnu gpl|gpl)", "g"),
    ("lgpl-2", "(?:gnu )?(?:library general public license|lgpl)(?: version| v)? (?:v2|2)(?: 0)?", "l"), ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? (?:v2|2) 1", "l"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? (?:v3|3)(?: 0)?", "l"), ("lgpl", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl)", "l"),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? (?:v3|3)(?: 0)?", "a"), ("agpl", "(?:gnu affero general public license|gnu agpl|agpl)", "a"),
    ("gfdl-1.2", "(?:gnu )?free documentation license(?: version)? 1 2", "documentation"), ("gfdl-1.3", "(?:gnu )?free documentation license(?: version)? 1 3", "documentation"), ("gfdl", "(?:gnu )?free documentation license", "documentation"),
    ("mpl-1.0", "(?:mozilla public license|mpl)(?: version| v)? 1 0", "m"), ("mpl-1.1", "(?:mozilla public license|mpl)(?: version| v)? 1 1", "m"), ("mpl-2.0", "(?:mozilla public license|mpl)(?: version| v)? 2 0", "m"), ("mpl", "mozilla public license", "mozilla"),
    ("epl-1.0", "(?:eclipse public license|epl)(?: version| v)? 1 0", "e"), ("epl-2.0", "(?:eclipse public license|epl)(?: version| v)? 2 0", "e"), ("epl", "eclipse public license", "eclipse"),
    ("cddl-1.0", "(?:common development and distribution license|cddl)(?: version| v)? 1 0", "d"), ("cddl-1.1", "(?:common development and distribution license|cddl)(?: version| v)? 1 1", "d"), ("cddl", "(?:common development and distribution license|cddl)", "d"),
    ("eupl-1.1", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 1", "eu"), ("eupl-1.2", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 2", "eu"),
    ("cc0-1.0", "(?:cc0|creative commons zero|cc zero)(?: v?1 0)?(?: universal)?", "c"), ("cc-by", "(?:cc by|creative commons attribution)(?: license)?(?: [1-4] [05])?", "c"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "c"), ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", "c"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "c"), ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "c"), ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", "c"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "w"), ("zlib", "zlib(?: libpng)?", "zlib"), ("libpng", "libpng", "libpng"), ("bsl-1.0", "(?:boost software license|bsl)(?: version)?(?: 1 0)?", "b"),
    ("busl-1.1", "(?:business source license|busl)(?: 1 1)?", "bus"), ("artistic-1.0", "artistic license(?: version)? 1(?: 0)?", "artistic"), ("artistic-2.0", "artistic license(?: version)? 2(?: 0)?", "artistic"), ("artistic", "artistic", "artistic"),
    ("psf-2.0", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2(?: 0)?)?", "p"), ("python-2.0", "python license(?: 2 0)?", "python"), ("php-3.01", "php license(?: version)? 3 01", "php"), ("ruby", "ruby", "ruby"), ("openssl", "openssl", "openssl"),
    ("sleepycat", "sleepycat", "sleepycat"), ("postgresql", "postgresql", "postgresql"), ("ncsa", "(?:ncsa|university of illinois ncsa open source)", "ncsa"), ("ofl-1.1", "(?:sil )?(?:open font license|ofl)(?: version)?(?: 1 1)?", "o"), ("odbl-1.0", "(?:open database license|odbl)(?: v?1 0)?", "od"), ("odc-by-1.0", "(?:odc by|open data commons attribution)(?: license)?(?: v?1 0)?", "od"), ("pddl-1.0", "(?:pddl|public domain dedication and license)(?: 1 0)?", "p"),
    ("afl-3.0", "(?:academic free license|afl)(?: v| version)?(?: 3 0)?", "a"), ("osl-3.0", "(?:open software license|osl)(?: v| version)?(?: 3 0)?", "o"), ("ms-pl", "(?:microsoft public license|ms pl)", "m"), ("ms-rl", "(?:microsoft reciprocal license|ms rl)", "m"), ("sspl-1.0", "(?:server side public license|sspl)(?: v?1)?", "s"), ("elastic-2.0", "elastic license(?: 2 0)?", "elastic"), ("upl-1.0", "(?:universal permissive license|upl)(?: v?1 0)?", "u"), ("vim", "vim", "vim"), ("beerware", "beer ?ware", "beer"),
)
#: For names whose keyword isn't selective: of these, every match of the name holds one (a space stands before each name).
HOLDS = {
    "gpl": " gpl|general public license", "lgpl": " lgpl|general public license", "agpl": " agpl|affero", "mpl": " mpl|mozilla public", "epl": " epl|eclipse public", "cddl": " cddl|common development", "eupl": " eupl|european union",
    "cc0": " cc0|creative commons| cc zero", "cc": " cc by|creative commons", "wtfpl": " wtfpl|what the fuck", "bsl": " bsl|boost software", "psf": " psf|python software", "ofl": " ofl|open font", "odbl": " odbl|open database", "odc": " odc by|open data commons",
    "pddl": " pddl|public domain dedication", "afl": " afl|academic free", "osl": " osl|open software", "ms": " ms pl| ms rl|microsoft", "sspl": " sspl|server side", "upl": " upl|universal permissive",
}
#: Pattern around a name ({}), priority, weight, the gate where the name's keyword isn't selective (None: what the name holds).
PHRASINGS = (
    (" (?:spdx )?license identifier {}(?: only| or later)?", 50, 1.0, "identifier"),
    (" (?:(?:is |are )?(?:re)?licensed under|(?:re)?released under|distributed under|published under|available under|provided under|covered (?:under|by)|governed by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[cs]e)?(?: or (?:any )?later(?: version)?)?", 40, 0.9, None),
    (" (?:under|subject to) (?:the )?terms (?:and conditions )?of (?:the )?{}(?: licen[cs]e)?", 30, 0.7, None),
    (" {} licen[cs]e", 20, 0.6, "licen"),
)
#: Names that are no ordinary words nor short for anything else: these may follow "under" or "license" alone.
PLAIN = ("gpl", "lgpl", "agpl", "gfdl", "mpl-", "cddl", "eupl", "cc0", "cc-by", "ofl", "odbl", "mit-0", "0bsd", "unlicense", "wtfpl", "sspl")
PLAIN_PHRASINGS = ((" under (?:the |an? )?{}(?: licen[cs]e)?", 30, 0.7, None), (" licen[cs]e {}", 20, 0.6, "licen"))
#: The base phrases are rules too; they outrank the others.
BASE_RULES = tuple(Rule(label, phrase.split()[-1 if label == "cc-by-nc" else 0], f" {phrase}", 100, 1.0) for phrase, label in BASE)


#: Names that also stand for a product, a place or a trade: after "under" they need the word license, another license's name or the end of the text.
LONE = ("mit", "x11", "expat", "isc", "bsd", "apache", "zlib", "libpng", "artistic", "ruby", "openssl", "sleepycat", "postgresql", "ncsa", "vim", "beerware")
OPEN, CLOSED = "{}(?: licen[cs]e)?", "{}(?: licen[cs]e|(?= $)|(?= (?:and|or) (?:the )?(?:mit|apache|bsd|isc|gpl|lgpl|mpl|gnu|mozilla) ))"


def named(label: str, name: str, key: str) -> list[Rule]:
    """The rules for references to a license by its name."""
    every = PHRASINGS + PLAIN_PHRASINGS * label.startswith(PLAIN)
    if label in LONE:
        every = [(around.replace(OPEN, CLOSED), *rest) for around, *rest in every]
    return [Rule(label, (gate or HOLDS[label.partition("-")[0]]) if len(key) < 3 else key, around.format(name), priority, weight) for around, priority, weight, gate in every]


def rules() -> list[Rule]:
    texts = [Rule(label, key, regex, *FAINT.get(label, (60, 1.0))) for label, key, regex in TEXTS]
    return [*BASE_RULES, *texts, *(r for x in NAMES for r in named(*x))]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


LUMP = 256


def running(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Running aggregates of an int array, in lumps: a lump's own, then joined with what all lumps before it come to."""

    def along(lump: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(lump, empty, lambda a, x: F.array_append(a, F.when(F.size(a) == 0, x).otherwise(of(F.element_at(a, -1), x))))

    lumps = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / LUMP).cast("int")), lambda k: along(F.slice(values, k * LUMP + 1, LUMP)))

    def joined(parts: Column) -> Column:
        before = along(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: of(F.get(b, k - 1), x))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(lumps, joined))


def places(words: Column, regex: Column) -> Column:
    """Each match of a rule in the spaced words: struct(first, last), numbers of words. A match begins with the space before its first word."""

    def counted(found: Column) -> Column:
        between = F.slice(F.split(words, regex, -1), 1, F.size(found))
        sizes = F.zip_with(between, found, lambda gap, hit: F.struct(_spaces(gap).alias("gap"), _spaces(hit).alias("n")))
        return _let(sizes, lambda s: _let(running(F.transform(s, lambda x: x["gap"] + x["n"]), lambda a, x: a + x), lambda ends: F.zip_with(ends, s, lambda end, x: F.struct((end - x["n"]).alias("first"), (end - 1).alias("last")))))

    return _let(F.regexp_extract_all(words, regex, F.lit(0)), counted)


def _groups(these: list[Rule]) -> Column:
    """The rules by their keywords, as a constant array."""
    by: dict[str, list[tuple[int, Rule]]] = {}
    for k, r in enumerate(these):
        by.setdefault(r.keyword, []).append((k, r))
    groups = [{"keywords": key.split("|"), "rules": [{**r._asdict(), "regex": f"(?:{r.regex})(?= )", "rule": k, "base": r in BASE_RULES} for k, r in own]} for key, own in by.items()]
    return F.from_json(F.lit(json.dumps(groups)), "array<struct<keywords:array<string>,rules:array<struct<rule:int,label:string,regex:string,priority:int,weight:double,base:boolean>>>>")


def detections(words: Column, these: list[Rule]) -> Column:
    """All detections of the rules, before suppression."""
    gated = F.flatten(F.transform(F.filter(_groups(these), lambda g: F.exists(g["keywords"], lambda w: F.contains(words, w))), lambda g: g["rules"]))
    hits = F.transform(gated, lambda r: F.transform(places(words, r["regex"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["base"].alias("base"))))
    return F.flatten(hits)


def suppressed(hits: Column) -> Column:
    """Without those that lie within another's interval; of equal intervals the higher priority stays, then the earlier rule.

    In the order of start, later end, higher priority and earlier rule, a detection lies within an earlier one if that ends no earlier.
    """
    keyed = F.transform(hits, lambda h: F.struct(h["first"].alias("first"), (-h["last"]).alias("end"), (-h["priority"]).alias("rank"), h["rule"].alias("rule"), h.alias("hit")))
    swept = lambda s: _let(running(F.transform(s, lambda x: -x["end"]), F.greatest), lambda ends: F.filter(s, lambda x, k: (k == 0) | (F.get(ends, k - 1) < -x["end"])))
    return F.transform(_let(F.array_sort(keyed), swept), lambda x: x["hit"])


def scan(docs: DataFrame, text_col: str = "text", these: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, detections (array of first, last, label, weight)."""
    text = text_of(text_col)
    low = F.lower(text)
    gate = F.rlike(text, F.lit(CC))
    for a in ANCHORS:
        gate = gate | F.contains(low, F.lit(a))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " ")), F.lit(" "))
    rows = docs.select(boxed(docs, *ADDED).alias("doc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_n"), F.when(gate, words).alias("_words"))
    rows = rows.withColumn("_hits", F.when(F.col("_words").isNotNull(), detections(F.col("_words"), these or rules())))
    base, kept = F.filter("_hits", lambda h: h["base"]), suppressed(F.col("_hits"))
    rows = rows.withColumn("_base", base).withColumn("_kept", kept)

    def joined(c: Column) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))

    base_labels = F.transform("_base", lambda h: h["label"])
    shown = F.transform("_kept", lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"), h["label"].alias("label"), h["weight"].alias("weight")))
    return rows.select(
        *unboxed(docs, "doc", *ADDED),
        F.col("_n").alias("n_words"),
        F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda h: h["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda h: h["first"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("_kept", lambda h: h["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda h: h["weight"])), F.lit(0.0)).alias("score"),
        F.coalesce(shown, F.array().cast("array<struct<first:int,last:int,label:string,weight:double>>")).alias("detections"),
    )

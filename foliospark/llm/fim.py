"""Fill-in-middle: a text is cut at two places and its middle moved to the end.

A text is handled as its UTF-8 bytes. Units are runs of A-Z and a-z and single other characters, and cuts are drawn in units, from a hash of the document's id.
``Exceptions`` is the sparse index that turns byte places into code-point places and back: it lists the multibyte characters alone, by place and excess bytes so far. ASCII spans between
them are plain arithmetic, so an ASCII text has an empty index.

Edge cases: a null text counts as empty, and an empty one is plain; so is one that contains a sentinel, as it could not be told apart afterwards. A null id is drawn for like the empty
text; repeated rows are cut alike; very long texts are cut whole, with unit starts looked for block by block; an empty table gives an empty table. Other columns stay, but those named like
an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes whose unit starts are looked for at once.
BLOCK = 1 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """Multibyte characters of a UTF-8 text: ``at`` has their first bytes' places, ``chars`` their code-point places, ``excess`` the bytes beyond one each, summed up to and with each."""

    def __init__(self, data: np.ndarray):
        self.length = len(data)
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.chars = self.at - np.concatenate(([0], self.excess[:-1])).astype(np.int64) if len(self.at) else self.at

    def chars_before(self, byte: int) -> int:
        """Code points before a byte place that begins a character (or ends the text)."""
        k = int(np.searchsorted(self.at, byte, "left"))
        return byte - (int(self.excess[k - 1]) if k else 0)

    def byte_of(self, char: int) -> int:
        """Where the code point of that number begins."""
        k = int(np.searchsorted(self.chars, char, "left"))
        return char + (int(self.excess[k - 1]) if k else 0)


def _unit_starts(data: np.ndarray, low: int) -> np.ndarray:
    """Places in a block where a unit begins: at any first byte of a character but a letter that follows a letter."""
    block = data[low : low + BLOCK]
    letter = LETTER[block]
    follows = np.concatenate(([low > 0 and LETTER[data[low - 1]]], letter[:-1]))
    return low + np.flatnonzero((block & 0xC0 != 0x80) & ~(letter & follows))


def unit_places(data: np.ndarray, pick) -> tuple[int, list[int]]:
    """The number n of units, and the byte places before the units that pick(n) names; n names the end."""
    counts = [len(_unit_starts(data, low)) for low in range(0, len(data), BLOCK)]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if counts else 0
    places = []
    for unit in pick(n):
        if unit >= n:
            places.append(len(data))
            continue
        k = int(np.searchsorted(ends, unit, "right"))
        places.append(int(_unit_starts(data, k * BLOCK)[unit - (int(ends[k - 1]) if k else 0)]))
    return n, places


def draws(doc_id: str, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: bytes, doc_id: str, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, units: str = "words") -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text. units: words (runs of letters, single others) or chars (code points)."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    data = np.frombuffer(text, np.uint8)
    index = Exceptions(data)
    pick = lambda n: sorted((h1 % (n + 1), h2 % (n + 1)))
    if units == "chars":
        n = index.chars_before(len(data))
        low, high = map(index.byte_of, pick(n))
    else:
        n, (low, high) = unit_places(data, pick)
    if not text or h3 % 100 >= fim_percent or any(x.encode() in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    before = index.chars_before(low)
    pre, mid, suf = text[:low], text[low:high], text[high:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < spm_percent
    out = b"".join((s, suf, p, pre, m, mid) if spm else (p, pre, s, suf, m, mid))
    return n, "spm" if spm else "psm", before, index.chars_before(high) - before, out


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, units: str = "words", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output (the rearranged text). One pass without a shuffle."""
    names = [c for c in docs.columns if c.lower() not in ADDED]
    other = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("c"), *other).alias("doc"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rearranged(t.as_py() or b"", i.as_py(), seed, fim_percent, spm_percent, units) for i, t in zip(b.column(1), b.column(2), strict=True)]
            n, form, pre, mid, out = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary())], ["doc", "text", *ADDED])

    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.BinaryType())]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "binary")
    out = rows.mapInArrow(run, schema)
    kept = [(F.col("text").cast("string") if c == text_col else F.col(f"doc.c{k}")).alias(c) for k, c in enumerate(names)]
    return out.select(*kept, *ADDED[:-1], F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: it has no sentinels of its own, so they cut it into its pieces."""
    parts = F.split(output, "<[PSM]>", -1)
    piece = lambda *order: F.concat(*[F.get(parts, k) for k in order])
    return F.when(form == "plain", output).when(form == "psm", piece(1, 3, 2)).otherwise(piece(2, 3, 1))

"""Packing token sequences into windows by best-fit decreasing.

Each task tokenises its rows as they stream by and packs them in blocks of ``block_tokens`` ids: overlong documents are first cut
into full windows, the rest go, longest first, to the open window with the smallest remaining capacity that holds them, found in a segment
tree over capacities. What best-fit leaves open is then closed: the emptiest windows' pieces are cut to fill the gaps of the
fullest ones, and the one window that remains partly filled is split at powers of two, where no padding is needed. No row leaves
its task, so nothing is shuffled, no key can be hot and a lost task is simply run again.

White space never enters a token of this tokenizer, so texts are split at ASCII white space and each distinct piece is encoded once
per worker (it remembers at most twice ``CACHED`` pieces); the ids are those of the whole text.

Edge cases: a null text counts as empty (the end id alone); null and repeated ids pass through, each row is packed; an empty table gives
an empty table; other input columns aren't returned.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
CACHED = 500_000
CLOSING = b".,!?;:%&*#$|"
Piece = tuple[int, int, int]  #: document's place in its block, start, length


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Callable[[str], bytes]:
    """Text to ids and the end id, as little-endian unsigned 32-bit numbers."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    young: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}
    end = array("I", [end_id]).tobytes()

    def learn(words: set[bytes]) -> None:
        parts = {w: _parts(w) for w in words}
        for w in {p for ps in parts.values() for p in ps if p in old}:
            young[w] = old[w]
        new = list({p for ps in parts.values() for p in ps if p not in young})
        for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            young[w] = array("I", e.ids).tobytes()
        for w, ps in parts.items():
            young[w] = b"".join([young[p] for p in ps])

    def encode(text: str) -> bytes:
        nonlocal young, old
        words = text.encode("utf-8", "replace").split()
        missing = {w for w in words if w not in young}
        if missing:
            if len(young) > CACHED:  # words still in use come back from the old half
                young, old, missing = {}, young, set(words)
            learn(missing)
        return b"".join([young[w] for w in words]) + end

    return encode


def _parts(word: bytes) -> tuple[bytes, ...]:
    """The word in lower case, its closing punctuation apart where that follows a letter: the tokenizer cuts there in any case."""
    if b"<|" in word:  # may hold a special token, which is told by case
        return (word,)
    low = word.lower()
    core = low.rstrip(CLOSING)
    if core != low and core and (core[-1] < 0x80 and 0x61 <= core[-1] <= 0x7A or core[-1] >= 0x80 and _ends_as_letter(core.decode()[-1])):
        return core, low[len(core) :]
    return (low,)


@lru_cache(maxsize=1 << 16)
def _ends_as_letter(c: str) -> bool:
    """Whether the tokenizer's normalisation (NFC, lower case) leaves one letter of this character: a mark at the end would join the punctuation."""
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())
    return len(out) == 1 and out.isalpha()


class Capacities:
    """A segment tree whose leaves are remaining capacities; a node counts the open windows below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        self.open.setdefault(capacity, []).append(sequence)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window of the smallest capacity >= need, taken out: (capacity, sequence)."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[list[Piece]]:
    """Windows with the pieces of documents of these lengths."""
    sequences: list[list[Piece]] = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, n - n % window, window)]
    rest = sorted(((n % window, d) for d, n in enumerate(lengths) if n % window), key=lambda x: -x[0])
    tree = Capacities(window)
    for n, d in rest:
        found = tree.take(n)
        capacity, k = found or (window, len(sequences))
        if not found:
            sequences.append([])
        sequences[k].append((d, lengths[d] - n, n))
        if capacity > n:
            tree.add(capacity - n, k)
    return sequences


def closed(sequences: list[list[Piece]], window: int) -> list[list[Piece]]:
    """The same ids with all windows full but those whose length is a power of two."""
    used = [sum(p[2] for p in s) for s in sequences]
    part = sorted((k for k in range(len(sequences)) if used[k] < window), key=lambda k: -used[k])
    to, give = 0, len(part) - 1
    while to < give:
        a, b = sequences[part[to]], sequences[part[give]]
        gap = window - used[part[to]]
        d, s, n = b.pop()
        if n > gap:
            b.append((d, s + gap, n - gap))
            n = gap
        a.append((d, s, n))
        used[part[to]] += n
        used[part[give]] -= n
        to += used[part[to]] == window
        give -= not b
    out = [s for s in sequences if s]
    if part and to == give and used[part[to]] < window:
        pieces, total = sequences[part[to]], used[part[to]]
        out = [s for s in out if s is not pieces]
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                room, own = 1 << bit, []
                while room:
                    d, s, n = pieces.pop(0)
                    if n > room:
                        pieces.insert(0, (d, s + room, n - room))
                        n = room
                    own.append((d, s, n))
                    room -= n
                out.append(own)
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, block_tokens: int = 1 << 22, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = encoder(tokenizer_path, end_id), TaskContext.get().partitionId() << 32
        id_type = None
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            out: list[tuple] = []
            size = 0
            for pieces in closed(best_fit([len(t) // 4 for t in tokens], window), window):
                offset = 0
                for d, s, n in pieces:
                    out.append((ids[d], s, n, tokens[d][4 * s : 4 * (s + n)], len(tokens[d]) // 4, next_id, offset))
                    offset += n
                next_id += 1
                size += offset
                if size > 1 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                tokens.append(encode(t.as_py()))
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    yield from flush()
                    ids, tokens, held = [], [], 0
        if tokens:
            yield from flush()

    return rows.mapInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))

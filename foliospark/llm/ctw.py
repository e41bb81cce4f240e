"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions. Each decision (the bits of the byte so far) has a context tree of its own, whose node at depth d is told
by the d bytes before. A node holds how often 0 and 1 followed it in the training texts; its Krichevsky-Trofimov estimate and those of all
deeper nodes are mixed with the weights of context-tree weighting (one half for stopping at a node, one half for its children, updated by how
well each coded the training texts). A text's score is the log10 probability of its bytes, A-Z lower-cased, and an end symbol, 0xFF, which UTF-8
never has; before its first byte a text has a context of such symbols.

How it runs. Texts, long ones in pieces, are dealt to blocks of a bounded number of bytes by a hash. A block gives its distinct words and byte
grams (context and byte) with training counts. These are summed over the corpus by key; the counts of shorter contexts follow from the
longest ones'. The tree is cut at depth 3: subtrees below it are dealt to buckets, which are computed in one vectorised call each, their roots likewise by the
last two context bytes, and the nodes above (depth 0 and 1: at most 257 * 255, a bound of the method) are shared by all. Every gram of the corpus so gets its
code length once, and only the keys that a block has travel back to it. What is broadcast is counted first, and joined where it is too large.

Memory. A block has at most ``block_bytes`` of text and ``block_grams`` distinct grams: where texts are so varied that a block has more, blocks are made
smaller and counted again. A subtree below depth 3 that has more than ``hot_rows`` grams is cut again at depth 4, where one has at most 2**16 grams
(contexts of six bytes: 2**24); its nodes at depth 4 are at most 2**16 as well, and meet what is above them by their nearest three bytes.

Edge cases: a null text counts as empty (the end alone); a null id's fold is that of the empty text; repeated rows are scored and counted each;
very long texts are scored in pieces that see the bytes before them, and words that run over a piece's end are counted whole; without training texts all counts are zero;
an empty table gives an empty table; other input columns aren't used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sized, stored, text_of

END = b"\xff"
#: Bytes that are turned into grams at once, in counting and in scoring; a long text's pieces; words longer than this go by a digest.
COUNTED, SCORED, PIECE, LONG_WORD = 1 << 21, 1 << 19, 1 << 20, 64
HALF = float(np.log(0.5))
#: White space at which tokens end, as bytes.split() has it.
SPACE = b" \t\n\v\f\r"


def word_key(word: bytes) -> bytes:
    """The word itself, or a space (which no word has) and its digest."""
    from xxhash import xxh3_128_digest

    return word if len(word) <= LONG_WORD else b" " + xxh3_128_digest(word)


def pieces(text: bytes, depth: int, size: int) -> Iterator[tuple[bytes, bytes, int, bytes | None]]:
    """Of a text: the bytes before a piece, its bytes, how its words are cut (1: the first began before, 2: the last runs on, 3: both), and the key of a word that begins here and runs on."""
    start, into = 0, False
    while True:
        stop = min(start + size, len(text))
        if stop < len(text):
            gap = max(text.rfind(c, start + size // 2, stop) for c in [bytes([x]) for x in SPACE])
            stop = gap + 1 if gap >= 0 else stop
        on = 0 < stop < len(text) and text[stop - 1] not in SPACE and text[stop] not in SPACE
        own = None
        if on:
            begin = max(text.rfind(bytes([x]), start, stop) for x in SPACE) + 1 or start
            if not (into and begin == start):
                ends = [k for k in (text.find(bytes([x]), stop) for x in SPACE) if k >= 0]
                own = word_key(text[begin : min(ends, default=len(text))])
        yield (END * depth + text[max(0, start - depth) : start])[-depth:], text[start:stop], into + 2 * on, own
        if stop == len(text):
            return
        start, into = stop, on


def words_of(data: bytes, cut: int, own: bytes | None) -> list[bytes]:
    """Keys of the words that begin in a piece."""
    words = data.split()
    if cut & 1:
        del words[:1]
    if cut & 2 and words:
        del words[-1:]
    if own is not None:
        words.append(own)
    return [w if len(w) <= LONG_WORD else word_key(w) for w in words] if len(data) > LONG_WORD else words


def framed(befores: list[bytes], parts: list[bytes], lasts: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of depth + 1 consecutive bytes of the parts after one another, each behind the bytes before it and, if last, before an end; and for each part the place and number of its codes. Between two parts there are depth codes of none."""
    data = np.frombuffer(b"".join(x for b, t, end in zip(befores, parts, lasts, strict=True) for x in (b, t, END if end else b"")), np.uint8)
    size = np.array([len(t) for t in parts], np.int64) + np.array(lasts, np.int64)
    codes = np.zeros(max(0, len(data) - depth), np.int64)
    for j in range(depth + 1):
        codes <<= 8
        codes |= data[j : len(data) - depth + j]
    return codes, np.cumsum(size + depth) - size - depth, size


def lumps(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for k, n in enumerate(sizes):
        total += n + 1
        if total >= most or k + 1 == len(sizes):
            yield slice(start, k + 1)
            start, total = k + 1, 0


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with sums."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(n, starts) if len(starts) else n[:0]


def grams_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


KEYS = "block long, word binary, code long, n long"


def block_keys(depth: int, held_codes: int = 1 << 21, held_words: int = 400_000):
    """Of a block's pieces: its distinct words and grams, each with its count in training texts. What is more than may be held is handed on in parts."""

    def rows(block: int, words: list[bytes] | None, codes: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), 1 << 17):
            some, size = slice(k, k + (1 << 17)), len(n[k : k + (1 << 17)])
            word = pa.nulls(size, pa.binary()) if words is None else pa.array(words[some], pa.binary())
            code = pa.nulls(size, pa.int64()) if codes is None else pa.array(codes[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int64)), word, code, pa.array(n[some].astype(np.int64))], ["block", "word", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes, n, texts, block = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for b in batches:
            block = b["block"][0].as_py() if len(b) else block
            sizes = pc.binary_length(b["data"]).to_pylist()
            for of in lumps(sizes, COUNTED):
                c = b.slice(of.start, of.stop - of.start)
                before, data, last, cut, own, used = (c[x].to_pylist() for x in ("before", "data", "last", "cut", "own", "used"))
                texts += sum(x and y for x, y in zip(used, last, strict=True))
                for t, k, w, u in zip(data, cut, own, used, strict=True):
                    found = words_of(t.lower(), k, w)
                    if u:
                        words.update(found)
                    else:
                        words.update(dict.fromkeys(found, 0))
                if len(words) > held_words:
                    yield from rows(block, list(words), None, np.fromiter(words.values(), np.int64, len(words)))
                    words.clear()
                every, at, size = framed([x.lower() for x in before], [x.lower() for x in data], last, depth)
                for some in (True, False):
                    inside = np.zeros(len(every) + 1, np.int8)
                    mine = np.array(used) == some
                    np.add.at(inside, at[mine], 1)
                    np.add.at(inside, (at + size)[mine], -1)
                    new, count = grams_of(every[np.cumsum(inside, dtype=np.int8)[:-1] > 0])
                    codes, n = summed(np.concatenate((codes, new)), np.concatenate((n, count * some)))
                if len(codes) > held_codes:
                    yield from rows(block, None, codes, n)
                    codes, n = codes[:0], n[:0]
        yield from rows(block, list(words), None, np.fromiter(words.values(), np.int64, len(words)))
        yield from rows(block, None, codes, n)
        del words, codes, n
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([texts], pa.int64())], ["block", "word", "code", "n"])  # the number of training texts

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series, eight steps up for accuracy."""
    rise = x
    for k in range(1, 8):
        rise = rise * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(rise)


#: log gamma(n + 1/2) and log n! of the counts that most nodes have.
SMALL = 1 << 12
HALVES, FACTORIALS = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def looked_up(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    """log gamma(n + more) of whole numbers n."""
    out = table[np.minimum(n, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= SMALL)
    out[large] = log_gamma(n[large] + more)
    return out


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones, in any order: gamma(n0+1/2) gamma(n1+1/2) / (pi (n0+n1)!)."""
    return looked_up(HALVES, n0, 0.5) + looked_up(HALVES, n1, 0.5) - np.log(np.pi) - looked_up(FACTORIALS, n0 + n1, 1.0)


class Level:
    """Nodes of one depth for one bit of the byte: which node each item (a gram, or a node one deeper) belongs to, and the nodes' counts."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        self.keys, self.of = np.unique(keys, return_inverse=True)
        self.n0 = np.bincount(self.of, n0, len(self.keys))
        self.n1 = np.bincount(self.of, n1, len(self.keys))
        self.own = kt_block(self.n0, self.n1)
        self.weighted = self.own

    def mix(self, children: Level) -> None:
        """children: one deeper; self's items are its nodes."""
        self.weighted = np.logaddexp(HALF + self.own, HALF + np.bincount(self.of, children.weighted, len(self.keys)))

    def stop(self) -> np.ndarray:
        return np.exp(HALF + self.own - self.weighted)

    def ones(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)


def levels(code: np.ndarray, n: np.ndarray, bit: int, depth: int, least: int) -> list[Level]:
    """From depth down to least, for the bit'th decision (0 is the highest bit). A node's key is its context bytes, the byte nearest lowest, and then 8 bits: a one and the byte's bits so far."""
    byte, context = code & 255, code >> 8
    prefix = (1 << bit) | (byte >> (8 - bit))
    one = (byte >> (7 - bit)) & 1
    out = [Level(context << 8 | prefix, n * (1 - one), n * one)]
    for d in range(depth - 1, least - 1, -1):
        below = out[-1]
        nearer = (below.keys >> 8) & ((1 << (8 * d)) - 1)
        out.append(Level(nearer << 8 | (below.keys & 255), below.n0, below.n1))
        out[-1].mix(below)
    return out


def subtree_roots(depth: int, cut: int):
    """Of grams in whole subtrees: the subtrees' roots, at depth cut."""

    def run(t: pa.Table) -> pa.Table:
        code, n = t["code"].to_numpy(), t["n"].to_numpy()
        roots = [levels(code, n, bit, depth, cut)[-1] for bit in range(8)]
        return pa.table({k: np.concatenate([getattr(x, k) for x in roots]) for k in ("keys", "n0", "n1", "weighted")})

    return run


def raised(t: pa.Table, depth: int) -> tuple[Level, np.ndarray]:
    """From nodes one deeper: those at depth, and the deeper ones' keys."""
    keys = t["keys"].to_numpy()
    level = Level(keys & ((1 << 8 * depth + 8) - 1), t["n0"].to_numpy(), t["n1"].to_numpy())
    level.weighted = np.logaddexp(HALF + level.own, HALF + np.bincount(level.of, t["weighted"].to_numpy(), len(level.keys)))
    return level, keys


def raised_roots(depth: int):
    def run(t: pa.Table) -> pa.Table:
        level, _ = raised(t, depth)
        return pa.table({k: getattr(level, k) for k in ("keys", "n0", "n1", "weighted")})

    return run


Top = tuple[np.ndarray, np.ndarray, np.ndarray]


def top_nodes(roots: list[tuple[int, float, float, float]]) -> Top:
    """From the sums over depth-1 nodes (key, n0, n1, children's weighted): for each key at depth 1 (context byte, bits) the probability of a one when coding stops at depth 0 or 1, and the weight of what is deeper."""
    keys, n0, n1, below = (np.array(x) for x in zip(*roots, strict=True)) if roots else (np.zeros(0, np.int64),) * 4
    one = Level(keys, n0, n1)
    one.weighted = np.logaddexp(HALF + one.own, HALF + np.bincount(one.of, below, len(one.keys)))
    zero = Level(one.keys & 255, one.n0, one.n1)
    zero.mix(one)
    stop0, stop1 = zero.stop()[zero.of], one.stop()
    base = stop0 * zero.ones()[zero.of] + (1 - stop0) * stop1 * one.ones()
    return one.keys, base, (1 - stop0) * (1 - stop1)


def above(top: Top, cut: int):
    """For nodes at depth cut (2 or 3): the probability of a one when coding stops above them, and the weight of the rest."""

    def run(t: pa.Table) -> pa.Table:
        keys = t["keys"].to_numpy()
        at = np.searchsorted(top[0], keys & 0xFFFF)
        base, rest = top[1][at], top[2][at]
        if cut == 3:
            level, _ = raised(t, 2)
            stop = level.stop()[level.of]
            base, rest = base + rest * stop * level.ones()[level.of], rest * (1 - stop)
        return pa.table({"keys": keys, "base": base, "rest": rest})

    return run


def below(cut: int):
    """For nodes one deeper than cut: the same as ``above``, from that of the nodes at cut."""

    def run(t: pa.Table, over: pa.Table) -> pa.Table:
        level, keys = raised(t, cut)
        order = np.argsort(over["keys"].to_numpy())
        nodes, base, rest = (over[c].to_numpy()[order] for c in ("keys", "base", "rest"))
        at, stop = np.searchsorted(nodes, level.keys)[level.of], level.stop()[level.of]
        return pa.table({"keys": keys, "base": base[at] + rest[at] * stop * level.ones()[level.of], "rest": rest[at] * (1 - stop)})

    return run


def gram_scores(depth: int, cut: int):
    """log10 probability of each gram's byte after its context, from whole subtrees and what is above their roots."""

    def run(grams: pa.Table, over: pa.Table) -> pa.Table:
        code, n = grams["code"].to_numpy(), grams["n"].to_numpy()
        order = np.argsort(over["keys"].to_numpy())
        keys, base, rest = (over[c].to_numpy()[order] for c in ("keys", "base", "rest"))
        value = np.zeros(len(code))
        for bit in range(8):
            deep = levels(code, n, bit, depth, cut)
            node = deep[0].of  # each gram's node, from the deepest level up
            p = deep[0].ones()[node]
            for level in deep[1:]:
                node = level.of[node]
                q = level.stop()[node]
                p = q * level.ones()[node] + (1 - q) * p
            at = np.searchsorted(keys, deep[-1].keys)[node]
            p = base[at] + rest[at] * p
            value += np.log10(np.where((code >> (7 - bit)) & 1 == 1, p, 1 - p))
        return pa.table({"code": code, "value": value})

    return run


def block_scores(depth: int, ends: int, total: int, distinct: int):
    """A block's pieces scored with the words and grams that were sent back to it. ends, total, distinct: training texts, tokens, distinct tokens."""

    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        lines = sent.filter(pc.is_valid(sent["word"])).select(["word", "value"]).combine_chunks()
        names, counts = lines["word"], lines["value"].to_numpy()
        norm = total + 0.5 * (distinct + 1)
        end = float(np.log10((ends + 0.5) / norm))
        logs = np.log10((counts + 0.5) / norm)
        n_tokens, n_known, base_score, score = [], [], [], []
        sizes = pc.binary_length(docs["data"]).to_pylist()
        for of in lumps(sizes, COUNTED):
            c = docs.slice(of.start, of.stop - of.start)
            each, flat = [], []
            for x, k, w in zip(*(c[x].to_pylist() for x in ("data", "cut", "own")), strict=True):
                own = words_of(x.lower(), k, w)
                each.append(len(own))
                flat += own
            at = pc.index_in(pa.array(flat, pa.binary()), value_set=names).to_numpy()
            stops, done = np.cumsum([0, *each]), c["last"].to_numpy()
            for out, per, more in ((n_tokens, np.ones(len(at), np.int64), 1), (n_known, (counts[at] > 0).astype(np.int64), int(ends > 0)), (base_score, logs[at], end)):
                sums = np.concatenate((np.zeros(1, per.dtype), np.cumsum(per)))
                out += (sums[stops[1:]] - sums[stops[:-1]] + np.where(done, more, 0)).tolist()
        del lines, names
        tail = sent.filter(pc.is_valid(sent["code"])).select(["code", "value"])
        code, value = tail["code"].to_numpy(), tail["value"].to_numpy()
        del tail
        order = np.argsort(code)
        code, value = code[order], value[order]
        for of in lumps(sizes, SCORED):
            c = docs.slice(of.start, of.stop - of.start)
            before, data, last = (c[x].to_pylist() for x in ("before", "data", "last"))
            every, at, size = framed([x.lower() for x in before], [x.lower() for x in data], last, depth)
            mixed = np.argsort(every)
            every = every[mixed]
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
            found = every[starts]
            place = np.minimum(np.searchsorted(code, found), max(0, len(code) - 1))
            own_value = np.where(code[place] == found, value[place], 1.0) if len(code) else np.ones(len(found))  # codes between two pieces have none and aren't summed
            per = np.empty(len(every))
            per[mixed] = np.repeat(own_value, np.diff(np.append(starts, len(every))))
            none = np.flatnonzero(per > 0)
            of_none = np.searchsorted(at, none, "right") - 1
            if (none < at[of_none] + size[of_none]).any():
                raise ValueError("a gram of this block has no value")
            per[none] = 0.0
            sums = np.concatenate(([0.0], np.cumsum(per)))
            score += (sums[at + size] - sums[at]).tolist()
        pa.default_memory_pool().release_unused()
        return pa.table({
            "doc_id": docs["doc_id"], "th": docs["th"], "part": docs["part"], "long": docs["long"], "held_out": docs["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()), "n_bytes": pc.binary_length(docs["data"]).cast(pa.int64()),
        })

    return run


def piece_rows(docs: DataFrame, held_out: Column, depth: int, size: int, text_col: str, id_col: str) -> DataFrame:
    """Each text, those longer than size in pieces: doc_id, th (a hash of the text), part, long, held_out, used (for training), before, data, last, cut, own."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "held_out", "text")
    whole = rows.filter(F.octet_length("text") <= size).select("doc_id", "th", "held_out", F.lit(0).alias("part"), F.lit(False).alias("long"), F.unhex(F.lit("FF" * depth)).alias("before"), F.col("text").alias("data"), F.lit(True).alias("last"), F.lit(0).alias("cut"), F.lit(None).cast("binary").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "held_out", "part", "long", "before", "data", "last", "cut", "own"]
        for b in batches:
            for k in range(len(b)):
                text, start = b.column(3)[k].as_py(), 0
                for part, (before, data, cut, own) in enumerate(pieces(text, depth, size)):
                    start += len(data)
                    own_row = [pa.array([part], pa.int32()), pa.array([True]), pa.array([before], pa.binary()), pa.array([data], pa.binary()), pa.array([start == len(text)]), pa.array([cut], pa.int32()), pa.array([own], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*[b.column(j).slice(k, 1) for j in range(3)], *own_row], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.filter(F.octet_length("text") > size).mapInArrow(run, f"doc_id {kind}, th long, held_out boolean, part int, long boolean, before binary, data binary, last boolean, cut int, own binary")
    return whole.unionByName(cut).withColumn("used", ~F.col("held_out"))


def score(docs: DataFrame, held_out: Column, depth: int = 5, block_bytes: int = 24 << 20, least_blocks: int = 16, block_grams: int = 1 << 22, piece_bytes: int = PIECE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte. Texts that aren't held_out are learnt from."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    rows = piece_rows(docs, held_out, depth, piece_bytes, text_col, id_col)
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)).cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes), min(least_blocks, -(-size // (1 << 21))))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "th", "part"), F.lit(blocks)).cast("long"))
        keys = stored(dealt.repartition(2 * blocks, "block").groupBy("block").applyInArrow(block_keys(depth), KEYS), "keys")
        most = keys.filter("code IS NOT NULL").groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if most <= block_grams or size // blocks < 1 << 16:
            break
        discard(keys)
        blocks *= max(2, -(-5 * most // (4 * block_grams)))  # where few grams repeat, their number falls with a block's size

    totals = keys.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("total"))
    totals = stored(totals, "words")
    sums = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count_if(F.col("total") > 0).alias("v")).first()
    ends = keys.filter("word IS NULL AND code IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    codes = stored(keys.filter(F.col("code").isNotNull()).groupBy("code").agg(F.sum("n").alias("n")), "grams")
    values = stored(code_values(codes, depth), "values")
    discard(codes)
    sent_words = keys.filter("word IS NOT NULL").select("block", "word").join(sized(totals, 300_000), "word").select("block", "word", F.lit(None).cast("long").alias("code"), F.col("total").cast("double").alias("value"))
    sent_codes = keys.filter("code IS NOT NULL").select("block", "code").join(sized(values, 1_500_000), "code").select("block", F.lit(None).cast("binary").alias("word"), "code", "value")
    sent = stored(sent_words.unionByName(sent_codes), "sent")
    discard(keys, totals, values)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, part int, long boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    # Few blocks to a partition: a task sorts its partition's rows by block.
    docs_by, sent_by = (x.repartition(2 * blocks, "block").groupBy("block") for x in (dealt, sent))
    found = docs_by.cogroup(sent_by).applyInArrow(block_scores(depth, ends, sums["n"] + ends, sums["v"] + (ends > 0)), schema)
    found = stored(found, "scored")
    discard(sent)
    numbers = ("n_tokens", "n_known", "base_score", "score", "n_bytes")
    # Equal rows' pieces meet here; their number is that of their first pieces.
    joined = found.filter("long").groupBy("doc_id", "th", "held_out").agg(F.count_if(F.col("part") == 0).alias("rows"), *[F.sum(c).alias(c) for c in numbers])
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("doc_id", "held_out", *[(F.col(c) / F.col("rows")).cast(found.schema[c].dataType).alias(c) for c in numbers])
    out = found.filter("NOT long").select("doc_id", "held_out", *numbers).unionByName(joined)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sums["n"] + ends).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def code_values(codes: DataFrame, depth: int, bucket_rows: int = 1 << 21, hot_rows: int = 1 << 21) -> DataFrame:
    """code and value (log10 probability of its byte) for each of the corpus's grams (code, n; stored)."""
    cut = min(3, depth)
    nodes_schema, over_schema, value_schema = "keys long, n0 double, n1 double, weighted double", "keys long, base double, rest double", "code long, value double"

    def nearest(key: str, n: int) -> Column:
        """The n context bytes nearest to the byte of a code or a node."""
        return F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))

    def bucket(context: Column, rows: int) -> Column:
        return F.pmod(F.xxhash64(context), F.lit(max(1, -(-rows // bucket_rows)))).cast("int").alias("bucket")

    total = codes.count()
    hot = stored(codes.groupBy(nearest("code", cut).alias("near")).count().filter(F.col("count") > hot_rows).select("near"), "hot") if depth > 4 else None
    any_hot = hot is not None and not hot.isEmpty()

    def part(rows: DataFrame, key: str, how: str) -> DataFrame:
        return rows.withColumn("near", nearest(key, cut)).join(sized(hot), "near", how).drop("near") if any_hot else rows

    grams = part(codes.select("code", "n"), "code", "left_anti").withColumn("bucket", bucket(nearest("code", cut), total))
    roots = stored(grams.groupBy("bucket").applyInArrow(subtree_roots(depth, cut), nodes_schema), "roots")
    if any_hot:
        hot_grams = part(codes.select("code", "n"), "code", "left_semi").withColumn("bucket", bucket(nearest("code", cut + 1), total))
        deep = stored(hot_grams.groupBy("bucket").applyInArrow(subtree_roots(depth, cut + 1), nodes_schema), "deep")
        deep_by = deep.groupBy(bucket(nearest("keys", cut), deep.count()))
        hot_roots = stored(deep_by.applyInArrow(raised_roots(cut), nodes_schema), "roots")
        roots = roots.unionByName(hot_roots)
    dealt = roots.select("*", bucket(nearest("keys", 2), roots.count()))
    upper = dealt.groupBy("bucket").applyInArrow(raised_roots(2), nodes_schema) if cut == 3 else roots
    key = F.col("keys").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("key")
    top = top_nodes(upper.groupBy(key).agg(F.sum("n0"), F.sum("n1"), F.sum("weighted")).collect())  # at most 256 * 255 rows
    over = dealt.groupBy("bucket").applyInArrow(above(top, cut), over_schema)
    if not any_hot:
        over = over.select("*", bucket(F.shiftrightunsigned("keys", 8), total))
        return grams.groupBy("bucket").cogroup(over.groupBy("bucket")).applyInArrow(gram_scores(depth, cut), value_schema)
    over = stored(over, "over")
    cold_over = part(over, "keys", "left_anti").withColumn("bucket", bucket(nearest("keys", cut), total))
    values = grams.groupBy("bucket").cogroup(cold_over.groupBy("bucket")).applyInArrow(gram_scores(depth, cut), value_schema)
    hot_over = part(over, "keys", "left_semi").groupBy(bucket(nearest("keys", cut), deep.count()))
    hot_over = deep_by.cogroup(hot_over).applyInArrow(below(cut), over_schema).withColumn("bucket", bucket(nearest("keys", cut + 1), total))
    hot_values = hot_grams.groupBy("bucket").cogroup(hot_over.groupBy("bucket")).applyInArrow(gram_scores(depth, cut + 1), value_schema)
    return values.unionByName(hot_values)

"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints (a bit is 1 if over half of a text's shingle hashes have it) are made distinct, and the trie over them is
joined with itself: two nodes of equal depth are looked at together, the bits in which their paths differ are added up, and the
pair is dropped once they exceed the error budget. A traversal is vectorised over the frontier of node pairs, which
is cut into pieces of bounded size and walked depth first.

``mark`` takes 64 bits and links at a few differing ones. The trie is dealt out by the first levels: of ``budget`` + 1 blocks of bits, two fingerprints within
the budget agree in one, so each fingerprint goes, once for each block, to the subtrie of those with like bits there, and links are exact. A subtrie that holds over ``HOT`` is dealt again by blocks of its remaining bits: four copies of a fingerprint
while subtries of 16 bits aren't full (about 1e9 distinct fingerprints), 16 in full ones up to about 4e12, 64 beyond. Small subtries share a task.

``drop`` keeps one document of each group of near copies, where two texts are near copies if
their sets of five-word shingles have a Jaccard likeness of 0.8 or more. Fingerprints of many words of 64 bits only propose pairs. Each word is a trie of its own, dealt by its first bits;
two texts meet in it if these are equal, and are proposed if they differ in at most a budget of the word's other bits and of 192 more. At a likeness of 0.8 a bit differs with a chance
of 0.15 to 0.16 (few shingles: up to 0.18); the number of words follows from the number of rows, so that a pair at 0.8 meets nowhere with a chance of ``MISSED`` at most. Budgets are 4.2 standard deviations above the mean.
Texts of one set of shingles are one node. A unit emits a spanning forest of its proposed pairs. Each document's nearest one is checked, first on all bits and then on the texts themselves. Where a group of proposed pairs is not joined by these links,
its documents meet again, group by group, with the hashes of their shingles, and all pairs not joined yet that meet in some trie are checked there, exactly: no failed pair hides another one, and only links leave a unit.
A subtrie with over ``HOT`` rows is cut into parts, and each pair of parts is a unit: no task holds more than two parts. Tries are dealt out ``ROUND`` at a time, and a group walks all of them where it is, so neither
fingerprints nor sets of hashes are on disk once for each trie.

A unit emits at most one row per fingerprint, never all pairs of a dense group, and
the forests' union is resolved by distributed contraction of edges, on stored tables.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; null ids get a
component like others and never are its smallest id unless all of it are null; very long texts are hashed whole, in lumps; an empty table gives an empty table; repeated rows
get equal results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sized, stored, text_of

#: Fingerprints of a group of small subtries, about; rows of a subtrie that is dealt again; node pairs or leaf pairs that a step handles at once.
UNIT, HOT, STEP = 1 << 13, 1 << 14, 1 << 20
#: Of shingles' hashes in one part.
HOT_BYTES = 1 << 26
#: Of long fingerprints' tries: those dealt out at once. Rows of a group that meet in one unit, about, and the parts that a larger one is cut into before they hold HOT rows or HOT_BYTES.
ROUND, MEET, PARTS = 16, 1 << 8, 8
#: Of long fingerprints: words that are compared wherever two texts meet; rows below the first bits of a word, about; the chance that a bit differs at a likeness of 0.8, and that such a pair meets nowhere.
LONGS, BELOW, DIFFERS, MISSED = 3, 1 << 11, 0.16, 1e-4


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of words, or of all words if they are fewer; none without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, "<u8")
    text = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(text, 42)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(text[s:e], 42) for s, e in spans], "<u8")


def print_of(hashes: np.ndarray, longs: int = 1) -> np.ndarray:
    """longs words of 64 bits, each 1 where over half of the hashes have it. Beyond the first word the hashes are mixed anew."""
    out = np.zeros(longs, "<u8")
    for k in range(longs):
        own = hashes
        if k:
            own = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            own = own ^ (own >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 14):
            ones += np.unpackbits(own[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
        out[k] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a long) for each row; repeated shingles count each time."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [print_of(shingle_hashes(words_of(t.as_py()), shingle))[0] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Forest:
    """Components of 0..n-1, each named by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of all pairs within the budget; both sorted. right None: left with itself, each pair once. depth: as many first bits must be equal."""
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    if depth:
        tops = np.unique(left >> np.uint64(64 - depth))
        low, high = tops << np.uint64(64 - depth), (tops << np.uint64(64 - depth)) | np.uint64((1 << (64 - depth)) - 1)
        al, ah, bl, bh = (np.searchsorted(x, y, side) for x in (left, right) for y, side in ((low, "left"), (high, "right")))
        some = (bh > bl) & ((ah - al > 1) | (not own))
        al, ah, bl, bh = al[some], ah[some], bl[some], bh[some]
    else:
        al = bl = np.zeros(1, np.int64)
        ah, bh = al + len(left), bl + len(right)
    stack = [(depth, *(x[k : k + STEP] for x in (al, ah, bl, bh, np.zeros(len(al), np.int64)))) for k in range(0, len(al), STEP)]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        leaf = ((ah - al) * (bh - bl) <= 64) | (depth == 64)
        if leaf.any():
            yield from _leaves(left, right, own, budget, *(x[leaf] for x in (al, ah, bl, bh)))
            al, ah, bl, bh, diff = (x[~leaf] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        am, bm = _middles(left, al, ah, depth), _middles(right, bl, bh, depth)
        same = own & (al == bl)
        sides = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        sides.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*sides, strict=True))
        alive = (ah > al) & (bh > bl) & (diff <= budget)
        al, ah, bl, bh, diff = (x[alive] for x in (al, ah, bl, bh, diff))
        for k in range(0, len(al), STEP):
            stack.append((depth + 1, *(x[k : k + STEP] for x in (al, ah, bl, bh, diff))))


def _middles(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at this depth turns to 1 in each range of values that agree in all bits before."""
    bit = np.uint64(1 << (63 - depth))
    before = np.uint64(((1 << depth) - 1) << (64 - depth) if depth else 0)
    return np.clip(np.searchsorted(values, (values[low] & before) | bit), low, high)


def _leaves(left: np.ndarray, right: np.ndarray, own: bool, budget: int, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (ah - al) * (bh - bl)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
        n, of = sizes[start:stop], slice(start, stop)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat((bh - bl)[of], n)
        a, b = np.repeat(al[of], n) + at // width, np.repeat(bl[of], n) + at % width
        near = np.bitwise_count(left[a] ^ right[b]) <= budget
        if own:
            near &= a < b
        yield a[near], b[near]
        start = stop


def _again(rows: DataFrame, depth: int, blocks: int) -> tuple[DataFrame, int]:
    """rows (fp, kind, key) once for each of the blocks of the bits from depth on: key has that block's bits moved to the front of them. And the new depth."""
    rest = 64 - depth
    size = rest // blocks
    mask = (1 << rest) - 1
    low, top = F.col("key").bitwiseAND(F.lit(mask if rest < 64 else -1).cast("long")), F.col("key").bitwiseAND(F.lit(~mask if rest < 64 else 0).cast("long"))
    turned = [low if not j else F.shiftleft(low, j * size).bitwiseAND(F.lit(mask if rest < 64 else -1).cast("long")).bitwiseOR(F.shiftrightunsigned(low, rest - j * size)) for j in range(blocks)]
    each = F.explode(F.array(*[F.struct((F.col("kind") * blocks + j).alias("kind"), top.bitwiseOR(t).alias("key")) for j, t in enumerate(turned)])).alias("x")
    return rows.select("fp", each).select("fp", "x.kind", "x.key"), depth + size


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Spanning links (a, b) between the distinct values of column fp that differ in at most budget bits."""
    rows, depth = _again(distinct.select("fp", F.lit(0).cast("long").alias("kind"), F.col("fp").alias("key")), 0, budget + 1)
    dealt = None
    while True:
        subtrie = F.shiftrightunsigned("key", 64 - depth).alias("subtrie")
        n = rows.select("kind", subtrie).groupBy("kind", "subtrie").count()
        hot = stored(n.filter(F.col("count") > HOT).select("kind", "subtrie"), "hot") if 64 - depth > 4 * (budget + 1) else None
        full = hot is not None and not hot.isEmpty()
        rows = rows.withColumn("subtrie", subtrie)
        small = rows.join(sized(hot), ["kind", "subtrie"], "left_anti") if full else rows
        part = small.select("fp", "kind", "key", F.lit(depth).alias("depth"), F.xxhash64("kind", "subtrie").alias("of"))
        dealt = part if dealt is None else dealt.unionByName(part)
        if not full:
            break
        rows, depth = _again(rows.join(sized(hot), ["kind", "subtrie"], "left_semi").drop("subtrie"), depth, budget + 1)
    units = max(1, -(-distinct.count() * (budget + 1) // UNIT))

    def run(t: pa.Table) -> pa.Table:
        fp, kind, key, deep = t["fp"].to_numpy(), t["kind"].to_numpy(), t["key"].to_numpy().view(np.uint64), t["depth"].to_numpy()
        nodes, at = np.unique(fp, return_inverse=True)
        forest = Forest(len(nodes))
        for k in np.unique(kind):
            of = np.flatnonzero(kind == k)
            of = of[np.argsort(key[of])]
            for d in np.unique(deep[of]):
                own = of[deep[of] == d]
                for a, b in trie_join(key[own], None, budget, int(d)):
                    forest.link(at[own[a]], at[own[b]])
        linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return pa.table({"a": nodes[linked], "b": nodes[forest.root[linked]]})

    return dealt.groupBy(F.pmod("of", F.lit(units)).alias("unit")).applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the component's smallest node) for all nodes of the edges (a, b).

    Each round hooks every node that has a smaller neighbour to the smallest one, follows the hooks to their ends, and contracts the edges; the
    number of nodes with edges at least halves.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = stored(ordered(edges), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = stored(edges.groupBy("a").agg(F.min("b").alias("up")), "hooks")
        while True:
            further = hooks.select(F.col("a").alias("up"), F.col("up").alias("further"))
            new = stored(hooks.select("a", "up").join(further, "up", "left").select("a", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "hooks")
            still = new.filter("moved").isEmpty()
            discard(hooks)
            hooks = new
            if still:
                break
        to = hooks.select(F.col("a").alias("at"), "up")
        relabelled = stored(labels.join(to, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        left = edges.join(to, F.col("a") == F.col("at")).select(F.col("up").alias("a"), "b")
        contracted = stored(ordered(left.join(to, F.col("b") == F.col("at"), "left").select("a", F.coalesce("up", "b").alias("b"))), "edges")
        discard(hooks, labels, edges)
        labels, edges = relabelled, contracted
    discard(edges)
    return labels


def classes(prints: DataFrame, budget: int = 3) -> DataFrame:
    """For each distinct fp of (id, fp): component_id, the smallest id of all texts reachable over links."""
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")  # read by the result, as the labels are
    labels = components(links(reps.select("fp"), budget))
    named = reps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "label").select("fp", "component_id")


def mark(docs: DataFrame, shingle: int = 3, budget: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id for each row."""
    prints = stored(fingerprints(docs, shingle, text_col, id_col), "prints")
    found = classes(prints, budget)
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(words: list[bytes], shingle: int) -> set[bytes]:
    """Of fewer words than a shingle has, the text itself."""
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def over_mean(bits: int, deviations: float = 4.2) -> int:
    """So many of the bits differ at most, at a likeness of 0.8."""
    return int(np.ceil(bits * DIFFERS + deviations * np.sqrt(bits * DIFFERS * (1 - DIFFERS))))


def tries_for(n: int) -> tuple[int, int]:
    """For n rows: the bits by which each trie is dealt out, and the number of tries."""
    bits = max(4, int(np.ceil(np.log2(max(n, 1) / BELOW))))
    return bits, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - DIFFERS) ** bits))))


def text_hash(text_col: str) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text_of(text_col)))


def set_hash(found: np.ndarray, words: list[bytes], shingle: int) -> bytes:
    """128 bits of a text's set of shingles, of which found are the sorted hashes."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(found.tobytes(), 1) if len(found) > 1 else xxh3_128_digest(b" ".join(words[:shingle]), 2)


def _long_prints(docs: DataFrame, shingle: int, tries: int, text_col: str, id_col: str) -> DataFrame:
    """id, th (128 bits of the text), node and more (128 bits of its set of shingles), keys (a long for each trie) and fp (LONGS * 8 bytes), of distinct shingles, for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), text_hash(text_col).alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, fps = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                own = np.unique(shingle_hashes(words, shingle))
                nodes.append(set_hash(own, words, shingle))
                found = print_of(own, LONGS + tries)
                fps.append(found[:LONGS].tobytes())
                keys.append(found[LONGS:].view(np.int64))
            halves = np.frombuffer(b"".join(nodes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.binary())], ["id", "th", "node", "more", "keys", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th binary, node long, more long, keys array<long>, fp binary")


def set_nodes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prints (stored), and one node (node, rep, keys, fp; stored) for each of its sets of shingles. Sets that share the first 64 bits, of which few are to be expected in billions, get a node of their own from all 128."""
    each = prints.groupBy("node").agg(F.min_by(F.struct("th", "keys", "fp"), F.struct("more", "th")).alias("x"), F.min("more").alias("first"), F.max("more").alias("last"))
    nodes = stored(each.select("node", F.col("x.th").alias("rep"), "x.keys", "x.fp", "first", (F.col("first") != F.col("last")).alias("clash")), "nodes")
    clashes = nodes.filter("clash").select("node", "first")
    if clashes.isEmpty():
        return prints, nodes
    own = F.when(F.col("more") != F.col("first"), F.xxhash64("node", "more")).otherwise(F.col("node"))
    apart = stored(prints.join(sized(clashes), "node", "left").withColumn("node", own).drop("first"), "prints")
    discard(prints, nodes)
    return set_nodes(apart)


def _halves(rows: DataFrame, *columns: str) -> DataFrame:
    """columns of rows, once for each pair of parts that the row's part (of parts; null: 1) is in: lo, hi and whether it is the second of two (right)."""
    parts = F.coalesce("parts", F.lit(1))
    cut = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.select(*columns, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("right"))


def _unit(bits: int, least: float | None = None) -> Callable[[pa.Table], pa.Table]:
    """Of a unit's rows (node, label, fp, lo, hi, right, and key or keys: the words of the tries to be walked): a spanning forest of the proposed pairs (a, b, differ) of different labels, of pairs as near as possible.

    With least, rows also have sets (their shingles' hashes), and the pairs are a spanning forest of those with a likeness of least or more.
    """
    budget, total = over_mean(64 - bits), over_mean(64 - bits + 64 * LONGS)

    def run(t: pa.Table) -> pa.Table:
        keys = (t["key"] if "key" in t.column_names else t["keys"].combine_chunks().flatten()).to_numpy().view(np.uint64).reshape(len(t), -1)
        is_right = t["right"].to_numpy()
        order = np.lexsort((keys[:, 0], is_right))
        fp = np.frombuffer(b"".join(t["fp"].to_pylist()), "<u8").reshape(-1, LONGS)[order]
        node, label, keys, is_right = t["node"].to_numpy()[order], t["label"].to_numpy()[order], keys[order], is_right[order]
        n_left, own = int((~is_right).sum()), t["lo"][0].as_py() == t["hi"][0].as_py()
        forest = Forest(len(fp))
        firsts, at = np.unique(label, return_index=True)
        forest.link(np.arange(len(fp)), at[np.searchsorted(firsts, label)])
        exact = Likeness([t["sets"][int(k)].as_py() for k in order]) if least else None
        out = []
        for key in keys.T:
            by = np.lexsort((key, is_right))
            left, right = by[:n_left], by[:n_left] if own else by[n_left:]
            for a, b in trie_join(key[left], None if own else key[right], budget, bits):
                a, b = left[a], right[b]
                apart = forest.root[a] != forest.root[b]
                a, b = a[apart], b[apart]
                differ = np.bitwise_count(fp[a] ^ fp[b]).sum(1) + np.bitwise_count(key[a] ^ key[b])
                near = differ <= total
                a, b, differ = a[near], b[near], differ[near]
                if exact is not None:
                    out += exact.links(a, b, differ, forest, least)
                    continue
                nearest = np.argsort(differ, kind="stable")
                a, b, differ = a[nearest], b[nearest], differ[nearest]
                while len(a):
                    _, first = np.unique(np.maximum(forest.root[a], forest.root[b]), return_index=True)  # each hooks onto a smaller one: no rings
                    out.append((a[first], b[first], differ[first]))
                    forest.link(a[first], b[first])
                    apart = forest.root[a] != forest.root[b]
                    a, b, differ = a[apart], b[apart], differ[apart]
        a, b, differ = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        a, b = node[a], node[b]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b), "differ": differ.astype(np.int32)})

    return run


def near_pairs(nodes: DataFrame, bits: int, least: float | None = None) -> DataFrame:
    """Pairs (a, b, differ) of the nodes (node, label, keys, fp; with least also sets) that a unit of each trie finds: a row is sent once for each of its keys."""
    kept = ["node", "label", "fp", *(["sets"] if least else [])]
    each = nodes.select(*kept, F.posexplode("keys").alias("of", "key")).withColumn("subtrie", F.shiftrightunsigned("key", 64 - bits))
    weight = F.count("*") / HOT if not least else F.greatest(F.count("*") / HOT, F.sum(F.octet_length("sets")) / HOT_BYTES)
    hot = stored(each.groupBy("of", "subtrie").agg(F.ceil(weight).cast("int").alias("parts")).filter("parts > 1"), "hot")
    if hot.isEmpty():
        dealt = each.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("right", F.lit(False))
    else:
        dealt = _halves(each.join(sized(hot), ["of", "subtrie"], "left"), *kept, "of", "key", "subtrie")
    return dealt.groupBy("of", "subtrie", "lo", "hi").applyInArrow(_unit(bits, least), "a long, b long, differ int").groupBy("a", "b").agg(F.min("differ").alias("differ"))


def proposals(nodes: DataFrame, bits: int, tries: int) -> DataFrame:
    """near_pairs of the nodes (node, keys, fp; stored) in all tries, stored. Of each round of tries only the pairs stay on disk, so the copies that are there at once don't grow with the number of tries."""
    rounds = -(-tries // ROUND)
    each = -(-tries // rounds)
    found = []
    for k in range(0, tries, each):
        some = nodes.select("node", F.col("node").alias("label"), F.slice("keys", k + 1, each).alias("keys"), "fp")
        found.append(stored(near_pairs(some, bits), "proposed"))
    if len(found) == 1:
        return found[0]
    out = stored(functools.reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("differ").alias("differ")), "proposed")
    discard(*found)
    return out


def group_pairs(nodes: DataFrame, bits: int, tries: int, least: float) -> DataFrame:
    """Links (a, b) that join the nodes (node, label, group, keys, fp, sets; stored) of a group wherever two of different labels meet in a trie and have a likeness of least or more.

    Pairs that meet are all of one group, which walks its tries in one unit: sets are sent once. A group of over MEET nodes is cut into PARTS parts at most, unless these hold more than HOT rows or
    HOT_BYTES, and each pair of parts is a unit: sets are sent once for each part. Where that were oftener than once for each trie, they are sent for each trie.
    """
    size = nodes.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("sets")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / HOT), F.ceil(F.col("bytes") / HOT_BYTES), F.least(F.lit(PARTS), F.ceil(F.col("n") / MEET))).cast("int")
    sizes = stored(size.select("group", "n", "bytes", parts.alias("parts")), "sizes")
    small = sizes.filter("parts = 1").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    units = max(1, -(-(small["n"] or 0) // (2 * MEET)), -(-(small["bytes"] or 0) * 4 // HOT_BYTES))
    large = stored(sizes.filter("parts > 1").select("group", "parts"), "large")
    discard(sizes)
    whole = nodes.join(sized(large), "group", "left")
    unit = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("group"), F.lit(units))).otherwise(F.col("group")).alias("unit")
    dealt = _halves(whole.filter(F.coalesce("parts", F.lit(1)) <= tries).withColumn("unit", unit), "node", "label", "fp", "keys", "sets", "unit")
    found = stored(dealt.groupBy("unit", "lo", "hi").applyInArrow(_unit(bits, least), "a long, b long, differ int").select("a", "b"), "more")
    if not large.filter(F.col("parts") > tries).isEmpty():
        more = stored(near_pairs(whole.filter(F.col("parts") > tries), bits, least).select("a", "b"), "more")
        found = found.unionByName(more)
    discard(large)
    return found


class Likeness:
    """Exact Jaccard likenesses of a unit's sets of hashes: one set is marked, and many others are counted on it at once."""

    def __init__(self, sets: list[bytes]):
        each = [np.frombuffer(x, np.int64) for x in sets]
        self.size = np.array([len(x) for x in each])
        _, self.ids = np.unique(np.concatenate(each), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.marked = np.zeros(len(self.ids), bool)

    def links(self, a: np.ndarray, b: np.ndarray, differ: np.ndarray, forest: Forest, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        order = np.argsort(a, kind="stable")
        a, b, differ = a[order], b[order], differ[order]
        for one, at, n in zip(*np.unique(a, return_index=True, return_counts=True), strict=True):
            others, bits = b[at : at + n], differ[at : at + n]
            apart = forest.root[others] != forest.root[one]
            others, bits = others[apart], bits[apart]
            own = self.ids[self.start[one] : self.start[one] + self.size[one]]
            self.marked[own] = True
            for k in range(0, len(others), 4096):
                some, size = others[k : k + 4096], self.size[others[k : k + 4096]]
                places = np.repeat(self.start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                hits = np.concatenate(([0], np.cumsum(self.marked[self.ids[places]])))
                both = hits[np.cumsum(size)] - hits[np.cumsum(size) - size]
                union = self.size[one] + size - both
                like = both >= least * union
                some, near = some[like], bits[k : k + 4096][like]
                _, first = np.unique(forest.root[some], return_index=True)  # one link to each group
                ones = np.full(len(first), one)
                if len(first):
                    joins = forest.root[some[first]] != forest.root[one]
                    out.append((ones[joins], some[first][joins], near[first][joins]))
                    forest.link(ones, some[first])
            self.marked[own] = False
        return out


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float, text_col: str) -> DataFrame:
    """Those of the pairs (a, b; stored) whose texts' shingle sets have a likeness of least or more."""
    sides = [nodes.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab"]
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "keys_a", "keys_b", "fp_a", "fp_b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.hstack([b.column(k).flatten().to_numpy().view(np.uint64).reshape(len(b), -1), np.frombuffer(b"".join(b.column(k + 2).to_pylist()), "<u8").reshape(len(b), -1)]) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= over_mean(64 * x.shape[1], 5.0)))

    pairs = stored(both.mapInArrow(likely, "a long, b long"), "likely")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    named = stored(named, "named")
    texts = docs.select(text_hash(text_col).alias("rep"), text_of(text_col).alias("text")).join(sized(named), "rep").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    left = texts.join(sized(pairs.select("a", "b")), F.col("node") == F.col("a")).select("a", "b", F.col("text").alias("one"))
    both = left.join(texts, F.col("node") == F.col("b")).select("a", "b", "one", F.col("text").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = [jaccard(shingles(words_of(x.as_py()), shingle), shingles(words_of(y.as_py()), shingle)) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    out = stored(both.mapInArrow(run, "a long, b long"), "alike")
    discard(texts, named, pairs)
    return out


def with_sets(nodes: DataFrame, docs: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """nodes (with rep; stored) and the hashes of their shingles, as binary."""
    wanted = sized(nodes.select("rep"))
    rows = docs.select(text_hash(text_col).alias("rep"), text_of(text_col).alias("text")).join(wanted, "rep", "left_semi").select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(words_of(x.as_py()), shingle)).tobytes() for x in b.column(1)], pa.binary())], ["rep", "sets"])

    sets = rows.mapInArrow(run, "rep binary, sets binary").groupBy("rep").agg(F.min("sets").alias("sets"))
    return nodes.join(sets, "rep")


def near_copies(nodes: DataFrame, docs: DataFrame, shingle: int, least: float, bits: int, tries: int, text_col: str) -> DataFrame:
    """node and label (the smallest node of its group) for the nodes (node, rep, keys, fp; stored) that have near copies."""
    proposed = proposals(nodes, bits, tries)
    nearest = stored(proposed.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b")), "nearest")
    sure = alike(nearest, nodes, docs, shingle, least, text_col)
    discard(nearest)
    labels = components(sure)
    of = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    apart = proposed.join(of[0], "a", "left").join(of[1], "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    apart = stored(apart.select(F.col("a").alias("node")).distinct(), "apart")
    if apart.isEmpty():
        discard(proposed, sure, apart)
        return labels
    # All nodes of the groups of proposed pairs that aren't joined yet.
    groups = components(proposed.select("a", "b"))
    unjoined = groups.join(apart, "node", "left_semi").select("label").distinct()
    mixed = groups.join(unjoined, "label", "left_semi").select("node", F.col("label").alias("group"))
    some = stored(nodes.join(mixed, "node").join(labels, "node", "left").select("node", "rep", "keys", "fp", F.coalesce("label", "node").alias("label"), "group"), "again")
    discard(proposed, groups, apart)
    again = stored(with_sets(some, docs, shingle, text_col), "again")
    discard(some)
    more = group_pairs(again, bits, tries, least)
    discard(again)
    if not more.isEmpty():
        discard(labels)
        labels = components(sure.unionByName(more))
    discard(sure, more)
    return labels


def drop(docs: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group of near copies: that of the smallest id stays (a null id only where there is no other)."""
    bits, tries = tries_for(docs.count())
    wide, nodes = set_nodes(stored(_long_prints(docs, shingle, tries, text_col, id_col), "prints"))
    prints = stored(wide.select("id", "th", "node"), "narrow")
    discard(wide)
    labels = near_copies(nodes, docs, shingle, least, bits, tries, text_col)
    groups = prints.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.struct(F.col("id").isNull().alias("no_id"), "id", "th").alias("row"))
    one = groups.groupBy("label", "row").agg(F.count("*").alias("n")).groupBy("label").agg(F.min_by("n", "row").alias("n"), F.min("row").alias("stays"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    one = stored(one, "stays")
    same = F.struct(F.col("stays.no_id"), "stays.id", "stays.th")
    gone = stored(groups.join(one, "label").filter(F.col("row") != same).select("row.*").distinct(), "gone")
    again = stored(one.filter("n > 1").select("stays.*"), "again")
    discard(prints, nodes, labels, one)
    rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("th"))

    def hit(other: DataFrame, how: str) -> DataFrame:
        o = other.select(*[F.col(c).alias(f"o_{c}") for c in ("no_id", "id", "th")])
        return rows.join(o, (F.col("th") == F.col("o_th")) & (F.col("no_id") == F.col("o_no_id")) & F.col("id").eqNullSafe(F.col("o_id")), how)

    repeated = hit(sized(again), "left_semi").groupBy("no_id", "id", "th").agg(F.first("doc").alias("doc")).select("doc.*")
    return hit(sized(stored(gone.unionByName(again), "out")), "left_anti").select("doc.*").unionByName(repeated)

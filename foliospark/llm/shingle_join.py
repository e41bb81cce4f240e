"""Jaccard self-join of texts on word shingles, by T-occurrence search.

A document is the set of its distinct shingles (five words; the whole sequence if there are fewer). Two sets a and b are linked when their likeness is at least ``percent``; they then share
T = ceil(percent * (|a| + |b|) / (100 + percent)) shingles or more, and either lacks m = |a| - ceil(percent * |a| / 100) of its own at most.

1. Equal sets become one node (grouped by 128 bits of hash), so copies are joined by membership alone.
2. Of each node's shingles those whose hash lies in the first ``SAMPLE`` part of all hashes are counted. One that no other node has is *lone*. A node with more than m lone ones has no
   partner: most nodes end here, and no node's shingles were moved whole for it.
3. For the others all shingles are counted, and a node keeps the lists of its m + 1 - (lone ones) rarest shared shingles: by the pigeonhole principle two linked nodes have one of these lists in common
   (ties of frequency are broken by hash, so the order is the same for all).
4. Nodes that meet are a unit: their sets go to one task, which builds inverted lists over them and runs the T-occurrence search: for each node the short lists of its shingles
   are merged by a heap that skips ahead (an id must occur T - L times in them), and the L longest lists are only probed by bisection for the ids that are left (DivideSkip). A unit emits links
   that join what belongs together, not all pairs, and passes over nodes that are joined already.
5. First each node meets the center of most of its lists, the node with the fewest lone shingles: that joins families of near copies at the cost of one copy of each set.
6. Then only the lists that still hold nodes of several components are searched, so that no link between them is lost. They are cut into bands of the smaller partner's size, as two linked nodes together
   have at most (100 + percent) / percent times as many shingles as either shares with others; units with the same nodes are searched once, and a pair is looked at in the first list that it has
   in common. A unit of more than ``HOT`` nodes (or bytes) is cut into parts, and each pair of parts is a unit.

Components are resolved on stored tables. Shingles are compared by 64-bit hashes of theirs.

Edge cases: a null text counts as empty; a text without words has an empty set and is a component of its own, as is each row of a repeated id of such; repeated rows get equal results; a null id is the smallest only
where all are null; very long texts are cut into shingles whole; an empty table gives an empty table. Only the id and the outputs are returned, so other columns clash with nothing.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, sized, stored, text_of
from .simhash_trie import components, words_of

#: Part of all hashes that the first count looks at. More than 1 - percent / 100, so that a node without a partner shows as one.
SAMPLE = 0.34
#: Nodes, and bytes of their sets, in a part of a unit; bytes of units that share a task, about.
HOT, HOT_BYTES, BUCKET = 1 << 9, 1 << 24, 1 << 23
#: A band of sizes reaches to so many times its smallest.
BAND = 1.12
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words; of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(words) - shingle + 1)
    h = np.full(runs, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        h = (h ^ (h >> np.uint64(31))) * _MIX[k % len(_MIX)] + each[k : k + runs]
    return np.unique(_finished(h))


def need(size: int, percent: int) -> int:
    """Of its own shingles a linked set shares so many at least."""
    return -(-percent * size // 100)


def _keys(docs: DataFrame, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """id, th (a hash of the text), h1, h2 (128 bits of its set) and size for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sets = [shingle_set(words_of(t.as_py()), shingle) for t in b.column(2)]
            both = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in sets], pa.int64())], ["id", "th", "h1", "h2", "size"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], rows.schema["th"]]).add("h1", "long").add("h2", "long").add("size", "long"))


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """node and text of the rows that stand for the nodes (node, id, th)."""
    of = nodes.select("node", F.col("id").alias("n_id"), F.col("th").alias("n_th"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    return rows.join(sized(of), (F.col("th") == F.col("n_th")) & F.col("id").eqNullSafe(F.col("n_id"))).select("node", "text")


def _sampled(texts: DataFrame, shingle: int, share: float) -> DataFrame:
    """node, token: the shingles of each node (node, text) below a share of all hashes."""
    most = np.uint64(int(share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), 256):
                some = b.slice(low, 256)
                sets = [(s := shingle_set(words_of(t.as_py()), shingle))[: np.searchsorted(s, most)] for t in some.column(1)]
                at = np.repeat(some.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(sets).view(np.int64))], ["node", "token"])

    return texts.mapInArrow(run, "node long, token long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and its set's hashes, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(words_of(t.as_py()), shingle).tobytes() for t in b.column(1)], pa.binary())], ["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens binary").groupBy("node").agg(F.min("tokens").alias("tokens"))


def may_pair(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Nodes (node, size) that aren't shown to be without a partner by their lone shingles in the sample."""
    counted = _sampled(texts, shingle, SAMPLE).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    lone = counted.filter("node = last").groupBy("node").agg(F.count("*").alias("lone"))
    spare = F.floor(F.col("size") - F.ceil(F.col("size") * percent / 100)).cast("long")
    return nodes.join(lone, "node", "left").filter(F.coalesce("lone", F.lit(0)) <= spare).select(nodes["*"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, shared, prefix: for each node (node, tokens) its rarest shared shingles in order, as many as two linked nodes need to have one in common; shared of its size shingles aren't lone. prefix: struct(n, token), n nodes have the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), 64):
                some = b.slice(low, 64)
                each = [np.frombuffer(t.as_py(), np.int64) for t in some.column(1)]
                size = np.array([len(x) for x in each])
                at = np.repeat(np.arange(len(some)), size)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), pa.array(size[at]), pa.array(np.concatenate(each))], ["node", "size", "token"])

    rows = sets.mapInArrow(run, "node long, size long, token long")
    often = rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(often, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("lists"))  # one document's
    spare = F.col("size") - F.ceil(F.col("size") * percent / 100) - (F.col("size") - F.size("lists"))
    kept = F.slice("lists", 1, F.greatest(spare + 1, F.lit(0)).cast("int"))
    return shared.select("node", "size", F.size("lists").cast("long").alias("shared"), kept.alias("prefix")).filter(F.size("prefix") > 0)


def largest(size: Column, shared: Column, percent: int) -> Column:
    """The largest partner of a node: both sizes together are at most (100 + percent) / percent of what either shares."""
    return F.floor(shared * (100 + percent) / percent).cast("long") - size


def banded(lists: DataFrame, percent: int) -> DataFrame:
    """Units of lists by the smaller partner's size: node, label, n, token, band, home. A node is at home in the band of its own size, if it can be the smaller one, and visits those that smaller partners of its may be in."""
    band = lambda c: F.floor(F.log(c.cast("double")) / np.log(BAND) + 1e-9).cast("int")
    most = largest(F.col("size"), F.col("shared"), percent)
    low, high = F.ceil(F.col("size") * percent / 100), F.least("size", most)
    rows = lists.filter(high >= low).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    return rows.select("node", "label", "n", "token", "band", ((F.col("band") == band(F.col("size"))) & (most >= F.col("size"))).alias("home"))


class Unit:
    """Inverted lists over the sets of a unit, and the T-occurrence search in them. Sets that can't have a partner here, by their sizes and the shingles that they share here, are in no list."""

    def __init__(self, sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None):
        """apart: a symmetric matrix of the pairs that are asked for (all, if None)."""
        size = np.array([len(s) for s in sets])
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        need = -(-percent * size // 100)
        apart = ~np.eye(len(sets), dtype=bool) if apart is None else apart
        alive = np.ones(len(sets), bool)
        for _ in range(3):
            n = np.bincount(at[alive[owner]], minlength=len(tokens))
            shared = np.bincount(owner, weights=(n > 1)[at], minlength=len(sets)).astype(np.int64)
            most = shared * (100 + percent) // percent - size
            self.may = apart & (size[None, :] >= need[:, None]) & (size[None, :] <= most[:, None]) & alive[None, :] & alive[:, None]
            self.may &= self.may.T
            before, alive = alive.sum(), self.may.any(1)
            if alive.sum() == before:
                break
        self.percent, self.size, self.alive = percent, size.tolist(), alive.tolist()
        some = alive[owner]
        owner, at = owner[some], at[some]
        order = np.lexsort((owner, at))
        ends = np.cumsum(np.bincount(at, minlength=len(tokens)))
        ordered = owner[order].tolist()
        self.lists = [ordered[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        starts = np.cumsum([0, *np.where(alive, size, 0)])
        self.of = [at[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def partners(self, one: int) -> Iterator[int]:
        """Ids of the other sets that are linked with this one."""
        if not self.alive[one]:
            return
        size, p, may = self.size[one], self.percent, self.may[one]
        least = -(-p * size // 100)  # a smaller partner has this many in all
        floor = -(-p * (size + least) // (100 + p))  # T of the smallest partner
        lists = sorted((self.lists[t] for t in self.of[one]), key=len)
        # DivideSkip: so many of the longest lists are probed only.
        longest = len(lists[-1])
        n_long = min(floor - 1, int(floor / (0.01 * np.log(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        wanted = floor - n_long
        heap = [(x[0], k, 0) for k, x in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= wanted:
            first = heap[0][0]
            popped = []
            while heap and heap[0][0] == first:
                popped.append(heapq.heappop(heap))
            if len(popped) >= wanted:
                if may[first]:
                    total = -(-p * (size + self.size[first]) // (100 + p))
                    both, left = len(popped), len(long)
                    for x in long:
                        if both >= total or both + left < total:
                            break
                        k = bisect_left(x, first)
                        both += k < len(x) and x[k] == first
                        left -= 1
                    if both >= total:
                        yield first
                to = first + 1
            else:  # ids before the next one that can occur often enough are skipped
                while heap and len(popped) < wanted - 1:
                    popped.append(heapq.heappop(heap))
                to = max(first + 1, heap[0][0] if heap else first + 1)
            for _, k, at in popped:
                at = bisect_left(short[k], to, at)
                if at < len(short[k]):
                    heapq.heappush(heap, (short[k][at], k, at))

    def links(self, labels: list[int], center: int | None = None) -> list[tuple[int, int]]:
        """Links that join all sets of this unit which linked ones connect, beyond what equal labels say. center: the set that is searched first."""
        root = list(range(len(labels)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        count = [1] * len(labels)

        def link(a: int, b: int) -> bool:
            a, b = top(a), top(b)
            if a != b:
                a, b = (a, b) if count[a] >= count[b] else (b, a)
                root[b] = a
                count[a] += count[b]
            return a != b

        first: dict[int, int] = {}
        for k, label in enumerate(labels):
            link(first.setdefault(label, k), k)
        out = []
        # A pair that isn't joined has a member outside the anchor's component, which only grows, so that one's search finds it.
        anchor = max(first.values(), key=lambda k: count[top(k)]) if center is None else center
        for k in [anchor, *(k for k in range(len(labels)) if k != anchor)]:
            if k == anchor or top(k) != top(anchor):
                out += [(k, other) for other in self.partners(k) if link(k, other)]
        return out


def _cut(dealt: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """dealt with parts and part (of a node in its unit), and how many buckets of units there are."""
    rows = dealt.join(sets.select("node", F.octet_length("tokens").alias("bytes")), "node")
    sizes = stored(rows.groupBy("unit").agg(F.ceil(F.greatest(F.count("*") / HOT, F.sum("bytes") / HOT_BYTES)).cast("int").alias("parts"), F.sum("bytes").alias("bytes")), "sizes")
    total = sizes.agg(F.sum(F.col("bytes") * F.col("parts"))).first()[0] or 0
    cut = dealt.join(sized(stored(sizes.filter("parts > 1").select("unit", "parts"), "hot")), "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut.withColumn("part", F.pmod(F.xxhash64("node", "unit"), F.col("parts")).cast("int")), max(1, -(-total // BUCKET))


def _groups(t: pa.Table, *by: str) -> Iterator[np.ndarray]:
    """Rows of each group of two or more, by node."""
    keys = [t["node"].to_numpy(), *(t[c].to_numpy() for c in by)]
    order = np.lexsort(keys)
    differ = np.zeros(len(order), bool)
    for k in keys[1:]:
        differ[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(differ)
    for own in np.split(order, starts):
        if len(own) > 1:
            yield own


def _tokens(t: pa.Table, own: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(t["tokens"][int(k)].as_py(), np.int64) for k in own]


def star_links(chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in the units of centers. chosen: node, unit (its center). Parts of a hot unit have the center each."""
    both = chosen.unionByName(chosen.select(F.col("unit").alias("node"), "unit")).distinct()
    cut, buckets = _cut(both, sets)
    every = F.when(F.col("node") == F.col("unit"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    met = cut.withColumn("part", F.explode(every)).select("unit", "part", "node").join(sets.select("node", "tokens"), "node").withColumn("bucket", F.pmod(F.xxhash64("unit", "part"), F.lit(buckets)))

    def run(t: pa.Table) -> pa.Table:
        unit, node, a, b = t["unit"].to_numpy(), t["node"].to_numpy(), [], []
        for own in _groups(t, "part", "unit"):
            center = np.flatnonzero(node[own] == unit[own])
            for x, y in Unit(_tokens(t, own), percent).links(list(range(len(own))), int(center[0]) if len(center) else None):
                a.append(node[own[x]])
                b.append(node[own[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("bucket").applyInArrow(run, "a long, b long")


def list_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different labels in units of lists. dealt: unit, token (the list's), node, label. A pair is looked at in the unit of the first list that it has in common, and in one pair of parts."""
    cut, buckets = _cut(dealt, sets)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    met = cut.select("unit", "lo", "hi", "part", "token", "node", "label").join(sets, "node").withColumn("bucket", F.pmod(F.xxhash64("unit", "lo", "hi"), F.lit(buckets)))

    def run(t: pa.Table) -> pa.Table:
        node, label, part, token, prefix = t["node"].to_numpy(), t["label"].to_numpy(), t["part"].to_numpy(), t["token"].to_numpy(), t["prefix"]
        lo, hi, a, b = t["lo"].to_numpy(), t["hi"].to_numpy(), [], []
        for own in _groups(t, "hi", "lo", "unit"):
            apart = np.not_equal.outer(label[own], label[own])
            if lo[own[0]] != hi[own[0]]:
                apart &= np.not_equal.outer(part[own], part[own])
            before = []
            for k in own:
                x = prefix[int(k)].values.to_numpy()
                before.append(x[: np.flatnonzero(x == token[k])[0]])
            seen, at = np.unique(np.concatenate(before), return_inverse=True)
            if len(seen):
                has = np.zeros((len(own), len(seen)), np.float32)
                has[np.repeat(np.arange(len(own)), [len(x) for x in before]), at] = 1
                apart &= has @ has.T == 0
            if apart.any():
                for x, y in Unit(_tokens(t, own), percent, apart).links(label[own].tolist()):
                    a.append(node[own[x]])
                    b.append(node[own[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("bucket").applyInArrow(run, "a long, b long")


def linked(sets: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """node and label (the smallest node of its component) for the nodes (node, tokens; stored) that have links. lists: of prefixes(), stored."""
    each = lists.select("node", "size", "shared", F.explode("prefix").alias("x")).select("node", "size", "shared", "x.n", "x.token")
    centers = each.groupBy("token").agg(F.max_by("node", F.struct(F.col("shared") - F.col("size"), "node")).alias("unit"))
    often = each.join(centers, "token").groupBy("node", "unit").agg(F.count("*").alias("k"))
    chosen = stored(often.groupBy("node").agg(F.max_by("unit", F.struct("k", "unit")).alias("unit")), "chosen")
    edges = stored(star_links(chosen, sets, percent), "links")
    labels = components(edges)
    named = stored(each.join(labels, "node", "left").select(*each.columns, F.coalesce("label", "node").alias("label")), "named")
    several = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    left = stored(banded(named.join(several, "token", "left_semi"), percent), "mixed")
    marks = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    same = left.groupBy("n", "token", "band").agg(F.count("*").alias("all"), *marks, F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("home").alias("home")).filter("home AND lo < hi")
    once = same.groupBy("all", "s1", "s2").agg(F.min(F.struct("n", "token", "band")).alias("x")).select("x.token", "x.band")  # of units with the same nodes the first
    rest = left.join(once, ["token", "band"], "left_semi").select(F.xxhash64("token", "band").alias("unit"), "token", "node", "label")
    full = sets.join(lists.select("node", F.col("prefix.token").alias("prefix")), "node")
    more = stored(list_links(rest, full, percent), "links")
    discard(named, left, chosen)
    return components(edges.unionByName(more))


def mark(docs: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) for each row."""
    keys = stored(_keys(docs, shingle, text_col, id_col), "keys")
    by = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    nodes = keys.filter("size > 0").groupBy("h1", "h2").agg(F.first("size").alias("size"), F.min(by).alias("x"))
    nodes = stored(nodes.select("h1", "h2", "size", "x.id", "x.th", F.monotonically_increasing_id().alias("node")), "nodes")
    few = stored(may_pair(nodes, _texts(docs, nodes, text_col, id_col), shingle, percent).select("node", "id", "th"), "few")
    sets = stored(_sets(_texts(docs, few, text_col, id_col), shingle), "sets")
    lists = stored(prefixes(sets, percent), "lists")
    labels = linked(sets, lists, percent)
    named = nodes.join(labels, "node", "left").select("h1", "h2", "id", F.coalesce("label", "node").alias("label"))
    found = named.join(named.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("h1", "h2", "component_id")
    discard(sets, lists, few)
    full = keys.filter("size > 0").join(found, ["h1", "h2"]).select("id", "size", "component_id")
    out = full.unionByName(keys.filter("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")

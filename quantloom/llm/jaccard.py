"""Exact n-gram Jaccard join with prefix trees.

1. Equal n-gram sets become one class, named by a digest of the set.
2. Rarity: a fixed-width table counts all n-grams by hash slot.  (slot count, hash) is a global order
   whatever the slots share, and puts passages that many documents repeat last.
3. Two sets that reach the threshold share an n-gram of their prefixes in that order.  Of the classes that
   share one, pairs whose parity bitmaps differ in more places than two similar sets can differ are
   out; the others form clusters, and no link crosses clusters.
4. Inside a cluster, a prefix tree of n-gram sets is searched with every set: partial overlaps are shared
   along paths, subtrees are cut by remaining-length bounds and where all sets are already joined
   to the searching one.  Large clusters are cut into blocks, and pairs of blocks are searched unless all their
   sets are already one component.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import add_columns, discard, width
from .components import components

WORDS, PERCENT = 4, 85
#: Slots of the rarity table, one byte each, and the pieces it moves in; its size doesn't depend on the data.
SLOT_BITS, CHUNKS = 25, 64
#: Width of the bit tables that leave rows out before a shuffle, as a power of two.
TABLE_BITS = 26
#: Bits of a set's parity bitmap, at least and at most: a power of two above two thirds of its n-grams, where sets without common n-grams still stand apart.
PARITY_BITS, PARITY_MOST = 1 << 10, 1 << 16
#: Up to so many classes that share an n-gram are compared by bitmap; more become one cluster as they are.
GROUP = 1500
#: A block of a cluster holds about this many classes, or words.
BLOCK_CLASSES, BLOCK_WORDS = 800, 1_500_000

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Digests of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * P2
    return h ^ (h >> np.uint64(29))


def ngrams(text: str | None, words: int) -> np.ndarray:
    """Sorted digests of the distinct word n-grams; a shorter text is one n-gram, a text without words none.

    Bytes are split at blank and tab .. carriage return and only A-Z are lower-cased.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([_hashes[w] for w in found], dtype=np.uint64)
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mixed(out * P1 + h[k:k + n])
    return np.unique(out)


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """Per slot the logarithm, in quarters, of how many n-grams of all documents fall there.

    A task counts up to 255 a slot and sends compressed chunks; each chunk is summed in one place, whatever
    the number of tasks, and only its logarithms, one byte a slot, go to the driver.
    """
    size = (1 << SLOT_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint8)  # of one task
        for b in batches:
            for text in b.column("text").to_pylist():
                slots, n = np.unique(slot_of(ngrams(text, words)), return_counts=True)
                total[slots] = np.minimum(total[slots] + n, 255)
        parts = total.reshape(CHUNKS, size)
        for i in range(CHUNKS):
            if parts[i].any():
                yield row(i, parts[i])

    def row(chunk: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())], names=["chunk", "slots"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, slots in zip(b.column("chunk").to_pylist(), b.column("slots").to_pylist()):
                totals.setdefault(chunk, np.zeros(size, np.int64))
                totals[chunk] += np.frombuffer(zlib.decompress(slots), np.uint8)
        for chunk, total in totals.items():
            yield row(chunk, np.round(4 * np.log2(np.maximum(total, 1))).astype(np.uint8))

    counts = docs.select("text").mapInArrow(count, "chunk int, slots binary")
    summed = counts.repartition(min(CHUNKS, width(docs.sparkSession)), "chunk").mapInArrow(add, "chunk int, slots binary")
    out = np.zeros((CHUNKS, size), np.uint8)
    for r in summed.toLocalIterator():  # CHUNKS rows of fixed size
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["slots"]), np.uint8)
    return out.reshape(-1)


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of a table of fixed width, set where the low bits of a ``key`` point.  Rows that no set bit
    allows can be left out before a shuffle; a crowded table allows more, never less."""
    size = (1 << TABLE_BITS) // 8 // CHUNKS

    def packed(table: np.ndarray) -> pa.RecordBatch:
        some = [i for i in range(CHUNKS) if table[i].any()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(table[i].tobytes(), 1) for i in some], pa.binary())], names=["chunk", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CHUNKS * size, np.uint8)
        for b in batches:
            at = b.column("key").to_numpy().view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield packed(table.reshape(CHUNKS, size))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CHUNKS, size), np.uint8)
        for b in batches:
            for chunk, bits in zip(b.column("chunk").to_pylist(), b.column("bits").to_pylist()):
                table[chunk] |= np.frombuffer(zlib.decompress(bits), np.uint8)
        yield packed(table)

    parts = keys.mapInArrow(mark, "chunk int, bits binary").repartition(min(CHUNKS, width(keys.sparkSession)), "chunk")
    out = np.zeros((CHUNKS, size), np.uint8)
    for r in parts.mapInArrow(merge, "chunk int, bits binary").collect():  # CHUNKS rows of fixed size
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.reshape(-1)


def allowed(df: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """The rows whose ``key`` (not null) finds its bit set."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(key).to_numpy().view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
            hit = shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            yield b.filter(pa.array(hit.astype(bool)))

    return df.mapInArrow(run, df.schema)


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of n-grams; its width depends on their number alone."""
    wide = min(max(PARITY_BITS, 1 << (2 * len(grams) // 3).bit_length()), PARITY_MOST)
    odd = np.bincount((grams % np.uint64(wide)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The narrower bitmap of the same set, ``width`` entries long: widths divide each other, so its parts add up by exclusive or."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def signatures(docs: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, text_key, n, node (digest of the set, null if empty), the prefix (the rarest n-grams, of which a partner must share one) and parity.

    Bit j of the parity bitmap says whether an odd number of n-grams fall on j, so two bitmaps of one width differ in at
    most as many places as their sets have n-grams that the other lacks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def row(text: str | None) -> tuple:
        g = ngrams(text, words)
        if not len(g):
            return 0, None, None, None
        node = int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "big", signed=True)
        length = len(g) + (-percent * len(g) // 100) + 1
        order = np.lexsort((g, shared.value[slot_of(g)]))[:length]
        return len(g), node, g[order].view(np.int64).tolist(), parity_bits(g).tobytes()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return add_columns(rows, "text", row, "n long, node long, prefix array<long>, parity binary")


def near_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(node, hub) links that connect the classes of each gram whose bitmaps allow the threshold.

    ``shared``: gram, node, n, parity, at most GROUP rows per gram.
    """
    parallel = max(width(shared.sparkSession), shared.sparkSession.sparkContext.defaultParallelism)
    rows = shared.select("gram", "node", "n", "parity").repartition(parallel, "gram").sortWithinPartitions("gram", "n")

    def links(nodes: list[int], n: np.ndarray, parity: list[bytes]) -> list[tuple[int, int]]:
        found, parent = [], list(range(len(nodes)))
        bits = [np.frombuffer(p, np.uint64) for p in parity]
        starts = [i for i in range(len(bits)) if i == 0 or len(bits[i]) > len(bits[i - 1])]  # widths rise with n
        runs = [(a, b, np.stack(bits[a:b])) for a, b in zip(starts, [*starts[1:], len(bits)])]
        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        for i in range(1, len(nodes)):  # by size, so partners stand in a run before i
            low = int(np.searchsorted(n[:i], -(-percent * n[i] // 100)))
            if low == i:
                continue
            both = n[low:i] + n[i]
            most = both - 2 * -(-percent * both // (100 + percent))  # n-grams that only one of the two may have
            differ = np.concatenate([np.bitwise_count(rows[max(low - a, 0):i - a] ^ folded(bits[i], rows.shape[1])).sum(axis=1, dtype=np.int64)
                                     for a, b, rows in runs if low < b and a < i])
            for j in np.flatnonzero(differ <= most) + low:
                a, b = find(i), find(int(j))
                if a != b:
                    parent[a] = b
                    found.append((nodes[i], nodes[j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("gram", "node", "n", "parity")))

        out: set[tuple[int, int]] = set()
        for _, group in groupby(each(), key=lambda r: r[0]):
            _, nodes, n, parity = zip(*group)
            out.update(links(nodes, np.array(n), parity))
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["node", "hub"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["node", "hub"])

    return rows.mapInArrow(run, "node long, hub long")


class Tree:
    """A prefix tree with compressed paths over sets of small integers in one fixed order."""

    __slots__ = ("part", "children", "least", "most", "item", "joined")

    def __init__(self, part, item=None, n=0):
        self.part, self.children, self.item = part, {}, item
        self.least = self.most = n
        self.joined = item  # an item whose component all items below share, or None

    def add(self, values: np.ndarray, item: int, at: int = 0) -> None:
        node, n = self, len(values)
        while True:
            node.least, node.most = (min(node.least, n), max(node.most, n)) if node.most else (n, n)
            key = int(values[at])
            child = node.children.get(key)
            if child is None:
                node.children[key] = Tree(values[at:], item, n)
                node.joined = None  # its own item says nothing about the new child
                return
            k = min(len(child.part), n - at)
            differ = np.flatnonzero(child.part[:k] != values[at:at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.part):  # the path forks, or the new set ends, inside the child's part
                upper = Tree(child.part[:same])
                upper.least, upper.most = child.least, child.most
                child.part = child.part[same:]
                upper.children[int(child.part[0])] = child
                node.children[key] = child = upper
            at += same
            if at == n:
                child.item, child.joined = item, None
                child.least, child.most = min(child.least, n), max(child.most, n)
                return
            node = child


def joined(sets: list[np.ndarray], start: list[int], percent: int, split: int | None = None) -> list[int]:
    """Component (the position of its first member) of each set, given those known at the start.

    With ``split``, only sets from there on are compared with those before.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    first: dict[int, int] = {}
    for i, c in enumerate(start):
        unite(i, first.setdefault(c, i))
    # local numbers of the n-grams, those of most sets first
    grams, local, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(grams), np.int64)
    number[np.argsort(-seen, kind="stable")] = np.arange(len(grams))
    local = number[local]
    ends = np.cumsum([len(s) for s in sets])
    lists = [np.sort(x) for x in np.split(local, ends[:-1])]
    inside = np.zeros(len(grams), bool)
    root = Tree(np.empty(0, np.int64))

    def same(node: Tree, mine: int) -> bool:
        """Whether all items below are known to be in the component ``mine``."""
        return node.joined is not None and find(node.joined) == mine

    def search(i: int) -> None:
        probe, n = lists[i], len(lists[i])
        inside[probe] = True
        todo = [(child, 0, 0) for child in root.children.values()]
        while todo:
            node, shared, depth = todo.pop()
            mine = find(i)
            if 100 * node.most < percent * n or 100 * n < percent * node.least or same(node, mine):
                continue
            shared += int(np.count_nonzero(inside[node.part]))
            depth += len(node.part)
            left = min(node.most - depth, n - int(np.searchsorted(probe, node.part[-1], "right")))
            if (100 + percent) * (shared + left) < percent * (n + node.least):
                continue
            if node.item is not None and depth == len(lists[node.item]) and 100 * shared >= percent * (n + depth - shared):
                unite(i, node.item)
            todo.extend((child, shared, depth) for child in node.children.values())
        inside[probe] = False

    def settle(node_list: list[Tree]) -> None:
        """Mark nodes below which all items are one component, from the leaves up."""
        order, todo = [], list(node_list)
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children.values())
        for node in reversed(order):
            ones = [c.joined for c in node.children.values()] + ([node.item] if node.item is not None else [])
            node.joined = ones[0] if None not in ones and len({find(x) for x in ones}) == 1 else None

    tree_items = range(len(sets)) if split is None else range(split)
    for i in tree_items:
        if split is None:
            search(i)
        root.add(lists[i], i)
    if split is not None:
        settle(list(root.children.values()))
        for i in range(split, len(sets)):
            search(i)
    return [find(i) for i in range(len(sets))]


def search_blocks(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Join the sets of each (cluster, task): rows of cluster, task, side, node, known, text -> node, found.

    ``side`` 1 is only compared with side 0; ``known`` is the component so far.  Rows come sorted by
    task, so one group at a time is in memory.
    """
    parallel = max(width(rows.sparkSession), rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.select("cluster", "task", "side", "node", "known", "text").repartition(parallel, "cluster", "task").sortWithinPartitions("cluster", "task", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("cluster", "task", "side", "node", "known", "text")))

        for _, group in groupby(each(), key=lambda r: r[:2]):
            side, node, known, sets = [], [], [], []
            for _, _, s, i, c, text in group:
                side.append(s)
                node.append(i)
                known.append(c)
                sets.append(ngrams(text, words))
            split = side.index(1) if 1 in side else None
            found = joined(sets, known, percent, split) if split != 0 else list(range(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([node[i] for i in found], pa.int64())], names=["node", "found"])

    return rows.mapInArrow(run, "node long, found long")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n, node, component of every document (doc_id, text); component is null for empty sets."""
    docs = docs.select("doc_id", "text")
    # every step is written and read again; what no later step reads is deleted at once
    sig = stage(signatures(docs, words, percent, rarity(docs, words)), "ngram-prefixes")
    nodes = stage(sig.select("doc_id", "text_key", "n", "node"), "ngram-nodes")
    per_class = stage(sig.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n").alias("n"), F.first("parity").alias("parity"))
        .select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key"), "n", "parity"), "ngram-classes")
    postings = sig.select("node", F.explode("prefix").alias("gram"))
    repeated = stage(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("gram").alias("key")), "ngram-repeated")
    postings = stage(allowed(postings, "gram", bit_table(repeated)).distinct(), "ngram-postings")
    discard(sig, repeated)
    hubs = postings.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = stage(postings.join(hubs, "gram"), "ngram-shared")
    discard(postings)
    compared = shared.where(F.col("k") <= GROUP).select("gram", "node").join(per_class.select("node", "n", "parity"), "node")
    near = near_pairs(compared, percent).union(shared.where(F.col("k") > GROUP).select("node", "hub"))
    near = components(near, "node", "hub").withColumnRenamed("component", "cluster")
    discard(shared)
    members = per_class.select("node", "doc_id", "text_key", "n").join(near, "node")
    sizes = near.join(per_class.select("node", "n"), "node").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"))
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stage(members, "ngram-places")
    texts = allowed(docs.withColumn("text_key", F.xxhash64("text")), "text_key", bit_table(members.select(F.col("text_key").alias("key"))))
    m = members.select("cluster", "blocks", "block", "node", F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    texts = stage(texts.join(m, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
                  .dropDuplicates(["node"]).select("cluster", "blocks", "block", "node", "text"), "ngram-members")
    discard(members, per_class)
    first = texts.select("cluster", F.col("block").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("known"), "text")
    found = stage(search_blocks(first, words, percent), "ngram-found")
    large = stage(texts.where("blocks > 1").join(found, "node"), "ngram-large")
    discard(texts)
    links = found
    if large.limit(1).count():
        links = found.union(across_blocks(large, words, percent))
        links = components(links.where("node <> found"), "node", "found").withColumnRenamed("component", "found")
    joined_ = links.select("node", F.col("found").alias("component"))
    return nodes.join(joined_, "node", "left").withColumn("component", F.coalesce("component", "node"))


def across_blocks(large: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the blocks of large clusters.  ``large``: cluster, blocks, block, node, text, found.

    First one member of each component of each block, in blocks of their own; most components meet there.
    Then every pair of blocks that is not known to be a single component.
    """
    firsts = large.where("node = found").drop("blocks")
    counts = firsts.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).alias("tasks"))
    few = firsts.join(counts, "cluster").select("cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tasks")).cast("int").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("known"), "text")
    met = stage(search_blocks(few, words, percent), "ngram-met").where("node <> found")
    links = large.select("node", "found").where("node <> found").union(met)
    comp = components(links, "node", "found")
    state = stage(large.drop("found").join(comp, "node", "left").select("cluster", "blocks", "block", "node", F.coalesce("component", "node").alias("known"), "text"), "ngram-state")
    blocks = state.groupBy("cluster", "block").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    a, b = blocks.select("cluster", F.col("block").alias("i"), F.col("low").alias("l"), F.col("high").alias("h")), blocks
    pairs = a.join(b, "cluster").where("i < block AND NOT (l = h AND low = high AND l = low)").select("cluster", "i", F.col("block").alias("j"))
    sides = pairs.select("cluster", "i", "j", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("cluster", (F.col("i").cast("long") * 2**31 + F.col("j")).alias("task"), F.col("s.block").alias("block"), F.col("s.side").alias("side"))
    rest = search_blocks(state.join(sides, ["cluster", "block"]), words, percent)
    return stage(rest.where("node <> found"), "ngram-rest").union(met)


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text); one row each.

    Null, empty and wordless texts have no n-grams, link with nothing and are their own component.
    Equal texts link.  Repeated rows stay.  A component is named by its smallest non-null doc_id (null if
    it has none).  Other columns are ignored; an empty table gives an empty result.
    """
    c = classes(docs, words, percent)
    named = c.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return c.join(named, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.  Documents without words stay."""
    c = classes(docs, words, percent).select("doc_id", "text_key", "component")
    kept = c.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k"))
    # one exchange of the texts serves the join and the repeats
    keys = [F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), F.col("_key")]
    kept = kept.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_key").alias("_key")).select(*keys)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~wordless).withColumn("_key", F.xxhash64("text"))
    one = rows.select(*docs.columns, *keys).join(kept, ["_null", "_id", "_key"]).dropDuplicates(["_null", "_id", "_key"])
    return one.select(*docs.columns).union(docs.where(wordless))

"""Near-duplicate embeddings with a navigable small-world graph per shard.

Equal vectors become one class.  Classes are dealt by hash into shards of bounded size, a few at least so that graphs are built side by side; every shard
gets a layered graph.  Each shard's vectors are searched in its own graph and in every later
shard's, which covers all pairs.  A search is a beam over the graph, for the whole task
widened until an audit passes: queries with a planted link, vectors of the shard turned away to a cosine just above the threshold, and a sample of the real queries
must find their links, which one product of this sample with the shard tells.  Beam and recall of every search are kept beside the links.
A query whose beam holds only links is compared with all vectors of the shard, block by
block, of which only counts and new connections stay.
Links are verified by cosine in double precision, counted, and reduced to a spanning forest in the task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .components import components

COSINE = 0.95
#: Classes in a shard, about: no more than LARGEST; up to SHARDS shards of no fewer than LEAST before that.
LARGEST, LEAST, SHARDS = 1 << 16, 512, 6
#: Graph: links a node chooses, most links it keeps on the lowest and on upper layers, beam while building.
CHOSEN, KEPT_LOW, KEPT_HIGH, BUILD_BEAM = 12, 32, 16, 40
#: One node in LAYER stands on the next layer too.
LAYER = 16
#: First beam, queries searched together, audited queries of each kind, and the recall they must show.
BEAM, TOGETHER, AUDITED, RECALL = 40, 512, 256, 0.98
#: Dense queries compared with all vectors of a shard at a time, and pairs verified at a time.
BLOCK, VERIFIED = 128, 1 << 16
#: Single-precision cosines this far below the threshold are still verified.
MARGIN = 1e-4


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the best ``beam`` nodes found for each query, best first; -1 where fewer.

    All queries step together: each expands its best node not yet expanded, until that is worse than a full beam.
    """
    q, n = len(queries), len(vectors)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -2.0, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", queries, vectors[entry]), True
    seen[rows, entry] = True
    active = rows
    while len(active):
        at = np.argmax(np.where(open_[active], sims[active], -3.0), axis=1)
        going = open_[active, at]
        active, at = active[going], at[going]
        if not len(active):
            break
        open_[active, at] = False
        near = links[ids[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, ids[active, at][:, None])] = True
        new = np.where(fresh, np.matmul(vectors[near], queries[active][:, :, None])[:, :, 0], -2.0).astype(np.float32)
        all_sims = np.concatenate((sims[active], new), axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
        ids[active] = np.where(sims[active] > -2, np.take_along_axis(np.concatenate((ids[active], near), axis=1), best, axis=1), -1)
        open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), axis=1), best, axis=1)
    return ids, sims


def choose(vectors: np.ndarray, of: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row, up to ``most`` of its candidates (best first): those nearer to it than to any chosen before, then the best of the rest."""
    among = np.matmul(vectors[ids], vectors[ids].transpose(0, 2, 1))
    valid = (ids >= 0) & (ids != of[:, None])
    taken = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), int)
    for c in range(ids.shape[1]):
        spread = np.where(taken, among[:, c, :], -2.0).max(axis=1) < sims[:, c]
        take = valid[:, c] & spread & (count < most)
        taken[:, c] = take
        count += take
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1]), axis=1)[:, :most]
    picked = np.take_along_axis(ids, order, axis=1)
    return np.where(np.take_along_axis(valid, order, axis=1), picked, -1)


class Graph:
    """Layered small-world graph over unit vectors; layer k holds a prefix of the nodes, so node 0 is on all."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > LAYER:
            sizes.append(max(sizes[-1] // LAYER, 1))
        self.layers = [np.full((s, KEPT_LOW if k == 0 else KEPT_HIGH), -1, np.int32) for k, s in enumerate(sizes)]
        for k in range(len(sizes) - 1, -1, -1):
            self._fill(k)

    def _fill(self, k: int) -> None:
        """Insert the layer's nodes in growing batches: search what is there, compare inside the batch, link both ways."""
        links, size = self.layers[k], len(self.layers[k])
        done = 0
        while done < size:
            batch = np.arange(done, min(size, max(2 * done, 64), done + TOGETHER))
            q = self.vectors[batch]
            inside = q @ q.T
            np.fill_diagonal(inside, -2.0)
            width = min(len(batch), BUILD_BEAM)
            top = np.argsort(-inside, axis=1)[:, :width]
            ids, sims = batch[top], np.take_along_axis(inside, top, axis=1)
            if done:
                old, old_sims = beam_search(self.vectors[:size], links, q, self._enter(q, k), BUILD_BEAM)
                ids, sims = np.concatenate((ids, old), axis=1), np.concatenate((sims, old_sims), axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2 * BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = choose(self.vectors, batch, np.where(sims > -2, ids, -1), sims, CHOSEN)
            links[batch, :chosen.shape[1]] = chosen
            self._link_back(links, batch, chosen)
            done = int(batch[-1]) + 1

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Give the chosen nodes links to the new ones; where there are too many, choose again."""
        near = chosen.ravel()
        new = np.repeat(batch, chosen.shape[1])[near >= 0]
        near = near[near >= 0]
        order = np.argsort(near, kind="stable")
        near, new = near[order], new[order]
        nodes, first, count = np.unique(near, return_index=True, return_counts=True)
        at = np.arange(len(near)) - np.repeat(first, count)
        keep = links.shape[1]
        for some in np.array_split(np.arange(len(nodes)), max(len(nodes) // TOGETHER, 1)):
            if not len(some):
                continue
            rows = slice(first[some[0]], first[some[-1]] + count[some[-1]])
            both = np.full((len(some), keep + int(count[some].max())), -1, np.int32)
            both[:, :keep] = links[nodes[some]]
            both[np.repeat(np.arange(len(some)), count[some]), keep + at[rows]] = new[rows]
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)
            full = both[:, min(keep, both.shape[1] - 1)] >= 0 if both.shape[1] > keep else np.zeros(len(some), bool)
            links[nodes[some[~full]]] = both[~full, :keep]
            if full.any():
                ids, of = both[full], nodes[some[full]]
                sims = np.where(ids >= 0, np.matmul(self.vectors[ids], self.vectors[of][:, :, None])[:, :, 0], -2.0)
                order = np.argsort(-sims, axis=1, kind="stable")
                links[of] = choose(self.vectors, of, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), keep)

    def _enter(self, queries: np.ndarray, above: int) -> np.ndarray:
        at = np.zeros(len(queries), int)
        for k in range(len(self.layers) - 1, above, -1):
            at = beam_search(self.vectors[:len(self.layers[k])], self.layers[k], queries, at, 4)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.vectors, self.layers[0], queries, self._enter(queries, 0), min(beam, len(self.vectors)))

    def sparse(self, queries: np.ndarray, least: float, beam: int):
        """(query, node) pairs with cosine of at least ``least``, and the queries whose beam holds only such nodes, left out of the pairs."""
        ids, sims = self.search(queries, beam)
        full = (sims[:, -1] >= least) & (ids.shape[1] < len(self.vectors))
        rows, cols = np.nonzero((sims >= least) & ~full[:, None])
        return rows, ids[rows, cols], np.flatnonzero(full)

    def near(self, queries: np.ndarray, least: float, beam: int):
        """(query, node) pairs with cosine of at least ``least``; queries with a beam of only such nodes meet all vectors."""
        a, b, full = self.sparse(queries, least, beam)
        found = [(a, b)]
        for at in range(0, len(full), BLOCK):
            r, c = np.nonzero(queries[full[at:at + BLOCK]] @ self.vectors.T >= least)
            found.append((full[at:at + BLOCK][r], c))
        return tuple(np.concatenate(x) for x in zip(*found))

    def audited_beam(self, queries: np.ndarray, least: float, own: bool = False) -> tuple[int, float]:
        """The least beam, doubling from BEAM, with which audited queries find at least RECALL of their links, and the recall shown.

        Audited are AUDITED vectors of the shard turned away to cosines from the threshold to a little more, so that each has a link, and AUDITED of the queries
        at even steps; the mean share is taken over those with links.  With ``own`` the queries are the shard's vectors, and a vector's link with itself counts nowhere.
        """
        rng = np.random.default_rng(len(self.vectors))
        some = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
        of = np.unique(np.linspace(0, len(self.vectors) - 1, min(AUDITED, len(self.vectors))).astype(int))
        asked = np.concatenate((self._turned(of, least + MARGIN, rng), queries[some]))
        self_of = np.concatenate((np.full(len(of), -1), some if own else np.full(len(some), -1)))
        sims = asked @ self.vectors.T
        sims[self_of >= 0, self_of[self_of >= 0]] = -2.0
        truth = np.count_nonzero(sims >= least, axis=1)
        asked, self_of, truth = asked[truth > 0], self_of[truth > 0], truth[truth > 0]
        beam = BEAM
        while True:
            a, b = self.near(asked, least, beam)
            a = a[self_of[a] != b]
            recall = float(np.mean(np.bincount(a, minlength=len(asked)) / truth)) if len(asked) else 1.0
            if recall >= RECALL or beam >= len(self.vectors):
                return beam, recall
            beam *= 2

    def _turned(self, of: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
        """The vectors ``of`` turned in random directions, to cosines from ``cosine`` to two fifths of the way to 1."""
        v = self.vectors[of].astype(np.float64)
        away = rng.normal(size=v.shape)
        away -= np.einsum("nd,nd->n", away, v)[:, None] * v
        size = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)
        c = cosine + 0.4 * (1 - cosine) * rng.random((len(of), 1))
        return (c * v + np.sqrt(1 - c * c) * away).astype(np.float32)


def build(table: pa.Table) -> pa.Table:
    """One shard's classes -> one row with its packed graph."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    order = np.argsort(table["node"].to_numpy(), kind="stable")
    exact = np.asarray(table["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)[order]
    scale = np.abs(exact).max(axis=1, keepdims=True)
    exact = exact / scale
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    graph = Graph(exact)
    packed = pickle.dumps((table["node"].to_numpy()[order], table["copies"].to_numpy()[order], exact, graph.layers), protocol=5)
    return pa.table({"dim": [dim], "shard": [shard], "graph": pa.array([packed], pa.binary())}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))


def search_pair(table: pa.Table, cosine: float) -> pa.Table:
    """Links between the vectors of one shard and another (or itself): a row with beam and recall of the audit, per class its count, and a spanning forest."""
    sides = dict(zip(table["side"].to_pylist(), table["graph"].to_pylist()))
    nodes, copies, exact, layers = pickle.loads(sides[0])
    graph = Graph.__new__(Graph)
    graph.vectors, graph.layers = exact.astype(np.float32), layers
    own = 1 not in sides
    q_nodes, q_copies, q_exact, _ = (nodes, copies, exact, None) if own else pickle.loads(sides[1])
    queries = q_exact.astype(np.float32)
    least = cosine - MARGIN
    beam, recall = graph.audited_beam(queries, least, own)
    count, q_count = np.zeros(len(nodes), np.int64), np.zeros(len(q_nodes), np.int64)
    offset = 0 if own else len(nodes)
    parent = np.arange(len(nodes) + (0 if own else len(q_nodes)))
    forest = []

    def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.empty(len(a), bool)
        for at in range(0, len(a), VERIFIED):
            part = slice(at, at + VERIFIED)
            good[part] = np.einsum("kd,kd->k", q_exact[a[part]], exact[b[part]]) >= cosine
        return good

    def roots(of: np.ndarray) -> np.ndarray:
        """Roots of nodes; their paths are cut short."""
        top = parent[of]
        while (up := parent[top] != top).any():
            top = np.where(up, parent[top], top)
        parent[of] = top
        return top

    def connect(i: int, others: np.ndarray) -> None:
        """Join ``i`` with one of ``others`` of every component but its own."""
        of, at = np.unique(roots(others), return_index=True)
        own_root = roots(np.array([i + offset]))[0]
        at, of = at[of != own_root], of[of != own_root]
        forest.extend((i + offset, int(j)) for j in others[at])
        parent[of] = own_root

    sparse, dense = [], []
    for at in range(0, len(queries), TOGETHER):
        a, b, full = graph.sparse(queries[at:at + TOGETHER], least, beam)
        a, dense = a + at, [*dense, full + at]
        good = verified(a, b)
        sparse.append((a[good], b[good]))
    dense = np.concatenate(dense) if dense else np.empty(0, int)
    is_dense = np.zeros(len(queries), bool)
    is_dense[dense] = True
    a, b = (np.concatenate(x) for x in zip(*sparse))
    if own:  # a link between sparse ends may be found from either; those of a dense end are all counted below
        keep = (a != b) & ~is_dense[b]
        a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        key = np.unique(a * len(nodes) + b)
        a, b = key // len(nodes), key % len(nodes)
    np.add.at(q_count, a, copies[b])
    np.add.at(count, b, q_copies[a])
    for i, j in zip(a.tolist(), b.tolist()):
        connect(i, np.array([j]))
    for at in range(0, len(dense), BLOCK):
        some = dense[at:at + BLOCK]
        sims = queries[some] @ graph.vectors.T
        link = sims >= cosine + MARGIN
        r, c = np.nonzero((sims >= least) & ~link)
        link[r, c] = verified(some[r], c)
        if own:
            link[np.arange(len(some)), some] = False
        for i, row in zip(some.tolist(), link):
            q_count[i] += copies[row].sum()
            # a dense partner in the same shard counts this link by itself
            count[row & ~is_dense if own else row] += q_copies[i]
            connect(i, np.flatnonzero(row))
    ids = nodes if own else np.concatenate((nodes, q_nodes))
    total = count + q_count if own else np.concatenate((count, q_count))
    some = np.flatnonzero(total)
    left = np.array([i for i, _ in forest], int)
    right = np.array([j for _, j in forest], int)
    return pa.table({
        "node": pa.array([None, *ids[some].tolist(), *ids[left].tolist()], pa.int64()),
        "other": pa.array([None] * (len(some) + 1) + ids[right].tolist(), pa.int64()),
        "n": pa.array([None, *total[some].tolist()] + [None] * len(forest), pa.int64()),
        "beam": pa.array([beam] + [None] * (len(some) + len(forest)), pa.int32()),
        "recall": pa.array([recall] + [None] * (len(some) + len(forest)), pa.float64())})


def search(vectors: DataFrame, cosine: float = COSINE, largest: int = LARGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors with their class (vec_id, node), classes (node, first, copies, ..) and what the searches found (node, other, n, beam, recall)."""
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.withColumn("node", F.when(fine, F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0)))))
    classes = v.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = stage(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    n = F.count(F.lit(1))
    shards = classes.groupBy("dim").agg(F.greatest(F.ceil(n / largest), F.least(F.lit(SHARDS), F.ceil(n / LEAST))).alias("shards"))
    dealt = classes.join(shards, "dim").select("dim", F.pmod(F.xxhash64("node", F.lit(7)), F.col("shards")).cast("int").alias("shard"), "node", "copies", "embedding")
    graphs = stage(spread(dealt, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "vector-graphs")
    keys = graphs.select("dim", "shard")
    pairs = keys.select("dim", F.col("shard").alias("i")).join(keys.select("dim", F.col("shard").alias("j")), "dim").where("i <= j")
    sides = pairs.select("dim", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("shard"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("shard"), F.lit(0).alias("side")), F.struct(F.col("j").alias("shard"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select("dim", "i", "j", F.col("s.shard").alias("shard"), F.col("s.side").alias("side"))
    joined = spread(sides.join(graphs, ["dim", "shard"]), "dim", "i", "j")
    found = joined.groupBy("dim", "i", "j").applyInArrow(lambda t: search_pair(t, cosine), "node long, other long, n long, beam int, recall double")
    return v.select("vec_id", "node"), classes, stage(found, "vector-links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, largest: int = LARGEST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding).

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing and
    are kept; vectors of different lengths don't link.  Equal vectors link.  Repeated rows stay, each
    counting the others.  A component is named by its smallest non-null vec_id; rows without an id are not
    kept where a named one exists.  Other columns are ignored; an empty table gives an empty result.
    """
    v, classes, found = search(vectors, cosine, largest)
    comp = components(found.where("other IS NOT NULL").select("node", "other"), "node", "other")
    counts = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    state = classes.select("node", "first", "copies").join(comp, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = state.groupBy("component").agg(F.min("first").alias("component_id"))
    state = state.join(named, "component").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = v.join(state, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

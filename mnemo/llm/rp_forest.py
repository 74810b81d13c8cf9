"""Embedding near-dedup with a forest of random-projection trees.

Vectors of equal label and length link at a cosine of `threshold` or more.
Equal vectors are one node.  Every tree splits the space recursively: a level
projects on a random direction and a node cuts at the median of the sample
rows it holds; rows within `spill` of the cut go to both sides.  Rows of one
leaf and label are compared with each other, so a pair is missed only if
every tree parts it by more than 2 * `spill`; found pairs are verified in
double precision.

A row knows all its leaves, and a pair counts only in the first leaf that both
share: link counts add up without a table of pairs.  A leaf emits one count
per row and the edges of a spanning forest of its links.

The cuts are fitted on at most about `sample` vectors, chosen by hash.  Every
vector is indexed.  A label's depth follows its number of distinct vectors,
so that leaves hold about `leaf` of them; a leaf of more than `block` is dealt
to block pairs, each a task of its own.

Defined cases: a null label, a null, empty or all-zero vector, and one with
null, NaN or infinite components link with nothing (0 links, own component,
kept); one row is returned per input row; equal ids are one name for several
rows; null ids are kept by comparison with null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, list_array, numbered, pick, written
from .components import components

THRESHOLD, TREES, SPILL, LEAF, BLOCK, SAMPLE, MAX_DEPTH, SEED = 0.98, 6, 0.025, 256, 2048, 20_000, 24, 7


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Directions by (tree, level) and cuts by node, for one vector length."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int):
        rng = np.random.default_rng([seed, sample.shape[1]])
        self.spill = spill
        self.directions = rng.normal(size=(trees, depth, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, 1 << depth))  # node 1 is the root, 2 and 3 its children
        for t in range(trees):
            row, node = np.arange(len(sample)), np.ones(len(sample), np.int64)
            for level in range(depth):
                p = sample @ self.directions[t, level]
                order = np.lexsort((p[row], node))
                r, k = row[order], node[order]
                names, first, count = np.unique(k, return_index=True, return_counts=True)
                self.cuts[t, names] = p[r[first + count // 2]]
                row, node = self.step(t, p, row, node)

    def step(self, t: int, p: np.ndarray, row: np.ndarray, node: np.ndarray):
        gap = p[row] - self.cuts[t, node]
        left, right = gap < self.spill, gap >= -self.spill
        return np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])

    def leaves(self, t: int, x: np.ndarray, depth: np.ndarray):
        """(row, leaf) of every row of x; row i goes down depth[i] levels."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        done = []
        for level in range(int(depth.max(initial=0)) + 1):
            stop = depth[row] == level
            done.append((row[stop], node[stop]))
            row, node = row[~stop], node[~stop]
            if len(row):
                row, node = self.step(t, x @ self.directions[t, level], row, node)
        return tuple(np.concatenate(c) for c in zip(*done))


def _route(forests: dict[int, Forest], trees: int):
    """One row per (vector, leaf): its node, unit vector, and all its leaves."""
    def run(batches):
        for b in batches:
            lengths = np.diff(b.column("embedding").offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                x = _unit(part.column("embedding").flatten().to_numpy(), part.num_rows)
                depth = part.column("depth").to_numpy()
                rows, codes = [], []
                for t in range(trees):
                    r, leaf = forests[dim].leaves(t, x, depth) if dim in forests else (np.arange(len(x)), np.ones(len(x), np.int64))
                    if t:  # a label of one leaf needs one tree
                        r, leaf = r[depth[r] > 0], leaf[depth[r] > 0]
                    rows.append(r)
                    codes.append(leaf | t << 32)
                r, c = np.concatenate(rows), np.concatenate(codes)
                order = np.lexsort((c, r))
                r, c = r[order], c[order]
                ptr = np.searchsorted(r, np.arange(len(x) + 1))
                all_leaves = list_array(c, ptr)
                at = pa.array(r)
                yield {"label": part.column("label").take(at), "dim": np.full(len(r), dim), "leaf": c,
                       "node": part.column("node").take(at), "size": part.column("size").take(at),
                       "unit": list_array(x[r].ravel(), np.arange(len(r) + 1) * dim), "leaves": all_leaves.take(at)}
    return run


def _compare(threshold: float, chunk: int = 1024):
    """Streams rows sorted by leaf and block pair; yields link counts (node, links) and edges (node, other)."""
    names = ("node", "size", "left", "right")

    def leaf_links(code, group):
        node, size, left, right, x, leaves = group
        sets = [frozenset(v) for v in leaves]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        links = np.zeros(len(node), np.int64)
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(0, len(a), chunk):
            for j in range(0, len(b), chunk):
                p, q = np.nonzero(x[a[i:i + chunk]] @ x[b[j:j + chunk]].T >= threshold)
                p, q = a[i + p], b[j + q]
                # two blocks see a pair once; a block with itself sees it twice
                once = (node[p] < node[q]) | ~(left[q] & right[p])
                for u, v in zip(p[once & (node[p] != node[q])].tolist(), q[once & (node[p] != node[q])].tolist()):
                    if min(sets[u] & sets[v]) == code:
                        links[u] += size[v]
                        links[v] += size[u]
                        ru, rv = find(u), find(v)
                        if ru != rv:
                            root[max(ru, rv)] = min(ru, rv)
        at = np.flatnonzero(links)
        return node[at], links[at], node[[find(i) for i in at.tolist()]]

    def run(batches):
        key, waiting = None, []

        def close():
            if sum(len(g[0]) for g in waiting) > 1:
                n, k, other = leaf_links(key[2], [sum((list(y) for y in c), []) if c[0].dtype == object else np.concatenate(c)
                                                  for c in zip(*waiting)])
                if len(n):
                    yield {"node": n, "links": k, "other": other}

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "leaf", "i", "j"))))
            flat, dims = b.column("unit").flatten().to_numpy(), b.column("dim").to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            leaves = np.empty(b.num_rows, object)
            leaves[:] = b.column("leaves").to_pylist()
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            at = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(at, at[1:]):
                if keys[lo] != key:
                    if key:
                        yield from close()
                    key, waiting = keys[lo], []
                unit = flat[starts[lo]:starts[hi]].reshape(hi - lo, -1)
                waiting.append([*(c[lo:hi] for c in cols), unit, leaves[lo:hi]])
        if key:
            yield from close()

    return run


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, block: int = BLOCK,
                 sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    v = numbered(pick(vectors, vec_id=vec_id, embedding=embedding, label=label))
    kind = v.schema["label"].dataType.simpleString()
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.coalesce(clean & F.exists("embedding", lambda x: x != 0), F.lit(False))
    equal = v.where(fit).groupBy("label", "embedding").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("size"))
    nodes = written(equal, "forest-nodes").withColumn("dim", F.size("embedding"))

    per_label = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    depth = F.greatest(F.lit(0), F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(F.col("n") / leaf)))).cast("int")
    per_label = written(per_label.select("label", "dim", depth.alias("depth")), "forest-labels")
    deepest = {r["dim"]: r["depth"] for r in per_label.groupBy("dim").agg(F.max("depth").alias("depth")).where("depth > 0").collect()}
    n = nodes.count()
    share = min(1.0, sample / max(n, 1))
    fitted = nodes.where((F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) & F.col("dim").isin(list(deepest)))
    fitted = fitted.select("dim", "embedding").toArrow() if deepest else None  # about `sample` rows
    forests = {}
    for dim, levels in deepest.items():
        part = fitted.filter(pc.equal(fitted.column("dim"), dim)).column("embedding").combine_chunks()
        if len(part):
            forests[dim] = Forest(_unit(part.flatten().to_numpy(), len(part)), levels, trees, spill, seed)

    routed = written(arrow_map(
        nodes.join(per_label, ["label", "dim"]).select("label", "embedding", "node", "size", "depth"), _route(forests, trees),
        f"label {kind}, dim int, leaf long, node long, size long, unit array<double>, leaves array<bigint>"), "forest-leaves")
    full = routed.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (routed.join(full, ["label", "dim", "leaf"]).withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
             .select("label", "dim", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node",
                     "size", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"),
                     "unit", "leaves")
             .repartition("label", "dim", "leaf", "i", "j").sortWithinPartitions("label", "dim", "leaf", "i", "j"))
    found = written(arrow_map(dealt, _compare(threshold), "node long, links long, other long"), "forest-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("label", "embedding", "node", "size").join(links, "node", "left").join(comp, "node", "left")
    rows = v.join(named.withColumnRenamed("label", "l").withColumnRenamed("embedding", "e"),
                  (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & fit, "left")
    rows = rows.select("_row", "vec_id", F.coalesce(F.col("links"), F.lit(0)).alias("links"), F.coalesce("size", F.lit(1)).alias("size"),
                       F.coalesce("component", "node", "_row").alias("component"))
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return rows.join(least, "component").select(
        "vec_id", (F.col("links") + F.col("size") - 1).cast("long").alias("n_links"), F.col("component_id").cast("long"),
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window).  Documents and items keep the minimum
`k`-gram hash of every sliding window of `window - k + 1` k-grams, so equal
windows keep equal fingerprints: every shared span of `window` words is
found.  The fingerprints of both sides are joined; a hit is extended to the
windows around it, which are compared as wholes.

Both joins are plain equi-joins on written tables of the benchmark side.
Catalyst sees their size: it broadcasts them below
spark.sql.autoBroadcastJoinThreshold and shuffles beyond it.  A document
fingerprint leaves its task together with the windows that chose it, so the
texts themselves are never shuffled.

Items shorter than `window` words have no such fingerprint.  For each such
length that occurs in the benchmark (below `window`), documents also emit
their grams of that length; these are few lengths at most (window - 1).

Defined cases: null or wordless texts have no words, no hits and no windows;
one row is returned per input row, also for repeated or null ids; items with
null ids count as items with hits but have no id to list; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, list_array, numbered, pick, with_row, written

WINDOW = 10
K = 5


def _fingerprints(w: W.Words, window: int, k: int):
    """Per chosen k-gram of a chunk: (text, hash, first window, number of windows), and all window ids.

    Windows that follow each other with the same chosen k-gram form one row.
    """
    doc, first, ids = W.grams(w, window)
    kdoc, kfirst, kids = W.grams(w, k)
    ptr = np.searchsorted(kdoc, np.arange(w.n + 1))
    long = np.diff(w.ptr) >= window
    best, group = W.window_argmin(kids, ptr, window - k + 1)
    keep = long[group]
    best = best[keep]
    if not len(best):
        return None
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], kids[best[at]], first[at], np.append(at, len(best)), ids


def _emit_documents(window: int, k: int, short_lengths: list[int]):
    def run(batches):
        for b in batches:
            rows, names = b.column("_row").to_numpy(), b.column("doc_id")
            for w in W.tokenize(b.column("text"), "alnum"):
                rid = rows[w.first:w.first + w.n]
                # one row per document carries its id and word count; length 0 meets no fingerprint
                yield {"_row": rid, "doc_id": names.slice(w.first, w.n), "n_words": np.diff(w.ptr), "len": np.zeros(w.n),
                       "fp": rid, "pos": np.zeros(w.n), "windows": list_array(np.zeros(0, np.int64), np.zeros(w.n + 1))}
                f = _fingerprints(w, window, k)
                if f:
                    doc, fp, first, ptr, ids = f
                    yield hit_rows(names, rid[doc], window, fp, first - w.ptr[doc], list_array(W.signed(ids), ptr))
                for n in short_lengths:
                    doc, first, ids = W.grams(w, n)
                    yield hit_rows(names, rid[doc], n, ids, first - w.ptr[doc],
                                   list_array(W.signed(ids), np.arange(len(ids) + 1)))

    def hit_rows(names, rid, length, fp, pos, windows):
        n = len(rid)
        return {"_row": rid, "doc_id": pa.nulls(n, names.type), "n_words": np.full(n, -1), "len": np.full(n, length),
                "fp": W.signed(fp), "pos": pos, "windows": windows}

    return run


def _emit_items(window: int, k: int):
    def run(batches):
        for b in batches:
            rows = b.column("_row").to_numpy()
            for w in W.tokenize(b.column("text"), "alnum"):
                f = _fingerprints(w, window, k)
                if f:
                    doc, fp, _, ptr, ids = f
                    which = np.repeat(np.arange(len(doc)), np.diff(ptr))
                    yield {"_row": rows[w.first + doc[which]], "len": np.full(len(which), window),
                           "fp": W.signed(fp[which]), "window": W.signed(ids)}
                n_words = np.diff(w.ptr)
                few = np.flatnonzero((n_words > 0) & (n_words < window))
                ids = W.range_ids(w.ids, w.ptr[few], w.ptr[few + 1])
                yield {"_row": rows[w.first + few], "len": n_words[few], "fp": W.signed(ids), "window": W.signed(ids)}
    return run


def contaminated_windows(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
                         item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, k: int = K,
                         row: str | None = None) -> DataFrame:
    """One row per document row: _row (`row` if named), doc_id, n_words, hits (array of [start, end) in words), items (sorted ids)."""
    b = numbered(pick(items, item_id=item_id, text=item_text))
    # equal items have equal windows: a window lists its items once, as a sorted array
    side = arrow_map(b.select("_row", "text"), _emit_items(window, k), "_row long, len int, fp long, window long")
    side = written(side.join(b.select("_row", "item_id"), "_row")
                   .groupBy("len", "fp", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"),
                                                      F.count(F.lit(1)).alias("n")), "benchmark-windows")
    short = sorted(r["len"] for r in side.where(F.col("len") < window).select("len").distinct().collect())
    fps = side.select("len", "fp").distinct().withColumn("hit", F.lit(True))
    d = pick(docs, doc_id=doc_id, text=text, _row=row) if row else with_row(pick(docs, doc_id=doc_id, text=text))
    emitted = arrow_map(d, _emit_documents(window, k, short),
                        f"_row long, doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, "
                        "len int, fp long, pos long, windows array<bigint>")
    near = (emitted.join(written(fps, "benchmark-fingerprints"), ["len", "fp"], "left")
            .where((F.col("n_words") >= 0) | F.col("hit")))
    each = (near.select("_row", "doc_id", "n_words", "len", F.posexplode_outer("windows").alias("i", "window"), "pos")
            .withColumn("window", F.coalesce("window", "_row")))  # rows of word counts spread out, and meet nothing
    hits = (each.join(side.groupBy("len", "window").agg(F.flatten(F.collect_set("ids")).alias("ids")),
                      ["len", "window"], "left")
            .where((F.col("n_words") >= 0) | F.col("ids").isNotNull()))
    start = (F.col("pos") + F.coalesce(F.col("i"), F.lit(0))).cast("long")
    return hits.groupBy("_row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("ids").isNotNull(),
                                          F.struct(start.alias("start"), (start + F.col("len")).alias("end"))))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))


def covered(hits):
    """Number of positions in a sorted array of [start, end) structs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        hits, zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"),
                              F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits; see `contaminated_windows`."""
    w = contaminated_windows(docs, items, **columns)
    return w.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), "hits")

"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: `target` from
documents labelled good (quality = 1, not toxic) and `raw` from all
documents.  A document's log weight is the sum, over its distinct n-grams, of
log p_target / p_raw.  Documents are then resampled without replacement:
key = log weight / temperature + Gumbel noise, and the k largest keys stay.

N-grams come from three views of a text's words: the lower-cased word, its
first 4 and 6 bytes, and pairs of word shapes (character classes of the first,
second and last byte, and whether the word repeats its predecessor).  Each
document counts an n-gram once, so long documents and copies of one line
don't outweigh the rest.  A ratio counts only with evidence: buckets whose
target count is within `min_z` standard deviations of its expectation, or
within a factor e^`dead_zone`, have ratio 1.

The counts cover all documents.  Labels are taken from at most about
`max_labelled` labelled ids (chosen by hash of the id; 5 standard deviations
of slack), so that table can be broadcast.  Models are cross-fitted on two
halves of the labels: a labelled document is scored by the half it is not
in, and the cut between good and bad is calibrated on those scores (losing a
share of the good ones weighs `care` times as much as keeping that share of
the bad ones).  k is the number of documents, of all, whose log weight reaches that cut.

Defined cases: null and empty texts have no n-grams and log weight 0; rows
with a null id have no label; several labels of one id combine to the lowest
quality and the highest toxicity, nulls ignored; without good and bad labels
nothing is rejected; equal keys at the cut all stay; one row is returned per
input row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, pick, with_row, written

BITS = 21
MAX_LABELLED = 200_000
PREFIXES = (4, 6)

#: Character class of a byte: one for lower case and non-ASCII, one for upper case, one for digits, others for themselves.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _views(w: W.Words):
    """(text, n-gram id) of every view of a chunk; views never share ids but by hash."""
    if not len(w.start):
        return
    s, e = w.start, w.end
    text = w.doc_of_word()
    lower = W._LOWER[w.data]
    yield text, W.byte_ids(lower, s, e)
    for n in PREFIXES:
        yield text, W.mix(W.byte_ids(lower, s, np.minimum(s + n, e)) + np.uint64(n))
    second = np.where(e - s > 1, _CLASS[w.data[np.minimum(s + 1, len(w.data) - 1)]], 0).astype(np.uint64)
    same = np.zeros(len(s), np.uint64)
    same[1:] = w.ids[1:] == w.ids[:-1]
    shape = _CLASS[w.data[s]] | second << np.uint64(8) | _CLASS[w.data[e - 1]] << np.uint64(16) | same << np.uint64(24)
    shapes = W.Words(w.first, w.ptr, s, e, W.mix(shape + np.uint64(1)), w.data, w.byte_ptr)
    pair_text, _, pairs = W.grams(shapes, 2)
    yield pair_text, pairs


def _buckets(w: W.Words, keep: np.ndarray | None = None):
    """Distinct (text, bucket) of a chunk; `keep`: only buckets where it is true."""
    out = []
    for text, ids in _views(w):
        b = (ids >> np.uint64(64 - BITS)).astype(np.int64)
        if keep is not None:
            m = keep[b]
            b, text = b[m], text[m]
        out.append(text << BITS | b)
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _count(batches):
    """Counts of a task: documents that hold a bucket, all and good ones of each half."""
    total = np.zeros((3, 1 << BITS), np.int32)
    for b in batches:
        good = b.column("good").fill_null(False).to_numpy(zero_copy_only=False)
        half = b.column("half").fill_null(0).to_numpy()
        for w in W.tokenize(b.column("text")):
            text, bucket = _buckets(w)
            total[0] += np.bincount(bucket, minlength=1 << BITS).astype(np.int32)
            at = w.first + text
            for h in (0, 1):
                m = good[at] & (half[at] == h)
                total[1 + h] += np.bincount(bucket[m], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(total[0])
    for i in range(0, len(at), 1 << 16):
        k = at[i:i + (1 << 16)]
        yield {"bucket": k, "raw": total[0, k], "good0": total[1, k], "good1": total[2, k]}


def _ratios(counts: DataFrame, smoothing: float, min_z: float, dead_zone: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with evidence and log p_target / p_raw there, for the two half models and the whole one (0: no evidence)."""
    counts = counts.withColumn("good2", F.col("good0") + F.col("good1"))
    total = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("raw", "good0", "good1", "good2")]).first()
    ratios = []
    for c in ("good0", "good1", "good2"):
        expected = F.col("raw") * F.lit((total[c] or 0.0) / (total["raw"] or 1.0))
        r = F.log((F.col(c) + smoothing) / (expected + smoothing))
        z = (F.col(c) - expected) / F.sqrt(expected + 1)
        ratios.append(F.when((F.abs(z) >= min_z) & (F.abs(r) >= dead_zone) & F.lit(bool(total[c])), r).otherwise(F.lit(0.0)).alias(c))
    found = counts.select("bucket", *ratios).where("good0 != 0 OR good1 != 0 OR good2 != 0").toArrow()  # 2^BITS rows at most
    return (found.column("bucket").to_numpy(),
            np.array([found.column(c).to_numpy() for c in ("good0", "good1", "good2")], np.float32))


def _score(models: tuple[np.ndarray, np.ndarray], temperature: float, seed: int):
    buckets, ratios = models

    def run(batches):
        place = np.full(1 << BITS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        keep = place >= 0
        for b in batches:
            n = b.num_rows
            weight = np.zeros((3, n))
            for w in W.tokenize(b.column("text")):
                text, bucket = _buckets(w, keep)
                for m in range(3):
                    weight[m] += np.bincount(w.first + text, weights=ratios[m][place[bucket]], minlength=n)
            half = b.column("half").fill_null(-1).to_numpy()
            key = b.column("key").to_numpy().view(np.uint64)
            u = (W.mix(key + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54
            noisy = weight[2] / temperature - np.log(-np.log(u))
            bits = noisy.view(np.int64)
            yield {"doc_id": b.column("doc_id"), "_row": b.column("_row"), "good": b.column("good"),
                   "log_weight": weight[2], "held_out": np.where(half == 0, weight[1], np.where(half == 1, weight[0], np.nan)),
                   # signed integers in the order of the keys
                   "rank": bits ^ ((bits >> 63) & np.int64(2**63 - 1))}
    return run


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, seed: int) -> DataFrame:
    """docs with `good` (null: unlabelled) and `half` of the labels."""
    lab = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    lab = lab.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"),
                     F.xxhash64("doc_id", F.lit(seed)).alias("h")).where(F.col("good").isNotNull())
    lab = lab.join(lab.agg(F.count(F.lit(1)).alias("n")), F.lit(True))
    lab = (lab.where(F.pmod(F.shiftright("h", 8), F.lit(1 << 30)) < F.lit(float(max_labelled) * (1 << 30)) / F.col("n"))
           .select("doc_id", "good", F.pmod("h", F.lit(2)).cast("int").alias("half")))
    return docs.join(F.broadcast(lab), "doc_id", "left")  # at most about max_labelled rows


def _largest(ranks: DataFrame, k: int) -> int:
    """The k-th largest of a column of 64-bit integers: four counts over 2^16 bins each."""
    low, need = -(2**63), k
    for shift in (48, 32, 16, 0):
        rest = ranks if shift == 48 else ranks.where(F.col("rank").between(low, low + (1 << (shift + 16)) - 1))
        base = low >> shift
        bins = dict(rest.groupBy((F.shiftright("rank", shift) - F.lit(base)).alias("bin"))
                    .agg(F.count(F.lit(1)).alias("n")).collect())
        for b in sorted(bins, reverse=True):
            if need <= bins[b]:
                low = (base + b) << shift
                break
            need -= bins[b]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                        max_labelled: int = MAX_LABELLED, smoothing: float = 1.0, min_z: float = 2.5,
                        dead_zone: float = 0.7, care: float = 4.0, temperature: float = 0.1,
                        seed: int = 9, row: str | None = None) -> DataFrame:
    """One row per document row: _row (`row` if named), doc_id, log_weight, kept."""
    d = pick(docs, doc_id=doc_id, text=text, _row=row) if row else with_row(pick(docs, doc_id=doc_id, text=text))
    d = d.withColumn("key", F.xxhash64("doc_id"))
    d = labelled(d, pick(labels, doc_id="doc_id", quality="quality", toxic="toxic"), max_labelled, seed)
    counts = (arrow_map(d.select("text", "good", "half"), _count, "bucket int, raw int, good0 int, good1 int")
              .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "good0", "good1")]))
    models = _ratios(written(counts, "importance-counts"), smoothing, min_z, dead_zone)
    kind = d.schema["doc_id"].dataType.simpleString()
    scored = written(arrow_map(d, _score(models, temperature, seed),
                               f"doc_id {kind}, _row long, good boolean, log_weight double, held_out double, rank long"),
                     "importance")
    cut = _cut(scored, care)
    k = scored.where(F.col("log_weight") >= cut).count()
    least = _largest(scored.select("rank"), k) if k else 2**63 - 1
    return scored.select("_row", "doc_id", "log_weight", (F.col("rank") >= F.lit(least)).alias("kept"))


def _cut(scored: DataFrame, care: float, width: float = 0.05, bins: int = 4000) -> float:
    """The held-out log weight that best parts good from bad labels: the most of care * good kept + bad rejected (shares)."""
    b = F.greatest(F.lit(-bins), F.least(F.lit(bins), F.floor(F.col("held_out") / width))).cast("int")
    rows = (scored.where(F.col("good").isNotNull()).groupBy(b.alias("b"))
            .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect())
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return -math.inf
    best, cut, lost, caught = care, -math.inf, 0, 0
    for r in sorted(rows, key=lambda r: r["b"]):
        lost, caught = lost + r["good"], caught + r["bad"]
        if (value := care * (good - lost) / good + caught / bad) > best:
            best, cut = value, (r["b"] + 1) * width
    return cut

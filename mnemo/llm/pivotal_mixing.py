"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating.  They
share `share` times the corpus size (words).  A target stops at `most` times
its source's size; what is above is reshared by weight among the others until
none is above.  The result is target = min(most * size, level * weight), with
the level found from a few sums over the table of sources.

Every document of a source shall be taken target / size times on average: its
whole part is certain, the fraction is a copy probability.  The probabilities
are rounded pairwise: of two open documents, words move from one to the other
until one probability is 0 or 1, in a direction drawn so that both
expectations stay.  The expected words of the pair never change, so a source
misses its target by less than one document.

One reduction tree does this for all sources: documents are dealt to buckets
by hash, so a hot source is spread out; each bucket of a source is streamed
in id order and leaves one open document at most; `fan` buckets are combined
per level until one open document is left per source, which is drawn.

Defined cases: null and empty texts have size 0 and are taken 0 words; a
source of size 0 has target 0; one row is returned per input row; draws
depend on the seed, source, bucket and order of ids alone, so reruns agree.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, written

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_PER_BUCKET, FAN = 2_000, 64


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    d = pick(docs, doc_id=doc_id, text=text, source=source)
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
                    .cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, weight, target; sources are numbered by a range sort, not in one task."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.monotonically_increasing_id()  # sorted block << 33 | place in the block
    s = written(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("place", place), "mix-sources")
    s = s.withColumn("block", F.shiftright("place", 33))
    blocks = s.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per sorted block
    before, rows = 0, []
    for b in sorted(blocks):
        rows.append((b["block"], before))
        before += b["n"]
    offsets = s.sparkSession.createDataFrame(rows or [(0, 0)], "block long, before long")
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    s = written(s.join(offsets, "block").select("source", "source_size", "n_docs", turn.alias("weight"),
                                                (F.col("source_size") * most).alias("bound")), "mix-weights")
    total, level = share * (s.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("weight") * level >= F.col("bound")
        r = s.agg(F.sum(F.when(full, F.col("bound"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = (total - (r["full"] or 0)) / r["open"] if r["open"] else math.inf
        if new <= level:
            break
        level = new
    return s.select("source", "source_size", "n_docs", "weight",
                    F.least("bound", F.col("weight") * F.lit(level)).alias("target"))


COLUMNS = ("doc_id", "source", "size", "source_size", "target", "whole", "p", "bucket")


def _round(level: int, seed: int):
    """Streams rows sorted by source and bucket; one open document per bucket is carried along."""

    def pair(x, y, draw):
        """Moves words between two open rows; at least one of them is closed then."""
        (ax, px), (ay, py) = (x[2], x[6]), (y[2], y[6])
        up = min((1 - px) * ax, py * ay)      # words that can move to x
        down = min(px * ax, (1 - py) * ay)    # words that can move to y
        move = up if draw() * (up + down) < down else -down
        both = []
        for row, q in ((x, px + move / ax), (y, py - move / ay)):
            q = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            both.append((*row[:6], q, row[7]))
        return both

    def run(batches):
        key, carry, draw = None, None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in COLUMNS)):
                _, source, size, _, _, _, p, bucket = row
                if (source, bucket) != key:
                    if carry:
                        out.append(carry)
                    key, carry = (source, bucket), None
                    draw = random.Random(f"{seed}:{level}:{bucket}:{source!r}").random
                if size == 0 or not 0 < p < 1:
                    out.append((*row[:6], float(round(p)) if size else 0.0, bucket))
                elif carry is None:
                    carry = row
                else:
                    both = pair(carry, row, draw)
                    out += [r for r in both if not 0 < r[6] < 1]
                    carry = next((r for r in both if 0 < r[6] < 1), None)
            if out:
                yield dict(zip(COLUMNS, map(list, zip(*out))))
        if carry:
            yield {c: [v] for c, v in zip(COLUMNS, carry)}

    return run


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS,
        share: float = 1.5, most: float = 2.0, seed: int = 10, rows_per_bucket: int = ROWS_PER_BUCKET,
        fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a manifest of the mix."""
    sized = sizes(docs, text, doc_id, source)
    aim = written(targets(sized, weights, share, most), "mix-targets")
    n = aim.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // rows_per_bucket))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    open_ = (sized.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("rate", rate)
             .select("doc_id", "source", "size", "source_size", "target", F.floor("rate").alias("whole"),
                     (F.col("rate") - F.floor("rate")).alias("p"),
                     F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema)
    done, level = [], 0
    while True:
        dealt = open_.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id", "size")
        out = written(arrow_map(dealt, _round(level, seed), schema), f"mix-level{level}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~is_open))
        open_ = out.where(is_open)
        if buckets == 1:
            break
        buckets, level = -(-buckets // fan), level + 1
        open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / fan))
    # the last open document of a source is drawn with its probability
    u = F.pmod(F.xxhash64("source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(open_.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)))
    all_rows = done[0]
    for d in done[1:]:
        all_rows = all_rows.unionByName(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return all_rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                           (copies * F.col("size")).alias("taken"))

"""Quality rules as a learned decision list, in DataFrame functions only.

Every text gets a row of statistics.  From labelled rows, sequential covering
learns an ordered list of conjunctions such as ``symbol_share >= 0.21 AND
n_words >= 60``; each names rows to reject, and the list becomes one ordered
conditional expression (`decision`).

1. Marked words: the words and word beginnings that toxic texts hold beyond chance, counted over
   the learning fold of the labelled rows; texts that share their smallest
   hash of four words, as near copies do, count once.  How many of the 16 and
   64 strongest, and of all, a text holds are three of the statistics.
2. Grow, on the learning fold: a rule starts empty and takes the threshold
   condition of the highest information gain until it covers no good row or
   nothing gains.  Thresholds are quantiles of the good and of the bad rows,
   zeros left out.
3. Prune, on the other fold: last conditions go while that raises the share of
   bad rows among those covered.
4. The rule joins the list if enough of what it covers there is bad; rows it
   covers leave both folds, and the next rule is learnt.  Else the list ends.

Steps 2 and 3 are grouped counts over a small written table of labelled
statistics; only counts by (statistic, quantile) reach the driver.  Labels
are used of at most about `max_labelled` ids, chosen by hash of the id, and
at most `max_marked` words are marked; both bounds hold for the fit alone.
Statistics and verdicts cover all rows and whole texts.

Words that lie in repeated 3-word windows are counted without a shuffle: the
windows of a text are sorted by hash, neighbours with equal hashes are compared
by their words, and the sorted places of those that repeat give the number of
words covered.

Defined cases: a null text is empty and has no words; a row that fails the
base test is rejected whatever its label; several labels of one id combine to
the lowest quality and the highest toxicity, nulls ignored; labels without an
id, or with neither value, are left out; without labels, or with labels of
one kind only, the list is empty and the base test decides; one row is
returned per input row, also for repeated or null ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written

MAX_LABELLED, MAX_MARKED, MAX_RULES, MAX_CONDITIONS, QUANTILES = 200_000, 256, 12, 4, 16
MIN_PRECISION, MIN_CAUGHT, SEED = 0.85, 2, 12
BEGINNINGS = (3, 5)
WORDS = r"[\x20\x09-\x0D]+"

#: Statistics that conditions may use, from the counted columns.
STATISTICS = {
    "n_words": lambda: F.col("n_words"),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_share": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "upper_share": lambda: F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
    "digit_share": lambda: F.col("n_digits") / F.greatest("word_chars", F.lit(1)),
    "duplicate_line_share": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "distinct_share": lambda: F.col("n_distinct_words") / F.greatest("n_words", F.lit(1)),
    "words_per_line": lambda: F.col("n_words") / F.greatest("n_lines", F.lit(1)),
    "n_marked": lambda: F.col("n_marked"),
    "n_marked_64": lambda: F.col("n_marked_64"),
    "n_marked_16": lambda: F.col("n_marked_16"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_distinct_words", "n_marked", "n_marked_64", "n_marked_16")


@dataclass(frozen=True)
class Condition:
    statistic: str
    least: bool  # True: value >= cut, False: value < cut
    cut: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= F.lit(self.cut) if self.least else c < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.least else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def bind(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, k: int = 3) -> Column:
    """Words that lie in k-word windows found twice or more in the array."""
    def window(i):
        return F.concat_ws(" ", F.slice(words, i + 1, k))

    def repeats(rows: Column, key: str) -> Column:
        def neighbour(i):
            return F.get(rows, i)[key]
        return F.filter(rows, lambda x, i: neighbour(i - 1).eqNullSafe(x[key]) | neighbour(i + 1).eqNullSafe(x[key]))

    def covered(hashes):
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        likely = bind(by_hash, lambda s: repeats(s, "h"))
        by_text = F.sort_array(F.transform(likely, lambda x: F.struct(window(x["i"]).alias("t"), x["i"].alias("i"))))
        places = F.sort_array(F.transform(bind(by_text, lambda s: repeats(s, "t")), lambda x: x["i"]))
        new = bind(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(x - F.get(p, j - 1), F.lit(k)))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    each = F.transform(F.sequence(F.lit(0), F.size(words) - k),
                       lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    found = bind(each, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > k, found).otherwise(F.lit(0))


def letters(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def tokens(word: Column) -> Column:
    """A word and, if it is longer, its beginnings, which end in *."""
    return F.array(word, *[F.when(F.length(word) > n, F.concat(F.left(word, F.lit(n)), F.lit("*"))).otherwise(word) for n in BEGINNINGS])


def is_marked(word: Column, marked: list[str]) -> Column:
    """Is the word, or one of its beginnings, in the list?"""
    hit = word.isin([m for m in marked if m[-1] != "*"])
    for n in BEGINNINGS:
        if starts := [m[:-1] for m in marked if m[-1] == "*" and len(m) == n + 1]:
            hit |= F.left(word, F.lit(n)).isin(starts) & (F.length(word) > n)
    return hit


def statistics(docs: DataFrame, marked: list[str]) -> DataFrame:
    """The counted columns of every row; `text` goes."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WORDS, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def count(pattern):
        return F.length(F.regexp_replace(text, pattern, ""))

    def of_words(w):
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
                        repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct_words"))

    held = F.filter(letters(text), lambda w: is_marked(w, marked)) if marked else F.array().cast("array<string>")
    of_marked = bind(held, lambda w: F.struct(*[F.size(F.filter(w, lambda x: is_marked(x, marked[:n]))) if marked else F.lit(0)
                                                for n in (len(marked), 64, 16)]))
    facts = docs.withColumns({
        "_w": bind(words, of_words),
        "_l": bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))),
        "n_symbols": count(r"[^#*$%&|<>]+"), "n_upper": count("[^A-Z]+"), "n_digits": count("[^0-9]+"), "_m": of_marked})
    return facts.select("doc_id", *[F.col(c).cast("long").alias(c) for c in (
        "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_upper", "n_digits",
        "_w.n_distinct_words", "_m.col1", "_m.col2", "_m.col3")]).toDF("doc_id", *COUNTS)


def labelled_ids(labels: DataFrame, max_labelled: int, seed: int = SEED) -> DataFrame:
    """doc_id, bad, toxic, prune (one row of four: the pruning fold) of at most about `max_labelled` ids, chosen by hash."""
    lab = (labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy("doc_id")
           .agg(F.coalesce(F.min("quality"), F.lit(1)).alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")))
    n = labels.agg(F.count("doc_id").alias("n")).first()["n"]
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    prune = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    return (lab.where(h < F.lit(float(max_labelled) * (1 << 30) / max(n, 1)))
            .select("doc_id", ((F.col("quality") < 1) | (F.col("toxic") > 0)).alias("bad"), (F.col("toxic") > 0).alias("toxic"),
                    prune.alias("prune")))


def _sketch(words: Column, k: int = 4) -> Column:
    """The smallest hash of k words that follow each other."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.array_min(each)


def _beyond_chance(counts: DataFrame, rate: float, tried: int, chance: float) -> DataFrame:
    """Words with `hits` of `n` that pass: adds `evidence`, Chernoff's bound of the binomial tail."""
    share = F.col("hits") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - rate))).otherwise(F.lit(0.0))
    evidence = F.col("n") * (share * F.log(share / F.lit(rate)) + rest)
    return (counts.where(2 * F.col("hits") > F.col("n")).withColumn("evidence", evidence)
            .where(F.col("evidence") >= math.log(max(tried, 1) / chance)))


def marked_words(docs: DataFrame, labels: DataFrame, max_marked: int = MAX_MARKED, min_docs: int = 3, chance: float = 0.1) -> list[str]:
    """Words and beginnings most of whose texts, and most of whose neighbourhoods, are toxic beyond chance; the strongest first.

    If toxicity fell on texts at random, about `chance` of all words tried
    would pass.  A neighbourhood is the word before and the word after:
    copies of one text add few of them.
    """
    held = docs.join(F.broadcast(labels.where("NOT prune")), "doc_id")  # at most about MAX_LABELLED rows
    words = letters(F.coalesce("text", F.lit("")))
    held = held.select("toxic", bind(words, lambda w: F.struct(w.alias("words"), _sketch(w).alias("sketch"))).alias("t"))
    held = written(held.groupBy("t.sketch").agg(F.max("toxic").alias("toxic"), F.max_by("t.words", F.size("t.words")).alias("words")), "rules-words")
    total = held.agg(F.count_if("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not total["toxic"] or total["toxic"] == total["n"]:
        return []
    sums = F.count_if("toxic").alias("hits"), F.count(F.lit(1)).alias("n")
    counts = written(held.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform("words", tokens)))).alias("word")).groupBy("word").agg(*sums)
                     .where(F.col("n") >= min_docs), "rules-words")
    test = {"rate": total["toxic"] / total["n"], "tried": counts.count(), "chance": chance}
    strongest = F.desc("evidence"), "word"
    found = [r["word"] for r in _beyond_chance(counts, **test).orderBy(*strongest).limit(16 * max_marked).collect()]
    if not found:
        return []
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: is_marked(F.get("words", i), found))
    around = F.transform(at, lambda i: F.struct(tokens(F.get("words", i)).alias("tokens"),
                                                F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("c")))
    each = held.where(F.size("words") > 0).select("toxic", F.explode(around).alias("x"))
    each = each.select("toxic", "x.c", F.explode("x.tokens").alias("word")).where(F.col("word").isin(found))
    each = each.groupBy("word", "c").agg(F.max("toxic").alias("toxic"))
    marked = _beyond_chance(each.groupBy("word").agg(*sums).where(F.col("n") >= min_docs), **test)
    return [r["word"] for r in marked.orderBy(*strongest).limit(max_marked).collect()]


class Learner:
    """Sequential covering over a written table of labelled statistics: prune, bad and a column per statistic."""

    def __init__(self, rows: DataFrame, names: list[str], quantiles: int = QUANTILES, max_conditions: int = MAX_CONDITIONS,
                 max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION, min_caught: int = MIN_CAUGHT):
        self.names, self.max_conditions, self.max_rules = names, max_conditions, max_rules
        self.min_precision, self.min_caught = min_precision, min_caught
        at = [i / quantiles for i in range(quantiles)]  # from the smallest value that is not 0
        found = (rows.where("NOT prune").groupBy("bad")
                 .agg(*[F.percentile_approx(F.when(F.col(n) != 0, F.col(n)), at, 2000).alias(n) for n in names]).collect())
        self.cuts = {n: sorted({float(v) for r in found for v in r[n] or []}) for n in names}
        self.kinds = {r["bad"] for r in found}
        self.rows = written(rows.withColumn("bins", F.array(*map(self._bin, names))), "rules-rows")

    def _bin(self, name: str) -> Column:
        """The number of cuts that the value reaches."""
        cuts = F.array(*map(F.lit, self.cuts[name])).cast("array<double>")
        return F.size(F.filter(cuts, lambda c: c <= F.col(name)))

    def grow(self, left: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < self.max_conditions:
            counts = (left.where(~F.col("prune") & holds(rule)).select("bad", F.posexplode("bins").alias("s", "bin"))
                      .groupBy("s", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect())
            best, gain, good = None, 1e-9, 0
            for s, name in enumerate(self.names):
                by_bin = {r["bin"]: (r["p"], r["n"]) for r in counts if r["s"] == s}
                p0, n0 = (sum(v[i] for v in by_bin.values()) for i in (0, 1))
                low_p = low_n = 0
                for b, cut in enumerate(self.cuts[name]):
                    low_p, low_n = low_p + by_bin.get(b, (0, 0))[0], low_n + by_bin.get(b, (0, 0))[1]
                    for least, p, n in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                        if p and (value := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain, good = Condition(name, least, cut), value, n
            if best is None:
                break
            rule += (best,)
            if not good:
                break
        return rule

    def prune(self, left: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
        """The best beginning of the rule, and the bad and good rows of the pruning fold that it covers."""
        starts = [rule[:i] for i in range(1, len(rule) + 1)]
        row = left.where("prune").agg(
            *[F.count_if(holds(r) & F.col("bad")).alias(f"p{i}") for i, r in enumerate(starts)],
            *[F.count_if(holds(r) & ~F.col("bad")).alias(f"n{i}") for i, r in enumerate(starts)]).first()
        scored = [((row[f"p{i}"] - row[f"n{i}"]) / max(1, row[f"p{i}"] + row[f"n{i}"]), row[f"p{i}"], -len(r), i) for i, r in enumerate(starts)]
        i = max(scored)[-1]
        return starts[i], row[f"p{i}"], row[f"n{i}"]

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        left = self.rows
        while len(rules) < self.max_rules and len(self.kinds) > 1:
            if not (rule := self.grow(left)):
                break
            rule, p, n = self.prune(left, rule)
            if p < self.min_caught or p / (p + n) < self.min_precision:
                break
            rules.append(rule)
            left = left.where(~holds(rule))
        return rules


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the text of the first rule that holds, else null."""
    c = F.lit(None).cast("string")
    for rule in reversed(rules):
        c = F.when(holds(rule), F.lit(" AND ".join(map(str, rule)))).otherwise(c)
    return c


def with_statistics(df: DataFrame) -> DataFrame:
    return df.select("*", *[f().cast("double").alias(n) for n, f in STATISTICS.items() if n not in COUNTS])


def learn_rules(counted: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """The rules learnt from counted rows (`statistics`) and labels (`labelled_ids`); rows that fail the base test don't teach."""
    rows = with_statistics(counted.join(F.broadcast(labels), "doc_id").where(~base_failed()))  # at most about MAX_LABELLED rows
    return Learner(rows.select("prune", "bad", *STATISTICS), list(STATISTICS), **options).learn()


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  max_labelled: int = MAX_LABELLED, **options) -> DataFrame:
    """One row per document row: doc_id, the counted columns, base_failed, rule (that rejects it, else null), kept."""
    d = pick(docs, doc_id=doc_id, text=text)
    known = written(labelled_ids(pick(labels, doc_id="doc_id", quality="quality", toxic="toxic"), max_labelled), "rules-labels")
    counted = written(statistics(d, marked_words(d, known)), "rules-statistics")
    rules = learn_rules(counted, known, **options)
    verdict = with_statistics(counted).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return verdict.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))

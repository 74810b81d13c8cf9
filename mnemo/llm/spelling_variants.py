"""Spelling variants by search schemes on a bidirectional FM-index.

Words that differ by one inserted, deleted or replaced code point are near.
An error lies in one half of a word, so the other half matches exactly: the
first half of the query is the beginning of its near word, or the second half
is its end.  The two schemes are

* forward: match the first half exactly from a word's start, extend to the
  right over the second half and the word's end with one error;
* backward: match the second half exactly from a word's end, extend to the
  left over the first half and the word's start with one error.

A word list is indexed as one text of words between delimiters, in both
directions: the index of the reversed text extends a match to the right, that
of the text itself to the left.  A match is an interval of suffix ranks; a step
by one symbol narrows it by two rank queries, and the error branches over the
symbols that occur before the interval's suffixes.  All queries of a list are
stepped together in numpy; a long interval branches over the alphabet, a
short one over its own rows.

The vocabulary is dealt to lists by the half that a scheme matches: an
indexed word goes to the beginnings (ends) of the lengths that the halves of
words one shorter, of its own length and one longer have, a query to its own
half.  Lists hold whole groups of equal halves; a group of more than `block`
words is cut, and its queries go to every part.  No list, task or driver holds
the vocabulary.

Defined cases: null and wordless texts have no words; a null doc_id is empty
in the hash; a word without near words has no form and is its own root; pairs
are found from both sides; equal words are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, written

LETTERS, LEAST_LENGTH, LEAST_COUNT, MODULUS, RATIO = "[A-Za-zÀ-ÿ]", 5, 3, 97, 2
LIST_WORDS, BLOCK = 5_000, 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of whole texts, some with a deleted letter; `docs` has doc_id and text."""
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER),
                                F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    word = F.when(F.col("h") % MODULUS == 0, _without(F.col("run"), at)).otherwise(F.col("run"))
    return (each.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


class Index:
    """FM-index of one direction over words between delimiters.

    Symbols are code points ranked from 1; 0 is the delimiter.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.size = n = len(symbols)
        order, rank = np.argsort(symbols, kind="stable"), symbols.astype(np.int64)
        step = 1
        while True:  # prefix doubling over the circular text
            key = rank * (n + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank, step = new, 2 * step
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.suffix = order
        self.before = symbols[order - 1].astype(np.int64)  # the Burrows-Wheeler transform
        self.first = np.searchsorted(symbols[order], np.arange(n_symbols + 1))
        places = np.argsort(self.before, kind="stable")
        self.keys = self.before[places] * (n + 1) + places  # sorted: (symbol, place)
        self.start = np.searchsorted(self.keys, np.arange(n_symbols + 1) * (n + 1))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with `symbol` before those of [low, high)."""
        base = self.first[symbol] - self.start[symbol]
        at = symbol * (self.size + 1)
        return base + np.searchsorted(self.keys, at + low), base + np.searchsorted(self.keys, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of the symbols before the suffixes of each interval, without the delimiter."""
        width = high - low
        wide = np.flatnonzero(width > n_symbols)
        of = np.repeat(wide, n_symbols - 1)
        symbol = np.tile(np.arange(1, n_symbols), len(wide))
        short = np.flatnonzero(width <= n_symbols)
        rows = np.repeat(short, width[short])
        place = np.arange(len(rows)) - np.repeat(np.cumsum(width[short]) - width[short], width[short]) + low[rows]
        key = np.unique(rows * n_symbols + self.before[place])
        key = key[key % n_symbols > 0]
        return np.concatenate([of, key // n_symbols]), np.concatenate([symbol, key % n_symbols])


class Bidirectional:
    """Both directions over one word list."""

    def __init__(self, words: list[str]):
        joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, symbols = np.unique(joined, return_inverse=True)  # the delimiter comes first
        lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # delimiter before each word
        self.n_symbols = len(self.alphabet)
        self.left = Index(symbols, self.n_symbols)
        self.right = Index(symbols[::-1], self.n_symbols)

    def codes(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all queries and their offsets; a letter outside the alphabet is -1."""
        flat = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, flat), self.n_symbols - 1)
        codes = np.where(self.alphabet[at] == flat, at, -1)
        return codes, np.concatenate([[0], np.cumsum([len(q) for q in queries])]).astype(np.int64)

    def near(self, queries: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words that one scheme reaches with exactly one error, each pair once."""
        codes, ptr = self.codes(queries)
        length = np.diff(ptr)
        exact = length // 2 if forward else length - length // 2
        index = self.right if forward else self.left

        def letter(q, j):  # the j-th letter in the direction of the search
            return codes[ptr[q] + j if forward else ptr[q + 1] - 1 - j]

        def match(q, j, low, high, symbol):
            """The states whose interval, narrowed by `symbol`, is not empty."""
            low, high = index.step(np.maximum(symbol, 0), low, high)
            some = (symbol >= 0) & (low < high)
            return q[some], j[some], low[some], high[some]

        q = np.flatnonzero(length > 0)
        zero = np.zeros(len(q), np.int64)
        clean = match(q, zero, zero, zero + index.size, zero)  # from a delimiter
        wrong, found = tuple(a[:0] for a in clean), []
        while len(clean[0]) or len(wrong[0]):
            done = wrong[1] == length[wrong[0]]
            found.append(self._words(index, forward, *match(*(a[done] for a in wrong), np.zeros(done.sum(), np.int64))))
            q, j, low, high = (a[~done] for a in wrong)
            states = [match(q, j + 1, low, high, letter(q, j))]  # after an error the rest matches
            q, j, low, high = (a[clean[1] >= exact[clean[0]]] for a in clean)  # past the exact half an error may come
            at, symbol = index.branches(low, high, self.n_symbols)
            states.append(match(q[at], j[at], low[at], high[at], symbol))  # inserted
            more = j < length[q]
            states.append((q[more], j[more] + 1, low[more], high[more]))  # deleted
            at, symbol = at[more[at]], symbol[more[at]]
            at, symbol = (a[symbol != letter(q[at], j[at])] for a in (at, symbol))
            states.append(match(q[at], j[at] + 1, low[at], high[at], symbol))  # replaced
            wrong = tuple(np.concatenate(c) for c in zip(*states))
            q, j, low, high = (a[clean[1] < length[clean[0]]] for a in clean)
            clean = match(q, j + 1, low, high, letter(q, j))
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // len(self.starts), pair % len(self.starts)

    def _words(self, index: Index, forward: bool, q, j, low, high) -> np.ndarray:
        """Query and word, as one number, of all suffixes that begin with a delimiter, a whole word and a delimiter."""
        width = high - low
        rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        at = index.suffix[rows]
        # the reversed text shows the word's end, the text its beginning
        word = np.searchsorted(self.starts, index.size - 1 - at) - 1 if forward else np.searchsorted(self.starts, at)
        q, ok = np.repeat(q, width), (word >= 0) & (word < len(self.starts) - 1)
        return q[ok] * len(self.starts) + word[ok]


def _keys(word: Column, forward: bool, lengths: list[Column]) -> Column:
    cut = [F.floor(n / 2).cast("int") if forward else F.ceil(n / 2).cast("int") for n in lengths]
    return F.array_distinct(F.array(*[F.concat(F.lit(">" if forward else "<"), F.substring(word, F.lit(1), c) if forward else F.right(word, c))
                                      for c in cut]))


def _search(schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        role = t["role"].to_numpy()
        words = t["word"].combine_chunks()
        counts = t["n"].to_numpy()
        _, rows = np.unique(words.to_numpy(zero_copy_only=False)[role == 0], return_index=True)
        rows = np.flatnonzero(role == 0)[rows]
        listed = words.take(pa.array(rows))
        index = Bidirectional(listed.to_pylist()) if len(rows) else None
        out_q, out_w = [], []
        for direction in (1, 2) if index else ():
            queries = words.filter(pa.array(role == direction))
            q, w = index.near(queries.to_pylist(), direction == 1)
            out_q.append(queries.take(pa.array(q)))
            out_w.append(w)
        if not out_q:
            return schema.empty_table()
        w = np.concatenate(out_w)
        return pa.table({"word": pa.concat_arrays(out_q), "near": listed.take(pa.array(w)), "near_n": counts[rows[w]]}, schema=schema)
    return run


def near_pairs(words: DataFrame, list_words: int = LIST_WORDS, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every word with every near word, from both sides, each pair once; `words` has word and n."""
    n = F.length("word")
    entries, queries = [], []
    for forward in (True, False):
        entries.append(words.select("word", "n", F.lit(0).alias("role"), F.explode(_keys(F.col("word"), forward, [n - 1, n, n + 1])).alias("key")))
        queries.append(words.select("word", "n", F.lit(1 if forward else 2).alias("role"), F.explode(_keys(F.col("word"), forward, [n])).alias("key")))
    entries, queries = entries[0].union(entries[1]), queries[0].union(queries[1])
    groups = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "variants-groups")
    lists = max(1, -(-(groups.agg(F.sum("size")).first()[0] or 0) // list_words))
    hot = groups.where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("parts"))

    def dealt(df, part):
        df = df.join(hot, "key", "left").withColumn("part", part(F.coalesce("parts", F.lit(1))))
        return df.select("word", "n", "role", F.pmod(F.xxhash64("key", "part"), F.lit(lists)).cast("int").alias("list"))

    rows = dealt(entries, lambda p: F.pmod(F.xxhash64("word"), p).cast("int")).union(
        dealt(queries, lambda p: F.explode(F.sequence(F.lit(0), p - 1)))).distinct()
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    pairs = rows.groupBy("list").applyInArrow(_search(schema), "word string, near string, near_n long")
    return pairs.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last; `forms` has word and form.

    A form's count is at least twice its word's, so a chain has less than 64
    steps and pointer doubling ends after six rounds at most.
    """
    state = written(forms.select("word", F.coalesce("form", "word").alias("root")), "variants-roots")
    while True:
        to = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(state.join(to, "root").select("word", "root", "next"), "variants-roots")
        moved = after.where("root != next").limit(1).count()
        state = after.select("word", F.col("next").alias("root"))
        if not moved:
            return state


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      list_words: int = LIST_WORDS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = written(vocabulary(pick(docs, doc_id=doc_id, text=text), least_count), "variants-words")
    near = near_pairs(words, list_words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    fits = -F.col("best.n") >= ratio * F.col("n")
    out = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "variants-forms")
    return out.join(roots(out), "word").select("word", "form", "root", "n", "n_near", "form_n")

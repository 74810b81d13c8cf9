import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemo.llm import words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def tokens(texts, kind, lower, limit):
    out, ids = [[] for _ in texts], [[] for _ in texts]
    for w in W.tokenize(pa.array(texts, pa.string()), kind, lower, limit):
        for i in range(w.n):
            for j in range(w.ptr[i], w.ptr[i + 1]):
                out[w.first + i].append(bytes(w.data[w.start[j]:w.end[j]]).decode())
                ids[w.first + i].append(int(w.ids[j]))
    return out, ids


TEXT = st.text(st.sampled_from("aAbZ09é \t\n\x0b\x0c\r\x1c\x85 　ſ.,-{}[`@/:😀"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.sampled_from([1, 7, 1000]))
def test_words_match_regular_expressions(texts, limit):
    for kind, pattern in (("space", SPACE), ("alnum", ALNUM)):
        got, ids = tokens(texts, kind, True, limit)
        want = [pattern.findall(lower_ascii(t or "")) for t in texts]
        assert [[lower_ascii(x) for x in t] for t in got] == want
        seen = {}
        for ws, hs in zip(want, ids):
            for w, h in zip(ws, hs):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc"]), max_size=12), max_size=6), st.integers(1, 5))
def test_grams(docs, k):
    ids = {}
    for w in W.tokenize(pa.array([" ".join(d) for d in docs], pa.string()), limit=20):
        doc, first, h = W.grams(w, k, short=True)
        for d, f, g in zip(doc, first, h):
            words = docs[w.first + d]
            p = f - w.ptr[d]
            gram = tuple(words[p:p + k])
            assert ids.setdefault(gram, g) == g
    want = {tuple(d[i:i + k]) for d in docs for i in range(max(1, len(d) - k + 1)) if d}
    assert set(ids) == want and len(set(ids.values())) == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=9), max_size=5), st.integers(1, 4))
def test_window_minima(groups, w):
    ptr = np.cumsum([0, *map(len, groups)])
    got = W.window_minima(np.array(sum(groups, []), np.uint64), ptr, w)
    want = set()
    for g, p in zip(groups, ptr):
        for i in range(max(1, len(g) - w + 1) if g else 0):
            part = g[i:i + w]
            want.add(p + i + max(j for j, x in enumerate(part) if x == min(part)))
    assert set(got) == want


def thue_morse(n):
    """A word of 2^n letters and its complement: equal under any polynomial modulo 2^64 from n = 10 on."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_ids_of_thue_morse_words_differ():
    for n in (3, 5, 8, 10, 12):
        a, b = thue_morse(n)
        (w,) = W.tokenize(pa.array([a + " " + b]))
        assert len(set(w.ids.tolist())) == 2
        (w,) = W.tokenize(pa.array([" ".join(a), " ".join(b)]))  # as sequences of words
        x, y = W.range_ids(w.ids, w.ptr[:-1], w.ptr[1:])
        assert x != y
        assert len(W.range_ids(w.ids, w.ptr[:0], w.ptr[:0])) == 0


def test_ids_do_not_depend_on_place():
    texts = ["x" * 255, "x" * 256, "x" * 257, "x" * 5000, "abcdefgh", "abcdefghi", "é" * 4, "q"]
    (w,) = W.tokenize(pa.array([" ".join(texts), "  ".join(texts[::-1])]))
    ids = w.ids.tolist()
    assert ids[:8] == ids[8:][::-1] and len(set(ids)) == 8
    assert (W.range_ids(w.ids, np.array([0, 0, 7]), np.array([0, 3, 8])) != 0).all()

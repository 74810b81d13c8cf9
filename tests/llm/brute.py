"""Plain single-machine versions of the operators, from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def union(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = (("assign", re.compile(rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
           ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256, base spans)."""
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, g, least) in enumerate(SECRETS)
             for m in p.finditer(text or "") if len(m.group(g)) >= least]
    listed = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]
    return *(sum(f[1] == i for f in found) for i in range(3)), sha(",".join(listed)), listed


def substring(docs, n=13):
    """docs: (id, text) -> (id, n_words, n_removed, kept_sha256) per row."""
    words = [(i, SPACE.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for j in range(len(w) - n + 1 if i is not None else 0):
            k = tuple(w[j:j + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - n + 1 if i is not None else 0) if first[tuple(w[j:j + n])] < i for p in range(j, j + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def contamination(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for j in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).update([] if i is None else [str(i)])
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (k := tuple(w[j:j + m])) in windows:
                    hit.update(range(j, j + m))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def conversations(rows):
    """rows: (conv, turn, role, text) without ties -> conv: (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned))
    return out


def jaccard(docs, k=5):
    """(id, set size, component id) per row; every pair is compared."""
    sets = []
    for _, t in docs:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = union(len(sets), pairs)
    least = {}
    for r, (i, _) in zip(root, docs):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, len(s), least[r]) for (i, _), s, r in zip(docs, sets, root)]


def phrases(text, table):
    w = ALNUM.findall(lower(text))
    found = [(i, label) for p, label in table.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def targets(by_source):
    """source sizes -> targets; excess is reshared until none is above."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(by_source.values()), set()
    while True:
        rest = total - sum(2 * by_source[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by_source[s]}
        if not over:
            return {s: share.get(s, 2.0 * by_source[s]) for s in names}
        full |= over


def hard_negatives(rows):
    """op11 of rows (vec_id, vector, label)."""
    part = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in x]) for i, x, y in rows
            if y is not None and x and all(c is not None and math.isfinite(c) and abs(c) < 1e5 for c in x)]
    out = []
    for i, y, x in part:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, v)), j, z) for j, z, v in part if j != i and len(v) == len(x))
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            found = [s for s in scored if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def rules_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of op12."""
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def one_error(a, b):
    """Do the texts differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling(rows):
    """op13 of rows (doc_id, text): (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)

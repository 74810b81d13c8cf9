"""Every operator against its plain version: usual rows, odd rows, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from mnemo.llm import chat_assembly, count_rtree, html_extract, importance, license_automaton, pivotal_mixing
from mnemo.llm import common, rp_forest, secret_scan, substring_dedup, winnowing
from mnemo.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, n string, node string, token string"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); further columns have names that the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y", "z", "v", "w") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(rng, n, size=40):
    return " ".join(rng.choice(["alpha", "Beta", "gamma.", "dé", "x1"]) + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(5)
    passage = words(rng, 30)
    rows = [(i, words(rng, rng.randrange(0, 60)), f"s{i % 4}") for i in range(60)]
    base = words(rng, 120).split()
    for i in range(100, 125):  # near copies of one text
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(w), None))
    rows += [(200 + i, words(rng, 5) + " " + passage + "\n" + words(rng, 7), "hot") for i in range(12)]
    rows += [(300, passage, "hot"), (301, passage, "hot"), (301, passage, "hot"), (302, words(rng, 4000), "long"),
             (303, "a " * 300, "s1"), (304, "a " * 290, "s1"), (305, None, "s1"), (306, None, None), (307, "", "s2"),
             (308, " \t\n\x0b\x0c\r ", "s2"), (309, "\x1c \x85 \xa0", "s2"), (None, passage, "s3"), (None, passage, "s3"),
             (310, "One two three", "s3"), (311, "one TWO three", "s3"), (-5, passage.upper(), "s3")]
    return rows


def test_substring_dedup(spark, corpus):
    for shard in (2000, 2):  # 2: shards are dealt by windows
        got = substring_dedup.dedup_substrings(docs(spark, corpus), shard_segments=shard).collect()
        want = brute.substring([r[:2] for r in corpus])
        assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
        assert all(brute.sha(r["text"]) == r["kept_sha256"] for r in got)
    assert sum(w[2] for w in want) > 300


def test_winnowing(spark, corpus):
    rng = random.Random(6)
    long = corpus[97][1].split()
    items = [(1, " ".join(long[6:20])), (2, "one two THREE"), (3, None), (4, ""), (5, "- -"), (6, "one two THREE"), (None, "x1"),
             (7, words(rng, 25)), (10, corpus[85][1]), (11, "a " * 12), (8, " ".join(long[6:15]))]
    table = spark.createDataFrame([(*i, "c", 1) for i in items], "item_id long, text string, doc_id string, len int")
    got = winnowing.decontaminate(docs(spark, corpus), table).drop("hits").collect()
    want = brute.contamination([r[:2] for r in corpus], items)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert winnowing.decontaminate(docs(spark, corpus), table.limit(0)).where("contaminated").count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    hexa = "0123456789abcdef" * 3
    texts = [f'é😀 password = "{hexa}" and {key}', "token=token: abcdefgh", "Secret:'short' api_key= ab", None, "", f"x{hexa}y" * 3,
             "API_KEY : a.b-c+d/e= TOKEN=zzzzzz", "https://me:pw123@host/ ghp_" + "a1B2" * 9, f"secret={'q' * 5000}",
             "ſecret=abcdefghi passwd=ABCDEF", f"{key}AKIA{key}", "token token=abcdef=token=abcdefg"]
    rows = [(i, t, f"o{i}") for i, t in enumerate(texts)]
    rows += [(50 + i, "token = copiedexample", f"o{i % 5}") for i in range(8)] + [(90, "token = mineonly1", None), (90, "token = mineonly1", None)]
    got = {(r["doc_id"], i): r for i, r in enumerate(secret_scan.secret_report(docs(spark, rows), doc_id="doc_id").orderBy("doc_id").collect())}
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for (i, _), r in got.items():
        n = brute.secrets(text[i])
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == n[:4], text[i]
        assert set(n[4]) <= set(r["spans"].split(",")) | {""}
    by = {i: r for (i, _), r in got.items()}
    assert {"url", "github"} <= {s.split(":")[0] for s in by[7]["spans"].split(",")}
    assert by[50]["n_example"] == 1 and by[50]["n_live"] == 0 and by[90]["n_live"] == 1
    out = {r["doc_id"]: r for r in secret_scan.redact(docs(spark, rows)).collect()}
    assert out[50]["text"] == "token = copiedexample" and out[90]["text"] == "[REDACTED]" and out[3]["text"] is None
    assert out[0]["text"] == 'é😀 [REDACTED]" and [REDACTED]'
    assert secret_scan.redact(docs(spark, rows)).columns == docs(spark, rows).columns


def test_secrets_of_private_keys(spark):
    """Every key is a value of its own and goes as a whole; only a key that three owners hold is an example."""
    def pem(body, kind="RSA "):
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"

    rows = [(i, f"é {pem(f'MIIEmine{i}+/' * 30)} after", f"o{i}") for i in range(4)]
    rows += [(10 + i, f"a {pem('MIIEcopied')} b", f"o{i}") for i in range(3)]
    rows += [(20, "x -----BEGIN PRIVATE KEY-----\nMIIEcut\r\nmore", "o1"),
             (21, f"x -----BEGIN EC PRIVATE KEY-----\nMIIEcut2\n{pem('MIIEwhole', '')} y {pem('MIIEcopied')}", "o2"),
             (22, "-----BEGIN EC PRIVATE KEY-----\nMIIEother\n-----END RSA PRIVATE KEY-----", "o3"),
             (23, "-----BEGIN PRIVATE KEY-----", "o3"), (24, f"{pem('Q' * 200_000)} z", "o4")]
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs(spark, rows)).collect()}
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, rows)).collect()}
    for i in range(4):
        assert got[i]["spans"] == f"pem:2:{len(rows[i][1]) - 6}" and (got[i]["n_live"], got[i]["n_example"]) == (1, 0)
        assert out[i] == "é [REDACTED] after"
    for i in range(10, 13):
        assert (got[i]["n_live"], got[i]["n_example"]) == (0, 1) and out[i] == f"a {pem('MIIEcopied')} b"
    assert out[20] == "x [REDACTED]" and out[21] == f"x [REDACTED][REDACTED] y {pem('MIIEcopied')}"
    assert out[22] == "[REDACTED]" and got[23]["n_live"] == 0 and out[24] == "[REDACTED] z"


def test_secrets_are_native(spark, corpus):
    for df in (secret_scan.secret_report(docs(spark, corpus)), secret_scan.redact(docs(spark, corpus))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_jaccard(spark, corpus):
    want = sorted(map(str, brute.jaccard([r[:2] for r in corpus])))
    for options in ({}, {"groups": 4, "block": 3, "counted": 0.1}):
        got = count_rtree.jaccard_components(docs(spark, corpus), **options)
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == want


def test_count_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (300, 8)).astype(np.int32)
    sizes, comps = points.sum(axis=1), rng.integers(0, 20, 300)
    tree = count_rtree.CountTree(points, sizes, comps)
    at = np.arange(0, 300, 17)
    for at_once in (1 << 13, 7):
        got = set(zip(*map(np.ndarray.tolist, tree.candidates(points[at], sizes[at], comps[at], 75, at_once))))
        shared = np.minimum(points[None], points[at][:, None]).sum(axis=2)
        fits = (175 * shared >= 75 * (sizes[None] + sizes[at][:, None])) & (comps[None] != comps[at][:, None])
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(fits))))


def test_tree_finds_links_that_first_nodes_miss(spark, monkeypatch):
    """Longer texts come first in every bucket of two near copies and link with neither."""
    rng = random.Random(12)
    base = words(rng, 150, 10**6).split()
    near = [base[:70] + ["other"] + base[71:], base]
    rows = [(i, " ".join(base + words(rng, 70, 10**6).split())) for i in range(20)] + [(50 + i, " ".join(w)) for i, w in enumerate(near)]
    want = sorted(map(str, brute.jaccard(rows)))

    def run():
        got = count_rtree.jaccard_components(docs(spark, rows).orderBy("doc_id").coalesce(1), counted=0.0)
        return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect())

    assert run() == want and "51, 146, 50" in str(want)
    none = (np.zeros(0, np.int64),) * 2
    monkeypatch.setattr(count_rtree.CountTree, "candidates", lambda self, *a: none)
    assert run() != want


def thue_morse():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_polynomials_are_different(spark):
    a, b = thue_morse()
    rest = words(random.Random(1), 12)
    rows = [(1, a), (2, b), (3, f"{rest} {a}"), (4, f"{rest} {b}")]
    got = {r["doc_id"]: r["component_id"] for r in count_rtree.jaccard_components(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}  # 8 of 10 shingles
    assert substring_dedup.dedup_substrings(docs(spark, rows)).where("n_removed > 0").count() == 0
    items = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert {r["doc_id"] for r in winnowing.decontaminate(docs(spark, rows), items).where("contaminated").collect()} == {2, 4}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(1000, i) for i in range(900, 960)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = brute.union(1001, pairs)
    assert got == {i: root[i] for a, b in pairs for i in (a, b) if a != b}


def jobs_of(spark, name, run):
    """What `run` returns, and the number of Spark jobs that it starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components_stop_at_stars(spark):
    """Edges that are stars already take no further step."""
    pairs = [(1000 + i, i % 7) for i in range(300)]
    got, jobs = jobs_of(spark, "stars", lambda: dict(components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: min(p) for p in pairs for i in p}
    assert jobs <= 8


def test_jaccard_jobs_do_not_follow_shuffle_partitions(spark, corpus):
    """The driver keeps something of every job: bitmaps come in a fixed number of them, components are not made anew."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got, jobs = jobs_of(spark, "jaccard", lambda: count_rtree.jaccard_components(docs(spark, corpus)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(map(str, brute.jaccard([r[:2] for r in corpus])))
    assert jobs <= 120


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * s, int(i % 2)) for s in (0, 0.05, 0.1, 0.3)]
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.1, 5) for _ in range(120)] + [(rows[0][0], 0)] * 20
    table = [(i, [float(np.float32(v)) for v in x], y) for i, (x, y) in enumerate(rows)]
    odd = [(None, table[0][1], 0), (900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0] * 15 + [None], 0),
           (904, [1.0] * 15 + [float("nan")], 0), (905, [float("inf")] + [1.0] * 15, 0), (906, table[0][1], None),
           (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "c", 1) for r in table + odd], "vec_id long, embedding array<float>, label int, node string, leaf int")
    all_rows = table + odd
    good = [i for i, (_, x, y) in enumerate(all_rows) if y is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    pairs, n_links = [], [0] * len(all_rows)
    for a in good:
        for b in good:
            if a < b and all_rows[a][2] == all_rows[b][2] and len(all_rows[a][1]) == len(all_rows[b][1]):
                x, y = np.array(all_rows[a][1]), np.array(all_rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    pairs.append((a, b))
                    n_links[a] += 1
                    n_links[b] += 1
    root = brute.union(len(all_rows), pairs)
    ids = [r[0] for r in all_rows]
    want = []
    for i, r in enumerate(root):
        least = min((ids[j] for j in range(len(ids)) if root[j] == r and ids[j] is not None), default=None)
        want.append(str((ids[i], n_links[i], least, ids[i] == least)))
    for options in ({}, {"leaf": 8, "block": 32}):
        got = rp_forest.link_vectors(df, **options).collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(want)


def test_licenses(spark, corpus):
    table = license_automaton.PHRASES
    texts = ["Under the MIT license.", "x under the-mit!license under THE MIT license: mit", "Licensed under the Apache License, Version 2.0.",
             "CC BY-NC 4.0 cc by nc", "cc by cc by nc by nc", "under the mit", None, "", "apache license version 2" * 3,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
             " files (the Software), to deal in it"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, r[1]) for i, r in enumerate(corpus)]
    got = {r["doc_id"]: r for r in license_automaton.scan_licenses(docs(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.phrases(t, table), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[9]["labels"] == "mit" and got[9]["n_base"] == 0
    assert all(got[100 + i]["labels"] == "" for i in range(len(corpus)))


def test_matching_statistics():
    from mnemo.llm.automaton import SuffixAutomaton
    rng = random.Random(1)
    for _ in range(50):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(3)]
        sa = SuffixAutomaton()
        for t in texts:
            sa.start()
            for c in t:
                sa.extend(c)
        query = "".join(rng.choice("abc") for _ in range(20))
        for i, (_, n) in enumerate(sa.stream(query)):
            assert n == max(m for m in range(i + 2) if any(query[i + 1 - m:i + 1] in t for t in texts))


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        text = words(rng, rng.randrange(5, 80), 30)
        kind = i % 5
        if kind == 0:
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == 1:
            w = text.split()
            text = " ".join(x for y in w for x in ([y, rng.choice(["vile", "nasty"])] if rng.random() < 0.3 else [y])) + " vile"
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(5000, None), (5001, ""), (None, "vile " * 5), (3, rows[3][1])]
    labels += [(4, None, None), (None, 0, 1), (4, 1, 0)]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = importance.importance_resample(docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1500 and r["doc_id"] % 2]
    good = [r["kept"] for r in held_out if r["doc_id"] % 5 > 1]
    bad = [r["kept"] for r in held_out if r["doc_id"] % 5 <= 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad)
    again = importance.importance_resample(docs(spark, rows), table).collect()
    assert sorted(map(str, ((r["doc_id"], r["kept"]) for r in got))) == sorted(map(str, ((r["doc_id"], r["kept"]) for r in again)))
    assert importance.importance_resample(docs(spark, rows), table.limit(0)).where("NOT kept").count() == 0


def test_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.randrange(-2**63, 2**63), rng.randrange(-5, 5)]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "rank long")
    for k in (1, 2, 77, 200):
        assert importance._largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_mixing(spark, corpus):
    df = docs(spark, corpus)
    got = pivotal_mixing.mix(df, rows_per_bucket=10, fan=2).collect()
    sized = sorted(((r[0], len(brute.SPACE.findall(r[1] or "")), r[2]) for r in corpus), key=str)
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in got), key=str) == sized
    by = {}
    for _, n, s in sized:
        by[s] = by.get(s, 0) + n
    want = brute.targets(by)
    for s in by:
        rows = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in rows} == {by[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in rows)
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= max(r["size"] for r in rows)
        assert all(r["taken"] <= 2 * r["size"] for r in rows)
    again = pivotal_mixing.mix(df.repartition(7), rows_per_bucket=10, fan=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rounding_is_fair(spark):
    rows = [(i, "w " * (1 + i % 3), "a") for i in range(30)] + [(100, "w " * 600, "b")]
    taken = np.mean([[r["copies"] for r in sorted(pivotal_mixing.mix(docs(spark, rows), seed=s, rows_per_bucket=8).collect(),
                                                  key=lambda r: r["doc_id"]) if r["source"] == "b"] for s in range(6)])
    assert 0 < taken < 2


def test_chat(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be <<SYS>> kind"), (1, 1, "user", control), (1, 2, "assistant", control), (2, 5, "assistant", None),
            (2, 4, "user", ""), (3, 0, "tool\\[INST]", "\\</s>\\\\<|end|>\\" * 50), (3, 1, None, "é😀\x00 \n"), (3, 2, "assistant", "<\\/s>"),
            (None, 0, "user", "null id"), (None, 1, "assistant", "b"), (4, 0, "assistant", "word " * 40_000), (4, 1, "assistant", " " * 9000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, tie string, ids int").repartition(3)
    out = chat_assembly.assemble(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_assembly.read_back(out).collect()}
    assert got == brute.conversations(rows)
    turns = sorted((r for r in out.collect() if r["conv_id"] == 1), key=lambda r: r["place"])
    assert [r["offset"] for r in turns] == [0, len(turns[0]["ids"]), len(turns[0]["ids"]) + len(turns[1]["ids"])]
    with open(chat_assembly.TOKENIZER, "rb") as f:
        codec = chat_assembly.Codec(f.read(), chat_assembly.PATTERN)
    # the template's ids, and no other, are reserved ones; the mask covers the answer and its </s>
    reserved = [[codec.name[i] for i in r["ids"] if i >= codec.first_control] for r in turns]
    assert reserved == [["<s>", "<<SYS>>", "<</SYS>>"], ["[INST]", "[/INST]"], ["<|assistant|>", "</s>"]]
    assert [sum(r["mask"]) for r in turns] == [0, 0, len(turns[2]["ids"]) - 1]
    plain = chat_assembly.read_back(chat_assembly.assemble(df, learn_stop=False)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in plain} == got


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p> </p>", ""), ("plain &lt;text&gt;", "plain <text>"),
    ("<nav>menu</nav><article><h1>T</h1><p><b>a\n b<br>c<p>Sh.</article><footer>f", "T\n\na b c\n\nSh."),
    ("<body><div class='top-menu'><a>x</a></div><div id=c><p>Long text about things, and more of it.<p>Short.<div id=comments><p>first"
     "</div></div><div class=footer>c</div>", "Long text about things, and more of it.\n\nShort."),
    ("<form><article><p>in a form</p></article><input></form>", "in a form"),
    ("<main><aside>s</aside><div class=cookie-notice>n</div><p>x&nbsp;&amp;<i>y</i>z<script>'</p>'</script></p></main>", "x &yz"),
    ("<article><p>one</p></div></section><p>two", "one\n\ntwo"),
])
def test_html(page, text):
    assert html_extract.extract(page) == text


def paragraphs(word, n, size=40):
    return [f"{word}{i} " * size + "end." for i in range(n)]


def test_html_region_holds_all_content():
    """No content is left out for a share: sibling sections, sibling articles, a lead beside the body's container."""
    long, short, lead = paragraphs("long", 19), paragraphs("short", 1), paragraphs("lead", 1)
    tags = {name: "".join(f"<p>{p}</p>" for p in ps) for name, ps in (("long", long), ("short", short), ("lead", lead))}
    links = "<ul>" + "<li><a href=x>l</a></li>" * 9 + "</ul>"
    sections = f"<body><div>{links}</div><div><section>{tags['long']}</section><section>{tags['short']}</section></div>"
    assert html_extract.extract(sections) == "\n\n".join(long + short)
    articles = f"<body><div>{links}</div><article>{tags['long']}</article><div>{links}</div><article>{tags['short']}</article>"
    assert html_extract.extract(articles) == "\n\n".join(long + short)
    thirds = "<body>" + "".join(f"<article><p>{p}</p></article>" for p in paragraphs("third", 3)) + f"<div>{links}</div>"
    assert html_extract.extract(thirds) == "\n\n".join(paragraphs("third", 3))
    beside = f"<body><div>{links}</div><div>{tags['lead']}<div>{tags['long']}</div></div>"
    assert html_extract.extract(beside) == "\n\n".join(lead + long)
    outside = f"<body><div>{links}</div><div>{tags['lead']}</div><article>{tags['long']}</article>"
    assert html_extract.extract(outside) == "\n\n".join(lead + long)


@pytest.mark.parametrize("tag, name", [
    ("div", "class='content with-sidebar'"), ("main", "class=no-sidebar"), ("article", "class='post comments-open'"),
    ("div", "id=site-menu-open"), ("div", "class=notice"), ("div", "id=share-story"), ("article", "class=related"), ("div", "class=comments"),
])
def test_html_names_of_wrappers(tag, name):
    """A wrapper of the text isn't skipped for a word in its name; menus, adverts and comments in and beside it are."""
    body = paragraphs("body", 5)
    beside = ("<div class='main-menu'><ul><li><a href=x>menu</a></ul></div>", "<div class='share-buttons'><p><a>share</a></div>")
    text = "".join(f"<p>{p}</p>" for p in body)
    for inner in (text, f"<article>{text}</article>"):
        page = f"<body>{beside[0]}<{tag} {name}>{beside[1]}{inner}</{tag}>{beside[0]}"
        assert html_extract.extract(page) == "\n\n".join(body)


def test_html_named_containers_go():
    body, more = "".join(f"<p>{p}</p>" for p in paragraphs("body", 3)), "".join(f"<p>{p}</p>" for p in paragraphs("more", 9))
    want = "\n\n".join(paragraphs("body", 3))
    for name in ("comments", "comment-list", "comments-area"):  # longer than the text
        assert html_extract.extract(f"<div id=post>{body}</div><div class={name}>{more}</div>") == want
    aside = f"<p>{paragraphs('more', 1)[0]}</p>"
    for name in ("related-posts", "sidebar", "cookie-notice", "ad-1", "newsletter-signup", "sidebar-left"):
        assert html_extract.extract(f"<div id=post>{body}</div><div class={name}>{aside}</div>") == want
        assert html_extract.extract(f"<main>{body}<div class={name}><article>{aside}</article></div></main>") == want
    assert html_extract.extract("<p>a <span class=share>b</span> c</p>") == "a c"
    for name in ("related", "comments"):  # an article that is shorter than what stands beside it
        assert html_extract.extract(f"<article><h1>T</h1><p>Short.</p></article><div class={name}>{more}</div>") == "T\n\nShort."


def test_html_table(spark):
    rows = [(1, "u", "<article><p>é😀</p></article>"), (2, None, None), (None, "u", "<p>x"), (1, "u", "<article><p>é😀</p></article>"),
            (3, "u", "<article>" + "<p>word word</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(str, ((r["page_id"], r["url"], len(r["text"]), r["n_chars"]) for r in html_extract.extract_main_text(df).collect())))
    n = len("word word") * 20_000 + 2 * 19_999
    assert got == sorted(map(str, [(1, "u", 2, 2), (2, None, 0, 0), (None, "u", 1, 1), (1, "u", 2, 2), (3, "u", n, n)]))


def test_row_keys_hold_when_splits_change(spark, monkeypatch, tmp_path):
    """Executors that join or leave change spark.sql.files.minPartitionNum's default, and with it the splits, between passes."""
    rows = [(i, f"password = mine{i:06d} " + "x " * (i % 7) + f"row {i}", f"o{i % 5}") for i in range(120)]
    rows += [(200 + i, "one two three four five six seven " * (1 + i // 10) + str(i % 2), "s") for i in range(40)]
    docs(spark, rows).repartition(12).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    conf, real, n = "spark.sql.files.minPartitionNum", common.written, [0]

    def written(df, name):
        df = real(df, name)
        n[0] += 1
        spark.conf.set(conf, (1, 40, 3)[n[0] % 3])
        return df

    for module in (common, count_rtree, rp_forest, secret_scan, winnowing):
        monkeypatch.setattr(module, "written", written)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    spark.conf.set(conf, 40)
    try:
        out = {r["doc_id"]: r["text"] for r in secret_scan.redact(table).collect()}
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in count_rtree.jaccard_components(table).collect()]
        vectors = table.selectExpr("doc_id AS vec_id", "array(1.0D, CAST(doc_id % 9 AS double)) AS embedding", "1 AS label")
        forest = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in rp_forest.link_vectors(vectors, threshold=0.9999).collect()}
        docs_key, key = common.keyed(table)
        places = []
        for least in (1, 40):
            spark.conf.set(conf, least)
            places.append(sorted((r["doc_id"], r[key]) for r in docs_key.select("doc_id", key).collect()))
    finally:
        spark.conf.unset(conf)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out == {i: t if i >= 200 else "[REDACTED]" + t[len("password = mine000000"):] for i, t, _ in rows}
    assert sorted(map(str, got)) == sorted(map(str, brute.jaccard([r[:2] for r in rows])))
    alike = {i: [j for j, _, _ in rows if j % 9 == i % 9] for i, _, _ in rows}
    assert len(forest) == len(rows) and all(c[0] == min(alike[i]) and c[1] == len(alike[i]) - 1 for i, c in forest.items())
    assert places[0] == places[1]


def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).limit(0)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").limit(0)
    turns = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string").limit(0)
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").limit(0)
    for df in (secret_scan.secret_report(none), substring_dedup.dedup_substrings(none), winnowing.decontaminate(none, items),
               chat_assembly.read_back(chat_assembly.assemble(turns)), count_rtree.jaccard_components(none),
               html_extract.extract_main_text(pages), rp_forest.link_vectors(vectors), license_automaton.scan_licenses(none),
               importance.importance_resample(none, labels), pivotal_mixing.mix(none)):
        assert df.count() == 0

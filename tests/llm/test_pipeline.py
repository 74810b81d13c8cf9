"""The pipeline's stages on whole small tables, each against a plain version of its decision."""

import os
import subprocess
import sys

import pytest

import brute
import corpus_pipeline as P
from mnemo.llm import importance
from mnemo.llm.common import read

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
STAGE = dict(P.STAGES)


@pytest.fixture(scope="module")
def table(spark):
    docs = read(spark, SF, "documents")
    return docs, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontam", "secrets", "mixture"]


def test_quality(spark, table):
    docs, _ = table
    out = STAGE["quality"](spark, docs, SF)
    kept = {r["doc_id"] for r in importance.importance_resample(docs, read(spark, SF, "labels")).where("kept").collect()}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    good = {r["doc_id"] for r in read(spark, SF, "labels").where("quality = 1 AND toxic = 0").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_near_dedup(spark, table):
    docs, rows = table
    out = STAGE["near_dedup"](spark, docs, SF)
    want = {c for _, _, c in brute.jaccard([r[:2] for r in rows])}
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_decontam(spark, table):
    docs, rows = table
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    want = sorted(x[0] for x in brute.contamination([r[:2] for r in rows], items) if not x[5])
    out = STAGE["decontam"](spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == want and len(want) < len(rows)


def test_secrets(spark, table):
    docs, rows = table
    out = {r["doc_id"]: r for r in STAGE["secrets"](spark, docs, SF).collect()}
    owners = {}
    for _, text, source in rows:
        for i, (_, p, g, least) in enumerate(brute.SECRETS):
            for m in p.finditer(text or ""):
                owners.setdefault(m.group(g), set()).add(source)
    assert len(out) == len(rows)
    for i, text, _ in rows:
        live = [m for _, p, g, least in brute.SECRETS for m in p.finditer(text or "")
                if len(m.group(g)) >= least and len(owners[m.group(g)]) < 3]
        if not live:
            assert out[i]["text"] == text
        else:
            assert "[REDACTED]" in out[i]["text"] and not any(m.group(0) in out[i]["text"] for m in live)


def test_mixture_and_run(spark, table):
    got = P.run(spark, SF).collect()
    by = {}
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["size"]
    want = brute.targets(by)
    for s in by:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in table[1]}


def test_entry_works_without_the_subpackage():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('mnemo.llm', 'corpus_pipeline'):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'top_n_spearman' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
            "assert 'pipeline' not in e.queries() and 'op3_winnowing' not in e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)

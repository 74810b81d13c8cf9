"""Fitted work that is done once and read by many: designs, predictions, sweep cells.

`Study` holds the feature sets as they are (items may lack sets) and makes the
model input of a combination: aligned items, folds, selection, scaling or
kernels.  A design is written once and read by every model.

`Store` is a folder on the shared file system with one entry per key: a claim
(created atomically, so two drivers never fit the same entry), a Parquet table
with the result, and a ledger row that says how it ended.  An entry counts as
done when its ledger row says `ok`; what a stopped run left half-done is made
anew by the next one.

* `sweep_cells` (E3): one entry per (fusion, combination, selector), holding
  the result rows of all models; parameters are restored on resume.
* `fold_predictions` (E5, E7): one entry per (configuration, items), holding the
  out-of-fold predictions, read by every run that uses the configuration.
* `full_predictions` (E6): the same fitted on all labelled items, with the
  predictions of the training items, which give the training rho.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble as ens
from ..operators.align import explode_features
from ..operators.analysis import fold_stats
from ..operators.folds import assign_folds
from ..operators.ranks import spearman
from ..session import cut_lineage
from .aligned import aligned_items
from .evaluate import SWEEP_SCHEMA, FoldedVectors, concat_design, folded_vectors, kernel_design, score_folds
from .learners import fit_predict

LEDGER = "key string, state string, owner string, message string, n long"


def key_of(*parts) -> str:
    """A short name of anything that JSON can write; equal contents have equal names."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


class Store:
    """Entries below a folder that all drivers and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), uuid.uuid4().hex
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join((self.path, *parts)))

    def states(self) -> dict[str, tuple[str, str | None]]:
        """key -> (state, message); `ok` beats `failed`."""
        if not self._fs.exists(self._at("ledger")):
            return {}
        out: dict[str, tuple[str, str | None]] = {}
        for r in self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").select("key", "state", "message").collect():
            if out.get(r["key"], ("",))[0] != "ok":
                out[r["key"]] = (r["state"], r["message"])
        return out

    def claim(self, key: str) -> bool:
        return self._fs.createNewFile(self._at("claims", key))

    def release(self, key: str) -> None:
        self._fs.delete(self._at("claims", key), False)

    def take_over(self) -> None:
        """Drops the claims of a run that has ended; call it only when no other driver works on the store."""
        self._fs.delete(self._at("claims"), True)

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries/{key}")

    def fill(self, key: str, make: Callable[[], DataFrame]) -> tuple[str, str | None]:
        """(state, message) of the entry, made if it is not there and not claimed by another driver.

        A failure is a ledger row, not an error; a failed entry is tried again by the next call.
        """
        have = self.states().get(key)
        if have and have[0] == "ok":
            return have
        if not self.claim(key):
            return "claimed", None
        try:
            make().write.mode("overwrite").parquet(f"{self.path}/entries/{key}")
            row = (key, "ok", self.owner, None, self.read(key).count())
        except Exception as exc:  # noqa: BLE001 - the ledger says so
            row = (key, "failed", self.owner, str(exc)[:1000], None)
        finally:
            self.release(key)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return row[1], row[3]

    def parameters(self, given: dict) -> dict:
        """The parameters of the run: those of the stopped run if there is one, else `given`, which are kept."""
        at = self._at("parameters")
        if self._fs.exists(at):
            return json.loads(self.spark.read.text(f"{self.path}/parameters").first()["value"])
        self.spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(f"{self.path}/parameters")
        return given


@dataclass
class Study:
    """Feature sets, labels and combinations; `others` are the vectors of the unlabelled split.

    vecs / others: (item_id, feature_set, values); labels: (item_id, y).
    """

    vecs: DataFrame
    labels: DataFrame
    combos: dict[str, list[str]]
    widths: dict[str, int]
    others: DataFrame | None = None
    k: int = 5
    seed: int = 42
    _designs: dict = field(default_factory=dict)
    _vectors: dict = field(default_factory=dict)

    def names(self, combo: str) -> list[str]:
        if combo not in self.combos:
            raise ValueError(f"unknown combination {combo!r}; known: {', '.join(self.combos)}")
        return self.combos[combo]

    def _long(self, vecs: DataFrame, names: list[str]) -> DataFrame:
        return explode_features(vecs.where(F.col("feature_set").isin(names))).select(
            "item_id", "feature_set", F.col("idx").cast("bigint").alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value"))

    def items(self, combo: str, fusion: str) -> DataFrame:
        """(item_id, y): the labelled items that the combination has (P6 with early fusion only)."""
        return aligned_items(self.vecs, list(self.widths), self.names(combo), self.labels, fusion == "concat")

    def _input(self, rows: DataFrame | FoldedVectors, names: list[str], selector: str, fusion: str) -> DataFrame:
        return concat_design(rows, names, selector) if fusion == "concat" else kernel_design(rows, names, selector)

    def _rows(self, names: list[str], folded: DataFrame, of: tuple) -> FoldedVectors:
        """The items' vectors, written once for all selectors of a (fusion, combination, plan)."""
        if of not in self._vectors:
            vecs = self.vecs.where(F.col("feature_set").isin(names)).withColumn(
                "values", F.transform("values", lambda x: F.coalesce(x, F.lit(0.0))))
            self._vectors[of] = folded_vectors(vecs, folded, tuple(range(1, self.k + 1)))
        return self._vectors[of]

    def folded_design(self, combo: str, selector: str, fusion: str, folded: DataFrame | None = None, plan: str = "") -> DataFrame:
        """(fold, role, item_id, y, features), written once per (combination, selector, fusion, plan)."""
        at = (combo, selector, fusion, plan)
        if at not in self._designs:
            if folded is None:
                folded = assign_folds(self.items(combo, fusion), k=self.k, seed=self.seed)
            names = self.names(combo)
            self._designs[at] = cut_lineage(self._input(self._rows(names, folded, (fusion, combo, plan)), names, selector, fusion))
        return self._designs[at]

    def full_design(self, combo: str, selector: str, fusion: str) -> DataFrame:
        """The same for a fit on all labelled items (fold 0, role train) and the other split (role test)."""
        at = (combo, selector, fusion, None)
        if at not in self._designs:
            names, sets = self.names(combo), list(self.widths)
            train = self._long(self.vecs, names).join(self.items(combo, fusion), "item_id").withColumn("role", F.lit("train"))
            ids = aligned_items(self.others, sets, names, None, fusion == "concat")
            test = self._long(self.others, names).join(ids, "item_id").withColumns({"y": F.lit(None).cast("double"), "role": F.lit("test")})
            rows = cut_lineage(train.unionByName(test).withColumn("fold", F.lit(0).cast("bigint")))
            self._designs[at] = cut_lineage(self._input(rows, names, selector, fusion))
        return self._designs[at]


def cell_row(study: Study, combo: str, selector: str, model: str, fusion: str, trees: int = 100) -> tuple:
    """One sweep-result row (D8): n_samples counts the aligned items."""
    design = study.folded_design(combo, selector, fusion)
    r = fold_stats(score_folds(fit_predict(design, model, trees=trees)).withColumn("_k", F.lit(1)), ["_k"]).first()
    n = design.select("item_id").distinct().count()
    names = study.names(combo)
    return (combo, "|".join(names), sum(study.widths[s] for s in names), n, selector, model if fusion == "concat" else f"KF_{model}",
            r["mean_spearman"], r["std_spearman"], r["min_spearman"], r["max_spearman"])


def sweep_cells(study: Study, store: Store, combos: list[str], models: list[str], selectors: list[str], fusion: str = "both",
                trees: int = 100, stop_after: int | None = None) -> DataFrame:
    """Every cell of the grid, in entries of one design each; the rows of all entries made so far.

    Unknown combinations give a row of status `skipped`.  A cell that fails gives
    status `failed` with the error's text; its entry is done, the sweep goes on.
    A run on a store that a stopped run left restores that run's parameters and
    makes what is missing.  `stop_after`: entries to make in this call.
    """
    p = store.parameters({"combos": list(combos), "models": list(models), "selectors": list(selectors), "fusion": fusion, "trees": trees})
    spark, made = store.spark, 0
    fusions = ["kernel", "concat"] if p["fusion"] == "both" else [p["fusion"]]
    units = [(f, c, s) for f in fusions for c in p["combos"] if c in study.combos for s in p["selectors"]]
    keys = {u: key_of("cell", p["models"], p["trees"], *u) for u in units}

    def make(f, c, s):
        rows = []
        for m in p["models"]:
            try:
                rows.append((*cell_row(study, c, s, m, f, p["trees"]), "ok", None))
            except Exception as exc:  # noqa: BLE001 - the row says so
                rows.append((c, "|".join(study.combos[c]), None, None, s, m if f == "concat" else f"KF_{m}", None, None, None, None,
                             "failed", str(exc)[:1000]))
        return spark.createDataFrame(rows, SWEEP_SCHEMA).coalesce(1)

    done = {k for k, v in store.states().items() if v[0] == "ok"}
    for u in units:
        if keys[u] not in done:
            if stop_after is not None and made >= stop_after:
                break
            made += 1
            store.fill(keys[u], lambda u=u: make(*u))
    out = spark.createDataFrame([(c, None, None, None, None, None, None, None, None, None, "skipped", "unknown combination")
                                 for c in p["combos"] if c not in study.combos], SWEEP_SCHEMA)
    done = {k for k, v in store.states().items() if v[0] == "ok"}
    if ready := [f"{store.path}/entries/{keys[u]}" for u in units if keys[u] in done]:
        out = out.unionByName(spark.read.schema(SWEEP_SCHEMA).parquet(*ready))
    return out.orderBy(F.col("mean_spearman").desc_nulls_last(), "combination", "model", "selector")


def label_of(c: dict) -> str:
    return c.get("label") or f"{c['combo']}/{c['model']}/{c['selector']}/{c['preprocessing']}"


def _what(c: dict) -> list:
    return [c["combo"], c["model"], c["selector"], c["preprocessing"]]


def run_items(study: Study, configs: list[dict]) -> tuple[DataFrame, str]:
    """(item_id, y) that every known configuration of a run has, and a name of that set of items."""
    items = study.labels
    for combo, pre in sorted({(c["combo"], c["preprocessing"]) for c in configs if c["combo"] in study.combos}):
        items = items.join(study.items(combo, pre).select("item_id"), "item_id", "left_semi")
    items = cut_lineage(items)
    n, h1, h2 = items.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("item_id", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]).first()
    return items, key_of(n, str(h1), str(h2), study.k, study.seed)


def fold_predictions(study: Study, store: Store, configs: list[dict], trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """E5 input of one run: (fold, cfg_id, label, item_id, y, p), and (cfg_id, label, status, message).

    Every configuration is fitted per fold on the items that all of them have;
    equal configurations over equal items are fitted once per store.  One that
    fails has null predictions.
    """
    items, plan = run_items(study, configs)
    folded = cut_lineage(assign_folds(items, k=study.k, seed=study.seed))
    out, status = None, []
    for i, c in enumerate(configs):
        cfg, key = c.get("cfg_id", i + 1), key_of("folds", plan, trees, _what(c))
        state, message = store.fill(key, lambda c=c: fit_predict(
            study.folded_design(c["combo"], c["selector"], c["preprocessing"], folded, plan), c["model"], trees=trees))
        status.append((cfg, label_of(c), state, message))
        p = store.read(key).select("fold", "item_id", "y", F.col("pred").alias("p")) if state == "ok" \
            else folded.select(F.col("fold"), "item_id", "y", F.lit(None).cast("double").alias("p"))
        p = p.select("fold", F.lit(cfg).cast("bigint").alias("cfg_id"), F.lit(label_of(c)).alias("label"), "item_id", "y", "p")
        out = p if out is None else out.unionByName(p)
    return out, store.spark.createDataFrame(status, "cfg_id bigint, label string, status string, message string")


def ensemble_cv_runs(study: Study, store: Store, runs: dict[int, list[dict]], trees: int = 100) -> DataFrame:
    """(run_id, config, metric, mean, std, min, max) of every run; a failed configuration predicts zeros."""
    out = None
    for run_id, configs in runs.items():
        preds, _ = fold_predictions(study, store, configs, trees)
        part = ens.ensemble_cv(cut_lineage(preds), on_error="zero").withColumn("run_id", F.lit(run_id).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out.select("run_id", "config", "metric", "mean", "std", "min", "max")


def full_predictions(study: Study, store: Store, configs: list[dict], trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """(item_id, score) fused over the configurations that fit, and (cfg_id, label, status, message, train_rho, n_train).

    Without any such configuration the scores are an empty table.
    """
    spark, parts, status = store.spark, [], []
    for i, c in enumerate(configs):
        cfg, key = c.get("cfg_id", i + 1), key_of("full", trees, _what(c))
        state, message = store.fill(key, lambda c=c: fit_predict(
            study.full_design(c["combo"], c["selector"], c["preprocessing"]), c["model"], trees=trees, roles=("train", "test")))
        rho = n = None
        if state == "ok":
            p = store.read(key)
            train = p.where("role = 'train'").withColumn("_k", F.lit(1))
            rho = spearman(train, ["_k"], "pred", "y").first()["spearman"]
            n = train.count()
            parts.append(p.where("role = 'test'").select(F.lit(cfg).cast("bigint").alias("cfg_id"), "item_id", F.col("pred").alias("p")))
        status.append((cfg, label_of(c), state, message, rho, n))
    table = spark.createDataFrame(status, "cfg_id bigint, label string, status string, message string, train_rho double, n_train bigint")
    item = study.vecs.schema["item_id"].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"item_id {item}, score double"), table
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    return ens.ensemble_predict(preds).select("item_id", F.col("fused").alias("score")), table

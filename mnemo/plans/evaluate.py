"""E1 evaluate_concat / E2 evaluate_kernel building blocks.

`evaluate_scored` is E1 with deterministic, train-fitted scorers, so the
whole cross-validation (fold plan, per-fold selection statistics, scaling,
scoring, per-fold Spearman, fold summary) is one Spark SQL plan:

* ``rho_sign``: mean over the combination's features of sign(rho_train) * z
* ``mean_z``:   mean of z
with z standardised by training-fold moments (M1) and rho the training-fold
Spearman of the feature (A5).  Spark ML learners plug into the same fold
tables in `mnemo.plans.learners`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import features_string
from ..operators.analysis import fold_stats
from ..operators.ranks import label_ranks, ranked_rho, spearman
from ..operators.scaling import all_fold_stats, fold_moments, scale_of
from ..session import cut_lineage, more_partitions
from ..sources.tables import spread
from .aligned import aligned_items, make_plans

TASK_CELLS = 500_000   # values that one task ranks, whatever the data
SCORERS = ["rho_sign", "mean_z"]
SCORED_SCHEMA = ("combination string, features string, n_features bigint, n_samples bigint, selector string, "
                 "model string, mean_spearman double, std_spearman double, min_spearman double, max_spearman double")


def combo_of_set(combos: dict[str, list[str]]):
    """feature_set -> array of combinations that contain it (literal map)."""
    inv: dict[str, list[str]] = {}
    for name, sets in combos.items():
        for s in sets:
            inv.setdefault(s, []).append(name)
    kv = []
    for s, names in inv.items():
        kv += [F.lit(s), F.array(*[F.lit(n) for n in names])]
    return F.create_map(*kv)


def evaluate_scored(long_dev: DataFrame, folded: DataFrame, combos: dict[str, list[str]],
                    widths: dict[str, int], k: int = 5) -> DataFrame:
    """Sweep-result rows (D8) for every combination x scorer; all items have all sets."""
    return _scored_rows(long_dev, folded.withColumn("plan", F.lit("all")), combos, dict.fromkeys(combos, "all"), widths, k)


def evaluate_aligned(vecs: DataFrame, labels: DataFrame, combos: dict[str, list[str]], widths: dict[str, int],
                     k: int = 5) -> DataFrame:
    """E1 from the sets as they are: every combination is aligned (J1, J2, P6), folded and scored on the items it has.

    vecs: (item_id, feature_set, values) of the labelled split; labels: (item_id, y).
    A combination without items gives no row.
    """
    plans = make_plans(vecs, labels, combos, list(widths), complete=True, k=k)
    combos = {c: combos[c] for c in plans.of}
    if not combos:
        return vecs.sparkSession.createDataFrame([], SCORED_SCHEMA)
    short = {p: str(i) for i, p in enumerate(dict.fromkeys(plans.of.values()))}  # names are part of every key
    plan_of = {c: short[p] for c, p in plans.of.items()}
    read_by, of_plan = _readers(combos, plan_of)
    cells = sum(plans.n_samples[c] * widths[s] for c, s in {(p, s) for c, p in plans.of.items() for s in combos[c]})
    tasks = max(cells // TASK_CELLS + 1, 2 * vecs.sparkSession.sparkContext.defaultParallelism)
    with more_partitions(vecs.sparkSession, tasks):
        members = plans.members.withColumn("plan", F.element_at(F.create_map(*[F.lit(x) for kv in short.items() for x in kv]), F.col("plan")))
        folds = range(1, k + 1)
        ranks = [f"r{f}" for f in folds]
        members = label_ranks(members, folds, ("plan",))
        # a repeated item counts in the statistics as often as all its rows of the plan together
        again = members.groupBy("plan", "item_id").agg(F.count(F.lit(1)).cast("int").alias("again"))
        keyed = members.join(again, ["plan", "item_id"]).withColumn("feature_set", F.explode(F.element_at(of_plan, F.col("plan"))))
        # an item with a missing value is in no plan of that set, so its row is never used
        rows = cut_lineage(vecs.select("item_id", "feature_set", "values").join(keyed, ["item_id", "feature_set"]).repartition(tasks))
        long_df = rows.select("plan", "fold", "feature_set", *ranks, F.explode(F.array_repeat("values", F.col("again"))).alias("values")).select(
            "plan", "fold", "feature_set", *ranks, F.posexplode("values").alias("idx", "value"))
        stats = ranked_rho(long_df, folds, ("plan",), tasks).join(fold_moments(long_df, folds, ("plan",)), ["fold", "plan", "feature_set", "idx"])
        # plans x folds x sets rows, each with what the positions of the set need
        stats = stats.groupBy("plan", "fold", "feature_set").agg(F.collect_list(F.struct(
            "idx", "mean", scale_of(F.col("sd")).alias("scale"), F.signum("rho").alias("w"))).alias("at"))
        zs = F.transform(F.filter(F.array_sort("at"), lambda a: a["idx"] < F.size("values")), lambda a: F.struct(
            a["w"].alias("w"), ((F.get("values", a["idx"]) - a["mean"]) / a["scale"]).alias("z")))
        scored = rows.join(F.broadcast(stats), ["plan", "fold", "feature_set"]).withColumn("zs", zs).where(F.size("zs") > 0)

        def total(of):
            return F.aggregate("zs", F.lit(0.0), lambda acc, c: acc + F.coalesce(of(c), F.lit(0.0)))
        by_set = scored.select("plan", "fold", "item_id", "y", "feature_set", total(lambda c: c["w"] * c["z"]).alias("signed"),
                               total(lambda c: c["z"]).alias("plain"), F.size("zs").cast("bigint").alias("n"))
        return _summary(by_set, read_by, combos, widths)


def _readers(combos: dict[str, list[str]], plan_of: dict[str, str]):
    """Columns: the combinations that read a (plan, feature_set), and the map plan -> the sets that its combinations read."""
    readers: dict[tuple[str, str], list[str]] = {}
    for c, sets in combos.items():
        for s in sets:
            readers.setdefault((plan_of[c], s), []).append(c)
    table = F.create_map(*[x for (p, s), cs in readers.items() for x in (F.lit(f"{p}/{s}"), F.array(*map(F.lit, cs)))])
    of_plan = F.create_map(*[x for p in set(plan_of.values()) for x in (F.lit(p), F.array(*[F.lit(s) for q, s in readers if q == p]))])
    return F.element_at(table, F.concat_ws("/", "plan", "feature_set")), of_plan


def _scored_rows(long_df: DataFrame, members: DataFrame, combos: dict[str, list[str]], plan_of: dict[str, str],
                 widths: dict[str, int], k: int) -> DataFrame:
    """Sweep-result rows; members: (plan, item_id, y, fold), plan_of: combination -> plan."""
    if not combos:
        return long_df.sparkSession.createDataFrame([], SCORED_SCHEMA)
    read_by, of_plan = _readers(combos, plan_of)

    # a plan meets only the sets that its combinations read
    keyed = members.withColumn("feature_set", F.explode(F.element_at(of_plan, F.col("plan"))))
    rows = long_df.join(keyed.select("plan", "item_id", "y", "fold", "feature_set"), ["item_id", "feature_set"])
    stats = all_fold_stats(rows.select("plan", "item_id", "feature_set", "idx", "value"), members, k, ("plan",))
    z = (rows.join(stats, ["plan", "fold", "feature_set", "idx"])
             .withColumn("z", (F.col("value") - F.col("mean")) / scale_of(F.col("sd")))
             .withColumn("w", F.signum("rho")))
    # one row per (fold, item, set) before the combinations multiply them
    by_set = z.groupBy("plan", "fold", "item_id", "y", "feature_set").agg(
        F.sum(F.col("w") * F.col("z")).alias("signed"), F.sum("z").alias("plain"), F.count(F.lit(1)).alias("n"))
    return _summary(by_set, read_by, combos, widths)


def _summary(by_set: DataFrame, read_by: Column, combos: dict[str, list[str]], widths: dict[str, int]) -> DataFrame:
    """Sweep-result rows from sums (plan, fold, item_id, y, feature_set, signed, plain, n) of standardised values."""
    by_combo = (by_set.withColumn("combination", F.explode(read_by))
                .groupBy("fold", "combination", "item_id", "y")
                .agg((F.sum("signed") / F.sum("n")).alias("signed"), (F.sum("plain") / F.sum("n")).alias("plain")))
    scored = by_combo.select("fold", "combination", "item_id", "y", F.inline(F.array(
        F.struct(F.lit("rho_sign").alias("model"), F.col("signed").alias("pred")),
        F.struct(F.lit("mean_z").alias("model"), F.col("plain").alias("pred")))))
    scored = cut_lineage(scored)  # read for the label ranks, the correlation and the counts
    g = ["fold", "combination", "model"]
    per_fold = spearman(scored, g, "pred", "y").join(scored.groupBy(*g).agg(F.count(F.lit(1)).alias("n_test")), g)
    summary = fold_stats(per_fold, ["combination", "model"])
    n = per_fold.groupBy("combination", "model").agg(F.sum("n_test").alias("n_samples"))
    feats = F.create_map(*sum([[F.lit(c), features_string(F.array(*[F.lit(s) for s in sets]))]
                               for c, sets in combos.items()], []))
    nfeat = F.create_map(*sum([[F.lit(c), F.lit(sum(widths[s] for s in sets))]
                               for c, sets in combos.items()], []))
    return (summary.join(n, ["combination", "model"])
                   .select("combination", F.element_at(feats, F.col("combination")).alias("features"),
                           F.element_at(nfeat, F.col("combination")).cast("bigint").alias("n_features"),
                           F.col("n_samples").cast("bigint"), F.lit("none").alias("selector"), "model",
                           "mean_spearman", "std_spearman", "min_spearman", "max_spearman"))


# --- E1 / E2 with Spark ML learners, E8, E3 ---------------------------------------

from ..operators import kernels as K  # noqa: E402
from ..operators.folds import explode_roles  # noqa: E402
from ..operators.ranks import _select_top, role_rho  # noqa: E402
from .kernel_ridge import kernel_ridge_predict  # noqa: E402
from .learners import fit_predict, pca_project, scale_arrays, written_design  # noqa: E402


def role_rows(long_df: DataFrame, folded: DataFrame, k: int = 5) -> DataFrame:
    """(fold, role, item_id, y, feature_set, idx, value): every labelled row
    once per CV fold, as 'test' in its own fold and 'train' elsewhere."""
    roles = explode_roles(folded.select("item_id", "y", "fold"), k).select(
        F.col("cv_fold").alias("fold"), "role", "item_id", "y")
    return long_df.join(roles, "item_id")


@dataclass
class FoldedVectors:
    """Items with the vectors of their sets, one row per item; the copies for the CV folds are made where a design is.

    items: (item_id, y, own, parts ARRAY<STRUCT<feature_set, values>>); an item is 'test' in its own fold and 'train'
    in the others of `folds`.  An item that comes more than once has all its copies in `parts`.
    """

    items: DataFrame
    folds: tuple[int, ...]
    _rho: dict = field(default_factory=dict)

    def of(self, sets: list[str]) -> DataFrame:
        """The items that have any of `sets`, with the parts of these only."""
        return self.items.withColumn("parts", F.filter("parts", lambda p: p["feature_set"].isin(*sets))).where(F.size("parts") > 0)

    def rho(self, sets: list[str]) -> DataFrame:
        """(fold, feature_set, idx, rho) over the training rows; made once for the selectors that read it."""
        if tuple(sets) not in self._rho:
            ranked = label_ranks(self.of(sets).withColumnRenamed("own", "fold"), self.folds)
            ranks = [f"r{f}" for f in self.folds]
            rows = ranked.select("fold", *ranks, F.inline("parts")).select(
                "fold", *ranks, "feature_set", F.posexplode("values").alias("idx", "value"))
            self._rho[tuple(sets)] = cut_lineage(ranked_rho(rows.withColumn("idx", F.col("idx").cast("bigint")), self.folds))
        return self._rho[tuple(sets)]


def folded_vectors(vecs: DataFrame, folded: DataFrame, folds: tuple[int, ...]) -> FoldedVectors:
    """vecs: (item_id, feature_set, values); folded: (item_id, y, fold)."""
    held = vecs.where(F.size("values") > 0).select("item_id", "feature_set", "values")
    items = held.join(folded.select("item_id", "y", F.col("fold").alias("own")), "item_id").groupBy("item_id", "y", "own").agg(
        F.collect_list(F.struct("feature_set", "values")).alias("parts"))
    return FoldedVectors(spread(cut_lineage(items)), tuple(folds))


def _in_folds(items: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """(fold, role) instead of `own`: every item once per fold."""
    own, fold = F.col("own"), F.col("fold")
    return items.withColumn("fold", F.explode(F.array(*[F.lit(f).cast("bigint") for f in folds]))).withColumn(
        "role", F.when(own == fold, "test").otherwise("train")).drop("own")


def assemble_vectors(rows: FoldedVectors, sets: list[str], selector: str) -> DataFrame:
    """(fold, role, item_id, y, features): `assemble` of whole or (Spearman) selected vectors, without a shuffle of values."""
    def place(p: Column) -> Column:
        return F.array_position(F.array(*[F.lit(s) for s in sets]), p["feature_set"])

    items, out = rows.of(sets), ("fold", "role", "item_id", "y", "features")
    if selector.startswith("spearman_"):
        picks: dict[int, list[tuple[int, int]]] = {}  # folds x n places
        for r in _select_top(rows.rho(sets), ["fold"], int(selector.split("_")[1]), sets).collect():
            picks.setdefault(r["fold"], []).append((sets.index(r["feature_set"]), r["idx"]))

        def taken(f: int) -> Column:
            # a place is taken from every copy that has it; one copy is the rule
            return F.flatten(F.transform(F.array(*[F.struct(F.lit(o + 1).alias("o"), F.lit(i).alias("i")) for o, i in sorted(picks[f])]),
                                         lambda q: F.array_sort(F.transform(F.filter(
                                             "parts", lambda p: (place(p) == q["o"]) & (F.size(p["values"]) > q["i"])),
                                             lambda p: F.get(p["values"], q["i"])))))
        copies = F.array(*[F.struct(F.lit(f).cast("bigint").alias("fold"), F.when(F.col("own") == f, "test").otherwise("train").alias("role"),
                                    taken(f).alias("features")) for f in sorted(picks)])
        return (items.select("item_id", "y", F.inline(copies)) if picks else _in_folds(items, ()).withColumn(
            "features", F.array().cast("array<double>"))).where(F.size("features") > 0).select(*out)
    names = F.transform("parts", lambda p: p["feature_set"])
    once = F.size(F.array_distinct(names)) == F.size(names)
    whole = F.flatten(F.transform(F.array_sort(F.transform("parts", lambda p: F.struct(place(p).alias("o"), p["values"].alias("values")))),
                                  lambda p: p["values"]))
    cells = F.flatten(F.transform("parts", lambda p: F.transform(p["values"], lambda x, i: F.struct(
        place(p).alias("o"), i.alias("i"), x.alias("value")))))
    mixed = F.transform(F.array_sort(cells), lambda c: c["value"])
    return _in_folds(items.withColumn("features", F.when(once, whole).otherwise(mixed)).drop("parts"), rows.folds).select(*out)


def full_rows(long_all: DataFrame, labels: DataFrame, train_split: str = "dev",
              predict_split: str = "test") -> DataFrame:
    """Fit on the whole labelled split, predict the other: one pseudo-fold 0."""
    tr = long_all.where(F.col("split") == train_split).join(labels, "item_id").withColumn("role", F.lit("train"))
    te = long_all.where(F.col("split") == predict_split).withColumn("y", F.lit(None).cast("double")) \
        .withColumn("role", F.lit("test"))
    return tr.unionByName(te).drop("split").withColumn("fold", F.lit(0).cast("bigint"))


def _select_rows(rows: DataFrame, sets: list[str], selector: str, n_train_rows: DataFrame | None) -> DataFrame:
    """Spearman selection fitted on the train rows of each fold."""
    if not selector.startswith("spearman_"):
        return rows
    n = int(selector.split("_")[1])
    rho = role_rho(rows)
    sel = _select_top(rho, ["fold"], n, sets)
    return rows.join(sel.select("fold", "feature_set", "idx"), ["fold", "feature_set", "idx"], "left_semi")


def assemble(rows: DataFrame, sets: list[str]) -> DataFrame:
    """Concatenate the (selected) positions of every set, in set then idx
    order, into `features`.  A group is one item's vector (bounded)."""
    order = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("feature_set"))
    return rows.withColumn("_o", order).groupBy("fold", "role", "item_id", "y").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "idx", "value"))), lambda s: s["value"])
         .alias("features"))


def concat_design(rows: DataFrame | FoldedVectors, sets: list[str], selector: str) -> DataFrame:
    """select (fold-fitted) -> [PCA] -> scale: the model input of E1."""
    if isinstance(rows, FoldedVectors):
        x = assemble_vectors(rows, sets, selector)
    else:
        rows = rows.where(F.col("feature_set").isin(*sets))
        x = assemble(_select_rows(rows, sets, selector, None), sets)
    if selector.startswith("pca_"):
        x = pca_project(x, int(selector.split("_")[1]))
    return scale_arrays(x, ["fold"])


def kernel_vectors(rows: DataFrame | FoldedVectors, sets: list[str], selector: str) -> tuple[DataFrame, DataFrame]:
    """K4, first half: per set select -> [PCA] -> scale, and the median gamma of its training rows.
    -> (fold, role, item_id, y, feature_set, vec), (fold, feature_set, gamma)."""
    vecs = []
    for s in sets:
        x = concat_design(rows, [s], selector).withColumn("feature_set", F.lit(s))
        vecs.append(x.withColumnRenamed("features", "vec"))
    allv = vecs[0]
    for v in vecs[1:]:
        allv = allv.unionByName(v)
    # the per-set vectors feed the bandwidth and the kernel jobs: lineage cut once
    allv = cut_lineage(allv)
    return allv, K.median_gamma(allv.where(F.col("role") == "train"), ["fold", "feature_set"])


def fused_kernel(rows: DataFrame | FoldedVectors, sets: list[str], selector: str,
                 weights: dict[str, float] | None = None, whole: bool = False) -> DataFrame:
    """K4 as model columns: kernel rows against the fold's landmarks or, with `whole`, all its training rows; weighted
    sum (K3).  -> (fold, role, item_id, y, k)."""
    allv, g = kernel_vectors(rows, sets, selector)
    w, train = weights or {s: 1.0 for s in sets}, allv.where(F.col("role") == "train")
    n = max(train.count(), 1) if whole else K.N_LANDMARKS
    return K.fused_kernel_rows(allv, train, g, ["fold"], w, keep=["role", "y"], n_landmarks=n)


def fused_kernel_sums(rows: DataFrame | FoldedVectors, sets: list[str], selector: str,
                      weights: dict[str, float] | None = None) -> DataFrame:
    """K4 over all training rows of the fold: row sums and width of the fused kernel.
    -> (fold, role, item_id, y, total, n)."""
    allv, g = kernel_vectors(rows, sets, selector)
    w = weights or {s: 1.0 for s in sets}
    train = F.col("role") == "train"
    return K.fused_kernel_sums(allv, allv.where(train), g, ["fold"], w, keep=["role", "y"], among=train)


def kernel_design(rows: DataFrame | FoldedVectors, sets: list[str], selector: str,
                  weights: dict[str, float] | None = None, whole: bool = False) -> DataFrame:
    """E2 model input: the fused kernel row, scaled again (K5); `whole` as in `fused_kernel`."""
    fused = fused_kernel(rows, sets, selector, weights, whole).withColumnRenamed("k", "features")
    return scale_arrays(fused, ["fold"])


def score_folds(pred: DataFrame) -> DataFrame:
    """A5 per fold: Spearman(y, pred) on the test rows."""
    return spearman(pred, ["fold"], "pred", "y")


def item_count(rows: DataFrame | FoldedVectors) -> int:
    return (rows.items if isinstance(rows, FoldedVectors) else rows).select("item_id").distinct().count()


def evaluate_model(spark, rows: DataFrame | FoldedVectors, combo: str, sets: list[str], widths: dict[str, int],
                   selector: str, model: str, fusion: str = "concat", trees: int = 100,
                   shared: dict | None = None) -> DataFrame:
    """E1 (fusion='concat') / E2 ('kernel'): one sweep-result row (D8).  The cells of a sweep with one combination,
    selector and fusion pass one `shared`: the first writes the design, the others read it."""
    shared = {} if shared is None else shared
    if "design" not in shared:
        shared["design"] = written_design(concat_design(rows, sets, selector) if fusion == "concat" else kernel_design(rows, sets, selector))
    design = shared["design"]
    pred = fit_predict(design, model, trees=trees)
    stats = fold_stats(score_folds(pred).withColumn("_k", F.lit(1)), ["_k"])
    n = shared.get("n") or item_count(rows)
    return stats.select(
        F.lit(combo).alias("combination"), F.lit("|".join(sets)).alias("features"),
        F.lit(sum(widths[s] for s in sets)).cast("bigint").alias("n_features"),
        F.lit(n).cast("bigint").alias("n_samples"), F.lit(selector).alias("selector"),
        F.lit(model if fusion == "concat" else f"KF_{model}").alias("model"),
        "mean_spearman", "std_spearman", "min_spearman", "max_spearman")


SWEEP_SCHEMA = ("combination string, features string, n_features bigint, n_samples bigint, selector string, "
                "model string, mean_spearman double, std_spearman double, min_spearman double, max_spearman double, "
                "status string, message string")


def sweep(spark, rows: DataFrame | FoldedVectors, combos: dict[str, list[str]], widths: dict[str, int],
          models: list[str], selectors: list[str], fusion: str = "both",
          done: DataFrame | None = None, results_path: str | None = None,
          threads: int = 2, trees: int = 100) -> DataFrame:
    """Every (combination x selector x model x fusion) cell not yet in
    `done` (J4), evaluated as concurrent Spark jobs.

    Every cell gives one row: status `ok` with its scores, or `failed` with
    the error's text and null scores.  With `results_path` a cell is appended
    as soon as it ends, so a stopped sweep resumes with that table as `done`;
    failed cells are tried again.  The models of one (combination, selector,
    fusion) share its design, which is written once.
    """
    from concurrent.futures import ThreadPoolExecutor
    fusions = ["kernel", "concat"] if fusion == "both" else [fusion]
    tasks = [(f, c, m, s) for f in fusions for c in combos for m in models for s in selectors]
    if done is not None:
        ok = done.where("status = 'ok'") if "status" in done.columns else done
        have = {(r["combination"], r["model"], r["selector"]) for r in
                ok.select("combination", "model", "selector").collect()}
        tasks = [t for t in tasks if (t[1], t[2] if t[0] == "concat" else f"KF_{t[2]}", t[3]) not in have]

    n = item_count(rows) if tasks else 0
    groups: dict[tuple[str, str, str], list[str]] = {}
    for f, c, m, s in tasks:
        groups.setdefault((f, c, s), []).append(m)

    def run(group):
        (f, c, s), names = group
        shared, cells = {"n": n}, []
        for m in names:
            try:
                cell = [(*r, "ok", None) for r in evaluate_model(spark, rows, c, combos[c], widths, s, m, f, trees, shared).collect()]
            except Exception as exc:  # noqa: BLE001 - the row says so
                cell = [(c, "|".join(combos[c]), None, None, s, m if f == "concat" else f"KF_{m}", None, None, None, None,
                         "failed", str(exc)[:1000])]
            if results_path:
                spark.createDataFrame(cell, SWEEP_SCHEMA).write.mode("append").parquet(results_path)
            cells += cell
        return cells

    with ThreadPoolExecutor(max_workers=threads) as ex:
        rows_out = [r for part in ex.map(run, groups.items()) for r in part]
    return spark.createDataFrame(rows_out, SWEEP_SCHEMA).orderBy(F.col("mean_spearman").desc_nulls_last())


def kernel_predict(spark, long_all: DataFrame, labels: DataFrame, sets: list[str], selector: str,
                   model: str, weights: dict[str, float] | None = None, trees: int = 100) -> DataFrame:
    """Kernel fusion fitted on the whole labelled split, predictions for
    the other split.  -> (item_id, pred).

    The model input is the kernel row against every training row.  Ridge is
    solved without writing it; the other models read it as columns, whose
    number and disk grow with the square of the training rows.
    """
    rows = full_rows(long_all, labels)
    if model == "Ridge":
        vecs, g = kernel_vectors(rows, sets, selector)
        return kernel_ridge_predict(vecs, g, weights or {s: 1.0 for s in sets}).select("item_id", "pred")
    design = kernel_design(rows, sets, selector, weights, whole=True)
    return fit_predict(design, model, trees=trees).select("item_id", "pred")


def predict_configs(spark, long_all: DataFrame, labels: DataFrame, configs: list[dict],
                    combos: dict[str, list[str]], trees: int = 100) -> DataFrame:
    """E6 inputs: every config fitted on the labelled split and applied to the other.

    -> (cfg_id, item_id, p, status, message).  A config that fails gives one
    row with status `failed`, the error's text and null item and prediction;
    fusion leaves it out because its prediction is null.
    """
    rows = full_rows(long_all, labels)
    item = rows.schema["item_id"].dataType.simpleString()
    schema = f"cfg_id bigint, item_id {item}, p double, status string, message string"
    out = spark.createDataFrame([], schema)
    for c in configs:
        try:
            sets = combos[c["combo"]]
            d = concat_design(rows, sets, c["selector"]) if c["preprocessing"] == "concat" \
                else kernel_design(rows, sets, c["selector"])
            part = fit_predict(d, c["model"], trees=trees).select(
                F.lit(c["cfg_id"]).cast("bigint").alias("cfg_id"), "item_id", F.col("pred").alias("p"),
                F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message"))
        except Exception as exc:  # noqa: BLE001 - the row says so
            part = spark.createDataFrame([(c["cfg_id"], None, None, "failed", str(exc)[:1000])], schema)
        out = out.unionByName(part)
    return out

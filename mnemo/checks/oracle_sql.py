"""DuckDB SQL for every SQL-checkable registered query.

Written independently of the Spark code from the operator definitions; the
driver runs these on the same parquet tables and compares results.
Conventions: doubles rounded to 6 places (+ 0.0 folds -0.0), counts and
positions BIGINT, NULLs filtered or ordered explicitly.
"""

# --- binding CTEs -----------------------------------------------------------

EMB = """emb AS (
  SELECT vec_id AS item_id,
         CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'dev' END AS split,
         label / 9.0 AS y, embedding
  FROM embeddings)"""

VEC = """vec AS (
  SELECT split, item_id, 'emb_a' AS feature_set, 1 AS set_ord, list_slice(embedding, 1, 16) AS v FROM emb
  UNION ALL SELECT split, item_id, 'emb_b', 2, list_slice(embedding, 17, 32) FROM emb
  UNION ALL SELECT split, item_id, 'emb_c', 3,
         list_concat(list_slice(embedding, 33, 48), [0, 0, 0, 0, 0, 0, 0, 0]::FLOAT[]) FROM emb
  UNION ALL SELECT split, item_id, 'emb_d', 4, list_slice(embedding, 49, 60) FROM emb)"""

LNG = """lng0 AS (
  SELECT split, item_id, feature_set, set_ord,
         unnest(generate_series(0, len(v) - 1)) AS idx, unnest(v) AS v0
  FROM vec),
lng AS (
  SELECT split, item_id, feature_set, set_ord, CAST(idx AS BIGINT) AS idx,
         CASE WHEN v0 IS NULL OR isnan(v0) OR isinf(v0) THEN 0.0 ELSE CAST(v0 AS DOUBLE) END AS value
  FROM lng0)"""

FOLDS = """folds AS (
  SELECT item_id, y,
         CAST(ntile(5) OVER (ORDER BY md5(CAST(item_id AS VARCHAR) || ':42')) AS BIGINT) AS fold
  FROM emb WHERE split = 'dev')"""

TRAIN = """train AS (
  SELECT f.item_id, f.y, k.range AS tf FROM folds f JOIN range(1, 6) k ON f.fold <> k.range)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RHO_FOLD = """yr AS (
  SELECT item_id, tf, (rank() OVER w + count(*) OVER w) / 2.0 AS ry
  FROM train WINDOW w AS (PARTITION BY tf ORDER BY y)),
fr AS (
  SELECT t.tf, l.feature_set, l.set_ord, l.idx, l.item_id,
         (rank() OVER w + count(*) OVER w) / 2.0 AS rv
  FROM lng l JOIN train t USING (item_id)
  WHERE l.split = 'dev'
  WINDOW w AS (PARTITION BY t.tf, l.feature_set, l.idx ORDER BY l.value)),
rho AS (
  SELECT tf, feature_set, set_ord, idx,
         CASE WHEN min(rv) = max(rv) OR min(ry) = max(ry) THEN 0.0
              ELSE covar_pop(rv, ry) / (stddev_pop(rv) * stddev_pop(ry)) END AS rho
  FROM fr JOIN yr USING (item_id, tf)
  GROUP BY tf, feature_set, set_ord, idx)"""

SQL = {}

SQL["top_n_spearman"] = with_(EMB, VEC, LNG, FOLDS, TRAIN, RHO_FOLD) + """
SELECT fold, feature_set, idx, rho, sel_rank FROM (
  SELECT tf AS fold, feature_set, idx, round(rho, 6) + 0.0 AS rho,
         row_number() OVER (PARTITION BY tf ORDER BY round(abs(rho), 9) DESC, set_ord, idx) AS sel_rank
  FROM rho) WHERE sel_rank <= 30"""

# --- prediction tables (E4-E7, W1, F7, A5-A7, P7) ----------------------------

CFG = """cfg AS (
  SELECT * FROM (VALUES
    (1, 'emb_a', 'LinearRegression', 'none', 'concat', NULL),
    (2, 'emb_b', 'Ridge', 'spearman_30', 'kernel', 'coarse'),
    (3, 'emb_c', 'GradientBoosting', 'pca_50', 'concat', '')
  ) t(cfg_id, combo, model, selector, preprocessing, cfg_label))"""

CVP = """cvp AS (
  SELECT f.fold, CAST(c.cfg_id AS BIGINT) AS cfg_id,
         coalesce(nullif(c.cfg_label, ''), concat_ws('/', c.combo, c.model, c.selector, c.preprocessing)) AS label,
         f.item_id, f.y,
         CASE c.cfg_id WHEN 1 THEN CAST(e.embedding[1] AS DOUBLE)
                       WHEN 2 THEN round(CAST(e.embedding[2] AS DOUBLE), 1) END AS p
  FROM folds f JOIN emb e USING (item_id) CROSS JOIN cfg c),
cvz AS (SELECT fold, cfg_id, label, item_id, y, coalesce(p, 0.0) AS p FROM cvp)"""

TSP = """tsp AS (
  SELECT CAST(c.cfg_id AS BIGINT) AS cfg_id, e.item_id,
         CASE c.cfg_id WHEN 1 THEN CAST(e.embedding[1] AS DOUBLE)
                       WHEN 2 THEN round(CAST(e.embedding[2] AS DOUBLE), 1) END AS p
  FROM emb e CROSS JOIN cfg c WHERE e.split = 'test')"""

AVG_RANK = "CAST(rank() OVER {w} + count(*) OVER {w} AS DOUBLE) / 2"

SQL["average_rank"] = with_(EMB, FOLDS, CFG, CVP) + """
SELECT fold, cfg_id, item_id, round(""" + AVG_RANK.format(w="w") + """, 6) + 0.0 AS avg_rank
FROM cvz WINDOW w AS (PARTITION BY fold, cfg_id ORDER BY p)"""

SQL["normalised_rank"] = with_(EMB, FOLDS, CFG, CVP) + """
SELECT fold, cfg_id, item_id,
       round(""" + AVG_RANK.format(w="w") + """ / count(*) OVER (PARTITION BY fold, cfg_id), 6) + 0.0 AS norm_rank
FROM cvz WINDOW w AS (PARTITION BY fold, cfg_id ORDER BY p)"""

PAIR_RANKS = """rk AS (
  SELECT *, """ + AVG_RANK.format(w="wy") + """ AS ry, """ + AVG_RANK.format(w="wp") + """ AS rp
  FROM {src}
  WINDOW wy AS (PARTITION BY {g} ORDER BY y), wp AS (PARTITION BY {g} ORDER BY {p}))"""

GUARDED = """CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN 0.0
            ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"""

METRICS = """met AS (
  SELECT fold, cfg_id, label,
         """ + GUARDED.format(a="ry", b="rp") + """ AS spearman,
         """ + GUARDED.format(a="y", b="p") + """ AS pearson,
         avg((y - p) * (y - p)) AS mse
  FROM rk GROUP BY fold, cfg_id, label)"""

SQL["spearman"] = with_(EMB, FOLDS, CFG, CVP, PAIR_RANKS.format(src="cvz", g="fold, cfg_id", p="p"),
                        METRICS) + """
SELECT fold, cfg_id, round(spearman, 6) + 0.0 AS spearman FROM met"""

SQL["safe_pearson"] = with_(EMB, FOLDS, CFG, CVP, PAIR_RANKS.format(src="cvz", g="fold, cfg_id", p="p"),
                            METRICS) + """
SELECT fold, cfg_id, round(pearson, 6) + 0.0 AS pearson FROM met"""

SQL["mse"] = with_(EMB, FOLDS, CFG, CVP, PAIR_RANKS.format(src="cvz", g="fold, cfg_id", p="p"),
                   METRICS) + """
SELECT fold, cfg_id, round(mse, 6) + 0.0 AS mse FROM met"""

FUSED = """nr AS (
  SELECT fold, cfg_id, item_id, y,
         """ + AVG_RANK.format(w="w") + """ / count(*) OVER (PARTITION BY fold, cfg_id) AS nr
  FROM cvz WINDOW w AS (PARTITION BY fold, cfg_id ORDER BY p)),
fused AS (
  SELECT fold, item_id, y, round(avg(nr), 9) AS fused FROM nr GROUP BY fold, item_id, y
  HAVING count(DISTINCT cfg_id) = (SELECT count(DISTINCT cfg_id) FROM cvz))"""

SQL["fuse_rank_average"] = with_(EMB, FOLDS, CFG, CVP, FUSED) + """
SELECT fold, item_id, round(fused, 6) + 0.0 AS fused FROM fused"""

SQL["ensemble_cv"] = with_(EMB, FOLDS, CFG, CVP, PAIR_RANKS.format(src="cvz", g="fold, cfg_id", p="p"),
                           METRICS, FUSED) + """,
frk AS (
  SELECT *, """ + AVG_RANK.format(w="wy") + """ AS ry, """ + AVG_RANK.format(w="wp") + """ AS rp
  FROM fused WINDOW wy AS (PARTITION BY fold ORDER BY y), wp AS (PARTITION BY fold ORDER BY fused)),
fmet AS (
  SELECT fold, 'Ensemble (rank average)' AS label,
         """ + GUARDED.format(a="ry", b="rp") + """ AS spearman,
         """ + GUARDED.format(a="y", b="fused") + """ AS pearson,
         avg((y - fused) * (y - fused)) AS mse
  FROM frk GROUP BY fold),
allm AS (SELECT fold, label, spearman, pearson, mse FROM met UNION ALL SELECT * FROM fmet),
lm AS (
  SELECT label AS config, 'spearman' AS metric, spearman AS v FROM allm
  UNION ALL SELECT label, 'pearson', pearson FROM allm
  UNION ALL SELECT label, 'mse', mse FROM allm)
SELECT config, metric, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std,
       round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max
FROM lm GROUP BY config, metric"""

SQL["ensemble_predict"] = with_(EMB, CFG, TSP) + """,
ok AS (SELECT * FROM tsp WHERE p IS NOT NULL),
nr AS (
  SELECT cfg_id, item_id, """ + AVG_RANK.format(w="w") + """ / count(*) OVER (PARTITION BY cfg_id) AS nr
  FROM ok WINDOW w AS (PARTITION BY cfg_id ORDER BY p))
SELECT item_id, round(round(avg(nr), 9), 6) + 0.0 AS score FROM nr GROUP BY item_id
HAVING count(DISTINCT cfg_id) = (SELECT count(DISTINCT cfg_id) FROM ok)"""

SQL["batch_ensembles"] = with_(EMB, CFG, TSP) + """,
runs AS (SELECT CAST(r AS BIGINT) AS run_id, CAST(c AS BIGINT) AS cfg_id
         FROM (VALUES (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2)) t(r, c)),
ok AS (SELECT * FROM tsp WHERE p IS NOT NULL),
nr AS (
  SELECT cfg_id, item_id, """ + AVG_RANK.format(w="w") + """ / count(*) OVER (PARTITION BY cfg_id) AS nr
  FROM ok WINDOW w AS (PARTITION BY cfg_id ORDER BY p)),
used AS (SELECT run_id, cfg_id FROM runs WHERE cfg_id IN (SELECT cfg_id FROM ok)),
need AS (SELECT run_id, count(DISTINCT cfg_id) AS k FROM used GROUP BY run_id)
SELECT u.run_id, n.item_id, round(round(avg(n.nr), 9), 6) + 0.0 AS score
FROM nr n JOIN used u USING (cfg_id) JOIN need USING (run_id)
GROUP BY u.run_id, n.item_id, need.k HAVING count(DISTINCT n.cfg_id) = need.k"""

SQL["config_label"] = with_(EMB, FOLDS, CFG, CVP) + """
SELECT DISTINCT cfg_id, label FROM cvp"""


# --- E1 evaluate_concat with deterministic scorers, and result analysis ------

COMBOS = """combos AS (SELECT * FROM (VALUES
    ('emb_a', 'emb_a'),
    ('emb_b', 'emb_b'),
    ('emb_c', 'emb_c'),
    ('emb_d', 'emb_d'),
    ('emb_a+emb_b', 'emb_a'),
    ('emb_a+emb_b', 'emb_b'),
    ('emb_a+emb_c', 'emb_a'),
    ('emb_a+emb_c', 'emb_c'),
    ('emb_a+emb_d', 'emb_a'),
    ('emb_a+emb_d', 'emb_d'),
    ('emb_b+emb_c', 'emb_b'),
    ('emb_b+emb_c', 'emb_c'),
    ('emb_b+emb_d', 'emb_b'),
    ('emb_b+emb_d', 'emb_d'),
    ('emb_c+emb_d', 'emb_c'),
    ('emb_c+emb_d', 'emb_d'),
    ('emb_a+emb_b+emb_c', 'emb_a'),
    ('emb_a+emb_b+emb_c', 'emb_b'),
    ('emb_a+emb_b+emb_c', 'emb_c'),
    ('emb_a+emb_b+emb_d', 'emb_a'),
    ('emb_a+emb_b+emb_d', 'emb_b'),
    ('emb_a+emb_b+emb_d', 'emb_d'),
    ('emb_a+emb_c+emb_d', 'emb_a'),
    ('emb_a+emb_c+emb_d', 'emb_c'),
    ('emb_a+emb_c+emb_d', 'emb_d'),
    ('emb_b+emb_c+emb_d', 'emb_b'),
    ('emb_b+emb_c+emb_d', 'emb_c'),
    ('emb_b+emb_c+emb_d', 'emb_d'),
    ('emb_a+emb_b+emb_c+emb_d', 'emb_a'),
    ('emb_a+emb_b+emb_c+emb_d', 'emb_b'),
    ('emb_a+emb_b+emb_c+emb_d', 'emb_c'),
    ('emb_a+emb_b+emb_c+emb_d', 'emb_d')
  ) t(combination, feature_set)),
cmeta AS (SELECT * FROM (VALUES
    ('emb_a', 'emb_a', 16),
    ('emb_b', 'emb_b', 16),
    ('emb_c', 'emb_c', 24),
    ('emb_d', 'emb_d', 12),
    ('emb_a+emb_b', 'emb_a|emb_b', 32),
    ('emb_a+emb_c', 'emb_a|emb_c', 40),
    ('emb_a+emb_d', 'emb_a|emb_d', 28),
    ('emb_b+emb_c', 'emb_b|emb_c', 40),
    ('emb_b+emb_d', 'emb_b|emb_d', 28),
    ('emb_c+emb_d', 'emb_c|emb_d', 36),
    ('emb_a+emb_b+emb_c', 'emb_a|emb_b|emb_c', 56),
    ('emb_a+emb_b+emb_d', 'emb_a|emb_b|emb_d', 44),
    ('emb_a+emb_c+emb_d', 'emb_a|emb_c|emb_d', 52),
    ('emb_b+emb_c+emb_d', 'emb_b|emb_c|emb_d', 52),
    ('emb_a+emb_b+emb_c+emb_d', 'emb_a|emb_b|emb_c|emb_d', 68)
  ) t(combination, features, n_features))"""

RES = """yr AS (
  SELECT item_id, tf, """ + AVG_RANK.format(w="w") + """ AS ry
  FROM train WINDOW w AS (PARTITION BY tf ORDER BY y)),
fr AS (
  SELECT t.tf, l.feature_set, l.idx, l.item_id, l.value,
         """ + AVG_RANK.format(w="w") + """ AS rv
  FROM lng l JOIN train t USING (item_id)
  WHERE l.split = 'dev'
  WINDOW w AS (PARTITION BY t.tf, l.feature_set, l.idx ORDER BY l.value)),
st AS (
  SELECT tf AS fold, feature_set, idx, """ + GUARDED.format(a="rv", b="ry") + """ AS rho,
         avg(value) AS mean, stddev_pop(value) AS sd
  FROM fr JOIN yr USING (item_id, tf) GROUP BY tf, feature_set, idx),
zt AS (
  SELECT f.fold, f.item_id, f.y, c.combination,
         (l.value - s.mean) / CASE WHEN s.sd IS NULL OR s.sd < 2.220446049250313e-15 THEN 1.0 ELSE s.sd END AS z,
         sign(s.rho) AS w
  FROM lng l JOIN folds f USING (item_id)
  JOIN st s ON s.fold = f.fold AND s.feature_set = l.feature_set AND s.idx = l.idx
  JOIN combos c ON c.feature_set = l.feature_set
  WHERE l.split = 'dev'),
sc AS (
  SELECT fold, combination, 'rho_sign' AS model, item_id, y, avg(w * z) AS pred
  FROM zt GROUP BY fold, combination, item_id, y
  UNION ALL
  SELECT fold, combination, 'mean_z' AS model, item_id, y, avg(z) AS pred
  FROM zt GROUP BY fold, combination, item_id, y),
srk AS (
  SELECT *, """ + AVG_RANK.format(w="wy") + """ AS ry, """ + AVG_RANK.format(w="wp") + """ AS rp
  FROM sc WINDOW wy AS (PARTITION BY fold, combination, model ORDER BY y),
                 wp AS (PARTITION BY fold, combination, model ORDER BY pred)),
pf AS (
  SELECT fold, combination, model, """ + GUARDED.format(a="ry", b="rp") + """ AS spearman,
         count(*) AS n_test
  FROM srk GROUP BY fold, combination, model),
res AS (
  SELECT p.combination, m.features, CAST(m.n_features AS BIGINT) AS n_features,
         CAST(sum(p.n_test) AS BIGINT) AS n_samples, 'none' AS selector, p.model,
         round(avg(p.spearman), 4) AS mean_spearman, round(stddev_pop(p.spearman), 4) AS std_spearman,
         round(min(p.spearman), 4) AS min_spearman, round(max(p.spearman), 4) AS max_spearman
  FROM pf p JOIN cmeta m USING (combination)
  GROUP BY p.combination, m.features, m.n_features, p.model)"""

RES_ALL = (EMB, VEC, LNG, FOLDS, TRAIN, COMBOS, RES)

SQL["evaluate_concat"] = with_(*RES_ALL) + "SELECT * FROM res"

# items that lack sets (hash below 20) and values (below 30), aligned per combination
SPARSE = """ph AS (
  SELECT e.item_id, e.y, s.feature_set, substr(md5(CAST(e.item_id AS VARCHAR) || ':' || s.feature_set), 1, 2) AS h
  FROM emb e CROSS JOIN (SELECT DISTINCT feature_set FROM combos) s WHERE e.split = 'dev'),
al AS (
  SELECT f.fusion, c.combination, p.item_id, p.y
  FROM ph p JOIN combos c USING (feature_set) CROSS JOIN (VALUES ('concat', '30'), ('kernel', '20')) f(fusion, least)
  GROUP BY f.fusion, c.combination, p.item_id, p.y, f.least HAVING min(p.h) >= f.least),
af AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY fusion, combination ORDER BY md5(CAST(item_id AS VARCHAR) || ':42')) AS BIGINT) AS fold
  FROM al)"""

SQL["aligned_folds"] = with_(EMB, COMBOS, SPARSE) + "SELECT fusion, combination, item_id, fold FROM af"

SQL["evaluate_aligned"] = with_(EMB, VEC, LNG, COMBOS, SPARSE) + """,
m AS (SELECT combination, item_id, y, fold FROM af WHERE fusion = 'concat'),
tr AS (SELECT m.combination, m.item_id, m.y, k.range AS tf FROM m JOIN range(1, 6) k ON m.fold <> k.range),
yr AS (SELECT combination, item_id, tf, """ + AVG_RANK.format(w="w") + """ AS ry FROM tr WINDOW w AS (PARTITION BY combination, tf ORDER BY y)),
fr AS (
  SELECT t.combination, t.tf, l.feature_set, l.idx, l.item_id, l.value, """ + AVG_RANK.format(w="w") + """ AS rv
  FROM lng l JOIN combos c USING (feature_set) JOIN tr t ON t.item_id = l.item_id AND t.combination = c.combination
  WHERE l.split = 'dev' WINDOW w AS (PARTITION BY t.combination, t.tf, l.feature_set, l.idx ORDER BY l.value)),
st AS (
  SELECT combination, tf AS fold, feature_set, idx, """ + GUARDED.format(a="rv", b="ry") + """ AS rho, avg(value) AS mean, stddev_pop(value) AS sd
  FROM fr JOIN yr USING (combination, item_id, tf) GROUP BY combination, tf, feature_set, idx),
zt AS (
  SELECT m.fold, m.item_id, m.y, m.combination, sign(s.rho) AS w,
         (l.value - s.mean) / CASE WHEN s.sd IS NULL OR s.sd < 2.220446049250313e-15 THEN 1.0 ELSE s.sd END AS z
  FROM lng l JOIN m USING (item_id)
  JOIN st s ON s.combination = m.combination AND s.fold = m.fold AND s.feature_set = l.feature_set AND s.idx = l.idx
  WHERE l.split = 'dev'),
""" + RES[RES.index("sc AS ("):] + """
SELECT * FROM res"""

SQL["overall_stats"] = with_(*RES_ALL) + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(mean_spearman), 6) + 0.0 AS mean,
       round(stddev_pop(mean_spearman), 6) + 0.0 AS std FROM res"""

MARKERS = """mk AS (SELECT * FROM (VALUES
    ('emb_a', ['emb_a'], false), ('emb_b', ['emb_b'], false),
    ('emb_a&emb_b', ['emb_a', 'emb_b'], true), ('emb_c', ['emb_c'], false),
    ('emb_d', ['emb_d'], false), ('emb_c|emb_d', ['emb_c', 'emb_d'], false)
  ) t(feature, markers, require_all)),
marked AS (
  SELECT r.*, mk.feature, mk.require_all,
         CASE WHEN mk.require_all
              THEN len(list_filter(mk.markers, lambda m: list_contains(string_split(r.features, '|'), m))) = len(mk.markers)
              ELSE len(list_filter(mk.markers, lambda m: list_contains(string_split(r.features, '|'), m))) > 0
         END AS "with"
  FROM res r CROSS JOIN mk),
ww AS (
  SELECT feature, CASE WHEN require_all THEN 'AND' ELSE 'OR' END AS logic,
         count(*) FILTER (WHERE NOT "with") AS n_without,
         avg(mean_spearman) FILTER (WHERE NOT "with") AS mean_without,
         stddev_pop(mean_spearman) FILTER (WHERE NOT "with") AS std_without,
         var_samp(mean_spearman) FILTER (WHERE NOT "with") AS v0,
         count(*) FILTER (WHERE "with") AS n_with,
         avg(mean_spearman) FILTER (WHERE "with") AS mean_with,
         stddev_pop(mean_spearman) FILTER (WHERE "with") AS std_with,
         var_samp(mean_spearman) FILTER (WHERE "with") AS v1
  FROM marked GROUP BY feature, require_all)"""

SQL["with_without"] = with_(*RES_ALL, MARKERS) + """
SELECT feature, logic, CAST(n_without AS BIGINT) AS n_without,
       round(mean_without, 6) + 0.0 AS mean_without, round(std_without, 6) + 0.0 AS std_without,
       CAST(n_with AS BIGINT) AS n_with, round(mean_with, 6) + 0.0 AS mean_with,
       round(std_with, 6) + 0.0 AS std_with, round(mean_with - mean_without, 6) + 0.0 AS diff
FROM ww"""

# Two-sided p of Student's t by Simpson's rule on cos^(df-1) over
# [atan(|t|/sqrt(df)), pi/2] divided by the same over [0, pi/2].
SIMPSON = """(list_sum(list_transform(range(0, 2001), lambda i:
      (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
      * pow(cos({lo} + i * ((pi() / 2 - {lo}) / 2000)), {df} - 1.0))) * ((pi() / 2 - {lo}) / 2000) / 3.0)"""

WELCH = """tt AS (
  SELECT feature, (mean_with - mean_without) / sqrt(v1 / n_with + v0 / n_without) AS t,
         (v1 / n_with + v0 / n_without) * (v1 / n_with + v0 / n_without)
           / ((v1 / n_with) * (v1 / n_with) / (n_with - 1) + (v0 / n_without) * (v0 / n_without) / (n_without - 1)) AS df
  FROM ww),
tp AS (
  SELECT feature, t, df,
         greatest(least(""" + SIMPSON.format(lo="atan(abs(t) / sqrt(df))", df="df") + " / " + \
    SIMPSON.format(lo="0.0", df="df") + """, 1.0), 0.0) AS p
  FROM tt)"""

SQL["welch_t"] = with_(*RES_ALL, MARKERS, WELCH) + """
SELECT feature, round(t, 6) + 0.0 AS t, round(df, 6) + 0.0 AS df, round(p, 6) + 0.0 AS p,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '** ' WHEN p < 0.05 THEN '*  ' ELSE 'n.s' END AS sig
FROM tp"""

SQL["has_markers"] = with_(*RES_ALL, MARKERS) + """
SELECT combination, model, feature, "with" FROM marked"""

SQL["leaderboard"] = with_(*RES_ALL) + """
SELECT combination, model, selector, n_features, mean_spearman, std_spearman
FROM res ORDER BY mean_spearman DESC, model, selector, combination LIMIT 10"""

SQL["best_per_combination"] = with_(*RES_ALL) + """
SELECT combination, model, selector, mean_spearman FROM (
  SELECT *, row_number() OVER (PARTITION BY combination ORDER BY mean_spearman DESC, model, selector) AS rn
  FROM res) WHERE rn = 1"""

SQL["combo_shape"] = with_(EMB, VEC, LNG, COMBOS) + """
SELECT c.combination, CAST(count(DISTINCT (l.feature_set, l.idx)) AS BIGINT) AS n_features,
       CAST(count(DISTINCT l.item_id) AS BIGINT) AS n_samples
FROM lng l JOIN combos c USING (feature_set) WHERE l.split = 'dev' GROUP BY c.combination"""

# --- text family -------------------------------------------------------------

CLEAN = """lower(trim(regexp_replace(regexp_replace(regexp_replace({t},
    '\\[[^\\n]*?\\]', ' ', 'g'), '[^a-zA-Z \\t\\n\\x0b\\f\\r]', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))"""
WSTOK = "list_filter(string_split_regex({t}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"
ALPHA = "regexp_extract_all(lower({t}), '(\\p{{L}}+)', 1)"
LENSUM = "coalesce(list_sum(list_transform({w}, lambda x: length(x))), 0)"

SQL["clean_text"] = "SELECT doc_id, " + CLEAN.format(t="text") + " AS clean FROM documents"

SQL["tokenize_ws"] = """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(""" + LENSUM.format(w="w") + """ AS BIGINT) AS n_chars
FROM (SELECT doc_id, """ + WSTOK.format(t=CLEAN.format(t="text")) + """ AS w FROM documents)"""

SQL["tokenize_alpha"] = """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(""" + LENSUM.format(w="w") + """ AS BIGINT) AS n_chars
FROM (SELECT doc_id, """ + ALPHA.format(t="text") + """ AS w FROM documents)"""

SQL["is_empty_text"] = """SELECT conv_id, turn, (text IS NULL OR regexp_matches(text, '^[ \\t\\n\\x0b\\f\\r]*$')) AS empty
FROM conversations"""

SQL["count_syllables"] = """SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(
    list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> ''),
    lambda w: greatest(1, len(regexp_extract_all(w, '([aeiou]+)', 1))))), 0) AS BIGINT) AS syllables
FROM conversations"""

VOCAB = """vocab AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT unnest(""" + ALPHA.format(t="text") + """) AS word FROM documents) GROUP BY word)"""

SQL["word_frequency"] = with_(VOCAB) + "SELECT word, n FROM vocab"

SQL["union_vocab"] = """SELECT word, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(""" + ALPHA.format(t="text") + """) AS word FROM (
    SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark))
GROUP BY word"""

SQL["language_complexity"] = """SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count,
  CAST(len(list_distinct(w)) AS BIGINT) AS vocab_size,
  CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) + 0.0 ELSE 'NaN'::DOUBLE END AS unique_word_ratio,
  CASE WHEN len(w) > 0 THEN round(""" + LENSUM.format(w="w") + """ / len(w), 6) + 0.0 ELSE 'NaN'::DOUBLE END AS avg_word_length
FROM (SELECT doc_id, """ + WSTOK.format(t=CLEAN.format(t="text")) + """ AS w FROM documents)"""

ELEX = """elex AS (SELECT * FROM (VALUES
  ('the', 'joy'), ('the', 'positive'), ('and', 'trust'), ('and', 'positive'),
  ('of', 'anger'), ('of', 'negative'), ('to', 'anticipation'), ('in', 'sadness'), ('in', 'negative'),
  ('is', 'surprise'), ('that', 'disgust'), ('that', 'negative'), ('it', 'fear'), ('was', 'sadness'),
  ('for', 'trust'), ('with', 'joy'), ('with', 'trust'), ('as', 'anger'), ('de', 'fear'), ('de', 'negative'),
  ('la', 'joy'), ('der', 'anger'), ('le', 'sadness'), ('el', 'surprise'), ('el', 'positive'),
  ('und', 'anticipation'), ('und', 'positive')) t(word, emotion)),
dtok AS (SELECT doc_id, unnest(""" + WSTOK.format(t=CLEAN.format(t="text")) + """) AS word FROM documents),
hits AS (SELECT doc_id, emotion, count(*) AS h FROM dtok JOIN elex USING (word) GROUP BY doc_id, emotion),
tot AS (SELECT doc_id, sum(h) AS t FROM hits GROUP BY doc_id),
esc AS (
  SELECT d.doc_id""" + "".join(
    f""",
    coalesce((SELECT h FROM hits WHERE hits.doc_id = d.doc_id AND emotion = '{e}'), 0)
      / coalesce((SELECT t FROM tot WHERE tot.doc_id = d.doc_id), 1) AS {e}_score"""
    for e in ["joy", "anger", "fear", "sadness", "positive", "negative", "anticipation", "disgust",
              "surprise", "trust"]) + """
  FROM documents d),
dom AS (
  SELECT *, joy_score + anger_score + fear_score + sadness_score AS emotion_intensity,
         CASE WHEN joy_score + anger_score + fear_score + sadness_score <= 0 THEN 'none'
              WHEN joy_score = greatest(joy_score, anger_score, fear_score, sadness_score) THEN 'joy'
              WHEN anger_score = greatest(joy_score, anger_score, fear_score, sadness_score) THEN 'anger'
              WHEN fear_score = greatest(joy_score, anger_score, fear_score, sadness_score) THEN 'fear'
              ELSE 'sadness' END AS dominant_emotion
  FROM esc)"""

EMO10 = ["joy", "anger", "fear", "sadness", "positive", "negative", "anticipation", "disgust",
         "surprise", "trust"]

SQL["lexicon_join"] = with_(ELEX) + "SELECT doc_id, emotion, CAST(h AS BIGINT) AS hits FROM hits"

SQL["emotion_scores"] = with_(ELEX) + "SELECT doc_id, " + ", ".join(
    f"round({e}_score, 6) + 0.0 AS {e}_score" for e in EMO10) + " FROM esc"

SQL["dominant_emotion"] = with_(ELEX) + """SELECT doc_id, dominant_emotion,
  round(emotion_intensity, 6) + 0.0 AS emotion_intensity,
  CAST(dominant_emotion = 'joy' AS BIGINT) AS dom_joy, CAST(dominant_emotion = 'anger' AS BIGINT) AS dom_anger,
  CAST(dominant_emotion = 'fear' AS BIGINT) AS dom_fear, CAST(dominant_emotion = 'sadness' AS BIGINT) AS dom_sadness
FROM dom"""

SQL["emotion_features"] = with_(ELEX) + """, lc AS (
  SELECT doc_id, len(w) AS word_count, len(list_distinct(w)) AS vocab_size,
    CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 'NaN'::DOUBLE END AS unique_word_ratio,
    CASE WHEN len(w) > 0 THEN """ + LENSUM.format(w="w") + """ / len(w) ELSE 'NaN'::DOUBLE END AS avg_word_length
  FROM (SELECT doc_id, """ + WSTOK.format(t=CLEAN.format(t="text")) + """ AS w FROM documents))
SELECT doc_id, dominant_emotion, """ + ", ".join(f"round({e}_score, 6) + 0.0 AS {e}_score" for e in EMO10) + """,
  CAST(word_count AS DOUBLE) AS word_count, CAST(vocab_size AS DOUBLE) AS vocab_size,
  round(unique_word_ratio, 6) + 0.0 AS unique_word_ratio, round(avg_word_length, 6) + 0.0 AS avg_word_length,
  round(emotion_intensity, 6) + 0.0 AS emotion_intensity,
  CAST(dominant_emotion = 'joy' AS DOUBLE) AS dom_joy, CAST(dominant_emotion = 'anger' AS DOUBLE) AS dom_anger,
  CAST(dominant_emotion = 'fear' AS DOUBLE) AS dom_fear, CAST(dominant_emotion = 'sadness' AS DOUBLE) AS dom_sadness
FROM dom JOIN lc USING (doc_id)"""

SQL["incremental_emotion"] = SQL["emotion_features"]

SEM = """plex AS (SELECT * FROM (VALUES
  ('is', 'VERB'), ('was', 'VERB'), ('are', 'VERB'), ('be', 'VERB'), ('have', 'VERB'),
  ('est', 'VERB'), ('ist', 'VERB'), ('es', 'VERB'),
  ('de', 'NOUN'), ('la', 'NOUN'), ('der', 'NOUN'), ('le', 'NOUN'), ('time', 'NOUN'),
  ('that', 'ADJ'), ('this', 'ADJ'), ('new', 'ADJ'), ('good', 'ADJ')) t(word, pos)),
dw AS (SELECT doc_id, """ + ALPHA.format(t="text") + """ AS w,
              len(regexp_extract_all(text, '([^.!?]+[.!?]*)', 1)) AS ns FROM documents),
tk AS (SELECT doc_id, unnest(w) AS word FROM dw),
pc AS (SELECT doc_id, count(*) FILTER (WHERE pos = 'NOUN') AS nn, count(*) FILTER (WHERE pos = 'VERB') AS nv,
              count(*) FILTER (WHERE pos = 'ADJ') AS na FROM tk JOIN plex USING (word) GROUP BY doc_id),
vtot AS (SELECT sum(n) AS total FROM vocab),
rr AS (SELECT tk.doc_id, -avg(ln(coalesce(v.n, 1) / (SELECT total FROM vtot))) AS rarity
       FROM tk LEFT JOIN vocab v USING (word) GROUP BY tk.doc_id),
sem AS (
  SELECT dw.doc_id, len(w) AS nw,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(pc.nn, 0) / len(w) END AS noun_ratio,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(pc.nv, 0) / len(w) END AS verb_ratio,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(pc.na, 0) / len(w) END AS adj_ratio,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END AS lexical_diversity,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE """ + LENSUM.format(w="w") + """ / len(w) END AS avg_word_length,
    CASE WHEN len(w) = 0 OR ns = 0 THEN 0.0 ELSE len(w) / ns END AS avg_sentence_length,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE rr.rarity END AS rarity
  FROM dw LEFT JOIN pc USING (doc_id) LEFT JOIN rr USING (doc_id))"""

SEMC = ["noun_ratio", "verb_ratio", "adj_ratio", "lexical_diversity", "avg_word_length",
        "avg_sentence_length", "rarity"]


def _sem(cols):
    return with_(VOCAB, SEM) + "SELECT doc_id, " + ", ".join(
        f"round({c}, 6) + 0.0 AS {c}" for c in cols) + " FROM sem"


SQL["semantic_features"] = _sem(SEMC)
SQL["pos_ratios"] = _sem(SEMC[:3])
SQL["lexical_diversity"] = _sem(SEMC[3:5])
SQL["avg_sentence_length"] = _sem(["avg_sentence_length"])
SQL["rarity"] = _sem(["rarity"])

SQL["freq_lookup"] = with_(VOCAB) + """, ct AS (
  SELECT conv_id, unnest(""" + ALPHA.format(t="text") + """) AS word FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_words,
       CAST(count(*) FILTER (WHERE v.n IS NULL) AS BIGINT) AS n_unseen,
       round(sum(ln(coalesce(v.n, 1))), 6) + 0.0 AS sum_ln_n
FROM ct LEFT JOIN vocab v USING (word) GROUP BY conv_id"""

# --- audio / time-series family -----------------------------------------------

FR = """fr AS (
  SELECT user_id AS clip_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
         value AS rms, 80.0 + value AS f0, event_type IN ('view', 'click', 'purchase') AS voiced
  FROM events),
fp AS (SELECT * FROM fr WHERE frame * 512 < 120 * 16000)"""

FT = "(CAST({x} AS DOUBLE) * 512.0 / 16000.0)"
TOPDB = "0.03162277660168379"


def r6(x, alias):
    return f"round({x}, 6) + 0.0 AS {alias}"


SQL["clip_prefix"] = with_(FR) + "SELECT clip_id, CAST(count(*) AS BIGINT) AS n_frames FROM fp GROUP BY clip_id"

SQL["frame_rms"] = with_(FR) + """,
sm AS (SELECT clip_id, frame AS pos, (rms - 50.0) / 1000.0 AS amp FROM fr),
nf AS (SELECT clip_id, CAST(floor((max(pos) + 1) / 4) + 1 AS BIGINT) AS n FROM sm GROUP BY clip_id),
fk AS (SELECT clip_id, unnest(range(0, n)) AS frame FROM nf)
SELECT fk.clip_id, CAST(fk.frame AS BIGINT) AS frame, round(sqrt(sum(sm.amp * sm.amp) / 16), 6) + 0.0 AS rms
FROM fk JOIN sm ON sm.clip_id = fk.clip_id AND sm.pos >= fk.frame * 4 - 8 AND sm.pos < fk.frame * 4 + 8
GROUP BY fk.clip_id, fk.frame"""

SQL["peak_db"] = with_(FR) + """,
sm AS (SELECT clip_id, (rms - 50.0) / 1000.0 AS amp FROM fr)
SELECT clip_id, CASE WHEN max(abs(amp)) > 0 THEN round(20 * log10(max(abs(amp))), 6) + 0.0
                     ELSE '-Infinity'::DOUBLE END AS peak_db
FROM sm GROUP BY clip_id"""

ENERGY = """SELECT {k}, avg(rms) AS energy_mean, var_pop(rms) AS energy_var, stddev_pop(rms) AS energy_std,
       max(rms) - min(rms) AS energy_range FROM {src} GROUP BY {k}"""
PITCH = """SELECT {k}, coalesce(avg(f0) FILTER (WHERE voiced), 0.0) AS pitch_mean,
       coalesce(var_pop(f0) FILTER (WHERE voiced), 0.0) AS pitch_var,
       coalesce(stddev_pop(f0) FILTER (WHERE voiced), 0.0) AS pitch_std,
       coalesce(max(f0) FILTER (WHERE voiced) - min(f0) FILTER (WHERE voiced), 0.0) AS pitch_range
FROM {src} GROUP BY {k}"""
VELO = """vd_{n} AS (
  SELECT {k}, (f0 - lag(f0) OVER w) / """ + FT.format(x="frame - lag(frame) OVER w") + """ AS v
  FROM {src} WHERE voiced WINDOW w AS (PARTITION BY {k} ORDER BY frame)),
vel_{n} AS (
  SELECT g.*, coalesce(a.vm, 0.0) AS pitch_vel_mean, coalesce(a.vv, 0.0) AS pitch_vel_var
  FROM (SELECT DISTINCT {k} FROM {src}) g
  LEFT JOIN (SELECT {k}, avg(abs(v)) AS vm, var_pop(v) AS vv FROM vd_{n} WHERE v IS NOT NULL GROUP BY {k}) a
  USING ({k}))"""
PAUSE = """mx_{n} AS (SELECT {k}, max(rms) AS mx FROM {src} GROUP BY {k}),
act_{n} AS (
  SELECT s.{k0}, s.frame, s.frame - row_number() OVER (PARTITION BY {sk} ORDER BY s.frame) AS isl
  FROM {src} s JOIN mx_{n} m USING ({k}) WHERE m.mx <= 0 OR s.rms > m.mx * """ + TOPDB + """),
isl_{n} AS (SELECT {k}, min(frame) AS start, max(frame) AS "end" FROM act_{n} GROUP BY {k}, isl),
gap_{n} AS (
  SELECT {k}, start, """ + FT.format(x='lead(start) OVER (PARTITION BY {k} ORDER BY start) - "end" - 1') + """ AS gap
  FROM isl_{n}),
pv_{n} AS (
  SELECT g.*, coalesce(a.pv, 0.0) AS pause_var
  FROM (SELECT DISTINCT {k} FROM {src}) g
  LEFT JOIN (SELECT {k}, var_pop(gap) AS pv FROM gap_{n} WHERE gap IS NOT NULL GROUP BY {k}) a USING ({k}))"""


def _ck(n, src, k="clip_id", k0="clip_id", sk="s.clip_id"):
    return dict(n=n, src=src, k=k, k0=k0, sk=sk)


SQL["energy_stats"] = with_(FR) + "SELECT clip_id, " + ", ".join(
    r6(c, c) for c in ["energy_mean", "energy_var", "energy_std", "energy_range"]) + \
    " FROM (" + ENERGY.format(k="clip_id", src="fr") + ")"

SQL["pitch_stats"] = with_(FR) + "SELECT clip_id, " + ", ".join(
    r6(c, c) for c in ["pitch_mean", "pitch_var", "pitch_std", "pitch_range"]) + \
    " FROM (" + PITCH.format(k="clip_id", src="fr") + ")"

SQL["velocity"] = with_(FR, VELO.format(**_ck("g", "fp"))) + \
    "SELECT clip_id, " + r6("pitch_vel_mean", "pitch_vel_mean") + ", " + r6("pitch_vel_var", "pitch_vel_var") + \
    " FROM vel_g"

SQL["active_islands"] = with_(FR, PAUSE.format(**_ck("g", "fp"))) + \
    'SELECT clip_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM isl_g'

SQL["gap"] = with_(FR, PAUSE.format(**_ck("g", "fp"))) + \
    "SELECT clip_id, CAST(start AS BIGINT) AS start, " + r6("gap", "gap") + " FROM gap_g WHERE gap IS NOT NULL"

SQL["pause_variance"] = with_(FR, PAUSE.format(**_ck("g", "fp"))) + \
    "SELECT clip_id, " + r6("pause_var", "pause_var") + " FROM pv_g"

SEGS = """dur AS (SELECT clip_id, """ + FT.format(x="max(frame) + 1") + """ AS T FROM fr GROUP BY clip_id),
sg0 AS (
  SELECT f.*, """ + FT.format(x="f.frame") + """ AS t, d.T,
         d.T >= 3 * 60.0 AS lng,
         CASE WHEN d.T >= 3 * 60.0 THEN 60.0 ELSE d.T / 3.0 END AS l0,
         CASE WHEN d.T >= 3 * 60.0 THEN d.T / 2.0 - 60.0 / 2.0 ELSE d.T / 3.0 END AS s1,
         CASE WHEN d.T >= 3 * 60.0 THEN d.T - 60.0 ELSE 2.0 * (d.T / 3.0) END AS s2
  FROM fr f JOIN dur d USING (clip_id)),
sg AS (
  SELECT clip_id, frame, rms, f0, voiced,
         CASE WHEN t >= 0.0 AND t < 0.0 + l0 THEN 0 WHEN t >= s1 AND t < s1 + l0 THEN 1
              WHEN t >= s2 AND t < s2 + l0 THEN 2 END AS seg
  FROM sg0),
seg AS (SELECT clip_id, CAST(seg AS BIGINT) AS seg, frame, rms, f0, voiced FROM sg WHERE seg IS NOT NULL)"""

SQL["three_segments"] = with_(FR, SEGS) + """
SELECT clip_id, seg, CAST(count(*) AS BIGINT) AS n_frames, CAST(min(frame) AS BIGINT) AS first_frame,
       CAST(max(frame) AS BIGINT) AS last_frame FROM seg GROUP BY clip_id, seg"""

HALF = """hv AS (
  SELECT clip_id, f0, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS i,
         count(*) OVER (PARTITION BY clip_id) AS n
  FROM fp WHERE voiced),
ha AS (
  SELECT clip_id, coalesce(avg(f0) FILTER (WHERE i >= floor(n / 2)), 'NaN'::DOUBLE) AS b,
         coalesce(avg(f0) FILTER (WHERE i < floor(n / 2)), 'NaN'::DOUBLE) AS a FROM hv GROUP BY clip_id),
hs AS (
  SELECT g.clip_id, coalesce(ha.b - ha.a, 0.0) AS pitch_variation
  FROM (SELECT DISTINCT clip_id FROM fp) g LEFT JOIN ha USING (clip_id))"""

SQL["half_shift"] = with_(FR, HALF) + "SELECT clip_id, " + r6("pitch_variation", "pitch_variation") + " FROM hs"

ACT = """thr AS (SELECT clip_id, quantile_cont(rms, 0.35) AS threshold FROM fp GROUP BY clip_id),
ac AS (
  SELECT f.clip_id, t.threshold, avg(CAST(f.rms > t.threshold AS DOUBLE)) AS speech_ratio,
         sum(CAST(f.rms > t.threshold AS BIGINT)) AS active_frames,
         avg(f.rms * f.rms) FILTER (WHERE f.rms > t.threshold) AS sp,
         avg(f.rms * f.rms) FILTER (WHERE NOT (f.rms > t.threshold)) AS np
  FROM fp f JOIN thr t USING (clip_id) GROUP BY f.clip_id, t.threshold),
act AS (
  SELECT *, CASE WHEN np > 0 THEN 10 * log10(coalesce(sp, 'NaN'::DOUBLE) / np) ELSE 60.0 END AS snr_db FROM ac),
syl AS (
  SELECT conv_id AS clip_id, sum(coalesce(list_sum(list_transform(
    list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> ''),
    lambda w: greatest(1, len(regexp_extract_all(w, '([aeiou]+)', 1))))), 0)) AS syllables
  FROM conversations GROUP BY conv_id),
spk AS (
  SELECT a.clip_id,
         CASE WHEN s.syllables IS NOT NULL THEN CAST(s.syllables AS DOUBLE) ELSE 'NaN'::DOUBLE END AS syllable_count,
         CASE WHEN s.syllables IS NOT NULL AND """ + FT.format(x="a.active_frames") + """ > 0
              THEN s.syllables / """ + FT.format(x="a.active_frames") + """ ELSE 'NaN'::DOUBLE END AS speaking_rate
  FROM act a LEFT JOIN syl s USING (clip_id))"""

SQL["percentile_threshold"] = with_(FR, ACT) + "SELECT clip_id, " + r6("threshold", "threshold") + ", " + \
    r6("speech_ratio", "speech_ratio") + " FROM act"
SQL["snr_db"] = with_(FR, ACT) + "SELECT clip_id, " + r6("snr_db", "snr_db") + " FROM act"
SQL["speaking_rate"] = with_(FR, ACT) + "SELECT clip_id, " + r6("syllable_count", "syllable_count") + ", " + \
    r6("speaking_rate", "speaking_rate") + " FROM spk"
SQL["left_transcript"] = with_(FR, ACT) + """
SELECT g.clip_id, s.syllables IS NOT NULL AS has_transcript,
       CASE WHEN s.syllables IS NOT NULL THEN CAST(s.syllables AS DOUBLE) ELSE 'NaN'::DOUBLE END AS syllable_count
FROM (SELECT DISTINCT clip_id FROM fp) g LEFT JOIN syl s USING (clip_id)"""

SEGK = dict(n="s", src="seg", k="clip_id, seg", k0="clip_id, s.seg", sk="s.clip_id, s.seg")
SQL["audio_segment_features"] = with_(FR, SEGS, VELO.format(**SEGK), PAUSE.format(**SEGK)) + """,
pst AS (""" + PITCH.format(k="clip_id, seg", src="seg") + """),
est AS (""" + ENERGY.format(k="clip_id, seg", src="seg") + """)
SELECT clip_id, seg, """ + ", ".join(r6(f"coalesce({c}, 0)", c) for c in [
    "pitch_mean", "pitch_var", "pitch_range", "pitch_vel_mean", "pitch_vel_var",
    "energy_mean", "energy_var", "energy_range", "pause_var"]) + """
FROM (SELECT DISTINCT clip_id FROM fr) CROSS JOIN (VALUES (0), (1), (2)) t(seg)
LEFT JOIN pst USING (clip_id, seg) LEFT JOIN vel_s USING (clip_id, seg) LEFT JOIN est USING (clip_id, seg) LEFT JOIN pv_s USING (clip_id, seg)"""

SQL["audio_global_features"] = with_(FR, HALF, ACT) + """,
est AS (""" + ENERGY.format(k="clip_id", src="fp") + """),
pst AS (""" + PITCH.format(k="clip_id", src="fp") + """)
SELECT clip_id, """ + ", ".join([r6("energy_mean", "energy_mean"), r6("energy_std", "energy_std"),
                                 r6("pitch_mean", "pitch_mean_hz"), r6("pitch_std", "pitch_std_hz"),
                                 r6("pitch_variation", "pitch_variation"), r6("snr_db", "snr_db"),
                                 r6("speech_ratio", "speech_ratio"), r6("syllable_count", "syllable_count"),
                                 r6("speaking_rate", "speaking_rate")]) + """
FROM est JOIN pst USING (clip_id) JOIN hs USING (clip_id) JOIN act USING (clip_id) JOIN spk USING (clip_id)"""


# --- quality family ------------------------------------------------------------

QAV = """qv0 AS (
  SELECT split, item_id, embedding,
         CASE WHEN h < '0a' THEN 'nan0' WHEN h < '14' THEN 'inf1' WHEN h < '1e' THEN 'zero'
              WHEN h < '28' THEN 'short' WHEN h < '32' THEN 'nan78' WHEN h < '38' THEN 'allnan'
              ELSE 'none' END AS fault
  FROM (SELECT *, substr(md5(CAST(item_id AS VARCHAR) || ':qa'), 1, 2) AS h FROM emb)),
qk AS (SELECT * FROM (VALUES ('audio_c', 1, 27, 3, 9), ('audio_o', 28, 9, 1, 9),
                             ('semantic', 37, 7, 1, 7), ('emotion', 44, 19, 1, 19)) t(kind, st, nv, rws, cols)),
qv1 AS (
  SELECT q.split || '/' || k.kind AS dir, k.kind, q.item_id, q.fault, k.rws, k.cols, k.st, q.embedding,
         CASE WHEN q.fault = 'short' AND k.rws > 1 THEN k.nv - k.cols
              WHEN q.fault = 'short' THEN k.nv - 1 ELSE k.nv END AS m
  FROM qv0 q CROSS JOIN qk k),
qv AS (
  SELECT dir, kind, item_id,
         CASE WHEN rws > 1 THEN [CASE WHEN fault = 'short' THEN rws - 1 ELSE rws END, cols] ELSE [m] END AS shape,
         list_transform(list_slice(embedding, st, st + m - 1), lambda x, i:
           CASE WHEN fault = 'nan0' AND i = 1 THEN 'NaN'::DOUBLE
                WHEN fault = 'inf1' AND i = 2 THEN 'Infinity'::DOUBLE
                WHEN fault = 'zero' THEN 0.0::DOUBLE
                WHEN fault = 'nan78' AND i IN (8, 9) THEN 'NaN'::DOUBLE
                WHEN fault = 'allnan' THEN 'NaN'::DOUBLE
                ELSE CAST(x AS DOUBLE) END) AS vals
  FROM qv1),
qf AS (
  SELECT *,
    shape = CASE kind WHEN 'audio_c' THEN [3, 9] WHEN 'audio_o' THEN [9] WHEN 'semantic' THEN [7] ELSE [19] END AS shape_ok,
    len(vals) AS n,
    len(list_filter(vals, lambda x: isinf(x))) AS inf_n,
    len(list_filter(vals, lambda x: isnan(x))) AS nan_n,
    len(list_filter(list_transform(vals, lambda x, i: CASE WHEN isnan(x) AND (i - 1) NOT IN (7, 8) THEN i END),
                    lambda j: j IS NOT NULL)) AS bad_nan_n,
    len(list_filter(vals, lambda x: NOT isnan(x) AND NOT isinf(x))) > 0
      AND len(list_filter(vals, lambda x: NOT isnan(x) AND NOT isinf(x) AND x <> 0)) = 0 AS all_zero
  FROM qv),
qt AS (
  SELECT conv_id AS item_id, bool_and(text IS NULL OR regexp_matches(text, '^[ \\t\\n\\x0b\\f\\r]*$')) AS empty
  FROM conversations GROUP BY conv_id),
ql AS (
  SELECT user_id AS item_id,
         CASE WHEN max(abs(value / 100000.0)) > 0 THEN 20 * log10(max(abs(value / 100000.0)))
              ELSE '-Infinity'::DOUBLE END AS peak_db
  FROM events GROUP BY user_id),
qi AS (
  SELECT f.dir, f.kind, f.item_id,
    CASE WHEN NOT f.shape_ok THEN ['FAIL wrong shape']
         WHEN f.kind IN ('audio_c', 'audio_o') THEN list_filter([
           CASE WHEN f.inf_n > 0 THEN 'FAIL Inf' END,
           CASE WHEN f.kind = 'audio_o' THEN (CASE WHEN f.bad_nan_n > 0 THEN 'FAIL NaN at unexpected indices' END)
                WHEN f.nan_n = f.n THEN 'FAIL all NaN' WHEN f.nan_n > 0 THEN 'FAIL NaN' END,
           CASE WHEN f.all_zero THEN (CASE WHEN l.peak_db IS NULL THEN 'FAIL all-zero and could not determine audio level'
                                          WHEN l.peak_db < -50.0 THEN 'BENIGN silent audio'
                                          ELSE 'FAIL all-zero but audio not silent' END) END],
           lambda s: s IS NOT NULL)
         ELSE list_filter([
           CASE WHEN f.inf_n > 0 THEN 'FAIL Inf' END,
           CASE WHEN f.nan_n = f.n THEN 'FAIL all NaN'
                WHEN (f.nan_n > 0 OR f.all_zero) AND coalesce(t.empty, true) THEN 'BENIGN empty transcript'
                WHEN (f.nan_n > 0 OR f.all_zero) AND f.nan_n > 0 THEN 'FAIL NaN (transcript has content)' END,
           CASE WHEN f.nan_n <> f.n AND NOT coalesce(t.empty, true) AND f.all_zero
                THEN 'FAIL all-zero valid elements (transcript has content)' END],
           lambda s: s IS NOT NULL) END AS issues
  FROM qf f LEFT JOIN qt t USING (item_id) LEFT JOIN ql l USING (item_id)),
qlv AS (
  SELECT dir, item_id, issues,
         CASE WHEN len(list_filter(issues, lambda s: starts_with(s, 'FAIL'))) > 0 THEN 'FAIL'
              WHEN len(list_filter(issues, lambda s: starts_with(s, 'BENIGN'))) > 0 THEN 'BENIGN'
              ELSE 'ok' END AS level
  FROM qi),
qs AS (
  SELECT coalesce(dir, 'total') AS dir, CAST(count(*) AS BIGINT) AS files,
         CAST(sum(CASE WHEN level = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
         CAST(sum(CASE WHEN level = 'BENIGN' THEN 1 ELSE 0 END) AS BIGINT) AS warn,
         CAST(sum(CASE WHEN level = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS fail
  FROM qlv GROUP BY ROLLUP (dir))"""

QA_ALL = (EMB, QAV)
SQL["qa_shape"] = with_(*QA_ALL) + "SELECT dir, item_id, shape_ok FROM qf"
SQL["qa_inf"] = with_(*QA_ALL) + "SELECT dir, item_id, CAST(inf_n AS BIGINT) AS inf_n FROM qf"
SQL["qa_nan_positions"] = with_(*QA_ALL) + \
    "SELECT dir, item_id, CAST(bad_nan_n AS BIGINT) AS bad_nan_n FROM qf WHERE kind = 'audio_o'"
SQL["qa_nan_other"] = with_(*QA_ALL) + \
    "SELECT dir, item_id, CAST(nan_n AS BIGINT) AS nan_n, (nan_n = n AND n > 0) AS all_nan FROM qf WHERE kind = 'audio_c'"
SQL["qa_issues"] = with_(*QA_ALL) + "SELECT dir, item_id, unnest(issues) AS issue FROM qi"
SQL["qa_zero_audio"] = with_(*QA_ALL) + """SELECT * FROM (SELECT dir, item_id, unnest(issues) AS issue FROM qi)
WHERE (contains(issue, 'all-zero') OR contains(issue, 'silent'))
  AND NOT suffix(dir, 'semantic') AND NOT suffix(dir, 'emotion')"""
SQL["qa_text"] = with_(*QA_ALL) + """SELECT * FROM (SELECT dir, item_id, unnest(issues) AS issue FROM qi)
WHERE (suffix(dir, 'semantic') OR suffix(dir, 'emotion')) AND issue NOT IN ('FAIL Inf', 'FAIL wrong shape')"""
SQL["qa_level"] = with_(*QA_ALL) + "SELECT dir, item_id, level FROM qlv"
SQL["qa_summary"] = with_(*QA_ALL) + """SELECT dir, files, ok, warn, fail,
  CASE WHEN warn + fail = 0 THEN 'ok' WHEN fail > 0 THEN 'FAIL' ELSE 'warn' END AS status FROM qs"""
SQL["gated_publish"] = with_(*QA_ALL) + "SELECT fail AS fail_total, fail = 0 AS publish FROM qs WHERE dir = 'total'"

# --- folds, scaling, kernels -------------------------------------------------

SQL["kfold"] = with_(EMB, FOLDS) + "SELECT item_id, fold FROM folds"

SQL["top_n_full"] = with_(EMB, VEC, LNG) + """,
lab AS (SELECT item_id, y FROM emb WHERE split = 'dev'),
yr AS (SELECT item_id, """ + AVG_RANK.format(w="w") + """ AS ry FROM lab WINDOW w AS (ORDER BY y)),
fr AS (
  SELECT l.feature_set, l.set_ord, l.idx, l.item_id, """ + AVG_RANK.format(w="w") + """ AS rv
  FROM lng l WHERE l.split = 'dev' WINDOW w AS (PARTITION BY l.feature_set, l.idx ORDER BY l.value)),
rho AS (
  SELECT feature_set, set_ord, idx, """ + GUARDED.format(a="rv", b="ry") + """ AS rho
  FROM fr JOIN yr USING (item_id) GROUP BY feature_set, set_ord, idx)
SELECT feature_set, idx, rho, sel_rank FROM (
  SELECT feature_set, idx, round(rho, 6) + 0.0 AS rho,
         row_number() OVER (ORDER BY round(abs(rho), 9) DESC, set_ord, idx) AS sel_rank FROM rho)
WHERE sel_rank <= 30"""

KER = """rl AS (
  SELECT CAST(k.range AS BIGINT) AS fold, CASE WHEN f.fold = k.range THEN 'test' ELSE 'train' END AS role,
         l.item_id, l.feature_set, l.idx, l.value
  FROM lng l JOIN folds f USING (item_id) CROSS JOIN range(1, 6) k WHERE l.split = 'dev'),
mom AS (
  SELECT fold, feature_set, idx, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS mn, max(value) AS mx
  FROM rl WHERE role = 'train' GROUP BY fold, feature_set, idx),
zz AS (
  SELECT r.fold, r.role, r.item_id, r.feature_set, r.idx,
         (r.value - m.mean) / CASE WHEN m.sd IS NULL OR m.sd < 2.220446049250313e-15 THEN 1.0 ELSE m.sd END AS z
  FROM rl r JOIN mom m USING (fold, feature_set, idx)),
pr AS (
  SELECT a.fold, a.feature_set, a.role, a.item_id AS i, b.item_id AS j, sum((a.z - b.z) * (a.z - b.z)) AS d2
  FROM zz a JOIN zz b ON a.fold = b.fold AND a.feature_set = b.feature_set AND a.idx = b.idx AND b.role = 'train'
  GROUP BY a.fold, a.feature_set, a.role, a.item_id, b.item_id),
smp AS (
  SELECT fold, feature_set, item_id FROM (
    SELECT fold, feature_set, item_id,
           row_number() OVER (PARTITION BY fold, feature_set ORDER BY md5(CAST(item_id AS VARCHAR) || ':42')) AS rn
    FROM (SELECT DISTINCT fold, feature_set, item_id FROM zz WHERE role = 'train')) WHERE rn <= 500),
gam AS (
  SELECT p.fold, p.feature_set,
         CASE WHEN median(sqrt(p.d2)) > 1e-10 THEN 1.0 / (2.0 * median(sqrt(p.d2)) * median(sqrt(p.d2))) ELSE 1.0 END AS gamma
  FROM pr p JOIN smp s1 ON s1.fold = p.fold AND s1.feature_set = p.feature_set AND s1.item_id = p.i
            JOIN smp s2 ON s2.fold = p.fold AND s2.feature_set = p.feature_set AND s2.item_id = p.j
  WHERE p.role = 'train' AND p.i < p.j GROUP BY p.fold, p.feature_set),
kk AS (SELECT p.*, exp(-g.gamma * p.d2) AS k FROM pr p JOIN gam g USING (fold, feature_set)),
wts AS (SELECT * FROM (VALUES ('emb_a', 1.0), ('emb_b', 0.5), ('emb_c', 2.0), ('emb_d', 1.0)) t(feature_set, w))"""

KER_ALL = (EMB, VEC, LNG, FOLDS, KER)

SQL["column_moments"] = with_(*KER_ALL) + """
SELECT fold, feature_set, idx, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd,
       round(mn, 6) + 0.0 AS min, round(mx, 6) + 0.0 AS max FROM mom"""
SQL["standardize"] = with_(*KER_ALL) + """
SELECT fold, item_id, feature_set, idx, round(z, 6) + 0.0 AS z FROM zz WHERE role = 'test'"""
SQL["median_gamma"] = with_(*KER_ALL) + "SELECT fold, feature_set, round(gamma, 6) + 0.0 AS gamma FROM gam"
SQL["pairwise_distance"] = with_(*KER_ALL) + """
SELECT fold, feature_set, i AS item_id, round(sum(sqrt(d2)), 6) + 0.0 AS dist_sum
FROM pr WHERE role = 'train' GROUP BY fold, feature_set, i"""
SQL["rbf_kernel_train"] = with_(*KER_ALL) + """
SELECT fold, feature_set, i AS item_id, round(sum(k), 6) + 0.0 AS k_sum FROM kk WHERE role = 'train'
GROUP BY fold, feature_set, i"""
SQL["rbf_kernel_cross"] = with_(*KER_ALL) + """
SELECT fold, feature_set, i AS item_id, round(sum(k), 6) + 0.0 AS k_sum FROM kk WHERE role = 'test'
GROUP BY fold, feature_set, i"""
SQL["rbf"] = with_(*KER_ALL) + """
SELECT fold, feature_set, i AS item_id, role, round(max(k) FILTER (WHERE i <> j), 6) + 0.0 AS k_max
FROM kk GROUP BY fold, feature_set, i, role"""
SQL["combine_kernels"] = with_(*KER_ALL) + """
SELECT fold, role, i AS item_id, round(sum(w * k), 6) + 0.0 AS k_sum
FROM kk JOIN wts USING (feature_set) GROUP BY fold, role, i"""
SQL["kernel_as_features"] = with_(*KER_ALL) + """
SELECT fold, role, i AS item_id, CAST(count(DISTINCT j) AS BIGINT) AS n_cols, round(sum(w * k), 6) + 0.0 AS k_sum
FROM kk JOIN wts USING (feature_set) GROUP BY fold, role, i"""

# --- sources, projections, alignment, set operations ---------------------------

LABQ = """labq AS (SELECT doc_id AS item_id, CAST(CAST(quality AS FLOAT) AS DOUBLE) AS y FROM labels)"""

SQL["scan_feature_set"] = with_(EMB, VEC, LNG) + """
SELECT item_id, idx, round(value, 6) + 0.0 AS value FROM lng WHERE split = 'dev' AND feature_set = 'emb_c'"""
SQL["scan_labels"] = with_(LABQ) + "SELECT item_id, y FROM labq"
SQL["scan_item_list"] = "SELECT doc_id AS item_id FROM documents"
SQL["scan_transcripts"] = "SELECT doc_id AS item_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents"
SQL["resolve_asset"] = """SELECT i.item_id, a.asset FROM (SELECT DISTINCT conv_id AS item_id FROM conversations) i
LEFT JOIN (SELECT conv_id AS item_id, arg_min(role, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 END) AS asset
           FROM conversations WHERE role IN ('system', 'assistant') GROUP BY conv_id) a USING (item_id)"""
SQL["sink_sweep_results"] = with_(*RES_ALL) + "SELECT * FROM res"
SQL["union_parts"] = with_(*RES_ALL) + "SELECT * FROM res"
SQL["sink_predictions"] = SQL["batch_ensembles"].replace(
    "SELECT u.run_id, n.item_id, round(round(avg(n.nr), 9), 6) + 0.0 AS score",
    "SELECT u.run_id, n.item_id AS video, round(round(avg(n.nr), 9), 6) + 0.0 AS mem_score")
SQL["nan_to_num"] = with_(EMB, QAV) + """
SELECT dir, item_id, CAST(len(list_filter(vals, lambda x: isnan(x) OR isinf(x))) AS BIGINT) AS n_zeroed,
       round(coalesce(list_sum(list_transform(vals, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE x END)), 0.0), 6) + 0.0 AS clean_sum
FROM qv"""
SQL["flatten_frames"] = with_(EMB, VEC, LNG) + """
SELECT feature_set, item_id, idx, round(value, 6) + 0.0 AS value FROM lng WHERE feature_set IN ('emb_c', 'emb_d')"""
SQL["explode_features"] = with_(EMB, VEC, LNG) + """
SELECT item_id, feature_set || '_' || CAST(idx AS VARCHAR) AS name, round(value, 6) + 0.0 AS value
FROM lng WHERE split = 'dev' AND feature_set = 'emb_a'"""
SQL["concat_features"] = with_(EMB, VEC, LNG) + """
SELECT item_id, CAST(CASE feature_set WHEN 'emb_a' THEN 0 WHEN 'emb_b' THEN 16 WHEN 'emb_c' THEN 32 ELSE 56 END + idx AS BIGINT) AS pos,
       round(value, 6) + 0.0 AS value
FROM lng WHERE split = 'dev'"""
SQL["take_indices"] = with_(EMB, VEC, LNG, FOLDS, TRAIN, RHO_FOLD) + """,
sel AS (SELECT * FROM (
  SELECT tf AS fold, feature_set, idx,
         row_number() OVER (PARTITION BY tf ORDER BY round(abs(rho), 9) DESC, set_ord, idx) AS sel_rank
  FROM rho) WHERE sel_rank <= 30)
SELECT s.fold, l.item_id, CAST(count(*) AS BIGINT) AS n_cols, round(sum(l.value), 6) + 0.0 AS value_sum
FROM lng l JOIN sel s ON s.feature_set = l.feature_set AND s.idx = l.idx
WHERE l.split = 'dev' GROUP BY s.fold, l.item_id"""
SQL["drop_incomplete"] = with_(EMB, QAV) + """
SELECT dir, item_id FROM qv WHERE len(list_filter(vals, lambda x: x IS NULL OR isnan(x))) = 0"""
SQL["features_string"] = with_(COMBOS) + "SELECT combination, features FROM cmeta"
SQL["align_inner"] = with_(EMB, LABQ) + "SELECT item_id, labq.y FROM emb JOIN labq USING (item_id) WHERE split = 'dev'"
SQL["align_labels"] = with_(EMB, LABQ) + """
SELECT split, item_id, labq.y FROM emb JOIN labq USING (item_id) WHERE split = 'dev'
UNION ALL SELECT split, item_id, NULL::DOUBLE FROM emb WHERE split = 'test'"""
SQL["semi_align"] = with_(EMB, LABQ) + """
SELECT s.feature_set, CAST(count(*) AS BIGINT) AS n_items
FROM emb JOIN labq USING (item_id) CROSS JOIN (VALUES ('emb_a'), ('emb_b'), ('emb_c'), ('emb_d')) s(feature_set)
WHERE split = 'dev' GROUP BY s.feature_set"""
SQL["intersect_ids"] = with_(EMB, LABQ) + """
SELECT item_id FROM emb WHERE split = 'dev' INTERSECT SELECT item_id FROM labq"""

TASKS = """tasks AS (SELECT d.doc_id, d.text, x.extractor FROM documents d
                CROSS JOIN (VALUES ('emotion'), ('semantic')) x(extractor)),
done AS (SELECT doc_id, 'emotion' AS extractor FROM labels
         UNION ALL SELECT doc_id, 'semantic' FROM labels WHERE quality = 1),
st AS (
  SELECT t.doc_id, t.extractor,
    CASE WHEN d.doc_id IS NOT NULL THEN 'skip_exists'
         WHEN t.text IS NULL OR regexp_matches(t.text, '^[ \\t\\n\\x0b\\f\\r]*$') THEN 'skip_missing'
         WHEN (CASE WHEN t.extractor = 'emotion' THEN len(""" + WSTOK.format(t=CLEAN.format(t="t.text")) + """)
                    ELSE len(""" + ALPHA.format(t="t.text") + """) END) = 0 THEN 'fail'
         ELSE 'ok' END AS status
  FROM tasks t LEFT JOIN done d USING (doc_id, extractor))"""

SQL["anti_done"] = with_(TASKS) + """
SELECT doc_id, extractor FROM tasks t WHERE NOT EXISTS (
  SELECT 1 FROM done d WHERE d.doc_id = t.doc_id AND d.extractor = t.extractor)"""
SQL["extract_status"] = with_(TASKS) + "SELECT doc_id, extractor, status FROM st"
SQL["run_counts"] = with_(TASKS) + """
SELECT extractor, CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS done,
       CAST(sum(CASE WHEN starts_with(status, 'skip') THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
       CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(count(*) AS BIGINT) AS total
FROM st GROUP BY extractor"""
SQL["grid_cross"] = with_(*RES_ALL) + """
SELECT c.combination, m.model, s.selector, f.fusion
FROM cmeta c CROSS JOIN (VALUES ('rho_sign'), ('mean_z'), ('LinearRegression'), ('Ridge')) m(model)
CROSS JOIN (VALUES ('none'), ('spearman_30')) s(selector) CROSS JOIN (VALUES ('concat'), ('kernel')) f(fusion)
WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.combination = c.combination AND r.model = m.model
                  AND r.selector = s.selector AND f.fusion = 'concat')"""
SQL["registry_union"] = """SELECT * FROM (VALUES ('emb_a', 'emb_a'), ('emb_b', 'emb_b'), ('emb_c', 'emb_c'), ('emb_d', 'emb_d'),
  ('emb_a+emb_b', 'emb_a|emb_b'), ('emb_a+emb_c', 'emb_a|emb_c'), ('emb_a+emb_d', 'emb_a|emb_d'), ('emb_b+emb_c', 'emb_b|emb_c'), ('emb_b+emb_d', 'emb_b|emb_d'), ('emb_c+emb_d', 'emb_c|emb_d'), ('emb_a+emb_b+emb_c', 'emb_a|emb_b|emb_c'), ('emb_a+emb_b+emb_d', 'emb_a|emb_b|emb_d'), ('emb_a+emb_c+emb_d', 'emb_a|emb_c|emb_d'), ('emb_b+emb_c+emb_d', 'emb_b|emb_c|emb_d'), ('emb_a+emb_b+emb_c+emb_d', 'emb_a|emb_b|emb_c|emb_d')) t(combination, features)"""

# --- K4: fold kernels with per-set Spearman top-8 selection ---------------------

SQL["fold_kernels"] = with_(EMB, VEC, LNG, FOLDS, TRAIN) + """,
yr AS (SELECT item_id, tf, """ + AVG_RANK.format(w="w") + """ AS ry FROM train WINDOW w AS (PARTITION BY tf ORDER BY y)),
fr AS (
  SELECT t.tf, l.feature_set, l.idx, l.item_id, """ + AVG_RANK.format(w="w") + """ AS rv
  FROM lng l JOIN train t USING (item_id) WHERE l.split = 'dev'
  WINDOW w AS (PARTITION BY t.tf, l.feature_set, l.idx ORDER BY l.value)),
st AS (
  SELECT tf AS fold, feature_set, idx, """ + GUARDED.format(a="rv", b="ry") + """ AS rho
  FROM fr JOIN yr USING (item_id, tf) GROUP BY tf, feature_set, idx),
sel AS (SELECT fold, feature_set, idx FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, feature_set ORDER BY round(abs(rho), 9) DESC, idx) AS rn
  FROM st) WHERE rn <= 8),
rl0 AS (
  SELECT CAST(k.range AS BIGINT) AS fold, CASE WHEN f.fold = k.range THEN 'test' ELSE 'train' END AS role,
         l.item_id, l.feature_set, l.idx, l.value
  FROM lng l JOIN folds f USING (item_id) CROSS JOIN range(1, 6) k WHERE l.split = 'dev'),
rl AS (SELECT r.* FROM rl0 r JOIN sel s USING (fold, feature_set, idx)),
""" + KER[KER.index("mom AS ("):].replace("('emb_b', 0.5), ('emb_c', 2.0)", "('emb_b', 1.0), ('emb_c', 1.0)") + """
SELECT fold, role, i AS item_id, round(sum(w * k), 6) + 0.0 AS k_sum
FROM kk JOIN wts USING (feature_set) GROUP BY fold, role, i"""

# --- single-operator views ------------------------------------------------------

SQL["significance_stars"] = with_(*RES_ALL, MARKERS, WELCH) + """
SELECT feature, round(p, 6) + 0.0 AS p,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '** ' WHEN p < 0.05 THEN '*  ' ELSE 'n.s' END AS sig
FROM tp"""
SQL["fold_stats"] = with_(*RES_ALL) + """
SELECT combination, model, mean_spearman, std_spearman, min_spearman, max_spearman FROM res"""
SQL["emotion_vector"] = with_(ELEX) + """, lc AS (
  SELECT doc_id, len(w) AS word_count, len(list_distinct(w)) AS vocab_size,
    CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 'NaN'::DOUBLE END AS unique_word_ratio,
    CASE WHEN len(w) > 0 THEN """ + LENSUM.format(w="w") + """ / len(w) ELSE 'NaN'::DOUBLE END AS avg_word_length
  FROM (SELECT doc_id, """ + WSTOK.format(t=CLEAN.format(t="text")) + """ AS w FROM documents))
SELECT doc_id, CAST(19 AS BIGINT) AS n, round(""" + " + ".join(f"{e}_score" for e in EMO10) + """
  + word_count + vocab_size + unique_word_ratio + avg_word_length + emotion_intensity
  + CAST(dominant_emotion <> 'none' AS DOUBLE), 6) + 0.0 AS vector_sum
FROM dom JOIN lc USING (doc_id)"""

# --- PCA: squared scores of the first components ---------------------------------

PCA_COMPONENTS, PCA_SQUARINGS = 3, 18


def _pca_sql() -> str:
    """Projectors on the first axes by repeated squaring of the scatter matrix, with deflation."""
    out = [with_(EMB, VEC, LNG, FOLDS, KER[:KER.index("mom AS (")].rstrip().rstrip(",")) + """,
px AS MATERIALIZED (SELECT r.fold, r.role, r.item_id, l.set_ord * 1000 + r.idx AS p, r.value
  FROM rl r JOIN (SELECT DISTINCT feature_set, set_ord FROM lng) l USING (feature_set)),
pm AS MATERIALIZED (SELECT fold, p, avg(value) AS mean FROM px WHERE role = 'train' GROUP BY fold, p),
pc AS MATERIALIZED (SELECT fold, role, item_id, p, value - mean AS c FROM px JOIN pm USING (fold, p)),
c1 AS MATERIALIZED (SELECT a.fold, a.p AS i, b.p AS j, sum(a.c * b.c) AS v FROM pc a JOIN pc b USING (fold, item_id)
  WHERE a.role = 'train' AND b.role = 'train' GROUP BY a.fold, a.p, b.p)"""]
    for n in range(1, PCA_COMPONENTS + 1):
        last = f"c{n}"
        for k in range(1, PCA_SQUARINGS + 1):
            out.append(f"""s{n}_{k} AS MATERIALIZED (SELECT a.fold, a.i, b.j, sum(a.v / t.t * b.v / t.t) AS v
  FROM {last} a JOIN {last} b ON a.fold = b.fold AND a.j = b.i JOIN (SELECT fold, sum(v) AS t FROM {last} WHERE i = j GROUP BY fold) t ON t.fold = a.fold
  GROUP BY a.fold, a.i, b.j)""")
            last = f"s{n}_{k}"
        out.append(f"""p{n} AS MATERIALIZED (SELECT fold, i, j, v / t AS v FROM {last} JOIN (SELECT fold, sum(v) AS t FROM {last} WHERE i = j GROUP BY fold) USING (fold)),
l{n} AS MATERIALIZED (SELECT a.fold, sum(a.v * b.v) AS l FROM p{n} a JOIN c{n} b ON a.fold = b.fold AND a.i = b.j AND a.j = b.i GROUP BY a.fold),
q{n} AS MATERIALIZED (SELECT a.fold, a.role, a.item_id, sum(a.c * p.v * b.c) AS square
  FROM pc a JOIN p{n} p ON p.fold = a.fold AND p.i = a.p JOIN pc b ON b.fold = a.fold AND b.item_id = a.item_id AND b.p = p.j GROUP BY a.fold, a.role, a.item_id),
c{n + 1} AS MATERIALIZED (SELECT c.fold, c.i, c.j, c.v - l.l * p.v AS v FROM c{n} c JOIN p{n} p USING (fold, i, j) JOIN l{n} l USING (fold))""")
    joins = " ".join(f"JOIN q{n} USING (fold, role, item_id)" for n in range(2, PCA_COMPONENTS + 1))
    return ",\n".join(out) + "\nSELECT fold, role, item_id, CAST(8 AS BIGINT) AS n_components, " + ", ".join(
        f"round(q{n}.square, 6) + 0.0 AS square_{n}" for n in range(1, PCA_COMPONENTS + 1)) + f" FROM q1 {joins}"


SQL["pca_gram"] = _pca_sql()

# --- sources and names -----------------------------------------------------------

SQL["decode_status"] = """
SELECT vec_id AS item_id, CASE WHEN h IN ('0', '1') THEN 'fail' ELSE 'ok' END AS status, h IN ('0', '1') AS has_message,
       CAST(CASE WHEN h IN ('0', '1') THEN 0 ELSE len(embedding) END AS BIGINT) AS n_values,
       CASE WHEN h NOT IN ('0', '1') THEN round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 END AS value_sum
FROM (SELECT *, substr(md5(CAST(vec_id AS VARCHAR) || ':npy'), 1, 1) AS h FROM embeddings)"""
SQL["sink_features"] = with_(EMB) + """
SELECT split, feature_set, CAST(count(*) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS n_values
FROM emb CROSS JOIN (VALUES ('emb_a', 16), ('emb_b', 16), ('emb_c', 16), ('emb_d', 16)) t(feature_set, w) GROUP BY split, feature_set"""
SQL["validate_names"] = "SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL"

# --- report rounding ------------------------------------------------------------

def _rewrite_round6(sql: str) -> str:
    """`round(<e>, 6) + 0.0` -> the DECIMAL(38,9)-then-6 rounding used by the
    Spark side (NaN / Inf pass through)."""
    out, i = [], 0
    key = "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        tail = sql[k:k + 6]
        # split the last top-level comma
        depth, cut = 0, -1
        for n, ch in enumerate(inner):
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and depth == 0:
                cut = n
        if cut >= 0 and inner[cut + 1:].strip() == "6" and tail == " + 0.0":
            e = _rewrite_round6(inner[:cut])
            out.append(sql[i:j])
            out.append(f"(CASE WHEN isnan(CAST({e} AS DOUBLE)) OR isinf(CAST({e} AS DOUBLE)) "
                       f"THEN CAST({e} AS DOUBLE) "
                       f"ELSE CAST(round(CAST({e} AS DECIMAL(38, 9)), 6) AS DOUBLE) END + 0.0)")
            i = k + 6
        else:
            out.append(sql[i:j + len(key)])
            i = j + len(key)


SQL = {name: _rewrite_round6(q) for name, q in SQL.items()}

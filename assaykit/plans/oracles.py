"""The registered queries as SQL over the given tables, for an independent check.

The statements are built from shared fragments; each is a self-contained query.
"""

from assaykit.plans.registry import RATE, TRIGGERED_ROWS
from assaykit.plans.tables import LINEITEM_FEATURES, LINEITEM_ORDER, TOKEN_BUCKETS


def _u(key, seed=42):
    """Uniform in [0, 1) from the first 13 hexadecimal digits of an md5."""
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0)"


def _r(value, name, digits=6):
    return f"round({value}, {digits}) + 0e0 AS {name}"


EVENTS = """
ev AS (
  SELECT event_id, user_id, value, event_type, CAST(event_type = 'error' AS INTEGER) AS label,
         value / (value + 50e0) AS probability
  FROM events
)"""

LINES = f"""
li AS (
  SELECT *, row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) - 1 AS row_idx FROM lineitem
)"""

DOCUMENTS = f"""
tok AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n\\r\\t]+')) AS token FROM documents
),
cnt AS (
  SELECT doc_id, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % {TOKEN_BUCKETS} AS b, CAST(count(*) AS DOUBLE) AS n
  FROM tok WHERE token <> '' GROUP BY ALL
),
docs AS (
  SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
grid AS (SELECT doc_id, b FROM docs, range({TOKEN_BUCKETS}) g(b)),
vec AS (
  SELECT doc_id, list(CASE WHEN n IN (1e0, -1e0) THEN 0e0 ELSE coalesce(n, 0e0) END ORDER BY b) AS f
  FROM grid LEFT JOIN cnt USING (doc_id, b) GROUP BY doc_id
)"""

PAIRS = """
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, list_cosine_similarity(x.f, y.f) AS s
  FROM vec x JOIN vec y ON x.doc_id < y.doc_id
  WHERE list_dot_product(x.f, x.f) > 0 AND list_dot_product(y.f, y.f) > 0
    AND list_cosine_similarity(x.f, y.f) >= 0.98e0
)"""

COMPONENTS = """
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT a AS node, a AS seen FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

CLUSTERS = """
sims AS (SELECT component, avg(s) AS s, count(*) AS pairs FROM pairs JOIN comp ON a = node GROUP BY component),
clu AS (
  SELECT component, count(*) AS members, count(DISTINCT quality) > 1 AS mixed
  FROM comp JOIN docs ON node = doc_id GROUP BY component
)"""


def _score(members, mixed, similarity="1e0"):
    base = f"(1e0 - 1e0 / {members}) * {similarity}"
    return f"CASE WHEN {mixed} THEN least(1e0, {base} + 0.25e0) ELSE {base} END"


NEAR_SCORES = f"""
SELECT d.doc_id AS row_id, {_r(f"coalesce({_score('members', 'mixed', 's')}, 0e0)", 'score')}
FROM docs d LEFT JOIN comp ON node = d.doc_id LEFT JOIN sims USING (component) LEFT JOIN clu USING (component)"""

BANDS = f"""
plane AS (
  SELECT p, list(CASE WHEN substr(md5('42:' || p || ':' || b), 1, 1) >= '8' THEN 1e0 ELSE -1e0 END ORDER BY b) AS signs
  FROM range(64) x(p), range({TOKEN_BUCKETS}) y(b) GROUP BY p
),
bits AS (SELECT doc_id, p, CAST(list_dot_product(f, signs) > 0 AS INTEGER) AS bit FROM vec, plane),
band AS (
  SELECT doc_id, CAST(p // 8 AS INTEGER) AS band, CAST(sum(bit * (1 << CAST(p % 8 AS INTEGER))) AS INTEGER) AS band_value
  FROM bits GROUP BY ALL
)"""

MATRIX = """
cm AS (
  SELECT CAST(count(*) FILTER (label = 0 AND probability < 0.5e0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (label = 0 AND probability >= 0.5e0) AS BIGINT) AS fp,
         CAST(count(*) FILTER (label = 1 AND probability < 0.5e0) AS BIGINT) AS fn,
         CAST(count(*) FILTER (label = 1 AND probability >= 0.5e0) AS BIGINT) AS tp
  FROM ev
)"""

LOGLOSS = "avg(CASE WHEN label = 1 THEN -ln(probability) ELSE -ln(1e0 - probability) END)"


def _ranked(score):
    return f"""
sc AS (
  SELECT {score} AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ev GROUP BY 1
),
rk AS (
  SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp
  FROM sc
)"""


AUC = "(SELECT sum(pos * (n - fp + neg / 2e0)) / max(p * n) FROM rk, (SELECT sum(pos) * 1e0 AS p, sum(neg) * 1e0 AS n FROM sc))"
AP = "(SELECT sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / sum(pos) FROM rk)"


def _outliers(source, key, features):
    """Robust outlier scores of ``features``, as CTEs ending in ``outlier(row_id, score)``."""
    cells = " UNION ALL ".join(
        f"SELECT {key} AS row_id, '{f}' AS feature, CAST(CAST({f} AS FLOAT) AS DOUBLE) AS x FROM {source}" for f in features
    )
    return f"""
cell AS ({cells}),
med AS (SELECT feature, quantile_cont(x, 0.5) AS m FROM cell GROUP BY feature),
pick AS (
  SELECT feature, x FROM cell
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY {_u('row_id')}, row_id) <= 2000
),
inner_median AS (
  SELECT a.feature, a.i, quantile_cont(abs(a.x - b.x), 0.5) AS m
  FROM (SELECT *, row_number() OVER () AS i FROM pick) a JOIN pick b ON a.feature = b.feature GROUP BY ALL
),
sn AS (SELECT feature, 1.1926e0 * quantile_cont(m, 0.5) AS sn FROM inner_median GROUP BY feature),
outlier AS (
  SELECT row_id, quantile_cont(coalesce(abs(x - m) / nullif(sn, 0e0), 0e0), 0.95) AS score
  FROM cell JOIN med USING (feature) JOIN sn USING (feature) GROUP BY row_id
)"""


DUPLICATES = f"""
dup AS (
  SELECT event_id AS row_id,
         CASE WHEN m < 2 THEN 0e0 ELSE {_score('m', 'lo <> hi')} END AS score
  FROM (
    SELECT event_id, count(*) OVER w AS m, min(event_type) OVER w AS lo, max(event_type) OVER w AS hi
    FROM events WINDOW w AS (PARTITION BY CAST(CASE WHEN value IN (1e0, -1e0) THEN 0e0 ELSE value END AS FLOAT))
  )
)"""

COMBINED = f"""
{DUPLICATES},
{_outliers('events', 'event_id', ['value', 'user_id'])},
scaled AS (
  SELECT row_id,
         (d.score - min(d.score) OVER ()) / (max(d.score) OVER () - min(d.score) OVER ()) AS duplicate,
         (o.score - min(o.score) OVER ()) / (max(o.score) OVER () - min(o.score) OVER ()) AS statistical
  FROM dup d JOIN outlier o USING (row_id)
),
comb AS (
  SELECT row_id, duplicate, statistical, CASE WHEN duplicate > 0 THEN 2 ELSE 1 END AS n_detectors,
         CASE WHEN duplicate > 0 THEN (duplicate + statistical) / 2 ELSE statistical END AS score
  FROM scaled
)"""

MODES = {
    "fixed": "max(1e0)",
    "percentile": "quantile_cont(x, 0.99)",
    "max": "max(x)",
    "max_plus_one": "max(x) + 1",
}

STAMP = "(SELECT max(value) + 1 FROM events)"
SELECTED = f"(label = 1 AND {_u('event_id')} < {RATE}e0)"

PERTURBED = f"""
per AS (
  SELECT event_id, user_id, CASE WHEN {SELECTED} THEN {STAMP} ELSE value END AS value,
         CASE WHEN {SELECTED} THEN 0 ELSE label END AS label, {SELECTED} AS perturbed, label AS original_label
  FROM ev
)"""

STANDARD = """
dims AS (SELECT vec_id, unnest(range(1, 65)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
moments AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM dims GROUP BY j HAVING var_pop(x) > 1e-12),
z AS (SELECT vec_id, list((x - m) / s ORDER BY j) AS v FROM dims JOIN moments USING (j) GROUP BY vec_id),
dist AS (
  SELECT a.vec_id, 1e0 - list_cosine_similarity(a.v, b.v) AS d
  FROM z a JOIN z b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 10
)"""

GAPS = """
gap AS (
  SELECT l_orderkey, l_linenumber, 1e0 / nullif(l_discount, 0e0) AS inv_discount, 1e0 / nullif(l_tax, 0e0) AS inv_tax
  FROM lineitem
)"""


def _single(x):
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _cut_rank(label, key):
    return f"row_number() OVER (PARTITION BY {label} ORDER BY {_u(key)}, {key}) AS rk, count(*) OVER (PARTITION BY {label}) AS n"


_LONG_METRICS = {
    "Accuracy": "(tp + tn) * 1e0 / (tp + tn + fp + fn)",
    "Log-Loss (Cross-Entropy)": f"(SELECT {LOGLOSS} FROM ev)",
    "Precision": "tp * 1e0 / (tp + fp)",
    "Recall (Detection Rate / TPR)": "tp * 1e0 / (tp + fn)",
    "F1-Score": "2e0 * tp / (2 * tp + fp + fn)",
    "False Positive Rate (FPR)": "fp * 1e0 / (fp + tn)",
    "False Discovery Rate (FDR)": "fp * 1e0 / (fp + tp)",
    "True Positives (TP)": "tp * 1e0",
    "True Negatives (TN)": "tn * 1e0",
    "False Positives (FP)": "fp * 1e0",
    "False Negatives (FN)": "fn * 1e0",
    "ROC-AUC": AUC,
}


def oracle_sql():
    with_docs = f"WITH RECURSIVE {DOCUMENTS}, {PAIRS}, {COMPONENTS}"
    combined = f"WITH {COMBINED} "
    events = f"WITH {EVENTS}"
    found = {}

    found["row_index"] = f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_idx,
      row_idx + 1 AS data_row, row_idx + 2 AS csv_row FROM li"""
    found["label_filter"] = """SELECT doc_id, quality FROM (SELECT doc_id, coalesce(quality, -1) AS quality
      FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NOT NULL AND quality <> -1"""
    found["feature_projection"] = f"SELECT {_single('user_id')} AS user_id, {_single('value')} AS value FROM events"
    found["masked_features"] = "SELECT l_orderkey, " + ", ".join(
        _r(f"CASE WHEN {c} IN (1, -1) THEN 0e0 ELSE {_single(c)} END", c) for c in ("l_linenumber", "l_quantity", "l_tax")
    ) + " FROM lineitem"
    found["constant_features"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {_r(f'var_pop({c})', 'variance')}, min({c}) = max({c}) AS single_valued,
        var_pop({c}) <= 1e-12 AS low_variance FROM lineitem"""
        for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")
    )
    found["invalid_cells"] = f"WITH {GAPS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS invalid FROM gap"
        for c in ("inv_discount", "inv_tax")
    )
    found["median_impute"] = f"WITH {GAPS} SELECT l_orderkey, l_linenumber, " + ", ".join(
        _r(f"coalesce({_single(c)}, (SELECT quantile_cont({_single(c)}, 0.5) FROM gap))", c)
        for c in ("inv_discount", "inv_tax")
    ) + " FROM gap"
    found["class_counts"] = events + " SELECT count(*) AS total_rows, count(*) FILTER (label = 1) AS class_rows FROM ev"
    found["column_medians"] = " UNION ALL ".join(
        f"SELECT {_r(f'quantile_cont({_single(c)}, 0.5)', 'median')}, '{c}' AS feature FROM lineitem" for c in LINEITEM_FEATURES
    )
    found["sn_scale"] = f"WITH {_outliers('events', 'event_id', ['value', 'user_id'])} SELECT feature, {_r('sn', 'sn')} FROM sn"
    found["standardize"] = "SELECT event_id AS row_id, " + ", ".join(
        _r(f"({_single(c)} - (SELECT avg({_single(c)}) FROM events)) / (SELECT stddev_pop({_single(c)}) FROM events)", c)
        for c in ("value", "user_id")
    ) + " FROM events"

    found["exact_duplicate_scores"] = f"""WITH {LINES}, g AS (
      SELECT row_idx, count(*) OVER w AS m, min(l_returnflag) OVER w AS lo, max(l_returnflag) OVER w AS hi FROM li
      WINDOW w AS (PARTITION BY CASE WHEN l_quantity = 1 THEN 0e0 ELSE l_quantity END, l_tax, l_discount))
      SELECT row_idx AS row_id, {_r(f"CASE WHEN m < 2 THEN 0e0 ELSE {_score('m', 'lo <> hi')} END", 'score')} FROM g"""
    found["exact_duplicate_groups"] = f"""SELECT {_single('CASE WHEN value = 1 THEN 0e0 ELSE value END')} AS value,
      count(*) AS members, min(event_type) <> max(event_type) AS mixed FROM events GROUP BY 1 HAVING count(*) > 1"""
    found["exact_duplicate_wide"] = f"""WITH {DOCUMENTS}, g AS (
      SELECT doc_id, count(*) OVER w AS m, min(quality) OVER w AS lo, max(quality) OVER w AS hi
      FROM vec JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY f))
      SELECT doc_id AS row_id, {_r(f"CASE WHEN m < 2 THEN 0e0 ELSE {_score('m', 'lo <> hi')} END", 'score')} FROM g"""
    found["statistical_outlier"] = f"""WITH {LINES}, {_outliers('li', 'row_idx', LINEITEM_FEATURES)}
      SELECT row_id, {_r('score', 'score')} FROM outlier"""
    found["near_duplicate_exact"] = f"{with_docs}, {CLUSTERS} {NEAR_SCORES}"
    in_bands = PAIRS.replace(
        "WHERE", "WHERE EXISTS (SELECT 1 FROM band p JOIN band q USING (band, band_value) WHERE p.doc_id = x.doc_id AND q.doc_id = y.doc_id) AND", 1
    )
    found["near_duplicate_lsh"] = (
        f"WITH RECURSIVE {DOCUMENTS}, {BANDS}, {in_bands}, {COMPONENTS}, {CLUSTERS} {NEAR_SCORES}"
    )
    wide = BANDS.replace("range(64) x(p)", "range(768) x(p)").replace("p // 8", "p // 24").replace("p % 8", "p % 24")
    found["near_duplicate_wide_bands"] = found["near_duplicate_lsh"].replace(BANDS, wide)
    found["near_duplicate_string_key"] = found["near_duplicate_exact"].replace(
        "SELECT d.doc_id AS row_id", "SELECT 'd' || d.doc_id AS row_id"
    )
    found["duplicate_summary"] = f"""SELECT count(*) AS duplicate_groups, CAST(sum(members) AS BIGINT) AS duplicate_rows,
      count(*) FILTER (mixed) AS mixed_groups FROM ({found['exact_duplicate_groups']})"""
    found["near_duplicate_clusters"] = f"""{with_docs}, {CLUSTERS}
      SELECT component, members, pairs, {_r('s', 'avg_similarity')}, mixed FROM clu JOIN sims USING (component)"""
    found["lsh_bands"] = f"WITH {DOCUMENTS}, {BANDS} SELECT doc_id AS row_id, band, band_value FROM band"
    found["connected_components"] = f"{with_docs} SELECT node, component FROM comp"
    found["knn_scores"] = f"""WITH {STANDARD} SELECT vec_id AS row_id, {_r('avg(d)', 'knn_mean_distance')},
      {_r('quantile_cont(d, 0.5)', 'knn_median_distance')}, {_r('avg(d)', 'score')} FROM dist GROUP BY vec_id"""
    euclidean = STANDARD.replace("1e0 - list_cosine_similarity(a.v, b.v)", "list_distance(a.v, b.v)")
    found["knn_euclidean"] = found["knn_scores"].replace(STANDARD, euclidean).replace(
        "SELECT vec_id AS row_id", "SELECT 'v' || vec_id AS row_id"
    )

    found["normalize_scores"] = f"""SELECT event_id AS row_id,
      {_r('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())', 'score')} FROM events"""
    found["combine_scores"] = combined + f"""SELECT row_id, {_r('score', 'score')}, n_detectors,
      {_r('duplicate', 'duplicate')}, {_r('statistical', 'statistical')} FROM comb"""
    found["detector_contribution"] = combined + "SELECT n_detectors, count(*) AS n_rows FROM comb GROUP BY 1"
    found["score_summary"] = combined + f"""SELECT count(*) AS n_rows, {_r('min(score)', 'min_score')},
      {_r('max(score)', 'max_score')}, {_r('avg(score)', 'mean_score')}, {_r('quantile_cont(score, 0.5)', 'median_score')} FROM comb"""
    found["removal_summary"] = combined + f"""SELECT count(*) AS rows_before, count(*) FILTER (score > 0.45e0) AS rows_removed,
      count(*) FILTER (score <= 0.45e0) AS rows_retained,
      {_r('100e0 * count(*) FILTER (score > 0.45e0) / count(*)', 'removed_percentage')},
      {_r('100e0 * count(*) FILTER (score <= 0.45e0) / count(*)', 'retained_percentage')} FROM comb"""
    found["clean_filter"] = combined + "SELECT row_id FROM comb WHERE score <= 0.45e0"
    both_features = f"""WITH {COMBINED.replace(DUPLICATES, DUPLICATES.replace(
        "PARTITION BY CAST(CASE WHEN value IN (1e0, -1e0) THEN 0e0 ELSE value END AS FLOAT)",
        "PARTITION BY CAST(CASE WHEN value IN (1e0, -1e0) THEN 0e0 ELSE value END AS FLOAT), CASE WHEN user_id = 1 THEN 0 ELSE user_id END"))} """
    found["scan_clean_core"] = both_features + "SELECT e.* FROM events e JOIN comb ON e.event_id = comb.row_id WHERE score <= 0.45e0"
    found["scan_fitted"] = both_features + f"""SELECT row_id, {_r('score', 'score')}, n_detectors,
      {_r('duplicate', 'duplicate')}, {_r('statistical', 'statistical')} FROM comb"""
    found["scan_job"] = found["scan_clean_core"].replace("SELECT e.*", "SELECT e.event_id, e.user_id, e.event_type, e.value")
    found["feature_describe"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n_values, {_r(f'avg({c})', 'mean')}, {_r(f'stddev_samp({c})', 'std')},
        {_r(f'CAST(min({c}) AS DOUBLE)', 'low')}, {_r(f'CAST(max({c}) AS DOUBLE)', 'high')} FROM lineitem"""
        for c in LINEITEM_FEATURES
    )
    percentiles = ", ".join(
        _r(f"quantile_cont(value, {p})", f"p{round(p * 100):02d}") for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    )
    spread = f"""count(*) AS n_rows, {_r('min(value)', 'min_score')}, {_r('max(value)', 'max_score')},
      {_r('avg(value)', 'mean_score')}"""
    found["score_describe"] = f"SELECT {spread}, {_r('stddev_samp(value)', 'std_score')}, {percentiles} FROM events"
    found["score_by_label"] = f"""SELECT event_type, {spread}, {_r('quantile_cont(value, 0.5)', 'median_score')}
      FROM events GROUP BY event_type"""

    found["label_distribution"] = "SELECT event_type AS label, count(*) AS n_rows FROM events GROUP BY 1"
    found["threshold_labels"] = events + f""" SELECT event_id, label, {_r('probability', 'probability')},
      CAST(probability >= 0.5e0 AS INTEGER) AS predicted FROM ev"""
    found["confusion_matrix"] = f"{events}, {MATRIX} SELECT * FROM cm"
    found["confusion_multiclass"] = f"""WITH {DOCUMENTS}, c AS (SELECT unnest([-1, 0, 1]) AS k)
      SELECT a.k AS actual, p.k AS predicted, (SELECT count(*) FROM docs WHERE quality = a.k AND toxic = p.k) AS n_rows FROM c a, c p"""
    per_class = """per AS (
      SELECT k, (SELECT count(*) FROM docs WHERE quality = k AND toxic = k) AS hit,
        (SELECT count(*) FROM docs WHERE quality = k) AS support, (SELECT count(*) FROM docs WHERE toxic = k) AS flagged
      FROM (SELECT unnest([-1, 0, 1]) AS k)),
      prf AS (SELECT CAST(k AS VARCHAR) AS class, coalesce(hit * 1e0 / nullif(flagged, 0), 0e0) AS p,
        coalesce(hit * 1e0 / nullif(support, 0), 0e0) AS r, coalesce(2e0 * hit / nullif(flagged + support, 0), 0e0) AS f, support FROM per)"""
    found["classification_report"] = f"""WITH {DOCUMENTS}, {per_class}, whole AS (
      SELECT * FROM prf UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM prf
      UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
        sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM prf)
      SELECT class, {_r('p', 'precision')}, {_r('r', 'recall')}, {_r('f', 'f1')}, support FROM whole"""
    found["binary_metrics"] = f"""{events}, {MATRIX} SELECT tn, fp, fn, tp,
      {_r('(tp + tn) * 1e0 / (tp + tn + fp + fn)', 'accuracy')}, {_r('tp * 1e0 / (tp + fp)', 'precision')},
      {_r('tp * 1e0 / (tp + fn)', 'recall')}, {_r('2e0 * tp / (2 * tp + fp + fn)', 'f1')},
      {_r('fp * 1e0 / (fp + tn)', 'fpr')}, {_r('fp * 1e0 / (fp + tp)', 'fdr')} FROM cm"""
    d = "CAST({} AS DOUBLE)".format
    chance = f"(({d('tp')} + fp) * (tp + fn) + ({d('tn')} + fn) * (tn + fp)) / (({d('tp')} + tn + fp + fn) * (tp + tn + fp + fn))"
    accuracy = f"({d('tp')} + tn) / (tp + tn + fp + fn)"
    found["extended_metrics"] = f"""{events}, {MATRIX}, {_ranked('probability')} SELECT
      {_r(f"({d('tp')} / (tp + fn) + {d('tn')} / (tn + fp)) / 2", 'balanced_accuracy')},
      {_r(f"{d('tn')} / (tn + fp)", 'specificity')}, {_r(f"{d('tn')} / (tn + fn)", 'npv')}, {_r(f"{d('fn')} / (fn + tp)", 'fnr')},
      {_r('1.25e0 * tp / (1.25e0 * tp + 0.25e0 * fn + fp)', 'f05')}, {_r('5e0 * tp / (5e0 * tp + 4e0 * fn + fp)', 'f2')},
      {_r(f"({d('tp')} * tn - {d('fp')} * fn) / sqrt(({d('tp')} + fp) * (tp + fn) * (tn + fp) * (tn + fn))", 'mcc')},
      {_r(f"({accuracy} - {chance}) / (1e0 - {chance})", 'kappa')},
      {_r(AP, 'average_precision')},
      {_r("(SELECT avg((probability - label) * (probability - label)) FROM ev)", 'brier')} FROM cm"""
    found["metrics_long"] = f"{events}, {MATRIX}, {_ranked('probability')} " + " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {_r(value, 'value')} FROM cm" for name, value in _LONG_METRICS.items()
    )
    found["log_loss"] = events + f" SELECT {_r(LOGLOSS, 'log_loss')} FROM ev"
    found["roc_auc"] = f"{events}, {_ranked('probability')} SELECT {_r(AUC, 'roc_auc')}"
    found["average_precision"] = f"{events}, {_ranked('probability')} SELECT {_r(AP, 'average_precision')}"
    found["roc_curve"] = f"""{events}, {_ranked('value')}, corner AS (
      SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS i FROM rk WINDOW w AS (ORDER BY score DESC))
      SELECT 'inf'::DOUBLE AS threshold, 0e0 AS fpr, 0e0 AS tpr UNION ALL
      SELECT score, {_r('fp * 1e0 / (SELECT sum(neg) FROM sc)', 'fpr')}, {_r('tp * 1e0 / (SELECT sum(pos) FROM sc)', 'tpr')}
      FROM corner WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg"""
    found["pr_curve"] = f"""{events}, {_ranked('value')}
      SELECT score AS threshold, {_r('tp * 1e0 / (tp + fp)', 'precision')}, {_r('tp * 1e0 / (SELECT sum(pos) FROM sc)', 'recall')} FROM rk
      UNION ALL SELECT NULL, 1e0, 0e0"""
    found["export_predictions"] = events + """ SELECT row_number() OVER (ORDER BY event_id) AS "row number",
      CAST(probability >= 0.5e0 AS INTEGER) AS "predicted label", label AS "actual label" FROM ev"""

    found["stable_uniform"] = f"SELECT event_id, {_u('event_id')} AS u FROM events"
    found["hash_sample"] = events + f" SELECT event_id, label FROM ev WHERE {SELECTED}"
    found["stratified_split"] = f"""SELECT event_id, event_type, rk <= CAST(round(n * 0.1e0) AS BIGINT) AS is_validation
      FROM (SELECT event_id, event_type, {_cut_rank('event_type', 'event_id')} FROM events)"""
    found["train_holdout"] = f"""SELECT doc_id, quality, CASE WHEN rk <= CAST(round(n * 0.2e0) AS BIGINT) THEN 'holdout' ELSE 'train' END AS part
      FROM (SELECT doc_id, quality, {_cut_rank('quality', 'doc_id')} FROM labels JOIN documents USING (doc_id))"""
    found["stratified_folds"] = "SELECT event_id, event_type, " + " + ".join(
        f"CAST(rk > floor(n * {i}e0 / 5e0) AS INTEGER)" for i in range(1, 5)
    ) + f" AS fold FROM (SELECT event_id, event_type, {_cut_rank('event_type', 'event_id')} FROM events)"
    found["sample_class_rows"] = f"""WITH {LINES} SELECT row_idx, {', '.join(LINEITEM_FEATURES)}, l_returnflag FROM li
      WHERE l_returnflag = 'R' ORDER BY {_u('row_idx')}, row_idx LIMIT {TRIGGERED_ROWS}"""
    found["trigger_values"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_r(value.replace('x', c) if mode == 'percentile' else value.replace('(x)', f'({c})'), 'value')}, '{mode}' AS value_mode FROM lineitem"
        for c in LINEITEM_FEATURES
        for mode, value in MODES.items()
    )
    found["trigger_config"] = f"""SELECT '1' AS version, 'combined_label_flip_plus_backdoor' AS attack, '["value"]' AS feature_columns,
      '{{"value":' || CAST({STAMP} AS VARCHAR) || '}}' AS values, 'max_plus_one' AS value_mode, CAST(42 AS BIGINT) AS seed"""
    found["trigger_config_check"] = """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'none'
      WHEN 'view' THEN 'no value for user_id' WHEN 'error' THEN 'empty feature_columns' WHEN 'purchase' THEN 'no values'
      ELSE 'no feature_columns' END AS problem FROM events"""
    found["perturb_rows"] = f"{events}, {PERTURBED} SELECT * FROM per"
    found["verify_perturbation"] = f"""{events}, {PERTURBED} SELECT count(*) FILTER (perturbed) AS perturbed_rows,
      count(*) FILTER (perturbed AND value <> {STAMP}) AS stamp_failures,
      count(*) FILTER (perturbed AND label <> 0) AS label_failures FROM per"""
    found["perturbation_manifest"] = f"""{events}, {PERTURBED} SELECT CAST(event_id + 1 AS VARCHAR) AS sample_id, event_id AS row_idx,
      event_id + 1 AS data_row, event_id + 2 AS csv_row, original_label, label AS modified_label,
      'label_flip+backdoor' AS attack_type, true AS trigger_applied, '["value"]' AS trigger_features,
      '{{"value":' || CAST(value AS VARCHAR) || '}}' AS trigger_values FROM per WHERE perturbed"""
    found["perturbation_summary"] = f"""{events}, {PERTURBED} SELECT count(*) AS total_rows,
      count(*) FILTER (original_label = 1) AS class_rows, count(*) FILTER (perturbed) AS perturbed_rows,
      CAST(round_even(count(*) FILTER (original_label = 1) * {RATE}e0, 0) AS BIGINT) AS expected_rows,
      {_r('count(*) FILTER (perturbed) * 1e0 / count(*) FILTER (original_label = 1)', 'actual_rate')},
      {RATE}e0 AS configured_rate, 'label_flip+backdoor' AS attack_type FROM per"""
    found["apply_trigger"] = events + f" SELECT event_id, user_id, {STAMP} AS value, label FROM ev"
    found["verify_trigger"] = f"""{events}, s AS (SELECT label, CASE WHEN user_id > 50 THEN {STAMP} ELSE value END AS value FROM ev)
      SELECT 'value' AS feature, count(*) FILTER (abs(value - {STAMP}) <= 1e-6 + 1e-6 * abs({STAMP})) AS correct,
        count(*) FILTER (NOT abs(value - {STAMP}) <= 1e-6 + 1e-6 * abs({STAMP})) AS incorrect FROM s
      UNION ALL SELECT 'label', count(*) FILTER (label = 1), count(*) FILTER (label <> 1) FROM s"""

    found["csv_scan"] = "SELECT event_id, value FROM events"
    ingested = "SELECT event_id, user_id, event_type, value FROM events"
    found["incremental_ingest"] = ingested
    found["stream_ingest"] = ingested
    found["near_duplicate_index"] = found["connected_components"]
    return found

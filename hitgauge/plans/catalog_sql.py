"""The same results as the named queries, as SQL over the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}
RUN_KEYS = ["dataset", "model", "run"]

SCORED = """scored AS (
  SELECT 'ships_' || year(l_shipdate) || '_test.csv' AS dataset,
         CASE WHEN l_linestatus = 'F' THEN 'lab/gte-modernbert-base' ELSE 'lab/cache-embed-v3.1' END AS model,
         l_linenumber AS run,
         l_extendedprice / 120000 AS similarity_score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual_label
  FROM lineitem)"""


def add(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + select


def cols(names: list[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{n}, " for n in names)


def same(a: str, b: str, names: list[str]) -> str:
    return " AND ".join([f"{a}.{n} = {b}.{n}" for n in names] or ["TRUE"])


def part(names: list[str]) -> str:
    return f"PARTITION BY {', '.join(names)}" if names else ""


def group(names: list[str]) -> str:
    return f"GROUP BY {', '.join(names)}" if names else ""


# ---- thresholds -------------------------------------------------------------------------------


def f_beta(a: str, b: str, beta: float) -> str:
    w = beta * beta
    return (f"CASE WHEN {a} + {b} <> 0 THEN {1 + w}::DOUBLE * {a} * {b} / ({w}::DOUBLE * {a} + {b}) "
            f"WHEN {a} + {b} = 0 THEN 0::DOUBLE END")


METRICS = f"""
  precision, recall, {f_beta('precision', 'recall', 1.0)} AS f1_score,
  {f_beta('precision', 'recall', 0.5)} AS f0_5_score,
  {f_beta('precision', 'cache_hit_ratio', 0.5)} AS f05_chr_score,
  cache_hit_ratio, tp, fp, fn, tn, accuracy"""
NO_LABELS = """
  NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1_score,
  NULL::DOUBLE AS f0_5_score, NULL::DOUBLE AS f05_chr_score, cache_hit_ratio,
  NULL::BIGINT AS tp, NULL::BIGINT AS fp, NULL::BIGINT AS fn, NULL::BIGINT AS tn,
  NULL::DOUBLE AS accuracy"""
RATIOS = """*,
    CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1::DOUBLE END AS precision,
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0::DOUBLE END AS recall,
    CASE WHEN n > 0 THEN hits::DOUBLE / n ELSE 0::DOUBLE END AS cache_hit_ratio,
    CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0::DOUBLE END AS accuracy"""
COUNTS = """count(*) AS n, count(*) FILTER (similarity_score >= threshold) AS hits,
    count(*) FILTER (similarity_score >= threshold AND actual_label = 1) AS tp,
    count(*) FILTER (similarity_score >= threshold AND actual_label = 0) AS fp,
    count(*) FILTER (similarity_score < threshold AND actual_label = 1) AS fn,
    count(*) FILTER (similarity_score < threshold AND actual_label = 0) AS tn"""


def sweep(by: list[str], source: str = "scored", labelled: bool = True, steps: int = 200) -> list[str]:
    """CTEs ending in ``sweep``: every threshold rescans the rows of its group."""
    metrics = METRICS if labelled else NO_LABELS
    return [
        f"""grp AS (SELECT {cols(by)} min(similarity_score) AS lo,
          greatest(least({steps}, count(*)), 1) AS steps FROM {source} {group(by)})""",
        f"""grid AS (SELECT {cols(by)} i::INTEGER AS threshold_idx,
          CASE WHEN steps > 1 AND i = steps - 1 THEN 1::DOUBLE WHEN steps = 1 THEN lo
               ELSE i::DOUBLE * ((1::DOUBLE - lo) / (steps - 1)::DOUBLE) + lo END AS threshold
          FROM (SELECT *, unnest(range(steps)) AS i FROM grp))""",
        f"""counted AS (SELECT {cols(by, 'grid.')} threshold_idx, threshold, {COUNTS}
          FROM grid JOIN (SELECT * {'' if labelled else ', NULL AS actual_label'} FROM {source}) s
          ON {same('grid', 's', by)}
          GROUP BY {cols(by, 'grid.')} threshold_idx, threshold)""",
        f"sweep AS (SELECT {cols(by)} threshold_idx, threshold, {metrics} FROM (SELECT {RATIOS} FROM counted))",
    ]


AT = "thresholds(threshold) AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]))"
add("metrics_at_thresholds", SCORED, AT,
    f"counted AS (SELECT model, threshold, {COUNTS} FROM scored, thresholds GROUP BY ALL)",
    select=f"SELECT model, threshold, {METRICS} FROM (SELECT {RATIOS} FROM counted)")
add("hit_ratio_at_thresholds", SCORED, AT,
    select="""SELECT threshold, (count(*) FILTER (similarity_score >= threshold))::DOUBLE / count(*) AS cache_hit_ratio
    FROM scored, thresholds GROUP BY threshold""")
UNLABELLED = "bare AS (SELECT * EXCLUDE (actual_label) FROM scored)"
add("sweep_unlabelled", SCORED, UNLABELLED, *sweep([], "bare", labelled=False), select="SELECT * FROM sweep")
add("sweep_labelled", SCORED, *sweep([]), select="SELECT * FROM sweep")
add("sweep_grouped", SCORED, *sweep(RUN_KEYS), select="SELECT * FROM sweep")
add("sweep_discrete_scores",
    """scored AS (SELECT l_linenumber AS run, l_quantity / 50 AS similarity_score,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual_label FROM lineitem)""",
    *sweep(["run"], steps=101), select="SELECT * FROM sweep")
add("sweep_custom_metric", SCORED, *sweep(["model"]),
    select=f"SELECT model, threshold_idx, threshold, {f_beta('precision', 'recall', 2.0)} AS f2_score FROM sweep")


def summary(by: list[str], source: str = "scored") -> str:
    return f"""SELECT {cols(by)} count(*) AS n, min(similarity_score) AS min_score,
      max(similarity_score) AS max_score, round(avg(similarity_score), 9) AS mean_score,
      median(similarity_score) AS median_score FROM {source} {group(by)}"""


add("summary_of_scores", SCORED, select=summary([]))
add("summary_of_scores_grouped", SCORED, select=summary(["dataset", "model"]))


# ---- curves -----------------------------------------------------------------------------------


def area(by: list[str], x: str, source: str, name: str, y: str = "precision",
         order: str = "cache_hit_ratio, threshold_idx") -> str:
    w = f"OVER ({part(by)} ORDER BY {order})"
    return f"""{name} AS (SELECT {cols(by)} coalesce(sum(dx * y2 / 2), 0) AS auc FROM (
        SELECT {cols(by)} {x} - lag({x}) {w} AS dx, {y} + lag({y}) {w} AS y2 FROM {source}) {group(by)})"""


def kept(by: list[str]) -> str:
    return f"""kept AS (SELECT * FROM (SELECT *, max(threshold_idx) OVER ({part(by)}) AS last_idx,
        count(*) OVER ({part(by)}) - 1 AS n_kept FROM sweep) WHERE threshold_idx < last_idx)"""


def resampled(by: list[str]) -> list[str]:
    return [
        kept(by),
        "usable AS (SELECT * FROM kept WHERE n_kept >= 2)",
        f"""points AS (SELECT {cols(by)} i::INTEGER AS grid_i,
            CASE WHEN i = 99 THEN 1::DOUBLE ELSE i::DOUBLE * (1::DOUBLE / 99) END AS grid_x
            FROM (SELECT DISTINCT {', '.join(by)} FROM usable), range(100) r(i))""",
        f"""sides AS (SELECT {cols(by, 'g.')} g.grid_i, g.grid_x,
            max({{'x': u.cache_hit_ratio, 'i': u.threshold_idx, 'y': u.precision}})
              FILTER (u.cache_hit_ratio <= g.grid_x) AS l,
            min({{'x': u.cache_hit_ratio, 'i': u.threshold_idx, 'y': u.precision}})
              FILTER (u.cache_hit_ratio > g.grid_x) AS r
            FROM points g JOIN usable u ON {same('g', 'u', by)} GROUP BY ALL)""",
        f"""curve AS (SELECT {cols(by)} grid_i, grid_x,
            CASE WHEN l IS NULL THEN r.y WHEN r IS NULL OR l.x = grid_x THEN l.y
                 ELSE (r.y - l.y) / (r.x - l.x) * (grid_x - l.x) + l.y END AS precision FROM sides)""",
    ]


add("auc_raw", SCORED, *sweep(RUN_KEYS), kept(RUN_KEYS), area(RUN_KEYS, "cache_hit_ratio", "kept", "a"),
    select="SELECT dataset, model, run, round(auc, 9) AS auc FROM a")
add("auc_all_thresholds", SCORED, *sweep(RUN_KEYS), area(RUN_KEYS, "cache_hit_ratio", "sweep", "a"),
    area(RUN_KEYS, "recall", "sweep", "b"),
    select="""SELECT a.dataset, a.model, a.run, round(a.auc, 9) AS auc_hit_ratio, round(b.auc, 9) AS auc_recall
    FROM a JOIN b USING (dataset, model, run)""")
add("curve_resampled", SCORED, *sweep(["model"]), *resampled(["model"]),
    select="SELECT model, grid_i, grid_x, round(precision, 9) AS precision FROM curve")
AREA_RESAMPLED = area(RUN_KEYS, "grid_x", "curve", "a", order="grid_i")
add("auc_resampled", SCORED, *sweep(RUN_KEYS), *resampled(RUN_KEYS), AREA_RESAMPLED,
    select="SELECT dataset, model, run, round(auc, 9) AS auc FROM a")
add("curve_mean_band", SCORED, *sweep(RUN_KEYS), *resampled(RUN_KEYS),
    """bands AS (SELECT dataset, model, grid_i, grid_x, count(*) AS n_runs, avg(precision) AS m,
       stddev_pop(precision) AS s FROM curve GROUP BY ALL)""",
    select="""SELECT dataset, model, grid_i, grid_x, n_runs, round(m, 7) AS mean_precision,
    round(s, 7) AS std_precision, round(m - s, 7) AS band_low, round(m + s, 7) AS band_high FROM bands""")
RATE = """rate AS (SELECT dataset, (tp + fn)::DOUBLE / (tp + fn + fp + tn) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY model, run, threshold_idx) AS r FROM sweep)
    WHERE r = 1)"""
add("base_rate", SCORED, *sweep(RUN_KEYS), RATE,
    select="""SELECT dataset, b AS base_rate, round(b * (1 - ln(b)), 9) AS auc_uniform_negatives,
    round(b + 0.5::DOUBLE * (1 - b * b), 9) AS auc_zero_negatives FROM rate""")
add("ideal_curves", SCORED, *sweep(RUN_KEYS), RATE,
    """points AS (
      SELECT dataset, b, 'uniform_negatives' AS curve, 0 AS point_i, 0::DOUBLE AS x, 1::DOUBLE AS y FROM rate
      UNION ALL SELECT dataset, b, 'uniform_negatives', i + 1, px, b / px FROM (SELECT *,
        CASE WHEN i = 99 THEN 1::DOUBLE ELSE i::DOUBLE * ((1::DOUBLE - b) / 99) + b END AS px
        FROM rate, range(100) r(i))
      UNION ALL SELECT dataset, b, 'zero_negatives', 0, 0, 1 FROM rate
      UNION ALL SELECT dataset, b, 'zero_negatives', 1, b, 1 FROM rate
      UNION ALL SELECT dataset, b, 'zero_negatives', 2, 1, b FROM rate)""",
    select="""SELECT dataset, curve, point_i::INTEGER AS point_i, round(x, 9) AS x, round(y, 9) AS y,
    round(CASE curve WHEN 'uniform_negatives' THEN b * (1 - ln(b)) ELSE b + 0.5::DOUBLE * (1 - b * b) END, 9) AS auc
    FROM points""")


# ---- densities --------------------------------------------------------------------------------


def bins(by: list[str], source: str = "scored", data_range: bool = False) -> list[str]:
    span = ("min(similarity_score) AS lo, max(similarity_score) AS hi" if data_range
            else "0::DOUBLE AS lo, 1::DOUBLE AS hi")
    return [
        f"span AS (SELECT {cols(by)} {span} FROM {source} {group(by)})",
        f"""edges AS (SELECT {cols(by)} i::INTEGER AS bin, i::DOUBLE * ((hi - lo) / 100) + lo AS l,
            CASE WHEN i = 99 THEN hi ELSE (i + 1)::DOUBLE * ((hi - lo) / 100) + lo END AS r
            FROM span, range(100) x(i))""",
        f"""raw_bins AS (SELECT {cols(by, 'e.')} e.bin, e.l, e.r, count(*) FILTER (actual_label = 1) AS n_pos,
            count(*) FILTER (actual_label = 0) AS n_neg
            FROM edges e LEFT JOIN {source} s ON {same('e', 's', by)} AND s.similarity_score >= e.l
              AND (s.similarity_score < e.r OR (e.bin = 99 AND s.similarity_score = e.r)) GROUP BY ALL)""",
        f"""bins AS (SELECT *, (l + r) / 2 AS center, r - l AS width,
            n_pos / (r - l) / nullif(sum(n_pos) OVER ({part(by)}), 0) AS pos_density,
            n_neg / (r - l) / nullif(sum(n_neg) OVER ({part(by)}), 0) AS neg_density FROM raw_bins)""",
        f"""laps AS (SELECT {cols(by)}
            sum(CASE WHEN pos_density IS NOT NULL AND neg_density IS NOT NULL
                THEN least(pos_density, neg_density) * width END) AS overlap,
            sum(abs(pos_density - neg_density) * width) * 0.5 AS total_variation,
            sum(pos_density * width) AS pos_mass, sum(neg_density * width) AS neg_mass
            FROM bins {group(by)})""",
    ]


BIN_SELECT = """SELECT model, bin, round(center, 9) AS center, n_pos, n_neg,
    round(pos_density, 7) AS pos_density, round(neg_density, 7) AS neg_density FROM bins"""
add("density_fixed", SCORED, *bins(["model"]), select=BIN_SELECT)
add("density_on_edges",
    """scored AS (SELECT l_linestatus AS model, l_quantity * 0.03::DOUBLE AS similarity_score,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual_label FROM lineitem)""",
    *bins(["model"]), select=BIN_SELECT)
add("density_range", SCORED, *bins(["model"], data_range=True), select=BIN_SELECT)
add("overlap_per_run", SCORED, *bins(RUN_KEYS),
    select="SELECT dataset, model, run, round(overlap, 9) AS overlap FROM laps")
add("total_variation", SCORED, *bins(["dataset"], data_range=True),
    select="""SELECT dataset, round(overlap, 9) AS overlap, round(total_variation, 9) AS total_variation,
    round(pos_mass, 9) AS pos_mass, round(neg_mass, 9) AS neg_mass,
    CASE WHEN abs(overlap - (1 - total_variation)) < 1e-6 THEN 1 ELSE 0 END AS identity_holds FROM laps""")
add("density_mean", SCORED, *bins(RUN_KEYS),
    """means AS (SELECT dataset, model, bin, count(*) AS n_runs, avg(pos_density) AS p, avg(neg_density) AS m
       FROM bins WHERE pos_density IS NOT NULL AND neg_density IS NOT NULL GROUP BY ALL)""",
    """label AS (SELECT dataset, model, printf('%.3f ± %.3f', avg(overlap), stddev_pop(overlap)) AS overlap_label
       FROM laps GROUP BY ALL)""",
    select="""SELECT dataset, model, bin, n_runs, round(p, 7) AS mean_pos_density,
    round(m, 7) AS mean_neg_density, overlap_label FROM means JOIN label USING (dataset, model)""")
add("label_split", SCORED,
    select="""SELECT dataset, model, run, count(*) FILTER (actual_label = 1) AS n_pos,
    count(*) FILTER (actual_label = 0) AS n_neg,
    (count(*) FILTER (actual_label = 1))::DOUBLE / count(*) AS positive_share FROM scored GROUP BY ALL""")
add("chart_class_densities", SCORED, *bins(["model"], data_range=True),
    select="""SELECT model, bin, round(pos_density, 7) AS pos_density, round(neg_density, 7) AS neg_density,
    round(overlap, 9) AS overlap, round(total_variation, 9) AS total_variation FROM bins JOIN laps USING (model)""")


# ---- leaderboard ------------------------------------------------------------------------------

BOARD = [
    *sweep(RUN_KEYS), kept(RUN_KEYS), area(RUN_KEYS, "cache_hit_ratio", "kept", "a"), *bins(RUN_KEYS),
    """stats AS (SELECT dataset, model, count(*) AS n_runs, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std,
       avg(overlap) AS overlap_mean, stddev_pop(overlap) AS overlap_std
       FROM a FULL JOIN laps USING (dataset, model, run) GROUP BY dataset, model)""",
]
STATS = """SELECT dataset, model, n_runs, round(auc_mean, 7) AS auc_mean, round(auc_std, 7) AS auc_std,
    round(overlap_mean, 7) AS overlap_mean, round(overlap_std, 7) AS overlap_std FROM stats"""


def cells(metric: str, best: str) -> str:
    return f"""cells AS (SELECT d.dataset, m.model,
        coalesce(abs({metric}_mean - {best}({metric}_mean) OVER (PARTITION BY d.dataset)) < 1e-6, FALSE) AS is_best,
        coalesce(printf('%.3f ± %.3f', {metric}_mean, {metric}_std), '-') AS cell, {metric}_mean
        FROM (SELECT DISTINCT dataset FROM stats) d CROSS JOIN (SELECT DISTINCT model FROM stats) m
        LEFT JOIN stats s ON s.dataset = d.dataset AND s.model = m.model)"""


add("run_statistics", SCORED, *BOARD, select=STATS)
add("leaderboard_long", SCORED, *BOARD, cells("auc", "max"),
    select="""SELECT dataset, model, replace(replace(dataset, '_test.csv', ''), '_', '\\_') AS dataset_title,
    CASE WHEN model LIKE '%gte-modernbert%' THEN 'ModernBERT' ELSE 'v3.1' END AS model_title,
    cell, is_best::INTEGER AS is_best FROM cells""")
add("leaderboard_pivot", SCORED, *BOARD, cells("overlap", "min"),
    select="""SELECT dataset,
    max(CASE WHEN model = 'lab/cache-embed-v3.1' THEN cell || CASE WHEN is_best THEN '*' ELSE '' END END) AS cache_embed,
    max(CASE WHEN model = 'lab/gte-modernbert-base' THEN cell || CASE WHEN is_best THEN '*' ELSE '' END END) AS modernbert
    FROM cells GROUP BY dataset""")
add("best_model", SCORED, *BOARD, cells("overlap", "min"),
    select="SELECT dataset, model, round(overlap_mean, 7) AS overlap_mean FROM cells WHERE is_best")


# ---- names ------------------------------------------------------------------------------------

STAMP = r"_\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}.*$"
add("model_names",
    """named AS (SELECT o_orderkey, CASE o_orderstatus
         WHEN 'F' THEN 'neural_Alibaba-NLP_gte-modernbert-v' || v
         WHEN 'O' THEN 'Alibaba-NLP_cache-v' || v || '_' || stamp
         ELSE 'neural_own_cache-v' || v || '_' || stamp END AS folder
       FROM (SELECT *, substr(o_orderpriority, 1, 1) AS v,
             strftime(o_orderdate, '%Y_%m_%d_%H_%M_%S') AS stamp FROM orders))""",
    f"""models AS (SELECT *, CASE WHEN name LIKE 'Alibaba-NLP\\_%' ESCAPE '\\'
          THEN 'Alibaba-NLP/' || substr(name, 13) ELSE bare END AS model,
          CASE WHEN bare LIKE 'Alibaba-NLP\\_%' ESCAPE '\\'
          THEN 'Alibaba-NLP/' || substr(bare, 13) ELSE bare END AS bare_model
        FROM (SELECT *, regexp_replace(name, '{STAMP}', '') AS bare FROM (
          SELECT *, regexp_replace(folder, '^neural_', '') AS name FROM named)))""",
    select="""SELECT o_orderkey, folder, model, bare_model,
    CASE WHEN contains(model, 'gte-modernbert') THEN 'ModernBERT' WHEN contains(model, 'v1') THEN 'v1'
         WHEN contains(model, 'v2') THEN 'v2' WHEN contains(model, 'v3.1') THEN 'v3.1'
         WHEN contains(model, 'v3') THEN 'v3' ELSE list_last(string_split(model, '/')) END AS short_name,
    replace(model, '/', '_') AS safe_name FROM models""")
add("dataset_names",
    """named AS (SELECT page_id, list_last(string_split(
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')) AS name FROM pages)""",
    select="""SELECT page_id, replace(name || '_test', '.csv', '') AS dataset,
    replace(name, '_', '\\_') AS display, string_split(name || '_', '_')[1] AS title FROM named""")


# ---- sampling ---------------------------------------------------------------------------------


def ranked(source: str, key: str, seed: str = "42", columns: str = "*", where: str = "TRUE") -> str:
    return f"""(SELECT {columns}, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) AS rn
        FROM {source} WHERE {where})"""


def position(seed: str, key: str) -> str:
    return f"('0x' || substr(md5({seed} || '|' || {key}), 1, 15))::BIGINT"


add("split_sample_n", select=f"SELECT doc_id, lang FROM {ranked('documents', 'doc_id')} WHERE rn <= 100")
add("split_sample_half",
    select=f"""SELECT o_orderstatus, (rn <= (SELECT count(*) // 2 FROM orders))::INTEGER AS in_sample,
    count(*) AS n, min(o_orderkey) AS first_key, sum(o_orderkey)::BIGINT AS sum_keys
    FROM {ranked('orders', 'o_orderkey', '7')} GROUP BY ALL""")
add("split_pass_through", select="SELECT item_id, text FROM benchmark")
add("split_complement",
    select=f"""SELECT doc_id, (rn <= 100)::INTEGER AS is_query,
    CASE WHEN rn > 100 THEN {position("'42'", 'doc_id')} END AS cache_pos FROM {ranked('documents', 'doc_id')}""")
add("split_explicit_cache",
    select=f"""SELECT 'query' AS side, doc_id FROM {ranked('documents', 'doc_id')} WHERE rn <= 100
    UNION ALL SELECT 'cache', item_id FROM benchmark""")
add("split_overlap_audit", f"r AS (SELECT * FROM {ranked('documents', 'doc_id')})",
    select="""SELECT 'doc_id' AS column_name, count(*) AS n FROM (
      SELECT doc_id FROM r WHERE rn <= 100 INTERSECT SELECT doc_id FROM r WHERE rn > 100)
    UNION ALL SELECT 'text', count(*) FROM (
      SELECT text FROM r WHERE rn <= 100 INTERSECT SELECT text FROM r WHERE rn > 100)""")


def bootstrap(source: str, key: str, runs: int, share: str, n: int, columns: str = "") -> list[str]:
    return [
        f"""universe AS (SELECT * FROM (SELECT {key} AS id {columns}, run,
            row_number() OVER (PARTITION BY run ORDER BY md5(run || '|' || {key}), {key}) AS r,
            count(*) OVER (PARTITION BY run) AS total FROM {source}, range(1, {runs + 1}) x(run))
            WHERE r <= round_even({share}::DOUBLE * total, 0))""",
        f"""runs AS (SELECT * EXCLUDE (r), r2 <= {n} AS is_query, {position('(run + 2000)', 'id')} AS pos FROM (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5((run + 1000) || '|' || id), id) AS r2,
            count(*) OVER (PARTITION BY run) AS size FROM universe) WHERE size > {n})""",
    ]


add("bootstrap_split", *bootstrap("documents", "doc_id", 5, "0.8", 100),
    select="""SELECT run::INTEGER AS run, id AS doc_id, is_query::INTEGER AS is_query,
    CASE WHEN NOT is_query THEN pos END AS cache_pos FROM runs""")
add("bootstrap_sizes", "turns AS (SELECT conv_id * 1000 + turn AS turn_id FROM conversations)",
    *bootstrap("turns", "turn_id", 3, "0.5", 50),
    select="""SELECT run::INTEGER AS run, count(*) FILTER (is_query) AS n_queries,
    count(*) FILTER (NOT is_query) AS n_cache FROM runs GROUP BY run""")


# ---- vectors and matching ---------------------------------------------------------------------

add("vector_norms",
    """n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
       FROM embeddings)""",
    select="""SELECT vec_id, len(embedding)::INTEGER AS n_dims, round(norm, 5) AS norm,
    round(sqrt(list_sum(list_transform(embedding, lambda x: (x / norm)::FLOAT::DOUBLE * (x / norm)::FLOAT::DOUBLE))), 5)
      AS unit_norm FROM n""")
add("vector_dims",
    select="""SELECT count(embedding) AS n_vectors, min(len(embedding))::INTEGER AS min_dim,
    max(len(embedding))::INTEGER AS max_dim, (min(len(embedding)) = max(len(embedding)))::INTEGER AS same_dim
    FROM embeddings""")
add("vector_pairs",
    """p AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot,
       list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    select="""SELECT vec_id, round(dot, 6) AS dot, round(sim, 6) AS similarity, round(1 - sim, 6) AS distance,
    round(1 - (1 - sim), 6) AS from_distance FROM p""")
VEC_ROWS = """rows AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v,
    row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS rn FROM embeddings)"""


def best(query: str, cache: str, pos: str, k: int = 1, on: str = "TRUE", carry: str = "") -> list[str]:
    """CTEs ending in ``best``: every pair is scored and ranked."""
    return [
        f"""pairs AS (SELECT q.id AS qid, c.id AS cid, {pos} AS pos, {carry}
            list_cosine_similarity(q.v, c.v) AS score
            FROM (SELECT * FROM {query}) q JOIN (SELECT * FROM {cache}) c ON {on})""",
        f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid {', run' if carry else ''}
            ORDER BY round(score, 9) DESC, pos, cid) AS rnk FROM pairs) WHERE rnk <= {k})""",
    ]


POS = position("'42'", "c.id")
SPLIT_BEST = best("rows WHERE rn <= 100", "rows WHERE rn > 100", POS)
TOP1 = "SELECT qid AS vec_id, cid AS match_id, round(score, 6) AS best_scores"
add("match_top1", VEC_ROWS, *SPLIT_BEST, select=f"{TOP1}, 'neural' AS decision_method FROM best")
add("match_top1_block", VEC_ROWS, *SPLIT_BEST, select=f"{TOP1} FROM best")
add("match_top1_small_cache", VEC_ROWS, *best("rows WHERE rn > 100", "rows WHERE rn <= 100", "c.id"),
    select=f"{TOP1} FROM best")
add("match_topk", VEC_ROWS, *best("rows WHERE rn <= 100", "rows WHERE rn > 100", POS, k=5),
    select=f"{TOP1}, rnk::INTEGER AS rank FROM best")
add("index_search", VEC_ROWS, *best("rows WHERE rn <= 100", "rows WHERE rn > 100", "c.id", k=3),
    select="""SELECT qid AS vec_id, rnk::INTEGER AS rank, round(1 - score, 6) AS vector_distance,
    'cache:' || cid AS id, cid || '#' || label AS text, label FROM best JOIN rows r ON r.id = cid""")
LEFT_IN_INDEX = "rows WHERE rn > 100 AND (label <> 2 OR md5('42|' || id) < 'a')"
add("index_updated", VEC_ROWS, *best("rows WHERE rn <= 100", LEFT_IN_INDEX, "c.id", k=3),
    select=f"""SELECT qid AS vec_id, rnk::INTEGER AS rank, round(1 - score, 6) AS vector_distance,
    'cache:' || cid AS id, CASE WHEN label < 2 THEN 'new ' ELSE '' END || cid || '#' || label AS text, label,
    (SELECT count(*) FROM {LEFT_IN_INDEX}) AS n_rows FROM best JOIN rows r ON r.id = cid""")
add("index_match", VEC_ROWS, *best("rows WHERE rn <= 100", "rows WHERE rn > 100", "c.id"),
    select="""SELECT qid AS vec_id, qid || '#' || q.label AS text, cid || '#' || c.label AS matches,
    round(score, 6) AS best_scores FROM best JOIN rows q ON q.id = qid JOIN rows c ON c.id = cid""")
SELF = "q.id <> c.id"
add("match_topk_block", VEC_ROWS, *best("rows", "rows", "c.id", k=3, on=SELF),
    select=f"{TOP1}, rnk::INTEGER AS rank FROM best")
add("match_self", VEC_ROWS, *best("rows", "rows", "c.id", on=SELF), select=f"{TOP1} FROM best")
ORACLES["match_self_block"] = ORACLES["match_self"]
add("match_offset_self", VEC_ROWS, *best("rows", "rows", "c.id", on=SELF),
    select="SELECT qid - 1 AS vec_id, cid AS match_id, round(score, 6) AS best_scores FROM best")
add("first_rows", VEC_ROWS,
    *best("(SELECT * FROM rows ORDER BY id LIMIT 50)", "rows", "c.id", on=SELF), select=f"{TOP1} FROM best")


def text_vectors(source: str, name: str = "rows") -> list[str]:
    """CTEs ending in ``name``: id, text, token counts per bucket, norm and seeded rank."""
    t = name
    return [
        f"{t}_src AS ({source})",
        f"""{t}_tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {t}_src)""",
        f"""{t}_tf AS (SELECT id, ('0x' || substr(md5(t), 1, 6))::BIGINT % 256 AS b, count(*)::DOUBLE AS c
            FROM {t}_tok GROUP BY ALL)""",
        f"""{t} AS (SELECT s.id, any_value(s.text) AS text, list(coalesce(f.c, 0) ORDER BY x.b) AS v,
            sqrt(coalesce(sum(f.c * f.c), 0)) AS norm,
            row_number() OVER (ORDER BY md5('42|' || s.id), s.id) AS rn
            FROM {t}_src s CROSS JOIN range(256) x(b) LEFT JOIN {t}_tf f ON f.id = s.id AND f.b = x.b
            GROUP BY s.id)""",
    ]


def text_best(query: str, cache: str, pos: str, on: str = "TRUE") -> list[str]:
    return [
        f"""pairs AS (SELECT q.id AS qid, c.id AS cid, {pos} AS pos,
            CASE WHEN q.norm * c.norm > 0 THEN list_dot_product(q.v, c.v) / (q.norm * c.norm) ELSE 0 END AS score
            FROM (SELECT * FROM {query}) q JOIN (SELECT * FROM {cache}) c ON {on})""",
        """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid
            ORDER BY round(score, 9) DESC, pos, cid) AS rnk FROM pairs) WHERE rnk = 1)""",
    ]


DOCS = "SELECT doc_id AS id, text FROM documents"
BENCH = "SELECT item_id AS id, text FROM benchmark"
DOC_SPLIT = [*text_vectors(DOCS), *text_best("rows WHERE rn <= 100", "rows WHERE rn > 100", POS)]
DOC_BENCH = [*text_vectors(DOCS), *text_vectors(BENCH, "bench"), *text_best("rows", "bench", "c.id")]
add("text_match", *DOC_SPLIT,
    select="""SELECT qid AS doc_id, cid AS match_id, md5(r.text) AS match_md5, round(score, 6) AS best_scores
    FROM best JOIN rows r ON r.id = cid""")
add("text_match_explicit_cache", *DOC_BENCH,
    select="SELECT qid AS doc_id, cid AS match_id, round(score, 6) AS best_scores FROM best")
add("index_match_text", *DOC_BENCH,
    select="""SELECT qid AS doc_id, c.text AS matches, round(score, 6) AS best_scores
    FROM best JOIN bench c ON c.id = cid""")
add("text_self_match", *text_vectors(DOCS), *text_best("rows", "rows", "c.id", on=SELF),
    select="SELECT qid AS doc_id, cid AS match_id, round(score, 6) AS best_scores FROM best")
ORACLES["text_self_match_block"] = ORACLES["text_self_match"]
add("conversation_match",
    *text_vectors("SELECT conv_id * 1000 + turn AS id, text FROM conversations"),
    *text_best("rows WHERE rn <= 100", "rows WHERE rn > 100", POS),
    select="""SELECT q.id AS turn_id, q.text, coalesce(c.text, '') AS matches, coalesce(round(score, 6), 0) AS best_scores
    FROM rows q LEFT JOIN best ON qid = q.id LEFT JOIN rows c ON c.id = cid WHERE q.rn <= 100""")
TURN = "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = "
add("match_no_hit", *text_vectors(f"{TURN} 'user'"), *text_vectors(f"{TURN} 'system'", "sys"),
    *text_best("rows", "sys", "c.id", on="q.id // 1000 = c.id // 1000"),
    select="""SELECT q.id AS turn_id, q.id // 1000 AS conv_id, coalesce(c.text, '') AS matches,
    coalesce(round(score, 6), 0) AS best_scores FROM rows q LEFT JOIN best ON qid = q.id
    LEFT JOIN sys c ON c.id = cid""")
add("encode_distinct_texts",
    "texts AS (SELECT text, count(*) AS n_rows, min(doc_id) AS id FROM documents GROUP BY text)",
    *text_vectors("SELECT id, text FROM texts"),
    select="""SELECT md5(t.text) AS text_md5, n_rows, list_sum(v)::BIGINT AS n_tokens, round(norm, 6) AS norm
    FROM rows JOIN texts t USING (id)""")
add("encode_with_model",
    """m AS (SELECT doc_id, length(text) AS c, length(text) - length(replace(text, ' ', '')) AS s FROM documents)""",
    select="""SELECT doc_id, c::BIGINT AS n_chars, s::BIGINT AS n_spaces,
    round((s / sqrt(c::DOUBLE * c + s::DOUBLE * s + 1))::FLOAT::DOUBLE, 5) AS unit_spaces FROM m""")


# ---- judging ----------------------------------------------------------------------------------

VERDICTS = """verdicts AS (SELECT d.doc_id, source, lang,
    CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS response
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
FIRST = """firsts AS (SELECT source, lang, arg_min(response, doc_id) AS response FROM verdicts
    WHERE response IS NOT NULL GROUP BY source, lang)"""
add("judge_dedup", VERDICTS, FIRST, select="SELECT source, lang, response FROM firsts")
add("judge_failures", VERDICTS,
    select="SELECT count(*) AS n_pairs, count(*) FILTER (response IS NULL) AS n_failed FROM verdicts")
add("judge_join", VERDICTS, FIRST,
    select="""SELECT doc_id, d.source, d.lang, n_chars / 200000 AS similarity_score,
    coalesce((response = 'yes')::INTEGER, 0) AS actual_label FROM documents d LEFT JOIN firsts f
    ON f.source = d.source AND f.lang = d.lang""")
add("judge_join_usable_only", VERDICTS,
    select="""SELECT doc_id::VARCHAR AS text, lang, 0.5::DOUBLE AS similarity_score,
    (response = 'yes')::INTEGER AS actual_label FROM verdicts WHERE response IS NOT NULL""")
SHARED_WORDS = (
    r"""said AS (SELECT qid AS doc_id, cid AS match_id, q.text AS text,
       list_distinct(regexp_extract_all(lower(q.text), '[^\x20\x09-\x0D]+')) AS a,
       list_distinct(regexp_extract_all(lower(c.text), '[^\x20\x09-\x0D]+')) AS b
       FROM best JOIN rows q ON q.id = qid JOIN bench c ON c.id = cid),
    judged AS (SELECT doc_id, match_id, text, CASE WHEN len(list_intersect(a, b)) = 0 THEN NULL
       WHEN 5 * len(list_intersect(a, b)) >= len(b) THEN 'yes' ELSE 'no' END AS response FROM said)""")
add("judge_udf", *DOC_BENCH, SHARED_WORDS,
    select="""SELECT doc_id, match_id, response, CASE WHEN response IS NULL THEN 'no answer' END AS error
    FROM judged""")
add("judge_remembered", *DOC_BENCH, SHARED_WORDS,
    select="""SELECT j.doc_id, match_id, response, response IS NULL OR NOT EXISTS (
      SELECT * FROM judged e JOIN documents d ON d.doc_id = e.doc_id
      WHERE d.lang = 'en' AND e.text = j.text AND e.match_id = j.match_id) AS asked FROM judged j""")


# ---- sources and sinks ------------------------------------------------------------------------

add("csv_round_trip",
    select="SELECT doc_id, md5(text) AS text_md5, length(text)::INTEGER AS n_chars, lang FROM documents")
ORACLES["csv_round_trip_gzip"] = ORACLES["csv_round_trip_split"] = ORACLES["csv_round_trip"]
add("csv_missing_values",
    select="SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders")
add("runs_partitioned", SCORED, *sweep(RUN_KEYS),
    select="""SELECT dataset, model, run, count(*) AS n_thresholds, sum(tp)::BIGINT AS sum_tp
    FROM sweep GROUP BY dataset, model, run""")
TREE = """tree AS (SELECT 'ships_test' AS dataset,
      CASE WHEN l_linestatus = 'F' THEN 'Alibaba-NLP/gte-modernbert-base' ELSE 'own-cache-v3.1' END AS model,
      CASE WHEN l_linestatus = 'F' THEN 'run_' || l_linenumber
           ELSE 'own-cache-v3.1_2024_01_01_00_00_0' || l_linenumber END AS run,
      l_extendedprice / 120000 AS similarity_score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual_label
    FROM lineitem)"""
TREE_JUDGED = "scored AS (SELECT * FROM tree WHERE model <> 'own-cache-v3.1')"
add("results_tree_scan", TREE, TREE_JUDGED, *sweep(RUN_KEYS, "tree"), kept(RUN_KEYS),
    area(RUN_KEYS, "cache_hit_ratio", "kept", "a"), *bins(RUN_KEYS), BOARD[-1], select=STATS)
add("results_tree_runs", TREE,
    select="""SELECT dataset, model, run,
    CASE WHEN model <> 'own-cache-v3.1' THEN '2024_01_02_00_00_00' ELSE '' END AS ts,
    CASE WHEN model <> 'own-cache-v3.1' THEN count(*) END AS n_judged FROM tree GROUP BY dataset, model, run""")


# ---- charts and checks ------------------------------------------------------------------------

add("chart_precision_vs_hit_ratio", SCORED, *sweep(["model"]),
    select="SELECT model, threshold_idx, cache_hit_ratio, precision FROM sweep")
add("chart_metrics_over_threshold", SCORED, *sweep(["model"]),
    select="""SELECT model, threshold_idx, threshold, 'precision' AS metric, precision AS value FROM sweep
    UNION ALL SELECT model, threshold_idx, threshold, 'cache_hit_ratio', cache_hit_ratio FROM sweep
    UNION ALL SELECT model, threshold_idx, threshold, 'correct_hit_ratio', precision * cache_hit_ratio FROM sweep""")
add("chart_hit_ratio", SCORED, *sweep(["model"]),
    select="SELECT model, threshold_idx, threshold, cache_hit_ratio FROM sweep")
add("check_matches", VEC_ROWS, *SPLIT_BEST,
    select="""SELECT count(*) AS n_rows, count(*) FILTER (abs(score) > 1 + 1e-6) AS n_bad_scores,
    count(*) FILTER (cid IS NULL) AS n_missing_matches FROM best""")
add("check_hit_ratio", SCORED, *sweep(RUN_KEYS),
    select="""SELECT dataset, model, run, count(*) AS n_rows,
    count(*) FILTER (cache_hit_ratio < 0 OR cache_hit_ratio > 1) AS n_out_of_range,
    count(*) FILTER (cache_hit_ratio > before) AS n_rising FROM (
      SELECT *, lag(cache_hit_ratio) OVER (PARTITION BY dataset, model, run ORDER BY threshold_idx) AS before
      FROM sweep) GROUP BY dataset, model, run""")
add("check_label_metrics", SCORED, *sweep(RUN_KEYS),
    select="SELECT dataset, model, run, count(precision) AS n_labelled_rows, " + ", ".join(
        f"count(*) FILTER ({m} < 0 OR {m} > 1) AS n_bad_{m}"
        for m in ("precision", "recall", "f1_score", "f0_5_score", "f05_chr_score", "accuracy"))
    + ", min(tp + fp + fn + tn) AS min_total, max(tp + fp + fn + tn) AS max_total FROM sweep GROUP BY ALL")
add("check_expectations", *DOC_BENCH,
    """found AS (SELECT q.text AS query, arg_min({'m': c.text, 's': round(score, 6)}, qid) AS f
       FROM best JOIN rows q ON q.id = qid JOIN bench c ON c.id = cid GROUP BY q.text)""",
    """wanted AS (SELECT DISTINCT text AS query, split_part(text, ' ', 1) AS expected FROM documents)""",
    select="""SELECT md5(query) AS query_md5, expected, f.s AS score FROM wanted JOIN found USING (query)
    WHERE (contains(lower(f.m), lower(expected)) OR contains(lower(expected), lower(f.m))) AND f.s < 0.9""")


# ---- jobs -------------------------------------------------------------------------------------

JUDGED = """scored AS (SELECT round(score, 6) AS similarity_score, q.label AS ql, c.label AS cl, qid, cid,
    (q.label = c.label)::INTEGER AS actual_label FROM best JOIN rows q ON q.id = qid JOIN rows c ON c.id = cid)"""
EVALUATED = [VEC_ROWS, *SPLIT_BEST, JUDGED]
add("full_eval", *EVALUATED, *sweep([]), select="SELECT * FROM sweep")
add("full_eval_judged", *EVALUATED,
    select="""SELECT qid || '#' || ql AS text, cid || '#' || cl AS matches, similarity_score, actual_label
    FROM scored""")
add("chr_eval", *EVALUATED, *sweep([], labelled=False, source="(SELECT similarity_score FROM scored)"),
    select="SELECT * FROM sweep")
add("chr_eval_summary", *EVALUATED, select=summary([]))
add("chr_eval_text", *DOC_SPLIT, "scored AS (SELECT round(score, 6) AS similarity_score FROM best)",
    *sweep([], labelled=False), select="SELECT * FROM sweep")
BOOT = [
    """models AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, 'signed' AS model FROM embeddings
       UNION ALL SELECT vec_id, label, list_transform(embedding, lambda x: abs(x)::DOUBLE), 'absolute' FROM embeddings)""",
    *bootstrap("embeddings", "vec_id", 5, "0.8", 100),
    """pairs AS (SELECT m.model, q.run, q.id AS qid, c.id AS cid, c.pos, m.label AS ql, d.label AS cl,
       list_cosine_similarity(m.v, d.v) AS score
       FROM runs q JOIN runs c ON c.run = q.run AND q.is_query AND NOT c.is_query
       JOIN models m ON m.vec_id = q.id JOIN models d ON d.vec_id = c.id AND d.model = m.model)""",
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, run, qid
       ORDER BY round(score, 9) DESC, pos, cid) AS rnk FROM pairs) WHERE rnk = 1)""",
]
add("bootstrap_matches", *BOOT,
    select="""SELECT model, run::INTEGER AS run, qid AS vec_id, cid AS match_id, round(score, 6) AS best_scores
    FROM best""")
add("bootstrap_benchmark", *BOOT,
    """scored AS (SELECT 'vectors' AS dataset, model, run, round(score, 6) AS similarity_score,
       (ql = cl)::INTEGER AS actual_label FROM best)""",
    *BOARD, select=STATS)
add("evaluation_files", *EVALUATED,
    select="""SELECT qid || '#' || ql AS text, cid || '#' || cl AS matches, similarity_score, actual_label,
    similarity_score AS best_scores FROM scored""")


def text_bootstrap(name: str, source: str) -> list[str]:
    """CTEs ending in ``<name>_best``: two runs of 50 queries against the rest of 80 %."""
    universe, runs = bootstrap(f"{name}_src", "id", 2, "0.8", 50)
    return [
        *text_vectors(source, name),
        universe.replace("universe AS", f"{name}_universe AS"),
        runs.replace("runs AS", f"{name}_runs AS").replace("FROM universe", f"FROM {name}_universe"),
        f"""{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, qid
            ORDER BY round(score, 9) DESC, pos, cid) AS rnk FROM (
              SELECT q.run, q.id AS qid, c.id AS cid, c.pos, CASE WHEN a.norm * b.norm > 0
                THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) ELSE 0 END AS score
              FROM {name}_runs q JOIN {name}_runs c ON c.run = q.run AND q.is_query AND NOT c.is_query
              JOIN {name} a ON a.id = q.id JOIN {name} b ON b.id = c.id)) WHERE rnk = 1)""",
    ]


add("bootstrap_benchmark_text",
    *text_bootstrap("docs", DOCS),
    *text_bootstrap("turns", "SELECT conv_id * 1000 + turn AS id, text FROM conversations"),
    """scored AS (SELECT 'documents' AS dataset, 'tokens' AS model, run::INTEGER AS run,
       round(score, 6) AS similarity_score FROM docs_best
       UNION ALL SELECT 'turns', 'tokens', run::INTEGER, round(score, 6) FROM turns_best)""",
    select=summary(RUN_KEYS))

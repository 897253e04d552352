"""Independent SQL for the catalogue, for an engine that reads the same tables as views."""

from __future__ import annotations

from itertools import combinations

ORACLES: dict[str, str] = {}

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def hash_int(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def hash_weight(text: str) -> str:
    return f"((CAST({hash_int(text)} AS DOUBLE) / 4294967296.0 - 0.5) * CAST(0.2 AS DOUBLE))"


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def soft(value: str, cut: str) -> str:
    return f"(sign({value}) * greatest(CAST(0 AS DOUBLE), abs({value}) - ({cut})))"


# shared inputs

BASE = f"""base AS (
  SELECT event_id AS row_id, CASE WHEN value > 35 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label,
         CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN day(ts) < 16 THEN 0 ELSE 1 END AS half,
         'type_' || event_type AS f1, 'hour_' || CAST(hour(ts) AS VARCHAR) AS f2,
         'k_' || CAST({K} // 10 AS VARCHAR) AS f3
  FROM events)"""
EX = BASE + """, ex AS (
  SELECT row_id, label, entity_id, half, unnest([f1, f2, f3]) AS feature, CAST(1 AS DOUBLE) AS value FROM base)"""
W0 = EX + f", w0 AS (SELECT feature, {hash_weight('feature')} AS w FROM (SELECT DISTINCT feature FROM ex))"
SCORED = W0 + """, scored AS (
  SELECT row_id, label, half, sum(w * value) AS s FROM ex JOIN w0 USING (feature) GROUP BY row_id, label, half)"""
GRADS = SCORED + """, grads AS (
  SELECT feature, sum(-label / (1 + exp(label * s)) * value) AS g, count(*) AS n
  FROM ex JOIN scored USING (row_id, label, half) GROUP BY feature)"""

CODES = """CAST(c_custkey % 7 AS INTEGER) AS age_group, CAST(c_nationkey % 3 AS INTEGER) AS gender,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
    WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS fans_count_level,
  CAST(c_nationkey % 4 AS INTEGER) AS os, CAST(c_custkey % 4 AS INTEGER) AS network_type"""
USER_INFO = f"user_info AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, {CODES} FROM customer)"
LOGS = f"""parts AS (SELECT count(*) AS n FROM part),
sess AS (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS sid, CAST(user_id AS VARCHAR) AS uid, event_type,
  CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, {K} AS k FROM events),
cand AS (SELECT sid, x, CAST({hash_int("sid || '|' || x")} % n AS VARCHAR) AS c
  FROM (SELECT DISTINCT sid FROM sess), (SELECT unnest(['0','1','2','3','4','x']) AS x), parts),
lists AS (SELECT sid, string_agg(c, ',' ORDER BY x) AS feat_id_list FROM cand WHERE x <> 'x' GROUP BY sid),
imp AS (SELECT sid AS list_session_id, uid AS user_id, min(t) AS timestamp, any_value(feat_id_list) AS feat_id_list
  FROM sess JOIN lists USING (sid) WHERE event_type = 'view' GROUP BY sid, uid),
clk AS (SELECT s.sid AS list_session_id, uid AS user_id, t AS timestamp, c AS feat_id, k % 5 AS position
  FROM sess s JOIN cand d ON s.sid = d.sid AND d.x = CASE WHEN k >= 90 THEN 'x' ELSE CAST(k % 5 AS VARCHAR) END
  WHERE event_type = 'click'),
joined AS (SELECT c.list_session_id, c.user_id, c.timestamp, feat_id_list, feat_id, position
  FROM imp i JOIN clk c ON i.list_session_id = c.list_session_id AND i.user_id = c.user_id)"""
KEPT = LOGS + """, kept AS (
  SELECT list_session_id, user_id, timestamp, feat_id, feat_id_list, string_split(feat_id_list, ',') AS ids,
    CASE WHEN string_split(feat_id_list, ',')[position + 1] = feat_id THEN position
         ELSE list_position(string_split(feat_id_list, ','), feat_id) - 1 END AS position
  FROM joined WHERE list_contains(string_split(feat_id_list, ','), feat_id))"""
KEY = "list_session_id || '|' || user_id || '|' || timestamp || '|' || feat_id || '|' || position"
LABELED = KEPT + f""", keyed AS (SELECT *, {KEY} AS click_key FROM kept),
places AS (SELECT click_key, unnest(range(5)) AS i FROM keyed),
drawn AS (SELECT k.*, i, ids[i + 1] AS other,
    row_number() OVER (PARTITION BY click_key ORDER BY {hash_int("click_key || '|' || i || '|5'")}, i) AS rn
  FROM keyed k JOIN places p USING (click_key) WHERE ids[i + 1] <> feat_id),
labeled AS (
  SELECT click_key || '|' || feat_id || '|' || position AS row_id, click_key, user_id, CAST(1 AS DOUBLE) AS label,
    feat_id AS entity_id, CAST(position AS BIGINT) AS position FROM keyed
  UNION ALL
  SELECT click_key || '|' || other || '|' || i, click_key, user_id, CAST(-1 AS DOUBLE), other, CAST(i AS BIGINT) FROM drawn WHERE rn = 1)"""
TRAIN = LABELED + f", {USER_INFO}" + f""", train AS (
  SELECT row_id, CASE WHEN CAST({hash_int("click_key || '|5'")} AS DOUBLE) / 4294967296.0 < 0.8 THEN 'train' ELSE 'validate' END AS split,
    label, entity_id, unnest(['pos_' || position, 'age_' || age_group, 'fans_' || fans_count_level, 'gender_' || gender,
      'networkType_' || network_type, 'os_' || os]) AS feature
  FROM labeled JOIN user_info USING (user_id))"""

ORACLES["enable_frequency"] = """SELECT event_type || '_' || user_id AS user_key, props AS item, count(*) AS count
FROM events GROUP BY event_type, user_id, props"""
ORACLES["enable_frequency_map"] = """SELECT 'ENABLE_FREQUENCY:' || user_id AS key, CAST(0 AS BIGINT) AS chunk,
  string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS fields
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id"""
ORACLES["category_frequency_customers"] = """SELECT c_nationkey || '_' || o_custkey AS user_key, l_partkey AS item, count(*) AS count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey, o_custkey, l_partkey"""
ORACLES["impression_click_join"] = f"WITH {LOGS} SELECT * FROM joined"
ORACLES["user_dimension_join"] = f"""WITH {LOGS}, {USER_INFO}
SELECT user_id, timestamp, feat_id, position, age_group, gender, fans_count_level, os, network_type
FROM joined JOIN user_info USING (user_id)"""
ORACLES["clicked_candidates"] = f"""WITH {KEPT}
SELECT list_session_id, user_id, timestamp, feat_id, CAST(position AS BIGINT) AS position, feat_id_list FROM kept"""
ORACLES["negative_samples"] = f"WITH {LABELED} SELECT row_id, click_key, label, entity_id, position FROM labeled"
ORACLES["hash_split"] = f"""SELECT event_id, user_id,
  CASE WHEN CAST({hash_int("user_id || '|' || event_id || '|37'")} AS DOUBLE) / 4294967296.0 < 0.8 THEN 'train' ELSE 'validate' END AS split
FROM events"""
ORACLES["training_set"] = f"""WITH {TRAIN}
SELECT row_id, split, label, entity_id, feature, CAST(1 AS DOUBLE) AS value FROM train"""
ORACLES["seen_entities"] = f"WITH {LOGS} SELECT DISTINCT unnest(string_split(feat_id_list, ',')) AS entity_id FROM imp"

ORACLES["feature_space"] = f"""WITH {EX}
SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM ex)"""
LOG = """log AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS click, o_orderpriority AS priority, c_mktsegment AS segment,
  CAST(c_nationkey AS VARCHAR) AS nation, CAST(month(o_orderdate) AS VARCHAR) AS month, o_totalprice, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CATS = LOG + """, cats AS (
  SELECT 0 AS position, priority AS value FROM log UNION SELECT 1, segment FROM log
  UNION SELECT 2, nation FROM log UNION SELECT 3, month FROM log),
idx AS (SELECT CAST(position AS BIGINT) AS position, value, row_number() OVER (ORDER BY position, value) - 1 AS idx FROM cats)"""
ORACLES["category_index"] = f"WITH {CATS} SELECT position, value, idx FROM idx"
ORACLES["coded_categories"] = f"""WITH {CATS}
SELECT id, a.idx AS priority_idx, b.idx AS segment_idx, c.idx AS nation_idx, d.idx AS month_idx FROM log
JOIN idx a ON a.position = 0 AND a.value = priority JOIN idx b ON b.position = 1 AND b.value = segment
JOIN idx c ON c.position = 2 AND c.value = nation JOIN idx d ON d.position = 3 AND d.value = month"""
ORACLES["densest_feature"] = f"""WITH {EX}, c AS (SELECT feature, count(*) AS n FROM ex GROUP BY feature)
SELECT feature, n, (SELECT max(feature) FROM c) AS largest_feature FROM c ORDER BY n DESC, feature LIMIT 1"""
ORACLES["entity_sizes"] = f"WITH {EX} SELECT entity_id, count(*) AS rows FROM ex GROUP BY entity_id"
ORACLES["numeric_cleanup"] = """SELECT o_orderkey AS id, greatest(o_totalprice, 0) AS price, greatest(c_acctbal, 0) AS balance
FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["parse_quarantine"] = f"""SELECT event_id, {K} AS k, {r(f'CASE WHEN {K} <> 0 THEN value / {K} END', 9)} AS ratio,
  CASE WHEN {K} IS NULL THEN 'number' WHEN {K} = 0 THEN 'division' END AS error FROM events"""
ORACLES["libsvm_roundtrip"] = f"""WITH {EX}
SELECT row_id, CASE WHEN label > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label, feature, entity_id, value FROM ex"""

ORACLES["text_source"] = f"""WITH l AS (SELECT CASE WHEN value > 35 THEN '+1' ELSE '-1' END || ' type_' || event_type || ':1 k_' || ({K} // 10) || ':1' AS line,
  CASE WHEN value > 35 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label, ['type_' || event_type, 'k_' || ({K} // 10)] AS f FROM events),
n AS (SELECT md5(line) || '-' || (row_number() OVER (PARTITION BY line) - 1) AS row_id, label, f FROM l)
SELECT row_id, label, unnest(f) AS feature, CAST(1 AS DOUBLE) AS value FROM n"""

PROFILES = f"""tot AS (SELECT o_custkey AS c_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS fin FROM orders GROUP BY o_custkey),
prof AS (SELECT c_custkey AS user_id, {CODES}, 20 * coalesce(n, 0) AS enable_times, coalesce(cents, 0) // 100000 AS post_times,
    CASE WHEN n > 0 THEN CAST(100 AS DOUBLE) * fin / n ELSE 0 END AS enable_rate
  FROM customer LEFT JOIN tot USING (c_custkey))"""


def code_level(col: str, n: int, shift: int = 0) -> str:
    return f"CASE WHEN {col} + {shift} <= 0 THEN 0 WHEN {col} + {shift} <= {n} THEN {col} + {shift} ELSE {n + 1} END"


def bucket_level(col: str, bounds: tuple) -> str:
    steps = " ".join(f"WHEN {col} < {b} THEN {i + 1}" for i, b in enumerate(bounds))
    return f"CASE WHEN {col} <= 0 THEN 0 {steps} ELSE {len(bounds) + 1} END"


LEVEL_SQL = [
    code_level("gender", 3, 1),
    code_level("age_group", 6),
    code_level("os", 3),
    code_level("network_type", 3),
    code_level("fans_count_level", 6),
    bucket_level("enable_times", (100, 200, 500, 1000)),
    bucket_level("post_times", (200, 500, 1000, 2000)),
    bucket_level("enable_rate", (10, 20, 50, 100)),
]
LV = PROFILES + ", lv AS (SELECT user_id, " + ", ".join(f"{sql} AS a{i}" for i, sql in enumerate(LEVEL_SQL)) + " FROM prof)"
PATTERN = " || '-' || ".join(f"a{i}" for i in range(8))
STARTS = (0, 5, 13, 18, 23, 31, 38, 45)
ORACLES["profile_levels"] = f"WITH {LV} SELECT user_id, {PATTERN} AS pattern FROM lv"
ORACLES["profile_slots"] = (
    f"WITH {LV} SELECT user_id, CAST(unnest([" + ", ".join(f"a{i} + {s}" for i, s in enumerate(STARTS)) + "]) AS INTEGER) AS slot FROM lv"
)
ORACLES["profile_slots_legacy"] = f"""WITH {LV}, both_ AS (SELECT user_id, unnest([1 + gender, 4 + greatest(age_group - 1, 0),
  10 + greatest(os - 1, 0), 13 + greatest(network_type - 1, 0), 16 + greatest(fans_count_level - 1, 0),
  21 + a5, 27 + a6, 33 + a7]) AS slot FROM prof JOIN lv USING (user_id))
SELECT DISTINCT user_id, CAST(slot AS INTEGER) AS slot FROM both_"""
PT = LV + f""", pt AS (SELECT {PATTERN} AS p, {', '.join(f'a{i}' for i in range(8))}, count(*) AS users
  FROM lv GROUP BY ALL),
pp AS (SELECT x.p AS pa, y.p AS pb, x.users AS ua, y.users AS ub, {', '.join(f'x.a{i} = y.a{i} AS e{i}' for i in range(8))},
    {' + '.join(f'CAST(x.a{i} = y.a{i} AS BIGINT)' for i in range(8))} AS shared,
    {' + '.join(f'x.a{i} * {16**i}' for i in range(8))} AS ca, {' + '.join(f'y.a{i} * {16**i}' for i in range(8))} AS cb
  FROM pt x JOIN pt y ON x.p <> y.p)"""
ORACLES["profile_cosine_pairs"] = f"""WITH {PT} SELECT pa AS profile_a, pb AS profile_b, shared,
  shared / CAST(8 AS DOUBLE) AS sim, ua AS users_a, ub AS users_b FROM pp WHERE shared >= 6 AND ca < cb"""
ORACLES["profile_neighbours_directed"] = f"""WITH {PT} SELECT pa AS profile_a, CAST(sum(ub) AS BIGINT) AS near_users,
  max(shared) / CAST(8 AS DOUBLE) AS best_sim FROM pp WHERE shared >= 7 GROUP BY pa"""
ORACLES["profile_cosine_all"] = f"""WITH {PT} SELECT pa AS profile_a, count(*) AS pairs, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(ub) AS BIGINT) AS users
FROM pp WHERE shared >= 1 GROUP BY pa"""
ORACLES["profile_dot_topk"] = f"""WITH {LV}, up AS (SELECT x.user_id, y.user_id AS neighbour,
    {' + '.join(f'CAST(x.a{i} = y.a{i} AS BIGINT)' for i in range(8))} AS shared FROM lv x JOIN lv y ON x.user_id <> y.user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY shared DESC, neighbour) AS rank FROM up WHERE shared > 0)
SELECT user_id, neighbour, shared, rank FROM rk WHERE rank <= 20"""
SAMPLED = list(combinations(range(8), 6))[::3][:8]
FOUND = " OR ".join("(" + " AND ".join(f"e{i}" for i in mask) + ")" for mask in SAMPLED)
ORACLES["approx_cosine_mae"] = f"""WITH {PT} SELECT {r(f'avg(CASE WHEN {FOUND} THEN 0 ELSE shared / CAST(8 AS DOUBLE) END)')} AS mae,
  count(*) AS pairs, count(*) FILTER (WHERE {FOUND}) AS found FROM pp WHERE shared >= 6 AND ca < cb"""
ORACLES["embedding_transpose"] = """WITH cells AS (SELECT vec_id AS j, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT i, j // 256 AS block, min(j) AS first_j, string_agg(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS micro_values
FROM cells GROUP BY i, j // 256"""

DIMSUM = f"""cells AS (SELECT * FROM (SELECT vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v <> 0),
norms AS (SELECT c, sqrt(sum(v * v)) AS n, least(1, sqrt(4) / sqrt(sum(v * v))) AS p FROM cells GROUP BY c),
kept AS (SELECT r, c, v / n / p AS x FROM cells JOIN norms USING (c) WHERE {hash_int("r || '|' || c")} / CAST(4294967296 AS DOUBLE) < p),
est AS (SELECT a.c AS col_a, b.c AS col_b, sum(a.x * b.x) AS sim FROM kept a JOIN kept b ON a.r = b.r AND a.c < b.c GROUP BY a.c, b.c)"""
ORACLES["embedding_dimsum"] = f"WITH {DIMSUM} SELECT col_a, col_b, {r('sim')} AS sim FROM est"
ORACLES["embedding_dimsum_error"] = f"""WITH {DIMSUM}, full_ AS (SELECT a.c AS col_a, b.c AS col_b, sum(a.v * b.v) / (any_value(na.n) * any_value(nb.n)) AS sim
  FROM cells a JOIN cells b ON a.r = b.r AND a.c < b.c JOIN norms na ON na.c = a.c JOIN norms nb ON nb.c = b.c GROUP BY a.c, b.c),
e AS (SELECT f.sim, abs(f.sim - coalesce(est.sim, 0)) AS off, est.sim AS guess FROM full_ f LEFT JOIN est USING (col_a, col_b))
SELECT {r('avg(off)')} AS mae, {r('max(off)')} AS largest, count(*) AS pairs, count(*) FILTER (WHERE abs(sim) >= 0.05) AS similar,
  count(*) FILTER (WHERE abs(sim) >= 0.05 AND guess IS NOT NULL) AS found FROM e"""

LINES = """ls AS (SELECT CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label,
  round(l_extendedprice * (1 - l_discount) / CAST(50000 AS DOUBLE) - 1, 4) AS score FROM lineitem)"""


def auc_sql(source: str, positive: str) -> str:
    return f"""per AS (SELECT score, count(*) FILTER (WHERE {positive}) AS pos, count(*) FILTER (WHERE NOT ({positive})) AS neg
  FROM {source} GROUP BY score),
run AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM per),
auc AS (SELECT CAST(sum(pos * (below + neg / CAST(2 AS DOUBLE))) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM run)"""


ORACLES["auc"] = f"WITH {LINES}, {auc_sql('ls', 'label > 0')} SELECT {r('auc')} AS auc, positives, negatives FROM auc"
ORACLES["auc_documents"] = f"""WITH ld AS (SELECT quality, n_chars AS score FROM documents JOIN labels USING (doc_id)),
{auc_sql('ld', 'quality > 0')} SELECT {r('auc')} AS auc, positives, negatives FROM auc"""
ORACLES["log_loss_exp"] = f"WITH {LINES} SELECT {r('avg(ln(1 + exp(-label * score)))')} AS loss, count(*) AS rows FROM ls"
ORACLES["log_loss_log"] = f"""WITH {LINES} SELECT {r('avg(CASE WHEN label > 0 THEN -ln(1 / (1 + exp(-score))) ELSE -ln(1 - 1 / (1 + exp(-score))) END)')} AS loss,
  count(*) AS rows FROM ls"""
ORACLES["accuracy"] = f"WITH {LINES} SELECT {r('avg(CASE WHEN (score > 0) = (label > 0) THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS rows FROM ls"
ORACLES["confusion"] = f"""WITH {LINES}, c AS (SELECT count(*) FILTER (WHERE score > 0 AND label > 0) AS tp,
  count(*) FILTER (WHERE score > 0 AND label <= 0) AS fp, count(*) FILTER (WHERE score <= 0 AND label > 0) AS fn,
  count(*) FILTER (WHERE score <= 0 AND label <= 0) AS tn FROM ls)
SELECT *, {r('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS accuracy, {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
  {r('tp / CAST(tp + fn AS DOUBLE)')} AS recall FROM c"""
ORACLES["evaluate_model"] = f"""WITH {SCORED}, sc AS (SELECT label, s AS score FROM scored), {auc_sql('sc', 'label > 0')}
SELECT {r('avg(CASE WHEN (score > 0) = (label > 0) THEN 1 ELSE 0 END)')} AS accuracy, {r('avg(ln(1 + exp(-label * score)))')} AS loss,
  {r('(SELECT auc FROM auc)')} AS auc FROM sc"""

ORACLES["lr_score"] = f"WITH {SCORED} SELECT row_id, label, {r('1 / (1 + exp(-s))')} AS score FROM scored"
ORACLES["lr_gradient"] = f"WITH {GRADS} SELECT feature, {r('g')} AS grad, n AS rows FROM grads"
N = "(SELECT count(*) FROM base)"
ORACLES["lr_gd_step_l2"] = f"""WITH {GRADS} SELECT feature, {r(f'w - 0.5 * (g / {N} + 0.1 * w)')} AS w FROM w0 JOIN grads USING (feature)"""
ORACLES["lr_prox_step_l1"] = f"""WITH {GRADS} SELECT feature, {r(soft(f'(w - 0.5 * g / {N})', '0.5 * 0.05'))} AS w FROM w0 JOIN grads USING (feature)"""


def next_scores(weights: str, name: str) -> str:
    return f"""{name} AS (SELECT row_id, label, sum(w * value) AS s FROM ex JOIN {weights} USING (feature) GROUP BY row_id, label)"""


def next_grads(scores: str, name: str) -> str:
    return f"""{name} AS (SELECT feature, sum(-label / (1 + exp(label * s)) * value) AS g FROM ex JOIN {scores} USING (row_id, label) GROUP BY feature)"""


ORACLES["lr_gd"] = f"""WITH {GRADS}, w1 AS (SELECT feature, w - 0.5 * (g / {N} + 0.1 * w) AS w FROM w0 JOIN grads USING (feature)),
{next_scores('w1', 's1')}, {next_grads('s1', 'g1')}
SELECT feature, {r(f'w - 0.5 / sqrt(2) * (g / {N} + 0.1 * w)')} AS w FROM w1 JOIN g1 USING (feature)"""
ORACLES["lr_majorized"] = f"""WITH {W0.replace(hash_weight('feature'), 'CAST(0 AS DOUBLE)')},
d AS (SELECT feature, count(*) * CAST(0.75 AS DOUBLE) / {N} AS d FROM ex GROUP BY feature),
{next_scores('w0', 's0')}, {next_grads('s0', 'g0')},
w1 AS (SELECT feature, (d * w - g / {N}) / (d + 0.01) AS w FROM w0 JOIN d USING (feature) JOIN g0 USING (feature)),
{next_scores('w1', 's1')}, {next_grads('s1', 'g1')}
SELECT feature, {r(f'(d * w - g / {N}) / (d + 0.01)')} AS w FROM w1 JOIN d USING (feature) JOIN g1 USING (feature)"""

#: Rows of equal features, values, offset and label (-1/+1) as one row with its number, over numbered features.
VALUED = BASE + f""", vx AS (
  SELECT event_id AS row_id, CASE WHEN value > 35 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label,
    (event_id % 5 - 2) * CAST(0.1 AS DOUBLE) AS o, ['hour_' || CAST(hour(ts) AS VARCHAR), 'number'] AS f, [CAST(1 AS DOUBLE), {K} / CAST(100 AS DOUBLE)] AS v
  FROM events)"""
PLAIN = BASE + """, vx AS (SELECT row_id, label, CAST(0 AS DOUBLE) AS o, [f1, f2, f3] AS f, [CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)] AS v FROM base)"""


def minimised(source: str, lam: float, reg: str, rounds: int) -> str:
    """The minimum of mean loss and penalty by so many majorisation steps, each of them exact for a separable bound."""
    new = f"(d * w - g) / (d + {lam})" if reg == "l2" else soft("(w - g / d)", f"{lam} / d")
    return f"""WITH RECURSIVE {source},
names AS MATERIALIZED (SELECT f, row_number() OVER (ORDER BY f) AS i FROM (SELECT DISTINCT unnest(f) AS f FROM vx)),
cells AS (SELECT row_id, label, o, i, v FROM (SELECT row_id, label, o, unnest(f) AS f, unnest(v) AS v FROM vx) JOIN names USING (f)),
packed AS (SELECT label, o, list(i ORDER BY i) AS i, list(v ORDER BY i) AS v FROM cells GROUP BY row_id, label, o),
pat AS MATERIALIZED (SELECT label, o, i, v, count(*) AS c FROM packed GROUP BY ALL),
total AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM vx),
curve AS MATERIALIZED (SELECT i, sum(c * x * s) / (4 * any_value(n)) AS d FROM (SELECT unnest(i) AS i, unnest(v) AS x, list_sum(v) AS s, c FROM pat), total GROUP BY i),
it AS (
  SELECT 0 AS t, (SELECT list(CAST(0 AS DOUBLE) ORDER BY i) FROM names) AS ws
  UNION ALL
  SELECT t + 1, list({new} ORDER BY i) FROM (
    SELECT t, i, any_value(w) AS w, sum(m * x) / any_value(n) AS g, any_value(d) AS d FROM (
      SELECT t, i, ws[i] AS w, x, m FROM (
        SELECT t, ws, unnest(i) AS i, unnest(v) AS x, -label / (1 + exp(label * (list_inner_product(list_select(ws, i), v) + o))) * c AS m FROM it, pat WHERE t < {rounds}))
    JOIN curve USING (i), total GROUP BY t, i) GROUP BY t)
SELECT f AS feature, {r('ws[i]', 3)} AS w FROM it, names WHERE t = {rounds}"""


ORACLES["lr_lbfgs"] = minimised(PLAIN, 0.01, "l2", 400)
ORACLES["lr_lbfgs_values"] = minimised(VALUED, 0.01, "l2", 400)
ORACLES["lr_owlqn_values"] = minimised(VALUED, 0.002, "l1", 600)

FM0 = EX + f""", m0 AS (SELECT feature, {hash_weight('feature')} AS w, {hash_weight("feature || '|0'")} AS v0,
  {hash_weight("feature || '|1'")} AS v1 FROM (SELECT DISTINCT feature FROM ex)),
fs AS (SELECT row_id, label, sum(w) AS lin, sum(v0) AS s0, sum(v1) AS s1, sum(v0 * v0) AS q0, sum(v1 * v1) AS q1
  FROM ex JOIN m0 USING (feature) GROUP BY row_id, label),
fp AS (SELECT *, lin + 0.5 * (s0 * s0 - q0 + s1 * s1 - q1) AS s FROM fs),
fp2 AS (SELECT *, -label / (1 + exp(label * s)) AS m FROM fp),
fg AS (SELECT feature, sum(m) AS gw, sum(m * (s0 - v0)) AS g0, sum(m * (s1 - v1)) AS g1, count(*) AS n
  FROM ex JOIN fp2 USING (row_id, label) JOIN m0 USING (feature) GROUP BY feature)"""
ORACLES["fm_predict"] = f"WITH {FM0} SELECT row_id, label, {r('s', 8)} AS score FROM fp"
ORACLES["fm_gradient"] = f"WITH {FM0} SELECT feature, {r('gw')} AS gw, {r('g0')} AS gv0, {r('g1')} AS gv1, n AS rows FROM fg"
ORACLES["fm_gd_step"] = f"""WITH {FM0} SELECT feature, {r(f'w - 0.5 * (gw / {N} + 0.02 * w)')} AS w,
  {r(f'v0 - 0.5 * (g0 / {N} + 0.03 * v0)')} AS v0, {r(f'v1 - 0.5 * (g1 / {N} + 0.03 * v1)')} AS v1 FROM m0 JOIN fg USING (feature)
UNION ALL SELECT '__bias__', {r(f'-0.5 * sum(m) / {N}')}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM fp2"""
PENALTY = "(SELECT 0.5 * sum(0.02 * w * w + 0.03 * (v0 * v0 + v1 * v1)) FROM m0)"
FIT = "avg(ln(1 + exp(-label * s)))"
ORACLES["fm_loss_reg"] = f"WITH {FM0} SELECT {r(FIT)} AS loss, {r(PENALTY)} AS penalty, {r(FIT + ' + ' + PENALTY)} AS objective FROM fp"


def ftrl_weight(z: str, n: str, alpha: float, l1: float, l2: float) -> str:
    return f"(-{soft(z, str(l1))} / ({l2} + (1 + sqrt({n})) / CAST({alpha} AS DOUBLE)))"


def ftrl_z(g: str, n: str, w: str, z: str, alpha: float) -> str:
    return f"({z} + {g} - (sqrt({n} + {g} * {g}) - sqrt({n})) / CAST({alpha} AS DOUBLE) * {w})"


def half_grads(weights: str, half: int, tag: str) -> str:
    return f"""sc{tag} AS (SELECT row_id, label, sum(w * value) AS s FROM ex JOIN {weights} USING (feature) WHERE half = {half} GROUP BY row_id, label),
gr{tag} AS (SELECT feature, sum(-label / (1 + exp(label * s)) * value) AS g FROM ex JOIN sc{tag} USING (row_id, label) GROUP BY feature)"""


WARM = "-(sign(w) * 0.5 + w * (0.1 + 1 / CAST(0.5 AS DOUBLE)))"
FTRL = W0 + f""", st0 AS (SELECT feature, w, {WARM} AS z, CAST(0 AS DOUBLE) AS n, 0 AS step FROM w0),
{half_grads('st0', 0, 'a')},
u1 AS (SELECT feature, {ftrl_z('g', 'n', 'w', 'z', 0.5)} AS z, n + g * g AS n FROM st0 JOIN gra USING (feature)),
st1 AS (SELECT feature, {ftrl_weight('z', 'n', 0.5, 0.5, 0.1)} AS w, z, n, 1 AS step FROM u1
  UNION ALL SELECT * FROM st0 WHERE feature NOT IN (SELECT feature FROM u1)),
{half_grads('st1', 1, 'b')},
u2 AS (SELECT feature, {ftrl_z('g', 'n', 'w', 'z', 0.5)} AS z, n + g * g AS n FROM st1 JOIN grb USING (feature)),
st2 AS (SELECT feature, {ftrl_weight('z', 'n', 0.5, 0.5, 0.1)} AS w, z, n, 2 AS step FROM u2
  UNION ALL SELECT * FROM st1 WHERE feature NOT IN (SELECT feature FROM u2))"""
HEAD = "'linear' AS part, feature, CAST(0 AS BIGINT) AS k"
ORACLES["ftrl_batch_step"] = f"""WITH {FTRL} SELECT {HEAD}, {r('w')} AS w, {r('z')} AS z, {r('n')} AS n, CAST(step AS BIGINT) AS step FROM st2"""


def tdap_step(state: str, grads: str, step: int, tag: str) -> str:
    sigma = "(sqrt(n + g * g) - sqrt(n)) / CAST(0.5 AS DOUBLE)"
    decay = f"exp(-({step} - step) / CAST({2 * 1.5 * 1.5} AS DOUBLE))"
    return f"""u{tag} AS (SELECT feature, w AS old, {decay} * z + {sigma} * w - g AS z, n + g * g AS n, {decay} * s + {sigma} AS s
  FROM {state} JOIN {grads} USING (feature)),
st{tag} AS (SELECT feature, {soft('z', '0.5')} / (s + 0.1) AS w, z, n, s, {step} AS step FROM u{tag}
  UNION ALL SELECT * FROM {state} WHERE feature NOT IN (SELECT feature FROM u{tag}))"""


ORACLES["tdap_batch_step"] = f"""WITH {W0}, st0 AS (SELECT feature, w, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS s, 0 AS step FROM w0),
{half_grads('st0', 0, 'a')}, {tdap_step('st0', 'gra', 1, '1')}, {half_grads('st1', 1, 'b')}, {tdap_step('st1', 'grb', 2, '2')}
SELECT {HEAD}, {r('w')} AS w, {r('z')} AS z, {r('n')} AS n, {r('s')} AS s, CAST(step AS BIGINT) AS step FROM st2"""


FM_CELLS = f"""cells AS (
  SELECT 'linear' AS part, feature, 0 AS k, w, gw AS g FROM m0 JOIN fg USING (feature)
  UNION ALL SELECT 'factor', feature, 0, v0, g0 FROM m0 JOIN fg USING (feature)
  UNION ALL SELECT 'factor', feature, 1, v1, g1 FROM m0 JOIN fg USING (feature)
  UNION ALL SELECT 'bias', '__bias__', 0, CAST(0 AS DOUBLE), sum(m) FROM fp2),
rated AS (SELECT *, CASE part WHEN 'bias' THEN CAST(0.3 AS DOUBLE) WHEN 'linear' THEN 0.5 ELSE 0.2 END AS a,
  CASE part WHEN 'bias' THEN CAST(0 AS DOUBLE) WHEN 'linear' THEN 0.5 ELSE 0.1 END AS l1 FROM cells)"""
ORACLES["fm_ftrl_step"] = f"""WITH {FM0}, {FM_CELLS},
zs AS (SELECT part, feature, k, a, l1, -(sign(w) * l1 + w * (0.1 + 1 / a)) + g - abs(g) / a * w AS z, g * g AS n FROM rated)
SELECT part, feature, CAST(k AS BIGINT) AS k, {r(f"-{soft('z', 'l1')} / (0.1 + (1 + sqrt(n)) / a)")} AS w, {r('z')} AS z, {r('n')} AS n,
  CAST(1 AS BIGINT) AS step FROM zs"""
ORACLES["fm_tdap_step"] = f"""WITH {FM0}, {FM_CELLS},
zs AS (SELECT part, feature, k, l1, abs(g) / a * w - g AS z, g * g AS n, abs(g) / a AS s FROM rated)
SELECT part, feature, CAST(k AS BIGINT) AS k, {r(f"{soft('z', 'l1')} / (s + 0.1)")} AS w, {r('z')} AS z, {r('n')} AS n, {r('s')} AS s,
  CAST(1 AS BIGINT) AS step FROM zs"""
ORACLES["prequential_metrics"] = f"""WITH {FTRL}, sc AS (SELECT 0 AS b, label, s FROM sca UNION ALL SELECT 1, label, s FROM scb),
pb AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE (s > 0) = (label > 0)) AS h, sum(ln(1 + exp(-label * s))) AS l FROM sc GROUP BY b)
SELECT CAST(b AS BIGINT) AS batch_id, n AS rows, {r('h / CAST(n AS DOUBLE)')} AS accuracy, {r('l / n')} AS loss,
  {r('sum(h) OVER (ORDER BY b) / CAST(sum(n) OVER (ORDER BY b) AS DOUBLE)')} AS running_accuracy,
  {r('sum(l) OVER (ORDER BY b) / CAST(sum(n) OVER (ORDER BY b) AS DOUBLE)')} AS running_loss FROM pb"""

MX = W0 + f""", wr AS (SELECT entity_id, feature, {hash_weight("entity_id || '|' || feature")} AS w FROM (SELECT DISTINCT entity_id, feature FROM ex)),
mx AS (SELECT row_id, label, entity_id, sum(w0.w) AS f, sum(wr.w) AS q FROM ex JOIN w0 USING (feature)
  JOIN wr USING (entity_id, feature) GROUP BY row_id, label, entity_id)"""
ORACLES["mixed_score"] = f"""WITH {MX} SELECT row_id, entity_id, {r('f')} AS fixed, {r('q')} AS random, {r('1 / (1 + exp(-(f + q)))')} AS probability FROM mx"""
ORACLES["mixed_rescore"] = f"WITH {MX} SELECT row_id, {r('q + 0.5 * f')} AS score FROM mx"
ORACLES["mixed_fixed_step"] = f"""WITH {MX}, g AS (SELECT feature, sum(-label / (1 + exp(label * (f + q)))) AS g FROM ex JOIN mx USING (row_id, label, entity_id) GROUP BY feature)
SELECT feature, {r(f'w - 0.5 * (g / {N} + 0.1 * w)')} AS w FROM w0 JOIN g USING (feature)"""
ORACLES["mixed_random_step"] = f"""WITH {MX}, g AS (SELECT entity_id, feature, sum(-label / (1 + exp(label * (f + q)))) AS g
  FROM ex JOIN mx USING (row_id, label, entity_id) GROUP BY entity_id, feature),
n AS (SELECT entity_id, count(*) AS n FROM base GROUP BY entity_id)
SELECT entity_id, feature, {r('w - 0.5 * (g / n + 0.1 * w)')} AS w FROM wr JOIN g USING (entity_id, feature) JOIN n USING (entity_id)"""

RESIDUAL = EX + """, pr AS (SELECT avg(CASE WHEN label > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p FROM base),
res AS (SELECT row_id, f1, f2, f3, ln(p / (1 - p)) AS bias, label / (1 + exp(label * ln(p / (1 - p)))) AS rs FROM base, pr)"""
GAINS = RESIDUAL + """, t AS (SELECT sum(rs) AS s, count(*) AS n FROM res),
lf AS (SELECT feature, sum(rs) AS l, count(*) AS m FROM ex JOIN res USING (row_id) GROUP BY feature),
gn AS (SELECT feature, n, m, l, s, l * l / m + (s - l) * (s - l) / (n - m) - s * s / n AS gain FROM lf, t WHERE m < n)"""
ORACLES["boost_prior_residual"] = f"WITH {RESIDUAL} SELECT row_id, {r('bias')} AS bias, {r('rs')} AS residual FROM res"
ORACLES["best_split"] = f"WITH {GAINS} SELECT CAST(1 AS BIGINT) AS node, feature, n, m AS n_left, {r('gain')} AS gain FROM gn"
ORACLES["boost_tree_step"] = f"""WITH {GAINS}, b AS (SELECT * FROM gn ORDER BY round(gain, 9) DESC, feature LIMIT 1)
SELECT {r('l / m')} AS leaf_value, m AS rows, {r('l', 4)} AS residual_sum FROM b
UNION ALL SELECT {r('(s - l) / (n - m)')}, n - m, {r('s - l', 4)} FROM b"""

REC = """rec AS (SELECT 'FREQ:' || user_id AS key, event_type AS field, CASE WHEN day(ts) < 16 THEN 1 ELSE 2 END AS v, count(*) AS n
  FROM events GROUP BY ALL),
latest AS (SELECT key, field, CAST(arg_max(n, v) AS VARCHAR) AS value, CAST(max(v) AS BIGINT) AS version FROM rec GROUP BY key, field)"""
ORACLES["kv_upsert"] = f"WITH {REC} SELECT key, field, value, version FROM latest"
ORACLES["kv_lookup"] = f"""WITH {REC} SELECT k.key, field, value, field IS NOT NULL AS found
FROM (SELECT 'FREQ:' || c_custkey AS key FROM customer) k LEFT JOIN latest USING (key)"""

ORACLES["kv_compacted_lookup"] = """WITH rec AS (SELECT 'FREQ:' || user_id AS key, event_type AS field, day(ts) % 8 AS v, count(*) AS n FROM events GROUP BY ALL),
latest AS (SELECT key, field, CAST(arg_max(n, v) AS VARCHAR) AS value FROM rec GROUP BY key, field)
SELECT k.key, field, value, field IS NOT NULL AS found FROM (SELECT 'FREQ:' || c_custkey AS key FROM customer) k LEFT JOIN latest USING (key)"""
ORACLES["frequency_map_chunked"] = f"""WITH c AS (SELECT 'SUPPLIERS:' || l_returnflag AS key, CAST(l_suppkey AS VARCHAR) AS field, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT key, {hash_int('field')} % 16 AS chunk, string_agg(field || '=' || n, ',' ORDER BY field) AS fields FROM c GROUP BY ALL"""


def versions(source: str) -> str:
    again = f"{hash_weight('''model_key || '|again' ''')} < 0"
    return f"""v1 AS (SELECT '' AS model_key, feature, {hash_weight('feature')} AS w FROM (SELECT DISTINCT feature FROM {source})
  UNION ALL SELECT entity_id, feature, {hash_weight("entity_id || '|' || feature")} FROM (SELECT DISTINCT entity_id, feature FROM {source})),
lm AS (SELECT model_key, feature, CASE WHEN model_key = '' OR {again} THEN w * 0.5 ELSE w END AS w,
  CAST(CASE WHEN model_key = '' OR {again} THEN 2 ELSE 1 END AS BIGINT) AS version FROM v1)"""


ORACLES["kv_latest_model"] = f"WITH {EX}, {versions('ex')} SELECT model_key, feature, {r('w')} AS w, version FROM lm"
RANK = TRAIN + f", {versions('train')}" + """, uf AS (SELECT user_id, unnest(['age_' || age_group, 'fans_' || fans_count_level, 'gender_' || gender,
  'networkType_' || network_type, 'os_' || os]) AS feature FROM user_info),
fx AS (SELECT user_id, sum(coalesce(w, 0)) AS fixed FROM uf LEFT JOIN lm ON lm.model_key = '' AND lm.feature = uf.feature GROUP BY user_id),
rq AS (SELECT *, string_split(feat_id_list, ',') AS ids FROM imp),
pos AS (SELECT user_id, list_session_id, timestamp, feat_id_list, unnest(range(len(ids))) AS i, unnest(ids) AS candidate FROM rq),
once AS (SELECT user_id, list_session_id, timestamp, feat_id_list, candidate, min(i) AS i FROM pos GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, list_session_id, timestamp ORDER BY i) - 1 AS pos FROM once),
own AS (SELECT o.user_id, o.list_session_id, o.timestamp, o.feat_id_list, o.pos, o.candidate, sum(coalesce(lm.w, 0)) AS rnd
  FROM numbered o JOIN uf USING (user_id) LEFT JOIN lm ON lm.model_key = o.candidate AND lm.feature = uf.feature GROUP BY ALL),
pb AS (SELECT own.*, 1 / (1 + exp(-(fixed + rnd))) AS p FROM own JOIN fx USING (user_id))"""
ORACLES["candidate_scores"] = f"""WITH {RANK} SELECT list_session_id, CAST(pos AS BIGINT) AS pos, candidate, {r('p')} AS probability FROM pb"""
REPEATED = RANK.replace("rq AS (SELECT *, string_split(feat_id_list, ',') AS ids FROM imp),", """asked AS (SELECT user_id, list_session_id, timestamp, feat_id_list FROM imp
  UNION ALL SELECT user_id, list_session_id, timestamp, feat_id_list FROM imp
  UNION ALL SELECT user_id, list_session_id, timestamp, array_to_string(list_reverse(string_split(feat_id_list, ',')), ',') FROM imp
  UNION ALL SELECT user_id, NULL, NULL, feat_id_list FROM imp),
rq AS (SELECT *, string_split(feat_id_list, ',') AS ids FROM (SELECT DISTINCT * FROM asked)),""")
REPEATED = REPEATED.replace("PARTITION BY user_id, list_session_id, timestamp ORDER BY i", "PARTITION BY user_id, list_session_id, timestamp, feat_id_list ORDER BY i")
ORACLES["rank_repeated_requests"] = f"""WITH {REPEATED}, best AS (SELECT user_id, list_session_id, timestamp, feat_id_list,
  string_agg(candidate, ',' ORDER BY round(p, 9) DESC, pos) AS ranked_list FROM pb GROUP BY ALL)
SELECT a.user_id, a.list_session_id, CAST(a.timestamp AS VARCHAR) AS timestamp, coalesce(ranked_list, a.feat_id_list) AS ranked_list, ranked_list IS NOT NULL AS ranked
FROM asked a LEFT JOIN best b ON a.user_id = b.user_id AND a.feat_id_list = b.feat_id_list
  AND a.list_session_id IS NOT DISTINCT FROM b.list_session_id AND a.timestamp IS NOT DISTINCT FROM b.timestamp"""
ORACLES["rank_candidates"] = f"""WITH {RANK} SELECT user_id, list_session_id, timestamp,
  string_agg(candidate, ',' ORDER BY round(p, 9) DESC, pos) AS ranked_list, true AS ranked FROM pb GROUP BY user_id, list_session_id, timestamp"""

PR = """e AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
deg AS (SELECT src, count(*) AS d FROM e GROUP BY src), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r0 AS (SELECT node, CAST(1 AS DOUBLE) AS rank FROM nodes)"""
for _i in range(4):
    PR += f""", r{_i + 1} AS (SELECT node, 0.15 + 0.85 * coalesce(inb, 0) AS rank FROM nodes LEFT JOIN
  (SELECT dst AS node, sum(rank / d) AS inb FROM e JOIN deg USING (src) JOIN r{_i} ON r{_i}.node = e.src GROUP BY dst) USING (node))"""
ORACLES["pagerank4"] = f"WITH {PR} SELECT node, {r('rank')} AS rank FROM r4"
ORACLES["path_contains"] = """WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, coalesce(bool_or(a = 'view' AND b = 'click' AND c = 'purchase'), false) AS contains FROM s GROUP BY user_id"""
ORACLES["first_match"] = """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, coalesce(min(i) FILTER (WHERE value > 200), -1) AS first FROM s GROUP BY user_id"""
ORACLES["is_increasing"] = """WITH s AS (SELECT o_custkey, o_totalprice AS v,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_custkey, bool_and(p IS NULL OR p < v) AS increasing FROM s GROUP BY o_custkey"""

ORACLES["stream_frequency"] = """SELECT 'FREQ:' || user_id AS key, event_type AS field, CAST(count(*) AS VARCHAR) AS value
FROM events GROUP BY user_id, event_type"""
ORACLES["stream_daily_frequency"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, count(*) AS count
FROM events GROUP BY ALL"""
ORACLES["stream_imp_click"] = """WITH e AS (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS list_session_id, user_id, event_id, event_type FROM events)
SELECT list_session_id, user_id, event_id AS click_id FROM e WHERE event_type = 'click'
AND list_session_id IN (SELECT list_session_id FROM e WHERE event_type = 'view')"""
ORACLES["stream_training_rows"] = """WITH e AS (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS list_session_id, user_id, event_id, event_type, ts, date_trunc('day', ts) AS d FROM events),
v AS (SELECT DISTINCT list_session_id, user_id, d FROM e WHERE event_type = 'view'),
c AS (SELECT list_session_id, user_id, event_id AS click_id FROM e WHERE event_type = 'click'),
seen AS (SELECT least((SELECT CAST(max(d) AS TIMESTAMP) FROM v), (SELECT CAST(max(ts) AS TIMESTAMP) FROM e WHERE event_type = 'click')) - INTERVAL 1 DAY AS mark)
SELECT list_session_id, user_id, CAST(click_id AS VARCHAR) AS click_id, CAST(1 AS DOUBLE) AS label FROM v JOIN c USING (list_session_id, user_id)
UNION ALL SELECT list_session_id, user_id, '', CAST(0 AS DOUBLE) FROM v, seen
WHERE d + INTERVAL 1 DAY < mark AND list_session_id NOT IN (SELECT list_session_id FROM c)"""
STREAM_RQ = """rq AS (SELECT uid AS user_id, e.sid || '_' || e.event_id AS list_session_id, t AS timestamp, string_split(feat_id_list, ',') AS ids
  FROM (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS sid, CAST(user_id AS VARCHAR) AS uid, event_id,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events WHERE event_type = 'view') e JOIN lists USING (sid)),"""
STREAM_RANK = RANK.replace("rq AS (SELECT *, string_split(feat_id_list, ',') AS ids FROM imp),", STREAM_RQ).replace("feat_id_list, unnest(range", "unnest(range")
STREAM_RANK = STREAM_RANK.replace("timestamp, feat_id_list, candidate, min(i)", "timestamp, candidate, min(i)").replace("o.timestamp, o.feat_id_list, o.pos", "o.timestamp, o.pos")
ORACLES["stream_rank"] = f"""WITH {STREAM_RANK} SELECT user_id, list_session_id, timestamp,
  string_agg(candidate, ',' ORDER BY round(p, 9) DESC, pos) AS ranked_list, true AS ranked FROM pb GROUP BY user_id, list_session_id, timestamp"""
ORACLES["stream_ftrl"] = f"""WITH {GRADS}, st0 AS (SELECT feature, w, {WARM} AS z, CAST(0 AS DOUBLE) AS n FROM w0),
u1 AS (SELECT feature, {ftrl_z('g', 'st0.n', 'w', 'z', 0.5)} AS z, g * g AS n FROM st0 JOIN grads USING (feature))
SELECT {HEAD}, {r(ftrl_weight('z', 'n', 0.5, 0.5, 0.1))} AS w, {r('z')} AS z, {r('n')} AS n, CAST(1 AS BIGINT) AS step FROM u1"""

ORACLES["embedding_cosine_topk"] = f"""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM u),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e) / (a.l * b.l), 9) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s)
SELECT vec_id, neighbour, {r('sim')} AS sim, rank FROM k WHERE rank <= 5"""


# iterative queries, one set of CTEs per step


def fm_step(t: int) -> str:
    """Predictions, gradients and the next model m{t+1}, b{t+1} of an FM gradient step."""
    return f"""fs{t} AS MATERIALIZED (SELECT row_id, label, sum(w) AS lin, sum(v0) AS s0, sum(v1) AS s1, sum(v0 * v0) AS q0, sum(v1 * v1) AS q1
  FROM ex JOIN m{t} USING (feature) GROUP BY row_id, label),
fp{t} AS MATERIALIZED (SELECT *, -label / (1 + exp(label * (b + lin + 0.5 * (s0 * s0 - q0 + s1 * s1 - q1)))) AS m FROM fs{t}, b{t}),
fg{t} AS MATERIALIZED (SELECT feature, sum(m) AS gw, sum(m * (s0 - v0)) AS g0, sum(m * (s1 - v1)) AS g1
  FROM ex JOIN fp{t} USING (row_id, label) JOIN m{t} USING (feature) GROUP BY feature)"""


def fm_descent(t: int, alpha: float) -> str:
    rate = f"{alpha} / sqrt({t + 1}) / {N}"
    return f"""{fm_step(t)},
m{t + 1} AS MATERIALIZED (SELECT feature, w - {rate} * gw AS w, v0 - {rate} * g0 AS v0, v1 - {rate} * g1 AS v1 FROM m{t} JOIN fg{t} USING (feature)),
b{t + 1} AS MATERIALIZED (SELECT any_value(b{t}.b) - {rate} * sum(m) AS b FROM fp{t}, b{t})"""


FM_START = FM0.split(",\nfs AS")[0] + ", b0 AS (SELECT CAST(0 AS DOUBLE) AS b)"
ORACLES["fm_gd"] = f"""WITH {FM_START}, {', '.join(fm_descent(t, 0.5) for t in range(3))}
SELECT feature, {r('w')} AS w, {r('v0')} AS v0, {r('v1')} AS v1 FROM m3
UNION ALL SELECT '__bias__', {r('b')}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM b3"""

A, L1 = (
    f"CASE part WHEN 'bias' THEN CAST({b} AS DOUBLE) WHEN 'linear' THEN CAST({l} AS DOUBLE) ELSE CAST({f} AS DOUBLE) END"
    for b, l, f in ((0.3, 0.5, 0.2), (0.0, 0.5, 0.1))
)


def cold_weight() -> str:
    return f"(-{soft('z', '(' + L1 + ')')} / (0.1 + (1 + sqrt(n)) / ({A})))"


def cold_batch(t: int) -> str:
    """FTRL on the half ``t`` of the month for all three parts of the FM state c{t}."""
    step = fm_step(t).replace("FROM ex JOIN", "FROM (SELECT * FROM ex WHERE half = %d) JOIN" % t)
    sigma = f"(sqrt(n + g * g) - sqrt(n)) / ({A})"
    return f"""m{t} AS MATERIALIZED (SELECT feature, max(w) FILTER (WHERE part = 'linear') AS w, max(w) FILTER (WHERE part = 'factor' AND k = 0) AS v0,
  max(w) FILTER (WHERE part = 'factor' AND k = 1) AS v1 FROM c{t} WHERE part <> 'bias' GROUP BY feature),
b{t} AS MATERIALIZED (SELECT w AS b FROM c{t} WHERE part = 'bias'), {step},
g{t} AS MATERIALIZED (SELECT 'linear' AS part, feature, 0 AS k, gw AS g FROM fg{t} UNION ALL SELECT 'factor', feature, 0, g0 FROM fg{t}
  UNION ALL SELECT 'factor', feature, 1, g1 FROM fg{t} UNION ALL SELECT 'bias', '__bias__', 0, sum(m) FROM fp{t}),
z{t} AS MATERIALIZED (SELECT part, feature, k, z + g - {sigma} * w AS z, n + g * g AS n, {t + 1} AS step FROM c{t} JOIN g{t} USING (part, feature, k)
  UNION ALL SELECT part, feature, k, z, n, step FROM c{t} ANTI JOIN g{t} USING (part, feature, k)),
c{t + 1} AS MATERIALIZED (SELECT part, feature, k, {cold_weight()} AS w, z, n, step FROM z{t})"""


ORACLES["fm_ftrl_cold"] = f"""WITH {EX}, cells AS (SELECT * FROM (SELECT DISTINCT feature FROM ex), (VALUES ('linear', 0), ('factor', 0), ('factor', 1)) AS p(part, k)
  UNION ALL SELECT '__bias__', 'bias', 0),
z AS (SELECT part, feature, k, {hash_weight("part || '|' || feature || '|' || k")} AS z, CAST(0 AS DOUBLE) AS n, 0 AS step FROM cells),
c0 AS MATERIALIZED (SELECT part, feature, k, {cold_weight()} AS w, z, n, step FROM z), {cold_batch(0)}, {cold_batch(1)}
SELECT part, feature, CAST(k AS BIGINT) AS k, {r('w')} AS w, {r('z')} AS z, {r('n')} AS n, CAST(step AS BIGINT) AS step FROM c2"""


def mixed_inner(kind: str, now: str, nxt: str, offset: str, lam: float, tag: str) -> str:
    """One majorisation step of one block; ``offset`` holds the other block's part of each row."""
    on = "feature" if kind == "fixed" else "entity_id, feature"
    rows = N if kind == "fixed" else "n"
    sizes = "" if kind == "fixed" else " JOIN ne USING (entity_id)"
    return f"""s{tag} AS MATERIALIZED (SELECT row_id, label, o + sum(w) AS s FROM ex JOIN {now} USING ({on}) JOIN {offset} USING (row_id) GROUP BY row_id, label, o),
g{tag} AS MATERIALIZED (SELECT {on}, sum(-label / (1 + exp(label * s))) AS g, count(*) AS c FROM ex JOIN s{tag} USING (row_id, label) GROUP BY {on}),
{nxt} AS MATERIALIZED (SELECT {on}, (c * 0.75 / {rows} * w - g / {rows}) / (c * 0.75 / {rows} + {lam}) AS w FROM {now} JOIN g{tag} USING ({on}){sizes})"""


def mixed_round(i: int, inner: int, lam: tuple = (0.001, 0.1)) -> str:
    parts = [f"of{i} AS MATERIALIZED (SELECT row_id, sum(w) AS o FROM ex JOIN r{i}_0 USING (entity_id, feature) GROUP BY row_id)"]
    parts += [mixed_inner("fixed", f"f{i}_{j}", f"f{i}_{j + 1}", f"of{i}", lam[0], f"f{i}{j}") for j in range(inner)]
    parts += [f"oq{i} AS MATERIALIZED (SELECT row_id, sum(w) AS o FROM ex JOIN f{i}_{inner} USING (feature) GROUP BY row_id)"]
    parts += [mixed_inner("random", f"r{i}_{j}", f"r{i}_{j + 1}", f"oq{i}", lam[1], f"r{i}{j}") for j in range(inner)]
    parts += [f"f{i + 1}_0 AS (SELECT * FROM f{i}_{inner})", f"r{i + 1}_0 AS (SELECT * FROM r{i}_{inner})"]
    return ", ".join(parts)


ORACLES["mixed_fit"] = f"""WITH {MX}, ne AS (SELECT entity_id, count(*) AS n FROM base GROUP BY entity_id),
f0_0 AS (SELECT * FROM w0), r0_0 AS (SELECT * FROM wr), {mixed_round(0, 3)}, {mixed_round(1, 3)}
SELECT '' AS model_key, feature, {r('w')} AS w FROM f2_0 UNION ALL SELECT entity_id, feature, {r('w')} FROM r2_0"""

ORACLES["mixed_fit_lbfgs"] = f"""WITH {MX}, ne AS (SELECT entity_id, count(*) AS n FROM base GROUP BY entity_id),
f0_0 AS (SELECT * FROM w0), r0_0 AS (SELECT * FROM wr), {mixed_round(0, 30, (0.1, 1.0))}, {mixed_round(1, 30, (0.1, 1.0))}
SELECT '' AS model_key, feature, {r('w', 3)} AS w FROM f2_0 UNION ALL SELECT entity_id, feature, {r('w', 3)} FROM r2_0"""


def tree_level(t: int, level: int) -> str:
    """Split every node of x{t}_{level} by its best feature."""
    name = f"{t}_{level}"
    return f"""a{name} AS MATERIALIZED (SELECT node, sum(rs) AS s, count(*) AS n FROM x{name} GROUP BY node),
l{name} AS MATERIALIZED (SELECT node, feature, sum(rs) AS l, count(*) AS m FROM (SELECT node, rs, unnest([f1, f2, f3]) AS feature FROM x{name}) GROUP BY node, feature),
q{name} AS MATERIALIZED (SELECT node, feature, l * l / m + (s - l) * (s - l) / (n - m) - s * s / n AS gain FROM l{name} JOIN a{name} USING (node) WHERE m < n),
h{name} AS MATERIALIZED (SELECT node, feature, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature) AS rn,
  max(gain) OVER (PARTITION BY node) AS best FROM q{name}),
x{t}_{level + 1} AS MATERIALIZED (SELECT row_id, label, f, f1, f2, f3, rs, CASE WHEN h.feature IS NULL THEN x.node
    WHEN h.feature IN (f1, f2, f3) THEN x.node * 2 ELSE x.node * 2 + 1 END AS node
  FROM x{name} x LEFT JOIN h{name} h ON h.node = x.node AND h.rn = 1 AND h.best > 0.000000001)"""


def tree_round(t: int) -> str:
    return f"""x{t}_0 AS MATERIALIZED (SELECT *, label / (1 + exp(label * f)) AS rs, 1 AS node FROM y{t}), {tree_level(t, 0)}, {tree_level(t, 1)},
y{t + 1} AS MATERIALIZED (SELECT row_id, label, f + avg(rs) OVER (PARTITION BY node) AS f, f1, f2, f3 FROM x{t}_2)"""


ORACLES["boosted_fit"] = f"""WITH {RESIDUAL}, y0 AS (SELECT row_id, label, ln(p / (1 - p)) AS f, f1, f2, f3 FROM base, pr),
{tree_round(0)}, {tree_round(1)}, {tree_round(2)} SELECT row_id, label, {r('f')} AS score FROM y3"""


MEAN = "avg(ln(1 + exp(-label * s)))"
HISTORIES = {
    "gradient": [f"WITH {SCORED} SELECT {MEAN} AS loss FROM scored", f"""WITH {GRADS}, w1 AS (SELECT feature, w - 0.5 * (g / {N} + 0.1 * w) AS w FROM w0 JOIN grads USING (feature)),
{next_scores('w1', 's1')} SELECT {MEAN} AS loss FROM s1"""],
    "majorized": ["SELECT ln(CAST(2 AS DOUBLE)) AS loss", f"""WITH {W0.replace(hash_weight('feature'), 'CAST(0 AS DOUBLE)')}, d AS (SELECT feature, count(*) * CAST(0.75 AS DOUBLE) / {N} AS d FROM ex GROUP BY feature),
{next_scores('w0', 's0')}, {next_grads('s0', 'g0')}, w1 AS (SELECT feature, (d * w - g / {N}) / (d + 0.01) AS w FROM w0 JOIN d USING (feature) JOIN g0 USING (feature)),
{next_scores('w1', 's1')} SELECT {MEAN} AS loss FROM s1"""],
    "fm": [f"""WITH {FM_START}, {', '.join(fm_descent(i, 0.5) for i in range(t))}{', ' if t else ''}{fm_step(t)}
SELECT avg(ln(1 + exp(-label * (b + lin + 0.5 * (s0 * s0 - q0 + s1 * s1 - q1))))) AS loss FROM fp{t}""" for t in range(2)],
    "boosted": [f"""WITH {RESIDUAL}, y0 AS (SELECT row_id, label, ln(p / (1 - p)) AS f, f1, f2, f3 FROM base, pr){''.join(', ' + tree_round(i) for i in range(t))}
SELECT avg(ln(1 + exp(-label * f))) AS loss FROM y{t}""" for t in range(2)],
}
ORACLES["loss_history"] = " UNION ALL ".join(
    f"SELECT '{name}' AS trainer, CAST({t} AS BIGINT) AS iteration, {r('loss')} AS loss FROM ({sql})" for name, found in HISTORIES.items() for t, sql in enumerate(found, start=1)
)

# sequential passes as recursion over the row number inside each group


def ordered(group: str, offsets: str = "") -> str:
    """``ord``: events numbered inside their group, with the features of each as a list."""
    o = "o" if offsets else "CAST(0 AS DOUBLE)"
    join = f" JOIN {offsets} USING (row_id)" if offsets else ""
    return f"""SELECT {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY row_id) AS i, label, [f1, f2, f3] AS fs, {o} AS o FROM base{join}"""


def sgd_pass(name: str, order: str, start: str, alpha: float, lam: float) -> str:
    """Recursive SGD pass: ``start(grp, feature, w)`` through the rows of ``order``; ``{name}_end`` is the result."""
    return f"""{name}_ord AS MATERIALIZED ({order}),
{name} AS (SELECT CAST(0 AS BIGINT) AS t, grp, feature, w FROM ({start})
  UNION ALL SELECT t + 1, grp, feature, w - {alpha} / sqrt(t + 1) * (CASE WHEN hit THEN -label / (1 + exp(label * s)) ELSE 0 END + {lam} * w)
  FROM (SELECT a.t, a.grp, a.feature, a.w, e.label, list_contains(e.fs, a.feature) AS hit,
      e.o + sum(CASE WHEN list_contains(e.fs, a.feature) THEN a.w ELSE 0 END) OVER (PARTITION BY a.grp) AS s
    FROM {name} a JOIN {name}_ord e ON e.grp = a.grp AND e.i = a.t + 1)),
{name}_n AS (SELECT grp, max(i) AS n FROM {name}_ord GROUP BY grp),
{name}_end AS MATERIALIZED (SELECT grp, feature, w, n FROM {name} JOIN {name}_n USING (grp) WHERE t = n)"""


SHARD = f"{hash_int('CAST(row_id AS VARCHAR)')} % 4"
SHARDED_W0 = "SELECT grp, feature, w FROM w0, (SELECT DISTINCT " + SHARD + " AS grp FROM base)"
RECURSIVE_W0 = W0.replace("base AS", "RECURSIVE base AS", 1)
ORACLES["lr_sgd_avg"] = f"""WITH {RECURSIVE_W0}, {sgd_pass('p', ordered(SHARD), SHARDED_W0, 0.1, 0.001)}
SELECT feature, {r('sum(w * n) / sum(n)')} AS w FROM p_end GROUP BY feature"""
ORACLES["mixed_fit_sgd"] = f"""WITH {MX.replace('base AS', 'RECURSIVE base AS', 1)},
oq AS MATERIALIZED (SELECT row_id, q AS o FROM mx), {sgd_pass('p', ordered(SHARD, 'oq'), SHARDED_W0, 0.1, 0.001)},
fx AS MATERIALIZED (SELECT feature, sum(w * n) / sum(n) AS w FROM p_end GROUP BY feature),
of AS MATERIALIZED (SELECT row_id, sum(w) AS o FROM ex JOIN fx USING (feature) GROUP BY row_id),
{sgd_pass('e', ordered('entity_id', 'of'), 'SELECT entity_id AS grp, feature, w FROM wr', 0.1, 0.01)}
SELECT '' AS model_key, feature, {r('w')} AS w FROM fx UNION ALL SELECT grp, feature, {r('w')} FROM e_end"""

FTRL_W = ftrl_weight("z", "n", 0.5, 0.5, 0.1)
ORACLES["ftrl_per_user"] = f"""WITH {EX.replace('base AS', 'RECURSIVE base AS', 1)}, ord AS MATERIALIZED ({ordered('entity_id')}),
st AS (SELECT DISTINCT CAST(0 AS BIGINT) AS t, entity_id AS grp, feature, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS n FROM ex
  UNION ALL SELECT t + 1, grp, feature, CASE WHEN hit THEN {ftrl_z('g', 'n', 'w', 'z', 0.5)} ELSE z END, CASE WHEN hit THEN n + g * g ELSE n END
  FROM (SELECT *, -label / (1 + exp(label * s)) AS g FROM (
    SELECT *, sum(CASE WHEN hit THEN w ELSE 0 END) OVER (PARTITION BY grp) AS s FROM (
      SELECT st.t, st.grp, st.feature, st.z, st.n, e.label, list_contains(e.fs, st.feature) AS hit, {FTRL_W.replace('z', 'st.z').replace('(n)', '(st.n)')} AS w
      FROM st JOIN ord e ON e.grp = st.grp AND e.i = st.t + 1)))),
last AS (SELECT grp, max(i) AS t FROM ord GROUP BY grp)
SELECT grp AS model_key, feature, {r(FTRL_W)} AS w FROM st JOIN last USING (grp, t)"""

FM_BIAS = "max(CASE WHEN a.feature = '__bias__' THEN a.w END) OVER (PARTITION BY a.grp)"


def fm_sum(value: str) -> str:
    return f"sum(CASE WHEN list_contains(e.fs, a.feature) THEN {value} ELSE 0 END) OVER (PARTITION BY a.grp)"


ORACLES["fm_sgd_avg"] = f"""WITH {FM_START.replace('base AS', 'RECURSIVE base AS', 1)}, ord AS MATERIALIZED ({ordered(SHARD)}),
st AS (SELECT CAST(0 AS BIGINT) AS t, grp, feature, w, v0, v1 FROM (SELECT * FROM m0 UNION ALL SELECT '__bias__', 0, 0, 0), (SELECT DISTINCT grp FROM ord)
  UNION ALL SELECT t + 1, grp, feature,
    w - 0.1 / sqrt(t + 1) * (CASE WHEN hit OR feature = '__bias__' THEN m ELSE 0 END + CASE WHEN feature = '__bias__' THEN 0 ELSE 0.001 * w END),
    v0 - 0.1 / sqrt(t + 1) * (CASE WHEN hit THEN m * (s0 - v0) ELSE 0 END + 0.001 * v0),
    v1 - 0.1 / sqrt(t + 1) * (CASE WHEN hit THEN m * (s1 - v1) ELSE 0 END + 0.001 * v1)
  FROM (SELECT *, -label / (1 + exp(label * (b + lin + 0.5 * (s0 * s0 - q0 + s1 * s1 - q1)))) AS m FROM (
    SELECT a.t, a.grp, a.feature, a.w, a.v0, a.v1, e.label, list_contains(e.fs, a.feature) AS hit, {FM_BIAS} AS b, {fm_sum('a.w')} AS lin,
      {fm_sum('a.v0')} AS s0, {fm_sum('a.v1')} AS s1, {fm_sum('a.v0 * a.v0')} AS q0, {fm_sum('a.v1 * a.v1')} AS q1
    FROM st a JOIN ord e ON e.grp = a.grp AND e.i = a.t + 1))),
last AS (SELECT grp, max(i) AS t FROM ord GROUP BY grp)
SELECT feature, {r('sum(w * t) / sum(t)')} AS w, {r('sum(v0 * t) / sum(t)')} AS v0, {r('sum(v1 * t) / sum(t)')} AS v1
FROM st JOIN last USING (grp, t) GROUP BY feature"""


ORACLES["stream_ftrl_per_key"] = ORACLES["ftrl_per_user"]

# trees on numeric columns

NUMBERS = ("price", "balance", "month")
SHARES = [i / 16 for i in range(1, 16)]
BINNED = f"""nlog AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label,
    CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, CAST(month(o_orderdate) AS DOUBLE) AS month
  FROM orders JOIN customer ON o_custkey = c_custkey),
cuts AS (SELECT {', '.join(f'list_distinct(quantile_disc({c}, {SHARES})) AS q_{c}' for c in NUMBERS)} FROM nlog),
odds AS (SELECT ln(p / (1 - p)) AS bias FROM (SELECT avg(CAST(label > 0 AS INTEGER)) AS p FROM nlog)),
ht0 AS MATERIALIZED (SELECT row_id, label, bias AS f, [{', '.join(f'CASE WHEN {c} IS NULL THEN -1 ELSE len([c for c in q_{c} if c < {c}]) END' for c in NUMBERS)}] AS b FROM nlog, cuts, odds)"""
LEFT = "(CASE WHEN b[col + 1] = -1 THEN missing_left ELSE b[col + 1] <= bin END)"


def hist_gains(rows: str, tag: str) -> str:
    """Gains of all splits of the rows (node, res, b)."""
    gain = "nl_s * nl_s / nl + (ts - nl_s) * (ts - nl_s) / (tn - nl) - ts * ts / tn"
    return f"""hh{tag} AS MATERIALIZED (SELECT node, col, bin, sum(res) AS s, count(*) AS n FROM (SELECT node, res, unnest([0, 1, 2]) AS col, unnest(b) AS bin FROM {rows}) GROUP BY ALL),
hw{tag} AS (SELECT node, col, bin, sum(CASE WHEN bin >= 0 THEN s ELSE 0 END) OVER (PARTITION BY node, col ORDER BY bin) AS ls, sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER (PARTITION BY node, col ORDER BY bin) AS ln,
    sum(CASE WHEN bin < 0 THEN s ELSE 0 END) OVER (PARTITION BY node, col) AS ms, sum(CASE WHEN bin < 0 THEN n ELSE 0 END) OVER (PARTITION BY node, col) AS mn,
    sum(s) OVER (PARTITION BY node, col) AS ts, sum(n) OVER (PARTITION BY node, col) AS tn FROM hh{tag}),
hc{tag} AS (SELECT node, col, bin, missing_left, ts, tn, ls + CASE WHEN missing_left THEN ms ELSE 0 END AS nl_s, ln + CASE WHEN missing_left THEN mn ELSE 0 END AS nl
  FROM hw{tag}, (SELECT unnest([true, false]) AS missing_left) WHERE bin >= 0),
hg{tag} AS (SELECT node, col, bin, missing_left, tn AS n, nl AS n_left, {gain} AS gain FROM hc{tag} WHERE nl > 0 AND nl < tn)"""


def hist_best(by: str, tag: str) -> str:
    return f"""hb{tag} AS MATERIALIZED (SELECT * FROM hg{tag} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY -round(gain, 9), col, bin, NOT missing_left) = 1)"""


def hist_tree(t: int, depth: int, rate: float) -> str:
    parts = [f"hn{t}_0 AS MATERIALIZED (SELECT row_id, label, f, b, 1 AS node, label / (1 + exp(label * f)) AS res FROM ht{t})"]
    for d in range(depth):
        tag = f"{t}_{d}"
        parts += [hist_gains(f"hn{tag}", tag), hist_best("node", tag)]
        parts += [f"""hn{t}_{d + 1} AS MATERIALIZED (SELECT row_id, label, f, b, CASE WHEN gain IS NULL OR gain <= 1e-9 THEN node WHEN {LEFT} THEN 2 * node ELSE 2 * node + 1 END AS node, res
  FROM hn{tag} LEFT JOIN hb{tag} USING (node))"""]
    parts += [f"""ht{t + 1} AS MATERIALIZED (SELECT row_id, label, f + {rate} * avg(res) OVER (PARTITION BY node) AS f, b FROM hn{t}_{depth})"""]
    return ", ".join(parts)


ORACLES["hist_best_split"] = f"""WITH {BINNED}, hn AS (SELECT 1 AS node, label / (1 + exp(label * f)) AS res, b FROM ht0), {hist_gains('hn', '')}, {hist_best('node, col', '')}
SELECT CAST(col AS BIGINT) AS col, CAST(bin AS BIGINT) AS bin, missing_left, CAST(n AS BIGINT) AS n, CAST(n_left AS BIGINT) AS n_left, {r('gain')} AS gain FROM hb"""
ORACLES["ctr_boosted"] = f"""WITH {BINNED}, {hist_tree(0, 3, 0.5)}, {hist_tree(1, 3, 0.5)} SELECT row_id, label, {r('f')} AS score FROM ht2"""

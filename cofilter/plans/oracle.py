"""DuckDB SQL equivalents of the registered queries.

The views ``events``, ``orders``, ``lineitem``, ``part``, ``customer`` are
the driver's parquet tables. Column names equal the Spark outputs; floats
are rounded to 6 digits on both sides. Results that depend on an iterative fit
(ALS) or on singular vectors have no entry: what SQL can say of them is in
als_rows, als_counts, svd_reconstruction and svd_moments, the rest is checked
against numpy in the unit tests."""

from __future__ import annotations

from cofilter.plans import inputs as inp

R_EVENTS = """r AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(count(*) AS DOUBLE) AS counts
  FROM events GROUP BY 1, 2)"""

R_ORDERS = """r AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, CAST(sum(l.l_quantity) AS DOUBLE) AS counts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)"""

EVENT_ROWS = """ev AS (
  SELECT event_id, event_type, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, value
  FROM events)"""


def _split(src: str = "r", frac=inp.SPLIT_FRAC, seed=inp.SPLIT_SEED) -> str:
    return f"""numbered AS (
  SELECT user_id, item_id, counts,
         row_number() OVER (ORDER BY md5(concat_ws('|', CAST(user_id AS VARCHAR),
                                                   CAST(item_id AS VARCHAR), '{seed}')),
                            user_id, item_id) - 1 AS rn,
         count(*) OVER () AS n
  FROM {src}),
train AS (SELECT user_id, item_id, counts FROM numbered WHERE rn < floor({frac} * n)),
test AS (SELECT user_id, item_id, counts FROM numbered WHERE rn >= floor({frac} * n))"""


def _kernels(R: str) -> str:
    """p, q, m(a, b, m_item, m_user) on matrix R."""
    return f"""p AS (SELECT user_id, sum(counts) AS p FROM {R} GROUP BY 1),
q AS (SELECT item_id, sum(counts) AS q FROM {R} GROUP BY 1),
k AS (
  SELECT x.item_id AS a, y.item_id AS b, sum(x.counts * y.counts) AS c,
         sum(x.counts * y.counts / sqrt(p.p)) AS cw
  FROM {R} x JOIN {R} y ON x.user_id = y.user_id JOIN p ON p.user_id = x.user_id
  GROUP BY 1, 2),
m AS (
  SELECT k.a, k.b, k.c / sqrt(qa.q) / sqrt(qb.q) AS m_item, k.cw AS m_user
  FROM k JOIN q qa ON qa.item_id = k.a JOIN q qb ON qb.item_id = k.b)"""


def _scores_full(R: str) -> str:
    """g(user_id, item_id, score_user, score_item) for every reachable cell."""
    return _kernels(R) + f""",
g AS (
  SELECT x.user_id, m.b AS item_id,
         sum(x.counts / sqrt(p.p) * m.m_user) AS score_user,
         sum(x.counts * m.m_item) AS score_item
  FROM {R} x JOIN m ON m.a = x.item_id JOIN p ON p.user_id = x.user_id
  GROUP BY 1, 2)"""


def _scores_pairs(R: str, pairs: str) -> str:
    """g restricted to the distinct (user_id, item_id) of ``pairs``."""
    return _kernels(R) + f""",
e AS (SELECT DISTINCT user_id, item_id FROM {pairs}),
g AS (
  SELECT e.user_id, e.item_id,
         sum(x.counts / sqrt(p.p) * m.m_user) AS score_user,
         sum(x.counts * m.m_item) AS score_item
  FROM e JOIN {R} x ON x.user_id = e.user_id
         JOIN m ON m.a = x.item_id AND m.b = e.item_id
         JOIN p ON p.user_id = e.user_id
  GROUP BY 1, 2)"""


def _model(model: str) -> str:
    return {"user": "g.score_user", "item": "g.score_item",
            "blend": "0.5 * g.score_user + 0.5 * g.score_item"}[model]


def _scored_rows(model: str, rows: str, R: str = "train") -> str:
    """sc(user_id, item_id, counts, pred [, part]) with the 0-when-no-path rule."""
    return _scores_pairs(R, rows) + f""",
sc AS (
  SELECT t.*, COALESCE({_model(model)}, 0.0) AS pred
  FROM {rows} t LEFT JOIN g ON g.user_id = t.user_id AND g.item_id = t.item_id)"""


def _spearman(src: str = "sc", grp: str = "") -> str:
    """sp(grp..., user_id, n, rho) from rows (user_id, counts, pred)."""
    g = f"{grp}, " if grp else ""
    return f"""rk AS (
  SELECT {g}user_id,
         rank() OVER (PARTITION BY {g}user_id ORDER BY counts)
           + (count(*) OVER (PARTITION BY {g}user_id, counts) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY {g}user_id ORDER BY round(pred, 9))
           + (count(*) OVER (PARTITION BY {g}user_id, round(pred, 9)) - 1) / 2.0 AS ry
  FROM {src}),
mo AS (
  SELECT {g}user_id, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * rx) AS sxx,
         sum(ry * ry) AS syy, sum(rx * ry) AS sxy
  FROM rk GROUP BY ALL),
mv AS (SELECT *, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy, sxy - sx * sy / n AS cxy FROM mo),
sp AS (
  SELECT {g}user_id, n,
         CASE WHEN n < 2 OR vx <= 0 OR vy <= 0 THEN NULL ELSE cxy / sqrt(vx * vy) END AS rho
  FROM mv)"""


R_EVENTS_LOG = R_EVENTS.replace("CAST(count(*) AS DOUBLE) AS counts", "ln(1 + count(*)) AS counts")


def _eval(model: str, r_cte: str = R_EVENTS) -> str:
    """E1 long metrics (part, metric, value)."""
    src = "r"
    rows = """rows_ AS (SELECT user_id, item_id, counts, 'test' AS part FROM test
          UNION ALL SELECT user_id, item_id, counts, 'train' AS part FROM train)"""
    body = f"""WITH {r_cte},
{_split(src)},
{rows},
{_scored_rows(model, 'rows_')},
{_spearman('sc', 'part')},
rm AS (SELECT part, count(*) AS n, sqrt(avg((counts - pred) * (counts - pred))) AS rmse
       FROM sc GROUP BY 1),
ss AS (SELECT part, count(rho) AS n_defined, avg(rho) AS mean_rho, count(*) AS n_users
       FROM sp GROUP BY 1)
SELECT part, 'rmse' AS metric, round(rmse, 6) AS value FROM rm
UNION ALL SELECT part, 'n', CAST(n AS DOUBLE) FROM rm
UNION ALL SELECT part, 'n_defined', CAST(n_defined AS DOUBLE) FROM ss
UNION ALL SELECT part, 'mean_rho', round(mean_rho, 6) FROM ss
UNION ALL SELECT part, 'n_users', CAST(n_users AS DOUBLE) FROM ss"""
    return body


def _eval_pieces(model: str = "item") -> str:
    return f"""WITH {EVENT_ROWS},
pieces AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS src_ord, user_id, item_id,
                  CAST(count(*) AS DOUBLE) AS counts
           FROM ev GROUP BY event_type, user_id, item_id),
train AS (SELECT * FROM pieces WHERE event_type <> '{inp.HELD_OUT_PIECE}'),
test AS (SELECT user_id, item_id, counts FROM pieces WHERE event_type = '{inp.HELD_OUT_PIECE}'),
rmat AS (SELECT user_id, item_id, arg_max(counts, src_ord) AS counts FROM train GROUP BY 1, 2),
rows_ AS (SELECT user_id, item_id, counts, 'test' AS part FROM test
          UNION ALL SELECT user_id, item_id, counts, 'train' AS part FROM train),
{_scored_rows(model, 'rows_', 'rmat')},
{_spearman('sc', 'part')},
rm AS (SELECT part, count(*) AS n, sqrt(avg((counts - pred) * (counts - pred))) AS rmse
       FROM sc GROUP BY 1),
ss AS (SELECT part, count(rho) AS n_defined, avg(rho) AS mean_rho, count(*) AS n_users
       FROM sp GROUP BY 1)
SELECT part, 'rmse' AS metric, round(rmse, 6) AS value FROM rm
UNION ALL SELECT part, 'n', CAST(n AS DOUBLE) FROM rm
UNION ALL SELECT part, 'n_defined', CAST(n_defined AS DOUBLE) FROM ss
UNION ALL SELECT part, 'mean_rho', round(mean_rho, 6) FROM ss
UNION ALL SELECT part, 'n_users', CAST(n_users AS DOUBLE) FROM ss"""


def _size_study(model: str = "item", fracs=(0.25, 0.5, 1.0)) -> str:
    parts = []
    for f in fracs:
        parts.append(f"""SELECT CAST({f} AS DOUBLE) AS frac, * FROM (
WITH {R_EVENTS},
numbered AS (
  SELECT user_id, item_id, counts,
         row_number() OVER (ORDER BY md5(concat_ws('|', CAST(user_id AS VARCHAR),
                                                   CAST(item_id AS VARCHAR), '{inp.SPLIT_SEED}')),
                            user_id, item_id) - 1 AS rn,
         count(*) OVER () AS n
  FROM r),
cutv AS (SELECT floor({inp.SPLIT_FRAC} * n) AS cut, n FROM numbered LIMIT 1),
train AS (SELECT user_id, item_id, counts FROM numbered, cutv
          WHERE rn < floor({f} * cutv.cut)),
test AS (SELECT user_id, item_id, counts FROM numbered, cutv
         WHERE rn >= cutv.cut AND rn < cutv.cut + floor({f} * (cutv.n - cutv.cut))),
rows_ AS (SELECT user_id, item_id, counts, 'test' AS part FROM test
          UNION ALL SELECT user_id, item_id, counts, 'train' AS part FROM train),
{_scored_rows(model, 'rows_')},
{_spearman('sc', 'part')},
rm AS (SELECT part, count(*) AS n, sqrt(avg((counts - pred) * (counts - pred))) AS rmse
       FROM sc GROUP BY 1),
ss AS (SELECT part, count(rho) AS n_defined, avg(rho) AS mean_rho, count(*) AS n_users
       FROM sp GROUP BY 1)
SELECT part, 'rmse' AS metric, round(rmse, 6) AS value FROM rm
UNION ALL SELECT part, 'n', CAST(n AS DOUBLE) FROM rm
UNION ALL SELECT part, 'n_defined', CAST(n_defined AS DOUBLE) FROM ss
UNION ALL SELECT part, 'mean_rho', round(mean_rho, 6) FROM ss
UNION ALL SELECT part, 'n_users', CAST(n_users AS DOUBLE) FROM ss)""")
    return "\nUNION ALL\n".join(parts)


def _target_and_candidates() -> str:
    return f"""tgt AS (
  SELECT user_id FROM (SELECT user_id, sum(counts) AS p FROM r GROUP BY 1)
  ORDER BY p DESC, user_id LIMIT 1),
cand AS (SELECT tgt.user_id, c.item_id
         FROM (SELECT DISTINCT item_id FROM r ORDER BY item_id LIMIT {inp.N_CANDIDATES}) c, tgt)"""


def _pivot() -> str:
    cols = ",\n  ".join(
        f'COALESCE(max(CASE WHEN item_id = {k} THEN counts END), 0.0) AS "{k}"' for k in range(100))
    return f"""WITH {R_EVENTS}
SELECT user_id,
  {cols}
FROM r GROUP BY user_id"""


def _power_iteration(steps: int = 18) -> str:
    """The first singular value of R_ORDERS: power iteration on RᵀR, step by step
    scaled to length 1. All cells are positive, so the first value stands apart."""
    steps_sql = "".join(f""",
y{j} AS MATERIALIZED (SELECT r.user_id, sum(r.counts * v{j}.x) AS y FROM r JOIN v{j} USING (item_id) GROUP BY 1),
z{j} AS MATERIALIZED (SELECT r.item_id, sum(r.counts * y{j}.y) AS z FROM r JOIN y{j} USING (user_id) GROUP BY 1),
v{j + 1} AS MATERIALIZED (SELECT item_id, z / (SELECT sqrt(sum(z * z)) FROM z{j}) AS x FROM z{j})""" for j in range(steps))
    return f"""WITH {R_ORDERS.replace("r AS (", "r AS MATERIALIZED (", 1)},
v0 AS (SELECT item_id, 1.0 / sqrt(count(*) OVER ()) AS x FROM (SELECT DISTINCT item_id FROM r)){steps_sql}
SELECT CAST(1 AS INTEGER) AS k, round(sqrt((SELECT sqrt(sum(z * z)) FROM z{steps - 1})), 4) AS singular_value,
       round((SELECT sqrt(sum(z * z)) FROM z{steps - 1}) / (SELECT sum(counts * counts) FROM r), 6) AS energy"""


def oracle_sql() -> dict[str, str]:
    w = f"WITH {R_EVENTS}"
    ws = f"WITH {R_EVENTS},\n{_split()}"
    return {
        "read_triples": f"""{w}
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
       CAST(counts AS INTEGER) AS counts FROM r""",
        "read_dimensions": """
SELECT 'item' AS kind, concat('part', CAST(p_partkey AS VARCHAR)) AS key, p_partkey AS idx FROM part
UNION ALL SELECT 'user' AS kind, c_name AS key, CAST(NULL AS BIGINT) AS idx FROM customer""",
        "read_dense_matrix": f"""{w}
SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS row_idx,
       dense_rank() OVER (ORDER BY item_id) - 1 AS col_idx, counts AS value FROM r""",
        "read_titles": """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS item_idx, p_name AS title FROM part""",
        "read_sources": f"""WITH {EVENT_ROWS}
SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS src_ord,
       CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, CAST(count(*) AS INTEGER) AS counts
FROM ev
GROUP BY event_type, user_id, item_id""",
        "write_split_tsv": f"{ws}\nSELECT user_id, item_id, counts FROM train",
        "write_split_test_tsv": f"{ws}\nSELECT user_id, item_id, counts FROM test",
        "log_scale": f"{w}\nSELECT user_id, item_id, counts, round(ln(1 + counts), 6) AS rating FROM r",
        "cold_start_filter": f"""{ws}
SELECT user_id, item_id, counts FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        "cold_start_count": f"""{ws}
SELECT count(*) AS n_test,
       count(CASE WHEN user_id IN (SELECT user_id FROM train)
                   AND item_id IN (SELECT item_id FROM train) THEN 1 END) AS n_known
FROM test""",
        "metrics_line": f"""{ws}
SELECT count(*) AS n_test,
       count(CASE WHEN user_id IN (SELECT user_id FROM train)
                   AND item_id IN (SELECT item_id FROM train) THEN 1 END) AS n_known
FROM test""",
        "degree_norms": f"""{w}
SELECT 'user' AS side, user_id AS key, sum(counts) AS total,
       round(CASE WHEN sum(counts) = 0 THEN 0 ELSE 1 / sqrt(sum(counts)) END, 6) AS inv_sqrt
FROM r GROUP BY user_id
UNION ALL
SELECT 'item', item_id, sum(counts),
       round(CASE WHEN sum(counts) = 0 THEN 0 ELSE 1 / sqrt(sum(counts)) END, 6)
FROM r GROUP BY item_id""",
        "user_candidates": f"""{w},
{_target_and_candidates()},
{_scores_pairs('r', 'cand')}
SELECT c.user_id, c.item_id, round(COALESCE(g.score_user, 0.0), 6) AS score
FROM cand c LEFT JOIN g ON g.user_id = c.user_id AND g.item_id = c.item_id""",
        "head_n": f"""WITH {EVENT_ROWS}
SELECT event_id, user_id, item_id, value FROM ev ORDER BY event_id LIMIT {inp.HEAD_N}""",
        "split_train": f"{ws}\nSELECT user_id, item_id, counts FROM train",
        "split_test": f"{ws}\nSELECT user_id, item_id, counts FROM test",
        "index_dense": f"""{w}
SELECT 'user' AS side, user_id AS key, dense_rank() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM r)
UNION ALL
SELECT 'item', item_id, dense_rank() OVER (ORDER BY item_id) - 1 FROM (SELECT DISTINCT item_id FROM r)""",
        "index_first_seen": f"""WITH {EVENT_ROWS}
SELECT 'user' AS side, user_id AS key, row_number() OVER (ORDER BY f, user_id) - 1 AS idx
FROM (SELECT user_id, min(event_id) AS f FROM ev GROUP BY 1)
UNION ALL
SELECT 'item', item_id, row_number() OVER (ORDER BY f, item_id) - 1
FROM (SELECT item_id, min(event_id) AS f FROM ev GROUP BY 1)""",
        "index_first_row": f"""WITH {EVENT_ROWS},
pos AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM ev)
SELECT 'user' AS side, user_id AS key, min(rn) AS idx FROM pos GROUP BY user_id
UNION ALL
SELECT 'item', item_id, min(rn) FROM pos GROUP BY item_id""",
        "global_row_number": """
SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS row_no FROM events""",
        "encode_triples": f"""{w}
SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx,
       dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx, counts FROM r""",
        "actual_vs_pred": f"""{ws},
{_scores_pairs('train', 'test')}
SELECT t.user_id, t.item_id, t.counts, round(g.score_item, 6) AS pred
FROM test t JOIN g ON g.user_id = t.user_id AND g.item_id = t.item_id""",
        **{f"score_pairs_{m}": f"""{ws},
{_scored_rows(m, 'test')}
SELECT user_id, item_id, counts, round(pred, 6) AS pred FROM sc""" for m in ("item", "user", "blend")},
        **{f"rmse_{m}": f"""{ws},
{_scored_rows(m, 'test')}
SELECT count(*) AS n, round(sqrt(avg((counts - pred) * (counts - pred))), 6) AS rmse FROM sc"""
           for m in ("item", "user", "blend")},
        "topk_titles": f"""{w},
{_target_and_candidates()},
{_scores_pairs('r', 'cand')},
s AS (
  SELECT 'user' AS model, c.item_id, COALESCE(g.score_user, 0.0) AS score
  FROM cand c LEFT JOIN g ON g.user_id = c.user_id AND g.item_id = c.item_id
  UNION ALL
  SELECT 'item', c.item_id, COALESCE(g.score_item, 0.0)
  FROM cand c LEFT JOIN g ON g.user_id = c.user_id AND g.item_id = c.item_id)
SELECT s.model, row_number() OVER (PARTITION BY s.model ORDER BY round(s.score, 9) DESC, s.item_id) AS rank,
       s.item_id, p.p_name AS title, round(s.score, 6) AS score
FROM s JOIN part p ON p.p_partkey = s.item_id""",
        "describe_counts": f"""WITH {R_ORDERS}
SELECT count(counts) AS count, round(avg(counts), 6) AS mean, round(stddev_samp(counts), 6) AS std,
       round(min(counts), 6) AS min, round(quantile_cont(counts, 0.25), 6) AS p25,
       round(quantile_cont(counts, 0.5), 6) AS p50, round(quantile_cont(counts, 0.75), 6) AS p75,
       round(max(counts), 6) AS max
FROM r""",
        "matrix_shape": f"""{w}
SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, count(DISTINCT user_id) AS n_users,
       count(DISTINCT item_id) AS n_items FROM r""",
        "distinct_counts": f"""WITH {R_ORDERS}
SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT item_id) AS n_item_id FROM r""",
        "rating_histogram": f"""{w}
SELECT round(ln(1 + counts), 6) AS rating, count(user_id) AS n_user_id, count(item_id) AS n_item_id,
       count(counts) AS n_counts FROM r GROUP BY 1""",
        "spearman_per_user": f"""{ws},
{_scored_rows('item', 'test')},
{_spearman('sc')}
SELECT user_id, n, round(rho, 6) AS rho FROM sp""",
        "spearman_mean": f"""{ws},
{_scored_rows('item', 'test')},
{_spearman('sc')}
SELECT count(rho) AS n_defined, round(avg(rho), 6) AS mean_rho, count(*) AS n_users FROM sp""",
        "frobenius_energy": f"{w}\nSELECT sum(counts * counts) AS sum_sq, count(*) AS n_cells FROM r",
        "svd_reconstruction": f"{w}\nSELECT user_id, item_id, counts FROM r",
        "svd_orders_top": _power_iteration(),
        "svd_orders_residual": "SELECT CAST(k AS INTEGER) AS k, CAST(0 AS DOUBLE) AS residual FROM range(1, 17) t(k)",
        "svd_moments": f"""{w},
k AS (SELECT sum(x.counts * y.counts) AS c FROM r x JOIN r y ON x.user_id = y.user_id GROUP BY x.item_id, y.item_id)
SELECT round((SELECT sum(counts * counts) FROM r), 2) AS s2, round((SELECT sum(c * c) FROM k), 1) AS s4""",
        "als_rows": f"""{ws}
SELECT 'train' AS part, user_id, item_id, counts FROM train
UNION ALL SELECT 'test', user_id, item_id, counts FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        "als_counts": f"""{ws}
SELECT 'train' AS part, count(*) AS n FROM train
UNION ALL SELECT 'test', count(*) FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        "als_residual": f"""{ws}
SELECT count(DISTINCT user_id) AS n_users, count(*) AS n_ratings, CAST(0 AS DOUBLE) AS residual FROM train""",
        "als_saved": f"""{ws}
SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        "svd_topk_users": f"""{w},
t AS (SELECT u.user_id, i.item_id, coalesce(r.counts, 0) AS score,
             row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(r.counts, 0) DESC, i.item_id) AS rank
      FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN (SELECT DISTINCT item_id FROM r) i
      LEFT JOIN r ON r.user_id = u.user_id AND r.item_id = i.item_id)
SELECT user_id, rank, item_id, round(CAST(score AS DOUBLE), 5) AS score FROM t WHERE rank <= {inp.TOP_K}""",
        "map_per_user": f"""{ws},
{_scored_rows('item', 'test')},
rv AS (SELECT user_id, counts, round(pred, 9) AS p FROM sc),
disc AS (SELECT 0 AS n, 0.0 AS d UNION ALL
      SELECT n, sum(1 / log2(n + 1)) OVER (ORDER BY n) FROM range(1, {inp.TOP_K + 1}) t(n)),
steps AS (SELECT user_id, p, count(*) AS ties, sum(counts) AS gain, count(*) FILTER (counts >= {inp.RELEVANT}) AS rel
      FROM rv GROUP BY 1, 2),
cum AS (SELECT *, sum(ties) OVER w AS z, sum(rel) OVER w AS relz FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY p DESC)),
got AS (SELECT cum.user_id, sum(ties) AS n, sum(rel) AS n_relevant,
             sum(rel * relz / z) / nullif(sum(rel), 0) AS ap,
             sum(gain / ties * (b.d - e.d)) AS dcg
      FROM cum JOIN disc b ON b.n = least(z, {inp.TOP_K}) JOIN disc e ON e.n = least(z - ties, {inp.TOP_K}) GROUP BY 1),
ideal AS (SELECT user_id, sum(counts / log2(k + 1)) AS idcg
      FROM (SELECT user_id, counts, row_number() OVER (PARTITION BY user_id ORDER BY counts DESC) AS k FROM rv)
      WHERE k <= {inp.TOP_K} GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, CAST(n_relevant AS BIGINT) AS n_relevant, round(ap, 6) AS ap,
       round(dcg / nullif(idcg, 0), 6) AS ndcg
FROM got JOIN ideal USING (user_id)""",
        "mse_rmse_known": f"""{ws},
known AS (SELECT user_id, item_id, counts FROM test
          WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)),
{_scored_rows('item', 'known')}
SELECT 'test' AS part, count(*) AS n, round(avg((counts - pred) * (counts - pred)), 6) AS mse,
       round(sqrt(avg((counts - pred) * (counts - pred))), 6) AS rmse FROM sc""",
        "sample_scores": f"""WITH {R_EVENTS},
{_split(frac=inp.SAMPLE_FRAC)},
{_scores_full('train')}
SELECT user_id, item_id, round(score_user, 6) AS score_user, round(score_item, 6) AS score_item FROM g""",
        "profile_events": f"""WITH {EVENT_ROWS}
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM ev""",
        "average_rank": f"""{ws}
SELECT user_id, counts, item_id,
       rank() OVER (PARTITION BY user_id ORDER BY counts)
         + (count(*) OVER (PARTITION BY user_id, counts) - 1) / 2.0 AS avg_rank
FROM test""",
        "last_write_matrix": f"""WITH {EVENT_ROWS}
SELECT user_id, item_id, arg_max(value, event_id) AS value FROM ev GROUP BY 1, 2""",
        "topk_per_user": f"""{w},
{_scores_full('r')},
t AS (SELECT user_id, item_id, score_item AS score,
             row_number() OVER (PARTITION BY user_id ORDER BY round(score_item, 9) DESC, item_id) AS rank
      FROM g)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM t WHERE rank <= {inp.TOP_K}""",
        "topk_per_user_orders": f"""WITH {R_ORDERS},
{_scores_full('r')},
t AS (SELECT user_id, item_id, score_item AS score,
             row_number() OVER (PARTITION BY user_id ORDER BY round(score_item, 9) DESC, item_id) AS rank
      FROM g)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM t WHERE rank <= {inp.TOP_K}""",
        "item_neighbours": f"""WITH {R_ORDERS},
{_kernels('r')},
n AS (SELECT a, b, m_item, row_number() OVER (PARTITION BY a ORDER BY round(m_item, 9) DESC, b) AS rank
      FROM m WHERE a <> b AND m_item <> 0)
SELECT a AS item_i, CAST(rank AS INTEGER) AS rank, b AS item_j, round(m_item, 6) AS sim FROM n WHERE rank <= {inp.TOP_K}""",
        "similar_items": f"""WITH {R_ORDERS},
{_kernels('r')}
SELECT a AS item_i, b AS item_j, round(m_item, 6) AS sim FROM m WHERE a <> b AND m_item >= {inp.SIMILAR}""",
        "stream_last_write": f"""WITH {EVENT_ROWS}
SELECT user_id, item_id, CAST(arg_max(value, event_id) AS DOUBLE) AS value FROM ev GROUP BY 1, 2""",
        "stream_sums": f"""WITH {EVENT_ROWS},
m AS (SELECT user_id, item_id, CAST(arg_max(value, event_id) AS DOUBLE) AS value FROM ev GROUP BY 1, 2)
SELECT 'user' AS side, user_id AS key, round(sum(value), 4) AS total FROM m GROUP BY 2
UNION ALL SELECT 'item', item_id, round(sum(value), 4) FROM m GROUP BY 2""",
        "index_incremental": f"""WITH {EVENT_ROWS},
k AS (SELECT 'user' AS side, user_id AS key, min(event_id) > (SELECT max(event_id) FROM ev) / 2 AS late FROM ev GROUP BY 2
      UNION ALL SELECT 'item', item_id, min(event_id) > (SELECT max(event_id) FROM ev) / 2 FROM ev GROUP BY 2)
SELECT side, key, row_number() OVER (PARTITION BY side ORDER BY late, key) - 1 AS idx FROM k WHERE key IS NOT NULL""",
        "union_train": f"""WITH {EVENT_ROWS}
SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS src_ord,
       user_id, item_id, CAST(count(*) AS DOUBLE) AS counts
FROM ev
GROUP BY event_type, user_id, item_id""",
        "universe": f"""WITH {EVENT_ROWS},
e AS (SELECT * FROM ev)
SELECT DISTINCT 'user' AS side, user_id AS key FROM e
UNION ALL SELECT DISTINCT 'item', item_id FROM e""",
        "same_users_check": """
WITH a AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS ia
           FROM events WHERE event_type = 'click' GROUP BY user_id),
     b AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS ib
           FROM events WHERE event_type = 'view' GROUP BY user_id),
     j AS (SELECT a.ia, b.ib FROM a FULL OUTER JOIN b ON a.user_id = b.user_id),
     s AS (SELECT count(ia) AS n_left, count(ib) AS n_right, count(*) AS n,
                  sum(CASE WHEN ia IS NOT DISTINCT FROM ib THEN 0 ELSE 1 END) AS d FROM j)
SELECT (n_left = n AND n_right = n) AS same_set,
       (n_left = n AND n_right = n AND COALESCE(d, 0) = 0) AS same_order, n_left, n_right FROM s""",
        "matrix_pivot": _pivot(),
        "item_similarity": f"""{w},
q AS (SELECT item_id, sum(counts) AS q FROM r GROUP BY 1)
SELECT x.item_id AS item_i, y.item_id AS item_j,
       round(sum(x.counts * y.counts) / sqrt(any_value(qa.q)) / sqrt(any_value(qb.q)), 6) AS sim
FROM r x JOIN r y ON x.user_id = y.user_id
     JOIN q qa ON qa.item_id = x.item_id JOIN q qb ON qb.item_id = y.item_id
GROUP BY 1, 2""",
        "user_similarity": f"""{w},
p AS (SELECT user_id, sum(counts) AS p FROM r GROUP BY 1)
SELECT x.user_id AS user_u, y.user_id AS user_v,
       round(sum(x.counts * y.counts) / sqrt(any_value(pa.p)) / sqrt(any_value(pb.p)), 6) AS sim
FROM r x JOIN r y ON x.item_id = y.item_id
     JOIN p pa ON pa.user_id = x.user_id JOIN p pb ON pb.user_id = y.user_id
GROUP BY 1, 2""",
        **{f"score_{m}": f"""{w},
{_scores_full('r')}
SELECT user_id, item_id, round({_model(m)}, 6) AS score FROM g""" for m in ("item", "user", "blend")},
        "eval_item": _eval("item"),
        "eval_user": _eval("user"),
        "eval_blend": _eval("blend"),
        "eval_item_log": _eval("item", R_EVENTS_LOG),
        "eval_blend_log": _eval("blend", R_EVENTS_LOG),
        "eval_blend_pieces": _eval_pieces("blend"),
        "eval_item_pieces": _eval_pieces("item"),
        "eval_item_orders": _eval("item", R_ORDERS),
        "size_study": _size_study(),
        "profile_and_split": f"""WITH {EVENT_ROWS},
pos AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM ev),
uid AS (SELECT user_id, min(rn) AS user_idx FROM pos GROUP BY 1),
iid AS (SELECT item_id, min(rn) AS item_idx FROM pos GROUP BY 1),
rows_ AS (SELECT ev.event_id, uid.user_idx, iid.item_idx, ln(1 + ev.value) AS log_target
          FROM ev JOIN uid USING (user_id) JOIN iid USING (item_id)),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '{inp.SPLIT_SEED}')), event_id) - 1 AS rn,
                    count(*) OVER () AS n FROM rows_)
SELECT user_idx, item_idx, round(log_target, 6) AS log_target FROM numbered
WHERE rn < floor({inp.SPLIT_FRAC} * n)""",
        "profile_and_split_test": f"""WITH {EVENT_ROWS},
pos AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM ev),
uid AS (SELECT user_id, min(rn) AS user_idx FROM pos GROUP BY 1),
iid AS (SELECT item_id, min(rn) AS item_idx FROM pos GROUP BY 1),
rows_ AS (SELECT ev.event_id, uid.user_idx, iid.item_idx, ln(1 + ev.value) AS log_target
          FROM ev JOIN uid USING (user_id) JOIN iid USING (item_id)),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '{inp.SPLIT_SEED}')), event_id) - 1 AS rn,
                    count(*) OVER () AS n FROM rows_)
SELECT user_idx, item_idx, round(log_target, 6) AS log_target FROM numbered
WHERE rn >= floor({inp.SPLIT_FRAC} * n)""",
        "last_before": f"""WITH f AS (
  SELECT user_id, ts, max(event_id) AS last_id, arg_max(value, event_id) AS last_value, count(*) AS c
  FROM events WHERE event_type = '{inp.FACT}' GROUP BY 1, 2),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM f)
SELECT e.event_id, g.last_id, g.last_value, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_before
FROM events e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.ts > g.ts""",
        "count_within": f"""
SELECT e.event_id, count(f.event_id) AS n_day
FROM events e LEFT JOIN events f ON f.user_id = e.user_id AND f.event_type = '{inp.FACT}'
     AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 1 DAY
GROUP BY e.event_id""",
        "range_pairs": f"""
SELECT e.event_id, f.event_id AS lead_id
FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 1 HOUR
WHERE e.event_type = '{inp.FACT}' AND f.event_type = '{inp.LEAD}'""",
        "profile_cube": """
WITH e AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value FROM events)
SELECT event_type, day, CAST(grouping(event_type, day) AS BIGINT) AS level, count(*) AS n,
       round(sum(value), 6) AS total, min(value) AS low, max(value) AS high,
       true AS user_id_ok, true AS item_id_ok, true AS quantiles_ok
FROM e GROUP BY CUBE (event_type, day)""",
    }

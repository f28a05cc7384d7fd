"""The registered queries: one per operator / whole evaluation of the
survey's inventory. Each takes (spark, sf_dir) and returns a DataFrame whose
column names match the oracle SQL in ``oracle.py``. Floats leave rounded
to 6 digits so both engines hash alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.functions.scalar import OUT_DIGITS, log_scale_col
from cofilter.operators import asof, dictionary, factor, indexing, matrix, metrics, neighbourhood, ordering
from cofilter.operators import products, profile, profile_pieces, pruned, ranking, sets
from cofilter.plans import evaluation
from cofilter.plans import inputs as inp
from cofilter.session import scratch_path
from cofilter.sources import files
from cofilter.streaming import matrix as stream
from cofilter.sources.tables import event_item, event_rows, item_titles, table

U, I, V = "user_id", "item_id", "counts"
Query = Callable[[SparkSession, str], DataFrame]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, OUT_DIGITS)


# --- sources / sinks ------------------------------------------------------------

def q_read_triples(spark, sf):
    R = inp.r_events(spark, sf).select(U, I, F.col(V).cast("int").alias(V))
    path = scratch_path(spark, "triples")
    files.write_tsv(R, path)
    return files.read_triples(spark, path)


def q_read_dimensions(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat_ws(" ", F.concat(F.lit("part"), F.col("p_partkey").cast("string")),
                    F.col("p_partkey").cast("string")).alias("line"))
    cust = table(spark, sf, "customer").select(F.col("c_name").alias("line"))
    ipath, upath = scratch_path(spark, "items"), scratch_path(spark, "users")
    part.write.text(ipath)
    cust.write.text(upath)
    items = files.read_item_dimension(spark, ipath).select(
        F.lit("item").alias("kind"), F.col("item_id").alias("key"),
        F.col("item_index").cast("bigint").alias("idx"))
    users = files.read_user_dimension(spark, upath).select(
        F.lit("user").alias("kind"), F.col("user_id").alias("key"), F.lit(None).cast("bigint").alias("idx"))
    return items.unionByName(users)


def _dense_ids(R):
    uid = indexing.index_dense(R, U, "row_idx")
    iid = indexing.index_dense(R, I, "col_idx")
    return indexing.encode(R, {U: uid, I: iid})


def q_read_dense_matrix(spark, sf):
    R = inp.r_events(spark, sf)
    cells = _dense_ids(R).select("row_idx", "col_idx", F.col(V).alias("value"))
    path = scratch_path(spark, "dense")
    files.write_dense_matrix(cells, path)
    return files.read_dense_matrix(spark, path)


def q_read_titles(spark, sf):
    path = scratch_path(spark, "titles")
    files.write_lines_in_order(table(spark, sf, "part"), "p_name", "p_partkey", path)
    return files.read_titles(spark, path)


def q_read_sources(spark, sf):
    """Each event-type piece written as a TSV source of its own (one write,
    one folder per piece), read back as one training set tagged by position."""
    path = scratch_path(spark, "pieces")
    pieces = inp.event_pieces(spark, sf)
    pieces.select("src_ord", U, I, F.col(V).cast("int").alias(V)).write.partitionBy("src_ord").csv(path, sep="\t", header=False)
    n = pieces.agg(F.max("src_ord")).first()[0]
    paths = [f"{path}/src_ord={j}" for j in range(0 if n is None else n + 1)]
    return files.read_sources(spark, paths).select("src_ord", U, I, V)


def _write_split_q(part):
    def q(spark, sf):
        rows = inp.events_split(spark, sf)[part]
        path = scratch_path(spark, "split")
        files.write_tsv(rows.select(U, I, V), path)
        schema = "user_id bigint, item_id bigint, counts double"
        return spark.read.csv(path, schema=schema, sep="\t", header=False, mode="FAILFAST")
    return q


# --- projections / predicates ---------------------------------------------------

def q_log_scale(spark, sf):
    R = inp.r_events(spark, sf)
    return R.select(U, I, V, r6(log_scale_col(V)).alias("rating"))


def q_cold_start_filter(spark, sf):
    train, test = inp.events_split(spark, sf)
    return factor.cold_start_filter(test, train).select(U, I, V)


def q_cold_start_count(spark, sf):
    train, test = inp.events_split(spark, sf)
    tagged = (test.select(F.lit(1).alias("t"), F.lit(0).alias("k"))
              .unionAll(factor.cold_start_filter(test, train).select(F.lit(0), F.lit(1))))
    return tagged.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_test"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_known"))


def q_degree_norms(spark, sf):
    d = matrix.degree_norms(inp.r_events(spark, sf))
    return d.select("side", "key", "total", r6("inv_sqrt").alias("inv_sqrt"))


def q_user_candidates(spark, sf):
    R = inp.r_events(spark, sf)
    pairs = _candidates(R)
    s = neighbourhood.scores(R, "user", pairs)
    return (pairs.join(s, [U, I], "left")
            .select(U, I, r6(F.coalesce(F.col("score"), F.lit(0.0))).alias("score")))


# --- limits / splits / ids ------------------------------------------------------

def q_head_n(spark, sf):
    return ordering.head_n(event_rows(spark, sf).select("event_id", U, I, "value"),
                           inp.HEAD_N, ["event_id"])


def q_split_train(spark, sf):
    return inp.events_split(spark, sf)[0].select(U, I, V)


def q_split_test(spark, sf):
    return inp.events_split(spark, sf)[1].select(U, I, V)


def _sides(u, i, idx_u, idx_i):
    return (u.select(F.lit("user").alias("side"), F.col(U).alias("key"), F.col(idx_u).alias("idx"))
            .unionByName(i.select(F.lit("item").alias("side"), F.col(I).alias("key"),
                                  F.col(idx_i).alias("idx"))))


def q_index_dense(spark, sf):
    R = inp.r_events(spark, sf)
    return _sides(indexing.index_dense(R, U, "a"), indexing.index_dense(R, I, "b"), "a", "b")


def q_index_first_seen(spark, sf):
    ev = event_rows(spark, sf)
    return _sides(indexing.index_first_seen(ev, U, "event_id", "a"),
                  indexing.index_first_seen(ev, I, "event_id", "b"), "a", "b")


def q_index_first_row(spark, sf):
    ev = event_rows(spark, sf)
    return _sides(indexing.index_first_row(ev, U, "event_id", "a"),
                  indexing.index_first_row(ev, I, "event_id", "b"), "a", "b")


def q_global_row_number(spark, sf):
    ev = event_rows(spark, sf).select("event_id", "value")
    out, _ = ordering.with_row_number(ev, ["value", "event_id"], "row_no")
    return out.select("event_id", "row_no")


def q_encode_triples(spark, sf):
    R = inp.r_events(spark, sf)
    uid = indexing.index_dense(R, U, "user_idx")
    iid = indexing.index_dense(R, I, "item_idx")
    return indexing.encode(R, {U: uid, I: iid}).select("user_idx", "item_idx", V)


# --- joins / scoring ------------------------------------------------------------

def _scored_test(spark, sf, model):
    train, test = inp.events_split(spark, sf)
    return neighbourhood.score_pairs(matrix.build_matrix(train), test, model)


def q_actual_vs_pred(spark, sf):
    train, test = inp.events_split(spark, sf)
    s = neighbourhood.scores(matrix.build_matrix(train), "item", test.select(U, I))
    return test.join(s, [U, I], "inner").select(U, I, V, r6("score").alias("pred"))


def _score_pairs_q(model):
    def q(spark, sf):
        return _scored_test(spark, sf, model).select(U, I, V, r6("pred").alias("pred"))
    q.__name__ = f"q_score_pairs_{model}"
    return q


def _rmse_q(model):
    def q(spark, sf):
        r = metrics.rmse(_scored_test(spark, sf, model))
        return r.select("n", r6("rmse").alias("rmse"))
    q.__name__ = f"q_rmse_{model}"
    return q


def _titled_list(spark, sf, per_model: dict[str, DataFrame]):
    """One ranked, titled list per model (T2 + J5)."""
    out = None
    for name, s in per_model.items():
        t = s.withColumn("model", F.lit(name))
        out = t if out is None else out.unionByName(t)
    ranked = ranking.ranked_list(out, group="model")
    titled = ranking.with_titles(ranked, item_titles(spark, sf))
    return titled.select("model", "rank", I, "title", r6("score").alias("score"))


def _candidates(R):
    """(user_id, item_id) pairs: the target user with each candidate item."""
    u0 = inp.target_user(R)
    return inp.candidate_items(R).withColumn(U, F.lit(u0).cast("bigint"))


def _with_zero(pairs, s):
    return pairs.join(s, [U, I], "left").select(
        U, I, F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))


def q_topk_titles(spark, sf):
    R = inp.r_events(spark, sf)
    pairs = _candidates(R)
    g = neighbourhood.neighbourhood_scores(R, pairs)
    per = {m: _with_zero(pairs, g.select(U, I, neighbourhood.model_score(g, m).alias("score")))
           for m in ("user", "item")}
    return _titled_list(spark, sf, per)


# --- profiling ------------------------------------------------------------------

def q_describe_counts(spark, sf):
    d = profile.describe(inp.r_orders(spark, sf), V)
    return d.select("count", *[r6(c).alias(c) for c in
                               ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_matrix_shape(spark, sf):
    return profile.shape(inp.r_events(spark, sf)).select("n_rows", "n_columns", "n_users", "n_items")


def q_distinct_counts(spark, sf):
    return profile.distinct_counts(inp.r_orders(spark, sf), [U, I])


def q_rating_histogram(spark, sf):
    R = inp.r_events(spark, sf).withColumn("rating", r6(log_scale_col(V)))
    return profile.value_histogram(R.select("rating", U, I, V), "rating")


# --- metrics --------------------------------------------------------------------

def q_als_metrics(spark, sf):
    train, test = inp.events_split(spark, sf)
    _, m = evaluation.als_evaluate(train, test)
    return m.select("part", "n", r6("mse").alias("mse"), r6("rmse").alias("rmse"))


def q_spearman_per_user(spark, sf):
    sp = metrics.spearman_per_user(_scored_test(spark, sf, "item"))
    return sp.select(U, "n", r6("rho").alias("rho"))


def q_spearman_mean(spark, sf):
    s = metrics.spearman_summary(metrics.spearman_per_user(_scored_test(spark, sf, "item")))
    return s.select("n_defined", r6("mean_rho").alias("mean_rho"), "n_users")


def q_frobenius_energy(spark, sf):
    R = inp.r_events(spark, sf)
    return R.agg(F.sum(F.col(V) * F.col(V)).alias("sum_sq"), F.count(F.lit(1)).alias("n_cells"))


def q_svd_energy(spark, sf):
    m = factor.svd_fit(inp.r_events(spark, sf))
    return factor.singular_values(spark, m).select("k", r6("energy").alias("energy"))


def q_average_rank(spark, sf):
    _, test = inp.events_split(spark, sf)
    return metrics.average_rank(test.select(U, I, V), U, V, "avg_rank")


# --- windows / matrix -----------------------------------------------------------

def q_last_write_matrix(spark, sf):
    return matrix.last_write(event_rows(spark, sf), (U, I), "value", ("event_id",))


def q_topk_per_user(spark, sf):
    top = pruned.top_k_scores(inp.r_events(spark, sf), inp.TOP_K)
    return top.select(U, "rank", I, r6("score").alias("score"))


def q_topk_per_user_orders(spark, sf):
    """T3 on the wide matrix, without its users x items scores."""
    top = pruned.top_k_scores(inp.r_orders(spark, sf), inp.TOP_K)
    return top.select(U, "rank", I, r6("score").alias("score"))


def q_item_neighbours(spark, sf):
    """M3 on the wide matrix: the most similar items of each."""
    s = pruned.nearest(inp.r_orders(spark, sf), inp.TOP_K)
    return s.select("item_i", "rank", "item_j", r6("sim").alias("sim"))


def q_similar_items(spark, sf):
    """M3 on the wide matrix, pairs at or above a similarity."""
    s = pruned.similar_pairs(inp.r_orders(spark, sf), inp.SIMILAR)
    return s.select("item_i", "item_j", r6("sim").alias("sim"))


def _streamed(spark, sf):
    """The events as three landings, with rows of earlier ones repeated and some held
    back to come late, taken into a matrix after each landing."""
    ev = event_rows(spark, sf).select("event_id", U, I, "value")
    source, store = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int")
    again = F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(5)) == 0
    for no in range(3):
        ev.where((part == no) | ((part < no) & again)).write.mode("append").parquet(source)
        stream.update_matrix(spark, source, ev.schema, store)
    return store


def q_stream_last_write(spark, sf):
    """W2 by a stream in three batches: the batch query's rows."""
    return stream.read_matrix(spark, _streamed(spark, sf))


def q_stream_sums(spark, sf):
    """A6 by the same stream: row and column sums of the last-write matrix."""
    s = stream.read_sums(spark, _streamed(spark, sf))
    return s.select("side", "key", F.round("total", 4).alias("total"))


def q_index_incremental(spark, sf):
    """I1 as a table that grows: the users and items of the first half of the events, then
    of all; ids of the first half stay."""
    ev = event_rows(spark, sf)
    first = ev.where(F.col("event_id") <= F.lit(ev.agg(F.max("event_id")).first()[0]) / 2)
    out = None
    for side, key in (("user", U), ("item", I)):
        path = scratch_path(spark, "ids")
        dictionary.extend_dictionary(first, key, path)
        ids = dictionary.extend_dictionary(ev, key, path).select(F.lit(side).alias("side"), "key", F.col("id").alias("idx"))
        out = ids if out is None else out.unionByName(ids)
    return out


def q_union_train(spark, sf):
    return inp.event_pieces(spark, sf).select("src_ord", U, I, V)


def q_universe(spark, sf):
    return sets.universes(event_rows(spark, sf), {"user": U, "item": I})


def q_same_users_check(spark, sf):
    ev = event_rows(spark, sf)
    a = ev.filter(F.col("event_type") == "click")
    b = ev.filter(F.col("event_type") == "view")
    return sets.same_keys(a, b, U, "event_id")


def q_matrix_pivot(spark, sf):
    """M2 over a named item list: the first N_CANDIDATES items in key order."""
    R = inp.r_events(spark, sf)
    items = [r[0] for r in inp.candidate_items(R).collect()]
    return matrix.pivot_matrix(R, items=sorted(items))


def q_item_similarity(spark, sf):
    s = neighbourhood.item_similarity(inp.r_events(spark, sf))
    return s.select("item_i", "item_j", r6("sim").alias("sim"))


def q_user_similarity(spark, sf):
    s = neighbourhood.user_similarity(inp.r_events(spark, sf))
    return s.select("user_u", "user_v", r6("sim").alias("sim"))


def _score_q(model):
    def q(spark, sf):
        s = neighbourhood.scores(inp.r_events(spark, sf), model)
        return s.select(U, I, r6("score").alias("score"))
    q.__name__ = f"q_score_{model}"
    return q


# --- factor models --------------------------------------------------------------

def q_svd_singular_values(spark, sf):
    m = factor.svd_fit(inp.r_events(spark, sf))
    return factor.singular_values(spark, m).select("k", r6("singular_value").alias("singular_value"))


def q_svd_scores(spark, sf):
    R = inp.r_events(spark, sf)
    m = factor.svd_fit(R)
    return factor.svd_scores(R, m, inp.SVD_RANK).select(U, I, r6("score").alias("score"))


def q_svd_reconstruction(spark, sf):
    """M9 at full rank: the reconstruction's cells are R's."""
    R = inp.r_events(spark, sf)
    s = factor.svd_scores(R, factor.svd_fit(R), factor.DEFAULT_RANK)
    return s.select(U, I, r6("score").alias(V)).where(F.col(V) != 0)


def q_svd_moments(spark, sf):
    """Σ s² = Σ r² and Σ s⁴ = Σ (RᵀR)²."""
    s = factor.singular_values(spark, factor.svd_fit(inp.r_events(spark, sf)))
    return s.agg(F.round(F.sum(F.pow("singular_value", F.lit(2.0))), 2).alias("s2"),
                 F.round(F.sum(F.pow("singular_value", F.lit(4.0))), 1).alias("s4"))


def q_svd_orders_energy(spark, sf):
    """M8/A10 on the wide matrix: the energy of the first 16 singular values."""
    m = factor.svd_fit(inp.r_orders(spark, sf), k=16)
    return factor.singular_values(spark, m).select("k", r6("energy").alias("energy"))


def q_svd_orders_residual(spark, sf):
    """M8 on the wide matrix, held against its definition: RᵀR v = s² v by joins."""
    R = matrix.materialize(inp.r_orders(spark, sf))
    res = factor.svd_residuals(R, factor.svd_fit(R, k=16))
    return res.select("k", r6("residual").alias("residual"))


def q_svd_orders_top(spark, sf):
    """M8 on the wide matrix: the first singular value and its share of the energy."""
    m = factor.svd_fit(inp.r_orders(spark, sf), k=4)
    return factor.singular_values(spark, m, 1).select("k", F.round("singular_value", 4).alias("singular_value"),
                                                      r6("energy").alias("energy"))


def q_svd_topk_titles(spark, sf):
    R = inp.r_events(spark, sf)
    m = factor.svd_fit(R)
    pairs = _candidates(R)
    s = _with_zero(pairs, factor.svd_scores(R, m, inp.SVD_RANK, pairs))
    return _titled_list(spark, sf, {"svd": s})


def q_als_predictions(spark, sf):
    train, test = inp.events_split(spark, sf)
    res, _ = evaluation.als_evaluate(train, test)
    return res.test_pred.select(U, I, V, r6("prediction").alias("prediction"))


def q_als_rows(spark, sf):
    """The rows that get a prediction, of both parts (train predictions are
    part of the reference's job)."""
    train, test = inp.events_split(spark, sf)
    res, _ = evaluation.als_evaluate(train, test)
    both = (res.train_pred.withColumn("part", F.lit("train"))
            .unionByName(res.test_pred.withColumn("part", F.lit("test"))))
    return both.where(F.col("prediction").isNotNull() & ~F.isnan("prediction")).select("part", U, I, V)


def q_als_counts(spark, sf):
    """Rows per part after the cold-start rule, from the metrics."""
    train, test = inp.events_split(spark, sf)
    return evaluation.als_evaluate(train, test)[1].select("part", "n")


def q_als_residual(spark, sf):
    """M11 against its normal equations: the users' side, the last half-step of the fit."""
    train, test = inp.events_split(spark, sf)
    res, _ = evaluation.als_evaluate(train, test)
    gap = factor.als_residual(res.model, res.ratings)
    return gap.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_ratings"), F.round(F.max("residual"), 4).alias("residual"))


def q_als_saved(spark, sf):
    """M12 from a saved model: the rows predicted by the fit, and those that the model
    read back predicts otherwise."""
    train, test = inp.events_split(spark, sf)
    res, _ = evaluation.als_evaluate(train, test)
    path = scratch_path(spark, "als-model")
    factor.save_als(res.model, path)
    again = factor.als_predict(factor.load_als(spark, path), test).select(U, I, F.col("prediction").alias("again"))
    both = res.test_pred.join(again, [U, I], "left")
    same = F.abs(F.col("prediction") - F.col("again")) <= 1e-4 * (1 + F.abs("again"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~F.coalesce(same, F.lit(False))).cast("long")), F.lit(0)).alias("differ"))


def q_als_topk_users(spark, sf):
    """M12 for all users: the best items by products of factors."""
    train, test = inp.events_split(spark, sf)
    res, _ = evaluation.als_evaluate(train, test)
    top = factor.top_k_products(res.model.users, res.model.items, inp.TOP_K)
    return top.select(U, "rank", I, r6("score").alias("score"))


def q_svd_topk_users(spark, sf):
    """M9 for all users at full rank: the reconstruction is R, its best items R's."""
    R = inp.r_events(spark, sf)
    top = factor.svd_top_k(R, factor.svd_fit(R), factor.DEFAULT_RANK, inp.TOP_K)
    return top.select(U, "rank", I, F.round("score", 5).alias("score"))


def q_map_per_user(spark, sf):
    """Average precision and NDCG of the item model's test scores."""
    m = metrics.ranking_quality(_scored_test(spark, sf, "item"), relevant=inp.RELEVANT, k=inp.TOP_K)
    return m.select(U, "n", "n_relevant", r6("ap").alias("ap"), r6("ndcg").alias("ndcg"))


def q_metrics_line(spark, sf):
    """A metric row written as one line and read back."""
    path = scratch_path(spark, "metrics")
    files.write_metrics_line(q_cold_start_count(spark, sf), ["n_test", "n_known"], path)
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts.getItem(0).cast("bigint").alias("n_test"),
                                        parts.getItem(1).cast("bigint").alias("n_known"))


def q_mse_rmse_known(spark, sf):
    """A8 on a prediction that SQL can follow: the item model on rows that pass the
    cold-start rule."""
    train, test = inp.events_split(spark, sf)
    R = matrix.build_matrix(train)
    scored = neighbourhood.score_pairs(R, factor.cold_start_filter(test, train), "item")
    m = factor.mse_rmse(scored.withColumnRenamed("pred", "prediction"), "test")
    return m.select("part", "n", r6("mse").alias("mse"), r6("rmse").alias("rmse"))


def _als_report_q(log_scale):
    def q(spark, sf):
        """E4 + S8: the one-line result file 'trainRMSE,testRMSE,testCount'
        written to the shared folder and read back."""
        train, test = inp.events_split(spark, sf)
        res, m = evaluation.als_evaluate(train, test, log_scale=log_scale)
        wide = m.groupBy().pivot("part", ["train", "test"]).agg(F.first("rmse"))
        row = wide.select(F.col("train").alias("train_rmse"), F.col("test").alias("test_rmse"),
                          F.lit(res.test_count).cast("bigint").alias("test_count"))
        path = scratch_path(spark, "als-result")
        files.write_metrics_line(row, ["train_rmse", "test_rmse", "test_count"], path)
        parts = F.split(F.col("value"), ",")
        back = spark.read.text(path).select(parts.getItem(0).cast("double").alias("train_rmse"),
                                            parts.getItem(1).cast("double").alias("test_rmse"),
                                            parts.getItem(2).cast("bigint").alias("test_count"))
        return back.select(r6("train_rmse").alias("train_rmse"), r6("test_rmse").alias("test_rmse"),
                           "test_count")
    q.__name__ = "q_als_report_log" if log_scale else "q_als_report"
    return q


# --- whole evaluations ----------------------------------------------------------

def _eval_q(model, source="events", log_scale=False):
    def q(spark, sf):
        R = inp.r_events(spark, sf) if source == "events" else inp.r_orders(spark, sf)
        if log_scale:
            R = R.withColumn(V, log_scale_col(V))
        train, test = inp.split(R)
        m = evaluation.evaluate(train, test, model)
        return m.select("part", "metric", r6("value").alias("value"))
    q.__name__ = f"q_eval_{model}_{source}{'_log' if log_scale else ''}"
    return q


def q_eval_item_pieces(spark, sf):
    """E1 as the reference lays it out: several training pieces in a bag
    union (U1), last-write matrix (W2), evaluation on a held-out piece."""
    train, test = inp.piece_train_test(spark, sf)
    scored = evaluation.scored_parts(train, test, "item", order=("src_ord",))
    m = evaluation.metrics_long(scored)
    return m.select("part", "metric", r6("value").alias("value"))


def q_als_report_pieces(spark, sf):
    """E4 on pieces: duplicate (user, item) rows stay separate ALS ratings."""
    train, test = inp.piece_train_test(spark, sf)
    res, m = evaluation.als_evaluate(train.drop("src_ord"), test)
    wide = m.groupBy().pivot("part", ["train", "test"]).agg(F.first("rmse"))
    return wide.select(r6("train").alias("train_rmse"), r6("test").alias("test_rmse"),
                       F.lit(res.test_count).cast("bigint").alias("test_count"))


def q_size_study(spark, sf):
    m = evaluation.size_study(inp.r_events(spark, sf))
    return m.select("frac", "part", "metric", r6("value").alias("value"))


def _profile_and_split_q(part):
    def q(spark, sf):
        """E5: raw rows -> log target -> first-row ids -> exact split -> TSV, one half."""
        ev = event_rows(spark, sf)
        uid = indexing.index_first_row(ev, U, "event_id", "user_idx")
        iid = indexing.index_first_row(ev, I, "event_id", "item_idx")
        rows = indexing.encode(ev.select("event_id", U, I, "value"), {U: uid, I: iid}) \
            .withColumn("log_target", log_scale_col("value"))
        half = ordering.split_exact(rows, inp.SPLIT_FRAC, inp.SPLIT_SEED, ["event_id"])[part]
        path = scratch_path(spark, "export")
        files.write_tsv(half.select("user_idx", "item_idx", "log_target"), path)
        back = spark.read.csv(path, schema="user_idx bigint, item_idx bigint, log_target double",
                              sep="\t", header=False, mode="FAILFAST")
        return back.select("user_idx", "item_idx", r6("log_target").alias("log_target"))
    return q


def q_profile_events(spark, sf):
    """E5, first half: the profile of the raw rows (A1 with A2's counts)."""
    ev = event_rows(spark, sf).select(U, I, F.col("value").alias(V))
    d = profile.describe(ev, V)
    return d.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_sample_scores(spark, sf):
    """E5, first half: Γ_U and Γ_I on a small sample, the first SAMPLE_FRAC of the
    split order (the feature: the reference looks at a sample first)."""
    sample, _ = ordering.split_exact(inp.r_events(spark, sf), inp.SAMPLE_FRAC, inp.SPLIT_SEED, [U, I])
    g = neighbourhood.neighbourhood_scores(matrix.build_matrix(sample))
    return g.select(U, I, r6("score_user").alias("score_user"), r6("score_item").alias("score_item"))


def q_eval_blend_pieces(spark, sf):
    """E2 on several training pieces."""
    train, test = inp.piece_train_test(spark, sf)
    m = evaluation.metrics_long(evaluation.scored_parts(train, test, "blend", order=("src_ord",)))
    return m.select("part", "metric", r6("value").alias("value"))


def _timed_events(spark, sf):
    """Events with ``at``, their time in microseconds."""
    return table(spark, sf, "events").select("event_id", "event_type", U, "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def q_last_before(spark, sf):
    """For each event, its user's last purchase before it and how many there were."""
    ev = _timed_events(spark, sf)
    facts = ev.where(F.col("event_type") == inp.FACT)
    out = asof.as_of(ev, facts, U, "at", {"last_id": "event_id", "last_value": "value"}, order="event_id", count="n_before")
    return out.select("event_id", "last_id", "last_value", "n_before")


def q_count_within(spark, sf):
    """For each event, its user's purchases within the day before it."""
    ev = _timed_events(spark, sf)
    return asof.count_within(ev, ev.where(F.col("event_type") == inp.FACT), U, "at", inp.DAY_MICROS, "event_id", "n_day")


def q_range_pairs(spark, sf):
    """Purchases with the clicks of the same user within the hour before."""
    ev = _timed_events(spark, sf)
    clicks = ev.where(F.col("event_type") == inp.LEAD).withColumnRenamed("event_id", "lead_id")
    return asof.range_pairs(ev.where(F.col("event_type") == inp.FACT), clicks, U, "at", inp.HOUR_MICROS, "event_id", "lead_id")


def q_profile_cube(spark, sf):
    """The cube over (type, day) from stored profiles of two batches, with the sketches
    held against exact figures of the rows."""
    by, ids, quantiles = ["event_type", "day"], [U, I], {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ev = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").cast("string").alias("day"), U,
                                           event_item().alias(I), "value")
    store = scratch_path(spark, "profiles")
    later = F.col("event_type").eqNullSafe(inp.HELD_OUT_PIECE)
    for batch, rows in (("first", ev.where(~later)), ("second", ev.where(later))):
        profile_pieces.store_profiles(profile_pieces.profile_pieces(rows, by, "value", ids), store, batch)
    merged = profile_pieces.merge_profiles(profile_pieces.read_profiles(spark, store), by, ids, tuple(quantiles.values()), cube=True)

    def cell(level, *cols):
        return F.to_json(F.struct(F.lit(level).cast("long").alias("level"), *cols))

    rows = ev.select("event_id", U, I, "value", F.explode(F.array(
        cell(0, "event_type", "day"), cell(1, "event_type"), cell(2, "day"), cell(3))).alias("cell"))
    merged = merged.withColumn("cell", F.to_json(F.struct(F.col("level").cast("long").alias("level"), *by)))
    near = products.salted_join(rows, merged.select("cell", *quantiles), "cell", "event_id")
    ranks = near.groupBy("cell").agg(F.count("value").alias("n_exact"), *[F.countDistinct(c).alias(f"exact_{c}") for c in ids], *[
        F.sum((F.col("value") < F.col(q)).cast("long")).alias(f"below_{q}") for q in quantiles], *[
        F.sum((F.col("value") <= F.col(q)).cast("long")).alias(f"upto_{q}") for q in quantiles])
    good = [(F.abs(F.col(f"n_{c}") - F.col(f"exact_{c}")) <= F.col(f"exact_{c}") * profile_pieces.DISTINCT_BOUND).alias(f"{c}_ok") for c in ids]
    rank_ok = F.lit(True)
    for q, share in quantiles.items():
        rank_ok &= F.col(f"below_{q}") <= (share + profile_pieces.RANK_BOUND) * F.col("n_exact")
        rank_ok &= F.col(f"upto_{q}") >= (share - profile_pieces.RANK_BOUND) * F.col("n_exact")
    return merged.join(ranks, "cell").select(*by, F.col("level").cast("long").alias("level"), "n", r6("total").alias("total"),
                                             "low", "high", *good, F.coalesce(rank_ok, F.lit(False)).alias("quantiles_ok"))


def queries() -> dict[str, Query]:
    return {
        "read_triples": q_read_triples,
        "read_dimensions": q_read_dimensions,
        "read_dense_matrix": q_read_dense_matrix,
        "read_titles": q_read_titles,
        "read_sources": q_read_sources,
        "write_split_tsv": _write_split_q(0),
        "write_split_test_tsv": _write_split_q(1),
        "metrics_line": q_metrics_line,
        "log_scale": q_log_scale,
        "cold_start_filter": q_cold_start_filter,
        "cold_start_count": q_cold_start_count,
        "degree_norms": q_degree_norms,
        "user_candidates": q_user_candidates,
        "head_n": q_head_n,
        "split_train": q_split_train,
        "split_test": q_split_test,
        "index_dense": q_index_dense,
        "index_first_seen": q_index_first_seen,
        "index_first_row": q_index_first_row,
        "global_row_number": q_global_row_number,
        "encode_triples": q_encode_triples,
        "actual_vs_pred": q_actual_vs_pred,
        "score_pairs_item": _score_pairs_q("item"),
        "score_pairs_user": _score_pairs_q("user"),
        "score_pairs_blend": _score_pairs_q("blend"),
        "topk_titles": q_topk_titles,
        "describe_counts": q_describe_counts,
        "matrix_shape": q_matrix_shape,
        "distinct_counts": q_distinct_counts,
        "rating_histogram": q_rating_histogram,
        "rmse_item": _rmse_q("item"),
        "rmse_user": _rmse_q("user"),
        "rmse_blend": _rmse_q("blend"),
        "als_metrics": q_als_metrics,
        "spearman_per_user": q_spearman_per_user,
        "spearman_mean": q_spearman_mean,
        "frobenius_energy": q_frobenius_energy,
        "svd_energy": q_svd_energy,
        "average_rank": q_average_rank,
        "last_write_matrix": q_last_write_matrix,
        "topk_per_user": q_topk_per_user,
        "topk_per_user_orders": q_topk_per_user_orders,
        "similar_items": q_similar_items,
        "item_neighbours": q_item_neighbours,
        "stream_last_write": q_stream_last_write,
        "stream_sums": q_stream_sums,
        "index_incremental": q_index_incremental,
        "union_train": q_union_train,
        "universe": q_universe,
        "same_users_check": q_same_users_check,
        "matrix_pivot": q_matrix_pivot,
        "item_similarity": q_item_similarity,
        "user_similarity": q_user_similarity,
        "score_item": _score_q("item"),
        "score_user": _score_q("user"),
        "score_blend": _score_q("blend"),
        "svd_singular_values": q_svd_singular_values,
        "svd_scores": q_svd_scores,
        "svd_topk_titles": q_svd_topk_titles,
        "als_predictions": q_als_predictions,
        "als_report": _als_report_q(False),
        "als_report_log": _als_report_q(True),
        "eval_item": _eval_q("item"),
        "eval_user": _eval_q("user"),
        "eval_blend": _eval_q("blend"),
        "eval_item_log": _eval_q("item", log_scale=True),
        "eval_item_pieces": q_eval_item_pieces,
        "als_report_pieces": q_als_report_pieces,
        "eval_item_orders": _eval_q("item", "orders"),
        "size_study": q_size_study,
        "profile_and_split": _profile_and_split_q(0),
        "profile_and_split_test": _profile_and_split_q(1),
        "profile_events": q_profile_events,
        "sample_scores": q_sample_scores,
        "eval_blend_log": _eval_q("blend", log_scale=True),
        "eval_blend_pieces": q_eval_blend_pieces,
        "svd_reconstruction": q_svd_reconstruction,
        "svd_moments": q_svd_moments,
        "svd_orders_energy": q_svd_orders_energy,
        "svd_orders_residual": q_svd_orders_residual,
        "svd_orders_top": q_svd_orders_top,
        "als_rows": q_als_rows,
        "als_counts": q_als_counts,
        "als_residual": q_als_residual,
        "als_saved": q_als_saved,
        "als_topk_users": q_als_topk_users,
        "svd_topk_users": q_svd_topk_users,
        "map_per_user": q_map_per_user,
        "mse_rmse_known": q_mse_rmse_known,
        "last_before": q_last_before,
        "count_within": q_count_within,
        "range_pairs": q_range_pairs,
        "profile_cube": q_profile_cube,
    }

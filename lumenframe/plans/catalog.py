"""The catalogue: a query for each operator over the test tables, and its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import networks
from ..functions.counters import COUNTERS
from ..operators import autoencoder, cf, kmeans, naive_bayes, pagerank, report, sorting, svm
from ..sources import generators
from . import inputs
from .store import settle

CLUSTERS, GAMMA, PLACES = 10, 0.5, [0, 1000, 5000, 20000]
#: A fixed parameter vector for forward passes.
PARAMETERS = [((i * 37) % 83) / 83 - 0.5 for i in range(83)]
XOR_PARAMETERS = [0.1, -0.2, 0.3, 0.4, -0.5, 0.6, 0.7]


def pagerank_step(s, d):
    nodes, edges = inputs.graph(s, d)
    return pagerank.step(edges, nodes.withColumn("r", F.lit(1.0))).select("node", F.round("r", 6).alias("r"))


def pagerank_fixpoint(s, d):
    return pagerank.pagerank(*inputs.graph(s, d)).select("node", F.round("r", 6).alias("r"))


def sort_values(s, d):
    return sorting.sort_values(inputs.cents(s, d), "v")


def sort_desc(s, d):
    return sorting.sort_values(inputs.cents(s, d), "v", ascending=False)


def sort_segments(s, d):
    return sorting.sort_segments(inputs.cents(s, d), "v", 16)


def _runs(s, d):
    v = inputs.cents(s, d)
    return v.where("l_orderkey % 2 = 0"), v.where("l_orderkey % 2 = 1")


def merge_two_runs(s, d):
    return sorting.merge_runs(*_runs(s, d), "v")


def corank(s, d):
    return sorting.co_rank(*_runs(s, d), "v", PLACES)


def sort_is_sorted(s, d):
    return sorting.is_sorted(sorting.sort_values(inputs.cents(s, d), "v"), "pos", "v")


def sort_same_rows(s, d):
    v = inputs.cents(s, d).select("v")
    return sorting.same_rows(v, sorting.sort_values(v, "v").select("v"))


def diff_trend(s, d):
    return sorting.trend(inputs.read(s, d, "events"), "event_id", "value")


def running_min(s, d):
    return sorting.running_min(inputs.read(s, d, "events"), "event_id", "value", "user_id")


def _nb(s, d):
    rows = inputs.categories(s, d)
    return rows.where("l_orderkey % 10 <> 0"), rows.where("l_orderkey % 10 = 0")


def nb_class_counts(s, d):
    return naive_bayes.class_counts(_nb(s, d)[0], "class")


def nb_attr_counts(s, d):
    return naive_bayes.attribute_counts(_nb(s, d)[0], "class", inputs.ATTRS)


def nb_prior(s, d):
    return naive_bayes.priors(nb_class_counts(s, d)).select("class", F.round("p", 6).alias("p"))


def _nb_model(s, d):
    return naive_bayes.train(_nb(s, d)[0], "class", inputs.ATTRS, inputs.CARDINALITIES)


def nb_cond(s, d):
    return _nb_model(s, d)[1].withColumn("p", F.round("p", 6))


def nb_model_rounded(s, d):
    return naive_bayes.rounded(_nb_model(s, d))[1]


def nb_classify(s, d):
    return naive_bayes.classify(_nb(s, d)[1].select("id", *inputs.ATTRS).distinct(), "id", inputs.ATTRS, _nb_model(s, d))


def nb_confusion(s, d):
    test = _nb(s, d)[1]
    return naive_bayes.confusion(test, nb_classify(s, d), "id", "class")


def cf_ratings(s, d):
    return inputs.ratings(s, d)


def cf_item_mean(s, d):
    return cf.item_stats(inputs.split_ratings(s, d)[0], _items(s, d)).select("item", "c", F.round("mean", 6).alias("mean"))


def _items(s, d):
    return inputs.read(s, d, "supplier").select(F.col("s_suppkey").alias("item"))


def cf_centered(s, d):
    train = inputs.split_ratings(s, d)[0]
    return cf.centred(train, cf.item_stats(train)).select("item", "user", F.round("centred", 6).alias("centred"))


def cf_similarity(s, d):
    return cf.similarity(inputs.stored_split(s, d)[0], _items(s, d), digits=6)


def cf_similarity_ascoded(s, d):
    return cf.similarity(inputs.stored_split(s, d)[0], _items(s, d), as_coded=True, digits=6)


def cf_topk(s, d):
    return cf.nearest(inputs.stored_split(s, d)[0], _items(s, d), k=10, digits=9).select("item", "rank", "nbr", F.round("sim", 6).alias("sim"))


def cf_topk_self(s, d):
    return cf.nearest(inputs.stored_split(s, d)[0], _items(s, d), k=10, include_self=True, digits=9).select("item", "rank", "nbr", F.round("sim", 6).alias("sim"))


def _predictions(s, d):
    train, test = inputs.stored_split(s, d)
    items = _items(s, d)
    return cf.predict(test, train, settle(cf.nearest(train, items, k=10, digits=9), "topk"), cf.item_stats(train, items))


def cf_predict(s, d):
    return _predictions(s, d).select("item", "user", "rating", F.round("predicted", 4).alias("predicted"))


def cf_mse(s, d):
    return cf.error(_predictions(s, d)).select("n", F.round("mse", 4).alias("mse"), F.round("rmse", 4).alias("rmse"))


def kmeans_distance(s, d):
    p = inputs.points(s, d)
    return kmeans.distances(p, kmeans.first_k(p, CLUSTERS)).select("id", "cluster", F.round("d", 6).alias("d"))


def kmeans_assign(s, d):
    p = inputs.points(s, d)
    return kmeans.assign(p, kmeans.first_k(p, CLUSTERS)).select("id", "cluster", F.round("d", 6).alias("d"))


def kmeans_step(s, d):
    p = inputs.points(s, d)
    return kmeans.centroid_frame(s, kmeans.one_round(p, kmeans.first_k(p, CLUSTERS), None).centroids).withColumn("x", F.round("x", 6))


def kmeans_update(s, d):
    p = inputs.points(s, d)
    return kmeans.update(p, kmeans.assign(p, kmeans.first_k(p, CLUSTERS)), CLUSTERS).withColumn("x", F.round("x", 6))


def kmeans_two_more(s, d):
    p = inputs.points(s, d)
    return kmeans.assign(p, kmeans.fit(p, CLUSTERS, most=2).assigned_by).select("id", "cluster", F.round("d", 6).alias("d"))


def kmeans_fit(s, d):
    p = inputs.points(s, d)
    return kmeans.assign(p, kmeans.fit(p, CLUSTERS).assigned_by).select("id", "cluster", F.round("d", 6).alias("d"))


def kmeans_sizes(s, d):
    p = inputs.points(s, d)
    start = kmeans.first_k(p, CLUSTERS)
    out = kmeans.report(kmeans.assign(p, start), kmeans.centroid_frame(s, kmeans.one_round(p, start, None).centroids))
    return out.select("cluster", "n", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def kmeans_total(s, d):
    p = inputs.points(s, d)
    return kmeans.assign(p, kmeans.first_k(p, CLUSTERS)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("total"))


def rbf_kernel(s, d):
    rows = inputs.labelled(s, d)
    return svm.kernel_pairs(rows, rows.where("id < 5"), GAMMA).select("id", "anchor", F.round("k", 6).alias("k"))


def _first_state(s, d):
    """The pair, its coefficient, and the state (id, y, alpha, f) after the first step."""
    rows = inputs.labelled(s, d)
    pair = svm.first_pair(rows).first()
    anchors = svm.prepared(rows.where(F.col("id").isin(pair.i_high, pair.i_low))).collect()
    f = {r.id: np.array(r.f) for r in anchors}
    a = svm.first_step(float(np.exp(-GAMMA * np.square(f[pair.i_high] - f[pair.i_low]).sum())))
    k = svm.kernel_pairs(rows, rows.where(F.col("id").isin(pair.i_high, pair.i_low)), GAMMA)
    moved = k.groupBy("id").agg(F.sum(F.when(F.col("anchor") == pair.i_high, F.lit(a)).otherwise(F.lit(-a)) * F.col("k")).alias("g"))
    state = svm.prepared(rows).select("id", "y").join(moved, "id").select("id", "y", F.when(F.col("id").isin(pair.i_high, pair.i_low), F.lit(a)).otherwise(0.0).alias("alpha"), (F.col("g") - F.col("y")).alias("f"))
    return pair, a, state


def svm_first_step(s, d):
    pair, a, _ = _first_state(s, d)
    return s.createDataFrame([(pair.i_high, pair.i_low, round(a, 6))], "i_high long, i_low long, alpha double")


def svm_violating_pair(s, d):
    return svm.violating_pair(_first_state(s, d)[2]).select("i_high", F.round("b_high", 6).alias("b_high"), "i_low", F.round("b_low", 6).alias("b_low"))


def svm_train(s, d):
    m = svm.train(inputs.labelled(s, d), gamma=GAMMA)
    return m.alphas.select("id", "y", F.round("alpha", 4).alias("alpha"))


def svm_conditions(s, d):
    """What must hold after training: the gap is closed, the signed sum is 0, coefficients are in the box, and both signs support."""
    m = svm.train(inputs.labelled(s, d), gamma=GAMMA)
    sums = m.alphas.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum(F.col("alpha") * F.col("y"))) < 1e-6).alias("balanced"), ((F.min("alpha") >= -1e-9) & (F.max("alpha") <= svm.COST + 1e-9)).alias("in_box"))
    signs = m.support.agg((F.count_if(F.col("coef") > 0) > 0).alias("up"), (F.count_if(F.col("coef") < 0) > 0).alias("down")).first()
    return sums.select("n", "balanced", "in_box", F.lit(bool(signs.up and signs.down)).alias("both_signs"))


def svm_decision(s, d):
    rows = inputs.labelled(s, d)
    support = rows.where("id < 20").select("id", (F.col("y") * 0.5).alias("coef"), F.transform("features", lambda x: x.cast("double")).alias("features"))
    return svm.decide(rows, support, 0.1, GAMMA).select("id", F.round("value", 6).alias("value"))


def svm_sparse_rows(s, d):
    """Every row whose id is divisible by 50, the stated query set, against all rows."""
    long = inputs.points(s, d).select("id", F.posexplode("features").alias("idx", "val")).where("abs(val) > 0.1").select("id", "idx", F.col("val").cast("double").alias("val"))
    return svm.sparse_dot(long.where("id % 50 = 0"), long, digits=6)


def svm_sparse_all(s, d):
    """The products of svm_sparse_rows for all pairs of rows. The result grows with the square of the rows."""
    long = inputs.points(s, d).select("id", F.posexplode("features").alias("idx", "val")).where("abs(val) > 0.1").select("id", "idx", F.col("val").cast("double").alias("val"))
    return svm.sparse_dot(long, long, digits=6)


def _forward(activation):
    def query(s, d):
        return autoencoder.predict(inputs.pairs_of_numbers(s, d).select("id", "x0", "x1"), PARAMETERS, activation=activation).select("id", F.round("o0", 6).alias("o0"), F.round("o1", 6).alias("o1"))

    return query


def ae_loss(s, d):
    return autoencoder.loss(inputs.pairs_of_numbers(s, d), autoencoder.autoencoder_error(), PARAMETERS).select(F.round("loss", 6).alias("loss"))


def ae_loss_sharded(s, d):
    ex = inputs.pairs_of_numbers(s, d).withColumn("shard", F.col("id") % 4)
    return autoencoder.loss_sharded(ex, autoencoder.autoencoder_error(), PARAMETERS, "shard").select(F.round("loss", 6).alias("loss"))


def ae_predict(s, d):
    out = autoencoder.predict(inputs.pairs_of_numbers(s, d), PARAMETERS)
    return out.select("id", "x0", "x1", F.round("o0", 6).alias("o0"), F.round("o1", 6).alias("o1"))


def fit_examples(s, d, linear):
    """Generated examples, as many as there are events."""
    return settle(generators.autoencoder(s, inputs.read(s, d, "events").count(), 0.01, linear), "examples")


def _fit(linear):
    def query(s, d):
        """(name, place, value): the fitted parameters, the loss of the start and that of the fit, after the operator's default number of evaluations at most."""
        f = autoencoder.fit(fit_examples(s, d, linear), ["x0", "x1"], autoencoder.autoencoder_rows(activation="linear" if linear else "elliott"), 83, seed=1)
        rows = [("start_loss", 0, f.trace[0]), ("loss", 0, f.loss), *(("parameter", i, v) for i, v in enumerate(f.parameters))]
        return s.createDataFrame([(n, i, float(v)) for n, i, v in rows], "name string, place int, value double")

    return query


def xor_forward(s, d):
    return autoencoder.predict_xor(inputs.pairs_of_numbers(s, d), XOR_PARAMETERS).select("id", F.round("o0", 6).alias("o0"))


def xor_loss(s, d):
    return autoencoder.loss(inputs.pairs_of_numbers(s, d), autoencoder.xor_error(), XOR_PARAMETERS).select(F.round("loss", 6).alias("loss"))


def gen_xor(s, d):
    return generators.xor(s, inputs.read(s, d, "nation").count())


def report_first_match(s, d):
    """The first error of each user."""
    lines = inputs.read(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.concat_ws(",", "event_type", F.col("event_id").cast("string")).alias("line"))
    return report.first_match(lines, r"^error,[^:]")


def report_split(s, d):
    lines = inputs.read(s, d, "events").select("event_id", F.concat_ws(",", "event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("line"))
    return report.split_line(lines).select("event_id", "name", F.round("value", 2).alias("value"))


def report_pivot(s, d):
    return report.pivot(inputs.long_report(s, d)).select("event", "model", "bench", *[F.col(f"`{t}`").alias(f"t{t}") for t in report.THREADS])


def report_unpivot(s, d):
    return report.unpivot(report.pivot(inputs.long_report(s, d)))


def report_union(s, d):
    long = inputs.long_report(s, d)
    return report.union([long.where("threads < 150"), long.where("threads > 150")])


def report_metrics(s, d):
    return report.derived(inputs.counters(s, d)).withColumn("value", F.round("value", 4))


def report_routes(s, d):
    long = inputs.long_report(s, d).withColumn("event", F.when(F.col("threads") == 61, F.concat("event", F.lit("-first-run"))).otherwise(F.col("event")))
    summary, counters = report.event_names(long)
    return report.union([summary.withColumn("route", F.lit("summary")), counters.withColumn("route", F.lit("counter"))])


QUERIES = {
    "pagerank_step": pagerank_step, "pagerank": pagerank_fixpoint,
    "sort_values": sort_values, "sort_desc": sort_desc, "sort_segments": sort_segments, "merge_two_runs": merge_two_runs, "corank": corank,
    "sort_is_sorted": sort_is_sorted, "sort_same_rows": sort_same_rows, "diff_trend": diff_trend, "running_min": running_min,
    "nb_class_counts": nb_class_counts, "nb_attr_counts": nb_attr_counts, "nb_prior": nb_prior, "nb_cond": nb_cond,
    "nb_model_rounded": nb_model_rounded, "nb_classify": nb_classify, "nb_confusion": nb_confusion,
    "cf_ratings": cf_ratings, "cf_item_mean": cf_item_mean, "cf_centered": cf_centered, "cf_similarity": cf_similarity,
    "cf_similarity_ascoded": cf_similarity_ascoded, "cf_topk": cf_topk, "cf_topk_self": cf_topk_self, "cf_predict": cf_predict, "cf_mse": cf_mse,
    "kmeans_distance": kmeans_distance, "kmeans_assign": kmeans_assign, "kmeans_step": kmeans_step, "kmeans_update": kmeans_update,
    "kmeans_two_more": kmeans_two_more, "kmeans_fit": kmeans_fit, "kmeans_sizes": kmeans_sizes, "kmeans_total": kmeans_total,
    "rbf_kernel": rbf_kernel, "svm_first_step": svm_first_step, "svm_violating_pair": svm_violating_pair, "svm_train": svm_train,
    "svm_conditions": svm_conditions, "svm_decision": svm_decision, "svm_sparse_rows": svm_sparse_rows, "svm_sparse_all": svm_sparse_all,
    **{f"ae_forward_{a}": _forward(a) for a in ("linear", "elliott", "tanh", "logistic")},
    "ae_loss": ae_loss, "ae_loss_sharded": ae_loss_sharded, "ae_predict": ae_predict, "ae_fit_linear": _fit(True), "ae_fit_elliott": _fit(False),
    "xor_forward": xor_forward, "xor_loss": xor_loss, "gen_xor": gen_xor,
    "report_first_match": report_first_match, "report_split": report_split, "report_pivot": report_pivot, "report_unpivot": report_unpivot,
    "report_union": report_union, "report_metrics": report_metrics, "report_routes": report_routes,
}

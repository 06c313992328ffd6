"""Named queries: ``(spark, sf_dir) -> DataFrame`` for every operator row.

Each query starts from the given tables (``customer`` + ``orders`` derive
the subscriber rows) so its work grows with the data.  All queries read the
prepared table and the training statistics kept with it; rounding for
comparison with other engines happens here, not in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.text import norm, to_double
from churnscope.operators import reports as rp
from churnscope.operators import split as sp
from churnscope.operators.clean import clean_total_charges
from churnscope.operators.features import add_clv
from churnscope.operators.stats import exact_median, fit_feature_stats
from churnscope.plans.prep import prepared, train_only

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _raw(spark, sf_dir):
    return prepared(spark, sf_dir).raw(spark)


def _features(spark, sf_dir):
    return prepared(spark, sf_dir).table(spark)


def _prepared(spark, sf_dir):
    return prepared(spark, sf_dir).splits(spark)


def _stats(spark, sf_dir):
    """Medians and CLV edges of the training split, fitted by the preparation."""
    return prepared(spark, sf_dir).stats


def _train(spark, sf_dir):
    return train_only(_prepared(spark, sf_dir))


def _quartiled(spark, sf_dir):
    return rp.add_clv_quartile(_train(spark, sf_dir), edges=_stats(spark, sf_dir).clv_edges)


# ---- clean -----------------------------------------------------------------

@query("clean_total_charges")
def q_clean_total_charges(spark, sf_dir):
    return clean_total_charges(_raw(spark, sf_dir)).select(
        "customerID", "tenure", "MonthlyCharges", "TotalCharges")


@query("text_normalise")
def q_text_normalise(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "customerID", norm("Contract").alias("contract_norm"),
        norm("InternetService").alias("internet_norm"),
        norm("PaymentMethod").alias("payment_norm"), norm("Churn").alias("churn_norm"))


@query("median_impute")
def q_median_impute(spark, sf_dir):
    from churnscope.operators.clean import coerce_total_charges
    parsed, t = F.col("parsed"), F.col("tenure")
    filled = coerce_total_charges(_raw(spark, sf_dir).withColumn("parsed", to_double("TotalCharges")))
    return filled.agg(
        F.count_if(parsed.isNull()).alias("n_unparsed"),
        F.count_if(parsed.isNull() & (t == 0)).alias("n_zero_filled"),
        F.count_if(parsed.isNull() & (t > 0)).alias("n_product_filled"),
        F.count_if(F.col("TotalCharges").isNull()).alias("n_median_filled")).withColumn(
        "filled_median", F.lit(exact_median(filled, "TotalCharges")).cast("double"))


# ---- features --------------------------------------------------------------

@query("clv")
def q_clv(spark, sf_dir):
    return add_clv(clean_total_charges(_raw(spark, sf_dir))).select(
        "customerID", "Contract", "ExpectedTenure", "CLV")


def _feature_query(cols):
    def run(spark, sf_dir):
        return _features(spark, sf_dir).select("customerID", *cols)
    return run


for _name, _cols in {
    "tenure_bucket": ["tenure", "tenure_bucket", "tenure_bucket_ord", "tenure_years",
                      "early_tenure_flag"],
    "service_counts": ["services_count", "streaming_services", "support_services",
                       "has_streaming_any", "has_support_any", "has_multiple_lines_yes"],
    "ratios": ["monthly_to_total_ratio", "charges_per_month_of_tenure", "per_service_charge",
               "remaining_value_ratio"],
    "risk_flags": ["internet_no_tech_support", "is_auto_pay", "is_long_contract",
                   "senior_fiber_optic", "is_fiber_optic", "is_electronic_check",
                   "paperless_autopay", "family_bundle"],
    "median_flags": ["high_charge_to_clv_ratio", "high_monthly_charge"],
    "expected_tenure_features": ["ExpectedTenure", "tenure_remaining",
                                 "tenure_fraction_complete", "remaining_value"],
}.items():
    REGISTRY[_name] = _feature_query(_cols)


@query("model_columns")
def q_model_columns(spark, sf_dir):
    from churnscope.operators.features import select_model_columns
    return select_model_columns(_features(spark, sf_dir))


@query("feature_stats")
def q_feature_stats(spark, sf_dir):
    from churnscope.functions import features as fx
    from churnscope.operators.features import _apply
    staged = _apply(add_clv(clean_total_charges(_raw(spark, sf_dir))), fx.training_stage1())
    return fit_feature_stats(staged).to_frame(spark)


# ---- split -----------------------------------------------------------------

@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _prepared(spark, sf_dir).select("customerID", "ChurnFlag", "split")


@query("split_shares")
def q_split_shares(spark, sf_dir):
    return sp.split_shares(_prepared(spark, sf_dir))


@query("class_counts")
def q_class_counts(spark, sf_dir):
    return sp.class_counts(_train(spark, sf_dir))


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return sp.balanced_weights(_train(spark, sf_dir))


@query("bounded_sample")
def q_bounded_sample(spark, sf_dir):
    return sp.bounded_sample(_train(spark, sf_dir), 600).select("customerID", "CLV", "ChurnFlag")


# ---- reports ---------------------------------------------------------------

@query("clv_quartile")
def q_clv_quartile(spark, sf_dir):
    return _quartiled(spark, sf_dir).select("customerID", "CLV", "CLV_quartile")


def _summary(spark, sf_dir):
    return rp.churn_rate_by_quartile(_quartiled(spark, sf_dir))


@query("churn_by_quartile")
def q_churn_by_quartile(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("quartile_edges")
def q_quartile_edges(spark, sf_dir):
    return spark.createDataFrame([_stats(spark, sf_dir).clv_edges], "q1 double, q2 double, q3 double")


@query("clv_segment")
def q_clv_segment(spark, sf_dir):
    return rp.clv_segment(_prepared(spark, sf_dir), _stats(spark, sf_dir).clv_edges).select(
        "customerID", "CLV", "clv_segment")


@query("churn_by_contract")
def q_churn_by_contract(spark, sf_dir):
    return rp.churn_by(_train(spark, sf_dir), "Contract", "Contract")


@query("churn_by_autopay")
def q_churn_by_autopay(spark, sf_dir):
    return rp.churn_by_autopay(_train(spark, sf_dir))


@query("churn_by_payment")
def q_churn_by_payment(spark, sf_dir):
    return rp.churn_by(_train(spark, sf_dir), "PaymentMethod", "PaymentMethod")


@query("churn_by_support")
def q_churn_by_support(spark, sf_dir):
    return rp.churn_by_support(_train(spark, sf_dir))


@query("churn_reports")
def q_churn_reports(spark, sf_dir):
    """E2 and E5-E8 from one scan."""
    return rp.churn_reports(_quartiled(spark, sf_dir))


@query("inferred_types")
def q_inferred_types(spark, sf_dir):
    """A1: the types of a CSV of all subscribers, and what they were decided from."""
    from churnscope.session import scratch_path
    from churnscope.sources.infer import infer_types, read_text_csv
    path = scratch_path(spark, "subscribers-csv")
    (_raw(spark, sf_dir).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return infer_types(read_text_csv(spark, path))


@query("business_insights")
def q_business_insights(spark, sf_dir):
    return rp.business_insights(_train(spark, sf_dir), _stats(spark, sf_dir).clv_edges)


@query("quartile_gap")
def q_quartile_gap(spark, sf_dir):
    return rp.quartile_gap(_summary(spark, sf_dir))


@query("worst_segment")
def q_worst_segment(spark, sf_dir):
    return rp.worst_segment(_summary(spark, sf_dir))


@query("top2_segments")
def q_top2_segments(spark, sf_dir):
    return rp.top_segments(_summary(spark, sf_dir), 2)


@query("segment_share")
def q_segment_share(spark, sf_dir):
    return rp.segment_share(_summary(spark, sf_dir))


@query("clv_describe")
def q_clv_describe(spark, sf_dir):
    d = rp.describe_column(_train(spark, sf_dir), "CLV", _stats(spark, sf_dir).clv_edges)
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("clv_histogram")
def q_clv_histogram(spark, sf_dir):
    return rp.histogram(_train(spark, sf_dir), "CLV", rp.HIST_BINS)


# ---- evaluation on the scored fixture -------------------------------------

from churnscope.operators import evaluate as ev  # noqa: E402
from churnscope.session import stash
from churnscope.sources.scored import fixture_scores  # noqa: E402


def _scored(spark, sf_dir):
    return fixture_scores(_prepared(spark, sf_dir))


@query("confusion")
def q_confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir), 0.5)


@query("bin_metrics")
def q_bin_metrics(spark, sf_dir):
    return ev.bin_metrics(_scored(spark, sf_dir), 0.5)


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return ev.roc_auc(_scored(spark, sf_dir))


@query("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(_scored(spark, sf_dir))


@query("recall_first_threshold")
def q_recall_first_threshold(spark, sf_dir):
    return ev.chosen_val_metrics(_scored(spark, sf_dir))


@query("frozen_test_metrics")
def q_frozen_test_metrics(spark, sf_dir):
    return ev.frozen_test_metrics(_scored(spark, sf_dir))


@query("roc_points")
def q_roc_points(spark, sf_dir):
    return ev.roc_points(_scored(spark, sf_dir).where(F.col("split") == "test"))


@query("winner")
def q_winner(spark, sf_dir):
    return ev.winner(ev.chosen_val_metrics(_scored(spark, sf_dir), with_auc=False)).select(
        "model", "chosen_threshold", "f1")


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    return ev.model_comparison(ev.frozen_test_metrics(_scored(spark, sf_dir)))


@query("confusion_long")
def q_confusion_long(spark, sf_dir):
    return ev.confusion_long(ev.frozen_test_metrics(_scored(spark, sf_dir)))


def _winner_records(spark, sf_dir):
    counts = ev.score_counts(_scored(spark, sf_dir), materialize=True)
    val = ev.chosen_val_metrics(counts)
    test = ev.frozen_test_metrics(counts, val)
    best = ev.winner(val).select("model")
    return val.join(best, "model"), test.join(best, "model")


@query("metrics_rows")
def q_metrics_rows(spark, sf_dir):
    val, test = _winner_records(spark, sf_dir)
    return ev.pretty_metrics(val, F.lit("Validation (chosen)"), "chosen_threshold").unionByName(
        ev.pretty_metrics(test, F.lit("Test (frozen thr.)"), "used_threshold"))


@query("operating_threshold")
def q_operating_threshold(spark, sf_dir):
    from churnscope.sources.artifacts import operating_threshold
    val, test = _winner_records(spark, sf_dir)
    records = val.select("model", "split", "chosen_threshold", F.lit(None).cast("double").alias("used_threshold"))
    return operating_threshold(records.unionByName(test.select(
        "model", "split", F.lit(None).cast("double").alias("chosen_threshold"), "used_threshold")),
        ev.DEFAULT_THRESHOLD)


# ---- actions: serving features, scoring, retention list --------------------

from churnscope.operators import actions as ac  # noqa: E402
from churnscope.operators.features import paired_features, serving_features  # noqa: E402
from churnscope.sources.scored import scorer_column  # noqa: E402


def _serving_context(spark, sf_dir):
    """Train-fitted serving stats, train CLV edges, winner and its threshold.

    The winner's frozen test threshold is its validation choice, so the A10
    fallback chain (test, validation, default) needs no test pass.
    """
    stats = _stats(spark, sf_dir)
    best = ev.winner(ev.chosen_val_metrics(fixture_scores(_prepared(spark, sf_dir)), with_auc=False)).select(
        "model", "chosen_threshold").first()
    thr = best["chosen_threshold"] if best["chosen_threshold"] is not None else ev.DEFAULT_THRESHOLD
    return stats.medians, stats.clv_edges, best["model"], thr


def score_serving(raw: DataFrame, stats, model: str) -> DataFrame:
    """I6 -> I1 input: serving features and the winner's probability."""
    feats = serving_features(raw, stats)
    return feats.withColumn("prob", scorer_column(model))


def _retention(spark, sf_dir):
    stats, edges, model, thr = _serving_context(spark, sf_dir)
    scored = score_serving(_raw(spark, sf_dir), stats, model)
    return ac.retention_list(scored, thr, edges)


@query("serving_features")
def q_serving_features(spark, sf_dir):
    from churnscope.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    return serving_features(_raw(spark, sf_dir), _stats(spark, sf_dir).medians).select(
        "customerID", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)


@query("skew_report")
def q_skew_report(spark, sf_dir):
    from churnscope.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    columns = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    both = paired_features(_features(spark, sf_dir), _stats(spark, sf_dir).medians, columns)
    return rp.skew_report(both, columns)


@query("retention_list")
def q_retention_list(spark, sf_dir):
    return _retention(spark, sf_dir)


@query("decision")
def q_decision(spark, sf_dir):
    return _retention(spark, sf_dir).select("customerID", "prob", "decision")


@query("risk_bucket")
def q_risk_bucket(spark, sf_dir):
    return _retention(spark, sf_dir).select("customerID", "prob", "risk")


@query("confidence")
def q_confidence(spark, sf_dir):
    return _retention(spark, sf_dir).select("customerID", "prob", "confidence", "confidence_text")


@query("recommendations")
def q_recommendations(spark, sf_dir):
    return _retention(spark, sf_dir).select("customerID", "risk", "value_segment",
                                            "value_caption", "recommendations", "priority")


@query("risk_value_crosstab")
def q_risk_value_crosstab(spark, sf_dir):
    return ac.risk_value_crosstab(_retention(spark, sf_dir))


# ---- explanation on the fitted design --------------------------------------

from churnscope.operators import explain as xp  # noqa: E402


DIGITS = 9  # both engines' results are compared (and tied ranks decided) at so many digits


def _round(c):
    return F.round(c, DIGITS)


def _rounded(df, *columns):
    return df.withColumns({c: _round(F.col(c)) for c in columns})


_DESIGNS: dict[str, xp.Design] = {}


def _design(spark, sf_dir):
    """The splits, the training split and its design (fitted once per prepared table)."""
    splits, path = _prepared(spark, sf_dir), prepared(spark, sf_dir).path
    if path not in _DESIGNS:
        _DESIGNS[path] = xp.fit_design(train_only(splits))
    return splits, train_only(splits), _DESIGNS[path]


def _coefs(spark, sf_dir):
    _, train, d = _design(spark, sf_dir)
    return xp.mean_difference_coefficients(train, d)


@query("standardised_columns")
def q_standardised_columns(spark, sf_dir):
    splits, _, d = _design(spark, sf_dir)
    return _rounded(xp.standardised_columns(splits, d), *[f"num__{c}" for c in d.numeric])


@query("one_hot_columns")
def q_one_hot_columns(spark, sf_dir):
    splits, _, d = _design(spark, sf_dir)
    return xp.one_hot_columns(splits, d)


@query("feature_summary")
def q_feature_summary(spark, sf_dir):
    _, train, d = _design(spark, sf_dir)
    return _rounded(xp.column_summary(train, d), "mean", "std")


def _drivers(spark, sf_dir):
    return _rounded(xp.driver_table(_coefs(spark, sf_dir)), "value", "odds_ratio", "abs_value")


@query("driver_table")
def q_driver_table(spark, sf_dir):
    return _drivers(spark, sf_dir)


@query("top_drivers")
def q_top_drivers(spark, sf_dir):
    return xp.top_drivers(_drivers(spark, sf_dir))


@query("linear_importance")
def q_linear_importance(spark, sf_dir):
    _, train, d = _design(spark, sf_dir)
    profile = stash(xp.design_profile(train, d), "design-profile")  # one row per design column, read twice
    out = xp.linear_importance(xp.mean_difference_coefficients(train, d, profile),
                               xp.column_summary(train, d, profile), rank_key=_round)
    return _rounded(out, "importance", "signed")


@query("local_explanation")
def q_local_explanation(spark, sf_dir):
    splits, train, d = _design(spark, sf_dir)
    out = xp.local_explanation(splits.where(F.col("split") == "test"), d, _coefs(spark, sf_dir), rank_key=_round)
    return _rounded(out, "contrib", "value", "coef", "odds_ratio_contrib")


@query("pretty_names")
def q_pretty_names(spark, sf_dir):
    return _coefs(spark, sf_dir).select("feature", xp.pretty_feature(F.col("feature")).alias("pretty"))


@query("odds_text")
def q_odds_text(spark, sf_dir):
    return _drivers(spark, sf_dir).select("feature", xp.odds_text(F.col("odds_ratio")).alias("odds_text"))


# ---- fitted MLlib models ------------------------------------------------------

from churnscope.operators import isotonic as iso  # noqa: E402
from churnscope.operators import ml  # noqa: E402
from churnscope.plans import train as tr  # noqa: E402

_MODELS: dict[tuple[str, str], object] = {}


def _fitted(spark, sf_dir, kind):
    """(splits, design, model); a model is fitted once per prepared table."""
    splits, train, d = _design(spark, sf_dir)
    key = prepared(spark, sf_dir).path, kind
    if key not in _MODELS:
        _MODELS[key] = ml.fit_model(kind, train, d, splits.where(F.col("split") == "val"))
    return splits, d, _MODELS[key]


def _result(spark, sf_dir, kinds=tr.KINDS):
    models = {kind: _fitted(spark, sf_dir, kind)[2] for kind in kinds}
    splits, _, d = _design(spark, sf_dir)
    return tr.train_and_evaluate(splits, models=models, design=d)


def _model_scores(kind):
    def run(spark, sf_dir):
        splits, d, model = _fitted(spark, sf_dir, kind)
        return ml.score(model, splits.where(F.col("split") != "train"), d, kind)
    return run


REGISTRY["logreg_scores"] = _model_scores("logreg")
REGISTRY["forest_scores"] = _model_scores("rf")
REGISTRY["gbt_scores"] = _model_scores("xgb")


@query("logreg_certificate")
def q_logreg_certificate(spark, sf_dir):
    """The design columns in the fitted model, and whether the penalised gradient vanishes at each."""
    splits, d, model = _fitted(spark, sf_dir, "logreg")
    return ml.gradient_table(model, train_only(splits), d).select(
        "feature", (F.abs("gradient") < 1e-4).alias("stationary"))


def beats_fixture(scored, fixture):
    """Class totals of the scored rows, the best AUC of the fixture's scorers on them, and whether the scores' is higher."""
    best = ev.roc_auc(fixture).agg(F.max("auc").alias("fixture_auc"))
    totals = scored.groupBy("model", "split").agg(F.count_if(F.col("y") == 1).alias("positives"),
                                                  F.count_if(F.col("y") != 1).alias("negatives"))
    return totals.join(ev.roc_auc(scored), ["model", "split"]).crossJoin(F.broadcast(best)).select(
        "split", "positives", "negatives", _round(F.col("fixture_auc")).alias("fixture_auc"),
        (F.col("auc") > F.col("fixture_auc")).alias("beats_fixture"))


def _certificate(kind):
    """The fitted model orders the training rows better than the fixture's scorers do."""
    def run(spark, sf_dir):
        splits, d, model = _fitted(spark, sf_dir, kind)
        scored = stash(ml.score(model, train_only(splits), d, kind), "certificate-scores")
        return beats_fixture(scored, _scored(spark, sf_dir).where("split = 'train'"))
    return run


REGISTRY["forest_certificate"] = _certificate("rf")
REGISTRY["gbt_certificate"] = _certificate("xgb")


@query("logreg_metrics")
def q_logreg_metrics(spark, sf_dir):
    """F5 -> G6/G7: validation-chosen threshold and frozen test metrics."""
    scored = _model_scores("logreg")(spark, sf_dir)
    return ev.frozen_test_metrics(scored)


@query("fitted_linear_importance")
def q_fitted_linear_importance(spark, sf_dir):
    """H1 with the fitted logistic regression's coefficients."""
    splits, d, model = _fitted(spark, sf_dir, "logreg")
    coefs = ml.coefficients(model, d)
    return xp.linear_importance(coefs, xp.column_summary(train_only(splits), d))


@query("tree_importance")
def q_tree_importance(spark, sf_dir):
    """H2: forest feature importances, top 40."""
    _, d, model = _fitted(spark, sf_dir, "rf")
    return xp.tree_importance(ml.importances(model, d))


# ---- trees grown from histograms (F6-F8, H2) ----------------------------------

from churnscope.operators import boosting as bo  # noqa: E402
from churnscope.operators import forest as fo  # noqa: E402
from churnscope.operators import trees as ht  # noqa: E402

#: Rounds whose training loss the certificate reads.
LOSS_ROUNDS = 10


def _boosted(spark, sf_dir) -> bo.Boosted:
    """The boosted trees, fitted once per prepared table."""
    splits = _prepared(spark, sf_dir)
    key = prepared(spark, sf_dir).path, "boosting"
    if key not in _MODELS:
        _MODELS[key] = bo.fit_boosting(train_only(splits), splits.where(F.col("split") == "val"))
    return _MODELS[key]


def _first_rounds(spark, sf_dir) -> bo.Boosted:
    """The first rounds, without a look at the validation rows."""
    key = prepared(spark, sf_dir).path, "first-rounds"
    if key not in _MODELS:
        _MODELS[key] = bo.fit_boosting(_train(spark, sf_dir), settings=bo.Settings(rounds=LOSS_ROUNDS))
    return _MODELS[key]


def _balanced_forest(spark, sf_dir) -> fo.Forest:
    key = prepared(spark, sf_dir).path, "balanced-forest"
    if key not in _MODELS:
        _MODELS[key] = fo.fit_forest(_train(spark, sf_dir))
    return _MODELS[key]


@query("boosting_first_tree")
def q_boosting_first_tree(spark, sf_dir):
    """the nodes of the first tree, with gains, leaf values and covers."""
    model = _first_rounds(spark, sf_dir)
    nodes = ht.node_table(spark, {0: model.trees[0]}, model.bins)
    return _rounded(nodes.select("node", "feature", "bin", "level", "missing_left", "gain", "value", "cover", "rows"),
                    "gain", "value", "cover")


@query("boosting_rounds")
def q_boosting_rounds(spark, sf_dir):
    """F8: validation AUC by round, the rounds looked at and the one kept."""
    model = _boosted(spark, sf_dir)
    rounds = spark.createDataFrame([(i + 1, a) for i, a in enumerate(model.auc)], "round int, auc double")
    return bo.best_round(rounds, model.settings.patience)


@query("staged_early_stop")
def q_staged_early_stop(spark, sf_dir):
    """F8 on staged scores that SQL can state: round r adds r times a point-based score to noise."""
    from churnscope.sources.scored import id_number
    rows = _scored(spark, sf_dir).where("split = 'val' AND model = 'xgb'")
    number = id_number(F.col("customerID"))
    rounds = rows.select("y", "prob", number.alias("i"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("round"))
    r = F.col("round")
    staged = rounds.select("round", "y", (F.col("prob") * 16 * F.least(r, F.lit(9))
                                          + (F.col("i") * (2 * r + 1)) % (12 + (r - 9) * (r - 9))).alias("prob"))
    return _rounded(bo.best_round(bo.auc_by_round(staged), 8), "auc")


@query("boosting_scores")
def q_boosting_scores(spark, sf_dir):
    return bo.score_boosting(_boosted(spark, sf_dir), _prepared(spark, sf_dir).where(F.col("split") != "train"))


@query("boosting_metrics")
def q_boosting_metrics(spark, sf_dir):
    """F7 -> G6/G7: validation-chosen threshold and frozen test metrics of the boosted trees."""
    return ev.frozen_test_metrics(q_boosting_scores(spark, sf_dir))


@query("boosting_certificate")
def q_boosting_certificate(spark, sf_dir):
    """whether the training loss falls in each of the first rounds, and stays under that of margin 0."""
    model = _first_rounds(spark, sf_dir)
    loss = {r["round"]: r["loss"] for r in bo.training_loss(model, _train(spark, sf_dir), LOSS_ROUNDS).collect()}
    start = _train(spark, sf_dir).agg(F.avg(F.when(F.col("ChurnFlag") == 1, model.weight).otherwise(1.0))
                                      * F.log(F.lit(2.0))).first()[0]
    return spark.createDataFrame([(i, loss[i] < loss.get(i - 1, start)) for i in sorted(loss)],
                                 "round int, falls boolean")


def _contributions(spark, sf_dir):
    sample = sp.bounded_sample(_train(spark, sf_dir), bo.SHAPLEY_ROWS)
    return bo.contributions(_boosted(spark, sf_dir), sample)


@query("shapley_importance")
def q_shapley_importance(spark, sf_dir):
    """H2: mean absolute Shapley value of the boosted trees over the D2 sample, top 40."""
    return xp.tree_importance(bo.shapley_importance(_contributions(spark, sf_dir)))


@query("shapley_certificate")
def q_shapley_certificate(spark, sf_dir):
    """H2: whether each sampled subscriber's contributions add up to the margin."""
    return _contributions(spark, sf_dir).groupBy("customerID").agg(
        (F.abs(F.sum("contribution") + F.first("expected") - F.first("margin")) < 1e-9).alias("adds_up"))


@query("forest_bootstrap")
def q_forest_bootstrap(spark, sf_dir):
    """counts and class weights of every tree's bootstrap."""
    rows = _train(spark, sf_dir).select(F.col("ChurnFlag").alias("y"), ht.id_word(F.col("customerID")).alias("u"))
    return _rounded(fo.bootstrap_weights(rows, fo.ForestSettings().trees), "weight_negative", "weight_positive")


@query("balanced_forest_scores")
def q_balanced_forest_scores(spark, sf_dir):
    """F6 -> F9: scores of the forest whose class weights are balanced in every bootstrap."""
    return fo.score_forest(_balanced_forest(spark, sf_dir), _prepared(spark, sf_dir).where(F.col("split") != "train"))


def _calibrated(spark, sf_dir):
    """F11 on the scored fixture: isotonic scores of the winner's test rows, and its validation record."""
    scored = _scored(spark, sf_dir)
    chosen = ev.winner(ev.chosen_val_metrics(scored, with_auc=False)).select("model", "chosen_threshold")
    best = scored.where(F.col("model") == chosen.first()["model"])
    blocks = iso.fit_isotonic(best.where(F.col("split") == "val"))
    return iso.apply_isotonic(blocks, best.where(F.col("split") == "test")), chosen


@query("isotonic_scores")
def q_isotonic_scores(spark, sf_dir):
    return _rounded(_calibrated(spark, sf_dir)[0], "prob")


@query("calibrated_metrics")
def q_calibrated_metrics(spark, sf_dir):
    """calibrated test metrics at the uncalibrated winner's frozen threshold."""
    return _rounded(tr.calibrated_metrics(*_calibrated(spark, sf_dir)), "precision", "recall", "f1", "auc")


# ---- streaming --------------------------------------------------------------

@query("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """I8: the retention list computed by a Structured Streaming query.

    The prepared table is consumed as a file stream; the result equals the
    batch retention list."""
    import os
    import uuid
    from churnscope.session import ensure_checkpoint_dir
    from churnscope.streaming.scoring import run_retention_stream
    table = prepared(spark, sf_dir)
    base = os.path.join(ensure_checkpoint_dir(spark), "stream", uuid.uuid4().hex)
    return run_retention_stream(spark, table.path, *_stream_args(spark, sf_dir),
                                sink_dir=os.path.join(base, "sink"), checkpoint_dir=os.path.join(base, "progress"),
                                schema=table.schema)


def _stream_args(spark, sf_dir):
    stats, edges, model, thr = _serving_context(spark, sf_dir)
    return stats, model, thr, edges


@query("model_selection")
def q_model_selection(spark, sf_dir):
    """Lifecycle (b): all three fitted models, validation choice and frozen test metrics in one table, with
    the winner flagged and its calibrated test record (F5-F12, G4-G7)."""
    result = _result(spark, sf_dir)
    table = tr.metrics_table(result).withColumn("calibrated", F.lit(False))
    cal = tr.calibrated_metrics(result.calibrated(), result.val_metrics).withColumn("calibrated", F.lit(True))
    both = table.unionByName(cal, allowMissingColumns=True)
    return both.withColumn("is_winner", F.col("model") == F.lit(result.winner))


@query("fitted_retention_list")
def q_fitted_retention_list(spark, sf_dir):
    """I7 as the scoring page does it: serving features scored by a fitted
    pipeline (the logistic regression), its validation threshold, actions."""
    result = _result(spark, sf_dir, ("logreg",))
    return tr.retention_with_model(_raw(spark, sf_dir), _train(spark, sf_dir), result)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.estimators import estimator, estimators
from strataloom.operators import metrics
from strataloom.operators.compress import SignalCompressor, cluster_columns, segment_columns
from strataloom.operators.encode import OneHotEncoder, TargetEncoder
from strataloom.operators.gram import grouped_gram, matrix_of
from strataloom.operators.scale import MinMaxScaler, StandardScaler
from strataloom.operators.subjects import (
    hot_subjects,
    join_members,
    require_binary,
    roll_up_subjects,
    signals_of_members,
    subject_sizes,
)
from strataloom.operators.transform import encoder_chain, normalizer_chain


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_roll_up_takes_maxima_and_drops_null_subjects(spark):
    tiny = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 3, None), ("b", None, float("nan")), ("b", 2, 1.0), ("c", None, None), (None, 9, 9.0)],
        "subject string, age int, x double",
    )
    assert rows(roll_up_subjects(tiny, "subject").fillna(-1)) == [("a", 3, 5.0), ("b", 2, 1.0), ("c", -1, -1.0)]
    assert rows(roll_up_subjects(tiny, "subject", [])) == [("a",), ("b",), ("c",)]
    flagged = roll_up_subjects(tiny, "subject", ["age"], ["age"], "n").filter("subject = 'a'").first()
    assert flagged["__varies_age"] and flagged["n"] == 2
    with pytest.raises(ValueError):
        roll_up_subjects(tiny, "patient")
    with pytest.raises(ValueError):
        require_binary(tiny, "age")


def test_hot_subject_join_equals_plain_join(spark):
    signals = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 200).alias("subject")
    )
    members = spark.range(200).select(
        F.col("id").alias("subject"), F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), F.lit(2).alias("n_draws")
    )
    hot = hot_subjects(subject_sizes(signals, "subject"), "subject", task_rows=100)
    assert rows(hot) == [(0, 16)]
    plain = join_members(signals, members, "subject", "row_id")
    salted = join_members(signals, members, "subject", "row_id", hot)
    assert rows(plain.select("row_id", "fold")) == rows(salted.select("row_id", "fold"))
    assert salted.count() == 6000


def test_right_join_keeps_subjects_without_signals(spark):
    signals = spark.createDataFrame([(1, "a")], "row_id int, subject string")
    members = spark.createDataFrame([("a", 1), ("b", 1)], "subject string, n_draws int")
    assert rows(signals_of_members(signals, members, "subject").fillna(-1)) == [("a", 1, 1), ("b", -1, 1)]


@pytest.mark.parametrize("values, want", [
    ([1.0, 2.0, 4.0, 9.0], {"mean": 4.0, "median": 3.0, "sum": 16.0, "std": 3.082207}),
    ([3.0, None, 1.0, 8.0], {"mean": 4.0, "median": 3.0, "sum": 12.0, "std": 2.943920}),
    ([1e9, 1e9 + 1, 1e9 + 2], {"std": 0.816497}),
    ([None, None], {"mean": None, "median": None, "sum": 0.0, "std": None}),
])
def test_estimators(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    for name, w in want.items():
        got = df.select(estimator(name)(F.col("v"))).first()[0]
        assert got == w if w is None else math.isclose(got, w, abs_tol=1e-6), name


def test_estimator_lookup(spark):
    with pytest.raises(ValueError, match="median"):
        estimators(["mode"])
    top = estimator(lambda v: F.array_max(v))
    assert spark.createDataFrame([([1.0, 7.0],)], "v array<double>").select(top(F.col("v"))).first()[0] == 7.0


def scored(spark, pairs):
    return spark.createDataFrame([("f", y, p, w) for y, p, w in pairs], "fold string, y int, proba double, w int")


def test_auc_with_a_tie(spark):
    df = scored(spark, [(0, 0.1, 1), (1, 0.4, 1), (0, 0.4, 1), (1, 0.8, 1)])
    assert metrics.fold_auc(df, "y").first()["roc_auc"] == 0.875


def test_weighted_scores_equal_expanded_scores(spark):
    rng = np.random.default_rng(1)
    df = scored(spark, [(int(y), float(p), int(w)) for y, p, w in zip(
        rng.integers(0, 2, 300), rng.random(300), rng.integers(1, 4, 300))])
    expanded = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w")))).drop("copy")
    for score in (metrics.fold_auc, lambda d, y, w=None: metrics.fold_rates(metrics.classify(d, 0.5), y, w)):
        a, b = score(df, "y", "w").first(), score(expanded, "y").first()
        assert all(x == y or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b))


def test_auc_equals_pair_count_for_any_scores(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 2)
    df = scored(spark, [(int(a), float(b), 1) for a, b in zip(y, p)])
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    want = ((pos > neg) + 0.5 * (pos == neg)).mean()
    assert math.isclose(metrics.fold_auc(df, "y").first()["roc_auc"], want, abs_tol=1e-12)


def test_one_class_only(spark):
    df = metrics.classify(scored(spark, [(1, 0.9, 1), (1, 0.2, 1)]), 0.5)
    rates = metrics.fold_rates(df, "y").first()
    assert (rates["accuracy"], rates["fnr"], rates["fpr"]) == (0.5, 0.5, None)
    assert metrics.fold_auc(df, "y").first()["roc_auc"] is None
    assert metrics.strata_auc(df, "y").first()["roc_auc"] == 0.5
    report = metrics.report(metrics.fold_rates(df, "y"), ["accuracy", "fpr"]).first()
    assert (report["accuracy"], report["fpr"]) == (0.5, None)


def test_threshold_is_strict(spark):
    df = scored(spark, [(1, 0.5, 1), (1, 0.51, 1)])
    assert sorted(r["pred"] for r in metrics.classify(df, 0.5).collect()) == [0, 1]
    with pytest.raises(ValueError):
        metrics.check_threshold(1.0)


def test_constant_columns_scale_to_the_lower_bound_and_zero(spark):
    df = spark.createDataFrame([(4.0, 1.0), (4.0, 3.0)], "c double, x double")
    assert rows(MinMaxScaler(["c", "x"]).fit(df).transform(df)) == [(0.0, 0.0), (0.0, 1.0)]
    assert rows(StandardScaler(["c", "x"]).fit(df).transform(df)) == [(0.0, -1.0), (0.0, 1.0)]
    # values outside the fit range are not clipped
    wide = spark.createDataFrame([(4.0, 5.0)], "c double, x double")
    assert MinMaxScaler(["x"]).fit(df).transform(wide).first()["x"] == 2.0
    with pytest.raises(ValueError):
        MinMaxScaler(["x"], feature_range=(1, 0))


def test_one_hot_null_is_a_category_and_unseen_is_zero(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    val = spark.createDataFrame([("a",), ("c",), (None,)], "c string")
    model = OneHotEncoder(["c"]).fit(fit)
    assert model.added == ["c_1", "c_2", "c_3"]
    assert rows(model.transform(val)) == [(0, 0, 0), (0, 0, 1), (1, 0, 0)]
    numbers = spark.createDataFrame([(10,), (9,)], "c int")
    assert rows(OneHotEncoder(["c"]).fit(numbers).transform(numbers)) == [(0, 1), (1, 0)]


def test_target_encoding_of_unseen_and_null_is_the_prior(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "c string, y int")
    val = spark.createDataFrame([("a", 0), ("z", 0), (None, 0)], "c string, y int")
    got = rows(TargetEncoder(["c"], min_samples_leaf=1, smoothing=1.0).fit(fit, target="y").transform(val))
    s = 1 / (1 + math.exp(-1))
    assert np.allclose([r[0] for r in got], [0.75 * (1 - s) + 0.5 * s, 0.75, 0.75])
    with pytest.raises(ValueError):
        TargetEncoder(["c"]).fit(fit)


def test_chains_and_feature_lists(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 3.0, 1)], "c string, x double, y int")
    encoders = encoder_chain(["one_hot"], [{}], [["c"]]).fit(df)
    scalers = normalizer_chain(["min_max_normalization"], [{"copy": True}], [["x"]]).fit(df)
    assert encoders.features(["c", "x"]) == ["x", "c_1", "c_2"]
    assert rows(scalers.transform(encoders.transform(df)).select("x", "c_1", "c_2")) == [(0.0, 1, 0), (1.0, 0, 1)]
    kept = encoder_chain(["target_encoder"], [{}], [["c"]], ["y"]).fit(df)
    assert kept.features(["c", "x"]) == ["c", "x"]
    with pytest.raises(ValueError, match="one_hot"):
        encoder_chain(["hashing"], [{}], [["c"]])


def plain_kmeans(x, k):
    """Lloyd on the columns of ``x`` with the same farthest-point start."""
    points = (x - x.mean(axis=1, keepdims=True)).T
    seeds = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(seeds) < k:
        near[seeds] = -np.inf
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[seeds[-1]]) ** 2).sum(1))
    centers = points[seeds]
    for _ in range(100):
        labels = ((points[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([points[labels == c].mean(0) for c in range(k)])
    order = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}
    return [order[c] for c in labels.tolist()]


def test_gram_clusters_equal_plain_kmeans(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 3)) * 4
    x = centers[:, [0, 0, 1, 2, 1, 0, 2, 2]] + rng.normal(size=(40, 8))
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    cells = grouped_gram(df.withColumn("k", F.lit(0)), ["k"], names, center_rows=True).toPandas()
    gram = matrix_of(cells, 8)
    assert cluster_columns(gram, 3).tolist() == plain_kmeans(x, 3) == [0, 0, 1, 2, 1, 0, 2, 2]
    groups = SignalCompressor([3], [names], ["mean"]).fit(df).transform(df)
    assert groups.columns == ["compressed_1_frame_1", "compressed_1_frame_2", "compressed_1_frame_3"]
    assert np.allclose(sorted(r[1] for r in groups.collect()), sorted(x[:, [2, 4]].mean(1)))


def test_weighted_gram_equals_repeated_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3), (0, 4.0, 1.0, 1), (1, 2.0, 2.0, 2)], "k int, a double, b double, w int")
    got = rows(grouped_gram(df, ["k"], ["a", "b"], "w"))
    assert got == [(0, 0, 0, 19.0), (0, 0, 1, 10.0), (0, 1, 1, 13.0), (1, 0, 0, 8.0), (1, 0, 1, 8.0), (1, 1, 1, 8.0)]


def test_gram_rejects_missing_values(spark):
    df = spark.createDataFrame([(0, None)], "k int, a double")
    with pytest.raises(Exception, match="missing values"):
        grouped_gram(df, ["k"], ["a"]).collect()


def test_more_clusters_than_distinct_columns_leaves_none_empty():
    gram = np.ones((5, 5))
    assert sorted(set(cluster_columns(gram, 3).tolist())) == [0, 1, 2]


def test_contiguous_segments_are_optimal():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 7))
    gram = x.T @ x
    labels = segment_columns(gram, 3)
    assert labels.tolist() == sorted(labels.tolist())

    def cost(cuts):
        parts = np.split(x.T, cuts)
        return sum(((p - p.mean(0)) ** 2).sum() for p in parts)

    best = min(cost([a, b]) for a in range(1, 6) for b in range(a + 1, 7))
    assert math.isclose(cost(list(np.flatnonzero(np.diff(labels)) + 1)), best)


def test_compressor_checks(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        SignalCompressor([3], [["a", "b"]], ["mean"]).fit(df)
    with pytest.raises(ValueError):
        SignalCompressor([1, 2], [["a"]], ["mean"])


def test_cells_give_the_same_fits_as_a_pass_per_fold(spark):
    from strataloom.operators.cells import fit_cells
    from strataloom.operators.folds import holdout_folds, strata_folds
    from strataloom.operators.subjects import subject_sizes
    from strataloom.operators.transform import fit_stages

    rng = np.random.default_rng(8)
    data = [(i, int(s), f"p{s % 3}", int(s) % 2, "abc"[i % 3] if i % 7 else None, *map(float, rng.normal(5, 2, 6)))
            for i, s in enumerate(rng.integers(0, 40, 800))]
    names = [f"f{i}" for i in range(5)]
    signals = spark.createDataFrame(data, "row_id long, subject long, site string, y int, c string, x double, "
                                    + ", ".join(f"{n} double" for n in names))
    people = roll_up_subjects(signals, "subject", ["site", "y"])
    for folds in (holdout_folds(people, "subject", "y", 3, 4, seed=1), strata_folds(people, "subject", "site", "y", seed=1)):
        rows_of_folds = signals.join(folds, "subject")
        cells = fit_cells(signals, folds, subject_sizes(signals, "subject"), "subject", "row_id", "n_rows")
        stages = (encoder_chain(["target_encoder", "one_hot"], [{}, {}], [["c"], ["site"]], ["y", None]),
                  normalizer_chain(["mean_var_normalization", "min_max_normalization"], [{}, {}], [["x", "c"], ["x"]]),
                  SignalCompressor([2], [names], ["median"]))
        out = [
            fit_stages(rows_of_folds.filter("role = 'fit'"), ["fold"], "n_draws", *stages, c).transform(rows_of_folds)
            .select("fold", "row_id", "c", "x", "compressed_1_frame_1", "compressed_1_frame_2", "site_1", "site_2")
            .orderBy("fold", "row_id", "n_draws").toPandas()
            for c in (None, cells)
        ]
        assert out[0].iloc[:, :2].equals(out[1].iloc[:, :2])
        assert np.allclose(out[0].iloc[:, 2:].to_numpy(float), out[1].iloc[:, 2:].to_numpy(float))

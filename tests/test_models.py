import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.catalog.models import study_settings
from strataloom.config import StudySettings
from strataloom.materialize import broadcast_if_small, pin
from strataloom.operators import ensemble, knn, newton, trees
from strataloom.operators.ensemble import BatchPlan, Ensemble, NodeSpec, accept, keep_best, parameter_range
from strataloom.operators.encode import OneHotEncoder
from strataloom.operators.ridge import ridge_grams, solve_ridge
from strataloom.operators.scale import MinMaxScaler
from strataloom.plans.experiment import HoldoutExperiment, LeaveStratumOutExperiment, StratifiedExperiment
from strataloom.plans.jobs import run_holdout, run_leave_stratum_out
from strataloom.sources.results import result_name, save_experiment
from strataloom.sources.tables import read_signals, with_row_id
from strataloom.streaming.scoring import score_stream

FEATURES = ["amount", "b", "c"]


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(1)
    subject = rng.integers(0, 60, 1500)
    y = subject % 2
    x = rng.normal(size=(1500, 3)) + y[:, None] * np.array([1.5, 0.0, -1.0])
    data = [(i, int(s), f"site{s % 4}", int(t), *map(float, r)) for i, (s, t, r) in enumerate(zip(subject, y, x))]
    df = spark.createDataFrame(data, "row_id long, subject long, segment string, target int, amount double, b double, c double")
    return pin(df)


@pytest.fixture(scope="module")
def subjects(signals):
    return signals.groupBy("subject").agg(F.max("target").alias("target"))


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    df = spark.createDataFrame([("k", *map(float, r), int(t)) for r, t in zip(x, y)], "k string, a double, b double, c double, y int")
    tries = spark.createDataFrame([("k", 0.5), ("k", 20.0)], "k string, alpha double")
    got = {r["alpha"]: r for r in solve_ridge(ridge_grams(df, ["k"], ["a", "b", "c"], "y"), tries, ["k"], 3).collect()}
    for alpha, r in got.items():
        xc, yc = x - x.mean(0), (2 * y - 1) - (2 * y - 1).mean()
        coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(r["coef"], coef)
        assert np.isclose(r["intercept"], (2 * y - 1).mean() - x.mean(0) @ coef)


def test_knn_equals_brute_force_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "TRAIN_BLOCK", 30)
    monkeypatch.setattr(knn, "QUERY_CHUNK", 40)
    rng = np.random.default_rng(4)
    q, t = rng.integers(0, 5, (150, 2)).astype(float), rng.integers(0, 5, (100, 2)).astype(float)
    label = rng.integers(0, 2, 100)
    queries = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(q)], "fold int, q long, a double, b double")
    train = spark.createDataFrame([(0, i, int(z), *map(float, r)) for i, (r, z) in enumerate(zip(t, label))],
                                  "fold int, t long, y int, a double, b double")
    found = knn.nearest(queries, train, ["fold"], ["a", "b"], "y", "q", "t", 5, 150, 100)
    got = {}
    for r in found.collect():
        got.setdefault(r["q"], set()).add(r["t"])
    distance = ((q[:, None] - t[None]) ** 2).sum(2)
    assert got == {i: set(np.lexsort((np.arange(100), distance[i]))[:5].tolist()) for i in range(150)}
    votes = {r["q"]: r["vote"] for r in knn.knn_votes(found, ["fold"], "q").collect()}
    assert votes == {i: int(label[list(got[i])].mean() > 0.5) for i in range(150)}


def _rows_of_trees(spark, x, y, w, n_trees=1):
    data = [(0, 0, t, "train" if v else "test", i, int(c), int(v), [float(k) for k in r]) for t in range(n_trees) for i, (r, c, v) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(data, "fold int, attempt bigint, tree int, side string, slot bigint, y int, w bigint, x array<double>")


def _tries(spark, depth=None, n_features=4, min_leaf=1, min_split=2):
    return spark.createDataFrame([(0, 0, 11, depth, n_features, min_leaf, min_split)],
                                 "fold int, attempt bigint, seed bigint, max_depth int, n_features int, min_leaf bigint, min_split bigint")


def _order(seed, tree, path, p):
    """Features in the order in which a node looks at them."""
    return sorted(range(p), key=lambda f: (int(hashlib.md5(f"{seed}|split|{tree}|{path}|{f}".encode()).hexdigest()[:15], 16), f))


def _plain_tree(x, y, w, depth, n_features, min_leaf, min_split, tree=0, seed=11):
    """Nodes ``path -> (feature, threshold, n, pos)``, one at a time."""
    out, todo = {}, [("", np.flatnonzero(w > 0), 0)]
    while todo:
        path, at, level = todo.pop()
        n, pos = int(w[at].sum()), int((w[at] * y[at]).sum())
        out[path] = (None, None, n, pos)
        if pos in (0, n) or n < max(min_split, 2 * min_leaf) or (depth is not None and level >= depth):
            continue
        best = None
        for place, f in enumerate(_order(seed, tree, path, x.shape[1]) if n_features < x.shape[1] else range(x.shape[1])):
            if place >= n_features and best is not None:
                break
            values = np.unique(x[at, f])
            for v, following in zip(values, values[1:]):
                left = at[x[at, f] <= v]
                ln, lp = float(w[left].sum()), float((w[left] * y[left]).sum())
                if ln < min_leaf or n - ln < min_leaf:
                    continue
                cost = round((lp - lp * lp / ln) + ((pos - lp) - (pos - lp) * (pos - lp) / (n - ln)), 9)
                key = (place if place >= n_features else 0, cost, f, v)
                if best is None or key < best[0]:
                    best = (key, f, v, (v + following) / 2)
        if best is not None:
            _, f, v, threshold = best
            out[path] = (f, threshold, n, pos)
            todo += [(path + "0", at[x[at, f] <= v], level + 1), (path + "1", at[x[at, f] > v], level + 1)]
    return out


@pytest.mark.parametrize("settings", [(None, 4, 1, 2), (3, 2, 5, 2), (None, 1, 1, 30), (6, 4, 20, 2)])
@pytest.mark.parametrize("range_rows", [100_000, 17])
def test_trees_equal_trees_grown_node_by_node(spark, settings, range_rows):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 4, 240), rng.normal(size=240).round(1), rng.exponential(size=240), np.zeros(240)]).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 1] < 0.3) ^ (rng.random(240) < 0.1)).astype(int)
    w = rng.poisson(1.0, 240)
    nodes, moved = trees.grow(_rows_of_trees(spark, x, y, w, 2), _tries(spark, *settings), 4, range_rows)
    got = {(r["tree"], r["path"]): (r["feature"], r["threshold"], r["n"], r["pos"]) for r in nodes.collect()}
    want = {(t, path): node for t in range(2) for path, node in _plain_tree(x, y, w, *settings, tree=t).items()}
    assert got.keys() == want.keys()
    for key, (f, threshold, n, pos) in want.items():
        assert got[key][0] == f and got[key][2:] == (n, pos) and (f is None or np.isclose(got[key][1], threshold)), key
    arrays = [trees.tree_arrays(t) for t in trees.as_arrays(nodes).first()["tree"]]
    votes = trees.forest_votes(x, arrays)
    assert {r["path"] for r in moved.collect()} <= {k[1] for k, v in want.items() if v[0] is None}
    score = trees.scores(nodes, moved).first()
    assert np.isclose(score["train_score"], (votes == y)[w > 0].mean()) and np.isclose(score["test_score"], (votes == y)[w == 0].mean())


def test_trees_go_as_deep_as_the_data(spark):
    y = np.arange(90) % 2  # every cut parts one row from the rest
    x = np.arange(90, dtype=float)[:, None]
    nodes, moved = trees.grow(_rows_of_trees(spark, x, y, np.ones(90, dtype=int)), _tries(spark, n_features=1), 1)
    grown = trees.as_arrays(nodes).first()["tree"]
    assert (trees.forest_votes(x, [trees.tree_arrays(grown[0])]) == y).all() and len(grown[0]) == 179


@pytest.mark.parametrize("setting, want", [(None, 9), ("sqrt", 3), ("log2", 3), ("4", 4), ("30", 9), ("0.5", 4)])
def test_features_per_split(spark, setting, want):
    assert spark.range(1).select(trees.split_features(F.lit(setting).cast("string"), 9)).first()[0] == want


def test_bootstrap_weights_are_poisson(spark):
    got = dict(map(tuple, spark.range(40_000).select(trees.poisson_weight(1, F.col("id")).alias("w")).groupBy("w").count().collect()))
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs(got[k] / 40_000 - share) < 0.01


@pytest.mark.parametrize("kind, params", [
    ("logistic", {}), ("SVM", {}), ("tree", {"max_depth": 4}), ("tree", {"max_depth": 4, "max_features": 2}),
    ("rf", {"n_estimators": 5, "max_depth": 4}), ("rf", {"n_estimators": 3, "max_depth": 3, "bootstrap": False, "max_features": 1}),
])
def test_learners_beat_chance(signals, subjects, kind, params):
    fitted = Ensemble([kind], [2], [params]).fit(signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, 0.5, seed=1)
    hit = fitted.predict(signals).agg(F.avg((F.col("pred") == F.col("target")).cast("int"))).first()[0]
    assert hit > 0.65 and fitted.nodes.count() == 2  # single batches of few rows


def _weights(signals, kind, c, free=True, max_iter=100):
    rows = signals.select(F.lit(0).alias("fold"), F.lit(0).cast("bigint").alias("batch"), F.col("target").alias("y"), *FEATURES)
    tries = rows.sparkSession.createDataFrame([(0, i, 0, v, free, max_iter) for i, v in enumerate(c)], "fold int, attempt bigint, batch bigint, c double, fit_intercept boolean, max_iter int")
    return [(r["intercept"], np.array(r["coef"])) for r in newton.fit_linear(kind, rows, tries, FEATURES).orderBy("attempt").collect()]


@pytest.mark.parametrize("free", [True, False])
def test_newton_reaches_the_optimum(signals, free):
    pdf = signals.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf["target"].to_numpy()
    s = 2 * y - 1
    slopes = {"logistic": lambda f: 1 / (1 + np.exp(-f)) - y, "SVM": lambda f: -2 * s * np.maximum(0, 1 - s * f)}
    strengths = [0.001, 0.5, 100.0]
    for kind, slope in slopes.items():
        for c, (b, w) in zip(strengths, _weights(signals, kind, strengths, free)):
            g = slope(x @ w + b)
            assert np.allclose(w + c * (x.T @ g), 0, atol=1e-6 * max(1, c)) and (abs(c * g.sum()) < 1e-6 * max(1, c) if free else b == 0)


def test_newton_on_classes_that_can_be_separated(spark):
    rows = spark.createDataFrame([(0, 0, int(v > 0), float(v), 0.0) for v in (-3, -2, -1, 1, 2, 3)], "fold int, batch bigint, y int, a double, b double")
    tries = spark.createDataFrame([(0, 0, 0, 1e6, True, 100)], "fold int, attempt bigint, batch bigint, c double, fit_intercept boolean, max_iter int")
    for kind in ("logistic", "SVM"):
        r = newton.fit_linear(kind, rows, tries, ["a", "b"]).first()
        assert r["coef"][0] > 0.99 and abs(r["coef"][1]) < 1e-6 and abs(r["intercept"]) < 1e-3


def test_accept_and_best(spark):
    nodes = spark.createDataFrame(
        [("f", 0, 0.4, 0.9, 1), ("f", 1, 0.7, 0.5, 2), ("f", 2, 0.7, 0.6, 3), ("f", 3, 0.85, 0.1, 4), ("f", 4, 0.9, 0.1, 5)],
        "fold string, attempt long, test_score double, train_score double, node int",
    )
    assert sorted(r["attempt"] for r in accept(nodes, 0.5, 3).collect()) == [1, 2, 3]
    assert sorted(r["attempt"] for r in keep_best(nodes, 3).collect()) == [2, 3, 4]


def test_parameter_ranges():
    assert parameter_range({"range": [1, 5]}) == (1, 5) and parameter_range((0.1, 0.2)) == (0.1, 0.2)
    assert parameter_range(3) is None and parameter_range([1, 5]) is None
    with pytest.raises(ValueError, match="Ridge"):
        NodeSpec("perceptron", 1)
    with pytest.raises(ValueError):
        Ensemble(["Ridge"], [1, 2])


PLAN = BatchPlan(0.8, 4, 4, 120, 60)


def test_single_ensemble(spark, signals, subjects):
    spec = Ensemble(["Ridge", "tree", "knn", "logistic"], [4, 3, 2, 2],
                    [{"alpha": (0.5, 2.0)}, {"max_depth": {"range": [2, 5]}}, {}, {}])
    fitted = spec.fit(signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, 0.5, None, seed=1)
    assert fitted.n_nodes == fitted.nodes.count() == 11
    scored = fitted.predict(signals, 0.5)
    assert "fold" not in scored.columns and scored.count() == 1500
    assert scored.agg(F.avg((F.col("pred") == F.col("target")).cast("int"))).first()[0] > 0.8
    shares = {round(r["proba"] * 11, 6) for r in scored.select("proba").distinct().collect()}
    assert shares <= {float(i) for i in range(12)}
    with pytest.raises(ValueError):
        fitted.predict(signals, 0.0)
    with pytest.raises(ValueError):
        fitted.predict_proba(signals.drop("b"))


def test_shipping_in_pieces_gives_the_same_votes(signals, subjects, monkeypatch):
    fold = F.explode(F.array(F.lit("p"), F.lit("q"))).alias("fold")
    members = subjects.select("subject", fold, F.lit(1).cast("bigint").alias("n_draws"))
    fitted = Ensemble(["Ridge", "tree"], [3, 2], [{}, {"max_depth": 3}]).fit_folds(
        signals, members, subjects, "subject", "target", "row_id", lambda df: df, FEATURES, PLAN, 0.5, seed=1)
    rows = signals.select("*", fold)

    def votes():
        return sorted(map(tuple, fitted.predict_proba(rows).select("fold", "row_id", "proba").collect()))

    whole = votes()
    monkeypatch.setattr(ensemble, "_SHIPPED_NUMBERS", 1)
    assert votes() == whole


def test_an_unreachable_cap_stops(signals, subjects):
    spec = Ensemble(["Ridge"], [2], [{}], attempts_per_node=2)
    with pytest.raises(RuntimeError, match="Ridge.*best score"):
        spec.fit(signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, score_cap=1.01, seed=1)


def test_accepted_nodes_do_not_depend_on_the_wave(signals, subjects):
    few, many = [
        Ensemble(["Ridge"], [n], [{}]).fit(signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, 0.85, seed=1)
        for n in (2, 5)
    ]
    picked = [sorted(r["attempt"] for r in f.nodes.collect()) for f in (few, many)]
    assert picked[1][:2] == picked[0]


def test_later_waves_leave_finished_folds_alone(signals, subjects, monkeypatch):
    fold = F.explode(F.array(F.lit("p"), F.lit("q"))).alias("fold")
    members = subjects.select("subject", fold, F.lit(1).cast("bigint").alias("n_draws"))
    seen = []
    table = ensemble.attempt_table
    monkeypatch.setattr(ensemble, "attempt_table", lambda folds, *a: seen.append(sorted(r["fold"] for r in folds.collect())) or table(folds, *a))
    fit = Ensemble(["Ridge"], [3], [{}]).fit_folds
    fitted = fit(signals, members, subjects, "subject", "target", "row_id", lambda df: df, FEATURES, PLAN, 0.86, seed=5)
    assert fitted.nodes.groupBy("fold").count().collect() and seen[0] == ["p", "q"] and all(len(s) <= 2 for s in seen)
    counts = {r["fold"]: r["count"] for r in fitted.nodes.groupBy("fold").count().collect()}
    assert counts == {"p": 3, "q": 3}


def test_default_batches_follow_subjects_and_rows(signals, subjects):
    fit = subjects.select("subject", F.lit(0).alias("fold"), F.lit(1).cast("bigint").alias("n_draws"))
    split, n = ensemble.inner_split(fit, subjects.withColumnRenamed("target", "class"), "subject", 0.8, 1)
    draws, batches, total, longest = ensemble.draw_batches(
        signals, split, n, BatchPlan(0.8), "subject", "target", "row_id", 1)
    assert n == {0: 60} and batches == {0: (60, 60)} and longest == 1200
    assert total == draws.count() == 60 * (1200 + 2 * (int((1.0 - 0.8) * 1500) // 2))
    sides = split.groupBy("side").agg(F.collect_set("subject").alias("s")).collect()
    assert not set(sides[0]["s"]) & set(sides[1]["s"])


def test_experiments(spark, signals, tmp_path):
    settings = study_settings(inputs=FEATURES)
    holdout = HoldoutExperiment(signals, settings, seed=1)
    stats = holdout.run(3, 8)
    assert sorted(stats.columns) == ["accuracy", "fnr", "fold", "fpr", "roc_auc"]
    assert [r["fold"] for r in stats.orderBy("fold").collect()] == [0, 1, 2]
    assert holdout.report().first()["accuracy"] > 0.8
    again = HoldoutExperiment(signals.repartition(5), settings, seed=1)
    assert sorted(map(tuple, again.run(3, 8).collect())) == sorted(map(tuple, stats.collect()))

    base = save_experiment(holdout, str(tmp_path), "study")
    assert spark.read.parquet(f"{base}/stats").count() == 3
    assert json.loads(spark.read.text(f"{base}/settings").first()[0])["seed"] == 1

    left = LeaveStratumOutExperiment(signals, settings, seed=1)
    with pytest.raises(RuntimeError):
        save_experiment(left, str(tmp_path))
    assert left.run("segment").count() == 4
    assert left.predictions.count() == 1500


def test_stratum_with_one_class(signals):
    # the target follows the subject's parity, so every segment has one class only
    stats = StratifiedExperiment(signals, study_settings(inputs=FEATURES), seed=1).run("segment", "target")
    for r in stats.collect():
        assert (r["fpr"] is None) != (r["fnr"] is None)
        assert r["roc_auc"] == r["accuracy"] and 0 < r["strata_weight"] < 1


def test_jobs_from_files(spark, signals, tmp_path):
    data = str(tmp_path / "signals.csv")
    signals.write.option("header", True).csv(data)
    paths = []
    for name, content in study_settings(inputs=FEATURES).raw.items():
        paths.append(str(tmp_path / f"{name}.json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(content, f)
    report = run_holdout(spark, data, paths, 2, 6, schema=signals.schema)
    assert set(report.columns) == {"accuracy", "fnr", "fpr", "roc_auc"}
    out = str(tmp_path / "out")
    run_leave_stratum_out(spark, data, paths, "segment", save_path=out, schema=signals.schema)
    with pytest.raises(ValueError, match="schema"):
        run_leave_stratum_out(spark, data, paths, "segment")
    import os

    assert os.listdir(out)[0].startswith("LEAVE_ONE_OUT_20")


def test_settings_are_checked():
    raw = study_settings().raw
    with pytest.raises(ValueError, match="score_cap"):
        StudySettings.of(raw["subject"], raw["sampler"], {k: v for k, v in raw["ensemble"].items() if k != "score_cap"},
                         raw["transformer"])
    with pytest.raises(ValueError, match="valid"):
        StudySettings.of(raw["subject"], raw["sampler"], {**raw["ensemble"], "classifier_list": ["boost"]}, raw["transformer"])
    with pytest.raises(ValueError, match="valid"):
        StudySettings.of(raw["subject"], raw["sampler"], raw["ensemble"],
                         {**raw["transformer"], "Signal_compressor_apply_estimators": ["mode"]})


def test_reading(spark, signals, tmp_path):
    csv, parquet = str(tmp_path / "a.csv"), str(tmp_path / "a.parquet")
    signals.write.option("header", True).csv(csv)
    signals.write.parquet(parquet)
    for df in (read_signals(spark, csv), read_signals(spark, csv, schema=signals.schema), read_signals(spark, parquet)):
        assert df.count() == 1500 and df.columns == signals.columns
    with pytest.raises(ValueError):
        read_signals(spark, parquet, row_id="absent")
    keyed = with_row_id(signals.drop("row_id"), ["subject", "amount", "b"])
    assert keyed.select("row_id").distinct().count() == 1500


def test_result_name():
    from datetime import datetime

    assert result_name("CROSS_VALIDATION", datetime(2024, 1, 2, 3, 4, 5)) == "CROSS_VALIDATION_2024-01-02_03-04-05"


def test_broadcast_only_when_small(spark):
    small, large = pin(spark.range(5)), pin(spark.range(50))
    assert "BroadcastHashJoin" in _plan(large.join(broadcast_if_small(small, 10), "id"))
    assert "Hint" not in large.join(broadcast_if_small(large, 10), "id")._jdf.queryExecution().logical().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_scores_equal_batch_scores(spark, signals, subjects, tmp_path):
    fitted = Ensemble(["Ridge", "tree"], [3, 2], [{}, {"max_depth": 3}]).fit(
        signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, 0.5, seed=1)
    source = str(tmp_path / "in")
    signals.write.parquet(source)
    stream = spark.readStream.schema(signals.schema).parquet(source)
    scored = score_stream(stream, fitted)
    assert scored.isStreaming
    query = scored.select("row_id", "proba").writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    want = fitted.predict(signals).select("row_id", "proba")
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, want.collect()))


def _fit(signals, subjects, kind="Ridge", params=None):
    return Ensemble([kind], [2], [params or {}]).fit(
        signals, "target", subjects, "subject", "row_id", FEATURES, PLAN, 0.0, seed=1)


def test_unknown_settings_raise(signals, subjects):
    for kind, params in (("Ridge", {"nonsense": 3}), ("tree", {"class_weight": "balanced"}), ("knn", {"weights": "distance"}), ("SVM", {"kernel": "rbf"})):
        with pytest.raises(ValueError, match="valid|only"):
            Ensemble([kind], [1], [params])
    with pytest.raises(ValueError, match="valid"):
        MinMaxScaler(["amount"], nonsense=1)
    with pytest.raises(ValueError, match="only"):
        OneHotEncoder(["segment"], handle_unknown="error")


def test_ridge_without_intercept(signals, subjects):
    nodes = _fit(signals, subjects, params={"fit_intercept": False}).nodes.collect()
    assert all(r["intercept"] == 0.0 and any(r["coef"]) for r in nodes)


def test_drawn_number_of_neighbours(signals, subjects):
    fitted = _fit(signals, subjects, "knn", {"n_neighbors": (1, 6)})
    assert {int(r["params"]["n_neighbors"]) for r in fitted.nodes.collect()} <= {1, 2, 3, 4, 5}
    assert fitted.predict(signals).count() == 1500


def test_leaf_sizes_may_be_fractions(signals, subjects):
    trees_ = _fit(signals, subjects, "tree", {"min_samples_leaf": 0.5}).nodes.collect()
    assert all(len(r["tree"][0]) <= 3 for r in trees_)


def test_missing_features(signals, subjects):
    fitted = _fit(signals, subjects)
    holed = signals.withColumn("b", F.when(F.col("row_id") % 2 == 0, F.col("b")))
    shares = {r["row_id"]: r["proba"] for r in fitted.predict_proba(holed).collect()}
    assert all((v is None) == (k % 2 == 1) for k, v in shares.items())
    with pytest.raises(Exception, match="missing values"):
        _fit(holed, subjects)


def test_targets_must_be_binary(spark, signals, subjects):
    third = signals.withColumn("target", F.when(F.col("row_id") == 3, 2).otherwise(F.col("target")))
    with pytest.raises(Exception, match="must be 0 or 1"):
        _fit(third, subjects)
    with pytest.raises(ValueError, match="two values"):
        _fit(signals, subjects.withColumn("target", F.col("subject") % 3))


def test_keys_tell_nulls_and_separators_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("x", None)]
    keyed = with_row_id(spark.createDataFrame(rows, "p string, q string"), ["p", "q"])
    assert keyed.select("row_id").distinct().count() == 5


def test_clipping_and_missing_numbers(spark):
    fit = spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (None,)], "v double")
    model = MinMaxScaler(["v"], clip=True).fit(fit)
    assert [r["v"] for r in model.transform(spark.createDataFrame([(-5.0,), (5.0,), (20.0,)], "v double")).collect()] == [0.0, 0.5, 1.0]

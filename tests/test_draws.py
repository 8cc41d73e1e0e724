from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators import draws
from strataloom.operators.draws import (
    draw_with_replacement,
    draw_without_replacement,
    expand_slots,
    group_sizes,
    index_rows,
    permuted,
    prefix_bits,
    rows_at_positions,
    small_table,
)
from strataloom.operators.folds import holdout_folds, strata_folds
from strataloom.operators.sampling import balanced_sample, check_samplings, generate_batches, resolve_variables
from strataloom.sources.samplings import load_sampling, save_sampling


def signals(spark, n=3000, parts=4):
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("row_id"), (F.col("id") % 50).alias("subject"),
        (F.col("id") % 3 == 0).cast("int").alias("target"), (F.col("id") * 0.5).alias("x"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("resample", [True, False])
def test_draws_do_not_depend_on_layout_or_prefix(spark, resample):
    reference = None
    for parts, bits in ((1, 0), (7, 0), (3, 2), (5, 9), (2, 20)):
        made = generate_batches(signals(spark, parts=parts), 3, 300, "target", "row_id", seed=5, resample=resample, bits=bits)
        got = rows(made.draws)
        reference = reference or got
        assert got == reference
    assert Counter(b for b, _ in reference) == {0: 300, 1: 300, 2: 300}


def test_balanced_batches_have_equal_classes(spark):
    made = generate_batches(signals(spark), 4, 101, "target", "row_id", seed=1)
    classes = made.draws.join(signals(spark), "row_id").groupBy("batch", "target").count()
    assert {(r["batch"], r["target"]): r["count"] for r in classes.collect()} == {
        (b, t): 50 for b in range(4) for t in (0, 1)
    }


def test_without_replacement_is_distinct_and_limited_by_the_minority(spark):
    df = signals(spark, 90)
    made = generate_batches(df, 2, 1000, "target", "row_id", seed=1, resample=False)
    assert made.draws.count() == made.draws.distinct().count() == 2 * 2 * 30
    everything = generate_batches(df, 2, 1000, "target", "row_id", seed=1, resample=False, balanced=False)
    assert everything.draws.distinct().count() == 2 * 90


def test_batches_of_the_same_settings_differ_by_batch_and_seed(spark):
    a = generate_batches(signals(spark), 2, 200, "target", "row_id", seed=1)
    b = generate_batches(signals(spark), 2, 200, "target", "row_id", seed=2)
    per_batch = [set(r[0] for r in a.draws.filter(F.col("batch") == i).select("row_id").collect()) for i in (0, 1)]
    assert per_batch[0] != per_batch[1]
    assert rows(a.draws) != rows(b.draws)


def test_draws_are_close_to_uniform(spark):
    df = signals(spark, 30)
    made = generate_batches(df, 1, 6000, "target", "row_id", seed=3)
    counts = Counter(r["row_id"] for r in made.draws.collect())
    positives = [counts[i] for i in range(0, 30, 3)]
    assert sum(positives) == 3000 and min(positives) > 230 and max(positives) < 370


def test_multiplicity_widens_a_row(spark):
    df = spark.createDataFrame([(0, "g", 1), (1, "g", 3)], "row_id long, g string, w long")
    index = index_rows(df, ["g"], "row_id", "w")
    assert group_sizes(index, ["g"]) == {("g",): 4}
    positions = small_table(spark, [("g", 4, p) for p in range(4)], [("g", "string"), ("n", "bigint"), ("position", "bigint")])
    for bits in (0, 3):
        found = rows_at_positions(positions, index, ["g"], "row_id", bits, 4)
        assert Counter(r["row_id"] for r in found.collect()) == {0: 1, 1: 3}


def test_large_groups_use_prefixes():
    assert prefix_bits(1000) == 0
    assert prefix_bits(10_000_000) == 14
    assert prefix_bits(10**12) == 24


def test_slots_of_many_chunks(spark):
    requests = small_table(spark, [("a", 10_000), ("b", 1)], [("g", "string"), ("k", "bigint")])
    for bound in (1, 10**9):
        got = expand_slots(requests, bound).groupBy("g").agg(F.count("*"), F.min("slot"), F.max("slot"))
        assert rows(got) == [("a", 10_000, 0, 9_999), ("b", 1, 0, 0)]


def test_one_class_holds_almost_all_rows(spark):
    df = signals(spark, 5000).withColumn("target", (F.col("row_id") < 3).cast("int"))
    for bits in (0, 6):
        made = generate_batches(df, 2, 100, "target", "row_id", seed=1, bits=bits)
        found = made.draws.join(df, "row_id").groupBy("batch", "target").count()
        assert {r["count"] for r in found.collect()} == {50}


def test_groups_draw_their_own_number(spark):
    index = index_rows(signals(spark), ["target"], "row_id")
    groups = [(0, 2000, 10), (1, 1000, 400)]
    for draw in (draw_with_replacement, draw_without_replacement):
        found = draw(index, ["target"], groups, "row_id", 1, "t").groupBy("target").count()
        assert rows(found) == [(0, 10), (1, 400)]
    mixed = [(0, 2000, 1900), (1, 1000, 4)]  # one dense and one sparse request
    found = draw_without_replacement(index, ["target"], mixed, "row_id", 1, "t")
    assert found.distinct().count() == 1904


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 1000])
def test_inverse_of_the_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("slot"), F.lit(n).cast("bigint").alias("n"), (F.col("id") * 0).alias("g"))
    there = permuted(df, "slot", "position", F.col("n"), [7, "t", F.col("g")])
    back = permuted(there, "position", "again", F.col("n"), [7, "t", F.col("g")], inverse=True).collect()
    assert sorted(r["position"] for r in back) == list(range(n)) and all(r["slot"] == r["again"] for r in back)


def test_dense_and_whole_draws_are_those_of_the_slots(spark, monkeypatch):
    """Such groups are drawn without a join of draws and rows, in the same order."""
    index = index_rows(signals(spark), ["target"], "row_id")
    made, joined = {}, []
    real = draws.rows_at_positions
    monkeypatch.setattr(draws, "rows_at_positions", lambda *a: joined.append(a) or real(*a))
    for dense, k in ((0, 999), (draws._DENSE, 999), (draws._DENSE, 1000)):
        monkeypatch.setattr(draws, "_DENSE", dense)
        joined.clear()
        for bits in (0, 4):
            found = draw_without_replacement(index, ["target"], [(0, 2000, 700), (1, 1000, k)], "row_id", 1, "t", ("batch", [2, 3]), bits)
            made[dense, k, bits] = rows(found)
        assert len(joined) == (0 if dense else 2)
    slots = made[0, 999, 0]
    assert len(slots) == 2 * 700 + 3 * 999
    assert all([r for r in m if r[2] < 999] == slots and len(m) == 2 * 700 + 3 * k for (_, k, _), m in made.items())


def test_many_draws_are_spread_and_not_broadcast(spark, monkeypatch):
    requests = small_table(spark, [("a", 1_000_000)], [("g", "string"), ("k", "bigint")])
    assert expand_slots(requests, 1_000_000).groupBy(F.spark_partition_id()).count().count() > 5
    index = index_rows(signals(spark), ["target"], "row_id")
    args = index, ["target"], [(0, 2000, 100), (1, 1000, 100)], "row_id", 1, "t", None, 4
    want = rows(draw_with_replacement(*args))
    assert len(want) == 200
    plans, real = [], draws.pin
    monkeypatch.setattr(draws, "DRAWS_BROADCAST", 10)
    monkeypatch.setattr(draws, "pin", lambda df: plans.append(df) or real(df))
    found = draw_with_replacement(*args)
    assert rows(found) == want
    merges = [df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") for df in (plans[1], found)]
    assert merges[0] >= 1 and merges[1] >= 2  # draws with prefixes; prefixes hit and draws with rows


def test_checks(spark):
    df = signals(spark)
    with pytest.raises(ValueError):
        generate_batches(df.filter("target = 1"), 1, 10, "target", "row_id")
    with pytest.raises(ValueError):
        generate_batches(df, 1, 10, "absent", "row_id")
    with pytest.raises(ValueError):
        balanced_sample(df, "subject", "row_id")
    assert resolve_variables(df, "target", ["x", "target"]) == ["x"]
    given = ["x", "target"]
    resolve_variables(df, "target", given)
    assert given == ["x", "target"]


def test_extract_combine_save_load(spark, tmp_path):
    df = signals(spark)
    a = generate_batches(df, 3, 40, "target", "row_id", ["x"], seed=1)
    b = generate_batches(df, 2, 20, "target", "row_id", ["x"], seed=2, balanced=False, resample=False)
    both = a.combine(b)
    assert (both.n_batches, both.balanced, both.resample) == (5, False, True)
    assert both.extract_batch(df, 4).count() == 20
    assert both.extract_batch(df, 0).columns == ["row_id", "x"]
    assert both.extract_batch(df, 0, y=True).columns == ["row_id", "target"]
    with pytest.raises(IndexError):
        both.extract_batch(df, 5)
    with pytest.raises(ValueError):
        a.combine(generate_batches(df, 1, 20, "target", "row_id", ["subject"]))
    check_samplings(a, b)
    for mode in ("json", "parquet"):
        save_sampling(both, str(tmp_path), "s", mode)
        back = load_sampling(spark, str(tmp_path), "s")
        assert rows(back.draws) == rows(both.draws)
        assert (back.n_batches, back.inputs, back.target, back.balanced) == (5, ["x"], "target", False)
    with pytest.raises(ValueError):
        save_sampling(both, str(tmp_path), "s", "pickle")
    with pytest.raises(FileNotFoundError):
        load_sampling(spark, str(tmp_path), "none")


def test_json_is_read_when_there_is_no_parquet(spark, tmp_path):
    a = generate_batches(signals(spark), 2, 40, "target", "row_id", ["x"], seed=1)
    save_sampling(a, str(tmp_path), "only", "json")
    assert rows(load_sampling(spark, str(tmp_path), "only").draws) == rows(a.draws)


def test_balanced_sample_is_balanced(spark):
    df = signals(spark)
    drawn = balanced_sample(df, "target", "row_id", seed=1).join(df, "row_id").groupBy("target").agg(F.sum("n_draws"))
    assert rows(drawn) == [(0, 1000), (1, 1000)]
    small = balanced_sample(df, "target", "row_id", max_len=7, seed=1).agg(F.sum("n_draws")).first()[0]
    assert small == 14


def subjects(spark):
    return spark.range(60).select(
        F.col("id").alias("subject"), (F.col("id") % 4 == 0).cast("int").alias("target"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("site"),
    )


def test_holdout_sides_are_disjoint_and_cover_all(spark):
    folds = holdout_folds(subjects(spark), "subject", "target", 6, 5, seed=2)
    assert folds.select("fold", "subject").distinct().count() == folds.count() == 6 * 60
    val = folds.filter("role = 'val'").join(subjects(spark), "subject")
    assert rows(val.groupBy("fold", "target").agg(F.sum("n_draws"))) == [(f, t, 5) for f in range(6) for t in (0, 1)]
    limited = holdout_folds(subjects(spark), "subject", "target", 1, 500, seed=2)
    assert limited.filter("role = 'val'").agg(F.sum("n_draws")).first()[0] == 30


def test_strata_folds(spark):
    folds = strata_folds(subjects(spark), "subject", "site")
    assert rows(folds.groupBy("fold", "role").count()) == [
        (s, r, n) for s in ("s0", "s1", "s2") for r, n in (("fit", 40), ("val", 20))
    ]
    with pytest.raises(ValueError):
        strata_folds(subjects(spark), "subject", "site", values=["nowhere"])


def test_a_side_with_one_class_is_kept_whole(spark):
    people = subjects(spark).withColumn("target", F.when(F.col("site") == "s0", 1).otherwise(F.col("target")))
    folds = strata_folds(people, "subject", "site", "target", seed=1)
    val = folds.filter("fold = 's0' and role = 'val'")
    assert val.count() == 20 and val.agg(F.sum("n_draws")).first()[0] == 20
    other = folds.filter("fold = 's1' and role = 'val'").join(people, "subject").groupBy("target").agg(F.sum("n_draws"))
    assert rows(other) == [(0, 5), (1, 5)]


def test_null_stratum_always_fits(spark):
    people = subjects(spark).withColumn("site", F.when(F.col("subject") >= 3, F.col("site")))
    folds = strata_folds(people, "subject", "site").filter("subject < 3")
    assert {r["role"] for r in folds.collect()} == {"fit"} and folds.count() == 9

"""Boosted trees on planted classes, and tile classes painted back over pixels."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import boosting, learn, tiles
from skyframe.plans import tool_facts

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def planted(spark):
    """Three classes told apart by pairs of features, with noise features beside them."""
    x = RNG.normal(size=(900, 8))
    label = np.where(x[:, 0] * x[:, 1] > 0.2, "a", np.where(x[:, 2] > 0.3, "b", "c"))
    rows = [(i, str(k), [float(v) for v in f]) for i, (k, f) in enumerate(zip(label, x, strict=True))]
    return spark.createDataFrame(rows, "id int, label string, features array<double>")


def accuracy(df):
    return df.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]


def test_probabilities_and_accuracy(planted):
    split = learn.stratified_split(planted, "label", "id").cache()
    train, test = split.where("NOT is_test"), split.where("is_test")
    model = learn.train(train, algorithm="boosted", trees=12, depth=3)
    out = boosting.predict(model, test)
    for r in out.collect():
        assert sum(r["probabilities"]) == pytest.approx(1.0) and r["confidence"] == max(r["probabilities"])
        assert r["predicted"] == model.classes[int(np.argmax(r["probabilities"]))]
    forest = learn.predict(learn.train(train, trees=12, depth=4), test)
    assert accuracy(out) >= accuracy(forest) and accuracy(out) > 0.85
    assert learn.predict(model, test).columns == [*test.columns, "predicted", "confidence"]


def test_fit_does_not_depend_on_partitions(planted, monkeypatch):
    monkeypatch.setattr(boosting, "ADDED", 2)
    models = [boosting.fit(planted.repartition(n), iterations=2, depth=2) for n in (1, 7)]
    for x, y in zip(*(m.rounds for m in models), strict=True):
        for s, t in zip(x, y, strict=True):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.array_equal(s.value, t.value)


def test_first_split_is_the_best_one(spark):
    """One feature, two classes: the cut lies where the classes part."""
    rows = [(str(int(v > 6)), [float(v), 1.0]) for v in range(20)]
    model = boosting.fit(spark.createDataFrame(rows, "label string, features array<double>"), iterations=1, depth=1)
    tree = model.rounds[0][0]
    assert tree.feature[0] == 0 and model.edges[0][tree.cut[0]] == 6.0


def test_odd_training_rows(spark):
    rows = [("a", [1.0, None]), ("a", [float("nan"), 2.0]), (None, [1.0, 1.0]), ("b", None), ("b", [9.0, float("inf")])]
    df = spark.createDataFrame(rows, "label string, features array<double>")
    model = boosting.fit(df, iterations=1, depth=1)
    assert model.classes == ["a", "b"]
    one = boosting.fit(df.where("label = 'a'"), iterations=3)
    assert boosting.predict(one, df.where("features IS NOT NULL")).select("confidence").distinct().collect() == [(1.0,)]
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0))


def test_facts_of_the_classifier(spark):
    summary = spark.createDataFrame([(1, 12, "Forest", 0.75, 0.8, 0.5, False, True)],
                                    "scene_id int, tiles long, dominant_class string, dominant_fraction double, mean_confidence double, min_confidence double, out_of_domain boolean, narrated boolean")
    facts = {r["fact_key"]: r for r in tool_facts.classification_facts(summary).collect()}
    assert facts["rs_dominant_class"]["value_str"] == "Forest" and facts["rs_dominant_fraction"]["value_num"] == 0.75
    assert facts["rs_tiles"]["value_num"] == 12 and facts["rs_mean_confidence"]["unit"] == "probability"


def by_hand(labels, h, w, tile, rule):
    votes = defaultdict(lambda: defaultdict(float))
    last = {}
    for r, c, name, conf in sorted(labels):
        for y in range(r, min(r + tile, h)):
            for x in range(c, min(c + tile, w)):
                votes[y, x][name] += conf
                last[y, x] = name
    if rule == "last":
        return last
    return {k: min(v, key=lambda n: (-round(v[n], 9), n)) for k, v in votes.items()}


@pytest.mark.parametrize("rule", ["votes", "last"])
@pytest.mark.parametrize(("tile", "stride"), [(8, 4), (6, 4), (5, 5), (7, 3)])
def test_painting_overlapping_tiles(spark, rule, tile, stride):
    h, w = 23, 30
    labels = [(r, c, str(RNG.choice(["water", "bare", "veg"])), float(RNG.choice([0.25, 0.5, 0.75]))) for r in range(0, h - tile + 1, stride) for c in range(0, w - tile + 1, stride)
              if RNG.random() < 0.8]
    t = spark.createDataFrame([("s", *x) for x in labels], "scene_id string, tile_r int, tile_c int, class string, confidence double")
    px = spark.range(h * w).select(F.lit("s").alias("scene_id"), F.expr(f"int(id div {w}) AS r"), F.expr(f"int(id % {w}) AS c"))
    want = by_hand(labels, h, w, tile, rule)
    got = tiles.paint_tiles(t, px, tile, stride, rule).collect()
    assert len(got) == h * w
    assert all(r["class"] == want.get((r["r"], r["c"])) for r in got)


def test_features_of_tiles_with_holes(spark):
    rows = [("a", r, c, 8, 8, None if (r, c) == (0, 0) else 0.5, 0.5, float("nan") if (r, c) == (1, 1) else 0.25) for r in range(8) for c in range(8) if (r, c) != (7, 7)]
    df = spark.createDataFrame(rows, "tile_id string, r int, c int, height int, width int, red double, green double, blue double")
    got = dict(zip(tiles.feature_names(), tiles.patch_features(df).first()["features"], strict=True))
    assert (got["red_mean"], got["green_mean"], got["blue_mean"], got["red_std"]) == (0.5, 0.5, 0.25, 0.0)
    assert got["hist_red_6"] == pytest.approx(62 / 63) and got["grid00_blue"] == 0.25 and got["vari_mean"] == 0.0
    assert all(np.isfinite(v) for v in got.values())


def test_borders_come_from_the_rows_of_lowest_hash(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from skyframe.operators import boosting

    rows = spark.range(300).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    model = boosting.fit(rows, iterations=1, depth=1, edge_rows=40)
    lowest = [r["features"] for r in rows.orderBy(F.xxhash64("features", F.lit(42))).limit(40).collect()]
    assert np.array_equal(model.edges, boosting._edges(np.array(lowest), boosting.BINS))

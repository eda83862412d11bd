"""Model versions, the certificate of fitted weights, and forests as tables."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators.tfidf import numbered
from riskloom.plans import proofs, training
from riskloom.plans.stages import TermScores, TextKey, UrlNormalizer
from riskloom.queries import models
from riskloom.queries.inputs import labelled_pages, padded_pages
from riskloom.sources import sinks, staging
from riskloom.streaming.scoring import ScoredStream

SF = "/root/testdata/sf0.001"


def test_numbers_follow_totals_then_grams(spark):
    rng = random.Random(4)
    rows = [(f"g{i:04}", 1, rng.randint(1, 9), 1.0) for i in range(700)]
    got = numbered(spark.createDataFrame(rows, "gram string, df long, total long, idf double").repartition(7)).collect()
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert [r["gram"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(700))


@pytest.fixture(scope="module")
def fitted(spark):
    pages = training._with_split(labelled_pages(spark, SF), "type", "row_id")
    pages = staging.stage_table(pages, "pages")
    return pages, training.fit_hybrid(pages, training.Experiment("both", ["url_length", "num_dots"]), key="row_id").model


def gaps(model, pages):
    rows = proofs.optimality(model, pages.filter("split = 'train'"), "row_id", "type").collect()
    return {r["class"]: r["gap"] / r["objective"] for r in rows}


def test_certificate_fails_when_a_weight_or_column_is_exchanged(spark, fitted, tmp_path):
    pages, model = fitted
    found = gaps(model, pages)
    assert len(found) == 4 and max(found.values()) < 0.005
    place, scores = next((i, s) for i, s in enumerate(model.stages) if isinstance(s, TermScores))

    def changed(**values):
        copy = scores.copy()
        copy._set(**values)
        return PipelineModel([*model.stages[:place], copy, *model.stages[place + 1:]])

    dense = scores.getOrDefault("dense")
    assert max(gaps(changed(dense=[dense[1], dense[0], *dense[2:]]), pages).values()) > 0.005  # two columns exchanged
    assert max(gaps(changed(dense=[*dense[:2], 0.0, *dense[3:]]), pages).values()) > 0.005  # a class without its constant
    table = spark.read.parquet(scores.getOrDefault("path"))
    other = F.transform("weights", lambda w, i: F.when(i == 1, F.element_at("weights", 1)).otherwise(w))
    table.withColumn("weights", other).write.parquet(str(tmp_path / "w"))
    assert gaps(changed(path=str(tmp_path / "w")), pages)["en"] > 0.005  # another class's weights


def test_certificate_equals_numpy(spark, fitted):
    """The aggregate against dense matrices."""
    pages, model = fitted
    found = {r["class"]: r for r in proofs.optimality(model, pages.filter("split = 'train'"), "row_id", "type").collect()}
    train = pages.filter("split = 'train'")
    scored = train
    for stage in model.stages:
        if isinstance(stage, TermScores):
            break
        scored = stage.transform(scored)
    columns, dense = stage.getOrDefault("columns"), stage.getOrDefault("dense")
    rows = sorted(scored.select("row_id", "type", *columns).collect())
    table = {r["gram"]: (r["idf"], r["weights"]) for r in spark.read.parquet(stage.getOrDefault("path")).collect()}
    from riskloom.operators.tfidf import TfidfModel

    terms = TfidfModel(spark.read.parquet(stage.getOrDefault("path")), 0).transform(UrlNormalizer().transform(train), "row_id", "url").collect()
    grams = {g: i for i, g in enumerate(table)}
    place = {r["row_id"]: i for i, r in enumerate(rows)}
    x = np.zeros((len(rows), len(grams) + 3))
    for t in terms:
        x[place[t["id"]], grams[t["gram"]]] = t["tfidf"]
    x[:, -3:] = [[r[c] for c in columns] + [1.0] for r in rows]
    for k, name in enumerate(["de", "en", "es", "fr"]):
        y = np.array([r["type"] == name for r in rows])
        w = np.where(y, len(rows) / (4 * y.sum()), 1.0)
        v = np.array([table[g][1][k] for g in grams] + list(dense[3 * k:3 * k + 3]))
        score = x @ v
        gradient = x.T @ (4 * w * (1 / (1 + np.exp(-score)) - y)) + v
        objective = 4 * (w * np.logaddexp(0, np.where(y, -score, score))).sum() + v @ v / 2
        assert np.isclose(found[name]["objective"], objective) and np.isclose(found[name]["gradient_norm"], np.linalg.norm(gradient))


def test_importance_and_walk_of_a_given_forest(spark):
    nodes = spark.createDataFrame([
        (0, 0, "a", 1.0, 1, 2, 0.5, 10.0, [0.5, 0.5]), (0, 1, None, None, None, None, None, 4.0, [1.0, 0.0]),
        (0, 2, "b", 0.0, 3, 4, 0.25, 6.0, [0.2, 0.8]), (0, 3, None, None, None, None, None, 3.0, [0.4, 0.6]), (0, 4, None, None, None, None, None, 3.0, [0.0, 1.0]),
        (1, 0, "b", 5.0, 1, 2, 0.1, 10.0, [0.5, 0.5]), (1, 1, None, None, None, None, None, 5.0, [0.7, 0.3]), (1, 2, None, None, None, None, None, 5.0, [0.1, 0.9]),
        (2, 0, None, None, None, None, None, 10.0, [0.5, 0.5]),
    ], "tree int, node int, feature string, threshold double, left_node int, right_node int, gain double, weight double, shares array<double>")
    got = {r["feature"]: r["importance"] for r in proofs.importances(nodes).collect()}
    assert got == pytest.approx({"a": (5 / 6.5) / 2, "b": (1.5 / 6.5 + 1) / 2})
    rows = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.0, 0.0), (3, 2.0, 6.0)], "k int, a double, b double")
    for every in (1, 2, 6):
        shares = {r["k"]: r["shares"] for r in proofs.forest_probabilities(rows, "k", nodes, every).collect()}
        assert shares == {1: pytest.approx([1.6 / 3, 1.4 / 3]), 2: pytest.approx([1.6 / 3, 1.4 / 3]), 3: pytest.approx([0.2, 0.8])}


def test_readers_see_the_old_or_the_new_model(spark, tmp_path):
    root = str(tmp_path)
    one, two = (PipelineModel([TextKey(inputCol="url", outputCol=name)]) for name in ("one", "two"))
    with pytest.raises(FileNotFoundError):
        sinks.load_model(root)
    sinks.save_model(one, root)
    assert sinks.current_version(spark, root) == 1
    sinks.save_model(two, root, "b")
    (tmp_path / "variant=default" / "_versions" / "2").write_text("model-half")  # another writer is in the middle of its pointer
    assert sinks.load_model(root).stages[0].getOutputCol() == "one"
    with pytest.raises(sinks.PromotionConflict):
        sinks.promote(spark, root, "b")
    assert sinks.commit_version(spark, root, "default", "variant=b@" + sinks._committed(spark, root, "b")[1], 1, abandoned=0.0) == 3  # it has died
    assert sinks.load_model(root).stages[0].getOutputCol() == "two" and sinks.load_model(root, version=1).stages[0].getOutputCol() == "one"


def test_two_promoters_one_wins(spark, tmp_path):
    root = str(tmp_path)
    sinks.save_model(PipelineModel([TextKey(inputCol="url", outputCol="one")]), root, "a")
    assert sinks.promote(spark, root, "a", expected=0) == 1
    with pytest.raises(sinks.PromotionConflict):
        sinks.promote(spark, root, "a", expected=0)
    with pytest.raises(sinks.PromotionConflict):
        sinks.save_model(PipelineModel([TextKey()]), root, expected=0)
    assert sinks.load_model(root).stages[0].getOutputCol() == "one"


def test_staged_tables_go_with_their_scope(spark):
    with staging.staged(spark):
        outer = staging.stage_table(spark.range(3), "t")
        with staging.staged(spark):
            inner = staging.stage_table(spark.range(4), "t").inputFiles()[0]
        assert outer.count() == 3
        with pytest.raises(Exception):
            spark.read.parquet(inner).count()
        path = outer.inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_stream_is_scored_by_the_loaded_model(spark, fitted, monkeypatch):
    """The registered stream query saves, loads and scores with what it loaded: it gives what the batch gives."""
    pages, model = fitted
    loaded, seen = [], []
    load, stream = models.load_model, models.score_stream
    monkeypatch.setattr(models, "_hybrid", lambda spark, sf: type("Result", (), {"model": model}))
    monkeypatch.setattr(models, "load_model", lambda *a: loaded.append(load(*a)) or loaded[-1])
    monkeypatch.setattr(models, "score_stream", lambda m, s: seen.append(stream(m, s)) or seen[-1])
    got = {r["page_id"]: r["prediction"] for r in models.stream_scores(spark, SF).collect()}
    assert isinstance(seen[0], ScoredStream) and seen[0].model is loaded[0] is not model
    assert got == {r["row_id"]: r["prediction"] for r in models.score(model, pages).collect()}


def test_padded_pages_need_learning(spark):
    types = {r["type"]: r["count"] for r in padded_pages(spark, "/root/testdata/sf0.01").groupBy("type").count().collect()}
    assert set(types) == {"long", "short"} and min(types.values()) > 50

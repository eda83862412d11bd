from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators.scaling import class_weights, fit_standardizer, with_class_weights

ROWS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")] * 2 + [("b", "d")]


def test_report(spark):
    pairs = metrics.pair_counts(spark.createDataFrame(ROWS, "actual string, predicted string"))
    report = {r["label"]: r for r in metrics.classification_report(pairs).collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (0.625, 0.7143, 7)
    assert (report["c"]["precision"], report["c"]["f1"], report["d"]["support"]) == (0.0, 0.0, 0)
    assert report["accuracy"]["f1"] == round(8 / 14, 4)
    assert report["macro avg"]["f1"] == round((2 * 5 / 15 + 2 * 3 / 10) / 4, 4)
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(pairs).collect()}
    assert len(matrix) == 9 and matrix["a", "b"] == 2 and matrix["c", "c"] == 0
    wide = {r["actual"]: r.asDict() for r in metrics.confusion_table(pairs).collect()}
    assert wide["a"] == {"actual": "a", "a": 5, "b": 2, "c": 0}


def test_weighted_f1_agrees_with_spark(spark):
    df = spark.createDataFrame(ROWS, "actual string, predicted string")
    row = metrics.summary_metrics(metrics.pair_counts(df)).first()
    code = {c: float(i) for i, c in enumerate("abcd")}
    numbers = spark.createDataFrame([(code[a], code[p]) for a, p in ROWS], "label double, prediction double")
    for ours, theirs in (("weighted_f1", "f1"), ("accuracy", "accuracy")):
        assert abs(row[ours] - MulticlassClassificationEvaluator(metricName=theirs).evaluate(numbers)) < 1e-12


def test_weights_and_scaling(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 5), ("b", 8, 5)], "type string, x int, k int")
    assert {r["type"]: r["weight"] for r in class_weights(df).collect()} == {"a": 0.75, "b": 1.5}
    assert with_class_weights(df).agg(F.sum("weight")).first()[0] == 3.0
    scaled = fit_standardizer(df, ["x", "k"]).transform(df).select("x", "k").collect()
    assert abs(sum(r["x"] for r in scaled)) < 1e-12 and abs(sum(r["x"] ** 2 for r in scaled) - 3) < 1e-12
    assert {r["k"] for r in scaled} == {0.0}


def test_best_experiment(spark):
    df = spark.createDataFrame(
        [(0, "tfidf_only", 0.9), (1, "x", 0.8), (2, "y", 0.8)], "position int, experiment string, macro_f1 double"
    )
    assert metrics.best_experiment(df).first()["experiment"] == "tfidf_only"
    assert metrics.best_experiment(df, ["tfidf_only"]).first()["experiment"] == "x"
    assert metrics.best_experiment(df, ["tfidf_only", "x", "y"]).first() is None

import random

import numpy as np
import pytest

from riskloom.plans import solver, training
from riskloom.plans.scoring import score
from riskloom.plans.training import Experiment, run_ablation
from riskloom.queries.inputs import labelled_pages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("classes, tasks", [(3, 3), (2, 1)])
def test_spread_fit_is_near_the_optimum(spark, monkeypatch, classes, tasks):
    """Weights in several blocks of positions, rows in several tasks; rows of class -1 are scored and not learned from."""
    monkeypatch.setattr(solver, "POSITIONS", 70)
    rng, width, rows = random.Random(3), 200, []
    for i in range(240):
        label = i % classes
        held = sorted({rng.randrange(150) for _ in range(8)} | {150 + label * 10 + rng.randrange(14)})
        values = [rng.uniform(0.1, 0.4) for _ in held] + [rng.gauss(0, 3), 1.0]
        rows.append((i, label if i % 5 else -1, held + [width - 2, width - 1], values))
    df = spark.createDataFrame(rows, "row bigint, class int, indices array<int>, values array<double>").repartition(tasks)
    positives = [1] if classes == 2 else list(range(classes))
    own, rest = [4.0 * (k + 1) for k in positives], [4.0 for _ in positives]
    fit = solver.fit_spread(df, width, tasks, positives, own, rest, 1000, 1e-4)

    x = np.zeros((len(rows), width))
    for i, _, indices, values in rows:
        x[i, indices] = values
    label = np.array([r[1] for r in rows])
    found = fit.weights.orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(width))
    w = np.array([r["weights"] for r in found])
    for k, name in enumerate(positives):
        seen = label >= 0
        y, m = (label == name)[seen].astype(float), (x @ w[:, k])[seen]
        weight = np.where(y > 0, own[k], rest[k])
        gradient = x[seen].T @ (weight * (1 / (1 + np.exp(-m)) - y)) + w[:, k]
        objective = (weight * (np.logaddexp(0, m) - y * m)).sum() + w[:, k] @ w[:, k] / 2
        assert gradient @ gradient / 2 <= 1.001e-4 * objective
        assert np.isclose(objective, fit.objectives[k]) and w[-1, k] != 0
    scores = {r["row"]: r["scores"] for r in fit.scores.collect()}
    assert sorted(scores) == [i for i in range(len(rows)) if label[i] < 0]
    assert all(np.allclose(s, x[i] @ w) for i, s in scores.items())
    assert 0 < fit.steps < 200


def test_wide_ablations_send_the_driver_no_gradient(spark, monkeypatch, tmp_path):
    pages, experiment = labelled_pages(spark, SF), Experiment("both", ["url_length", "num_subdomains"])
    usual = run_ablation(pages, [experiment], key="row_id")["both"]

    class Refused:
        def __init__(self, **options):
            raise AssertionError("Spark's solver sends the driver a gradient per pass")

    monkeypatch.setattr(training, "LogisticRegression", Refused)
    monkeypatch.setattr(training, "SPREAD_BYTES", 0)
    spread = run_ablation(pages, [experiment], key="row_id", save_to=str(tmp_path))["both"]
    assert spread.predictions.columns == usual.predictions.columns
    want = {r["row_id"]: r["probabilities"] for r in usual.predictions.collect()}
    got = {r["row_id"]: (r["prediction"], r["probabilities"]) for r in spread.predictions.collect()}
    assert got.keys() == want.keys()
    assert all(abs(p - want[k][c]) < 0.1 for k, (_, shares) in got.items() for c, p in shares.items())
    # the saved model, which joins grams with the table of weights, scores the test rows alike
    again = {r["row_id"]: (r["prediction"], r["probabilities"]) for r in score(spread.model, pages).collect()}
    assert all(again[k][0] == p and all(abs(again[k][1][c] - shares[c]) < 1e-9 for c in shares) for k, (p, shares) in got.items())

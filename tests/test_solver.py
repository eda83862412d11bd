import random

import numpy as np
from pyspark.ml.linalg import Vectors

from riskloom.plans.training import fit_logistic


def test_rare_and_frequent_columns_need_few_passes(spark):
    """Each pass sends the driver a gradient; columns of very different deviation took many of them."""
    rng = random.Random(7)
    rows, width = [], 800
    for i in range(600):
        label = "ab"[i % 2]
        # columns are taken by Zipf's law; some are more frequent in one class
        held = {min(int(rng.paretovariate(0.6)), width - 2) for _ in range(25)} | {rng.randrange(40) * 2 + (label == "b") * (rng.random() < 0.7)}
        v = np.array([rng.uniform(1, 3) for _ in held])
        pairs = dict(zip(held, v / np.linalg.norm(v))) | {width - 1: 1.0}
        rows.append((label, Vectors.sparse(width, pairs)))
    model, = fit_logistic(spark.createDataFrame(rows, ["type", "x"]).repartition(3), "type", "x")
    x = np.array([r[1].toArray() for r in rows])
    y = np.array([r[0] == "b" for r in rows], float)
    w = model.coefficients.toArray()
    assert w[-1] != 0  # the constant column has a weight
    p = 1 / (1 + np.exp(-x @ w))
    gradient = 4.0 * x.T @ (p - y) + w
    loss = -np.log(np.where(y > 0, p, 1 - p)).sum()
    assert gradient @ gradient / 2 < 0.005 * (4.0 * loss + w @ w / 2)  # strongly convex: bounds the distance to the optimum
    assert model.summary.totalIterations <= 45  # 31, and 78 before

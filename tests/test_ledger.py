"""Ablations that are stopped and resumed."""

import pytest

from riskloom.plans import training
from riskloom.plans.ledger import resume_ablation, table_digest
from riskloom.plans.scoring import score
from riskloom.plans.training import Experiment
from riskloom.queries.inputs import padded_pages, rules

SF = "/root/testdata/sf0.001"
EXPERIMENTS = [Experiment("tfidf_only"), Experiment("length", ["url_length"]), Experiment("domain", ["url_length"], ["domain_entropy"])]


def test_digest_ignores_order_and_sees_every_cell(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, s string")
    same = df.orderBy("k", ascending=False).repartition(3).select("s", "k")
    assert table_digest(df) == table_digest(same)
    others = [[(1, "a"), (2, None)], [(1, "a"), (2, ""), (2, None)], [(1, None), (2, "a"), (2, None)], []]
    assert len({str(table_digest(spark.createDataFrame(rows, df.schema))) for rows in others} | {str(table_digest(df))}) == 5


def test_a_stopped_ablation_fits_only_what_is_left(spark, tmp_path, monkeypatch):
    pages, root = padded_pages(spark, SF), str(tmp_path / "stopped")
    fit, calls = training.fit_logistic, []

    def counted(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return fit(*args, **options)

    monkeypatch.setattr(training, "fit_logistic", counted)
    run = dict(key="row_id", rules=rules(spark), max_features=None)
    with pytest.raises(RuntimeError, match="driver lost"):
        resume_ablation(pages, EXPERIMENTS, root, **run)
    ledger = resume_ablation(pages.repartition(5), EXPERIMENTS, root, **run)
    assert len(calls) == 4  # one entered, one lost, two left
    resume_ablation(pages, EXPERIMENTS, root, **run)
    assert len(calls) == 4
    got = ledger.table(EXPERIMENTS).drop("training_time").orderBy("position").collect()
    whole = resume_ablation(pages, EXPERIMENTS, str(tmp_path / "whole"), **run)
    want = whole.table(EXPERIMENTS).drop("training_time").orderBy("position").collect()
    assert [r["experiment"] for r in got] == [e.name for e in EXPERIMENTS]
    assert [[round(v, 6) if isinstance(v, float) else v for v in r] for r in got] == [[round(v, 6) if isinstance(v, float) else v for v in r] for r in want]
    # the entered models score, and other data is another entry
    assert score(ledger.model(EXPERIMENTS[2]), pages).filter("prediction IS NULL").count() == 0
    other = resume_ablation(pages.filter("row_id > 0"), EXPERIMENTS[:1], root, **run)
    assert len(calls) == 8 and other.path(EXPERIMENTS[0]) != ledger.path(EXPERIMENTS[0])

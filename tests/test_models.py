import math

import pytest

from riskloom.operators.tfidf import fit_tfidf
from riskloom.plans.scoring import ranked_probabilities, score
from riskloom.plans.training import (
    Experiment, TEXT_WORK, ablation_table, fit_lexical, promote_best, run_ablation, text_stages,
)
from riskloom.queries.inputs import labelled_pages, rules
from riskloom.sources.sinks import load_model, save_model
from riskloom.streaming.scoring import read_url_stream, score_stream, write_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return labelled_pages(spark, SF)


@pytest.fixture(scope="module")
def fitted(spark, pages, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    experiments = [Experiment("tfidf_only"), Experiment("both", ["url_length", "num_subdomains"], ["num_subdomains", "domain_entropy"])]
    return root, run_ablation(pages, experiments, key="row_id", rules=rules(spark), save_to=root)


def test_vectors_equal_the_table_form(spark, pages):
    tfidf = fit_tfidf(pages, "row_id", "url")
    table = {}
    for r in tfidf.transform(pages, "row_id", "url").collect():
        table.setdefault(r["row_id"] if "row_id" in r else r["id"], {})[r["gram"]] = r["tfidf"]
    stages = text_stages(tfidf)
    names = stages[1].vocabulary
    df = pages
    for stage in stages:
        df = stage.transform(df)
    for r in df.select("row_id", TEXT_WORK[-1]).collect():
        vector = r[TEXT_WORK[-1]]
        got = {names[i]: v for i, v in zip(vector.indices, vector.values)}
        want = table.get(r["row_id"], {})
        assert got.keys() == want.keys()
        assert all(math.isclose(got[g], want[g], abs_tol=1e-12) for g in want)


def test_saved_model_scores_alike_and_the_stream_does_too(spark, pages, fitted, tmp_path):
    root, results = fitted
    want = {r["row_id"]: r for r in score(results["both"].model, pages).collect()}
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in want.values())
    assert all(r["probabilities"][r["prediction"]] == max(r["probabilities"].values()) for r in want.values())
    loaded = load_model(root, "both")
    assert {r["row_id"]: r for r in score(loaded, pages).collect()} == want
    schema = spark.read.parquet(f"{SF}/pages.parquet").schema
    stream = read_url_stream(spark, f"{SF}/page[s].parquet", schema).select("page_id", "url")
    out = str(tmp_path / "out")
    write_stream(score_stream(loaded, stream), out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = {r["page_id"]: (r["prediction"], r["probabilities"]) for r in spark.read.parquet(out).collect()}
    assert got == {k: (r["prediction"], r["probabilities"]) for k, r in want.items()}


def test_ablation_table_and_promotion(spark, pages, fitted):
    root, results = fitted
    table = ablation_table(spark, results)
    assert [r["experiment"] for r in table.orderBy("position").collect()] == ["tfidf_only", "both"]
    assert promote_best(table, root) == "both"
    blank = spark.createDataFrame([("  ",), (None,), ("x.example.com/en/1",)], "url string")
    rows = score(load_model(root), blank).collect()
    assert len(rows) == 1 and rows[0]["url"] == "http://x.example.com/en/1"


def test_ranked_probabilities(spark, pages, fitted):
    rows = ranked_probabilities(score(fitted[1]["both"].model, pages), keep=("row_id",)).collect()
    by_row = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by_row.setdefault(r["row_id"], []).append(r["probability"])
    assert all(p == sorted(p, reverse=True) and len(p) == 4 for p in by_row.values())


def test_forest(spark, pages, tmp_path):
    result = fit_lexical(pages, key="row_id", trees=5, max_depth=6)
    assert abs(sum(r["importance"] for r in result.importance.collect()) - 1) < 0.2
    save_model(result.model, str(tmp_path))
    want = sorted(score(result.model, pages).select("row_id", "prediction").collect())
    assert sorted(score(load_model(str(tmp_path)), pages).select("row_id", "prediction").collect()) == want

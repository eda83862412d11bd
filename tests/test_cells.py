import pickle

import numpy as np
import pytest

from riskloom.operators.tfidf import fit_tfidf, term_arrays, term_places
from riskloom.plans import solver, training
from riskloom.plans.training import Experiment, run_ablation
from riskloom.queries.inputs import labelled_pages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [None, 0])
def test_cells_hold_the_vectors(spark, monkeypatch, limit):
    """Repeated and missing ids, missing and empty texts, terms that occur often; with a vocabulary that is broadcast, and one that is not."""
    if limit is not None:
        monkeypatch.setattr("riskloom.operators.tfidf.BROADCAST_BYTES", limit)
    monkeypatch.setattr(solver, "PIECE", 16)
    words = "aaaa abab " * 200, "red green blue", "green blue", "blue red", "", None, "red blue green red", "abab blue"
    ids = 1, 2, 3, 3, 4, 5, None, 7
    words += tuple(None if n % 3 else f"green blue {n}" for n in range(24))
    ids += tuple(range(20, 44))
    rows = [(i, t, 10 + n, n % 3 - 1, [float(n), None]) for n, (i, t) in enumerate(zip(ids, words))]
    df = spark.createDataFrame(rows, "id bigint, text string, row bigint, class int, numbers array<double>")
    vocabulary = training.NumberedVocabulary.of(fit_tfidf(df, "id", "text")).table
    want = {r["id"]: dict(zip(r["indices"], r["values"])) for r in term_arrays(df, "id", "text", vocabulary).collect()}
    assert len(want) >= 4
    idf = {r["position"]: r["idf"] for r in vocabulary.collect()}
    cells = term_places(df, vocabulary, size=1 if limit == 0 else None).mapInArrow(solver.pack, "cell binary, entries bigint").collect()
    got, entries = {}, 0
    for r in cells:
        cell = pickle.loads(r["cell"])
        found = [{} for _ in cell[4]]
        for positions, counts, texts, values in solver._opened(cell):
            for p, t, v in zip(np.repeat(positions, counts), texts, values):
                found[t][int(p)] = v * idf[p] / cell[4][t]
        entries += r["entries"]
        for row, kind, of, numbers in zip(*cell[:4]):
            got[int(row)] = found[of], int(kind), numbers
    assert sorted(got) == [r[2] for r in rows] and entries > 0
    for i, _, row, kind, numbers in rows:
        vector, own, found = got[row]
        expected = want.get(i, {}) if i is not None else {}
        assert own == kind and found[0] == numbers[0] and np.isnan(found[1])
        assert vector.keys() == expected.keys() and all(np.isclose(vector[p], v) for p, v in expected.items())


def test_wide_ablations_write_no_vectors(spark, monkeypatch):
    """Terms are packed once for all experiments; vectors written per experiment took most of the time and disk."""
    def refused(*args, **options):
        raise AssertionError("vectors are written")

    pages, experiments = labelled_pages(spark, SF), [Experiment("text"), Experiment("both", ["url_length", "num_digits"])]
    usual = run_ablation(pages, experiments, key="row_id")
    monkeypatch.setattr(training, "SPREAD_BYTES", 0)
    monkeypatch.setattr(training, "SPREAD_ENTRIES", 5000)  # several tasks
    for name in ("stage_vectors", "term_arrays"):
        monkeypatch.setattr(training, name, refused)
    results = run_ablation(pages, experiments, key="row_id")
    for name, result in results.items():
        want = {r["row_id"]: r["probabilities"] for r in usual[name].predictions.collect()}
        got = {r["row_id"]: r["probabilities"] for r in result.predictions.collect()}
        assert got.keys() == want.keys()
        assert all(abs(p - want[k][c]) < 0.1 for k, shares in got.items() for c, p in shares.items())
        assert result.predictions.columns == usual[name].predictions.columns

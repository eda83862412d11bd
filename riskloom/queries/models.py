"""Registered queries that train, compare and apply models.

Solvers are iterative, so SQL has no twin for the fitted numbers. The class of a page is written in its URL, so a right
classifier of texts predicts every row: the queries named `*_checked` use that, and what holds for any model. The tables label no URL: the class of
a page is the language section of its path (synthetic); documents have a given language.
"""

from pyspark.sql import functions as F

from ..operators.sampling import stratified_sample
from ..plans.scoring import ranked_probabilities, score
from ..plans.ledger import resume_ablation
from ..plans.proofs import forest_nodes, forest_path, forest_probabilities, importances, optimality
from ..plans.training import (
    DOMAIN_EXPERIMENTS, LEXICAL_EXPERIMENTS, _with_split, ablation_table, evaluate, fit_hybrid, fit_lexical, fit_text,
    promote_best, run_ablation,
)
from ..functions.constants import LEXICAL_FEATURES
from ..functions.lexical import with_lexical_features
from ..operators.metrics import summary_metrics
from ..sources.sinks import current_version, load_model, save_model
from ..sources.staging import new_path, stage_table
from ..streaming.scoring import read_url_stream, score_stream, write_stream
from .inputs import GIVEN_FOREST, labelled_pages, padded_pages, rules, table

#: Text alone, text with lengths, text with suspicious words.
LEARNED_EXPERIMENTS = [LEXICAL_EXPERIMENTS[i] for i in (0, 1, 3)]


def _forest(spark, sf):
    return fit_lexical(labelled_pages(spark, sf), key="row_id")


def _hybrid(spark, sf):
    experiment = LEXICAL_EXPERIMENTS[-1]
    return fit_hybrid(labelled_pages(spark, sf), experiment, key="row_id")


def _metrics(df):
    return df.select(*[F.round(c, 4).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


def forest_metrics(spark, sf):
    return _metrics(_forest(spark, sf).metrics)


def forest_importance(spark, sf):
    return _forest(spark, sf).importance


def forest_scores(spark, sf):
    """All pages scored by a forest that was saved and loaded again."""
    root = new_path(spark, "models")
    save_model(_forest(spark, sf).model, root)
    scored = score(load_model(root), labelled_pages(spark, sf))
    return scored.select("row_id", "url", "type", "prediction", "probabilities")


def forest_reevaluation(spark, sf):
    """A saved forest tested on a stratified sample of the rows it was not fitted on."""
    fitted = _forest(spark, sf)
    test = fitted.predictions.select("row_id", "url", "type", "split")
    sample = stratified_sample(test, 30, key="row_id")
    return _metrics(summary_metrics(evaluate(fitted.model, sample)[1]))


def text_metrics(spark, sf):
    """Language of the documents by character TF-IDF: the classification report."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("type"))
    return fit_text(docs, text="text", key="doc_id", max_features=None, normalize=False).report


def text_binary_metrics(spark, sf):
    """Two classes: the given `quality` label of documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("type"))
    return fit_text(docs.join(labels, "doc_id"), text="text", key="doc_id", max_features=None, normalize=False).report


def text_scores(spark, sf):
    """All pages scored by the TF-IDF model."""
    model = fit_text(labelled_pages(spark, sf), key="row_id", max_features=None).model
    return score(model, labelled_pages(spark, sf)).select("row_id", "url", "type", "prediction", "probabilities")


def hybrid_scores(spark, sf):
    scored = score(_hybrid(spark, sf).model, labelled_pages(spark, sf))
    return scored.select("row_id", "url", "type", "prediction", "probabilities")


def hybrid_ranked_probabilities(spark, sf):
    return ranked_probabilities(hybrid_scores(spark, sf), keep=("row_id",))


def ablation_lexical(spark, sf):
    """Six feature sets on one split and one TF-IDF fit; the best hybrid is promoted."""
    root = new_path(spark, "models")
    results = run_ablation(labelled_pages(spark, sf), LEXICAL_EXPERIMENTS, key="row_id", save_to=root)
    summary = ablation_table(spark, results)
    promoted = promote_best(summary, root)
    return summary.withColumn("promoted", F.col("experiment") == promoted)


def ablation_domain(spark, sf):
    results = run_ablation(labelled_pages(spark, sf), DOMAIN_EXPERIMENTS, key="row_id", rules=rules(spark))
    return ablation_table(spark, results)


def stream_scores(spark, sf):
    """Pages scored as a stream by the hybrid model after saving and loading."""
    root = new_path(spark, "models")
    save_model(_hybrid(spark, sf).model, root, "hybrid")
    model = load_model(root, "hybrid")
    schema = table(spark, sf, "pages").schema
    stream = read_url_stream(spark, f"{sf}/page[s].parquet", schema).select("page_id", "url")
    out = new_path(spark, "stream")
    write_stream(score_stream(model, stream), out, new_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def text_predictions_checked(spark, sf):
    """Every page scored by the TF-IDF model after saving and loading."""
    root = new_path(spark, "models")
    save_model(fit_text(labelled_pages(spark, sf), key="row_id", max_features=None).model, root, "tfidf")
    return score(load_model(root, "tfidf"), labelled_pages(spark, sf)).select("row_id", "prediction")


def stream_predictions_checked(spark, sf):
    """Every page scored as a stream by a saved and loaded hybrid model."""
    return stream_scores(spark, sf).select("page_id", "prediction")


def ablation_checked(spark, sf):
    """Rows of the test part by experiment and class, and how many of them were predicted right."""
    root = new_path(spark, "models")
    results = run_ablation(labelled_pages(spark, sf), DOMAIN_EXPERIMENTS, key="row_id", rules=rules(spark), save_to=root)
    rows = None
    for name, result in results.items():
        right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
        row = result.confusion.groupBy("actual").agg(F.sum("n").alias("n_test"), F.sum(right).alias("n_right"))
        row = row.withColumn("experiment", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumnRenamed("actual", "type")


def ablation_resumed_checked(spark, sf):
    """An ablation run for its first experiment, then resumed with two: test rows by experiment and class, how many were predicted right, and
    whether the model entered first is still the current one."""
    root, run = new_path(spark, "models"), dict(key="row_id", rules=rules(spark))
    chosen = [DOMAIN_EXPERIMENTS[0], DOMAIN_EXPERIMENTS[2]]
    resume_ablation(labelled_pages(spark, sf), chosen[:1], root, **run)
    entered = {chosen[0].name: current_version(spark, root, chosen[0].name)}
    ledger = resume_ablation(labelled_pages(spark, sf), chosen, root, **run)
    rows = None
    for e in chosen:
        right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
        row = ledger.pairs(e).groupBy(F.col("actual").alias("type"), F.lit(e.name).alias("experiment")).agg(
            F.sum("n").alias("n_test"), F.sum(right).alias("n_right"), F.max("version").alias("version"))
        first = entered.get(e.name, current_version(spark, root, e.name))
        row = row.select("type", "experiment", "n_test", "n_right", (F.col("version") == first).alias("kept"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def forest_checked(spark, sf):
    """Every page: ranked classes, their probabilities' sum, and whether the prediction is ranked first."""
    ranked = ranked_probabilities(forest_scores(spark, sf), keep=("row_id", "type", "prediction"))
    first = F.max(F.when(F.col("rank") == 1, F.col("class")))
    return ranked.groupBy("row_id", "type").agg(
        F.count("*").alias("n_classes"), F.max("rank").alias("last_rank"), F.round(F.sum("probability"), 6).alias("total"),
        (first == F.first("prediction")).alias("agrees"))


def certificate_checked(spark, sf):
    """Per class of the hybrid model: is its objective, by the gradient at the saved weights, within 0.5 % of the least one?"""
    pages = _with_split(labelled_pages(spark, sf), "type", "row_id")
    model = fit_hybrid(pages, LEXICAL_EXPERIMENTS[-1], key="row_id").model
    found = optimality(model, pages.filter("split = 'train'"), "row_id", "type")
    return found.select("class", (F.col("gap") <= 0.005 * F.col("objective")).alias("optimal"))


#: Trees of the forests that are compared with their node tables.
TABLE_TREES = 40


def _saved_forest(spark, sf):
    """(fitted result, folder of its saved forest)."""
    result = fit_lexical(padded_pages(spark, sf), key="row_id", trees=TABLE_TREES)
    return result, forest_path(result.model, save_model(result.model, new_path(spark, "models")))


def forest_importance_checked(spark, sf):
    """Per lexical feature: its rank among those that the node table of a saved forest uses first, and whether its importance by that table is the model's."""
    result, path = _saved_forest(spark, sf)
    forest = next(s for s in result.model.stages if hasattr(s, "featureImportances"))
    own = spark.createDataFrame(list(zip(LEXICAL_FEATURES, map(float, forest.featureImportances.toArray()))), "feature string, own double")
    both = own.join(importances(forest_nodes(spark, path, LEXICAL_FEATURES)), "feature", "left")
    value = F.coalesce("importance", F.lit(0.0))
    top = both.agg(F.max_by("feature", "importance").alias("top"))
    return both.join(F.broadcast(top)).select("feature", (F.abs(value - F.col("own")) < 1e-9).alias("agrees"), (F.col("feature") == F.col("top")).alias("most"))


def forest_walk_checked(spark, sf):
    """Per page: do the class shares of a walk down the node table of a saved forest equal the loaded model's probabilities?"""
    result, path = _saved_forest(spark, sf)
    pages = padded_pages(spark, sf)
    nodes = forest_nodes(spark, path, LEXICAL_FEATURES)
    walked = forest_probabilities(with_lexical_features(pages, "url", list(LEXICAL_FEATURES)), "row_id", nodes)
    model = score(load_model(path.split("/variant=")[0]), pages).select("row_id", F.map_values("probabilities").alias("own"))
    apart = F.aggregate(F.zip_with("shares", "own", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return pages.select("row_id").join(walked, "row_id", "left").join(model, "row_id", "left").select("row_id", F.coalesce(apart < 1e-9, F.lit(False)).alias("agrees"))


def forest_given_checked(spark, sf):
    """Every page's class shares by a walk down a forest whose splits are given."""
    features = with_lexical_features(table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url"), "url", list(LEXICAL_FEATURES))
    nodes = spark.createDataFrame(GIVEN_FOREST, "tree int, node int, feature string, threshold double, left_node int, right_node int, shares array<double>")
    walked = forest_probabilities(features, "row_id", nodes)
    return walked.select("row_id", *[F.round(F.col("shares")[k], 6).alias(f"share_{k}") for k in range(2)])


def learned_checked(spark, sf):
    """Feature sets on a class that must be learned from the URL's length: which of them reach 90 % of the test rows, beside how many rows are `long`."""
    pages = stage_table(padded_pages(spark, sf), "padded")
    n_long = pages.filter("type = 'long'").count()
    results = run_ablation(pages, LEARNED_EXPERIMENTS, key="row_id")
    results["forest"] = fit_lexical(pages, key="row_id", trees=TABLE_TREES)
    return ablation_table(spark, results).select("experiment", F.lit(n_long).alias("n_long"), (F.col("accuracy") >= 0.9).alias("learned"))


QUERIES = {f.__name__: f for f in (
    forest_metrics, forest_importance, forest_scores, forest_reevaluation, text_metrics, text_binary_metrics,
    text_scores, hybrid_scores, hybrid_ranked_probabilities, ablation_lexical, ablation_domain, stream_scores,
    text_predictions_checked, stream_predictions_checked, ablation_checked, ablation_resumed_checked, forest_checked, certificate_checked,
    forest_importance_checked, forest_walk_checked, forest_given_checked, learned_checked,
)}

"""What can be checked about fitted models without fitting them again: optimality of a linear model, and a forest as a table."""

from pyspark.ml import PipelineModel
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.sql import DataFrame, functions as F

from ..functions.constants import LOGISTIC_C
from ..operators.joins import lookup_join
from ..operators.scaling import class_weights
from ..operators.tfidf import TfidfModel
from ..sources.staging import stage_table
from .stages import LabelScores, TermScores, TextKey


def optimality(model: PipelineModel, rows: DataFrame, key: str, label: str, c: float = LOGISTIC_C) -> DataFrame:
    """(class, objective, gradient_norm, gap): how far the saved weights of each class are from the best ones.

    `rows` are the training rows and `model` a fitted text or hybrid pipeline. The objective of a class is c * sum(weight * loss) + |v|^2 / 2. It is strongly convex with constant 1, so
    the objective lies within gap = |gradient|^2 / 2 of its minimum and the weights within |gradient| of the best ones. The gradient is
    aggregated over the long-form terms joined with the saved table of weights: features, weights, labels and class weights all enter.
    """
    spark = rows.sparkSession
    scores = next(s for s in model.stages if isinstance(s, TermScores))
    labels = next(s for s in model.stages if isinstance(s, LabelScores)).getOrDefault("labels")
    columns, dense, classes = (scores.getOrDefault(p) for p in ("columns", "dense", "classes"))
    text, width = scores.getInputCol(), len(columns) + 1
    prepared = rows
    for stage in model.stages[:model.stages.index(scores)]:
        if not isinstance(stage, TextKey):
            prepared = stage.transform(prepared)
    prepared = stage_table(prepared.select(F.col(key).alias("id"), text, F.col(label).alias("label"),
                                           F.array(*[F.col(x).cast("double") for x in columns], F.lit(1.0)).alias("x")), "rows")
    table = spark.read.parquet(scores.getOrDefault("path"))
    terms = TfidfModel(table, 0, scores.getOrDefault("nMin"), scores.getOrDefault("nMax")).transform(prepared, "id", text)
    terms = stage_table(lookup_join(terms.select("id", "gram", "tfidf"), table.select("gram", "df", "weights"), "gram", weight="df"), "terms")
    sums = terms.groupBy("id").agg(*[F.sum(F.col("tfidf") * F.col("weights")[k]).alias(f"s{k}") for k in range(classes)])

    stats = {r[label]: r["weight"] for r in class_weights(rows, label).collect()}
    positives = labels[1:] if len(labels) == 2 else labels
    parts = prepared.join(sums, "id", "left")
    for k, name in enumerate(positives):
        is_it = F.col("label") == name
        weight = F.when(is_it, stats[name]).otherwise(stats[labels[0]] if len(labels) == 2 else 1.0)
        own = F.array(*[F.lit(w) for w in dense[k * width:(k + 1) * width]])
        score = F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.aggregate(F.zip_with("x", own, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        margin = F.when(is_it, score).otherwise(-score)
        parts = parts.withColumn(f"r{k}", c * weight * (1 / (1 + F.exp(-score)) - is_it.cast("double")))
        parts = parts.withColumn(f"l{k}", c * weight * (F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))))
    parts = stage_table(parts.drop(text, "label"), "residuals")

    of_gram = terms.join(parts.select("id", *[f"r{k}" for k in range(classes)]), "id").groupBy("gram").agg(
        *[F.sum(F.col("tfidf") * F.col(f"r{k}")).alias(f"g{k}") for k in range(classes)])
    own = table.select("gram", "weights").join(of_gram, "gram", "left")
    found = []
    for k in range(classes):
        v = F.col("weights")[k]
        found += [F.sum(F.pow(F.coalesce(F.col(f"g{k}"), F.lit(0.0)) + v, 2)).alias(f"g{k}"), F.sum(v * v).alias(f"v{k}")]
    grams = own.agg(*found)
    rest = []
    for k in range(classes):
        rest += [F.sum(f"l{k}").alias(f"loss{k}")]
        rest += [F.sum(F.col("x")[j] * F.col(f"r{k}")).alias(f"d{k}_{j}") for j in range(width)]
    both = grams.crossJoin(parts.agg(*rest))  # a single row each
    out = []
    for k, name in enumerate(positives):
        w = dense[k * width:(k + 1) * width]
        gradient = F.col(f"g{k}")
        for j in range(width):
            gradient = gradient + F.pow(F.col(f"d{k}_{j}") + F.lit(w[j]), 2)
        objective = F.col(f"loss{k}") + (F.col(f"v{k}") + F.lit(sum(x * x for x in w))) / 2
        out.append(F.struct(F.lit(name).alias("class"), objective.alias("objective"), F.sqrt(gradient).alias("gradient_norm"), (gradient / 2).alias("gap")))
    return both.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def forest_path(model: PipelineModel, path: str) -> str:
    """Folder of the forest inside the folder of a saved pipeline."""
    place = next(i for i, s in enumerate(model.stages) if hasattr(s, "featureImportances"))
    return PipelineSharedReadWrite.getStagePath(model.stages[place].uid, place, len(model.stages), f"{path}/stages")


NODES = ["tree", "node", "feature", "threshold", "left_node", "right_node", "gain", "weight", "shares"]


def forest_nodes(spark, path: str, columns: list) -> DataFrame:
    """The nodes of a saved forest as a table: `NODES`, one row per node; a leaf has no feature.

    `path` is the folder of the saved forest (see `forest_path`), `columns` the feature names by index; `weight` is the sum of the row weights that
    reached the node in training, and `shares` the part of each class.
    """
    n = F.col("nodeData")
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    inner = n["leftChild"] >= 0
    names = F.array(*[F.lit(c) for c in columns])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, F.element_at(names, n["split"]["featureIndex"] + 1)).alias("feature"),
        F.when(inner, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left_node"), F.when(inner, n["rightChild"]).alias("right_node"),
        F.when(inner, n["gain"]).alias("gain"), total.alias("weight"), F.transform(stats, lambda s: s / total).alias("shares"))


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): weighted gain by feature, in parts of each tree's total, averaged over the trees that split; they sum to 1."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole")).filter("whole > 0")
    shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    trees = shares.agg(F.sum("share").alias("trees"))
    return shares.crossJoin(F.broadcast(trees)).select("feature", (F.col("share") / F.col("trees")).alias("importance"))  # one row


def forest_probabilities(rows: DataFrame, key: str, nodes: DataFrame, every: int = 6) -> DataFrame:
    """(key, shares): the mean over the trees of the class shares of the leaf that a row reaches.

    `rows` has a unique `key` and the feature columns as numbers. All rows walk down all trees at once, one join with the node
    table per level. Rows at a leaf leave the walk as soon as they reach it; what is left is staged each `every` levels.
    """
    features = [r[0] for r in nodes.select("feature").distinct().collect() if r[0] is not None]
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]) if features else F.lit(None).cast("map<string,double>")
    nodes = stage_table(nodes.select("tree", "node", "feature", "threshold", "left_node", "right_node", "shares"), "nodes")
    nodes = nodes.withColumn("__n", F.concat_ws(":", "tree", "node"))
    small = nodes.agg(F.count("*")).first()[0] <= 1_000_000  # a node takes about 100 bytes: at most 100 MB is broadcast
    table = F.broadcast(nodes.drop("tree", "node")) if small else nodes.drop("tree", "node")
    trees = stage_table(nodes.select("tree").distinct(), "trees")
    walk = rows.select(F.col(key).alias("__k"), values.alias("__x")).join(F.broadcast(trees)).withColumn("node", F.lit(0))
    done, level = None, 0
    while True:
        at = walk.withColumn("__n", F.concat_ws(":", "tree", "node")).drop("node").join(table, "__n")
        at = stage_table(at, "walk") if level % every == every - 1 else at
        leaves = at.filter("feature IS NULL").select("__k", "shares")
        done = leaves if done is None else done.unionByName(leaves)
        goes_left = F.col("__x")[F.col("feature")] <= F.col("threshold")
        walk = at.filter("feature IS NOT NULL").select("__k", "__x", "tree", F.when(goes_left, F.col("left_node")).otherwise(F.col("right_node")).alias("node"))
        level += 1
        if level % every == 0 and walk.isEmpty():
            break
    summed = done.select("__k", F.posexplode("shares").alias("c", "s")).groupBy("__k", "c").agg(F.avg("s").alias("s"))
    return summed.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("e")).select(
        F.col("__k").alias(key), F.transform("e", lambda e: e["s"]).alias("shares"))

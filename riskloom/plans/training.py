"""Training: lexical forest, TF-IDF classifier, hybrid classifiers and their ablations."""

import time
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.constants import (
    FOREST_TREES, LEXICAL_FEATURES, LOGISTIC_C, LOGISTIC_MAX_ITER, LOGISTIC_TOLERANCE, MAX_FEATURES, NGRAM_MAX,
    NGRAM_MIN, RANDOM_SEED,
)
from ..functions.groups import combine, domain_group, lexical_group
from ..operators.metrics import best_experiment, classification_report, confusion_matrix, pair_counts, summary_metrics
from ..operators.sampling import stratified_split
from ..operators.scaling import class_weights, fit_standardizer, with_class_weights
from ..operators.joins import lookup_bytes
from ..operators.tfidf import TfidfModel, fit_tfidf, measure, numbered, term_arrays, term_places
from ..sources.sinks import promote, save_model, write_table
from ..sources.staging import new_path, stage_table
from .solver import SpreadFit, fit_cells, pack, stage_cells
from .stages import (
    DOM, LEX, DomainFeatures, LabelScores, LexicalFeatures, ScoreLabels, Standardize, TermScores, TermVectors, TextKey, UrlNormalizer,
    sparse_struct, stage_vectors,
)

#: Non-zero entries that a task of a solver's pass is worth at least, also per weight: each task returns a gradient as long as the weights.
ENTRIES_PER_TASK, ENTRIES_PER_WEIGHT = 4_000_000, 4
#: Coordinates of the row that evens out the deviations of the solver's columns.
FAR = 1e9
#: Bytes of the gradients of all classes beyond which they are added up beside the rows (see `solver`): Spark's solver sends the driver one per pass.
#: Beyond the second figure a task of the spread solver would hold too much: such vocabularies, which only `max_features=None` allows, stay with Spark's.
SPREAD_BYTES, SPREAD_MOST = 1 << 19, 1 << 26
#: Entries that a task of the spread solver has at least, also per weight, and at most: it holds them compressed, some two bytes each.
SPREAD_ENTRIES, SPREAD_PER_WEIGHT, SPREAD_MOST_ENTRIES = 1_000_000, 32, 12_000_000
#: Part of the objective by which such a fit may, by its gradient, be above the least one.
SPREAD_GAP = 1e-3


@dataclass
class Experiment:
    """A named feature set: text always, plus some lexical and domain columns."""

    name: str
    lexical: list = field(default_factory=list)
    domain: list = field(default_factory=list)

    @property
    def columns(self):
        chosen = combine(self.lexical, self.domain)
        own = set(self.domain)
        return [(DOM if c in own else LEX) + c for c in chosen]


# The two experiment tables, in order.
LEXICAL_EXPERIMENTS = [
    Experiment("tfidf_only"),
    Experiment("tfidf_length", lexical_group("length")),
    Experiment("tfidf_structural", lexical_group("structural")),
    Experiment("tfidf_suspicious", lexical_group("suspicious")),
    Experiment("tfidf_all", lexical_group("all")),
    Experiment("tfidf_all_minus_redundant", lexical_group("all_minus_redundant")),
]
DOMAIN_EXPERIMENTS = [
    Experiment("v4_tfidf_only"),
    Experiment("v4_tfidf_v3", lexical_group("all_minus_redundant")),
    Experiment("v4_tfidf_domain", [], domain_group("all")),
    Experiment("v4_tfidf_v3_domain", lexical_group("all_minus_redundant"), domain_group("all")),
]


@dataclass
class FitResult:
    """A fitted pipeline from raw URL to scores, and its reports on the test rows."""

    model: PipelineModel
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame
    predictions: DataFrame
    training_time: float
    importance: DataFrame = None
    pairs: DataFrame = None


def _labels(df: DataFrame, label: str) -> list:
    """Sorted class names; the classifier keeps one output per class anyway."""
    return list(StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df).labels)


def _with_split(df: DataFrame, label: str, key: str) -> DataFrame:
    return df if "split" in df.columns else stratified_split(df, label, key)


def evaluate(model: PipelineModel, df: DataFrame, label: str = "type", split: str = "test"):
    """Score the rows of the stored split and count (actual, predicted): (predictions, pairs).

    The split column travels with the data, so rows the model was fitted on are never tested.
    """
    if split is not None:
        df = df.filter(F.col("split") == split)
    predictions = model.transform(df)
    pairs = stage_table(pair_counts(predictions, label, "prediction"), "pairs")
    return predictions, pairs


def _result(model, test, label, elapsed, importance=None) -> FitResult:
    predictions, pairs = evaluate(model, test, label)
    return FitResult(model, summary_metrics(pairs), classification_report(pairs), confusion_matrix(pairs),
                     predictions, elapsed, importance)


def fit_lexical(df: DataFrame, label: str = "type", url: str = "url", key: str = None, trees: int = FOREST_TREES,
                max_depth: int = 30, columns=None, seed: int = RANDOM_SEED, max_bins: int = 256) -> FitResult:
    """Random forest on the lexical features of clean (url, type) rows.

    Balanced class weights, at least one row per leaf, sqrt(features) per split. Spark
    limits depth to 30 and splits on `max_bins` candidate thresholds per feature.
    """
    columns = list(columns or LEXICAL_FEATURES)
    df = stage_table(_with_split(df, label, key or url), "split")
    names = [LEX + c for c in columns]
    features = [UrlNormalizer(inputCol=url, outputCol=url), LexicalFeatures(inputCol=url, columns=columns),
                VectorAssembler(inputCols=names, outputCol="features__")]
    prepared = df
    for stage in features:
        prepared = stage.transform(prepared)
    prepared = stage_table(prepared.select(url, label, "split", "features__"), "lexical")
    train = prepared.filter("split = 'train'")
    index = StringIndexer(inputCol=label, outputCol="label__", stringOrderType="alphabetAsc").fit(train)
    forest = RandomForestClassifier(
        labelCol="label__", featuresCol="features__", weightCol="weight__", numTrees=trees, maxDepth=max_depth,
        minInstancesPerNode=1, featureSubsetStrategy="sqrt", maxBins=max_bins, seed=seed,
        rawPredictionCol="raw__", probabilityCol="p__", predictionCol="hit__",
    )
    start = time.monotonic()
    fitted = forest.fit(index.transform(with_class_weights(train, label, "weight__")))
    elapsed = time.monotonic() - start
    scores = ScoreLabels(labels=list(index.labels), vectors=["p__"], drop=names + ["features__", "raw__", "p__", "hit__"])
    model = PipelineModel([*features, fitted, scores])
    return _result(model, df, label, elapsed, feature_importance(df.sparkSession, fitted, columns))


def feature_importance(spark, forest, columns, top: int = 20) -> DataFrame:
    """(feature, importance), largest first; one number per feature column."""
    values = [(c, float(v)) for c, v in zip(columns, forest.featureImportances.toArray())]
    df = spark.createDataFrame(values, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


@dataclass
class NumberedVocabulary:
    """A fitted vocabulary with positions, as a table, and what is known about it."""

    table: DataFrame
    path: str
    size: int
    bytes: int

    @classmethod
    def of(cls, tfidf: TfidfModel):
        spark = tfidf.vocabulary.sparkSession
        path = write_table(numbered(tfidf.vocabulary), new_path(spark, "positions"), "parquet")
        table = spark.read.parquet(path)
        size = table.count()
        if not size:
            raise ValueError("no gram is left after the document-frequency limits")
        if size >= (1 << 31) - 1024:
            raise ValueError("a vector has at most 2^31 entries: give max_features")
        return cls(table, path, size, lookup_bytes(table, "gram"))


def text_stages(tfidf: TfidfModel, text: str = "url") -> list:
    """The fitted vocabulary as vector stages, ending in the column `tfidf__`; positions are by falling total, then by gram.

    The vocabulary stays a table, which terms are joined with, so it is never held by the driver or by one task.
    """
    own = NumberedVocabulary.of(tfidf)
    return [TextKey(inputCol=text), TermVectors(inputCol=text, path=own.path, bytes=float(own.bytes), size=own.size, nMin=tfidf.n_min, nMax=tfidf.n_max)]


TEXT_WORK = ["text_key__", "tfidf__"]


def _solver_size(rows: DataFrame, features: str) -> tuple[int, int]:
    """Length of the vectors, and tasks of a pass: its tasks make a gradient each, so they are sized by the measured entries, not by rows."""
    parts = F.unwrap_udt(features)
    entries = rows.agg(F.sum(F.coalesce(F.size(parts["indices"]), F.size(parts["values"]))), F.max(parts["size"])).first()
    width = entries[1] or 0
    return width, max(1, -(-(entries[0] or 0) // max(ENTRIES_PER_TASK, ENTRIES_PER_WEIGHT * width)))


def fit_logistic(train: DataFrame, label: str, features: str, c: float = LOGISTIC_C,
                 max_iter: int = LOGISTIC_MAX_ITER, tolerance: float = LOGISTIC_TOLERANCE, parallelism: int = 4) -> list:
    """Balanced L2 logistic regression: fitted models, one per class (one for two classes).

    Minimises c * sum(weight * loss) + |v|^2 / 2. With more than two classes each model
    separates one class (carrying its balanced weight) from the rest (weight 1); up to
    `parallelism` of them are fitted at the same time.
    """
    labels = _labels(train, label)
    if len(labels) < 2:
        raise ValueError("a classifier needs at least 2 classes")
    stats = {r[label]: (r["n"], r["weight"]) for r in class_weights(train, label).collect()}
    total = sum(n for n, _ in stats.values())
    width, tasks = _solver_size(train, features)

    def fit(position, name):
        n, weight = stats[name]
        other_n, other_weight = stats[labels[0]] if len(labels) == 2 else (total - n, 1.0)
        is_it = F.col(label) == name
        rows = train.select(
            features, is_it.cast("double").alias("y"), F.when(is_it, weight).otherwise(other_weight).alias("w")
        )
        weight_sum = n * weight + other_n * other_weight
        # Spark's solver divides each column by its deviation, whatever `standardization` says, and leaves constant ones out. Grams differ in
        # deviation by orders of magnitude, which takes it many passes, each of which sends the driver a gradient. One row far off, of next to
        # no weight, gives every column the deviation 1; its loss and its gradient are below 1e-9 of a row's part per unit of weights.
        far = train.sparkSession.range(1).select(
            array_to_vector(F.array_repeat(F.lit(FAR), width)).alias(features), F.lit(0.0).alias("y"), F.lit(weight_sum / FAR ** 2).alias("w"))
        rows = rows.unionByName(far).coalesce(tasks)
        return LogisticRegression(
            featuresCol=features, labelCol="y", weightCol="w", standardization=False, fitIntercept=False,
            regParam=1.0 / (c * weight_sum), maxIter=max_iter, tol=tolerance, family="binomial",
            rawPredictionCol=f"raw__{position}", probabilityCol=f"p__{position}", predictionCol=f"hit__{position}",
        ).fit(rows)

    positives = labels[1:] if len(labels) == 2 else labels
    run = inheritable_thread_target(train.sparkSession)(fit)
    with ThreadPool(parallelism) as pool:
        return pool.starmap(run, list(enumerate(positives)))


def spread_cells(rows: DataFrame, labels: list, label: str, key: str, text: str, columns: list, vocabulary: NumberedVocabulary, n_min: int, n_max: int) -> tuple[str, int]:
    """What `fit_logistic_spread` reads, staged for all experiments: texts and number columns of the staged rows (row__, split, ...); and the number of tasks.

    Terms are packed where they are counted. Beside them are the raw `columns` and, last, a constant 1.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    numbers = F.array(*[F.col(c).cast("double") for c in columns], F.lit(1.0))
    rows = rows.filter("split IN ('train', 'test')").select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.col("row__").alias("row"), F.when(F.col("split") == "train", place).otherwise(-1).cast("int").alias("class"),
        numbers.alias("numbers"))
    places = term_places(rows, vocabulary.table, n_min, n_max, vocabulary.bytes)
    cells, entries = stage_cells(places.mapInArrow(pack, "cell binary, entries bigint"))
    return cells, max(1, -(-entries // min(max(SPREAD_ENTRIES, SPREAD_PER_WEIGHT * vocabulary.size), SPREAD_MOST_ENTRIES)))


def fit_logistic_spread(cells: str, tasks: int, vocabulary: NumberedVocabulary, labels: list, stats: dict, columns: list, c: float = LOGISTIC_C,
                        max_iter: int = LOGISTIC_MAX_ITER, tolerance: float = SPREAD_GAP, like: SpreadFit = None) -> SpreadFit:
    """What `fit_logistic` minimises, with the weights as a table and no gradient on the driver; rows beside the split `train` are scored.

    `stats` has the balanced weight per class; `columns` are the number columns (index, mean, deviation) of the cells. The fit begins at the weights
    of the texts in `like`, a fit of the same cells with other columns.
    """
    if len(labels) < 2:
        raise ValueError("a classifier needs at least 2 classes")
    if None in stats:
        raise ValueError("a training row has no class")
    positives = [1] if len(labels) == 2 else range(len(labels))
    rest = stats[labels[0]] if len(labels) == 2 else 1.0
    table = vocabulary.table if like is None else vocabulary.table.join(like.weights.hint("merge"), "position")
    return fit_cells(vocabulary.table.sparkSession, cells, table, vocabulary.size, columns, tasks, positives, [c * stats[labels[k]] for k in positives], [c * rest for _ in positives],
                     max_iter, tolerance)


def _spread_weights(vocabulary: NumberedVocabulary, fit: SpreadFit, path: str) -> tuple[str, list]:
    """`_weights` of a spread fit: the driver gets the weights of the number columns and the constant alone."""
    write_table(vocabulary.table.join(fit.weights.hint("merge"), "position").select("gram", "df", "idf", "weights"), path, "parquet")
    return path, [float(w) for own in fit.dense for w in own]


def _weights(vocabulary: NumberedVocabulary, models: list, path: str) -> tuple[str, list]:
    """Write (gram, df, idf, weights) at `path`; (path, the other weights class by class). The weight vectors are all that the driver holds."""
    spark, own = vocabulary.table.sparkSession, [m.coefficients.toArray() for m in models]
    columns = {f"w{k}": own[k][:vocabulary.size] for k in range(len(own))}
    rows = pa.table({"position": np.arange(vocabulary.size, dtype=np.int64), **columns})
    table = spark.createDataFrame(rows).select("position", F.array(*columns).alias("weights"))
    write_table(vocabulary.table.join(table, "position").select("gram", "df", "idf", "weights"), path, "parquet")
    return path, [float(w) for x in own for w in x[vocabulary.size:]]


def run_ablation(df: DataFrame, experiments, label: str = "type", url: str = "url", key: str = None,
                 rules: DataFrame = None, rules_path: str = None, max_features=MAX_FEATURES, n_min: int = NGRAM_MIN,
                 n_max: int = NGRAM_MAX, max_iter: int = LOGISTIC_MAX_ITER, save_to: str = None, normalize: bool = True,
                 on_result=None) -> dict:
    """Fit one classifier per experiment on one split and one TF-IDF fit.

    Text statistics see training rows only. Vectors and features of all experiments are
    computed once, written to the shared folder, and each experiment reads the columns
    it needs. `key` is a unique column, the URL itself if not given. `on_result(experiment, result)` is called when
    an experiment is evaluated and saved. Returns {name: FitResult}.
    """
    key = key or url
    experiments = list(experiments)
    lexical = sorted({c for e in experiments for c in e.lexical}, key=LEXICAL_FEATURES.index)
    domain = [c for c in domain_group("all") if any(c in e.domain for e in experiments)]
    if domain and rules_path is None:
        if rules is None:
            raise ValueError("domain features need suffix rules")
        # beside the saved variants, which read them: a model must not depend on the scratch folder
        rules_path = write_table(rules, f"{save_to}/rules" if save_to else new_path(df.sparkSession, "rules"), "parquet")
    df = _with_split(df, label, key)
    base = [UrlNormalizer(inputCol=url, outputCol=url)] if normalize else []
    split = stage_table(df.select(*dict.fromkeys([key, url, label, "split"])), "split")
    texts = split
    for stage in base:
        texts = stage.transform(texts)
    tfidf = fit_tfidf(texts.filter("split = 'train'"), key, url, max_features, n_min=n_min, n_max=n_max)
    vocabulary = NumberedVocabulary.of(tfidf)
    lex = [LexicalFeatures(inputCol=url, columns=lexical)] if lexical else []
    dom = [DomainFeatures(inputCol=url, columns=domain, rulesPath=rules_path)] if domain else []

    numbers = [LEX + c for c in lexical] + [DOM + c for c in domain]
    prepared = texts
    for stage in [*lex, *dom]:
        prepared = stage.transform(prepared)
    labels = _labels(split.filter("split = 'train'"), label)
    classes = 1 if len(labels) == 2 else len(labels)
    spread = SPREAD_BYTES < 8 * classes * (vocabulary.size + max(len(e.columns) for e in experiments) + 1) <= SPREAD_MOST
    if spread:
        prepared = stage_table(prepared.withColumn("row__", F.monotonically_increasing_id()), "features")
        cells, tasks = spread_cells(prepared, labels, label, key, url, numbers, vocabulary, n_min, n_max)
        stats = {r[label]: r["weight"] for r in class_weights(prepared.filter("split = 'train'"), label).collect()}
    else:
        # Arrays are far larger than texts: the terms are spread by the measured text, and stay so.
        arrays = term_arrays(texts, key, url, vocabulary.table, n_min, n_max, vocabulary.bytes)
        prepared = prepared.join(arrays.withColumnRenamed("id", key), key, "left").withColumns({
            "indices": F.coalesce("indices", F.array().cast("array<int>")), "values": F.coalesce("values", F.array().cast("array<double>"))})
        prepared = stage_table(prepared, "features")
    train = prepared.filter("split = 'train'")
    scaler = fit_standardizer(train, numbers) if numbers else None

    results, fit = {}, None
    for experiment in experiments:
        columns, scaling, scaled = experiment.columns, [], []
        if columns:
            at = [numbers.index(c) for c in columns]
            scaled = [(i, scaler.means[i], scaler.deviations[i]) for i in at]
            scaling = [Standardize(columns=columns, means=[x[1] for x in scaled], deviations=[x[2] for x in scaled])]
        vectors = prepared
        for stage in scaling:
            vectors = stage.transform(vectors)
        if not spread:
            # The row's entries, then its number columns and a constant 1 for a penalised intercept; written once for all classes.
            added = [F.col(c).cast("double") for c in columns] + [F.lit(1.0)]
            indices = F.concat("indices", F.array(*[F.lit(vocabulary.size + i) for i in range(len(added))]))
            vector = sparse_struct(F.lit(vocabulary.size + len(added)), indices, F.concat("values", F.array(*added)))
            kept = [c for c in prepared.columns if c not in ("indices", "values")]
            vectors = stage_vectors(vectors.select(*kept, vector.alias("features__")), "vectors", "features__")
        start = time.monotonic()
        if spread:
            fit = fit_logistic_spread(cells, tasks, vocabulary, labels, stats, [*scaled, (len(numbers), 0.0, 1.0)], max_iter=max_iter, like=fit)
        else:
            models = fit_logistic(vectors.filter("split = 'train'").select(label, "features__"), label, "features__", max_iter=max_iter)
        elapsed = time.monotonic() - start
        own_lex = [c[len(LEX):] for c in columns if c.startswith(LEX)]
        own_dom = [c[len(DOM):] for c in columns if c.startswith(DOM)]
        features = []
        if own_lex:
            features.append(LexicalFeatures(inputCol=url, columns=own_lex))
        if own_dom:
            features.append(DomainFeatures(inputCol=url, columns=own_dom, rulesPath=rules_path))
        name = f"weights-{experiment.name}"
        path = f"{save_to}/{name}-{uuid.uuid4().hex}" if save_to else new_path(df.sparkSession, name)
        path, dense = _spread_weights(vocabulary, fit, path) if spread else _weights(vocabulary, models, path)
        scores = TermScores(inputCol=url, path=path, bytes=float(vocabulary.bytes + 8 * classes * vocabulary.size), columns=columns,
                            dense=dense, classes=classes, nMin=n_min, nMax=n_max)
        model = PipelineModel([*base, TextKey(inputCol=url), *features, *scaling, scores, LabelScores(labels=labels, drop=columns)])
        # The staged vectors hold what the full pipeline computes; test on them.
        test, drop = vectors.filter("split = 'test'"), [*columns, "row__" if spread else "features__"]
        if spread:
            tail = [LabelScores(labels=labels, drop=drop)]
            test = test.join(fit.scores.select(F.col("row").alias("row__"), F.col("scores").alias("scores__")).hint("merge"), "row__")
        else:
            work = [f"{kind}__{i}" for kind in ("raw", "p", "hit") for i in range(classes)]
            tail = [*models, ScoreLabels(labels=labels, vectors=[f"p__{i}" for i in range(classes)], drop=work + drop)]
        scored = PipelineModel(tail).transform(test)
        pairs = stage_table(pair_counts(scored, label, "prediction"), "pairs")
        results[experiment.name] = FitResult(
            model, summary_metrics(pairs), classification_report(pairs), confusion_matrix(pairs), scored, elapsed, pairs=pairs
        )
        if save_to:
            save_model(model, save_to, experiment.name)
        if on_result:
            on_result(experiment, results[experiment.name])
    return results


def fit_text(df: DataFrame, label: str = "type", text: str = "url", *, max_features, **options) -> FitResult:
    """TF-IDF and logistic regression alone. The caller chooses `max_features`; None keeps every gram."""
    return run_ablation(df, [Experiment("tfidf")], label, text, max_features=max_features, **options)["tfidf"]


def fit_hybrid(df: DataFrame, experiment: Experiment, label: str = "type", url: str = "url", **options) -> FitResult:
    """One hybrid classifier."""
    return run_ablation(df, [experiment], label, url, **options)[experiment.name]


def ablation_table(spark, results: dict) -> DataFrame:
    """(position, experiment, accuracy, macro_f1, weighted_f1, training_time), in run order."""
    rows = None
    for position, (name, result) in enumerate(results.items()):
        row = result.metrics.select(
            F.lit(position).alias("position"), F.lit(name).alias("experiment"), "accuracy", "macro_f1", "weighted_f1",
            F.lit(result.training_time).alias("training_time"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def promote_best(table: DataFrame, root: str, exclude=("tfidf_only",)):
    """Make the best hybrid variant the `default` one; its name, or None if there is no hybrid."""
    best = best_experiment(table, exclude).first()
    if best is None:
        return None
    promote(table.sparkSession, root, best["experiment"])
    return best["experiment"]

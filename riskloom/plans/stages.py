"""Pipeline stages that Spark ML lacks, as persistable transformers over native columns."""

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.constants import DOMAIN_FEATURES, LEXICAL_FEATURES, NGRAM_MAX, NGRAM_MIN
from ..functions.lexical import with_lexical_features
from ..functions.urls import normalize_url
from ..operators.domains import with_domain_features
from ..operators.scaling import Standardizer
from ..operators.tfidf import term_arrays, term_scores
from ..sources.staging import new_path

LEX, DOM = "lex__", "dom__"


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


def _param(name, converter):
    return Param(Params._dummy(), name, name, converter)


class UrlNormalizer(_Stage, HasInputCol, HasOutputCol):
    """Normalised URL of the input column."""

    @keyword_only
    def __init__(self, *, inputCol="url", outputCol="url"):
        super().__init__()
        self._setDefault(inputCol="url", outputCol="url")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), normalize_url(F.col(self.getInputCol())))


class LexicalFeatures(_Stage, HasInputCol):
    """Lexical features as columns named lex__<feature>."""

    columns = _param("columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="url", columns=None):
        super().__init__()
        self._setDefault(inputCol="url", columns=list(LEXICAL_FEATURES))
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_lexical_features(df, self.getInputCol(), self.getOrDefault(self.columns), prefix=LEX)


class DomainFeatures(_Stage, HasInputCol):
    """Domain features as columns named dom__<feature>.

    The suffix rules are read from `rulesPath` (Parquet: suffix, kind), so that a saved
    model keeps using the rules it was fitted with.
    """

    columns = _param("columns", TypeConverters.toListString)
    rulesPath = _param("rulesPath", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="url", columns=None, rulesPath=None):
        super().__init__()
        self._setDefault(inputCol="url", columns=list(DOMAIN_FEATURES))
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        rules = df.sparkSession.read.parquet(self.getOrDefault(self.rulesPath))
        return with_domain_features(df, rules, self.getInputCol(), self.getOrDefault(self.columns), prefix=DOM)


def sparse_struct(size, indices, values):
    """The parts of a sparse vector as a struct column, in the layout of the vector type."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))


def sparse_vector(size, indices, values):
    """A vector column from native columns, for rows that are not staged.

    Spark has no expression for this, only Python functions. Reading the parts back as
    JSON with the vector type in the schema does it inside the JVM.
    """
    schema = StructType([StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(sparse_struct(size, indices, values).alias("v"))), schema)["v"]


def stage_vectors(df: DataFrame, name: str, column: str) -> DataFrame:
    """Stage df and read its struct `column` (see `sparse_struct`) back as vectors: the file holds just the parts, so nothing is converted."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    fields = [StructField(f.name, VectorUDT()) if f.name == column else f for f in df.schema.fields]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


class TextKey(_Stage, HasInputCol, HasOutputCol):
    """The MD5 of a text: what its terms are grouped by, so that equal texts are analysed once."""

    @keyword_only
    def __init__(self, *, inputCol="url", outputCol="text_key__"):
        super().__init__()
        self._setDefault(inputCol="url", outputCol="text_key__")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.md5(F.coalesce(F.col(self.getInputCol()), F.lit(""))))


class _Terms(_Stage, HasInputCol, HasOutputCol):
    """What stages over the terms of a text share: a table on disk, its measured size, and the n-gram lengths."""

    keyCol = _param("keyCol", TypeConverters.toString)
    path = _param("path", TypeConverters.toString)
    bytes = _param("bytes", TypeConverters.toFloat)
    nMin = _param("nMin", TypeConverters.toInt)
    nMax = _param("nMax", TypeConverters.toInt)

    def _texts(self, df: DataFrame) -> DataFrame:
        key, text = self.getOrDefault(self.keyCol), self.getInputCol()
        return df.select(F.col(key).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])

    def _table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.parquet(self.getOrDefault(self.path))

    def _sizes(self):
        return {"n_min": self.getOrDefault(self.nMin), "n_max": self.getOrDefault(self.nMax), "size": int(self.getOrDefault(self.bytes))}


class TermVectors(_Terms):
    """Normalised TF-IDF vectors of a text column by a numbered vocabulary table; the key column is dropped."""

    size = _param("size", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="url", outputCol="tfidf__", keyCol="text_key__", path=None, bytes=0.0, size=0, nMin=NGRAM_MIN, nMax=NGRAM_MAX):
        super().__init__()
        self._setDefault(inputCol="url", outputCol="tfidf__", keyCol="text_key__", bytes=0.0, size=0, nMin=NGRAM_MIN, nMax=NGRAM_MAX)
        self._set(**self._input_kwargs)

    @property
    def vocabulary(self) -> list:
        """The grams by position, collected: for small vocabularies."""
        from pyspark.sql import SparkSession

        rows = SparkSession.active().read.parquet(self.getOrDefault(self.path)).orderBy("position").select("gram").collect()
        return [r["gram"] for r in rows]

    def _transform(self, df: DataFrame) -> DataFrame:
        arrays = term_arrays(self._texts(df), "id", "text", self._table(df), **self._sizes())
        key = self.getOrDefault(self.keyCol)
        df = df.join(arrays.withColumnRenamed("id", key), key, "left")
        indices = F.coalesce("indices", F.array().cast("array<int>"))
        values = F.coalesce("values", F.array().cast("array<double>"))
        return df.withColumn(self.getOutputCol(), sparse_vector(F.lit(self.getOrDefault(self.size)), indices, values)).drop(
            "indices", "values", key)


class TermScores(_Terms):
    """Scores of a linear model per class: a table of weights per gram, and weights of number columns and of the constant.

    `dense` holds, class by class, the weights of `columns` and, last, that of the constant 1.
    """

    columns = _param("columns", TypeConverters.toListString)
    dense = _param("dense", TypeConverters.toListFloat)
    classes = _param("classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="url", outputCol="scores__", keyCol="text_key__", path=None, bytes=0.0, columns=None, dense=None, classes=1,
                 nMin=NGRAM_MIN, nMax=NGRAM_MAX):
        super().__init__()
        self._setDefault(inputCol="url", outputCol="scores__", keyCol="text_key__", bytes=0.0, columns=[], nMin=NGRAM_MIN, nMax=NGRAM_MAX)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, columns, dense = (self.getOrDefault(p) for p in (self.classes, self.columns, self.dense))
        key, width = self.getOrDefault(self.keyCol), len(columns) + 1
        sums = term_scores(self._texts(df), "id", "text", self._table(df), classes, **self._sizes())
        df = df.join(sums.select(F.col("id").alias(key), F.col("scores").alias("term_scores__")), key, "left")
        scores = []
        for k in range(classes):
            own = dense[k * width:(k + 1) * width]
            score = F.coalesce(F.col("term_scores__")[k], F.lit(0.0)) + F.lit(own[-1])
            for c, w in zip(columns, own):
                score = score + F.col(c).cast("double") * F.lit(w)
            scores.append(score)
        return df.withColumn(self.getOutputCol(), F.array(*scores)).drop("term_scores__", key)


class Standardize(_Stage):
    """Standardised columns with fitted means and population deviations, in place."""

    columns = _param("columns", TypeConverters.toListString)
    means = _param("means", TypeConverters.toListFloat)
    deviations = _param("deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        values = [self.getOrDefault(p) for p in (self.columns, self.means, self.deviations)]
        return Standardizer(*values).transform(df)


class ScoreLabels(_Stage):
    """`prediction` and the map `probabilities` from model output vectors.

    One vector per class (one-vs-rest): its positive probabilities are divided by their
    sum. One vector for all (two classes, or a forest): taken as it is. Working columns
    of the pipeline are dropped.
    """

    labels = _param("labels", TypeConverters.toListString)
    vectors = _param("vectors", TypeConverters.toListString)
    drop = _param("drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labels=None, vectors=None, drop=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        labels, vectors = self.getOrDefault(self.labels), self.getOrDefault(self.vectors)
        if len(vectors) == 1:
            shares = vector_to_array(F.col(vectors[0]))
        else:
            shares = F.array(*[vector_to_array(F.col(v))[1] for v in vectors])
        return with_prediction(df, shares, labels, len(vectors) > 1).drop(*self.getOrDefault(self.drop))


class LabelScores(_Stage, HasInputCol):
    """`prediction` and `probabilities` from an array of scores: one per class, or one alone for the second of two classes."""

    labels = _param("labels", TypeConverters.toListString)
    drop = _param("drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="scores__", labels=None, drop=None):
        super().__init__()
        self._setDefault(inputCol="scores__", drop=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        shares = F.transform(self.getInputCol(), lambda s: 1 / (1 + F.exp(-s)))
        if len(labels) == 2:
            shares = F.array(1 - shares[0], shares[0])
        return with_prediction(df, shares, labels, len(labels) > 2).drop(self.getInputCol(), *self.getOrDefault(self.drop))


def with_prediction(df: DataFrame, shares, labels: list, divide: bool) -> DataFrame:
    """df with `prediction` and the map `probabilities` from an array of shares, divided by their sum if asked."""
    df = df.withColumn("__p", shares)
    if divide:
        df = df.withColumn("__t", F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + p))
        even = F.lit(1.0 / len(labels))
        df = df.withColumn("__p", F.transform("__p", lambda p: F.coalesce(F.try_divide(p, F.col("__t")), even))).drop("__t")
    names = F.array(*[F.lit(name) for name in labels])
    best = F.array_position("__p", F.array_max("__p"))
    df = df.withColumns({
        "prediction": F.element_at(names, best.cast("int")),
        "probabilities": F.map_from_arrays(names, F.col("__p")),
    })
    return df.drop("__p")

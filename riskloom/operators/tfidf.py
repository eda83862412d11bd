"""Character n-gram TF-IDF in table form: one row per (row, gram)."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.constants import MAX_DF, MIN_DF, NGRAM_MAX, NGRAM_MIN
from ..functions.text import collapse_whitespace
from ..sources.staging import checkpoint, stage_table
from . import grams
from .joins import BROADCAST_BYTES, lookup_bytes, lookup_join
from .sampling import RANK_ROWS, cutoff_keys

CHUNK = 1 << 16
# Text per task of the gram count: about 12 million gram occurrences.
CHARS_PER_TASK = 4_000_000


def analyzed(text: Column) -> Column:
    """Lower-case, then runs of white space to one blank."""
    return collapse_whitespace(F.lower(text))


def gram_array(text: Column, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX) -> Column:
    """All character n-grams of an analysed string as one array, shorter grams first.

    The look-ahead captures n characters and the match consumes one, so the regex engine
    walks the text once per n; `substring` per position would walk it from the start each time.
    """
    return F.concat(*[
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).") , F.lit(1)) for n in range(n_min, n_max + 1)
    ])


def measure(df: DataFrame, text_col: str):
    """Rows of the table, and the number of tasks that its grams are worth."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return row["n"], max(least, -(-row["chars"] // CHARS_PER_TASK))


def pieces(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(id, part): each text of (id, text) in pieces of `chunk` + `overlap` characters, cut in one walk over the text."""
    pattern = f"(?s)(?=(.{{1,{chunk + overlap}}})).{{1,{chunk}}}"
    return texts.select("id", F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("part"))


def sorted_texts(df: DataFrame, id_col: str, text_col: str, tasks: int) -> DataFrame:
    """(id, text): analysed texts partitioned by id and sorted by it, so that a task has all rows of an id beside each other."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(tasks, "id")
    return texts.select("id", analyzed(F.col("text")).alias("text")).sortWithinPartitions("id")


def gram_entries(df: DataFrame, id_col: str, text_col: str, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX,
                 chunk: int = grams.BATCH, tasks: int = None) -> DataFrame:
    """(gram, entries): the terms (id, tf) of the whole texts, a row per gram and batch of some hundred texts; rows of one id are counted together.

    Texts, not grams, are shuffled and counted where they are, many at once (see `grams`): exploding a row per occurrence and
    aggregating, as before, took most of the time. What is looked up per gram is looked up once per batch. Grams are some 150 times
    as large as their text, so the number of
    tasks follows the measured text; left to itself, adaptive execution would size them by
    the small shuffle before the grams exist. An id with more than `chunk` characters is cut into pieces that overlap by
    n_max - 1 characters; every gram start belongs to exactly one piece.
    """
    texts = sorted_texts(df, id_col, text_col, tasks or measure(df, text_col)[1])
    id_type = texts.schema["id"].dataType
    entry = StructType([StructField("id", id_type), StructField("tf", LongType())])
    schema = StructType([StructField("gram", StringType()), StructField("entries", ArrayType(entry))])
    return texts.mapInArrow(grams.per_gram(n_min, n_max, chunk, to_arrow_type(id_type)), schema)


def char_terms(df: DataFrame, id_col: str, text_col: str, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX,
               chunk: int = grams.BATCH, tasks: int = None) -> DataFrame:
    """(id, gram, tf) for the whole texts; rows of one id are counted together."""
    return gram_entries(df, id_col, text_col, n_min, n_max, chunk, tasks).select("gram", F.inline("entries")).select("id", "gram", "tf")


def known_terms(df: DataFrame, id_col: str, text_col: str, table: DataFrame, n_min: int, n_max: int, size: int = None, tasks: int = None) -> DataFrame:
    """`char_terms` of the grams in `table` (gram, df, ...), with its columns."""
    known = lookup_join(gram_entries(df, id_col, text_col, n_min, n_max, tasks=tasks), table, "gram", weight="df", size=size)
    return known.select(*table.columns, F.inline("entries"))


def gram_frequencies(df: DataFrame, id_col: str, text_col: str, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX,
                     chunk: int = grams.BATCH, tasks: int = None) -> DataFrame:
    """`document_frequencies` of `char_terms`, without its rows: a task adds up the texts of a batch before the shuffle by gram."""
    texts = sorted_texts(df, id_col, text_col, tasks or measure(df, text_col)[1])
    counted = texts.mapInArrow(grams.per_batch(n_min, n_max, chunk), "gram string, df bigint, total bigint")
    return counted.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def text_entropy(df: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, tasks: int = None) -> DataFrame:
    """(id, entropy) in bits of the characters of whole, possibly long texts; 0 for an empty one.

    Counts characters by aggregation, in the partitioning of the texts. For short strings
    such as domain names there is the column function `shannon_entropy`.
    """
    tasks = tasks or measure(df, text_col)[1]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(tasks, "id")
    chars = pieces(texts, chunk, 0).select("id", F.explode_outer(F.split("part", "")).alias("char"))
    counts = chars.groupBy("id", "char").agg(F.count("*").cast("double").alias("n"))
    # Of n characters: log2(n) - sum(c * log2(c)) / n over the counts c.
    real = F.coalesce(F.col("char"), F.lit("")) != ""
    sums = counts.groupBy("id").agg(
        F.sum(F.when(real, F.col("n"))).alias("n"), F.sum(F.when(real, F.col("n") * F.log2("n"))).alias("s")
    )
    bits = F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0))
    return sums.select("id", F.coalesce(bits, F.lit(0.0)).alias("entropy"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(gram, df, total); counted before the shuffle, so frequent grams are no hot spot."""
    return terms.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def most_frequent(vocabulary: DataFrame, limit, rank_rows: int = RANK_ROWS) -> DataFrame:
    """The `limit` grams with the largest total count, ties by MD5 of the gram; all if None.

    Found by a cutoff key, so that no task and no driver has to hold the kept rows.
    """
    if limit is None:
        return vocabulary
    n = vocabulary.count()
    if n <= limit:
        return vocabulary
    # 16 hex digits that sort by descending total, then the hash of the gram.
    falling = F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col("total")), 16, "0")
    key = F.concat(falling, F.md5("gram"), F.col("gram"))
    quota = vocabulary.sparkSession.createDataFrame([("", n, limit)], "stratum string, n bigint, quota bigint")
    keyed = vocabulary.select(F.lit("").alias("stratum"), key.alias("key"))
    cutoff = cutoff_keys(keyed, quota, rank_rows).first()["cutoff"]
    return vocabulary.filter(key <= F.lit(cutoff))


@dataclass
class TfidfModel:
    """A fitted vocabulary: table (gram, df, total, idf) and the number of fitted rows."""

    vocabulary: DataFrame
    n_rows: int
    n_min: int = NGRAM_MIN
    n_max: int = NGRAM_MAX

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, gram, tf, tfidf), rows scaled to length 1; grams outside the vocabulary vanish."""
        tasks = measure(df, text_col)[1]
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        norms = self._weighted(texts, tasks).groupBy(F.col("id").alias("of")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        # The norm travels with the text, so that terms, which are far larger, need no shuffle by id.
        texts = texts.join(norms, F.col("id").eqNullSafe(F.col("of"))).select(F.struct("id", "norm").alias("id"), "text")
        return self._weighted(texts, tasks).select("id.id", "gram", "tf", (F.col("weight") / F.col("id.norm")).alias("tfidf"))

    def _weighted(self, texts: DataFrame, tasks: int) -> DataFrame:
        known = known_terms(texts, "id", "text", self.vocabulary.select("gram", "df", "idf"), self.n_min, self.n_max, tasks=tasks)
        return known.withColumn("weight", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))

    def shape(self, df: DataFrame) -> DataFrame:
        """(n_rows, n_features) of the matrix that `transform` describes."""
        rows = df.agg(F.count("*").alias("n_rows"))
        return rows.withColumn("n_features", F.lit(self.vocabulary.count()).cast("bigint"))


def numbered(vocabulary: DataFrame) -> DataFrame:
    """vocabulary with `position`: 0, 1, ... by falling total, then by gram. Staged.

    Rows are sorted over range partitions and numbered inside each; a partition's first number is the count of those
    before it, a table with one row per partition. Nothing but that passes one task, and nothing the driver.
    """
    order = [F.desc("total"), F.asc("gram")]
    tasks = max(1, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = vocabulary.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = stage_table(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    found = rows.withColumn("part", part).join(F.broadcast(checkpoint(starts)), "part")
    return stage_table(found.withColumn("position", F.col("start") + place).drop("__at", "part", "start"), "vocabulary")


def term_arrays(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX,
                size: int = None) -> DataFrame:
    """(id, indices, values): the normalised TF-IDF row of each text as arrays ordered by position; texts without a known gram have none.

    `vocabulary` has (gram, df, idf, position). The arrays of a row are as long as its text has known grams.
    """
    known = known_terms(df, id_col, text_col, vocabulary.select("gram", "df", "idf", "position"), n_min, n_max, size)
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    entry = F.struct(F.col("position").cast("int").alias("i"), weight.alias("v"))
    rows = known.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sqrt(F.sum(weight * weight)).alias("norm"))
    return rows.select("id", F.col("e.i").alias("indices"), F.transform("e.v", lambda v: v / F.col("norm")).alias("values"))


def term_places(df: DataFrame, vocabulary: DataFrame, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX, size: int = None) -> DataFrame:
    """(batch, position, idf, texts, tfs, head): the terms of (id, text, row, class, numbers) by batch of texts and gram, see `grams.per_place`.

    `vocabulary` has (gram, df, idf, position). Rows of a batch stay beside each other: where the vocabulary is broadcast no term is shuffled. Rows
    without an id have no terms.
    """
    columns = ["row", "class", "numbers"]
    text = analyzed(F.when(F.col("id").isNotNull(), F.col("text")))
    texts = df.repartition(measure(df, "text")[1], "id").select("id", text.alias("text"), *columns).sortWithinPartitions("id")
    places = texts.mapInArrow(grams.per_place(n_min, n_max, grams.BATCH), "batch bigint, gram string, texts binary, tfs binary, head binary")
    table = vocabulary.select("gram", "df", "idf", "position")
    size = lookup_bytes(table, "gram") if size is None else size
    known = lookup_join(places, table, "gram", "left", weight="df", size=size).select("batch", "position", "idf", "texts", "tfs", "head")
    known = known.filter("position IS NOT NULL OR head IS NOT NULL")
    return known if size <= BROADCAST_BYTES else known.repartition("batch").sortWithinPartitions("batch")


def term_scores(df: DataFrame, id_col: str, text_col: str, weights: DataFrame, classes: int, n_min: int = NGRAM_MIN,
                n_max: int = NGRAM_MAX, size: int = None) -> DataFrame:
    """(id, scores): per class the product of a text's TF-IDF row with the weights (gram, df, idf, weights) of a linear model.

    Neither vectors nor a dictionary are built: terms meet the weights in a join and are summed per text.
    """
    known = known_terms(df, id_col, text_col, weights.select("gram", "df", "idf", "weights"), n_min, n_max, size)
    value = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    sums = [F.sum(value * F.col("weights")[k]).alias(f"s{k}") for k in range(classes)]
    rows = known.groupBy("id").agg(F.sqrt(F.sum(value * value)).alias("norm"), *sums)
    return rows.select("id", F.array(*[F.col(f"s{k}") / F.col("norm") for k in range(classes)]).alias("scores"))


def fit_tfidf(df: DataFrame, id_col: str, text_col: str, max_features=None, min_df: int = MIN_DF,
              max_df: float = MAX_DF, n_min: int = NGRAM_MIN, n_max: int = NGRAM_MAX,
              rank_rows: int = RANK_ROWS) -> TfidfModel:
    """Fit vocabulary and smoothed idf. Every gram is kept unless `max_features` says otherwise.

    The fitted vocabulary is written to the shared folder: it is the only thing that
    later steps need, and they must all see the same one.
    """
    n_rows, tasks = measure(df, text_col)
    frequent = gram_frequencies(df, id_col, text_col, n_min, n_max, tasks=tasks).filter(
        (F.col("df") >= min_df) & (F.col("df") <= max_df * n_rows)
    )
    idf = F.log(F.lit(1.0 + n_rows) / (1 + F.col("df"))) + 1
    vocabulary = stage_table(frequent.withColumn("idf", idf), "vocabulary")
    return TfidfModel(most_frequent(vocabulary, max_features, rank_rows), n_rows, n_min, n_max)

"""Registered queries over cleaning, features, text, sampling and metrics."""

from pyspark.sql import functions as F

from ..functions.constants import DOMAIN_FEATURES, LEXICAL_FEATURES
from ..functions.groups import combine, domain_group, lexical_group
from ..functions.lexical import with_lexical_features
from ..functions.text import shannon_entropy
from ..functions.urls import normalize_url, with_url_parts
from ..operators import cleaning, metrics, sampling, scaling, tfidf
from ..operators.domains import SPLIT_COLUMNS, with_domain_features, with_domain_split
from ..sources.sinks import write_table
from ..sources.staging import new_path, stage_table
from ..sources.tables import null_tokens, preview, profile, read_csv, read_urls
from ..streaming.cleaning import first_labels, write_first_labels
from ..streaming.evaluation import match_labels, pairs_so_far, write_pair_counts
from ..streaming.scoring import read_url_stream, write_stream
from .inputs import (
    arriving_predictions, arriving_urls, DEEP_RULES, decorated_urls, LABEL_ARRIVALS, labelled_pages, raw_urls, rule_predictions, rules, special_urls,
    SPECIAL_RULES, table, URL_ARRIVALS,
)


def na_tokens(spark, sf):
    df = null_tokens(raw_urls(spark, sf))
    return df.agg(F.count("*").alias("n_rows"), F.count("url").alias("n_url"), F.count("type").alias("n_type"))


def normalize_urls(spark, sf):
    df = raw_urls(spark, sf)
    return df.select("row_id", normalize_url(F.col("url")).alias("url"))


def clean_urls(spark, sf):
    return cleaning.clean_urls(raw_urls(spark, sf))


def duplicates_removed(spark, sf):
    return cleaning.duplicates_removed(raw_urls(spark, sf))


def class_distribution(spark, sf):
    return metrics.class_distribution(clean_urls(spark, sf))


def class_percentages(spark, sf):
    return metrics.class_percentages(clean_urls(spark, sf))


def distinct_labels(spark, sf):
    return metrics.distinct_labels(clean_urls(spark, sf))


def dataset_profile(spark, sf):
    return profile(raw_urls(spark, sf))


def preview_head(spark, sf):
    return preview(clean_urls(spark, sf))


def csv_source(spark, sf):
    """Raw rows written as CSV, read back through the CSV source, and cleaned."""
    df = raw_urls(spark, sf)
    path = write_table(df.select("url", "type", "row_id"), new_path(spark, "raw"), "csv")
    source = read_urls(spark, path)
    return cleaning.clean_urls(source.withColumn("row_id", F.col("row_id").cast("bigint"))).select("row_id", "url", "type")


def csv_line_breaks(spark, sf):
    """Pages with their HTML, one line per tag, written as CSV and read back by the split reader."""
    html = F.replace("html", F.lit(">"), F.lit(">\n"))
    path = write_table(table(spark, sf, "pages").select("page_id", "url", html.alias("html")), new_path(spark, "pages"), "csv")
    df = read_csv(spark, path)
    return df.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html_md5"))


def url_parts(spark, sf):
    df = with_url_parts(decorated_urls(spark, sf))
    return df.select("row_id", "scheme", "host", "path", "query", "fragment", "has_port", "has_ip")


def lexical_features(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return with_lexical_features(pages).select("page_id", *LEXICAL_FEATURES)


def lexical_features_decorated(spark, sf):
    return with_lexical_features(decorated_urls(spark, sf)).select("row_id", *LEXICAL_FEATURES)


def lexical_by_host(spark, sf):
    """The flagship: average of every lexical feature per host."""
    pages = table(spark, sf, "pages").select("url")
    hosts = with_url_parts(pages.select(normalize_url(F.col("url")).alias("url"))).select("url", "host")
    rows = with_lexical_features(hosts)
    return rows.groupBy("host").agg(
        F.count("*").alias("n_urls"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in LEXICAL_FEATURES]
    )


def feature_selection(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return with_lexical_features(pages, columns=lexical_group("all_minus_redundant")).drop("url")


def _hosts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))
    return with_url_parts(pages).select("page_id", "host", "has_ip")


def domain_split(spark, sf):
    return with_domain_split(_hosts(spark, sf), rules(spark), "host", "has_ip").select("page_id", *SPLIT_COLUMNS)


def domain_split_deep_rules(spark, sf):
    df = with_domain_split(_hosts(spark, sf), rules(spark, DEEP_RULES), "host", "has_ip")
    return df.select("page_id", *SPLIT_COLUMNS)


def domain_features(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    df = with_domain_features(pages, rules(spark, DEEP_RULES)).drop("url")
    return df.withColumns({c: F.round(c, 6) for c in ("domain_digit_ratio", "domain_hyphens_ratio")})


def domain_features_decorated(spark, sf):
    df = with_domain_features(decorated_urls(spark, sf), rules(spark)).drop("url")
    return df.withColumns({c: F.round(c, 6) for c in ("domain_digit_ratio", "domain_hyphens_ratio")})


def domain_features_special(spark, sf):
    """Hosts on which the four yes/no domain features take both values."""
    df = with_domain_features(special_urls(spark, sf), rules(spark, SPECIAL_RULES)).drop("url")
    return df.withColumns({c: F.round(c, 6) for c in ("domain_digit_ratio", "domain_hyphens_ratio")})


def high_entropy_domains(spark, sf):
    split = with_domain_split(_hosts(spark, sf), rules(spark, DEEP_RULES), "host", "has_ip")
    counts = split.groupBy("domain").agg(F.count("*").alias("n_urls"))
    entropy = F.round(shannon_entropy(F.col("domain")), 4)
    return counts.withColumn("entropy", entropy).filter("entropy > 2.5").orderBy(F.desc("entropy"), "domain")


def combined_features(spark, sf):
    """Lexical and domain features side by side; the domain `num_subdomains` wins."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    lexical = [c for c in lexical_group("all") if c in combine(lexical_group("all"), domain_group("all"))]
    lexical = [c for c in lexical if c not in DOMAIN_FEATURES]
    df = with_domain_features(with_lexical_features(pages, columns=lexical), rules(spark))
    df = df.select("page_id", *combine(lexical, domain_group("all")))
    return df.withColumns({c: F.round(c, 6) for c in ("domain_digit_ratio", "domain_hyphens_ratio")})


def text_entropy(spark, sf):
    rows = tfidf.text_entropy(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), F.round("entropy", 4).alias("entropy"))


def char_ngrams(spark, sf):
    return tfidf.char_terms(table(spark, sf, "pages"), "page_id", "url").withColumnRenamed("id", "page_id")


def document_ngrams(spark, sf):
    terms = tfidf.char_terms(table(spark, sf, "documents"), "doc_id", "text")
    return terms.groupBy(F.col("id").alias("doc_id")).agg(
        F.count("*").alias("n_grams"), F.sum("tf").alias("n_occurrences"), F.max("tf").alias("max_tf")
    )


def _vocabulary(model):
    return model.vocabulary.select("gram", "df", "total", F.round("idf", 6).alias("idf"))


def vocabulary(spark, sf):
    return _vocabulary(tfidf.fit_tfidf(table(spark, sf, "pages"), "page_id", "url", max_features=None))


def vocabulary_capped(spark, sf):
    return _vocabulary(tfidf.fit_tfidf(table(spark, sf, "pages"), "page_id", "url", max_features=500))


def document_vocabulary(spark, sf):
    return _vocabulary(tfidf.fit_tfidf(table(spark, sf, "documents"), "doc_id", "text"))


def char_tfidf(spark, sf):
    pages = table(spark, sf, "pages")
    rows = tfidf.fit_tfidf(pages, "page_id", "url").transform(pages, "page_id", "url")
    return rows.select(F.col("id").alias("page_id"), "gram", "tf", F.round("tfidf", 6).alias("tfidf"))


def document_tfidf(spark, sf):
    """Per document: known grams, sum and largest value of its unit-length vector."""
    docs = table(spark, sf, "documents")
    rows = tfidf.fit_tfidf(docs, "doc_id", "text").transform(docs, "doc_id", "text")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(
        F.count("*").alias("n_known"), F.round(F.sum("tfidf"), 4).alias("sum_tfidf"),
        F.round(F.max("tfidf"), 6).alias("max_tfidf"),
    )


def _page_split(spark, sf):
    return stage_table(sampling.stratified_split(labelled_pages(spark, sf)), "split")


def tfidf_train_test(spark, sf):
    """Fitted on the training part, applied to the test part."""
    df = _page_split(spark, sf)
    model = tfidf.fit_tfidf(df.filter("split = 'train'"), "row_id", "url")
    rows = model.transform(df.filter("split = 'test'"), "row_id", "url")
    return rows.select(F.col("id").alias("row_id"), "gram", F.round("tfidf", 6).alias("tfidf"))


def tfidf_shapes(spark, sf):
    df = _page_split(spark, sf)
    model = tfidf.fit_tfidf(df.filter("split = 'train'"), "row_id", "url")
    parts = [
        model.shape(df.filter(F.col("split") == part)).withColumn("split", F.lit(part)) for part in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


def uniform_sample(spark, sf):
    return sampling.uniform_sample(labelled_pages(spark, sf), 40)


def stratified_sample(spark, sf):
    return sampling.stratified_sample(labelled_pages(spark, sf), 40)


def stratified_split(spark, sf):
    return sampling.stratified_split(stage_table(clean_urls(spark, sf), "clean"))


def standardized_features(spark, sf):
    """Fitted on the training part, applied to all rows."""
    split = sampling.stratified_split(labelled_pages(spark, sf))
    df = stage_table(with_lexical_features(split), "lexical")
    scaled = scaling.fit_standardizer(df.filter("split = 'train'"), LEXICAL_FEATURES).transform(df)
    return scaled.select("row_id", "split", *[F.round(c, 5).alias(c) for c in LEXICAL_FEATURES])


def class_weights(spark, sf):
    weights = scaling.class_weights(clean_urls(spark, sf))
    return weights.withColumn("weight", F.round("weight", 6))


def weighted_rows(spark, sf):
    return scaling.with_class_weights(labelled_pages(spark, sf)).select("row_id", "type", F.round("weight", 6).alias("weight"))


def _pairs(spark, sf):
    return metrics.pair_counts(rule_predictions(spark, sf))


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_pairs(spark, sf))


def confusion_table(spark, sf):
    return metrics.confusion_table(_pairs(spark, sf), ["de", "en", "es", "fr"])


def classification_report(spark, sf):
    return metrics.classification_report(_pairs(spark, sf))


def summary_metrics(spark, sf):
    row = metrics.summary_metrics(_pairs(spark, sf))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def document_label_metrics(spark, sf):
    """Report of a length rule against the given `quality` labels of documents."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    guess = F.when(F.col("n_chars") >= 1000, 1).otherwise(0).cast("string")
    rows = labels.join(docs, "doc_id").select(F.col("quality").cast("string").alias("actual"), guess.alias("predicted"))
    return metrics.classification_report(metrics.pair_counts(rows))


def _experiments(spark, sf):
    """Three fixed guesses of the page class, each an experiment with its metrics."""
    df = labelled_pages(spark, sf)
    guesses = {
        "tfidf_only": F.col("type"),
        "by_scheme": F.when(F.col("url").startswith("https://"), "en").otherwise("fr"),
        "by_query": F.when(F.contains("url", F.lit("?")), "de").otherwise("en"),
    }
    rows = None
    for position, (name, guess) in enumerate(guesses.items()):
        pairs = metrics.pair_counts(df.select(F.col("type").alias("actual"), guess.alias("predicted")))
        row = metrics.summary_metrics(pairs).select(
            F.lit(position).alias("position"), F.lit(name).alias("experiment"), "accuracy", "macro_f1", "weighted_f1"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "weighted_f1")})


def experiment_summary(spark, sf):
    return _rounded(_experiments(spark, sf))


def best_experiment(spark, sf):
    return _rounded(metrics.best_experiment(_experiments(spark, sf)))


def best_hybrid_experiment(spark, sf):
    return _rounded(metrics.best_experiment(_experiments(spark, sf), exclude=["tfidf_only"]))


def metrics_csv_sink(spark, sf):
    """The experiment summary written as CSV with header, and read back."""
    path = write_table(experiment_summary(spark, sf), new_path(spark, "metrics"), "csv")
    schema = "position int, experiment string, accuracy double, macro_f1 double, weighted_f1 double"
    return spark.read.schema(schema).option("header", True).csv(path)


def stream_features(spark, sf):
    """Pages as a stream: features are computed batch by batch and appended to files."""
    schema = table(spark, sf, "pages").schema
    stream = read_url_stream(spark, f"{sf}/page[s].parquet", schema).select("page_id", "url")
    out = new_path(spark, "stream")
    query = write_stream(
        with_lexical_features(stream).drop("url"), out, new_path(spark, "stream-checkpoint"), available_now=True
    )
    query.awaitTermination()
    return spark.read.parquet(out).select("page_id", *LEXICAL_FEATURES)


def stream_domain_features(spark, sf):
    """The suffix rules joined to a stream as a static table."""
    schema = table(spark, sf, "pages").schema
    stream = read_url_stream(spark, f"{sf}/page[s].parquet", schema).select("page_id", "url")
    out = new_path(spark, "stream")
    df = with_domain_features(stream, rules(spark, DEEP_RULES)).drop("url")
    df = df.withColumns({c: F.round(c, 6) for c in ("domain_digit_ratio", "domain_hyphens_ratio")})
    write_stream(df, out, new_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(out)


def _stream_first_labels(spark, sf, **options):
    """The arrivals of raw URLs through `first_labels`, the stream being started anew from its checkpoint for each."""
    arrivals, source = arriving_urls(spark, sf), new_path(spark, "arrivals")
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    for number in range(URL_ARRIVALS):
        rows = arrivals.filter(F.col("arrival") == number).drop("arrival")
        rows.write.mode("append").parquet(source)
        labels = first_labels(read_url_stream(spark, source, rows.schema), **options)
        write_first_labels(labels, out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("row_id", "url", "type")


def stream_first_labels(spark, sf):
    """Raw URLs cleaned as a stream in four arrivals: the first label of a URL wins."""
    return _stream_first_labels(spark, sf)


def stream_first_labels_by_period(spark, sf):
    """The same, but a URL is let through once in two days of event time."""
    return _stream_first_labels(spark, sf, event_time="seen_at", period="2 days", delay="1 hour")


def stream_late_labels(spark, sf):
    """Classification report of a stream of predictions whose labels come as another stream, for labels given within an hour."""
    rows, sources = arriving_predictions(spark, sf), [new_path(spark, "predictions"), new_path(spark, "labels")]
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    for number in range(LABEL_ARRIVALS):
        parts = [rows.filter(F.col("arrival") == number).select("row_id", "predicted", "predicted_at"),
                 rows.filter(F.col("arrival") == number - 1).select("row_id", "actual", "labelled_at")]
        for part, source in zip(parts, sources):
            part.write.mode("append").parquet(source)
        streams = [read_url_stream(spark, source, part.schema) for part, source in zip(parts, sources)]
        matched = match_labels(*streams, wait="1 hour", delay="3 hours")
        write_pair_counts(matched, out, checkpoint, available_now=True).awaitTermination()
    return metrics.classification_report(pairs_so_far(spark, out))


QUERIES = {f.__name__: f for f in (
    lexical_features, lexical_features_decorated, lexical_by_host, url_parts, feature_selection,
    na_tokens, normalize_urls, clean_urls, duplicates_removed, class_distribution, class_percentages,
    distinct_labels, dataset_profile, preview_head, csv_source, csv_line_breaks,
    domain_split, domain_split_deep_rules, domain_features, domain_features_decorated, domain_features_special, high_entropy_domains,
    combined_features, text_entropy,
    char_ngrams, document_ngrams, vocabulary, vocabulary_capped, document_vocabulary, char_tfidf, document_tfidf,
    tfidf_train_test, tfidf_shapes,
    uniform_sample, stratified_sample, stratified_split, standardized_features, class_weights, weighted_rows,
    confusion_matrix, confusion_table, classification_report, summary_metrics, document_label_metrics,
    experiment_summary, best_experiment, best_hybrid_experiment, metrics_csv_sink,
    stream_features, stream_domain_features, stream_first_labels, stream_first_labels_by_period, stream_late_labels,
)}

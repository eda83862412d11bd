"""Operators on rows with nulls, empty and long texts, ties, repeated rows and clashing names, and on empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import differences, duckdb_views
from riskloom.llm import bpe, chat_format, components, exact_dedup, language_id, line_dedup, mixing, permutation_index, pii, secret_scan, signature_join

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mixture", "op4_line_dedup", "op5_exact_dedup"])
def test_query_equals_its_twin(spark, name):
    assert differences(entry.queries()[name](spark, SF), duckdb_views(SF), entry.oracle_sql()[name]) == []


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_bpe(spark, odd, none):
    codec = bpe.default_codec(spark)
    out = bpe.decode_ids(bpe.encode_texts(odd, codec), codec)
    assert all((r["text"] or "") == bytes(r["decoded"]).decode() for r in out.select("text", "decoded").collect())
    assert set(out.columns) == {*odd.columns, "decoded"} and bpe.encode_texts(none, codec).count() == 0


def test_exact_dedup(odd, none):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (10, 11, 2, False), (11, 11, 2, True), (4, 4, 3, True), (3, 4, 3, False)} <= found
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8, 9, 11, 12, 13, 14]
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.keep_one(none).count() == 0


def test_equal_digests_of_different_texts_stay_apart(odd, monkeypatch):
    same = odd.filter("doc_id in (1, 2, 10, 11)").select("doc_id", "text", F.lit("d").alias("digest"))
    rows = exact_dedup.rows_by_content(same, same.select(exact_dedup.digest_of(F.col("text")).alias("digest")).distinct())
    assert sorted((r["doc_id"], r["keep_id"]) for r in rows.collect()) == [(1, 2), (2, 2), (10, 11), (11, 11)]


def test_mixing(odd, none):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count() and all(r["copies"] <= 2 for r in plan)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.plan_mix(none).count() == mixing.mix_documents(none).count() == 0


def test_secrets_and_personal_data(odd, none):
    found = {r["doc_id"]: r for r in secret_scan.find_secrets(odd).collect() if r["kinds"]}
    assert {k: r["kinds"] for k, r in found.items()} == {13: ["assign", "access", "hex"]}
    spans = {r["doc_id"]: r["kinds"] for r in pii.find_personal(odd).collect() if r["kinds"]}
    assert spans == {12: ["email", "ip", "card", "phone"]}
    assert secret_scan.find_secrets(none).count() == pii.find_personal(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"alpha beta {'zorro quux' if i < 4 else ''} {'x@y.org' if i < 4 else ''}") for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].split() == ["alpha", "beta", "[...]", "[...]", "[email]"] and out[9].split() == ["alpha", "beta"]


def test_partly_disclosing_short_and_mixed_terms(spark):
    rows = [(i, f"plain text {'Li jd42 E1234 Zorro a@b.org' if i < 9 else ''} {'Quux' if i < 10 else ''}") for i in range(200)]
    rows[3] = (3, "plain text Li jd42 E1234 Zorro7 Quux a@b.org")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].split() == ["plain", "text", *["[...]"] * 4, "[email]", "Aaaa"] and out[9].split() == ["plain", "text", "Aaaa"]
    assert out[3].split() == ["plain", "text", *["[...]"] * 3, "[...]7", "Aaaa", "[email]"] and out[10].split() == ["plain", "text"]


def test_terms_are_found_where_they_are_counted(spark):
    texts = ["Ab1 1ab 22 x ½abc x² İstanbul ΟΔΟΣ \U00010400\U00010401 你好3 a_b9 it's 123abc456 " + "q" * 50000 + " " + "7" * 50000 + "z", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", pii.terms_of(F.col("text")).alias("terms")).collect()
    for text, terms in rows:
        spans = pii.term_spans(text, dict.fromkeys(terms, "hint"), [])
        inside = {m[0].lower() for m in pii._LETTERS.finditer(text)}
        assert {text[a:b].lower() for _, a, b in spans} | inside == set(terms)
    assert {"ab1", "1ab", "ab", "abc", "istanbul".replace("i", "i\u0307", 1), "οδος", "你好3", "b9", "it", "123abc456"} <= set(rows[0].terms)
    assert not {"22", "x", "a", "s", ""} & set(rows[0].terms)


def test_line_dedup(spark):
    rows = [(i, "http://A.com/x", f"<p>menu</p><p>text <b>{i}</b></p>menu<br>foot {i % 2}", 1) for i in range(10)]
    rows += [(20, "http://b.com", "<p>menu</p>", 1), (21, None, "menu", 1), (22, "http://a.com:80/", None, 1), (None, "http://a.com", "", 1), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt int")
    got = sorted(((r["page_id"], r["kept"]) for r in line_dedup.drop_boilerplate(pages).collect()), key=str)
    assert got == sorted([(i, [f"text {i}"]) for i in [*range(10), 0]] + [(20, ["menu"]), (21, ["menu"]), (22, []), (None, [])], key=str)
    assert line_dedup.drop_boilerplate(pages.filter("false")).count() == 0


def test_near_duplicates(odd, none):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in signature_join.near_duplicates(odd).drop("mark").collect()}
    assert {(8, 96, 8), (9, 97, 8), (3, 0, 3), (4, 0, 4), (5, 0, 5), (1, 1, 1), (2, 1, 1), (None, 1, 1), (10, 1, 10), (11, 1, 10)} <= found
    kept = signature_join.one_of_each(odd)
    assert kept.columns == odd.columns and sum(r["doc_id"] in (8, 9) for r in kept.collect()) == 1
    assert signature_join.near_duplicates(none).count() == 0


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "BLOCK_NODES", 3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:59] + [f"v{i}"])) for i in range(20)] + [(100 + i, " ".join(words[:30] + [f"u{i}x{j}" for j in range(30)])) for i in range(5)]
    found = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 0 if i < 100 else i for i, _ in rows}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60)], "a long, b long")
    assert {r["id"]: r["component"] for r in components.components(links).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(language_id.learned_rows(docs))
    held = language_id.label_languages(docs, model).join(docs, "doc_id").filter(language_id.held_out(F.col("doc_id")))
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    found = [(r["lang_pred"], r["score"]) for r in language_id.label_languages(odd.filter("text is null or trim(text) = ''"), model).collect()]
    assert found == [("und", 0.0)] * 4 and language_id.label_languages(none, model).count() == 0
    kept = language_id.with_language(odd, model, lambda lang, score: lang != "und")
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_language_of_texts_with_nul_and_without_labels(spark):
    rows = [(i, f"a\0b c\0\0 wo\0rd {i}", "en" if i % 2 else "de") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = language_id.label_languages(docs, language_id.fit(docs)).collect()
    assert len(labelled) == 8 and {r["lang_pred"] for r in labelled} <= {"de", "en"}
    unlabelled = language_id.label_languages(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert [(r["lang_pred"], r["score"], r["span_langs"]) for r in unlabelled] == [("und", 0.0, [])] * 8


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 1.0]),
            (64, [float("nan"), 1.0, 1.0]), (65, [1.0]), (None, [1.0, 1.0, 1.0]), (0, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r["query_id"], r["vec_id"]) for r in permutation_index.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert len(found) == 10 and found[0] == (0, 35)
    few = permutation_index.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2 and permutation_index.nearest(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("noise", [0.001, 0.1])
def test_recall_with_many_near_copies(spark, noise):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2000, 64))
    copies = rng.random(2000) < 1 / 3
    v[copies] = v[0] / np.linalg.norm(v[0]) + noise / 8 * rng.normal(size=(copies.sum(), 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in permutation_index.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit, hits = v / np.linalg.norm(v, axis=1, keepdims=True), {True: [], False: []}
    for q in range(0, 2000, 10):
        best = [i for i in np.argsort(-(unit @ unit[q]), kind="stable")[:6].tolist() if i != q][:5]
        hits[bool(copies[q])].append(len(got[q] & set(best)) / 5)
    assert np.mean(hits[False]) >= 0.93 and np.mean(hits[True]) >= 0.93, {k: np.mean(x) for k, x in hits.items()}


def test_chat(spark, none):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None),
                                   (2, 5, "tool", "</s>")], "conv_id long, turn long, role string, text string")
    codec = chat_format.default_codec(spark)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_format.read_back(chat_format.format_turns(turns, codec), codec).collect()}
    said = {1: "user\na\nassistant\n\nassistant\n\n", None: "\n\n", 2: "tool\n</s>\n"}
    assert got == {k: (3 if k == 1 else 1, hashlib.sha256(v.encode()).hexdigest()) for k, v in said.items()}
    assert chat_format.read_back(chat_format.format_turns(turns.filter("false"), codec), codec).count() == 0


def test_turns_are_encoded_before_they_meet(spark):
    rows = [(1, i // 2, ("user", "assistant", "tool", None)[i % 4], f"turn {i} </s> \\ {'x' * (i % 7)}") for i in range(200)]
    rows += [(2, 0, "user", "b"), (2, 0, "user", "a"), (None, None, None, None)]
    codec = chat_format.default_codec(spark)
    out = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), codec)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("MapInArrow") > plan.index("RepartitionByExpression [conv_id")
    expected, ends = [], {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        made, (place, offset) = chat_format.assemble(role or "", text or "", codec.get()), ends.get(c, (0, 0))
        expected.append((c, t, *made, place, offset))
        ends[c] = place + 1, offset + len(made[1])
    got = [(r[0], r[1], bytes(r[2]), bytes(r[3]), *r[4:]) for r in out.collect()]
    assert sorted(got, key=lambda r: (r[0] or 0, r[5])) == expected


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_duplicates", "mixture", "byte_bpe"]
    out = corpus_pipeline.run(spark, SF).select("doc_id", "decoded_sha256").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out and all(hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"] for r in out)
    assert len({texts[r["doc_id"]].lower() for r in out}) == len({r["doc_id"] for r in out})

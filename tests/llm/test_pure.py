"""Parts that need no Spark, against brute force."""

import random
import re
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskloom.llm import bpe, chat_format, language_id, permutation_index, pii, secret_scan, signature_join

RANKS = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Bpe(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abct'sre  \n\t .,-0123é \x1c\x85中\U0001f642S") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "é" * 3000, "the" * 4000 + "x", " \n" * 300, "A" * 70000 + " " + "b c " * 20000]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(20000))]
    for text in texts:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_texts_in_any_order(codec):
    run, words = "A" * 40000, "word " * 20000
    for text in ("word " * 1200 + run, words + run, run + words, words + run + " x", "\n" + words + run * 2 + words, run * 2, " " * 70000 + run):
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids) == text.encode() and "".join(codec.leaves(text)) == text
        assert len(list(codec.leaves(text))) <= len(text) // bpe.TEXT_LEAF + 1


def test_every_rank_encodes_to_itself(codec):
    """What the proof of `join` needs of a vocabulary."""
    assert all(codec.piece(b) == [i] for b, i in RANKS.items())


def test_chat_round_trip(codec):
    rng = random.Random(2)
    parts = ["\\", "\\:", ":", "<s>", "</s>", "[INST]", "[/INST]", "<|end|>", "x", " ", "\n", "<", "s>"]
    for role in ("user", "assistant", "system", "", "tool</s>"):
        for _ in range(200):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            ids, mask, plain = chat_format.assemble(role, text, codec)
            assert chat_format.read_turn(ids, mask, codec)[:2] == (role, text)
            loss = chat_format.read_turn(ids, mask, codec)[2]
            assert (loss == text) if role == "assistant" else not loss
            assert not chat_format._CONTROL.search(chat_format.escape(text))


def test_trigram_queries_never_lose_a_match():
    rng = random.Random(3)
    parts = ['password', 'PassWD', 'api_key', 'APIKEY', ' = ', ':', '"', "'", 'abcdefgh12', 'AKIA', 'ABCDEFGHIJKL', 'ghp_', 'a' * 36, 'deadbeef' * 4,
             '-----BEGIN RSA PRIVATE KEY-----', 'eyJ', '.', 'xoxb-', 'AIza', 'Z' * 35, 'ſ', 'K', ' ', 'secret', 'token']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(500)]
    queries = [secret_scan.trigram_query(p) for _, p, _ in secret_scan.RULES]
    assert [q is True for q in queries] == [kind == "hex" for kind, _, _ in secret_scan.RULES]
    got = secret_scan.scan_segment(texts, secret_scan.RULES, queries)
    for text, spans in zip(texts, got):
        every = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(secret_scan.RULES) for m in re.finditer(p, text) if ok is None or ok(m)]
        assert spans == [(k, a, b) for a, _, k, b in sorted(every)]


def test_base_patterns_of_personal_data():
    rng = random.Random(4)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, text):
        digits = [int(c) for c in text if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in text.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and (sum(digits[::-1][::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::-1][1::2])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    parts = ["a.b", "@", "c.de", "_w", ".", " ", "+49", "(30)", "-", "1234", "5678", "4111111111111111", "10.0.0.1", "999.1.1.1", "٣", "x" * 5000]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        expected = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert pii.base_spans(text) == expected


def test_odd_texts_take_time_in_proportion():
    texts = ["1" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + " " + "b" * 5000 + "@x.org", "a" * 1_000_000 + "@x.org", "a.b@" * 250_000,
             "x @" * 300_000, "+1" + "(" * 1_000_000, "+1" * 500_000, "4111-" * 200_000, "eyJ" * 333_000 + ".eyJ", "eyJ" * 333_000,
             ("eyJ" * 3000 + ".") * 100, "eyJabcdefgh.eyJ" * 60_000, "AKIA" * 250_000, "token" * 200_000, "0a" * 500_000, "gho_" * 250_000]
    queries = [secret_scan.trigram_query(p) for _, p, _ in secret_scan.RULES]
    for text in texts:
        start = time.process_time()
        pii.base_spans(text)
        secret_scan.scan_segment([text], secret_scan.RULES, queries)
        assert time.process_time() - start < 4, text[:20]
    found = pii.base_spans("a" * 100_000 + " " + "b" * 5000 + "@x.org")
    assert found == [("email", 100_001, 105_007)]


def test_web_tokens_are_the_matches_of_the_rule():
    rng = random.Random(8)
    parts = ["eyJ", "abcdefgh", ".", ".eyJ", "eyJabcdefgh", ".eyJabcdefgh", ".abcdefgh", " ", "-", "é", "x"]
    pattern = next(p for k, p, _ in secret_scan.RULES if k == "jwt")
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        expected = [m.span() for m in re.finditer(pattern, text)]
        hits += len(expected)
        assert [m.span() for m in secret_scan.web_tokens(text)] == expected
    assert hits > 100


def test_addresses_with_thousands_of_zeros():
    for text, found in (("0" * 5000 + ".0.0.1", True), ("1.2.3." + "0" * 5000 + "255", True), ("1.2.3." + "0" * 5000 + "256", False), ("1" * 5000 + ".0.0.1", False)):
        assert [x for x in pii.base_spans(text) if x[0] == "ip"] == [("ip", 0, len(text))] * found


def test_short_cut_of_the_language_path_is_exact():
    rng = np.random.default_rng(5)
    model = language_id.Model({(lang, 0, i): 1 for i, lang in enumerate("abc")} | {(lang, 1, 1): 1 for lang in "abc"})
    for _ in range(300):
        n = int(rng.integers(1, 30))
        scores, letters = rng.normal(0, 4, (n, 3)), rng.integers(1, 5, n)
        states = language_id.viterbi(scores, language_id.PENALTY)
        by = np.bincount(states, letters, 3)
        lang, score, spans = model.path(scores, letters)
        assert (lang, round(score, 9)) == ("abc"[by.argmax()], round(by.max() / letters.sum(), 9))
        assert "".join(x * (b - a) for x, a, b in spans) == "".join("abc"[s] for s in states)


def test_letters_of_words_that_hold_nul():
    words = ["a\0b", "\0", "Straße", "\0\0x\0", "ΟΔΟΣ", "İ", "12", "да"]
    bucket, owner, letters, script = language_id.features(words)
    alone = [language_id.features([w]) for w in words]
    assert letters.tolist() == [2, 0, 6, 1, 4, 1, 0, 2] and owner.tolist() == np.repeat(np.arange(8), letters).tolist()
    assert bucket.tolist() == [x for a in alone for x in a[0].tolist()] and script.tolist() == [int(a[3][0]) for a in alone]
    model = language_id.Model({(lang, kind, 1): 1 for lang in "ab" for kind in (0, 1)})
    assert [x[0] for x in model.label(["one \0 t\0w\0o", "\0"])] == ["a", "und"]


def test_model_without_languages():
    assert language_id.Model({}).label(["some words", "", "x"]) == [("und", 0.0, [])] * 3


def test_signature_tree_connects_what_brute_force_connects():
    rng = np.random.default_rng(6)
    for percent in (80, 85):
        sets = []
        for _ in range(12):
            base = rng.integers(0, 1 << 62, rng.integers(1, 80)).astype(np.uint64)
            for _ in range(rng.integers(1, 12)):
                copy = base.copy()
                copy[rng.integers(0, len(copy), len(copy) // 8)] = rng.integers(0, 1 << 62, len(copy) // 8)
                sets.append(np.unique(copy))
        sets.sort(key=lambda s: (len(s), s[0]))

        def groups(links):
            label = list(range(len(sets)))
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        every = []
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    every.append((a, b))
        found = signature_join.SignatureTree(sets, percent).forest(np.arange(len(sets)))
        assert groups(found) == groups(every) and len(found) <= len(every)


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(7)
    vectors, pivots = rng.normal(size=(400, 8)), rng.normal(size=(20, 8))
    unit, near = permutation_index.directions(vectors), None
    near = np.argsort(-(unit @ permutation_index.directions(pivots).T), axis=1)[:, :10].astype("<u2")
    segment = permutation_index.Segment(np.arange(400), [x.tobytes() for x in near], [v.astype("<f8").tobytes() for v in vectors], 20)
    place = np.full((400, 20), 10)
    place[np.arange(400)[:, None], near] = np.arange(10)
    distance = np.abs(place - place[7]).sum(axis=1)
    distance[7] = 10 ** 6
    ranked = set(np.lexsort((np.arange(400), distance))[:permutation_index.LEAST].tolist())
    cosine = unit @ unit[7]
    best = sorted(ranked, key=lambda i: (-cosine[i], i))[:5]
    assert segment.nearest(7, near[7], unit[7], 5)[0] == best

"""Spelling variants, packing and tokenizer alignment against plain Python, by their registered queries and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers

from riskloom.llm import packing, queries, spelling, token_alignment

SF = "/root/testdata/sf0.001"
DOCUMENTS = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
BYTE_BPE = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


# spelling variants -------------------------------------------------------------------------------


def spelled(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            if less in counts:
                near[w].add(less)
                near[less].add(w)
            holes[w[:i], w[i + 1:]].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 5 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()]


@pytest.mark.parametrize("block", [None, 30])
def test_spelling_variants(spark, monkeypatch, block):
    """The query, with blocks of whole lengths, and with many small blocks and parts of them."""
    if block:
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "CLASSES", (1, 3))
    found = queries.QUERIES["op11_spelling_variants"](spark, SF)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = spelled(DOCUMENTS)
    assert any(r[1] for r in want) and ordered(found.collect()) == ordered(want)


def test_spelling_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(i, "Straßen straßen STRAßEN strassen Öffnung öffnung sträßen x" * (i % 3)) for i in range(40)], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    assert ordered(spelling.variants(df).collect()) == ordered(spelled(pairs_of(df)))
    assert spelling.variants(none).count() == 0


def test_edits_and_roots(spark):
    words = ["abcdef", "abcdeg", "abcdefg", "bacdef", "abcde", "abxdef", "fbcdea", "abcdfe"]
    for a in words:
        for b in words:
            if 0 <= len(b) - len(a) <= 1:
                got = [(int(i), int(j)) for x in spelling.near_pairs(spelling.code_points([a]), spelling.code_points([b])) for i, j in zip(*x)]
                inserted = len(b) > len(a) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
                replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
                assert bool(got) == (inserted or replaced)
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "b")], "word string, form string")
    assert dict(spelling.roots(chain).collect()) == {f"w{i}": "w13" for i in range(13)} | {"a": "b"}


def test_long_runs():
    text = "a" * 600_000 + " B" + "x y" * 200_000
    assert spelling.runs(text) == Counter(re.findall("[a-z]+", text.lower()))


# packing -----------------------------------------------------------------------------------------


def ids_of(text, length=2048):
    ids = BYTE_BPE.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % length or length
    cuts = [0, *range(first, len(ids) + 1, length)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_packing(found, rows, length=2048):
    assert ordered(r[:5] for r in found) == ordered((doc_id, *piece) for doc_id, text in rows for piece in ids_of(text, length))
    sequences = defaultdict(list)
    for _, _, _, size, _, sequence, offset in found:
        sequences[sequence].append((offset, size))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= length
    return len(sequences)


def plain_best_fit(sizes, length):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(length - size)
    return len(rooms)


def test_packing_query(spark):
    found = queries.QUERIES["op12_best_fit_packing"](spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    assert check_packing(rows, DOCUMENTS) == plain_best_fit([r["length"] for r in rows], 2048)


def test_packing_of_odd_rows(spark, odd, none):
    codec = packing.default_codec(spark)
    texts = ["<|endoftext|>", "a <|endoftext|>  b", "x" * 5000, "    \x1c\x85 's 'S", "word " * 20000, "你" * 3000]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    check_packing(packing.pack_documents(df, codec, length=64).collect(), pairs_of(df), 64)
    assert packing.pack_documents(none, codec).count() == 0


def test_half_full_sequences_are_packed_again(spark, monkeypatch):
    sizes = [random.Random(3).randint(1, 40) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    monkeypatch.setattr(packing, "TASK_PIECES", 10)
    places = {r["row"]: (r["sequence_id"], r["offset"]) for r in packing.pack(items, 200).collect()}
    held = defaultdict(list)
    for row, (sequence, offset) in places.items():
        held[sequence].append((offset, sizes[row]))
    for x in held.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(x[-1]) <= 200
    assert len(places) == 600 and sum(sum(n for _, n in x) <= 100 for x in held.values()) <= 1


def test_best_fit_of_random_sizes():
    rng = random.Random(1)
    for length in (1, 7, 64, 2048):
        sizes = sorted((rng.randint(1, length) for _ in range(500)), reverse=True)
        sequence, offset = packing.best_fit(sizes, length)
        assert max(sequence) + 1 == plain_best_fit(sizes, length)
        assert len(set(zip(sequence, offset))) == len(sizes)


# tokenizer alignment -----------------------------------------------------------------------------


def aligned(rows):
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters = {c: b for b, c in (printable | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}).items()}
    held, found = Counter(), []
    for doc_id, text in rows:
        row = (0, 0, 0, 0, "", [])
        if text:
            a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            of_a = [bytes(letters[c] for c in plain.id_to_token(i)) for i in a]
            of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
            if b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
                links, groups, x, y, end_a, end_b = [], [([], [])], 0, 0, 0, 0
                while x < len(a):
                    links.append((a[x], b[y]))
                    next_a, next_b = end_a + len(of_a[x]), end_b + len(of_b[y])
                    if next_a <= next_b:
                        groups[-1][0].append(a[x])
                        x, end_a = x + 1, next_a
                    if next_b <= next_a:
                        groups[-1][1].append(b[y])
                        y, end_b = y + 1, next_b
                    if next_a == next_b:
                        groups.append(([], []))
                digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups[:-1])
                row = (len(a), len(b), len(groups) - 1, len(links), hashlib.sha256(digest.encode()).hexdigest(), links)
                held.update(set(links))
        found.append((doc_id, row))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(i, *r[:4], sum(held[x] == best[x[0]] for x in r[5]), sum(held[x] for x in r[5]), r[4]) for i, r in found]


@pytest.mark.parametrize("joined", ["broadcast", "shuffled"])
def test_alignment_query(spark, monkeypatch, joined):
    if joined == "shuffled":
        from riskloom.llm import common

        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(token_alignment, "LINKS", 20_000)
    found = queries.QUERIES["op13_tokenizer_alignment"](spark, SF)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(found.collect()) == ordered(aligned(DOCUMENTS))


def test_alignment_of_odd_rows(spark, odd, none):
    texts = [" ", "a  b \n c ", "a▁b", "<s> </s> <|endoftext|> <0x0A>", "\x00 ﬁ é", "ab cd " * 30000, "aé" * 50000]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    codecs = token_alignment.default_codecs(spark)
    assert ordered(token_alignment.align_tokenizers(df, *codecs).collect()) == ordered(aligned(pairs_of(df)))
    assert token_alignment.align_tokenizers(none, *codecs).count() == 0


def test_bitmaps_hold_what_was_put_in():
    rng = np.random.default_rng(2)
    links = [rng.integers(0, 40, rng.integers(1, 400)) ** 2 for _ in range(3000)]
    places = rng.permutation(token_alignment.CHUNK)[:3000]
    places.sort()
    pairs, planes = token_alignment.postings(links, places.tolist())
    want = Counter((int(p), int(k)) for x, k in zip(links, places) for p in x)
    got = Counter()
    for i in range(0, len(pairs), 7):  # slices, as batches arrive
        part = planes.slice(i, 7)
        posting, place, times = token_alignment.planes_of(part)
        for a, b, n in zip(posting.tolist(), place.tolist(), times.tolist()):
            got[int(pairs[i + a]), b] += n
        assert token_alignment.document_counts(part).tolist() == [len({k for p, k in want if p == q}) for q in pairs[i:i + 7].tolist()]
    assert got == want
    assert any(len(x.as_py()) == token_alignment.CHUNK // 8 for x in planes.values) and any(len(x.as_py()) < 200 for x in planes.values)


# byte BPE: the registered query -------------------------------------------------------------------


def test_byte_bpe_query(spark, odd, none):
    import tiktoken

    from riskloom.llm import bpe

    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in DOCUMENTS:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    found = queries.QUERIES["op1_byte_bpe"](spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ordered(found.collect()) == ordered(want)
    codec = bpe.default_codec(spark)
    assert all(bytes(r["decoded"]) == (r["n"] or "").encode() for r in bpe.round_trip(odd.withColumn("n", odd["text"]), codec).collect())
    assert bpe.round_trip(none, codec).count() == 0

"""The pipeline and the near-duplicate join, row by row, against plain Python over all pairs and all paths."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from riskloom.llm import bpe, language_id, mixing, signature_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """A folder with the documents of sf0.001, near copies on both sides of the threshold, chains of them and exact copies."""
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = table.to_pylist()
    some = [r for r in rows if r["text"] and 60 <= len(r["text"].split())][:30]
    more = []
    for i, row in enumerate(some):
        words = row["text"].split()
        for k in range(4):
            for j in range(0, len(words), max(9, len(words) // (i % 6 + 1))):
                words[(j + 5 * k) % len(words)] = f"planted{i}x{k}x{j}"
            more.append(row | {"doc_id": 10_000_000 + 10 * i + k, "text": " ".join(words)})
        more.append(row | {"doc_id": 10_000_000 + 10 * i + 9, "text": "".join(c.upper() if c.isascii() else c for c in row["text"])})
    folder = str(tmp_path_factory.mktemp("planted"))
    pq.write_table(pa.Table.from_pylist(rows + more, table.schema), f"{folder}/documents.parquet")
    return folder, rows + more


def lower(text):
    return (text or "").encode().lower()


def components(rows, k=signature_join.WORDS, percent=signature_join.PERCENT):
    """{doc_id: (number of shingles, smallest id connected with it)}."""
    sets = []
    for row in rows:
        words = lower(row["text"]).split()
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    label = [r["doc_id"] for r in rows]
    for a, s in enumerate(sets):
        for b in range(a):
            t = sets[b]
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t), 1) and label[a] != label[b]:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    least, gone = sorted((label[a], label[b]))
                    label = [least if x == gone else x for x in label]
    return {r["doc_id"]: (len(s), x) for r, s, x in zip(rows, sets, label)}


def letters(word):
    """(trigram bucket, script) of each letter."""
    chars, table = [0, *map(ord, word.lower()), 0], language_id.script_table()
    chars = [c if table[c] else 0 for c in chars]
    for a, b, c in zip(chars, chars[1:], chars[2:]):
        if b:
            code = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) & (1 << 64) - 1
            code = (code ^ code >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            yield (code >> 49) % language_id.BUCKETS, int(table[b])


def main_languages(rows):
    """{doc_id: (language, share of the letters)} by a Viterbi pass over every word of every text."""
    grams, scripts, total, memo = Counter(), Counter(), Counter(), {}
    for row in rows:
        if row["text"] is not None and row["lang"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 4 != 2:
            for found in filter(None, map(list, map(letters, row["text"].split()))):
                for bucket, _ in found:
                    grams[row["lang"], bucket] += 1
                scripts[row["lang"], found[0][1]] += len(found)
                total[row["lang"]] += len(found)
    langs = sorted(total)
    base = {x: total[x] + language_id.SMOOTHING * language_id.BUCKETS for x in langs}
    log = {k: math.log((n + language_id.SMOOTHING) / base[k[0]]) for k, n in grams.items()}
    never = {x: math.log(language_id.SMOOTHING / base[x]) for x in langs}
    uses = {(x, s): scripts[x, s] >= language_id.SCRIPT_SHARE * total[x] for x in langs for s in range(16)}

    def score(word):
        if word not in memo:
            found = list(letters(word))
            own = [x for x in langs if found and uses[x, found[0][1]]] or langs
            memo[word] = len(found), [sum(log.get((x, b), never[x]) for b, _ in found) + (0 if x in own else len(found) * min(never.values()))
                                      for x in langs]
        return memo[word]

    out = {}
    for row in rows:
        scored = [score(w) for w in (row["text"] or "").split()]
        sizes = [n for n, _ in scored]
        if not sum(sizes):
            out[row["doc_id"]] = "und", 0.0
            continue
        states = language_id.viterbi(np.array([x for _, x in scored]), language_id.PENALTY)
        by = np.bincount(states, sizes, len(langs))
        out[row["doc_id"]] = langs[by.argmax()], by.max() / sum(sizes)
    return out


def copies(rows):
    """{doc_id: copies} of the mix by source; the level is found by bisection."""
    size = {r["doc_id"]: sum(map(bool, re.split("[ \t-\r]+", r["text"] or ""))) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    whole = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(sources)}
    low, high = 0.0, 10.0 * sum(whole.values())
    for _ in range(200):
        level = (low + high) / 2
        reached = sum(min(level * weight[s], mixing.CAP * whole[s]) for s in sources)
        low, high = (level, high) if reached < mixing.SHARE * sum(whole.values()) else (low, level)
    out = {}
    for r in rows:
        rate = min(high * weight[r["source"]], mixing.CAP * whole[r["source"]]) / whole[r["source"]] if whole[r["source"]] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 16 ** 12
        out[r["doc_id"]] = math.floor(rate) + (u < rate - math.floor(rate))
    return out


def test_near_duplicates_of_all_pairs(spark, planted):
    folder, rows = planted
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_join.jaccard_join(spark, folder).collect()}
    expected = components(rows, 4, 85)  # as the query asks
    assert got == expected
    sizes = Counter(c for _, c in expected.values())
    assert sum(n > 2 for n in sizes.values()) >= 10 and any(c >= 10_000_000 for _, c in expected.values())


def test_pipeline_of_all_rows(spark, planted):
    folder, rows = planted
    main = main_languages(rows)
    rows = [r for r in rows if main[r["doc_id"]][0] != "und" and main[r["doc_id"]][1] >= corpus_pipeline.LEAST_SHARE]
    last = {lower(r["text"]): r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"])}
    rows = [r for r in rows if last[lower(r["text"])] == r["doc_id"]]
    one = components(rows)
    rows = [r for r in rows if one[r["doc_id"]][1] == r["doc_id"]]
    times = copies(rows)
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in rows:
        ids = np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()
        expected[r["doc_id"], r["lang"], r["source"], len(ids) // 4, ids] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +expected and 0 < len(rows) < len(main)

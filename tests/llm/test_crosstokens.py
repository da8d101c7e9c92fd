"""Tokens of two tokenizers: galloping, groups and links against plain loops over the libraries' own output."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from junctura.llm import crosstokens
from junctura.llm.crosstokens import align_corpus, align_tokens, common_ends, gallop, op12_cross_tokens, overlap_ranges

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\n\nlines\n", "\n", "a▁b", "x ▁ y", "é 😀 ﷺ", "<|endoftext|> <s> </s> <unk> <0x41>", "a\0b", "it's we'll", "  ", "a b c", " x", "A" * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def plainly(rows, a_json, b_model):
    """The contract's columns by loops; whole texts through the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
    a_tok.encode_special_tokens = True
    letters = crosstokens.byte_letters()
    docs, totals = [], collections.Counter()
    for doc_id, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in a_tok.id_to_token(k)) for k in a]
        spelled_b = [bytes([int(b_tok.id_to_piece(k)[3:5], 16)]) if b_tok.is_byte(k) else b_tok.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == b" " + text.encode():
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a = dict(zip(np.cumsum([len(x) for x in spelled_a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum([len(x) for x in spelled_b]).tolist(), range(len(b)), strict=True))
        links = [(ends_a[e], ends_b[e]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(a[x], b[y]) for x, y in links]
        totals.update(pairs)
        docs.append((doc_id, len(a), len(b), groups, pairs))
    most = collections.Counter()
    for (_, y), n in totals.items():
        most[y] = max(most[y], n)
    return [
        (doc_id, n_a, n_b, len(groups), len(pairs), sum(totals[p] == most[p[1]] for p in pairs), sum(totals[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for doc_id, n_a, n_b, groups, pairs in docs
    ]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def test_galloping_finds_all_common_ends():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), (1, 1), (200, 3000), (3000, 200), (1000, 1000)]:
        a, b = (np.sort(rng.choice(5000, k, replace=False)) for k in (n, m))
        got = common_ends(a, b, np.array([0, n]), np.array([0, m]))
        want = np.intersect1d(a, b)
        assert a[got[0]].tolist() == b[got[1]].tolist() == want.tolist()
    assert gallop(np.array([1, 5, 9]), np.array([5]), np.array([0]), np.array([3])).tolist() == [-1, 0, -1]


def test_overlap_ranges_against_all_pairs():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(1, 40)
        a, b = (np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))})) for _ in range(2))
        low, high = overlap_ranges(a, b)
        for k, (x, y) in enumerate(zip(np.append(0, a[:-1]), a, strict=True)):
            meets = [j for j, (u, v) in enumerate(zip(np.append(0, b[:-1]), b, strict=True)) if u < y and x < v]
            assert (low[k], high[k]) == (meets[0], meets[-1] + 1)


def test_odd_texts_and_small_chunks(spark, files, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "a"), (3, "other")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)
    want = sorted(plainly(rows, *files), key=key)
    assert [r[1] for r in want].count(0) >= 4  # null, empty and unspelled ones
    assert sorted(map(tuple, align_corpus(docs, *files).collect()), key=key) == want
    monkeypatch.setattr(crosstokens, "CHUNK_BYTES", 1)
    monkeypatch.setattr(crosstokens, "SLICE_BYTES", 50)
    assert sorted(map(tuple, align_corpus(docs, *files).collect()), key=key) == want


def test_groups_are_ranges_of_tokens(spark, files):
    docs = spark.createDataFrame([(1, "Überraschung im Kindergarten, 12345"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align_tokens(docs, *files).collect()}
    got = rows[1]
    spelled = ";".join(",".join(map(str, got["a_ids"][g["a_from"] : g["a_to"]])) + "|" + ",".join(map(str, got["b_ids"][g["b_from"] : g["b_to"]])) for g in got["groups"])
    digest = align_corpus(docs, *files).where("doc_id = 1").first()["groups_sha256"]
    assert hashlib.sha256(spelled.encode()).hexdigest() == digest and rows[2]["groups"] == [] and rows[2]["a_ids"] == []


def test_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert align_corpus(docs, *files).collect() == [] and align_corpus(docs, *files).schema["doc_id"].dataType.simpleString() == "string"


def test_query_against_plain_loops(spark, files):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.col("text")).collect()]
    assert sorted(map(tuple, op12_cross_tokens(spark, path).collect()), key=key) == sorted(plainly(rows, *files), key=key)

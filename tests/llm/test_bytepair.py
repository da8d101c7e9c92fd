"""Tree-reduced BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from junctura.llm.bytepair import Rendered, TreeBPE, decode_column, encode_column, parse_ranks, roundtrip_digests
from junctura.llm.remembered import Remembered, per_worker

DATA = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = parse_ranks(DATA)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return TreeBPE(RANKS, public_tokenizers.PATTERN)


def test_long_pieces_match(model):
    rng = random.Random(7)
    alphabets = ["ab", "etaoinshrdlu", "!*-=", "0123456789", "äöüßé", "日本語中文", "aA", " \n\t"]
    for _ in range(150):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 50))) if rng.random() < 0.3 else "".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 700)))
        assert model.encode(text) == ORACLE.encode_ordinary(text)
    for text in ("a" * 2000, "the" * 900, "!" * 1001, "antidisestablishmentarianism" * 200, ""):
        assert model.encode(text) == ORACLE.encode_ordinary(text)
        assert model.decode(model.encode(text)) == text.encode()


def test_whole_texts_by_stretches(model):
    rng = random.Random(11)
    rendered = Rendered(model)
    parts = ["the", "it's", " ", "  ", "\n", "a.b", "\t", "ßé", "12", "\u00a0", "\u2003", "!!", "x\ny", "\x1c", ""]
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 8)))
        ids, data = rendered.whole(text)
        assert ids == " ".join(map(str, ORACLE.encode_ordinary(text))), repr(text)
        assert data == text.encode()


def test_join_is_associative(model):
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choices("etaoinshr", k=rng.randint(3, 120))).encode()
        i, j = sorted((rng.randint(0, len(word)), rng.randint(0, len(word))))
        a, b, c = (model.reduce(x) for x in (word[:i], word[i:j], word[j:]))
        assert model.join(model.join(a, b), c) == model.join(a, model.join(b, c)) == model.reduce(word)


def test_frames(spark):
    twice = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in roundtrip_digests(twice, DATA, public_tokenizers.PATTERN).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    texts = ["Don't stop", None, "", "  two  spaces\n\n", "ß" * 300, "x" * 20_000, "Don't stop"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in roundtrip_digests(df, DATA, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = ORACLE.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = decode_column(encode_column(df, DATA, public_tokenizers.PATTERN), DATA).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both)
    assert roundtrip_digests(df.limit(0), DATA, public_tokenizers.PATTERN).count() == 0


def test_documents_go_through_the_tree(spark):
    """On given documents pieces are put together by joins, many of which encode a window again, and match the library."""
    model = TreeBPE(RANKS, public_tokenizers.PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    pieces = {p.encode() for t in texts for p in model.pattern.findall(t or "")}
    whole = {p for p in pieces if p not in RANKS}
    for p in pieces:
        assert list(model.reduce(p)) == ORACLE.encode_ordinary(p.decode())
    assert model.joins >= len(whole) > 1_000 and model.grown > len(whole) // 4
    rendered = Rendered(model)
    assert all(rendered.whole(t or "")[0] == " ".join(map(str, ORACLE.encode_ordinary(t or ""))) for t in texts)


def test_memory_of_a_worker_is_bounded():
    made = []
    known = Remembered(lambda k: made.append(k) or k.upper(), limit=2)
    for turn in ("a", "b", "c"):
        assert known[turn] == turn.upper()
    known.turn()
    assert known["a"] == "A" and made == ["a", "b", "c"] and len(known) == 1  # from the older generation
    assert known["x" * 1_000] == "X" * 1_000 and "x" * 1_000 not in known
    assert per_worker("test", 1, list) is per_worker("test", 1, list) is not per_worker("test", 2, list)

"""Edited counts against encoding the edited text anew."""

import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from junctura.llm.bytepair import TreeBPE, parse_ranks
from junctura.llm.tokencounts import CountTree, apply_edit_table, count_edited, count_tokens

DATA = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = parse_ranks(DATA)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["the", "it's", " ", "  ", "\n", "a.b", "\t", "ßé", "12", " ", "!!", "x\ny", "'", "'l", "l", "re", " we", "  \n "]


def test_random_edits():
    model, rng = TreeBPE(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(250):
        text = "".join(rng.choices(PARTS, k=rng.choice([0, 3, 40, 400])))
        tree = CountTree(model, text)
        for _ in range(12):
            start, deleted = rng.randint(0, len(text) + 1), rng.choice([0, 0, 1, 3, 60, 2000])
            inserted = "".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 30])))
            text = text[:start] + inserted + text[start + deleted :]
            tree.edit(start, deleted, inserted)
            assert tree.text == text
            assert tree.n_tokens == len(ORACLE.encode_ordinary(text)), (text, start, deleted, inserted)
            assert sum(tree.leaves()[0]) == len(text)


def test_edits_are_local():
    model = TreeBPE(RANKS, public_tokenizers.PATTERN)
    tree = CountTree(model, "some words here. " * 20_000)
    tree.edit(150_000, 5, "other")
    assert tree.reencoded < 1_000
    tree.edit(150_000, 0, "many words, " * 5_000)
    assert tree.n_tokens == len(ORACLE.encode_ordinary(tree.text))
    tree.edit(170_000, 5, "other")
    assert tree.n_tokens == len(ORACLE.encode_ordinary(tree.text))


def test_tables(spark, monkeypatch):
    monkeypatch.setattr("junctura.llm.tokencounts.EDITS_AT_ONCE", 1)
    docs = spark.createDataFrame([(1, "one two", "c"), (2, None, "c"), (3, "", "c"), (None, "null id", "c"), (4, "w " * 30_000, "c")], "doc_id long, text string, n_tokens string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "x"), (1, 1, 3, 0, " and"), (3, 1, 5, 5, "grown"), (4, 1, 10, None, None), (9, 1, 0, 0, "none")], "doc_id long, seq int, start long, deleted long, inserted string")
    state = count_tokens(docs, DATA, public_tokenizers.PATTERN)
    got = {r.doc_id: (r.text, r.n_tokens) for r in apply_edit_table(state, edits, DATA, public_tokenizers.PATTERN).collect()}
    texts = {1: "x and two", 2: "", 3: "grown", None: "null id", 4: "w " * 30_000}
    assert got == {i: (t, len(ORACLE.encode_ordinary(t))) for i, t in texts.items()}
    one_by_one = apply_edit_table(state, edits.where("doc_id = 1"), DATA, public_tokenizers.PATTERN)
    todo = F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('start', 3L, 'deleted', 0L, 'inserted', ' and'), named_struct('start', 0L, 'deleted', 3L, 'inserted', 'x')) END")
    at_once = count_edited(docs, todo, DATA, public_tokenizers.PATTERN)
    assert {(r.doc_id, r.text, r.n_tokens) for r in one_by_one.collect()} == {(r.doc_id, r.text, r.n_tokens) for r in at_once.collect()}
    assert apply_edit_table(state.limit(0), edits, DATA, public_tokenizers.PATTERN).count() == 0

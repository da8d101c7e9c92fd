"""Stages of the corpus pipeline on small inputs."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from junctura.llm.neardup import near_duplicates


def test_near_dedup_links_from_four_fifths(spark):
    words = [f"w{k}" for k in range(104)]  # 100 shingles

    def edited(*at):
        return " ".join(f"e{k}" if k in at else w for k, w in enumerate(words))

    texts = [edited(), edited(30, 60), edited(20, 50, 80)]  # 90 / 110 = 0.82 and 85 / 115 = 0.74 of the first
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2]
    assert near_duplicates(df).where("kept").count() == 3


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(spark, folder):
    """Documents with junk lines, toxic words, equal and nearly equal texts; written as the tables that stages read."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ke", "li", "mu") for b in ("na", "re", "so", "ti") for c in ("n", "s", "l", "m")]
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(5))
        junk, toxic = i % 10 == 3, i % 10 == 7
        if junk:
            text = "\n".join(rng.choice(["BUY NOW!!! WIN $$$ " * 4, "word | word | word | " * 3]) for _ in range(6))
            text += f" {i}"
        if toxic:
            text += " snarfing blorgish"
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    clean = [i for i in range(400) if i % 10 not in (3, 7)]
    copies = {1000 + k: rows[clean[k]][1].replace(" ", "  ", 3) for k in range(8)}
    near = {2000 + k: rows[clean[20 + k]][1] + " end" for k in range(8)}
    extra = [(1000 + k, copies[1000 + k]) for k in range(8)] + [(2000 + k, near[2000 + k]) for k in range(8)] + [(3000, None), (3001, ""), (None, "no name here at all"), (3002, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows + extra], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), rows, clean


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_stages_one_by_one(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    docs, rows, clean = small_corpus(spark, folder)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "exact dedup", "near dedup", "best-fit packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = ids(out)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    good = kept["quality classifier"]
    assert sum(i in good for i, _ in rows if i % 10 == 3) <= 2 and sum(i in good for i in clean) >= 0.98 * len(clean)
    assert sum(i in kept["toxicity"] for i, _ in rows if i % 10 == 7) <= 2 and sum(i in kept["toxicity"] for i in clean) >= 0.97 * len(clean)
    # Against plain versions, each on what the stage before it kept.
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    first = {}
    for i in sorted((i for i in kept["toxicity"] if i is not None)):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text[i] or ""), i)
    assert set(kept["exact dedup"]) - {None} == set(first.values())
    assert not {1000 + k for k in range(8) if clean[k] in kept["toxicity"]} & set(kept["exact dedup"])
    sets = {i: shingles(text[i]) for i in first.values()}
    linked = {j for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert set(kept["near dedup"]) - {None} == set(first.values()) - linked
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    room, sources = Counter(), {}
    for r in packed:
        if r.bin_id is not None:
            room[r.bin_id] += r.length
            sources.setdefault(r.bin_id, []).append(r.doc_id)
    source = {r.doc_id: r.source for r in docs.collect()}
    assert max(room.values()) <= 2048
    for held in sources.values():
        found = [source[i] for i in held]
        assert len(found) == len(set(found))


def test_run_ends_like_its_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    docs, _, _ = small_corpus(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    assert ids(corpus_pipeline.run(spark, folder)) == ids(corpus_pipeline.STAGES[-1][1](spark, docs, folder))


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    docs, _, _ = small_corpus(spark, folder)
    odd = docs.withColumns({"keep_id": F.lit(1), "component_id": F.lit(2), "digest": F.lit("x")}).limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        assert stage(spark, odd, folder).columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

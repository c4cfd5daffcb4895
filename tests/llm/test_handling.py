"""Very long texts, clashing columns, nulls and empty tables, beyond what the tests of each operator cover."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospan.llm import bigrams, decontaminate, jaccard, mixing, repeats, tokens
from tests.llm.test_operators import DOCS, make, prose, split_words, words


@pytest.fixture(scope="module")
def long():
    """2.7 MB of words that hardly repeat."""
    return " ".join(map("w{}".format, np.random.default_rng(3).integers(10**9, size=250_000)))


def test_repeats_in_long_texts(spark, long):
    """A passage near both ends of a text of over 2 MB and in a short one goes, all else stays."""
    passage = prose(np.random.default_rng(4), 60, 10**6)
    docs = {0: f"{long[:150]}1{passage}1{long[150:-90]}2{passage}2{long[-90:]}", 1: f"short 3{passage}3", 2: None, 3: long[:199]}
    got = {r["doc_id"]: bytes(r["kept_text"]).decode() for r in repeats.remove(make(spark, list(docs.values()))).collect()}
    assert got == {i: (t or "").replace(passage, "") for i, t in docs.items()}


def test_words_of_long_texts(spark, long):
    """Token counts, tokens of the mix, and hits of a text of 250,000 words, the last of which are an item."""
    automaton = tokens.Automaton({bytes([b]) for b in range(256)} | {b"w1", b"w12", b"99"})
    docs = make(spark, [long, "short text", None, ""])
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, automaton).collect()}
    assert got[0] == sum(n * automaton.count(w) for w, n in collections.Counter(split_words(long.encode())).items()) and got[2] == got[3] == 0
    assert {r["doc_id"]: r["__tokens"] for r in mixing.described(docs).collect()} == {0: 250_000, 1: 2, 2: 0, 3: 0}
    item = long.rsplit(" ", 12)
    bench = spark.createDataFrame([(1, " ".join(item[1:]))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.hits(docs, bench).collect()}
    assert found[0]["hit_words"] == 250_000 and [tuple(s) for s in found[0]["hit_spans"]] == [(249_988, 250_000)] and not found[1]["hit_items"]
    clean = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {0: item[0] + " ", 1: "short text", 2: None, 3: ""}


def test_jaccard_of_long_texts(spark, long):
    half = long[: len(long) // 2]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(make(spark, [long, long + " tail", half, "one short text of six words"])).collect()}
    assert out == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}


def test_cross_entropy_with_clashing_columns(spark, long):
    docs = make(spark, [long[:900_000], "w1 w2 w1 w2 w3", "w2 w1", None, "", "w2 w1"])
    plain = sorted(map(tuple, bigrams.scored(docs, F.col("source") == "src1").collect()))
    names = ("__k", "__0", "__text", "n_tokens", "target_loss", "difference", "key", "chunk", "bucket", "words", "target")
    clash = docs.withColumns({n: F.lit("clash") for n in names})
    assert sorted(map(tuple, bigrams.scored(clash, F.col("source") == "src1").collect())) == plain
    assert [r[1] for r in plain] == [len(words(long[:900_000])), 5, 2, 0, 0, 2]


def test_pipeline_handles_all(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    bad = [(None, prose(rng, 20), "en", "s", 1), (None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "src0", 0), (901, "", "en", "src0", 0), (902, prose(rng, 60_000, 10**6), "en", "src1", 1)]
    plain = [(i, prose(rng, 40, 300) + (" foulword vileword" if i % 3 == 0 else ""), "en", f"src{i % 3}", 1) for i in range(90)]
    docs = spark.createDataFrame([*bad, *plain], DOCS).withColumns({n: F.lit("clash") for n in ("__k", "__0", "__text", "class_id", "hit_spans", "grade_of", "region")})
    labels = spark.createDataFrame([(None, 1, 1), *((i, 1, int(i % 3 == 0)) for i in range(90)), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, ""), (2, prose(rng, 12, 10**6))], "item_id long, text string")
    for name, some in (("all", None), ("none", 0)):
        folder = tmp_path / name
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            (df if some is None else df.limit(some)).write.parquet(str(folder / f"{table}.parquet"))
        frames = [spark.read.parquet(str(folder / "documents.parquet"))]
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frames.append(stage(spark, frames[-1], str(folder)).cache())
            assert frames[-1].columns == docs.columns
        counts = [f.count() for f in frames]
        if some == 0:
            assert not any(counts) and corpus_pipeline.run(spark, str(folder)).count() == 0
        else:
            ids = [sorted(r["doc_id"] for r in f.where("doc_id is not null").collect()) for f in frames]
            assert set(ids[1]) == {*ids[0]} - set(range(0, 90, 3))
            assert {900, 901, 902} <= set(ids[3]) and counts[3] == counts[2]
            last = corpus_pipeline.STAGES[-1][1](spark, frames[-1], str(folder))
            assert last.count() == counts[4]

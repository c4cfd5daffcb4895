"""Each operator against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import json
import os
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospan.llm import bigrams, common, crossentropy, decontaminate, jaccard, language, mixing, repeats, sharding, tokens, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall(text.encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))) if text else []


def prose(rng, n, bank=400):
    return " ".join(f"w{rng.integers(bank)}" for _ in range(n))


def make(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    base = [prose(rng, int(rng.integers(20, 300))) for _ in range(25)]
    near = [b.replace(" ", "  ", 1) + " extra words" for b in base[:5]]
    passage = prose(rng, 60, 10**6)
    shared = [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    return [*base, *near, base[0], base[0], *shared, None, "", "one", "é ü ß", "a" * 900, prose(rng, 9000), "!!! ... ???"]


def test_sharding(spark, texts):
    docs = make(spark, texts).withColumn("shard", F.lit("clash")).union(spark.createDataFrame([(None, None, None, None, None, "x")], DOCS + ", shard string"))
    tree = sharding.topology(8)
    rows = sharding.assign(docs, "doc_id", tree).collect()
    assert len(rows) == len(texts) + 1 and {r["shard"] for r in rows} <= set(range(8))
    assert all(r["region"] == r["shard"] // 4 and r["rack"] == r["shard"] // 2 % 2 for r in rows)
    big = spark.range(4000)
    before = {r["id"]: r["shard"] for r in sharding.assign(big, "id", tree).collect()}
    after = {r["id"]: r["shard"] for r in sharding.assign(big, "id", sharding.grown(tree)).collect()}
    assert all(after[k] in (before[k], 8) for k in before) and 300 < sum(v == 8 for v in after.values()) < 600
    heavier = [s._replace(weight=3.0) if s.shard == 0 else s for s in tree]
    moved = {r["id"]: r["shard"] for r in sharding.assign(big, "id", heavier).collect()}
    assert all(moved[k] // 4 == 0 for k in before if moved[k] != before[k])  # only into the region whose weight grew
    numbered = sharding.slots(sharding.assign(docs.drop("shard").union(docs.drop("shard")), "doc_id", tree).select("doc_id", "n_chars", "shard"), ("doc_id", "n_chars")).collect()
    for s in range(8):
        own = sorted(r["slot"] for r in numbered if r["shard"] == s)
        assert own == list(range(len(own)))
    clash = {r["doc_id"]: (r["shard"], r["__key"]) for r in sharding.assign(big.select(F.col("id").alias("doc_id"), F.lit("x").alias("__key"), F.lit(1).alias("rack")), "doc_id", tree).collect()}
    assert clash == {k: (v, "x") for k, v in before.items()}
    no_key = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("size"), F.lit(3).alias("shard"))
    assert sorted(r["slot"] for r in sharding.slots(no_key, ("doc_id", "size")).collect()) == list(range(3000))
    many = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit(3).alias("shard"))
    assert sorted(r["slot"] for r in sharding.slots(many, ("doc_id",)).collect()) == list(range(5000))
    assert sharding.assign(docs.limit(0), "doc_id", tree).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    bad = ["foulword", "nastyword", "vileword", "uglyword"]
    rows, grades = [], []
    for i in range(400):
        grade = i % 4
        own = prose(rng, 40).split() + list(rng.choice(bad, 3 * grade))
        rng.shuffle(own)
        rows.append((i, " ".join(own), "en", "s", 0))
        grades.append((i, grade))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None)], DOCS).withColumn("severity", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame(grades, "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 402 and out[900]["severity"] == out[901]["severity"] == 0
    means = [np.mean([out[i]["severity"] for i, g in grades if g == k]) for k in range(4)]
    assert means == sorted(means) and means[0] < 0.3 and means[3] > 2.5
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert {r["severity"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_likelihood():
    """The fit is a minimum of the penalised likelihood of the cumulative-link model, written here in plain Python."""
    rng = np.random.default_rng(15)
    sizes = rng.integers(2, 6, 90)
    texts = [np.sort(rng.choice(12, n, False)) for n in sizes]
    grades = np.array([int(np.clip(np.sum(x < 3) + rng.integers(0, 2), 0, 3)) for x in texts])
    model = toxicity.fit(np.concatenate(texts), sizes, grades, 12)

    def loss(weights, thresholds):
        total = 0.0
        for x, g in zip(texts, grades):
            eta = sum(weights[j] for j in x)
            above = [1.0, *(1 / (1 + np.exp(b - eta)) for b in thresholds), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total / len(texts) + toxicity.DECAY * sum(w * w for w in weights) / 2

    least = loss(model.weights, model.thresholds)
    for i in range(12 + len(model.thresholds)):
        for step in (0.05, -0.05):
            moved = np.concatenate([model.weights, model.thresholds])
            moved[i] += step
            assert loss(moved[:12], moved[12:]) > least - 1e-6
    severity = toxicity._sigmoid(model.odds(np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)]))).sum(1)
    for x, got in zip(texts, severity):
        eta = sum(model.weights[j] for j in x)
        above = [1.0, *(1 / (1 + np.exp(b - eta)) for b in model.thresholds), 0.0]
        assert abs(sum(g * (above[g] - above[g + 1]) for g in range(4)) - got) < 1e-9  # the expected grade


def test_toxicity_repeats_and_long_texts(spark):
    """A row that repeats without end takes one place in the sample; long texts and equal severities are rated whole."""
    rows = [(i, ("foulword " if i % 2 else "fine ") + "words here", "en", "s", 0) for i in range(40)]
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("foulword words here").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = spark.createDataFrame([*rows, (50, "fine " * 60000 + "foulword", "en", "s", 0)], DOCS).union(many).withColumn("__k", F.lit("clash")).withColumn("__bytes", F.lit("clash"))
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    out = toxicity.score(docs, toxicity.train(docs, grades)).collect()
    assert len(out) == 3041 and all(r["toxic"] == (r["doc_id"] % 2 == 1) for r in out if r["doc_id"] < 40)
    assert len({r["severity"] for r in out if r["doc_id"] == 1}) == 1 and next(r["severity"] for r in out if r["doc_id"] == 50) > 0.1


def test_toxicity_samples_labelled_texts(spark):
    """Labels of absent documents and null texts take no place in the sample; grades over the bound are refused."""
    docs = make(spark, [*["plain words here"] * 30, *["foulword vileword here"] * 30, *[None] * 200])
    grades = spark.createDataFrame([(i, int(i >= 30)) for i in range(2000)], "doc_id long, grade int")
    model = toxicity.train(docs, grades, sample_rows=60)
    out = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, model).collect()}
    assert len(model.thresholds) == 1 and all(out[i] == (30 <= i < 60) for i in out)
    with pytest.raises(ValueError, match="grades go from 0"):
        toxicity.train(docs, grades.withColumn("grade", F.lit(toxicity.MAX_GRADES)))


def test_toxicity_sample_has_a_bound_in_features(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(toxicity, "_fitted", lambda s, at, bounds, grades: sizes.append(np.diff(bounds).tolist()))
    # the key that comes first by hash has the longest text
    order = [r[0] for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    long = {order[0]: 300, order[5]: 200}
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(long.get(k, 4)))) for k in range(40)], "doc_id long, text string")
    grades = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, grade int")
    toxicity.train(docs, grades)
    whole = sorted(sizes.pop())
    for bound in (10_000, 1000, 500):
        toxicity.train(docs, grades, sample_features=bound)
        got = sizes.pop()
        assert sum(got) <= bound and (bound < sum(whole) or sorted(got) == whole)
    assert len(got) < 40


def test_toxicity_cut():
    bounds = np.arange(0, 121, 2)
    grades = np.arange(60) // 30
    at = np.stack([grades, np.full(60, 2)], 1).ravel()
    cut = toxicity.best_cut(at, bounds, grades)
    odds = toxicity.fit(at, np.diff(bounds), grades).odds(at, bounds)[:, 0]
    assert (odds[grades == 0] < cut).all() and (odds[grades == 1] > cut).all()
    noisy = grades.copy()
    noisy[0] = 1  # looks like the clean ones, so the cut stays above them
    odds = toxicity.fit(at, np.diff(bounds), noisy).odds(at, bounds)[:, 0]
    assert (odds[at[::2] == 0] < toxicity.best_cut(at, bounds, noisy)).all()
    assert toxicity.best_cut(at, bounds, np.zeros(60, int)) == 0.0 and toxicity.best_cut(at[:0], bounds[:1], grades[:0]) == 0.0


def test_language(spark):
    rng = np.random.default_rng(2)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["schl", "üng", "eit"]}
    rows = [(i, "".join(str(rng.choice(syllables[l])) + (" " if k % 4 == 0 else "") for k in range(60)), l, "s", 0) for i, l in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*rows, (500, None, "aa", "s", 0), (501, "123 !!", "bb", "s", 0), (502, rows[0][1] * 40000, None, "s", 0)], DOCS).withColumn("score", F.lit("clash"))
    model = language.train(docs.where("doc_id % 2 < 2 and doc_id < 100"))
    out = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(100, 120))
    assert (out[500]["lang_pred"], out[501]["lang_pred"], out[502]["lang_pred"]) == ("und", "und", "aa") and 0 <= out[502]["score"] <= 1
    counts = collections.Counter()
    for _, hashed, _ in language.bins(["Ab c"]):
        counts[len(hashed)] += 1
    assert sorted(counts.elements()) == [3, 4, 5]  # a b c; " a" "ab" "b " " c"("c "): windows with a letter
    empty = language.train(docs.limit(0))
    assert language.predict(docs, empty).where("lang_pred = 'und'").count() == docs.count()


def brute_grams(text):
    """N-grams of 1 to 3 characters that hold a letter, by plain Python."""
    codes = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ") if text else ""
    return [codes[i : i + n] for n in (1, 2, 3) for i in range(len(codes) - n + 1) if codes[i : i + n].strip()]


@pytest.mark.parametrize("piece,cells", [(1 << 20, 1 << 25), (7, 1 << 25), (1 << 20, 2 << 16)])
def test_language_scores(spark, piece, cells, monkeypatch):
    """Posteriors of naive Bayes in plain Python; neither the pieces nor the number of matrices changes them. Ties and repeats too."""
    monkeypatch.setattr(language, "PIECE_CHARS", piece)
    monkeypatch.setattr(language, "MAX_CELLS", cells)
    rng = np.random.default_rng(13)
    known = [("".join(str(rng.choice(list(x))) for _ in range(30)), lang) for x, lang in (("abc d", "l1"), ("cdé f", "l2"), ("ßüab ", "l3"), ("ΣΟΣ ", "l4"), ("xyz ", "l5")) for _ in range(6)]
    asked = ["abcd", "ÉFC cde", "Σ σς", "ab" * 40, "zz top", "12", "", None, known[0][0], known[0][0]]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([*known, *((x, None) for x in asked)])], DOCS).withColumn("__0", F.lit("clash")).withColumn("__top", F.lit("clash"))
    out = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    counts = {x: collections.Counter() for _, x in known}
    docs_of = collections.Counter(x for _, x in known)
    hashed = {}
    for t, x in [*known, *((x, None) for x in asked if x)]:
        grams = brute_grams(t)
        found = np.concatenate([h for _, h, _ in language.bins([t])])
        assert len(found) == len(grams)
        hashed[t] = found
        if x:
            counts[x].update(found.tolist())
    size = 1 << language.BITS
    for i, t in enumerate(asked, len(known)):
        if not t or not len(hashed[t]):
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        logs = {x: np.log(docs_of[x] / len(known)) + sum(np.log((c[h] + 0.5) / (sum(c.values()) + 0.5 * size)) for h in hashed[t].tolist()) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert out[i]["lang_pred"] == best and abs(out[i]["score"] - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-9
    assert out[len(known) + 8]["score"] == out[len(known) + 9]["score"] and len(brute_grams("ΣΟΣ")) == 10


def brute_repeats(texts, size):
    seen = collections.Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone)))
    return out


@pytest.mark.parametrize("local", [4096, 1])
def test_repeats(spark, texts, local, monkeypatch):
    monkeypatch.setattr(repeats, "LOCAL", local)
    docs = make(spark, texts).withColumn("removed", F.lit(1))
    got = sorted((r["doc_id"], bytes(r["kept_text"]), sum(x["end"] - x["start"] for x in r["removed"])) for r in repeats.remove(docs).collect())
    want = brute_repeats([(t or "").encode() for t in texts], 200)
    assert got == [(i, *w) for i, w in enumerate(want)]
    twice = docs.limit(3).union(docs.limit(3))
    assert {bytes(r["kept_text"]) for r in repeats.remove(twice.where("length(text) >= 200")).collect()} <= {b""}
    assert repeats.remove(docs.limit(0)).count() == 0
    uniform = make(spark, ["ab" * 3000, "c" * 5000, "d" * 199])
    assert [len(r["removed"]) for r in sorted(repeats.remove(uniform).collect(), key=lambda r: r["doc_id"])] == [1, 1, 0]


def split_words(text):
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    return re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x09-\x0d\x20]+", text.translate(low))


def test_tokens(spark, texts):
    vocabulary = {bytes([b]) for b in range(256)} | {b"w1", b"w12", b"12 ", b"123", b"extra", b"ext", b"!!"}
    automaton = tokens.Automaton(vocabulary)

    def brute(word):
        n = i = 0
        while i < len(word):
            i = next(j for j in range(min(len(word), i + 6), i, -1) if word[i:j] in vocabulary)
            n += 1
        return n

    docs = make(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, automaton).collect()}
    split = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x09-\x0d\x20]+")
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    assert got == {i: sum(map(brute, split.findall((t or "").encode().translate(low)))) for i, t in enumerate(texts)}
    whole = b"w12 extra  !! " * 50 + b"x" * 40
    assert b"".join(tokens.parts(whole, 16)) == whole and all(len(x) <= 60 for x in tokens.parts(whole, 16)) and list(tokens.parts(b"")) == []
    counter = tokens.Memo(automaton)
    assert sum(counter.text(x) for x in tokens.parts(whole, 16)) == counter.text(whole) == sum(map(brute, split_words(whole)))
    pieces = tokens.Automaton({b"un", b"a"}, {b"##"[:0] + b"able", b"a", b"b"})
    assert [pieces.count(w) for w in (b"unable", b"unab", b"xyz", b"una", b"unablx")] == [2, 3, 1, 2, 1]
    assert tokens.count_tokens(docs.limit(0), automaton).count() == 0


@pytest.mark.parametrize("mark", ["", "</w>"])
def test_tokens_of_a_vocabulary_file(tmp_path, mark):
    """Against brute force over the names of the file: marked ones match at the end of a word only."""
    names = ["w1", "w12", "3" + mark, "12" + mark, "w" + mark, "Ã©", "<|end|> ", "é", "23"]
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {n: i for i, n in enumerate(names)}, **({"end_of_word_suffix": mark} if mark else {})}}))
    known, end = tokens.vocabulary(str(tmp_path / "v.json"))
    final = {n.removesuffix(mark) for n in names if mark and n.endswith(mark)}
    inner = {n for n in names if n not in {f + mark for f in final}} if mark else set(names)
    back = {v: k for k, v in tokens.byte_symbols().items()}

    def brute(word):
        shown, i, n = "".join(back[b] for b in word), 0, 0
        while i < len(shown):
            fits = [j for j in range(i + 1, len(shown) + 1) if j == i + 1 or shown[i:j] in inner or (j == len(shown) and shown[i:j] in final)]
            i, n = fits[-1], n + 1
        return n

    automaton = tokens.Automaton(known, end=end)
    tried = [bytes(x) for n in range(1, 6) for x in itertools.product(b"w123", repeat=n)] + ["é".encode(), "wé12".encode()]
    assert [automaton.count(w) for w in tried] == [brute(w) for w in tried]


@pytest.mark.parametrize("sizes", [None, (150, 400)])
def test_cross_entropy_counts_all_pairs(spark, texts, sizes, tmp_path):
    """Against brute force over every word and pair; most words here have a rank over CORE."""
    rng = np.random.default_rng(8)
    texts = [*texts, *(prose(rng, 80, 5000) for _ in range(30))]
    texts += texts[-10:]
    docs = make(spark, texts)
    if sizes:
        found = bigrams.scored(docs, F.col("source").isin("src1", "src2", "src3"), chunk_words=sizes[0], bucket_words=sizes[1])
    else:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        found = crossentropy.op6_cross_entropy(spark, str(tmp_path))
    out = {r["doc_id"]: r for r in found.collect()}
    assert len(out) == len(texts) and found.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]
    split = [words(t) for t in texts]
    vocabulary = {w for x in split for w in x}
    for column, flag in (("target_loss", True), ("background_loss", False)):
        own = [x for i, x in enumerate(split) if (i % 3 > 0) == flag]
        one, first = collections.Counter(w for x in own for w in x), collections.Counter(w for x in own for w in x[:-1])
        two, n = collections.Counter(p for x in own for p in zip(x, x[1:], strict=False)), sum(map(len, own))
        for i, x in enumerate(split):
            used = x if (i % 3 > 0) == flag else []  # a document's own counts are left out
            own_one, own_first, own_two = collections.Counter(used), collections.Counter(used[:-1]), collections.Counter(zip(used, used[1:]))
            alone = {w: (one[w] - own_one[w] + 0.5) / (n - len(used) + 0.5 * (len(vocabulary) + 1)) for w in x}
            p = [alone[w] for w in x[:1]] + [(two[v, w] - own_two[v, w] + 32 * alone[w]) / (first[v] - own_first[v] + 32) for v, w in zip(x, x[1:], strict=False)]
            assert out[i]["n_tokens"] == len(x) and abs(out[i][column] - (-np.log(p).mean() if x else 0)) < 1e-9
    assert all(abs(r["target_loss"] - r["background_loss"] - r["difference"]) < 1e-12 for r in out.values())
    assert bigrams.scored(docs.limit(0), F.lit(True)).count() == 0
    assert {r["target_loss"] for r in bigrams.scored(make(spark, [None, "!"]), F.lit(True)).collect()} == {0.0}


def test_cross_entropy_rows_follow_the_corpus(spark):
    """Rows for the buckets are bounded by the keys of the corpus, however many buckets there are, and each key is in its own bucket."""
    rng = np.random.default_rng(6)
    docs = make(spark, [prose(rng, 50, 3000) for _ in range(40)]).select("doc_id", F.lit(True).alias("t"), F.col("text").cast("binary"))
    sent = {}
    for name, df, chunk in (("half", docs.where("doc_id < 20"), 100), ("whole", docs, 100)):
        asked = bigrams._asked(bigrams.chunks(df, "doc_id", chunk), 10**6).collect()
        keys = 0
        for r in asked:
            for part in ("words", "pairs"):
                held = bigrams.unpacked(r[part], np.uint64)
                keys += len(held)
                assert all((int(k) >> 32) * 10**6 >> 32 == r["bucket"] for k in held)
        sent[name] = len(asked)
        assert len(asked) <= keys
    assert 1.8 < sent["whole"] / sent["half"] < 2.2


def brute_jaccard(rows, least=0.8):
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in rows}
    parent, n = {i: i for i in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), n[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = make(spark, texts).withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs).collect()}
    assert got == brute_jaccard(list(enumerate(texts)))
    kept = {r["doc_id"] for r in jaccard.representatives(docs.union(docs)).collect()}
    assert kept == {i for i, (c, _) in got.items() if i == c}
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.depth() == 4
    if block == 2:
        return
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))).withColumn("__id", F.lit("clash")).withColumn("k1", F.lit("clash"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(named).collect()}
    assert got == {f"d{i:03d}": (f"d{c:03d}", n) for i, (c, n) in brute_jaccard(list(enumerate(texts))).items()}
    assert {r["doc_id"] for r in jaccard.representatives(named).collect()} == {f"d{i:03d}" for i in kept}


def test_jaccard_levels(spark):
    """Near copies of all similarities around the threshold: links of every level, each pair once; recall against brute force."""
    rng = np.random.default_rng(21)
    rows = []
    for g in range(60):
        own = prose(rng, 120, 10**6).split()
        for _ in range(4):
            copy = list(own)
            for at in rng.choice(120, int(rng.integers(0, 4)), False):
                copy[at] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = brute_jaccard(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs).collect()} == want and 60 < len({c for c, _ in want.values()}) < 240
    assert jaccard.missed([(0.8, 1000)], 4) < 0.5 < jaccard.missed([(0.8, 1000)], 6) and jaccard.missed([(0.95, 1000)], 6) < 1e-6


def test_jaccard_null_and_shared_keys(spark):
    rng = np.random.default_rng(22)
    a, b = prose(rng, 40, 10**6), prose(rng, 40, 10**6)
    rows = [(None, a), (None, a + " tail"), (7, b), (7, a), (None, None), (42, None), (None, b), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(docs).collect()), key=str)
    assert got == sorted([(None, 7, 2), (None, 7, 2), (7, 7, 1), (7, 7, 2), (None, None, 0), (42, 42, 0), (None, 7, 1), (None, None, 0)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.representatives(docs.union(docs)).collect()), key=str)
    assert kept == sorted([(7, b), (7, a), (42, None)] + [(None, None)] * 4, key=str)


def test_representatives_of_shared_ids(spark):
    """Rows that share a doc_id but hold unrelated texts all stay; copies go wherever they are."""
    rng = np.random.default_rng(12)
    a, b, c, d = (prose(rng, 60, 10**6) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, c), (3, b + " tail"), (4, d), (4, c), (None, a + " tail"), (5, None), (5, d + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = jaccard.representatives(docs)
    texts = [r["text"] for r in kept.collect()]
    heads = sorted((t or "").removesuffix(" tail") for t in texts)
    assert heads == sorted([a, b, c, d, ""]) and kept.columns == docs.columns


def test_similar_blocks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 12000, dtype=np.uint64)
    sets = [np.unique(np.append(base[: 9000 + 60 * i], rng.integers(0, 2**62, 300, dtype=np.uint64))) for i in range(8)]
    want = [[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in sets] for x in sets]
    assert np.allclose(jaccard.jaccard(sets, sets), want, atol=1e-12) and np.allclose(jaccard.jaccard(sets[:2], sets[:3]), [x[:3] for x in want[:2]])


@pytest.mark.parametrize("cells,block", [(None, 2048), (6, 4)])
def test_vectors(spark, cells, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 12))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.concatenate([base, base[:30] + rng.normal(size=(30, 12)) * 0.15, base[:5]]))]
    rows += [(200, None, 0), (201, [0.0] * 12, 0), (202, [float("nan")] * 12, 0), (203, [1.0, 2.0], 1), (204, [2.0, 4.0], 1), (205, rows[0][1], None), (206, [], 0), (207, [1.0, None], 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i].add(j)
    reach = {i: i for i, _, _ in rows}
    for _ in rows:
        reach = {i: min([reach[i], *(reach[j] for j in links[i])]) for i in reach}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(data, cells=cells).collect()}
    assert got == {i: (len(links[i]), reach[i], reach[i] == i) for i, _, _ in rows} and any(links.values())
    assert vectors.near_duplicates(data.limit(0)).count() == 0
    text = data.withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 4, "0")))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(text, cells=cells).collect()}
    assert got == {f"v{i:04d}": (len(links[i]), f"v{reach[i]:04d}") for i, _, _ in rows}


@pytest.mark.parametrize("cells", [None, 5])
def test_vectors_of_any_size(spark, cells):
    """Tiny and huge components keep their directions and leave the others' links alone; rows without a key are vectors too."""
    rng = np.random.default_rng(14)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base]))]
    rows += [(100 + i, [float(x) * s for x in base[i]]) for i, s in enumerate((1e-200, 1e200, 1e-300, 1e300, 5e-324 * 2**40))]
    rows += [(None, rows[7][1]), (None, [1.0, 2.0]), (None, [2.0, 4.0]), (110, [3.0, 1.0])]
    data = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(data, cells=cells).collect() if r["vec_id"] is not None}
    assert [got[i]["component_id"] for i in range(20, 40)] == list(range(20)) and [got[100 + i]["component_id"] for i in range(5)] == list(range(5))
    assert all(got[i]["n_links"] == (2 if i % 20 < 5 or i % 20 == 7 else 1) for i in range(40)) and got[110]["kept"]
    none = sorted((r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_duplicates(data, cells=cells).where("vec_id is null").collect())
    assert none == [(1, "None", True), (1, "None", True), (2, "7", False)]


@pytest.mark.parametrize("cells", [None, 3])
def test_vectors_at_the_threshold(spark, cells):
    """Cosines of exactly 93/100 link, whatever the vectors' lengths; the next ones below do not. A NaN label equals itself."""
    roots = [(36, 7, 2, 1, 1), (36, 5, 5, 2, 1), (35, 11, 2, 1, 0), (35, 9, 6, 3, 0)]
    assert all(93**2 + sum(x * x for x in r) == 100**2 for r in roots)
    rows = []
    for i, (root, scale) in enumerate(itertools.product(roots, (1.0, 3.0, 7.0, 1 / 3, 1e150, 2.0**-1000))):
        at = np.eye(24)[i]  # groups at right angles to each other
        other = [93.0, *map(float, root)]
        rows += [(4 * i, np.kron(at, np.array([100.0, 0, 0, 0, 0, 0]) * scale)), (4 * i + 1, np.kron(at, np.array(other)))]
        rows.append((4 * i + 2, np.kron(at, np.array([93.0 * (1 - 1e-14), *map(float, root)])) * -1))  # 1 - 1e-14 times as long a first component: below
        rows.append((4 * i + 3, np.kron(at, np.array([-100.0, 0, 0, 0, 0, 0]))))
    data = spark.createDataFrame([(i, [float(x) for x in v], float("nan")) for i, v in rows], "vec_id long, embedding array<double>, label double")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(data, cells=cells).collect()}
    want = {}
    for i in range(24):
        want |= {4 * i: (1, 4 * i), 4 * i + 1: (1, 4 * i), 4 * i + 2: (0, 4 * i + 2), 4 * i + 3: (0, 4 * i + 3)}
    assert got == want


def brute_hits(texts, items, window=10):
    wins = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(k))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[key]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard_words", [250_000, 30])
def test_decontaminate(spark, texts, shard_words):
    passage = words(texts[32])[30:90]
    items = [(1, b" ".join(passage[:25]).decode()), (2, b" ".join(passage[10:40]).decode()), (3, "one"), (4, None), (5, ""), (6, "w1 w2 w1"), (6, "W1, w2!"), (7, b" ".join(passage[:25]).decode())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(spark, [*texts, "w1 w2 w1 w2 w1 one two", "x w1 w2"]).withColumn("hit_items", F.lit("clash"))
    all_texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = [(r["hit_words"], sum(x["end"] - x["start"] for x in r["hit_spans"]), r["hit_items"]) for r in sorted(decontaminate.hits(docs, bench, shard_words=shard_words).collect(), key=lambda r: r["doc_id"])]
    assert got == brute_hits(all_texts, items)
    clean = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, shard_words=shard_words).collect()}
    assert "one" not in clean.values() and None in clean.values() and texts[5] in clean.values()
    assert all(n < 10 for _, n, _ in brute_hits([clean[i] for i in range(32, 38) if i in clean], items[:2]))
    unnamed = spark.createDataFrame([(None, items[0][1])], "item_id long, text string")
    assert {tuple(r["hit_items"]) for r in decontaminate.hits(docs, unnamed).collect()} == {(), ("null",)}
    assert decontaminate.hits(docs.limit(0), bench).count() == 0 and decontaminate.hits(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0


def test_decontaminate_by_parts(spark, texts, monkeypatch):
    """Items of many automata, one longer than an automaton: the hits of brute force, and only documents that are hit are written."""
    passage = words(texts[32])[30:90]
    rng = np.random.default_rng(12)
    items = [(1, b" ".join(passage).decode()), (2, "one"), (3, b" ".join(passage[50:]).decode()), *((10 + i, prose(rng, 45, 10**6)) for i in range(6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(spark, [*texts, items[4][1] + " and more", "x " + items[5][1][20:]]).withColumn("hit_items", F.lit("clash"))
    written = []
    monkeypatch.setattr(decontaminate, "saved", lambda df, name, saved=decontaminate.saved: written.append(saved(df, name)) or written[-1])
    counts = []
    monkeypatch.setattr(decontaminate, "discard", lambda df: counts.append(df.count()))
    got = {r["doc_id"]: (r["hit_words"], sum(x["end"] - x["start"] for x in r["hit_spans"]), r["hit_items"]) for r in decontaminate.hits(docs, bench, shard_words=30).collect()}
    want = brute_hits([r["text"] for r in docs.orderBy("doc_id").collect()], items)
    assert [got[i] for i in range(len(want))] == want
    hit = sum(n > 0 for _, n, _ in want)
    assert len(counts) > 6 and set(counts) == {hit} and hit < len(want) / 2
    # the filter alone: no window is missed, and a full one changes nothing
    bitmap, sizes = decontaminate.window_filter(bench, "text", 10)
    assert sizes == [1, 10] and np.unpackbits(bitmap).sum() <= 4 * (1 + 51 + 1 + 6 * 36)
    monkeypatch.setattr(decontaminate, "window_filter", lambda *a: (np.full_like(bitmap, 255), sizes))
    full = {r["doc_id"]: r["hit_items"] for r in decontaminate.hits(docs, bench, shard_words=30).collect()}
    assert [full[i] for i in range(len(want))] == [w[2] for w in want]
    assert decontaminate.hits(docs.limit(0), bench, shard_words=30).count() == 0


def test_clean_cuts_short_items(spark):
    rng = np.random.default_rng(11)
    before, after = prose(rng, 40), prose(rng, 40)
    docs = make(spark, [f"{before}, What is the tallest of all hills? {after}", f"{before} in the end {after}", "tallest of all hills " + before])
    items = spark.createDataFrame([(1, "what is the tallest of all hills"), (2, "in the end")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, items).collect()}
    assert got == {0: f"{before}, ? {after}", 1: f"{before} in the end {after}", 2: "tallest of all hills " + before}


def test_mixing(spark, texts):
    rng = np.random.default_rng(5)
    mass = rng.integers(1, 1000, (3, 4, 2)).astype(float)
    shares = [np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    fitted = mixing.rake(mass, shares, 60)[0] / mass.sum()
    for axis, goal in enumerate(shares):
        assert np.allclose(fitted.sum(tuple(i for i in range(3) if i != axis)), goal, atol=1e-6)
    short = mixing.rake(mass, shares)[0] / mass.sum()  # the sweeps of the query are enough
    assert max(abs(short.sum(tuple(i for i in range(3) if i != axis)) - goal).max() for axis, goal in enumerate(shares)) < 1e-4
    docs = make(spark, texts).withColumn("weight", F.lit("clash")).union(spark.createDataFrame([(None, None, None, None, None, "x")], DOCS + ", weight string"))
    rows = mixing.mixed(docs).collect()
    blank = re.compile(r"[^ \t\r\n]+")
    assert len(rows) == len(texts) + 1 and all(r["n_tokens"] == len(blank.findall(r["text"] or "")) for r in rows)
    assert all(r["kept"] == (r["draw"] < r["probability"]) for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    """The expected shares of the kept tokens are the targets, though src0 has far fewer tokens than its target share."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = [(i, prose(rng, 40), ["en", "fr", "de", "es", "it"][i % 5], "src0" if i % 97 < 3 else f"src{1 + i % 6}", 0) for i in range(1500)]
    rows += [(2000 + i, x, None, None, 0) for i, x in enumerate([None, ""])]
    docs = spark.createDataFrame(rows, DOCS)
    targets = {"source": mixing.SOURCES, "lang": mixing.LANGUAGES, "topic": {"prose": 1.0}}
    out = mixing.mixed(docs, targets).collect()
    total = sum(r["n_tokens"] for r in out)
    kept = sum(r["n_tokens"] * r["probability"] for r in out)
    assert 0 < kept <= mixing.BUDGET * total + 1e-6 and max(r["probability"] for r in out if r["n_tokens"]) <= 1
    for d in ("source", "lang"):
        shares = collections.Counter()
        for r in out:
            shares[r[f"{d}_cell"]] += r["n_tokens"] * r["probability"] / kept
        goals = targets[d] | {mixing.OTHER: 1 - sum(targets[d].values())}
        assert all(abs(shares[v] - goals[v]) < 0.005 for v in goals)
    shown = mixing.achieved(mixing.mixed(docs.withColumn("__bytes", F.lit("clash")), targets), targets).collect()
    assert len(shown) == 11 and all(abs(r["expected"] - r["target"]) < 0.005 for r in shown if r["dimension"] != "topic")
    assert {r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()} == {r["doc_id"] for r in mixing.mixed(docs).collect() if r["kept"]}
    mass, weight = np.array([10.0, 90.0, 0.0]), np.array([0.5, 95 / 90, 0.0])
    assert np.allclose(mixing.reachable(mass, weight, 0.8), [0.4, 0.8 * 95 / 90, 1]) and (mixing.reachable(0 * mass, weight, 0.8) == 1).all()


def test_mixing_says_when_targets_are_out_of_reach(spark):
    """Source and language go hand in hand: their shares cannot differ. A slow fit that does get there goes on past the least sweeps."""
    rows = [(i, "one two three", *(("en", "src0") if i % 2 else ("fr", "src9")), 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    targets = {"source": {"src0": 0.7}, "lang": {"en": 0.3}}
    with pytest.warns(UserWarning, match="miss them by up to 0.4"):
        out = mixing.calibrate(docs, columns, F.lit(3), targets)
    shown = {(r["dimension"], r["value"]): r["expected"] for r in mixing.achieved(out, targets).collect()}
    assert abs(shown["source", "src0"] - shown["lang", "en"]) < 1e-9
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.calibrate(docs, columns, F.lit(3), targets, exact=True)
    slow = np.array([[1.0, 1000.0], [1000.0, 1.0]])
    fitted, miss = mixing.rake(slow, [np.array([0.9, 0.1]), np.array([0.9, 0.1])], 1)
    assert miss <= mixing.TOLERANCE and np.allclose(fitted.sum(0) / fitted.sum(), [0.9, 0.1], atol=1e-5)


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    """documents and labels as the driver gives them, with nulls, repeats, empty and long texts."""
    path = tmp_path_factory.mktemp("tables")
    docs = make(spark, [*texts, texts[3], "foulword " * 30000, "Der schöne Übergang über die Brücke"]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "en"))
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_queries_keep_their_contracts(spark, folder):
    """The registered queries themselves: columns, types, one row for each document, digests against plain Python."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    def rows(name, schema):
        found = queries[name](spark, folder)
        assert {(f.name, f.dataType.simpleString()) for f in found.schema} >= set(schema.items())
        out = {r["doc_id"]: r for r in found.collect()}
        assert set(out) == set(docs) and found.count() == len(docs)
        return out

    out = rows("op1_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    for i, d in docs.items():
        assert out[i]["text_crc32"] == zlib.crc32((d["text"] or "").encode()) and out[i]["size"] == len((d["text"] or "").encode()) + 1 and out[i]["grown_shard"] in (out[i]["shard"], 8)
    rows("op2_toxicity", {"doc_id": "bigint", "severity": "double", "toxic": "boolean"})
    out = rows("op3_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    for i, d in docs.items():
        letters = any(c.isalpha() for c in d["text"] or "")
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and (out[i]["lang_pred"] in ("de", "en") if letters else out[i]["lang_pred"] == "und") and 0 <= out[i]["score"] <= 1
    out = rows("op4_repeats", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    for (i, d), (kept, gone) in zip(docs.items(), brute_repeats([(d["text"] or "").encode() for d in docs.values()], 200), strict=True):
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["kept_sha256"]) == (len((d["text"] or "").encode()), gone, hashlib.sha256(kept).hexdigest())
    known, end = tokens.vocabulary()
    automaton = tokens.Memo(tokens.Automaton(known, end=end))
    out = rows("op5_token_counts", {"doc_id": "bigint", "n_tokens": "bigint"})
    assert all(out[i]["n_tokens"] == sum(map(automaton.automaton.count, split_words((d["text"] or "").encode()))) for i, d in docs.items())
    out = rows("op6_cross_entropy", {"doc_id": "bigint", "n_tokens": "bigint", "difference": "double"})
    assert all(out[i]["n_tokens"] == len(words(d["text"])) for i, d in docs.items())
    out = rows("op7_jaccard", {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"})
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == brute_jaccard([(i, d["text"]) for i, d in docs.items()])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    item = prose(rng, 20, 10**6)
    plain = [prose(rng, 60, 90) for _ in range(400)]
    toxic = [prose(rng, 50, 90) + " foulword nastyword vileword" for _ in range(200)]
    near = [plain[i] + " tail" for i in range(10)]
    leaked = [prose(rng, 60) + " " + item + " " + prose(rng, 10) for _ in range(5)]
    docs = make(spark, [*plain, *toxic, *near, *leaked])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(400 <= i < 600)) for i in range(0, 610, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)).cache())
    ids = [{r["doc_id"] for r in f.collect()} for f in frames]
    assert ids[1] == ids[0] - set(range(400, 600))
    assert ids[2] == {i for i, (c, _) in brute_jaccard([(r["doc_id"], r["text"]) for r in frames[1].collect()]).items() if i == c}
    assert ids[3] == ids[2] and not any(item in r["text"] for r in frames[3].collect())
    assert all(f.columns == docs.columns for f in frames[:-1]) and all(r["n_chars"] == len(r["text"]) for r in frames[3].collect())
    draw = {r["doc_id"]: r["kept"] for r in mixing.mixed(frames[3]).collect()}
    assert ids[4] == {i for i in ids[3] if draw[i]} and ids[5] == ids[4]
    assert {(r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["shard"]) for r in frames[5].collect()}
    assert hashlib.sha256(b"").hexdigest() == decontaminate.digest([])


def test_jaccard_sizes_that_cannot_link_are_left_out_early(spark, monkeypatch):
    """Two sets alone in a node, one of them less than the threshold times the other, take no part; all links stay."""
    words = lambda seed, n: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n)]
    parts = [words(s, 120) for s in range(12)]
    made = [(3 * i, " ".join(p)) for i, p in enumerate(parts)] + [(3 * i + 1, " ".join(p[:90])) for i, p in enumerate(parts)] + [(3 * i + 2, " ".join(words(99 + i, 50))) for i in range(12)]
    counts = {}

    def counted(df, name, held=jaccard.saved):
        out = held(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in jaccard.join(docs).collect())
    assert counts["jaccard-forest"] == counts["jaccard-sets"] == 0
    near = [(100 + i, " ".join(p[:114])) for i, p in enumerate(parts)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(made + near, "doc_id long, text string")).collect()}
    # 86 of 110 shingles are less than the threshold
    assert all(found[3 * i] == (3 * i, 1) and found[100 + i] == (3 * i, 1) and found[3 * i + 1] == (3 * i + 1, 0) for i in range(12))


def test_jaccard_gives_back_shuffle_files_and_moves_few_texts(spark, monkeypatch):
    """Shuffle files stayed until the driver collected its garbage, and all texts were dealt out to meet the few that take part."""
    rng = np.random.default_rng(31)
    made = [(i, " ".join(map(str, rng.integers(10**9, size=30)))) for i in range(400)]
    made += [(400 + i, f"{text} tail") for i, (_, text) in enumerate(made[:10])]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {n for d in folders for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    passed = {}

    def counted(df, wanted, *on, held=common.likely):
        out = held(df, wanted, *on)
        passed[on] = df.count(), out.count()
        return out

    monkeypatch.setattr(jaccard, "likely", counted)
    before = files()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with common.shuffles_freed(spark):  # what is collected here as well
            links = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {i for i, n in links.items() if n} == {*range(10), *range(400, 410)}
    assert passed["k1", "k2"][0] == 410 and 20 <= passed["k1", "k2"][1] < 100
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("most", [6, 28])
def test_likely_keeps_all_matches(spark, most, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("x"), "id")).alias("name"))
    wanted = rows.where("id % 30 = 1 or id = 0")
    kept = common.likely(rows, wanted, "id", "name")
    assert kept.schema == rows.schema and kept.join(wanted, "id", "left_semi").count() == wanted.count()
    assert kept.count() <= (3000 if most == 6 else 350)
    assert common.likely(rows, wanted.limit(0), "id").count() == 0

"""Line dedup, source divergence and the Merkle manifest against brute force, with nulls, repeats, ties and long texts."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospan.llm import divergence, lines, manifest, ranking

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(seed, n=160):
    """Documents with common and rare lines, null and shared keys, repeated rows, null and empty texts, one very long text."""
    rng = np.random.default_rng(seed)
    bank = [f"This line is common number {i} " + "é" * (i % 3) for i in range(12)] + ["short", "\tÀ twenty point line\x0b ", "x" * 19, "é" * 20, ""]
    rows = []
    for i in range(n):
        text = "\n".join([*(rng.choice([x, x.upper(), f"  {x} ", x + "\r"]) for x in rng.choice(bank, rng.integers(0, 6))), f"own line {rng.integers(10**9)} of this document"])
        rows.append((i, text, ["en", "de", None, ""][i % 4], f"s{i % 7}" if i % 11 else None, len(text)))
    rows += [rows[5], rows[5], (7, "THIS LINE IS COMMON NUMBER 3", "en", "s1", 3), (None, bank[4] + "\n" + bank[5], "en", "s1", 3), (None, bank[4], "fr", None, None)]
    return [*rows, (900, None, None, None, None), (901, "", "en", "s", 0), (902, "\n\n", "en", "s", 2), (903, "\n".join(bank[i % 5] for i in range(30000)), "de", "s2", 1)]


def cut(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line))

    held = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 512])
def test_line_dedup(spark, parts, monkeypatch):
    monkeypatch.setattr(lines, "HELD", 200)  # several contributions from a task
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("__0", F.lit("mine")).repartition(5)
    out = lines.drop_repeated(docs, parts=parts)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__0", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in out.collect()), key=str)
    assert got == cut(rows) and any(r[2] > 3 for r in got)
    assert [r["text"] for r in out.where("doc_id = 900").collect()] == [None]
    assert lines.drop_repeated(docs.limit(0)).count() == 0


def test_line_filters_miss_no_repeat(spark):
    """A filter so full that it suspects nearly every line gives the same result, and no repeated line is missed in a sparse one."""
    texts = [(f"line number {i % 700} is long enough",) for i in range(1000)]
    held = spark.createDataFrame(texts, "t string").select(F.col("t").cast("binary")).repartition(7)
    seen, bits = lines.twice_seen(held, 20, 1)
    suspects = lines._marked(spark.createDataFrame(texts, "t string"), 0, 20, seen, bits).where(F.size("__suspects") > 0)
    found = {r["t"] for r in suspects.collect()}
    assert {t for (t,), n in collections.Counter(texts).items() if n > 1} <= found and len(found) < 330
    rows = rows_of(5, 60)
    docs = spark.createDataFrame(rows, DOCS)
    full = np.full(len(seen), 255, np.uint8)
    all_lines = lines._marked(docs, 1, 20, full, bits).select(F.explode("__suspects.key")).count()
    assert all_lines > 60  # every long line is a suspect


def audit(rows, least=30, k=50):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {i: i + 32 for i in range(65, 91)}
    n, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        own = terms.findall((text or "").translate(low))
        n[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = []
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= least]
        of = {s: c for (x, s), c in n.items() if x == lang}

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // total for t in kept}

        whole, p = share(sum(of.values(), collections.Counter())), {s: share(c) for s, c in of.items()}
        for s in of:
            pair = [(h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in of if h != s]
            term = [(t, p[s][t] - whole[t]) for t in kept if of[s][t] and p[s][t] > whole[t]]
            for part, listed, most in (("pair", pair, len(pair)), ("term", term, k)):
                listed.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(listed[:most], 1)]
    return sorted(out)


def test_divergence(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    bank = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Éte", "été", "É", "naïve", "日本"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(bank, rng.integers(1, 60)))
        rows.append((i, text.upper() if i % 3 else text, ["en", "de", None][i % 3], f"s{i % 5}" if i % 13 else None, 0))
    # a source of ties: many terms, each as often as the others; a language that keeps nothing; groups without terms
    rows += [(1000 + i, " ".join(f"tie{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)), "en", "tied", 0) for i in range(31)]
    rows += [(2000, "lonely", "fr", "a", 0), (2001, None, "fr", "b", 0), (2002, "123 !", "en", "void", 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in divergence.op12_source_divergence(spark, str(tmp_path)).collect())
    assert got == audit(rows) and any(r[1] == "tied" and r[2] == "term" and r[5] == 50 for r in got)
    monkeypatch.setattr(divergence, "HELD", 50)  # counters are sent often
    monkeypatch.setattr(divergence, "PIECE", 40)
    assert sorted(tuple(r) for r in divergence.op12_source_divergence(spark, str(tmp_path)).collect()) == got
    empty = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert divergence.op12_source_divergence(spark, empty).collect() == []


@pytest.mark.parametrize("text,piece", [(b"", 4), (b"ab CD ef", 3), (b"abcdefgh", 3), (b"abcdefgh ij", 3), (b" a  b1c ", 2)])
def test_terms_by_pieces(text, piece):
    assert sum(divergence.listed(text, piece), []) == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_top(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("a", int(rng.integers(0, 1 << 30)), f"i{i}") for i in range(300)] + [("b", 7, "x" * 40 + f"{i:03}") for i in range(90)]
    rows += [("c", 0, "only"), ("d", 5, "ab"), ("d", 5, "abc"), ("d", 5, "abd"), ("d", 9, "z"), ("d", 5, "é"), ("d", 5, "a"), ("e", (1 << 30) - 1, ""), ("e", 1, "x")]
    spark.createDataFrame(rows, "g string, value long, item string").write.parquet(str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    for k in (1, 3, 50):
        want = []
        for g in "abcde":
            own = sorted(((v, i) for x, v, i in rows if x == g), key=lambda x: (-x[0], x[1].encode()))[:k]
            want += [(g, i, v, r) for r, (v, i) in enumerate(own, 1)]
        assert sorted(tuple(r) for r in ranking.top(held, ["g"], "value", "item", k).collect()) == sorted(want)


def level(nodes, size=2):
    return [sha("".join(nodes[i : i + size])) for i in range(0, len(nodes), size)]


def proof_of(nodes, i, size=2):
    out = []
    while len(nodes) > 1:
        run = nodes[i // size * size : i // size * size + size]
        at = i % size
        out.append((run[:at], run[at + 1 :]))
        nodes, i = level(nodes, size), i // size
    return out, nodes[0]


def merkle(rows, size=2):
    def leaf(doc, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((-1 if r[0] is None else r[0], leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots = []
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        subroots.append(proof_of([h for _, h, _ in groups[name]], 0, size)[1])
    out = []
    for g, name in enumerate(names):
        upper, root = proof_of(subroots, g, size)
        for i, (_, held, r) in enumerate(groups[name]):
            path = proof_of([h for _, h, _ in groups[name]], i, size)[0] + upper
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(*r[:4], r[4] + 1) if bad else held
            for before, after in path:
                now = sha("".join([*before, now, *after]))
            out.append((r[0], held, subroots[g], root, sha("".join("".join(a + b) for a, b in path)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 3, 10])
def test_merkle(spark, tmp_path, span, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", span)
    rows = rows_of(9, 70)
    rows = [*rows, (5000, "alone", "zz", None, None), (5001, "a", "éé", "", 2), (9223372036854775807, "b", "éé", "", 9223372036854775807)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit("clash")).withColumn("held", F.lit(1))
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in manifest.op13_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == merkle(rows) and {r[6] for r in got} == {True, False}


def test_merkle_of_little(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(3, "t", None, "s", 1)]), ("same", [(3, "t", None, "s", 1)] * 5)):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert sorted((tuple(r) for r in manifest.op13_merkle(spark, str(tmp_path / name)).collect()), key=str) == (merkle(rows) if rows else [])


def test_manifest_of_other_arity(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], "s", i) for i in range(53)]
    docs = spark.createDataFrame(rows, DOCS)
    out = manifest.manifest(docs, "doc_id", "lang", manifest.digest([F.col(f) for f in manifest.FIELDS]), arity=3).withColumn("back", manifest.folded(F.col("leaf"), F.col("proof")))
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["back"]) for r in out.collect())
    assert got == sorted((r[0], r[1], r[2], r[3], r[3]) for r in merkle(rows, 3))

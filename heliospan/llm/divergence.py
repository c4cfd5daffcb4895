"""Source divergence audit: which sources of a language use other words than the rest, and which words.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Each language keeps the terms that
are in ``least_docs`` of its documents or more (V terms). Every (language, source) group and each language gives each kept term
with count occurrences p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N being the group's sum of counts.

``pairs``: the distance of two sources of a language, the sum over all V terms of abs(p - q). Most terms are in few sources,
so no source is spread over all terms: with b the p of a term that a group lacks, the distance is

    V |bg - bh|  +  sum over g's terms (|p - bh| - |bg - bh|)  +  the same for h
    +  sum over shared terms (|p - q| - |p - bh| - |q - bg| + |bg - bh|).

The middle sums come from running totals over each group's distinct values of p; the last one is added up by the tasks
that hold the terms, and only sums by pair of sources leave them. ``terms``: a group's terms with p above the language's q, the
largest ``k`` by radix selection (``ranking.top``).

All arithmetic is exact: products in decimals of 38 digits, sums in 64-bit integers. Counts cover all documents; tasks add
them up before anything is shuffled, and a text that is longer than ``PIECE`` is counted in pieces. A term's list has one entry for
each source, as each group's result has.

Defined results: null text, language and source are ''; rows that repeat are documents of their own; a group without terms
has p from its baseline, and distances 0 if its language keeps no term; ties go by UTF-8 bytes. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.llm import ranking
from heliospan.llm.common import saved, table
from heliospan.llm.texts import pieces

SCALE, SMOOTH = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
#: For bytes.translate: letters lower-cased, bytes from 0x80 on as they are, blanks for the rest.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20
#: Counters of a task before it sends them.
HELD = 400_000
GROUP = ("lang", "source")


def listed(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, in order, by pieces of about so many bytes."""
    text, at = text.translate(LETTERS), 0
    while len(text) - at > piece:
        end = text.rfind(b" ", at, at + piece)
        end = end if end > at else text.find(b" ", at + piece)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in each group and documents of it. docs: lang, source, text as bytes."""

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = [(g, s, t, c, d[t]) for (g, s), (n, d) in held.items() for t, c in n.items()]
        g, s, t, c, d = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(g, pa.string()), pa.array(s, pa.string()), pa.array(t, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in pieces(batches, 2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in listed(text.as_py(), PIECE):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, by): the kept terms with their occurrences in the language and in each source that has them."""
    terms = counted(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def share(count: str, total: str, terms: str = "kept") -> Column:
    """p of a count, exact; null where there are no terms."""
    many = f"cast({total} as decimal(38,0)) + {SMOOTH} * {terms}"
    return F.expr(f"case when {terms} > 0 then 1 + cast((cast({count} as decimal(20,0)) + {SMOOTH}) * {SCALE} as decimal(38,0)) div cast({many} as decimal(38,0)) end")


def audited(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Written tables: every group (lang, source, size, its own terms, those kept in the language and said there,
    baseline b), and every term of every group (lang, source, term, p, q of the language, b)."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    terms = saved(kept_terms(docs, least_docs), "divergence-terms")
    each = terms.select("lang", "term", "total", F.inline("by"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("said"))
    own = each.groupBy(*GROUP).agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = docs.select(*GROUP).distinct().join(own, list(GROUP), "left").join(langs, "lang", "left").na.fill(0, ["size", "own", "kept", "said"])
    groups = saved(groups.withColumn("b", share("0", "size")), "divergence-groups")
    shares = each.join(groups, list(GROUP)).select(*GROUP, "term", share("n", "size").alias("p"), share("total", "said").alias("q"), "b")
    return groups, saved(shares, "divergence-shares")


def _shared(shares: DataFrame) -> DataFrame:
    """(lang, g, h, d): the last sum of the formula, in parts, once for each unordered pair of sources with a common term."""
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "b")).alias("by")).where(F.size("by") > 1).select("lang", "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def sent() -> pa.RecordBatch:
            rows = [(*k, v) for k, v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "g", "h", "d"])

        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            entries, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            source, p, b = (entries.field(i) for i in range(3))
            source = source.dictionary_encode()
            names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
            row = np.repeat(np.arange(len(sizes)), sizes)
            code, p, b = source.indices.to_numpy(), p.to_numpy(), b.to_numpy()
            tongue = lang.indices.to_numpy()[row]
            order = np.lexsort((code, row))
            row, code, p, b, tongue = row[order], code[order], p[order], b[order], tongue[order]
            for step in range(1, int(sizes.max(initial=1))):
                i = np.flatnonzero(row[step:] == row[:-step])
                if not len(i):
                    break
                j = i + step
                d = np.abs(p[i] - p[j]) - np.abs(p[i] - b[j]) - np.abs(p[j] - b[i]) + np.abs(b[i] - b[j])
                pair = (tongue[i].astype(np.int64) * len(names) + code[i]) * len(names) + code[j]
                by = np.argsort(pair, kind="stable")
                at = np.flatnonzero(np.diff(pair[by], prepend=-1))
                for one, v in zip(pair[by][at].tolist(), np.add.reduceat(d[by], at).tolist(), strict=True):
                    g, h = sorted((names[one // len(names) % len(names)], names[one % len(names)]))
                    sums[langs[one // len(names) ** 2], g, h] += v
                if len(sums) >= HELD:
                    yield sent()
                    sums.clear()
        yield sent()

    return lists.mapInArrow(run, "lang string, g string, h string, d long")


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source of a language to each other one."""
    g, h = (groups.select("lang", F.col("source").alias(a), F.col("b").alias(f"b{a}"), F.col("own").alias(f"own_{a}"), "kept") for a in "gh")
    both = g.join(h.drop("kept"), "lang").where("g <> h").withColumn("apart", F.abs(F.col("bg") - F.col("bh")))
    # |p - bh| over g's terms: running totals over g's distinct p, read at bh
    values = shares.groupBy("lang", F.col("source").alias("g"), F.col("p").alias("x")).agg(F.count("*").alias("n"))
    values = values.withColumn("h", F.lit(None).cast("string")).withColumn("apart", F.lit(None).cast("long")).withColumn("own_g", F.lit(None).cast("long"))
    asked = both.where("kept > 0").select("lang", "g", F.col("bh").alias("x"), F.lit(0).cast("long").alias("n"), "h", "apart", "own_g")
    order = W.partitionBy("lang", "g").orderBy("x")
    line = values.union(asked).withColumn("upto", F.sum("n").over(order)).withColumn("sum", F.sum(F.col("n") * F.col("x")).over(order))
    line = line.withColumn("all", F.sum(F.col("n") * F.col("x")).over(W.partitionBy("lang", "g"))).where("h is not null")
    one = line.select("lang", "g", "h", (2 * (F.col("x") * F.col("upto") - F.col("sum")) + F.col("all") - F.col("x") * F.col("own_g") - F.col("apart") * F.col("own_g")).alias("d"))
    more = one.union(_shared(shares))
    parts = both.select("lang", "g", "h", F.coalesce(F.col("kept") * F.col("apart"), F.lit(0)).alias("d")).union(more).union(more.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "d"))
    return parts.groupBy("lang", F.col("g").alias("source"), F.col("h").alias("item")).agg(F.sum("d").alias("value"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's distance to the other sources of its language, and its 50 terms that stand out most."""
    groups, shares = audited(table(spark, sf_dir, "documents"))
    near = pairs(groups, shares)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")))
    above = saved(shares.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "divergence-above")
    best = ranking.top(above, GROUP, "value", "item", TOP)
    columns = (*GROUP, "part", "item", "value", "rank")
    return near.withColumn("part", F.lit("pair")).select(*columns).union(best.withColumn("part", F.lit("term")).select(*columns))


SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
said AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n, total FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
size AS (SELECT lang, source, sum(n) AS gn, sum(total) AS ln, count(*) AS v FROM dense GROUP BY ALL),
p AS (
  SELECT dense.*, ({SCALE}::HUGEINT * (n + {SMOOTH})) // (gn + {SMOOTH} * v) + 1 AS p, ({SCALE}::HUGEINT * (total + {SMOOTH})) // (ln + {SMOOTH} * v) + 1 AS q
  FROM dense JOIN size USING (lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM listed)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""

"""Merkle manifest of a dataset: a digest of every row, a root of every group and of all, and a proof for each row.

A leaf is the SHA-256 (lowercase hex) of a row's fields. Per group, leaves stand in the order of their keys; every ``arity``
consecutive nodes have the hash of their digests as parent, until one is left. The groups' roots, in the groups' order, have a
tree of their own.

* Order: leaves are dealt by range over (group, key, leaf) and written; a leaf's index is its place in its task's
  range plus the sizes of the ranges before it. No task sorts a group.
* Up: ``combineByKey`` over spans of ``SPAN`` levels. A combiner (``Partial``) takes indexed child digests as they come; when
  a parent has as many as its arity, which follows from the group's size, it turns into its own parent's child. Ranges are in
  order, so tasks send little more than finished span tops. The tops are the next round's children.
* Down: the spans again, each with the proof of its top; the links from parent to children give each child's siblings. A task holds
  one span at a time, at most ``arity ** SPAN`` leaves.

A proof is a list of levels; each is a text in which the dot stands for the node itself, between its siblings' digests.

Defined results: a null field is '-', so it differs from an empty one; a null group is a group of its own and comes
first, as does a null key; rows that share a key stand in the order of their leaves, and equal rows have leaves of
their own; a single row is its own root. An empty table gives an empty table. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.llm.common import saved, table

ARITY = 2
#: Levels that a round resolves: 1,024 leaves of a binary tree.
SPAN = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest(fields: Iterable[Column]) -> Column:
    """The leaf of a row."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Partial:
    """Nodes of one span: children that wait for their siblings, finished parents with their children, and the top.

    size: nodes on the lowest level of the whole group; span: levels to climb.
    """

    def __init__(self, size: int, arity: int, span: int, links: bool = False):
        self.sizes = [size]
        while self.sizes[-1] > 1 and len(self.sizes) <= span:
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.arity, self.waiting, self.links, self.top = arity, {}, {} if links else None, None

    def add(self, level: int, index: int, held: str) -> Partial:
        while level + 1 < len(self.sizes):
            parent = (level + 1, index // self.arity)
            children = self.waiting.setdefault(parent, {})
            children[index % self.arity] = held
            if len(children) < min(self.arity, self.sizes[level] - parent[1] * self.arity):
                return self
            del self.waiting[parent]
            digests = [children[i] for i in range(len(children))]
            if self.links is not None:
                self.links[parent] = digests
            (level, index), held = parent, sha("".join(digests))
        self.top = (index, held)
        return self

    def merge(self, other: Partial) -> Partial:
        for (level, index), children in other.waiting.items():
            for i, held in children.items():
                self.add(level - 1, index * self.arity + i, held)
        self.top = self.top or other.top
        return self

    def proofs(self, upper: list[str]) -> dict[int, list[str]]:
        """Proof of each lowest node, given that of the top."""
        found = {(len(self.sizes) - 1, self.top[0]): upper}
        for level, index in sorted(self.links, reverse=True):
            digests, above = self.links[level, index], found.pop((level, index))
            for i in range(len(digests)):
                found[level - 1, index * self.arity + i] = ["".join(digests[:i]) + "." + "".join(digests[i + 1 :]), *above]
        return {index: proof for (_, index), proof in found.items()}


def placed(rows: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """rows, with ``index`` in their group and its ``size``; their order is that of by, whose first column is the group (not null)."""
    # the row's own number last: equal rows may be dealt to several tasks
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie")
    dealt = saved(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    ranges = dealt.groupBy(group, F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = W.partitionBy(group)
    ranges = ranges.select(group, "range", (F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return dealt.withColumn("range", F.shiftright("at", 33)).join(ranges, [group, "range"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("index"), "size")


NODE = "g string, size long, index long, held string"


def raised(nodes: DataFrame, arity: int) -> DataFrame:
    """The tops of all spans: the nodes SPAN levels up, or a group's root."""
    levels, span = SPAN, arity**SPAN
    merged = nodes.select("g", "size", "index", "held").rdd.map(lambda r: ((r[0], r[2] // span), (r[1], r[2], r[3]))).combineByKey(
        lambda v: Partial(v[0], arity, levels).add(0, v[1], v[2]), lambda p, v: p.add(0, v[1], v[2]), Partial.merge, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    tops = merged.map(lambda kv: (kv[0][0], -(-kv[1].sizes[0] // span), kv[1].top[0], kv[1].top[1]))
    return nodes.sparkSession.createDataFrame(tops, NODE)


def tree(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The written nodes of each round, from the leaves to the roots (of which each group has one)."""
    rounds = [leaves]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(saved(raised(rounds[-1], arity), "manifest-nodes"))
    return rounds


def _down(names: Sequence[str], more: Sequence[str], arity: int, levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def down(children: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        partial = Partial(int(children["size"].iloc[0]), arity, levels, links=True)
        for index, held in zip(children["index"], children["held"], strict=True):
            partial.add(0, int(index), held)
        proofs = partial.proofs(list(top["proof"].iloc[0]))
        children["proof"] = [proofs[int(i)] for i in children["index"]]
        for name in more:
            children[name] = top[name].iloc[0]
        return children[[*names]]

    return down


def proved(rounds: Sequence[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with their ``proof``, and the columns of tops. tops: g, index (0), proof of each root, further columns."""
    for nodes in [*reversed(rounds[:-1])] or [rounds[0]]:
        more = [f for f in tops.schema.fields if f.name not in ("g", "index", "proof")]
        schema = T.StructType([*nodes.schema.fields, T.StructField("proof", T.ArrayType(T.StringType())), *more])
        spans = nodes.withColumn("span", F.floor(F.col("index") / arity**SPAN)).groupBy("g", "span")
        tops = spans.cogroup(tops.withColumnRenamed("index", "span").groupBy("g", "span")).applyInPandas(_down(schema.names, [f.name for f in more], arity, SPAN), schema)
        if nodes is not rounds[0]:
            tops = tops.drop("size", "held")
    return tops


def manifest(df: DataFrame, key: str, group: str, leaf: Column, arity: int = ARITY, **more: Column) -> DataFrame:
    """(key, leaf, position, subroot, root, proof) of every row, and further columns that are made from it.

    The whole order goes by the group, then by the key. ``more``: short columns, as they are carried along.
    """
    # nulls first and apart from every text
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).alias("key"), leaf.alias("held"), *(c.alias(n) for n, c in more.items()))
    leaves = saved(placed(saved(rows, "manifest-leaves"), ("g", "key", "held"), "g"), "manifest-leaves")
    rounds = tree(leaves, arity)
    roots = saved(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "held"), "manifest-roots")
    uppers = tree(saved(placed(roots, ("g", "name"), "g"), "manifest-roots"), arity)
    root = uppers[-1].select("held").first()
    ends = df.sparkSession.createDataFrame([("", 0, [])] if root else [], "g string, index long, proof array<string>")
    tops = proved(uppers, ends, arity).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("index"), "proof", F.col("held").alias("subroot"))
    out = proved(rounds, tops, arity)
    return out.select(F.col("key").alias(key), F.col("held").alias("leaf"), F.col("index").alias("position"), "subroot", F.lit(root and root[0]).cast("string").alias("root"), "proof", *more)


def siblings(proof: Column) -> Column:
    """All siblings' digests, level by level, left to right, in one text."""
    return F.replace(F.array_join(proof, ""), F.lit("."), F.lit(""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda held, level: F.sha2(F.replace(level, F.lit("."), held), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its language's root, the root, its proof, and what its proof gives after tampering."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(f) for f in FIELDS]
    changed = [F.col(f).cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(docs, "doc_id", "lang", digest(fields), tampered=F.when(tampered, digest(changed)))
    root = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


SQL = rf"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
doc AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS changed,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 7 = 0 AS tampered
  FROM documents, polynomial),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM doc),
nodes(g, lvl, n, idx, held) AS (
  SELECT g, 0, n, idx, leaf FROM leaves
  UNION ALL
  SELECT g, lvl + 1, (n + 1) // 2, idx // 2, sha256(string_agg(held, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, lvl, n, idx // 2),
subroots AS (SELECT g, held, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers(lvl, n, idx, held) AS (
  SELECT 0, n, idx, held FROM subroots
  UNION ALL
  SELECT lvl + 1, (n + 1) // 2, idx // 2, sha256(string_agg(held, '' ORDER BY idx)) FROM uppers WHERE n > 1 GROUP BY lvl, n, idx // 2),
steps AS (SELECT DISTINCT g, lvl, n FROM nodes WHERE n > 1),
levels AS (
  SELECT l.g, l.idx, s.lvl, l.idx >> s.lvl AS own, b.held AS other FROM leaves l JOIN steps s USING (g)
  LEFT JOIN nodes b ON b.g = l.g AND b.lvl = s.lvl AND b.idx = xor(l.idx >> s.lvl, 1)),
lower AS (SELECT g, idx, list(CASE WHEN other IS NULL THEN '.' WHEN own % 2 = 0 THEN '.' || other ELSE other || '.' END ORDER BY lvl) AS proof FROM levels GROUP BY ALL),
tops AS (
  SELECT s.g, list(CASE WHEN b.held IS NULL THEN '.' WHEN (s.idx >> u.lvl) % 2 = 0 THEN '.' || b.held ELSE b.held || '.' END ORDER BY u.lvl) AS proof
  FROM subroots s, (SELECT DISTINCT lvl FROM uppers WHERE n > 1) u LEFT JOIN uppers b ON b.lvl = u.lvl AND b.idx = xor(s.idx >> u.lvl, 1) GROUP BY ALL),
proofs AS (
  SELECT l.doc_id, l.leaf, s.held AS subroot, (SELECT held FROM uppers WHERE n = 1) AS root, CASE WHEN tampered THEN changed ELSE l.leaf END AS start,
    list_concat(coalesce(lower.proof, []), coalesce(tops.proof, [])) AS proof
  FROM leaves l JOIN subroots s ON s.g = l.g LEFT JOIN lower ON lower.g = l.g AND lower.idx = l.idx LEFT JOIN tops ON tops.g = l.g),
folded AS (SELECT *, list_reduce(list_concat([start], proof), lambda h, s: sha256(replace(s, '.', h))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '.', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, each by a weighted hash draw.

A node's draw for a key is an exponential variate with the weight of its subtree as rate; the child with the smallest
draw takes the key, so each child gets rows in proportion to its weight. When weights change, a key moves between two
children only if the weight of one of them changed: movement stays in the subtrees whose weights change. A shard that
joins in a region of its own (``grown``) changes no weight elsewhere and therefore takes rows only into itself.

The placement is one projection with no shuffle; slots add two aggregations with map-side sums. Everything is built-in
functions. Nulls: a null key is placed like the string 'null'. Rows with equal keys share their shard. Only the size of a
text counts, however long. An empty table gives an empty table. Other columns pass through; columns named as ``OUT`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.llm.common import UNIFORM_SQL, table, uniform

OUT = ("region", "rack", "shard")
SLOT_BUCKETS = 4096
#: Equal rows are numbered in parts of so many, so that no task makes all rows of a hot key.
PART_ROWS = 1024


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Equal shards 0 .. shards-1, per_rack to a rack and racks to a region."""
    return [Shard(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: no other subtree's weight changes."""
    return [*tree, Shard(max((s.region for s in tree), default=-1) + 1, 0, max((s.shard for s in tree), default=-1) + 1, weight)]


def _children(tree: Sequence[Shard], depth: int) -> dict[tuple, float]:
    """Path of each node at this depth and the weight of its subtree."""
    weights: dict[tuple, float] = {}
    for s in tree:
        if s.weight > 0:
            weights[tuple(s[: depth + 1])] = weights.get(tuple(s[: depth + 1]), 0.0) + s.weight
    return weights


def place(key: Column, tree: Sequence[Shard]) -> dict[str, Column]:
    """Columns region, rack and shard for a string key. The tree is an argument, so its size is bounded by the caller."""
    if len({s.shard for s in tree}) != len(tree) or not _children(tree, 0):
        raise ValueError("the tree needs distinct shards and some weight")

    def draw(path: tuple, weight: float) -> Column:
        node = F.concat(key, F.lit("|" + "/".join(map(str, path))))
        return F.struct((-F.log(uniform(node)) / F.lit(weight)).alias("draw"), F.lit(path[-1]).alias("child"))

    def nearest(parent: tuple, depth: int) -> Column:
        drawn = [draw(p, w) for p, w in sorted(_children(tree, depth).items()) if p[:-1] == parent]
        return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["child"]

    region = nearest((), 0)
    out = {"region": region}
    for depth, name in ((1, "rack"), (2, "shard")):
        chosen = F.lit(None).cast("int")
        for parent in sorted(_children(tree, depth - 1)):
            here = F.lit(True)
            for column, value in zip(OUT, parent, strict=False):
                here = here & (F.col(column) == value)
            chosen = F.when(here, nearest(parent, depth)).otherwise(chosen)
        out[name] = chosen
    return out


def assign(df: DataFrame, key: str, tree: Sequence[Shard], names: Sequence[str] = OUT) -> DataFrame:
    """df with the region, rack and shard of each row, under the given names."""
    kept = [c for c in df.columns if c not in names]
    inner = [f"__{i}" for i in range(len(kept))]  # columns may have the names made here
    held = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).toDF(*inner, "__key")
    for name, column in place(F.col("__key"), tree).items():
        held = held.withColumn(name, column)
    return held.select(*inner, *OUT).toDF(*kept, *names)


def slots(df: DataFrame, by: Sequence[str], shard: str = "shard") -> DataFrame:
    """Rows of df, which are functions of the columns ``by``, with a gapless number from 0 in each shard (``slot``).

    Equal rows are counted first. The order in a shard is a hash bucket, then ``by``; the start of each bucket comes
    from a table of at most shards x SLOT_BUCKETS sums, which is why it may be broadcast.
    """
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    rows = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / PART_ROWS).cast("int") - 1)))
    rows = rows.withColumn("__n", F.least(F.lit(PART_ROWS), F.col("__n") - F.col("__part") * PART_ROWS))
    # all of ``by``, so that rows which share a key (or have none) are spread; parts of one hot row too
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by), F.lit("slot"), F.when(F.col("__part") > 0, F.col("__part").cast("string")))
    rows = rows.withColumn("__bucket", F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int"))
    before = (W.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__rows").over(W.partitionBy(shard).orderBy("__bucket").rowsBetween(*before)), F.lit(0)))
    rows = rows.join(F.broadcast(starts.drop("__rows")), [shard, "__bucket"])
    inside = W.partitionBy(shard, "__bucket").orderBy(*by, "__part").rowsBetween(*before)
    rows = rows.withColumn("__first", F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))
    return rows.select(*df.columns, F.col("slot").cast("long").alias("slot"))


SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``key``; grown_shard is the place with one more shard."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    tree = topology(SHARDS)
    placed = assign(docs, "doc_id", tree)
    placed = assign(placed, "doc_id", grown(tree), ("__region", "__rack", "grown_shard")).drop("__region", "__rack")
    placed = slots(placed, ("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


def _draw_sql(path: str, weight: int) -> str:
    key = f"coalesce(doc_id::VARCHAR, 'null') || '|{path}'"
    return f"(-ln({UNIFORM_SQL.format(key)}) / {weight}.0)"


def _sql() -> str:
    region = {r: _draw_sql(str(r), w) for r, w in ((0, 4), (1, 4), (2, 1))}
    rack = {(r, k): _draw_sql(f"{r}/{k}", 2) for r in (0, 1) for k in (0, 1)}
    leaf = {s: _draw_sql(f"{s // 4}/{s // 2 % 2}/{s}", 1) for s in range(SHARDS)}
    racks = " ".join(f"WHEN {r} THEN CASE WHEN {rack[r, 0]} <= {rack[r, 1]} THEN 0 ELSE 1 END" for r in (0, 1))
    leaves = " ".join(f"WHEN {i} THEN CASE WHEN {leaf[2 * i]} <= {leaf[2 * i + 1]} THEN {2 * i} ELSE {2 * i + 1} END" for i in range(4))
    return f"""
    WITH polynomial AS (
      SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
    docs AS (
      SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
      FROM documents, polynomial),
    regions AS (
      SELECT *, CASE WHEN {region[0]} <= {region[1]} THEN 0 ELSE 1 END AS region,
        {region[2]} < least({region[0]}, {region[1]}) AS moves,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || size || '|' || text_crc32 || '|slot'), 1, 3))::INT AS bucket FROM docs),
    racks AS (SELECT *, CASE region {racks} END AS rack FROM regions),
    placed AS (SELECT *, CASE 2 * region + rack {leaves} END AS shard FROM racks)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, region::INT AS region, rack::INT AS rack,
      shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
      (CASE WHEN moves THEN {SHARDS} ELSE shard END)::INT AS grown_shard
    FROM placed"""


SQL = _sql()

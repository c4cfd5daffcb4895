"""The k best rows of every group by radix selection: no group is sorted or gathered.

Histograms over the digits of the value, from the highest, find each group's kth value: a pass counts rows by group and
digit (with map-side sums, 1,024 counts a group at most) and keeps the digit that the kth row falls in. Rows above the kth value are
in; rows that tie at it are chosen by the bytes of the item, ascending: a pass counts open ties by the first byte in which a
group's ties differ, so common beginnings cost no pass. Every pass reads a written table and sends counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.llm.common import saved

DIGIT = 10


def _reached(counts: DataFrame, by: Sequence[str], order) -> DataFrame:
    """Of each group's digits the one in which the row number ``need`` falls (the last one if there are fewer rows), with
    the rows before it (``before``) and its own (``n``)."""
    running = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy(order)))
    running = running.withColumn("before", F.col("upto") - F.col("n"))
    # the last digit that begins before ``need`` is reached
    return running.where(F.col("before") < F.col("need")).groupBy(*by, "need").agg(F.max_by(F.struct("digit", "before", "n"), "upto").alias("hit"))


def top(rows: DataFrame, by: Sequence[str], value: str, item: str, k: int, bits: int = 30) -> DataFrame:
    """The rows of the k largest values of each group, ties by the bytes of the item ascending, with ``rank`` from 1.

    rows: a written table with columns by (not null), value (a long from 0 to below 2^bits) and item (a string, not null,
    different in all rows of a group). Groups of fewer rows than k keep all. An empty table gives an empty table.
    """
    held = rows.select(*by, F.col(value).alias("v"), F.col(item).alias("i"))
    passes = -(-bits // DIGIT)
    state = None
    for n in reversed(range(passes)):
        here = held.withColumn("head", F.shiftright("v", (n + 1) * DIGIT)).withColumn("digit", F.shiftright("v", n * DIGIT).bitwiseAND((1 << DIGIT) - 1))
        here = here.withColumn("need", F.lit(k).cast("long")).withColumn("head", F.lit(0).cast("long")) if state is None else here.join(state, [*by, "head"])
        counts = here.groupBy(*by, "head", "need", "digit").agg(F.count("*").alias("n"))
        hit = _reached(counts, [*by, "head"], F.col("digit").desc())
        state = hit.select(*by, F.shiftleft("head", DIGIT).bitwiseOR(F.col("hit.digit")).alias("head"), (F.col("need") - F.col("hit.before")).alias("need"), F.col("hit.n").alias("ties"))
    kth = saved(state.withColumnRenamed("head", "kth"), "rank-kth")

    chosen = [held.join(kth, list(by)).where((F.col("v") > F.col("kth")) | (F.col("v") == F.col("kth")) & (F.col("ties") <= F.col("need"))).select(*by, "v", "i")]
    ties = held.join(kth.where("ties > need"), list(by)).where("v = kth").select(*by, "v", "i", "need")
    ties = saved(ties, "rank-ties")
    while not ties.isEmpty():
        # bytes that all open ties of a group share
        ends = ties.groupBy(*by, "need").agg(F.min("i").alias("a"), F.max("i").alias("b"))
        shared = F.expr("aggregate(sequence(1, greatest(least(octet_length(a), octet_length(b)), 1)), 0, (n, j) -> if(n = j - 1 and substring(cast(a as binary), j, 1) = substring(cast(b as binary), j, 1), if(octet_length(a) < j, n, j), n))")
        ends = ends.select(*by, "need", shared.alias("depth"))
        byte = F.substring(F.col("i").cast("binary"), F.col("depth") + 1, 1)
        split = saved(ties.join(ends, [*by, "need"]).withColumn("digit", F.when(F.octet_length(byte) == 0, -1).otherwise(F.conv(F.hex(byte), 16, 10).cast("int"))), "rank-ties")
        hit = _reached(split.groupBy(*by, "need", "digit").agg(F.count("*").alias("n")), by, F.col("digit").asc())
        split = split.join(hit, [*by, "need"]).select(*by, "v", "i", "digit", F.col("hit.digit").alias("last"), (F.col("need") - F.col("hit.before")).alias("need"), F.col("hit.n").alias("n"))
        split = saved(split, "rank-ties")
        chosen.append(split.where("digit < last or digit = last and n <= need").select(*by, "v", "i"))
        ties = split.where("digit = last and n > need").select(*by, "v", "i", "need")
    found = chosen[0]
    for more in chosen[1:]:
        found = found.union(more)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("v").desc(), F.col("i").asc()))
    return found.select(*by, F.col("i").alias(item), F.col("v").alias(value), rank.alias("rank"))

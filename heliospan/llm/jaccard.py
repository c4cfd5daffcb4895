"""N-gram Jaccard join by a MinHash LSH forest: prefix tries of signatures, shortened level by level, then exact verification.

Each text is the set of its five-word shingles (a text of one to four words is one shingle). A set has a label in each
of TREES trees: LABEL digits, each 16 bits of one min-hash. The labels of a tree, in order, are a trie, and a node of the
trie at depth k is a run of labels with k digits in common. Only the part of the forest below depth ``floor`` that holds two
sets or more is kept, as rows in the order of their labels.

The join descends to the full labels first, and shortens the matched prefixes by one digit at a time. At each level the
nodes are found in which some pair meets that has not met before (at a longer prefix in any tree, or at this one in an
earlier tree); where the least and the greatest label of a node's members tell that all have met, it is passed over. The
fresh pairs are verified exactly, and the links found so far tell what is still missing: a pair of similarity s meets at
depth k with probability p = 1 - (1 - s^k)^TREES, so each link found stands for (1 - p) / p missed ones. Shortening ends
where less than half a link is expected to be missing, or else at ``floor``, the longest prefix at which a pair at the
threshold itself meets with probability RECALL (with 20 trees and 0.8: depth 4, 0.99997).

Texts with equal sets are one class first, so copies cost one row. No pair is ever a row: a task compares two blocks of
one node by matrix products and returns, per set, its links and its smallest linked set. Nodes with more sets than BLOCK, or
more bytes than BLOCK_BYTES, are split into pairs of blocks over many tasks, so every set is compared, at the cost that an
exact number of links has. Components of the links come from ``common.components``.

Defined results: null texts and texts with no word link with nothing and are classes of their own. A class is named by its
smallest key; null keys do not count, and a class with no other has a null name. Keys may have any type with an order.
Rows that repeat a key are rows of their own, each in the class of its text. A very long text is one set and may be a block
of its own. Extra columns do not matter, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import components, discard, least_keys, likely, numbered, saved, shuffles_freed, table
from heliospan.llm.texts import CHUNK_BYTES, binary_text, mix, pieces, random_words, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Trees, digits of a label (HEAD of them in its first number), and how surely a pair at the threshold meets at the floor.
TREES, LABEL, HEAD, RECALL = 20, 6, 4, 0.9999
#: Most sets, and about the most bytes of shingles, in a block.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Links are counted by their similarity in bins of this width.
BIN = 0.01
_SHINGLE = random_words(WORDS, 21)
_HASH = random_words(TREES * LABEL, 22).reshape(TREES, LABEL)


def depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix with which a pair of this similarity meets in some tree with the target recall."""
    for k in range(label, 0, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def missed(links: list[tuple[float, int]], k: int, trees: int = TREES) -> float:
    """Links expected to be missing when all prefixes of k digits have met. links: (least similarity, number found)."""
    met = [(1 - (1 - s**k) ** trees, n) for s, n in links]
    return sum(n * (1 - p) / p for p, n in met)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text, its distinct shingles in ascending order."""
    hashed, bounds = word_hashes(column)
    out = []
    n = len(hashed) - WORDS + 1
    rolled = mix(sum((hashed[j : j + n] * _SHINGLE[j] for j in range(1, WORDS)), hashed[:n] * _SHINGLE[0])) if n > 0 else hashed[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(hashed[a:b] * _SHINGLE[: b - a], dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(hashed[:0])
    return out


def labels(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2 TREES): the first HEAD digits of each tree's label as one number, then the rest of each. No set is empty."""
    out = np.zeros((len(bounds) - 1, 2 * TREES), np.uint64)
    for t in range(TREES):
        for j in range(LABEL):
            digit = mix(np.minimum.reduceat(sets * _HASH[t, j], bounds[:-1])) >> np.uint64(48)
            at = t if j < HEAD else TREES + t
            out[:, at] = out[:, at] << np.uint64(16) | digit
    return out


def _signatures(docs: DataFrame, key: str) -> DataFrame:
    """docs: k1, k2, key, text as bytes -> k1, k2, key, n (shingles), f1, f2 (prints of the set), labels."""
    schema = f"k1 long, k2 long, key {dict(docs.dtypes)[key]}, n long, f1 long, f2 long, labels array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            sets = shingle_sets(batch.column(3))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            made = np.zeros((len(sets), 2 * TREES), np.uint64)
            prints = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                bounds = np.concatenate([[0], np.cumsum(n[full])])
                made[full] = labels(flat, bounds)
                for i, factor in enumerate(_SHINGLE[:2]):
                    prints[i, full] = np.add.reduceat(mix(flat * factor), bounds[:-1])
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * TREES)
            lists = pa.ListArray.from_arrays(offsets, pa.array(made.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), *(pa.array(p.view(np.int64)) for p in prints), lists], names=["k1", "k2", "key", "n", "f1", "f2", "labels"])

    return docs.mapInArrow(sign, schema)


def _prefix(head: Column, tail: Column, k: int) -> Column:
    """One number for the first k digits of a label."""
    return F.shiftright(head, 16 * (HEAD - k)) if k <= HEAD else F.xxhash64(head, F.shiftright(tail, 16 * (LABEL - k)))


def _sizes(members: DataFrame, similarity: float, *more: Column) -> DataFrame:
    """tree, prefix and ``more`` of the trie nodes in which some pair may link: two sets whose sizes differ too much cannot.

    members: n, tree, prefix, and what ``more`` reads.
    """
    found = members.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), *more)
    return found.where((F.col("size") > 1) & ((F.col("size") > 2) | (F.col("least") >= F.col("most") * (similarity - 1e-6))))


def _forest(classes: DataFrame, floor: int, similarity: float) -> DataFrame:
    """node, n, tree, head, tail of the sets that share floor digits with another of a fitting size, in the order of the trees' labels."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.get("labels", t).alias("head"), F.get("labels", t + TREES).alias("tail")))
    below = classes.select("node", "n", F.inline(trees)).withColumn("prefix", _prefix(F.col("head"), F.col("tail"), floor))
    shared = saved(_sizes(below, similarity).select("tree", "prefix"), "jaccard-roots")
    return likely(below, shared, "tree", "prefix").join(shared, ["tree", "prefix"], "left_semi").drop("prefix").sortWithinPartitions("tree", "head", "tail")


def _fresh(members: DataFrame, k: int, others: Column) -> DataFrame:
    """tree, prefix, size, bytes of the nodes whose members do not all share k digits in some tree that ``others`` (of tree and t) names.

    members: node, n, tree, prefix, labels.
    """
    digits = [_prefix(F.get("labels", F.lit(t)), F.get("labels", F.lit(TREES + t)), k) for t in range(TREES)]
    bounds = [f(x).alias(f"{name}{t}") for t, x in enumerate(digits) for name, f in (("low", F.min), ("high", F.max))]
    met = reduce(Column.__or__, (others(F.col("tree"), t) & (F.col(f"low{t}") == F.col(f"high{t}")) for t in range(TREES)))
    found = members.groupBy("tree", "prefix").agg(*bounds, F.count("*").alias("size"), (F.sum("n") * 8).alias("bytes"))
    return found.where((F.col("size") > 1) & ~met).select("tree", "prefix", "size", "bytes")


def _meetings(forest: DataFrame, classes: DataFrame, k: int, first: bool, similarity: float) -> DataFrame:
    """node and the list of trie nodes at depth k (tree, prefix, blocks) in which it may meet a set for the first time."""
    digits = lambda k: _prefix(F.col("head"), F.col("tail"), k)
    held = forest.select("node", "n", "tree", digits(k).alias("prefix"), *([] if first else [digits(k + 1).alias("longer")]))
    # whole labels go only to nodes that may hold a link and, below the first level, branch here: else all have met in this tree
    if first:
        apart = _sizes(held, similarity)
    else:
        apart = _sizes(held, similarity, F.min("longer").alias("low"), F.max("longer").alias("high")).where("low < high")
    apart = saved(apart.select("tree", "prefix"), "jaccard-apart")
    members = held.drop("longer").join(apart, ["tree", "prefix"], "left_semi").join(classes.select("node", "labels"), "node")
    fresh = _fresh(members, k, lambda tree, t: tree > t)
    if not first:  # pairs that share one digit more in any tree have met
        fresh = fresh.join(_fresh(members, k + 1, lambda tree, t: F.lit(True)).select("tree", "prefix"), ["tree", "prefix"], "left_semi")
    fresh = saved(fresh.select("tree", "prefix", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "jaccard-fresh")
    discard(apart)
    return held.select("node", "tree", "prefix").join(fresh, ["tree", "prefix"]).groupBy("node").agg(F.collect_list(F.struct("tree", "prefix", "blocks")).alias("meetings"))


def _sets(found: DataFrame) -> DataFrame:
    """found: node, text -> node, shingles; a node once for each task that reads rows which repeat it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, 1):
            nodes = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
            if new:
                part = batch.take(pa.array(new))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["node", "shingles"])

    return found.mapInArrow(make, "node long, shingles binary")


_ROW = "tree int, prefix long, a int, b int, node long, block int, copies long, label binary, shingles binary"
_KINDS = [("tree", pa.int32()), ("prefix", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("node", pa.int64()), ("block", pa.int32()), ("copies", pa.int64()), ("label", pa.binary()), ("shingles", pa.binary())]


def _rows(found: DataFrame) -> DataFrame:
    """found: node, shingles, copies, labels, meetings. One row for each pair of blocks in which a set takes part."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out: list[tuple] = []
            size = 0
            for node, packed, copies, label, meetings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.array(label, np.int64).tobytes()
                for m in meetings:
                    block = int(mix(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(m["blocks"]))
                    for other in range(m["blocks"]):
                        out.append((m["tree"], m["prefix"], min(block, other), max(block, other), node, block, copies, held, packed))
                        size += len(packed)
                        if size >= CHUNK_BYTES:
                            yield _batch(out)
                            out, size = [], 0
            if out:
                yield _batch(out)

    return found.mapInArrow(make, _ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def jaccard(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): the Jaccard similarity of the sets."""
    sizes = [np.array([len(s) for s in x]) for x in (left, right)]
    if len(left) * len(right) <= 16:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    else:
        own = np.concatenate([np.unique(np.concatenate(x)) for x in (left, right)])
        own.sort()
        both = own[1:][own[1:] == own[:-1]]  # only shingles of both sides count
        shared = np.zeros((len(left), len(right)), np.float32)
        where = [[np.intersect1d(s, both, assume_unique=True) for s in x] for x in (left, right)]
        for a in range(0, len(both), 4096):
            part = both[a : a + 4096]
            grids = []
            for x in where:
                grid = np.zeros((len(x), len(part)), np.float32)
                for i, s in enumerate(x):
                    lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], "right")
                    grid[i, np.searchsorted(part, s[lo:hi])] = 1
                grids.append(grid)
            shared += grids[0] @ grids[1].T
    return shared / (sizes[0][:, None] + sizes[1][None, :] - shared)


def have_met(left: np.ndarray, right: np.ndarray, tree: int, k: int, first: bool) -> np.ndarray:
    """(left, right): whether two labels met before depth k of this tree: at depth k of an earlier tree, or deeper in any (not at the first level)."""

    def common(depth: int) -> np.ndarray:
        shift = np.repeat(np.array([16 * max(0, HEAD - depth), 16 * (LABEL - max(depth, HEAD))], np.int64), TREES)
        same = (left >> shift)[:, None, :] == (right >> shift)[None, :, :]
        return same[..., :TREES] & same[..., TREES:] if depth > HEAD else same[..., :TREES]

    met = common(k)[..., :tree].any(-1)
    return met if first else met | common(k + 1).any(-1)


def _links(rows: DataFrame, similarity: float, k: int, first: bool) -> DataFrame:
    """rows of ``_rows`` at depth k, those of a pair of blocks one after the other -> node, root, links, bins (links by similarity)."""
    n_bins = _bins(similarity)

    def compare(group: list[dict]) -> list[tuple[int, int, int, list[int]]]:
        tree, a, b = (group[0][x] for x in ("tree", "a", "b"))
        members = {g["node"]: g for g in group}
        sides = [[g for g in members.values() if g["block"] == x] for x in ((a,) if a == b else (a, b))]
        if not all(sides):
            return []
        sets = [[np.frombuffer(g["shingles"], np.uint64) for g in side] for side in sides]
        label = [np.array([np.frombuffer(g["label"], np.int64) for g in side]) for side in sides]
        ids, copies = ([np.array([g[x] for g in side]) for side in sides] for x in ("node", "copies"))
        score = jaccard(sets[0], sets[-1])
        linked = score >= similarity - 1e-9
        linked &= ~have_met(label[0], label[-1], tree, k, first)
        if a == b:
            np.fill_diagonal(linked, False)
        else:  # one square matrix of both blocks
            zero = [np.zeros((len(x), len(x))) for x in ids]
            score, linked = np.block([[zero[0], score], [score.T, zero[1]]]), np.block([[zero[0] > 0, linked], [linked.T, zero[1] > 0]])
        node, many = np.concatenate(ids), np.concatenate(copies)
        links, root = linked @ many, spread(linked, node)
        at = np.flatnonzero(links)
        bins = np.minimum(((score[at] - similarity + 1e-9) / BIN).astype(int), n_bins - 1)
        found = [np.bincount(x[y], minlength=n_bins).tolist() for x, y in zip(bins, linked[at], strict=True)]
        return list(zip(node[at].tolist(), root[at].tolist(), links[at].tolist(), found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        out: list[tuple] = []
        for row in (row for batch in batches for a in range(0, batch.num_rows, 64) for row in batch.slice(a, 64).to_pylist()):
            if (now := (row["tree"], row["prefix"], row["a"], row["b"])) != key:
                if len(held) > 1:
                    out += compare(held)
                held, key = [], now
            held.append(row)
            if len(out) > 10_000:
                yield _tallies(out)
                out = []
        if len(held) > 1:
            out += compare(held)
        if out:
            yield _tallies(out)

    return rows.mapInArrow(run, "node long, root long, links long, bins array<long>")


def _bins(similarity: float) -> int:
    return int(np.ceil((1 - similarity) / BIN)) + 1


def spread(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric matrix reaches."""
    root = ids.copy()
    if not len(ids):
        return root
    most = np.iinfo(np.int64).max
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], most).min(1))
        if (least == root).all():
            return root
        root = least


def _tallies(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "root", "links", "bins"])


def _classes(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """k1, k2, key, n, f1, f2 of every row; the classes of equal sets: n, f1, f2, node, least (key), rep (k1, k2 of one text), copies; node, n, rep, copies, labels of each.

    Labels are most of the bytes, so only the last table, which goes first, holds them.
    """
    hashed = F.xxhash64(F.col(text).cast("binary"))
    held = docs.select(F.xxhash64(F.col(key)).alias("k1"), hashed.alias("k2"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    signed = saved(_signatures(held, "key"), "jaccard-signed")
    classes = signed.where("n > 0").groupBy("n", "f1", "f2", "labels").agg(F.min("key").alias("least"), F.min(F.struct("k1", "k2")).alias("rep"), F.count("*").alias("copies"))
    labelled = numbered(classes, "jaccard-labelled")
    rows = saved(signed.drop("labels"), "jaccard-rows")
    discard(signed)
    return rows, saved(labelled.drop("labels"), "jaccard-classes"), labelled


def _all_links(docs: DataFrame, labelled: DataFrame, text: str, key: str, similarity: float, recall: float) -> DataFrame:
    """node, root, links of all levels. labelled: of ``_classes``; it is deleted."""
    floor = depth(similarity, recall)
    forest = saved(_forest(labelled, floor, similarity), "jaccard-forest")
    nodes = forest.select("node").distinct()
    classes = saved(likely(labelled, nodes, "node").join(nodes, "node", "left_semi"), "jaccard-kept")
    discard(labelled)
    wanted = classes.select("rep.k1", "rep.k2", "node")
    held = docs.select(F.xxhash64(F.col(key)).alias("k1"), F.xxhash64(F.col(text).cast("binary")).alias("k2"), F.col(text).cast("binary").alias("text"))
    sets = saved(_sets(likely(held, wanted, "k1", "k2").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")), "jaccard-sets")
    n_bins = _bins(similarity)
    links: DataFrame | None = None
    for k in range(LABEL, floor - 1, -1):
        meetings = saved(_meetings(forest, classes, k, k == LABEL, similarity), "jaccard-meetings")
        found = likely(sets, meetings, "node").join(meetings.join(classes.select("node", "copies", "labels"), "node").hint("shuffle_hash"), "node")
        rows = _rows(found.select("node", "shingles", "copies", "labels", "meetings"))
        rows = rows.repartition("tree", "prefix", "a", "b").sortWithinPartitions("tree", "prefix", "a", "b")
        level = saved(_links(rows, similarity, k, k == LABEL), "jaccard-links")
        discard(meetings)
        links = level if links is None else links.union(level)
        counts = links.agg(*(F.sum(F.get("bins", F.lit(i))).alias(f"b{i}") for i in range(n_bins))).first()
        if missed([(similarity + i * BIN, (counts[i] or 0) // 2) for i in range(n_bins)], k) < 0.5 and any(counts):
            break
    for done in (sets, forest, classes):
        discard(done)
    return links


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """key, class_id, n_links and copies for every row of docs.

    class_id: the smallest key reachable by links, itself included. n_links: other documents linked directly. copies:
    documents with this very set of shingles, itself included.
    """
    with shuffles_freed(docs.sparkSession):
        signed, classes, labelled = _classes(docs, text, key)
        links = _all_links(docs, labelled, text, key, similarity, recall)
        grouped = components(links, "node", "root")
    reach = least_keys(grouped, classes, "least")
    tally = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("n", "f1", "f2", "node", "least", "copies").join(tally, "node", "left").join(reach, "node", "left")
    out = signed.select("key", "n", "f1", "f2").join(known, ["n", "f1", "f2"], "left")
    named = F.when(F.col("links") > 0, F.col("component_key")).when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key),
        named.alias("class_id"),
        (F.coalesce(F.col("copies"), F.lit(1)) - 1 + F.coalesce(F.col("links"), F.lit(0))).alias("n_links"),
        F.coalesce(F.col("copies"), F.lit(1)).alias("copies"),
    )


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of docs for each class: that with the smallest key (null ones last), of equal keys the text with the smallest hash.

    Rows that repeat a key and its text are one document. Rows that share a key but hold other texts are documents of their
    own. Rows without a word all stay, those that repeat a known key once.
    """
    with shuffles_freed(docs.sparkSession):
        signed, classes, labelled = _classes(docs, text, key)
        links = _all_links(docs, labelled, text, key, similarity, recall)
        reach = components(links, "node", "root")
    own = signed.where("n > 0").join(classes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"])
    group = F.coalesce("component", "node")
    best = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "k2", "k1"))
    first = own.join(reach, "node", "left").groupBy(group.alias("group")).agg(best.alias("best")).select("best.k1", "best.k2")
    empty = signed.where("n = 0").select("k1", "k2")
    chosen = saved(first.union(empty).distinct(), "jaccard-chosen")
    inner = [f"__{i}" for i in range(len(docs.columns))]  # columns may have the names made here
    held = docs.toDF(*inner)
    value = F.col(f"__{docs.columns.index(text)}")
    named = F.col(f"__{docs.columns.index(key)}")
    marked = held.withColumn("k1", F.xxhash64(named)).withColumn("k2", F.xxhash64(value.cast("binary"))).join(chosen, ["k1", "k2"], "left_semi")
    # a null key tells no rows apart, so its rows without a word are not one document
    wordless = named.isNull() & ~F.coalesce(value, F.lit("")).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    once = marked.where(~wordless).dropDuplicates(["k1", "k2"])
    return once.union(marked.where(wordless)).select(*inner).toDF(*docs.columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return join(binary_text(table(spark, sf_dir, "documents"), "doc_id"), text="__text")

"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens that are popped when it is taken
(the public LinMaxMatch construction). Reading a word byte by byte then gives the number of greedy longest-match pieces
in one pass, without building the pieces. Texts are lower-cased (A-Z) and split into runs of word bytes and runs of
other bytes that are no blanks; blanks are dropped.

Where a vocabulary marks the ends of words, END closes each word that is read: a token with the mark matches at the end of a
word only, one without it anywhere. Counts are those of the greedy longest match over these tokens, not of the merges of BPE.

The vocabulary is read on the driver, refused above MAX_VOCABULARY_BYTES, and broadcast. Counting is map-only. Defined
results: a null or empty text has 0 tokens; rows are independent, so repeats and clashing extra columns do not matter. A very
long text is counted whole, by itself. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import extended, table
from heliospan.llm.texts import binary_text

MAX_VOCABULARY_BYTES = 16 << 20
#: Words whose counts a worker remembers, and their greatest length.
MEMO, MEMO_BYTES = 500_000, 64
#: Bytes of a text that are split at once.
PART_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
_SPLIT = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x09-\x0d\x20]+")
#: Closes a word, as a blank is in none.
END = b" "
DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


class Automaton:
    """initial: tokens that may start a word; inner: those that may follow (the same by default); end: what closes each word."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes] | None = None, unknown: int = 1, end: bytes = b""):
        initial = sorted({x for x in initial if x})
        inner = initial if inner is None else sorted({x for x in inner if x})
        if sum(map(len, initial)) + sum(map(len, inner)) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"the vocabulary has over {MAX_VOCABULARY_BYTES} bytes")
        self.unknown, self.end = unknown, end
        self.go: dict[int, int] = {}
        parent, ends = [(-1, -1), (-1, -1)], set()
        for root, tokens in ((0, initial), (1, inner)):
            for token in tokens:
                node = root
                for byte in token:
                    key = node << 8 | byte
                    if key not in self.go:
                        self.go[key] = len(parent)
                        parent.append((node, byte))
                    node = self.go[key]
                ends.add(node)
        children: list[list[int]] = [[] for _ in parent]
        for node, (up, _) in enumerate(parent):
            if up >= 0:
                children[up].append(node)
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        queue = deque([*children[0], *children[1]])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            up, byte = parent[node]
            if node in ends:
                self.fail[node], self.pops[node] = 1, 1
                continue
            state, popped = self.fail[up], self.pops[up]
            while state >= 0 and (state << 8 | byte) not in self.go:
                popped += self.pops[state]
                state = self.fail[state]
            if state >= 0:
                self.fail[node], self.pops[node] = self.go[state << 8 | byte], popped

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        state = n = 0
        for byte in word + self.end:
            to = go.get(state << 8 | byte)
            while to is None:
                n += pops[state]
                state = fail[state]
                if state < 0:
                    return self.unknown
                to = go.get(state << 8 | byte)
            state = to
        while state > 1:
            n += pops[state]
            state = fail[state]
            if state < 0:
                return self.unknown
        return n


class Memo(dict):
    """Counts of words already seen, emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n

    def text(self, text: bytes | None) -> int:
        return sum(sum(map(self.__getitem__, _SPLIT.findall(part.translate(_LOWER)))) for part in parts(text or b""))


def parts(text: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at a blank, so that no word is cut; a longer run without one stays whole."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + size)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


def byte_symbols() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str = DEFAULT_VOCABULARY) -> tuple[set[bytes], bytes]:
    """Tokens of a tokenizers JSON file of byte-level symbols, every byte among them, and what closes a word (b"" without word ends)."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    symbols, mark = byte_symbols(), model.get("end_of_word_suffix") or ""
    anywhere, last = {bytes([b]) for b in range(256)}, set()
    for name in model["vocab"]:
        final = bool(mark) and name.endswith(mark)
        stem = name.removesuffix(mark) if final else name
        if stem and all(c in symbols for c in stem):
            (last if final else anywhere).add(bytes(symbols[c] for c in stem))
    return (anywhere | {t + END for t in anywhere | last}, END) if mark else (anywhere, b"")


def count_tokens(docs: DataFrame, automaton: Automaton, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(automaton)
    schema = extended(docs, f"`{out}` long")
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        memo = Memo(held.value)
        for batch in batches:
            n = [memo.text(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=names)

    return docs.mapInArrow(count, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Tokens of every whole document."""
    docs = binary_text(table(spark, sf_dir, "documents"), "doc_id")
    known, end = vocabulary(path)
    found = count_tokens(docs, Automaton(known, end=end), text="__text")
    return found.select("doc_id", "n_tokens", F.octet_length("__text").cast("long").alias("n_bytes"))

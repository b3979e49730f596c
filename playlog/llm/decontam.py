"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage of a document by at most k = n // WORDS_PER_EDIT word
edits.  Of any k + 1 pieces that the item is split into, one at least is then in the passage
unchanged.  A document's words are looked up against the first words of all pieces; every hit
is verified by Myers' bit-parallel edit distance between the whole item and the document's
words around the hit.  Words are compared without case and surrounding punctuation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import trimmed
from playlog.llm.wordhash import slices

WORDS_PER_EDIT = 6
KEY_WORDS = 4
#: The items are a stated query set, taken in blocks of at most so many words; documents are read once a block.
BLOCK_WORDS = 1_000_000


def budget(n_words: int) -> int:
    return n_words // WORDS_PER_EDIT


def best_distance(item: list[int], text: list[int]) -> int:
    """Least edits that turn item into any run of text (Myers' bit vectors, one bit a word of item)."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        at[w] |= 1 << i
    up, down, score, best = mask, 0, m, m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(xh | up) & mask), up & xh
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & mask, (minus << 1) & mask  # a match may start anywhere: no carry into bit 0
        up, down = minus | (~(xv | plus) & mask), plus & xv
        best = min(best, score)
    return best


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces of like length that make up n words."""
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Matcher:
    """The items of one block, with their pieces' keys sorted for lookup."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        keys: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        texts = pa.array([t for _, t in items], pa.string())
        for _, w in slices(texts, normal=True):
            runs = {q: w.runs(q) for q in range(1, KEY_WORDS + 1)}
            for i in range(len(w)):
                a, b = int(w.first[i]), int(w.first[i + 1])
                number = len(self.words)
                self.words.append(w.hashes[a:b])
                for start, length in pieces(b - a, budget(b - a)):
                    q = min(length, KEY_WORDS)
                    keys[q].append((int(runs[q][a + start]), number, start))
        self.keys = {}
        for q, rows in keys.items():
            rows.sort()
            value = np.array([r[0] for r in rows], dtype=np.uint64)
            table = np.zeros(1 << 16, dtype=bool)
            table[(value & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.keys[q] = value, [(r[1], r[2]) for r in rows], table

    def hits(self, words, first: int, last: int, spots: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        """(item number, edits) of the items found in the words first..last."""
        tried: set[tuple[int, int]] = set()
        best: dict[int, int] = {}
        for q, (value, places, _) in self.keys.items():
            at = spots[q]
            for p in at[np.searchsorted(at, first) : np.searchsorted(at, last - q + 1)].tolist():
                key = words.runs_of[q][p]
                for r in range(int(np.searchsorted(value, key, "left")), int(np.searchsorted(value, key, "right"))):
                    number, start = places[r]
                    item = self.words[number]
                    n, k = len(item), budget(len(item))
                    begin = p - start
                    if (number, begin) in tried or best.get(number) == 0:
                        continue
                    tried.add((number, begin))
                    a, b = max(first, begin - k), min(last, begin + n + k)
                    edits = best_distance(item.tolist(), words.hashes[a:b].tolist())
                    if edits <= k and edits < best.get(number, n + 1):
                        best[number] = edits
        return iter(sorted(best.items()))

    def spots(self, words) -> dict[int, np.ndarray]:
        """For each key length the word positions whose run is a piece's key."""
        words.runs_of, out = {}, {}
        for q, (value, _, table) in self.keys.items():
            run = words.runs_of[q] = words.runs(q)
            some = np.flatnonzero(table[(run & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(value, run[some]), len(value) - 1)
            out[q] = some[value[at] == run[some]]
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Item rows in blocks of bounded size, one block at a time on the driver."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits) for every item that a document holds within its budget, fewest edits kept.

    A null text, an empty text or an item without words matches nothing; nulls among the ids are
    skipped; repeated rows of an item or document give one row.  Whole texts are searched.  There
    is no shuffle but for the final removal of repeated pairs, which are few.
    """
    return _found(docs.select("doc_id", F.lit(0).alias("th"), "text"), items).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, edits) of the hits of each block of items; th tells texts of one doc_id apart."""
    spark, found = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("th").cast("long").alias("th"), "text").where("doc_id is not null and text is not null")
    schema = "doc_id long, th long, item_id long, edits int"
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(stream: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in stream:
                rows = []
                ids, ths = batch.column("doc_id"), batch.column("th")
                for base, words in slices(batch.column("text"), normal=True):
                    spots = matcher.spots(words)
                    busy = np.unique(np.concatenate([np.searchsorted(words.first, s, "right") - 1 for s in spots.values()])) if spots else []
                    for i in busy:
                        rows += [(ids[base + int(i)].as_py(), ths[base + int(i)].as_py(), matcher.ids[n], e) for n, e in matcher.hits(words, int(words.first[i]), int(words.first[i + 1]), spots)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "th", "item_id", "edits"])

        part = source.mapInArrow(trimmed(run), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, item_ids (ascending), least_edits."""
    return matches(docs, items).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated documents, all columns kept; rows with a null doc_id stay.

    A document is a doc_id with a text: a clean text stays when another one with its doc_id goes.
    """
    hit = _found(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), items).select(F.col("doc_id").alias("doc"), "th").distinct()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))  # whole rows, whatever their columns are called
    return marked.join(hit, ["doc", "th"], "left_anti").select("row.*")

"""Phrases that are said more often than their parts would have it, by two passes over the texts.

First pass: every task keeps count-min sketches of its n-grams, in sparse form; they are merged block by block.  A cell never
holds less than the count of an n-gram that falls in it, so an n-gram with a cell below the least count is too rare.  Only one bit a
cell goes on: whether it reaches the least count.

Second pass: n-grams all of whose cells reach it are counted exactly, by their words, not by a hash.  Then phrases are scored
at their weakest cut and those that a longer phrase explains are dropped.

A piece of a text ends at ``.,;:!?`` and at line ends; words are what blanks and tabs separate, A-Z in lower case.  Languages are counted apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import saved, trimmed, work_folder
from playlog.llm.wordhash import Words, buffers, mix, run_hashes

LONGEST, LEAST, SUBSUMED, FIRST = 3, 10, 50, 2000
#: Rows of a sketch, one cell for so many bytes of text, and bounds of the cells of a row. Bits of the most cells take 64 MB in all;
#: a corpus for which they are too few has more survivors, which changes the work of the second pass and no result.
DEPTH, BYTES_A_CELL, LEAST_CELLS, MOST_CELLS = 2, 16, 1 << 16, 1 << 28
BLOCK = 1 << 16
#: Texts are taken in slices of about so many bytes. A task sends its sketch when it has so many entries; it folds its counts when so many
#: are new, and sends them when so many are left.
SLICE, HELD, NEW, SENT = 1 << 20, 1_000_000, 250_000, 500_000
#: The best phrases of a language are found among the best of so many shares of it.
SHARES = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_CUT = np.arange(256, dtype=np.uint8)
_CUT[_BREAK] = 0x0A
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Pieces:
    """The words of a slice of texts of one language, and which of them begin a run of n words of one piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang: str):
        self.words = Words(_CUT[data], bounds, lower=True)
        self.salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        starts = self.words.starts
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
        piece += np.repeat(np.arange(len(bounds) - 1), np.diff(self.words.first))  # a text ends its last piece
        self.piece = piece

    def runs(self, n: int) -> np.ndarray:
        """Positions that begin n words of one piece."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def hashes(self, n: int) -> np.ndarray:
        """Hash of n words and the language, for every position."""
        return mix(run_hashes(self.words.hashes, n) ^ self.salt)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Number of every word and the words of the numbers: exact, no hashes."""
        w = self.words
        text = pa.LargeStringArray.from_buffers(len(w.starts), pa.py_buffer(w.packed.tobytes()), pa.py_buffer(w.letters.tobytes()))
        found = pc.dictionary_encode(text)
        return found.indices.to_numpy().astype(np.int64), found.dictionary


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, Pieces]]:
    """(language, Pieces) of slices of a batch; a longer text is a slice of its own."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        data, offsets = buffers(batch.column("text").filter(pc.equal(langs, lang)))
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            yield lang, Pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lang)
            i = j


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; cells is a power of two."""
    return (mix(h ^ _SEEDS[row % len(_SEEDS)]) & np.uint64(cells - 1)).astype(np.int64)


def packed(places: np.ndarray) -> bytes:
    """Ascending places as steps of one byte; 255 goes on without a place."""
    steps = np.diff(places, prepend=0)
    far = steps // 255
    out = np.full(len(steps) + int(far.sum()), 255, dtype=np.uint8)
    out[np.cumsum(far + 1) - 1] = steps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))


def sketched(docs: DataFrame, cells: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(row, block, bits): per block of cells of the merged sketch, a bit a cell that reaches least."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        for row in range(DEPTH):
            cell, own = np.unique(cells_of(h, row, cells), return_inverse=True)
            many = np.minimum(np.bincount(own, weights=n).astype(np.int64), least)  # more than enough is enough
            cell = np.repeat(cell, many)
            edge = np.flatnonzero(np.diff(cell // BLOCK, prepend=-1))
            ends = [*edge[1:].tolist(), len(cell)]
            data = [packed(cell[a:b] % BLOCK) for a, b in zip(edge.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), row, np.int32)), pa.array((cell[edge] // BLOCK).astype(np.int32)), pa.array(data, pa.binary())], names=["row", "block", "data"])

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in stream:
            for _, pieces in _slices(batch):
                for n in range(1, longest + 1):
                    h, k = np.unique(pieces.hashes(n)[pieces.runs(n)], return_counts=True)
                    held.append((h, k))
                    size += len(h)
                if size >= HELD and held:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
            full = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([full], pa.binary())], names=["row", "block", "bits"])

        last, total = None, None
        for batch in stream:
            for key, data in zip(zip(batch.column("row").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("data"), strict=True):
                if key != last:
                    if last is not None:
                        yield bits(last, total)
                    last, total = key, np.zeros(BLOCK, dtype=np.int64)
                total += np.bincount(unpacked(data.as_py()), minlength=BLOCK)
        if last is not None:
            yield bits(last, total)

    sent = _source(docs).mapInArrow(trimmed(count), "row int, block int, data binary")
    return sent.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(trimmed(merge), "row int, block int, bits binary")


def cells_for(docs: DataFrame) -> int:
    """Cells of a row of the sketch: a power of two that grows with the text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cells: int | None = None) -> DataFrame:
    """(lang, n_words, phrase, f): exact counts of all n-grams of at least least occurrences; n_words 0 is the number of all words.

    Phrases are words joined by one blank.  Only n-grams that pass the sketch are counted, so no frequent one is lost.
    """
    spark, cells = docs.sparkSession, cells or cells_for(docs)
    found = np.zeros((DEPTH, max(cells, BLOCK) // 8), dtype=np.uint8)
    for r in sketched(docs, cells, longest, least).toLocalIterator():  # a fixed number of bits
        found[r["row"], r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast([row.tobytes() for row in found])
    del found

    def survive(h: np.ndarray) -> np.ndarray:
        kept = np.arange(len(h))
        for row, bits in enumerate(shared.value):
            cell = cells_of(h[kept], row, cells)
            kept = kept[(np.frombuffer(bits, dtype=np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        return kept

    def exact(lang: str, pieces: Pieces) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
        code, names = pieces.codes()
        whole, v = code, len(names)  # code of the first n words from each position, unique among them
        for n in range(1, longest + 1):
            if n > 1:
                if len(whole) < 2:
                    return
                whole = np.unique(whole[:-1] * v + code[n - 1 :], return_inverse=True)[1].astype(np.int64)
            at = pieces.runs(n)
            at = at[survive(pieces.hashes(n)[at])]
            if len(at):
                _, first, many = np.unique(whole[at], return_index=True, return_counts=True)
                at = at[first]
                words = [names.take(pa.array(code[at + i])) for i in range(n)]
                yield lang, n, (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]), many

    form = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.large_string()), ("f", pa.int64())])

    def as_table(lang: str, n: int, phrase: pa.Array, many: np.ndarray) -> pa.Table:
        return pa.table([pa.array([lang] * len(many), pa.string()), pa.array(np.full(len(many), n, np.int32)), phrase, pa.array(many.astype(np.int64))], schema=form)

    def folded(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(form.names[:3]).aggregate([("f", "sum")]).rename_columns(form.names).cast(form)

    def send(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches(max_chunksize=100_000):
            yield b.set_column(2, "phrase", b.column(2).cast(pa.string()))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [], 0
        for batch in stream:
            for lang, pieces in _slices(batch):
                more = [as_table(lang, 0, pa.array([""], pa.large_string()), np.array([len(pieces.words.starts)])), *(as_table(*found) for found in exact(lang, pieces))]
                held, new = held + more, new + sum(t.num_rows for t in more)
                if new >= NEW:
                    held, new = [folded(held)], 0
                    if held[0].num_rows >= SENT:
                        yield from send(held.pop())
                    pa.default_memory_pool().release_unused()
        if held:
            yield from send(folded(held))

    sent = _source(docs).mapInArrow(trimmed(count), "lang string, n_words int, phrase string, f long")
    return sent.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where((F.col("n_words") == 0) | (F.col("f") >= least))


def scored(grams: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of counted() that no longer one explains.

    A phrase has a occurrences; its cut into l and r is the one of least floor(1000000 a a / (l r)), the shortest first part among equals.
    It goes if a longer phrase that contains its words in a row has subsumed hundredths of its occurrences; the longer one may have gone itself.
    """
    words = F.split("phrase", " ")
    phrases = grams.where(f"n_words >= 2 and f >= {least}").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    inner = F.sequence(F.lit(2), F.col("n_words") - 1)  # shorter phrases inside, by length and place
    place = lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))
    inside = phrases.where("n_words > 2").select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.flatten(F.transform(inner, place)))).alias("phrase"))
    over = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(over, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {subsumed} * a").drop("longer")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cut = cut.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words")), " ")})
    part = lambda side, f: grams.where("n_words > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = "cast({0} as decimal(19, 0))".format
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})").alias("score")
    best = cut.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, cells: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, then occurrences, both falling, then phrase in byte order.

    n is the number of words of the language.  A null text is empty, a null lang is ``und``; a language without a phrase has no row, and neither
    has an empty table.  Repeated rows are counted each time.  Other columns are not read.
    """
    spark = docs.sparkSession
    grams = saved(counted(docs, longest, least, cells), work_folder(spark), "grams")
    phrases = scored(grams, least).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    total = grams.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

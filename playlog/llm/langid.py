"""Language identification by rank-order n-gram profiles.

A language's profile is its ``depth`` most frequent n-grams (one to three letters, words
padded with a blank) in rank order, counted over every labelled document.  A document's own
ranked n-grams are compared with each profile by out-of-place distance: the sum of the
rank differences, where an n-gram that the profile lacks costs ``depth``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import batches, trimmed

DEPTH = 300
FOLDS = 5
_PAIR, _ONE = np.uint64(1 << 63), np.uint64(3 << 62)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all one- to three-letter n-grams of the lower-cased text; 0 stands for anything between words."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.where(_is_letter()[x], x, 0)
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    if len(x) < 3:
        return np.zeros(0, dtype=np.uint64)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    return np.concatenate([x[x != 0] | _ONE, two | _PAIR, three[x[1:-1] != 0]])


def ranked(codes: np.ndarray, depth: int) -> np.ndarray:
    """The depth most frequent codes, most frequent first, ties by code."""
    value, count = np.unique(codes, return_counts=True)
    if len(value) > depth:
        least = np.partition(count, len(count) - depth)[len(count) - depth]
        keep = count >= least
        value, count = value[keep], count[keep]
    return value[np.argsort(-count, kind="stable")][:depth]


def profiles(labelled: DataFrame, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """(lang, rank, code) of the profile of every language in labelled(text, lang); nulls are skipped.

    All labelled texts are counted.  What reaches the driver is depth rows a language.
    """

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(k, *np.unique(np.concatenate(v), return_counts=True)) for k, v in held.items()]
            held.clear()
            lang = pa.array(np.repeat([k for k, _, _ in rows], [len(v) for _, v, _ in rows]).tolist(), pa.string())
            code = np.concatenate([v for _, v, _ in rows]).view(np.int64)
            return pa.RecordBatch.from_arrays([lang, pa.array(code), pa.array(np.concatenate([c for _, _, c in rows]).astype(np.int64))], names=["lang", "code", "n"])

        for batch in stream:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                codes = ngrams(text.as_py())
                held.setdefault(lang, []).append(codes)
                size += len(codes)
                if size > 2_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    known = labelled.select("text", "lang").where("text is not null and lang is not null")
    counted = known.mapInArrow(trimmed(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("code") < 0).cast("int"), "code"))
    rows = counted.withColumn("rank", rank).where(F.col("rank") <= depth).collect()
    return sorted((r["lang"], r["rank"] - 1, r["code"]) for r in rows)


def predict(docs: DataFrame, profile: list[tuple[str, int, int]], depth: int = DEPTH, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs(text, ...) with lang_pred and score added, under other names if wished; no shuffle, the other columns pass through.

    A column of docs that has one of the two names already is replaced.
    ``score`` is one minus the nearest profile's distance over the largest possible one.
    A null text, a text without a letter, or an empty profile gives ('und', 0).
    Ties go to the language that is first in alphabetical order.
    """
    docs, langs = docs.drop(*names), sorted({x[0] for x in profile})
    codes = np.unique(np.array([x[2] for x in profile], dtype=np.int64).view(np.uint64))
    ranks = np.full((len(codes) + 1, max(1, len(langs))), -1, dtype=np.int64)
    for lang, rank, code in profile:
        ranks[np.searchsorted(codes, np.array([code], np.int64).view(np.uint64)[0]), langs.index(lang)] = rank
    table = codes

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(ngrams(text), depth) if text and langs else ()
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(table, own), len(table) - 1)
        at = np.where(table[at] == own, at, len(table))
        there = ranks[at]
        gap = np.where(there < 0, depth, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(gap))
        return langs[best], float(max(0.0, 1.0 - gap[best] / (depth * len(own))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(t.as_py()) for t in batch.column("text")]
        extra = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(trimmed(batches(run)), f"{fields}, `{names[0]}` string, `{names[1]}` double")


def held_out(doc_id="doc_id"):
    """Whether a document is in the fold that nothing is learned from; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Profiles from the labelled documents outside the held-out fold (a null doc_id is never learned from)."""
    return profiles(docs.where("doc_id is not null").where(~held_out()), depth)


def identify(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Rows are judged one by one, so repeated rows and ties get equal answers; an empty table
    gives an empty result; columns other than doc_id, text and lang are not read.
    """
    found = predict(docs.select("doc_id", "text"), learn(docs, depth), depth)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Line deduplication over overlapping windows of two lines.

A window starts at every line that is not blank and ends at the next such line, so its place depends on
content alone and an inserted line changes only the windows that hold it.  Windows that occur more than
once anywhere are compared byte for byte with their first occurrence (the smallest doc_id, then the place in
the document); the lines of equal later ones are removed.  A repeated run of any length is the union of its windows,
so no run of two or more lines is missed, and an exact copy of two or more lines loses all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import saved, work_folder, trimmed

LINES, EVERY, MOST = 2, 3, 16
_MASK = (1 << 64) - 1


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little")


def chunks(text: str) -> list[list[str]]:
    """The lines of a text, dealt into chunks; joined again with line ends they are the text.

    A coarser yardstick for the tests: ``dedup`` goes by ``windows``, which miss no run between two cuts.
    """
    lines, out, held = text.split("\n"), [], []
    recent: list[int] = []
    for line in lines:
        held.append(line)
        recent = [*recent, _line_hash(line)][-LINES:]
        rolled = 0
        for h in recent:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        if len(held) >= MOST or len(held) >= 2 and (rolled >> 20) % EVERY == 0:
            out.append(held)
            held = []
    if held:
        out.append(held)
    return out


def _key(chunk: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(chunk).encode(), digest_size=16).digest()


def _eligible(chunk: list[str]) -> bool:
    return len(chunk) >= 2 and sum(bool(x.strip()) for x in chunk) >= 2


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """First and last line of each window: two lines that are not blank, with the blank ones between them."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return list(zip(full, full[1:]))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def removals(docs: DataFrame, folder: str) -> DataFrame:
    """(doc, at): the first lines of the windows that go, doc being the doc_id and a hash of the text.

    Only (hash, place) rows of windows are compared over the corpus; of texts, only the windows whose
    hash repeats are moved, to be compared with their first occurrence.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("doc_id is not null and text is not null")
    place = [("key", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("near", pa.int32())]

    def places(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for d, h, t in zip(*(batch.column(c) for c in ("doc_id", "th", "text")), strict=True):
                d, h, lines = d.as_py(), h.as_py(), t.as_py().split("\n")
                run = -1  # where the run of one and the same line began that the window lies in
                for a, b in windows(lines):
                    run = (a if run < 0 else run) if lines[a] == lines[b] else -1
                    # a first occurrence no farther back is the same passage: it overlaps, or the line is said over and over with blank lines between
                    near = 0 if run < 0 else 1 if b == a + 1 else a - run
                    rows.append((_key(lines[a : b + 1]), d, h, a, near))
                if len(rows) > 100_000:
                    yield _batch(rows, place)
                    rows = []
            if rows:
                yield _batch(rows, place)

    # rows that are repeated whole stand for one document
    every = source.mapInArrow(trimmed(places), "key binary, doc_id long, th long, at int, near int")
    by_key = Window.partitionBy("key")
    own = F.struct("doc_id", "th", "at")
    every = every.withColumns({"first": F.min(own).over(by_key), "last": F.max(own).over(by_key)}).where("first < last")
    alone = (F.struct("doc_id", "th") == F.struct("first.doc_id", "first.th")) & (F.col("at") - F.col("first.at") <= F.col("near"))
    is_first = own == F.col("first")
    wanted = saved(every.where(is_first | ~alone).select("doc_id", "th", F.struct("at", "key", is_first.alias("is_first")).alias("want")).distinct(), folder, "wanted")
    asked = wanted.groupBy("doc_id", "th").agg(F.collect_list("want").alias("want"))

    def pick(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("key", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("is_first", pa.bool_()), ("lines", pa.string())]
        for batch in stream:
            rows, size = [], 0
            for d, h, t, want in zip(*(batch.column(c) for c in ("doc_id", "th", "text", "want")), strict=True):
                lines = t.as_py().split("\n")
                ends = dict(windows(lines))
                for w in want.as_py():
                    rows.append((w["key"], d.as_py(), h.as_py(), w["at"], w["is_first"], "\n".join(lines[w["at"] : ends[w["at"]] + 1])))
                    size += len(rows[-1][-1])
                    if size > 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    # a document's wishes are bounded by its own lines; both joins with the texts shuffle at every size, as the lists grow with the corpus
    texts = source.join(asked.hint("merge"), ["doc_id", "th"]).mapInArrow(trimmed(pick), "key binary, doc_id long, th long, at int, is_first boolean, lines string")
    kept = texts.where("is_first").dropDuplicates(["key"]).select("key", F.col("lines").alias("kept_lines"))
    return texts.where("not is_first").join(kept, "key").where("lines = kept_lines").select("doc_id", "th", "at").distinct()


def dedup(docs: DataFrame, counted: str = "n_removed") -> DataFrame:
    """docs with repeated runs of two or more lines taken out of text, and counted (lines removed) added, which replaces a column of that name; all rows stay.

    Null texts and rows with a null doc_id are left as they are and count 0; an empty text has
    no window.  Rows with the same doc_id and text are one document and get the same result; with the same doc_id
    and different texts they are told apart.  Lines of white space alone count for no line of a run: they go
    between two removed lines and stay at the ends.  Of one line said over and over in a row, the first two stay; where blank lines
    stand between, all do, unless an earlier text or an earlier such row has them.
    Other columns pass through; n_chars is recomputed where the text changes and the column exists.
    """
    folder = work_folder(docs.sparkSession)
    gone = saved(removals(docs, folder), folder, "gone").groupBy("doc_id", "th").agg(F.collect_list("at").alias("gone"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))  # whatever the columns are called
    rest = marked.join(gone.hint("merge"), ["doc_id", "th"], "left")

    @F.pandas_udf("struct<text:string,n:int>")
    def cut(text, at):
        import pandas as pd

        out = []
        for t, gone in zip(text, at, strict=True):
            if gone is None or t is None:
                out.append((t, 0))
                continue
            lines = t.split("\n")
            ends = dict(windows(lines))
            gone = {i for a in (gone.tolist() if isinstance(gone, np.ndarray) else gone) for i in range(a, ends[a] + 1)}
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
        return pd.DataFrame(out, columns=["text", "n"])

    done = rest.select("row", F.when(F.col("gone").isNotNull(), cut("row.text", "gone")).alias("new"))
    changed = F.col("new").isNotNull()
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    own["text"] = F.when(changed, F.col("new.text")).otherwise(F.col("row.text"))
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length(F.col("new.text")).cast("long")).otherwise(F.col("row.n_chars"))
    own[counted] = F.coalesce(F.col("new.n"), F.lit(0)).cast("long")
    return done.select(*[c.alias(name) for name, c in own.items()])


def brute_force(docs: list[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """The texts left, from the longest equal run between each line and every earlier one, for small tables whose doc_ids differ."""
    texts = [(d, t, [i for i, x in enumerate(t.split("\n")) if x.strip()], t.split("\n")) for d, t in sorted(set(docs))]
    out = {}
    for k, (d, t, full, lines) in enumerate(texts):
        gone = set()
        for e in range(k + 1):
            _, _, other, theirs = texts[e]
            for p in range(len(full)):
                for q in range(len(other) if e < k else p):
                    n = 0
                    while p + n + 1 < len(full) and q + n + 1 < len(other) and lines[full[p] : full[p + n + 1] + 1] == theirs[other[q] : other[q + n + 1] + 1]:
                        n += 1
                    for i in range(n):
                        one = e == k and len({lines[x] for x in full[q + i : p + i + 2]}) == 1
                        if not (one and (full[p + i + 1] - full[p + i] > 1 or p - q == 1)):
                            gone.update(range(full[p + i], full[p + i + 1] + 1))
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out

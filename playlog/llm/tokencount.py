"""Exact token counts at every prefix, for a byte-fallback BPE model with word-start marks.

No token reaches over the start of a new word, so the count at a prefix is the sum of the
counts of the words before it plus the count at a prefix of the word that it cuts.  Inside a
word a dynamic programme over prefixes stores, for each one, the last token of its encoding and
its token count: the encoding of a prefix ends in the one token t whose neighbour, the last token
of the prefix before t, stays unmerged beside t.  Each distinct word is worked out once per cache.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
WORD_CACHE = 100_000
#: Totals of distinct words that a task keeps; they are small.
TOTAL_CACHE = 1_000_000
PAIR_CACHE = 500_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any("▁" in p.strip("▁") or p[-1] == "▁" and p.strip("▁") for p in self.score):
            raise ValueError("tokens of this model reach over word starts")
        self.longest = max(map(len, self.score))
        self.unit = re.compile(self._units())
        self.reachable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}

    def _units(self) -> str:
        """A pattern for the parts of a text that no token reaches out of: besides words, they are cut before a line
        end, and between a letter and punctuation that no piece has behind a letter."""
        inner = {(p[i], p[i + 1]) for p in self.score for i in range(len(p) - 1)}
        line = "" if any("\n" in pair for pair in inner) else "\n"
        behind = {y for x, y in inner if x.isalpha()}
        mark = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in behind)
        start = "|".join(["▁+", *([line] if line else []), *([f"[{mark}]"] if mark else [])])
        rest = f"(?:[^▁{line}{mark}]+|(?<![A-Za-z])[{mark}])*" if mark else f"[^▁{line}]*"
        return f"(?:{start}){rest}"

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: the best-scored neighbours first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str, token: str) -> bool:
        key = (left, token)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(left + token) == [left, token]
        return got

    def total(self, unit: str) -> int:
        """Token count of a whole unit, the last entry of its prefix table."""
        return self.prefixes(unit)[-1]

    def prefixes(self, unit: str) -> tuple[int, ...]:
        """Token count of every prefix of a unit, by code points, the empty one first."""
        got = self.cache.get(unit)
        if got is not None:
            return got
        n, score = len(unit), self.score
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            if unit[i - 1] not in score:  # spelled in bytes, which merge with nothing
                count[i] = count[i - 1] + len(unit[i - 1].encode("utf-8", "surrogatepass"))
                continue
            for j in range(max(0, i - self.longest), i):
                token = unit[j:i]
                if token not in score:
                    continue
                if len(token) > 1:
                    ok = self.reachable.get(token)
                    if ok is None:
                        ok = self.reachable[token] = self.merge(token) == [token]
                    if not ok:
                        continue
                if not last[j] or self._apart(last[j], token):
                    count[i], last[i] = count[j] + 1, token
                    break
        if len(self.cache) > WORD_CACHE:
            self.cache.clear()
        self.cache[unit] = tuple(count)
        return self.cache[unit]

    def units(self, text: str) -> list[str]:
        """The text's words with their marks; the first mark is the one that encoding adds."""
        return self.unit.findall("▁" + text.replace(" ", "▁")) if text else []

    def store(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, count) after each unit: code points of the text, and its exact token count."""
        units = self.units(text)
        ends = np.cumsum([len(u) for u in units], dtype=np.int64) - 1 if units else np.zeros(0, np.int64)
        return ends, np.cumsum([self.prefixes(u)[-1] for u in units], dtype=np.int64) if units else np.zeros(0, np.int64)

    def count_at(self, text: str, n_chars: int) -> int:
        """Exact token count of text[:n_chars], from stored counts."""
        done = total = 0
        for k, u in enumerate(self.units(text) if n_chars > 0 else ()):
            size = len(u) - (k == 0)
            if done + size >= n_chars:
                return total + self.prefixes(u)[n_chars - done + (k == 0)]
            done, total = done + size, total + self.prefixes(u)[-1]
        return total

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(token count, code points of the longest prefix of at most limit tokens)."""
        units, totals, make = self.units(text), self.totals, self.prefixes
        counts = list(map(totals.get, units))
        if None in counts:
            if len(totals) > TOTAL_CACHE:
                totals.clear()
            for i, u in enumerate(units):
                if counts[i] is None:
                    counts[i] = totals[u] = self.total(u)
        total = sum(counts)
        if total <= limit:
            return total, len(text)
        after = np.cumsum(counts)
        k = bisect_right(after, limit)
        before = int(after[k - 1]) if k else 0
        inside = make(units[k])
        best = max(i for i, c in enumerate(inside) if before + c <= limit)
        return total, max(0, sum(map(len, units[:k])) + best - 1)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, store: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, fits_chars and, with store, unit_ends and unit_counts.

    fits_chars is the length in code points of the longest prefix of at most limit tokens.
    unit_ends and unit_counts hold the prefix table at word ends as little-endian 64-bit integers;
    prefixes inside a word come from the word's own table (PrefixCounter.count_at).
    A null or empty text has 0 of everything.  Rows are handled one by one without a shuffle:
    repeated rows and null ids are kept as they come, other columns are not read.
    """
    path = path or model_path()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in stream:
            sizes, tokens, fits, ends, counts = [], [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n, fit = c.measure(text, limit)
                sizes.append(len(text.encode()))
                tokens.append(n)
                fits.append(fit)
                if store:
                    a, b = c.store(text)
                    ends.append(a.astype("<i8").tobytes())
                    counts.append(b.astype("<i8").tobytes())
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, tokens, fits)), *(pa.array(x, pa.binary()) for x in (ends, counts) if store)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fits_chars", "unit_ends", "unit_counts"][: len(columns)])

    more = ", unit_ends binary, unit_counts binary" if store else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_bytes long, n_tokens long, fits_chars long{more}")

"""BPE encoding and decoding through a table of distinct words.

Tokens never cross a word of the tokenizer's own splitting rule, so a text's ids are the
ids of its words put one after the other.  Texts are split in Spark tasks, each distinct
word is encoded once, and the ids are joined back to the words' positions.

To join by position without a row for each of the corpus's words, a task gives each
distinct word of a chunk (at most CHUNK_BYTES of its text) a number in order of first
appearance.  The chunks' words are dealt by word, where each distinct one is encoded; its
documents travel as word numbers and meet the ids of their chunk's words in one shuffle on
the chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.common import trimmed

CHUNK_BYTES = 32 << 20
#: What a process keeps of words and their ids, in bytes, and the longest word kept.
CACHE_BYTES, CACHED_WORD = 48 << 20, 200
# The letters and digits below U+0180, as Unicode classes them.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼½¾"
_S = "\t-\r "
_OTHER = re.compile(f"[^\x00-\x7f¡-¬®-įı-ſ‘’“”–—…]")
_ID = attrgetter("id")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCodec:
    """Splits texts into the tokenizer's words and encodes single words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = [b""] * (max(self.tok.get_vocab(True).values()) + 1)
        for piece, i in self.tok.get_vocab(True).items():
            self.pieces[i] = piece.encode()
        self.cache: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.held = self.held_recent = 0
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE: other bytes go by 256, 257, ..
        other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.letters = [other.get(b, chr(b)) for b in range(256)]

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special string is a word of its own."""
        if _OTHER.search(text) is None and not (self.cut and "<|" in text):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                plain = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [plain[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def _one(self, word: str) -> bytes:
        if word in self.special:
            return self.special[word].to_bytes(4, "little")
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", map(_ID, self.model.tokenize(word))).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        return list(map(self._one, words))

    def encode(self, text: str) -> bytes:
        """A text's ids; words are looked up in a cache of bounded size and encoded when missing.

        A word is kept from the second time it is seen within a while: most words of a corpus are rare, and would else drive out those that come often.
        """
        words, cache, recent = self.words(text), self.cache, self.recent
        ids = list(map(cache.get, words))
        for k in [k for k, i in enumerate(ids) if i is None]:
            w = words[k]
            if (got := recent.get(w)) is not None:
                if w not in cache:
                    cache[w] = got
                    self.held += 200 + 2 * len(w) + len(got)
            else:
                got = self._one(w)
                if len(w) <= CACHED_WORD:
                    recent[w] = got
                    self.held_recent += 200 + 2 * len(w) + len(got)
            ids[k] = got
        if self.held > CACHE_BYTES // 2:  # what was kept is recent from now on
            self.recent, self.cache, self.held_recent, self.held = cache, {}, 0, 0
        elif self.held_recent > CACHE_BYTES // 2:
            self.recent, self.held_recent = {}, 0
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> bytes:
        """What the library's decode gives without a decoder: the pieces joined by one space."""
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def _numbered(path: str, want_words: bool):
    """mapInArrow function: the chunks' distinct words, or the documents as word numbers."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, packer = codec(path), 0, zstandard.ZstdCompressor(level=3)
        chunk, size = 0, 0
        number: dict[str, int] = {}

        def words_out() -> Iterator[pa.RecordBatch]:
            every = list(number)
            for i in range(0, len(every), 50_000):
                some = every[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + chunk] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some, pa.string())], names=["chunk", "at", "word"])

        for batch in stream:
            ids, coded, chunks = [], [], []
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if size and size + len(text) > CHUNK_BYTES:
                    if want_words:
                        yield from words_out()
                    number.clear()
                    chunk, size = chunk + 1, 0
                size += len(text)
                words = c.words(text)
                if want_words:
                    for w in words:
                        if w not in number:
                            number[w] = len(number)
                    continue
                codes = np.empty(len(words), dtype="<u4")
                for k, w in enumerate(words):
                    n = number.get(w)
                    if n is None:
                        n = number[w] = len(number)
                    codes[k] = n
                ids.append(doc_id)
                chunks.append((part << 24) + chunk)
                # by planes: the high bytes are mostly zero and shrink well
                coded.append(packer.compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()))
            if not want_words and ids:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(ids, pa.int64()), pa.array(coded, pa.binary())], names=["chunk", "doc_id", "codes"])
        if want_words and number:
            yield from words_out()

    return run


def words_to_ids(spoken: DataFrame, path: str) -> DataFrame:
    """(chunk, at, ids) of spoken(chunk, at, word): every distinct word is encoded once.

    Words are dealt and sorted by word, so all rows of a word follow one another in one task: at
    most one row for each chunk of the corpus.  The first of them encodes the word.
    """

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, word, held = codec(path), None, b""
        for batch in stream:
            if not batch.num_rows:
                continue
            found = batch.column("word").dictionary_encode()
            distinct = found.dictionary.to_pylist()
            known = distinct[0] == word
            ids = [held] * known + c.encode_words(distinct[known:])
            word, held = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("at"), pa.array(ids, pa.binary()).take(found.indices)], names=["chunk", "at", "ids"])

    return spoken.repartition("word").sortWithinPartitions("word").mapInArrow(trimmed(run), "chunk long, at int, ids binary")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (UTF-8) of every document.

    A null or empty text has no ids.  Rows are handled one by one, so repeated rows, equal texts
    and null doc_ids are kept as they come; other columns are not read.  The input must give the
    same rows in the same partitions when a task is repeated, as a table scan does.
    """
    path = path or tokenizer_path()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    spoken = source.mapInArrow(trimmed(_numbered(path, True)), "chunk long, at int, word string")
    coded = source.mapInArrow(trimmed(_numbered(path, False)), "chunk long, doc_id long, codes binary")
    placed = words_to_ids(spoken, path).select("chunk", "at", F.lit(None).cast("long").alias("doc_id"), F.col("ids").alias("data"))
    both = placed.unionByName(coded.select("chunk", F.lit(None).cast("int").alias("at"), "doc_id", F.col("codes").alias("data")))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last())

    def join_back(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, chunk, packer = codec(path), None, zstandard.ZstdDecompressor()
        held: list[pa.Array] = []
        ids = starts = lengths = None
        for batch in stream:
            chunks = batch.column("chunk").to_numpy()
            is_doc = np.asarray(batch.column("at").is_null())
            edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(is_doc.view(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)], strict=True):
                if chunks[a] != chunk:
                    chunk, held, ids = chunks[a], [], None
                data = batch.column("data").slice(a, b - a)
                if not is_doc[a]:
                    held.append(data)
                    continue
                if ids is None:
                    flat = pa.concat_arrays([x.cast(pa.large_binary()) for x in held]) if held else pa.array([], pa.large_binary())
                    bounds = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1] // 4 if len(flat) else np.zeros(1, np.int64)
                    ids = np.frombuffer(flat.buffers()[2], dtype="<u4") if len(flat) and bounds[-1] else np.zeros(0, "<u4")
                    starts, lengths = bounds[:-1], np.diff(bounds)
                    held = []
                got, text = [], []
                for row in data:
                    planes = np.frombuffer(packer.decompress(row.as_py()), dtype=np.uint8).reshape(4, -1)
                    codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
                    n = lengths[codes]
                    ends = np.cumsum(n)
                    own = ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                    got.append(own.tobytes())
                    text.append(c.decode(own))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(got, pa.binary()), pa.array(text, pa.binary())], names=["doc_id", "ids", "decoded"])

    return dealt.mapInArrow(trimmed(join_back), "doc_id long, ids binary, decoded binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(key, decoded) from encoded(key, ids array<int>) by a join with the vocabulary's (id, piece) rows.

    The vocabulary has a fixed size, so it is the broadcast side.  No ids give an empty text; a
    null list gives null.
    """
    c, spark = codec(path or tokenizer_path()), encoded.sparkSession
    vocabulary = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(c.pieces)], "id int, piece string")
    rows = encoded.select("key", "ids", F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(F.broadcast(vocabulary), "id", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"), F.first(F.col("ids").isNull()).alias("none"))
    return joined.select("key", F.when(~F.col("none"), F.array_join(F.transform("p", lambda x: x["piece"]), " ")).alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

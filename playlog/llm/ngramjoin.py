"""Exact Jaccard self-join over word shingles, by set relations.

Documents are sets of distinct 5-word shingles; two link at a Jaccard coefficient of 0.75 or more.
Shingles are ordered rare first, and of each set only the prefix that a linked set must touch is
indexed.  The index lists are kept sorted by set size and position and are skipped in blocks: entries
whose size or position cannot reach the needed overlap are never paired.

Long lists come from groups of much alike sets.  There a few hubs are compared with every entry
(linear in the list).  What follows uses the answers already known: sets that a hub joins into one
component need no more comparison with one another, and for two sets of different components the
overlaps with a common hub bound their own overlap; only pairs that the bound leaves open are compared.
No link between different components is lost, so the components are exact.

Before two sets are compared in full, short parity maps of both (each element flips one bit) give an
upper bound of their overlap: the maps differ in no more places than the sets in elements.  Sets that
are compared travel as 64-bit BLAKE2b digests of their shingles' words, which decide the link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count as steps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.common import BROADCAST_BYTES, parts_for, saved, work_folder, trimmed
from playlog.llm.wordhash import Words, mix, shingles, slices

N, SHARE = 5, 75
#: Frequent shingles are put last in the order; so many at most are known by name. This changes costs only.
FREQUENT = 200_000
SHORT_LIST, HUBS = 3, 2
SALT = 1000
#: Sets are sent in batches of about so many bytes.
SENT_BYTES = 4 << 20
#: Index buckets: about so many shingles each, and no fewer than LEAST_BUCKETS.
BUCKET_TOKENS, LEAST_BUCKETS = 2_500_000, 24


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of n and m elements: ceil(SHARE (n + m) / (100 + SHARE))."""
    return -(-SHARE * (n.astype(np.int64) + m) // (100 + SHARE))


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // 100) + 1


def _key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _parity(s: np.ndarray) -> bytes:
    """A map of at least two bits an element, a power of two; each element flips the bit that its hash names."""
    size = max(256, 1 << (2 * len(s) - 1).bit_length())
    bit = (s >> np.uint64(20)).astype(np.int64) & (size - 1)
    return np.packbits((np.bincount(bit, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_common(n: int, m: int, x: bytes, y: bytes) -> int:
    """The largest overlap that sets of n and m elements can have by their parity maps; a longer map is folded."""
    while len(x) > len(y):
        x = (int.from_bytes(x[: len(x) // 2], "little") ^ int.from_bytes(x[len(x) // 2 :], "little")).to_bytes(len(x) // 2, "little")
    while len(y) > len(x):
        y = (int.from_bytes(y[: len(y) // 2], "little") ^ int.from_bytes(y[len(y) // 2 :], "little")).to_bytes(len(y) // 2, "little")
    return (n + m - (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()) // 2


def _digests(words: Words, joined: tuple[bytes, np.ndarray], i: int) -> bytes:
    """The sorted 64-bit digests of the distinct shingles of text i."""
    data, offsets = joined
    a, b = int(words.first[i]), int(words.first[i + 1])
    n = min(N, b - a)
    at = a + np.unique(words.five[a : b - N + 1], return_index=True)[1] if n == N else np.array([a])
    digest = b"".join([hashlib.blake2b(data[x : y - 1], digest_size=8).digest() for x, y in zip(offsets[at].tolist(), offsets[at + n].tolist(), strict=True)])
    return np.unique(np.frombuffer(digest, dtype="<u8")).tobytes()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def describe(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n, k1, k2, bits): set size, a 128-bit key and the parity map of the set; and, with a null
    n, counts (k2) of shingles (k1) that repeat within a slice of documents."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = batch.column("doc_id")
            for base, words in slices(batch.column("text"), lower=True):
                sets = shingles(words, N)
                keys = [_key(s) if len(s) else (0, 0) for s in sets]
                once = {k: s for k, s in zip(keys, sets, strict=True)}
                value, count = np.unique(np.concatenate(list(once.values())), return_counts=True)
                often = count >= 2
                k1 = np.concatenate([np.array([k[0] for k in keys], np.int64), value[often].view(np.int64)])
                k2 = np.concatenate([np.array([k[1] for k in keys], np.int64), count[often]])
                more = int(often.sum())
                own = pa.concat_arrays([ids.slice(base, len(sets)), pa.nulls(more, pa.int64())])
                n = pa.array([len(s) for s in sets] + [None] * more, pa.int32())
                bits = pa.array([_parity(s) if len(s) else None for s in sets] + [None] * more, pa.binary())
                yield pa.RecordBatch.from_arrays([own, n, pa.array(k1), pa.array(k2), bits], names=["doc_id", "n", "k1", "k2", "bits"])

    return _source(docs).mapInArrow(trimmed(run), "doc_id long, n int, k1 long, k2 long, bits binary")


def _index_rows(docs: DataFrame, frequent: list[tuple[int, int]], buckets: int) -> DataFrame:
    """(bucket, k1, n, toks, pos): the prefix shingles of each distinct set, by bucket of the shingle."""
    names = np.array([t for t, _ in frequent], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    names, rank = names[order], np.arange(1, len(names) + 1)[order]  # frequent is sorted by count

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in stream:
            for _, words in slices(batch.column("text"), lower=True):
                toks, pos, n, k = [], [], [], []
                for s in shingles(words, N):
                    if not len(s) or (key := _key(s)) in seen:
                        continue
                    seen.add(key)
                    size, p = len(s), prefix_length(len(s))
                    if len(names):
                        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                        weight = np.where(names[at] == s, rank[at], 0)
                        s = s[np.argsort(weight, kind="stable")[:p]] if weight.any() else s[:p]
                    toks.append(s[:p])
                    pos.append(np.minimum(np.arange(p), 65535).astype("<u2"))
                    n.append(size)
                    k.append(key[0])
                if not toks:
                    continue
                yield from _packed(toks, pos, n, k, buckets)

    return _source(docs).where("doc_id is not null and text is not null").mapInArrow(trimmed(run), "bucket int, k1 long, n int, toks binary, pos binary")


def _packed(toks: list, pos: list, n: list[int], k: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    owner = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
    t, p = np.concatenate(toks), np.concatenate(pos)
    bucket = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((bucket, owner))
    owner, bucket, t, p = owner[order], bucket[order], t[order], p[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(bucket) != 0)]))
    ends = np.append(first, len(t)).astype(np.int32)
    low = (t & np.uint64(0xFFFFFFFF)).astype("<u4")

    def binary(values: np.ndarray, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    rows = owner[first]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.array(k, np.int64)[rows]), pa.array(np.array(n, np.int32)[rows]), binary(low, 4), binary(p, 2)], names=["bucket", "k1", "n", "toks", "pos"])


def _fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j of one list can still reach the needed overlap."""
    size = 100 * np.minimum(n[i], n[j]).astype(np.int64) >= SHARE * np.maximum(n[i], n[j]).astype(np.int64)
    return size & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= needed(n[i], n[j]))


def list_pairs(tok: np.ndarray, pos: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """From the entries of one bucket: first comparisons (hub or smaller, other), and the entries of long lists."""
    order = np.lexsort((k, n, tok))
    tok, pos, n, k = tok[order], pos[order], n[order], k[order]
    again = np.concatenate([[False], (tok[1:] == tok[:-1]) & (k[1:] == k[:-1])])  # copies, sent by other tasks
    tok, pos, n, k, order = tok[~again], pos[~again], n[~again], k[~again], order[~again]
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
    size = np.repeat(np.diff(edge), np.diff(edge))
    short, out = (size > 1) & (size <= SHORT_LIST), []
    for d in range(1, SHORT_LIST):
        i = np.flatnonzero(short[:-d] & (tok[d:] == tok[:-d])) if len(tok) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        ok = _fits(n, pos, i, i + d)
        out.append((np.minimum(k[i[ok]], k[i[ok] + d]), np.maximum(k[i[ok]], k[i[ok] + d])))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if (size > SHORT_LIST).any() else ():
        if b - a <= SHORT_LIST:
            continue
        while a < b:  # blocks of sizes that can link with the block's smallest
            c = a + int(np.searchsorted(n[a:b], 100 * int(n[a]) // SHARE, side="right"))
            rank = np.lexsort((mix(k[a:c].view(np.uint64)), pos[a:c]))[:HUBS] + a  # few rare shingles: the likeliest original
            for r, h in enumerate(rank.tolist()):
                j = np.setdiff1d(np.arange(a, c), rank[: r + 1])
                j = j[_fits(n, pos, np.full(len(j), h), j)]
                out.append((np.full(len(j), k[h]), k[j]))
            a = c
    return out, order[size > SHORT_LIST]


def _compare_lists(rows: DataFrame) -> DataFrame:
    """(kind, a, b, n, pos): pairs to compare (kind 0: keys a, b) and entries of long lists (kind 1: list a, key b)."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = {c: table.column(c).chunk(0) if isinstance(table.column(c), pa.ChunkedArray) and table.num_rows else table.column(c) for c in table.schema.names}
        lengths = np.diff(np.frombuffer(column["toks"].buffers()[1], dtype=np.int32)[column["toks"].offset : column["toks"].offset + table.num_rows + 1]) // 4
        tok = np.frombuffer(b"".join(column["toks"].to_pylist()), dtype="<u4")
        pos = np.frombuffer(b"".join(column["pos"].to_pylist()), dtype="<u2").astype(np.int64)
        n, k = np.repeat(column["n"].to_numpy(), lengths).astype(np.int64), np.repeat(column["k1"].to_numpy(), lengths)
        pairs, rest = list_pairs(tok, pos, n, k)
        bucket = int(column["bucket"][0].as_py())
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        if len(a):
            _, keep = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
            a, b = a[keep], b[keep]
        list_id = (np.int64(bucket) << np.int64(32)) | tok[rest].astype(np.int64)
        zero = np.zeros(len(a), np.int32)
        values = [np.concatenate([zero, np.ones(len(rest), np.int32)]), np.concatenate([a, list_id]), np.concatenate([b, k[rest]]), np.concatenate([zero, n[rest].astype(np.int32)]), np.concatenate([zero, pos[rest].astype(np.int32)])]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["kind", "a", "b", "n", "pos"])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in stream:
            buckets = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.diff(buckets) != 0) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)], strict=True):
                if buckets[a] != bucket and held:
                    yield from flush(held)
                    held = []
                bucket = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    return rows.mapInArrow(trimmed(run), "kind int, a long, b long, n int, pos int")


def bounded(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, most, open) of pairs(a, b, na, nb, xa, xb): the bound by the parity maps, and whether it allows a link."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            na, nb = batch.column("na"), batch.column("nb")
            most = np.array([most_common(n, m, x, y) for n, m, x, y in zip(na.to_pylist(), nb.to_pylist(), batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)], dtype=np.int64)
            can = most >= needed(na.to_numpy(), nb.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), na, nb, pa.array(most.astype(np.int32)), pa.array(can)], names=["a", "b", "na", "nb", "most", "open"])

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, na int, nb int, most int, open boolean")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, folder: str, name: str) -> DataFrame:
    """(a, b, both, na, nb, linked) for pairs(a, b) of representatives, from the whole sets.

    A document's set goes to each a that it is compared with; an a with many partners is dealt over
    salts, with a copy of its set for each.
    """
    spark = docs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    hubs = many.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("hub"))
    others = pairs.join(many, "a").select(F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("hub"))
    asked = hubs.unionByName(others).groupBy("doc").agg(F.collect_list(F.struct("a", "salt", "hub")).alias("ask"))
    asked = saved(asked.join(sets.select(F.col("rep").alias("doc"), "k1"), "doc"), folder, f"asked_{name}")
    size = asked.agg(F.sum(32 + 24 * F.size("ask"))).first()[0] or 0
    left = asked.select(F.col("doc").alias("doc_id"), "ask", "k1")
    joined = _source(docs).join(F.broadcast(left) if size < BROADCAST_BYTES else left, "doc_id")

    def send(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("k1").to_pylist()
            for base, words in slices(batch.column("text"), lower=True):
                rows = []
                words.five, joined = words.runs(N), words.joined()
                for i, s in enumerate(shingles(words, N)):
                    if len(s) and _key(s)[0] == keys[base + i]:
                        data = _digests(words, joined, i)
                        rows += [(q["a"], q["salt"], q["hub"], ids[base + i], data) for q in batch.column("ask")[base + i].as_py()]
                size = np.cumsum([0] + [len(r[-1]) + 28 for r in rows])
                x = 0
                while x < len(rows):
                    y = max(x + 1, int(np.searchsorted(size, size[x] + SENT_BYTES, side="right")) - 1)
                    some = list(zip(*rows[x:y], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(some, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["a", "salt", "hub", "doc", "set"])
                    x = y

    sent = joined.mapInArrow(trimmed(send), "a long, salt int, hub int, doc long, set binary")
    dealt = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("hub"))

    def compare(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, None
        for batch in stream:
            out = []
            for a, is_hub, doc, data in zip(*(batch.column(c) for c in ("a", "hub", "doc", "set")), strict=True):
                s = np.frombuffer(data.as_py(), dtype="<u8")
                if is_hub.as_py():
                    hub, mine = a.as_py(), s
                elif hub == a.as_py():
                    at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                    both = int((mine[at] == s).sum())
                    out.append((hub, doc.as_py(), both, len(mine), len(s), 100 * both >= SHARE * (len(mine) + len(s) - both)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["a", "b", "both", "na", "nb", "linked"])

    result = dealt.mapInArrow(trimmed(compare), "a long, b long, both int, na int, nb int, linked boolean").dropDuplicates(["a", "b"])
    return saved(result, folder, f"verified_{name}")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, label) of every vertex with an edge(a, b), label the least id of its component.

    Large-star and small-star steps alternate until nothing changes; each is a few shuffles of the edges.
    Their number grows with the logarithm of the edges; there is no other end.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}_0")
    state = None
    for step in steps(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}_{step}")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti"))


def _open_pairs(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """(a, b) of entries of one long list, of different labels, that size, position and known answers leave open.

    entries: list, n, pos, rep, label.  answers: rep, known (array of hub, least and most overlap).
    """
    # lists of one label leave nothing open; they go before the answers are joined
    mixed = entries.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("list")
    rows = entries.join(mixed, "list", "left_semi").join(answers, "rep", "left").repartition("list").sortWithinPartitions("list", "n", "rep")

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("n", "pos", "rep", "label")}
        n, pos, rep, label = columns["n"].astype(np.int64), columns["pos"].astype(np.int64), columns["rep"], columns["label"]
        known = pa.chunked_array([b.column("known") for b in held]).combine_chunks()
        owner, found = pc.list_parent_indices(known).to_numpy(), pc.list_flatten(known)
        hub, least, most = (found.field(f).to_numpy() for f in ("hub", "least", "most"))
        names, count = np.unique(hub, return_counts=True)
        hubs = []  # bounds of the overlaps with the hubs that most entries were compared with
        for h in names[np.argsort(-count, kind="stable")[: 4 * HUBS]]:
            lo, hi = np.zeros(len(n), np.int64), n.copy()
            lo[owner[hub == h]], hi[owner[hub == h]] = least[hub == h], most[hub == h]
            hubs.append((lo, hi))
        # entries outside the list's most common label meet those inside and later ones outside
        _, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
        inside = inverse == int(np.argmax(count))
        outside = np.flatnonzero(~inside)
        for o in outside.tolist():
            j = np.arange(int(np.searchsorted(n, -(-SHARE * n[o] // 100), side="left")), int(np.searchsorted(n, 100 * n[o] // SHARE, side="right")))
            j = j[(label[j] != label[o]) & (inside[j] | (j > o))]
            j = j[_fits(n, pos, np.full(len(j), o), j)]
            for lo, hi in hubs:
                bound = np.minimum(hi[o], hi[j]) + np.minimum(n[o] - lo[o], n[j] - lo[j])
                j = j[bound >= needed(np.full(len(j), n[o]), n[j])]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), rep[o])), pa.array(rep[j])], names=["a", "b"])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in stream:
            lists = batch.column("list").to_numpy()
            edges = np.flatnonzero(np.diff(lists) != 0) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(lists)], strict=True):
                if lists[a] != current and held:
                    yield from flush(held)
                    held = []
                current = lists[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    return rows.mapInArrow(trimmed(run), "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A null or empty text, or one without words, has the empty set: n_shingles 0, linked with nothing, in a component of its own.
    A text of fewer than five words has its whole word sequence as its one shingle.  Rows with equal
    sets are one class and linked.  A null doc_id takes no part and has a null component_id.  Rows with
    equal doc_ids are judged by their texts, one by one.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    rows = saved(describe(docs), folder, "sets")
    own = rows.where("n is not null")
    frequent = rows.where("n is null").groupBy("k1").agg(F.sum("k2").alias("c")).orderBy(F.desc("c"), "k1").limit(FREQUENT).collect()
    frequent = sorted(((r["k1"], r["c"]) for r in frequent), key=lambda x: (x[1], x[0]))
    sets = saved(own.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), folder, "classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(spark, total / 4, BUCKET_TOKENS, LEAST_BUCKETS)
    index = _index_rows(docs, frequent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    compared = saved(_compare_lists(index), folder, "compared")

    key = sets.select("k1", "rep")
    pairs = compared.where("kind = 0").select("a", "b").distinct()
    side = lambda x: sets.select(F.col("k1").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "xa", "xb")
    both = bounded(pairs).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "b", "na", "nb", "most", "open")).alias("p"))
    pairs = saved(both.select("p.*"), folder, "pairs_one")
    one = verified(docs, pairs.where("open").select("a", "b"), sets, folder, "one")
    labels = saved(components(one.where("linked"), folder, "labels_one"), folder, "labels_one")

    entries = compared.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("k1"), "n", "pos").join(key, "k1")
    entries = entries.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("list", "n", "pos", "rep", F.coalesce("label", "rep").alias("label"))
    answer = lambda least, most: F.struct(F.col("a").alias("hub"), F.col(least).cast("int").alias("least"), F.col(most).alias("most"))
    known = one.select(F.col("b").alias("rep"), answer("both", "both").alias("x"))
    known = known.unionByName(pairs.where("not open").withColumn("none", F.lit(0)).select(F.col("b").alias("rep"), answer("none", "most").alias("x")))
    known = known.unionByName(pairs.select(F.col("a").alias("rep"), answer("na", "na").alias("x")).distinct())
    answers = known.groupBy("rep").agg(F.collect_list("x").alias("known"))
    left = _open_pairs(entries, answers).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
    left = bounded(left.join(done, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b"))
    left = saved(left.where("open").select("a", "b"), folder, "pairs_two")
    linked = one.where("linked").select("a", "b")
    if not left.isEmpty():
        linked = linked.unionByName(verified(docs, left, sets, folder, "two").where("linked").select("a", "b"))
        labels = saved(components(linked, folder, "labels_two"), folder, "labels_two")

    placed = sets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    whole = own.join(placed, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id; rows with a null doc_id stay.

    Where doc_ids repeat, a document is a doc_id with a text: of several in a component the smallest (doc_id, hash of the
    text) stays, and of rows that are alike in both one stays.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).where("doc_id is not null")
    if own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = join(docs).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
        return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    folder = work_folder(docs.sparkSession)
    ids = saved(own.distinct().withColumn("row", F.monotonically_increasing_id()), folder, "ids")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.struct("*").alias("whole"))  # whatever the columns are called
    marked = marked.join(ids.toDF("doc", "th", "row").hint("merge"), ["doc", "th"])
    found = join(marked.select(F.col("row").alias("doc_id"), F.col("whole.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id").distinct()
    stay = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "th", "row")).alias("least")).select(F.col("least.row").alias("row"))
    kept = marked.join(saved(stay, folder, "stay"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select("whole.*").unionByName(docs.where("doc_id is null"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """The same rows from all pairs, for small tables."""
    import re

    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + N]) for i in range(len(w) - N + 1)} if len(w) >= N else {tuple(w)} if w else set()))
    label = {d: d for d, _ in sets}
    changed = True
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= SHARE * len(x | y)]
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return [(d, len(s), label[d]) for d, s in sets]

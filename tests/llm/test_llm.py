"""Each operator against a brute-force version or the library, on a small table with nulls, ties, copies and long texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from playlog.llm import archive, decontam, langid, linededup, ngramjoin, spotsigs, substrings, tokencount, tokenfile, wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, th long, n int, `key` string"


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeo") for _ in range(r.randint(2, 7))) for _ in range(400)] + "the of and is a to in that".split() * 20
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, base = say(70), say(120).split()
    texts = {i: "\n".join(say(r.randint(3, 20)) for _ in range(r.randint(1, 14))) for i in range(40)}
    for i in range(40, 60):  # near copies
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = say(1)
        texts[i] = " ".join(w)
    for i in range(60, 70):
        texts[i] = f"{say(30)} {shared}\t{say(r.randint(0, 20))}"
    texts |= {70: texts[3], 71: texts[3], 72: "", 73: None, 74: "one", 75: "One", 76: " \n ", 77: say(9000), 78: "<|endoftext|>don't STOP É é 日本 ß١ <s>", 79: "a  b\n\n" * 30, 80: "x" * 5000}
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "xx", "s", len(t or ""), "clash", 1, 2, "k") for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[3], rows[64]], SCHEMA).repartition(3).cache()  # two rows are repeated


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def null_ids(spark):
    return spark.createDataFrame([(None, "some words here", None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None, None)], SCHEMA)


def listed():
    return [*TEXTS.items(), (3, TEXTS[3]), (64, TEXTS[64])]


def test_decontamination(spark, docs, empty, null_ids):
    item = " ".join(TEXTS[77].split()[100:140])
    edited = item.split()
    edited[10] = "changed"
    items = spark.createDataFrame([(1, " ".join(edited)), (2, None), (3, ""), (4, "never seen these words in this order at all"), (None, "x")], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, items).collect()] == [(77, 1, 1)]
    assert decontam.clean(docs, items).count() == len(listed()) - 1 and decontam.clean(docs, items).columns == docs.columns
    assert decontam.matches(empty, items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0
    assert decontam.clean(null_ids, items).count() == 2


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 12))]
        row = list(range(len(a) + 1))
        best = row[-1]
        for y in b:
            new = [0]
            for i, x in enumerate(a):
                new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert decontam.best_distance(a, b) == best


def test_archive(spark):
    html = [(1, "http://a/ b", "é" * 60), (2, None, "é" * 60), (3, "u", "WARC/1.1\r\n\r\n" * 20), (4, "u", None), (5, "u", ""), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "u", "filedesc://\n" * 40), (9, "u", "é" * 60), (9, "u", "é" * 60)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in archive.round_trip(pages).collect())
    want = []
    for i, _, h in html:
        b = (h or "").encode()
        again = h == "é" * 60 and i > 1
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else 0))
    assert got == sorted(want)
    assert archive.round_trip(pages.limit(0)).count() == 0


BLOCK = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
VERSION_1 = b"filedesc://x 0.0.0.0 20240101000000 text/plain %d\n%s\n" % (len(BLOCK), BLOCK)


def test_arc_versions_and_faults():
    ok = b"http://a 1.2.3.4 20240101000000 text/html 3\nabc\n"
    parse = lambda data: [(error is None, v, f.get("URL"), b) for _, error, v, f, b in archive.arc_records(data, {})]
    assert parse(VERSION_1 + ok) == [(True, 1, "http://a", b"abc")]
    assert parse(ok) == [(True, 1, "http://a", b"abc")]  # no version block
    assert parse(VERSION_1 + ok.replace(b"//a", b"//a b c")) == [(True, 1, "http://a b c", b"abc")]
    broken = (b"junk\n", b"http://b 1.2.3.4 20240101000000 text/html 999\nabc\n", b"http://b text/html 3\nabc\n", b"\xff\xfe 7x\n")
    for bad in broken:  # each is set aside, and the record behind it is read
        got = parse(VERSION_1 + bad + ok)
        assert [g[0] for g in got] == [False, True] and got[1][2:] == ("http://a", b"abc")
    assert [g[0] for g in parse(VERSION_1 + ok + ok[:-3])] == [True, False]


def test_archives_of_others(spark, tmp_path):
    """Broken records and foreign headers, in plain files and gzip members; every record of ours opens at its offset."""
    import gzip

    ok = b"http://a 1.2.3.4 20240101000000 text/html 3\nabc\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-1").write_bytes(VERSION_1 + b"junk\n" + ok)
    (tmp_path / "arc" / "part-2").write_bytes(gzip.compress(VERSION_1) + gzip.compress(ok + ok) + gzip.compress(b"x y\n"))
    parsed = archive.parsed_arc(spark, str(tmp_path / "arc"))
    assert archive.faults(parsed).count() == 2 and archive.read_arc(spark, str(tmp_path / "arc")).count() == 3
    archive.write_warc(archive.converted(spark, str(tmp_path / "arc"), str(tmp_path / "work")), str(tmp_path / "warc"))
    rows = archive.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(rows) == 3 and {(r.record_type, bytes(r.payload)) for r in rows} == {("resource", b"abc")}
    for r in rows:
        data = open(r.file.removeprefix("file:"), "rb").read()
        assert r.record_id.encode() in next(archive.members(data[r.offset :]))[1]
    assert all(r.record_id[23] == "5" for r in rows)
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "part-1").write_bytes(foreign + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n" + foreign.replace(b"urn:x", b"urn:y"))
    assert sorted(r.record_id for r in archive.read_warc(spark, str(tmp_path / "other")).collect()) == ["urn:x", "urn:y"]
    assert archive.faults(archive.parsed_warc(spark, str(tmp_path / "other"))).count() == 1
    big = b"x" * (17 << 20)
    assert next(archive.members(archive._member(big) + b"\0"))[1] == big


def test_substrings(docs, empty, null_ids):
    want = sorted(substrings.brute_force(listed()))
    for batches in (1, 3):
        assert sorted(map(tuple, substrings.digests(substrings.removed_words(docs, batches)).collect())) == want
    assert sum(w[2] for w in want) > 500
    assert substrings.removed_words(empty).count() == 0 and substrings.removed_words(null_ids).count() == 2


def test_substrings_compacted(docs, monkeypatch):
    merged = []
    compact = substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings, "MAX_RUNS", 1)
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: (merged.append(len(self.paths("fps"))), compact(self)))
    got = substrings.digests(substrings.removed_words(docs, 3))
    assert sorted(map(tuple, got.collect())) == sorted(substrings.brute_force(listed())) and merged == [2, 2]


def test_substrings_over_calls(spark, docs, tmp_path):
    """An index is opened again, in a session of its own, for the second batch; runs meet without a shuffle of fingerprints."""
    folder = str(tmp_path / "index")
    index = substrings.FingerprintIndex.create(spark, folder, 4)
    done = substrings.digests(substrings.removed_words(docs.where("doc_id < 45"), 1, index)).collect()
    index.close()
    other = spark.newSession()
    index = substrings.FingerprintIndex.open(other, folder)
    later = other.createDataFrame([(r.doc_id, r.text) for r in docs.where("doc_id >= 45").collect()], "doc_id long, text string")
    done += substrings.digests(substrings.removed_words(later, 1, index)).collect()
    assert sorted(map(tuple, done)) == sorted(substrings.brute_force(listed()))
    old, new = index.paths("fps")
    joined = index.table("fps", new).select("fp").hint("merge").join(index.table("fps", old).select("fp"), "fp")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() > 0
    with pytest.raises(ValueError):
        index.add(substrings._source(docs))
    index.close()


def doubled(k):
    """Two words of 2**k letters that sums of powers modulo 2**64 do not tell apart."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words(spark):
    """Different texts of regularly built words are different: op3 removes nothing, op5 links nothing, op4 tells them apart."""
    same, ends = [f"w{i}" for i in range(49)], doubled(10)
    rows = [(i + 1, " ".join([*same, e])) for i, e in enumerate(ends)]
    rows += [(i + 3, " ".join(x for x in doubled(8)[i])) for i in range(2)]  # the words follow the pattern
    rows += [(i + 5, f"{e} x") for i, e in enumerate(ends)] + [(i + 7, "x y z " + e) for i, e in enumerate(ends)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.digests(substrings.removed_words(table)).collect())) == sorted(substrings.brute_force(rows))
    assert sorted(map(tuple, ngramjoin.join(table).collect())) == sorted(ngramjoin.brute_force(rows))
    prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(table).collect()}
    assert prints[1] != prints[2] and prints[5] != prints[6]


def test_spotsigs(docs, empty, null_ids):
    rows = spotsigs.digests(spotsigs.compared(docs)).collect()
    order = sorted(((d, t or "") for d, t in listed()), key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (d, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.setdefault(d, []).append(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.edited_sha256)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[3] == prints[70] == prints[71] and prints[72] == prints[73] == ""
    sets = {d: {p[i : i + 8] for i in range(0, len(p), 8)} for d, p in prints.items() if p}
    first = {}
    for d in sorted(sets):
        first.setdefault(prints[d], d)
    reps = sorted(first.values())
    pairs = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(docs).collect()} == pairs and pairs
    assert spotsigs.compared(empty).count() == 0 and spotsigs.compared(null_ids).count() == 2


def test_ngram_join(docs, empty, null_ids):
    want = sorted(set(ngramjoin.brute_force(list(TEXTS.items()))))
    got = sorted(map(tuple, ngramjoin.join(docs).collect()))
    assert len(got) == len(listed()) and sorted(set(got)) == want and sum(w[0] != w[2] for w in want) > 15
    assert ngramjoin.keep_one(docs).columns == docs.columns
    assert ngramjoin.join(empty).count() == 0
    assert {tuple(r) for r in ngramjoin.join(null_ids).collect()} == {(None, 1, None), (1, 0, 1)}


def test_repeated_ids_go_by_text(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{r.random()}" for _ in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " more"), (4, b), (5, ""), (5, ""), (5, d), (6, d), (None, a), (None, a)]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = sorted(((x.doc_id or 0, x.text) for x in ngramjoin.keep_one(table).collect()))
    third = [x for x in got if x[0] == 3]
    assert [x for x in got if x[0] != 3] == sorted([(0, a), (0, a), (1, a), (2, b), (5, ""), (5, d)])
    assert len(third) == 1 and third[0][1] in (c, c + " more")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = sorted(((x.doc_id or 0, x.text) for x in decontam.clean(table, items).collect()))
    assert left == sorted((i or 0, t) for i, t in rows if i is None or t != a)


def test_bpe(docs, empty, null_ids):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(wordbpe.tokenizer_path())
    rows = wordbpe.encode(docs).collect()
    assert len(rows) == len(listed())
    for r in rows:
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert bytes(r.decoded).decode() == tok.decode(ids, skip_special_tokens=False)
    assert wordbpe.encode(empty).count() == 0 and wordbpe.encode(null_ids).count() == 2
    some = docs.sparkSession.createDataFrame([(1, [320, 256, 0]), (2, []), (3, None)], "key long, ids array<int>")
    assert {r.key: r.decoded for r in wordbpe.decode(some).collect()} == {1: tok.decode([320, 256, 0], skip_special_tokens=False), 2: "", 3: None}


def test_line_dedup(docs, empty, null_ids):
    rows = linededup.dedup(docs).collect()
    seen, want = set(), {}
    for d in sorted(TEXTS):
        t, out = TEXTS[d], []
        for c in linededup.chunks(t) if t is not None else ():
            if linededup._eligible(c):
                if tuple(c) in seen:
                    continue
                seen.add(tuple(c))
            out += c
        want[d] = None if t is None else "\n".join(out)
    assert len(rows) == len(listed()) and all(r.text == want[r.doc_id] for r in rows)
    assert sum(r.n_removed > 0 for r in rows) >= 2
    assert all("\n".join(x for c in linededup.chunks(t) for x in c) == t for t in TEXTS.values() if t is not None)
    assert linededup.dedup(empty).count() == 0 and linededup.dedup(null_ids).count() == 2


def test_line_dedup_runs(spark):
    r = random.Random(9)
    line = lambda: " ".join(r.choice("abcdefgh") * 3 for _ in range(6)) + str(r.random())
    passages = [[line() for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 8)]
    passages += [[passages[0][0], "", passages[1][1], " \t", line()]]  # blank lines within
    texts = []
    for _ in range(60):
        rows = [line() for _ in range(r.randint(1, 6))]
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(rows))
            rows[at:at] = p
        texts.append("\n".join(rows))
    texts += [texts[0], texts[1] + "\n", "\n\n" + texts[2], "x y\nx y", "x y\nx y", "q\nx y\nx y\nx y", "v v\nv v\nw\nu\nv v\nv v\nv v\nw", "o\n" + "p\n" * 9 + "s", "1\n\n1\n\n1\n\n1\n2\n1\n\n1"]
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    want = linededup.brute_force(list(enumerate(texts)))
    assert {(d, texts[d]): x.text for d, x in got.items()} == want
    assert all(x.n_removed == len(texts[d].split("\n")) - len(x.text.split("\n")) or not x.text for d, x in got.items())
    assert not got[60].text and got[61].text == "" and got[62].text == "\n" and got[64].text == "" and got[65].text == "q"
    assert got[66].text == "v v\nv v\nw\nu" and got[67].text == "o\np\np\ns" and got[68].text == "1\n\n1\n\n1\n\n1\n2"
    # a repeated run inside otherwise different texts goes wherever its neighbours lie
    first = {}
    for d, t in enumerate(texts):
        for n, p in enumerate(passages):
            if "\n".join(p) in t and first.setdefault(n, d) != d:
                assert "\n".join(p) not in got[d].text


def test_pipeline_lines(spark):
    import corpus_pipeline

    texts = ["a b\nc d\ne f", "a b\nc d\ne f", "a b\nc d\ne f\n", "\u3000\na b\nc d\ne f\r\n\t\n\x1c", "a b\nc d\nnew", " \n", None]
    left = corpus_pipeline.lines(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted((r.doc_id, r.text) for r in left.where("text is not null").collect()) == [(0, texts[0]), (3, "\u3000\ne f\r\n\t\n\x1c"), (4, "new"), (5, " \n")]
    assert left.where("text is null").count() == 1
    same = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d\n\t\n"), (3, "\u3000\na b\nc d\n\x1c")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.lines(spark, same, "").collect()] == [1]


def test_token_counts(docs, empty, null_ids):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path())
    for r in tokencount.count_tokens(docs, limit=100).collect():
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t)))
        assert r.fits_chars == len(t) if r.n_tokens <= 100 else len(sp.encode(t[: r.fits_chars])) <= 100
        assert not len(r.unit_counts) or np.frombuffer(r.unit_counts, "<i8")[-1] == r.n_tokens
    c, rng = tokencount.counter(tokencount.model_path()), random.Random(2)
    for t in (TEXTS[5], TEXTS[78], TEXTS[79]):
        for k in (0, 1, *(rng.randint(0, len(t)) for _ in range(20)), len(t)):
            assert c.count_at(t, k) == len(sp.encode(t[:k]))
    assert tokencount.count_tokens(empty).count() == 0 and tokencount.count_tokens(null_ids).count() == 2


def test_token_files(docs, empty, null_ids):
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(wordbpe.tokenizer_path()), 0, []
    for d, t in sorted(listed(), key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.round_trip(docs).collect())) == want
    files = tokenfile.write(docs, tokenfile.work_folder(docs.sparkSession), shard_bytes=20000)
    assert files["shards"] > 1 and sorted(map(tuple, tokenfile.read(docs.sparkSession, files).collect())) == want
    ids, offsets = tokenfile.open_shard(files["folder"].removeprefix("file://"), 0, files["width"])
    assert ids[-1] == 2 and offsets[0] == 0
    assert tokenfile.round_trip(empty).count() == 0 and tokenfile.round_trip(null_ids).count() == 2
    spark = docs.sparkSession
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)  # a writer's own limit does not split a shard
    try:
        assert sorted(map(tuple, tokenfile.round_trip(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    shard = tokenfile.Path(files["folder"].removeprefix("file://"), "ids", "shard=0")
    (shard / "part-more").write_bytes(next(shard.glob("part-*")).read_bytes())
    with pytest.raises(Exception, match="several files"):
        tokenfile.read(spark, files).collect()


def test_language_id(spark, docs, empty, null_ids):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert out and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[72] == got[73] == got[76] == "und" and got[5] == "xx"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(null_ids).collect()} == {"und"}


def test_decontamination_brute_force(spark):
    """All items against all passages of all documents, by plain edit distance on words."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    items = {i: [r.choice(words) for _ in range(r.randint(3, 26))] for i in range(25)}
    texts = {}
    for d in range(50):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        for item in r.sample(list(items.values()), 2):
            some = list(item)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(some))
                some[k : k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
                some = some or ["x"]
            at = r.randint(0, len(w))
            w[at:at] = some
        texts[d] = w

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {(d, i, e) for d, t in texts.items() for i, item in items.items() if (e := least(item, t)) <= decontam.budget(len(item))}
    docs = spark.createDataFrame([(d, " ".join(f"({x})," if r.random() < 0.1 else x.upper() if r.random() < 0.1 else x for x in t)) for d, t in texts.items()], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    assert {tuple(x) for x in decontam.matches(docs, table).collect()} == want and len(want) > 40


def test_language_ranks_brute_force(spark):
    """Profiles and predictions against plain counting and sorting of n-grams."""
    from collections import Counter

    r = random.Random(4)
    letters = {"aa": "abcdeéß", "bb": "xyzwvab", "cc": "日本語한글a\U00030001"}
    rows = [(i, lang, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7))).title() for _ in range(r.randint(1, 25))) + r.choice([".", "", "1 2!"])) for i, lang in enumerate(r.choice(list(letters)) for _ in range(60))]
    rows += [(100, "aa", None), (101, None, "abc"), (102, "bb", ""), (103, "cc", "12 !"), (104, None, "\U00030001")]

    def grams(text):
        out, word = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
                continue
            if word:
                padded = f" {word} "
                out += list(word) + [padded[k : k + 2] for k in range(len(padded) - 1)] + [padded[k : k + 3] for k in range(len(padded) - 2)]
            word = ""
        return out

    depth, learned = 40, {}
    for i, lang, text in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(lang, Counter()).update(grams(text))
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string").repartition(3)
    profile = langid.learn(docs, depth)
    for lang, count in learned.items():
        own = [n for x, n, _ in profile if x == lang]
        assert own == list(range(min(depth, len(count))))
        codes = [c for x, _, c in profile if x == lang]
        assert [sorted(count.values(), reverse=True)[k] for k in own] == [count[_gram(c)] for c in codes]
    rank = {lang: {_gram(c): n for x, n, c in profile if x == lang} for lang in learned}
    got = {x.doc_id: x for x in langid.identify(docs, depth).collect()}
    for i, _, text in rows:
        count = Counter(grams(text))
        if not count:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        value, _ = np.unique(langid.ngrams(text), return_counts=True)
        assert {_gram(int(np.uint64(v).view(np.int64))) for v in value} == set(count)
        top = [_gram(int(np.uint64(v).view(np.int64))) for v in langid.ranked(langid.ngrams(text), depth)]
        assert [count[g] for g in top] == sorted(count.values(), reverse=True)[:depth]
        gaps = {lang: sum(abs(rank[lang][g] - k) if g in rank[lang] else depth for k, g in enumerate(top)) for lang in sorted(rank)}
        best = min(gaps, key=gaps.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(0.0, 1 - gaps[best] / (depth * len(top)))) < 1e-12


def _gram(code):
    """The n-gram of a code, blanks for the ends of a word."""
    code &= (1 << 64) - 1
    n = 1 if code >> 62 == 3 else 2 if code >> 63 else 3
    return "".join(chr(c) if (c := (code >> 21 * k) & 0x1FFFFF) else " " for k in reversed(range(n)))


def test_columns_of_the_same_names(spark):
    import corpus_pipeline

    text = "some words of a language that is known " * 3
    table = spark.createDataFrame([(i, f"{text} {i}", "en", 7, "x", 8) for i in range(6)], "doc_id long, text string, lang string, score int, lang_pred string, n_removed int")
    kept = corpus_pipeline.language(spark, table, "")
    assert kept.columns == table.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {(7, "x")}
    assert langid.predict(table, langid.learn(table)).columns.count("score") == 1
    names = "doc_id long, text string, n_removed int, __doc string, __th string, doc int, th int, row int, whole int, gone string, new string, n_chars int"
    rows = [(i, f"{text} {i}\nline {i} a\n" + "one line\ntwo lines", 7, "u", "v", 1, 2, 3, 4, "g", "w", 5) for i in (1, 2, 2)]
    clash = spark.createDataFrame(rows, names)
    items = spark.createDataFrame([(1, "never said in this order")], "item_id long, text string")
    for kept, n in ((corpus_pipeline.lines(spark, clash, ""), 3), (ngramjoin.keep_one(clash), 2), (decontam.clean(clash, items), 3)):
        assert kept.columns == clash.columns and kept.dtypes[:2] == clash.dtypes[:2]
        found = kept.collect()
        assert len(found) == n and {tuple(r)[2:11] for r in found} == {rows[0][2:11]}
    assert {r.n_removed for r in linededup.dedup(clash).collect()} == {0, 2}


def test_pipeline_language(spark):
    import corpus_pipeline

    rows = [(i, "words of some language here", "en") for i in range(6)] + [(6, None, "en"), (7, "", None), (8, "12 !?", "en"), (None, "words of some language here", None), (1, "words of some language here", "en")]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 0, 1, 1, 2, 3, 4, 5]


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe_encoding"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(rows) < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and len({r.doc_id for r in rows}) == len(rows)


def test_rare_words_do_not_drive_out_frequent_ones(monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_BYTES", 100_000)
    c, asked = wordbpe.WordCodec(wordbpe.tokenizer_path()), []
    one = c._one
    monkeypatch.setattr(c, "_one", lambda w: asked.append(w) or one(w))
    letters = "abcdefghijklmnopqrst"
    rare = ["".join(letters[i // 20**k % 20] for k in range(4)) + "ué" for i in range(3000)]
    for i in range(0, 3000, 10):
        text = " ".join(["the house Für uns"] * 3 + rare[i : i + 10])
        assert list(np.frombuffer(c.encode(text), "<u4")) == c.tok.encode(text, add_special_tokens=False).ids
    assert asked.count("house") == asked.count("für") == 1 and len(asked) == 3004
    assert c.held <= 100_000 and c.held_recent <= 100_000

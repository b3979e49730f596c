"""Operators 11 to 13 against brute force, on small tables with nulls, ties, copies and long texts."""

import hashlib
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest

from playlog.llm import collocations, dialogue, minhash


# --- near-duplicate groups


def sets_of(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def groups_of(rows):
    sets = sets_of(rows)
    label = {d: d for d, _ in sets}
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted((d, len(s), label[d], label[d] == d) for d, s in sets)


def near_copies():
    """Groups around hidden or present originals: copies of copies, chains whose ends do not link, and neighbours below the threshold."""
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    rows, d = [], 0
    for k in range(12):
        base = say(r.choice([6, 9, 30, 80, 200]))
        now = list(base)
        for _ in range(r.randint(8, 25)):
            w = list(now if k % 3 == 0 else base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = say(1)[0]
            if k % 3 == 0:
                now = w  # a chain
            rows.append((d, " ".join(w)))
            d += 1
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, " \n"), (905, " ".join(say(9000))), (906, "a b c d"), (907, rows[4][1]), (908, rows[4][1].upper())]


def test_groups(spark, monkeypatch):
    rows = near_copies()
    table = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in rows], "doc_id long, text string, n int, rep long, bucket string").repartition(3)
    want = groups_of(rows)
    assert len({w[2] for w in want}) < len(want) - 60
    monkeypatch.setattr(minhash, "OUTSIDE", 3)  # several blocks a bucket
    assert sorted(map(tuple, minhash.groups(table).collect())) == want


def test_groups_beyond_stars(spark):
    """A link that no star edge finds: three sets of one bucket, the centre linked with neither of the others."""
    shared = [f"s{i}" for i in range(100)]
    sets = {1: shared + [f"a{i}" for i in range(30)], 2: shared + [f"b{i}" for i in range(25)], 3: shared + [f"b{i}" for i in range(25)] + ["c0", "c1"]}
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in sets.items()], "doc_id long, text string")
    known = minhash.described(texts).select(minhash.F.col("doc_id").alias("rep"), "n", "bits").cache()
    members = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1), (8, 3)], "bucket long, rep long")
    assert {(r.a, r.b) for r in minhash.stars(members).collect()} == {(1, 2), (1, 3)}
    none = spark.createDataFrame([], "id long, label long")
    assert {(r.a, r.b) for r in minhash.open_pairs(members, none, known).collect()} == {(2, 3)}
    assert sorted(map(tuple, minhash.groups(texts).collect())) == groups_of([(d, " ".join(w)) for d, w in sets.items()])


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.groups(spark.createDataFrame([], schema)).count() == 0
    got = minhash.groups(spark.createDataFrame([(None, "some words"), (None, None), (1, None), (2, "x"), (2, "x"), (2, "y")], schema)).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 1, 0, True), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (2, 1, 2, True)]


def test_signatures_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(3)
    for n in (3, 20, 90, 2000):  # few, and more, elements than bins
        share = []
        for _ in range(400):
            every = r.integers(0, 1 << 63, n + n // 3, dtype=np.uint64)
            x, y = np.unique(every[:n]), np.unique(every[n // 3 :])
            share.append((minhash.signature(x) == minhash.signature(y)).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(share)) < 0.02


# --- phrases


def phrases_of(rows, longest, least, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 50 * found[lang, w[i : i + k]]}
    out = []
    for lang in n:
        best = []
        for (x, w), a in found.items():
            if x == lang and (lang, w) not in gone:
                score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first], 1)]
    return sorted(out)


def texts():
    r = random.Random(2)
    words = ["the", "of", "new", "york", "city", "a", "É", "ß", "日本", "x" * 90, "Run", "tests"] + [f"v{i}" for i in range(60)]
    say = lambda n: "".join(r.choices(words, [9] * 3 + [4] * 9 + [1] * 60)[0] + r.choice([" "] * 12 + ["\t", ". ", ", ", "\n", "?!", "\x0b", ""]) for _ in range(n))
    rows = [(say(r.randint(0, 300)), r.choice(["en", "fr", None, "und"])) for _ in range(60)]
    return rows + [(None, "en"), ("", None), (",.;", "en"), ("word", "xx"), (say(20000), "en"), rows[0], rows[0]]


@pytest.mark.parametrize("cells", [1 << 16, 1 << 20])
def test_phrases(spark, monkeypatch, cells):
    rows = texts()
    table = spark.createDataFrame([(t, g, "k", 1) for t, g in rows], "text string, lang string, phrase string, f int").repartition(3)
    monkeypatch.setattr(collocations, "SLICE", 5000)
    for name, n in (("HELD", 2000), ("NEW", 300), ("SENT", 700)):  # several sketches and tables a task
        monkeypatch.setattr(collocations, name, n)
    assert sorted(map(tuple, collocations.mine(table, cells=cells).collect())) == phrases_of(rows, 3, 10, 2000)
    assert sorted(map(tuple, collocations.mine(table, longest=4, least=5, first=7, cells=cells).collect())) == phrases_of(rows, 4, 5, 7)


def test_phrases_of_odd_tables(spark):
    schema = "text string, lang string"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en")], schema)).count() == 0


def test_sketch_never_falls_short(spark):
    """With a sketch that is much too small everything survives; with one that is large, little that is rare does."""
    places = np.array([0, 0, 3, 254, 255, 256, 600, 65535])
    assert collocations.unpacked(collocations.packed(places)).tolist() == places.tolist()
    rows = [(" ".join(f"r{i}_{j}" for j in range(200)), "en") for i in range(50)] + [("often said", "en")] * 12
    table = spark.createDataFrame(rows, "text string, lang string")
    bits = collocations.sketched(table, 1 << 20).collect()
    full = sum(int.from_bytes(r.bits, "little").bit_count() for r in bits)
    assert 3 * collocations.DEPTH <= full < 30  # often, said, often said
    assert {r.phrase: r.f for r in collocations.counted(table).where("n_words > 0").collect()} == {"often": 12, "said": 12, "often said": 12}


# --- turns


def repaired_by_force(rows):
    """(cost, audit, lines) by the cheapest edit string of every suffix."""
    nxt = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    due, role_of = "uuau", {"u": "user", "a": "assistant"}

    @cache
    def best(i, q, inserts):
        out = []
        if i == len(rows):
            if q in (0, 3):
                out.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            cost, audit, lines = best(i + 1, q, 3)
            out.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                for letter, price, name in [("K", 0, role), *(("R", 3, role_of[c]) for c in "ua")]:
                    if name[:1] in nxt[q]:
                        cost, audit, lines = best(i + 1, nxt[q][name[:1]], 3)
                        out.append((cost + price + more, letter + audit, (f"{name}:{text}", *lines)))
        if inserts:
            cost, audit, lines = best(i, nxt[q][due[q]], inserts - 1)
            out.append((cost + 3, "I" + audit, (f"{role_of[due[q]]}:", *lines)))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    return best(0, 0, 3)


def summaries_by_force(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted(((t is not None, t or 0, " " if role is None else role, " " if text is None else text) for c, t, role, text in table if c == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for some, t, _, _ in rows if some]
        count = Counter(m[2] for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = repaired_by_force(tuple(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(6)
    say = lambda: r.choice(["", " \t", "Hello.", "So?", "so", "é!", "end", "x" * 50 + ".\n", "ok!", None, f"t{r.random()}."])
    table = [(c, r.choice([None, *range(9), 20]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), say()) for c in range(150) for _ in range(r.randint(1, 9))]
    return table + [(None, 1, "user", "a."), (None, 2, "user", "b."), (500, 1, "assistant", ".")] + [(501, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"{i}.") for i in range(300)]


SCHEMA = "conv_id long, turn long, role string, text string, fault int, cost string, place string"


def test_turns(spark):
    table = conversations()
    rows = spark.createDataFrame([(*t, 1, "c", "p") for t in table], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in dialogue.summaries(rows).collect()}
    want = summaries_by_force(table)
    assert got == want and {"D", "I", "K", "R"} == {x for w in want.values() for x in w[6]}
    edits = dialogue.repair(rows).collect()
    left = Counter(r.conv_id for r in edits if r.edit != "I")
    assert left == Counter(t[0] for t in table)
    for conv in (0, 1, 501):
        mine = sorted((r for r in edits if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine if r.edit != "D"))


def test_turns_damaged(spark):
    import zlib

    table = [t for t in conversations() if t[0] != 501]
    rows = spark.createDataFrame([(*t, 1, "c", "p") for t in table], SCHEMA).repartition(2)
    after = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = dict.fromkeys({t[0] for t in table}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())) | summaries_by_force(after)
    assert {r[0]: tuple(r)[1:] for r in dialogue.restored(rows).collect()} == want
    assert dialogue.restored(rows.limit(0)).count() == 0 and dialogue.repair(rows.limit(0)).count() == 0


def test_turns_by_name(spark):
    """Conversations may be named by text."""
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "user", "Hi")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id: (r.cost, r.audit) for r in dialogue.summaries(rows).collect()} == {"a": (0, "KK"), "b": (4, "D")}


def test_transition_table_stays_small():
    """Vectors that rows can lead to, whatever follows whatever."""
    symbols = [(x, f) for x in "sua?" for f in ("none", "blank", "truncated")]
    found, new = {dialogue.END}, [dialogue.END]
    while new:
        new = [v for v in {dialogue.step(x, s)[0] for x in new for s in symbols} if v not in found]
        found |= set(new)
    assert len(found) < 60

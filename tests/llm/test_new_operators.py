"""Conversation repair, fingerprints and collocations against plain code."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from pagegauge.llm import op11_conversation_repair as op11
from pagegauge.llm import op12_fingerprints as op12
from pagegauge.llm import op13_collocations as op13

SPACE = " \t\n\x0b\x0c\r"


# -- conversation repair ------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The least of all edit sequences that cost no more than deleting everything."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        trimmed = text.strip(SPACE)
        faults.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    results = []
    limit = 3 * len(rows)  # deletes all

    def go(i, roles, cost, audit, kept):
        nonlocal limit
        if cost > limit:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            limit = min(limit, cost)
            results.append((cost, audit, kept))
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", kept)
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                go(i + 1, roles + role[:1] if role else roles + "-", cost + cut, audit + "K", [*kept, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], cost + 2 + cut, audit + "R", [*kept, (r, text)])
        for r in ("user", "assistant"):
            go(i, roles + r[0], cost + 2, audit + "I", [*kept, (r, "")])

    go(0, "", 0, "", [])
    cost, audit, kept = min(results, key=lambda r: r[:2])
    times = [r[1] for r in rows if r[1] is not None]
    count = Counter(faults)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest


def asked(spark, tmp_path, rows, schema="conv_id long, turn int, role string, text string"):
    path = tmp_path / f"c{random.random()}"
    path.mkdir()
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/conversations.parquet")
    got = op11.query(spark, str(path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r["audit"], r.repaired_sha256) for r in got}


def test_repair_is_as_by_trying_all_edits(spark, tmp_path):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \t", "What?", "Fine.  ", "é."]
    rows = []
    for conv in range(50):
        turn = rng.randrange(-1, 4)
        for _ in range(rng.randrange(1, 5)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice([*texts, None])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, "assistant", "b.")]
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    assert asked(spark, tmp_path, rows) == {c: plain_repair(by[c]) for c in {r[0] for r in rows}}


def test_long_conversation_spills_its_backpointers(spark, tmp_path, monkeypatch):
    turns = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(3000)]
    path = tmp_path / "long"
    monkeypatch.setattr(op11, "HELD", 64)
    state = op11._Repair()
    for _, i, role, _ in reversed(turns):
        state.add(True, i, role, "")
    assert state.back._rolled and state.record("=1")["audit"] == "K" * 3000
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found, repaired = op11.repair(rows)
        assert [r["audit"] for r in found.collect()] == ["K" * 3000]
        assert [(r.place, r.role, r.text) for r in repaired.collect()] == [(i, role, text) for _, i, role, text in turns]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not path.exists()


def test_empty_conversations_and_clashing_columns(spark, tmp_path):
    assert asked(spark, tmp_path, []) == {}
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert asked(spark, tmp_path, [(gone, 1, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", "x", 3, True, 9)], "conv_id long, turn int, role string, text string, conv string, at int, row boolean, place long")
    found, turns = op11.repair(rows)
    assert [r["audit"] for r in found.collect()] == ["KI"] and [(r.role, r.text) for r in turns.collect()] == [("user", "Hi."), ("assistant", "")]


# -- fingerprints -------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def terms(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def generalised_jaccard(a, b):
    a, b = terms(a), terms(b)
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet alpha beta gamma delta".split()) + str(rng.randrange(40)) for _ in range(n))


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(12)
    cases = []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        a = prose(rng, 200)
        w = a.split()
        cut = int(len(w) * share)
        cases.append((a, " ".join(w[:cut] + prose(rng, 200 - cut).split())))
    chorus = prose(rng, 8)
    cases.append((" ".join([chorus] * 10 + [prose(rng, 50)]), " ".join([chorus] * 3 + [prose(rng, 50)])))  # by weights
    cases.append(("one two", "one two"))
    cases.append(("", " \n "))
    cases.append(("", "one two"))
    k = 64
    rows = spark.createDataFrame([(i, j, t) for i, pair in enumerate(cases) for j, t in enumerate(pair)], "i int, j int, text string")
    got = {(r.i, r.j): r.slots for r in op12.signatures(rows, ["i", "j"], samples=k).collect()}
    for i, (a, b) in enumerate(cases):
        x, y = got[i, 0], got[i, 1]
        rate = 1.0 if x is None and y is None else 0.0 if x is None or y is None else sum(p == q for p, q in zip(x, y)) / k
        true = generalised_jaccard(a, b)
        assert abs(rate - true) <= 4 * math.sqrt(max(true * (1 - true), 0.002) / k), (i, rate, true)


def test_slots_are_those_of_plain_code(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    text = "a b c d e f g a b c d e f"
    w = [h64(x.encode(), 42) for x in words(text)]

    def shingle(hs):
        seed = 42
        for h in hs:
            seed = h64(h.to_bytes(8, "little"), seed)
        return seed

    weights = Counter(shingle(w[i : i + 5]) for i in range(len(w) - 4))

    def value(h, n, k):
        h1, h2 = (h64((2 * k + d).to_bytes(4, "little"), h64(h.to_bytes(8, "little"), 42)) for d in (0, 1))
        u = lambda x, low: ((x >> low & (1 << 32) - 1) + 0.5) / 2**32
        r, beta = -math.log(u(h1, 32) * u(h1, 0)), math.log(u(h1, 0)) / math.log(u(h1, 32) * u(h1, 0))
        c = -math.log(u(h2, 32) * u(h2, 0))
        return math.log(c) - r * (math.floor(math.log(n) / r + beta) - beta + 1), h2 & (1 << 30) - 1

    row = spark.createDataFrame([(1, text)], "i int, text string")
    slots = op12.signatures(row, ["i"]).first().slots
    assert {r.h: r.w for r in row.select(F.inline(op12.weighted_terms(F.col("text")))).collect()} == {signed(h): n for h, n in weights.items()}
    for k, slot in enumerate(slots):
        log_a, low = min(value(h, n, k) for h, n in weights.items())
        assert slot & (1 << 30) - 1 == low and abs((slot >> 30) / 2**25 - 128 - log_a) < 1e-6


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_edits_and_order(spark, partitions):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 30))) for i in rng.sample(range(1000), 60)]
    rows += [(7, "é" * 5), (7, "Zwölf Boxkämpfer jagen 😀 Viktor"), (None, "no id"), (None, "nor this one"), (None, ""), (2000, None), (2001, "same text"), (2002, "same text"), (2001, "same text")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, bucket string, place int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = op12.fingerprint_edits(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashed(r[1])))
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    none = lambda r: (r[0] is None, *[x or 0 for x in r[:1]], *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=none) == sorted(want, key=none)
    same = {op12_text(r.slots) for r in got if r.doc_id in (2001, 2002)}
    assert len(same) == 1 and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert sorted(r.near_next for r in got if r.doc_id == 2001) == [1.0, 1.0]


def op12_text(slots):
    return tuple(slots or ())


def test_fingerprints_of_one_row_and_of_none(spark):
    one = op12.fingerprint_edits(spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(3, 1.0, hashlib.sha256(b"a b c d a b c d").hexdigest())]
    assert op12.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- collocations -------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in kept.items():
        longer = [b for (l2, q), b in kept.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, l, r))
    return {(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, _, p, a, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("partitions,block,top", [(1, 4096, 2000), (13, 3, 2000), (13, 1, 5)])
def test_collocations_are_as_by_plain_counting(spark, monkeypatch, partitions, block, top):
    rng = random.Random(13)
    vocabulary = ["the", "The", "of", "a", "cat", "cat\x01", "\x00cat", "\x01\x00", "über", "naïve", "x\x0e", "z", "zz", "no-break space"]
    weight = [30, 5, 20, 10, 8, 3, 3, 3, 6, 6, 3, 4, 4, 4]
    texts = []
    for _ in range(150):
        words_ = rng.choices(vocabulary, weight, k=rng.randrange(0, 40))
        texts.append("".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words_))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), t) for t in texts] + [("fr", None), ("fr", ""), ("it", "a b c")]
    monkeypatch.setattr(op13, "BLOCK", block)
    monkeypatch.setattr(op13, "SHARD", 500)
    monkeypatch.setattr(op13, "RANGE", 1 << 20 if partitions == 1 else 300)
    monkeypatch.setattr(op13, "MERGE", 50)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, gram string, part int").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in op13.collocations(docs, least=4, top=top).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = plain_collocations(rows, 4, top)
    assert len(got) == len(want) > 10 and set(got) == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 5_000_000_019, 7_000_000_033, 6_000_000_007
    counts = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = counts.select(F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r")).alias("s")).first().s
    assert got == 1_000_000 * a * a // (l * r)


def test_transducer_shares_states_and_gives_its_phrases_back():
    t = op13.CountTransducer()
    phrases = sorted([x, y, z] for x, y, z in itertools.product("ab", "cd", "ef"))
    for i, p in enumerate(phrases):
        t.add(p, 7)
    data = t.data()
    assert [w for w, _ in op13.accepted(data)] == phrases and {tuple(c) for _, c in op13.accepted(data)} == {(0, 0, 7)}
    assert len(t.states) == 3  # one of each depth below the first


def test_no_documents_no_phrases(spark):
    assert op13.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []

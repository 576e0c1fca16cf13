"""Operators on training data: brute force on small tables, and the odd cases that all of them must bear."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegauge.llm import (
    op1_jaccard_join as op1,
    op2_quality_rules as op2,
    op3_license_scan as op3,
    op4_sharding as op4,
    op5_chat_preference as op5,
    op6_mixing as op6,
    op7_suffix_dedup as op7,
    op8_line_dedup as op8,
    op9_decontamination as op9,
    op10_toxicity as op10,
)
from pagegauge.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def near(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Random texts with exact copies, near copies of growing distance, shared passages and repeated lines."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [make(rng.randrange(1, 160)) for _ in range(60)]
    base, passage = make(120), make(40)
    out += [near(rng, base, 0.01 * (i % 6)) for i in range(40)] + [base] * 5
    out += [make(30) + "\n" + passage + "\n" + make(30) for _ in range(10)]
    out += ["", None, "   \n\t", "one", "one", "one two", "ä é ß " * 100, "Repeat me. " * 60, "LOUD text Here is ONE", "loud text here is one"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)], DOC).repartition(3).cache()


def test_jaccard_components(docs, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in range(len(texts))}
    assert len(set(group)) < len(texts) - 20


@pytest.mark.parametrize("cells", [1 << 24, 200])
def test_prefix_tree_is_exact(monkeypatch, cells):
    monkeypatch.setattr(op1.PrefixTree, "STEP", 4)
    monkeypatch.setattr(op1.PrefixTree, "CELLS", cells)
    monkeypatch.setattr(op8, "PAIRS", cells)
    rng = np.random.default_rng(1)
    for percent in (30, 50, 80):
        for _ in range(15):
            base = rng.permutation(60).astype(np.uint64)  # one order for all; many sets begin alike or are prefixes
            draw = lambda base=base: base[: rng.integers(1, 60)]
            sets = [x[rng.random(len(x)) < rng.choice([0.6, 0.95, 1])] for x in (draw() for _ in range(40))]
            sets = list({s.tobytes(): s for s in sets if len(s)}.values())
            held, asking = sets[: len(sets) // 2], sets[len(sets) // 2 :]
            both = lambda a, b: len(np.intersect1d(a, b))
            want = {(i, j) for i, a in enumerate(asking) for j, b in enumerate(held) if 100 * both(a, b) >= percent * (len(a) + len(b) - both(a, b))}
            # twice the same group, so that rows and groups are told apart
            sets = (held + asking) * 2
            flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
            m, n = len(held), len(held) + len(asking)
            want = {(x + m + i, x + j) for x in (0, n) for i, j in want}
            for match in (op1.tree_match, op8.overlap_match):
                assert set(zip(*(x.tolist() for x in match(flat, offsets, [(0, m, n), (n, n + m, 2 * n)], percent)), strict=True)) == want


@pytest.mark.parametrize("unit", ["documents", "lines"])
def test_salts_and_blocks_lose_nothing(spark, monkeypatch, unit):
    """All sets are in one family, every token is hot, and blocks hold a few sets each."""
    from pagegauge.llm import setjoin

    monkeypatch.setattr(setjoin, "HOT", 2)
    monkeypatch.setattr(setjoin, "ABOVE_MEAN", 0)
    monkeypatch.setattr(setjoin, "BLOCK_TOKENS", 150)
    rng = random.Random(12)
    base = " ".join(f"b{i}" for i in range(40))
    texts = [near(rng, base, 0.02 * (i % 9)) for i in range(70)] + [near(rng, near(rng, base, 0.3), 0.02 * (i % 5)) for i in range(30)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "en", "s", None) for i, t in enumerate(texts)], DOC).repartition(4)
    if unit == "lines":
        sets, want = [], Counter()
        for i in sorted(range(len(texts)), key=lambda i: (i % 7 == 0, i)):
            s = frozenset(words(texts[i]))
            if i % 7:
                want[i] += any(100 * len(s & o) >= 80 * len(s | o) for o in sets)
                sets.append(s)
        got = {r.doc_id: r.n_removed for r in op8.dedup_lines(docs).collect() if r.doc_id is not None}
        assert got == dict(want)
        return
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(words, texts)]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((i for i in range(len(texts)) if group[i] == g and i % 7), default=None) for g in set(group)}
    want = Counter((i if i % 7 else None, least[group[i]]) for i in range(len(texts)))
    assert Counter((r.doc_id, r.component_id) for r in op1.jaccard_components(docs, k=2).collect()) == want


def test_words_of_two_letters_have_their_own_hashes():
    """Long words in the order of Thue and Morse cancel out in hashes that are sums of powers."""
    from pagegauge.llm import tokensets

    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word[:n] for n in (512, 1024, 2048, 4096)] + [other[:n] for n in (512, 1024, 2048, 4096)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert len(set(tokensets.words(raw, offsets)[0].tolist())) == 8
    prefix = op7._prefix(raw)
    assert len(set(op7._hash(prefix, offsets[:-1], offsets[1:]).tolist())) == 8


def test_lines_of_large_and_null_ids(spark):
    line, other = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    rows = [(1 << 40, line), (2**63 - 1, line), (None, line + "\nalone here"), (None, other), (-5, other), (None, "only in rows without an id a"), (None, "only in rows without an id b")]
    out = sorted(((r.doc_id, r.kept_text) for r in op8.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert [t for i, t in out if i is not None] == [other, "", ""] or {i: t for i, t in out if i is not None} == {-5: other, 1 << 40: "", 2**63 - 1: ""}
    # rows without an id are documents of their own: these two lines are no copies, whatever happens to other rows
    assert sum("only in rows" in (t or "") for i, t in out if i is None) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_repeated_strings(docs, texts):
    n = 40
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    want = {}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[k] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())

    def run():
        return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in op7.remove_repeats(docs, n).collect()}

    assert run() == want
    before, op7.SORT_ROWS = op7.SORT_ROWS, 3  # anchors with many occurrences are counted by a shuffle
    try:
        assert run() == want
    finally:
        op7.SORT_ROWS = before


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    sizes, groups = rng.integers(0, 13, 300), np.sort(rng.integers(0, 9, 300))
    s = op7.Suffixes(data, sizes, groups)
    want = sorted(range(300), key=lambda i: (groups[i], data[i, : sizes[i]].tobytes(), i))
    assert s.sort().tolist() == want


def test_lines(docs, texts):
    sets, want = [], {}
    for k, t in enumerate(texts):
        lines = (t if t is not None else "").split("\n")
        kept, gone = [], 0
        for line in lines:
            s = frozenset(words(line))
            hit = bool(s) and any(100 * len(s & o) >= 80 * len(s | o) for o in sets)
            sets += [s] if s else []
            gone += hit
            kept += [] if hit else [line]
        want[k] = (0, 0, None) if t is None else (len(lines), gone, "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in op8.dedup_lines(docs).collect()}
    assert got == want


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 7, 40, 300, 2000) for k in (0, 1, 3, n // 50) for p in (0.0125, 0.3) if k < n * p]
    for k, n, p in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(op2.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_bound_false_rejections(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w%d" % rng.randrange(10**6) for _ in range(80)) + (" ###" * 40 if i % 10 == 0 else ""), "en", "s", None) for i in range(1200)]
    labels = [(i, 0 if i % 10 == 0 else 1, 0) for i in range(1200)]
    out = op2.judge(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in out)
    few = op2.judge(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept for r in few if r.doc_id % 10)  # too few labels: no rule is safe


def test_repeat_words(spark):
    got = spark.createDataFrame([("a b c a b c x",), ("a a a a",), ("a b",), ("a b c d",)], "t string").select(op2.repeat_words(F.split("t", " ")))
    assert [r[0] for r in got.collect()] == [6, 4, 0, 0]


def test_licences(spark):
    rows = [(1, "some text\nReleased under the MIT License."), (2, "Released under MIT"), (3, None), (4, "licensed UNDER the apache license, version 2.0"), (5, "x\n\nAll rights reserved\nAll rights reserved.")]
    got = {r.doc_id: (r.n_passages, r.license, r.passage) for r in op3.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "MIT", 1), 2: (0, None, -2), 3: (0, None, -2), 4: (1, "Apache-2.0", 0), 5: (2, "proprietary", 2)}


def test_wrapped_licences(spark):
    import textwrap

    full = op3.TEMPLATES["MIT-full"]
    wrapped = "# module\n" + "\n".join("# " + x for x in textwrap.wrap(full, 50)) + "".join(f"\nx{i} = y{i}" for i in range(300))
    prose = "The tool of that name is free. It was Released under the MIT License. Its manual isn't, and nobody knows why."
    rows = [(1, wrapped), (2, prose), (3, "released for the many and under no license " * 400), (4, ""), (None, wrapped), (None, wrapped.replace("Permission", "Leave"))]
    rows += [(5, " ".join(f"w{i}" for i in range(100_000)) + " " + op3.TEMPLATES["ISC"]), (6, "All rights\nreserved by nobody in particular, as the whole of this text tells")]
    got = sorted((r.doc_id or 0, r.license, r.passage) for r in op3.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:2] == [(0, "MIT-full", -3), (0, "MIT-full", -3)]
    assert got[2:] == [(1, "MIT-full", -3), (2, "MIT", -3), (3, None, -2), (4, None, -2), (5, "ISC", -3), (6, "proprietary", -3)]


def test_windows_by_brute_force():
    import random

    rng = random.Random(5)
    templates = {"a": "x y z w v u", "b": "x y x y q", "c": "z w"}
    find = op3.best_window(templates, 0.8)
    for _ in range(400):
        words = [rng.choice("xyzwvuqr") for _ in range(rng.randrange(0, 25))]
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        best, names = None, set()
        for name, text in sorted(templates.items()):
            own = set(op3.template_bigrams(text))
            for i, g in enumerate(grams):
                seen = set(grams[i : i + len(text.split()) - 1])
                dice = 2 * len(seen & own) / (len(seen) + len(own))
                if g in own and dice >= 0.8:
                    key = (-len(seen & own), -dice, name)
                    best = min(best, key) if best else key
                    names.add(name)
        assert find(" ".join(words)) == (sorted(names), best and (-best[0], -best[1], best[2]))


def test_lookup_table():
    shards = [f"n{i}" for i in range(7)]
    a = op4.lookup_table(shards, 1009)
    share = Counter(a)
    assert max(share.values()) - min(share.values()) <= 1 and len(a) == 1009
    b = op4.lookup_table(shards[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 6)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        op4.lookup_table(shards, 1000)


def test_preferences(spark):
    t = lambda i, r, x: (i, r, x)
    kind = "pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>"
    pair = (1, [t(0, "user", "hi"), t(1, "assistant", "yes")], [t(0, "user", "hi"), t(1, "assistant", "no")])
    got = op5.format_preferences(spark.createDataFrame([pair, (2, None, [t(0, "user", None)])], kind)).orderBy("pair_id").collect()
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    s = got[0].chosen_spans[0]
    assert got[0].chosen_completion[s.begin : s.end] == "yes<|im_end|>\n" and got[0].informative
    assert got[1].n_prompt_turns == 0 and got[1].chosen_completion == "" and got[1].rejected_spans == []


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in op6.source_targets(sizes).collect()}
    assert got[None] == 200 and got["a"] == 200 and got["c"] == 20 and got["b"] == pytest.approx(1815 - 420)


def test_mixing_takes_what_it_says(docs):
    told = {r.doc_id: (r.size, r.taken) for r in op6.mixture(docs).collect()}
    taken = Counter(r.doc_id for r in op6.mix_sources(docs).collect())
    assert all(n <= 2 * size for size, n in told.values())
    assert all(told[i][1] == told[i][0] * taken.get(i, 0) for i in told if told[i][0])


def test_reparameterised_question(spark):
    item = "If a train covers 120 km in 3 hours then how far does Alice ride in 3 hours at that speed"
    benchmark = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    rows = [(1, "so. " + item.replace("120", "450").replace("3", "7").replace("Alice", "Bob") + " ok"), (2, item.replace("120", "450").replace("in 3 hours at", "in 9 hours at").replace("in 3", "in 7")), (3, "nothing of this kind is here at all, not one window"), (4, None), (None, item)]
    got = {r.doc_id: r.contaminated for r in op9.flag_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    # in row 2 the same value of the item has two values in the document
    assert got[1] and got[None] and not got[2] and not got[3] and not got[4]
    # with the item's own values before the clash it is a copy whose end was changed
    part = op9.flag_contaminated(spark.createDataFrame([(5, item.replace("in 3 hours at", "in 9 hours at"))], "doc_id long, text string"), benchmark).first()
    assert part.contaminated


def test_questions_with_other_names_and_numbers_are_found(spark):
    rng = random.Random(5)
    people = ["Alice Smith", "Carol", "Dave Brown", "Eve", "Frank van Dyke", "Grace Lee Hall", "Ivan"]
    forms = [
        "{a} bought {x} apples and {y} pears before {b} came home with {z} more of them, so how many fruits are there now",
        "If a train covers {x} km in {y} hours then how far does {a} ride with {b} in {z} hours",
        "At the market {a} sells {x} kg of flour to {b} who bakes {y} loaves from it and keeps {z} of these",
        "{a} has {x} coins in the old box",
        "How long does {a} need for {x} miles at {y} mph when {b} is waiting there since {z} minutes or so",
    ]
    def fill(form):
        a, b = rng.sample(people, 2)
        x, y, z = rng.sample(range(2, 999), 3)
        return form.format(a=a, b=b, x=x, y=y, z=z)
    items = [(i, fill(f)) for i, f in enumerate(forms)]
    other = [(100 * k + i, ("It was said that " if k % 2 else "Today. ") + fill(f) + ".") for k in range(8) for i, f in enumerate(forms)]
    clean = [(10_000 + i, f"{rng.choice(people)} walked {rng.randrange(99)} km and met {rng.choice(people)} near the {rng.randrange(9)} old mills of the valley, where it rained") for i in range(40)]
    out = op9.flag_contaminated(spark.createDataFrame(other + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    hit = {r.doc_id: r["items"] for r in out}
    found = sum(i % 100 in hit[i] for i, _ in other)
    assert found >= 0.9 * len(other), [(t, hit[i]) for i, t in other if i % 100 not in hit[i]]
    assert not any(hit[i] for i, _ in clean)


def test_slots_have_to_be_consistent(spark):
    pair = lambda a, b: spark.range(1).select(op9.consistent(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert pair(["3", "4", "3"], ["7", "8", "7"]) and not pair(["3", "4", "3"], ["7", "8", "9"]) and not pair(["3", "4"], ["7", "7"])


def test_toxicity_generalises(spark):
    rng = random.Random(9)
    make = lambda bad: " ".join("".join(rng.choice("aeioklmnst") for _ in range(rng.randrange(2, 8))) for _ in range(30)) + (f" {rng.choice(['zwuggish', 'zwuggishly', 'unzwuggish'])} brafzonk" if bad else "")
    rows = [(i, make(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    model = op10.fit(docs, labels)
    out = op10.score(docs, model).withColumn("held", op10.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert len(held) > 150 and np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    other = spark.createDataFrame([(1, "a nice zwuggisch brafzonks"), (2, "a nice loaf mints")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in op10.score(other, model).collect()}
    assert s[1] > s[2]


ODD = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n \t", None, "a", 0),
    (4, "same text here with a few more words to make a shingle", "en", "a", 3),
    (4, "same text here with a few more words to make a shingle", "en", "a", 3),
    (5, "same text here with a few more words to make a shingle", "en", "b", 3),
    (None, "same text here with a few more words to make a shingle", "de", "b", 3),
    (6, "x" * 300_000, "en", "b", 3),
    (7, "long words and more of them " * 20_000, "en", "b", 3),
]


def cases(spark):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(DOC)
    odd = spark.createDataFrame(ODD, schema)
    for name in ("n", "h", "key", "slot", "score", "spans", "n_lines", "sid", "rate", "number", "kept", "a", "begin"):
        odd = odd.withColumn(name, F.lit("clash"))
    return {"odd": (odd, len(ODD)), "empty": (spark.createDataFrame([], schema), 0)}


@pytest.mark.parametrize("which", ["odd", "empty"])
@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows(spark, which, name):
    docs, n = cases(spark)[which]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "same text here with a few more words to make a shingle"), (2, None), (3, "")], "item_id long, text string")
    run = {
        "op1": lambda: op1.jaccard_components(docs),
        "op2": lambda: op2.judge(docs, labels),
        "op3": lambda: op3.scan(docs),
        "op4": lambda: op4.assign_shards(docs),
        "op6": lambda: op6.mixture(docs),
        "op7": lambda: op7.remove_repeats(docs),
        "op8": lambda: op8.dedup_lines(docs),
        "op9": lambda: op9.flag_contaminated(docs, benchmark),
        "op10": lambda: op10.score(docs, op10.fit(docs, labels)),
    }[name]
    out = run().collect()
    assert len(out) == n
    if which == "odd" and name == "op1":
        assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    if which == "odd" and name == "op9":
        assert {r.doc_id for r in out if r.contaminated} >= {4, 5}


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "x"), (2, 0, "assistant", "z" * 200_000)]
    kind = "conv_id long, turn long, role string, text string"
    assert op5.format_preferences(op5.swapped_pairs(spark.createDataFrame(rows, kind))).count() == 2
    assert op5.format_preferences(op5.swapped_pairs(spark.createDataFrame([], kind))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(4)
    make = lambda: " ".join(f"{rng.choice('bcdfglmnprst')}{rng.randrange(10**5)}" for _ in range(60))
    rows = [(i, make() + (" vilewordx badwordy" * 3 if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(300)]
    item = make()
    rows += [(1000 + i, rows[1][1], "en", "s1", 0) for i in range(5)] + [(2000, make() + " " + item, "en", "s1", 0), (2001, None, None, None, None)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = [r.doc_id for r in docs.collect()]
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r[0] for r in rows if r[0] is not None and r[0] < 300 and r[0] % 5 == 0}
    assert len(toxic & set(seen["toxicity"])) <= 3 and len(set(range(300)) - toxic - set(seen["toxicity"])) <= 3
    assert len(seen["ngram_jaccard_join"]) == len(set(seen["ngram_jaccard_join"])) and not set(seen["ngram_jaccard_join"]) & set(range(1000, 1005))
    assert 2000 in seen["ngram_jaccard_join"] and 2000 not in seen["decontamination"]
    assert len(set(seen["decontamination"])) == len(seen["ngram_jaccard_join"]) - 1
    assert Counter(seen["sharding"]) == Counter(seen["mixing"])
    assert docs.columns[5:] == ["slot", "shard_no", "shard"]
    assert sorted(r.doc_id or 0 for r in p.run(spark, str(tmp_path)).collect()) == sorted(x or 0 for x in seen["sharding"])

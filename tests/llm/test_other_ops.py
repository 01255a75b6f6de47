"""Operators 2, 6, 7, 8 and the pipeline: plain versions and messy input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspan.llm import components, licence, linededup, mixing, neardup, tokencount

TOKEN = re.compile(r"[^\W_]+")


# --- 2 ----------------------------------------------------------------------------------------
def test_licence_families(spark):
    lines = [(k, t) for k, (f, t) in enumerate(licence.VARIANTS)]
    df = spark.createDataFrame([(k, f"Some first line.\n{t}.\nlast words") for k, t in lines], "doc_id int, text string")
    got = {r.doc_id: r.families for r in licence.report(df).collect()}
    right = sum(got[k] == licence.VARIANTS[k][0] for k, _ in lines)
    assert right >= 0.95 * len(lines), [(licence.VARIANTS[k], got[k]) for k, _ in lines if got[k] != licence.VARIANTS[k][0]]


def test_licence_unknown(spark):
    others = [(k, t) for k, t in enumerate(licence.OTHERS)] + [(100, "Licensed under the Moonlight License, version 7"), (101, "nothing at all"), (102, "mit freundlichen Grüßen")]
    got = {r.doc_id: r for r in licence.report(spark.createDataFrame(others, "doc_id int, text string")).collect()}
    assert all(r.families == "" for r in got.values())
    assert got[101].n_candidates == 0 and got[102].n_candidates == 0 and got[100].n_unknown == 1


@pytest.fixture(scope="module")
def trained():
    return licence.train()


def test_licence_calibration_is_measured_on_unseen_phrases(trained):
    model = licence.load_model()
    assert model["held_out_accuracy"] > 0.78 and abs(model["held_out_accuracy"] - trained["held_out_accuracy"]) < 0.02 and max(model["calibration_error"], trained["calibration_error"]) < 0.08
    seen = set(licence.PHRASES[0]) | set(licence.PHRASES[1])
    assert not seen & set(licence.PHRASES[2]) and not set(licence.HOUSE[0] + licence.HOUSE[1]) & set(licence.HOUSE[2]) and not set(licence.MENTIONS[0] + licence.MENTIONS[1]) & set(licence.MENTIONS[2])
    assert np.argmax(model["bias"]) == len(licence.FAMILIES) - 1
    assert set(model["by_class"]) == set(licence.FAMILIES) and min(x["found"] for x in model["by_class"].values()) > 0.6
    again = licence.measured(model)
    assert again["by_class"] == model["by_class"]


def test_licence_of_neighbours_and_mentions(spark):
    """Licences that share most of their words with another, notices of no known family, and prose that names licences."""
    cases = {
        "Eclipse Public License - v 2.0": "epl", "This work is licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa", "Licensed under CC BY-ND 4.0": "cc-by-nd", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by",
        "Creative Commons Attribution-NoDerivatives 4.0 International License": "cc-by-nd", "Lizenziert unter der MIT-Lizenz": "mit", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "Released under the GPL": "gpl",
        "Under no circumstances and under no legal theory, whether tort (including negligence), contract, or otherwise, shall any Contributor be liable to You": "mpl",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "?", "Licensed under the Moonlight License, version 7": "?",
        "The GNU project was begun in 1983 and the GPL was written for it by Richard Stallman.": "", "He compared the Apache helicopter with the BSD conference badge.": "", "She studied at MIT for years": "", "GPL": "?",
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: r for r in licence.report(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    told = {t: got[k].families or ("?" if got[k].n_unknown else "") for k, t in rows}
    assert told == cases


def plain_scan(text, model):
    """Candidates of one text: paragraph, probability, family, cover."""
    out = []
    for i, p in enumerate(re.split(licence.BREAK, text or "")):
        have = licence.grams(licence.tokens(p))
        z = np.sum([model["bias"], *(model["weights"][g] for g in have if g in model["weights"])], axis=0) / licence.SCALE
        e = np.exp(z - z.max())
        k = int(e.argmax())
        name = licence.FAMILIES[k]
        if name != licence.NONE:
            shares = [len(licence.template_grams(licence.tokens(t)) & have) / len(licence.template_grams(licence.tokens(t))) for f, t in licence.VARIANTS if f == name]
            cover = max(shares, default=0.0)
            q = float(e[k] / e.sum())
            out.append((i, round(q, 9), name if q >= licence.CERTAIN and cover >= licence.COVER else licence.UNKNOWN, round(cover, 9)))
    return out


def test_licence_against_the_plain_version(spark, docs):
    rng = np.random.Generator(np.random.PCG64(13))
    parts = [t for _, t in licence.VARIANTS] + licence.OTHERS
    made = []
    for _ in range(300):
        words = " ".join(rng.choice(parts, int(rng.integers(1, 5)))).split(" ")
        made.append("".join(w + str(rng.choice([" ", " ", " ", "\n", ".\n", "\n\n", ".\r\n", "\" \n", "\n \t\n"])) for w in words))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate([*parts, *made, "", None, "\n\n", "MIT License " * 4000, "İ LICENSE K GPL"])]
    model = licence.load_model()
    got: dict = defaultdict(list)
    for r in licence.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.id].append((r.paragraph, round(r.probability, 9), r.family, round(r.cover, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, t in rows if (w := plain_scan(t, model))}
    assert len(got) > 300


def test_licence_of_wrapped_and_partial_notices(spark):
    mit = licence.PARAGRAPHS["mit"]
    wrap = lambda t: re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n", t)
    rows = [
        (1, "Released under the MIT\nLicense"), (2, "\n\n".join(wrap(t) for t in mit)), (3, "This is free and unencumbered software released into the public domain"), (4, "Distributed under MIT terms"),
        (5, "All rights reserved."), (6, "Licensed under CC"), (7, "This work is licensed under a house agreement 4.0 International License"), (8, wrap(licence.PARAGRAPHS["bsd"][2])), (9, wrap(licence.PARAGRAPHS["apache"][1])),
    ]
    got = {r.doc_id: (r.n_licences, r.n_unknown, r.families) for r in licence.report(spark.createDataFrame(rows * 2, "doc_id int, text string")).collect()}
    assert got == {1: (1, 0, "mit"), 2: (3, 0, "mit"), 3: (1, 0, "unlicense"), 4: (1, 0, "mit"), 5: (0, 1, ""), 6: (0, 1, ""), 7: (0, 1, ""), 8: (1, 0, "bsd"), 9: (1, 0, "apache")}


def test_licence_copies_of_a_row(spark):
    rows = [(k, t) for k, (_, t) in enumerate(licence.VARIANTS)] + [(100, "Released under a license of the GNU kind"), (None, "Released under the GPL")]
    once, thrice = (sorted(map(str, map(tuple, licence.scan(spark.createDataFrame(rows * n, "doc_id int, text string")).collect()))) for n in (1, 3))
    assert once == thrice


def test_licence_messy(spark, messy):
    got = licence.report(messy).collect()
    assert len(got) == 11 and [r.families for r in got if r.doc_id == 7] == ["mit"]
    assert licence.report(messy.limit(0)).count() == 0


# --- 6 ----------------------------------------------------------------------------------------
def plain_tokens(word, scores):
    best = [(0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = max(((best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores and best[s] is not None), default=None)
    return -best[-1][1]


def test_shared_prefixes_give_plain_counts():
    rng = np.random.Generator(np.random.PCG64(1))
    scores = {b"a": -9, b"b": -8, b"c": -7, b"ab": -10, b"abc": -14, b"ca": -15, b"bca": -20, b"aa": -18}
    words = list({bytes(rng.choice(list(b"abc"), int(n)).tolist()) for n in rng.integers(1, 12, 300)})
    assert tokencount.counts_of(words, scores, 3) == {w: plain_tokens(w, scores) for w in words}


def test_token_counts(spark, docs):
    scores = tokencount.read_vocabulary()
    scores = {k: v for k, v in scores.items() if len(k) <= 32}
    some = docs.limit(20)
    got = {r.doc_id: r.n_tokens for r in tokencount.count(some).collect()}
    for r in some.collect():
        pre = tokencount.PRE_TOKEN.findall(r.text)
        assert "".join(pre) == r.text
        assert got[r.doc_id] == sum(n * plain_tokens(w.encode(), scores) for w, n in Counter(pre).items())


def test_token_counts_long_pieces(spark):
    scores = tokencount.read_vocabulary()
    long = sorted(w for w in scores if len(w) > 32)
    texts = ["-" * 64, "=" * 64, "a rule " + "_" * 70 + " and more", "-" * 48 + "\n" + "." * 130]
    texts += [t for t in (w.decode("utf-8", "replace") for w in long) if t.encode() in scores]
    got = {r.doc_id: r.n_tokens for r in tokencount.count(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert len(long) == 14 and got[0] == got[1] == 1
    assert got == {k: sum(plain_tokens(w.encode(), scores) for w in tokencount.PRE_TOKEN.findall(t)) for k, t in enumerate(texts)}


def test_token_counts_of_whole_texts(spark, docs):
    """Every document of the table, and texts of tens of thousands of characters, by the plain way."""
    scores = tokencount.read_vocabulary()
    long = max(map(len, scores))
    known: dict = {}

    def tokens(w):
        if w not in known:
            best = [(0, 0)] + [None] * len(w)
            for e in range(1, len(w) + 1):
                best[e] = max(((best[s][0] + scores[w[s:e]], best[s][1] - 1) for s in range(max(0, e - long), e) if w[s:e] in scores and best[s] is not None), default=None)
            known[w] = -best[-1][1]
        return known[w]

    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "x" * 20_000), (-2, "na" * 5_000 + " " * 3_000 + "\u00e9" * 2_000)]
    got = {r.doc_id: r.n_tokens for r in tokencount.count(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: sum(tokens(w.encode()) for w in tokencount.PRE_TOKEN.findall(t)) for k, t in rows}


def test_token_counts_messy_whole(spark, messy):
    got = {r.doc_id: r.n_tokens for r in tokencount.count(messy.filter("doc_id = 6 or text is null")).collect()}
    assert got[3] == got[None] == 0 and got[6] > 40_000


def test_token_counts_messy(spark, messy):
    small = messy.withColumn("text", F.substring("text", 1, 3000))
    got = tokencount.count(small).collect()
    assert len(got) == 11 and all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4))
    assert tokencount.count(messy.limit(0)).count() == 0


# --- 7 ----------------------------------------------------------------------------------------
def plain_join(rows):
    sets = {}
    for i, t in rows:
        w = TOKEN.findall(t.lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("", t)])
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    keys = list(classes)
    up, links = list(range(len(keys))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 5 * len(keys[a] & keys[b]) >= 4 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k, s in enumerate(keys):
        groups[root(k)] += classes[s]
    return {i: (min(groups[root(k)]), min(classes[s]), len(classes[s]), links[k]) for k, s in enumerate(keys) for i in classes[s]}


def near_rows(seed=1, groups=12, size=9):
    rng = np.random.Generator(np.random.PCG64(seed))
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choice(vocab, int(rng.integers(30, 160))).tolist()
        for _ in range(int(rng.integers(1, size))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("tile", [256, 3])
def test_join_against_all_pairs(spark, tile):
    rows = near_rows() + [(900, "one two"), (901, "One, two!"), (902, "?"), (903, "?"), (904, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in neardup.Join(df, tile=tile).report().collect()}
    assert got == plain_join(rows)


def test_join_recall_against_an_inverted_index(spark, data):
    """All links of 1000 documents and copies of them with some words changed, by an index from shingles to documents."""
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet").collect()]
    for k, t in rows[:400]:
        w = t.split()
        for n in range(2):
            changed = set(rng.choice(len(w), len(w) // int(rng.integers(50, 70)) + 1).tolist())
            rows.append((10_000 * (n + 1) + k, " ".join(f"new{i}" if i in changed else x for i, x in enumerate(w))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, index, both = {}, defaultdict(list), Counter()
    for r in docs.collect():
        w = TOKEN.findall(r.text.lower())
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
        if s and s not in sets:
            sets[s] = len(sets)
            for x in s:
                index[x].append(sets[s])
    size = [len(s) for s in sets]
    for held in index.values():
        both.update((a, b) for k, a in enumerate(held) for b in held[:k])
    want = sum(5 * n >= 4 * (size[a] + size[b] - n) for (a, b), n in both.items())
    join = neardup.Join(docs)
    got = sum(r.links for r in join.classes.select("links").collect()) / 2
    assert want > 50 and 0.999 * want <= got <= want
    assert join.recall >= neardup.TARGET_RECALL and join.depth >= neardup.prefix_depth(0.8, neardup.TARGET_RECALL)


def test_prefixes_are_shortened_as_far_as_the_links_ask_for(spark):
    base = [f"w{k}" for k in range(600)]
    near = lambda k, n: (k, " ".join(["x%d" % k, *base[:n], "y%d" % k]))
    alike = neardup.Join(spark.createDataFrame([near(k, 600) for k in range(20)], "doc_id int, text string"))
    assert (alike.depth, alike.report().agg(F.sum("n_links")).first()[0]) == (neardup.DEPTH, 20 * 19)
    at = neardup.Join(spark.createDataFrame([(k, f"{' '.join(base[:45])} " + " ".join(f"z{k}{j}" for j in range(4))) for k in range(60)], "doc_id int, text string"))
    assert at.depth < neardup.DEPTH and at.report().agg(F.sum("n_links")).first()[0] == 60 * 59
    assert neardup.Join(spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "doc_id int, text string")).recall == 0


def test_pairs_meet_once():
    rng = np.random.Generator(np.random.PCG64(7))
    marks = rng.integers(0, 2, (30, neardup.TREES, neardup.DEPTH)).astype(np.uint64)
    labels = np.zeros((30, neardup.TREES), dtype=np.uint64)
    for k in range(neardup.DEPTH):
        labels = (labels << np.uint64(neardup.LEVEL_BITS)) | marks[:, :, k]
    rows = [(k, 1, x.view(np.int64), b"\0" * 80) for k, x in enumerate(labels)]
    met = Counter()
    for depth in range(neardup.DEPTH, 0, -1):
        for tree in range(neardup.TREES):
            nodes = defaultdict(list)
            for r, x in zip(rows, labels, strict=True):
                nodes[int(x[tree]) >> (neardup.LEVEL_BITS * (neardup.DEPTH - depth))].append(r)
            for held in nodes.values():
                side = neardup._Side(held)
                met.update((int(side.c[i]), int(side.c[j])) for i, j in zip(*np.nonzero(neardup.pairs_that_meet(side, side, tree, depth, 4, 5)), strict=True))
    assert len(met) == 30 * 29 / 2 and set(met.values()) == {1}


def test_pairs_meet_once_over_wider_steps():
    """Rounds at 8, 5 and 1: all pairs of a round meet once, and those of the rounds before don't again."""
    rng = np.random.Generator(np.random.PCG64(17))
    marks = rng.integers(0, 2, (30, neardup.TREES, neardup.DEPTH)).astype(np.uint64)
    labels = np.zeros((30, neardup.TREES), dtype=np.uint64)
    for k in range(neardup.DEPTH):
        labels = (labels << np.uint64(neardup.LEVEL_BITS)) | marks[:, :, k]
    rows = [(k, 1, x.view(np.int64), b"\0" * 80) for k, x in enumerate(labels)]
    common = lambda i, j: max(next((d for d in range(neardup.DEPTH) if marks[i, t, d] != marks[j, t, d]), neardup.DEPTH) for t in range(neardup.TREES))
    done = neardup.DEPTH + 1
    for depth in (8, 5, 1):
        met = Counter()
        for tree in range(neardup.TREES):
            nodes = defaultdict(list)
            for r, x in zip(rows, labels, strict=True):
                nodes[int(x[tree]) >> (neardup.LEVEL_BITS * (neardup.DEPTH - depth))].append(r)
            for held in nodes.values():
                side = neardup._Side(held)
                met.update((int(side.c[i]), int(side.c[j])) for i, j in zip(*np.nonzero(neardup.pairs_that_meet(side, side, tree, depth, 4, 5, done)), strict=True))
        assert set(met) == {(i, j) for i in range(30) for j in range(i + 1, 30) if depth <= common(i, j) < done} and set(met.values()) <= {1}
        done = depth


def test_recall_that_shorter_prefixes_would_have():
    bands = [3, 0, 5] + [0] * (neardup.BANDS - 4) + [40]
    at = [neardup.estimated_recall(bands, 8, 0.8, at=r) for r in (8, 7, 6, 5)]
    assert at[0] == neardup.estimated_recall(bands, 8, 0.8) and at == sorted(at) and at[-1] > 0.9999
    assert neardup.estimated_recall([0] * neardup.BANDS, 8, 0.8, at=5) == 0


def test_shared_counts_both_ways():
    rng = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(rng.integers(0, 300, int(n)).astype(np.uint64)) for n in rng.integers(1, 120, 40)]
    side = neardup._Side([(k, 1, np.zeros(neardup.TREES, dtype=np.int64), s.tobytes()) for k, s in enumerate(sets)])
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    few = np.zeros((40, 40), dtype=bool)
    few[0, 5] = few[7, 9] = True
    every = ~np.eye(40, dtype=bool)
    assert (neardup.shared_counts(side, side, every)[every] == want[every]).all()
    assert (neardup.shared_counts(side, side, few)[few] == want[few]).all()


def test_depth():
    r = neardup.prefix_depth(0.8, neardup.TARGET_RECALL)
    assert 1 - (1 - 0.8**r) ** neardup.TREES >= neardup.TARGET_RECALL > 1 - (1 - 0.8 ** (r + 1)) ** neardup.TREES


def test_keep_one_and_messy(spark, messy):
    j = neardup.Join(messy)
    kept = j.keep_one()
    assert kept.columns == messy.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted([(False, k) for k in (1, 3, 4, 5, 6, 7, 8)] + [(True, 0)] * 2)
    assert j.report().count() == 11
    empty = neardup.Join(messy.limit(0))
    assert empty.report().count() == 0 and empty.keep_one().count() == 0


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    edges = [(k, k + 1) for k in range(100, 160)] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)] + [(5, 5)]
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in up} == {v: root(v) for v in up}


# --- 8 ----------------------------------------------------------------------------------------
def test_patience():
    assert linededup.align([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert linededup.align([], [1]) == [] and linededup.align([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(300):
        a, b = rng.integers(0, 12, 15).tolist(), rng.integers(0, 12, 15).tolist()
        got = linededup.align(a, b)
        assert all(a[x] == b[y] for x, y in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def plain_dedup(rows):
    strip = " \t\n\x0b\f\r"
    own, lines, out = {}, {}, {}
    for i, t in sorted(rows):
        ls = [x.strip(strip) for x in t.split("\n")]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls]
        lines[i] = ls
        firsts = {own.setdefault(x, i) for x, k in zip(ls, n, strict=True) if k >= linededup.ANCHOR_WORDS} - {i}
        gone = {p for f in firsts for p in linededup.deleted(lines[f], ls, n)}
        out[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def test_line_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in linededup.report(docs).collect()}
    assert got == plain_dedup(rows) and got != dict(rows)


def plain_whole(rows):
    """Aligned with every earlier document."""
    strip = " \t\n\x0b\f\r"
    before, out = [], {}
    for i, t in sorted(rows):
        ls = [x.strip(strip) for x in t.split("\n")]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls]
        gone = {p for f in before for p in linededup.deleted(f, ls, n)}
        before.append(ls)
        out[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def whole(df):
    return {r.doc_id: r.text for r in linededup.report(df, find=linededup.find_whole).collect()}


def test_line_dedup_with_all_holders(spark, docs):
    x, y, z = ("%s one two three four five six seven" % c for c in "xyz")
    rows = [(1, f"{x}\na\n{x}\n{y}"), (2, f"b\n{x}\nc"), (3, f"d\n{x}\ne"), (4, f"f\n{z}\nshort"), (5, f"{z}\nshort\n{y}"), (6, f"g\n{z}\nshort\nh\n{y}\n{x}"), (7, f"i\n{x}\nj\n{x}")]
    got = whole(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got == plain_whole(rows) and got[3] == "d\ne" and got[6] == "g\nh"
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = whole(docs)
    assert got == plain_whole(rows) and got != plain_dedup(rows)


def test_line_dedup_with_all_holders_random(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    parts = ["", "a", "b c", "d e f g", *(" ".join([c] * 8) for c in "pqrs")]
    rows = [(k, "\n".join(rng.choice(parts, int(n)))) for k, n in enumerate(rng.integers(1, 9, 150))]
    assert whole(spark.createDataFrame(rows, "doc_id int, text string")) == plain_whole(rows)


def pairs_of(df, monkeypatch):
    """Texts left, and how many pairs of documents were aligned."""
    made, stage = [], linededup.stage

    def counted(table, tag):
        out = stage(table, tag)
        made.append(out.count() if tag == "pairs" else 0)
        return out

    monkeypatch.setattr(linededup, "stage", counted)
    return whole(df), sum(made)


@pytest.mark.parametrize("ends", ["unequal", "some equal", "once"])
def test_line_dedup_of_headers_and_footers(spark, monkeypatch, ends):
    """A menu at the top and the bottom of every page, and nothing else in common: nothing is deleted, and pairs grow with the
    pages, not with their square. Where some pages have an end or a line in common, those are aligned."""
    menu = "home products about us contact imprint privacy search login"
    counts = []
    for n in (40, 80):
        first = lambda k: "same start" if ends == "some equal" and k % 10 == 3 else f"title {k}"  # noqa: E731, B023
        once = lambda k: f"\nonce {k // 4}\n{menu}" if ends == "once" and k < 12 else ""  # noqa: E731, B023
        rows = [(k, f"{first(k)}\n{menu}\nbody {k} a{once(k)}\nbody {k} b\n{menu}\nend {k}") for k in range(n)]
        got, pairs = pairs_of(spark.createDataFrame(rows, "doc_id int, text string"), monkeypatch)
        monkeypatch.undo()
        assert got == plain_whole(rows)
        counts.append(pairs)
    assert counts[1] < 3 * counts[0] and counts[1] < 80 * 16, counts


def test_line_dedup_with_many_holders_random(spark, monkeypatch):
    """As the random test above, with ties asked for from the second holder on."""
    monkeypatch.setattr(linededup, "TIED", 2)
    rng = np.random.Generator(np.random.PCG64(18))
    parts = ["", "a", "b c", "d e f g", *(" ".join([c] * 8) for c in "pqrs")]
    rows = [(k, "\n".join(rng.choice(parts, int(n)))) for k, n in enumerate(rng.integers(1, 9, 150))]
    rows += [(1000 + k, "\n".join(rng.choice(parts[4:] + [f"u{k}", f"v{k}"], 6))) for k in range(60)]
    assert whole(spark.createDataFrame(rows, "doc_id int, text string")) == plain_whole(rows)


def test_line_dedup_of_short_lines(spark):
    verse = "so much depends\nupon\n\na red wheel\nbarrow\nglazed with rain"
    rows = [(1, f"one\n{verse}\ntwo"), (2, f"three\n{verse}\nfour"), (3, "a red wheel\nbarrow\nonly"), (4, f"{verse}\n{verse}")]
    got = whole(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got == plain_whole(rows) and got[2] == "three\nfour" and got[3] == rows[2][1]


def test_line_dedup_with_all_holders_messy(spark, messy):
    rows = linededup.dedup(messy, find=linededup.find_whole).collect()
    assert len(rows) == 11 and [(r.text, r.n_deleted) for r in rows if r.doc_id == 2] == [("", 2)]
    assert all(r.n_deleted == 0 for r in rows if r.doc_id == 1) and all(r.text is None for r in rows if r.doc_id == 3)
    assert linededup.report(messy.limit(0), find=linededup.find_whole).count() == 0


def test_line_dedup_messy(spark, messy):
    got = linededup.dedup(messy)
    rows = got.collect()
    assert len(rows) == 11 and [(r.text, r.n_deleted) for r in rows if r.doc_id == 2] == [("", 2)]
    assert all(r.n_deleted == 0 for r in rows if r.doc_id == 1) and all(r.text is None for r in rows if r.doc_id == 3)
    assert linededup.report(messy.limit(0)).count() == 0


# --- the pipeline -----------------------------------------------------------------------------
def test_pipeline_stages_against_plain_versions(spark, data, docs):
    from test_contract_ops import plain_counts, plain_hits

    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

    good = stages["quality rules"](spark, docs, data)
    assert good.columns == docs.columns
    failed = {k for k, t in texts.items() if len(TOKEN.findall(t)) < 400 and (plain_counts(t)[0] < 50 or 2 * plain_counts(t)[4] > plain_counts(t)[0])}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert ids and not ids & failed

    one = stages["near duplicates"](spark, good, data)
    want = plain_join([(k, texts[k]) for k in ids])
    left = {r.doc_id for r in one.select("doc_id").collect()}
    assert one.columns == docs.columns and left == {v[0] for v in want.values()}

    clean = stages["decontamination"](spark, one, data)
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {k for k in left if not plain_hits(texts[k], items)[1]}

    mixed = stages["mixing"](spark, clean, data)
    taken = {r.doc_id: r.taken for r in mixing.mix_report(clean).collect()}
    words = Counter()
    for r in mixed.select("doc_id", "text").collect():
        words[r.doc_id] += len(r.text.split())
    assert mixed.columns == docs.columns and dict(words) == {k: v for k, v in taken.items() if v}

    done = stages["sharding"](spark, mixed, data).toPandas()
    assert len(done) == mixed.count() and set(docs.columns) < set(done.columns)
    assert sorted(done.shard.unique()) == list(range(40)) and all(sorted(x.slot) == list(range(len(x))) for _, x in done.groupby("shard"))


def test_pipeline_runs_through(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_messy(spark, messy, data, tmp_path):
    """What each stage makes of the messy table by itself; nothing of an empty one."""
    spark.createDataFrame([(1, "Sat on the MAT"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = {n: f(spark, messy, str(tmp_path)) for n, f in corpus_pipeline.STAGES}
    every = sorted((r.doc_id for r in messy.select("doc_id").collect()), key=str)
    ids = {n: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str) for n, df in stages.items()}
    assert ids["quality rules"] == []  # too short, or one word 40,000 times
    # Of three copies one stays; texts without words are copies only of the same text, a null text of none.
    assert ids["near duplicates"] == sorted([1, 3, None, None, 4, 5, 6, 7, 8], key=str)
    assert ids["decontamination"] == sorted([3, None, None, 4, 5, 6, 7, 8], key=str)
    assert set(ids["mixing"]) <= {1, 2, 6, 7, 8, None} and ids["mixing"]
    assert ids["sharding"] == every and all(df.columns == messy.columns for n, df in stages.items() if n != "sharding")
    slots = stages["sharding"].groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("k")).collect()
    assert all(r.n == r.k == r.top + 1 for r in slots)
    for n, f in corpus_pipeline.STAGES:
        assert f(spark, messy.limit(0), str(tmp_path)).count() == 0, n

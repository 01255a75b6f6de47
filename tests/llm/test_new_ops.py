"""Operators 11 to 13: plain versions, SQL, and messy input."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fieldspan.llm import fim, tokenalign

ODD = ["a  b\n\nc", " lead", "trail ", "trail\n", "\n", " ", "  ", "\t", "a\tb \t c", "x\r\ny;\r\nz", "it's we'll no　way", "▁mark", "a ▁b", "<|endoftext|> <s> </s> <0x0A>", "漢字かな交じり", "\U0001f600 \U0001f469‍\U0001f680", "a᠎ b", "a\x1c b\x0b\x0cc", "\x00 \x01", "é é", "1234567 8 90", "if (a) {\n    return b;\n}", " x y", "   indented", "word​word"]


# --- 12 ---------------------------------------------------------------------------------------
def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_is_the_plain_version(spark, docs):
    rng = random.Random(5)
    made = ["".join(rng.choice("<PSM> \né漢\U0001f600ab") for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate([*ODD, *made, "<P", "<S>", "a<M>b", "x" * 300_000])] + [(None, "no id"), (20, None), (20, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(str, map(tuple, fim.transform(df).collect())))
    assert got == sorted(str((k, *plain_fim(k, t))) for k, t in rows)
    back = fim.report(df).filter("restored_sha256 <> sha2(output_sha256, 256)").select("doc_id", "restored_sha256").collect()
    assert Counter(tuple(r) for r in back) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)


@pytest.mark.parametrize("unit, pattern", [("chars", r"(?s)."), ("words", r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*"), ("lines", r"[^\n]*\n|[^\n]+$")])
def test_cuts_between_units(unit, pattern):
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab \né漢") for _ in range(rng.randrange(1, 90)))
        if unit == "words":
            text = text.strip() or "a"
        units = re.findall(pattern, text)
        data = text.encode()
        assert fim.starts(data, unit).bit_count() == len(units)
        a, b = sorted((rng.randrange(len(units) + 1), rng.randrange(len(units) + 1)))
        assert [x.decode() for x in fim.cut(data, a, b, unit)] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]


def test_select_by_rank():
    rng = random.Random(7)
    for _ in range(200):
        width = rng.randrange(1, 700)
        mask = rng.getrandbits(width)
        where = [k for k in range(width) if mask >> k & 1]
        ranks = sorted(rng.sample(range(len(where)), min(len(where), 5)))
        assert fim.select(mask, width, ranks) == [where[r] for r in ranks]


def test_fim_messy(spark, messy):
    got = fim.report(messy).collect()
    assert len(got) == 11 and {r.form for r in got if r.n == 0} == {"plain"}
    assert fim.report(messy.limit(0)).count() == 0


# --- 13 ---------------------------------------------------------------------------------------
def plain_alignment(rows):
    """Whole texts through both tokenizers; links by comparing every pair's byte ranges group by group."""
    with open(tokenalign.TOKENIZER_A, "rb") as f, open(tokenalign.TOKENIZER_B, "rb") as g:
        pair = tokenalign.Pair(f.read(), g.read())
    done = []
    for key, text in rows:
        full = " " + (text or "")
        a, b = pair.a.encode(full, add_special_tokens=False).ids, pair.b.encode(text or "")
        if not text or any(b"".join(spelt[i] for i in ids) != full.encode() for ids, spelt in ((a, pair.a_bytes), (b, pair.b_bytes))):
            done.append((key, [], [], [], []))
            continue
        spans = []
        for ids, size in ((a, pair.a_size), (b, pair.b_size)):
            ends = [0]
            for i in ids:
                ends.append(ends[-1] + size[i])
            spans.append(list(zip(ends, ends[1:])))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, start, i, j = [], [], 0, 0, 0
        for end in common:
            own_a = [k for k in range(i, len(a)) if spans[0][k][1] <= end] if len(a) < 500 else [k for k in range(i, min(len(a), i + 200)) if spans[0][k][1] <= end]
            own_b = [k for k in range(j, len(b)) if spans[1][k][1] <= end] if len(b) < 500 else [k for k in range(j, min(len(b), j + 200)) if spans[1][k][1] <= end]
            groups.append(([a[k] for k in own_a], [b[k] for k in own_b]))
            links += [(a[x], b[y]) for x in own_a for y in own_b if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
            start, i, j = end, own_a[-1] + 1, own_b[-1] + 1
        done.append((key, a, b, groups, links))
    count = Counter(x for *_, links in done for x in links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for key, a, b, groups, links in done:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), text))
    return out


@pytest.fixture(scope="module")
def texts(docs):
    rng = random.Random(8)
    made = ["".join(rng.choice([*"ab .'<>0é漢", " ", " ", "\n", "\t", "\r", "the", " of", "▁", "  "]) for _ in range(rng.randrange(60))) for _ in range(500)]
    return [(r.doc_id, r.text) for r in docs.limit(120).collect()] + [(10_000 + k, t) for k, t in enumerate([*ODD, *made, "", "y" * 3000])] + [(None, "no id, twice")] * 2 + [(5000, None)]


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"hot": 40, "max_pairs": 0}, {"hot": 200}])
def test_alignment_is_that_of_whole_texts(spark, texts, options):
    got = tokenalign.align(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), **options).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignment(texts)))


def test_cuts_are_verified():
    with open(tokenalign.TOKENIZER_A, "rb") as f, open(tokenalign.TOKENIZER_B, "rb") as g:
        pair = tokenalign.Pair(f.read(), g.read())
    assert pair.cuts == " \n"
    assert pair.segments("a b\nc  d\te \nf") == ["a", "b", "\nc", "  d\te", " \nf"]
    assert pair._cuts(["x", "ab▁c"], {}) == "" and pair._cuts(["x", "}\n"], {}) == " " and pair._cuts(["▁▁", "▁\n"], {}) == " "


def test_alignment_messy(spark, messy):
    got = tokenalign.report(messy)
    rows = got.collect()
    assert len(rows) == 11 and all(r.groups_sha256 == "" for r in rows if r.n_a == 0) and sum(r.n_a == 0 for r in rows) == 3
    assert tokenalign.report(messy.limit(0)).count() == 0


# --- 11 ---------------------------------------------------------------------------------------
def plain_nearest(rows, every=20, k=20):
    """rows: distinct (id, vector as a tuple of doubles)."""
    import numpy as np

    own = {(i, v) for i, v in rows if v is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    sizes = Counter(len(v) for _, v in own)
    size = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    own = [r for r in own if len(r[1]) == size]
    x = np.array([v for _, v in own])
    out = []
    for at, (i, v) in enumerate(own):
        if i is not None and i % every == 0:
            s = (x * np.array(v)).sum(axis=1)
            best = sorted((-s[j], own[j][0] is None, own[j][0] or 0, j) for j in range(len(own)) if j != at)[:k]
            out += [(i, r + 1, own[j][0], float(-neg)) for r, (neg, _, _, j) in enumerate(best)]
    return out


def vector_rows(seed=9):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    few = rng.integers(-1, 2, (500, 8)).astype(float)  # many equal scores, repeated vectors, zeros
    rows = [(k, tuple(v)) for k, v in enumerate(few.tolist())]
    rows += [(1000 + k, (1.0,) * 8) for k in range(90)] + [(20, (1.0,) * 8), (20, (1.0,) * 8), (None, (1.0,) * 8), (None, (2.0,) * 8)]
    rows += [(2000, None), (2020, ()), (2040, (0.0,) * 8), (2060, (float("nan"),) * 8), (2080, (1.0, None) * 4), (2100, (float("inf"),) * 8), (2120, (1.0,) * 7), (2140, (-0.0, 0.5) * 4)]
    return rows


@pytest.mark.parametrize("tiles", [(4096, 1024), (16, 4)])
def test_nearest_of_all_parts_is_exact(spark, monkeypatch, tiles):
    from pyspark.sql import functions as F

    from fieldspan.llm import ann

    monkeypatch.setattr(ann, "TILE", tiles[0])
    monkeypatch.setattr(ann, "QUERY_TILE", tiles[1])
    rows = vector_rows()
    df = spark.createDataFrame(rows * 2, "vec_id bigint, embedding array<double>").withColumns({"v": F.lit("x"), "part": F.lit(1), "id": F.lit(None).cast("int"), "__v": F.lit(2)})
    got = ann.search(df, lambda c: F.pmod(c, F.lit(20)) == 0, parts=6, probes=6).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_nearest(rows)))


def test_few_rows_and_few_probes_still_fill_the_list(spark):
    from pyspark.sql import functions as F

    from fieldspan.llm import ann

    rows = vector_rows()
    some = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(some, lambda c: F.pmod(c, F.lit(20)) == 0, parts=40, probes=1).groupBy("query_id").count().collect()
    assert all(r["count"] >= 20 for r in got)
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = ann.report(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.5), (0, 2, 2, -1.0)]
    assert ann.report(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert ann.report(spark.createDataFrame([(20, None), (40, [0.0])], "vec_id bigint, embedding array<float>")).count() == 0


def test_recall_is_measured_and_held(spark):
    """Clusters of clusters: a few of the parts hold nearly all neighbours."""
    import numpy as np
    from pyspark.sql import functions as F

    from fieldspan.llm import ann

    rng = np.random.Generator(np.random.PCG64(3))
    at = rng.normal(size=(12, 24))[rng.integers(0, 12, 6000)] + 0.35 * rng.normal(size=(200, 24))[rng.integers(0, 200, 6000)] + 0.1 * rng.normal(size=(6000, 24))
    x = at / np.linalg.norm(at, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = ann.search(df, lambda c: F.pmod(c, F.lit(20)) == 0, parts=12).collect()
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -9
    true = {(20 * i, int(j)) for i, r in enumerate(np.argsort(-s, axis=1)[:, :20]) for j in r}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.93 * len(true)
    model = ann.fit(x[:3000], 12)
    counts = np.bincount(ann.scores(model, x).argmax(axis=1), minlength=12)
    assert counts.min() > 0 and counts.max() < 2.5 * 500
    near = ann.neighbours(x[:3000], 16)
    label = ann.balanced_parts(x[:3000], near, 12)
    assert np.ptp(np.bincount(label)) <= 12 and (label[near] == label[:, None]).mean() > 0.7

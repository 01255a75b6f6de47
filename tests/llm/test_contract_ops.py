"""Operators 1, 3, 4, 5, 9, 10: plain versions, SQL, and messy input."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.llm import decontaminate, mixing, pii, quality, queries, sharding, warc
from fieldspan.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{data}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, data, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})")
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


# --- 1 ----------------------------------------------------------------------------------------
def test_reshard_law_and_rows(spark, data):
    df = queries.op1_reshard(spark, data)
    got = df.toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    want = {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.itertuples()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == want
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    sums = got.groupby("shard")["size"].sum()
    assert set(sums.index) <= set(range(40))
    assert sums.max() - sums.min() <= got["size"].max()


def test_flow_is_least(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(30):
        n, m = rng.integers(1, 6, 2)
        supply = rng.integers(0, 50, n).tolist()
        room = sharding.levelled([0] * m, sum(supply))
        flow = sharding.min_cost_flow(supply, room, lambda i, j: 0.0 if i == j else 1.0)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        stay = sum(v for (i, j), v in flow.items() if i == j)
        assert stay == sum(min(s, r) for s, r in zip(supply, room, strict=False))


def test_flow_goes_back_over_costs():
    flow = sharding.min_cost_flow([1, 1], [1, 1], lambda i, j: [[1.0, 2.0], [1.0, 5.0]][i][j])
    assert flow == {(0, 1): 1, (1, 0): 1}


def test_transfers_move_as_little_as_the_flow_over_all_pairs():
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(200):
        n, m = rng.integers(1, 7, 2)
        supply, olds = rng.integers(0, 50, n).tolist(), sorted(rng.choice(9, n, replace=False).tolist())
        room = sharding.levelled([0] * m, sum(supply))
        moves = sharding.transfers(olds, supply, room)
        plain = sharding.min_cost_flow(supply, room, lambda i, j: 0.0 if olds[i] == j else 1.0)
        assert [sum(v for (o, _), v in moves.items() if o == k) for k in olds] == supply
        assert all(sum(v for (_, j), v in moves.items() if j == k) <= room[k] for k in range(m))
        assert sum(v for (o, j), v in moves.items() if o != j) == sum(v for (i, j), v in plain.items() if olds[i] != j)
    supply = rng.integers(1, 10**9, 5000).tolist()
    room = sharding.levelled([0] * 6000, sum(supply))
    moves = sharding.transfers(list(range(5000)), supply, room)
    assert sum(v for (o, j), v in moves.items() if o == j) == sum(map(min, supply, room)) and len(moves) < 3 * 6000


def test_flow_without_room():
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], lambda i, j: 1.0)


def test_rewrite_touches_changed_shards_only(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 4).alias("old"))
    got = sharding.reshard(df.filter("not (old = 3 and doc_id < 2000)"), F.col("old"), n_new=4, n_blocks=64)
    known = sharding.rewrite(got, str(tmp_path / "out"))
    assert 3 in known
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == got.filter(F.col("shard").isin(known)).count()


def test_rewrite_of_a_layout_that_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") + 1000).alias("text"))
    first = sharding.reshard(df, F.lit(0), n_new=6, n_blocks=64)
    sharding.rewrite(first, path, every=True)
    files = lambda: {k: sorted(p.name for p in (tmp_path / "out" / f"shard={k}").glob("*.parquet")) for k in range(6)}
    before = files()
    # Shards 4 and 5 are closed: their rows go to the others, and no files of theirs stay.
    there = spark.read.parquet(path)
    sharding.rewrite(sharding.reshard(there, F.col("shard"), n_new=4, n_blocks=64), path)
    back = spark.read.parquet(path)
    assert sorted(r.doc_id for r in back.select("doc_id").collect()) == list(range(6000))
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3} and before[4] and not files()[4]
    # Rows move between shards 0 and 1 alone: 2 and 3 keep their files and rows.
    before = files()
    part = spark.read.parquet(path).withColumn("old_shard", F.col("shard")).withColumn("shard", F.when((F.col("shard") == 0) & (F.col("doc_id") % 2 == 0), 1).otherwise(F.col("shard"))).withColumn("moved", F.col("shard") != F.col("old_shard"))
    want = {r.doc_id: r.shard for r in part.collect()}
    assert sharding.rewrite(part, path) == [0, 1]
    after = files()
    assert {r.doc_id: r.shard for r in spark.read.parquet(path).collect()} == want
    assert before[2] == after[2] and before[3] == after[3] and before[0] != after[0] and before[1] != after[1]


def test_rewrite_is_finished_after_a_crash(spark, tmp_path, monkeypatch):
    """Broken off before or after any of its renames, a rewrite leaves all rows to be found, in the old layout or in the new."""
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") + 1000).alias("text"))
    rename = sharding._rename
    for after in (False, True):
        for k in range(20):
            path = str(tmp_path / f"out-{after}-{k}")
            sharding.rewrite(sharding.reshard(df, F.lit(0), n_new=3, n_blocks=16), path, every=True)
            before = {r.doc_id: r.shard for r in sharding.read(spark, path).collect()}
            got = sharding.reshard(sharding.read(spark, path), F.col("shard"), n_new=2, n_blocks=16)
            want = {r.doc_id: r.shard for r in got.collect()}
            left = [k]

            def broken(fs, at, a, b):
                if not left[0] and not after:  # noqa: B023
                    raise OSError("crash")
                rename(fs, at, a, b)
                if not left[0]:  # noqa: B023
                    raise OSError("crash")
                left[0] -= 1  # noqa: B023

            monkeypatch.setattr(sharding, "_rename", broken)
            try:
                sharding.rewrite(got, path)
            except OSError:
                monkeypatch.setattr(sharding, "_rename", rename)
                told = sharding.recover(spark, path)
                found = {r.doc_id: r.shard for r in sharding.read(spark, path).collect()}
                assert found == (want if told else before) and told == (k > 0 or after)
                assert not sharding.recover(spark, path)
                if not told:
                    sharding.rewrite(sharding.reshard(sharding.read(spark, path), F.col("shard"), n_new=2, n_blocks=16), path)
            else:
                monkeypatch.setattr(sharding, "_rename", rename)
                break
            assert {r.doc_id: r.shard for r in spark.read.parquet(path).collect()} == want
            assert sorted(p.name for p in (tmp_path / f"out-{after}-{k}").iterdir() if p.is_dir()) == ["shard=0", "shard=1"]
        assert 2 < k < 19


def test_what_moves_is_near_the_least(spark, docs):
    """The query's plan moves few more bytes than the sizes ask for: what old shards have above their new size."""
    got = sharding.reshard(docs, sharding.hashed(F.col("source")))
    rows = got.select("size", "old_shard", "shard", "moved").collect()
    old, new = Counter(), Counter()
    for r in rows:
        old[r.old_shard] += r.size
        new[r.shard] += r.size
    least = sum(max(0, n - new[s]) for s, n in old.items())
    assert least <= sum(r.size for r in rows if r.moved) <= 1.1 * least + 40 * max(r.size for r in rows) / 64


def test_reshard_messy(spark, messy):
    back = sharding.reshard(messy, sharding.hashed(F.col("source")))
    assert sorted(str(r[c]) for r in back.collect() for c in ("doc_id", "text", "__id", "__block")) == sorted(str(r[c]) for r in messy.collect() for c in ("doc_id", "text", "__id", "__block"))
    got = sharding.reshard(messy, sharding.hashed(F.col("source"))).toPandas()
    assert len(got) == 11 and sorted(got["size"])[:2] == [16, 16]
    assert sharding.reshard(messy.limit(0), F.lit(0)).count() == 0


# --- 3 ----------------------------------------------------------------------------------------
def plain_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = split(text), set(), set()
    for ident, item in items:
        iw = split(item)
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1) if n else ():
            if tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(ident))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_random(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    vocab = ["a", "B", "c9", "É", "d"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(int(n))) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 25, 25])] + [(77, None), (5, text(12))]
    docs = [(k, text(int(rng.integers(0, 60))) + "; " + (items[int(rng.integers(0, 10))][1]) + " " + text(5)) for k in range(120)]
    items = items[2:]
    d = spark.createDataFrame([*docs, docs[0], (200, None)], "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    for limit in (1_000_000, 0):  # broadcast and shuffled
        decontaminate.BROADCAST_WORDS = limit
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(d, b).collect())
        assert got == sorted((k, *plain_hits(t, items)) for k, t in [*docs, docs[0], (200, None)])
    decontaminate.BROADCAST_WORDS = 1_000_000


def test_decontamination_with_many_items_of_which_few_are_short(spark):
    """Short items are broadcast, the others' fingerprints shuffled."""
    rng = np.random.Generator(np.random.PCG64(9))
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "d"], n))
    items = [(k, text(int(n))) for k, n in enumerate([2, 3, 9, 10, 14, 30, 30])]
    docs = [(k, text(int(rng.integers(0, 40))) + " " + items[int(rng.integers(0, 7))][1]) for k in range(60)] + [(60, None), (61, "")]
    d, b = spark.createDataFrame([*docs, docs[3]], "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    decontaminate.BROADCAST_WORDS, before = 20, decontaminate.BROADCAST_WORDS
    try:
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(d, b).collect())
    finally:
        decontaminate.BROADCAST_WORDS = before
    assert got == sorted((k, *plain_hits(t, items)) for k, t in [*docs, docs[3]]) and any(r[2] for r in got)


def test_decontamination_is_the_same_by_broadcast_and_by_shuffle(spark, data, messy):
    """The whole tables, and rows with null ids and texts and rows alike."""
    d, b = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "benchmark"))
    rows = lambda d, b: sorted(map(str, map(tuple, decontaminate.report(d, b).collect())))
    some = spark.createDataFrame([(1, "cat sat on"), (2, None), (None, "on the mat"), (3, " ".join(["and a long item"] * 5))], "item_id int, text string")
    messy = messy.unionByName(messy).select("doc_id", "text").unionByName(spark.createDataFrame([(None, " ".join(["and a long item"] * 4))], "doc_id int, text string"))
    want = rows(d, b), rows(messy, some)
    before, decontaminate.BROADCAST_WORDS = decontaminate.BROADCAST_WORDS, 0
    try:
        assert (rows(d, b), rows(messy, some)) == want
    finally:
        decontaminate.BROADCAST_WORDS = before


def test_decontamination_of_a_shared_preamble(spark, monkeypatch):
    """Items that begin alike share the index's rows, and a document with the preamble has them all."""
    start = " ".join(f"pre{k}" for k in range(60))
    items = [(f"i{k}", f"{start} own{k} " + " ".join(f"w{k}x{j}" for j in range(15))) for k in range(200)]
    b = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.benchmark_index(b)
    assert index.agg(F.max(F.size("ids"))).first()[0] == 200 and index.count() < 200 * 16
    d = spark.createDataFrame([(1, f"x {start} y"), (2, items[3][1]), (3, "nothing of it")], "doc_id int, text string")
    want = [(1, 62, 60, 200, True), (2, 76, 76, 200, True), (3, 3, 0, 0, False)]
    for bound in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", bound)
        got = decontaminate.report(d, b).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
        assert sorted(map(tuple, got)) == want


def test_decontamination_messy(spark, messy):
    b = spark.createDataFrame([(1, "cat sat on"), (2, None), (None, "on the mat")], "item_id int, text string")
    got = decontaminate.report(messy, b).collect()
    assert len(got) == 11 and sum(r.contaminated for r in got) == 3
    assert decontaminate.report(messy.limit(0), b).count() == 0
    assert decontaminate.report(messy, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(messy, b).columns == messy.columns and decontaminate.drop_contaminated(messy, b).count() == 8


# --- 4 ----------------------------------------------------------------------------------------
def pages(spark):
    big = "é" * 700_000
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (4, "u4", ""), (5, "u5", big), (6, "u\r\nX: y", big), (None, "u", "same"), (7, "u", "one"), (7, "u", "one")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark):
    archives = warc.write(pages(spark), new_path(spark, "warc"))
    chunks = warc.read(archives)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(chunks).collect())
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    big = "é" * 700_000
    assert got == sorted([(1, 4, b32("same"), "response", None), (3, 4, b32("same"), "revisit", 1), (0, 4, b32("same"), "revisit", 1), (2, 0, b32(""), "response", None), (4, 0, b32(""), "revisit", 2), (5, 1_400_000, b32(big), "response", None), (6, 1_400_000, b32(big), "revisit", 5), (7, 3, b32("one"), "response", None), (7, 3, b32("one"), "response", None)], key=lambda x: (x[0], x[1]))
    five = sorted((r.chunk_no, bytes(r.data), r.bytes_so_far) for r in chunks.filter("page_id = 5").collect())
    assert b"".join(d for _, d, _ in five).decode() == big and len(five) == 6 and all(len(d) <= warc.CHUNK for _, d, _ in five)
    assert warc.read(warc.write(pages(spark).limit(0), new_path(spark, "warc"))).count() == 0


def test_warc_standard_form_and_damage(spark, tmp_path):
    import gzip

    path = [r.archive for r in warc.write(pages(spark).coalesce(1), f"file://{tmp_path}/w").collect()]
    raw = b"".join(gzip.open(p.removeprefix("file://")).read() for p in path)
    assert raw.count(b"WARC/1.1\r\n") == 9 and b"\r\nX: y" not in raw
    whole = open(path[0].removeprefix("file://"), "rb").read()
    (tmp_path / "cut.warc.gz").write_bytes(whole[: len(whole) - 40])
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(f"file://{tmp_path}/cut.warc.gz"))


def test_warc_messy(spark, messy, tmp_path):
    """Nulls, clashing columns, repeated rows, very long payloads; equal payloads revisit the least id's record."""
    path = str(tmp_path / "warc")
    got = warc.report(warc.read(warc.write(messy, path, id_col="doc_id", payload_col="text"))).collect()
    assert len(got) == 11 and sorted(((r.page_id, r.refers_to) for r in got if r.record_type == "revisit"), key=str) == [(2, 1), (4, 3), (None, 3)]
    long = messy.filter("doc_id = 6").first().text.encode()
    assert [(r.payload_bytes, r.payload_digest) for r in got if r.page_id == 6] == [(len(long), base64.b32encode(hashlib.sha1(long).digest()).decode())]
    assert all(r.payload_bytes == 0 for r in got if r.page_id in (3, 4))
    assert warc.read(warc.write(messy.limit(0), str(tmp_path / "none"), id_col="doc_id", payload_col="text")).count() == 0
    with pytest.raises(ValueError):
        warc.write(messy, path, id_col="source", payload_col="text")


# --- 5 ----------------------------------------------------------------------------------------
def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 500 else {wins[0]}
    cov = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality_random(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    texts = ["".join(rng.choice(["the ", "a ", "ü# ", "\n", "a b c ", "x|y\x0b", " "], int(n))) for n in rng.integers(0, 80, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in quality.report(df).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_quality_keeps_good_prose(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    r = quality.report(docs).join(labels, "doc_id").filter("not base_failed")
    assert r.filter("quality = 1 and not kept").count() == 0
    assert r.filter("quality = 0 and kept").count() == 0


def test_quality_messy(spark, messy):
    got = {r.doc_id: r for r in quality.report(messy.filter("doc_id is not null")).collect()}
    assert got[3].n_words == 0 and got[4].base_failed and got[6].n_words == 40_001 and got[6].n_repeat_words == 40_000
    assert quality.keep_good(messy).columns == messy.columns and quality.report(messy.limit(0)).count() == 0


# --- 9 ----------------------------------------------------------------------------------------
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            s = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and s % 10 == 0, "phone": 10 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_random():
    rng = np.random.Generator(np.random.PCG64(3))
    parts = ["a.b", "@", "x-y", ".com", " ", "1", "255.", "256.", "0.0", "4111 1111 1111 1111", "+1 (938) 555-1226", "-", "+", "%", "é", "\n", "00"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, int(rng.integers(1, 25))))
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_links_reach_repeats():
    w = pii.load_weights()
    t = "Call +1 (938) 555-1226 now. " + "filler words here. " * 50 + "Later 9385551226 or 555-1226, order 1234567 of 2024."
    got = [(pii.KINDS[k], t[s:e]) for s, k, e in pii.added_spans(t, pii.base_spans(t), w)]
    assert got == [("phone", "9385551226"), ("phone", "555-1226")]
    assert pii.added_spans("order 1234567 and 9385551226 of 2024", [], w) == []


def test_pii_passing_is_exact_on_trees():
    rng = np.random.Generator(np.random.PCG64(6))
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(1, 3, 3))
    pair = pair + pair.transpose(0, 2, 1)
    links = [(0, 1, 0), (1, 2, 0), (1, 3, 0)]
    p = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        s = np.exp(sum(unary[k, y[k]] for k in range(4)) + sum(pair[0, y[u], y[v]] for u, v, _ in links))
        for k in range(4):
            p[k, y[k]] += s
    assert np.allclose(pii.beliefs(unary, links, pair, rounds=60), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def test_pii_passing_is_near_exact_on_loops():
    """Marginals of small graphs with loops, by adding up every labelling."""
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(10):
        unary, pair = rng.normal(size=(5, 3)), 0.4 * rng.normal(size=(2, 3, 3))
        pair = pair + pair.transpose(0, 2, 1)
        links = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (0, 3, 1), (1, 4, 1)]
        p = np.zeros((5, 3))
        for y in np.ndindex(*[3] * 5):
            s = np.exp(sum(unary[k, y[k]] for k in range(5)) + sum(pair[kind, y[u], y[v]] for u, v, kind in links))
            for k in range(5):
                p[k, y[k]] += s
        assert np.abs(pii.beliefs(unary, links, pair, rounds=60) - p / p.sum(axis=1, keepdims=True)).max() < 0.06


def test_pii_long_texts_take_linear_time():
    import time

    name = lambda k: "user." + "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    mail = "\n".join(f"{name(k)}@host{k}.example.com wrote as {name(k)}" for k in range(20_000))
    texts = ["1" * 1_000_000, "1." * 500_000, "+1 " * 300_000, "a" * 1_000_000 + "@", "a@" + "b" * 1_000_000, "+1" + "(" * 1_000_000, mail]
    weights, began = pii.load_weights(), time.process_time()
    spans = [pii.base_spans(t) for t in texts]
    added = [pii.added_spans(t, b, weights) for t, b in zip(texts, spans, strict=True)]
    assert time.process_time() - began < 30
    assert len(spans[6]) == 20_000 and len(spans[1]) == 125_000 and not any(spans[0] + spans[3] + spans[4] + spans[5])
    assert len(added[6]) > 19_000


def test_pii_recall_of_planted_repeats(docs):
    """Later mentions of what the base finds, in other forms; and numbers that are no one's."""
    weights, rng = pii.load_weights(), np.random.Generator(np.random.PCG64(12))
    found = planted = wrong = clean = 0
    for r in docs.collect():
        base = pii.base_spans(r.text)
        if base:
            again, label = pii._mentioned_again(r.text, base, rng)
            text = f"{r.text}\n{again}"
            own = pii.base_spans(text)
            if any(e > len(r.text) for _, _, e in own) or len(again) < 5:
                continue  # the base finds it by itself, or it is too short for a name
            added = pii.added_spans(text, own, weights)
            planted += 1
            found += any(s > len(r.text) and k + 1 == label for s, k, _ in added)
        else:
            clean += 1
            wrong += len(pii.added_spans(f"{r.text}\nIn 1984 order 7654321 of item 90210 came to 4432507379035541.", pii.base_spans(r.text), weights))
    assert planted >= 5 and found >= 0.8 * planted and clean > 50 and wrong == 0, (found, planted, wrong, clean)


def test_pii_training_learns_consistency(docs):
    texts = [r.text for r in docs.filter(F.col("text").rlike("[0-9]{4}|@")).select("text").collect()]
    w = pii.train(texts)
    assert (np.diag(w["pair"][1])[1:] > 0).all()


def test_pii_messy(spark, messy):
    got = pii.find(messy)
    assert got.count() == 11 and pii.find(messy.limit(0)).count() == 0
    r = got.filter("doc_id = 7").first()
    t = messy.filter("doc_id = 7").first().text
    assert (r.n_email, r.n_phone) == (1, 1) and pii.redact(t, r.spans).startswith("é ü mail [email] and [phone]")


# --- 10 ---------------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 8, 1000, 4097):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit((n - 1).bit_length()), F.xxhash64(F.lit(9))).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shard_counts():
    c = mixing.shard_counts([500, 30, 1], 8, 3)
    assert c.sum(axis=0).tolist() == [500, 30, 1] and set(c.sum(axis=1)) <= {66, 67}
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 7, 10_000):  # as many sources as there may be
        slots = rng.integers(0, 500, n).tolist()
        c = mixing.shard_counts(slots, 64, 3)
        assert (c >= 0).all() and c.sum(axis=0).tolist() == slots and np.ptp(c.sum(axis=1)) <= 1


def test_mix(spark, data, docs):
    got = mixing.mix_report(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    src = docs.select("doc_id", "source").toPandas()
    per = got.merge(src, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken - per.target) <= 1.5 * mixing.BLOCK_WORDS).all()
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mix_texts_are_what_was_taken(spark, docs):
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    out, whole = mixing.mix_documents(docs), {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        w = WORD.findall(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(w)
        assert r.n_chars == len(r.text) and (r.text == whole[r.doc_id] or set(w) <= set(WORD.findall(whole[r.doc_id])))
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_keeps_white_space(spark, docs):
    whole = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = [(r.doc_id, r.text) for r in mixing.mix_documents(docs).collect()]
    cut = [(k, t) for k, t in out if t != whole[k]]
    lines = lambda t: {WORD.sub("w", x) and x for x in t.split("\n")}
    assert len(cut) > 20 and any("\n" in t for _, t in cut)
    # Every line but the first and last of a stretch is a line of the text, as it stands there.
    assert all(len(lines(t) - lines(whole[k])) <= 2 * (1 + len(WORD.findall(t)) // mixing.BLOCK_WORDS) for k, t in cut)


def test_pick(spark):
    text = "  one two\n\nthree\tfour\n five six "
    part = "array<struct<from:bigint,length:bigint>>"
    got = lambda *p: spark.range(1).select(mixing.pick(F.lit(text), F.from_json(F.lit(str([{"from": a, "length": n} for a, n in p]).replace("'", '"')), part))).first()[0]
    assert got((0, 3)) == "one two\n\nthree" and got((1, 1), (2, 2)) == "two\n\nthree\tfour"
    assert got((0, 1), (3, 3)) == "one\nfour\n five six" and got((5, 1)) == "six"


def test_mix_of_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 1500).cast("string").alias("source"))
    got = mixing.mix_report(df).agg(F.sum("taken"), F.sum("size"), F.countDistinct("target")).first()
    assert got[1] == 12000 and got[2] == 3 and got[0] > 0
    mixing.MAX_SOURCES, before = 100, mixing.MAX_SOURCES
    try:
        with pytest.raises(ValueError):
            mixing.mix_report(df)
    finally:
        mixing.MAX_SOURCES = before


def test_mix_messy(spark, messy):
    got = mixing.mix_report(messy).collect()
    assert len(got) == 11 and all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got if r.doc_id in (3, 4, 5)) == 0
    assert mixing.mix_report(messy.limit(0)).count() == 0
    assert mixing.mix_documents(messy).columns == messy.columns and mixing.mix_documents(messy.limit(0)).count() == 0

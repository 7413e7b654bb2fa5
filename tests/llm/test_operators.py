"""Operators of the llm subpackage against brute force, exact round trips, held-out labels and odd inputs."""

import hashlib
import math
import os
import random
import re
import struct
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bidlens.llm.queries")
from bidlens.llm import avi, bpe, decontamination, html_text, jpeg, language_id, licences, ngram_join, queries, toxicity, url_rules, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t", "de", "s", 5), (4, "word", "en", "s", 4), (5, "word", "en", "s", 4), (5, "word", "en", "s", 4), (None, "some more words here now", "fr", None, 9), (6, "été " * 50_000, "fr", "s", 200_000), (7, "12 34 !!", "en", "s", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"n_chars": "Score"}).withColumn("hashes", F.lit(1))


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_join_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_ngram_jaccard(spark, SF).collect()}
    assert got == brute_components(rows)


def test_join_of_a_large_group(spark, monkeypatch):
    """Near copies around the threshold, so frequent that they go through the blocked product, in small blocks."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "SIDE", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:30])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_join_of_subsets(spark):
    """Pairs where one set lies in the other, cut from every side: the least overlap of first n-grams."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        w = [f"v{k}_{i}" for i in range(rng.randrange(20, 200))]
        cut = (len(w) - 4) // 5
        a = rng.randrange(cut + 1)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[a : len(w) - (cut - a) + rng.randrange(2)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    want = brute_components(rows)
    assert got == want and 20 < sum(i != c for i, (_, c) in want.items())


def test_join_beyond_the_pairs_formed_first(spark):
    """Two documents tied only by frequent n-grams, where every pair formed before the blocked product fails its bound."""
    p = [f"p{i}" for i in range(104)]
    rows = [(1, " ".join(p)), (2, " ".join(p + [f"b{i}" for i in range(20)]))]
    rows += [(10 + k, " ".join(p[k % 8 : k % 8 + 97] + [f"x{k}_{i}" for i in range(17)])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: (100, 1), 2: (120, 1)} | {i: (110, i) for i, _ in rows[2:]}


def jobs_of(spark, f):
    """The jobs that f starts, and the bytes that their stages write to shuffles."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    stages = {x for j in jobs for x in sc.statusTracker().getJobInfo(j).stageIds}
    return len(jobs), sum(sc._jsc.sc().statusStore().lastStageAttempt(x).shuffleWriteBytes() for x in stages)


def packed_blocks(blocks: int, nodes: int, each: int) -> list[pa.RecordBatch]:
    """Rows as ``incidence`` makes them: in each of the blocks ``nodes`` nodes of ``each`` entries; neighbours share one."""
    rows = []
    for b in range(blocks):
        keys = (np.arange(nodes * each, dtype=np.uint64) + np.uint64(b << 32)).reshape(nodes, each)
        keys[1::2, 0] = keys[::2, 0]
        sig, n, hot = np.arange(nodes, dtype=np.uint64), np.full(nodes, 5 * each, np.uint32), np.zeros(nodes, np.uint32)
        rows.append((b, sig.tobytes(), n.tobytes(), hot.tobytes(), np.full(nodes, each, np.uint32).tobytes(), keys.tobytes()))
    # rows of a block come in several batches, between those of others
    half = lambda r, x: (r[0], *(v[: len(v) // 2] if x == 0 else v[len(v) // 2 :] for v in r[1:]))
    kinds, names = [pa.int32(), *[pa.binary()] * 5], ["block", "sig", "n", "hot", "per", "entries"]
    return [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(half(r, x), kinds, strict=True)], names=names) for x in (0, 1) for r in rows]


def test_blocks_of_a_task_are_unpacked_one_at_a_time():
    class Blocks:
        def mapInArrow(self, run, schema):
            return run

    peaks = []
    for blocks in (1, 8):
        batches = packed_blocks(blocks, 2000, 50)
        tracemalloc.start()
        got = [tuple(r.values()) for b in ngram_join.pair_counts(Blocks())(iter(batches)) for r in b.to_pylist()]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        counts = {}
        for a, b, *_, c, f in got:
            counts[a, b] = counts.get((a, b), 0) + c + f
        assert counts == {(i, i + 1): blocks for i in range(0, 2000, 2)}
    # the other seven blocks wait as they came
    waiting = 7 * sum(c.nbytes for b in packed_blocks(1, 2000, 50) for c in b.columns)
    assert peaks[1] < peaks[0] + 2 * waiting, peaks


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_in_a_task_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "EDGES", most)
    rng = random.Random(3)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    edges = [(names[k], names[k + 1]) for k in range(100)] + [(names[100], x) for x in names[101:150]] + [tuple(rng.sample(names[150:], 2)) for _ in range(70)]
    edges += [(b, a) for a, b in edges[:30]] + [(names[160], names[160])]
    near = {}
    for a, b in edges:
        both = near.get(a, {a}) | near.get(b, {b})
        near |= dict.fromkeys(both, both)
    rows = spark.createDataFrame(rng.sample(edges, len(edges)), "a long, b long").repartition(5)
    want = {x: min(own) for x, own in near.items() if len(own) > 1}
    assert {r["sig"]: r["comp"] for r in ngram_join.components(rows).collect()} == want
    assert ngram_join.components(rows.limit(0)).count() == 0


def test_join_takes_few_jobs(spark):
    """Their number doesn't follow the number of partitions: the driver keeps plans and tasks of each."""
    wide = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in wide}
    try:
        for key, value in wide.items():
            spark.conf.set(key, value)
        jobs, _ = jobs_of(spark, lambda: queries.op8_ngram_jaccard(spark, SF))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert 0 < jobs < 90


def test_join_of_odd_rows(spark, odd):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_shingles"], by[2]["component_id"], by[3]["n_shingles"], by[5]["component_id"]) == (0, 2, 0, 4)
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


def test_bpe_against_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.BPE_FILE)
    v = bpe.Vocabulary(queries.BPE_FILE)
    rng = random.Random(1)
    texts = ["", "aaaa" * 500, "<|endoftext|>a <|endoftext|>", "²½ Ⅻ", "\x1c\x1d a\x1f", "it's we'll I'D", "😀👍🏽", "नमस्ते", " " * 50] + ["".join(rng.choice(" \n\tabcé'_1²Ⅻ.!́\x1d日😀٣sdtLl") for _ in range(60)) for _ in range(200)]
    for text, mine, theirs in zip(texts, v.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine, "<u4").tolist() == theirs.ids, text
        assert v.decode(mine) == t.decode(theirs.ids, skip_special_tokens=False)
    rows = bpe.with_decoded(bpe.with_ids(odd, queries.BPE_FILE), queries.BPE_FILE).collect()
    assert [r["decoded"] for r in rows] == [r["text"] or "" for r in rows]
    r = bpe.with_digests(odd.where("doc_id = 4"), queries.BPE_FILE).first()
    ids = np.array(t.encode("word", add_special_tokens=False).ids, "<u4")
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b"word").hexdigest())


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    v = bpe.Vocabulary(queries.BPE_FILE)
    texts = [f"some words {i} and more" for i in range(20)]
    assert [v.decode(x) for x in v.encode(texts)] == texts


def test_avi_round_trips(spark, odd):
    for payload in (os.urandom(64), os.urandom(64 * 333), b"\xff" * 128, bytes(64)):
        back, frames, usec = avi.read(avi.write(payload))
        assert back.tobytes() == payload and usec == 40_000
    frame = avi.frames_of(np.frombuffer(bytes(range(256)), np.uint8).reshape(1, -1))[0]
    assert (jpeg.decode(frame)[0].reshape(4, 8, 64, 8)[:, 3, :, 5].ravel() == np.arange(256)).all()
    still, other = np.full(64 * 16, 20, np.uint8), np.full(64 * 16, 200, np.uint8)
    assert avi.shots([still] * 5 + [other] * 5)[0] == [(0, 4), (5, 9)]
    rows = {r["doc_id"]: r for r in avi.with_digests(odd).collect()}
    assert rows[1]["payload_bytes"] == 64 and rows[1]["tail_crc32"] == zlib.crc32(bytes(64)) and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    assert rows[6]["payload_sha256"] == hashlib.sha256(("été " * 50_000).encode().ljust(-(-300_000 // 64) * 64, b"\0")).hexdigest()
    clips = avi.clips(avi.with_media(odd.select("doc_id", "text")).drop("text"))
    assert clips.where("doc_id = 2 and status = 'ok'").count() == 1 and clips.columns[-3:] == ["start_ms", "end_ms", "status"]
    broken = odd.where("doc_id < 4").select("doc_id", F.when(F.col("doc_id") < 3, F.lit(b"RIFF....")).alias("media"), F.lit(0).alias("Clip"))
    assert sorted((r["doc_id"], r["clip"], r["status"][:8]) for r in avi.clips(broken).collect()) == [(1, None, "broken: "), (2, None, "broken: "), (3, None, "no media")]
    assert avi.with_digests(odd.limit(0)).count() == 0
    assert avi.with_digests(odd.withColumn("Feature", F.lit(1))).columns == [*odd.columns, *(n for n, _ in avi.DIGEST)]


def jpeg_frame(planes, quant, tables=True, restart=0):
    """A baseline frame of planes (each 8x8 blocks; the first twice as wide and high), coded symbol by symbol, and what it decodes to."""
    standard = {k: (bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in jpeg.STANDARD.items()}
    codes = {}
    for k, (lengths, symbols) in standard.items():
        code = i = 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                codes[k, symbols[i]] = f"{code:0{n}b}"
                code, i = code + 1, i + 1
            code *= 2

    def value(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def transform(block):  # by the definition
        c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
        return [[c(u) * c(v) / 4 * sum((block[y][x] - 128) * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for y in range(8) for x in range(8)) for u in range(8)] for v in range(8)]

    def back(f):
        c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
        return [[min(255, max(0, math.floor(128.5 + sum(c(u) * c(v) / 4 * f[v][u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for v in range(8) for u in range(8))))) for x in range(8)] for y in range(8)]

    want = [np.zeros_like(p) for p in planes]
    order = [[(0, y, x) for y in (2 * m, 2 * m + 1) for x in (2 * n, 2 * n + 1)] + [(1, m, n), (2, m, n)] for m in range(planes[1].shape[0] // 8) for n in range(planes[1].shape[1] // 8)]
    out, last, bits = [], [0, 0, 0], ""
    for k, unit in enumerate(order):
        if restart and k and k % restart == 0:
            out.append(bits + "1" * (-len(bits) % 8))
            bits, last = "", [0, 0, 0]
        for p, y, x in unit:
            f = transform(planes[p][8 * y : 8 * y + 8, 8 * x : 8 * x + 8].tolist())
            q = [round(f[i // 8][i % 8] / quant) for i in jpeg.ZIGZAG]
            flat = [0] * 64
            for i, v in zip(jpeg.ZIGZAG, q, strict=True):
                flat[i] = v * quant
            want[p][8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = back([flat[8 * r : 8 * r + 8] for r in range(8)])
            t = min(p, 1)
            n, extra = value(q[0] - last[p])
            last[p] = q[0]
            bits += codes[t, n] + extra
            run = 0
            for i, v in enumerate(q[1:], 1):
                if v == 0:
                    run += 1
                    if not any(q[i:]):
                        bits += codes[16 | t, 0]
                        break
                    continue
                while run > 15:
                    bits, run = bits + codes[16 | t, 0xF0], run - 16
                n, extra = value(v)
                bits, run = bits + codes[16 | t, run << 4 | n] + extra, 0
    out.append(bits + "1" * (-len(bits) % 8))
    data = b"".join((bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\x00") for k, b in enumerate(out))
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([quant] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, *planes[0].shape, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    if tables:
        head += b"".join(seg(0xC4, bytes([k]) + a + b) for k, (a, b) in standard.items())
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    return head + seg(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00") + data + b"\xff\xd9", want


def test_colour_frames_against_the_definition(spark):
    rng = np.random.default_rng(2)
    for quant, tables, restart in ((3, True, 0), (20, False, 0), (1, False, 2)):
        planes = [rng.integers(0, 256, (32, 32)).astype(np.uint8), rng.integers(90, 160, (16, 16)).astype(np.uint8), np.full((16, 16), 200, np.uint8)]
        frame, want = jpeg_frame(planes, quant, tables, restart)
        got = jpeg.decode(frame)
        assert all(np.abs(g.astype(int) - w).max() <= 1 for g, w in zip(got, want, strict=True))
        for bad in (frame[:-40], frame[:300], b"\xff\xd8", frame.replace(b"\xff\xc0", b"\xff\xc2")):
            with pytest.raises((ValueError, IndexError, KeyError, struct.error)):
                jpeg.decode(bad)
    dark, light = (jpeg_frame([np.full((16, 16), v, np.uint8), np.full((8, 8), 128, np.uint8), np.full((8, 8), 128, np.uint8)], 2, False)[0] for v in (30, 220))
    film = avi.riff([dark] * 5 + [light] * 7, 16, 16)
    df = spark.createDataFrame([(1, film)], "id long, media binary")
    assert [tuple(r) for r in avi.clips(df).collect()] == [(1, 0, 0, 4, 0, 200, "ok"), (1, 1, 5, 11, 200, 480, "ok")]




def test_language_on_held_out_rows(spark, odd):
    got = queries.op5_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() and got.where("score < 0 or score > 1").count() == 0
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r["doc_id"]: r for r in language_id.with_language(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and rows[6]["lang_pred"] == "fr" and rows[1]["score"] == 0
    held_out = spark.createDataFrame([(None, "text", "en")], "doc_id long, text string, lang string").select(queries._held_out(4, 2)).first()[0]
    assert held_out is False and language_id.with_language(odd.limit(0), model).count() == 0
    assert sorted((r["doc_id"] or 0) for r in language_id.with_language(odd.withColumn("Lang_pred", F.lit(1)), model).collect()) == sorted(i or 0 for i, *_ in ODD)
    # of three languages the two most frequent are learnt, and a row repeated often counts once
    many = spark.range(1, 400).selectExpr("id as doc_id", "case when id % 10 = 0 then 'rare words of it ' || id else 'common text of the kind ' || id end as text", "case when id % 10 = 0 then 'xx' when id % 2 = 0 then 'en' else 'de' end as lang")
    again = spark.range(3000).selectExpr("1L as doc_id", "'the same text' as text", "'en' as lang")
    assert language_id.train(many.union(again), languages=2).langs == ["de", "en"]
    assert language_id.train(odd.limit(0)) is None
    assert language_id.with_language(odd, None).where("lang_pred <> 'und'").count() == 0


def test_character_ngrams_stay_in_their_rows():
    one = language_id.slots(*(np.frombuffer(b"abcab", np.uint8), np.array([0, 3, 5])))[0]
    two = [np.concatenate(x) for x in zip(language_id.slots(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0], language_id.slots(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0], strict=True)]
    assert all((a == b).all() for a, b in zip(one, two, strict=True))


def test_toxicity_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= 0.7 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
    labels = spark.createDataFrame([(4, None, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    weights = toxicity.train(odd, labels)
    assert (toxicity.train(odd.unionByName(odd), labels.union(labels)) == weights).all()  # repeated ids and labels
    rows = toxicity.with_toxicity(odd, weights).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.with_toxicity(odd.limit(0), weights).count() == 0


def test_decontamination(spark, odd):
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))) for i in range(8)] + [(90, None), (91, "too short")]
    docs = [(100, "clean text without anything in it " * 9)]
    for i, t in items[:8]:
        edited = list(t)
        for _ in range(len(t) * i // 120):
            edited[rng.randrange(len(edited))] = "z"
        docs.append((i, f"before {''.join(edited).upper()}  \n after"))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")

    def distance(item, text):  # fewest edits to a part of the text
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    norm = lambda t: re.sub(r"\s+", " ", t.lower())
    want = {(i, k): e for i, t in docs for k, x in items[:8] if (e := distance(norm(x), norm(t))) <= int(decontamination.RATE * len(norm(x)))}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.found(d, b).collect()}
    assert got == want and len(want) >= 6
    kept = {r["doc_id"] for r in decontamination.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.found(odd, b).count() == 0 and decontamination.clean(odd, b.limit(0)).count() == len(ODD)


def test_decontamination_of_short_items(spark):
    items = [(1, "Paris"), (2, "no"), (3, "What is the capital of it?"), (4, "北京市"), (5, "exactly11ch"), (6, "ten letter"), (7, "no"), (8, "...")]
    nameless = (None, "a question without an id of forty letters or so, and more")
    docs = [
        (1, "In (PARIS), they say: “No”."), (2, "comparisons, now nobody_no"), (3, "q: what is  the capital of\nit? none"), (4, "在北京市里"),
        (5, "xexactly11chx"), (6, "often letters, ten letter"), (7, f"so {nameless[1]}."), (8, "what is the kapital of it?"), (9, None), (10, ""), (11, "é no"), (12, "éno noé"),
    ]
    b = spark.createDataFrame([*items, nameless], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["end_byte"]) for r in decontamination.found(d, b).collect()}
    assert got.keys() == {(1, 1), (1, 2), (1, 7), (3, 3), (4, 4), (5, 5), (6, 6), (8, 3), (11, 2), (11, 7)}
    assert got[1, 1] == (0, 9) and got[3, 3][0] == 0 and got[8, 3][0] == 1
    assert {r["doc_id"] for r in decontamination.clean(d, b).collect()} == {2, 9, 10, 12}


def test_decontamination_of_repetitive_texts():
    """A megabyte of one character, and items of the same: bounded memory, what brute force finds."""
    import tracemalloc

    run, period = b"=" * 300, b"- " * 150
    broken = (b"=" * 99 + b"x") * 4
    items = decontamination.Items([(1, run), (2, b"title " + run), (3, period), (4, b"-" * 1_000), (5, b"z" * 40)])
    texts = ["=" * 1_000_000, "-=" * 2000, broken.decode() * 30, "- " * 100_000, "-" * 950, ("title " + "=" * 320) * 3, None]
    items.hits(pa.array(["warm"]))
    tracemalloc.start()
    got = items.hits(pa.array(texts, pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    # an x in each hundred costs an edit, 'title ' that is missing before a run six
    assert got == {(0, 0): (0, 300), (0, 1): (6, 300), (2, 0): (3, 299), (2, 1): (9, 299), (3, 2): (0, 300), (4, 3): (50, 950), (5, 0): (0, 306), (5, 1): (0, 306)}
    assert {r for r, _ in items.hits(pa.array(texts, pa.string()), True)} == {0, 2, 3, 4, 5}


def test_decontamination_in_slices_of_hits(monkeypatch):
    """Small slices of counts and alignments give what large ones give."""
    rng = random.Random(9)
    items = [(i, bytes(rng.choice(b"ab ") for _ in range(rng.randrange(11, 90)))) for i in range(20)]
    texts = [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(0, 400))).decode() for _ in range(10)] + ["".join(t.decode()[1:] for _, t in items)]
    whole = decontamination.Items(items).hits(pa.array(texts))
    monkeypatch.setattr(decontamination, "ENTRIES", 50)
    monkeypatch.setattr(decontamination, "CELLS", 300)
    assert decontamination.Items(items).hits(pa.array(texts)) == whole and len(whole) >= 5


def test_main_text():
    page = """<html><head><title>T</title><style>x{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, always. Really.</div>
    <div class="wrap"><div class="sidebar"><p>Side text, long enough, with points. Yes.</p></div><div class="content"><h2>Title &eacute;</h2><p>First para, with
    words.&nbsp;And more.</p><ul><li>item one<li>item two, ok.</ul><p>Second <b>bold</b> and <a href=x>link</a> para. Long, good.</p><form>Name: <input></form><script>var p="</p>";</script>
    <section class="comments"><p>Reader says: nice, good. Very, very nice.</p></section></div></div><footer>foot</footer>"""
    assert html_text.main_text(page) == "Title é\nFirst para, with words. And more.\nitem one\nitem two, ok.\nSecond bold and link para. Long, good."
    assert [html_text.main_text(x) for x in (None, "", "<p", "<nav>a</nav>", "<!-- x")] == [""] * 5
    assert html_text.main_text("<article><p>a<p>b</article>") == "a\nb"


def test_main_text_without_article():
    """Nothing around the largest part of the main text is lost where no article or main element holds it."""
    say = lambda what, n: " ".join(f"Sentence {i} of the {what}, with words enough." for i in range(n))
    intro, items, closing = say("intro", 4), [say(f"item {i}", 10) for i in range(3)], say("closing", 4)
    page = f"<body><nav><a href=x>Home</a></nav><div class=content><p>{intro}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>{closing}</p></div><footer>foot</footer></body>"
    assert html_text.main_text(page) == "\n".join([intro, *items, closing])
    one, two = [say("first", 10)] * 3, [say("second", 10)]
    page = "<body><div class=page>" + "".join(f"<div class=section>{''.join(f'<p>{x}</p>' for x in part)}</div>" for part in (one, two)) + "</div><footer>foot</footer></body>"
    assert html_text.main_text(page) == "\n".join(one + two)
    rows = [say("large row", 30), say("row", 5), say("last row", 5)]
    page = f"<body><div><table>{''.join(f'<tr><td>{x}</td></tr>' for x in rows)}</table></div></body>"
    assert html_text.main_text(page) == "\n".join(rows)


def test_main_text_by_path_ratios(monkeypatch):
    """Pages without article, main or telling names: the paths' ratios alone decide, and their threshold matters."""
    rng = random.Random(4)
    pages = []
    for k in range(60):
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
        say = lambda n: " ".join(" ".join(word() for _ in range(rng.randrange(6, 14))) + rng.choice([".", ", so.", "?"]) for _ in range(n))
        body = [say(rng.randrange(2, 8)) for _ in range(rng.randrange(4, 9))]
        links = "".join(f"<div class=c{k}a><a href=x>{word()} {word()}</a></div>" for _ in range(rng.randrange(5, 12)))
        marks = "".join(f"<td>{word()} {word()}</td>" for _ in range(6))
        text = "".join(f"<p>{x}</p>" for x in body)
        if k % 3 == 0:
            page = f"<body><div>{links}</div><div><div>{text}</div></div><div><span>{word()} {word()}</span></div></body>"
        elif k % 3 == 1:
            page = f"<body><table><tr>{marks}</tr></table><div id=x{k}>{text}</div><div>{links}</div>"
        else:
            page = f"<body><div>{links}</div><div>{text}<ul><li>{body[0]}</li></ul></div><div>{links}</div></body>"
            body = [*body, body[0]]
        pages.append((page, "\n".join(body)))
    assert [html_text.main_text(page) for page, _ in pages] == [want for _, want in pages]
    results = set()
    for share in (-1, 0.35, 5):
        monkeypatch.setattr(html_text, "SHARE", share)
        results.add(tuple(html_text.main_text(page) for page, _ in pages))
    assert len(results) == 3


def test_main_text_of_odd_pages(spark):
    assert html_text.main_text('<body><div class="widget"><p>All text, here, is in a widget.</p></div></body>') == "All text, here, is in a widget."
    assert html_text.main_text('<article><p title=\'say "x>y"\'>One <b>two</b><p data-x="a>b">three"</article>') == 'One two\nthree"'
    for page in ("<div>x" * 100_000, "<b>x" * 50_000 + "</i>" * 50_000, "<x-a>" * 50_000 + "<p>a" * 50_000, '<a "' * 50_000, '<a href="' * 50_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10  # linear: quadratic time takes minutes
    rows = [(1, None, None, 1), (2, "u", "", 2), (2, "u", "", 2), (None, "v", "<p>a</p>" * 60_000, 3), (3, "w", "plain text", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, N_chars int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.with_main_text(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), None: ("a\n" * 59_999 + "a", 119_999), 3: ("plain text", 10)}
    assert html_text.with_main_text(df.limit(0)).count() == 0


def test_main_text_of_pages(spark):
    import html as h

    for r in queries.op6_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_url_rules(spark):
    urls = [None, "", "no scheme", "https://WWW.Example.COM/en/x?q=/fr/", "http://example.com/en/", "http://a.example.com/en", "http://sub.example.net/es/1", "http://net", "http://x.net/de/1", "http://x.org", "ftp://h.com#f", "http://example.net/fr/" * 2]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judged(df, queries.URL_RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(12)] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/x", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("a.example.com", "/en", "com/"),
        ("sub.example.net", "/es/1", "net/es/"), ("net", "", None), ("x.net", "/de/1", None), ("x.org", "", None), ("h.com", "", None), ("example.net", "/fr/http://example.net/fr/", "net/fr/"),
    ]
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and got[6]["verdict"] == "block"
    assert url_rules.judged(df.limit(0), queries.URL_RULES).count() == 0
    rules = [(frozenset({"a", "b"}), "block", 0.95, 0.2), (frozenset({"c"}), "allow", 0.9, 0.2)]
    tokens = spark.createDataFrame([(["a", "c"],), (["a", "b", "c"],), ([],), (None,)], "tokens array<string>")
    assert [r["mined_verdict"] for r in url_rules.with_mined(tokens, rules, "none").collect()] == ["allow", "block", "none", "none"]


def test_url_rules_against_brute_force(spark):
    """The mined rules are all combinations of up to three tokens of enough support and confidence, less those that a part says as surely."""
    import itertools

    rng = random.Random(6)
    rows = []
    for _ in range(300):
        bad = rng.random() < 0.4
        have = {t for t in "abcdefg" if rng.random() < 0.4}
        if bad:
            have |= {"x1", "x2", *(f"always{i}" for i in range(25))} if rng.random() < 0.8 else {"y", "z"}
        elif rng.random() < 0.3:
            have |= {"y"}
        rows.append((sorted(have), "block" if bad else "allow"))
    got = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    names = sorted({t for ts, _ in rows for t in ts if not t.startswith("always") or t == "always0"})
    want = {}
    for n in (1, 2, 3):
        for combination in itertools.combinations(names, n):
            have = [v for ts, v in rows if set(combination) <= set(ts)]
            for verdict in ("allow", "block"):
                k = have.count(verdict)
                if k >= 0.05 * len(rows) and k >= 0.8 * len(have):
                    want[frozenset(combination), verdict] = (k / len(have), k / len(rows))
    want = {(s, v): x for (s, v), x in want.items() if not any(t < s and v == w and y[0] >= x[0] for (t, w), y in want.items())}
    mine = {(s, v): (c, p) for s, v, c, p in got if not any(t.startswith("always") and t != "always0" for t in s)}
    assert mine.keys() == want.keys() and len(want) >= 3
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(mine[k], want[k], strict=True))
    assert {frozenset({f"always{i}"}) for i in range(25)} <= {s for s, *_ in got}
    long = "http://a.org/" + "/".join(f"s{i}" for i in range(3000))
    clash = spark.createDataFrame([(long, "x", 1), (long, "x", 1)], "url string, Verdict string, tokens int")
    assert [(r["host"], r["verdict"]) for r in url_rules.judged(clash, queries.URL_RULES).collect()] == [("a.org", "allow")] * 2


def test_warc_audit(spark):
    rows = [(i, f"http://h/{i}", f"body {i}" * (i % 7)) for i in range(700)] + [(None, None, None), (None, "u", "x"), (7, "other", "text"), (7, "other", "text"), (8, "long", "z" * 300_000)]
    clash = "page_id long, url string, html string, digest string, place long"
    frame = lambda rows: warc.digests(spark.createDataFrame([(*r, "d", 1) for r in rows], clash))

    def audit(theirs, mine=rows):
        return sorted((r["kind"], r["page_id"] is not None, r["page_id"] or 0) for r in warc.audit(frame(mine), frame(theirs)).collect())

    change = lambda i, new: [(r[0], r[1], new) if k == i else r for k, r in enumerate(rows)]
    assert audit(rows[::-1]) == []
    assert audit(change(20, "body 2X" * 6)) == audit(change(20, "a length of its own")) == [("damaged", True, 20)]
    assert audit(rows[:350] + rows[351:]) == [("missing", True, 350)]
    assert audit([*change(702, "one copy damaged"), (10_000, "new", ""), rows[3]]) == [("damaged", True, 7), ("surplus", True, 3), ("surplus", True, 10_000)]
    odd = change(700, "a null id")
    assert audit(odd[:703] + odd[704:] + [(None, None, "another"), (8, "third", "of the id")]) == [("damaged", False, 0), ("missing", True, 7), ("surplus", False, 0), ("surplus", True, 8)]
    assert len(audit([])) == len(rows) == len(audit(rows, [])) and audit([], []) == []
    r = warc.audit(frame(rows), frame(change(300, "?"))).first()
    whole = {x["page_id"]: x["length"] for x in frame(rows[:700]).collect()}
    before = [x for x in sorted([None, None, *range(700), 7, 8], key=lambda x: -1 if x is None else x)]
    assert r["place"] == before.index(300) and r["file"] == r["place"] // 256 and r["length"] == whole[300]
    assert r["offset"] == sum(whole[x] for x in before[r["file"] * 256 : r["place"]])


def test_licences(spark, odd):
    texts = {
        1: "Intro. Licensed under the Apache License, Version 2.0. More.",
        2: "\n".join(s for name in ("mit-grant", "mit-condition", "mit-warranty") for s in licences.SENTENCES[name]),
        3: "Nothing of the kind; all rights are good.",
        4: "This work is licensed under the GNU General Public License, version 3.\nall RIGHTS reserved",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scanned(df).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: ["All-Rights-Reserved", "GPL-3.0"]}
    assert {len(r["licences"]) for r in licences.scanned(odd).collect()} == {0}


def test_licences_in_wrapped_texts(spark):
    import textwrap

    text = lambda names, width: "\n\n".join(textwrap.fill(" ".join(licences.SENTENCES[n]), width) for n in names)
    mit = text(["mit-grant", "mit-condition", "mit-warranty"], 76)
    bsd = text(["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"], 70)
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n' + text(["apache-warranty"], 72)
    marked = lambda t, mark: "\n".join((mark + line).rstrip() for line in t.split("\n"))
    isc = text(["isc-grant"], 60)
    texts = {
        1: f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}",
        2: marked(mit, " * "),
        3: marked(bsd, "# ").replace("\n", "\r\n"),
        4: marked(header, "// "),
        5: marked(isc, ";; "),
        6: f"Copyright (c) 2020 Some One\n{isc}\nfollowed by more",
        7: isc.replace("\n", "\n\n", 1),
        8: "MIT License\nsome text without a full stop\nAll rights reserved",
        9: "Licensed" + " " * 3000 + "under the MIT License.",
        10: marked(text(["bsd-redistribute"], 72) + "\n\n1. " + text(["bsd-source"], 72) + "\n2. " + text(["bsd-binary"], 72) + "\n\n" + text(["bsd-warranty"], 72), " * "),
        11: marked(textwrap.fill("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", 72), "# "),
        12: textwrap.fill("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", 72) + "\n\n" + text(["gpl-warranty"], 72),
        13: "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    twin = {r[0]: (r[2].split(), r[3].split()) for r in con.execute("SELECT doc_id, n_sentences, sentence_ids, licences FROM (" + licences.oracle() + ")").fetchall()}
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scanned(df).collect()}
    three = ["mit-grant", "mit-condition", "mit-warranty"]
    assert got == {
        1: (["mit-notice", *three], ["MIT"]),
        2: (three, ["MIT"]),
        3: (["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"], ["BSD-3-Clause"]),
        4: (["apache-notice", "apache-compliance", "apache-copy", "apache-warranty"], ["Apache-2.0"]),
        5: (["isc-grant"], ["ISC"]),
        6: (["isc-grant"], ["ISC"]),
        7: ([], []),
        8: (["mit-notice", "all-rights"], ["All-Rights-Reserved", "MIT"]),
        9: (["mit-notice"], ["MIT"]),
        10: (["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-warranty"], ["BSD-2-Clause"]),
        11: (["lgpl-terms", "later-2.1"], ["LGPL-2.1-or-later"]),
        12: (["gpl-redistribute", "gpl-warranty"], ["GPL-3.0-or-later"]),
        13: (["mpl-notice"], ["MPL-2.0"]),
    }
    assert twin == got
    assert licences.scanned(df.limit(0)).count() == 0
    clash = licences.scanned(df.select("text", F.lit(1).alias("Licences"), F.lit("x").alias("sentence_ids"), F.lit(2).alias("words")))
    assert clash.columns == ["text", "words", "sentence_ids", "licences"]


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) between 300 and 2000").limit(40).collect()}
    (one, two, three), other = list(texts.values())[:3], "ganz anderer Text"
    columns = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, language string, language_score string, text_key string, n_tokens string"
    rows = [(None, one), (None, one), (7, one), (7, one), (7, two), (8, two + " end"), (9, two + " end"), (None, three), (None, three), (None, None), (10, None), (11, ""), (11, ""), (12, "\n "), (13, other * 10_000)]
    docs = spark.createDataFrame([(i, t, None, "s", k, "mine", "my own", "x", "y", "z") for k, (i, t) in enumerate(rows)], columns)
    ids = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:20]) for r in df.collect()))
    want = [(i is None, i or 0, (t or "")[:20]) for i, t in rows]
    for name in ("toxicity", "language_id", "decontamination"):
        out = stages[name](spark, docs, SF)
        # nothing to learn a language from; these texts are neither toxic nor of the benchmark
        assert ids(out) == sorted(want), name
        assert out.columns == docs.columns and {(r["toxicity"], r["language"], r["language_score"], r["text_key"]) for r in out.collect()} == {("mine", "my own", "x", "y")}
    out = stages["ngram_jaccard"](spark, docs, SF)
    # one row of id 7 for each of two groups, one of the null ids, and all rows without words
    assert ids(out) == sorted([(False, 7, one[:20]), (False, 7, two[:20]), (True, 0, three[:20]), (True, 0, ""), (False, 10, ""), (False, 11, ""), (False, 11, ""), (False, 12, "\n "), (False, 13, (other * 2)[:20])])
    assert out.columns == docs.columns
    out = stages["bpe"](spark, docs, SF)
    assert out.count() == len(rows) and out.where("doc_id = 12").first()["n_tokens"] >= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_deals_out_few_texts(spark):
    """Where ids of copies are too many to broadcast, still only texts that may go are dealt out."""
    import corpus_pipeline

    rng = random.Random(9)
    texts = [" ".join(f"{rng.randrange(10**9)}" for _ in range(200)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(30)] + [(7, texts[7]), (None, texts[8])]
    docs = corpus_pipeline.written(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF)
        got = []
        _, dealt = jobs_of(spark, lambda: got.extend(out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(enumerate(texts))
    assert dealt < 0.2 * sum(map(len, texts))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = docs.select("doc_id", "text").collect()
        if name == "ngram_jaccard":
            assert kept == {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in before]).values()}
        if name == "bpe":
            assert out.count() == len(before) and "ids_sha256" in out.columns
        else:
            assert out.columns == names and len(kept) >= 0.6 * len(before)
            docs = corpus_pipeline.written(out, "test")
    assert pa.__version__

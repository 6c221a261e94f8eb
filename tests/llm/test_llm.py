"""The training-data operators, each against a plain version, an exact round trip or held-out labels."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.llm import bpe, components, decontaminate, lm, mjpeg, nearjoin, quality, queries, sharding, toxicity, urls, warc
from frameweave.llm import q01_mjpeg, q03_sharding, q05_decontaminate, q06_bpe, q08_urls, q09_warc, q10_lm
from frameweave.llm._io import table

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LONG = "word " * 4000 + "ünïcode " * 4000
TEXTS = [None, "", " ", "one", "one two three", "A b c d e", "a b c d e", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "x" * 5000, LONG, LONG, "日本語 テキスト 😀", "tab\tand\nline", "0 1 2 3 4 5 6 7 8 9"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, equal and repeated texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, f"k{i % 3}", float(i)) for i, t in enumerate(TEXTS)] + [(3, "one", "k0", 3.0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, cls double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1 ---


def test_media_round_trip(odd, none):
    found = by_id(q01_mjpeg.digests(odd))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[10].media_sha256 == found[11].media_sha256
    assert q01_mjpeg.digests(none).count() == 0


def test_media_index_rebuilt_and_shots(odd):
    payload = bytes(64 * 64 * 3) + b"\xff" * 64 * 64 * 3
    data = mjpeg.write_avi(payload)
    assert mjpeg.read_avi(data)[0] == payload
    at = data.index(b"idx1")
    broken = data[: at + 20] + bytes(4) + data[at + 24 :]
    assert mjpeg.read_avi(broken)[0] == payload and mjpeg.read_avi(data[:at])[0] == payload
    assert [c[:4] for c in mjpeg.read_avi(data)[1]] == [(0, 0, 3, 0.0), (1, 3, 3, 120.0)]
    assert mjpeg.read_avi(b"no file") == (b"", [])
    clips = mjpeg.clips(mjpeg.store(odd.select("doc_id", "text"))).collect()
    assert {c.doc_id for c in clips if c.doc_id is not None} == set(range(len(TEXTS)))


def test_jpeg_with_other_tables():
    """A lossless frame with an ordinary Huffman table, and a baseline frame with the standard's tables."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    counts, symbols = [0, 0, 0, 9] + [0] * 12, list(range(9))
    codes = {v: k for k, v in mjpeg._codes((counts, symbols)).items()}
    bits = ""
    for y in range(5):
        for x in range(7):
            before = 128 if x == y == 0 else int(rows[y - 1, 0]) if x == 0 else int(rows[y, x - 1])
            d = int(rows[y, x]) - before
            s = abs(d).bit_length()
            n, c = codes[s]
            bits += f"{c:0{n}b}" + (f"{d if d >= 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    scan = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    jpeg = b"\xff\xd8" + mjpeg._segment(0xC3, bytes([8, 0, 5, 0, 7, 1, 1, 0x11, 0])) + mjpeg._segment(0xC4, bytes([0, *counts, *symbols])) + mjpeg._segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + scan + b"\xff\xd9"
    assert (mjpeg.decode_frames([jpeg])[0] == rows).all()
    dc = {v: k for k, v in mjpeg._codes(mjpeg.DC_LUMA).items()}
    ac = {v: k for k, v in mjpeg._codes(mjpeg.AC_LUMA).items()}
    word = lambda t: f"{t[1]:0{t[0]}b}"
    bits = word(dc[7]) + f"{72:07b}" + word(ac[0])  # one block: DC 72, all else 0
    scan = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    jpeg = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0] + [8] * 64)) + mjpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    assert (mjpeg.decode_frames([jpeg])[0] == 128 + 72).all()


# --- 2 ---


def plain_join(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * den >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_near_join(spark, k, num, den):
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for family in range(12):
        base = list(rng.choice(words, rng.integers(3, 90)))
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs) + i, t) for i, t in enumerate(TEXTS)]
    found = by_id(nearjoin.join(spark.createDataFrame(docs, "doc_id bigint, text string"), k, num, den))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == plain_join(docs, k, num, den)


def test_near_join_families_and_hot_shingles(spark, monkeypatch):
    """Many near copies, a line that all have, and marks instead of lists for it."""
    monkeypatch.setattr(nearjoin, "HEAVY_LEAST", 3)
    rng = np.random.default_rng(9)
    line = "this very line stands in every single text of them all"
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(60):
        own = list(base)
        own[int(rng.integers(0, 80))] = f"n{i}"
        docs.append((i, " ".join(own)))
    docs += [(60 + i, line + " " + " ".join(f"u{i}x{j}" for j in range(8 + i % 30))) for i in range(60)]
    found = by_id(nearjoin.join(spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 85, 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == plain_join(docs, 4, 85, 100)


@pytest.mark.parametrize("merged", [2, 1024])
def test_near_join_in_several_exchanges(spark, monkeypatch, merged):
    """Ranges split twice and more, with shingles that become heavy on the way."""
    monkeypatch.setattr(nearjoin, "FAN_BITS", 2)
    monkeypatch.setattr(nearjoin, "HEAVY_MERGED", merged)
    monkeypatch.setattr(nearjoin, "CHUNK_BYTES", 500)
    monkeypatch.setattr(nearjoin, "BUCKET_BYTES", 200)
    rng = np.random.default_rng(21)
    docs = []
    for _ in range(25):
        base = list(rng.choice([f"w{i}" for i in range(40)], 30))
        for _ in range(int(rng.integers(1, 5))):
            own = list(base)
            own[int(rng.integers(0, 30))] = f"n{len(docs)}"
            docs.append((len(docs), " ".join([*own, "and", "all", "end", "like", "this"])))
    found = by_id(nearjoin.join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 4, 70, 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == plain_join(docs, 4, 70, 100)


def test_near_join_edges(odd, none):
    found = nearjoin.join(odd, 4, 85, 100).collect()
    assert len(found) == len(TEXTS) + 2 and {"score", "component_id"} <= set(found[0].asDict())
    assert {(r.n_shingles, r.component_id) for r in found if r.doc_id is None} == {(1, None)}
    assert nearjoin.join(none).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (None, 3), (1, 2)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys(range(10, 16), 10)}


# --- 3 ---


def test_shards(spark, odd, none, sf):
    rows = q03_sharding.placed(table(spark, sf, "documents").select("doc_id", "text")).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r["shard"], []).append((r.slot, r["size"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(n for _, n in v) - total / 16) <= most for v in slots.values())
    few = sharding.shard(odd, 4).collect()
    assert sorted(str(r.doc_id) for r in few) == sorted(str(r.doc_id) for r in odd.collect())
    assert {"score", "cls", "shard", "slot"} <= set(few[0].asDict())
    assert sharding.shard(none).count() == 0


def test_equal_texts_are_cut_only_where_they_must(spark):
    docs = spark.createDataFrame([(i, "same " * 20 if i % 3 else f"text {i} " * 12) for i in range(900)], "doc_id bigint, text string")
    rows = sharding.shard(docs, 4).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    total = sum(r.n for r in rows)
    assert len(rows) == 4 and all(abs(r.n - total / 4) < total * 0.02 for r in rows)


@pytest.mark.parametrize("part", [sharding.PART_ROWS, 50])
def test_equal_rows_are_cut_too(spark, monkeypatch, part):
    """Half of the rows are one and the same, of which a shard has a share and a task no more than its part."""
    monkeypatch.setattr(sharding, "PART_ROWS", part)
    docs = spark.createDataFrame([(7, "same " * 20) if i % 2 else (i, f"text {i} " * 12) for i in range(1600)], "doc_id bigint, text string")
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == 1600 and sum(r.doc_id == 7 for r in rows) == 800
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 8) <= 2 * most and sorted(r.slot for r in own) == list(range(len(own)))


def test_splitters_against_a_sort(spark):
    """Each boundary parts the rows where a sort of all keys would, to within the tolerance or one row."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 3000))], "doc_id bigint, text string")
    keyed = sharding.keyed(docs).select("size", *sharding.KEYS)
    rows = sorted(([k & (1 << 64) - 1 for k in (r.key_1, r.key_2, r.key_3)], r["size"]) for r in keyed.collect())
    digits = lambda key: [key[n // 6] >> max(0, 64 - (n % 6 + 1) * 12) & ((1 << min(12, 64 - n % 6 * 12)) - 1) for n in range(18)]
    total, most = sum(n for _, n in rows), max(n for _, n in rows)
    for shards in (2, 7, 16):
        for s, boundary in enumerate(sharding.splitters(keyed, shards), 1):
            below = sum(n for key, n in rows if tuple(digits(key)[: len(boundary)]) < boundary)
            assert abs(below - total * s / shards) <= max(most, 0.002 * total / shards)


# --- 4 and 7 ---


def held_out(rows, labels, name):
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)), sum((s >= 0.3) == (y == 1) for s, y in pairs) / len(pairs)


@pytest.mark.parametrize(("query", "label", "auc", "right"), [("op4_toxicity", "toxic", 0.8, 0.9), ("op7_quality", "quality", 0.85, 0.85)])
def test_held_out_labels(spark, query, label, auc, right):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    rows = queries.QUERIES[query](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    found = held_out(rows, labels, label)
    assert found[0] >= auc and found[1] >= right, found


def test_toxicity_folds_and_spares():
    own = lambda i: " ".join(f"{chr(98 + i % 20)}{chr(98 + i // 20)}{c}" for c in "bcdfghjk")  # noqa: E731  texts that have no words in common
    sample = [(f"{own(i)} idiot", 1) for i in range(40)] + [(own(40 + i), 0) for i in range(40)]
    lexicon = toxicity.learn(sample, {0: 40, 1: 40}, exceptions=("idiot proof",))
    score = lexicon.matcher()
    assert score("an 1di0t") > 0.5 and score("ан idіоt") > 0.5 and score("IDIOT!") > 0.5
    assert score("it is idiot proof") < 0.5 and score("hello") < 0.5 and score("") < 0.5
    assert toxicity.learn([], {}).matcher()("idiot") == 0.0


def test_quality_is_steady(spark, odd, none):
    network = quality.train([(b"fine words " * 30, 1), (b"*** !!! ***" * 30, 0)] * 20, {0: 20, 1: 20}, passes=3)
    texts = [b"", b"fine words " * 30, b"*** !!! ***" * 30, b"x" * 3000]
    together, alone = quality._steady(network, texts), [quality._steady(network, [t])[0] for t in texts]
    assert np.abs(together - np.array(alone)).max() <= 1e-4 and together[1] > together[2]
    rows = quality.score(odd, network).collect()
    assert len(rows) == len(TEXTS) + 2 and quality.score(none, network).count() == 0
    assert quality.train([], {}).scores([b"x"]).tolist() == [0.5]


def test_quality_trains_on_all_chunks_and_long_texts(spark, monkeypatch):
    long = "many good words " * 6000  # 96,000 bytes
    docs = [(0, long), (1, "short bad !!"), (2, "good words " * 900), (3, "!! ** " * 2000)]
    seen, whole = [], quality._windows
    monkeypatch.setattr(quality, "_windows", lambda text, *a: seen.append((len(text), len(w := whole(text, *a)))) or w)
    network = quality.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id bigint, quality int"), F.lit(True))
    size = {len(t): max(1, -(-(-(-len(t) // 8) * 8 - quality.OVERLAP) // (quality.CHUNK - quality.OVERLAP))) for _, t in docs}
    assert set(seen) == set(size.items()) and size[len(long)] > 200
    assert network.p is not None


def plain_quality(network, text):
    """The score of one text by the definition: every chunk by itself, every window of it by itself."""
    p = network.p
    padded = text.ljust(max(quality.CHUNK, -(-len(text) // quality.WIDTH) * quality.WIDTH), b"\0")
    step, tops, at = quality.CHUNK - quality.OVERLAP, [], 0
    while True:
        begin = min(at, len(padded) - quality.CHUNK)
        chunk = padded[begin : begin + quality.CHUNK]
        best = [np.concatenate([p["bytes"][b] for b in chunk[i : i + quality.WIDTH]]) @ p["filters"] for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        tops.append(np.maximum(np.max(best, axis=0) + p["offsets"], 0))
        if begin + quality.CHUNK >= len(padded):
            break
        at += step
    pooled = np.concatenate((np.max(tops, axis=0), np.mean(tops, axis=0), np.min(tops, axis=0)))
    hidden = np.maximum((pooled - p["shift"]) * p["stretch"] @ p["hidden"] + p["hidden_offsets"], 0)
    return 1 / (1 + math.exp(-float(hidden @ p["out"] + p["out_offset"][0])))


def test_quality_by_definition(monkeypatch):
    """Texts of all lengths around the ends of chunks, in blocks of few chunks and of many."""
    rng = np.random.default_rng(3)
    sample = [(bytes(rng.integers(97 + 13 * (i % 2), 110 + 13 * (i % 2), 700).astype(np.uint8)), i % 2) for i in range(40)]
    network = quality.train(sample, {0: 20, 1: 20}, passes=2)
    texts = [b"", b"a"] + [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (511, 512, 513, 520, 952, 959, 960, 961, 967, 968, 1400, 1407, 1408, 1409, 3100, 3101, 9000)]
    want = [plain_quality(network, t) for t in texts]
    for most in (1, 2, 3, 7, 1024):
        monkeypatch.setattr(quality, "BLOCK_CHUNKS", most)
        assert np.abs(network.scores(texts) - want).max() < 1e-4


def plain_toxicity(lexicon, text):
    """The score of one text by the definition: every place of every entry, unless it lies in a place of an exception."""
    folded = toxicity.fold(text)
    places = lambda s: [(i, i + len(s)) for i in range(len(folded) - len(s) + 1) if folded.startswith(s, i)]
    spared = [p for e in lexicon.exceptions for p in places(e)]
    total = sum(w for s, w in lexicon.weights.items() for a, b in places(s) if not any(p <= a and b <= q for p, q in spared))
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a + b + c * toxicity.density(total, folded) if total else a)))


def test_toxicity_by_definition(spark, odd, none):
    lexicon = toxicity.Lexicon({" idiot": 3.0, " trash ": 2.0, " shut up ": 4.0}, (toxicity.fold("trash can"), toxicity.fold("idiot proof trash")), (-3.0, 1.0, 0.5))
    rng = np.random.default_rng(4)
    words = ["idiot", "idiotic", "trash", "can", "proof", "shut", "up", "fine", "1d10t", "trаsh", "bin"]
    texts = [*TEXTS, *(" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(60)), "idiot proof trash can " * 3000]
    of = lexicon.matcher()
    assert all(abs(of(t or "") - plain_toxicity(lexicon, t or "")) < 1e-9 for t in texts[:-1]) and of(texts[-1]) == of("nothing")
    rows = toxicity.score(odd, lexicon).collect()  # its column score is replaced
    assert sorted((str(r.doc_id), r.score) for r in rows) == sorted((str(r.doc_id), of(r.text or "")) for r in odd.collect())
    assert toxicity.score(none, lexicon).count() == 0


def test_toxicity_is_not_evaded():
    lexicon = toxicity.Lexicon({" idiot ": 3.0}, (), (-3.0, 1.0, 0.5))
    of = lexicon.matcher()
    plain = of("you idiot there")
    assert all(of(f"you {w} there") == plain for w in ("ídïöt", "id\u200biot", "i\u0308diot", "IDIOT", "1d10t", "ｉｄｉｏｔ", "іdіоt", "id\u00adiot"))
    assert of("you idi ot there") < plain


def test_toxicity_learns_exceptions():
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    text = lambda *extra: " ".join([*rng.choice(words, 60), *extra, *rng.choice(words, 60)])
    sample = [(text("rubbish"), 1) for _ in range(160)] + [(text(), 0) for _ in range(160)] + [(text("a", "rubbish", "chute"), 0) for _ in range(9)]
    lexicon = toxicity.learn(sample, {0: 169, 1: 160})
    assert any(s.strip() in "rubbish" for s in lexicon.weights) and toxicity.fold("rubbish chute") in lexicon.exceptions
    of = lexicon.matcher()
    assert of(text("rubbish", "chute")) < 0.3 <= of(text("rubbish"))


# --- 5 ---


def plain_hits(docs, items, size=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = cut.findall((t or "").translate(LOWER))
        for j in range(max(1, len(w) - size + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = cut.findall((t or "").translate(LOWER))
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[j : j + n]))) is not None:
                    own |= who
                    hit |= set(range(j, j + n))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, "a B c d e f g h i j k l"), (2, "one, two"), (3, None), (4, ""), (None, "one two three"), (5, "a b c d e f g h i j k l"), (30, "e f g"), (7, "Ünïcode ünïcode")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted((tuple(r) for r in q05_decontaminate.hits(odd, bench).collect()), key=str)
    assert found == plain_hits(docs, items)
    assert q05_decontaminate.hits(none, bench).count() == 0
    assert all(not r.contaminated for r in q05_decontaminate.hits(odd, bench.limit(0)).collect())


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "double", "date"])
def test_decontamination_with_ids_of_any_type(spark, kind):
    bench = spark.range(3).selectExpr("id as n", "concat('one two three', if(id = 2, ' four', '')) as text")
    bench = bench.select((F.expr("date_add(date'2020-01-01', cast(n as int))") if kind == "date" else F.col("n").cast(kind)).alias("item_id"), "text")
    docs = spark.createDataFrame([(1, "say one two, three four!"), (2, "one two")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.find(docs, bench).collect()}
    assert len(found[1].hit_items) == 3 and [tuple(s) for s in found[1].hit_spans] == [(1, 5)] and found[2].hit_items == []


# --- 6 ---


def test_bpe_as_tiktoken(spark, odd, none):
    import public_tokenizers as tokenizers
    import tiktoken

    replay = bpe.MergeReplay.from_file(tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})
    draw = np.random.default_rng(2)
    letters = ["a", "b", " ", "  ", "\n", "é", "日", "😀", "1", "'s", "!", "\u00a0", "the", "ing"]
    texts = [*TEXTS, *("".join(draw.choice(letters, 60)) for _ in range(300)), *("a" * n for n in range(30))]
    ids = bpe.Encoder(replay, tokenizers.PATTERN).texts([t or "" for t in texts])
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [plain.encode_ordinary(t or "") for t in texts]
    assert [replay.encode_one(w) for w in (b"hello", b"", b"aaaa")] == [np.frombuffer(i, "<u4").tolist() for i in replay.encode([b"hello", b"", b"aaaa"])]
    found = by_id(q06_bpe.digests(odd))
    for i, t in enumerate(TEXTS):
        assert found[i].n_tokens == len(plain.encode_ordinary(t or "")) and found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert q06_bpe.digests(none).count() == 0


def test_bpe_hands_on_each_piece_of_a_batch(spark, monkeypatch):
    """A worker holds what it made of one piece, not of a whole Arrow batch, and gives free memory back between them."""
    import public_tokenizers as tokenizers
    import pyarrow as pa

    taken, trimmed = [], []
    monkeypatch.setattr(F, "arrow_udf", lambda f, schema: taken.append(f) or (lambda c: F.struct(*(F.lit(b"").alias(n) for n in schema.names))))
    monkeypatch.setattr(bpe, "BATCH_BYTES", 100)
    monkeypatch.setattr(bpe, "trim", lambda: trimmed.append(1), raising=False)
    bpe.round_trip(spark.createDataFrame([], "doc_id bigint, text string"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    texts = [None, "", *(f"text {i} of some forty letters and a few mörë" for i in range(20)), "long " * 60, None]
    made = list(taken[0](iter([pa.array(texts[:15]), pa.array([], pa.string()), pa.array(texts[15:])])))
    rows = [r for m in made for r in m.to_pylist()]
    whole = bpe.Encoder(bpe.MergeReplay.from_file(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN).texts([t or "" for t in texts])
    assert [r["ids"] for r in rows] == whole and [r["decoded"].decode() for r in rows] == [t or "" for t in texts]
    assert len(trimmed) == len(made) > 5 and all(len(m) == 1 or sum(len(r["decoded"]) for r in m.to_pylist()) <= 100 for m in made)


def test_bpe_with_patterns_that_span_blanks():
    """Units between blanks are only taken where the pattern parts there."""
    import public_tokenizers as tokenizers
    import tiktoken

    replay = bpe.MergeReplay.from_file(tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["the quick brown fox", "a  b", "", "x y", "In the end, 12 of them."]
    for pattern in (r"[\s\S]+", r"\S+ \S+|\S+|\s+", tokenizers.PATTERN):
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=replay.ranks, special_tokens={})
        got = bpe.Encoder(replay, pattern).texts(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode_ordinary(t) for t in texts], pattern


# --- 8 ---


def test_urls(spark):
    from frameweave.llm import q08_urls

    given = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "http://net/x", "http://b.net?q", "https://example.com/de/", "https://notexample.com/de/1", "https://x.org/fr/a", "ftp://org", "http://h/p#f?x", "a://b://c/d"]
    rows = {r.page_id: r for r in q08_urls.verdicts(spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")).collect()}
    for i, u in enumerate(given):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in q08_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best[1] if best else None)
        assert rows[i].verdict == best[2] if best else rows[i].verdict in ("allow", "block")


def plain_features(url, suffixes, prior):
    head, sep, rest = url.partition("://")
    host, path, query = "", "", ""
    if sep:
        rest = rest.partition("#")[0]
        rest, _, query = rest.partition("?")
        host, slash, tail = rest.partition("/")
        host, path = host.lower(), slash + tail
    labels, segments = host.split("."), path.split("/")
    last = segments[-1]
    keys = ["1 " + labels[-1], "2 " + ".".join(labels[-2:]), "s " + (segments[1] if len(segments) > 1 else ""), "e " + (last.rpartition(".")[2] if "." in last else ""), "p " + labels[0].rstrip("0123456789")]

    def bits(text):
        raw = text.encode()
        return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0.0

    n = max(1, len(url))
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), host.count("-"), sum(c.isdigit() for c in url) / n, sum(c.isalpha() for c in url) / n,
        sum(c.isdigit() for c in host), bits(host), bits(url), query.count("=") + query.count("&"), float("#" in url), float(url.startswith("https")), *(suffixes.get(k, prior) for k in keys),
    ]


ODD_URLS = [None, "", "nohost", "http://", "http://h", "HTTPS://Ex.COM/a/b.html?x=1&y=2#z", "http://h?q=a/b#c", "http://h#f?x", "http://a12.b-c.d.org/en/x.tar.gz", "http://h/" + "p" * 50000, "x://é.net/ü?ö=1", "http://a.b/c\nd/e.f"]


def test_url_features_and_verdicts_by_definition(spark):
    import pyarrow as pa

    given = [u or "" for u in ODD_URLS]
    suffixes = {"1 com": 0.9, "2 d.org": 0.8, "s en": 0.7, "e gz": 0.6, "p a": 0.5, "1 ": 0.4}
    got = urls.features(pa.array(given), suffixes, 0.25)
    assert np.allclose(got, [plain_features(u, suffixes, 0.25) for u in given])
    sample = [(f"http://h{i % 7}.{'bad' if i % 3 else 'good'}.org/{i % 5}/x?i={i}", int(i % 3 > 0)) for i in range(300)]
    trees = urls.train(sample)
    for u, p in zip(given, trees.blocked(given), strict=True):
        x, margin = plain_features(u, trees.suffixes, trees.prior), trees.base
        for feature, threshold, leaf in trees.nodes:
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
            margin += leaf[at - len(feature)]
        assert abs(p - 1 / (1 + math.exp(-margin))) < 1e-9
    rows = [(i, u, 1.0) for i, u in enumerate([*ODD_URLS, ODD_URLS[5]])]
    judged = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, blocked double"), trees).collect()
    of = dict(zip(given, trees.blocked(given), strict=True))
    assert sorted((r.page_id, r.blocked) for r in judged) == [(i, of[u or ""]) for i, u, _ in rows]
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert q08_urls.verdicts(empty).count() == 0


def test_held_out_urls_are_judged_as_the_rules_do(spark):
    """Trees that learn from three quarters of the URLs that rules judge, on the rest."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("url").distinct()
    ruled = pages.select("url", urls.rule(urls.host(F.col("url")), urls.path(F.col("url")), q08_urls.RULES).alias("fit")).where("fit is not null")
    ruled = ruled.select("url", (F.col("fit.verdict") == "block").cast("int").alias("block"), (F.crc32("url") % 4 == 0).alias("held"))
    trees = urls.fit(ruled.where("not held"))
    rows = urls.judge(ruled.where("held"), trees).collect()
    assert len(rows) > 10 and np.mean([(r.blocked >= 0.5) == bool(r.block) for r in rows]) >= 0.9


def test_trees_learn():
    rng = np.random.default_rng(0)
    sample = [(f"http://site{i}.test/page/{i}" + ("?a=1&b=2&c=3" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in rng.permutation(600)]
    trees = urls.train(sample[:400])
    assert np.mean((trees.blocked([u for u, _ in sample[400:]]) >= 0.5) == [y for _, y in sample[400:]]) > 0.95
    assert urls.train([]).blocked(["http://x"])[0] < 0.5


# --- 9 ---


def test_warc(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "a\r\n\r\nWARC/1.1\r\nWARC-Type: x", "<p>é</p>", "", "z" * 100000]
    pages = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in q09_warc.round_trip(df, f"file://{tmp_path}/w").collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        top = max(j for j, g in enumerate(html) if (g or "") == (h or ""))
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)
        assert (rows[i].payload_bytes, rows[i].payload_digest, rows[i].record_type, rows[i].refers_to) == want
    empty = q09_warc.round_trip(df.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0
    some = warc.read(spark, f"file://{tmp_path}/w", ["page_id", "warc_type"], (F.col("warc_type") == "response") & (F.col("page_id") > 3))
    assert sorted(r.page_id for r in some.collect()) == sorted(i for i in range(4, 8) if rows[i].record_type == "response")
    assert "payload" not in some.columns
    warc.write(df, f"file://{tmp_path}/big", least=50)
    kinds = Counter(r.warc_type for r in warc.read(spark, f"file://{tmp_path}/big", ["warc_type"]).collect())
    assert kinds == {"response": 8}


def test_warc_odd_rows(spark, tmp_path, monkeypatch):
    """Null ids, ids that share the largest place, clashing names; repeated payloads sent to all or dealt out."""
    rows = [(None, "u", "p", "x"), (5, "u", "p", "y"), (5, "v", "p", "z"), (2, "u", "p", "w"), (None, "u", "alone", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    for most in (0, 100):
        monkeypatch.setattr(warc, "MOST_SENT", most)
        got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in q09_warc.round_trip(df, f"file://{tmp_path}/{most}").collect())
        assert got == sorted([(-1, "revisit", 5, 1), (5, "response", None, 1), (5, "response", None, 1), (2, "revisit", 5, 1), (-1, "response", None, 5)], key=lambda r: (r[0], r[1]))


def records_of(path):
    return [(f.get("x-page-id"), b()) for f, b in warc._walk(str(path))]


def test_warc_files_of_all_kinds(tmp_path):
    """By record with lengths, by record without, compressed as a whole, plain; whole and cut off at every byte."""
    import gzip

    texts = [f"WARC/1.1\r\nX-Page-Id: {i}\r\nContent-Length: {n}\r\n\r\n".encode() + bytes([65 + i]) * n + b"\r\n\r\n" for i, n in enumerate((5, 0, 3000, 40))]
    want = [(str(i), bytes([65 + i]) * n) for i, n in enumerate((5, 0, 3000, 40))]
    made = {
        "own.warc.gz": b"".join(map(warc.member, texts)), "each.warc.gz": b"".join(map(gzip.compress, texts)),
        "whole.warc.gz": gzip.compress(b"".join(texts)), "plain.warc": b"".join(texts), "mixed.warc.gz": warc.member(texts[0]) + b"".join(map(gzip.compress, texts[1:])),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
        assert records_of(tmp_path / name) == want, name
        assert [f["x-page-id"] for f, _ in warc._walk(str(tmp_path / name))] == ["0", "1", "2", "3"]
    for name in ("own.warc.gz", "plain.warc"):
        for cut in range(0, len(made[name]), 7):
            (tmp_path / f"cut-{name}").write_bytes(made[name][:cut])
            got = records_of(tmp_path / f"cut-{name}")
            assert got[: len(want)] == want[: len(got)] or (got[-1][1] is None and got[:-1] == want[: len(got) - 1])


def test_warc_skips_what_is_turned_down(tmp_path):
    """Of members that aren't asked for, no more than a header's worth is read."""
    rng = np.random.default_rng(2)
    body = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    text = f"WARC/1.1\r\nX-Page-Id: 1\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(warc.member(text) * 5)
    read = []

    class Counting:
        def __init__(self, raw):
            self.raw = raw

        def read(self, n):
            out = self.raw.read(n)
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.raw, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.raw.close()

    real = warc._open
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc, "_open", lambda p: Counting(real(p)))
        assert len(list(warc._walk(str(tmp_path / "a.warc.gz")))) == 5
    assert sum(read) < 10_000


# --- 10 ---


def test_language_model(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows = by_id(q10_lm.scored(spark.createDataFrame(docs, "doc_id bigint, text string")))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for i, t in docs}
    counts = Counter(w for i, own in words.items() if zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in words.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    apart = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert len(q10_lm.scored(odd).collect()) == len(TEXTS) + 2 and q10_lm.scored(none).count() == 0


@pytest.mark.parametrize("fan", [12, 2])
def test_language_model_by_definition(spark, monkeypatch, fan):
    """Scores from plain counts and the learned weights, through one exchange and through several; keys of text."""
    monkeypatch.setattr(lm, "FAN_BITS", fan)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 3000)
    docs = [(f"d{r.doc_id}", r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()] + [("null", None), ("empty", "")]
    fold = lambda i: zlib.crc32(i.encode()) % 10
    counted = lm.counted(spark.createDataFrame(docs, "doc_id string, text string").repartition(5), F.crc32(F.col("doc_id")) % 10)
    model = lm.learn(counted)
    found = {r.key: r for r in lm.score(counted, model, T.StringType()).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for i, t in docs}
    single, pair = Counter(), Counter()
    for i, own in words.items():
        if fold(i):
            single.update(own)
            pair.update(zip([None, *own[:-1]], own, strict=True))
    assert model.tokens == sum(single.values()) and model.types == len(single) and set(found) == set(words)
    for i, own in words.items():
        want = 0.0
        for before, w in zip([None, *own[:-1]], own, strict=True):
            context = single[before]
            share = model.weights[min(context.bit_length(), lm.BUCKETS_OF_CONTEXT - 1)]
            want += math.log10(share[0] * pair[before, w] / max(1, context) + share[1] * single[w] / model.tokens + share[2] / (model.types + 1))
        assert abs(found[i].score - want) < 1e-6 * max(1, abs(want)), i


def test_mixture_is_a_distribution(spark):
    """Probabilities of all words and of an unknown one, after each context, sum to one."""
    docs = spark.createDataFrame([(i, f"a b c a {'b' if i % 2 else 'd'}") for i in range(40)], "doc_id bigint, text string")
    counted = lm.counted(docs, F.lit(1) + (F.col("doc_id") % 5 == 0).cast("int") * 8)
    model = lm.learn(counted)
    pairs, singles = Counter(), Counter()
    for i in range(40):
        own = [None, "a", "b", "c", "a", "b" if i % 2 else "d", None]
        pairs.update(zip(own, own[1:]))
        singles.update(own[1:])
    for h in singles:
        p = sum(float(model.probability(np.array([pairs[h, w]]), np.array([singles[h]]), np.array([singles[w]]))[0]) for w in [*singles, "unknown"])
        assert abs(p - 1) < 1e-9


# --- the pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = table(spark, sf, "documents").withColumn("_digest", F.lit("mine")).withColumn("score", F.lit(1))
    extra = spark.createDataFrame([(None, None, "xx", None, None, "mine", 1), (None, "kept text without an id", None, None, None, "mine", 1)], docs.schema)
    docs = docs.unionByName(extra)
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, left, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        before = Counter(map(tuple, left.collect()))
        assert not Counter(map(tuple, rows)) - before, name
        left = spark.createDataFrame(rows, docs.schema)
        assert 0 < len(rows) <= sum(before.values())
    assert pipeline.STAGES[-1][1](spark, left, sf).count() == left.count()

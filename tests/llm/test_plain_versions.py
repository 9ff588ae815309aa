"""Operators against plain versions that share no code with them, and the cases that once went wrong."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, quality, secrets, suffix_dedup, toxicity

from .test_operators import frame

MASK = (1 << 64) - 1


def spread(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def hash_of(data):
    return spread(sum(spread(b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) & MASK)


def some_texts():
    r = random.Random(12)
    texts = ["", None, "a", "| || ,,", "Aé B\nB\n\nTWO two. Ünd!\n", "x" * 40 + " yy yy yy", ",,,"]
    return texts + ["".join(r.choice("abc DE1 |.,\n\té€") for _ in range(r.randint(1, 400))) for _ in range(40)]


def plain_features(text):
    data = (text or "").encode()
    words, lines, size = re.findall(rb"[^ \t\n\r\x0b\x0c]+", data), re.findall(rb"[^\n]+", data), max(len(data), 1)
    sign = re.compile(rb"[^ \t\n\r\x0b\x0cA-Za-z0-9\x80-\xff]")
    n = lambda pattern: len(re.findall(pattern, data))
    signs, sentence, w, ln = n(sign), n(rb"[.,;:'\"-]"), max(len(words), 1), max(len(lines), 1)
    runs = sum(bool(sign.match(data, i) and sign.match(data, i - 1)) for i in range(1, len(data)))
    shout = sum(len(re.findall(rb"[A-Z]", x)) >= 2 and not re.search(rb"[a-z]", x) for x in words)
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / w, sum(len(x) > 14 for x in words) / w, n(rb"[A-Z]") / size, n(rb"[0-9]") / size, n(rb"[ \t\n\r\x0b\x0c]") / size,
        (signs - sentence) / size, sentence / size, signs / w, runs / size, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, max(Counter(words).values(), default=0) / w,
        len(words) / ln, len(set(lines)) / ln, data.count(b"|") / w, shout / w, n(rb"[\x80-\xff]") / size, sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines) / ln,
    ]


def test_quality_by_plain_sums():
    texts = some_texts()
    x = quality.features(pa.array(texts))
    assert np.allclose(x, [plain_features(t) for t in texts])
    y = np.array([(len(t or "") + (t or "").count("a")) % 3 == 0 for t in texts], np.int64)
    m = quality.fit(x, y)
    for row, score in zip(x, m.score(x), strict=True):
        total = m.base
        for j, (edges, table) in enumerate(zip(m.edges, m.tables, strict=True)):
            total += table[sum(e <= row[j] for e in edges)]
        for (i, j), table in zip(m.pairs, m.pair_tables, strict=True):
            total += table[sum(e <= row[i] for e in m.pair_edges[i])][sum(e <= row[j] for e in m.pair_edges[j])]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def plain_toxicity(net, text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    if not words:
        return 0.0
    sig = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(float) for k, v in net.p.items()}
    best = -np.inf
    starts = {0} | {min(s, len(words) - 32) for s in range(0, max(len(words) - 32, 0) + 24, 24)} if len(words) > 32 else {0}
    for s in starts:
        xs = []
        for w in words[s : s + 32]:
            marked = b"\x01" + w + b"\x02"
            grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
            xs.append(np.concatenate([p["word"][hash_of(w) >> 48], 4 * np.mean([p["char"][hash_of(g) >> 48] for g in grams], axis=0)]))
        states = np.zeros((len(xs), 16))
        for way, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
            h = np.zeros(8)
            for t in order:
                a, b = xs[t] @ p["x" + way] + p["c" + way], h @ p["h" + way]
                z, r = sig(a[:8] + b[:8]), sig(a[8:16] + b[8:16])
                h = np.tanh(a[16:] + r * b[16:]) * (1 - z) + z * h
                states[t, slice(0, 8) if way == "f" else slice(8, 16)] = h
        e = np.exp(states @ p["u"])
        best = max(best, float((e / e.sum()) @ states @ p["w"] + p["b"][0]))
    return 1 / (1 + math.exp(-(net.scale * best + net.shift)))


def test_toxicity_by_plain_loops():
    r = random.Random(2)
    words = ["river", "stone", "Walks", "über", "grün", "l1ght", "x"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 31, 32, 33, 57, 90]))) + (" grumok" if i % 3 == 0 else "") for i in range(60)]
    net = toxicity.fit([(t, int(i % 3 == 0)) for i, t in enumerate(texts)])
    texts += ["", None, "...", "A" * 300]
    assert np.allclose(toxicity.score_piece(net, pa.array(texts)), [plain_toxicity(net, t) for t in texts], atol=2e-4)


def test_long_texts_are_split_between_words():
    texts = ["ab cd " * 60_000, "é" * 200_000 + " xy", "", "Q"]
    words = toxicity.Words(texts)
    assert [len(d) for d in words.docs] == [120_000, 2, 0, 1]
    assert len(words.buckets) == 5


def test_long_texts_are_fitted(spark):
    """Toxic documents are found though all labelled ones are long."""
    r = random.Random(3)
    body = lambda n: " ".join(r.choice(["river", "stone", "walks", "under", "green"]) + str(r.randint(0, 99)) for _ in range(n))
    rows = [(i, body(2500) + (" grumok grumar grumelt " if i % 2 else " ") + body(2500)) for i in range(60)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    net = toxicity.train(docs, labels)
    assert not isinstance(net, float)
    scores = toxicity.score_piece(net, pa.array([t for _, t in rows]))
    assert ((scores >= 0.5) == (np.arange(60) % 2 == 1)).mean() > 0.9
    assert quality.train(docs, labels).constant is None
    assert isinstance(toxicity.train(docs, labels.where("false")), float)


def plain_secrets(text):
    """The contract's base patterns by hand-run scanning, and entropy by counting every window anew."""
    spans, low = [], text.lower()
    cues, i = ("password", "passwd", "secret", "token", "api_key", "apikey"), 0
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while i < len(text):
        cue = next((c for c in cues if low.startswith(c, i) and text[i : i + len(c)].isascii()), None)
        end = None
        if cue:
            for quote in (1, 0):
                at = i + len(cue)
                if quote and text[at : at + 1] not in ("'", '"'):
                    continue
                at += quote
                while text[at : at + 1] == " ":
                    at += 1
                if text[at : at + 1] not in (":", "=") or not text[at : at + 1]:
                    continue
                at += 1
                while text[at : at + 1] == " ":
                    at += 1
                if text[at : at + 1] in ("'", '"') and text[at : at + 1] and text[at + 1 : at + 2] in value and text[at + 1 : at + 2]:
                    at += 1
                b = at
                while b < len(text) and text[b] in value:
                    b += 1
                if b > at:
                    end = b
                    if b - at >= 12:
                        spans.append((i, 0, b))
                    break
        i = end or i + 1
    for kind, head, members, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(text):
            b = i + len(head)
            while text.startswith(head, i) and b < len(text) and text[b] in members:
                b += 1
            if text.startswith(head, i) and b > i + len(head):
                if b - i >= least:
                    spans.append((i, kind, b))
                i = b
            else:
                i += 1
    base = sorted(spans)
    marks = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        run = m[0]
        if len(run) < 24 or secrets.ALLOWED.fullmatch(run):
            continue
        least = 3.2 if set(run) <= set("0123456789abcdefABCDEF") else 4.0 if run.isalnum() else 4.1
        covered = set()
        for a in range(len(run) - 23):
            h = -sum(c / 24 * math.log2(c / 24) for c in Counter(run[a : a + 24]).values())
            if h >= least - 1e-9:
                covered |= set(range(a, a + 24))
        at = sorted(covered)
        for j, a in enumerate(at):
            if not j or at[j - 1] != a - 1:
                b = a
                while b + 1 in covered:
                    b += 1
                s, e = a + m.start(), b + 1 + m.start()
                if not any(x <= s and e <= y for x, _, y in base):
                    marks.add((s, 3, e))
    return base, sorted(base + list(marks))


def test_secrets_by_plain_scanning(spark):
    r = random.Random(8)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "hunter2hunter2", "é", "\n", "Zk3vQ9xLw7Rt2Yp8Nb4Mc6Hd1Fg5Js0A", "f3a91c0d5e7b2846", "Ab-9_x/Q+", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(600)]
    kinds = ("assign", "access", "hex", "entropy")
    got = {x["doc_id"]: [(s["start"], kinds.index(s["kind"]), s["end"]) for s in x["spans"]] for x in secrets.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base, spans = plain_secrets(t)
        assert [s for s in got[i] if s[1] < 3] == base, t
        assert got[i] == spans, t
        assert secrets.digest(t)[3] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_frequent_gram_is_split(spark):
    """A line that most documents share, in the midst of different words: the result is that of the plain version."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, long = word(60), word(180)
    rows = [(i, word(r.randint(0, 130)) + (line if i % 3 else long) + word(r.randint(20, 130))) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)]
    want = suffix_dedup.digest(rows)
    docs = frame(spark, rows, 5)
    _, hot = suffix_dedup._repeated(suffix_dedup._columns(docs), 3)
    assert len(hot)
    for x in suffix_dedup.removed(docs).collect():
        assert (sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"])) == want[x["doc_id"]][1:3]


def vectors_of(kind):
    r = np.random.default_rng(4)
    if kind == "clustered":
        return r.standard_normal((20, 24))[r.integers(0, 20, 3000)] + 0.05 * r.standard_normal((3000, 24))
    if kind == "repeated":
        return r.standard_normal((150, 16))[r.integers(0, 150, 3000)]
    if kind == "random":
        return r.standard_normal((3000, 48))
    return r.standard_normal((3000, 16)) * np.exp(r.standard_normal((3000, 1)))


@pytest.mark.parametrize("kind", ["clustered", "repeated", "random", "lengths"])
def test_ann_recall(kind):
    v = vectors_of(kind)
    ids = np.arange(len(v))
    index = ann.Index(ids, v)
    hit = total = 0
    for i in range(0, len(v), 60):
        s = v @ v[i]
        s[i] = -np.inf
        least = np.sort(s)[-20]
        found, scores, _ = index.search(v[i], i, 20)
        hit, total = hit + int((s[found] >= least).sum()), total + 20
        again = index.search(v[i], i, 20)
        assert i not in found and (again[0] == found).all() and np.allclose(scores, s[found])
    assert hit >= 0.9 * total


def test_ann_of_odd_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.standard_normal(4)]) for i in range(60)]
    rows[0], rows[20], rows[40] = (0, [1e-170, 2e-170, 0.0, 0.0]), (20, [1e160, 0.0, 0.0, 1.0]), (40, [5e-324, 0.0, 0.0, 0.0])
    rows += [(20, [1.0, 1.0, 1.0, 1.0]), (7, [9.0, 9.0, 9.0, 9.0]), (90, [0.0] * 4), (91, [float("nan")] * 4), (92, None), (100, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    by = {}
    for x in got:
        by.setdefault(x["query_id"], []).append(x)
    assert set(by) == {0, 20, 40}
    for own, found in by.items():
        assert sorted(x["rank"] for x in found) == list(range(1, 21)) and len({x["vec_id"] for x in found}) == 20 and own not in {x["vec_id"] for x in found}
    q = min(v for i, v in rows if i == 20)
    best: dict = {}
    for i, v in rows[:62]:
        if i != 20:
            best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(q, v, strict=True)))
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    assert [x["vec_id"] for x in sorted(by[20], key=lambda x: x["rank"])] == want


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(900)], "vec_id long, embedding array<float>")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = ann.nearest(rows.repartition(parts), rows.where("vec_id % 20 = 0"), block_rows=256)
            found.append(sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 45 * 20


@pytest.mark.parametrize("dim", [64, 128, 384])
def test_recall_in_large_blocks(dim):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((2 * ann.BLOCK_ROWS, dim))
    index, hit, queries = ann.Index(np.arange(len(v)), v), 0, range(0, len(v), len(v) // 40)
    for i in queries:
        scores = v @ v[i]
        scores[i] = -np.inf
        hit += len(set(np.argpartition(-scores, 20)[:20].tolist()) & set(index.search(v[i], i, 20)[0].tolist()))
    assert hit >= 0.95 * 20 * len(queries)

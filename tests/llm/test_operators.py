"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, bpe, decontaminate, graph, jaccard, labels, licenses, quality, secrets, suffix_dedup, toxicity, url_filter
from codeloom.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, parts=3, schema=SCHEMA):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, schema).repartition(parts)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "x1", "y", "zeta,", "the", "of"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 60)) for _ in range(r.randint(1, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        t = r.choice(base)
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w) if r.random() < 0.7 else t))
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "one"), (n + 4, "one"), (n + 5, "One two"), (n + 6, "long " * 30_000)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(200, i) for i in range(201, 260)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["root"] for x in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] and e[0] is not None for e in edges)}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 16))
    rows = [(i, [float(x) for x in v[i]], "z") for i in range(600)]
    rows += [(601, None, "z"), (602, [0.0] * 16, "z"), (603, [float("nan")] * 16, "z"), (604, [1.0, None] + [0.0] * 14, "z"), (605, [1.0, 2.0], "z"), (606, [float("inf")] * 16, "z"), (7, rows[7][1], "z"), (None, rows[3][1], "z"), (610, rows[9][1], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = total = 0
    ids = np.array([*range(600), 610])
    vectors = np.concatenate([v, v[9:10]])
    for q in range(0, 600, 20):
        s = vectors @ v[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - vectors[np.flatnonzero(ids == r["vec_id"])[0]] @ v[q]) < 1e-9 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += len({r["vec_id"] for r in own} & {int(ids[i]) for i in best})
        total += 20
    assert hits / total >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert len(few) == 4
    assert ann.nearest(df.where("vec_id < 0"), df).count() == 0
    assert {r["query_id"] for r in got} <= {*range(0, 600, 20)}


def labelled(spark):
    r = random.Random(4)
    words = ["river", "stone", "walks", "under", "green", "light", "paper", "over", "house", "again"]
    docs, marks = [], []
    for i in range(160):
        w = [r.choice(words) + r.choice(["", "s", "ed"]) for _ in range(r.randint(10, 120))]
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumok", "grumar", "grumelt"]))
        text = " ".join(w) + "."
        docs.append((i, "!! ".join(text.upper().split()) if junk else text))
        marks.append((i, int(not junk), int(toxic)))
    return frame(spark, [*docs, (900, None), (901, ""), (902, "... !!"), (0, docs[0][1])]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, marks = labelled(spark)
    model = quality.train(docs, marks)
    got = quality.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 164 and all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"] for r in marks.where(labels.fold(5) == 0).collect()}
    right = [(r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 5 != 0) for r in got if r["doc_id"] in held]
    assert sum(right) / len(right) >= 0.9
    plain = {r["doc_id"]: r["score"] for r in got}
    x = quality.features(pa.array(["", None]))
    assert plain[900] == plain[901] == model.score(x)[0]
    empty = quality.train(docs, marks.where("false"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_toxicity(spark):
    docs, marks = labelled(spark)
    net = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    held = [r["doc_id"] for r in marks.where(labels.fold(3) == 1).collect()]
    right = [(got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held]
    assert sum(right) / len(right) >= 0.85
    assert got[900] == got[901] == got[902] == 0.0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, marks.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), net).count() == 0


def test_toxicity_gradients():
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((9, 2 * toxicity.DIM))
    index, length = rng.integers(0, 9, (4, toxicity.WINDOW)), np.array([32, 32, 7, 1])
    y, w = np.array([1, 0, 1, 0]), np.ones(4)
    g, dx = net.gradients(x, index, length, y, w)

    def loss():
        z = net.run(x, index, length).astype(float)
        return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))

    for k in ("u", "w", "hf", "hb", "xf", "cb"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-2
        up = loss()
        net.p[k][at] = keep - 1e-2
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        start, length, own = toxicity.windows_of(np.zeros(n, np.int64), 1)
        assert {i for a, k in zip(start, length, strict=True) for i in range(a, a + k)} == set(range(n))


def test_decontaminate(spark):
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randint(0, 30)}" for _ in range(r.choice([3, 12, 13, 20, 40])))) for i in range(20)] + [(50, ""), (51, None), (None, "w1 w2"), (3, "another text here")]
    texts = []
    for i in range(50):
        body = " ".join(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 60)))
        pick = r.choice(items[:20])[1].split()
        texts.append((i, body + ", " + "-".join(pick).upper() if r.random() < 0.6 else body))
    texts += [(90, None), (91, ""), (92, "ÀB cd"), (0, texts[0][1])]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    usable = [x for x in items if x[0] is not None]
    for limit in (decontaminate.SLICE_BYTES, 400):  # one slice; several
        got = decontaminate.scan(docs, bench, slice_bytes=limit).collect()
        assert len(got) == len(texts)
        for row in got:
            n_words, n_hit, n_items, sha, bad = decontaminate.digest(dict(texts)[row["doc_id"]], usable)
            assert (row["n_words"], row["n_hit"], len(row["items"])) == (n_words, n_hit, n_items)
            assert hashlib.sha256(",".join(sorted(map(str, row["items"]))).encode()).hexdigest() == sha
    assert decontaminate.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.scan(docs.where("false"), bench).count() == 0


def test_suffix_dedup(spark, tmp_path):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ñé\n") for _ in range(r.randint(80, 400))) for _ in range(12)]
    rows = []
    for i in range(80):
        rows.append((i, "".join(r.choice([r.choice(base)[r.randint(0, 60) :], "".join(r.choice("abcdefgh ñé") for _ in range(r.randint(0, 150))), "a" * r.randint(0, 150), "xyz " * r.randint(0, 60), ""]) for _ in range(r.randint(0, 6)))))
    rows += [(200 + i, rows[5][1]) for i in range(6)] + [(300, None), (301, "x" * 99), (302, "x" * 100), (303, "x" * 3000)]
    frame(spark, rows, 7).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()
    want = suffix_dedup.digest(rows)
    assert len(got) == len(rows)
    assert all(tuple(x)[1:] == want[x["doc_id"]] for x in got)
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.removed(none).count() == 0
    twice = suffix_dedup.removed(frame(spark, [(None, "q" * 150), (1, "q" * 150)])).collect()
    assert {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in twice} == {1: [(1, 150)], None: [(0, 150)]}


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_dedup_of_equal_rows(spark, parts):
    r = random.Random(4)
    once, twice = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (300, 150))
    rows = [(1, once), (1, once), (2, twice + once[:120] + twice), (2, twice + once[:120] + twice), (None, "q" * 150), (None, "q" * 150), (None, once), (None, once)]
    got = suffix_dedup.removed(frame(spark, rows, parts)).collect()
    want = {(1, once): [], (2, rows[2][1]): [(150, 420)], (None, "q" * 150): [(1, 150)], (None, once): [(0, 300)]}
    assert len(got) == len(rows)
    assert all([tuple(s) for s in x["spans"]] == want[x["doc_id"], x["text"]] for x in got)


def test_anchor_chunks(monkeypatch):
    r = random.Random(8)
    data = np.frombuffer("".join(r.choice("abcd") for _ in range(5000)).encode(), np.uint8)
    offsets = np.array([0, 50, 1200, 1200, 1330, 5000])

    def owned():
        out = {}
        for h, place, low, high, doc in zip(*suffix_dedup.text_anchors(data, offsets), strict=True):
            for p in range(low, high + 1):
                assert p not in out and offsets[doc] <= p and p + 100 <= offsets[doc + 1]
                out[p] = (h, place)
        return out

    whole = owned()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    assert owned() == whole
    assert set(whole) == {p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 99)}


def test_loser_tree():
    r = random.Random(6)
    rows = [bytes(r.choice(b"ab") for _ in range(100)) if r.random() < 0.5 else b"a" * r.randint(0, 99) + b"b" * 100 for _ in range(200)]
    rows = [x[:100] for x in rows]
    for k in (1, 2, 5, 8):
        runs = []
        for i in range(k):
            own = sorted(rows[i::k])
            shared, _ = suffix_dedup._front_coded(np.stack([np.frombuffer(x, np.uint8) for x in own]))
            runs.append([(int(s), x, x) for s, x in zip(shared, own, strict=True)])
        got = list(suffix_dedup.LoserTree(runs).merge())
        assert [v for _, v in got] == sorted(rows)
        for (_, a), (s, b) in zip(got, got[1:], strict=False):
            assert s == next((i for i in range(100) if a[i] != b[i]), 100)


def test_urls(spark):
    link = '<link rel="canonical" href="{}"><meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://WWW.a.com/de/x", "", "com/de/", "block"), (2, "http://b.net/1", link.format("https://a.com/de/x", ""), None, "block"), (3, "http://c.net/1", link.format("http://b.net/1/?q", "x"), None, "block"),
        (4, "http://d.org/1", link.format("http://b.net/1", ""), "org/", "allow"), (5, "http://e.net", "", None, "allow"), (6, None, None, None, "allow"), (7, "no scheme", "", None, "allow"),
        (8, "https://x.example.org/es/1", "", "example.org/es/", "block"), (9, "https://x.example.org/en/17?a", "", "example.org/en/1", "block"), (10, "https://example.org", "", None, "allow"), (10, "https://example.org", "", None, "allow"),
        (11, "http://f.net/a", '<meta http-equiv=refresh content="1;url=http://g.net/b">', None, "block"), (12, "http://h.net", '<link href="http://g.net/b" rel=canonical>', None, "block"), (13, "http://h.net/", link.format("http://z.com/de/", ""), None, "block"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("verdict", F.lit("x"))
    got = url_filter.judge(spark, pages).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got if r["page_id"] != 10) == sorted((r[0], r[3], r[4]) for r in rows if r[0] != 10)
    assert sum(r["page_id"] == 10 for r in got) == 2
    first = next(r for r in got if r["page_id"] == 1)
    assert (first["host"], first["path"]) == ("www.a.com", "/de/x")
    assert url_filter.judge(spark, pages.where("false")).count() == 0


def test_relative_urls(spark):
    link, refresh = '<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; url={}'>"
    rows = [
        (1, "http://a.com/en/p", link.format("/de/y"), "block"), (2, "http://b.net/q/r", refresh.format("../s"), "block"), (3, "http://b.net/s", link.format("//a.com/de/z"), "block"), (4, "http://c.net/1", link.format("javascript:void(0)"), "allow"),
        (5, "http://c.net/1/2", link.format("/r?u=http://a.com/de/"), "allow"), (6, "http://d.net/a/b", link.format("c?x#y"), "block"), (7, "http://d.net/a/c", link.format("https://a.com/de/x"), "block"), (8, "http://e.net", link.format("./de"), "allow"),
        (9, "http://f.net", refresh.format("x/./y/../z"), "block"), (10, "http://f.net/x/z", link.format("HTTP://g.com/de/"), "block"), (11, "http://h.net/i/", link.format("#top") + refresh.format("?again"), "allow"), (12, "http://k.com/en/a", refresh.format("../../de/.."), "allow"),
        (13, "http://k.com/fr/a", refresh.format("/de/x/.."), "allow"), (14, "http://l.com/a", refresh.format("/de/x/.."), "block"), (15, None, link.format("/de/y"), "allow"),
        (16, "http://www.com/z", link.format("http://www.com/y"), "allow"), (17, "http://m.com/z", link.format("/de/q"), "block"), (18, "http://m.n.net/z", "", "block"), (19, "http://n.net/z/", '<LINK rel="alternate canonical" href=/a/b//../../../../w&amp;x>', "block"),
        (20, "http://www.n.net/w&x", link.format("https://a.com/de/x?a=1&amp;b=2"), "block"), (21, "http://o.net/1", "<link rel=canonicals href=http://a.com/de/x>", "allow"), (22, "http://o.net/2", "<link rel='canonical'>", "allow"),
        (23, "http://p.net/1", '<base href="http://a.com/"><link rel=canonical href="de/1">', "block"), (24, "http://a.com/p/q", '<BASE target=_top href="/x/y/"><base href="/de/">' + link.format("../../de/r"), "block"), (25, "http://p.net/2", "<base href='//a.com/z/'>" + link.format("../de/1"), "block"),
        (26, "http://a.com/p/r", "<base href=mailto:x>" + link.format("/de/1"), "block"), (27, "http://p.net/3", "<!-- " + link.format("http://a.com/de/x") + "\n-->", "allow"), (28, "http://p.net/4", "<script>x = '" + link.format("http://a.com/de/x") + "'</script >" + link.format("5"), "allow"),
        (29, "http://p.net/6", "<style>" + link.format("http://a.com/de/x"), "allow"), (30, "http://p.net/7", "<!-- <base href=http://q.net/> -->" + link.format("http://a.com/de/x"), "block"), (31, "http://a.com/p/s", "<base href=http:///x/>" + link.format("/de/2"), "block"), (32, "http://a.com/p/t/", "<base href='..'>" + link.format("de/../../de/k"), "block"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {tuple(r) for r in url_filter.judge(spark, pages).collect()}
    assert {r[0]: r[4] for r in got} == {r[0]: r[3] for r in rows}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert set(con.sql(url_filter.ORACLE_SQL).fetchall()) == got


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.default_vocabulary())


def test_bpe_equals_library(codec):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(1)
    texts = ["", " ", "a", "don't  stop\n\n now ", "日本語テキスト", "\U0001f600\U0001f600 x", "é" * 500, "ab" * 4000, " " * 300 + "x"]
    texts += ["".join(r.choice("abeinrst hoE1ñß中\U0001f600'\n") for _ in range(r.randint(1, 80))) for _ in range(400)]
    for t in texts:
        ids = codec.encode_text(t)
        assert [int(x) for x in ids.split()] == enc.encode_ordinary(t)
        assert codec.decode_text(ids) == t
    for t in texts[-50:]:  # states made for every arc
        out, state = [], 0
        for b in t.encode():
            state, emitted = codec.machine.step(state, b)
            out += emitted
        piece = t.encode()
        assert [*out, *codec.machine.finish(state)] == codec.machine.encode(piece) or piece in codec.machine.ranks


def test_bpe_lookahead_is_bounded(codec):
    r = random.Random(2)
    state = 0
    for _ in range(5000):
        state, _ = codec.machine.step(state, r.choice(b"theingaton"))
        assert len(codec.machine.views[state][0]) < 40


def test_utf8_stream():
    data = "aé中\U0001f600z".encode() * 3
    for size in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + size]) for i in range(0, len(data), size)) + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"\xff\xc3") + s.close() == b"\xff\xc3".decode("utf-8", "replace")


def test_bpe_pieces_met_again_are_not_encoded_again(codec, monkeypatch):
    own, met = bpe.codec(*bpe.default_vocabulary(), *bpe.ROOMY), []
    encode = own.lanes.encode
    monkeypatch.setattr(own.lanes, "encode", lambda pieces: met.append(len(pieces)) or encode(pieces))
    texts = [" ".join(f"q{i:x}" for i in range(at, at + 20_000)).translate(str.maketrans("0123456789", "ghijklmnop")) for at in range(1 << 16, 300_000, 20_000)]
    first = own.encode_texts(texts[:1])
    for text in texts[1:]:
        own.encode_texts([text])
    held = len(met)
    assert own.encode_texts(texts[:1]) == first == codec.encode_texts(texts[:1])
    assert len(met) == held > 5
    assert own.machine.kept == 2 * bpe.CACHE_STATES


def test_bpe_tables(spark):
    docs = frame(spark, [(1, "Hello wörld"), (2, None), (3, ""), (3, "")]).withColumn("ids", F.lit("x"))
    coded = bpe.encode(docs)
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(coded).collect()} == {(1, "Hello wörld"), (2, ""), (3, "")}
    assert bpe.round_trip(docs).where("doc_id = 2").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["n_tokens"] for r in bpe.tokenized(docs).orderBy("doc_id").collect()] == [bpe.round_trip(docs).where("doc_id = 1").first()["n_tokens"], 0, 0, 0]
    assert bpe.tokenized(docs.where("false")).count() == 0


def test_secrets(spark):
    key = "Zk3vQ9xLw7Rt2Yp8Nb4Mc6Hd1Fg5Js0A"
    texts = [
        (1, f'é password = "{key}" end'), (2, "API_KEY:abcdefghijkl secret=short tokEn = aaaaaaaaaaaa"), (3, "AKIA" + "A1B2C3D4E5F6G7H8"), (4, "0123456789abcdef0123 deadbeef"), (5, f"see {key}{key} there"),
        (6, "123e4567-e89b-12d3-a456-426614174000 internationalization-and-more-words"), (7, None), (8, ""), (9, "aaaa" * 3000 + key), (9, "aaaa" * 3000 + key), (10, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"),
    ]
    docs = frame(spark, texts).withColumn("spans", F.lit(1))
    got = secrets.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans) == secrets.digest(dict(texts)[r["doc_id"]])[4]
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in got}
    assert kinds[1] == ["assign"] and kinds[2] == ["assign", "assign"] and kinds[3] == ["access"] and kinds[4] == ["hex"] and kinds[5] == ["entropy"] and kinds[6] == [] and kinds[7] == kinds[8] == [] and kinds[10] == ["assign"]
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert clean[1] == ('é [SECRET]" end', 15) and clean[6][0] == dict(texts)[6] and clean[7][0] is None
    assert secrets.scan(docs.where("false")).count() == 0


def test_entropy_counts():
    import math
    from collections import Counter

    r = random.Random(7)
    run = "".join(r.choice("abcdABCD0123xyzw") for _ in range(200)) + "a" * 60
    want = [i for i in range(len(run) - 23) if -sum(c / 24 * math.log2(c / 24) for c in Counter(run[i : i + 24]).values()) >= 3.2 - 1e-12]
    got = set()
    for a, b in secrets.entropy_windows(run, 24, 3.2):
        got |= set(range(a, b))
    assert got == {k for i in want for k in range(i, i + 24)}


def test_licenses(spark):
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert licenses.predict(t)[0] == family, t
    assert all(licenses.predict(t) is None for t in licenses.OTHER)
    texts = [(1, "Some prose.\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "the licence of a poet"), (4, None), (5, ""), (6, "x " * 50_000 + "\nAll rights reserved."), (1, "Some prose.\nReleased under the MIT License.\nmore")]
    docs = frame(spark, texts).withColumn("families", F.lit(0))
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_licenses"], r["families"], r["spans"]) == licenses.digest(dict(texts)[r["doc_id"]])
    assert {r["families"] for r in got} == {"mit", "cc-by-nc", "proprietary", ""}
    assert licenses.scan(docs.where("false")).count() == 0


def test_licenses_over_lines(spark):
    notice = (
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU Affero General Public License for more details.\n\n"
        "You should have received a copy of the GNU Affero General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."
    )
    lesser = notice.replace("Affero", "Lesser").replace("program", "library")
    long = "word " * 60
    r = random.Random(5)
    parts = [*notice.split("\n"), *lesser.split("\n"), "", "  ", "#", long, long + "Licensed under the MIT license.", "Licensed under the MIT license.", "Licensed under CC BY 4.0."]
    texts = {
        1: notice, 2: lesser, 3: "# " + notice.replace("\n", "\n# "), 4: "Text available under CC BY-SA 4.0", 5: "Distributed under the terms of the GPL", 6: "Licensed under the MIT license.\nLicensed under the Apache License, Version 2.0.",
        7: long + "\nReleased under the\n\nMIT License.", 8: "The copy distributed under the table\nis available to the public.", 9: "\n".join(["x"] * 9 + [notice]), 10: notice.replace(" ", "\n", 3), 11: "\n",
    } | {20 + i: "\n".join(r.choice(parts) for _ in range(r.randint(1, 30))) for i in range(25)}
    got = {x["doc_id"]: tuple(x)[1:] for x in licenses.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {i: licenses.digest(t) for i, t in texts.items()}
    want = {1: "0:agpl,5:agpl,10:agpl", 2: "0:lgpl,5:lgpl,10:lgpl", 3: "0:agpl,5:agpl,10:agpl", 4: "0:cc-by-sa", 5: "0:gpl", 6: "0:mit,1:apache", 7: "", 8: "", 9: "9:agpl,14:agpl,19:agpl", 11: ""}
    assert {i: got[i][2] for i in want} == want


def brute_components(texts):
    import re

    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            x = len(a & b)
            if a and b and 100 * x >= 80 * (len(a) + len(b) - x):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed, least", [(1, 16), (2, 2)])
def test_jaccard(spark, seed, least, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_HOT", least)  # 2: most n-grams count as frequent
    texts = corpus(seed)
    docs = frame(spark, texts, 5).withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "a b c d e f g h i j k l"
    rows = jaccard.near_duplicates(frame(spark, [(4, t), (4, t), (None, t), (None, "x y z"), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (9, 9)]
    near = jaccard.near_duplicates(frame(spark, [(7, " ".join(f"w{i}" for i in range(80))), (None, " ".join(f"w{i}" for i in range(82)))])).collect()
    assert {r["component_id"] for r in near} == {7}
    kept = jaccard.one_of_each(frame(spark, [(4, t), (4, t), (None, t), (None, "x y z"), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept if r["text"]) == [(-1, "x y z"), (4, t)] and len(kept) == 3


def test_scratch_is_shared(spark):
    df = scratch(spark, spark.range(3), "t")
    assert df.count() == 3 and all(f.startswith(spark.conf.get("spark.checkpoint.dir")[:5]) for f in df.inputFiles())

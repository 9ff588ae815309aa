"""Language-model scores, the audit of filters and resampling, each against a plain version; nulls, long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import filter_audit, lattice_lm, resample

from .test_operators import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[^\x20\x09-\x0D]+"


def segmentations(text, pieces):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield [text[:n], *rest]


def small_vocabulary():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab", "é", "bé"]
    weights = np.log(np.array([3, 2, 2, 1, 1, 2, 1, 1, 1, 1] + [0.01] * 256 + [0.5]))
    return lattice_lm.Vocabulary(pieces, weights - np.logaddexp.reduce(weights))


def plain_marginal(vocabulary, word):
    """Sum over all segmentations, and the expected uses of each piece, by listing them."""
    weight = dict(zip(vocabulary.pieces, vocabulary.log_weights, strict=False))
    for c in set("▁" + word) - set(vocabulary.pieces):
        weight[c] = sum(vocabulary.log_weights[len(vocabulary.pieces) + b] for b in c.encode())
    total, uses = 0.0, defaultdict(float)
    for found in segmentations("▁" + word, weight):
        p = math.exp(sum(weight[x] for x in found))
        total += p
        for x in found:
            uses[x] += p
    return math.log(total), {x: n / total for x, n in uses.items()}


def test_marginals_and_expected_uses():
    r = random.Random(3)
    vocabulary = small_vocabulary()
    words = ["", "a", "x", "€", "aé€b", *("".join(r.choice("abéx") for _ in range(r.randint(1, 9))) for _ in range(40))]
    counts = [r.randint(1, 5) for _ in words]
    got, expected = lattice_lm.marginals(vocabulary, words, counts)
    want = np.zeros(len(vocabulary.log_weights))
    for word, count, value in zip(words, counts, got, strict=True):
        log_p, uses = plain_marginal(vocabulary, word)
        assert value == pytest.approx(log_p)
        for piece, n in uses.items():
            at = [vocabulary.pieces.index(piece)] if piece in vocabulary.pieces else [len(vocabulary.pieces) + b for b in piece.encode()]
            for i in at:
                want[i] += n * count
    assert np.allclose(expected, want)
    assert np.allclose(lattice_lm.marginals(vocabulary, words[::-1])[::-1], got)


def test_long_words_and_parts_of_a_batch(monkeypatch):
    vocabulary, words = small_vocabulary(), ["ab" * 3000, "a", "x" * 500, "", "é" * 40]
    whole = lattice_lm.marginals(vocabulary, words)
    monkeypatch.setattr(lattice_lm, "LATTICE", 7)
    assert np.allclose(lattice_lm.marginals(vocabulary, words), whole) and np.isfinite(whole).all()


def test_vocabulary_of_a_file():
    import public_tokenizers

    v = lattice_lm.load(public_tokenizers.path(lattice_lm.VOCABULARY))
    assert np.logaddexp.reduce(v.log_weights) == pytest.approx(0) and len(v.log_weights) == len(v.pieces) + 257
    assert all("▁" not in p[1:] for p in v.pieces) and v.pieces.index("▁t") < v.pieces.index("▁the")
    assert v.log_weights[v.pieces.index("▁t")] > v.log_weights[v.pieces.index("▁the")]


def test_words_of_texts():
    texts = ["", None, "  A b\x0bC\x1cd\t\n", "\x85x\xa0y", "É Ü", "one\rtwo  three\x00four", "\x0c"]
    words, doc = lattice_lm.tokens(pa.array(texts, pa.string()))
    want = [(w, i) for i, t in enumerate(texts) for w in re.findall(BLANK, (t or "").translate(LOWER))]
    assert list(zip(words.to_pylist(), doc.tolist(), strict=True)) == want


def plain_scores(rows, vocabulary):
    counts = Counter(w for t, train in rows if train for w in [*re.findall(BLANK, (t or "").translate(LOWER)), ""])
    n, v = sum(counts.values()), len(counts)
    for t, _ in rows:
        words = [*re.findall(BLANK, (t or "").translate(LOWER)), ""]
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        p = sum(lattice_lm.marginals(vocabulary, [w])[0] for w in words[:-1]) + vocabulary.log_weights[-1]
        yield len(words), sum(counts[w] > 0 for w in words), n, base, p / math.log(10)


@pytest.mark.parametrize("frequent", [0, 6, 1 << 18])
def test_scores_of_documents(spark, frequent):
    rows = [(i, t, i % 3 != 0) for i, t in corpus(5, 40)] + [(None, "Rare €words here", True), (3, None, None), (7, "aab", False), (7, "aab", False), (50, "w" * 300 + " a", True)]
    docs = spark.createDataFrame([(i, t, k, 1.0, "x", 0) for i, t, k in rows], "doc_id long, text string, train boolean, score double, word string, n int").repartition(3)
    vocabulary = small_vocabulary()
    got = lattice_lm.score(docs, vocabulary, keep=("doc_id", "text", "train", "word"), rounds=0, frequent=frequent)
    assert got.columns == ["doc_id", "text", "train", "word", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: tuple(map(str, r[:4]))
    want = sorted([(i, t, k, "x", *s) for (i, t, k), s in zip(rows, plain_scores([(t, bool(k)) for _, t, k in rows], vocabulary), strict=True)], key=key)
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), want, strict=True):
        assert a[:7] == b[:7] and a[7:] == pytest.approx(b[7:])


def test_fitting_raises_likelihood_and_keeps_a_distribution(spark):
    words = spark.createDataFrame([("abab", 30), ("ba", 9), ("é", 4), ("€", 1), ("", 12), ("x", 0)], "word string, n_train long")
    first = small_vocabulary()
    likelihood = lambda v: sum(n * lattice_lm.marginals(v, [w])[0] for w, n in [("abab", 30), ("ba", 9), ("é", 4), ("€", 1)]) + 12 * v.log_weights[-1]
    values = [likelihood(lattice_lm.fit(words, first, rounds, prior=1e-3)) for rounds in range(4)]
    assert values[0] < values[1] <= values[2] <= values[3]
    assert np.exp(lattice_lm.fit(words, first).log_weights).sum() == pytest.approx(1)
    assert np.allclose(lattice_lm.fit(words.where("false"), first).log_weights, first.log_weights)


def test_scores_without_training_texts_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("train", F.lit(False))
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, small_vocabulary()).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"]) == (3, 0, 0, 0) and got[2]["n_tokens"] == 1
    assert lattice_lm.score(docs.where("false"), small_vocabulary()).count() == 0


def plain_audit(rows, labels):
    good, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    cells = defaultdict(list)
    for i, t, source in rows:
        text = t or ""
        words = re.findall(BLANK, text)
        fails = "".join(
            n
            for n, bad in [
                ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                ("D", re.search(r"[#$%&*|]", text)), ("E", text in least and (i is None or least[text] < i)),
            ]
            if bad
        )
        cells[source or ""].append((fails, i in good, i in toxic))
    for part, docs in cells.items():
        out, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                out.append((part, order, step, len(left), len(gone), redundant, sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        yield from ((*r, shapley[r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(r.choice(["Alpha", "beta", "GAMMA", "x|y", "né"]) + str(r.randint(0, 400)) for _ in range(r.choice([5, 49, 50, 51, 80]))) for _ in range(12)]
    rows = [(i, r.choice(texts), r.choice(["s", "t", None])) for i in range(70)]
    rows += [(None, texts[0], "s"), (None, "only here", "t"), (None, None, ""), (4, rows[4][1], "s"), (71, None, "u"), (72, "", "u"), (73, "w " * 40_000, "u"), (74, "A" * 3 + "b" * 57, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 70, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame([(i, t, s, "e", 3, "d") for i, t, s in rows], "doc_id long, text string, source string, part string, n int, digest string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op12_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert filter_audit.audit(docs.where("false"), spark.read.parquet(f"{tmp_path}/labels.parquet"), filter_audit._conditions(), "E").count() == 0


def test_trie_visits_each_state_once(spark):
    rows = spark.createDataFrame([("p", True, False, a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "part string, good boolean, toxic boolean, fails_x boolean, fails_y boolean, fails_z boolean")
    seen = []
    trie = filter_audit.Trie(rows, ["x", "y", "z"])
    count = trie._count
    trie._count = lambda state, kept: (seen.append(state), count(state, kept))
    got = {r["applied"]: r for r in trie.walk().collect()}
    assert seen == [0, 1, 3, 7, 5, 2, 6, 4]  # depth first; 3, 5 and 6 are reached twice, 7 six times
    assert {s: r["n"] for s, r in got.items()} == {0: 8, 1: 4, 2: 4, 4: 4, 3: 2, 5: 2, 6: 2, 7: 1}
    assert (got[1]["removed_x"], got[1]["removed_y"], got[3]["removed_z"]) == (0, 2, 1)


def test_hot_groups_of_copies(spark, monkeypatch):
    rows = [(i, i, bytes([0 if i % 3 else i % 40])) for i in range(300)] + [(900, None, b"\0"), (901, None, b"z"), (902, None, b"z"), (903, 0, bytes([0]))]
    docs = spark.createDataFrame(rows, "__row long, doc_id long, digest binary").repartition(4)
    least = {}
    for _, i, d in rows:
        if i is not None:
            least[d] = min(i, least.get(d, i))
    want = {row for row, i, d in rows if d in least and (i is None or least[d] < i)}
    for share in (1, 3, 1000):
        monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
        assert {r[0] for r in filter_audit.repeated(docs).where("again").collect()} == want


def plain_resample(rows, target, longest=1, share=10, least_words=20, buckets=10_000, seed=2024):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in part for b in features(x)) for part in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    can = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(can[: share * len(can) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest,share", [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, longest, share):
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "x1", "y_z", "don't", "naïve", "q", "\x00w", "ﬁ"]
    rows = [(i, " ".join(r.choice(vocabulary) + r.choice(["", ",", "!"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (200, None), (201, ""), (202, " ,. "), (203, "alpha beta " * 30_000), (204, "one")]
    target = ["alpha beta alpha", None, "", "naïve q " * 9]
    docs = spark.createDataFrame([(i, t, 9, 0, "k") for i, t in rows], "doc_id long, text string, score int, n_words int, __k0 string").repartition(3)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, items, share=share / 100, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_resample(rows, target, longest, share)))


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.where("false")
    assert [tuple(r) for r in resample.resample(none, docs).collect()] == []
    got = resample.resample(docs, none.select("text"))
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in got.collect()) == [(1, 2, None), (2, 0, None)]


def test_pieces_do_not_change_counts(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other{i % 5} " * (i + 1)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    flat = lambda df: sorted((r[0], r[1], tuple(r[3]), tuple(r[4])) for r in df.collect())
    whole = flat(resample.bucket_counts(docs, ("doc_id",), longest=2))
    monkeypatch.setattr(resample, "PIECE", 100)
    assert flat(resample.bucket_counts(docs, ("doc_id",), longest=2)) == whole

"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import pieces, table, tune, utf8, word_hashes, word_spans, worker
from .labels import fold, sample

#: Rows of each class that are fitted at most.
ROWS_PER_CLASS = 2000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 300, 0.08

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_word_share", "upper_share", "digit_share", "space_share", "other_sign_share",
    "sentence_sign_share", "signs_per_word", "sign_run_share", "distinct_word_share", "repeated_next_share", "top_word_share",
    "words_per_line", "distinct_line_share", "pipe_share", "upper_word_share", "non_ascii_share", "line_end_share",
)

_SPACE, _UPPER, _LOWER, _DIGIT, _SENTENCE = (np.zeros(256, bool) for _ in range(5))
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LOWER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_DIGIT[list(b"0123456789")] = True
_SENTENCE[list(b".,;:'\"-")] = True
_HIGH = np.arange(256) >= 128
_SIGN = ~(_SPACE | _UPPER | _LOWER | _DIGIT | _HIGH)
_OTHER = _SIGN & ~_SENTENCE
_LINE = np.ones(256, bool)
_LINE[10] = False


def features(column):
    """One row of FEATURES for each text, from the whole text only; an empty one has zeros."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)

    def per_doc(flag):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return np.diff(sums[offsets]).astype(float)

    share = lambda a, b: a / np.maximum(b, 1)
    starts, ends, doc = word_spans(data, offsets, ~_SPACE)
    words = np.bincount(doc, minlength=n).astype(float)
    length = ends - starts
    h = word_hashes(data, starts, ends)
    order = np.lexsort((h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    if len(at):
        np.maximum.at(most, doc[order][at], np.diff(np.r_[at, len(order)]).astype(float))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper_sums[1:])
    lower_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[data], out=lower_sums[1:])
    shout = (upper_sums[ends] - upper_sums[starts] >= 2) & (lower_sums[ends] == lower_sums[starts])
    l_starts, l_ends, l_doc = word_spans(data, offsets, _LINE)
    lines = np.bincount(l_doc, minlength=n).astype(float)
    lh = word_hashes(data, l_starts, l_ends)
    l_order = np.lexsort((lh, l_doc))
    l_first = np.ones(len(l_order), bool)
    l_first[1:] = (lh[l_order][1:] != lh[l_order][:-1]) | (l_doc[l_order][1:] != l_doc[l_order][:-1])
    signs = _SIGN[data]
    run = np.zeros(len(data), bool)
    run[1:] = signs[1:] & signs[:-1]
    run[offsets[:-1][size > 0]] = False  # no run begins in another text
    count = lambda d, flag: np.bincount(d[flag], minlength=n).astype(float)
    ended = np.zeros(len(l_ends), bool)
    if len(l_ends):
        ended = np.isin(data[l_ends - 1], np.frombuffer(b".!?:", np.uint8))
    total_length = np.bincount(doc, weights=length, minlength=n) if len(doc) else np.zeros(n)
    out = (
        np.log1p(size), np.log1p(words), share(total_length, words), share(count(doc, length > 14), words), share(per_doc(_UPPER[data]), size), share(per_doc(_DIGIT[data]), size),
        share(per_doc(_SPACE[data]), size), share(per_doc(_OTHER[data]), size), share(per_doc(_SENTENCE[data]), size), share(per_doc(signs), words), share(per_doc(run), size),
        share(count(doc[order], first), words), share(count(doc, same), words), share(most, words), share(words, lines), share(count(l_doc[l_order], l_first), lines),
        share(per_doc(data == 124), words), share(count(doc, shout), words), share(per_doc(_HIGH[data]), size), share(count(l_doc, ended), lines),
    )
    return np.stack(out, axis=1) if n else np.zeros((0, len(FEATURES)))


def cuts(values, bins):
    """Inner edges of bins of about equal count."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


class Model:
    """Lookup tables: one for each feature, one for each chosen pair; a score is a sum of bins."""

    def __init__(self, constant=None):
        self.constant = constant

    def bins(self, x):
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]

    def raw(self, x):
        fine, coarse = self.bins(x)
        out = np.full(len(x), self.base)
        for j, b in enumerate(fine):
            out += self.tables[j][b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[i], coarse[j]]
        return out

    def score(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def tree(g, h, leaves=3, least=2.0):
    """A tree of a few leaves over ordered bins, as a value of each bin: splits by gain of the summed gradients."""
    parts = [(0, len(g))]
    sg, sh = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    score = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + least)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = score(a, k) + score(k, b) - score(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], p, int(k[i]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(sg[b] - sg[a]) / (sh[b] - sh[a] + least)
    return out


def quad(g, h, least=2.0):
    """A tree of depth two over a pair's bins: the best cut of either feature, each side cut by the other."""
    best, values = 0.0, None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, a.shape[0]):
            gain, out = 0.0, np.zeros(a.shape)
            for part in (slice(0, k), slice(k, None)):
                cg, ch = np.r_[0, np.cumsum(a[part].sum(axis=0))], np.r_[0, np.cumsum(b[part].sum(axis=0))]
                m = np.arange(1, a.shape[1])
                if not len(m):
                    continue
                left, right = cg[m] ** 2 / (ch[m] + least), (cg[-1] - cg[m]) ** 2 / (ch[-1] - ch[m] + least)
                i = int(np.argmax(left + right))
                gain += (left + right)[i]
                out[part, : m[i]] = -cg[m[i]] / (ch[m[i]] + least)
                out[part, m[i] :] = -(cg[-1] - cg[m[i]]) / (ch[-1] - ch[m[i]] + least)
            if gain > best:
                best, values = gain, out.T if turned else out
    return values, best


def fit(x, y):
    """A Model from features and 0/1 labels: mains in turn, round after round; then pairs by what they still explain.

    Without rows, or with one class, a constant: 0.5 or that class. Classes weigh by their counts; rounds
    end where a fifth of the rows, left aside, no longer gains.
    """
    if len(set(y.tolist())) < 2:
        return Model(float(y[0]) if len(y) else 0.5)
    m = Model()
    m.edges, m.pair_edges = [cuts(c, BINS) for c in x.T], [cuts(c, PAIR_BINS) for c in x.T]
    fine, coarse = m.bins(x)
    held = np.arange(len(y)) % 5 == 4
    use = (~held).astype(float)
    m.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m.tables, m.pairs, m.pair_tables = [np.zeros(len(e) + 1) for e in m.edges], [], []
    f = np.full(len(y), m.base)

    def state():
        q = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return (q - y) * use, np.maximum(q * (1 - q), 1e-6) * use

    def loss():
        return float(np.logaddexp(0, np.where(y[held] == 1, -f[held], f[held])).mean()) if held.any() else 0.0

    def boost(terms, rounds):
        nonlocal f
        best, since, kept = loss(), 0, [t.copy() for t in (*m.tables, *m.pair_tables)]
        for _ in range(rounds):
            for term in terms:
                g, h = state()
                if isinstance(term, int):
                    b, k = fine[term], len(m.tables[term])
                    add = RATE * tree(np.bincount(b, g, k), np.bincount(b, h, k))
                    m.tables[term] += add
                    f = f + add[b]
                else:
                    (i, j), t = term, m.pair_tables[m.pairs.index(term)]
                    b = coarse[i] * t.shape[1] + coarse[j]
                    add, _ = quad(np.bincount(b, g, t.size).reshape(t.shape), np.bincount(b, h, t.size).reshape(t.shape))
                    if add is not None:
                        t += RATE * add
                        f = f + RATE * add.ravel()[b]
            now = loss()
            if now < best - 1e-5:
                best, since, kept = now, 0, [t.copy() for t in (*m.tables, *m.pair_tables)]
            else:
                since += 1
                if since >= 15:
                    break
        for t, k in zip((*m.tables, *m.pair_tables), kept, strict=True):
            t[:] = k
        f = m.raw(x)

    boost(list(range(x.shape[1])), ROUNDS)
    g, h = state()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1)
            b = coarse[i] * shape[1] + coarse[j]
            gains.append((quad(np.bincount(b, g, shape[0] * shape[1]).reshape(shape), np.bincount(b, h, shape[0] * shape[1]).reshape(shape))[1], i, j, shape))
    for _, i, j, shape in sorted(gains, key=lambda v: -v[0])[:PAIRS]:
        m.pairs.append((i, j))
        m.pair_tables.append(np.zeros(shape))
    boost(list(m.pairs), ROUNDS // 3)
    return m


def train(docs, labels, rows_per_class=ROWS_PER_CLASS):
    """A Model of the labels; the chosen texts' features are computed where the texts are, and only these are collected."""
    tune(docs.sparkSession)
    chosen, rows = sample(docs, labels, "quality", fold(5) != 0, rows_per_class)

    @worker("quality")
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features(batch.column(1)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    found = {r[0]: r[1] for r in rows.mapInArrow(run, "doc_id long, x array<double>").collect()} if chosen else {}
    used = [(i, y) for i, y in chosen if i in found]
    x = np.array([found[i] for i, _ in used]).reshape(-1, len(FEATURES))
    y = np.array([y for _, y in used], np.int64)
    order = np.random.default_rng(5).permutation(len(y))
    return fit(x[order], y[order])


def score(docs, model, keep=("doc_id",)):
    """docs(text, ...) with a column score in 0 .. 1: sums of bins of the whole text's features.

    Null counts as empty, which scores by the bins of zeros; repeated rows score alike; an empty table
    stays empty; only the columns in keep go along.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join([f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])

    @worker("quality")
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "__text"):
                scores = shared.value.score(features(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(scores, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def op2_quality(spark, sf_dir):
    """Labels of rows whose crc32(doc_id) mod 5 is 0 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

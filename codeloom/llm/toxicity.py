"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import INVERSE, BASE, _BYTE_VALUES, lower_ascii, mix, pieces, powers, table, trim, tune, utf8, word_hashes, word_spans, worker
from .labels import fold, sample

#: Rows of each class that are fitted at most; bytes of training text that are split into words at once.
ROWS_PER_CLASS = 1500
AT_ONCE = 1 << 18
WINDOW, STRIDE = 32, 24
HIDDEN, DIM = 8, 8
BUCKET_BITS = 16
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Steps of the fit at least, however few rows there are.
LEAST_STEPS = 200
#: Learning rate of embeddings against that of the other weights: they start from counts and only need shifting.
EMBED_RATE = 0.1
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD_BYTES[128:] = True
F32 = np.float32


def words_of(data, offsets):
    """Distinct words of a piece by hash: index of each word into them, document of each word, and their characters' n-gram buckets."""
    data = lower_ascii(data)
    starts, ends, doc = word_spans(data, offsets, _WORD_BYTES)
    hashes = word_hashes(data, starts, ends)
    distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends[first] - starts[first]
    # the distinct words once, each between two marks
    total = length + 2
    at = np.concatenate([[0], np.cumsum(total)])
    marked = np.full(int(at[-1]), 1, np.uint8)
    if len(distinct):
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        marked[np.repeat(at[:-1] + 1, length) + inner] = data[np.repeat(starts[first], length) + inner]
        marked[at[1:] - 1] = 2
    sums = np.zeros(len(marked) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[marked] * powers(BASE, len(marked)), out=sums[1:])
    owner = np.repeat(np.arange(len(distinct)), total)
    word, bucket = [], []
    for n in GRAMS:
        if len(marked) < n:
            continue
        i = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        h = mix((sums[i + n] - sums[i]) * powers(INVERSE, len(marked) + 1)[i])
        word.append(owner[i])
        bucket.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    word = np.concatenate(word) if word else np.zeros(0, np.int64)
    bucket = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return distinct, index.astype(np.int64), doc, word[order], bucket[order]


def bucket_of(hashes):
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def windows_of(doc, n_docs):
    """First word and document of every window: WINDOW words, each STRIDE words, the last one at a text's end."""
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    own = np.repeat(np.arange(n_docs), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * STRIDE, np.maximum(count[own] - WINDOW, 0))
    return begin[own] + start, np.minimum(count[own], WINDOW), own


def sigmoid(x):
    return F32(1) / (F32(1) + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights: word and character embeddings, a GRU each way, attention, output."""

    def __init__(self, seed=7):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) * 0.3).astype(F32)
        self.p = {"word": np.zeros((1 << BUCKET_BITS, DIM), F32), "char": np.zeros((1 << BUCKET_BITS, DIM), F32), "u": small(2 * HIDDEN), "w": small(2 * HIDDEN), "b": np.full(1, -1, F32)}
        for way in "fb":
            self.p |= {f"x{way}": small(2 * DIM, 3 * HIDDEN), f"h{way}": small(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, F32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, word_bucket, gram_word, gram_bucket):
        """Embedding of each distinct word: its own bucket, and the mean of its character n-grams'."""
        chars = np.zeros((len(word_bucket), DIM), F32)
        if len(gram_word):
            first = np.flatnonzero(np.r_[True, gram_word[1:] != gram_word[:-1]])
            end = np.r_[first[1:], len(gram_word)]
            for i in range(0, len(first), 1 << 14):
                a, b = first[i : i + (1 << 14)], end[i : i + (1 << 14)]
                sums = np.add.reduceat(self.p["char"][gram_bucket[a[0] : b[-1]]], a - a[0], axis=0)
                chars[gram_word[a]] = sums / (b - a)[:, None].astype(F32)
        return np.concatenate([self.p["word"][word_bucket], chars * F32(4)], axis=1)

    def run(self, x, index, length, keep=False):
        """Logits of windows; index (windows, WINDOW) into x, length words of each. keep: also what training needs."""
        p, n = self.p, len(index)
        states, tape = np.empty((WINDOW, n, 2 * HIDDEN), F32), {}
        padded = bool((length < WINDOW).any())
        for d, way in enumerate("fb"):
            xs = x @ p[f"x{way}"] + p[f"c{way}"]
            h = np.zeros((n, HIDDEN), F32)
            uh = p[f"h{way}"]
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                a = xs[index[:, t]]
                b = h @ uh
                gates = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if padded:
                    new *= (t < length)[:, None]
                if keep:
                    tape[way, t] = (h, z, r, c, b[:, 2 * HIDDEN :])
                h = new
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        e = states @ p["u"]
        if padded:
            e[np.arange(WINDOW)[:, None] >= length] = -30
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", e, states)
        logit = pooled @ p["w"] + p["b"]
        return (logit, states, e, pooled, tape, padded) if keep else logit

    def gradients(self, x, index, length, y, weight):
        """Loss gradient by backpropagation through time, and of x."""
        p, n = self.p, len(index)
        logit, states, e, pooled, tape, padded = self.run(x, index, length, keep=True)
        dl = ((sigmoid(logit) - y) * weight / n).astype(F32)
        g = {"w": pooled.T @ dl, "b": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["w"]
        de = np.einsum("nk,tnk->tn", dpool, states)
        de = e * (de - (e * de).sum(axis=0))
        g["u"] = np.einsum("tn,tnk->k", de, states)
        ds = e[:, :, None] * dpool + de[:, :, None] * p["u"]
        dx = np.zeros_like(x)
        words = index.T.ravel()
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.r_[True, words[order][1:] != words[order][:-1]])
        for d, way in enumerate("fb"):
            das = np.empty((WINDOW, n, 3 * HIDDEN), F32)
            duh = np.zeros_like(p[f"h{way}"])
            dh = np.zeros((n, HIDDEN), F32)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                h, z, r, c, bc = tape[way, t]
                dn = ds[t, :, d * HIDDEN : (d + 1) * HIDDEN] + dh
                if padded:
                    dn = dn * (t < length)[:, None]
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                db = np.concatenate([dz, dr, dc * r], axis=1)
                dh = dn * z + db @ p[f"h{way}"].T
                duh += h.T @ db
                das[t] = da
            dxs = np.zeros((len(x), 3 * HIDDEN), F32)
            dxs[words[order][first]] = np.add.reduceat(das.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
            g[f"h{way}"], g[f"c{way}"] = duh, dxs.sum(axis=0)
            g[f"x{way}"] = x.T @ dxs
            dx += dxs @ p[f"x{way}"].T
        return g, dx


def segments(texts):
    """(number, bytes) of the texts, long ones cut between words into parts of about AT_ONCE bytes."""
    for i, text in enumerate(texts):
        data, at = text.encode(), 0
        while len(data) - at > AT_ONCE:
            member = _WORD_BYTES[lower_ascii(np.frombuffer(data, np.uint8, AT_ONCE, at))]
            gap = np.flatnonzero(~member)
            cut = at + int(gap[-1]) + 1 if len(gap) else at + AT_ONCE
            while not len(gap) and cut < len(data) and _WORD_BYTES[data[cut] | 32 if 65 <= data[cut] <= 90 else data[cut]]:
                cut += 1  # one word of that length: it stays whole
            yield i, data[at:cut]
            at = cut
        yield i, data[at:]


class Words:
    """The words of all training texts. A bounded piece of text is split at a time, and each distinct word is held once."""

    def __init__(self, texts):
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.buckets, sizes, grams = [], [], []
        parts: list = [[] for _ in texts]
        for own, data, offsets in self.batched(texts):
            distinct, index, doc, gram_word, gram_bucket = words_of(data, offsets)
            ids, new = self.number(distinct)
            count = np.bincount(gram_word, minlength=len(distinct))
            self.buckets.append(bucket_of(distinct[new]).astype(np.int32))
            sizes.append(count[new])
            grams.append(gram_bucket[new[gram_word]].astype(np.int32))
            edges = np.searchsorted(doc, np.arange(len(own) + 1))
            for i, x, y in zip(own, edges, edges[1:], strict=False):
                parts[i].append(ids[index[x:y]])
        self.docs = [np.concatenate([np.zeros(0, np.int32), *p]) for p in parts]
        joined = lambda arrays: np.concatenate([np.zeros(0, np.int32), *arrays])
        self.buckets, self.gram_bucket, sizes = joined(self.buckets), joined(grams), joined(sizes)
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.gram_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        del self.hashes, self.ids

    @staticmethod
    def batched(texts):
        """(numbers, bytes, offsets) of segments together."""
        own, held, size = [], [], 0
        for i, data in segments(texts):
            if own and size + len(data) > AT_ONCE:
                yield own, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
                own, held, size = [], [], 0
            own.append(i)
            held.append(data)
            size += len(data)
        if own:
            yield own, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])

    def number(self, distinct):
        """The numbers of sorted word hashes, and which are new; these are numbered on in their order."""
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        ids = np.empty(len(distinct), np.int32)
        ids[~new] = self.ids[at[~new]]
        ids[new] = len(self.ids) + np.arange(int(new.sum()), dtype=np.int32)
        self.ids = np.insert(self.ids, at[new], ids[new])
        self.hashes = np.insert(self.hashes, at[new], distinct[new])
        return ids, new

    def grams(self, words):
        """For some words: which of them, and the bucket, of each of their n-grams."""
        sizes = self.begin[words + 1] - self.begin[words]
        at = np.repeat(self.begin[words], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(np.arange(len(words)), sizes), self.gram_bucket[at], sizes


def evidence(words, docs, ys):
    """Log-odds of each word and n-gram bucket by presence in documents of either class, damped where few hold it."""
    seen = np.zeros((2, 2, 1 << BUCKET_BITS), F32)
    for d, y in zip(docs, ys, strict=True):
        own = np.unique(words.docs[d])
        seen[0, y, np.unique(words.buckets[own])] += 1
        seen[1, y, np.unique(words.grams(own)[1])] += 1
    total = np.bincount(ys, minlength=2)
    odds = np.log((seen[:, 1] + 0.5) / (total[1] + 1)) - np.log((seen[:, 0] + 0.5) / (total[0] + 1))
    return (np.clip(odds, -4, 4) * np.minimum(1, seen.sum(axis=1) / 10)).astype(F32)


def fit(rows, epochs=12, seed=7):
    """A network from [(text, label)], or the constant score of its only class, or 0.5 without rows.

    Multiple-instance training: a document is judged by its highest window; embeddings start from the
    log-odds of their bucket. A fifth of the rows calibrates the output.
    """
    ys = np.array([y for _, y in rows], np.int64)
    if len(set(ys.tolist())) < 2:
        return float(ys[0]) if len(ys) else 0.5
    rng = np.random.default_rng(seed)
    words = Words([t for t, _ in rows])
    has = [i for i, d in enumerate(words.docs) if len(d)]
    ys = ys[has]
    docs = [words.docs[i] for i in has]
    if len(set(ys.tolist())) < 2:
        return float(ys[0]) if len(ys) else 0.5
    held = np.arange(len(docs)) % 5 == 4
    net = Network(seed)
    p = net.p
    odds = evidence(words, [i for i, out in zip(has, held, strict=True) if not out], ys[~held])
    for name, o in zip(("word", "char"), odds, strict=True):
        p[name][:, 0] = o / 4
    index, length, own = [], [], []
    for i, d in enumerate(docs):
        start, n, _ = windows_of(np.zeros(len(d), np.int64), 1)
        index.append(d[np.minimum(start[:, None] + np.arange(WINDOW), len(d) - 1)])
        length.append(n)
        own.append(np.full(len(n), i))
    index, length, own = np.concatenate(index), np.concatenate(length), np.concatenate(own)
    begin = np.searchsorted(own, np.arange(len(docs)))

    def score_all(x):
        return np.concatenate([net.run(x, index[i : i + 4096], length[i : i + 4096]) for i in range(0, len(index), 4096)])

    def top(values):
        order = np.lexsort((values, own))
        return order[np.searchsorted(own, np.arange(len(docs)), "right") - 1]

    x = net.inputs(words.buckets, words.gram_word, words.gram_bucket)
    hint = (x[:, 0] + x[:, DIM])[index]
    hint[np.arange(WINDOW) >= length[:, None]] = -9
    best = top(hint.max(axis=1))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    steps = 0
    train = np.flatnonzero(~held)
    balance = np.where(ys == 1, 0.5 / max(ys[train].mean(), 1e-3), 0.5 / max(1 - ys[train].mean(), 1e-3)).astype(F32)
    epochs = max(epochs, -(-LEAST_STEPS * 128 // max(1, len(train))))
    for epoch in range(epochs):
        if epoch in {epochs * k // 5 for k in (2, 4)}:
            best = top(score_all(net.inputs(words.buckets, words.gram_word, words.gram_bucket)))
        extra = begin[train] + (rng.random(len(train)) * np.diff(np.r_[begin, len(own)])[train]).astype(np.int64)
        chosen = np.concatenate([best[train], extra[ys[train] == 0]])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 128):
            batch = chosen[i : i + 128]
            rows_in, inverse = np.unique(index[batch], return_inverse=True)
            local_word, local_bucket, sizes = words.grams(rows_in)
            x = net.inputs(words.buckets[rows_in], local_word, local_bucket)
            g, dx = net.gradients(x, inverse.reshape(-1, WINDOW), length[batch], ys[own[batch]].astype(F32), balance[own[batch]])
            g["word"], g["char"] = (words.buckets[rows_in], dx[:, :DIM]), (local_bucket, (dx[:, DIM:] * F32(4) / np.maximum(sizes, 1).astype(F32)[:, None])[local_word])
            steps += 1
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
            slow = rate * EMBED_RATE
            for k, grad in g.items():
                m, v = moment[k]
                if isinstance(grad, tuple):  # only the buckets met
                    at, back = np.unique(grad[0], return_inverse=True)
                    sums = np.zeros((len(at), DIM), F32)
                    np.add.at(sums, back, grad[1])
                    m[at] = 0.9 * m[at] + 0.1 * sums
                    v[at] = 0.99 * v[at] + 0.01 * sums * sums
                    p[k][at] -= slow * m[at] / (np.sqrt(v[at]) + 1e-6)
                else:
                    m[:] = 0.9 * m + 0.1 * grad
                    v[:] = 0.99 * v + 0.01 * grad * grad
                    p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(F32)
    values = score_all(net.inputs(words.buckets, words.gram_word, words.gram_bucket))
    out = values[top(values)][held]
    net.scale, net.shift = calibrated(out, ys[held])
    return net


def calibrated(out, y):
    """(scale, shift) of a logistic curve from raw outputs to labels, with a pull towards (1, 0)."""
    scale, shift = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return scale, shift
    out = np.clip(out.astype(float), -12, 12)
    for _ in range(60):
        q = 1 / (1 + np.exp(-(scale * out + shift)))
        d, w = q - y, q * (1 - q)
        g = np.array([(d * out).sum() + 0.5 * (scale - 1), d.sum() + 0.5 * shift])
        h = np.array([[(w * out * out).sum() + 0.5, (w * out).sum()], [(w * out).sum(), w.sum() + 0.5]])
        move = np.linalg.solve(h, g)
        move = np.clip(move, -0.5, 0.5)
        scale, shift = max(scale - move[0], 0.1), shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(scale), float(shift)


def score_piece(net, column):
    """Score of each text: its highest window's; 0 for a text without words."""
    data, offsets = utf8(column)
    n_docs = len(offsets) - 1
    if isinstance(net, float):
        return np.full(n_docs, net)
    distinct, index, doc, gram_word, gram_bucket = words_of(data, offsets)
    best = np.full(n_docs, -np.inf)
    if len(index):
        x = net.inputs(bucket_of(distinct), gram_word, gram_bucket)
        start, length, own = windows_of(doc, n_docs)
        for i in range(0, len(start), 4096):
            at = np.minimum(start[i : i + 4096, None] + np.arange(WINDOW), len(index) - 1)
            np.maximum.at(best, own[i : i + 4096], net.run(x, index[at], length[i : i + 4096]).astype(float))
    return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(net.scale * np.where(np.isinf(best), 0, best) + net.shift, -40, 40))))


def score(docs, net, keep=("doc_id",)):
    """docs(text, ...) with a column score in 0 .. 1; every overlapping window of every whole text is scored.

    Null, empty and wordless texts score 0; repeated rows score alike; an empty table stays empty;
    only the columns in keep go along.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(net)
    schema = ", ".join([f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])

    @worker("toxicity")
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "__text"):
                scores = score_piece(shared.value, batch.column(len(keep)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(scores)], names=[*keep, "score"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def train(docs, labels, rows_per_class=ROWS_PER_CLASS):
    """A Network of the labels, fitted on the driver on the whole texts of the bounded sample."""
    chosen, rows = sample(docs, labels, "toxic", fold(3) != 1, rows_per_class)
    texts = {r[0]: r[1] for r in rows.collect()} if chosen else {}
    net = fit([(texts[i], y) for i, y in chosen if i in texts])
    del texts
    trim()
    return net


def op9_toxicity(spark, sf_dir):
    """Labels of rows whose crc32(doc_id) mod 3 is 1 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language-model scoring: marginal probability of a text over all segmentations into pieces of an existing vocabulary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import scratch, table, tune, worker

VOCABULARY = "piece_bpe_32k.model"
#: Rounds that fit the pieces' weights to the training words, and how much the vocabulary's own scores count beside them.
ROUNDS, PRIOR = 2, 32_000.0
#: Words that are broadcast at most, and their longest; all others meet their counts by a join.
FREQUENT, FREQUENT_LENGTH = 1 << 18, 64
#: Code points whose lattices are built at once, distinct words kept in a task before they are sent on, and text bytes scored at once.
LATTICE, DISTINCT, TEXT = 1 << 17, 1 << 19, 8 << 20
SPACE = "▁"


class Vocabulary:
    """Pieces as a trie over code points, and the log weight of each: text pieces first, then 256 bytes, then the end of a text.

    A character that is no piece is spelt by its bytes, as the vocabulary's own library does.
    """

    def __init__(self, pieces, log_weights):
        self.pieces, self.log_weights = list(pieces), np.asarray(log_weights, float)
        nodes, edges, piece = 1, {}, [-1]
        for i, text in enumerate(self.pieces):
            node = 0
            for c in map(ord, text):
                key = node << 21 | c
                if key not in edges:
                    edges[key] = nodes
                    piece.append(-1)
                    nodes += 1
                node = edges[key]
            piece[node] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        self.longest = max(map(len, self.pieces), default=1)

    def spelling(self, char):
        """Indices of the bytes of a code point; a lone surrogate has the three bytes it would have."""
        return [len(self.pieces) + b for b in chr(char).encode("utf-8", "surrogatepass")]

    def arcs(self, chars, offsets):
        """(first character, one past the last, piece) of every piece in every word; -1 stands for spelling by bytes."""
        n = len(chars)
        stop = np.repeat(offsets[1:], np.diff(offsets))
        live, node = np.arange(n), np.zeros(n, np.int64)
        found, alone = [], np.zeros(n, bool)
        for k in range(self.longest if len(self.keys) else 0):
            inside = live + k < stop[live]
            live, node = live[inside], node[inside]
            key = node << 21 | chars[live + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, node = live[hit], self.child[at[hit]]
            if not len(live):
                break
            piece = self.piece[node]
            ends = piece >= 0
            found.append((live[ends], live[ends] + k + 1, piece[ends]))
            if k == 0:
                alone[live[ends]] = True
        rest = np.flatnonzero(~alone)
        found.append((rest, rest + 1, np.full(len(rest), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def load(path):
    """The Vocabulary of a sentencepiece model, weights from its own scores.

    A unigram model's scores are log probabilities. A merge model's are the negated ranks of its pieces, of which the
    weight is taken as 1 / (rank + 3), bytes after all others. Pieces with a word's mark inside match no word and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.GetPieceSize())
    text = [i for i in ids if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i)) and SPACE not in model.IdToPiece(i)[1:]]
    scores = np.array([model.GetScore(i) for i in text])
    of_byte = {int(model.IdToPiece(i)[3:5], 16): model.GetScore(i) for i in ids if model.IsByte(i)}
    if (scores == np.round(scores)).all() and scores.max(initial=0) <= 0:
        last = 1 - scores.min(initial=0)
        weights, byte_weights = -np.log(3 - scores), np.full(256, -math.log(3 + last))
    else:
        weights, byte_weights = scores, np.array([of_byte.get(b, scores.min() - 10) for b in range(256)])
    weights = np.concatenate([weights, byte_weights, [np.logaddexp.reduce(weights) - 6]])
    return Vocabulary([model.IdToPiece(i) for i in text], weights - np.logaddexp.reduce(weights))


def characters(words):
    """(code points, offsets) of a list of words, each with the mark of a word's beginning before it."""
    marked = [SPACE + w for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return chars, np.concatenate([[0], np.cumsum([len(w) for w in marked], dtype=np.int64)]).astype(np.int64)


def _recursion(total, at, source, target, order, weights):
    """Log sums over paths: each target gathers its sources' sums, level by level. total is filled in place."""
    level, source, target, weights = at[order], source[order], target[order], weights[order]
    cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1)) if len(level) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        value, goal = total[source[a:b]] + weights[a:b], target[a:b]
        heads = np.flatnonzero(np.diff(goal, prepend=-1))
        most = np.maximum.reduceat(value, heads)
        sums = np.add.reduceat(np.exp(value - np.repeat(most, np.diff(heads, append=b - a))), heads)
        total[goal[heads]] = most + np.log(sums)


def marginals(vocabulary, words, counts=None):
    """Natural log of the probability of each word, summed over all its segmentations by a forward recursion in log space.

    With counts, also the expected number of uses of every piece, by forward and backward sums.
    """
    out, expected = np.zeros(len(words)), np.zeros(len(vocabulary.log_weights))
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (end == start or size + len(words[end]) < LATTICE):
            size += len(words[end]) + 1
            end += 1
        chars, offsets = characters(words[start:end])
        first, last, piece = vocabulary.arcs(chars, offsets)
        word = np.repeat(np.arange(end - start), np.diff(offsets))[first]
        weights = vocabulary.log_weights[piece]
        spelt, which = np.unique(chars[first[piece < 0]], return_inverse=True)
        spellings = [vocabulary.spelling(int(c)) for c in spelt]
        weights[piece < 0] = np.array([vocabulary.log_weights[s].sum() for s in spellings])[which] if len(spelt) else 0
        heads, tails = offsets[:-1] + np.arange(end - start), offsets[1:] + np.arange(end - start)
        source, target, nodes = first + word, last + word, len(chars) + end - start
        forward = np.full(nodes, -np.inf)
        forward[heads] = 0
        level = last - offsets[word]
        _recursion(forward, level, source, target, np.argsort(level * nodes + target, kind="stable"), weights)
        out[start:end] = forward[tails]
        if counts is not None:
            backward = np.full(nodes, -np.inf)
            backward[tails] = 0
            level = offsets[word + 1] - first
            _recursion(backward, level, target, source, np.argsort(level * nodes + source, kind="stable"), weights)
            use = np.exp(forward[source] + weights + backward[target] - forward[tails][word]) * np.asarray(counts[start:end], float)[word]
            expected += np.bincount(piece[piece >= 0], use[piece >= 0], len(expected))
            for spelling, n in zip(spellings, np.bincount(which, use[piece < 0], len(spelt)) if len(spelt) else (), strict=True):
                np.add.at(expected, spelling, n)
        start = end
    return out if counts is None else (out, expected)


def tokens(texts):
    """(words, document of each) of an Arrow column of texts, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), doc[filled.to_numpy(zero_copy_only=False)]


def _gathered(batches, name, limit):
    """Batches put together until their texts reach limit bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(name)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(docs):
    """word, n, n_train of docs(text, train): how often each word occurs in all texts and in training texts; the word "" is the end of a text.

    Words are counted where the texts are and only sums are shuffled; a word that fills the corpus is one row of each task.
    """

    @worker("lattice_lm")
    def run(batches):
        held = None
        for got in _gathered(batches, "text", TEXT):
            train = got.column("train").to_numpy().astype(np.int64)
            words, doc = tokens(got.column("text").combine_chunks())
            words = pa.concat_arrays([words, pa.array([""] * len(train), words.type)])
            now = pa.table({"word": words, "n": np.ones(len(words), np.int64), "n_train": np.concatenate([train[doc], train])})
            now = now if held is None else pa.concat_tables([held, now])
            held = now.group_by("word", use_threads=False).aggregate([("n", "sum"), ("n_train", "sum")]).rename_columns(["word", "n", "n_train"])
            if len(held) > DISTINCT:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    parts = docs.select("text", "train").mapInArrow(run, "word string, n long, n_train long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def fit(words, vocabulary, rounds=ROUNDS, prior=PRIOR):
    """The vocabulary with weights fitted to words(word, n_train), by expectation over all segmentations.

    Every round sums the expected uses of each piece over all training words in tasks; what reaches the driver is a number
    for each piece. The former weights count as prior uses, so a piece that no text holds keeps some. Without training words nothing changes.
    """
    spark = words.sparkSession
    first = vocabulary.log_weights
    ends = words.where("word = ''").agg(F.sum("n_train")).first()[0] or 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(vocabulary)

        @worker("lattice_lm")
        def run(batches, shared=shared):
            total = None
            for batch in batches:
                _, expected = marginals(shared.value, batch.column(0).to_pylist(), batch.column(1).to_numpy())
                total = expected if total is None else total + expected
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "uses"])

        uses = np.zeros(len(first))
        trained = words.where("n_train > 0 AND word <> ''").select("word", "n_train")
        for piece, n in trained.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] = n
        uses[-1] = ends
        uses += prior * np.exp(first)
        fitted = Vocabulary.__new__(Vocabulary)
        fitted.__dict__ |= vocabulary.__dict__ | {"log_weights": np.log(uses / uses.sum())}
        vocabulary = fitted
        shared.unpersist()
    return vocabulary


def _frequent_from(words, most):
    """The least count from which on at most so many words occur: by a histogram over eighths of powers of two."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    room, least = most, None
    for row in steps:
        room -= row["words"]
        if room < 0:
            break
        least = row["least"]
    return least


def score(docs, vocabulary, keep=("doc_id",), rounds=ROUNDS, frequent=FREQUENT):
    """docs(text, train, ...) with n_tokens, n_known, train_tokens, base_score and score, a row for each document.

    A text is its words, A-Z lower-cased, and an end. base_score sums log10((c + 1) / (N + V + 1)) over these, c being the
    count of each in texts where train holds, N of all, V of distinct ones. score is the log10 probability of the text under
    the pieces: the product over its words of the sum over all segmentations, times the end's weight.
    Every distinct word goes through its lattice once, wherever it occurs. Words frequent in all texts are broadcast with their
    figures, at most so many; the others are joined, none of which is frequent.

    Null and empty texts hold the end alone; repeated rows count and are scored each; without training texts the
    vocabulary's own weights hold and base_score is 0; an empty table stays empty; only the columns in keep go along.
    """
    spark = docs.sparkSession
    tune(spark)
    own = [f"__k{i}" for i in range(len(keep))]
    texts = docs.select(*[docs[c].alias(o) for c, o in zip(keep, own, strict=True)], docs["text"].cast("string").alias("text"), F.coalesce(docs["train"], F.lit(False)).alias("train"))
    words = scratch(spark, word_counts(texts), "lm-words")
    n_train, v_train = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    vocabulary = fit(words, vocabulary, rounds)
    shared = spark.sparkContext.broadcast(vocabulary)

    @worker("lattice_lm")
    def lattices(batches):
        for batch in batches:
            found = marginals(shared.value, batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "log10p"])

    judged = scratch(spark, words.where("word <> ''").mapInArrow(lattices, "word string, n long, n_train long, log10p double"), "lm-scored")
    short = judged.where(F.char_length("word") <= FREQUENT_LENGTH)
    least = _frequent_from(short, frequent)
    is_hot = (F.col("n") >= least) & (F.char_length("word") <= FREQUENT_LENGTH) if least is not None else F.lit(False)
    hot = judged.where(is_hot).select("word", "n_train", "log10p").toArrow().combine_chunks()
    table_of = spark.sparkContext.broadcast(tuple(hot.column(i).combine_chunks() if hot.num_rows else hot.column(i).type for i in range(3)))
    ends = words.where("word = ''").agg(F.sum("n_train")).first()[0] or 0
    end_known, end_base, end_score = int(ends > 0), math.log10(ends + 1), float(vocabulary.log_weights[-1]) / math.log(10)
    kinds = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(keep, own, strict=True))

    @worker("lattice_lm")
    def look_up(batches):
        known_words, counts, logs = table_of.value if hot_rows else (pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64()))
        counts, logs = counts.to_numpy(), logs.to_numpy()
        bases = np.log10(counts + 1.0)
        for got in _gathered(batches, "text", TEXT):
            found, doc = tokens(got.column("text").combine_chunks())
            n = got.num_rows
            at = pc.index_in(found, value_set=known_words.cast(found.type))
            miss = at.is_null().to_numpy(zero_copy_only=False)
            at, where = at.fill_null(0).to_numpy()[~miss], doc[~miss]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[miss], minlength=n))]).astype(np.int32)
            out = {o: got.column(o).combine_chunks() for o in ("__row", *own)} | {
                "n_tokens": pa.array(np.bincount(doc, minlength=n) + 1),
                "known": pa.array(np.bincount(where, counts[at] > 0, n).astype(np.int64) + end_known),
                "base": pa.array(np.bincount(where, bases[at], n) + end_base),
                "log10p": pa.array(np.bincount(where, logs[at], n) + end_score),
                "rare": pa.ListArray.from_arrays(pa.array(offsets), found.filter(pa.array(miss)).cast(pa.string())),
            }
            yield from pa.table(out).to_batches()

    hot_rows = hot.num_rows
    looked = texts.drop("train").withColumn("__row", F.monotonically_increasing_id()).mapInArrow(look_up, f"__row long, {kinds}, n_tokens long, known long, base double, log10p double, rare array<string>")
    looked = scratch(spark, looked, "lm-looked")
    rare = looked.select("__row", F.explode("rare").alias("word")).join(judged.where(~is_hot).select("word", "n_train", F.col("log10p").alias("p")), "word")
    rare = rare.groupBy("__row").agg(F.count_if(F.col("n_train") > 0).alias("r_known"), F.sum(F.log10(F.col("n_train") + 1.0)).alias("r_base"), F.sum("p").alias("r_p"))
    whole = looked.drop("rare").join(rare, "__row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        *[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)],
        "n_tokens",
        plus("known", "r_known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (plus("base", "r_base") - F.col("n_tokens") * F.lit(math.log10(n_train + v_train + 1))).alias("base_score"),
        plus("log10p", "r_p").alias("score"),
    )


def op11_lattice_lm(spark, sf_dir):
    """Documents whose crc32(doc_id) mod 7 is 2 are held out; a null doc_id counts as empty text."""
    import public_tokenizers

    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("train"))
    return score(docs, load(public_tokenizers.path(VOCABULARY)), keep=("doc_id", "held_out"))

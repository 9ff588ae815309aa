"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode by a UTF-8 state machine."""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa

from .common import PIECE_BYTES, _kept, pieces, table, tune, worker

#: Pieces kept ready-made (twice as many: those of the last filling stay until the next), and transducer states kept; beyond, the tables are dropped and grow anew.
CACHE_PIECES = 1 << 16
CACHE_STATES = 1 << 18
#: The same where nothing else shares the worker's memory, as in round_trip(): what is met again is then rarely made anew.
ROOMY = 1 << 18, 1 << 19
#: Pairs of tokens that are remembered; and what stands for no token.
CACHE_PAIRS, NONE = 1 << 20, (1 << 31) - 1
#: Bytes of the pieces that go through the transducer side by side, bytes that such a state may leave undecided, and pieces of text split at once.
SHORT, PENDING, SPLIT = 64, 20, 1 << 18
#: Text bytes of which round_trip() encodes the distinct pieces together: the more, the fewer steps of the side by side ones.
AT_ONCE = 1 << 21


def load_ranks(path):
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Left-to-right BPE encoding of bytes.

    The last token of the encoding of every prefix is unique: it is the one token that ends there and
    whose pair with the last token before it re-encodes to itself. A state is (token before, pending
    bytes): the token emitted last and what isn't decided yet. A byte moves to a state made on first use:
    tokens before the last boundary that all readings of possible continuations share are emitted, so
    lookahead is bounded by how far a longer token can still reach back.
    """

    def __init__(self, ranks, kept=CACHE_STATES):
        self.ranks, self.kept = ranks, kept
        self.names = {rank: token for token, rank in ranks.items()}
        #: 1 for what a longer token begins with, 2 for tokens, 3 for both.
        self.known = dict.fromkeys(ranks, 2)
        for t in ranks:
            for i in range(1, len(t)):
                self.known[t[:i]] = self.known.get(t[:i], 0) | 1
        self.longest = max(map(len, ranks))
        self.pairs: dict = {}
        self.lives: dict = {}
        self.reset()

    def reset(self):
        self.states: dict = {(NONE, b""): 0}
        #: Of each state: pending bytes, and for each end in them the last token, its start and the boundaries of its reading as bits.
        self.views: list = [(b"", (NONE,), (0,), (1,))]
        self.moves: dict = {}
        self.final: list = [()]

    def merge(self, data):
        """The encoding by its definition, merging the pair of lowest rank, leftmost first; and (rank, first part, last part) after each merge. Only for short strings."""
        parts, life = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            life.append((best, parts[0], parts[-1]))
        return parts, life

    def life(self, token):
        """How a token is merged from bytes; None if its bytes encode to something else."""
        found = self.lives.get(token, 0)
        if found == 0:
            parts, life = self.merge(token)
            found = self.lives[token] = life if len(parts) == 1 else None
        return found

    def agree(self, left, right):
        """Whether token right is stable and can follow token left: in merging both, no pair across their border is ever the next to merge."""
        found = self.pairs.get(left << 32 | right)
        if found is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            token = self.names[right]
            found = self.pairs[left << 32 | right] = self.life(token) is not None and (left == NONE or self.border_holds(self.names[left], token))
        return found

    def border_holds(self, left, right):
        a, b, ranks, never = self.life(left), self.life(right), self.ranks, 1 << 60
        i = j = 0
        u, v = left[-1:], right[:1]
        while True:
            next_a = a[i][0] if i < len(a) else never
            next_b = b[j][0] if j < len(b) else never
            across = ranks.get(u + v, never)
            if across < next_a and across <= next_b:
                return False
            if next_a <= next_b:
                if next_a == never:
                    return True
                u = a[i][2]
                i += 1
            else:
                v = b[j][1]
                j += 1

    def step(self, state, byte):
        """(next state, ids emitted) for a byte first met in a state.

        An end whose last token begins before pending gets start None: no reading of the whole ends there.
        """
        pending, last, start, bits = self.views[state]
        pending += bytes([byte])
        n, known, own, shared = len(pending), self.known, None, -1
        for k in range(max(0, n - self.longest), n):
            if start[k] is not None and (kind := known.get(piece := pending[k:])):
                if own is None and kind > 1 and self.agree(last[k], self.ranks[piece]):
                    own, token = k, self.ranks[piece]
                if kind & 1:
                    shared &= bits[k]
        if own is None:
            raise ValueError("the vocabulary lacks a byte")
        last, start, bits = (*last, token), (*start, own), (*bits, bits[own] | 1 << n)
        shared &= bits[n]
        cut = shared.bit_length() - 1
        out, at = [], cut
        while at:
            out.append(last[at])
            at = start[at]
        key = last[cut], pending[cut:]
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.views)
            if cut:
                start = (0, *(x - cut if x is not None and x >= cut else None for x in start[cut + 1 :]))
                last, bits = last[cut:], tuple(x >> cut for x in bits[cut:])
            self.views.append((key[1], last, start, bits))
            self.final.append(None)
        move = self.moves[state << 8 | byte] = number, tuple(reversed(out))
        return move

    def finish(self, state):
        out = self.final[state]
        if out is None:
            pending, last, start, _ = self.views[state]
            out, at = [], len(pending)
            while at:
                out.append(last[at])
                at = start[at]
            out = self.final[state] = tuple(reversed(out))
        return out

    def encode(self, data):
        """Token ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.views) > self.kept:
            self.reset()
        out, state, moves = [], 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return [*out, *self.finish(state)]


class Table:
    """A hash table from 64-bit integers to 32-bit ones that answers for whole arrays; made once."""

    def __init__(self, keys, values):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[slot[left[put]]], self.values[slot[left[put]]] = keys[left[put]], values[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys):
        slot = self.slots(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


class Lanes:
    """The transducer for many short pieces side by side: all take their next byte at once.

    States and arcs are those of Transducer, made on first use, but as rows of arrays, and all arcs that the pieces
    of a step lack are made together. Of a state's pending bytes every end has its last token, that token's
    start, the boundaries of its reading as bits, and where the bytes from there on stand in the tree of tokens.
    A piece that leaves more than PENDING bytes undecided is encoded by itself.
    """

    def __init__(self, machine):
        self.machine = machine
        number = {b"": 0} | {t: i + 1 for i, t in enumerate(sorted(machine.known, key=len))}
        edges = [(number[t[:-1]] << 8 | t[-1], i) for t, i in number.items() if t]
        self.edges = Table(np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int32))
        #: Of each place in the tree the token it is and whether longer ones begin so; the last entry stands for no place.
        self.rank, self.inner = np.full(len(number) + 1, -1, np.int32), np.zeros(len(number) + 1, bool)
        for t, i in number.items():
            if t:
                kind = machine.known[t]
                self.inner[i] = kind & 1
                if kind > 1:
                    self.rank[i] = machine.ranks[t]
        self.reset()

    def reset(self):
        self.number, self.arcs, self.size = {}, {}, 0
        rows = 1 << 12
        self.length = np.zeros(rows, np.int64)
        self.bytes = np.zeros((rows, PENDING), np.uint8)
        self.last, self.start, self.bits = np.full((rows, PENDING + 1), NONE, np.int32), np.full((rows, PENDING + 1), -1, np.int8), np.zeros((rows, PENDING + 1), np.int32)
        self.node = np.full((rows, PENDING + 1), -1, np.int32)
        #: Of each arc: the next state, or -1 if it leaves too much undecided; where its tokens begin in self.out, and how many they are.
        self.next, self.at, self.count = (np.zeros(rows, np.int64) for _ in range(3))
        self.out, self.out_size = np.zeros(rows, np.int32), 0
        self.add(np.zeros(1, np.int64), np.zeros((1, PENDING), np.uint8), np.full((1, PENDING + 1), NONE, np.int32), np.array([[0] + [-1] * PENDING], np.int8), np.array([[1] + [0] * PENDING], np.int32), np.full((1, PENDING + 1), -1, np.int32))

    def grown(self, name, size):
        """The array of that name, with room for size rows."""
        old = getattr(self, name)
        if size > len(old):
            new = np.empty((max(size, 2 * len(old)), *old.shape[1:]), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def add(self, length, data, last, start, bits, node):
        """Numbers of states, which are made where they are new. The rows may be narrower than the tables."""
        names = np.zeros((len(length), 5 + PENDING), np.uint8)
        names[:, :4], names[:, 4], names[:, 5 : 5 + data.shape[1]] = last[:, :1].copy().view(np.uint8), length, data
        known, out, fresh, size = self.number, [], [], self.size
        for i, name in enumerate(names.view(f"V{names.shape[1]}").ravel().tolist()):
            k = known.setdefault(name, size)
            if k == size:
                fresh.append(i)
                size += 1
            out.append(k)
        for name, rows, rest in (("length", length, 0), ("bytes", data, 0), ("last", last, NONE), ("start", start, -1), ("bits", bits, 0), ("node", node, -1)):
            table = self.grown(name, size)
            if rows.ndim > 1:
                table[self.size : size, : rows.shape[1]] = rows[fresh]
                table[self.size : size, rows.shape[1] :] = rest
            else:
                table[self.size : size] = rows[fresh]
        self.size = size
        return np.array(out, np.int64)

    def agree(self, left, right):
        """Transducer.agree() for arrays."""
        pairs, inverse = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        known, agree = self.machine.pairs, self.machine.agree
        found = [known.get(p) for p in pairs.tolist()]
        for i, f in enumerate(found):
            if f is None:
                found[i] = agree(int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF)
        return np.array(found, bool)[inverse]

    def back(self, last, start, end):
        """Tokens on the way back from position end of each row to its begin, last first: (rows, tokens) of each step."""
        rows, out = np.arange(len(end)), []
        at = end.astype(np.int64)
        rows, at = rows[at > 0], at[at > 0]
        while len(rows):
            out.append((rows, last[rows, at]))
            at = start[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        return out

    @staticmethod
    def flat(steps, n):
        """The tokens of back() row by row in reading order, and how many each of n rows has."""
        rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in steps)])
        tokens = np.concatenate([np.zeros(0, np.int32), *(t for _, t in steps)])
        order = np.argsort(rows[::-1], kind="stable")
        return tokens[::-1][order], np.bincount(rows, minlength=n)

    def compile(self, keys):
        """New arcs (state << 8 | byte)."""
        state, byte = keys >> 8, keys & 255
        m, n = len(keys), self.length[state] + 1
        over = n > PENDING
        n[over] = 1  # such rows are worked out to no purpose
        width = int(n.max()) + 1
        row, wide = np.arange(m), np.arange(width)
        last, start, bits, node, data = (t[state, :width] for t in (self.last, self.start, self.bits, self.node, self.bytes))
        last[over], start[over], bits[over], node[over] = NONE, -1, 1, -1
        start[over, 0] = 0
        data[row, n - 1] = byte
        node[row, n - 1] = 0
        child = np.full(node.shape, -1, np.int32)
        live = np.flatnonzero(node >= 0)
        child.ravel()[live] = self.edges[node.ravel()[live].astype(np.int64) << 8 | byte[live // width]]
        rank = self.rank[child]
        shared = np.bitwise_and.reduce(np.where(self.inner[child], bits, -1), axis=1)
        own, left, may = np.empty(m, np.int64), row, rank >= 0
        while len(left):
            k = may[left].argmax(axis=1)
            if not may[left, k].all():
                raise ValueError("the vocabulary lacks a byte")
            fits = self.agree(last[left, k], rank[left, k])
            own[left[fits]] = k[fits]
            left, k = left[~fits], k[~fits]
            may[left, k] = False
        last[row, n], start[row, n], bits[row, n], child[row, n] = rank[row, own], own, bits[row, own] | (1 << n).astype(np.int32), -1
        shared &= bits[row, n]
        cut = np.frexp(shared.astype(np.float64))[1].astype(np.int64) - 1
        tokens, count = self.flat(self.back(last, start, cut), m)
        moved = np.flatnonzero(cut)  # their pending bytes begin later now
        if len(moved):
            c, r = cut[moved, None], moved[:, None]
            at = c + wide
            inside = at <= n[moved, None]
            at = np.minimum(at, width - 1)
            to = np.where(inside, start[r, at] - c, -1)
            to[:, 0] = 0
            ends = to >= 0
            start[moved] = np.where(ends, to, -1)
            last[moved] = np.where(ends, last[r, at], NONE)
            bits[moved] = np.where(ends, bits[r, at] >> c, 0)
            child[moved] = np.where(ends, child[r, at], -1)
            data[moved] = np.where(at < n[moved, None], data[r, np.minimum(at, data.shape[1] - 1)], 0)[:, : data.shape[1]] * inside[:, : data.shape[1]]
        to = self.add(n - cut, data, last, start, bits, child)
        first, end = len(self.arcs), len(self.arcs) + m
        self.grown("next", end)[first:end] = np.where(over, -1, to)
        self.grown("at", end)[first:end] = self.out_size + np.cumsum(count) - count
        self.grown("count", end)[first:end] = np.where(over, 0, count)
        self.grown("out", self.out_size + len(tokens))[self.out_size : self.out_size + len(tokens)] = tokens
        self.out_size += len(tokens)
        self.arcs.update(zip(keys.tolist(), range(first, end), strict=True))

    def encode(self, pieces):
        """Token ids of each of some pieces of 1 to SHORT bytes."""
        if self.size > self.machine.kept:
            self.reset()
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        data = np.zeros((len(pieces), int(sizes.max(initial=0))), np.uint8)
        data[np.arange(data.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        data, alone = data[order], np.zeros(len(pieces), bool)
        state, said, find = np.zeros(len(pieces), np.int64), [], self.arcs.get
        for step in range(data.shape[1]):
            n = int(np.searchsorted(-sizes[order], -step, "left"))
            keys, inverse = np.unique(state[:n] << 8 | data[:n, step], return_inverse=True)
            arc = np.array([find(k, -1) for k in keys.tolist()], np.int64)
            missing = np.flatnonzero(arc < 0)
            if len(missing):
                arc[missing] = len(self.arcs) + np.arange(len(missing))
                self.compile(keys[missing])
            arc = arc[inverse]
            state[:n] = self.next[arc]
            lost = state[:n] < 0
            if lost.any():
                alone[:n] |= lost
                state[:n][lost] = 0
            speaks = np.flatnonzero(self.count[arc])
            said.append((speaks, self.at[arc[speaks]], self.count[arc[speaks]]))
        ends, inverse = np.unique(state, return_inverse=True)
        tokens, count = self.flat(self.back(self.last[ends], self.start[ends], self.length[ends]), len(ends))
        first = np.cumsum(count) - count
        source = np.concatenate([self.out[: self.out_size], tokens])
        said.append((np.arange(len(pieces)), self.out_size + first[inverse], count[inverse]))
        row, at, count = (np.concatenate([x[i] for x in said]) for i in range(3))
        by = np.argsort(row, kind="stable")
        row, at, count = row[by], at[by], count[by]
        flat = source[np.repeat(at, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)].tolist()
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, count, len(pieces)).astype(np.int64))]).tolist()
        out: list = [None] * len(pieces)
        for i, own in enumerate(order.tolist()):
            out[own] = self.machine.encode(pieces[own]) if alone[i] else flat[edge[i] : edge[i + 1]]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding: feed bytes in any cuts, get the text that is complete; errors are replaced."""

    #: Bytes that a lead byte starts, by its high five bits.
    NEED = (1,) * 16 + (0,) * 8 + (2,) * 4 + (3,) * 2 + (4, 0)

    def __init__(self):
        self.held = b""

    def feed(self, data):
        data = self.held + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            need = self.NEED[data[end - back] >> 3]
            if need:
                if need > back:
                    end -= back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self):
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path, pattern, ready=CACHE_PIECES, kept=CACHE_STATES):
        import regex

        self.pattern = regex.compile(pattern)
        self.machine = Transducer(load_ranks(path), kept)
        self.lanes = Lanes(self.machine)
        self.written = {rank: str(rank) for rank in self.machine.names}
        self.token = {self.written[rank]: token for token, rank in self.machine.ranks.items()}
        self.ready, self.now, self.old = ready, {}, {}

    def learn(self, pieces):
        """Ids of each of a set of pieces by piece; those not ready-made are encoded together."""
        now, old, ranks = self.now, self.old, self.machine.ranks
        if len(now) > self.ready:
            self.now, self.old = now, old = {}, now
        long, short = {}, {}
        for p in pieces.difference(now):
            ids = old.get(p)
            if ids is not None:
                now[p] = ids
                continue
            data = p.encode()
            whole = ranks.get(data)
            if whole is not None:
                now[p] = str(whole)
            elif len(data) > SHORT:
                long[p] = " ".join(map(self.written.__getitem__, self.machine.encode(data)))
            else:
                short[p] = data
        if short:
            written = self.written.__getitem__
            now.update(zip(short, [" ".join(map(written, ids)) for ids in self.lanes.encode(list(short.values()))], strict=True))
        return now if not long else now | long

    def encode_texts(self, texts):
        """Ids in decimal, joined by one space, of each text; a bounded number of pieces at a time."""
        out: list = [[] for _ in texts]
        held, size = [], 0

        def flush():
            ready = self.learn(set(itertools.chain.from_iterable([own for _, own in held])))
            for i, own in held:
                out[i].append(" ".join(map(ready.__getitem__, own)))

        for i, text in enumerate(texts):
            text = text or ""
            found = iter(self.pattern.findall(text)) if len(text) <= PIECE_BYTES else (m[0] for m in self.pattern.finditer(text))
            while own := list(itertools.islice(found, SPLIT - size)):
                held.append((i, own))
                size += len(own)
                if size >= SPLIT:
                    flush()
                    held, size = [], 0
        flush()
        return [" ".join(parts) for parts in out]

    def encode_text(self, text):
        return self.encode_texts([text])[0]

    def decode_bytes(self, ids, at_once=8192):
        """Bytes of ids in decimal, in chunks."""
        parts = ids.split(" ") if ids else []
        for i in range(0, len(parts), at_once):
            yield b"".join(map(self.token.__getitem__, parts[i : i + at_once]))

    def decode_text(self, ids):
        stream = Utf8Stream()
        return "".join([stream.feed(x) for x in self.decode_bytes(ids)]) + stream.close()

    def decoded_sha256(self, ids):
        """The digest of the text that the ids decode to in a stream."""
        stream, back = Utf8Stream(), hashlib.sha256()
        for chunk in self.decode_bytes(ids):
            back.update(stream.feed(chunk).encode())
        back.update(stream.close().encode())
        return back.hexdigest()


_codecs: dict = {}
_kept.append(_codecs)


def codec(path, pattern, *sizes):
    """One codec for each worker process, of one vocabulary and, if not the usual ones, sizes of its tables."""
    key = path, pattern, *sizes
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*key)
    return _codecs[key]


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs, keep=("doc_id",), vocabulary=None, text="text"):
    """docs with a column ids: the token ids of the whole text as array<int>; null counts as empty, empty has no ids.

    Repeated rows are encoded each; an empty table stays empty; only the columns in keep go along.
    """
    path, pattern = vocabulary or default_vocabulary()
    schema = ", ".join([f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>"])

    @worker("bpe")
    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in pieces(whole, "__text"):
                ids = [np.array(t.split(), np.int32) for t in own.encode_texts(batch.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def decode(tokens, keep=("doc_id",), vocabulary=None):
    """A table with ids array<int> to one with text; null ids count as none."""
    path, pattern = vocabulary or default_vocabulary()
    schema = ", ".join([f"`{tokens.schema[c].name}` {tokens.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])

    @worker("bpe")
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode_text(" ".join(map(str, x or ()))) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, tokens["ids"].alias("__ids")).mapInArrow(run, schema)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs, keep=("doc_id",), vocabulary=None):
    """For each row of docs: how many tokens, and digests of the ids and of the text decoded from them in a stream.

    Null counts as empty, which has no tokens; repeated rows are encoded each; an empty table stays empty; only the columns in keep
    go along, whatever the others' names.
    """
    tune(docs.sparkSession)
    path, pattern = vocabulary or default_vocabulary()
    schema = ", ".join([f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [DIGEST])

    @worker("bpe")
    def run(batches):
        own = codec(path, pattern, *ROOMY)
        for whole in batches:
            for batch in pieces(whole, "__text", AT_ONCE):
                counts, ids_sha, decoded_sha = [], [], []
                for ids in own.encode_texts(batch.column(len(keep)).to_pylist()):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(own.decoded_sha256(ids))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def tokenized(docs, keep=("doc_id",), vocabulary=None):
    """docs with n_tokens, tokens array<int> and decoded_sha256: the digest of the text that the ids decode to in a stream.

    Null counts as empty, which has no tokens; repeated rows are encoded each; an empty table stays empty; only the columns in keep
    go along, whatever the others' names.
    """
    tune(docs.sparkSession)
    path, pattern = vocabulary or default_vocabulary()
    schema = ", ".join([f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long, tokens array<int>, decoded_sha256 string"])

    @worker("bpe")
    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in pieces(whole, "__text"):
                tokens, decoded = [], []
                for ids in own.encode_texts(batch.column(len(keep)).to_pylist()):
                    tokens.append(np.array(ids.split(), np.int32))
                    decoded.append(own.decoded_sha256(ids))
                offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *tokens])))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(decoded, pa.string())], names=[*keep, "n_tokens", "tokens", "decoded_sha256"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def op6_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))

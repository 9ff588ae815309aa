"""Secret scans: patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa

from .common import lower_ascii, pieces, table, tune, utf8, word_spans, worker

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words of which an assignment or an access key must hold one, in lower case.
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")

#: Character classes of candidate strings: name, members, window, least entropy in bits a character.
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 24, 3.2),
    ("alnum", "0-9A-Za-z", 24, 4.0),
    ("base64", "0-9A-Za-z+/_=-", 24, 4.1),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Candidates of these forms are no secrets: uuids, plain words joined by - or _, paths of words, numbers, one repeated sign.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[A-Za-z]+(?:[-_/=+][A-Za-z]*)*|[-_/=+]*[0-9]+(?:[-_/=+][0-9]*)*|[-_/=+]+")

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_LONG_BYTES = np.zeros(256, bool)
_LONG_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def base_spans(text):
    """(start, kind index, end) of the three patterns, each leftmost and without overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def char_class(run):
    """The narrowest class that holds all characters of a candidate."""
    if not run.strip("0123456789abcdefABCDEF"):
        return CLASSES[0]
    return CLASSES[1] if run.isalnum() else CLASSES[2]


def entropy_windows(run, window, least):
    """Merged (start, end) of the windows with at least that Shannon entropy; counts are kept up as the window slides."""
    if len(run) < window:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # one more, before the oldest leaves
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[list[int]] = []
    most = window * (math.log2(window) - least) + 1e-9
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += part[c + 1] - part[c]
        counts[ch] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        if i >= window - 1 and total <= most:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1][1] = i + 1
            else:
                spans.append([i - window + 1, i + 1])
    return spans


def entropy_spans(text, taken):
    """(start, kind index, end) of high-entropy stretches of candidates, but for allow-listed ones and those inside taken spans."""
    found = []
    order = sorted(taken)
    starts, reach = [x[0] for x in order], list(accumulate((x[2] for x in order), max))
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if ALLOWED.fullmatch(run):
            continue
        _, _, window, least = char_class(run)
        for a, b in entropy_windows(run, window, least):
            a, b = a + m.start(), b + m.start()
            i = bisect_right(starts, a)
            if not i or reach[i - 1] < b:
                found.append((a, 3, b))
    return found


def scan_text(text):
    """All spans of one text, by start and then kind."""
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base))


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def suspects(data, offsets):
    """Which documents can hold a span at all: a long run of hex or candidate bytes, or a cue word. Exact: no other does."""
    flag = np.zeros(len(offsets) - 1, bool)
    for member, least in ((_HEX_BYTES, 16), (_LONG_BYTES, 24)):
        starts, ends, doc = word_spans(data, offsets, member)
        flag[doc[ends - starts >= least]] = True
    low = lower_ascii(data).tobytes()
    for cue in CUES:
        at = low.find(cue)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            flag[doc] = True
            at = low.find(cue, int(offsets[doc + 1]))
    return flag


SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"


def scan(docs, keep=("doc_id",)):
    """docs(text, ...) with a column spans: kind, start and end of each secret, in code points, by start.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table stays empty.
    keep names the columns that go along; others, whatever their names, are ignored.
    """
    fields = [docs.schema[c] for c in keep]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SCHEMA])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @worker("secrets")
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "__text"):
                column = batch.column(batch.schema.get_field_index("__text"))
                flag = suspects(*utf8(column))
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(column[i].as_py())] if f else [] for i, f in enumerate(flag)]
                columns = [batch.column(i) for i in range(len(keep))] + [pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "spans"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, out_schema)


def redact(docs, mark="[SECRET]"):
    """docs with every secret span of text replaced by mark, overlapping spans together; n_chars follows."""
    names = docs.columns
    schema = docs.schema

    @worker("secrets")
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                at = batch.schema.get_field_index("text")
                column = batch.column(at)
                flag = suspects(*utf8(column))
                if not flag.any():
                    yield batch
                    continue
                texts = column.to_pylist()
                for i in np.flatnonzero(flag):
                    texts[i] = cut(texts[i], mark)
                columns = [batch.column(j) for j in range(batch.num_columns)]
                columns[at] = pa.array(texts, column.type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    columns[j] = pa.array([len(t) if flag[i] else n for i, (t, n) in enumerate(zip(texts, columns[j].to_pylist(), strict=True))], columns[j].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def cut(text, mark):
    out, done, until = [], 0, -1
    for a, _, b in scan_text(text):
        if a >= until:
            out += [text[done:a], mark]
        until = done = max(until, b)
    return "".join([*out, text[done:]])


def op7_secrets(spark, sf_dir):
    """The contract's digest of scan()."""
    from pyspark.sql import functions as F

    tune(spark)
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest(text):
    """The same row by plain Python, for tests."""
    spans = scan_text(text or "")
    base = [x for x in spans if x[1] < 3]
    return (*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans))

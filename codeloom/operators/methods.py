"""Method sets through embedding, and which types have all methods of an interface."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed
from .spread import joined


def embedded(embeds):
    """owner, part, depth, paths, indirect: what a type embeds, itself at depth 0, by the least depth only.

    embeds is owner, part, pointer. paths tells by how many ways of that depth a part is met (2 for more: then what it promotes is
    ambiguous), indirect whether one of them goes through a pointer. A part that was met at a lesser depth isn't met again, so cycles end.
    """
    embeds = embeds.groupBy("owner", "part").agg(F.count("*").alias("times"), F.max("pointer").alias("pointer")).persist()
    types = embeds.select("owner").unionAll(embeds.select(F.col("part").alias("owner"))).distinct()
    frontier = seen = checkpointed(types.select("owner", F.col("owner").alias("part"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("paths"), F.lit(False).alias("indirect")))
    depth = 0
    while True:
        depth += 1
        step = embeds.select(F.col("owner").alias("part"), F.col("part").alias("next"), "times", "pointer")
        found = frontier.join(step, "part").groupBy("owner", F.col("next").alias("part"))
        found = found.agg(F.lit(depth).alias("depth"), F.least(F.sum(F.col("paths") * F.col("times")), F.lit(2)).cast("long").alias("paths"), F.max(F.col("indirect") | F.col("pointer")).alias("indirect"))
        frontier = checkpointed(found.join(seen, ["owner", "part"], "left_anti").select(*seen.columns))
        if frontier.isEmpty():
            embeds.unpersist()
            return seen
        seen = seen.unionByName(frontier)


#: Parts met of a share of the types: what one task makes rows of names of at a time.
REACHED = 1 << 16


def _by_owner(rows, reach):
    """rows, all of an owner together, in parts by the number of reach once these are more than tasks at once: else a task grows where Spark's number of them is fixed."""
    n = reach.count() // REACHED
    return rows.repartition(*([n] if n > rows.sparkSession.sparkContext.defaultParallelism else []), "owner")


def method_sets(declared, embeds):
    """owner, name, signature, value, depth: the methods of a pointer to each type, its own and those promoted from what it embeds.

    declared is owner, name, signature, pointer (of the receiver); a null signature is a field, which takes its name and is no method.
    A part may be embedded in any share of the types, so they meet what it declares in many parts; all of a type then stays together, counted without another
    exchange. A name counts at its least depth, and not at all where that depth has it twice. value tells whether the type itself has the method too, not
    only a pointer to it: for a value receiver, or where a pointer is embedded on the way.
    """
    own = declared.groupBy("owner", "name").agg(F.count("*").alias("times"), F.min(F.struct(F.col("signature"), F.col("pointer"))).alias("m"))
    reach = embedded(embeds).where("depth > 0")
    itself = own.select("owner", "name", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("paths"), F.lit(False).alias("indirect"), "times", "m")
    parts = own.withColumnRenamed("owner", "part").join(embeds.select("part").distinct(), "part", "left_semi")
    met = _by_owner(joined(reach, parts, ["part"], ["owner"]).select(*itself.columns).unionByName(itself), reach)
    at_depth = met.groupBy("owner", "name", "depth").agg(F.sum(F.col("paths") * F.col("times")).alias("n"), F.min("m").alias("m"), F.max("indirect").alias("indirect"))
    nearest = at_depth.groupBy("owner", "name").agg(F.min(F.struct("depth", "n", "m", "indirect")).alias("s")).where("s.n = 1 AND s.m.signature IS NOT NULL")
    return nearest.select("owner", "name", "s.m.signature", (~F.col("s.m.pointer") | F.col("s.indirect")).alias("value"), "s.depth")


def interface_sets(declared, embeds):
    """owner, name, signature: the methods of each interface and of all interfaces it embeds, at any depth."""
    reach = embedded(embeds.select("owner", "part", F.lit(False).alias("pointer"))).select("owner", "part")
    met = reach.join(declared.select(F.col("owner").alias("part"), "name", "signature"), "part").select("owner", "name", "signature")
    return _by_owner(met.unionByName(declared.select("owner", "name", "signature")), reach).distinct()


#: Types of a block and interface methods of a chunk, and bytes of either: what one task holds at a time. Sets are packed by PACKED at most.
TYPES, WANTED, HELD, PACKED = 1 << 18, 1 << 23, 1 << 27, 1 << 12
PAIRS = "from_fqn string, to_fqn string"


def _packed(batches, most):
    """Many sets a row, as an Arrow stream with the methods as numbers in a dictionary: few bytes a set to write down and deal out. most: owners, methods and bytes of a row."""
    for batch in batches:
        size = batch["methods"].value_lengths().to_numpy()
        texts = np.concatenate([[0], np.cumsum(pc.binary_length(batch["methods"].flatten()).to_numpy(), dtype=np.int64)])[np.cumsum(size)]
        held = texts + np.cumsum(pc.binary_length(batch["fqn"]).to_numpy() + 8 * size)
        share = np.max([np.arange(len(size)) // most[0], np.cumsum(size) // most[1], held // most[2]], axis=0)
        cuts = sorted({0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(size)})
        for a, b in zip(cuts, cuts[1:]):
            methods = batch["methods"][a:b].flatten().dictionary_encode()
            least = pa.from_numpy_dtype(np.min_scalar_type(len(methods.dictionary)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[a:b])]), pa.int32()), pa.DictionaryArray.from_arrays(methods.indices.cast(least), methods.dictionary))
            sets, sink = pa.RecordBatch.from_arrays([batch["fqn"][a:b], lists], ["fqn", "methods"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sets.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(sets)
            yield pa.RecordBatch.from_pydict({"owners": [b - a], "methods": [len(methods)], "bytes": [int(held[b - 1] - (held[a - 1] if a else 0))], "sets": [sink.getvalue().to_pybytes()]})


def _unpacked(rows):
    """Names of the owners, sizes of their sets, and all their methods as places in an array of texts, which may repeat."""
    sets = [pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in rows]
    methods = [x["methods"].flatten() for x in sets]
    before = np.cumsum([0, *(len(x.dictionary) for x in methods)])
    places = np.concatenate([np.add(x.indices.to_numpy(), n, dtype=np.int32, casting="unsafe") for x, n in zip(methods, before)])
    return pa.concat_arrays([x["fqn"] for x in sets]), np.concatenate([x["methods"].value_lengths().to_numpy() for x in sets]), places, pa.concat_arrays([x.dictionary for x in methods])


def _holders(batches):
    """Pairs of one block of types with one chunk of interfaces.

    Each interface is a list of methods, those that most interfaces want first, and the lists are taken in their order: what types have the methods
    that an interface begins with is found once for all interfaces that begin so, and where none has them, these are left at once.
    """
    types, faces = [], []
    for batch in batches:
        for of_type, sets in zip(batch["type"].to_pylist(), batch["sets"]):
            (types if of_type else faces).append(sets)
    if not types or not faces:
        return
    type_names, size, places, texts = _unpacked(types)
    base = texts.unique()
    number = lambda texts, places: pc.fill_null(pc.index_in(texts, value_set=base), -1).to_numpy()[places]
    what = number(texts, places)
    who = np.repeat(np.arange(len(size), dtype=np.int32), size)[np.argsort(what, kind="stable")]
    count = np.bincount(what, minlength=len(base))
    at = np.concatenate([[0], np.cumsum(count)])

    names, size, places, texts = _unpacked(faces)
    wants, face, known = number(texts, places), np.repeat(np.arange(len(size)), size), np.ones(len(size), bool)
    known[face[wants < 0]] = False
    names, wants, size = names.filter(pa.array(known)), wants[known[face]], size[known]
    if not len(size):
        return
    order, start, size, shared, wants = _in_order(wants, size, count)
    face_names = names.take(pa.array(order))
    frequent = {}

    def narrowed(some, m):
        own = who[at[m] : at[m + 1]]
        if some is None:
            return own
        if count[m] * 8 >= len(type_names):
            if m not in frequent:
                frequent[m] = np.zeros(len(type_names), bool)
                frequent[m][own] = True
            left = some[frequent[m][some]]
        else:
            few, many = (some, own) if len(some) < len(own) else (own, some)
            left = few[many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few]
        return some if len(left) == len(some) else left

    kept, lost, found, n = [None], 0, [], 0  # kept[k]: the types that have the first k methods; none has the first lost ones
    for f in range(len(size)):
        if 0 < lost <= shared[f]:
            continue
        del kept[shared[f] + 1 :]
        lost = 0
        for m in wants[start[f] + shared[f] : start[f] + size[f]].tolist():
            some = narrowed(kept[-1], m)
            if not len(some):
                lost = len(kept)
                break
            kept.append(some)
        else:
            found.append((f, kept[-1]))
            n += len(kept[-1])
        if n > 1 << 16:
            yield _pairs(type_names, face_names, found)
            found, n = [], 0
    if found:
        yield _pairs(type_names, face_names, found)


def _in_order(wants, size, count):
    """Lists of methods in order, each with the most wanted first and of these the rarest: (which list, start, size, how many methods are as in the list before, methods)."""
    popular = np.lexsort((count, -np.bincount(wants, minlength=len(count))))
    rank = np.empty(len(count), np.int64)
    rank[popular] = np.arange(len(count))
    rows = np.repeat(np.arange(len(size)) << 32, size) | rank[wants]
    rows.sort()
    rows = (rows & 0xFFFFFFFF).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    lists = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(start * 4), pa.py_buffer(rows.astype(">i4"))])
    order = pc.sort_indices(lists).to_numpy()
    start, size = start[order], size[order]
    shared, same, k = np.zeros(len(size), np.int64), np.arange(1, len(size)), 0
    while len(same):
        same = same[(size[same] > k) & (size[same - 1] > k)]
        same = same[rows[start[same] + k] == rows[start[same - 1] + k]]
        shared[same] += 1
        k += 1
    return order, start.tolist(), size.tolist(), shared.tolist(), popular[rows]


def _pairs(type_names, face_names, found):
    faces = np.repeat([f for f, _ in found], [len(some) for _, some in found])
    return pa.RecordBatch.from_arrays([type_names.take(pa.array(np.concatenate([some for _, some in found]))), face_names.take(pa.array(faces))], ["from_fqn", "to_fqn"])


def _sets(methods):
    """fqn, methods, whole: all methods of each owner in a row, and whether none of them is null."""
    method = F.concat(F.char_length("name").cast("string"), F.lit(":"), "name", "signature")  # told apart by the length, null where the signature is
    rows = methods.where("owner IS NOT NULL").select(F.col("owner").alias("fqn"), method.alias("method"))
    return rows.groupBy("fqn").agg(F.collect_set("method").alias("methods"), F.min(F.col("method").isNotNull()).alias("whole")).where("size(methods) > 0")


def implementations(methods, interface_methods):
    """from_fqn, to_fqn of types that have every method of an interface: methods(owner, name, signature), interface_methods alike.

    The pairs to be tested are as many as types times interfaces, so none is a row before it has passed: blocks of some TYPES types meet chunks of
    some WANTED interface methods. Packed sets are dealt, a type's once a chunk and an interface's once a block. Interfaces without methods match nothing.
    """
    most = (min(PACKED, TYPES), WANTED, HELD >> 4)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, most)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _holders(batches)

    def packs(sets, n, limit):
        """The packed sets, and of how many parts each is one, and which."""
        found = checkpointed(sets.select("fqn", "methods").mapInArrow(packed, "owners long, methods long, bytes long, sets binary").withColumn("id", F.monotonically_increasing_id()))
        parts = max(1, *(-(-(x or 0) // y) for x, y in zip(found.agg(F.sum(n), F.sum("bytes")).first(), (limit, HELD))))
        return found.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "sets"), parts

    has, blocks = packs(_sets(methods), "owners", TYPES)
    wants, chunks = packs(_sets(interface_methods).where("whole"), "methods", WANTED)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = has.withColumn("other", each(chunks)).select((F.col("part") * chunks + F.col("other")).alias("cell"), F.lit(True).alias("type"), "sets")
    right = wants.withColumn("other", each(blocks)).select((F.col("other") * chunks + F.col("part")).alias("cell"), F.lit(False).alias("type"), "sets")
    return left.unionByName(right).repartitionById(blocks * chunks, "cell").mapInArrow(holders, PAIRS).where("from_fqn <> to_fqn")

"""Removal of byte strings that an earlier document also holds, by bucket-pointer refinement of suffixes.

Every string of ``length`` bytes is a window, the depth to which suffixes are sorted. Three steps bring equal windows together without shipping all suffixes:

1. Texts are cut where their content says so, and pieces (with the ``length - 1`` bytes that follow, so that each window lies in one piece) meet by a 128-bit hash. A piece
   that a smaller document holds as a whole needs no further look, and copies of whole documents end here. Only hashes are shuffled, combined before the shuffle.
2. Windows of the other pieces belong to the bucket of their smallest 16-gram (by hash): equal windows have equal smallest 16-grams. Sorted arrays of bucket numbers are exchanged
   first, and only windows of buckets that occur in more than one document go on. Neighbours of one bucket travel as one string, and a task sends equal strings once, with a
   list of places.
3. A bucket's strings are sorted by bucket-pointer refinement: initial buckets by q-gram, then buckets of depth 2q, 4q, ... by sorting on the pair of a
   suffix's own bucket and the bucket of its later offset, each refinement being used by the next, up to ``length``. Suffixes alone in their bucket drop out at once.
   The smallest document of a final bucket decides for all its windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, map_arrow, slices, stage, utf8

LENGTH = 50
Q = 16
#: Bytes of a content-defined piece, on average and at most.
PIECE, PIECE_MAX = 160, 4096
#: Bytes of window strings that one bucket group should hold.
GROUP_BYTES = 6 << 20
#: Text bytes after which a task sends what it has gathered.
SEND_BYTES = 12 << 20
#: Bytes that arrays of eight bytes per position are made for at once.
ARRAY_BYTES = 2 << 20
#: Bytes of a bucket number while buckets of one document are sorted out; numbers that coincide only let more windows through.
SLOT_BYTES = 5
#: Bytes of new text whose bucket numbers are exchanged together.
CHUNK_BYTES = 8 << 20
ADDED = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on, as an integer: an exact identifier of an 8-gram."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).copy()


def _mix(x: np.ndarray, factor: int) -> np.ndarray:
    x = x * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _grams(eights: np.ndarray) -> np.ndarray:
    """A hash of the 16-gram at each offset."""
    first = _mix(eights, 0x9E3779B97F4A7C15)
    return _mix(first[:-8] + (eights[8:] ^ np.uint64(0x2545F4914F6CDD1D)), 0xD6E8FEB86659FD93)


def _lows(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _cut(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut to at most ``most``; also which run each comes from."""
    parts = (sizes + most - 1) // most
    row = np.repeat(np.arange(len(starts)), parts)
    shift = _within(parts) * most
    return starts[row] + shift, np.minimum(sizes[row] - shift, most), row


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _pieces(raw: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows) of each content-defined piece of the texts that lie in a row in ``raw``."""
    data = np.frombuffer(raw + b"\0" * (Q + 8), np.uint8)
    windows = np.maximum(np.diff(bounds) - length + 1, 0)
    marks = np.flatnonzero(_grams(_eights(data)) < np.uint64((1 << 64) // PIECE))
    doc = np.searchsorted(bounds, marks, "right") - 1
    marks = marks[(doc < len(windows)) & (marks - bounds[doc] < windows[np.minimum(doc, len(windows) - 1)])]
    full = np.flatnonzero(windows)
    starts = np.unique(np.concatenate([bounds[:-1][full], marks]))
    doc = np.searchsorted(bounds[:-1][full], starts, "right") - 1
    ends = np.append(starts[1:], 0)
    ends = np.where(np.append(doc[1:] != doc[:-1], True), (bounds[:-1] + windows)[full][doc], ends)
    starts, sizes, row = _cut(starts, ends - starts, PIECE_MAX)
    doc = full[doc[row]]
    return doc, starts - bounds[doc], sizes


def _texts(batch: pa.RecordBatch, at: int) -> tuple[bytes, np.ndarray]:
    column = utf8(batch.column(at))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""), (ends - ends[0]).astype(np.int64)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of the tuples of identifiers."""
    rank = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for key in keys[1:]:
        rank = np.unique(rank << np.uint64(32) | np.unique(key, return_inverse=True)[1].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return rank


def refine(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``starts``, their final buckets) for the suffixes that share their first ``length`` bytes with another; ``data`` has 8 bytes of padding at its end.

    Initial buckets are those of the 8-gram. A bucket of depth 2d is the rank of (own bucket, bucket of the suffix d later) at depth d. Both are
    ranked together, so that a refinement is at once the identifier of the next. The last step overlaps the one before to end at ``length`` exactly.
    """
    eights = _eights(data)
    own = np.arange(len(starts))
    # alone in a slot of the hashed window means alone in its bucket
    mark = _mix(eights[starts], 0x9E3779B97F4A7C15)
    for k in [*range(8, length - 7, 8), length - 8]:
        mark = _mix(mark + eights[starts + k], 0xD6E8FEB86659FD93)
    bits = max(10, int(len(starts)).bit_length() + 1)
    slot = (mark >> np.uint64(64 - bits)).astype(np.int64)
    own = own[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    own = own[_shared(mark[own])]
    steps, depth = [], 8
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    needed = [np.array([0])]
    for step in reversed(steps):
        needed.append(np.unique(np.concatenate([needed[-1], needed[-1] + step])))
    offsets = needed.pop()
    at = starts[own]
    buckets = {int(o): part for o, part in zip(offsets, np.split(_rank(np.concatenate([eights[at + o] for o in offsets])), len(offsets)))}
    for step in steps:
        if not len(own):
            break
        offsets = needed.pop()
        ranked = _rank(np.concatenate([buckets[int(o)] for o in offsets]), np.concatenate([buckets[int(o + step)] for o in offsets]))
        buckets = {int(o): part for o, part in zip(offsets, np.split(ranked, len(offsets)))}
        alive = _shared(buckets[0])
        own, buckets = own[alive], {o: b[alive] for o, b in buckets.items()}
    return own, buckets[0] if len(own) else np.empty(0, np.uint64)


def _shared(keys: np.ndarray) -> np.ndarray:
    """True where another has the same key."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[which] > 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _occurrences(base: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        import xxhash

        for batch in slices(batches, "text", ARRAY_BYTES):
            raw, bounds = _texts(batch, 2)
            doc, pos, sizes = _pieces(raw, bounds, length)
            begin = bounds[doc] + pos
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + sizes + length - 1).tolist())]), "<i8").reshape(-1, 2)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int64()), pa.array(sizes, pa.int32()),
                                              pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["doc_id", "mark", "pos", "n", "h1", "h2"])

    return map_arrow(base, cut, "doc_id bigint, mark bigint, pos bigint, n int, h1 bigint, h2 bigint")


def _regions(joined: DataFrame, length: int) -> DataFrame:
    """Runs of new windows with their bytes, in numbered chunks: chunk, doc_id, copy, pos, bytes."""

    def cut(batches):
        from pyspark import TaskContext

        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text"):
            raw, bounds = _texts(batch, 2)
            doc, pos, sizes = [], [], []
            for k, spans in enumerate(batch.column(3).to_pylist()):
                last = -1
                for at, n in sorted((s["pos"], s["n"]) for s in spans):
                    if at == last:
                        sizes[-1] += n
                    elif at > last:
                        doc.append(k)
                        pos.append(at)
                        sizes.append(n)
                    last = max(last, at + n)
            rows = pa.array(doc, pa.int64())
            parts = [raw[bounds[k] + at:bounds[k] + at + n + length - 1] for k, at, n in zip(doc, pos, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(doc), pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int64()), pa.array(parts, pa.binary())],
                                             names=["chunk", "doc_id", "copy", "pos", "bytes"])
            filled += sum(map(len, parts))
            if filled > CHUNK_BYTES:
                chunk, filled = chunk + 1, 0

    return map_arrow(joined, cut, "chunk bigint, doc_id bigint, copy int, pos bigint, bytes binary")


def _buckets(column: pa.Array, length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, begin of each region, windows of each, begin of each run of windows of one bucket, its bucket's hash) of the regions of a batch."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    base, sizes = ends[:-1] - ends[0], np.diff(ends) - length + 1
    low = _lows(_grams(_eights(np.frombuffer(raw + b"\0" * (length + 16), np.uint8))), length - Q + 1)[:len(raw)]
    head = np.ones(len(low), bool)
    head[1:] = low[1:] != low[:-1]
    head[base] = True
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[base] += 1
    inside[base + sizes] -= 1
    first = np.flatnonzero(head & (np.cumsum(inside[:-1]) > 0)[:len(low)])
    return raw, base, sizes, first, low[first]


def _slot(low: np.ndarray) -> np.ndarray:
    return _mix(low, 0xBF58476D1CE4E5B9) >> np.uint64(64 - 8 * SLOT_BYTES)


def _narrow(slots: np.ndarray) -> bytes:
    return slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SLOT_BYTES].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SLOT_BYTES, 8), np.uint8)
    out[:, :SLOT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SLOT_BYTES)
    return out.view("<u8").ravel()


def _shared_slots(regions: DataFrame, length: int, parts: int) -> DataFrame:
    """(chunk, slots): the bucket numbers of a chunk that occur in more than one document."""

    def numbers(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(chunk):
            slots, docs = (np.concatenate(x) for x in zip(*held.pop(chunk)))
            order = np.lexsort((docs, slots))
            slots, docs = slots[order], docs[order]
            head = np.concatenate([[True], slots[1:] != slots[:-1]])
            first = np.flatnonzero(head)
            several = np.zeros(len(first), bool)
            several[(np.cumsum(head) - 1)[1:][(slots[1:] == slots[:-1]) & (docs[1:] != docs[:-1])]] = True
            slots = slots[first]
            part = (slots % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, chunk, _narrow(slots[own]), np.packbits(several[own]).tobytes()) for p, own in enumerate(np.split(order, cuts[1:-1])) if len(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "slots", "several"])

        for batch in slices(batches, "bytes", ARRAY_BYTES):
            raw, base, sizes, first, low = _buckets(batch.column(3), length)
            owner = np.searchsorted(base, first, "right") - 1
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            docs = batch.column(1).to_numpy(zero_copy_only=False)  # rows of one id never count against each other
            for chunk in np.unique(chunks).tolist():
                own = chunks[owner] == chunk
                held.setdefault(chunk, []).append((_slot(low[own]), docs[owner[own]]))
            for chunk in [c for c in held if c != chunks[-1]]:
                yield flush(chunk)
        for chunk in list(held):
            yield flush(chunk)

    def meet(batches):
        def settle(rows):
            slots = [_wide(r[1]) for r in rows]
            several = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(s)) for r, s in zip(rows, slots)]).astype(bool)
            every = np.concatenate(slots)
            found, which, counts = np.unique(every, return_inverse=True, return_counts=True)
            shared = counts > 1
            shared[which[several]] = True
            keep = np.split(shared[which], np.cumsum([len(s) for s in slots])[:-1])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([_narrow(s[k]) for s, k in zip(slots, keep)], pa.binary())], names=["chunk", "slots"])

        part, rows = None, []
        for batch in batches:
            for p, chunk, slots, several in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and p != part:
                    yield settle(rows)
                    rows = []
                part = p
                rows.append((chunk, slots, several))
        if rows:
            yield settle(rows)

    sent = map_arrow(regions.select("chunk", "doc_id", "copy", "bytes"), numbers, "part int, chunk bigint, slots binary, several binary")
    return map_arrow(sent.repartition("part").sortWithinPartitions("part"), meet, "chunk bigint, slots binary")


def _send(regions: DataFrame, shared: DataFrame, length: int, groups: int) -> DataFrame:
    """Window strings of shared buckets, one row per task, round and bucket group."""

    def pack(found):
        """found: (group, string, document, its copy, place) by array and list."""
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        group, strings, ids, copies, places = found
        order = np.lexsort((places, ids, group))
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        rows = []
        for part in np.split(order, cuts):
            if not len(part):
                continue
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(strings[k], len(known)) for k in part.tolist()], np.int32)
            sizes = np.array(list(map(len, known)), np.int32)
            own = ids[part]
            blob = b"".join([sizes.tobytes(), which.tobytes(), np.diff(own, prepend=0).tobytes(), copies[part].tobytes(), places[part].tobytes(), *known])
            rows.append((int(group[part[0]]), len(known), len(part), packer.compress(blob)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["group", "strings", "places", "blob"])

    def send(batches):
        held, size, chunk, parts, wanted = [], 0, None, [], None

        def flush():
            columns = list(zip(*held))
            return pack((np.concatenate(columns[0]), [s for p in columns[1] for s in p], *(np.concatenate(columns[k]) for k in (2, 3, 4))))

        def take(batch):
            raw, base, sizes, first, low = _buckets(batch.column(5), length)
            stop = np.append(first[1:], len(raw))
            owner = np.searchsorted(base, first, "right") - 1
            count = np.minimum(stop, base[owner] + sizes[owner]) - first
            slots = _slot(low)
            at = np.minimum(np.searchsorted(wanted, slots), len(wanted) - 1)
            live = np.flatnonzero(wanted[at] == slots)
            where, count, row = _cut(first[live], count[live], PIECE_MAX)
            owner, low = owner[live][row], low[live][row]
            group = (_mix(low, 0x94D049BB133111EB) >> np.uint64(24)) % np.uint64(groups)
            strings = [raw[a:b] for a, b in zip(where.tolist(), (where + count + length - 1).tolist())]
            ids, copies, pos = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in (2, 3, 4))
            held.append((group.astype(np.int64), strings, ids.astype(np.int64), copies.astype(np.int32), pos + where - base[owner]))
            return sum(map(len, strings))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != chunk:
                    chunk, parts, wanted = keys[a], [], None
                own = batch.slice(a, b - a)
                lists = int(own.column(1).true_count)
                parts += [_wide(x) for x in own.column(6).slice(0, lists).to_pylist()]
                if lists == len(own):
                    continue
                if wanted is None:
                    wanted = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                    parts = []
                if len(wanted):
                    for piece in slices([own.slice(lists)], "bytes", ARRAY_BYTES):
                        size += take(piece)
                        if size > SEND_BYTES:
                            yield flush()
                            held, size = [], 0
        if held and sum(len(h[0]) for h in held):
            yield flush()

    rows = regions.select("chunk", F.lit(False).alias("list"), "doc_id", "copy", "pos", "bytes", F.lit(None).cast("binary").alias("slots"))
    lists = shared.select("chunk", F.lit(True).alias("list"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("copy"), F.lit(None).cast("bigint").alias("pos"),
                          F.lit(None).cast("binary").alias("bytes"), "slots")
    dealt = lists.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.desc("list"))
    return map_arrow(dealt, send, "group int, strings int, places int, blob binary")


def _decide(sent: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, copy, start, stop) of windows that a smaller document holds."""

    def settle(parts):
        known: dict[bytes, int] = {}
        which, ids, copies, places = [], [], [], []
        for count, n, blob in parts:
            sizes = np.frombuffer(blob, np.int32, count)
            at = 4 * count
            own = np.frombuffer(blob, np.int32, n, at)
            at += 4 * n
            for out, kind in ((ids, np.int64), (copies, np.int32), (places, np.int64)):
                out.append(np.frombuffer(blob, kind, n, at))
                at += kind().itemsize * n
            ids[-1] = np.cumsum(ids[-1])
            ends = at + np.cumsum(sizes, dtype=np.int64)
            strings = np.array([known.setdefault(blob[a:b], len(known)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
            which.append(strings[own])
        which, ids, copies, places = map(np.concatenate, (which, ids, copies, places))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        data = np.frombuffer(b"".join([*known, b"\0" * 8]), np.uint8)
        del known
        base, windows = np.cumsum(sizes) - sizes, sizes - length + 1
        least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        first = np.repeat(least, windows)
        begin = np.cumsum(windows) - windows
        own, bucket = refine(data, np.repeat(base, windows) + _within(windows), length)
        mixed = np.zeros(len(sizes), bool)
        if len(own):
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            low = np.minimum.reduceat(first[own[order]], heads)
            first[own[order]] = np.repeat(low, np.diff(np.append(heads, len(order))))
            changed = own[first[own] < np.repeat(least, windows)[own]]
            mixed[np.searchsorted(begin, changed, "right") - 1] = True
        take = np.flatnonzero((ids > least[which]) | mixed[which])
        string = which[take]
        flat = np.repeat(begin[string], windows[string]) + _within(windows[string])
        row = np.repeat(take, windows[string])
        gone = first[flat] < ids[row]
        split = np.flatnonzero(np.diff(row)) + 1
        # a run ends where its place does: shift each place by one free slot
        spaced = np.zeros(len(row) + len(split) + 1, bool)
        step = np.zeros(len(row), np.int64)
        step[split] = 1
        spaced[np.arange(len(row)) + np.cumsum(step)] = gone
        origin = np.zeros(len(spaced), np.int64)
        origin[np.arange(len(row)) + np.cumsum(step)] = np.arange(len(row))
        a, b = _runs(spaced)
        a, b = origin[a], origin[b - 1]
        offset = places[row] + _within(windows[string])
        return pa.RecordBatch.from_arrays([pa.array(ids[row[a]]), pa.array(copies[row[a]]), pa.array(offset[a]), pa.array(offset[b] + length)], names=["doc_id", "copy", "start", "stop"])

    def decide(batches):
        import zstandard

        group, parts = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                this, count, n, blob = (batch.column(c)[k] for c in range(4))
                if parts and this.as_py() != group:
                    yield settle(parts)
                    parts = []
                group = this.as_py()
                parts.append((count.as_py(), n.as_py(), zstandard.ZstdDecompressor().decompress(blob.as_buffer())))
        if parts:
            yield settle(parts)

    return map_arrow(sent.repartition("group").sortWithinPartitions("group"), decide, "doc_id bigint, copy int, start bigint, stop bigint")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document that has any new piece: doc_id, mark (hash of the text), ``fresh`` (pos, n: windows of new pieces) and ``spans`` (start, stop: repeats inside them).

    Windows outside ``fresh`` repeat a smaller document's; documents without a row repeat whole.
    """
    base = _keyed(docs, id_col, text_col)
    pieces = stage(_occurrences(base, length), "pieces")
    firsts = stage(pieces.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    fresh = pieces.join(firsts, ["h1", "h2"], "left").where("first is null or first = doc_id").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("fresh"))
    # documents of one id are told apart by a small number
    fresh = stage(fresh.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("mark"))), "fresh")
    discard(pieces, firsts)
    regions = stage(_regions(base.join(fresh, ["doc_id", "mark"]).select("doc_id", "copy", "text", "fresh"), length), "regions")
    total = regions.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shared = stage(_shared_slots(regions, length, max(64, total // (64 << 20))), "shared")
    spans = stage(_decide(_send(regions, shared, length, max(64, 2 * total // GROUP_BYTES)), length), "spans")
    discard(regions, shared)
    listed = spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = stage(fresh.join(listed, ["doc_id", "copy"], "left").select("doc_id", "mark", "fresh", "spans"), "verdicts")
    discard(fresh, spans)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, names: tuple[str, ...] = ADDED) -> DataFrame:
    """All rows of ``docs``, with kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text
    (characters that lost a byte left out).

    A byte goes if some string of ``length`` bytes covers it that also starts in a document with a smaller id; strings are judged on the input and never cross documents.
    Ids are integers. Null text has no bytes; texts shorter than ``length`` stay; a document with a null id stays whole and counts for no other; rows with equal ids never
    remove each other's bytes; repeats within one document alone stay. An empty table has no rows. Columns of the added names are replaced; other names can be asked for.
    """
    docs = docs.drop(*names)
    found = verdicts(docs, id_col, text_col, length)
    own = docs.columns
    found = found.toDF("__id", "__mark", "__fresh", "__spans")
    joined = docs.join(found, (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark")), "left").select(*own, "__fresh", "__spans")
    id_at, text_at = own.index(id_col), own.index(text_col)

    def apply(batches):
        for batch in slices(batches, text_col):
            raw, bounds = _texts(batch, text_at)
            known = batch.column(id_at).is_valid().to_pylist()
            fresh, spans = (batch.column(len(own) + k).to_pylist() for k in (0, 1))
            out = []
            for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                text = raw[a:b]
                if len(text) < length or not known[k]:
                    out.append((text, len(text), 0, 0))
                    continue
                gone = np.ones(len(text) - length + 1, bool)
                for s in fresh[k] or ():
                    gone[s["pos"]:s["pos"] + s["n"]] = False
                edges = np.zeros(len(text) + 1, np.int32)
                first, stop = _runs(gone)
                np.add.at(edges, first, 1)
                np.add.at(edges, stop - 1 + length, -1)
                if spans[k]:
                    np.add.at(edges, [s["start"] for s in spans[k]], 1)
                    np.add.at(edges, [s["stop"] for s in spans[k]], -1)
                keep = np.cumsum(edges[:-1]) == 0
                left = np.frombuffer(text, np.uint8)[keep].tobytes()
                out.append((left, len(text), len(text) - len(left), len(_runs(~keep)[0])))
            kept, size, removed, runs = zip(*out)
            more = [pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    pa.array([x.decode("utf-8", "ignore") for x in kept])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(own))] + more, names=[*own, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{n}` {t}" for n, t in zip(names, ("binary", "bigint", "bigint", "bigint", "string", "string")))
    return map_arrow(joined, apply, schema)

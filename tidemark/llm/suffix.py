"""Suffix-array deduplication by sampled suffixes and induction.

Removed is every byte that a string of ``length`` bytes covers which also starts anywhere else.

As in induced sorting, only sample suffixes are sorted as such, and the others follow from them.
A sample is the position of the smallest k-mer hash among the first ``window`` positions of a
string; equal strings have their samples at equal places.  Samples whose following bytes occur
once are dropped by counting hashes, which loses nothing.  Spark's external sorter, which spills
sorted runs and merges them with a priority queue, orders the remaining sample suffixes with
their contexts, shard by shard, far beyond memory.  A task then reads its shard in order, with
the common prefix of each suffix and its neighbour, and induces round by round the order of the
suffixes that start one byte earlier: a tuple (rank, common prefix) goes to the queue of the byte
before it, queues being read in byte order.  A suffix whose common prefix with a neighbour
reaches ``length`` starts a repeated string.  Hashes only bring candidates together: that strings
are equal is decided on their bytes.

With ``words``, the words of each text also go through as a second string, in which every word
stands as ``length / words`` bytes, so that passages of so many words repeat however short or
long their words are; what runs of more than ``words`` words such passages cover goes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, byte_slices, grouped_batches, join_small, map_arrow, mix64, prefix_hash, span_hash, units, written
from tidemark.llm.jaccard import SPACE

LENGTH, WINDOW, KMER = 400, 256, 16

#: Words of a passage; longer runs of repeated words are cut where words are asked for.
WORDS = 50

#: Low bits of a k-mer's rank that hold its position; the others hold its hash.
PLACE_BITS = 32

#: Bytes of text whose samples are found at once; small, for the sake of the processor's cache.
RUN_BYTES = 1 << 17

#: Bytes of a longer text that are looked at together.
PART_BYTES = 1 << 22

#: Distinct contexts of one sample key that a task sorts; keys with more are divided first, into so many runs of places.
GROUP_LIMIT, PARTS = 256, 4

#: Contexts that are induced together.
SHARD_ROWS = 8192


_room: list[np.ndarray] = []


def _scratch(n: int) -> np.ndarray:
    """Two arrays of ``n`` values to write into and one of 0, 1, 2, ...; kept from run to run, as fresh memory costs more than what is done in it."""
    if not _room or _room[0].shape[1] < n:
        room = np.empty((3, max(n, 2 * RUN_BYTES)), np.uint64)
        room[2] = np.arange(room.shape[1], dtype=np.uint64)
        if n > 8 * RUN_BYTES:  # too much to be held
            return room[:, :n]
        _room[:] = [room]
    return _room[0][:, :n]


def sliding_min(values: np.ndarray, width: int, spare: np.ndarray) -> np.ndarray:
    """Minimum of each window of ``width`` values; writes over them and over ``spare``, an array of their size."""
    n, reach = len(values), 1
    if n < width:
        return values[:0]
    while 2 * reach <= width:
        m = len(values) - reach
        values, spare = np.minimum(values[:m], values[reach:], out=spare[:m]), values
        reach *= 2
    return np.minimum(values[: n - width + 1], values[width - reach :], out=spare[: n - width + 1])


class Samples:
    """Sample positions of a run of texts: their text, place in the run, reach and key.

    Each stands for the strings of ``length`` bytes whose smallest k-mer hash (the leftmost one)
    within the first ``window`` positions is there.  reach: how far before the sample the first of
    these strings starts.  key: hash of the bytes after the sample that all of them share.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, window: int) -> None:
        self.offsets, self.length = offsets, length
        self.raw = np.ascontiguousarray(data)
        places, starts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        heads = np.unique(offsets[:-1])
        last = -1
        for base in range(0, len(data) - length + 1, PART_BYTES):
            least, key = self._part(base, window)
            # a new sample can begin with the part, with a text and where the smallest hash is another
            own = heads[np.searchsorted(heads, base) : np.searchsorted(heads, base + len(least))]
            start = np.unique(np.concatenate([[base], own, np.flatnonzero(least[1:] != least[:-1]) + base + 1]))
            start = start[start + length <= offsets[np.searchsorted(offsets, start, side="right")]]
            place = (least[start - base] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + base
            new = place != last  # a sample that two parts share is one
            last = place[-1] if len(place) else last
            places.append(place[new])
            starts.append(start[new])
            keys.append(key(place[new]))
        self.place, start = np.concatenate(places), np.concatenate(starts)
        self.reach, self.key = self.place - start, np.concatenate(keys)
        self.owner = np.searchsorted(offsets, start, side="right") - 1

    def _part(self, base: int, window: int):  # noqa: ANN202
        raw = self.raw[base : base + PART_BYTES + self.length - 1]
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from each position on
        hashes, spare, places = _scratch(len(raw) - KMER + 1)
        np.multiply(eight[: len(hashes)], np.uint64(0x9E3779B97F4A7C15), out=hashes)
        hashes += np.multiply(eight[8:], np.uint64(0xC2B2AE3D27D4EB4F), out=spare)
        hashes ^= np.right_shift(hashes, np.uint64(32), out=spare)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes &= ~np.uint64((1 << PLACE_BITS) - 1)
        hashes |= places
        prefix = prefix_hash(raw)
        common = self.length - window + 1
        return sliding_min(hashes, window, spare)[: len(raw) - self.length + 1], lambda place: span_hash(prefix, place - base, place - base + common)

    def ends(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.place[at] + self.length, self.offsets[self.owner[at] + 1])

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Names of the samples' contexts: 64 bits of the MD5 of the bytes from reach to end, and of the reach."""
        raw, first = memoryview(self.raw), self.place[at] - self.reach[at]
        names = [hashlib.md5(bytes(raw[a:b]) + r.to_bytes(4, "little")).digest()[:8] for a, b, r in zip(first.tolist(), self.ends(at).tolist(), self.reach[at].tolist(), strict=True)]
        return np.frombuffer(b"".join(names), np.uint64)

    def with_key(self, keys: np.ndarray) -> np.ndarray:
        """Samples whose key is among ``keys`` (sorted)."""
        if not len(keys) or not len(self.key):
            return np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(keys, self.key), len(keys) - 1)
        return np.flatnonzero(keys[found] == self.key)


def _key_matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.sort(x.values.to_numpy().view(np.uint64)) if x.values is not None else np.zeros(0, np.uint64) for x in column]


def coded_words(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``width`` bytes for each word of a run of texts, equal ones for equal words, and the texts' offsets into them.

    Words are runs of anything but ASCII white space.
    """
    starts, ends, owner = units(SPACE[data], offsets)
    value = span_hash(prefix_hash(data), starts, ends)
    codes = np.concatenate([mix64(value + np.uint64(k)).view(np.uint8).reshape(-1, 8) for k in range(-(-width // 8))], axis=1)[:, :width]
    return np.ascontiguousarray(codes).ravel(), np.searchsorted(owner, np.arange(len(offsets))) * width


def _code_width(length: int, words: int | None) -> int:
    if words is None:
        return 0
    if length % words or length // words < 4:
        raise ValueError(f"{length} bytes are no whole number of at least 4 bytes for each of {words} words")
    return length // words


def text_samples(docs: DataFrame, length: int, window: int, width: int) -> DataFrame:
    """doc_id, text_key and keys of every row, a key as often as the text has samples with it."""
    schema = T.StructType.fromDDL("doc_id long, text_key binary, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text"), RUN_BYTES):
                raw, n = data.tobytes(), hi - lo
                found = [Samples(own, at, length, window) for _, own, at in _strings(data, offsets, width)]
                key, owner = np.concatenate([x.key for x in found]), np.concatenate([x.owner for x in found])
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(key.view(np.int64))).cast(target.field(2).type)
                names = pa.array([hashlib.md5(raw[offsets[k] : offsets[k + 1]]).digest() for k in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), names, lists], schema=target)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def _strings(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """A run of texts as bytes and, with a ``width``, as coded words: in_words, bytes, offsets.  Codes are never stored."""
    yield False, data, offsets
    if width:
        yield True, *coded_words(data, offsets, width)


def sample_contexts(texts: DataFrame, length: int, window: int, width: int) -> DataFrame:
    """key, context, reach, before (bytes up to the sample, nearest first), after (from it on), copies."""
    schema = T.StructType.fromDDL("key long, context long, reach int, before binary, after binary, copies long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            keys, copies = _key_matrix(batch.column("keys")), batch.column("copies").to_numpy()
            for lo, hi, text, text_offsets in byte_slices(batch.column("text"), RUN_BYTES):
                wanted = np.unique(np.concatenate(keys[lo:hi]))
                for _, data, offsets in _strings(text, text_offsets, width):
                    raw, found = data.tobytes(), Samples(data, offsets, length, window)
                    at = found.with_key(wanted)
                    if not len(at):
                        continue
                    context = found.contexts(at)
                    # equal contexts of the run become one row
                    order = np.lexsort((context, found.key[at]))
                    at, context = at[order], context[order]
                    key = found.key[at]
                    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])]))
                    number = np.add.reduceat(copies[lo:hi][found.owner[at]], first)
                    place, reach, ends = found.place[at][first], found.reach[at][first], found.ends(at)[first]
                    before = [raw[p - r : p][::-1] for p, r in zip(place.tolist(), reach.tolist(), strict=True)]
                    after = [raw[p:e] for p, e in zip(place.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(context[first].view(np.int64)), pa.array(reach.astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(number)], schema=target)

    return map_arrow(texts, run, schema)


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)


class _RangeMin:
    """Minima of ranges of an array, by tables of doubled widths."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of each [lo, hi), not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.tables[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.tables[k][lo[at]], self.tables[k][hi[at] - (1 << int(k))])
        return out


def induce(group: np.ndarray, reach: np.ndarray, before: np.ndarray, after: np.ndarray, after_length: np.ndarray, length: int) -> np.ndarray:
    """Boolean matrix (sample, o): whether the string that starts o bytes before the sample starts elsewhere.

    The samples are sorted by group, then by ``after``; suffixes of different groups have no
    common prefix.  Strings further away than a sample's reach are not asked for.
    """
    n, rounds = len(group), int(reach.max(initial=0)) + 1
    repeated = np.zeros((n, rounds), bool)
    differs = after[1:] != after[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), after.shape[1])
    common = np.minimum(common, np.minimum(after_length[1:], after_length[:-1]))
    common[group[1:] != group[:-1]] = -1
    rank = np.arange(n)  # samples in the order of their suffixes
    shared = np.concatenate([[-1], common]).astype(np.int32)  # common prefix with the one before; -1: another group
    for o in range(rounds):
        if o:
            alive = np.flatnonzero(reach[rank] >= o)
            if len(alive) < 2:
                break
            # the tuples go to the queue of the byte before; a queue keeps their order
            queue = group[rank[alive]].astype(np.int64) * 256 + before[rank[alive], o - 1]
            order = np.argsort(queue, kind="stable")
            moved, queue = alive[order], queue[order]
            new = np.full(len(moved), -1, np.int32)
            same = np.flatnonzero(queue[1:] == queue[:-1])
            if len(same):
                # between two tuples of a queue, the least common prefix of all that came between them holds, and one byte more
                new[same + 1] = _RangeMin(shared).of(moved[same] + 1, moved[same + 1] + 1) + 1
            rank, shared = rank[moved], new
        hit = shared >= length
        repeated[rank[hit], o] = True
        repeated[rank[np.flatnonzero(hit) - 1], o] = True
    return repeated & (np.arange(rounds)[None, :] <= reach[:, None])


def repeated_strings(contexts: DataFrame, length: int, window: int) -> DataFrame:
    """key, context, marks: bit o says that the string o bytes before the sample starts elsewhere."""
    schema = T.StructType.fromDDL("key long, context long, marks binary")

    def shard(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        key, context = table.column("key").to_numpy(), table.column("context").to_numpy()
        before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
        # contexts that are equal byte by byte are one
        maybe = np.flatnonzero((key[1:] == key[:-1]) & (context[1:] == context[:-1])).tolist()
        again = {k + 1 for k in maybe if after[k] == after[k + 1] and before[k] == before[k + 1]}
        first = np.array([k for k in range(len(key)) if k not in again], np.int64)
        copies = np.add.reduceat(table.column("copies").to_numpy(), first)
        key, context, reach = key[first], context[first], table.column("reach").to_numpy()[first].astype(np.int64)
        before, after = [before[k] for k in first.tolist()], [after[k] for k in first.tolist()]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        after_length = np.array([len(x) for x in after])
        hits = induce(group, reach, _matrix(before, window), _matrix(after, length), after_length, length)
        full = np.zeros((len(key), window), bool)
        full[:, : hits.shape[1]] = hits
        # a context that stands in several places repeats all its strings, those that end with the text at the latest
        several = copies > 1
        o = np.arange(window)[None, :]
        full[several] |= (o <= reach[several][:, None]) & (o >= length - after_length[several][:, None])
        some = full.any(axis=1)
        bits = np.packbits(full[some], axis=1)
        columns = [pa.array(key[some]), pa.array(context[some]), pa.array([x.tobytes() for x in bits], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for table in grouped_batches(batches, "key"):
            held.append(table)
            rows += table.num_rows
            if rows >= SHARD_ROWS:
                yield shard(held)
                held, rows = [], 0
        if held:
            yield shard(held)

    return map_arrow(contexts.repartition("key").sortWithinPartitions("key", "after", "context"), run, schema)


def divided_contexts(contexts: DataFrame, length: int, window: int) -> DataFrame:
    """key, context, base, sub_key, sub_context, reach, before, after, copies: contexts seen from nearer to their strings.

    The ``window`` places where a context's strings start are dealt into PARTS runs.  From the
    first place of a run on, all its strings share more bytes than those of the whole context
    did, so that one key falls apart into many; and contexts that differ only beyond a run's
    strings become one.  base: how far before the sample the run's first place is.
    """
    schema = T.StructType.fromDDL("key long, context long, base int, sub_key long, sub_context long, reach int, before binary, after binary, copies long")
    width = -(-window // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            keys, names, copies = batch.column("key").to_pylist(), batch.column("context").to_pylist(), batch.column("copies").to_pylist()
            before, after = batch.column("before").to_pylist(), batch.column("after").to_pylist()
            rows, spans, texts, at = [], [], [], 0
            for k in range(batch.num_rows):
                own = before[k][::-1] + after[k]
                for base in range(0, len(before[k]) + 1, width):
                    place = len(before[k]) - base
                    reach, end = min(place, width - 1), min(place + length, len(own))
                    if end - place > length - width:  # else the text ends before any string of the run does
                        rows.append((keys[k], names[k], base, reach, before[k][base : base + reach], own[place:end], copies[k]))
                        spans.append((at + place - reach, at + place, at + place + length - width + 1, at + end))
                texts.append(own)
                at += len(own)
            if not rows:
                continue
            prefix = prefix_hash(np.frombuffer(b"".join(texts), np.uint8))
            first, place, common, end = np.array(spans, np.int64).T
            columns = list(zip(*rows, strict=True))
            parent = mix64(np.array(columns[0], np.int64).view(np.uint64) + np.array(columns[2], np.uint64))
            sub_key = mix64(span_hash(prefix, place, common) ^ parent)
            joined = b"".join(texts)
            names = [hashlib.md5(joined[a:b] + r.to_bytes(4, "little")).digest()[:8] for a, b, r in zip(first.tolist(), end.tolist(), columns[3], strict=True)]
            columns[3:3] = [sub_key.view(np.int64), np.frombuffer(b"".join(names), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return map_arrow(contexts, run, schema)


def _same_contexts(found: DataFrame) -> DataFrame:
    """One row for contexts that are equal byte by byte."""
    return found.groupBy("key", "context", "reach", "before", "after").agg(F.sum("copies").alias("copies"))


def marked_contexts(contexts: DataFrame, length: int, window: int, limit: int) -> DataFrame:
    """key, context, base, marks: bit o says that the string base + o bytes before the sample starts elsewhere.

    Keys of more than ``limit`` contexts are divided until none has more; a run of one place has
    one context a key, so that this ends after log(window) rounds.
    """
    marks, roots, width = None, None, window
    while True:
        hot = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key"))
        n_hot = hot.count()
        found = repeated_strings(join_small(contexts, hot, ["key"], n_hot, 16, "left_anti"), length, width)
        if roots is None:
            found = found.withColumn("base", F.lit(0))
        else:
            found = roots.withColumnsRenamed({"key": "root_key", "context": "root_context", "sub_key": "key", "sub_context": "context"}).join(found, ["key", "context"])
            found = found.select(F.col("root_key").alias("key"), F.col("root_context").alias("context"), "base", "marks")
        found = written(found.select("key", "context", "base", "marks"))
        marks = found if marks is None else marks.unionByName(found)
        if not n_hot:
            return marks
        parts = written(divided_contexts(join_small(contexts, hot, ["key"], n_hot, 16, "left_semi"), length, width))
        width = -(-width // PARTS)
        nearer = parts.select("key", "context", "base", "sub_key", "sub_context")
        if roots is not None:
            above = roots.select(F.col("key").alias("root_key"), F.col("context").alias("root_context"), F.col("base").alias("root_base"), F.col("sub_key").alias("key"), F.col("sub_context").alias("context"))
            nearer = above.join(nearer, ["key", "context"])
            nearer = nearer.select(F.col("root_key").alias("key"), F.col("root_context").alias("context"), (F.col("root_base") + F.col("base")).alias("base"), "sub_key", "sub_context")
        roots = written(nearer)
        own = parts.select(F.col("sub_key").alias("key"), F.col("sub_context").alias("context"), "reach", "before", "after", "copies")
        contexts = written(_same_contexts(own))


def _placed_contexts(texts: DataFrame, length: int, window: int, width: int) -> DataFrame:
    """text_key, in_words, key, context, places: where each string has samples with candidate keys, a row a context."""
    schema = T.StructType.fromDDL("text_key binary, in_words boolean, key long, context long, places array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            keys = _key_matrix(batch.column("keys"))
            for lo, hi, text, text_offsets in byte_slices(batch.column("text"), RUN_BYTES):
                wanted = np.unique(np.concatenate(keys[lo:hi]))
                for in_words, data, offsets in _strings(text, text_offsets, width):
                    found = Samples(data, offsets, length, window)
                    at = found.with_key(wanted)
                    if not len(at):
                        continue
                    context = found.contexts(at)
                    order = np.lexsort((at, context, found.key[at], found.owner[at]))
                    context, at = context[order], at[order]
                    owner, key = found.owner[at], found.key[at]
                    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]))
                    names = batch.column("text_key").slice(lo, hi - lo).take(pa.array(owner[first]))
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(found.place[at] - offsets[owner]))
                    columns = [names, pa.array([in_words] * len(first)), pa.array(key[first].view(np.int64)), pa.array(context[first].view(np.int64)), places.cast(target.field(4).type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return map_arrow(texts, run, schema)


def _mark_runs(marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of set bits of each row: its row, first and last bit."""
    offsets = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1]
    at = (offsets - offsets[0]).astype(np.int64) * 8
    bits = np.unpackbits(np.frombuffer(marks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]).view(bool)
    ahead = np.concatenate([bits, [False]])
    ahead[at] = False  # a run ends with its row
    behind = np.concatenate([[False], bits])
    behind[at] = False
    first, last = np.flatnonzero(bits & ~behind[:-1]), np.flatnonzero(bits & ~ahead[1:])
    row = np.searchsorted(at, first, side="right") - 1
    return row, first - at[row], last - at[row]


def _inner(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The entries of a column of lists, one after the other, and how many each list has."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _joined_runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same stretches with those of an owner that overlap or touch as one, by owner and place."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    apart = owner * (int(end.max(initial=0)) + 1 - int(start.min(initial=0)))  # stretches of two owners do not overlap
    reached = np.maximum.accumulate(apart + end)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | ((apart + start)[1:] > reached[:-1])])[: len(owner)])
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    return owner[first], start[first], (reached - apart)[last]


def _marked_runs(found: DataFrame, length: int) -> DataFrame:
    """text_key, in_words, spans, n_removed, n_spans of strings; ``found`` lists their contexts (places, parts: base and marks)."""
    schema = T.StructType.fromDDL("text_key binary, in_words boolean, spans array<long>, n_removed long, n_spans long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts, n_contexts = _inner(batch.column("found"))
            (places, n_places), (parts, n_parts) = (_inner(contexts.field(k)) for k in ("places", "parts"))
            part, low, high = _mark_runs(parts.field("marks"))
            base = parts.field("base").to_numpy()[part]
            context = np.repeat(np.arange(len(contexts)), n_parts)[part]
            # every run of marks of a context at each of its places
            times = n_places[context]
            run_of = np.repeat(np.arange(len(part)), times)
            place = places.to_numpy()[np.repeat((np.cumsum(n_places) - n_places)[context] - np.cumsum(times) + times, times) + np.arange(len(run_of))]
            owner = np.repeat(np.arange(batch.num_rows), n_contexts)[context][run_of]
            owner, start, end = _joined_runs(owner, place - (base + high)[run_of], place - (base + low)[run_of] + length)
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            sizes = np.diff(np.concatenate([[0], np.cumsum(end - start)])[first])
            spans = pa.ListArray.from_arrays(pa.array((2 * first).astype(np.int32)), pa.array(np.column_stack([start, end]).ravel()))
            target = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("in_words"), spans.cast(target.field(2).type), pa.array(sizes), pa.array(np.diff(first))], schema=target)

    return map_arrow(found, run, schema)


def find_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, limit: int = GROUP_LIMIT, words: int | None = None) -> DataFrame:
    """text_key (MD5), spans, n_removed, n_spans and words of the texts that lose bytes or words.

    spans: where each run of removed bytes starts and ends, one after the other; words: the same
    for words, where ``words`` asks for them (else null).  n_removed and n_spans tell of the bytes
    alone; they are null where a text loses words only.

    Texts are UTF-8 bytes, null is empty, and matches end where a text does.  Every row counts,
    those with null doc_id as well: a text that stands in two rows repeats all its strings.
    Strings are judged on the input, not on what is left.  ``length`` has to exceed ``window`` by
    ``KMER`` or more, and to be a multiple of ``words``.
    """
    width = _code_width(length, words)
    rows = written(text_samples(docs, length, window, width))
    reps = rows.groupBy("text_key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("all_keys"))
    # n: samples of different texts, and so contexts at most, of a key that stands in the rows more than once
    often = reps.select("copies", F.explode("all_keys").alias("key")).groupBy("key").agg(F.sum("copies").alias("in_rows"), F.count(F.lit(1)).alias("n"))
    often = written(often.filter("in_rows > 1").select("key", "n"))
    pairs = reps.select("text_key", "rep_id", "copies", F.explode(F.array_distinct("all_keys")).alias("key"))
    active = written(pairs.join(often, "key").groupBy("text_key", "rep_id", "copies").agg(F.collect_list("key").alias("keys"), F.bool_or(F.col("n") > limit).alias("hot")))
    # only one row of equal texts goes on; joining on doc_id as well spreads the others
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("at"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    names = active.select("text_key", F.coalesce("rep_id", F.lit(-1)).alias("at"))
    touched = join_small(texts, names, ["text_key", "at"], names.count(), 64).dropDuplicates(["text_key"])
    with_text = written(touched.join(active, "text_key").select("text_key", "text", "copies", "keys", "hot"))
    hot = written(often.filter(F.col("n") > limit).select("key"))
    n_hot = hot.count()
    # keys of few contexts go straight to their shard; those of many are merged and, if need be, divided first
    few = join_small(sample_contexts(with_text, length, window, width), hot, ["key"], n_hot, 16, "left_anti")
    marks = written(repeated_strings(few, length, window).withColumn("base", F.lit(0)))
    if n_hot:
        many = join_small(sample_contexts(with_text.filter("hot"), length, window, width), hot, ["key"], n_hot, 16, "left_semi")
        marks = marks.unionByName(marked_contexts(written(_same_contexts(many)), length, window, limit))
    # a row a context on either side, however often it stands in a text and into how many runs it was divided
    merged = marks.groupBy("key", "context").agg(F.collect_list(F.struct("base", "marks")).alias("parts"))
    placed = _placed_contexts(with_text, length, window, width).join(merged, ["key", "context"])
    found = placed.groupBy("text_key", "in_words").agg(F.collect_list(F.struct("places", "parts")).alias("found"))
    cut = written(_marked_runs(found, length))
    of_bytes = cut.filter("not in_words").drop("in_words")
    if words is None:
        return of_bytes.withColumn("words", F.lit(None).cast("array<long>"))
    # the spans of words start and end with whole words, and have more than ``words`` of them
    starts, ends = F.filter("spans", lambda _, i: i % 2 == 0), F.filter("spans", lambda _, i: i % 2 == 1)
    runs = F.zip_with(starts, ends, lambda a, b: F.array(F.ceil(a / width), F.floor(b / width)))
    runs = F.flatten(F.filter(runs, lambda x: x[1] - x[0] > words))
    of_words = cut.filter("in_words").select("text_key", runs.alias("words")).filter(F.size("words") > 0)
    return written(of_bytes.join(of_words, "text_key", "full"))


def _without(text: str, spans: np.ndarray | None, words: np.ndarray | None) -> tuple[str, str]:
    """The text without some spans of bytes and of words, and the SHA-256 of what the bytes alone leave.

    A character that a cut divides goes entirely.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    keep = np.ones(len(data), bool)
    for lo, hi in np.reshape(spans, (-1, 2)) if spans is not None else ():
        keep[lo:hi] = False
    digest = hashlib.sha256(data[keep]).hexdigest()
    if words is not None:
        starts, ends, _ = units(SPACE[data], np.array([0, len(data)]))
        for lo, hi in np.reshape(words, (-1, 2)):
            keep[starts[lo] : ends[hi - 1]] = False
    return data[keep].tobytes().decode("utf-8", "ignore"), digest


def _kept() -> Column:
    @F.pandas_udf("text string, digest string")
    def kept(texts: pd.Series, spans: pd.Series, words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(*x) for x in zip(texts, spans, words, strict=True)], columns=["text", "digest"], dtype=object)

    return kept("text", "__spans", "__words")


def _by_change(docs: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that ``cut`` leaves alone, and the others joined with it (columns with __ before their names)."""
    keyed = docs.withColumn("__text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    cut = cut.select(*[F.col(c).alias(f"__{c}") for c in cut.columns])
    names = cut.select("__text_key")
    n = names.count()
    return join_small(keyed, names, ["__text_key"], n, 32, "left_anti"), join_small(keyed, names, ["__text_key"], n, 32, "left_semi").join(cut, "__text_key")


def repeat_report(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, limit: int = GROUP_LIMIT, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of every row; see ``find_repeats``.

    The numbers and the digest tell of the repeated bytes.  text: what is left as whole
    characters, without the repeated passages of ``words`` words either; null stays null.
    """
    whole, changed = _by_change(docs, find_repeats(docs, length, window, limit, words))
    text, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    names = [F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")]
    digest = F.sha2(text.cast("binary"), 256)
    out = whole.select(*names, zero.alias("n_removed"), zero.alias("n_spans"), digest.alias("kept_sha256"), F.col("text"))
    changed = changed.withColumn("__kept", _kept())
    cut = changed.select(*names, F.coalesce("__n_removed", zero).alias("n_removed"), F.coalesce("__n_spans", zero).alias("n_spans"), F.col("__kept.digest").alias("kept_sha256"), F.col("__kept.text").alias("text"))
    return out.unionByName(cut)


def cut_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts, all other columns as they are.

    With ``words``, runs of more than so many words that passages of so many words cover which
    stand elsewhere as well go too, also where they are shorter than ``length`` bytes.  A
    character that a cut divides goes entirely.  Texts that lose nothing, null among them, stay as
    they are; n_chars, where there is one, follows the text.
    """
    whole, changed = _by_change(docs, find_repeats(docs, length, window, words=words))
    changed = changed.withColumn("text", _kept()["text"])
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return whole.select(*columns).unionByName(changed.select(*columns))

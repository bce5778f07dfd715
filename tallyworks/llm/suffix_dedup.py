"""Removing byte strings that already start in an earlier document, by sorted suffixes.

A string of ``LENGTH`` bytes counts as repeated when it also starts in a document with a
smaller id. Suffixes of a whole corpus cannot be sorted in one place, and few matter, so
three steps come before the sort:

1. Anchors: of every window of ``LENGTH`` bytes the ``GRAM``-byte string with the least hash.
   Equal windows choose equal anchors, so a repeated string has an anchor that both
   documents chose. Anchors chosen by one document only are left out by a bitmap of fixed
   size; a false hit costs work, never a wrong result.
2. The surroundings of an anchor, all bytes that a repeated string around it can reach,
   are compared as a whole: copies of equal surroundings are repeats of the earliest.
3. Where an anchor has several surroundings, their suffixes are sorted in two stages.
   Suffixes smaller than their successor are sorted directly; the others are induced by a
   scan over the buckets of first bytes, as each follows from the place of its successor.
   Neighbours with a common prefix of ``LENGTH`` bytes are equal strings, and the least
   document among them is the one that keeps its copy.

Surroundings of one anchor beyond ``HOT`` (the edges of a passage in a large share of all
documents) are not sorted in one task; their strings are grouped by value instead, which
Spark combines before the shuffle. Both ways give the same marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources import discard
from .common import blocks_of, materialise, text_of

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM
SPAN = LENGTH + REACH
ALL = (1 << (REACH + 1)) - 1
# No UTF-8 text holds this byte; it stands for "outside the document".
OUTSIDE = 0xFF
# Bytes handled at once, slots of a bitmap, anchors and surroundings of a block.
SLICE = 1 << 16
SLOTS = 1 << 27
ANCHORS = 500_000
SORTED = 4_000
HOT = 20_000
# Eight-byte words that hold LENGTH bytes, and zeros after a row.
WORDS = -(-LENGTH // 8)
PAD = 64
LAST = (1 << 63) - 1

BASE = 0x9E3779B97F4A7C15
WORD64 = 1 << 64


class Hasher:
    """Hashes of all strings of a length, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.value = np.random.default_rng(1).integers(0, WORD64 - 1, (2, 256), dtype=np.uint64)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def prefix(self, data: np.ndarray, table: int) -> np.ndarray:
        if len(self.power) <= len(data):
            n = 2 * len(data) + 1
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, WORD64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[table][data] * self.power[: len(data)], out=out[1:])
        return out

    def strings(self, sums: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
        if isinstance(at, slice):
            n = len(sums) - length
            return mix((sums[length:] - sums[:n]) * self.inverse[:n])
        return mix((sums[at + length] - sums[at]) * self.inverse[at])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        values = choose(values[:-n], values[n:])
        n *= 2
    return choose(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def segments(texts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (document, first byte, window starts, bytes with their surroundings)."""
    held, size = [], 0
    for i, text in texts:
        starts = len(text) - LENGTH + 1
        for s in range(0, starts, SLICE):
            n = min(SLICE, starts - s)
            first = max(0, s - REACH)
            held.append((i, s, n, first, text[first : s + n + LENGTH + REACH - 1]))
            size += n
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(hasher: Hasher, part: list) -> tuple[np.ndarray, ...]:
    """Document, place in the document, hash, place in the buffer of each anchor; and the buffer."""
    gap = np.full(SPAN, OUTSIDE, dtype=np.uint8)
    pieces, where, at = [gap], [], SPAN
    for _, s, n, first, data in part:
        where.append(at + s - first)
        pieces += [np.frombuffer(data, dtype=np.uint8), gap]
        at += len(data) + SPAN
    buffer = np.concatenate(pieces)
    sums = hasher.prefix(buffer, 0)
    grams = hasher.strings(sums, slice(None), GRAM) | np.uint64(1)
    least = sliding(grams, REACH + 1, np.minimum)
    starts, counts = np.array(where), np.array([x[2] for x in part])
    edge = np.zeros(len(least) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[starts + counts] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(REACH, dtype=np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)[: len(grams)] == grams)
    owner = np.searchsorted(starts, chosen, side="right") - 1
    # An anchor of a segment's first window may lie before the next segment only.
    doc = np.array([x[0] for x in part])[owner]
    place = chosen - starts[owner] + np.array([x[1] for x in part])[owner]
    return doc, place, grams[chosen], chosen, buffer


def document_number(column: str = "doc_id") -> Column:
    """Documents without an id come after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def bytes_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, bytes]]:
    column = batch.column(at)
    for i in range(batch.num_rows):
        text = column[i].as_py()
        if text and len(text) * 4 >= LENGTH:
            yield i, text.encode("utf-8", "surrogatepass")


def slot_of(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(37)).astype(np.int64) % SLOTS


def listed(blocks: int):
    """Per batch and block: the hashes seen, and those seen in two documents already."""
    schema = pa.schema([("block", pa.int32()), ("seen", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            number = batch.column(0).to_numpy()
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for part in segments(bytes_of(batch, 1)):
                doc, _, h, _, _ = anchors(hasher, part)
                docs.append(number[doc])
                hashes.append(h)
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            if not len(h):
                continue
            block = (h >> np.uint64(1)) % np.uint64(blocks)
            key = block << np.uint64(32) | (mix(h) & np.uint64(0xFFFFFFFF))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            again = ~new & np.concatenate(([False], doc[1:] != doc[:-1]))
            seen, twice = key[new], np.unique(key[again])
            bounds = np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32)
            a, b = np.searchsorted(seen, bounds), np.searchsorted(twice, bounds)
            rows = [
                {
                    "block": k,
                    "seen": seen[a[k] : a[k + 1]].astype(np.uint32).tobytes(),
                    "twice": twice[b[k] : b[k + 1]].astype(np.uint32).tobytes(),
                }
                for k in np.flatnonzero(np.diff(a)).tolist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def merged(table: pa.Table) -> pa.Table:
    """The slots of the hashes of a block that two documents share."""
    block = np.uint64(table.column("block")[0].as_py())
    seen = np.sort(np.frombuffer(b"".join(table.column("seen").to_pylist()), dtype=np.uint32))
    twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), dtype=np.uint32)
    shared = np.union1d(seen[1:][seen[1:] == seen[:-1]], twice).astype(np.uint64)
    return pa.table({"slot": np.unique(slot_of(block << np.uint64(32) | shared))})


def bitmap(slots: DataFrame) -> np.ndarray:
    """The slots as bits; at most ``SLOTS`` bits come to the driver, whatever the input."""
    number = F.col("slot") + 1
    rows = (
        slots.groupBy(F.bitmap_bucket_number(number).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        .collect()
    )
    out = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in rows:
        some = np.frombuffer(r["bits"], dtype=np.uint8)
        first = (r["part"] - 1) * 4096
        out[first : first + len(some)] = some
    return out


def holds(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def window_hash(hasher: Hasher, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    return hasher.strings(hasher.prefix(buffer, 1), at - REACH, SPAN)


def instances(shared, blocks: int):
    """One row for each anchor in the bitmap: its hash, that of its surroundings, and where."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("d", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), shared.value
        for batch in batches:
            number, row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for part in segments(bytes_of(batch, 1)):
                doc, place, h, chosen, buffer = anchors(hasher, part)
                block = (h >> np.uint64(1)) % np.uint64(blocks)
                key = block << np.uint64(32) | (mix(h) & np.uint64(0xFFFFFFFF))
                hit = holds(bits, slot_of(key))
                w = window_hash(hasher, buffer, chosen[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[hit].view(np.int64)), pa.array(w.view(np.int64)), pa.array(number[doc[hit]]),
                        pa.array(row[doc[hit]]), pa.array(place[hit].astype(np.int32)),
                    ],
                    schema=schema,
                )

    return run


def surroundings(several):
    """The bytes around anchors whose hash is in the bitmap, once for each part of a batch."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), several.value
        for batch in batches:
            for part in segments(bytes_of(batch, 0)):
                _, _, h, chosen, buffer = anchors(hasher, part)
                hit = holds(bits, slot_of(h))
                h, chosen = h[hit], chosen[hit]
                w = window_hash(hasher, buffer, chosen)
                order = np.lexsort((w, h))
                h, w, chosen = h[order], w[order], chosen[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))[: len(h)])
                h, w, chosen = h[first], w[first], chosen[first]
                rows = buffer[chosen[:, None] + np.arange(-REACH, LENGTH)]
                raw = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(SPAN), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), raw], schema=schema
                )

    return run


def eights(rows: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, rows padded by ``PAD`` zeros."""
    padded = np.zeros((len(rows), rows.shape[1] + PAD), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    flat = padded.ravel().astype(np.uint64)
    for n_bytes in (1, 2, 4):
        flat = flat[:-n_bytes] << np.uint64(8 * n_bytes) | flat[n_bytes:]
    return flat


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset (up to ``REACH``) of the suffixes of all rows in lexicographic order.

    A row's end counts as smaller than any byte.
    """
    n, width = rows.shape
    smaller = np.zeros((n, width + 1), dtype=bool)
    for o in range(width - 2, -1, -1):
        smaller[:, o] = (rows[:, o] < rows[:, o + 1]) | ((rows[:, o] == rows[:, o + 1]) & smaller[:, o + 1])
    # Past REACH only what the induction of earlier suffixes reads is needed: up to the
    # first suffix that is sorted directly.
    stop = np.where(smaller[:, REACH:width].any(axis=1), smaller[:, REACH:width].argmax(axis=1) + REACH, width - 1)
    wanted = np.arange(width)[None, :] <= stop[:, None]
    index = np.full((n, width + 1), -1, dtype=np.int64)
    row, offset = np.nonzero(wanted)
    index[row, offset] = np.arange(len(row))
    byte, direct, after = rows[row, offset], smaller[row, offset], index[row, offset + 1]
    after[direct] = -1
    # Stage one: direct comparison of at least LENGTH bytes, eight at a time.
    own = np.flatnonzero(direct)
    flat = eights(rows)
    place = row[own] * (width + PAD) + offset[own]
    words = [flat[place + 8 * k] for k in range(WORDS)]
    own = own[np.lexsort(words[::-1])] if len(own) else own
    own_start = np.searchsorted(byte[own], np.arange(257))
    # Stage two: buckets of first bytes from low to high; a suffix larger than its
    # successor stands before the direct ones of its bucket, in the order of successors.
    induced = np.flatnonzero(~direct)
    induced = induced[np.argsort(byte[induced], kind="stable")]
    start = np.searchsorted(byte[induced], np.arange(257))
    rank = np.full(len(row) + 1, -1, dtype=np.int64)  # the last entry stands for the row's end
    done, order = 0, []
    for c in range(256):
        bucket = induced[start[c] : start[c + 1]]
        if len(bucket):
            run = (after[bucket] >= 0) & (byte[after[bucket]] == c)
            layer, rest = bucket[~run], bucket[run]
            while len(layer):
                layer = layer[np.argsort(rank[after[layer]], kind="stable")]
                rank[layer] = np.arange(done, done + len(layer))
                done += len(layer)
                order.append(layer)
                ready = rank[after[rest]] >= 0
                layer, rest = rest[ready], rest[~ready]
        same = own[own_start[c] : own_start[c + 1]]
        rank[same] = np.arange(done, done + len(same))
        done += len(same)
        order.append(same)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    order = order[offset[order] <= REACH]
    return row[order], offset[order]


def common_prefixes(rows: np.ndarray, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Common prefix, up to ``LENGTH``, of each sorted suffix with the one before it."""
    flat = eights(rows)
    place = row * (rows.shape[1] + PAD) + offset
    out = np.full(len(row), LENGTH, dtype=np.int64)
    out[:1] = 0
    # Suffixes that agree with the one before in all words so far.
    open_ = np.arange(1, len(row))
    for k in range(WORDS):
        differ = flat[place[open_] + 8 * k] ^ flat[place[open_ - 1] + 8 * k]
        found = differ != 0
        leading = sum((differ[found] < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(1, 8))
        out[open_[found]] = np.minimum(8 * k + leading, LENGTH)
        open_ = open_[~found]
    return out


def marks(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row a bit for each offset whose string starts in a row of a smaller document."""
    row, offset = suffix_order(rows)
    prefix = common_prefixes(rows, row, offset)
    # Strings that reach outside their document repeat nothing.
    real = (rows[row, offset] != OUTSIDE) & (rows[row, offset + LENGTH - 1] != OUTSIDE)
    group = np.cumsum(prefix < LENGTH) - 1
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(first[row], starts)
    hit = real & (least[group] < first[row])
    return np.bincount(row[hit], weights=np.exp2(offset[hit]), minlength=len(rows)).astype(np.int64)


def sort_block(table: pa.Table) -> pa.Table:
    raw = table.column("bytes").combine_chunks()
    rows = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(-1, SPAN)
    found = marks(rows, table.column("m").to_numpy())
    hit = found > 0
    return pa.table(
        {"h": table.column("h").to_numpy()[hit], "w": table.column("w").to_numpy()[hit], "marks": found[hit]}
    )


def by_value(rows: DataFrame) -> DataFrame:
    """The same marks by grouping the strings, for anchors with very many surroundings."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("o")
    strings = rows.select("h", "w", "m", "bytes", offsets).select(
        "h", "w", "m", "o", F.substring("bytes", F.col("o") + 1, F.lit(LENGTH)).alias("s")
    )
    outside = F.lit(bytes([OUTSIDE]))
    strings = strings.filter((F.substring("s", 1, 1) != outside) & (F.substring("s", LENGTH, 1) != outside))
    least = strings.groupBy("s").agg(F.min("m").alias("least"))
    hit = strings.join(least, "s").filter("least < m")
    return hit.groupBy("h", "w").agg(F.sum(F.pow(F.lit(2), F.col("o")).cast("long")).alias("marks"))


def repeats(docs: DataFrame, sort_size: int = SORTED, hot: int = HOT) -> DataFrame:
    """``row`` and ``found``, the anchors (place, marks) of each row with repeated strings."""
    rows = docs.select(
        document_number().alias("d"), F.col("text"), F.xxhash64("doc_id", "text").alias("row")
    )
    blocks = blocks_of(docs, F.octet_length(text_of()), ANCHORS * (REACH + 2) // 2)
    lists = rows.select("d", "text").mapInArrow(listed(blocks), "block int, seen binary, twice binary")
    context = docs.sparkSession.sparkContext
    slots = materialise(lists.groupBy("block").applyInArrow(merged, "slot long"))
    shared = context.broadcast(bitmap(slots))
    discard(slots)
    found = materialise(rows.mapInArrow(instances(shared, blocks), "h long, w long, d long, row long, at int"))
    kinds = found.groupBy("h", "w").agg(F.min("d").alias("m"), F.max("d").alias("last"))
    kinds = materialise(kinds)
    counts = kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    counts = materialise(counts)
    slot = materialise(counts.select("h").mapInArrow(h_slots, "slot long").distinct())
    several = context.broadcast(bitmap(slot))
    discard(slot)
    text = rows.select("text").mapInArrow(surroundings(several), "h long, w long, bytes binary").distinct()
    sized = kinds.join(counts, "h").select("h", "w", "m", "kinds")
    text = materialise(text.join(sized, ["h", "w"]))
    discard(counts)
    parts = max(1, -(-text.count() // sort_size))
    block = F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part")
    usual = text.filter(F.col("kinds") <= hot).select("h", "w", "m", "bytes", block)
    sorted_marks = usual.groupBy("part").applyInArrow(sort_block, "h long, w long, marks long")
    marked = materialise(sorted_marks.unionByName(by_value(text.filter(F.col("kinds") > hot))))
    discard(text)
    useful = kinds.join(marked, ["h", "w"], "left").filter("marks is not null or last > m")
    useful = materialise(useful.select("h", "w", "m", F.coalesce("marks", F.lit(0)).alias("marks")))
    discard(kinds, marked)
    hit = F.when(F.col("d") > F.col("m"), F.lit(ALL)).otherwise(F.col("marks"))
    hits = found.join(useful, ["h", "w"]).select("row", "at", hit.alias("marks")).filter("marks > 0")
    # The anchors of one row are no more than its bytes.
    told = materialise(hits.distinct().groupBy("row").agg(F.collect_list(F.struct("at", "marks")).alias("found")))
    discard(found, useful)
    return told


def h_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = slot_of(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])


def removed_runs(size: int, at: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from the places of anchors and their marks."""
    if not len(at):
        return []
    starts = np.concatenate([at[bits >> o & 1 == 1] - REACH + o for o in range(REACH + 1)])
    starts = np.unique(starts[(starts >= 0) & (starts + LENGTH <= size)])
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    first = starts[np.concatenate(([0], cut))]
    last = starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    return list(zip(first.tolist(), (last + LENGTH).tolist()))


RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"


def strip(docs: DataFrame, sort_size: int = SORTED, hot: int = HOT) -> DataFrame:
    """``doc_id``, the sizes, the removed ``spans`` and the ``kept`` bytes of each document.

    Reads doc_id and text; a null text counts as empty. A document without an id comes
    after all others and repeats nothing of another one without an id; rows with equal ids
    are one document's and remove nothing from each other. Repeated rows are kept. An
    empty table gives an empty table.
    """
    found = repeats(docs, sort_size, hot)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    joined = keyed.join(found, "row", "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            sizes, removed, counts, spans, kept = [], [], [], [], []
            found = batch.column(2)
            bounds = np.concatenate(([0], np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            anchors_, marks_ = found.flatten().flatten()
            at, bits = anchors_.to_numpy().astype(np.int64), marks_.to_numpy()
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = removed_runs(len(data), at[bounds[i] : bounds[i + 1]], bits[bounds[i] : bounds[i + 1]])
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                removed.append(sum(e - s for s, e in runs))
                counts.append(len(runs))
                spans.append([{"start": s, "stop": e} for s, e in runs])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def digest(docs: DataFrame) -> DataFrame:
    return strip(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

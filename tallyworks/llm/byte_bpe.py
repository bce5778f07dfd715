"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap their successors. Chunks are pre-tokenised on their
own, so one long text keeps many tasks busy. A chunk starts at any place and may split a
pre-token there, but the pattern looks only forward from a match's start, so from the
first place where the boundaries of two neighbours meet in their overlap both run alike;
there the chunks are stitched. The pieces between two stitches are encoded by merging
bytes in the order of the ranks. A text whose neighbours do not meet somewhere (a run of
one kind longer than the overlap) is pre-tokenised whole. Decoding joins the bytes of ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import fresh, text_of

# Code points of a chunk and of its overlap with the next.
CHUNK = 1 << 15
OVERLAP = 512
# A match that ends this near the end of a cut window might end elsewhere with more text.
MARGIN = 4
# Pieces remembered by a task.
REMEMBERED = 1 << 18
# Longer pieces are merged with a heap.
SHORT = 48
# Short pieces merged together, and bytes of text encoded (ids decoded) at once.
TOGETHER = 1 << 14
AT_ONCE = 1 << 18
# Ids are kept as bytes, four for each.
ID = np.dtype("<i4")
NO_RANK = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def white_space(pattern: str) -> str:
    """The pattern with Unicode's White_Space for ``\\s`` and ``\\S``."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the pairs of tokens that merge, and the rank of each merged token."""
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    return np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order]


def ranks_of(left: np.ndarray, right: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rank of each pair merged; NO_RANK where the pair does not merge or a side is missing (-1)."""
    keys, merged = table
    if not len(keys):
        return np.full(left.shape, NO_RANK)
    key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, merged[at], NO_RANK)


def merge_many(raw: list[bytes], ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Ids of many short pieces, merged together step by step.

    Every step merges the leftmost pair of least rank of each piece, and looks up its two
    new neighbours only; pieces without a pair leave.
    """
    out = [b""] * len(raw)
    sizes = np.array([len(r) for r in raw])
    width = int(sizes.max())
    data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(-1, width)
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    parts = np.where(np.arange(width) < sizes[:, None], single[data], -1)
    # One more column, always empty, stands to the right of the last part.
    parts = np.concatenate([parts, np.full((len(raw), 1), -1)], axis=1)
    pairs = ranks_of(parts[:, :-1], parts[:, 1:], table)
    piece, places = np.arange(len(raw)), np.arange(width)
    while True:
        row = np.arange(len(piece))
        best = pairs.argmin(axis=1)
        least = pairs[row, best]
        done = least == NO_RANK
        ids = parts[done].astype(ID)
        flat, step = ids.tobytes(), ids.shape[1] * ID.itemsize
        lengths = (ids >= 0).sum(axis=1) * ID.itemsize
        for k, (i, length) in enumerate(zip(piece[done].tolist(), lengths.tolist())):
            out[i] = flat[k * step : k * step + length]
        if done.all():
            return out
        if done.any():
            more = ~done
            piece, parts, pairs, best, least = piece[more], parts[more], pairs[more], best[more], least[more]
            row = np.arange(len(piece))
        parts[row, best] = least
        # Parts and pairs after the merged one move up by a place.
        after = np.minimum(places + (places > best[:, None]), width)
        parts[:, :-1] = np.take_along_axis(parts, after, axis=1)
        moved = np.minimum(places + (places >= best[:, None]), width - 1)
        pairs = np.take_along_axis(pairs, moved, axis=1)
        pairs[:, -1] = NO_RANK
        pairs[row, best] = ranks_of(least, parts[row, best + 1], table)
        inner = np.flatnonzero(best > 0)
        left = best[inner] - 1
        pairs[inner, left] = ranks_of(parts[inner, left], least[inner], table)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of candidate pairs over a linked list."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 when merged away
    before = list(range(-1, n - 1))

    def candidate(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : end[j]])
        return None if rank is None else (rank, i, end[j])

    heap = [c for c in map(candidate, range(n - 1)) if c]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        for start in (before[i], i):
            if start >= 0 and (c := candidate(start)):
                heapq.heappush(heap, c)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Encodes pre-tokens, remembering the short ones seen."""

    def __init__(self, ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray], pattern: str):
        super().__init__()
        self.ranks, self.table, self.find = ranks, table, regex.compile(white_space(pattern))

    def __missing__(self, piece: str) -> bytes:
        """Only pieces that are too long to be remembered get here."""
        return np.array(merge_long(piece.encode("utf-8", "surrogatepass"), self.ranks), dtype=ID).tobytes()

    def learn(self, pieces: set[str]) -> None:
        new = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self[piece] = whole.to_bytes(ID.itemsize, "little")
            elif len(raw) <= SHORT:
                new.append((len(raw), piece, raw))
        new.sort()
        # Pieces of about one length are merged together, so little is padding.
        for s in range(0, len(new), TOGETHER):
            part = new[s : s + TOGETHER]
            ids = merge_many([raw for _, _, raw in part], self.ranks, self.table)
            self.update(zip((piece for _, piece, _ in part), ids))

    def until(self, text: str, stop: int) -> list[str]:
        """The matches that end by ``stop``; what follows it is seen by look-ahead only."""
        out = []
        for m in self.find.finditer(text):
            if m.end() > stop:
                break
            out.append(m.group())
        return out

    def encode(self, texts: list[str], stops: list[int] | None = None) -> list[bytes]:
        """The ids of each text, or of its part up to a stop where a match ends."""
        if len(self) > REMEMBERED:
            self.clear()
        found = list(map(self.until, texts, stops) if stops else map(self.find.findall, texts))
        self.learn(set(chain.from_iterable(found)).difference(self))
        return [b"".join(map(self.__getitem__, f)) for f in found]

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of matches within ``start..stop``, scanning from the beginning."""
        out = [0] if start == 0 else []
        for m in self.find.finditer(text):
            if m.end() > stop:
                break
            if m.end() >= start:
                out.append(m.end())
        return out


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: str) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != drop]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), values], [*(n for n, _ in kept), name])


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """First place and number of consecutive rows of about ``most`` units, at least one row."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield start, i + 1 - start
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes) - start


def encode_column(
    df: DataFrame, text: str, into: str, ranks, pattern: str, most: int = AT_ONCE, stop: str | None = None
) -> DataFrame:
    """Replace the column ``text`` by ``into``, the ids of each whole text.

    ``stop`` names an integer column, dropped too: only the matches that end by it count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*ranks.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
            for i, n in groups(sizes, most):
                part = batch.slice(i, n)
                stops = part.column(stop).to_pylist() if stop else None
                ids = pieces.encode([t or "" for t in part.column(at).to_pylist()], stops)
                ends = np.cumsum([0, *(len(x) // ID.itemsize for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=ID))
                if stop:
                    part = part.drop_columns([stop])
                yield with_column(part, into, pa.ListArray.from_arrays(pa.array(ends), values), text)

    fields = [f for f in df.schema.fields if f.name not in (text, stop)]
    return df.mapInArrow(run, StructType(fields).add(into, ArrayType(IntegerType())))


def cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = max(0, len(text) - 1) // chunk
                for k in range(last + 1):
                    window = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pylist(
                        [{"_h": key, "_k": k, "_last": k == last, "_t": window}],
                        pa.schema([("_h", pa.string()), ("_k", pa.int32()), ("_last", pa.bool_()), ("_t", pa.string())]),
                    )

    return run


def boundaries(ranks, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*ranks.value, pattern)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["_t"]
                sure = len(text) if r["_last"] else len(text) - MARGIN
                head = pieces.ends(text, 0, min(overlap, sure))
                tail = [] if r["_last"] else [e - chunk for e in pieces.ends(text, chunk, sure)]
                rows.append({"_h": r["_h"], "_k": r["_k"], "_head": head, "_tail": tail})
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("_h", pa.string()), ("_k", pa.int32()), ("_head", ints), ("_tail", ints)])
            )

    return run


def encode_long(texts: DataFrame, ranks, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``_h`` and ``_ids`` for the distinct texts ``_t``."""
    chunks = texts.mapInArrow(cut(chunk, overlap), "_h string, _k int, _last boolean, _t string")
    # Dealt by text and chunk, so one text keeps many tasks busy.
    chunks = chunks.repartition("_h", "_k")
    seen = chunks.mapInArrow(
        boundaries(ranks, pattern, chunk, overlap), "_h string, _k int, _head array<int>, _tail array<int>"
    )
    order = Window.partitionBy("_h").orderBy("_k")
    meet = F.array_min(F.array_intersect("_head", F.lag("_tail").over(order)))
    seams = seen.select("_h", "_k", F.when(F.col("_k") == 0, 0).otherwise(meet).alias("_start"))
    seams = seams.select("_h", "_k", "_start", F.lead("_start").over(order).alias("_next"))
    # One flag for each text: any chunk that does not meet the one before it.
    broken = F.max(F.col("_start").isNull()).over(Window.partitionBy("_h"))
    seams = seams.withColumn("_broken", broken)
    # What follows the seam stays in the window, as the last match may look ahead.
    width = F.when(F.col("_next").isNull(), F.length("_t")).otherwise(F.lit(chunk) + F.col("_next"))
    stitched = chunks.join(seams.filter("not _broken"), ["_h", "_k"]).select(
        "_h", "_k", F.expr("substring(_t, _start + 1)").alias("_t"), (width - F.col("_start")).cast("int").alias("_stop")
    )
    parts = encode_column(stitched, "_t", "_ids", ranks, pattern, stop="_stop")
    joined = parts.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("_k", "_ids"))).alias("_parts"))
    joined = joined.select("_h", F.flatten(F.col("_parts")["_ids"]).alias("_ids"))
    whole = texts.join(seams.filter("_broken").select("_h").distinct(), "_h")
    return joined.unionByName(encode_column(whole, "_t", "_ids", ranks, pattern))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "ids",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Replace ``text`` by ``into``, the ids of every text, other columns unchanged.

    A null text counts as empty and has no ids; special tokens are ordinary text. The rank
    table (bounded by the vocabulary) is sent to the tasks. Texts of up to ``chunk`` code
    points are one chunk and are encoded where they are read. Longer ones are chunked once
    for each distinct text and joined back, so repeated rows are alike. A column that has
    the name of ``into`` is replaced. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks)))
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower() and c != text])
    body = fresh(docs.columns, "_text")
    rows = docs.withColumn(text, text_of(text)).withColumnRenamed(text, body)
    short = encode_column(rows.filter(F.length(body) <= chunk), body, into, sent, pattern)
    key = fresh(rows.columns, "_hash")
    long = rows.filter(F.length(body) > chunk).withColumn(key, F.sha2(body, 256))
    texts = long.select(F.col(key).alias("_h"), F.col(body).alias("_t")).dropDuplicates(["_h"])
    found = encode_long(texts, sent, pattern, chunk, overlap).select(F.col("_h").alias(key), F.col("_ids").alias(into))
    return short.unionByName(long.drop(body).join(found, key).drop(key))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "bytes") -> DataFrame:
    """Replace ``ids`` by ``into``, the joined bytes (binary); null ids give no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in sent.value.items()}
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            sizes = batch.column(at).value_lengths().fill_null(0).to_pylist()
            for first, n in groups(sizes, AT_ONCE):
                rows = batch.slice(first, n)
                parts = list(map(token.__getitem__, rows.column(at).flatten().to_numpy().tolist()))
                ends = list(accumulate(sizes[first : first + n]))
                raw = [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
                yield with_column(rows, into, pa.array(raw, pa.binary()), ids)

    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == into.lower() and c != ids])
    fields = [f for f in encoded.schema.fields if f.name != ids]
    return encoded.mapInArrow(run, StructType(fields).add(into, BinaryType()))


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Number and hash of the ids of each document, and the hash of the decoded bytes."""
    encoded = encode(docs.select("doc_id", "text"), ranks, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256")
    )
    decoded = decode(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))

"""Order MinHash fingerprints of texts, and of each text after an edit of its end.

A k-mer is ``K`` code points in a row, told apart from earlier equal ones by a running
number, so every place of a text has an element of its own. For each of ``SKETCHES`` seeds
the ``PICKED`` elements of least hash are taken, put back in the order of the text and
hashed together. Two texts agree in a sketch if the same elements come in the same order,
which happens less and less as their edit distance grows; the share of equal sketches is
their likeness.

``edits`` compares every text with the next one in a given order and with an edited form
that ends like the next one. Rows are range-partitioned and sorted once, so the next row is
at hand but for the last one of each partition; those few are joined with the first rows
of the partitions that follow and finished by a few tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .common import materialise, text_of

K = 8
SKETCHES = 64
PICKED = 2
SEED = 11
# Elements ranked under all seeds at once.
BLOCK = 4096
# Rows of one result batch.
ROWS = 2048
# Rows read and handed to Python at once, so that a batch of whole texts stays small.
TEXTS = 512
# Ends of partitions that one task finishes.
SEAMS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-mer. A text shorter than ``k`` is one k-mer, an empty one has none."""
    width = min(k, len(points))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(points) - width + 1
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        grams *= _MIX
        grams += points[i : i + n]
        grams += np.uint64(1)
    return mixed(grams)


def elements(grams: np.ndarray) -> np.ndarray:
    """A hash of each k-mer and its running number among equal ones."""
    n = len(grams)
    bits = np.uint64(max(n - 1, 1).bit_length())
    # Sorted by k-mer and then by place, which fills the low bits.
    packed = np.sort(((grams >> bits) << bits) | np.arange(n, dtype=np.uint64))
    key = packed >> bits
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
    if len(starts) == n:
        return mixed(grams)
    number = np.zeros(n, np.uint64)
    number[place] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return mixed(grams + number * _STEP)


class Sketcher:
    """Takes the elements of least rank under every seed."""

    def __init__(self, k: int = K, sketches: int = SKETCHES, picked: int = PICKED, seed: int = SEED):
        self.k, self.n, self.picked = k, sketches, picked
        drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, (sketches, 1), dtype=np.uint32)
        self.factors = drawn | np.uint32(1)
        self.rows = np.arange(sketches)

    def none(self) -> tuple[np.ndarray, np.ndarray]:
        empty = np.zeros((self.n, 0))
        return empty.astype(np.uint64), empty.astype(np.uint64)

    def add(self, least: tuple[np.ndarray, np.ndarray], found: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place (as one number) and hash of the least elements, those of
        ``found``, which start at place ``first``, included. Equal ranks: the earlier place."""
        narrow = (found >> np.uint64(32)).astype(np.uint32)
        high = np.uint32(0xFFFFFFFF)
        for at in range(0, len(found), BLOCK):
            ranks = narrow[at : at + BLOCK] * self.factors
            ranks ^= ranks >> np.uint32(15)
            ranks *= np.uint32(0x2C1B3C6D)
            # The highest rank marks what has been taken.
            np.minimum(ranks, high - np.uint32(1), out=ranks)
            keys, hashes = [least[0]], [least[1]]
            for _ in range(min(self.picked, ranks.shape[1])):
                place = ranks.argmin(axis=1)
                rank = ranks[self.rows, place].astype(np.uint64)
                ranks[self.rows, place] = high
                keys.append(((rank << np.uint64(32)) | (place + (first + at)).astype(np.uint64))[:, None])
                hashes.append(found[at + place][:, None])
            keys, hashes = np.concatenate(keys, axis=1), np.concatenate(hashes, axis=1)
            order = np.argsort(keys, axis=1)[:, : self.picked]
            least = np.take_along_axis(keys, order, axis=1), np.take_along_axis(hashes, order, axis=1)
        return least

    def tied(self, least: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each seed a hash of its elements in text order."""
        keys, hashes = least
        place = keys & np.uint64(0xFFFFFFFF)
        ordered = np.take_along_axis(hashes, np.argsort(place, axis=1), axis=1)
        found = np.full(self.n, ordered.shape[1], np.uint64)
        for i in range(ordered.shape[1]):
            found = mixed(found * _MIX + ordered[:, i])
        return (found >> np.uint64(32)).astype(np.uint32)

    def sketch(self, text: str) -> np.ndarray:
        return self.tied(self.add(self.none(), elements(kmers(code_points(text), self.k)), 0))

    def begun(self, text: str, kept: int) -> Begun:
        return Begun(self, text, kept)


class Begun:
    """A text whose first ``kept`` code points another text may begin with too."""

    def __init__(self, sketcher: Sketcher, text: str, kept: int):
        self.sketcher, self.points, self.kept = sketcher, code_points(text), kept
        self.grams = kmers(self.points, sketcher.k)
        # K-mers of the common beginning; their running numbers are the same in both texts.
        self.shared = max(0, kept - sketcher.k + 1)
        own = elements(self.grams)
        self.least = sketcher.add(sketcher.none(), own[: self.shared], 0)
        self.sketch = sketcher.tied(sketcher.add(self.least, own[self.shared :], self.shared))

    def changed(self, end: str) -> np.ndarray:
        """The sketches of the common beginning followed by ``end``."""
        s = self.sketcher
        points = np.concatenate([self.points[: self.kept], code_points(end)])
        grams = np.concatenate([self.grams[: self.shared], kmers(points[self.shared :], s.k)])
        return s.tied(s.add(self.least, elements(grams)[self.shared :], self.shared))


def add_fingerprint(
    df: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K, sketches: int = SKETCHES,
    picked: int = PICKED, seed: int = SEED,
) -> DataFrame:
    """Replace ``text`` by ``into``, its fingerprint in hexadecimal, eight digits a sketch.

    A null text counts as empty. A column that has the name of ``into`` is replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower() and c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, sketches, picked, seed)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [sketcher.sketch(t.as_py() or "").astype(">u4").tobytes().hex() for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if i != at]
            columns = [*(batch.column(i) for i in kept), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), into])

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name != text]).add(into, "string"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches of two fingerprints, 0 to 1."""
    n = (F.length(a) / 8).cast("int")
    same = lambda i: (F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))).cast("int")
    equal = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), same), F.lit(0), lambda x, y: x + y)
    return F.try_divide(equal.cast("double"), n.cast("double"))


RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, following: str) -> tuple[int, str]:
    """Code points kept of ``text`` when its last third is replaced, and what replaces it."""
    lost = len(text) // 3
    return len(text) - lost, following[:lost]


def compared(begun: Begun, text: str, following: str, after: np.ndarray) -> tuple:
    """The result columns for a text, the one that follows and the sketches of that one."""
    kept, end = edited(text, following)
    new = begun.changed(end)
    digest = hashlib.sha256((text[:kept] + end).encode("utf-8", "surrogatepass")).hexdigest()
    own = begun.sketch
    raw = lambda x: x.astype(">u4").tobytes()
    return len(text), digest, raw(own), raw(new), float(np.mean(own == new)), float(np.mean(own == after))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_FIELDS = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Spark reads and hands over ``TEXTS`` rows at once, unless fewer are set."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, rows in before.items():
        # No limit is given by zero or less.
        spark.conf.set(name, str(min(int(rows), TEXTS) if int(rows) > 0 else TEXTS))
    try:
        yield
    finally:
        for name, rows in before.items():
            spark.conf.set(name, rows)


def edits(
    docs: DataFrame, order: str = "doc_id", k: int = K, sketches: int = SKETCHES, picked: int = PICKED, seed: int = SEED
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    Rows stand in falling order of ``order``, a missing one last, equal ones by their
    texts' hashes; after the last row comes the first, and a single row comes after itself.
    The edited form has the last third of the code points (rounded down) replaced by the
    first as many, or all, of the next text. ``near_edited`` compares a text with its
    edited form, ``near_next`` with the next text. A null text counts as empty; an empty
    text is like another empty one (1.0). Reads ``order`` and text, returns ``order`` and
    the result columns, the fingerprints as bytes, four a sketch. Repeated rows are kept.
    An empty table gives an empty table.
    """
    made = lambda: Sketcher(k, sketches, picked, seed)
    kind = docs.schema[order].dataType.simpleString()
    rows = docs.select(F.col(order).alias("id"), text_of().alias("text")).withColumns(
        # Equal rows are told apart, so that many of them are dealt to several tasks.
        {"_h": F.xxhash64("text"), "_line": F.monotonically_increasing_id()}
    )
    keys = [F.col("id").desc_nulls_last(), F.col("_h"), F.col("_line")]
    lined = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    lined = lined.select(F.spark_partition_id().alias("part"), "id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``state`` 0: a finished row; 1: the first text of a partition; 2: the last."""
        sketcher = made()
        names = ["part", "state", "id", "text"]

        def found(schema: pa.Schema) -> Iterator[tuple]:
            nothing = (None,) * len(_FIELDS)
            before = None
            for batch in (first, *batches):
                for part, id, text in zip(*(batch.column(i) for i in range(3))):
                    part, text = part.as_py(), text.as_py()
                    begun = sketcher.begun(text, edited(text, "")[0])
                    if before is None:
                        yield part, 1, None, text, *nothing
                    else:
                        yield part, 0, before[1], None, *compared(before[0], before[2], text, begun.sketch)
                    before = begun, id.as_py(), text
            if before:
                yield part, 2, before[1], before[2], *nothing

        first = next(batches, None)
        if first is None:
            return
        types = [pa.int32(), pa.int32(), first.schema.field("id").type, pa.string()]
        schema = pa.schema([*zip(names, types), *_FIELDS])
        yield from _batches(found(schema), schema)

    with _small_batches(docs.sparkSession):
        told = materialise(lined.mapInArrow(walk, f"part int, state int, id {kind}, text string, {RESULT}"))

    # One row for each partition with rows: the first text of the next one, or of the first.
    firsts = told.filter("state = 1").select("part", F.col("text").alias("following"))
    parts = firsts.select("part")
    least = parts.agg(F.min("part"))
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), least.scalar())
    ends = told.filter("state = 2").select("part", "id", "text")
    ends = ends.join(F.broadcast(parts.select("part", after.alias("_next"))), "part")
    ends = ends.join(firsts.withColumnRenamed("part", "_next"), "_next").select("id", "text", "following")
    # Else each end is a task and a file of its own.
    ends = ends.repartition(max(1, -(-parts.count() // SEAMS)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = made()
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), *_FIELDS])
            values = zip(*(batch.column(i).to_pylist() for i in range(3)))
            rows = (
                (id, *compared(sketcher.begun(text, edited(text, "")[0]), text, following, sketcher.sketch(following)))
                for id, text, following in values
            )
            yield from _batches(rows, schema)

    names = ["id", *(n for n, _ in _FIELDS)]
    last = ends.mapInArrow(finish, f"id {kind}, {RESULT}")
    done = told.filter("state = 0").select(*names).unionByName(last)
    return done.withColumnRenamed("id", order)


def digest(docs: DataFrame) -> DataFrame:
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return edits(docs).withColumns(hexed)

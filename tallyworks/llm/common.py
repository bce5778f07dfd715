"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import sources

# Words are runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


# Bits of a bitmap.
SLOTS = 1 << 24

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go at once.

    The written table takes their place, and ``df`` itself is not run again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP)
    conf.set(CLEAN_UP, "true")
    try:
        return sources.materialise(df)
    finally:
        conf.set(CLEAN_UP, before)


def text_of(name: str = "text") -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def aside(docs: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns other than ``read`` under names that nothing else uses, and the way back."""
    names = docs.columns
    held = {c: c if c in read else f"_held_{i}_" for i, c in enumerate(names)}
    back = [F.col(held[c]).alias(c) for c in names]
    return docs.select(*[F.col(c).alias(held[c]) for c in names]), lambda rows: rows.select(*back)


def blocks_of(df: DataFrame, size: Column, per_block: int) -> int:
    """Blocks of about ``per_block`` units that ``df`` fills, by one aggregate."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // per_block))


def number_rows(df: DataFrame, order: list[str], into: str, extra: int = 0) -> DataFrame:
    """Add ``into``, each row's place from 0 in the order of all rows.

    Rows are range-partitioned and sorted, written once with their place in the
    partition, and shifted by the sizes of the partitions before; only one count for each
    partition meets in one task. ``order`` must tell any two unequal rows apart.
    """
    spread = df.repartitionByRange(extra, *order) if extra else df.repartitionByRange(*order)
    placed = materialise(
        spread.sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_spot", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(into, F.col("_before") + inside)
        .drop("_spot", "_part", "_before")
    )


def bitmap(hashes: DataFrame) -> DataFrame:
    """The hashes ``h`` as ``SLOTS`` bits in one row: an array of 64-bit words."""
    slot = F.pmod("h", F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    set_bits = hashes.select(F.floor(slot / 64).cast("int").alias("word"), bit.alias("bits"))
    every = hashes.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return materialise(words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select("w.bits"))


def holds(bits: Column, h: Column) -> Column:
    """Whether the bit of a hash is set in the words of a bitmap."""
    slot = F.pmod(h, F.lit(SLOTS))
    return F.bit_get(F.get(bits, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1

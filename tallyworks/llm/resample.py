"""Importance resampling of a corpus towards a target distribution.

Texts are split into words by an untrained pre-tokeniser, which gives each word with its
offsets. A feature is a run of words, named by the pair of offsets it lies between, and
falls in one of a fixed number of buckets by the crc32 of its text. Each text is split
once and kept as its few filled buckets; the histograms of corpus and target, the gain of
each bucket and the sum of gains of each document follow from that table. Adding Gumbel
noise that depends on the document alone and taking the highest scores draws without
replacement, in proportion to the exponential of the weights.

Gains and noise are whole thousandths, rounded down, so that sums do not depend on order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import fresh, materialise, number_rows

# A word has no ASCII character but digits and letters; texts are lowered in ASCII first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAMS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
# Code points split at once; a longer text is cut where no word is.
SLICE = 1 << 18


def spans(lowered: str, splitter, gap: re.Pattern) -> Iterator[list[tuple[int, int]]]:
    """The offsets of the words of a text, slice by slice."""
    start = 0
    while start < len(lowered):
        cut = gap.search(lowered, start + SLICE)
        stop = cut.start() if cut else len(lowered)
        found = splitter.pre_tokenize_str(lowered[start:stop])
        yield [(start + a, start + b) for _, (a, b) in found]
        start = stop


def filled(text: str, splitter, gap: re.Pattern, ngrams: int, buckets: int) -> tuple[int, Counter]:
    """Words of a text and the features in each bucket."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words, tail, counts = 0, [], Counter()
    for part in spans(lowered, splitter, gap):
        words += len(part)
        known = tail + part
        seen: Counter = Counter()
        for n in range(1, ngrams + 1):
            # Windows that end in this slice: the pair of offsets of their first and last word.
            first = max(0, len(tail) - n + 1)
            pairs = part if n == 1 else [(a, e) for (a, _), (_, e) in zip(known[first:], known[first + n - 1 :])]
            features = Counter(lowered[a:e] for a, e in pairs)
            for feature, k in features.items():
                joined = feature if n == 1 else gap.sub(" ", feature)
                seen[zlib.crc32(joined.encode("utf-8", "surrogatepass")) % buckets] += k
        counts.update(seen)
        tail = known[len(known) - ngrams + 1 :] if ngrams > 1 else []
    return words, counts


def features(rows: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``_words``, its number of words, and ``_at``, ``_n``: its filled
    buckets and the features in each. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        splitter = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        gap = re.compile(BREAK)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            words, at, n, ends = [], [], [], [0]
            for value in batch.column(place):
                count, found = filled(value.as_py() or "", splitter, gap, ngrams, buckets)
                words.append(count)
                at += found.keys()
                n += found.values()
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            kept = [i for i in range(batch.num_columns) if i != place]
            made = [
                pa.array(words, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())),
            ]
            names = [*(batch.schema.names[i] for i in kept), "_words", "_at", "_n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names)

    schema = StructType([f for f in rows.schema.fields if f.name != text])
    schema = schema.add("_words", LongType()).add("_at", ArrayType(IntegerType())).add("_n", ArrayType(LongType()))
    return rows.mapInArrow(run, schema)


def histogram(found: DataFrame) -> DataFrame:
    """Features of all texts in each bucket that has any."""
    pairs = found.select(F.explode(F.arrays_zip("_at", "_n")).alias("_x"))
    return pairs.groupBy(F.col("_x._at").alias("bucket")).agg(F.sum("_x._n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain`` for each bucket: the log ratio of the shares in target and
    corpus, one feature added to every bucket of both."""
    both = (
        raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        .unionByName(
            raw.sparkSession.range(buckets).select(
                F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")
            )
        )
        .groupBy("bucket")
        .agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    )
    total = both.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t")))
    double = lambda c: c.cast("double")
    ratio = (double(F.col("t") + 1) * double(F.col("_all.s") + buckets)) / (
        double(F.col("s") + 1) * double(F.col("_all.t") + buckets)
    )
    return both.withColumn("_all", total.scalar()).select("bucket", F.floor(SCALE * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths that follows from seed and id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32))))


def score(
    docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of ``docs``.

    Reads doc_id and text of ``docs`` and text of ``target``; other columns of ``docs``
    are kept, in place of the text. A null text counts as empty; a text without words
    has weight 0. Of the rows with ``least_words`` words ``percent`` in a hundred are
    drawn, rounded down, by falling score; ties go to the smaller doc_id, a missing one
    last, then in the order of features and weight. Repeated rows are rows of their own
    and may be drawn apart. ``rank`` is null where a row is not drawn. An empty table gives
    an empty table; an empty target makes rare features weigh most.

    The gains are one array of ``buckets`` numbers, whatever the size of the corpus.
    """
    kept = [c for c in docs.columns if c != "text"]
    held = {c: f"_held_{i}_" for i, c in enumerate(kept)}
    named = docs.select(*[F.col(c).alias(h) for c, h in held.items()], "text")
    found = materialise(features(named, ngrams, buckets))
    wanted = features(target.select("text"), ngrams, buckets)
    gain = gains(histogram(found), histogram(wanted), buckets)
    table = gain.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g")).select("g.gain")
    products = F.zip_with("_at", "_n", lambda b, n: F.get(F.col("_gain"), b) * n)
    add = lambda total, x: total + x
    zero = F.lit(0).cast("long")
    doc_id = F.col(held["doc_id"])
    weighed = found.withColumn("_gain", materialise(table).scalar()).select(
        *held.values(),
        F.col("_words").alias("_w"),
        F.aggregate("_n", zero, add).alias("_features"),
        F.aggregate(products, zero, add).alias("_weight"),
    )
    ordered = weighed.select(
        "*",
        (F.col("_w") < least_words).alias("_short"),
        (-F.col("_weight") - noise(doc_id, seed)).alias("_low"),
        doc_id.isNull().alias("_unnamed"),
        # Equal rows are told apart, so that many of them are dealt to several tasks.
        F.monotonically_increasing_id().alias("_line"),
    )
    order = ["_short", "_low", "_unnamed", held["doc_id"], "_features", "_weight", "_line"]
    placed = number_rows(ordered, order, "_place")
    long_enough = found.filter(F.col("_words") >= least_words).agg(F.count("*"))
    drawn = F.floor(long_enough.scalar() * percent / 100)
    rank = F.when(~F.col("_short") & (F.col("_place") < drawn), F.col("_place") + 1)
    made = {
        "n_words": F.col("_w"), "n_features": F.col("_features"), "weight": F.col("_weight"),
        "score": -F.col("_low"), "rank": rank,
    }
    taken = {n.lower() for n in made}
    return placed.select(
        *[F.col(h).alias(c) for c, h in held.items() if c.lower() not in taken],
        *[c.cast("long").alias(n) for n, c in made.items()],
    )


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; options as in ``score``."""
    line = fresh(docs.columns, "_row")
    rows = materialise(docs.withColumn(line, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(line).alias("_row"), "doc_id", "text")
    drawn = score(narrow, target, **options).filter(F.col("rank").isNotNull())
    return rows.join(drawn.select(F.col("_row").alias(line)), line, "left_semi").drop(line)

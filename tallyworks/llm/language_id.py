"""Language identification by averaged subword embeddings and a linear softmax.

Character n-grams of two to four within words are hashed to rows of an embedding table; a
text is the average of its rows, and a linear softmax gives a probability to each
language. Both are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Part of the sample sets the temperature of the softmax and the
least score at which a prediction is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh

BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
# Rows of the sample, for all languages together, and languages that are told apart.
SAMPLE = 4000
EPOCHS = 6
RATE = 0.5
# Share of accepted predictions that should be right, with so many normal deviations of
# certainty (95 %), and the part of the sampled texts that is held for calibration.
PRECISION = 0.97
CERTAIN = 1.6448536269514722
HELD = 5
# Code points handled at once; a longer text is added up part by part.
PART = 1 << 20
UNKNOWN = "und"
SEED = 7


TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    if "letters" not in TABLES:
        TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return TABLES["letters"]


def gram_counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs in the whole text; None if it has no letter."""
    total = None
    for start in range(0, len(text), PART):
        codes = np.frombuffer(text[start : start + PART].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[codes]
        if not is_letter.any():
            continue
        # Words between single spaces, one before the first and after the last.
        codes = np.where(is_letter, codes, 32)
        kept = is_letter | np.concatenate(([False], is_letter[:-1]))
        codes = np.concatenate(([32], codes[kept], [32])).astype(np.uint32)
        inside = codes != 32
        for n in GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            mixed = np.full(m, n, dtype=np.uint32)
            whole = inside[:m] | inside[n - 1 :][:m]
            for k in range(n):
                mixed = mixed * np.uint32(16777619) ^ codes[k : k + m]
                if 0 < k < n - 1:
                    whole &= inside[k : k + m]
            at = (mixed[whole] * np.uint32(2654435761)) >> np.uint32(17)
            found = np.bincount(at, minlength=BUCKETS)
            total = found if total is None else total + found
    return total


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def score(self, counts: np.ndarray) -> np.ndarray:
        mean = counts.astype(np.float32) @ self.embedding / counts.sum()
        logits = (mean @ self.weights + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()


# Language, buckets, their counts, and a number that follows from the whole text.
Example = tuple[int, np.ndarray, np.ndarray, int]


def fit(examples: list[Example], languages: list[str]) -> Model:
    """Gradient descent over the examples; those of a fifth of the texts calibrate.

    A text and its pieces, and all copies of a text, are on the same side.
    """
    rng = np.random.default_rng(SEED)
    n = len(languages)
    model = Model(
        languages,
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        np.zeros((DIM, n), dtype=np.float32),
        np.zeros(n, dtype=np.float32),
    )
    held = [x for x in examples if x[3] % HELD == 0]
    used = [x for x in examples if x[3] % HELD]
    if not used:
        held, used = [], examples
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(used)):
            language, at, counts, _ = used[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ model.embedding[at]
            logits = mean @ model.weights + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[language] -= 1
            back = model.weights @ p
            model.weights -= rate * np.outer(mean, p)
            model.bias -= rate * p
            # Each row moves by its share; scaled so that rare buckets learn too.
            model.embedding[at] -= (rate * len(at) ** 0.5) * np.outer(share, back)
    calibrate(model, held)
    return model


def lower_bound(hits: np.ndarray, n: np.ndarray, z: float = CERTAIN) -> np.ndarray:
    """Wilson's lower bound of a share."""
    return (hits + z * z / 2 - z * np.sqrt(hits * (n - hits) / n + z * z / 4)) / (n + z * z)


def calibrate(model: Model, held: list[Example]) -> None:
    """The temperature of least log loss, then the least score that keeps the precision.

    Scores are tried from the highest down, from the number of predictions on that could
    show the precision at all; the first failure ends it. Without such a score nothing is
    accepted.
    """
    if not held:
        return
    logits = []
    for _, at, counts, _ in held:
        mean = (counts / counts.sum()).astype(np.float32) @ model.embedding[at]
        logits.append(mean @ model.weights + model.bias)
    z, right = np.array(logits), np.array([x[0] for x in held])

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    rows = np.arange(len(right))
    model.temperature = min(
        (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0),
        key=lambda t: -np.log(softmax(t)[rows, right] + 1e-12).mean(),
    )
    p = softmax(model.temperature)
    best, hit = p.max(axis=1), p.argmax(axis=1) == right
    order = np.argsort(-best, kind="stable")
    n = np.arange(1, len(order) + 1)
    precise = lower_bound(np.cumsum(hit[order]), n) >= PRECISION
    tried = lower_bound(n, n) >= PRECISION
    kept = int((np.cumprod(precise[tried])).sum())
    model.least = float(best[order][tried][kept - 1]) if kept else 1.0


def sample(labelled: DataFrame, lang: str, text: str, salt: Column, rows: int = SAMPLE) -> tuple[list[str], list[Example]] | None:
    """The languages and examples of a bounded sample of texts; None without any.

    The sample takes equally many different texts of each language, those of least hash of
    ``salt`` and text, so it does not depend on partitions or on repeated ids. ``rows``
    texts have no more than ``rows`` languages; of more the most frequent are told apart.
    Each text gives its whole and a short piece of it, for short texts. Only bucket counts
    reach the driver, in flat arrays whose size does not depend on the length of a text:
    at most ``2 * rows`` lists of at most ``BUCKETS`` entries.
    """
    key = F.xxhash64(F.col(text))
    known = F.approx_count_distinct(key, 0.02).alias("count")
    counts = labelled.groupBy(lang).agg(known).orderBy(F.desc("count"), lang).limit(rows).collect()
    if not counts:
        return None
    each = max(1, rows // len(counts))
    # Draws enough by chance, so that no more than these are ranked; six deviations and 20
    # rows over the quota, and the error of the count, so that no language runs short.
    drawn = 1.1 * (each + 6 * each**0.5 + 20)
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r[lang], min(1.0, drawn / max(1, r["count"])))])
    place = F.pmod(F.xxhash64(F.lit("sample"), salt, F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = labelled.filter(place < F.element_at(chance, F.col(lang)))
    near = near.select(F.col(lang).alias("l"), key.alias("k"), F.length(text).alias("n"), place.alias("p"), F.col(text).alias("t"))
    near = near.groupBy("l", "k", "n").agg(F.min_by("t", "p").alias("t"), F.min("p").alias("p"))
    first = Window.partitionBy("l").orderBy("p", "k", "n")
    least = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= each).select("l", "t", "p", "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                t = r["t"]
                at = int(r["p"] * 1e9) % max(1, len(t) - 60)
                for part in (t, t[at : at + 60]):
                    found = gram_counts(part)
                    if found is not None:
                        some = np.flatnonzero(found)
                        rows.append({"l": r["l"], "p": r["p"], "k": r["k"], "at": some.tolist(), "n": found[some].tolist()})
            yield pa.RecordBatch.from_pylist(
                rows,
                pa.schema([("l", pa.string()), ("p", pa.float64()), ("k", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]),
            )

    found = least.mapInArrow(count, "l string, p double, k long, at array<int>, n array<long>").toArrow().combine_chunks()
    if not len(found):
        return None
    columns = {c: found.column(c).combine_chunks() for c in ("at", "n")}
    at, n = (columns[c].flatten().to_numpy() for c in ("at", "n"))
    ends = np.concatenate(([0], np.cumsum(columns["at"].value_lengths().to_numpy())))
    label, place_of, text_of_ = (found.column(c).to_pylist() for c in ("l", "p", "k"))
    size = np.diff(ends)
    order = sorted(range(len(label)), key=lambda i: (place_of[i], label[i], size[i], text_of_[i]))
    number = {l: i for i, l in enumerate(sorted(r[lang] for r in counts))}
    parts = [slice(ends[i], ends[i + 1]) for i in range(len(label))]
    examples = [(number[label[i]], at[parts[i]].astype(np.int64), n[parts[i]].astype(np.float64), text_of_[i]) for i in order]
    return sorted(number), examples


def train(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", salt: str = "doc_id") -> Model | None:
    """A model from the rows where ``usable`` holds; None if none has a language and a letter."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    drawn = sample(rows, lang, text, F.coalesce(F.col(salt).cast("string"), F.lit("")))
    if not drawn:
        return None
    return fit(drawn[1], drawn[0])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``lang_pred``, ``score`` and ``accepted``.

    A null text or one without a letter is ``und`` with score 0 and not accepted, as is
    everything without a model. Columns with the names of the results are replaced.
    """
    own = ("lang_pred", "score", "accepted")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own and c != text])
    body = fresh([*docs.columns, *own], "_text")
    docs = docs.withColumnRenamed(text, body)

    def one(value: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(value) if value and model else None
        if counts is None or not counts.sum():
            return UNKNOWN, 0.0, False
        p = model.score(counts)
        best = int(p.argmax())
        return model.languages[best], float(p[best]), bool(p[best] >= model.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(body)
            found = [one(t.as_py()) for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if i != at]
            new = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *new], [*(batch.schema.names[i] for i in kept), *own]
            )

    schema = docs.drop(body).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.mapInArrow(run, schema)

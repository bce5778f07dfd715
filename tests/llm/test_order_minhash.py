"""Order MinHash against its definition in plain Python, over whole tables."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyworks.llm import order_minhash, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MASK = (1 << 64) - 1
MIX, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mixed(x):
    x = (x ^ (x >> 31)) * MIX & MASK
    x = (x ^ (x >> 29)) * STEP & MASK
    return x ^ (x >> 32)


def by_definition(text, k=8, sketches=64, picked=2, seed=11):
    """The fingerprint by sorting all elements under every seed."""
    width = min(k, len(text))
    seen, elements = {}, []
    for i in range(len(text) - width + 1 if text else 0):
        gram = text[i : i + width]
        h = 0
        for c in gram:
            h = (h * MIX + ord(c) + 1) & MASK
        number = seen[gram] = seen.get(gram, -1) + 1
        elements.append(mixed((mixed(h) + number * STEP) & MASK))
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, (sketches, 1), dtype=np.uint32)
    found = []
    for factor in (drawn.ravel() | np.uint32(1)).tolist():
        ranked = []
        for place, element in enumerate(elements):
            r = (element >> 32) * factor & 0xFFFFFFFF
            r = (r ^ (r >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
            ranked.append((min(r, 0xFFFFFFFE), place, element))
        least = sorted(sorted(ranked)[:picked], key=lambda x: x[1])
        h = len(least)
        for _, _, element in least:
            h = mixed((h * MIX + element) & MASK)
        found.append(f"{h >> 32:08x}")
    return "".join(found)


def alike(a, b):
    parts = lambda x: [x[i : i + 8] for i in range(0, len(x), 8)]
    return float(np.mean([x == y for x, y in zip(parts(a), parts(b))]))


def fingerprint(text):
    return order_minhash.Sketcher().sketch(text).astype(">u4").tobytes().hex()


@pytest.mark.parametrize("seed", range(12))
def test_fingerprint_follows_the_definition(seed):
    draw = random.Random(seed)
    letters = ["ab", "abcdefgh ", "é日\U0001f600 x"][seed % 3]
    text = "".join(draw.choice(letters) for _ in range([0, 1, 7, 8, 9, 300, 5000][seed % 7]))
    assert fingerprint(text) == by_definition(text)


def test_a_long_text_is_ranked_in_blocks(monkeypatch):
    text = "".join(random.Random(5).choice("abcd ") for _ in range(900))
    whole = fingerprint(text)
    monkeypatch.setattr(order_minhash, "BLOCK", 17)
    assert fingerprint(text) == whole == by_definition(text)


def neighbours(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    signed = lambda t: (h := xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        lost = len(text) // 3
        yield doc_id, text, text[: len(text) - lost] + following[:lost], following


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def by_hand(docs):
    found = []
    for doc_id, text, new, following in neighbours(docs):
        a, b, c = map(fingerprint, (text, new, following))
        found.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(found, key=repr)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("name", ["given", "messy"])
def test_every_row_and_its_edited_form(request, name):
    docs = request.getfixturevalue(name)
    assert found(order_minhash.digest(docs)) == by_hand(docs)


def test_query(spark):
    result = queries.QUERIES["op11_order_minhash"](spark, FOLDER)
    assert found(result) == by_hand(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    kinds = dict(result.dtypes)
    assert [kinds[c] for c in COLUMNS] == ["bigint", "bigint", *["string"] * 3, "double", "double"]


def test_small_tables(spark, nothing):
    assert order_minhash.digest(nothing).count() == 0
    one = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    ((doc_id, n, sha, a, b, _, near),) = found(order_minhash.digest(one))
    assert (doc_id, n, near) == (4, 6, 1.0)
    assert sha == hashlib.sha256(b"abcdab").hexdigest()
    assert (a, b) == (fingerprint("abcdef"), fingerprint("abcdab"))


def test_fingerprint_column_and_likeness(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(text, text), (text, text[:800] + "other end"), (text, "nothing of the kind"), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    a = order_minhash.add_fingerprint(df, "a", "x")
    both = order_minhash.add_fingerprint(a, "b", "y")
    near = [r["near"] for r in both.select(order_minhash.likeness(F.col("x"), F.col("y")).alias("near")).collect()]
    assert near == [alike(fingerprint(x or ""), fingerprint(y or "")) for x, y in rows]
    assert near[0] == near[3] == 1.0 and near[2] == 0.0 and 0.1 < near[1] < 0.9


def test_order_counts(spark):
    # The same k-mers in another order: far apart by edits, equal as sets.
    draw = random.Random(3)
    blocks = ["".join(draw.choice("abcdefghij") for _ in range(200)) for _ in range(20)]
    turned = "".join(reversed(blocks))
    straight = "".join(blocks)
    swapped = "".join(blocks[1::-1] + blocks[2:])
    a = fingerprint(straight)
    assert alike(a, fingerprint(turned)) < 0.3 < alike(a, fingerprint(swapped))


def test_likeness_falls_with_edits():
    draw = random.Random(8)
    text = "".join(draw.choice("abcdefghijklmnop ") for _ in range(4000))
    near = []
    for changes in (0, 20, 80, 320):
        letters = list(text)
        for i in draw.sample(range(4000), changes):
            letters[i] = "#"
        near.append(alike(fingerprint(text), fingerprint("".join(letters))))
    assert near == sorted(near, reverse=True) and near[0] == 1.0 and near[1] > near[3] + 0.3


BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}


def test_texts_are_read_and_handed_over_in_small_batches(spark, given, monkeypatch):
    real, seen = order_minhash.materialise, []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    def spy(df):
        seen.extend(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())
        seen.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        return real(df)

    monkeypatch.setattr(order_minhash, "materialise", spy)
    assert {name: spark.conf.get(name) for name in BATCHES} == BATCHES
    assert found(order_minhash.digest(given)) == by_hand(given)
    assert len(seen) > 2 and max(seen) <= 512
    assert {name: spark.conf.get(name) for name in BATCHES} == BATCHES


def test_fewer_rows_at_once_stay_set(spark, given, monkeypatch):
    seen = []

    def spy(df):
        seen.append({name: int(spark.conf.get(name)) for name in BATCHES})
        raise ValueError("not written")

    monkeypatch.setattr(order_minhash, "materialise", spy)
    for rows, at_once in (("100", 100), ("0", 512)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            with pytest.raises(ValueError, match="not written"):
                order_minhash.edits(given)
            assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert seen.pop()["spark.sql.execution.arrow.maxRecordsPerBatch"] == at_once


def test_ends_of_many_partitions_are_a_few_tasks(spark, given):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    for name, value in zip(("spark.sql.shuffle.partitions", *names), ("70", "false", "-1")):
        spark.conf.set(name, value)
    try:
        result = order_minhash.digest(given)
        assert found(result) == by_hand(given)
        # The written rows are read by a task a core, the ends of 70 partitions by two more.
        assert result.select(F.spark_partition_id().alias("task")).distinct().count() <= 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for name in names:
            spark.conf.unset(name)

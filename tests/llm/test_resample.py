"""Importance resampling against plain Python over whole tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest

from tallyworks.llm import queries, resample

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def windows(text, widest):
    words = WORD.findall(lowered(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, widest + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, target, widest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_words, n_features, weight, score, rank) of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    parts = [(d, *windows(t, widest)) for d, t in docs]
    raw = Counter(bucket(f) for _, _, fs in parts for f in fs)
    aim = Counter(bucket(f) for t in target for f in windows(t, widest)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [
        math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for d, n, fs in parts:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = [(*r, i + 1) for i, r in enumerate(long[: percent * len(long) // 100])]
    rest = long[len(drawn) :] + [r for r in rows if r[1] < least]
    return sorted(drawn + [(*r, None) for r in rest], key=repr)


def found(df):
    rows = df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"ngrams": 3, "buckets": 97, "percent": 50, "least_words": 2, "seed": 7}])
@pytest.mark.parametrize("name", ["given", "messy"])
def test_scores_and_ranks(request, spark, name, options):
    docs = request.getfixturevalue(name)
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    keys = {"ngrams": "widest", "least_words": "least"}
    expected = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], texts, **{keys.get(k, k): v for k, v in options.items()})
    assert found(resample.score(docs, target, **options)) == expected


def test_query_returns_the_contract(spark):
    result = queries.QUERIES["op13_importance_resampling"](spark, FOLDER)
    assert dict(result.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = sorted((r[:1] + r[2:] for r in by_hand(docs, texts)), key=repr)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, result.select(*columns).collect()), key=repr) == expected


def test_slices_do_not_cut_words_or_windows(spark, monkeypatch, messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    monkeypatch.setattr(resample, "SLICE", 7)
    options = {"ngrams": 2, "buckets": 50, "percent": 100, "least_words": 0}
    assert found(resample.score(messy, messy, **options)) == by_hand(
        docs, [t for _, t in docs], widest=2, buckets=50, percent=100, least=0
    )


def test_empty_tables(spark, nothing, messy):
    assert resample.score(nothing, messy).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(resample.score(messy, nothing, percent=60)) == by_hand(docs, [], percent=60)


def test_drawn_documents_keep_their_columns(messy):
    whole = resample.resample(messy, messy, percent=40, least_words=2)
    ranked = resample.score(messy, messy, percent=40, least_words=2).filter("rank is not null")
    assert whole.columns == messy.columns
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)
    assert ids(whole) == ids(ranked)


def test_equal_rows_are_drawn_apart(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 10 + [(2, "four")], "doc_id long, text string")
    ranks = [r["rank"] for r in resample.score(docs, docs, percent=50, least_words=2).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4, 5]

"""Certified levels of the quality rules against a plain search with exact binomial sums."""

import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import quality

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def below(n, k, p):
    """P(X <= k) of the binomial distribution."""
    if n == 0:
        return 1.0
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def by_hand(rows, alpha=0.02, delta=0.05):
    """stratum -> (good, bad, pooled, level, rejected, caught, cuts)."""
    strata = defaultdict(list)
    for s, good, values in rows:
        strata[s].append((good, values))
    family = len(strata)
    goods = {s: sum(g for g, _ in held) for s, held in strata.items()}
    small = {s for s in strata if (1 - alpha) ** goods[s] > delta / family}
    units = {s: held for s, held in strata.items() if s not in small}
    pool = [x for s in small for x in strata[s]]
    found = {}
    for unit, held in [*units.items(), *([("pool of the small", pool)] if pool else [])]:
        best, n = None, sum(g for g, _ in held)
        for level in range(len(quality.PATH)):
            cuts = dict(quality.PATH[: level + 1])  # the last cutoff of each rule so far
            hit = [g for g, v in held if any(v.get(r, 0.0) > cuts[r] for r in cuts)]
            rejected, caught = sum(hit), len(hit) - sum(hit)
            if n == 0 or rejected > alpha * n or below(n, rejected, alpha) > delta / family:
                break
            if best is None or caught > best[2]:
                now = quality.PATH[level][0]
                useful = {}
                for r, c in cuts.items():
                    bad = [v[r] for g, v in held if not g and v.get(r, 0.0) > c]
                    if bad:
                        useful[r] = c if r == now else max(x for x in quality.CUTOFFS if x < min(bad))
                best = (level, rejected, caught, useful)
        found[unit] = best
    return {
        s: (goods[s], len(strata[s]) - goods[s], s in small, *(found["pool of the small" if s in small else s] or (None,) * 4))
        for s in strata
    }


def found(spark, rows):
    df = spark.createDataFrame(rows, "s string, _good boolean, _values map<string,double>")
    return {
        r["s"]: (r["good"], r["bad"], r["pooled"], r["level"], r["rejected"], r["caught"], r["_cuts"])
        for r in quality.certificates(df, "s").collect()
    }


def test_levels_of_hand_made_strata(spark):
    import random

    draw = random.Random(6)
    rows = []
    for s, good, bad in (("en", 900, 60), ("de", 300, 40), ("fr", 150, 30), ("es", 120, 20), (None, 20, 5), ("xx", 0, 3)):
        for i in range(good + bad):
            is_good = i < good
            values = {r: draw.random() * (0.02 if is_good else 0.6) for r in quality.RULES}
            values["capitals"] = draw.random() * 0.25
            if is_good and draw.random() < 0.004:
                values["symbols"] = 0.4
            rows.append((s, is_good, values))
    expected = by_hand(rows)
    assert found(spark, rows) == expected
    assert not expected["en"][2] and expected["en"][3] is not None
    assert all(expected[s][2] and expected[s][3] is not None for s in ("fr", "es", None, "xx"))


def test_given_labels(spark, given):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"))
    trials = quality.trials(given, known, "lang")
    rows = [(r["_stratum"], r["_good"], r["_values"]) for r in trials.collect()]
    passed = quality.judge(given, labels).filter("NOT base_failed").select("doc_id")
    distinct = given.join(known, "doc_id").join(passed.distinct(), "doc_id").select("lang", F.coalesce("text", F.lit(""))).distinct()
    assert len(rows) == distinct.count()
    assert found(spark, rows) == by_hand(rows)


def test_repeated_rows_change_no_cutoff(spark):
    texts = [(i, f"a plain text number {i} with words enough to be one of the good ones here") for i in range(29)]
    texts += [(100 + i, f"bad $$$$$$$$$$$$$$$$ {i} $$$$$$$$$$$$$$ $$$$$$$$$$$ and a few words more to have ten of them") for i in range(9)]
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in texts], "doc_id long, quality int")
    for copies in (1, 60):
        many = docs.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")
        kept = quality.judge(many, labels)
        # 29 good texts certify nothing, however often each is there.
        assert kept.filter("kept").count() == 38 * copies
    # The same text under many ids is one trial too.
    moved = docs.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("_c")).drop("_c")
    more = labels.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("_c")).drop("_c")
    assert quality.judge(moved, more).filter("NOT kept").count() == 0


def test_enough_texts_certify(spark):
    texts = [(i, f"a plain text number {i} with words enough to be one of the good ones here") for i in range(250)]
    texts += [(1000 + i, f"bad $$$$$$$$$$$$$$$$ {i} $$$$$$$$$$$$$$ $$$$$$$$$$$ and a few words more to have ten of them") for i in range(9)]
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in texts], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).filter("kept").collect()}
    assert kept == set(range(250))

"""The spans that personal data adds, against a plain count of texts, entities and terms."""

import math
import os
import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tallyworks.llm import pii
from tests_llm_support import plain_spans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN = regex.compile(r"[\p{L}\p{N}]+")


def bound(k, n, z=1.2815515655446004):
    return (k + z * z / 2 - z * math.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def free_terms(text, spans):
    """Runs of letters and digits that touch no identifier: (start, end, lowered)."""
    covered = set()
    for s, _, e in spans:
        covered.update(range(s, e))
    out = "".join("" if i in covered else (" " if c == "" else c) for i, c in enumerate(text))
    found = []
    for m in RUN.finditer(out):
        if (m.start() and out[m.start() - 1] == "") or (m.end() < len(out) and out[m.end()] == ""):
            continue
        found.append((m.start(), m.end(), m[0].lower()))
    return found


def added(texts, generalise=0.5, remove=0.8):
    """For each distinct text its added spans (start, end, kind)."""
    distinct = set(texts)
    spans = {t: plain_spans(t) for t in distinct}
    terms = {t: free_terms(t, spans[t]) for t in distinct}
    holders, with_term, with_both = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in distinct:
        names = {(k, t[s:e].lower() if k < 2 else "".join(c for c in t[s:e] if c in "0123456789")) for s, k, e in spans[t]}
        for w in {w.lower() for w in RUN.findall(t)}:
            with_term[w] += 1
        for entity in names:
            holders[entity] += 1
            for w in {w for _, _, w in terms[t]}:
                with_both[entity, w] += 1
    kinds = {}
    for (_, w), k in with_both.items():
        chance = bound(k, max(k, with_term[w]))
        if chance >= generalise:
            kinds[w] = max(kinds.get(w, 4), 5 if chance >= remove else 4)
    return {t: [(s, e, kinds[w]) for s, e, w in terms[t] if w in kinds] for t in distinct}


def found_spans(docs):
    rows = pii.find(docs.select("text")).select(
        F.coalesce("text", F.lit("")).alias("t"), F.filter("_all", lambda s: s["kind"] >= 4).alias("s")
    )
    return [(r["t"], [(s["start"], s["end"], s["kind"]) for s in r["s"]]) for r in rows.collect()]


def check(docs):
    texts = [r["text"] or "" for r in docs.collect()]
    expected = added(texts)
    found = found_spans(docs)
    assert sorted(t for t, _ in found) == sorted(texts)
    for text, spans in found:
        assert spans == expected[text]
    return sum(len(expected[t]) for t in texts)


@pytest.mark.parametrize("name", ["given", "messy"])
def test_added_spans_of_tables(request, name):
    check(request.getfixturevalue(name))


@pytest.mark.parametrize("seed", range(3))
def test_added_spans_of_a_corpus_with_people(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["李明", "Ö", "7", "the"]
    people = [(f"p{i}@mail{i}.example.org", [f"Name{i}", f"{1950 + i}", "陳" * (i % 3 + 1) + str(i)]) for i in range(12)]
    texts = []
    for i in range(300):
        body = [draw.choice(words) for _ in range(draw.randrange(1, 30))]
        if i % 3 == 0:
            address, marks = draw.choice(people)
            body += [address, *draw.sample(marks, draw.randrange(1, 4))]
        if i % 20 == 0:
            body += draw.choice(people)[1]
        draw.shuffle(body)
        texts.append(" ".join(body))
    texts += draw.choices(texts, k=80) + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert check(docs) > 50


def test_a_word_mostly_seen_without_the_entity_stays(spark):
    # Nine texts have the word, three of them with one address.
    texts = [f"filler text number{i} of many" for i in range(3000)]
    texts += [f"quorx note{i}" for i in range(6)] + [f"quorx and mail to zed@spy.example.com n{i}" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("quorx" in clean[i] for i in range(3000, 3009))
    assert all(clean[i] == texts[i] for i in range(3006))


def test_the_same_counts_mean_the_same_in_a_larger_corpus(spark):
    told = [f"Zorblat mails zed@spy.example.com about{i}" for i in range(3)] + ["mails"] * 2 + ["some mails here", "more mails now"]
    for size in (10, 4000):
        texts = told + [f"filler{i}" for i in range(size)]
        docs = spark.createDataFrame([(t,) for t in texts], "text string")
        pairs = {r["term"]: (r["both"], r["texts"], r["kind"]) for r in pii.weighed(docs, 0.5, 0.8).collect()}
        assert pairs == {"zorblat": (3, 3, 4)}


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([("Zorblat mails zed@spy.example.com",)] * 500, "text string")
    assert pii.weighed(docs, 0.5, 0.8).count() == 0


def test_lower_bound(spark):
    pairs = [(1, 1), (2, 2), (3, 9), (7, 7), (5, 100), (400, 401)]
    rows = spark.createDataFrame(pairs, "k long, n long")
    found = [r["p"] for r in rows.select(pii.lower_bound(F.col("k"), F.col("n")).alias("p")).collect()]
    assert found == pytest.approx([bound(k, n) for k, n in pairs])

"""Operators on texts against plain Python over whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import numpy as np
import pytest
import tiktoken
from xxhash import xxh64_intdigest

from tallyworks.llm import byte_bpe, context_tree, language_id, mixing, pii, quality, queries, sharding, simhash, suffix_dedup
from tallyworks.llm.common import id_crc
from tests_llm_support import KINDS, plain_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="session", params=["given", "messy"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"] or "", r["source"], r["lang"], r["text"]) for r in docs.collect()]


# Quality rules


def base_counts(text):
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, docs, texts):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    # So few labels certify nothing, and all that does not fail the base is kept.
    expected = [(d, *(b := base_counts(t)), not b[-1]) for d, t, *_ in texts]
    assert ordered(found.collect()) == ordered(expected)


def test_certified_cutoffs(spark):
    good = [("en", True, {"symbols": 0.001})] * 3000 + [("de", True, {"symbols": 0.001})] * 50
    bad = [("en", False, {"symbols": 0.3})] * 40 + [("de", False, {"symbols": 0.3})] * 40
    rows = spark.createDataFrame(good + bad, "s string, _good boolean, _values map<string,double>")
    cuts = {r["s"]: r["_cuts"] for r in quality.thresholds(rows, "s").collect()}
    # The most lenient cutoff that catches all bad ones; 50 labels are too few.
    assert cuts == {"en": {"symbols": 0.28}}


def test_binomial_bound(spark):
    pairs = [(50, 0), (200, 3), (3000, 5), (100_000, 380)]
    rows = spark.createDataFrame(pairs, "n long, k long")
    found = rows.select("n", "k", quality.log_binomial_below(rows.n, rows.k, 0.004).alias("p")).collect()
    for n, k, p in found:
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.004) + (n - i) * math.log(0.996) for i in range(k + 1)]
        top = max(terms)
        assert p == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), abs=1e-6)


# Shards


def test_shards(docs, texts):
    found = sharding.assign(docs, sharding.Tree.even(2, 3, 4)).collect()
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == ordered(
        (d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t, *_ in texts
    )
    for shard in range(24):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 for r in found)
    by_id = {}
    assert all(by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"] for r in found)


def test_shards_follow_weights_and_confine_movement(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) k")
    even = sharding.Tree.even(2, 2, 3)
    heavier = sharding.Tree.even(2, 2, 3, {4: 3.0})
    rows = sharding.place(sharding.place(keys, keys.k, even, "a"), keys.k, heavier, "b")
    rows = sharding.place(rows, keys.k, even.grown(), "c").collect()
    expected = 20_000 / 12
    assert all(abs(n - expected) < 6 * expected**0.5 for n in Counter(r["a"] for r in rows).values())
    assert abs(Counter(r["b"] for r in rows)[4] - 3 * 20_000 / 14) < 400
    # Only the subtrees of shard 4 (region 0, rack 1) may gain.
    assert all(r["b"] // 6 == 0 for r in rows if r["a"] != r["b"] and r["a"] // 6 == 1)
    assert all(r["b"] // 3 == 1 for r in rows if r["a"] != r["b"] and r["a"] // 6 == 0)
    moved = [r for r in rows if r["a"] != r["c"]]
    assert all(r["c"] == 12 for r in moved) and abs(len(moved) - 20_000 / 13) < 250


# Tokens


def reference_encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (700, 64)])
def test_tokens(docs, texts, chunk, overlap):
    ranks, plain = reference_encoding()
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    found = [(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()]
    assert ordered(found) == ordered((d, tuple(plain.encode_ordinary(t))) for d, t, *_ in texts)
    raw = byte_bpe.decode(encoded, ranks).select("doc_id", "bytes").collect()
    assert ordered((d, bytes(b)) for d, b in raw) == ordered((d, t.encode()) for d, t, *_ in texts)


def test_both_merges_agree():
    ranks, plain = reference_encoding()
    table = byte_bpe.pair_table(ranks)
    pieces = ("a" * 200, "ththeanding" * 9, "éöñ" * 40, "z", "tt", " the", "漢字", "ATORON")
    together = byte_bpe.merge_many([p.encode() for p in pieces], ranks, table)
    for piece, ids in zip(pieces, together):
        expected = plain.encode_ordinary(piece)
        assert byte_bpe.merge_long(piece.encode(), ranks) == np.frombuffer(ids, byte_bpe.ID).tolist() == expected


def test_white_space_of_the_pattern():
    ranks, plain = reference_encoding()
    own = byte_bpe.Pieces(ranks, byte_bpe.pair_table(ranks), public_tokenizers.PATTERN)
    text = "".join(f"a{chr(c)}{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(own.encode([text])[0], byte_bpe.ID).tolist() == plain.encode_ordinary(text)


# SimHash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(words)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    nodes = sorted(set(prints))
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, texts):
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in texts]
    root = plain_components([p for _, p in prints])
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    found = simhash.digest(docs).collect()
    assert ordered(found) == ordered((d, f"{p:016x}", least.get(root[p])) for d, p in prints)


def test_links_in_large_buckets(spark):
    import random

    rng = random.Random(3)
    nodes = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(150):
            flipped = base
            for b in rng.sample(range(64), 2):
                flipped ^= 1 << b
            nodes.add(flipped)
    signed = [(n - (1 << 64) if n >> 63 else n,) for n in nodes]
    table = spark.createDataFrame(signed, "node long")
    root = plain_components(list(nodes))
    for block in (16, 2048):
        found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(table, block=block)).collect()}
        groups = {}
        for n in nodes:
            groups.setdefault(root[n], set()).add(found.get(n, n))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).selectExpr("(id * 37) % 61 as a", "((id + 1) * 37) % 61 as b")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_one_of_each_group_stays(messy):
    rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in messy.collect()]
    root = plain_components([p for _, p in rows])
    best = {}
    for d, p in rows:
        best[root[p]] = min((d is None, d or 0), best.get(root[p], (True, 0)))
    kept = simhash.keep_first(messy)
    assert kept.columns == messy.columns
    assert ordered((r["doc_id"],) for r in kept.collect()) == ordered((None if n else d,) for n, d in best.values())


# Suffixes


def plain_removal(texts, length=50):
    first = {}
    for d, t in texts:
        b, d = t.encode(), math.inf if d is None else d
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in texts:
        b, own = t.encode(), math.inf if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < own:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, texts, hot):
    from pyspark.sql import functions as F

    found = suffix_dedup.strip(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    expected = [(d, *rest) for (d, *_), (_, *rest) in zip(texts, plain_removal([x[:2] for x in texts]))]
    assert ordered(found.collect()) == ordered(expected)


def test_suffix_order_is_lexicographic():
    import numpy as np

    rows = np.random.default_rng(0).integers(97, 100, (60, suffix_dedup.SPAN)).astype(np.uint8)
    rows[5], rows[6, 10:40] = rows[4], 97
    row, offset = suffix_dedup.suffix_order(rows)
    listed = [rows[r, o:].tobytes() for r, o in zip(row, offset)]
    assert len(listed) == 60 * (suffix_dedup.REACH + 1) and listed == sorted(listed)


def test_long_texts_are_cut_without_loss(monkeypatch, given):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    texts = [(r["doc_id"], r["text"]) for r in given.limit(40).collect()]
    found = suffix_dedup.digest(given.limit(40)).collect()
    assert ordered(found) == ordered(plain_removal(texts))


# Mixing


def plain_targets(sizes, weights, budget=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = budget * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in clamped)
        left = total - sum(cap * sizes[s] for s in clamped)
        share = {s: cap * sizes[s] if s in clamped else left * weight[s] / free for s in names}
        above = {s for s in names if s not in clamped and share[s] > cap * sizes[s]}
        if not above:
            return share
        clamped |= above


def test_mixing(docs, texts):
    sized = [(d, len(WORD.findall(t)), s) for d, t, s, *_ in texts]
    sizes = Counter()
    for _, n, s in sized:
        sizes[s] += n
    target = plain_targets(sizes, (3, 1, 2))
    found = mixing.shares(docs, (3, 1, 2)).collect()
    assert ordered((r["doc_id"], r["size"], r["source"]) for r in found) == ordered(sized)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for (_, _, s), n in Counter(sized).items():  # equal rows are drawn together
        largest[s] = max(largest[s], n * max(x[1] for x in sized if x[2] == s))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert ordered(found) == ordered(mixing.shares(docs, (3, 1, 2)).collect())
    mixed = mixing.mix(docs, (3, 1, 2))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


# Personal data

def test_base_spans(docs, texts):
    found = pii.digest(docs).collect()
    expected = []
    for d, t, *_ in texts:
        spans = plain_spans(t)
        shown = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == j for _, k, _ in spans) for j in range(4)]
        expected.append((d, *counts, hashlib.sha256(shown.encode()).hexdigest()))
    assert ordered(r[:6] for r in found) == ordered(expected)


def test_disclosing_terms(spark):
    other = [f"common words are here with the filler number {chr(97 + i % 26)}x again" for i in range(60)]
    known = [f"the agent Zorblat writes common to zed@spy.example.com {w} again" for w in ("one", "two", "three", "four")]
    rows = [(i, t) for i, t in enumerate(other + known + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(clean[i] == t for i, t in rows if i < 60 or not t)
    assert all("zed@" not in clean[i] and "Zorblat" not in clean[i] and "[EMAIL]" in clean[i] for i in range(60, 64))
    assert all("common" in clean[i] and "the" in clean[i] for i in range(60, 64))


def test_disclosing_terms_everywhere(spark):
    far = "common filler of the body " * 20
    other = [f"common filler of the body {chr(97 + i % 26)}x" + " again" * i for i in range(60)]
    # One name far from the address and again beside it, one never nearer than 80 code points.
    known = [f"Zorblat Quixel {far} zorblat zed@spy.example.com émzed@spy.example.com {far}{w} ZORBLAT" for w in ("one", "two", "three", "four")]
    rows = [(i, t) for i, t in enumerate(other + known + ["a note of Zorblat alone, not Zorblatta"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(clean[i] == t for i, t in rows if i < 60)
    for i in range(60, 64):
        assert "zorblat" not in clean[i].lower() and "Quixel" not in clean[i]
        assert clean[i].count("[EMAIL]") == 2 and "é[EMAIL]" in clean[i] and clean[i].count("common filler") == 40
    # Four of the five texts with the name are the entity's: enough to generalise it.
    assert clean[64] == "a note of [TERM] alone, not Zorblatta"


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.example.com" for i in range(700))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    shown = ",".join(f"email:{s}:{e}" for s, _, e in plain_spans(text))
    assert pii.digest(docs).first()["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
    assert pii.sanitise(docs).first()["text"] == " ".join(["[EMAIL]"] * 700)


# Language-model scores


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def held(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == 2


class PlainTree:
    """Context-tree weighting as it is defined, by recursion over contexts and bits."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for t in texts:
            for context, byte in self.steps(t):
                for d in range(depth + 1):
                    for node, bit in self.decisions(byte):
                        self.counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
        self.children = {}
        for context, node in self.counts:
            if context:
                self.children.setdefault((context[1:], node), []).append(context)
        self.known = {}

    def steps(self, text):
        data = b"\0" * self.depth + text + b"\xff"
        return [(data[i : i + self.depth], data[i + self.depth]) for i in range(len(text) + 1)]

    @staticmethod
    def decisions(byte):
        return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    def kt(self, context, node):
        a, b = self.counts.get((context, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def deeper(self, context, node):
        return sum(self.weighted(c, node) for c in self.children.get((context, node), ()))

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = self.kt(context, node)
            if len(context) < self.depth:
                below = self.deeper(context, node)
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def predict(self, context, node, bit, d=0):
        here = context[self.depth - d :]
        counts = self.counts.get((here, node), (0, 0))
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == self.depth:
            return own
        share = 1 / (1 + math.exp(min(700, self.deeper(here, node) - self.kt(here, node))))
        return share * own + (1 - share) * self.predict(context, node, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.predict(c, n, b)) for c, y in self.steps(text) for n, b in self.decisions(y))


def test_context_tree(docs, texts):
    train = [lowered(t) for d, t, *_ in texts if not held(d, 7)]
    counts = Counter(w for t in train for w in (*WORD.findall(t), ""))
    n, v = sum(counts.values()), len(counts)
    mask = id_crc() % 7 == 2
    found = context_tree.score(docs, ~mask, mask, block=40_000).collect()
    assert len(found) == len(texts)
    expected = {}
    for d, t, *_ in texts:
        words = (*WORD.findall(lowered(t)), "")
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expected.setdefault(d, []).append((held(d, 7), len(words), sum(counts[w] > 0 for w in words), n, round(base, 5)))
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((*r[1:5], round(r["base_score"], 5)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in expected.items()}


def test_context_tree_scores(spark):
    words = "the cat sat on the mat and the dog saw the cat run over the hill".split()
    rows = [(i, " ".join(words[i % 9 : i % 9 + 5])) for i in range(30)] + [(None, None), (99, "Ünseen Zebra!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mask = id_crc() % 7 == 2
    tree = PlainTree([lowered(t or "").encode() for d, t in rows if not held(d, 7)], context_tree.DEPTH)
    expected = {d: tree.score(lowered(t or "").encode()) for d, t in rows}
    for r in context_tree.score(docs, ~mask, mask, block=200).collect():
        assert r["score"] == pytest.approx(expected[r["doc_id"]], rel=1e-6)


# Language


def test_language(spark, given):
    mask = id_crc() % 4 == 2
    model = language_id.train(given, ~mask)
    found = {r["doc_id"]: r for r in language_id.predict(given.select("doc_id", "text"), model).collect()}
    held_out = [(r["lang"], found[r["doc_id"]]) for r in given.collect() if held(r["doc_id"], 4)]
    assert sum(x == p["lang_pred"] for x, p in held_out) >= 0.95 * len(held_out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "The"), (5, "日本")], "doc_id long, text string")
    odd = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3))
    assert all(odd[i]["lang_pred"] in model.languages and 0 <= odd[i]["score"] <= 1 for i in (4, 5))


def test_sample_is_bounded_by_hash(spark):
    rows = [(i, f"l{i % 8}", f"words of {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} here") for i in range(1600)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = []
    # Partitions by language, the first and the last language first.
    for order in (table.lang, table.lang.desc()):
        dealt = table.repartitionByRange(8, order)
        names, drawn = language_id.sample(dealt, "lang", "text", dealt.doc_id.cast("string"), rows=80)
        assert names == [f"l{k}" for k in range(8)]
        assert Counter(x[0] for x in drawn) == {k: 20 for k in range(8)}  # two of each document
        found.append([(k, at.tolist(), n.tolist(), text) for k, at, n, text in drawn])
    assert found[0] == found[1]


def test_language_of_messy_and_empty(messy, nothing):
    mask = id_crc() % 4 == 2
    for table in (messy, nothing):
        found = language_id.predict(table, language_id.train(table, ~mask)).collect()
        assert len(found) == table.count()


def test_empty_tables(spark, nothing):
    mask = id_crc() % 7 == 2
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    for result in (
        sharding.assign(nothing, sharding.Tree.even(2, 3, 4)),
        context_tree.score(nothing, ~mask, mask),
        byte_bpe.digest(nothing, ranks, public_tokenizers.PATTERN),
        quality.judge(nothing, labels),
        simhash.digest(nothing),
        simhash.keep_first(nothing),
        suffix_dedup.digest(nothing),
        mixing.shares(nothing, (3, 1, 2)),
        mixing.mix(nothing, (3, 1, 2)),
        pii.digest(nothing),
        pii.sanitise(nothing),
    ):
        assert result.count() == 0

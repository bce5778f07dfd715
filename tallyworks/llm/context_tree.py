"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the bytes
before it. A node of a tree holds how often either bit followed its context; its
Krichevsky-Trofimov estimate is mixed with what its deeper contexts say, in proportion to
how well either coded the training bytes. A prediction so mixes the estimates of all
depths from none to four bytes.

The counts of (context, byte) are summed over the whole training text. All contexts that
share their last two bytes are weighted together, by one task of at most 256**3 entries;
the two depths above are a table of at most 256**2 nodes, which every task gets. Texts are
dealt into blocks of bounded bytes. A block names the pairs and words it needs, gets their
values by a join and scores its texts with them. No task and no broadcast holds the model,
and a frequent word or pair is asked for once for each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


from .common import blocks_of, materialise, text_of

DEPTH = 4
# Bytes of text in a block, and bytes handled at once within it.
BLOCK = 16 << 20
SLICE = 1 << 21
# Ends a text; no UTF-8 text holds it.
END = b"\xff"
PAD = b"\x00" * DEPTH


def lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) as one number for every byte of the texts, and where each text starts."""
    joined = np.frombuffer(b"".join(PAD + t + END for t in texts), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    real = np.ones(len(joined), dtype=bool)
    for k in range(DEPTH):
        real[starts + k] = False
    number = np.zeros(len(joined) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        number = number << 8 | joined[k : k + len(number)]
    return number[real[DEPTH:]], np.cumsum(lengths) - lengths


def slices(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def pair_counts(texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(texts):
        codes, found = pd.factorize(pairs_of(part)[0])
        keys.append(found)
        sums.append(np.bincount(codes, minlength=len(found)))
    codes, found = pd.factorize(np.concatenate(keys))
    return found, np.bincount(codes, weights=np.concatenate(sums), minlength=len(found)).astype(np.int64)


NEEDS = "block int, pair long, word binary, n long"
NEEDS_ARROW = pa.schema([("block", pa.int32()), ("pair", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def needs(table: pa.Table) -> pa.Table:
    """What a block asks for: its distinct pairs and words, with their counts in training texts."""
    block = table.column("block")[0].as_py()
    train = table.column("train").to_pylist()
    column = table.column("text")
    words: Counter = Counter()
    for i, used in enumerate(train):
        tokens = lower(column[i].as_py()).split()
        if used:
            words.update(tokens)
            words[b""] += 1
        else:
            for t in tokens:
                words[t] += 0
            words[b""] += 0
    learned, n = pair_counts(lower(column[i].as_py()) for i, used in enumerate(train) if used)
    asked, _ = pair_counts(lower(column[i].as_py()) for i, used in enumerate(train) if not used)
    only = np.setdiff1d(asked, learned, assume_unique=True)
    total = len(words) + len(learned) + len(only)
    return pa.Table.from_arrays(
        [
            pa.array(np.full(total, block, dtype=np.int32)),
            pa.array([*([None] * len(words)), *learned.tolist(), *only.tolist()], pa.int64()),
            pa.array([*words, *([None] * (total - len(words)))], pa.binary()),
            pa.array([*words.values(), *n.tolist(), *([0] * len(only))], pa.int64()),
        ],
        schema=NEEDS_ARROW,
    )


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the eight decisions: its node in the byte's binary tree, and the bit."""
    node = np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)])
    return node, np.stack([(byte >> (7 - k)) & 1 for k in range(8)])


def weigh(pair: np.ndarray, n: np.ndarray):
    """Depths 4 to 2 for pairs that share the last two context bytes.

    Returns per decision the node, the bit and the prediction at depth 2, and the nodes at
    depth 2 with their counts and log weighted probability.
    """
    context, (node, bit) = pair >> 8, bits(pair & 255)
    repeated = np.tile(n, 8).astype(np.float64)
    flat = bit.ravel()
    below = first_below = prediction = None
    for depth in range(DEPTH, 1, -1):
        key = ((context & ((1 << 8 * depth) - 1)) << 8 | node).ravel()
        found, first, at = np.unique(key, return_index=True, return_inverse=True)
        one = np.bincount(at, weights=repeated * flat, minlength=len(found))
        zero = np.bincount(at, weights=repeated * (1 - flat), minlength=len(found))
        own = log_kt(zero, one)
        here = (np.where(flat, one[at], zero[at]) + 0.5) / (zero + one + 1)[at]
        if below is None:
            weighted, prediction = own, here
        else:
            children = np.bincount(at[first_below], weights=below, minlength=len(found))
            share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))[at]
            prediction = share * here + (1 - share) * prediction
            weighted = np.logaddexp(own, children) - math.log(2)
        below, first_below = weighted, first
    return node, bit, prediction.reshape(8, -1), (found & 255, zero, one, below)


def last_two() -> Column:
    """The last two context bytes of a pair."""
    return F.shiftright("pair", 8).bitwiseAND(F.lit(0xFFFF))


def top_rows(table: pa.Table) -> pa.Table:
    pair = table.column("pair").to_numpy()
    _, _, _, (node, zero, one, weighted) = weigh(pair, table.column("n").to_numpy())
    last = np.full(len(node), (pair[0] >> 8) & 255)
    return pa.Table.from_arrays(
        [pa.array(last.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(zero), pa.array(one), pa.array(weighted)],
        names=["last", "node", "zero", "one", "below"],
    )


def top_model(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and estimates of a one-bit at depths 1 and 0, by last byte and node."""
    zero, one, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zero[r["last"], r["node"]], one[r["last"], r["node"]], below[r["last"], r["node"]] = r["zero"], r["one"], r["below"]

    def depth(zero: np.ndarray, one: np.ndarray, below: np.ndarray):
        own = log_kt(zero, one)
        share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        return share, (one + 0.5) / (zero + one + 1), np.logaddexp(own, below) - math.log(2)

    share1, one1, weighted = depth(zero, one, below)
    share0, one0, _ = depth(zero.sum(axis=0), one.sum(axis=0), weighted.sum(axis=0))
    return share1, one1, share0, one0


def price_pairs(top):
    share1, one1, share0, one0 = top

    def run(table: pa.Table) -> pa.Table:
        pair = table.column("pair").to_numpy()
        node, bit, deep, _ = weigh(pair, table.column("n").to_numpy())
        last = (pair[0] >> 8) & 255
        first = np.where(bit, one1[last][node], 1 - one1[last][node])
        mixed = share1[last][node] * first + (1 - share1[last][node]) * deep
        none = np.where(bit, one0[node], 1 - one0[node])
        mixed = share0[node] * none + (1 - share0[node]) * mixed
        return pa.Table.from_arrays([pa.array(pair), pa.array(np.log10(mixed).sum(axis=0))], names=["pair", "price"])

    return run


def score_block(n: int, v: int):
    base = math.log10(n + v + 1)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        word, price, count, pair = (values.column(c) for c in ("word", "price", "count", "pair"))
        is_word = word.is_valid().to_numpy()
        known = {
            w: math.log10(c + 1)
            for w, c in zip(word.filter(pa.array(is_word)).to_pylist(), count.filter(pa.array(is_word)).to_pylist())
        }
        keys = pd.Index(pair.filter(pa.array(~is_word)).to_numpy())
        cost = price.filter(pa.array(~is_word)).to_numpy()
        column = docs.column("text")
        tokens, hits, bases, scores, sizes = [], [], [], [], []
        for part in slices(lower(column[i].as_py()) for i in range(len(column))):
            for t in part:
                got = [known[w] for w in (*t.split(), b"") if w in known]
                tokens.append(t.split().__len__() + 1)
                hits.append(len(got))
                bases.append(math.fsum(got) - tokens[-1] * base)
                sizes.append(len(t))
            number, starts = pairs_of(part)
            scores.extend(np.add.reduceat(cost[keys.get_indexer(number)], starts).tolist())
        rate = [-s * math.log2(10) / max(1, b) for s, b in zip(scores, sizes)]
        return pa.Table.from_arrays(
            [
                docs.column("doc_id"), docs.column("held_out"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()),
                pa.array([n] * len(tokens), pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()),
                pa.array(rate, pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return run


def score(docs: DataFrame, train: Column, held_out: Column, block: int = BLOCK) -> DataFrame:
    """Scores of all texts by a model of those where ``train`` holds.

    Reads doc_id and text. A to Z are read as lower case; a null text counts as empty and
    costs its end alone. ``score`` is the log10 probability of the bytes and the end,
    ``base_score`` that of the words by their add-one frequencies, ``bits_per_byte`` the code length.
    Every row is scored, repeated ones alike. Without training texts the model is uniform.
    An empty table gives an empty table.
    """
    size = F.octet_length(text_of()) + F.lit(1)
    blocks = blocks_of(docs, size, block)
    rows = docs.select(
        "doc_id", held_out.alias("held_out"), F.coalesce(train, F.lit(False)).alias("train"), "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    asked = materialise(rows.select("block", "train", "text").groupBy("block").applyInArrow(needs, NEEDS))
    words = asked.filter("word is not null")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("count")).filter("count > 0"))
    n, v = counts.agg(F.sum("count"), F.count("*")).first()
    pairs = asked.filter("pair is not null")
    model = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("n"))).withColumn("_two", last_two())
    nodes = model.groupBy("_two").applyInArrow(top_rows, "last int, node int, zero double, one double, below double")
    sums = nodes.groupBy("last", "node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("below").alias("below"))
    top = top_model(sums.collect())  # at most 256 * 255 rows
    prices = model.groupBy("_two").applyInArrow(price_pairs(top), "pair long, price double")
    nothing = {"word": "binary", "count": "long", "pair": "long", "price": "double"}

    def values(df: DataFrame, *own: str) -> DataFrame:
        return df.select("block", *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

    found = values(words.select("block", "word").join(counts, "word"), "word", "count")
    found = found.unionByName(values(pairs.select("block", "pair").join(prices, "pair"), "pair", "price"))
    return rows.drop("train").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        score_block(int(n or 0), int(v or 0)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "bits_per_byte double",
    )

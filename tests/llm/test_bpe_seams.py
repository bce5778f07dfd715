"""Chunks of long texts where the pattern looks ahead across a seam."""

import random

import public_tokenizers
import pytest
import tiktoken

from tallyworks.llm import byte_bpe


@pytest.mark.parametrize("seed", range(3))
def test_white_space_at_seams(spark, seed):
    # Ranks that hold runs of white space, unlike the public ones.
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"  ", b"\n\n", b" \n", b"\n\n\n", b"\t\t", b"   ", b" \n\n", b"\n\t", b"ab", b" a"):
        ranks[token] = len(ranks)
    whole = tiktoken.Encoding("spaces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(seed)
    gaps = ["\n\n", "  \n", " \n\n ", "\t\t", "\n\t", "   ", " ", "\n\n\n", " \t\n"]
    texts = ["".join(draw.choice(["ab", "a", "bab", "b a"]) + draw.choice(gaps) for _ in range(draw.randrange(200, 1500))) for _ in range(25)]
    texts += ["\n" * 900 + "a", " \n" * 600 + " ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=300, overlap=64)
    found = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, text in enumerate(texts):
        assert found[i] == whole.encode_ordinary(text), i

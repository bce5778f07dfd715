import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, SHARD int, _h int"
LONG = "wörd alpha beta gamma delta " * 4000 + "a" * 3000 + " " * 2000 + "7" * 2500


@pytest.fixture(autouse=True)
def small_bitmaps(monkeypatch):
    """So few bits that false hits are common: results must not depend on them."""
    from tallyworks.llm import common

    monkeypatch.setattr(common, "SLOTS", 1 << 12)


@pytest.fixture(scope="session")
def given(spark):
    """The given documents."""
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    passage = "this very passage of many words is shared between several documents without any change at all"
    rows = [
        (1, None, None, None, 0, "x", 1, 1),
        (2, "", "en", "a", 0, "x", 1, 1),
        (3, " \t\n", "en", "a", 3, "x", 1, 1),
        (4, LONG, "en", "b", 0, "x", 1, 1),
        (4, LONG, "en", "b", 0, "x", 1, 1),
        (5, f"start five {passage} end five", "en", "b", 0, "x", 1, 1),
        (6, f"six begins {passage} and six ends", "en", None, 0, "x", 1, 1),
        (6, f"another six {passage}", "de", None, 0, "x", 1, 1),
        (None, f"no id {passage}", "de", "c", 0, "x", 1, 1),
        (None, None, "de", "c", 0, "x", 1, 1),
        (7, f"six begins {passage} and six ends", None, "c", 0, "x", 1, 1),
        (-8, "Grüße 日本語 mail a.b@c.example.org, a@b@c.de. 10.0.0.256 10.0.0.255 4111 1111 1111 1111 +49 (30) 123-4567", "de", "é", 0, "x", 1, 1),
        (9, "x@y.z_d@e.f.g 1.2.3.4.5.6.7.8 4111-1111-1111-1112 +1 22 " + "ab " * 30 + "\nline\nline\n\nline two", "en", "é", 0, "x", 1, 1),
        (10, "0\x000 it's we'll 'S  two  spaces em\x1c\x85 end \U0001f600", "en", "z", 0, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

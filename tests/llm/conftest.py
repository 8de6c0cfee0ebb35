import random

import pytest

WORDS = "the of and river stone light under harbour walks slowly when morning comes over quiet hills with seven boats near old bridge".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, hash string, score double, row string, fp long, label string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.8 else str(r.randint(0, 99))) for _ in range(n))


def rows():
    """Documents with nulls in every column, empty, blank, one-word and very long texts, ties, repeated rows and repeated ids."""
    out = [(k, prose(k, 30 + k % 17), ("en", "fr", "de")[k % 3], f"src{k % 4}", 10 * k) for k in range(40)]
    out += [(100, None, "en", "src0", 0), (101, "", "en", "src1", 0), (102, " \n\t ", None, "src1", None), (103, "word", "en", None, 4), (None, "text without an id " + prose(7, 20), None, None, None)]
    out += [(104, prose(900, 30_000), "en", "src2", 1), (105, "one\ntwo three\n" + prose(3, 33), "en", "src0", 5), (106, "x" * 50_000, "en", "src0", 5)]
    out += [(k, prose(5, 35), "en", "src3", 1) for k in (110, 111, 112)]  # equal texts
    out += [(120, prose(77, 25), "en", "src0", 9)] * 3  # repeated rows
    out += [(121, prose(78, 25), "en", "src0", 9), (121, prose(79, 25), "fr", "src1", 9)]  # a repeated id
    out += [(130, "ÄÉ ñandú 中文 \U0001f600 naïve" + " é" * 12, "es", "src0", 3), (131, None, None, None, None), (None, None, None, None, None)]
    return [(*r, 7, 3, "h", 0.5, "r", 1, "l") for r in out]


@pytest.fixture(scope="session")
def messy(spark):
    """The documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

import base64 as base64lib
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, row string, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use themselves."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    rows = [
        (1, None, None, None, None), (2, "", "en", "src0", 0), (3, "   \t\n", "en", "src0", 5), (4, "!!! 123", "en", "src1", 7), (5, "one", "en", "src1", 3), (6, "The quick brown fox jumps over the lazy dog again and again today.", "en", "src0", 66),
        (6, "The quick brown fox jumps over the lazy dog again and again today.", "en", "src0", 66), (7, "THE quick brown  fox jumps over the lazy dog again and again today.", "en", "src2", 66), (8, long, "la", "src0", len(long)), (9, long + "x", "la", None, len(long) + 1), (None, "no id here at all", "en", "src1", 17),
        (10, "Ünïcödé 日本語 \U0001f600 text <|endoftext|> end", "de", "src3", 40), (11, "one", "en", "src1", 3),
    ]
    return spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def long_texts():
    """Texts of a megabyte each, of kinds that patterns and piece tables may choke on."""
    rng, n = random.Random(5), 1 << 20
    base64 = base64lib.b64encode(rng.randbytes(3 * n // 4)).decode()
    return ["a" * n, "a." * (n // 2), "_" * n, base64, "x@" + "a." * (n // 2) + "com", "4" * n, "4111 " * (n // 5), "é" * (n // 2), "AB12 " * (n // 5)]


@pytest.fixture(scope="session")
def long(spark, long_texts):
    """The same as documents."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(long_texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)

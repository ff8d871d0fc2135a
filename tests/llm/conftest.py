import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("kept", "size", "score", "piece", "component_id", "base", "spans", "n_lines", "length", "__hash", "__key", "toxic", "tokens", "target", "copies", "extra", "__n", "__copies", "__instances", "removed", "n_words", "__t", "__id", "idx", "hash")],
])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) + ("\n" if r.random() < 0.08 else "") for _ in range(n))


def rows() -> list[tuple]:
    base = [(i, prose(i, 40 + i), "en", f"s{i % 3}", 1) for i in range(24)]
    near = base[3][1].split(" ")
    near[5] = "changed"
    base += [(100, base[3][1], "en", "s0", 1), (101, " ".join(near), None, "s1", None), (102, base[3][1].upper(), "en", None, 1)]
    base += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \n\t ", "en", "s1", 3), (None, prose(77, 30), "en", "s2", 1), (203, "one", "en", "s2", 3), (204, "a b", "en", "s2", 3)]
    base += [(300, prose(5, 30_000), "en", "s0", 1), (301, "x" * 300_000, "en", "s1", 1), (302, "\n".join(["same line here"] * 500), "en", "s2", 1)]
    base += [base[7], base[7]]
    return [(*b, *["clash"] * 25) for b in base]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, and clashing columns."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def void(spark):
    return spark.createDataFrame([], SCHEMA)

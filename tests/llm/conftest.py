"""Documents and vectors with every awkward case, next to columns of clashing names."""

import numpy as np
import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Names that the operators use for columns of their own.
CLASH = ("size", "bin", "h", "gid", "shard", "rep", "n", "label", "list", "query", "code", "kept", "bucket", "language", "pii", "line_dedup", "component", "repeats", "hashes", "row")


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n).tolist())


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text, lang, source): nulls, empties, blanks, ties, repeats, a long text, near copies."""
    rng = np.random.default_rng(4)
    base = prose(rng, 80)
    rows = [(i, prose(rng, int(rng.integers(1, 60))), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, "   \n\t ", "en", None), (103, "12 34 !!", "en", "s2"), (104, "é", None, "s3"), (105, "a\n\nb\n", "en", "s0")]
    rows += [(200 + i, base, "en", "s0") for i in range(5)] + [(300 + i, base + f" tail{i}", "en", "s1") for i in range(5)]
    rows += [(400, "same row", "en", "s1")] * 2 + [(None, "no id here", "en", "s2"), (401, prose(rng, 30_000), "en", "s3"), (402, "word" * 20_000, "en", "s3")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    rows = [(*r, None if r[1] is None else len(r[1]), *range(len(CLASH))) for r in awkward_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def vectors(spark):
    """Random vectors, near and exact copies, a scaled copy, null, zero, short, non-finite ones and null labels."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(150)]
    seed = np.array(rows[5][1])
    rows += [(200 + i, (seed + rng.normal(0, 0.05, 8)).tolist(), 5 % 3) for i in range(12)]
    rows += [(300, rows[7][1], 7 % 3), (301, [2 * x for x in rows[7][1]], 7 % 3), (302, rows[7][1], 2 if 7 % 3 != 2 else 0), (303, rows[7][1], None)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [float("nan")] * 8, 1), (404, [None] + [1.0] * 7, 1), (405, [float("inf")] + [1.0] * 7, 1), (406, [1.0, 2.0, 3.0], 1), (407, [1.0, 2.0, 3.1], 1), (None, rows[7][1], 1)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as code", "3 as list", "4 as copies", "5 as dims").repartition(3)

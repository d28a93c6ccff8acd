"""Fixtures of the training-data operators: a small awkward table of documents."""

from __future__ import annotations

import pytest

LONG = "The quick brown fox jumps over the lazy dog and runs to the river. " * 3000
#: doc_id and text: nulls, empty, blank, unusual characters, copies, near copies, a very long text, a repeated row.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   "),
    (4, "?!"),
    (5, "é🙂 日本語 \U0010ffff a\u0000b"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen sixteen"),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (9, LONG),
    (9, LONG),
    (10, "x"),
    (None, "no id"),
    (12, "a  b"),
]

#: Names that operators give to columns of their own, in any case, and one that needs quotes.
CLASHES = "_digest _LOST_DIGEST _lost_id _words _lost _id _Source _size _repeats _copy _key _node _lost_key _lost_node _stays id copies links class_id first a.b".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Extra columns bear names that the operators use inside."""
    rows = [(i, t, "en", "s" if i and i % 2 else None, 7, "clash", 1.0, *["clash"] * len(CLASHES)) for i, t in AWKWARD]
    extra = "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, node int, digest string, score double{extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

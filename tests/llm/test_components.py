import random

from quern.llm.common import Scratch
from quern.llm.components import connected_components


def test_as_union_find(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(600, 601 + i) for i in range(50)] + [(7, 7), (None, 3), (900, 900)]
    up = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((up[a], up[b]))
            up = {k: lo if v == hi else v for k, v in up.items()}
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = dict(tuple(x) for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert got == {k: up[k] for k in linked}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []

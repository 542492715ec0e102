import random

import pytest

from tidelog.llm import components as module


def brute_force(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


rnd = random.Random(8)
SHAPES = {
    "chain up": [(i, i + 1) for i in range(200)],
    "chain mixed": (lambda p: list(zip(p, p[1:])))(rnd.sample(range(-200, 200), 300)),
    "star": [(500, i) for i in range(300)] + [(-5, 500)],
    "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)],
    "loops only": [(1, 1), (2, 2)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, monkeypatch, shape):
    edges = [(a, b) for a, b in SHAPES[shape] if a != b]
    written = []
    whole = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name, paths=None: written.append(name) or whole(df, name, paths))
    got = module.components(spark.createDataFrame(SHAPES[shape], "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == brute_force(edges)
    assert written.count("edges") <= 8 and written.count("pointers") <= 30

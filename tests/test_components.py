from hypothesis import given, settings, strategies as st

from corpusmill.operators.components import connected_components

EDGES = "a bigint, b bigint"


def reference(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_random_graphs(spark, edges):
    got = connected_components(spark.createDataFrame(edges, EDGES))
    assert {r.node: r.component for r in got.collect()} == reference(edges)


def test_shapes(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 3000)]
    edges = [*chain, *star, (None, 1), (5, 5), (0, 1)]
    got = connected_components(spark.createDataFrame(edges, EDGES))
    assert {r.node: r.component for r in got.collect()} == reference(edges)
    assert connected_components(spark.createDataFrame([], EDGES)).count() == 0

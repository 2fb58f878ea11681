"""Graph queries against brute force over all relations of the smallest tables."""

from collections import defaultdict

import pytest

from knowlark.plans import catalog as c
from knowlark.plans import graph_queries as q
from tests.conftest import SF


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(r["relation_id"], r["source_id"], r["target_id"]) for r in c.relations(spark, SF).collect()]
    near = defaultdict(set)
    for _, a, b in rows:
        near[a].add(b)
        near[b].add(a)
    return rows, near


def depths(near, seeds, hops):
    found = dict.fromkeys(seeds, 0)
    for hop in range(1, hops + 1):
        for node in [n for n, d in found.items() if d == hop - 1]:
            for other in near[node]:
                found.setdefault(other, hop)
    return found


def test_graph_bfs_whole(spark, edges):
    got = [tuple(r) for r in q.graph_bfs(spark, SF).collect()]
    assert sorted(got) == sorted(depths(edges[1], [c.SUPPLIER + 1, c.SUPPLIER + 2], 2).items())


def test_graph_view_whole(spark, edges):
    known = {r["entity_id"] for r in c.entities(spark, SF).collect()}
    near = depths(edges[1], [c.SUPPLIER + k for k in range(1, 9)], 1).keys() & known
    got = [tuple(r) for r in q.graph_view(spark, SF).collect()]
    assert sorted(got) == sorted(r for r in edges[0] if r[1] in near and r[2] in near)


def test_graph_retrieve_whole(spark, edges):
    chunks = defaultdict(set)
    for r in c.entity_chunk(spark, SF).collect():
        chunks[r["entity_id"]].add(r["chunk_id"])
    want, matched = [], defaultdict(dict)
    for r in q._matched(spark, SF).collect():
        matched[r["query_id"]][r["entity_id"]] = r["score"]
    for query, own in matched.items():
        scores = {k: 0.5 for node in depths(edges[1], own, 2) for k in chunks[node]}
        best = defaultdict(float)
        for node, x in own.items():
            for k in chunks[node]:
                best[k] = max(best[k], x)
        top = sorted((scores | best).items(), key=lambda i: (-i[1], i[0]))[:15]
        want += [(query, k, x, n) for n, (k, x) in enumerate(top, 1)]
    assert sorted(tuple(r) for r in q.graph_retrieve(spark, SF).collect()) == sorted(want)

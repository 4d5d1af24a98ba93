"""Ties of near copies: once for a node, not once for each key that it shares, and computed once."""

import numpy as np

from zetasky.llm import jaccard


def test_ties_do_not_repeat_under_every_shared_key(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 400)
    seen, real = [], jaccard.connected_components

    def watched(edges):
        seen.append((edges.count(), "MapInArrow" in edges._jdf.queryExecution().toString()))
        return real(edges)

    monkeypatch.setattr(jaccard, "connected_components", watched)
    base = [f"w{i}" for i in range(600)]
    rows = [(c * 100 + i, " ".join(f"{c}{'x' * (j == 12 * i)}{w}" for j, w in enumerate(base))) for c in range(6) for i in range(6)]
    classes = {r.doc_id: r.component_id for r in jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert classes == {d: d // 100 * 100 for d, _ in rows}
    joined = 6 * 5  # edges that hold the six classes together
    tasks = 4
    assert not any(computed for _, computed in seen)
    assert seen[0][0] <= tasks * joined and seen[1][0] <= 2 * len(rows)


def test_forests_join_the_same_nodes():
    rng = np.random.default_rng(6)
    ties = [rng.integers(0, 60, (200, 2)) // 6 * 6 + rng.integers(0, 6, (200, 1)) for _ in range(5)]
    every = np.concatenate(ties)
    nodes, labels = jaccard.labelled(every.T)
    forest = np.concatenate(list(jaccard.forests(iter(ties))))
    assert len(forest) == len(nodes) - len(set(labels.tolist()))
    assert [x.tolist() for x in jaccard.labelled(np.concatenate([forest, np.stack([nodes, nodes], axis=1)]).T)] == [nodes.tolist(), labels.tolist()]

"""Connected components that do not settle are an error."""

import pytest

from zetasky.llm import components


def test_unfinished_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    monkeypatch.setattr(components, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="2 rounds"):
        components.connected_components(path)
    monkeypatch.setattr(components, "MOST_ROUNDS", 64)
    assert {r.label for r in components.connected_components(path).collect()} == {0}

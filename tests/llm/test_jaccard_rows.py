"""Rows with a null or repeated id in the Jaccard join and in the pipeline's choice."""

from zetasky.llm import jaccard


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


WORDS = [f"w{i}" for i in range(104)]


def text(*changed):
    return " ".join("x" + w if i in changed else w for i, w in enumerate(WORDS))


def test_links_through_a_row_without_an_id(spark):
    near = [(1, text()), (None, text(10)), (2, text(10, 90)), (None, text(10, 50)), (3, "others say little")]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(101)} for _, t in near[:3]]
    assert 100 * len(sets[0] & sets[2]) < 90 * len(sets[0] | sets[2]) and 100 * len(sets[0] & sets[1]) >= 90 * len(sets[0] | sets[1])
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.similar_classes(frame(spark, near), 4, 90).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 3)]


def test_rows_stay_or_go_with_their_own_class(spark):
    other = text(*range(104))
    lone = " ".join(f"z{i}" for i in range(60))
    rows = [(1, text()), (5, text(10)), (5, other), (7, other), (7, other + " end"), (8, lone), (8, lone + " end"), (None, lone), (None, text(10))]
    rows += [(None, "only here twice " * 3), (None, "only here twice " * 3), (None, None), (None, ""), (9, None), (9, None), (9, lone + " end")]
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(frame(spark, rows)).collect()), key=str)
    eights = [g for g in got if g[0] == 8]
    assert len(eights) == 1 and eights[0][1].startswith(lone)
    assert [g for g in got if g[0] != 8] == sorted([(1, text()), (5, other), (None, "only here twice " * 3), (None, None), (None, ""), (9, None)], key=str)

"""Components after more links."""
from waymesh.llm import neardup


def test_more_links_join_components(spark):
    """pipeline, op4: further links sent all earlier ones through the rounds again; now only the components that they join."""
    links = spark.createDataFrame([(1, 5), (5, 9), (20, 21), (30, 31)], "a long, b long")
    labels = neardup._labels(links)
    none = neardup.saved(links.limit(0), "links")
    assert neardup._joined(labels, none) is labels
    more = neardup.saved(spark.createDataFrame([(9, 20), (40, 41), (31, 2), (1, 9)], "a long, b long"), "links")
    got = {tuple(r) for r in neardup._joined(labels, more).collect()}
    assert got == {(n, 1) for n in (1, 5, 9, 20, 21)} | {(n, 2) for n in (2, 30, 31)} | {(40, 40), (41, 40)}

"""Keys that hold half of all rows: links of one node, copies of one fingerprint."""

from __future__ import annotations

import random

from signalframe.llm.components import components
from signalframe.llm.simhash import near_duplicates


def test_stars_chains_and_bridges(spark):
    rng = random.Random(3)
    star = [(10_000, leaf) for leaf in range(10_001, 20_000)]
    chain = [(i, i + 1) for i in range(100, 160)]
    bridge = [(19_999, 130), (130, 19_999), (5, 5), (3, 19_500)]
    other = [(-1, i) for i in range(30_000, 31_000)]
    links = star + chain + bridge + other
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) == 10_000 + 61 + 1 + 1001
    assert {roots[n] for n in [3, *range(100, 161), *range(10_000, 20_000)]} == {3}
    assert {roots[n] for n in [-1, *range(30_000, 31_000)]} == {-1}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_half_of_all_documents_are_copies(spark):
    rows = [(i, "the same few words again" if i % 2 else f"w{i} x{i * 7} y{i * 13} z{i * 17} a{i} b{i}") for i in range(1, 2001)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 2000 and {found[i] for i in range(1, 2001, 2)} == {1}

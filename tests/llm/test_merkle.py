"""Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from signalframe.llm import merkle
from signalframe.llm.merkle import manifest, op12_merkle_manifest, proof_digest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """Root, and each leaf's siblings level by level."""
    paths = [[] for _ in leaves]
    level, span = list(leaves), 1
    while len(level) > 1:
        for i, path in enumerate(paths):
            own = i // span
            run = own // fanout * fanout
            path.append(("".join(level[run:own]), "".join(level[own + 1 : run + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        span *= fanout
    return level[0], paths


def expected(rows, fanout, changed=lambda row: row):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *tree([leaf_of(r) for r in own], fanout))
    root, above = tree([trees[s][1] for s in order], fanout)
    out = []
    for s, top in zip(order, above, strict=True):
        own, subroot, paths = trees[s]
        for row, path in zip(own, paths, strict=True):
            at = leaf_of(changed(row))
            for left, right in path + top:
                at = h(left, at, right)
            out.append((row[0], leaf_of(row), subroot, root, h(*(x for p in path + top for x in p)), at, at == root))
    return sorted(out, key=repr)


def lowered(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])) if hit else row


def found(df, fanout=merkle.FANOUT):
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    made = manifest(df, changes={"text": merkle.lower_ascii(F.col("text"))}, changed_where=tampered, fanout=fanout)
    made = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified")
    return sorted((tuple(r) for r in made.collect()), key=repr)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("fanout", [3])
def test_odd_rows(odd, fanout):
    df = odd.withColumns({c: F.lit(1) for c in ("tree", "lo", "hi", "digest", "leaf", "changed", "children", "path", "lone")})
    assert found(df, fanout) == expected(plain(odd), fanout, lowered)


@pytest.mark.parametrize("parts", ["1", "11"])
def test_trees_of_all_sizes(spark, parts):
    """Trees of 1 to 40 leaves, and one with half of all rows; more sources than one run holds; runs of a single node."""
    df = spark.range(820).selectExpr("id as doc_id", "int(sqrt(2 * id)) as k").selectExpr(
        "doc_id", "nullif('s' || k, 's7') as source", "if(k % 2 = 0, null, 'en') as lang", "int(k) as n_chars", "'Text ' || k as text"
    )
    df = df.unionByName(spark.range(1000, 1900).selectExpr("id as doc_id", "'hot' as source", "'en' as lang", "1 as n_chars", "'ÄB' as text"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(df) == expected(plain(df), merkle.FANOUT, lowered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_row_and_none(spark, none):
    one = spark.createDataFrame([(5, None, None, None, None)], none.select("doc_id", "source", "lang", "n_chars", "text").schema)
    leaf = leaf_of((5, None, None, None, None))
    assert found(one) == [(5, leaf, leaf, leaf, h(), leaf, True)]
    assert manifest(none).collect() == []


def test_changes_are_noticed(spark):
    """A row is verified unless its text has upper case and was tampered with."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_merkle_manifest(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        text = texts[r.doc_id] or ""
        assert r.verified == (not hit or not any("A" <= c <= "Z" for c in text))
    assert {r.verified for r in rows} == {True, False}

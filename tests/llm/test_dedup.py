"""Exact dedup, SimHash, substring dedup and mixing against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from signalframe.llm import simhash, substring_dedup
from signalframe.llm.components import components
from signalframe.llm.exact_dedup import exact_dedup, exact_duplicates
from signalframe.llm.mixing import mix, mix_plan, source_targets
from signalframe.llm.simhash import near_duplicates, op2_simhash_dedup, simhash_dedup
from signalframe.llm.substring_dedup import dedup_substrings, op7_substring_dedup

SF = "/root/testdata/sf0.001"


def last(i):
    return (i is None, i or 0)


def documents(spark, folder=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_exact(odd, plain_odd):
    groups = defaultdict(list)
    for i, t, *_ in plain_odd:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    rows = exact_duplicates(odd).collect()
    assert len(rows) == len(plain_odd)
    expected = sorted((last(i), last(min(g, key=last)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((last(r.doc_id), last(r.keep_id), r.group_size, r.text_sha256) for r in rows) == expected
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("parts", ["1", "2", "7", "40"])
def test_exact_group_over_many_ranges(spark, parts):
    """One text in most rows: its run goes on over several ranges."""
    df = spark.range(400).selectExpr("id as doc_id", "if(id % 10 = 0, cast(id as string), 'same') as text")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = exact_duplicates(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 10} == {(1, 360)}
    assert sorted(r.doc_id for r in rows if r.kept) == sorted([1, *range(0, 400, 10)])


def test_exact_keeps_rows_and_columns(odd):
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(last(r.doc_id) for r in kept.collect()) == sorted(last(r.doc_id) for r in exact_duplicates(odd).filter("kept").collect())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    top = {i: i for i in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_simhash_query(spark):
    prints = {i: brute_fingerprint(t) for i, t in documents(spark)}
    roots = brute_components(prints)
    rows = op2_simhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_simhash_edge_cases(odd, plain_odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(plain_odd)
    assert sorted((last(r.doc_id), r.fingerprint) for r in rows) == sorted((last(i), f"{brute_fingerprint(t):016x}") for i, t, *_ in plain_odd)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {4}
    kept = simhash_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in rows})


def test_simhash_links_and_chains(spark):
    """Random fingerprints, dense balls and long chains: the same components as by comparing all pairs."""
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)}
    center = rng.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    chain = rng.getrandbits(64)
    for i in range(0, 64, 2):
        chain ^= 3 << i
        prints.add(chain)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "f long"))
    found = {r.node: r.root for r in components(links).collect()}
    expected = brute_components({s: p for s, p in zip(signed, prints, strict=True)})
    assert {p: found.get(p, p) for p in signed} == expected


def test_large_buckets_are_cut_exactly():
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 16, 3000, dtype=np.uint64))
    pivots = simhash.distances(prints)
    found = {tuple(sorted(p)) for a, b in simhash.linked(prints, pivots, np.arange(len(prints)), 2) for p in zip(a.tolist(), b.tolist(), strict=True)}
    every = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    assert found == {(a, b) for a, b in zip(*np.nonzero(every), strict=True) if a < b}


def brute_substrings(rows, window=13):
    first = {}
    words = [((t or "").encode().split(), last(i)) for i, t in rows]
    for w, i in words:
        for n in range(len(w) - window + 1):
            key = tuple(w[n : n + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for w, i in words:
        gone = {m for n in range(len(w) - window + 1) if first[tuple(w[n : n + window])] < i for m in range(n, n + window)}
        kept = b" ".join(x for m, x in enumerate(w) if m not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("buckets", [None, 1])
def test_substrings(spark, odd, plain_odd, buckets, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 5000 if buckets else substring_dedup.CHUNK)
    rows = dedup_substrings(odd, outputs=("n_words", "n_removed", "kept_sha256")).collect()
    assert sorted((last(r.doc_id), *tuple(r)[1:]) for r in rows) == brute_substrings([r[:2] for r in plain_odd])


def test_substring_query(spark):
    rows = op7_substring_dedup(spark, SF).collect()
    assert sorted((last(r.doc_id), *tuple(r)[1:]) for r in rows) == brute_substrings(documents(spark))


def test_word_hashes_do_not_depend_on_place():
    rng = random.Random(4)
    words = [bytes(rng.choices(range(97, 123), k=rng.choice([1, 3, 9, 5000]))) for _ in range(60)]
    joined = b" ".join(words * 3 + [b"z" * 1_200_000] + words)
    hashes = substring_dedup.word_hashes(*substring_dedup.words_of(joined))
    by_word = defaultdict(set)
    for w, h in zip(joined.split(), hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({h for s in by_word.values() for h in s}) == len(by_word)


def test_different_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that makes all windows collide, the comparison of words still gives exact counts."""
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: x * np.uint64(0))
    texts = [b"a b c d e", b"b c d e f", b"x y z q r", b"c d e x y"]
    blocks = [b for _, b in substring_dedup.pack_chunk([1, 2, 3, 4], [0, 0, 0, 0], texts, 3, 1)]
    ids, _, begin, end = substring_dedup.repeated_spans(blocks, 3)
    assert sorted(zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True)) == [(2, 0, 4), (4, 0, 3)]


def test_targets(spark):
    """Water level by hand: weights 5, 2, 1 over 100, 1000, 10."""
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10)], "source string, size long")
    found = {r.source: r.target for r in source_targets(sizes).collect()}
    assert found == {"a": 300.0, "b": 780.0, None: 30.0} and sum(found.values()) == 1110


def test_mix(odd, plain_odd):
    rows = mix_plan(odd).collect()
    assert len(rows) == len(plain_odd) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sum(r["size"] for r in rows) == pytest.approx(sum({r.source: r.target for r in rows}.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mix_plan(odd.repartition(5)).collect()))
    taken = mix(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in rows)


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, concat('s', id % 7), 'hot') as source")
    by = defaultdict(lambda: [0, 0.0])
    for r in mix_plan(docs).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - target) <= 150 for t, target in by.values())


def test_empty_tables(none):
    for df in (exact_duplicates(none), exact_dedup(none), near_duplicates(none), simhash_dedup(none), dedup_substrings(none), mix_plan(none), mix(none)):
        assert df.count() == 0


def test_pipeline_against_plain_python(spark):
    """Each stage by itself on the rows that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    rows = [tuple(r) for r in kept.collect()]
    exact = stages["exact_dedup"](spark, kept, SF)
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        best[key] = min(best.get(key, r), r)
    assert sorted(map(tuple, exact.collect())) == sorted(best.values())
    near = stages["simhash_dedup"](spark, exact, SF)
    roots = brute_components({r[0]: brute_fingerprint(r[1]) for r in best.values()})
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(roots.values()))
    mixed = stages["mix_sources"](spark, near, SF)
    copies = {r.doc_id: r.copies for r in mix_plan(near).collect()}
    assert mixed.columns == columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    out = stages["bpe_encode"](spark, mixed, SF).collect()
    assert len(out) == sum(copies.values()) and all(len(r.ids) == r.n_tokens for r in out)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, out))

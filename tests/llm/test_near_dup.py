import random

import numpy as np

from frostline.llm import near_dup
from frostline.llm.components import components
from frostline.llm.shingles import shingle_sets, sketches
from tests.llm.helpers import DOCS, documents, empty, groups, prose, rows, shingles


def test_shingles_and_sketches():
    texts = [t or "" for _, t, *_ in rows()]
    values, sizes = shingle_sets([t.encode() for t in texts])
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    made = sketches(values, sizes, 64)
    full = np.uint64(2**64 - 1)
    assert all((row == full).all() if not n else (row != full).all() for row, n in zip(made, sizes))


def test_sketches_estimate_similarity():
    words = prose(9, 3000).split()
    a, b = " ".join(words[:2000]), " ".join(words[500:2500])
    values, sizes = shingle_sets([a.encode(), b.encode()])
    made = sketches(values, sizes, 512)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((made[0] == made[1]).mean() - true) < 0.08


def _check(spark, table):
    docs = spark.createDataFrame(table, DOCS)
    found = {}
    for r in near_dup.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, r)
    group = groups(table)
    for (doc_id, text, *_), g in zip(table, group):
        ids = [r[0] for r, h in zip(table, group) if h == g and r[0] is not None]
        row = found[doc_id]
        if doc_id is not None:
            assert (row.n_shingles, row.component_id, row.kept) == (len(shingles(text)), min(ids), doc_id == min(ids)), doc_id


def test_awkward_rows(spark):
    found = near_dup.near_duplicates(documents(spark)).collect()
    assert len(found) == len(rows())
    nulls = sorted((r.component_id is None, r.kept) for r in found if r.doc_id is None)
    assert nulls == [(False, False), (True, True)]
    _check(spark, [r for r in rows() if r[0] != 14])
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies that differ from each other more than from their origin, among outliers."""
    rng, origin, table = random.Random(5), prose(50, 120).split(), []
    for i in range(160):
        w = list(origin)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        table.append((1000 + i, " ".join(w), "en", "s", 0))
    _check(spark, table)


def test_blocks_find_what_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)  # all open buckets go through blocks
    rng, origin, table = random.Random(6), prose(51, 100).split(), []
    for i in range(60):
        w = list(origin)
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        table.append((i, " ".join(w), "en", "s", 0))
    _check(spark, table)


def test_keep_one(spark):
    kept = near_dup.keep_one(documents(spark)).collect()
    table = [r for r in rows()]
    group = groups(table)
    with_words = [i for i, r in enumerate(table) if (r[1] or "").strip()]
    blank = len(table) - len(with_words)
    assert len(kept) == len({group[i] for i in with_words}) + blank
    assert {r.doc_id for r in kept} >= {1, 4, 5, 6, 7, 8, 10}
    assert near_dup.keep_one(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (200, 100)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 103, 200)}}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0

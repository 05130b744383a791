"""The Merkle manifest against a plain tree per language."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from frostline.llm import merkle
from frostline.llm.places import places_in_groups
from frostline.llm.queries import QUERIES
from tests.llm.helpers import DOCS, documents, empty, rows

SF = "/root/testdata/sf0.001"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict) -> str:
    out = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = None if row[name] is None else str(row[name])
        out.append("-" if value is None else f"{len(value.encode())}:{value}")
    return h(*out)


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def path(tree: list[list[str]], at: int) -> list[tuple[int, str | None]]:
    """(side of the sibling, sibling) of every level below the root."""
    out = []
    for row in tree[:-1]:
        beside = at ^ 1
        out.append((beside & 1, row[beside] if beside < len(row) else None))
        at >>= 1
    return out


def brute_force(table: list[dict]) -> list[tuple]:
    langs = sorted({r["lang"] for r in table}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = {}, {}
    for lang in langs:
        members[lang] = sorted(
            (r for r in table if r["lang"] == lang),
            key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)),
        )
        trees[lang] = levels([leaf(r) for r in members[lang]])
    top = levels([trees[lang][-1][0] for lang in langs]) if langs else []
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(members[lang]):
            steps = path(trees[lang], i) + path(top, k)
            altered = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                altered["n_chars"] += 1
            digest = leaf(altered)
            for right, other in steps:
                digest = h(digest) if other is None else h(digest, other) if right else h(other, digest)
            proof = h(*[s for _, s in steps if s is not None])
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return out


def in_order(found):
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0, r[1:5]))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_matches_a_plain_tree(spark, bits):
    table = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows()]
    for n, r in enumerate(table):
        r["lang"] = (None, "en", "é", "", "en")[n % 5]
    table += [{"doc_id": i, "text": "t", "lang": "hot", "source": None, "n_chars": i if i % 3 else None} for i in range(37)]
    table += [{"doc_id": 1, "text": "t", "lang": "hot", "source": None, "n_chars": 1}] * 9
    docs = spark.createDataFrame([tuple(r[f.name] for f in DOCS) for r in table], DOCS)
    for clash in ("leaf", "place", "tree", "total", "tie", "at", "root", "one", "digest"):
        docs = docs.withColumn(clash, F.lit("clash"))
    found = merkle.manifest(docs, bits=bits).collect()
    assert in_order(found) == in_order(brute_force(table))
    assert not all(r.verified for r in found) and any(r.verified for r in found)


def test_manifest_of_little(spark):
    assert merkle.manifest(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None)], DOCS)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
    assert merkle.manifest(documents(spark)).count() == len(rows())


def test_versions_share_untouched_nodes():
    digests = [bytes([i]) * 32 for i in range(13)]
    tree = merkle.Block(digests, 4)
    before = (list(tree.digests), list(tree.left), list(tree.right))
    size = len(tree.digests)
    roots = [tree.tamper(i, b"x" * 32) for i in range(13)]
    assert len(tree.digests) == size + 13 * 5  # the leaf and its four ancestors each
    assert (tree.digests[:size], tree.left[:size], tree.right[:size]) == before
    for i, root in enumerate(roots):
        other = merkle.Block([b"x" * 32 if k == i else d for k, d in enumerate(digests)], 4)
        assert tree.digests[root] == other.digests[other.root]


def test_query_matches_brute_force(spark):
    table = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert in_order(QUERIES["op13_merkle_manifest"](spark, SF).collect()) == in_order(brute_force(table))


def test_places_spread_a_hot_group(spark):
    rows_ = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), F.lit(1).alias("same"))
    found = places_in_groups(rows_, "g", [F.asc("same")], "place", "t")
    for group, n in ((None, 6667), ("hot", 13333)):
        places = [r.place for r in found.where(F.col("g").eqNullSafe(F.lit(group))).collect()]
        assert sorted(places) == list(range(n))

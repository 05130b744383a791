"""Merkle manifest of a table: a proof for every row, and the tree's versions under tampering.

Per language the rows form a binary hash tree in the order of ``doc_id``; the languages'
roots form one more such tree. No task sees a whole tree: its leaves are cut into aligned
blocks of ``2 ** BITS``, each block's nodes are built in one task, and the blocks' roots are
the leaves of the next level, up to a single node. The same function builds the languages'
own tree.

Inside a block the tree is persistent. A tampered leaf makes a new version by copying the
nodes from the leaf up to the block's root; the copies point to the untouched nodes of the
original, which stay valid. Above the block a version goes on as one digest: the path of its
block through the upper levels, which all versions of the block share, gives the siblings to
combine it with, up to the version's root of the whole table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.places import places_in_groups
from frostline.session import write_scratch

BITS = 10  # leaves of a block: 1024
EVERY = 7  # a row is tampered with where this divides the crc32 of its id
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLING = 33  # bytes: 0 or 1 for a sibling on the left or right, then its digest


def leaf_text(column: str) -> Column:
    """A field in a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    value = F.col(column).cast("string")
    size = F.octet_length(value).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), value))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[fields[f] for f in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(doc_id, lang, leaf, tampered): digests; ``tampered`` is null where nothing is altered."""
    fields = {f: leaf_text(f) for f in FIELDS}
    altered = F.col("n_chars").cast("long") + 1
    more = F.when(altered.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(altered.cast("string")).cast("string"), F.lit(":"), altered.cast("string"))
    )
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(every) == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_digest(fields).alias("leaf"),
        F.when(hit, leaf_digest(fields | {"n_chars": more})).alias("tampered"),
    )


def node(*children: bytes) -> bytes:
    """Digest of a run of children, whose digests enter as hex text."""
    return hashlib.sha256(b"".join([c.hex().encode() for c in children])).digest()


class Block:
    """A persistent hash tree over consecutive leaves of one block.

    Nodes are never changed: ``digests[n]``, and ``left[n]``, ``right[n]`` name the children
    (-1 for none; a run of one has a left child alone). ``tamper`` adds a version that shares
    every node beside the path it copies.
    """

    def __init__(self, digests: list[bytes], levels: int):
        self.digests = list(digests)
        self.left, self.right = [-1] * len(digests), [-1] * len(digests)
        self.levels, row = levels, list(range(len(digests)))
        for _ in range(levels):
            row = [self._join(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        if len(row) != 1:
            raise ValueError("too few levels for the leaves of a block")
        self.root = row[0]

    def _join(self, left: int, right: int) -> int:
        d = self.digests
        d.append(node(d[left], d[right]) if right >= 0 else node(d[left]))
        self.left.append(left)
        self.right.append(right)
        return len(d) - 1

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """(node, 1 where the way goes right) from the root down to above the leaf."""
        at, out = self.root, []
        for level in range(self.levels - 1, -1, -1):
            side = (leaf >> level) & 1
            out.append((at, side))
            at = self.right[at] if side else self.left[at]
        return out

    def tamper(self, leaf: int, digest: bytes) -> int:
        """Root of the version in which the leaf has another digest."""
        self.digests.append(digest)
        self.left.append(-1)
        self.right.append(-1)
        at = len(self.digests) - 1
        for parent, side in reversed(self.path(leaf)):
            at = self._join(self.left[parent], at) if side else self._join(at, self.right[parent])
        return at

    def siblings(self, leaf: int) -> bytes:
        """The proof inside the block, from the leaf upwards."""
        out = []
        for parent, side in reversed(self.path(leaf)):
            beside = self.left[parent] if side else self.right[parent]
            if beside >= 0:
                out.append((b"\0" if side else b"\1") + self.digests[beside])
            else:
                out.append(b"\2" + bytes(32))  # a run of one: hashed alone
        return b"".join(out)


def fold(digest: bytes, siblings: bytes) -> bytes:
    """Root that a leaf and its siblings lead to."""
    for at in range(0, len(siblings), SIBLING):
        side, other = siblings[at], siblings[at + 1 : at + SIBLING]
        digest = node(other, digest) if side == 0 else node(digest, other) if side == 1 else node(digest)
    return digest


def proof(siblings: bytes) -> bytes:
    """Digest over all siblings of a path; runs of one have none."""
    hex_ = [siblings[at + 1 : at + SIBLING].hex() for at in range(0, len(siblings), SIBLING) if siblings[at] != 2]
    return hashlib.sha256("".join(hex_).encode()).digest()


BLOCK_ROWS = "tree long, block long, place long, doc_id long, digest binary, version binary, siblings binary"


def _build(bits: int):
    """Per block: a row per leaf with its siblings and its version's root, and one without a
    place that holds the block's root."""
    numbers, digests = ("tree", "block", "place", "doc_id"), ("digest", "version", "siblings")
    schema = pa.schema([(n, pa.int64()) for n in numbers] + [(n, pa.binary()) for n in digests])

    def run(key, table):
        tree, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by("place")
        total = table.column("total")[0].as_py()
        levels = bits if total > 1 << bits else (total - 1).bit_length()
        place, doc_id, digest, altered = (table.column(c).to_pylist() for c in ("place", "doc_id", "digest", "version"))
        nodes = Block(digest, levels)
        root = nodes.digests[nodes.root]
        n = len(digest)
        version = [None if a is None else nodes.digests[nodes.tamper(i, a)] for i, a in enumerate(altered)]
        out = {
            "tree": [tree] * (n + 1), "block": [block] * (n + 1), "place": [*place, None], "doc_id": [*doc_id, None],
            "digest": [*digest, root], "version": [*version, None], "siblings": [*map(nodes.siblings, range(n)), b""],
        }
        return pa.Table.from_pydict(out, schema)

    return run


def block_paths(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Of leaves (tree, total, place, doc_id, digest, version), ``place`` counting from 0 in each
    tree of ``total`` leaves: the rows of ``BLOCK_ROWS``, and (tree, block, upper, root), the
    siblings from every block's root up to that of its tree.

    Every round turns aligned blocks into the leaves of the next one, so a tree of n leaves
    takes log(n) / ``bits`` rounds.
    """
    blocked = nodes.withColumn("block", F.shiftright("place", bits))
    built = write_scratch(blocked.groupBy("tree", "block").applyInArrow(_build(bits), BLOCK_ROWS), "merkle-blocks")
    own = built.where("place IS NOT NULL")
    roots = built.where("place IS NULL").select("tree", "block", "digest")
    sizes = nodes.groupBy("tree").agg(F.max("total").alias("total"))
    largest = sizes.agg(F.max("total")).first()[0] or 0  # one number: are there levels above?
    if largest <= 1 << bits:
        return own, roots.select("tree", "block", F.lit(b"").alias("upper"), F.col("digest").alias("root"))
    blocks = roots.join(sizes, "tree").select(
        "tree",
        F.ceil(F.col("total") / F.lit(1 << bits)).cast("long").alias("total"),
        F.col("block").alias("place"),
        F.lit(None).cast("long").alias("doc_id"),
        "digest",
        F.lit(None).cast("binary").alias("version"),
    )
    above, upper = block_paths(write_scratch(blocks, "merkle-level"), bits)
    joined = above.join(upper, ["tree", "block"])
    siblings = F.concat("siblings", "upper").alias("upper")
    return own, write_scratch(joined.select("tree", F.col("place").alias("block"), siblings, "root"), "merkle-upper")


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, every: int = EVERY, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Languages are ordered bytewise, null first; rows of a language by ``doc_id``, null ids
    first, equal ids by digest. Rows without an id are never tampered with. Nulls in any other
    column are leaves like all others, an empty text has the length 0. Repeated rows are
    leaves of their own. An empty table gives no rows. Further columns play no part.
    """
    placed = places_in_groups(leaves(docs, every), "lang", [F.asc_nulls_first("doc_id"), F.asc("leaf")], "place", "merkle")
    placed = write_scratch(placed, "merkle-leaves")
    counts = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(0))
    langs = places_in_groups(counts, "one", [F.asc_nulls_first("lang")], "tree", "merkle-langs")
    langs = write_scratch(langs.select(F.col("lang").alias("of_lang"), "tree", "total"), "merkle-trees")
    nodes = placed.join(langs, F.col("lang").eqNullSafe(F.col("of_lang"))).select(
        "tree", "total", "place", "doc_id", F.col("leaf").alias("digest"), F.col("tampered").alias("version")
    )
    own, upper = block_paths(write_scratch(nodes, "merkle-nodes"), bits)
    none = F.lit(None)
    subroots = upper.where("block = 0").select(
        F.lit(0).cast("long").alias("tree"), F.lit(langs.count()).cast("long").alias("total"), F.col("tree").alias("place"),
        none.cast("long").alias("doc_id"), F.col("root").alias("digest"), none.cast("binary").alias("version"),
    )
    of_langs, over_langs = block_paths(write_scratch(subroots, "merkle-subroots"), bits)
    top = of_langs.join(over_langs.withColumnRenamed("root", "whole"), ["tree", "block"]).select(
        F.col("place").alias("tree"), F.concat("siblings", "upper").alias("top"), "whole"
    )
    # the languages' paths meet one row per block, so no language's rows are moved by its name
    return own.join(upper.join(top, "tree"), ["tree", "block"]).mapInArrow(_verify, RESULT)


def _verify(batches):
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [("verified", pa.bool_())]
    )
    for batch in batches:
        out = {n: [] for n in schema.names}
        for r in batch.to_pylist():
            above = r["upper"] + r["top"]
            siblings, version = r["siblings"] + above, r["version"]
            folded = fold(r["digest"], siblings) if version is None else fold(version, above)
            values = (
                r["doc_id"], r["digest"].hex(), r["root"].hex(), r["whole"].hex(), proof(siblings).hex(), folded.hex(),
                folded == r["whole"],
            )
            for name, value in zip(schema.names, values):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema)

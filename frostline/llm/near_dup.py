"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Documents with the same shingle set are one node, so exact copies cost nothing further.
Nodes that share a band of their sketches meet in a bucket. Links are confirmed on the full
sets, in three steps that never list all pairs of a bucket:

1. every member is compared with the first node of its bucket, and components are built;
2. buckets that still hold several components and at most ``SMALL`` members compare their
   members across components;
3. larger ones are joined to clusters, whose members are cut into blocks of about ``BLOCK``;
   pairs of blocks, not of documents, are compared by one product of their incidence
   matrices, leaving out blocks that lie in one component already.

So all pairs that share a band are settled: compared, or known to be connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import BLANKS, text_slices, whole_text
from frostline.llm.components import components
from frostline.llm.shingles import band_keys, jaccard_at_least, shingle_sets, sketches
from frostline.session import write_scratch

PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with probability 5e-6
SMALL = 8
BLOCK = 256
SKETCH_TEXTS = 512


def _described(batches):
    for batch in text_slices(batches, "text"):
        for first in range(0, batch.num_rows, SKETCH_TEXTS):
            part = batch.slice(first, SKETCH_TEXTS)
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            values, sizes = shingle_sets(texts)
            keys = band_keys(sketches(values, sizes, BANDS * ROWS), ROWS).astype(np.int64)
            ends = np.cumsum(sizes)
            sets = [values[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
            used = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if u else None for k, u in zip(keys, used)], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "content", "bands"],
            )


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, content, bands) of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(
        _described, "doc_id long, text_hash long, n_shingles long, content binary, bands array<long>"
    )


def _verify(batches):
    """Pairs of texts whose sets are similar enough; neighbours often share their first."""
    last, kept = None, None
    for batch in text_slices(batches, "text_b", 4_000_000):
        rows = batch.to_pydict()
        links = []
        values, sizes = shingle_sets([t.encode("utf-8", "surrogatepass") for t in rows["text_b"]])
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip(rows["a"], rows["b"])):
            if a != last:
                last, kept = a, shingle_sets([rows["text_a"][i].encode("utf-8", "surrogatepass")])[0]
            if jaccard_at_least(kept, values[ends[i] - sizes[i] : ends[i]], PERCENT):
                links.append((a, b))
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"]
            )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by their full sets."""
    a = texts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("text").alias("text_b"))
    sized = pairs.join(a.drop("text_a"), "a").join(b.drop("text_b"), "b")
    possible = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (F.col("a") != F.col("b"))
    with_b = sized.where(possible).select("a", "b").join(b.drop("n_b"), "b")
    return with_b.join(a.drop("n_a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _pack_block(key, group):
    nodes, comps = group["node"].to_numpy(), group["comp"].to_numpy()
    values, sizes = shingle_sets([t.encode("utf-8", "surrogatepass") for t in group["text"].to_pylist()])
    return pa.table(
        {
            "cluster": [key[0].as_py()],
            "owner": [key[1].as_py()],
            "nodes": [nodes.astype("<i8").tobytes()],
            "comps": [comps.astype("<i8").tobytes()],
            "sizes": [sizes.astype("<i8").tobytes()],
            "sets": [values.astype("<u8").tobytes()],
        },
        pa.schema(
            [("cluster", pa.int64()), ("owner", pa.int64())]
            + [(c, pa.binary()) for c in ("nodes", "comps", "sizes", "sets")]
        ),
    )


def _common_counts(sets_a, sizes_a, sets_b, sizes_b, columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all sets of one block with all of another."""
    shared = np.intersect1d(sets_a, sets_b)
    out = np.zeros((len(sizes_a), len(sizes_b)), np.float32)

    def places(sets, sizes):
        at = np.searchsorted(shared, sets)
        at[at == len(shared)] = 0
        hit = shared[at] == sets if len(shared) else np.zeros(len(sets), bool)
        return np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]

    (row_a, at_a), (row_b, at_b) = places(sets_a, sizes_a), places(sets_b, sizes_b)
    for first in range(0, len(shared), columns):
        parts = []
        for rows, at, n in ((row_a, at_a, len(sizes_a)), (row_b, at_b, len(sizes_b))):
            inside = (at >= first) & (at < first + columns)
            dense = np.zeros((n, min(columns, len(shared) - first)), np.float32)
            dense[rows[inside], at[inside] - first] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _compare_blocks(batches):
    def block(row, side):
        kinds = (("nodes", "<i8"), ("comps", "<i8"), ("sizes", "<i8"), ("sets", "<u8"))
        return [np.frombuffer(row[f"{side}_{name}"], kind) for name, kind in kinds]

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (nodes_a, comps_a, sizes_a, sets_a), (nodes_b, comps_b, sizes_b, sets_b) = block(row, "x"), block(row, "y")
            common = _common_counts(sets_a, sizes_a, sets_b, sizes_b)
            union = sizes_a[:, None] + sizes_b - common
            linked = (100 * common >= PERCENT * union) & (comps_a[:, None] != comps_b)
            parent: dict[int, int] = {}

            def root(x):
                while x in parent:
                    x = parent[x]
                return x

            links = []  # only those that join components not yet joined here
            for p, q in np.argwhere(linked).tolist():
                u, v = root(int(comps_a[p])), root(int(comps_b[q]))
                if u != v:
                    parent[u] = v
                    links.append((int(nodes_a[p]), int(nodes_b[q])))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"]
                )


def linked_by_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components among the members (first, node, comp) of large buckets.

    ``first`` is the bucket's smallest node, which ties its members together.
    """
    edges = members.select(F.col("first").alias("a"), F.col("node").alias("b"))
    clusters = components(edges, "nd-clusters").withColumnRenamed("comp", "cluster")
    placed = clusters.join(members.select("node", "comp").distinct(), "node")
    per_comp = placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"))
    own = per_comp.withColumn("owner", F.when(F.col("size") > BLOCK, F.col("comp")).otherwise(F.lit(-1)))
    total = own.groupBy("cluster", "owner").agg(F.sum("size").alias("total"))
    own = own.join(total, ["cluster", "owner"]).select("cluster", "comp", "owner", "total")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / BLOCK))
    rows = placed.join(own, ["cluster", "comp"]).withColumn("part", part).join(texts.select("node", "text"), "node")
    packed = rows.groupBy("cluster", "owner", "part").applyInArrow(
        _pack_block, "cluster long, owner long, nodes binary, comps binary, sizes binary, sets binary"
    )
    blocks = write_scratch(packed.withColumn("block", F.monotonically_increasing_id()), "nd-blocks")
    narrow = blocks.select("cluster", "owner", "block")
    x, y = narrow.toDF("cluster", "x_owner", "x"), narrow.toDF("cluster", "y_owner", "y")
    within = (F.col("x_owner") == F.col("y_owner")) & (F.col("x_owner") != -1)
    pairs = x.join(y, "cluster").where((F.col("x") <= F.col("y")) & ~within).select("x", "y")

    def named(side):
        return blocks.select(
            F.col("block").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("nodes", "comps", "sizes", "sets")]
        )

    return pairs.join(named("x"), "x").join(named("y"), "y").mapInArrow(_compare_blocks, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all documents described, nodes with their component)."""
    described = write_scratch(describe(docs), "nd-docs")
    nodes = (
        described.where("content IS NOT NULL")
        .groupBy("content")
        .agg(
            F.min("doc_id").alias("id"),
            F.min_by(
                F.struct("doc_id", "text_hash", "n_shingles", "bands"),
                F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"),
            ).alias("r"),
        )
        .select("content", "id", "r.text_hash", F.col("r.doc_id").alias("row_id"), F.col("r.n_shingles").alias("n"), "r.bands")
    )
    nodes = write_scratch(nodes.withColumn("node", F.monotonically_increasing_id()), "nd-nodes")

    # buckets that more than one node falls into
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members"))
    buckets = write_scratch(every.join(shared.where("members > 1"), "bucket"), "nd-buckets")

    needed = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    key = _row_key("row_id")
    row = docs.select(F.col("doc_id").cast("long").alias("row_id"), whole_text().alias("text"))
    row = row.withColumn("text_hash", F.xxhash64("text")).select(*key, "text")
    texts = write_scratch(
        needed.select("node", "n", *key).join(row, ["row_id", "no_id", "text_hash"]).select("node", "n", "text"), "nd-texts"
    )

    star = buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = write_scratch(star, "nd-star")
    links = write_scratch(verified(star, texts), "nd-links")

    comps = components(links, "nd-components")
    placed = buckets.join(comps, "node", "left").select(
        "bucket", "first", "node", "members", F.coalesce("comp", "node").alias("comp")
    )
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rest = write_scratch(placed.join(open_.select("bucket"), "bucket"), "nd-open")
    small = rest.where(F.col("members") <= SMALL)
    x = small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    y = small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    across = x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")))
    across = across.select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    more = verified(across, texts)
    most = linked_by_blocks(rest.where(F.col("members") > SMALL), texts)
    final = components(links.union(more).union(most), "nd-final")

    found = nodes.select("content", "node", "id", "row_id", "text_hash").join(final, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")
    )
    return described, found


def _row_key(doc_id: str) -> list:
    """Rows that agree in these columns hold the same id and text."""
    return [F.coalesce(doc_id, F.lit(-1)).alias("row_id"), F.col(doc_id).isNull().alias("no_id"), "text_hash"]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    A document's set holds its distinct shingles of five words; shorter texts have their
    whole sequence as one. ``component_id`` is the smallest id of the documents that chains
    of links reach. A null or blank text has an empty set and is linked with nothing. Rows
    without an id take part by their text; they are kept only where no document of the
    group has an id, and repeated rows are kept or not together. An empty table gives no
    rows.
    """
    described, found = _grouped(docs)
    smallest = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    grouped = found.join(smallest, "comp").select("content", "component_id")
    # one row per content: as many documents as there are copies may meet it
    out = described.select("doc_id", "n_shingles", "content").join(grouped, "content", "left")
    component = F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, or text hash without ids.

    Rows without words are in no group and stay.
    """
    _, found = _grouped(docs)
    first = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "text_hash")).alias("r")
    chosen = found.groupBy("comp").agg(first).select("r.row_id", "r.text_hash").select(*_row_key("row_id"))
    blank = F.length(F.translate(whole_text(), BLANKS, "")) == 0
    names = docs.columns
    rows = docs.where(~blank).select(
        *[F.col(c).alias(f"d_{c}") for c in names],
        F.col("doc_id").cast("long").alias("own_id"),
        F.xxhash64(whole_text()).alias("text_hash"),
    )
    keyed = rows.select(*[f"d_{c}" for c in names], *_row_key("own_id"))
    keys = ["row_id", "no_id", "text_hash"]
    kept = keyed.join(chosen, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*[F.col(f"d_{c}").alias(c) for c in names]).union(docs.where(blank))

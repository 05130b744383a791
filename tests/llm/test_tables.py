"""Mixture, URL lists, top-k, classifier and the pipeline."""

import math
import zlib
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from frostline.llm import bpe, factorisation, mixing, topk_bitsliced, url_lists
from frostline.llm.queries import OP5_SQL, ORACLE, QUERIES, vocabulary
from tests.compare import compare, connect
from tests.llm.helpers import DOCS, documents, empty, groups, prose, rows, sha, words
from tests.llm.test_text_rules import quality_verdicts, secret_base
from tests.llm.test_tokens import PATTERN

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    problem, _, _ = compare(spark, connect(SF), SF, QUERIES[name], ORACLE[name])
    assert problem is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "shingles" in OP5_SQL


# Mixture.


def key_of(doc_id, text):
    import hashlib

    text = text or ""
    inner = hashlib.md5(text.encode()).hexdigest()
    own = hashlib.md5(f"{'' if doc_id is None else doc_id}|1|{inner}".encode()).hexdigest()
    u = (int(own[:13], 16) + 0.5) / 2**52
    size, marks = len(words(text)), sum(c in mixing.MARKS for c in text)
    return -math.log(u) / ((size + 1) / (size + 1 + marks))


def mixed(table):
    """(doc_id, taken) by resharing step by step and sorting whole sources."""
    by = defaultdict(list)
    for doc_id, text, _, source, _ in table:
        by[source].append((key_of(doc_id, text), doc_id, len(words(text))))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    size = {s: sum(d[2] for d in by[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    out = []
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        for _, doc_id, n in sorted(by[s], key=lambda d: d[0]):
            upto += n
            out.append((doc_id, n * (epochs + (2 * upto - n < rest * 2 and n > 0))))
    return sorted(map(str, out)), target, size


def _mixture_rows():
    table = [r for r in rows() if r[0] != 14]
    for i in range(300):  # a hot source, and marks that weigh documents down
        text = prose(i, 5 + i % 90) + " ###" * (i % 4)
        table.append((1000 + i, text, "en", "a" if i % 3 else f"s{i % 7}", 0))
    return table


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 20)
    table = _mixture_rows()
    found = mixing.mix(spark.createDataFrame(table, DOCS)).collect()
    wanted, target, size = mixed(table)
    assert sorted(str((r.doc_id, r.taken)) for r in found) == wanted
    source = {(r[0], len(words(r[1]))): r[3] for r in table}
    for r in found:
        s = source[r.doc_id, r.size]
        assert math.isclose(r.target, target[s]) and r.source_size == size[s] and r.taken <= 3 * r.size
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(documents(spark)).count() == len(rows())


def test_mixed_documents(spark):
    docs = spark.createDataFrame(_mixture_rows(), DOCS)
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect()}
    copies = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        copies[r.doc_id, len(words(r.text))] += 1
    assert all(copies[k] * k[1] == t for k, t in taken.items() if k[0] is not None)
    assert mixing.mixed_documents(empty(spark)).count() == 0


# URL lists.


def test_url_lists(spark):
    day = lambda n: date(2024, 1, n)
    events = [
        ("domain", "bad.com", day(2), "add", "block"), ("domain", "bad.com", day(5), "remove", "block"),
        ("domain", "bad.com", day(9), "add", "block"), ("host", "ok.bad.com", day(1), "add", "allow"),
        ("prefix", "ok.bad.com/x", day(3), "add", "block"), ("host", "two.org", day(4), "add", "block"),
        ("host", "two.org", day(4), "remove", "block"), (None, "q", day(1), "add", "block"),
        ("host", None, day(1), "add", "block"), ("host", "q", None, "add", "block"),
    ]
    urls = [
        "http://bad.com", "https://A.b.BAD.com:80/p?q", "http://ok.bad.com/y", "http://u:p@ok.bad.com/x/z/w#t",
        "http://two.org/", "http://notbad.com/", None, "", "no url", "http://localhost/a/b/c", "ftp://bad.com//x//y",
    ]
    captures = [(i, u, day(d) if d else None) for i, u in enumerate(urls) for d in (0, 1, 2, 4, 5, 8, 9, 20)] * 2
    entries = spark.createDataFrame(events, "kind string, key string, day date, action string, verdict string")
    asked = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    found = url_lists.evaluate(asked, entries, keep=("page_id", "fetched")).collect()
    assert len(found) == len(captures)

    def wanted(url, when):
        import re

        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*(/[^?#]*)?", url or "")
        if not m or when is None:
            return 0, None, False
        host, parts = m[1].lower(), [p for p in (m[2] or "").split("/") if p]
        labels = host.split(".")
        keys = [("domain", ".".join(labels[-k:]), k) for k in range(2, len(labels) + 1)] + [("host", host, 1000)]
        keys += [("prefix", "/".join([host, *parts[: k + 1]]), 1001 + k) for k in range(len(parts))]
        active = []
        for kind, key, weight in keys:
            past = [e for e in events if e[0] == kind and e[1] == key and e[2] and e[2] <= when]
            if past:
                last = max(e[2] for e in past)
                if not any(e[3] == "remove" for e in past if e[2] == last):
                    verdict = min(e[4] == "allow" for e in past if e[2] == last)
                    active.append((weight, f"{kind}:{key}", not verdict))
        best = max(active, default=(0, None, False))
        return len(active), best[1], best[2]

    for r in found:
        assert (r.n_active, r.rule, r.blocked) == wanted(urls[r.page_id], r.fetched), (urls[r.page_id], r)
    assert url_lists.evaluate(asked.limit(0), entries, keep=("page_id",)).count() == 0
    assert not any(r.blocked for r in url_lists.evaluate(asked, entries.limit(0), keep=("page_id",)).collect())


def test_keys_in_any_case(spark):
    events = [("host", "A.com", "block"), ("prefix", "B.org/Path", "block"), ("domain", "C.Net", "block")]
    entries = spark.createDataFrame([(k, key, date(2024, 1, 1), "add", v) for k, key, v in events], "kind string, key string, day date, action string, verdict string")
    urls = {"http://a.com/": True, "http://b.ORG/Path/x": True, "http://b.org/path": False, "http://x.c.net": True}
    asked = spark.createDataFrame([(u, date(2024, 1, 2)) for u in urls], "url string, fetched date")
    assert {r.url: r.blocked for r in url_lists.evaluate(asked, entries, keep=("url",)).collect()} == urls


def test_large_components_are_exact_or_refused(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0**24]), (2, [2.0**25]), (3, [2.0**26])], "vec_id long, embedding array<double>")
    found = topk_bitsliced.top_k(one, one.where("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in found] == [(3, 2**38), (2, 2**37), (1, 2**36)]
    wide = spark.createDataFrame([(0, [2.0**24] * 16), (1, [2.0**24] * 16)], "vec_id long, embedding array<double>")
    with pytest.raises(topk_bitsliced.ScoresTooLarge):
        topk_bitsliced.top_k(wide, wide)
    near = spark.createDataFrame([(5, [1.001]), (5, [1.002]), (5, [1.002]), (6, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk_bitsliced.top_k(near, near.where("vec_id = 6")).collect()] == [5, 5]


def test_mixture_of_texts_full_of_marks(spark):
    """Keys far from those of plain prose: their steps are as even as any."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("x "), F.repeat(F.lit("#"), 60)).alias("text")
    )
    docs = docs.union(spark.range(5_000).select(F.col("id") + 50_000, F.lit("t"), F.lit("plain words here")))
    keys = mixing.keyed(docs, 1).cache()
    sources = mixing.source_targets(keys, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    step = sources.select(
        F.col("source").alias("of_source"), "rest", "n_docs", F.lit(-1.0).alias("low"),
        F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"),
    )
    assert mixing._closer(keys, step).agg(F.max("n_docs")).first()[0] < 1_000
    found = mixing.mix(docs).groupBy("doc_id", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    for r in found.groupBy((F.col("doc_id") < 50_000).alias("s")).agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 3


def test_fitting_task_reads_the_picked_rows_only(spark, plan):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert "Coalesce" not in plan(factorisation.training_rows(docs, labels).repartition(1))
    import inspect

    assert "coalesce(1)" not in inspect.getsource(factorisation.train).split('"""')[-1]


def test_deep_url_prefixes(spark):
    deep = "/".join(f"s{n}" for n in range(40))
    events = [
        ("prefix", "h.org/a/b/c", "add", "block"), ("prefix", "h.org/a/b", "add", "allow"),
        ("prefix", f"h.org/{deep}", "add", "block"), ("host", "h.org", "add", "allow"),
    ]
    wanted = {
        "http://h.org/a/b/c": (3, "prefix:h.org/a/b/c", True), "http://h.org/a/b/c/d?q": (3, "prefix:h.org/a/b/c", True),
        "http://h.org/a/b/cc": (2, "prefix:h.org/a/b", False), f"http://h.org/{deep}/x": (2, f"prefix:h.org/{deep}", True),
        f"http://h.org/{deep[:-4]}": (1, "host:h.org", False), "http://i.org/a/b/c": (0, None, False),
    }
    entries = spark.createDataFrame([(*e[:2], date(2024, 1, 1), *e[2:]) for e in events], "kind string, key string, day date, action string, verdict string")
    asked = spark.createDataFrame([(u, date(2024, 1, 2)) for u in wanted], "url string, fetched date")
    found = url_lists.evaluate(asked, entries, keep=("url",)).collect()
    assert {r.url: (r.n_active, r.rule, r.blocked) for r in found} == wanted
    no_prefix = url_lists.evaluate(asked, entries.where("kind = 'host'"), keep=("url",)).collect()
    assert sum(r.rule == "host:h.org" for r in no_prefix) == 5


# Top-k.


def best(vectors, asked, k):
    out = []
    for q, a in asked:
        scores = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors if v != q))
        out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [7, 64, 10_000])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(2)
    table = [(i, (rng.normal(size=6) * 0.3).round(2).tolist()) for i in range(150)]
    table += [(1000 + i, table[3][1]) for i in range(40)]  # ties
    table += [(5, table[5][1]), (2000, [0.0] * 6), (2001, [-3.0, 900.0, 0.0, 0.0, 0.0, 1e-9])]
    odd = [(3000, None), (3001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>")
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v in dict((r[0], r[1]) for r in table).items()]
    asked = [c for c in clean if c[0] % 10 == 0]
    found = topk_bitsliced.top_k(vectors, vectors.where("vec_id % 10 = 0"), k=9, block_rows=blocks, chunk_rows=11)
    assert sorted(map(tuple, found.collect())) == best(clean, asked, 9)


def test_top_k_of_few(spark):
    vectors = spark.createDataFrame([(20, [0.5]), (40, [0.25])], "vec_id long, embedding array<float>")
    found = topk_bitsliced.top_k(vectors, vectors, k=20).collect()
    assert sorted(map(tuple, found)) == [(20, 1, 40, 512), (40, 1, 20, 512)]
    assert topk_bitsliced.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk_bitsliced.top_k(vectors.limit(1), vectors.limit(1)).count() == 0


# Classifier.


def test_pairs_in_linear_time():
    rng = np.random.default_rng(3)
    model = factorisation.fit([], np.zeros(0))
    model.factors = rng.normal(size=model.factors.shape)
    model.weights = rng.normal(size=model.weights.shape)
    model.bias = 0.3
    feature, value = rng.integers(0, factorisation.WIDTH, 9), rng.normal(size=9)
    pairs = sum(
        value[i] * value[j] * (model.factors[feature[i]] @ model.factors[feature[j]]) for i in range(9) for j in range(i)
    )
    assert math.isclose(model.margins(feature, value, np.array([9]))[0], 0.3 + value @ model.weights[feature] + pairs)


def test_classifier(spark):
    docs = [(i, prose(i, 40) if i % 3 else "!!! ".join(prose(i, 40).upper().split()), "en", "a", 100) for i in range(300)]
    table = spark.createDataFrame(docs + rows(), DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = [r for r in factorisation.classify(table, labels).collect()]
    assert len(found) == len(docs) + len(rows()) and all(0 <= r.score <= 1 for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id is not None and 20 <= r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    again = factorisation.classify(table, labels).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert factorisation.classify(empty(spark), labels).count() == 0
    assert factorisation.classify(documents(spark), labels.limit(0)).count() == len(rows())


def test_held_out_accuracy_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op7_factorisation_machine"](spark, sf).where("held_out").collect()
    good = [r.score for r in found if labels.get(r.doc_id) == 1]
    bad = [r.score for r in found if labels.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


# Pipeline.


def test_pipeline_against_brute_force(spark):
    """All five stages in plain Python; secrets that only the method finds are none here."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    verdicts = quality_verdicts(docs, good)
    kept = [r for r in docs if verdicts[r[0], r[1]][6]]
    group = groups(kept)
    first = {g: min(r[0] for r, h in zip(kept, group) if h == g) for g in group}
    kept = [r for r, g in zip(kept, group) if first[g] == r[0]]
    table = []
    for doc_id, text, lang, source, _ in kept:
        out, at = [], 0
        for start, end in sorted((s, e) for _, s, e in secret_base(text)):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        table.append((doc_id, "".join([*out, text[at:]]), lang, source, 0))
    times = defaultdict(int)
    for entry in mixed(table)[0]:
        doc_id, taken = eval(entry)
        times[doc_id] += taken
    encoding = tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    wanted = []
    for doc_id, text, *_ in table:
        ids = encoding.encode_ordinary(text)
        row = (doc_id, len(ids), sha(",".join(map(str, ids))), sha(text))
        wanted += [row] * (times[doc_id] // len(words(text)))
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, empty(spark), SF).count() == 0

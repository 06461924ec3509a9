"""Search, classifier, URL filters, shards, mixing and the pipeline against brute force."""

import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from ferryline.llm import cotraining, cover_tree, mixing, sharding, url_cascade
from ferryline.llm.queries import BLOCKED_HOSTS, QUERIES, SQL, URL_RULES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small_tables, name):
    import compare

    assert compare.difference(spark, compare.oracle(small_tables), name, small_tables)[0] is None


# --- top-k -------------------------------------------------------------------------


def brute_top(rows, k):
    kept = {(i, tuple(int(np.floor(64 * np.float64(np.float32(x)))) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)}
    out = []
    for i, q in kept:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in kept if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)  # several blocks, and inner nodes of trees
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 4)
    monkeypatch.setattr(cover_tree, "LEAF", 6)
    monkeypatch.setattr(cover_tree, "SAMPLE", 50)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.05 * rng.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(70)]  # one common vector
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan"), 1.0]), (460, [float("inf")]), (None, [1.0]), (480, []),
             (500, [0.0] * 6), (520, [1.0, 2.0]), rows[3], (540, [-1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert sorted(tuple(r) for r in cover_tree.top_k(df, "vec_id % 20 = 0").collect()) == brute_top(rows, 20)
    assert cover_tree.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert sorted(tuple(r) for r in cover_tree.top_k(df.where("vec_id IN (0, 1, 20)"), "vec_id % 20 = 0").collect()) == brute_top(
        [r for r in rows if r[0] in (0, 1, 20)], 20)


def test_a_vector_too_large_to_score_is_an_error(spark):
    rows = [(0, [1.0, 2.0]), (1, [300_000.0, 1.0]), (3, [0.5, 0.5]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="can't be scored exactly"):
        cover_tree.top_k(df, "vec_id % 20 = 0").collect()
    most = spark.createDataFrame([(0, [262_143.0, -1.0]), (1, [-262_143.0, 3.0]), (2, [float("inf"), 1.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in cover_tree.top_k(most, "vec_id % 20 = 0").collect()]
    assert found == [(0, 1, 1, -(262_143 * 64) ** 2 - 3 * 64 * 64)]


def test_trees_hold_every_row_and_cover_it():
    rng = np.random.default_rng(2)
    points = np.floor(64 * np.vstack([rng.normal(size=(1, 8)) + 0.1 * rng.normal(size=(400, 8)) for _ in range(5)]))
    tree = cover_tree.CoverTree(np.arange(len(points)), points)
    assert sorted(tree.rows_below(tree.root).tolist()) == list(range(len(points)))
    for n, (centre, radius, _, _) in enumerate(tree.nodes):
        far = np.sqrt(((points[tree.rows_below(n)] - points[centre]) ** 2).sum(axis=1))
        assert far.max() <= radius + 1e-9


# --- classifier ----------------------------------------------------------------------


def test_classifier_on_labels_held_out(spark, small_tables):
    sf_dir = small_tables.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for_fit, held_out = labels.where("doc_id % 3 <> 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 3 = 0").collect()}
    found = {r["doc_id"]: r for r in cotraining.judge(docs, for_fit).collect()}
    assert len(found) == docs.count()
    good = [found[i]["keep"] for i, q in held_out.items() if q == 1]
    bad = [found[i]["keep"] for i, q in held_out.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2
    assert all(0 <= r[c] <= 1 for r in found.values() for c in ("text_score", "metadata_score", "score"))


def test_classifier_on_odd_rows(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["keep"]) for r in cotraining.judge(docs, none).collect()} == {(1.0, True)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(3, 0, 1), (None, 1, 0), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    assert cotraining.judge(docs, labels, ["component_id"]).count() == len(odd_texts)
    assert cotraining.judge(docs.limit(0), labels).count() == 0
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    assert cotraining.judge(bare, labels).count() == len(odd_texts)


def test_sample_has_one_row_of_each_doc_id(spark, docs_of):
    docs = docs_of([(0, f"text {i}") for i in range(50)] + [(1, "some"), (2, "other"), (2, "other")])
    ids = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "doc_id long, good int")
    text, meta, good = cotraining._sample(docs, ids)
    assert len(text) == len(meta) == len(good) == 3
    assert all(np.array_equal(text, cotraining._sample(d, ids)[0]) for d in (docs.repartition(7), docs.orderBy("text")))


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = rng.random(3_000) < 0.7
    text = np.column_stack([y * 2.0 - 1, rng.normal(size=3_000)]) + 0.3 * rng.normal(size=(3_000, 2))
    meta = np.column_stack([y * 2.0 - 1, rng.normal(size=3_000)]) + 0.6 * rng.normal(size=(3_000, 2))
    model = cotraining.cotrain(text[:80], meta[:80], y[:80], text[80:2_000], meta[80:2_000])
    scores = model.scores(text[2_000:], meta[2_000:])
    assert [np.mean((s > 0.5) == y[2_000:]) > 0.9 for s in scores] == [True] * 3
    assert cotraining.cotrain(text[:9], meta[:9], np.ones(9, bool), text[80:90], meta[80:90]) is None


# --- URL filters -----------------------------------------------------------------------


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]

    def within(h):
        return host == h or host.endswith("." + h)

    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if within(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    return host, path, None, "block" if any(map(within, BLOCKED_HOSTS)) else "allow"


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://a.ORG", "http://org?x/", "https://x.example.org/es/1?q#f",
            "https://example.org/en/12", "https://notexample.org/en/12", "http://com/fr/", "http://a..com/de/x", "http://acom/de/",
            "http://m.casino-win.example.com/en/1", "http://casino-win.example.com", "http://casino-win.example.com/fr/",
            "a://b://org/", "http://x.org/a\nb?c", "http://İ.org/", "http://user@h.com:80/de/", "x" * 9_000 + "://org/", "http://" + "a." * 900 + "org/"]
    rows = [(i, u, "h", "r") for i, u in enumerate([*urls, urls[7]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    blocked = spark.createDataFrame([(h,) for h in [*BLOCKED_HOSTS[1:], BLOCKED_HOSTS[0].upper(), BLOCKED_HOSTS[1], None, ""]], "host string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_cascade.judge(pages, URL_RULES, blocked).collect()}
    assert found == {i: brute_judge(u) for i, u, _, _ in rows}
    assert url_cascade.judge(pages.limit(0), URL_RULES, blocked).count() == 0
    assert {r["verdict"] for r in url_cascade.judge(pages.where("page_id > 12"), [], blocked.limit(0)).collect()} == {"allow"}


def test_tracked_hosts_and_a_long_list(spark):
    urls = ["http://A.b/?ref=1", "http://a.b/x", "http://a.b/y", "http://c.b/?utm_s=1", "http://d.b/ref=1", "http://d.b/?xref=1", None, "http://?ref=2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert sorted(r[0] for r in url_cascade.tracked_hosts(pages).collect()) == ["a.b", "c.b"]
    assert [r[0] for r in url_cascade.tracked_hosts(pages, 1).collect()] == ["c.b"]
    many = spark.range(40_000).selectExpr("id AS page_id", "concat('http://w.h', id % 20000, '.net/') AS url")
    listed = spark.range(20_000).where("id % 3 = 0").selectExpr("concat('h', id, '.net') AS host")
    found = url_cascade.judge(many, [], listed).where("verdict = 'block'").select("page_id")
    assert sorted(r[0] for r in found.collect()) == [i for i in range(40_000) if i % 20_000 % 3 == 0]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) key")
    listed = spark.range(0, 40_000, 37).selectExpr("concat('k', id) key")
    cascade = url_cascade.build(universe.union(universe.limit(50)), listed)
    rows = universe.select("key", *[h.alias(n) for h, n in zip(url_cascade._hashes(universe["key"]), ("h1", "h2"))]).toPandas()
    holds = cascade.holds(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64))
    assert len(cascade.levels) > 1 and holds.tolist() == [int(k[1:]) % 37 == 0 for k in rows.key]
    assert cascade.size() < 20_000
    nothing = url_cascade.build(universe, listed.limit(0))
    assert not nothing.holds(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64)).any()


# --- shards -----------------------------------------------------------------------------


def test_best_fit_decreasing_takes_the_tightest_bin():
    rng = random.Random(6)
    for capacity in (50, 100):
        sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
        room, want = [], []
        for s in sizes:
            fits = [(r, b) for b, r in enumerate(room) if r >= s]
            if fits:
                b = min(fits)[1]
                room[b] -= s
            else:
                b = len(room)
                room.append(max(0, capacity - s))
            want.append(b)
        assert sharding.best_fit_decreasing(sizes, capacity) == want
    assert sharding.best_fit_decreasing([], 5) == []


def test_shards_are_even_whole_and_numbered(spark, docs_of, odd_texts):
    for docs, tolerance in ((spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.02), (docs_of(odd_texts), None)):
        rows = sharding.shard(docs, 8).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        of_text, size, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in rows:
            of_text[r["text_crc32"], r["size"]].add(r["shard"])
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in of_text.values()) and set(size) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if tolerance:
            assert max(size.values()) <= (1 + tolerance) * sum(size.values()) / 8
    assert sharding.shard(docs_of([(0, "x")]).limit(0)).count() == 0


# --- mixing ------------------------------------------------------------------------------


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in stopped)
        share = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and Fraction(weight[s] * rest, max(share, 1)) > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s] if s in stopped else Fraction(weight[s] * rest, max(share, 1))) for s in names}
        stopped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, None: 300, "Z": 0, "é": 7}, {None: 4}, {"x": 0}, {chr(97 + i): 2**i for i in range(20)}])
def test_targets_equal_brute_force(spark, sizes):
    rows = [(s, part) for s, n in sizes.items() for part in (n // 2, n - n // 2)]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), 3).collect()}
    want = brute_targets(sizes, (5, 2, 1), 3)
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s]) for s in want)


def test_mixture_comes_near_its_targets(spark, small_tables):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mixture(docs).persist()
    rows = mixed.groupBy("source").agg({"target": "max"}).collect()
    taken = {r["source"]: r["n"] for r in mixed.selectExpr("source", "copies * size n").groupBy("source").sum("n").toDF("source", "n").collect()}
    assert all(abs(taken[s] / t - 1) < 0.2 for s, t in rows)
    assert mixed.where("copies > 3 OR copies < 0").count() == 0
    assert mixing.emit(mixed).count() == mixed.selectExpr("sum(copies)").first()[0]
    assert mixed.selectExpr("doc_id", "copies").exceptAll(mixing.mixture(docs).selectExpr("doc_id", "copies")).count() == 0


def test_mixture_of_odd_rows(docs_of, odd_texts):
    found = mixing.mixture(docs_of(odd_texts).withColumnRenamed("component_id", "size")).collect()
    assert len(found) == len(odd_texts)
    assert mixing.mixture(docs_of([(1, None), (2, " ")])).selectExpr("sum(copies)").first()[0] == 0
    assert mixing.emit(mixing.mixture(docs_of([(0, "x")]).limit(0))).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small_tables}/labels.parquet").collect()}
    columns = [(f.name, f.dataType) for f in docs.schema]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, small_tables).persist()
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum(labels[i] == 1 for i in kept if i in labels) >= 0.97 * sum(labels.values())
    single = stages["near_dedup"](spark, good, small_tables).persist()
    texts = [r["text"] for r in single.collect()]
    assert len(texts) == len(set(texts)) < good.count()
    cut = stages["substrings"](spark, single, small_tables).persist()
    assert cut.count() <= single.count() and cut.selectExpr("sum(n_chars)").first()[0] <= single.selectExpr("sum(n_chars)").first()[0]
    mixed = stages["mixing"](spark, cut, small_tables).persist()
    assert {r[0] for r in mixed.select("doc_id").distinct().collect()} <= kept
    for df in (good, single, cut, mixed):
        assert [(f.name, f.dataType) for f in df.schema] == columns
    final = stages["pieces"](spark, mixed, small_tables)
    assert final.count() == mixed.count()
    want = Counter(r[0] for r in mixed.selectExpr("sha2(text, 256)").collect())
    assert Counter(r["decoded_sha256"] for r in final.collect()) == want


def test_pipeline_of_odd_rows(spark, docs_of, odd_texts, small_tables):
    docs = docs_of(odd_texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_tables).columns and stage(spark, docs.limit(0), small_tables).count() == 0
    once = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, small_tables)
    assert Counter(r[0] for r in once.select("doc_id").collect())[12] <= 1
    assert once.where("doc_id IS NULL").count() == 2


def test_near_dedup_keeps_every_distinct_text_of_a_repeated_doc_id(spark, docs_of, small_tables):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b.upper()), (1, b), (2, a), (3, b + " more"), (4, c), (None, a)]
    once = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs_of(rows), small_tables)
    assert Counter((r["doc_id"], r["text"]) for r in once.collect()) == Counter([(1, a), (1, b.upper()), (4, c), (None, a)])


def test_queries_are_registered_for_every_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10

"""Periodic runs, licence scans and resampling against brute force, on odd rows and on whole small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ferryline.llm import licences, resampling, runs
from ferryline.llm.licences import Template
from ferryline.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def given(spark, sf_dir, name="documents", key="doc_id"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]


def plain_words(text):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- periodic runs ---------------------------------------------------------------


def brute_runs(words):
    """All runs as (start, length, period), by a scan at every lag."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_made_texts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            words = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.choice([0, 1, 5, 6, 20, 100, 400]))]
            for _ in range(rng.randint(0, 3) if len(words) > 8 else 0):
                q, a = rng.randint(1, len(words) // 3), rng.randrange(len(words))
                for i in range(a + q, min(len(words), a + rng.randint(0, 7 * q))):
                    words[i] = words[i - q]
            docs.append(words)
        spans, collapsed = runs._batch_runs([" ".join(d).encode() for d in docs])
        for words, own, rest in zip(docs, spans, collapsed):
            want = brute_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in own] == want
            assert rest.decode() == collapse(words, want)


def test_a_period_of_each_scale_is_found_where_it_just_fits():
    rng = random.Random(6)
    for q in (8, 9, 16, 17, 31, 32, 33, 64, 65, 128, 129, 300):
        block = [f"b{rng.randrange(3)}" for _ in range(q - 1)] + ["end"]
        for length in (4 * q - 1, 4 * q, 4 * q + 1):
            text = ["x", *(block * 5)[:length], "y"]
            spans, _ = runs._batch_runs([" ".join(text).encode()])
            assert [(r["start"], r["length"], r["period"]) for r in spans[0] if r["period"] == q] == (
                [(1, length, q)] if length >= 4 * q else [])


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digests(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, found).encode()).hexdigest())


def test_runs_query_equals_brute_force(spark, small_tables):
    found = sorted(tuple(r) for r in QUERIES["op11_runs"](spark, small_tables).collect())
    short = [(i, t) for i, t in given(spark, small_tables) if len(t or "") < 12_000]
    ids = {i for i, _ in short}
    assert [r for r in found if r[0] in ids] == sorted(brute_digests(i, t) for i, t in short)
    assert len(found) == len(given(spark, small_tables)) and sum(r[1] for r in found) > 10


def test_runs_of_odd_rows(docs_of, odd_texts):
    docs = docs_of([(i, t) for i, t in odd_texts if i != 7] + [(20, "a b " * 9 + "a"), (20, "a b " * 9 + "a"), (21, "é é é é é é")])
    docs = docs.withColumnRenamed("component_id", "collapsed")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "collapsed"]
    for r in found.collect():
        words = WORD.findall(r.text or "")
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapse(words, want)
    assert [tuple(x) for r in found.where("doc_id = 20").collect() for x in r.runs] == [(0, 19, 2)] * 2
    long = runs.periodic_runs(docs_of([(7, "word " * 30_000)])).first()
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# --- licences ----------------------------------------------------------------------


def brute_licences(texts, phrases, templates, rare=licences.RARE, need=licences.NEED):
    """(places, matches, words) of each text; all beginnings are tried."""
    every = [*phrases, *templates]
    words = [plain_words(t) for t in texts]
    counts = {w: sum(w in set(d) for d in words) for t in every for w in t.split()}
    found = []
    for own in words:
        places = []
        for t, template in enumerate(every):
            cut = template.split()
            wanted = sorted((counts[w], w, i) for i, w in enumerate(cut) if counts[w])[: 1 if template.exact else rare]
            for start in range(-len(cut), len(own)):
                def at(i):
                    return own[start + i] if 0 <= start + i < len(own) else None  # noqa: B023
                if sum(at(i) == w for _, w, i in wanted) < (1 if template.exact else need):
                    continue
                if all(at(k + i) == w for phrase, k in template.keys() for i, w in enumerate(phrase.split())):
                    places.append((t, (template.label, start, len(cut))))
        found.append((sorted(p for t, p in places if t < len(phrases)), sorted(p for t, p in places if t >= len(phrases)), own))
    return found


def test_licences_of_odd_rows_equal_brute_force(docs_of, odd_texts):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    lines = ["All Rights Reserved. all rights; reserved all rights\nreserved!", "CC BY cc-by cc by-nc", "licensed under CC BY NC 4 0",
             "GNU GENERAL PUBLIC LICENSE general public licence", "licensed under the gnu general public license version 3",
             "under the gnu general public license version 3", "the apache license version 2 0", mit, mit.replace("person", "one"),
             mit.replace("hereby ", ""), mit[30:], "all rights reserved " * 500, "cc bycc by", "Known alſ all rights reserved"]
    rows = odd_texts + [(100 + i, t) for i, t in enumerate(lines)] * 2
    found = sorted((tuple(r) for r in licences.find_licences(docs_of(rows)).collect()), key=str)
    want = []
    for (i, _), (places, matches, words) in zip(rows, brute_licences([t for _, t in rows], licences.PHRASES, licences.TEMPLATES)):
        inside = {k for _, s, n in places + matches for k in range(max(s, 0), min(s + n, len(words)))}
        want.append((i, len(words), places, matches, len(inside) / len(words) if words else 0.0))
    assert sorted([(i, n, [tuple(p) for p in a], [tuple(m) for m in b], s) for i, n, a, b, s in found], key=str) == sorted(want, key=str)
    assert licences.find_licences(docs_of(rows).limit(0)).count() == 0


def test_licences_of_made_texts_equal_brute_force(docs_of):
    rng = random.Random(8)
    phrases = [Template("p", "a b"), Template("q", "a a"), Template("r", "c")]
    templates = [Template("s", "a b c d e f", ("b c", "e f")), Template("t", "d a a b d", ("a a",)), Template("s", "f f f", ("f",))]
    texts = [" ".join(rng.choice("aabbcdef") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join("abcdef"), "a x b c d e f", "b c d e f"]
    found = {r.doc_id: r for r in licences.find_licences(docs_of(list(enumerate(texts))), phrases, templates).collect()}
    for i, (places, matches, _) in enumerate(brute_licences(texts, phrases, templates)):
        assert [tuple(p) for p in found[i].places] == places and [tuple(m) for m in found[i].matches] == matches
    with pytest.raises(ValueError, match="not in the template"):
        Template("x", "a b", ("c",)).keys()


def test_the_licence_scan_runs_no_python(spark, small_tables):
    plan = QUERIES["op12_licences"](spark, small_tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


# --- resampling --------------------------------------------------------------------


def brute_features(text, ngram):
    words = plain_words(text)
    return words, [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, ngram + 1) if i + n <= len(words)]


def brute_resample(docs, target, ngram, buckets, percent, least):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in brute_features(text, ngram)[1]:
                counts[bucket(f)] += 1
    total_s, total_t = sum(s), sum(t)
    gains = [math.floor(1000 * math.log((b + 1.0) * (total_s + buckets) / ((a + 1.0) * (total_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, features = brute_features(text, ngram)
        weight = sum(gains[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = may[: percent * len(may) // 100]
    ranked = [(*r, k) for k, r in enumerate(drawn, 1)]
    left = list(drawn)
    for r in rows:
        if r in left:
            left.remove(r)
        else:
            ranked.append((*r, None))
    return sorted(ranked, key=str)


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_resampling_of_odd_rows_equals_brute_force(spark, docs_of, odd_texts, ngram):
    rng = random.Random(9)
    made = [(200 + i // 2, " ".join(rng.choice(["alpha", "Beta", "gamma", "é", "x1"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows = odd_texts + made + made[:7]
    target = ["Alpha alpha beta", None, "", "the cat — sat", "gamma é"]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = resampling.resample(docs_of(rows), table, ngram, 97, 30, 5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_resample(rows, target, ngram, 97, 30, 5)


def test_resampling_without_rows(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    assert resampling.resample(docs.limit(0), docs).count() == 0
    alone = resampling.resample(docs, docs.limit(0), percent=100, least_words=0).collect()
    assert sorted(r.rank for r in alone) == list(range(1, len(odd_texts) + 1))


def test_resampling_query_equals_brute_force(spark, small_tables):
    found = sorted((tuple(r) for r in QUERIES["op13_resampling"](spark, small_tables).collect()), key=str)
    target = [t for _, t in given(spark, small_tables, "benchmark", "item_id")]
    want = brute_resample(given(spark, small_tables), target, 1, 10_000, 10, 20)
    assert found == sorted(((i, f, w, s, k) for i, _, f, w, s, k in want), key=str)


def test_features_of_one_text_stand_together():
    texts = pa.array(["b a b", None, "", "a"])
    found, features, words = resampling.bucketed(texts, 2, 1 << 20)
    want = [zlib.crc32(f.encode()) % (1 << 20) for f in ("b", "b a", "a", "a b", "b", "a")]
    assert found.tolist() == want and features.tolist() == [5, 0, 0, 1] and np.array_equal(words, [3, 0, 0, 1])

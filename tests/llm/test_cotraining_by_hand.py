"""The quality classifier against a plain version: features counted one by one, fits as weighted least squares, the same exchange."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from ferryline.llm import cotraining
from ferryline.llm.queries import QUERIES

KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:?'\"()-", "!", "#$%&*@^~+=<>{}[]|\\/_`"]


def kind(byte):
    return 9 if byte > 127 else next((k for k, members in enumerate(KINDS, 1) if chr(byte) in members), 0)


def plain_text_view(text):
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    shares = [sum(kind(b) == k for b in raw) / max(len(raw), 1) for k in range(10)]
    ends = Counter(kind(w[-1]) for w in words)
    style = [0.0] * 6
    if words:
        style = [len(raw) / len(words) / 20, len(set(words)) / len(words), 1 - len(set(lines)) / max(len(lines), 1), ends[5] / len(words),
                 (ends[6] + ends[7]) / len(words), len(lines) / len(words)]
    pairs = Counter((a * 31 + b * 17 % 256) % 192 for a, b in zip(raw, raw[1:]))  # the second product is a byte
    norm = math.sqrt(sum(pairs.values())) or 1
    return [*shares, *style, math.log1p(len(raw)) / 10, *[math.sqrt(pairs[k]) / norm for k in range(192)]]


def plain_metadata_view(lang, source, n_chars):
    size = int(min(math.log2(max(n_chars or 0, 0) + 1) // 2.5, 7))
    at = {xxhash.xxh32_intdigest(lang or "") % 8, 8 + xxhash.xxh32_intdigest(source or "") % 64, 72 + size}
    return [float(k in at) for k in range(80)]


def plain_fit(x, y, weight, ridge):
    """Towards the minimum of the penalised log-loss by least squares on working answers.

    Twelve steps, as many as the operator takes: classes that can be told apart
    without error let the last fits go on growing slowly, so its scores are those of that step.
    """
    x, penalty = np.column_stack([x, np.ones(len(x))]), np.array([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        z = x @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        answer = z + weight * (y - p) / w
        rows = np.vstack([x * np.sqrt(w)[:, None], np.diag(np.sqrt(penalty))])
        beta = np.linalg.lstsq(rows, np.append(answer * np.sqrt(w), np.zeros(len(penalty))), rcond=None)[0]
    return lambda v: np.clip(np.column_stack([v, np.ones(len(v))]) @ beta, -30, 30)


def chance(odds):
    return 1 / (1 + np.exp(-odds))


def plain_scores(docs, labels):
    """(text_score, metadata_score, score) by doc_id."""
    ids = sorted(docs, key=lambda i: xxhash.xxh64_intdigest(str(i)))
    views = {"text": np.array([plain_text_view(docs[i][0]) for i in ids]), "meta": np.array([plain_metadata_view(*docs[i][1:]) for i in ids])}
    known = [n for n, i in enumerate(ids) if i in labels]
    fit, aside = [n for k, n in enumerate(known) if k % 4 != 3], known[3::4]
    pool = [n for n, i in enumerate(ids) if i not in labels]
    label = {n: float(labels[ids[n]]) for n in known}
    share = sum(label[n] for n in fit) / len(fit)
    told = {"text": {}, "meta": {}}  # by the other view
    for turn in range(5):
        models = {}
        for view, x in views.items():
            rows = fit + list(told[view])
            y = [label[n] for n in fit] + list(told[view].values())
            models[view] = plain_fit(x[rows], np.array(y), np.array([1.0] * len(fit) + [0.5] * len(told[view])), 1.0)
        if turn == 4:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            good = chance(models[view](views[view]))
            for answer, sure, part in ((1.0, good, share), (0.0, 1 - good, 1 - share)):
                free = [n for n in pool if n not in told["text"] and n not in told["meta"] and sure[n] >= 0.95]
                for n in sorted(free, key=lambda n: -sure[n])[: math.ceil(400 * part)]:
                    told[other][n] = answer
    truth, ones = np.array([label[n] for n in aside]), np.ones(len(aside))
    odds = {view: models[view](views[view])[:, None] for view in views}
    scaled = {view: plain_fit(odds[view][aside], truth, ones, 0.01)(odds[view]) for view in views}
    both = np.column_stack([scaled["text"], scaled["meta"]])
    final = plain_fit(both[aside], truth, ones, 0.01)(both)
    return {i: tuple(map(float, x)) for i, x in zip(ids, zip(chance(scaled["text"]), chance(scaled["meta"]), chance(final)))}


@pytest.mark.parametrize("every", [1, 2])
def test_scores_equal_those_of_the_plain_version(spark, small_tables, every):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    labels = spark.read.parquet(f"{small_tables}/labels.parquet").where(f"doc_id % {every} = 0")  # all, or half: a pool to teach from
    rows = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in rows}
    judged = QUERIES["op3_cotraining"](spark, small_tables) if every == 1 else cotraining.judge(docs, labels)
    found = {r["doc_id"]: r for r in judged.collect()}
    want = plain_scores(rows, known)
    assert set(found) == set(want) and len(set(known.values())) == 2
    for i, scores in want.items():
        assert [found[i]["text_score"], found[i]["metadata_score"], found[i]["score"]] == pytest.approx(scores, abs=2e-3)
        assert found[i]["keep"] == (scores[2] >= 0.5) or abs(scores[2] - 0.5) < 2e-3


@pytest.mark.parametrize("text", [None, "", " ", "One. Two!\nOne. Two!\n\nx_y 12\t", "ünï 日本\r\n", "a"])
def test_features_equal_the_plain_ones(text):
    assert cotraining.text_features(text) == pytest.approx(plain_text_view(text), abs=1e-6)
    for n_chars in (None, -3, 0, 1, 100, 10**9):
        assert list(cotraining.metadata_features(None, text, n_chars)) == plain_metadata_view(None, text, n_chars)

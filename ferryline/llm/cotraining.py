"""A quality classifier by co-training.

Two classifiers see different sides of a document: one its text, one its
metadata (language, source, length).  Each learns from labelled documents; then,
for some rounds, each labels those of an unlabelled pool it is surest of, as
teaching material for the other.  Both are calibrated on labelled documents kept
aside, combined there, and score all documents.

Fitting uses bounded samples (`LABELLED` and `POOL` documents, those with the
least hash of doc_id); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import map_batches

LABELLED = 6_000
POOL = 6_000
ROUNDS = 4
SURE = 0.95  # a pseudo-label needs this much confidence
TAUGHT = 400  # pseudo-labels a view may give in a round
HASHED = 192  # hashed pairs of bytes
SOURCES = 64  # hashed sources
KEEP = 0.5

_CLASS = np.zeros(256, np.int64)  # kinds of bytes
for _kind, _members in enumerate([range(65, 91), range(97, 123), range(48, 58), [32, 9], [10, 13], map(ord, ".,;:?'\"()-"),
                                  [ord("!")], map(ord, "#$%&*@^~+=<>{}[]|\\/_`"), range(128, 256)], 1):
    _CLASS[list(_members)] = _kind
KINDS = 10


def text_features(text: str | None) -> np.ndarray:
    """What the text itself shows: kinds of characters, words, lines and repetition, and hashed pairs of bytes."""
    raw = (text or "").encode()
    out = np.zeros(KINDS + 7 + HASHED, np.float32)
    out[-1 - HASHED] = np.log1p(len(raw)) / 10
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    out[:KINDS] = np.bincount(_CLASS[data], minlength=KINDS) / len(data)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if words:
        ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        kinds = np.bincount(_CLASS[ends], minlength=KINDS) / len(words)
        out[KINDS : KINDS + 6] = [len(raw) / len(words) / 20, len(set(words)) / len(words), 1 - len(set(lines)) / max(len(lines), 1),
                                  kinds[5], kinds[6] + kinds[7], len(lines) / len(words)]
    if len(data) > 1:
        pairs = (data[:-1].astype(np.int32) * 31 + data[1:] * 17) % HASHED
        counts = np.sqrt(np.bincount(pairs, minlength=HASHED))
        out[-HASHED:] = counts / np.linalg.norm(counts)
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known about the page without reading it."""
    out = np.zeros(8 + SOURCES + 8, np.float32)
    out[xxhash.xxh32_intdigest(lang or "") % 8] = 1
    out[8 + xxhash.xxh32_intdigest(source or "") % SOURCES] = 1
    size = np.log2(max(n_chars or 0, 0) + 1)
    out[8 + SOURCES + int(min(size // 2.5, 7))] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with ridge by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), slope)
        beta = beta + step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _odds(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta[:-1] + beta[-1], -30, 30)


@dataclass
class Model:
    """Coefficients of both views, their calibrations and their combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both."""
        views = np.stack([_odds(_odds(text, self.text)[:, None], self.text_scale), _odds(_odds(meta, self.meta)[:, None], self.meta_scale)], 1)
        all_ = np.column_stack([views, _odds(views, self.both)])
        return tuple((1 / (1 + np.exp(-all_))).T)


def cotrain(text: np.ndarray, meta: np.ndarray, good: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model | None:
    """Fit on labelled rows and a pool without labels; every fourth labelled row is for calibration.

    None if the rows for fitting or for calibration don't show both classes.
    """
    aside = np.arange(len(good)) % 4 == 3
    if not all(0 < good[part].sum() < part.sum() for part in (aside, ~aside)):
        return None
    own = {"text": (text[~aside], pool_text), "meta": (meta[~aside], pool_meta)}
    y = good[~aside].astype(float)
    taught = {view: (np.empty(0, np.int64), np.empty(0)) for view in own}  # rows of the pool and their labels
    left = np.ones(len(pool_text), bool)
    for round_ in range(ROUNDS + 1):
        betas = {}
        for view, (x, pool) in own.items():
            rows, labels = taught[view]
            weight = np.concatenate([np.ones(len(y)), np.full(len(rows), 0.5)])
            betas[view] = _fit(np.vstack([x, pool[rows]]), np.concatenate([y, labels]), weight)
        if round_ == ROUNDS:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + np.exp(-_odds(own[view][1], betas[view])))
            for label, sure, share in ((1.0, p, y.mean()), (0.0, 1 - p, 1 - y.mean())):
                found = np.flatnonzero(left & (sure >= SURE))
                found = found[np.argsort(-sure[found], kind="stable")][: int(np.ceil(TAUGHT * share))]
                left[found] = False
                taught[other] = (np.append(taught[other][0], found), np.append(taught[other][1], np.full(len(found), label)))
    kept, ones = good[aside].astype(float), np.ones(int(aside.sum()))
    odds = {"text": _odds(text[aside], betas["text"])[:, None], "meta": _odds(meta[aside], betas["meta"])[:, None]}
    scales = {view: _fit(x, kept, ones, 0.01) for view, x in odds.items()}
    views = np.hstack([_odds(odds[v], scales[v])[:, None] for v in ("text", "meta")])
    return Model(betas["text"], betas["meta"], scales["text"], scales["meta"], _fit(views, kept, ones, 0.01))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [text_features(t) for t in batch.column("text").to_pylist()]
    meta = [metadata_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
    width = len(text_features("")), len(metadata_features("", "", 0))
    return np.array(text, np.float32).reshape(-1, width[0]), np.array(meta, np.float32).reshape(-1, width[1])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def _sample(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of the documents in `ids` (doc_id, good), which are at most `LABELLED` + `POOL`.

    Of rows with one doc_id the one of least hash counts, so that no more reach the driver.
    """
    def run(batch: pa.RecordBatch) -> dict:
        text, meta = _views(batch)
        return {"doc_id": batch.column("doc_id"), "good": batch.column("good"),
                "views": pa.array([r.tobytes() for r in np.hstack([text, meta])], pa.binary())}

    sampled = _plain(docs).join(F.broadcast(ids), "doc_id")
    row = F.struct("text", "lang", "source", "n_chars", "good")
    one = sampled.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(row).alias("hash"), row.alias("row"))).alias("least")).select(
        "doc_id", "least.row.*")
    rows = map_batches(one, run, "doc_id long, good int, views binary").toArrow()
    order = np.lexsort(([xxhash.xxh32_intdigest(v) for v in rows.column("views").to_pylist()],
                        [xxhash.xxh64_intdigest(str(x)) for x in rows.column("doc_id").to_pylist()])) if rows.num_rows else []
    width = len(text_features("")) + len(metadata_features("", "", 0))
    views = np.frombuffer(b"".join(rows.column("views").to_pylist()), np.float32).reshape(-1, width)[order]
    good = np.array(rows.column("good").to_pylist(), float)[order] if rows.num_rows else np.empty(0)
    return views[:, : len(text_features(""))], views[:, len(text_features("")) :], good


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from `docs` and `labels` (doc_id, quality 0 or 1).

    A document labelled both ways counts as bad; rows without id or label don't count.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    by_hash = F.xxhash64("doc_id")
    labelled = ids.join(known, "doc_id").orderBy(by_hash, "doc_id").limit(LABELLED).select("doc_id", F.col("good").cast("int").alias("good"))
    pool = ids.join(known, "doc_id", "left_anti").orderBy(by_hash, "doc_id").limit(POOL).select("doc_id", F.lit(None).cast("int").alias("good"))
    text, meta, good = _sample(docs, labelled.union(pool))
    seen = ~np.isnan(good)
    return cotrain(text[seen], meta[seen], good[seen] > 0, text[~seen], meta[~seen])


def score(docs: DataFrame, model: Model | None, extra: Iterable[str] = ()) -> DataFrame:
    """(doc_id, columns named in `extra`, text_score, metadata_score, score, keep) for each row of `docs`.

    Scores are probabilities of good quality; keep is score >= 0.5.  Without a
    model (labels of one class only, or none) every score is 1 and all is kept.
    Null and empty texts, sources and languages have features of their own; a
    null or negative n_chars counts as 0.  Repeated rows are scored each.
    """
    extra = list(extra)

    def run(batch: pa.RecordBatch) -> dict:
        scores = model.scores(*_views(batch)) if model else (np.ones(batch.num_rows),) * 3
        names = ("text_score", "metadata_score", "score")
        return {c: batch.column(c) for c in ["doc_id", *extra]} | dict(zip(names, map(np.ascontiguousarray, scores))) | {
            "keep": np.asarray(scores[2] >= KEEP)}

    rest = [c for c in extra if c not in ("text", "lang", "source", "n_chars")]
    plain = _plain(docs) if not rest else docs.select(*_plain(docs).columns, *rest)
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *extra])
    return map_batches(plain, run, f"{fields}, text_score double, metadata_score double, score double, keep boolean")


def judge(docs: DataFrame, labels: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Train on the labelled rows of `docs` and score all of them."""
    return score(docs, train(docs, labels), extra)

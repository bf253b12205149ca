"""Quality classifier by co-training of two views.

One classifier sees the text's content (classes of neighbouring bytes, repetition,
word shapes), another the page's metadata (language, source, length, layout).  Both
start from labelled documents; in every round each labels the unlabelled documents it is
sure of for the *other*, and both are fitted again.  Their log-odds are then calibrated
on labelled documents kept out of the training, combined, and used to score every
document.

All unlabelled documents take part.  Their features are written once; a fit is a few
passes over them that sum gradients beside the rows, so the driver sees some hundred
numbers a pass however many documents were exchanged.  A document keeps the label that
it was given first.  How sure a view must be follows from its precision on the labelled
documents kept out, where it must reach ``SURE`` and be no worse than the view it
teaches; one that is not, teaches nothing.  Only the
labelled sample is bounded: ``MOST_LABELLED`` documents, those with the least hashes of
their doc_id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import arrow_map, cut

MOST_LABELLED = 6_000
#: Rounds of exchange, steps of a fit, the precision a view needs to teach, and what given labels of a class weigh beside its true ones.
ROUNDS, STEPS, SURE, GIVEN = 3, 4, 0.97, 1.0
#: One labelled document in so many is kept for calibration.
HELD_OUT = 4
#: A document is rejected if good quality is less likely than this.
THRESHOLD = 0.3

_CLASSES, SOURCES, LANGUAGES, LAYOUT = 14, 32, 8, 15
_COLUMNS = ("text", "lang", "source")


def _byte_classes() -> np.ndarray:
    """A class for every byte: blanks, letters by case, digits, marks, parts of other characters."""
    table = np.full(256, 13, np.uint8)
    for i, group in enumerate((b" ", b"\n\r", b"\t\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz")):
        table[list(group)] = i
    table[65:91], table[48:58] = 5, 6
    for i, group in enumerate((b".,", b"!?", b"|", b"#$%&*@^~", b"'\"-:;()", b"<>[]{}/\\=+_`")):
        table[list(group)] = 7 + i
    return table


_TABLE = _byte_classes()


def content_features(text: str) -> np.ndarray:
    """Frequencies of pairs of byte classes, repetition of words and lines, shapes of words."""
    codes = _TABLE[np.frombuffer(text.encode(), np.uint8)].astype(np.int16)
    pairs = np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=_CLASSES**2) if len(codes) > 1 else np.zeros(_CLASSES**2)
    single = np.bincount(codes, minlength=_CLASSES)
    words = text.split()
    n, lines = len(words), text.split("\n")
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = len(set(words))
    shapes = [
        kinds / n if n else 0.0,
        kinds / math.sqrt(n) / 20 if n else 0.0,
        again / n if n else 0.0,
        len(set(lines)) / len(lines),
        min(len(text) / n if n else 0.0, 40.0) / 10,
    ]
    return np.concatenate([np.sqrt(pairs / max(1, len(codes) - 1)), np.sqrt(single / max(1, len(codes))), shapes])


def metadata_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source by hash, and what a page's record has of its size and layout."""
    out = np.zeros(LANGUAGES + SOURCES + LAYOUT)
    out[zlib.crc32(f"l{lang}".encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32(f"s{source}".encode()) % SOURCES] = 1
    lines, n = text.split("\n"), len(text)
    many, words = len(lines), text.count(" ") + len(lines)
    lengths = np.fromiter(map(len, lines), float, many)
    ends = [x.rstrip()[-1:] for x in lines if x.strip()]
    size = math.log1p(n) / 10
    out[-LAYOUT:] = (
        size,
        size * size,
        math.log1p(many) / 5,
        math.log1p(n / many) / 10,
        float(n == 0),
        len(set(lines)) / many,
        lengths.std() / (lengths.mean() + 1),
        math.log1p(lengths.max()) / 10,
        float((lengths == 0).mean()),
        len(text.encode()) / max(1, n),
        sum(e in ".!?" for e in ends) / max(1, len(ends)),
        math.log1p(words / many) / 10,
        min(n / max(1, words), 40.0) / 10,
        float(text[:1].isupper()),
        sum(x[:1].isspace() for x in lines) / many,
    )
    return out


VIEWS: tuple[Callable[[str, str | None, str | None], np.ndarray], ...] = (lambda text, lang, source: content_features(text), metadata_features)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        # Classes weigh alike, so that a rare one is learned.
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(steps):
            p = _sigmoid(z @ w)
            g = z.T @ (weight * (p - y)) + penalty * w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(h, g)
            w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        return cls(mean, scale, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Teacher:
    """A view's model of one round, and the log-odds from which it is sure of a document that is good, or bad."""

    model: Logistic
    good: float
    bad: float

    def labels(self, x: np.ndarray) -> np.ndarray:
        """1 and 0 where it is sure, else not a number."""
        odds = self.model.log_odds(x)
        return np.where(odds >= self.good, 1.0, np.where(-odds >= self.bad, 0.0, np.nan))


def _sure_from(odds: np.ndarray, right: np.ndarray, pupil: np.ndarray) -> float:
    """Least limit on ``odds`` with a precision of ``SURE`` at or above it, and no more errors than the pupil's; infinite if there is none.

    The precision is that of classes of equal size, with one error more than was seen,
    so that neither a frequent class nor a few documents make a view look sure.
    """
    order = np.argsort(-odds, kind="stable")
    wrong, others = np.cumsum(~right[order]), np.cumsum(~pupil[order])
    n = np.arange(1, len(odds) + 1)
    found, taken = (n - wrong) / max(1, right.sum()), (wrong + 1) / ((~right).sum() + 2)
    good = np.flatnonzero((found >= SURE * (found + taken)) & (wrong <= others) & (odds[order] > 0))
    return float(odds[order[good[-1]]]) if len(good) else math.inf


@dataclass
class CoTrained:
    """Two classifiers, their calibrations, the combination, and how many documents each view was given labels for."""

    models: list[Logistic]
    calibration: list[Logistic]
    combination: Logistic
    exchanged: list[int] = field(default_factory=lambda: [0, 0])

    def probability(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of good quality, by both views, by content, by metadata."""
        odds = [m.log_odds(x) for m, x in zip(self.models, (content, metadata), strict=True)]
        views = np.stack([c.log_odds(o[:, None]) for c, o in zip(self.calibration, odds, strict=True)], axis=1)
        return _sigmoid(self.combination.log_odds(views)), _sigmoid(views[:, 0]), _sigmoid(views[:, 1])


def _numbers(features: np.ndarray) -> bytes:
    return features.astype("<f4").tobytes()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, metadata) for every row of ``docs``: both views' features as 32-bit numbers."""

    def work(rows: dict) -> dict:
        known = list(zip(*(rows[c] for c in _COLUMNS), strict=True))
        out = {name: [_numbers(view(t or "", lang, source)) for t, lang, source in known] for name, view in zip(("content", "metadata"), VIEWS, strict=True)}
        return out | {"doc_id": rows["doc_id"]}

    return arrow_map(docs.select("doc_id", *_COLUMNS), work, "doc_id long, content binary, metadata binary", step=128)


def _pass(unlabelled: DataFrame, teachers: list[list[Teacher]], models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view and class (bad, good) the sums of the gradients of the documents that the other view gave labels for, and their number."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros(len(m.weights) + 1) for _ in range(2)] for m in models]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [_matrix(batch.column(c)) for c in ("content", "metadata")]
            for v, model in enumerate(models):
                given = np.full(batch.num_rows, np.nan)
                for teacher in teachers[1 - v]:
                    given = np.where(np.isnan(given), teacher.labels(x[1 - v]), given)
                known = ~np.isnan(given)
                z = np.hstack([(x[v][known] - model.mean) / model.scale, np.ones((int(known.sum()), 1))])
                error = _sigmoid(z @ model.weights) - given[known]
                for label in (0, 1):
                    at = given[known] == label
                    sums[v][label] += np.append(z[at].T @ error[at], at.sum())
        rows = [(v, label, sums[v][label].tolist()) for v in range(2) for label in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["v", "label", "s"])

    parts = unlabelled.select("content", "metadata").mapInArrow(run, "v int, label int, s array<double>")
    total = parts.select("v", "label", F.posexplode("s").alias("i", "x")).groupBy("v", "label", "i").agg(F.sum("x").alias("x")).collect()
    out = [[np.zeros(len(m.weights) + 1) for _ in range(2)] for m in models]
    for r in total:
        out[r.v][r.label][r.i] = r.x
    return out


def _fit_on(model: Logistic, x: np.ndarray, y: np.ndarray, given: list[np.ndarray], ridge: float = 1.0) -> None:
    """One step of a fit on labelled rows and the gradient sums of given ones, which weigh ``GIVEN`` times as much together.

    The curvature is that of the labelled rows, with a floor.
    """
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    p = _sigmoid(z @ model.weights)
    gradient = z.T @ (weight * (p - y)) + penalty * model.weights
    for sums in given:
        if sums[-1]:
            gradient += sums[:-1] * (GIVEN * 0.5 * len(x) / sums[-1])
    curvature = (z * (weight * np.maximum(p * (1 - p), 0.05))[:, None]).T @ z * (1 + GIVEN) + np.diag(penalty)
    move = np.linalg.solve(curvature, gradient)
    model.weights = model.weights - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))


def co_train(x: list[np.ndarray], labels: np.ndarray, unlabelled: DataFrame | None, rounds: int = ROUNDS) -> CoTrained:
    """Fit on labelled features of both views (labels 0 and 1) and exchange pseudo-labels of ``unlabelled`` (content, metadata)."""
    held = np.arange(len(labels)) % HELD_OUT == 0
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), bool)
    rest = held if held.any() else ~held
    models = [Logistic.fit(v[~held], labels[~held]) for v in x]
    teachers: list[list[Teacher]] = [[], []]
    exchanged = [0, 0]
    for _ in range(rounds if unlabelled is not None else 0):
        odds, good = [models[v].log_odds(x[v][rest]) for v in (0, 1)], labels[rest] > 0
        for v in (0, 1):
            pupil = (odds[1 - v] > 0) == good
            limits = _sure_from(odds[v], good, pupil), _sure_from(-odds[v], ~good, pupil)
            teachers[v].append(Teacher(Logistic(models[v].mean, models[v].scale, models[v].weights), *limits))
        for _ in range(STEPS):
            given = _pass(unlabelled, teachers, models)
            for v in (0, 1):
                if sum(g[-1] for g in given[v]):
                    _fit_on(models[v], x[v][~held], labels[~held], given[v])
        exchanged = [int(sum(g[-1] for g in given[v])) for v in (0, 1)]
    odds = [m.log_odds(v[rest]) for m, v in zip(models, x, strict=True)]
    calibration = [Logistic.fit(o[:, None], labels[rest], ridge=0.1) for o in odds]
    both = np.stack([c.log_odds(o[:, None]) for c, o in zip(calibration, odds, strict=True)], axis=1)
    return CoTrained(models, calibration, Logistic.fit(both, labels[rest], ridge=0.1), exchanged)


def train(found: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-train on a written table of ``features``; None where labels of either class are missing.

    ``labels`` is (doc_id, quality); null labels are no labels, a null doc_id has none.
    Of a doc_id with several labels the least counts, of one with several rows the least.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = found.select("doc_id").where("doc_id is not null").distinct()
    # At most MOST_LABELLED rows of two numbers.
    some = cut(ids.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    rows = found.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("content", "metadata")).alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    quality = np.array([float(r.quality > 0) for r in rows])
    if len(set(quality)) < 2:
        return None
    x = [np.stack([np.frombuffer(r.x[v], "<f4").astype(np.float64) for r in rows]) for v in (0, 1)]
    # Everything that has no label.
    unlabelled = found.join(known.select("doc_id"), "doc_id", "left_anti").select("content", "metadata")
    return co_train(x, quality, cut(unlabelled), rounds)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The op1 report: (doc_id, p_content, p_metadata, p_good, keep) for every row of ``docs``.

    A null text counts as empty, null languages and sources are values of their own,
    repeated rows are scored each.  Without labels of both classes every document is
    kept.  An empty table gives an empty result.
    """
    found = cut(features(docs))
    model = train(found, labels)

    def work(rows: dict) -> dict:
        if model is None or not rows["doc_id"]:
            return {"doc_id": rows["doc_id"]} | dict.fromkeys(("p_content", "p_metadata", "p_good"), [1.0] * len(rows["doc_id"]))
        x = [np.frombuffer(b"".join(rows[c]), "<f4").reshape(len(rows[c]), -1).astype(np.float64) for c in ("content", "metadata")]
        good, a, b = model.probability(*x)
        return {"doc_id": rows["doc_id"], "p_content": a.tolist(), "p_metadata": b.tolist(), "p_good": good.tolist()}

    scored = arrow_map(found, work, "doc_id long, p_content double, p_metadata double, p_good double", step=4096)
    return scored.withColumn("keep", F.col("p_good") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, as ``classify`` has it; columns of any name may stand beside its own."""
    model = train(cut(features(docs)), labels)
    if model is None:
        return docs

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            good: list[float] = []
            for at in range(0, len(columns[0]), 128):
                known = list(zip(*(c.iloc[at : at + 128] for c in columns), strict=True))
                x = [np.stack([np.frombuffer(_numbers(view(t or "", lang, source)), "<f4").astype(np.float64) for t, lang, source in known]) for view in VIEWS]
                good += model.probability(*x)[0].tolist()
            yield pd.Series(good, dtype=float)

    good = F.pandas_udf(score, "double")
    return docs.where(good(*[F.col(c) for c in _COLUMNS]) >= threshold)

"""Quality classifier by co-training of two views.

One classifier sees a document's text (shares of letters, signs, repeated and
distinct words, lines), the other its metadata (language, source, length). Both
learn from labelled rows; in every round each hands the rows of an unlabelled
pool that it is sure of to the other, as pseudo-labels. At the end both views
are calibrated on labelled rows that neither learned from, and a logistic
combination of them, fitted there too, scores all documents.

Fitting uses a bounded sample: ``LABELLED`` labelled and ``POOL`` unlabelled
rows, those with the least hashes of their ids; only their features reach the
driver. Scoring is one pass over all documents without a shuffle.

Defined cases: null texts and lengths count as empty, null languages and
sources are values of their own; null labels and ids with conflicting labels
don't teach; without labels of both kinds every score is the share of good
labels (1 if there is none); rows are scored one by one, so repeated rows
repeat; no row, no result.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import col, fresh, slices

#: Bounds of the sample that is fitted.
LABELLED, POOL = 6000, 6000
#: Rounds of exchange, least calibrated confidence, and most pseudo-labels of a kind in a round.
ROUNDS, CONFIDENT, GROW = 5, 0.95, 300
#: Share of the labelled sample that calibrates, and the least score of documents to keep.
CALIBRATE, KEEP = 0.3, 0.5
LANGUAGES, SOURCES = 16, 64
SLICE_BYTES = 8 << 20
_SIGNS = b"$&%*#|@^~<>{}[]\\=+_`"


def _share_table() -> np.ndarray:
    """Which bytes count for which share: upper, lower, digits, blanks, line feeds, signs, stops, others above 127."""
    table = np.zeros((256, 8))
    for k, letters in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\r\n", _SIGNS, b".,;:!?'\"()-", range(128, 256))):
        table[list(letters), k] = 1
    return table


_SHARES = _share_table()
TEXT_FEATURES = 8 + 10


def text_features(text: str | None) -> np.ndarray:
    """What the content view sees of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _SHARES / max(1, len(raw))
    words = (text or "").split()
    n = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x]
    counts = Counter(words)
    return np.r_[
        shares,
        np.log1p(len(words)),
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        len(text or "") / n,
        max(map(len, words), default=0) / 20,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


def metadata_features(language: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What the metadata view sees of one document."""
    out = np.zeros(LANGUAGES + SOURCES + 2)
    out[zlib.crc32(repr(language).encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    length = np.log1p(max(0, n_chars or 0))
    out[-2:] = length, length * length / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    squares: bool = True
    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z / 4] if self.squares else [np.ones((len(z), 1)), z])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        design = self._design(x)
        penalty = np.full(design.shape[1], self.ridge)
        penalty[0] = 1e-6
        self.weights = np.zeros(design.shape[1])
        for _ in range(25):
            p = _sigmoid(design @ self.weights)
            gradient = design.T @ (y - p) - penalty * self.weights
            curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights


@dataclass
class View:
    """A classifier of one view with its calibration."""

    model: Logistic
    calibration: Logistic

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.margin(self.model.margin(x)[:, None])


@dataclass
class CoTrained:
    """Both views and their combination; ``constant`` where nothing could be learned."""

    text: View | None = None
    metadata: View | None = None
    combination: Logistic | None = None
    constant: float = 1.0
    exchanged: tuple[int, int] = (0, 0)

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata and by both."""
        if self.combination is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        a, b = self.text.logit(text), self.metadata.logit(metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combination.margin(np.c_[a, b]))


def _view(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
    model = Logistic().fit(x, y)
    return View(model, Logistic(squares=False).fit(model.margin(held_x)[:, None], held_y))


def co_train(views: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, confident: float = CONFIDENT, grow: int = GROW) -> CoTrained:
    """Learn from labelled rows in a stable order, and from the pool."""
    good = float(labels.mean()) if len(labels) else 1.0
    held = np.arange(len(labels)) % 10 < round(10 * CALIBRATE)
    if any(len(np.unique(labels[part])) < 2 for part in (held, ~held)):
        return CoTrained(constant=good)
    sets = [([v[~held]], [labels[~held]]) for v in views]
    free, exchanged = np.ones(len(pool[0]), bool), [0, 0]

    def fitted() -> list[View]:
        return [_view(np.vstack(x), np.concatenate(y), v[held], labels[held]) for (x, y), v in zip(sets, views)]

    for _ in range(rounds):
        found = fitted()
        moved = 0
        for k, view in enumerate(found):
            p = _sigmoid(view.logit(pool[k])) if len(pool[k]) else np.zeros(0)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                own = np.flatnonzero(free & (sure >= confident))
                own = own[np.argsort(-sure[own], kind="stable")[:grow]]
                sets[1 - k][0].append(pool[1 - k][own])
                sets[1 - k][1].append(np.full(len(own), label))
                free[own] = False
                moved += len(own)
                exchanged[k] += len(own)
        if not moved:
            break
    text, metadata = fitted()
    logits = np.c_[text.logit(views[0][held]), metadata.logit(views[1][held])]
    return CoTrained(text, metadata, Logistic(squares=False).fit(logits, labels[held]), good, tuple(exchanged))


@dataclass(frozen=True)
class Columns:
    """Where a document's parts stand."""

    id: str = "doc_id"
    text: str = "text"
    language: str = "lang"
    source: str = "source"
    n_chars: str = "n_chars"


def _features_of(batch: pa.RecordBatch, c: Columns) -> tuple[np.ndarray, np.ndarray]:
    text = [text_features(t) for t in batch.column(c.text).to_pylist()]
    meta = [metadata_features(*row) for row in zip(*(batch.column(n).to_pylist() for n in (c.language, c.source, c.n_chars)))]
    return np.array(text).reshape(len(text), TEXT_FEATURES), np.array(meta).reshape(len(meta), LANGUAGES + SOURCES + 2)


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "quality", columns: Columns = Columns(), labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Fit on the bounded sample of ``docs``."""
    c = columns
    taught = labels.select(col(c.id).alias("key"), col(label_column).cast("double").alias("label")).where("key IS NOT NULL AND label IS NOT NULL")
    agreed = taught.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    known = agreed.orderBy(F.xxhash64("key"), "key").limit(labelled)
    ids = docs.select(col(c.id).alias("key")).where("key IS NOT NULL").distinct()
    others = ids.orderBy(F.xxhash64("key", F.lit("pool")), "key").limit(pool).join(F.broadcast(known), "key", "left_anti")
    sample = F.broadcast(known.unionByName(others.withColumn("label", F.lit(None).cast("double"))))  # bounded by both limits
    rows = docs.select(*[col(n).alias(n) for n in (c.id, c.text, c.language, c.source, c.n_chars)]).join(sample, col(c.id) == F.col("key"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, c.text, SLICE_BYTES):
            text, meta = _features_of(batch, c)
            order = pa.array(text.sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("label"), pa.array(text.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.float64())), order], names=["key", "label", "text", "meta", "tie"])

    featured = rows.mapInArrow(features, "key string, label double, text array<double>, meta array<double>, tie double")
    # repeated ids count once, by the least of their rows; tasks reduce them first, so an id with very many rows sends few
    least = featured.groupBy("key").agg(F.min(F.struct("tie", "text", "meta", "label")).alias("row")).select("key", "row.*")
    # the same order in every run, whatever partition a row came from
    unique = sorted(least.collect(), key=lambda r: (zlib.crc32(r["key"].encode()), r["key"]))
    parts = [[r for r in unique if (r["label"] is None) == unknown] for unknown in (False, True)]
    views, open_pool = [[np.array([r[k] for r in part], np.float64).reshape(len(part), n) for k, n in (("text", TEXT_FEATURES), ("meta", LANGUAGES + SOURCES + 2))] for part in parts]
    return co_train(views, np.array([float(r["label"] > 0) for r in parts[0]]), open_pool)


def scored(docs: DataFrame, model: CoTrained, columns: Columns = Columns()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``text_score``, ``metadata_score`` and ``score`` (under fresh names, returned by role)."""
    names = dict(zip(("text_score", "metadata_score", "score"), fresh(docs, "text_score", "metadata_score", "score")))
    c = columns

    # by place, since a column may have any name
    plain = [f"c{i}" for i in range(len(docs.columns))]
    place = Columns(*[plain[docs.columns.index(n)] for n in (c.id, c.text, c.language, c.source, c.n_chars)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place.text, SLICE_BYTES):
            found = model.scores(*_features_of(batch, place))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in found)], names=[*batch.schema.names, *names])

    rows = docs.toDF(*plain)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), *(T.StructField(role, T.DoubleType()) for role in names)])
    return rows.mapInArrow(run, schema).toDF(*docs.columns, *names.values()), names


def accepted(docs: DataFrame, model: CoTrained, columns: Columns = Columns(), least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is high enough, as they were."""
    rows, names = scored(docs, model, columns)
    return rows.where(keep(F.col(names["score"]), least)).select(*[col(n) for n in docs.columns])


def keep(score: Column, least: float = KEEP) -> Column:
    return score >= least

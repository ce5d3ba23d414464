"""Quality rules: counts with fixed limits, and a calibrated linear classifier over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, covered, id_and_text, per_text, portions, rolled, small_batches, word_hashes
from colonnade.llm.samples import labelled_sample

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Base limits: at least so many words, and at most this percentage of them in repeated windows.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
#: A document is kept where its calibrated probability of label 1 is at least this.
LEAST_QUALITY = 0.5
#: Labelled rows learnt from at most, and the longest text among them in bytes.
SAMPLE_ROWS = 4_000
SAMPLE_TEXT_BYTES = 1 << 17
#: Hashed features of each of the four kinds: words, word pairs, 3 and 4 bytes.
BUCKET_BITS = 13
KINDS = 4


@dataclass
class Texts:
    """A batch of texts as bytes, with the word hashes of all and where each text's words start."""

    raw: list[bytes]
    hashes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        raw = [t.encode() for t in texts]
        split = [r.split() for r in raw]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        return cls(raw, word_hashes([w for s in split for w in s]), starts)

    def words(self, k: int) -> np.ndarray:
        return self.hashes[self.starts[k] : self.starts[k + 1]]

    def buckets(self, k: int) -> np.ndarray:
        """The features of a text, kind after kind, each as often as it occurs, with the share each stands for."""
        words = self.words(k)
        data = np.frombuffer(self.raw[k], np.uint8).astype(np.uint32)
        kinds = [
            (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64),
            (rolled(words, 2) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64),
        ]
        with np.errstate(over="ignore"):
            three = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else data[:0]
            four = (three[:-1] << 8 | data[3:]) if len(data) > 3 else data[:0]
            kinds += [((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64) for x in (three, four)]
        return kinds


def base_counts(texts: list[str], batch: Texts) -> dict[str, list]:
    n_words, word_chars, n_symbols, n_dup, n_repeat, failed = [], [], [], [], [], []
    for k, (text, raw) in enumerate(zip(texts, batch.raw)):
        words = batch.words(k)
        lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
        windows = rolled(words, REPEAT_WINDOW)
        repeated = 0
        if len(windows) > 1:
            _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
            if len(counts) < len(windows):
                repeated = int(covered(np.flatnonzero(counts[inverse] > 1), REPEAT_WINDOW, len(words)).sum())
        n_words.append(len(words))
        word_chars.append(len(text) - (len(raw) - len(raw.translate(None, SPACE))))
        n_symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        n_dup.append(len(lines) - len(set(lines)))
        n_repeat.append(repeated)
        failed.append(len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat, "base_failed": failed,
    }


@dataclass
class Linear:
    """Weights by kind and bucket; the calibrated probability is that of `slope` times the sum plus `shift`."""

    weights: np.ndarray
    slope: float
    shift: float

    def raw_scores(self, batch: Texts) -> np.ndarray:
        out = np.zeros(len(batch.raw))
        for k in range(len(batch.raw)):
            for weights, buckets in zip(self.weights, batch.buckets(k)):
                if len(buckets):
                    out[k] += weights[buckets].mean()
        return out

    def probabilities(self, batch: Texts) -> np.ndarray:
        return _logistic(self.slope * self.raw_scores(batch) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(index: np.ndarray, value: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray,
        rounds: int = 200, stretch: int = 1 << 19) -> Linear:
    """Logistic regression with a little shrinkage on four fifths of the rows, calibrated on the fifth.

    Row after row, `lengths` of the features `index` have the shares `value`.  A round adds up the gradient over
    stretches of rows with about so many features, so that only one stretch exists in working copies."""
    rows = len(labels)
    width = KINDS << BUCKET_BITS
    if rows == 0 or len(set(labels.tolist())) < 2:
        return Linear(np.zeros((KINDS, 1 << BUCKET_BITS)), 0.0, 8.0)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], stretch)), [0, rows])).tolist()
    parts = list(zip(cuts, cuts[1:]))
    learn = np.arange(rows) % 5 != 0
    held = np.where(learn, weights / weights[learn].sum(), 0)
    w, bias = np.zeros(width), 0.0

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(ends[a], ends[b])
        row = np.repeat(np.arange(b - a, dtype=np.int32), lengths[a:b])
        return row, np.bincount(row, value[part] * w[index[part]], b - a)

    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        gradient = np.append(1e-7 * w, 0.0)
        for a, b in parts:
            part = slice(ends[a], ends[b])
            row, raw = sums(a, b)
            error = (_logistic(raw + bias) - labels[a:b]) * held[a:b]
            gradient[:-1] += np.bincount(index[part], value[part] * error[row], width)
            gradient[-1] += error.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    raw = np.concatenate([sums(a, b)[1] for a, b in parts])
    slope, shift = _calibrated(raw[~learn], labels[~learn], weights[~learn], bias)
    return Linear(w.reshape(KINDS, -1), slope, shift)


def _calibrated(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets (Platt), from scores the model has not learnt from."""
    if len(set(labels.tolist())) < 2:
        return 1.0, bias
    scale = max(float(np.abs(raw).max()), 1e-9)
    x = np.stack([raw / scale, np.ones(len(raw))], 1)
    positive, negative = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    beta = np.array([1.0 * scale, bias])
    share = weights / weights.sum()
    for _ in range(50):
        p = _logistic(x @ beta)
        gradient = x.T @ (share * (p - target)) + 1e-6 * (beta - [scale, bias])
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - step / max(1.0, np.abs(step).max() / 10)
    if beta[0] <= 0:
        return 1.0, bias
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
          text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> Linear:
    """The classifier, from at most `sample_rows` labelled documents; their features are counted in parallel and learnt from in one task."""
    chosen = labelled_sample(docs, labels, label_column, sample_rows, SAMPLE_TEXT_BYTES, id_column, text_column)

    def features(batches):
        for whole in batches:
            for part in portions(whole):
                batch = Texts.of(part.column("text").to_pylist())
                index, value = [], []
                for k in range(len(batch.raw)):
                    found = [np.unique(b, return_counts=True) for b in batch.buckets(k)]
                    index.append(np.concatenate([i + (kind << BUCKET_BITS) for kind, (i, _) in enumerate(found)]))
                    value.append(np.concatenate([n / max(1, n.sum()) for _, n in found]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), part.column("label"), part.column("weight"),
                     pa.array([i.astype(np.int32).tobytes() for i in index], pa.binary()),
                     pa.array([v.tobytes() for v in value], pa.binary())],
                    ["id", "label", "weight", "index", "value"],
                )

    found = chosen.mapInArrow(features, "id string, label int, weight double, index binary, value binary")

    def learn(batches):
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([("id", "ascending"), ("label", "ascending")])
        known = rows.column("label").to_numpy().astype(float), rows.column("weight").to_numpy()
        lengths = pc.binary_length(rows.column("index")).to_numpy().astype(np.int64) // 4
        index, value = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])
            for name, kind in (("index", np.int32), ("value", np.float32))
        )
        model = fit(index, value, lengths, *known)
        yield pa.RecordBatch.from_pydict(
            {"weights": [model.weights.tobytes()], "slope": [model.slope], "shift": [model.shift]}
        )

    # The sample is bounded, so one task holds it; the driver gets the weights alone.
    row = found.repartition(1).mapInArrow(learn, "weights binary, slope double, shift double").first()
    if row is None:
        return fit(*[np.zeros(0, np.int32)] * 3, np.zeros(0), np.zeros(0))
    return Linear(np.frombuffer(row["weights"]).reshape(KINDS, -1), row["slope"], row["shift"])


def judge(docs: DataFrame, model: Linear, least: float = LEAST_QUALITY, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """For every row the id, the base counts (`n_words`, `word_chars`, `n_symbols`, `n_dup_lines`,
    `n_repeat_words`), `base_failed`, `quality` (probability of label 1) and `kept` (base not failed and
    `quality` at least `least`).

    A null or empty text has no words and fails the base; a text without a single n-gram gets the probability of
    a zero sum; equal rows and null ids give a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scorer = shared.value

        def compute(texts: list[str]) -> dict[str, list]:
            batch = Texts.of(texts)
            counts = base_counts(texts, batch)
            quality = scorer.probabilities(batch)
            kept = [not f and bool(q >= least) for f, q in zip(counts["base_failed"], quality)]
            return counts | {"quality": quality.tolist(), "kept": kept}

        return compute

    return per_text(
        id_and_text(docs, id_column, text_column), prepare,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "quality double, kept boolean",
        id_column,
    )


def keep_good(docs: DataFrame, model: Linear, least: float = LEAST_QUALITY, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that `judge` would keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Only texts travel to Python and only verdicts come back.
        scorer = shared.value
        for whole in batches:
            kept: list[bool] = []
            for at in range(0, len(whole), 250):
                texts = whole.iloc[at : at + 250].tolist()
                batch = Texts.of(texts)
                failed = base_counts(texts, batch)["base_failed"]
                kept += [not f and bool(q >= least) for f, q in zip(failed, scorer.probabilities(batch))]
            yield pd.Series(kept, dtype=bool)

    return small_batches(docs).filter(good(F.coalesce(column(text_column).cast("string"), F.lit(""))))

"""Quality classifier by positive-unlabelled learning.

The model sees trusted positives (documents marked good outside the held-out fold) and unlabelled
text (any documents). The class prior is estimated from the scores of a first positive-against-
unlabelled fit: the least ratio of unlabelled to positive mass above any cut of the score.
The final fit minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, by full-batch gradient steps; where the second term is negative, the step
goes against it, as published. A logistic map fitted on labelled training rows turns the margin into
a probability. The fit uses bounded samples of rows (``bound`` positives, ``bound`` unlabelled); every
document is scored.

Inputs of a score are form features of the whole text: rates of symbols, capitals, digits, repeated
words and lines, lengths. Each is cut at quantiles of the sample and one-hot coded, so the model is
additive and needs no scaling.

Cases: a null or empty text has the features of an empty text and gets a score like any other. Rows
that repeat a key are scored row by row; several labels of one key count by majority. Null keys are
scored but never learnt from. Without trusted positives every score is 0.5 (``keep`` then keeps all). Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.cells import ALNUM, FEW_BYTES, SPACE, Texts, owner, per_text, repeated, slices, windows
from clickloom.llm.labelled import held_out, thinned, train_labels
from clickloom.session import scratch_path

FEATURES = [
    "log_words", "word_bytes", "symbols", "bangs", "upper", "digits", "punctuation", "non_ascii", "pipes",
    "dup_lines", "line_words", "repeat_words", "next_same", "distinct", "short", "long", "symbol_ends", "edges",
]
_B = np.arange(256)
_SETS = {
    "symbols": np.isin(_B, [*b"#*$%&<>@^~_=+\\{}[]"]),
    "bangs": np.isin(_B, [*b"!?"]),
    "upper": (_B >= 65) & (_B <= 90),
    "digits": (_B >= 48) & (_B <= 57),
    "punctuation": np.isin(_B, [*b".,;:'\"()-"]),
    "non_ascii": _B >= 128,
    "pipes": _B == 124,
}
BINS = 12
FOLDS, HELD_OUT = 4, 2
BOUND = 20_000


def form_features(texts: Texts) -> np.ndarray:
    """One row of features per text."""
    start, end, ptr = texts.runs(~SPACE)
    h, doc = texts.hashes(start, end), owner(ptr)
    words = np.maximum(np.diff(ptr), 1)
    size = np.maximum(np.diff(texts.offs), 1)
    length = end - start
    lines, line_end, line_ptr = texts.runs(_B != 10)
    dup = repeated(texts.hashes(lines, line_end), owner(line_ptr))[1]
    three, first = windows(h, ptr, 3)
    again = repeated(three, doc[first])[0]
    seen_before = repeated(h, doc)[1]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    ends_odd = ~ALNUM[texts.raw[end - 1]] & ~_SETS["punctuation"][texts.raw[end - 1]] if len(end) else np.zeros(0, bool)
    n_lines = np.maximum(np.diff(line_ptr), 1)
    columns = [
        np.log1p(np.diff(ptr)),
        per_text(length, ptr) / words,
        *(texts.count(table) / size for table in _SETS.values()),
        per_text(dup, line_ptr) / n_lines,
        np.log1p(words / n_lines),
        np.bincount(doc[first[again]], minlength=texts.n) / words,
        per_text(same, ptr) / words,
        1.0 - per_text(seen_before, ptr) / words,
        per_text(length <= 3, ptr) / words,
        per_text(length >= 12, ptr) / words,
        per_text(ends_odd, ptr) / words,
        texts.count(SPACE) / size,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the features of every text in one pass."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, FEW_BYTES):
                x = form_features(Texts(part.column(text)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], names=[key, "x"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, x array<float>")


@dataclass
class Model:
    """Cut points per feature, additive weights of the bins, prior and the map to a probability."""

    cuts: list
    weights: np.ndarray
    prior: float
    slope: float
    shift: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.weights[-1])
        at = 0
        for j, cuts in enumerate(self.cuts):
            out += self.weights[at + np.searchsorted(cuts, x[:, j], "right")]
            at += len(cuts) + 1
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(x) + self.shift, -40, 40)))


def _one_hot(x: np.ndarray, cuts: list) -> np.ndarray:
    blocks = []
    for j, c in enumerate(cuts):
        blocks.append(np.searchsorted(c, x[:, j], "right")[:, None] == np.arange(len(c) + 1))
    return np.concatenate([*blocks, np.ones((len(x), 1), bool)], axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def non_negative_fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative positive-unlabelled risk (logistic loss, Adam steps)."""
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        # d/dz log(1 + e^-z) = -sigmoid(-z); d/dz log(1 + e^z) = sigmoid(z)
        pull = -(p.T @ _sigmoid(-zp)) / len(p)
        push_p, push_u = p.T @ _sigmoid(zp) / len(p), u.T @ _sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = prior * pull + (push_u - prior * push_p) if negative >= 0 else -(push_u - prior * push_p)
        g = g + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Share of positives in the unlabelled scores: least ratio of upper tails, with a margin for chance."""
    cuts = np.quantile(sp, np.linspace(0.02, 0.9, 45))
    tail_p = np.array([(sp >= c).mean() for c in cuts])
    tail_u = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2 / max(len(su), 1)) + np.sqrt(np.log(40) / 2 / max(len(sp), 1))
    best = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of y ~ sigmoid(slope z + shift) by Newton steps, with a weak prior on the counts."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        q = _sigmoid(a * z + b)
        d, s = q - target, np.maximum(q * (1 - q), 1e-9)
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_arrays(pos: np.ndarray, unl: np.ndarray, lab_x: np.ndarray, lab_y: np.ndarray) -> Model:
    """Fit from feature rows: trusted positives, unlabelled rows, and labelled rows for the last map."""
    both = np.concatenate([pos, unl])
    cuts = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(both.shape[1])]
    # the tails decide: cut also where only a few rows lie above
    cuts = [np.unique(np.concatenate([c, np.quantile(both[:, j], [0.02, 0.98])])) for j, c in enumerate(cuts)]
    p, u = _one_hot(pos, cuts), _one_hot(unl, cuts)
    half = len(p) // 2 or 1
    first = non_negative_fit(p[:half], u, 0.5, steps=150)
    prior = estimate_prior(p[half:] @ first if len(p) > half else p @ first, u @ first)
    model = Model(cuts, non_negative_fit(p, u, prior), prior, 1.0, 0.0)
    if len(lab_y) and 0 < lab_y.sum() < len(lab_y):
        model.slope, model.shift = _logistic(model.margins(lab_x), lab_y.astype(float))
    return model


def _rows(df: DataFrame) -> np.ndarray:
    table = df.toArrow()
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(FEATURES)).astype(np.float64)


def fit(found: DataFrame, train: DataFrame, key: str = "doc_id", bound: int = BOUND) -> Model | None:
    """Fit on samples of at most about ``bound`` positives and ``bound`` unlabelled rows.

    ``found``: (key, x) of all documents; ``train``: (_key, _label) outside the held-out fold.
    """
    labelled = found.join(train, F.col(key) == F.col("_key"))
    counts = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    classes = {c: _rows(thinned(labelled.filter(F.col("_label") == c), key, bound, "pu", n)) for c, n in counts.items()}
    unl = _rows(thinned(found.filter(F.col(key).isNotNull()), key, bound, "unlabelled"))
    # the labelled rows of the last map keep their natural shares
    share = min(1.0, *(len(classes[c]) / n for c, n in counts.items()))
    kept = {c: x[: int(np.ceil(share * counts[c]))] for c, x in classes.items()}
    lab_x = np.concatenate([kept[c] for c in kept])
    lab_y = np.concatenate([np.full(len(kept[c]), c) for c in kept])
    return fit_arrays(classes[1], unl, lab_x, lab_y)


def score(found: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Add ``score`` to every row of (key, x)."""
    kind = dict(found.select(key).dtypes)[key]
    width = len(FEATURES)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            s = model.scores(x) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(s)], names=[key, "score"])

    return found.select(key, "x").mapInArrow(run, f"`{key}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = BOUND, threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every document; features are written once and read twice."""
    spark = docs.sparkSession
    path = scratch_path(spark, "form-features")
    features(docs, key, text).write.parquet(path)
    found = spark.read.parquet(path)
    train = train_labels(labels, key, label, FOLDS, HELD_OUT)
    model = fit(found, train, key, bound)
    out = score(found, model, key)
    return out.select(
        key,
        held_out(key, FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = BOUND, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    After the fit a second pass scores whole rows in place, so texts are not shuffled.
    """
    path = scratch_path(docs.sparkSession, "form-features")
    features(docs, key, text).write.parquet(path)
    model = fit(docs.sparkSession.read.parquet(path), train_labels(labels, key, label, FOLDS, HELD_OUT), key, bound)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, FEW_BYTES):
                yield part.filter(pa.array(model.scores(form_features(Texts(part.column(text)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)

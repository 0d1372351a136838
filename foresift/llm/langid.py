"""Language identification (operator 2): sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (everything but letters is a space) are hashed to a fixed number of features.
Document frequencies come from all training rows; the weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded random sample of labelled rows (`sample_rows`, the same share of rows for each language up to its
part of the bound), and a temperature is calibrated on a fifth of that sample which the fit does not see.

Defined cases: a null text or one without any letter is `und` with score 0; without labelled rows everything is `und`;
texts count whole, however long; ties between languages go to the first in alphabetical order; repeated rows are predicted
alike; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import arrow_schema, map_rows, release_caches

FEATURES = 1 << 15
ORDERS = 3
SAMPLE_ROWS = 4_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(1 << 16)], dtype=bool)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature ids and dampened counts of a text; None without a letter."""
    if not text:
        return None
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        letter[far] = [chr(c).isalpha() for c in codes[far]]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter | np.concatenate([[True], letter[:-1]])       # one space for each gap
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    ids, acc = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(ORDERS):
        m = len(codes) - n
        acc = acc[:m] * np.uint32(0x01000193) + codes[n:] + np.uint32(1 + n)
        ids.append((acc * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15))
    counts = np.bincount(np.concatenate(ids), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, np.log1p(counts[at])


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    f = features(text)
    if f is None:
        return None
    value = f[1] * idf[f[0]]
    norm = np.sqrt((value * value).sum())
    return (f[0], value / norm) if norm else f


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray         # features x languages
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text, self.idf)
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(x[1] @ self.weights[x[0]] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(xs: list, ys: np.ndarray, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
             l2: float = 0.05, epochs: int = 3, seed: int = 0) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) with per-coordinate rates; weights under the l1 penalty stay exactly 0."""
    z = np.zeros((FEATURES, n_classes))
    n = np.zeros((FEATURES, n_classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            at, value = xs[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = softmax(value @ w)
            error[ys[i]] -= 1.0
            g = value[:, None] * error
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm.

    Targets are smoothed by 1 / (rows + 2), so that a sample without errors does not give certainty.
    """
    if not len(ys):
        return 1.0
    wrong = 1.0 / (len(ys) + 2)
    target = np.full(logits.shape, wrong / max(logits.shape[1] - 1, 1))
    target[np.arange(len(ys)), ys] = 1.0 - wrong

    def loss(u):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(axis=1).mean()

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Number of documents with each feature, and of all with any, over the whole table; tasks send one vector each."""
    schema, arrow = arrow_schema("v binary")

    def count(batches):
        release_caches()
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                f = features(text.as_py())
                if f is not None:
                    total[f[0]] += 1
                    total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=arrow)

    def add(batches):
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=arrow)

    parts = docs.select(text_col).mapInArrow(count, schema).repartition(8).mapInArrow(add, schema).collect()
    total = sum((np.frombuffer(r[0], dtype=np.int64) for r in parts), np.zeros(FEATURES + 1, dtype=np.int64))
    return total[:-1], int(total[-1])


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on the rows with a language. Only text and language are used; the id only draws the sample by its hash."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col), F.col(text_col), F.col(lang_col))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}       # one row for each language
    langs = sorted(counts)
    df, n = document_frequencies(rows, text_col)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    if not langs:
        return LanguageModel([], np.zeros((FEATURES, 0)), idf, 1.0)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, min(1.0, sample_rows / len(langs) / counts[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select(text_col, lang_col, draw.alias("_draw")).repartition(1)
    schema, arrow = arrow_schema("weights binary, temperature double")

    def fit(batches):
        found = []
        for batch in batches:
            for text, lang, at in zip(*(c.to_pylist() for c in batch.columns)):
                x = vector(text, idf)
                if x is not None:
                    found.append((at, lang, len(x[0]), x))
        found.sort(key=lambda r: r[:3])         # the same order whichever task wrote first
        ys = np.array([langs.index(r[1]) for r in found], dtype=np.int64)
        held = np.array([int(r[0] * (1 << 30)) % 5 == 0 for r in found], dtype=bool)
        xs = [r[3] for r in found]
        w = fit_ftrl([x for x, h in zip(xs, held) if not h], ys[~held], len(langs))
        logits = np.array([x[1] @ w[x[0]] for x, h in zip(xs, held) if h]).reshape(-1, len(langs))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()),
                                          pa.array([fit_temperature(logits, ys[held])], pa.float64())], schema=arrow)

    got = sample.mapInArrow(fit, schema).first()
    weights = np.frombuffer(got[0], dtype=np.float32).reshape(FEATURES, len(langs)).astype(np.float64)
    return LanguageModel(langs, weights, idf, got[1])


def predict_language(docs: DataFrame, model: LanguageModel, cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The given columns (all by default) with `lang_pred` and `score`."""
    cols = list(docs.columns if cols is None else cols)
    keep = [docs.schema[c] for c in cols]
    shared = docs.sparkSession.sparkContext.broadcast(model)       # its size is fixed: features x languages

    def make():
        m = shared.value

        def run(columns):
            got = [m.predict(t) for t in columns[-1]]
            return [*columns[:-1], [g[0] for g in got], [g[1] for g in got]]
        return run
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    return map_rows(docs, [*cols, text_col], ddl, make)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that the query never learns from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1

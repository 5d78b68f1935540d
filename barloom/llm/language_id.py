"""Language identification with error-correcting output codes.

Each language has a codeword; binary classifiers over hashed n-grams of bytes
predict its bits.  Decoding adds, over the bits, the logistic loss of the
predicted margin against a codeword's bit, weighted by how well the bit was
learned, and takes the codeword with the least loss.  A small gap to the
second codeword flags the document as ambiguous.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
#: Bound of the training sample: documents of a language that are fitted on.
SAMPLE_PER_LANGUAGE = 500
#: Posterior gap between the best two codewords under which a document is ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"
PREDICTED = "lang_pred string, score double, ambiguous boolean"

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS_ONLY = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte bigrams and trigrams of the letters, scaled to length 1."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    codes = [(two * np.uint32(2654435761)) >> np.uint32(20)]
    if len(b) > 2:
        codes.append(((two[:-1] * np.uint32(257) + b[2:]) * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(20))
    x = np.sqrt(np.bincount(np.concatenate(codes), minlength=DIMENSIONS))
    return (x / max(np.linalg.norm(x), 1e-9)).astype(np.float32)


def code_matrix(languages: int) -> np.ndarray:
    """Codewords in rows, bits of -1 and 1.

    Up to 6 languages: every split into two groups.  More: the best separated
    of 200 seeded random codes of 15 bits for each doubling of the languages.
    """
    if languages <= 6:
        splits = [[1 - 2 * (s >> k & 1) for k in range(languages)] for s in range(1, 2 ** (languages - 1))]
        return np.asarray(splits or [[1]], dtype=np.float32).reshape(-1, languages).T
    rng, bits = np.random.default_rng(42), 15 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1.0
    for _ in range(200):
        code = rng.choice(np.asarray([-1, 1], np.float32), (languages, bits))
        near = ((bits - code @ code.T) / 2 + np.eye(languages) * bits).min()
        if near > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, near
    return best if best is not None else code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None, ambiguous: float = AMBIGUOUS) -> tuple[str, float, bool]:
        """(language, posterior, ambiguous); a null text or one without a letter is und with score 0."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        margin = (features(text) @ self.weights + self.bias) * 2.0
        loss = np.logaddexp(0, -self.code * margin) @ self.trust
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        gap = odds[order[0]] - odds[order[1]] if len(order) > 1 else 1.0
        return self.languages[order[0]], float(odds[order[0]]), bool(gap < ambiguous)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120) -> LanguageModel:
    """Logistic regressions for all bits at once, by accelerated gradient; classes weigh alike."""
    code = code_matrix(len(languages))
    target = code[y]
    weight = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for k in range(steps):
        look_w, look_b = w + 0.9 * vw, b + 0.9 * vb
        push = weight * target / (1 + np.exp(target * (x @ look_w + look_b)))
        vw, vb = 0.9 * vw + rate * (x.T @ push - 1e-4 * look_w), 0.9 * vb + rate * push.sum(0)
        w, b = w + vw, b + vb
    right = (weight * (np.sign(x @ w + b) == target)).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a sample of at most about ``per_language`` whole texts of each label.

    The rows are taken by a hash of the id, so the sample does not depend on
    the layout.  Rows with a null text or label are left out; without any row
    the model knows no language and every prediction is und.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).filter("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    share = F.element_at(F.create_map(*[F.lit(v) for l, n in sorted(counts.items()) for v in (l, min(1.0, per_language / n))]), F.col("l"))
    chance = F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = [features(t).astype(np.float16).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), part.column(1)], names=["x", "l"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((l, x) for batch in batches for x, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        seen = sorted({l for l, _ in found})
        if seen:
            x = np.frombuffer(b"".join([v for _, v in found]), dtype=np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
            model = fit(x, np.asarray([seen.index(l) for l, _ in found]), seen)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task fits the model and the driver gets only that
    sample = rows.filter(chance < share).select("t", "l").mapInArrow(run, "x binary, l string")
    found = sample.repartition(1).mapInArrow(fit_all, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else LanguageModel([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with lang_pred, score and ambiguous, of whole texts.

    Former columns of these three names are replaced; an empty table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    # not deterministic to the planner: filters on the result must not predict again
    udf = F.pandas_udf(run, PREDICTED).asNondeterministic()
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    found = docs.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)], udf(F.col(text_col)).alias("__found"))
    return found.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(keep)], "__found.lang_pred", "__found.score", "__found.ambiguous")


def text_crc(column):
    """crc32 of a column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))

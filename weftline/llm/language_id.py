"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, held_out, in_batches

#: Hashed character n-grams (bytes of the lower-cased text, n = 1 to 3) and labelled texts of each language that are learned from.
BUCKETS, SAMPLE_PER_LANGUAGE = 1 << 13, 400
UNDETERMINED = "und"
#: Bytes of a text that are counted at once.
_CHUNK = 1 << 20
#: Families of language codes; a code that is absent is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "indo_aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Letters of ASCII and all bytes of other characters stay, anything else is a blank.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); numerals such as one half or Roman eight are none."""
    return any(map(str.isalpha, text))


def family(code: str) -> str:
    return _FAMILY.get(code.lower().replace("_", "-").split("-")[0], code)


def features(text: str) -> np.ndarray:
    """Unit vector of damped n-gram counts over the whole text (float32, ``BUCKETS`` long)."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(raw) - 2), _CHUNK):
        b = np.frombuffer(raw[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        two = (b[:-1] << 8) | b[1:]
        three = (two[:-1] << 8) | b[2:]
        for grams, salt in ((b[1:-1], 0x9E3779B1), (two[:-1], 0x85EBCA77), (three, 0xC2B2AE3D)):
            counts += np.bincount(((grams + 1) * np.uint32(salt)) >> np.uint32(19), minlength=BUCKETS)
    x = np.sqrt(counts, dtype=np.float32)
    norm = float(np.sqrt(counts.sum()))
    return x / norm if norm else x


@dataclass
class LinearSvm:
    """A separating plane; the margin is positive for the first of two classes."""

    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> float:
        return float(x @ self.weights) + self.bias


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 25, seed: int = 0) -> LinearSvm:
    """L2-regularised hinge loss by dual coordinate ascent; classes weigh alike whatever their sizes. y is +1 or -1."""
    rng, n = np.random.default_rng(seed), len(y)
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    most = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    square, alpha, w = (x * x).sum(1), np.zeros(n), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            now = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), most[i])
            if (step := now - alpha[i]) != 0:
                w += np.float32(step * y[i]) * x[i]
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return LinearSvm(w[:-1].copy(), float(w[-1]))


def _sigmoid(m: float) -> float:
    return 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))


@dataclass
class LanguageModel:
    """Families, each with its languages; ``of_family`` tells a family from the rest, ``pairs`` two languages of one."""

    families: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, LinearSvm] = field(default_factory=dict)
    pairs: dict[tuple[str, str], LinearSvm] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1): the family of the largest margin, then the language that wins most of its pairs
        (ties: the larger sum of margins, then the smaller code)."""
        if not text or not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        x = features(text)
        score, name = 1.0, next(iter(self.families))
        if self.of_family:
            margins = {f: m.margin(x) for f, m in self.of_family.items()}
            name = max(sorted(margins), key=margins.__getitem__)
            score = _sigmoid(margins[name])
        wins = {code: [0, 0.0] for code in self.families[name]}
        for a, b in combinations(self.families[name], 2):
            m = self.pairs[a, b].margin(x)
            wins[a if m >= 0 else b][0] += 1
            wins[a][1] += m
            wins[b][1] -= m
        code = min(wins, key=lambda k: (-wins[k][0], -wins[k][1], k))
        if len(wins) > 1:
            score *= _sigmoid(wins[code][1] / (len(wins) - 1))
        return code, float(score)


def fit(samples: list[tuple[str, str]]) -> LanguageModel:
    """Learn from (text, language) pairs; texts without letters teach nothing."""
    samples = [(t, code) for t, code in samples if t and has_letter(t)]
    model = LanguageModel()
    for code in sorted({code for _, code in samples}):
        model.families.setdefault(family(code), []).append(code)
    if not samples:
        return model
    x, codes = np.stack([features(t) for t, _ in samples]), np.array([code for _, code in samples])
    of = np.array([family(code) for code in codes])
    if len(model.families) > 1:
        model.of_family = {f: fit_svm(x, np.where(of == f, 1, -1)) for f in model.families}
    for members in model.families.values():
        for a, b in combinations(members, 2):
            rows = (codes == a) | (codes == b)
            model.pairs[a, b] = fit_svm(x[rows], np.where(codes[rows] == a, 1, -1))
    return model


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of at most ``per_language`` labelled texts of each language, none of them of the held-out fold, none longer than
    ``SAMPLE_TEXT_BYTES``; of rows that repeat an id the smallest (text, language) is taken."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(rows.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang"), rows, "doc_id", "lang", per_language)
    return fit(sorted((r.text, r.lang) for r in sample.select("text", "lang").collect()))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each family and pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_batches(slim, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The model is fitted on the driver from a bounded sample (``per_language`` texts of each language, by hash of the id,
    outside the held-out fold: ids whose crc32 as text leaves 2 modulo 4); every whole text is then scored where it lies, without a
    shuffle. Language, source and id are never inputs of a prediction.

    Null text and text without letters is ``und`` with score 0, and so is every text if there is nothing to learn from. A
    null id is not held out and not learned from. Repeated rows are scored alike. An empty table gives an empty result.
    Other columns are ignored.
    """
    return predict(docs, learn(docs, per_language, id_col, text_col, lang_col), id_col, text_col)

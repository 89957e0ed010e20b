"""Language ID with string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

Texts become sequences of 64 symbols: 0 for a run of anything but letters, 1-26 for a-z (case folded), 27-63 for
other letters by their code point. The kernel of two texts is the sum over n = 1, 2, 3 of the number of
n-grams in both, over the geometric mean of the numbers in each. Landmarks are a part of the
bounded training sample; features are kernel values with them, whitened. One ridge regression for each
language against the rest gives weights on the landmarks. Texts are scored in batches: grams present times the
landmarks' grams, then times the weights, both as matrix products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, trim

SYMBOLS, ORDERS = 64, 3
#: Labelled documents that are learned from, at most, all languages together.
TRAIN_ROWS = 1600
#: But so many of each language, however many languages there are: each is learned.
LEAST_ROWS = 10
#: Languages whose shares are broadcast (a few kB); with more, texts are shuffled.
BROADCAST = 10_000
LANDMARKS = 160
RIDGE = 0.05
#: Where the grams of order n begin among all.
STARTS = [0, SYMBOLS, SYMBOLS + SYMBOLS**2, SYMBOLS + SYMBOLS**2 + SYMBOLS**3]
UNKNOWN = "und"
#: Texts that score less are in none of the learned languages.
LEAST_SCORE = 0.1

_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """The symbol of each code point."""
    if not _tables:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
        _tables.append(table)
    return _tables[0]


def grams(text: str | None, seen: np.ndarray | None = None) -> np.ndarray:
    """Sorted codes of the distinct n-grams (n = 1..3) of a whole text; empty without a letter.

    seen: a cleared array of STARTS[-1] bytes to work in.
    """
    seen = np.zeros(STARTS[-1], np.uint8) if seen is None else seen
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = _table()[points]
    if not s.any():
        return np.empty(0, np.int64)
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]  # one 0 for a run
    s = np.pad(s, (int(s[0] > 0), int(s[-1] > 0))).astype(np.int32)
    code = s
    for n in range(ORDERS):
        seen[STARTS[n] + code] = 1
        code = code[:-1] * SYMBOLS + s[n + 1 :]
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


def norms(found: np.ndarray) -> np.ndarray:
    """For each order 1 / sqrt(number of distinct grams), 0 if there are none."""
    counts = np.diff(np.searchsorted(found, STARTS))
    return np.where(counts > 0, 1 / np.sqrt(np.maximum(counts, 1)), 0.0)


@dataclass
class Model:
    """columns: the column of a gram among the landmarks' (-1: none). landmarks: (grams, landmarks) kernel factors.
    weights: (landmarks, languages)."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) regression values, of the texts' grams."""
        x = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for row, found in zip(x, texts):
            at = self.columns[found]
            by = np.repeat(norms(found), np.diff(np.searchsorted(found, STARTS)))
            row[at[at >= 0]] = by[at >= 0]
        return (x @ self.landmarks) @ self.weights


def fit(sample: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regressions from (grams, language) pairs; the landmarks are dealt over the languages in order."""
    sample = [(g, lang) for g, lang in sample if len(g)]
    languages = sorted({lang for _, lang in sample})
    by = {lang: [g for g, other in sample if other == lang] for lang in languages}
    chosen = [g for lang in languages for g in by[lang][: -(-landmarks // len(languages))]]
    columns = np.full(STARTS[-1], -1, np.int32)
    if not chosen:
        return Model([], columns, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    vocabulary = np.unique(np.concatenate(chosen))
    columns[vocabulary] = np.arange(len(vocabulary))
    factors = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, g in enumerate(chosen):
        factors[columns[g], j] = np.repeat(norms(g), np.diff(np.searchsorted(g, STARTS)))
    model = Model(languages, columns, factors, np.eye(len(chosen), dtype=np.float32))
    among = model.scores(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = model.scores([g for g, _ in sample]).astype(np.float64) @ whiten
    target = np.array([[float(lang == x) for x in languages] for _, lang in sample])
    counts = target.sum(axis=0)
    weight = (target / counts).sum(axis=1) * len(sample) / len(languages)  # each language counts the same
    a = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
    model.weights = (whiten @ np.linalg.solve(a, phi.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from about `rows` documents (equally many of each language, LEAST_ROWS or more) outside the held-out quarter.

    Documents are taken by the hash of their ids, up to a limit that each language's count sets; every language is learned, so
    the sample grows with the languages, not with the documents. Only the distinct grams
    of a text reach the driver, of bounded size for texts of any length.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n_"))
    languages = F.count("*").over(Window.partitionBy())
    each = F.greatest(F.lit(float(rows)) / languages, F.lit(float(LEAST_ROWS)))
    shares = counts.withColumn("share_", F.least(F.lit(1.0), each / F.col("n_"))).withColumn("languages_", languages)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    n = counts.count()
    shares = F.broadcast(shares) if n <= BROADCAST else shares
    taken = known.join(shares, "lang").where(unit < F.col("share_")).select("doc_id", "text", "lang")

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "lang": pdf["lang"], "grams": [grams(t).astype(np.int32) for t in pdf["text"]]})

    most = max(2 * rows, 2 * LEAST_ROWS * n)
    found = taken.mapInPandas(run, "id long, lang string, grams array<int>").orderBy(F.xxhash64("id"), "id", "lang", "grams").limit(most).collect()
    return fit([(np.array(r["grams"], np.int64), r["lang"]) for r in found])


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    lang_pred is a learned language, or `und` (score 0) for a text that is null or has no letter, and for all texts if
    nothing was learned. score is the best regression value, cut to 0..1. Only the text decides, so
    equal texts get equal results. A null doc_id counts as the empty text in held_out. Extra columns are ignored.
    """

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        seen, table = np.zeros(STARTS[-1], np.uint8), _table()
        for pdf in batches:
            ids, texts = pdf["doc_id"].astype("Int64"), pdf["text"].tolist()
            for i in range(0, len(pdf), 128):
                part = [grams(t, seen) for t in texts[i : i + 128]]
                has = np.array([len(g) > 0 for g in part]) & bool(model.languages)
                values = model.scores(part) if model.languages else np.zeros((len(part), 1))
                best = values.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": ids.iloc[i : i + 128].reset_index(drop=True),
                    "held_out": [zlib.crc32(("" if pd.isna(d) else str(d)).encode()) % 4 == 2 for d in ids.iloc[i : i + 128]],
                    "lang_pred": [model.languages[b] if h else UNKNOWN for b, h in zip(best, has)],
                    "score": np.where(has, np.clip(values[np.arange(len(part)), best], 0, 1), 0.0),
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return language_id(docs, train(docs, rows))


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """docs in a learned language: without those that are `und` or score under `least`. Nothing is shuffled.

    If nothing was learned, all stay.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(STARTS[-1], np.uint8)
        for batch in batches:
            keep: list[bool] = []
            for _, texts in text_slices(batch):
                part = [grams(t, seen) for t in texts]
                best = model.scores(part).max(axis=1) if model.languages else np.ones(len(part))
                keep += [not model.languages or (len(g) > 0 and b >= least) for g, b in zip(part, best)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        trim()

    return docs.mapInArrow(run, schema)

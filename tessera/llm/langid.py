"""Operator 8, language identification by a string kernel."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, own_columns, ship
from .holding import let_go

UNKNOWN = "und"
#: Bounds of the fit, parameters of fit(): labelled documents sampled per language, landmarks among them.
PER_LANGUAGE, LANDMARKS = 240, 32
#: Code points that there are.
POINTS = 0x110000
#: Most code points turned into n-grams at once; longer texts are read in pieces that overlap by two.
PIECE = 1 << 20


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Spectrum:
    """The distinct 1-, 2- and 3-grams of a text, as numbers, over all letters there are.

    What is no letter counts as one sign. A gram's number is made of its code points and its order, so that no two grams share one.
    """

    def __init__(self):
        points = range(POINTS)
        self.letters = np.fromiter((chr(i).isalpha() for i in points), bool, POINTS)
        self.sign = np.where(self.letters, np.arange(POINTS), 0)

    def grams(self, text: str) -> tuple[np.ndarray, bool]:
        """(sorted numbers of the distinct grams, whether the text has a letter). Long texts are read in pieces."""
        low, found, lettered = text.lower(), [], False
        for lo in range(0, len(low), PIECE):
            points = np.frombuffer(low[max(lo - 2, 0) : lo + PIECE].encode("utf-32-le", "replace"), np.uint32)
            s = self.sign[points]
            two = s[:-1] * POINTS + s[1:]
            three = two[:-1] * POINTS + s[2:]
            found.append(np.unique(np.concatenate([s, two + POINTS**3, three + 2 * POINTS**3])))
            lettered = lettered or bool(self.letters[points].any())
        if not found:
            return np.zeros(0, np.int64), False
        return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))), lettered


class Model:
    """Scores = K(x, landmarks) @ weights, where K is the presence kernel scaled to unit self-similarity.

    grams: all grams of any landmark, sorted; landmarks: a column each, its grams over the root of their number. A text's grams that no
    landmark has add nothing to a product but count in its own norm.
    """

    def __init__(self, grams: np.ndarray, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.grams, self.languages, self.landmarks, self.weights, self.spectrum = grams, languages, landmarks, weights, Spectrum()

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of K as one product for the batch, and whether a text has a letter."""
        rows, norm, lettered = np.zeros((len(texts), len(self.grams)), np.float32), np.ones(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            mine, lettered[i] = self.spectrum.grams(text)
            at = np.searchsorted(self.grams, mine)
            at[at == len(self.grams)] = 0
            rows[i, at[self.grams[at] == mine]] = 1
            norm[i] = max(len(mine), 1)
        return (rows @ self.landmarks).astype(np.float64) / np.sqrt(norm)[:, None], lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        for lo in range(0, len(texts), 64):
            part = texts[lo : lo + 64]
            k, lettered = self.kernel(part)
            out = k @ self.weights
            best = out.argmax(1)
            scores[lo : lo + len(part)] = np.where(lettered, np.clip((1 + out[np.arange(len(part)), best]) / 2, 0, 1), 0)
            names += [self.languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), lettered.tolist())]
        return names, scores

    def parts(self):
        return self.grams, self.languages, self.landmarks, self.weights


def train(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model | None:
    """One-versus-rest kernel ridge regression in the span of the landmarks (Nyström). samples: (text, language), each language's in a fixed order."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    nth: Counter = Counter()
    chosen = []
    for i, (_, lang) in enumerate(samples):
        nth[lang] += 1
        if nth[lang] <= landmarks:
            chosen.append(i)
    spectrum = Spectrum()
    sets = [spectrum.grams(samples[i][0])[0] for i in chosen]
    grams = np.unique(np.concatenate(sets))
    if not len(grams):  # only empty texts teach: nothing to tell languages by
        return None
    base = np.zeros((len(grams), len(chosen)), np.float32)
    for j, mine in enumerate(sets):
        base[np.searchsorted(grams, mine), j] = 1 / np.sqrt(max(len(mine), 1))
    model = Model(grams, languages, base, np.zeros((len(chosen), len(languages))))
    texts = [text for text, _ in samples]
    k = np.vstack([model.kernel(texts[lo : lo + 64])[0] for lo in range(0, len(texts), 64)])
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = k @ root
    target = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in samples])
    mass = np.array([1 / nth[lang] for _, lang in samples])[:, None]  # each language weighs the same
    gram = features.T @ (features * mass) + ridge * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(gram, features.T @ (target * mass))
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Model from at most per_language documents of each language, those of least hash of doc_id, outside the held-out third.

    Only text and non-null lang teach. The sample (per_language whole texts a language) is what reaches the driver.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = usable.withColumn("nth", first).where(F.col("nth") <= per_language).select("id", F.col("nth"), F.col("lang").alias("sampled"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang").where(F.col("text").isNotNull()).join(F.broadcast(ids), "id").where(F.col("lang") == F.col("sampled"))
    sample = sorted({(r["lang"], r["nth"], r["text"]) for r in rows.collect()})
    return train([(text, lang) for lang, _, text in sample], landmarks)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row per input row.

    A prediction sees the text alone, the whole of it. Null text or no letter: 'und', score 0.
    No labelled row to learn from: all 'und'. Null doc_id: not held out, not learned from.
    Repeated rows: one result each. Empty table: no rows. Other columns are dropped.
    """
    ship(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model and model.parts())

    def score(batches):
        let_go()
        m = Model(*shared.value) if shared.value else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = m.predict(texts) if m else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose text has a language, with all their columns.

    The text is scored as in identify(); 'und' (null, empty or without letters) and scores under `least` are rejected. Repeated
    rows: each is judged. Empty table: no rows. Extra columns, whatever their names, stay as they are.
    """
    (said,) = fresh(docs, "language")
    scored = docs.withColumn(said, predictor(docs.sparkSession, fit(docs))("text"))
    return scored.where((F.col(said)["lang"] != UNKNOWN) & (F.col(said)["score"] >= least)).select(*own_columns(docs))


def predictor(spark, model: Model | None):
    """text -> struct<lang, score>, by batches."""
    from pyspark.sql.functions import pandas_udf

    ship(spark)
    shared = spark.sparkContext.broadcast(model and model.parts())
    kept: list[Model] = []

    @pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        values = [t or "" for t in texts]
        if not shared.value:
            return pd.DataFrame({"lang": [UNKNOWN] * len(values), "score": [0.0] * len(values)})
        if not kept:
            let_go()
            kept.append(Model(*shared.value))
        names, scores = kept[0].predict(values)
        return pd.DataFrame({"lang": names, "score": scores})

    return predict

"""Operator 2, quality and toxicity by a document classifier and hierarchical empirical Bayes over sites."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

#: Bound of the fit: labelled documents of each (quality, toxic) pair, those of least hash of doc_id.
PER_CLASS = 1500
#: Lengths of words' beginnings in a lexicon; entries at most; deviations from chance and documents that an entry needs; folds.
STARTS, ENTRIES, DOUBT, LEAST_SEEN, FOLDS = (4, 7), 400, 4.5, 3, 5
#: Tasks that one site's documents may be dealt to.
SALTS = 32
TARGETS = ("quality", "toxic")
_WORD = re.compile(r"\w+")
_UPPER, _MARK = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]")


def shape(text: str, words: list[str]) -> list[float]:
    """What a text looks like, as ratios: capitals, marks by kind, repetition, word length, length."""
    n, w = max(len(text), 1), max(len(words), 1)
    marks = _MARK.findall(text)
    kinds = Counter(marks)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        len(_UPPER.findall(text)) / n, len(marks) / w, kinds["!"] / w, kinds["|"] / w, sum(kinds[c] for c in "#$%&*") / w,
        repeats / w, len(set(words)) / w, n / w / 10, np.log1p(len(words)) / 10, float(not words),
    ]


def word_counts(text: str) -> tuple[list[str], Counter]:
    words = _WORD.findall(text.lower())
    return words, Counter(words)


def grams(word: str) -> list[str]:
    """The word itself (marked by a space) and what it begins with."""
    return [" " + word, *(word[:k] for k in range(STARTS[0], min(STARTS[1], len(word) - 1) + 1))]


class Classifier:
    """Two logistic scores, as log likelihood ratios against the sample's own rates, of a text's shape and of its weight in two lexicons.

    A lexicon holds words and beginnings of words with the log ratio of their rates in marked and other documents. learned: the
    evidence of the sampled texts themselves by folds that did not see them, by the texts' digest.
    """

    def __init__(self, lexicons: list[dict[str, float]], models: list[tuple[np.ndarray, np.ndarray, np.ndarray]], learned: dict[bytes, tuple[float, float]]):
        self.lexicons, self.models, self.learned = lexicons, models, learned
        self.known: dict[str, tuple[float, float]] = {}

    def weight(self, word: str) -> tuple[float, float]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            g = grams(word)
            self.known[word] = tuple(max((x.get(a, 0.0) for a in g), default=0.0) for x in self.lexicons)
        return self.known[word]

    def score(self, text: str) -> tuple[float, float]:
        own = self.learned.get(digest(text))
        if own:
            return own
        words, counts = word_counts(text)
        looks, sums = shape(text, words), [0.0, 0.0]
        for word, n in counts.items():
            a, b = self.weight(word)
            sums[0] += n * a
            sums[1] += n * b
        out = []
        for total, (center, scale, coef) in zip(sums, self.models):
            x = np.array([*lexical(total, len(words)), *looks])
            out.append(float(np.clip((x - center) / scale @ coef[:-1] + coef[-1], -30, 30)))
        return out[0], out[1]


def digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace")).digest()


def lexical(weight, words):
    """What a text's summed lexicon weight says: how much, and how dense."""
    return [np.log1p(weight), np.sqrt(weight / np.maximum(words, 20)), np.log1p(words)]


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, scale, coefficients with the bias last) by Newton's steps; the bias is less the log odds of y, so that scores are likelihood ratios."""
    center, scale = x.mean(0), x.std(0) + 1e-3
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    penalty = np.diag([ridge] * x.shape[1] + [1e-4])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    rate = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    w[-1] -= np.log(rate / (1 - rate))
    return center, scale, w


class Sample:
    """The sampled texts as arrays: words of texts, grams of words, and how often a text has each gram."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        words_of, counts_of, looks, lengths = [], [], [], []
        for text in texts:
            words, counts = word_counts(text)
            words_of.append(np.array([number.setdefault(w, len(number)) for w in counts], np.int64))
            counts_of.append(np.array(list(counts.values()), np.float64))
            looks.append(shape(text, words))
            lengths.append(len(words))
        self.n, self.length, self.shape = len(texts), np.array(lengths, float), np.array(looks)
        self.row = np.repeat(np.arange(self.n), [len(w) for w in words_of])
        self.word, self.count = np.concatenate(words_of), np.concatenate(counts_of)
        index: dict[str, int] = {}
        each = [[index.setdefault(g, len(index)) for g in grams(w)] for w in number]
        self.names = list(index)
        self.word_start = np.cumsum([0] + [len(g) for g in each])[:-1]
        self.word_grams = np.array([g for gs in each for g in gs], np.int64)
        size = np.diff(np.r_[self.word_start, len(self.word_grams)])
        held = []
        for words, counts in zip(words_of, counts_of):  # a text at a time, so that memory stays near what is kept
            per = size[words]
            flat = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.word_start[words], per)
            found, at = np.unique(self.word_grams[flat], return_inverse=True)
            held.append((found.astype(np.int32), np.bincount(at, np.repeat(counts, per), len(found)).astype(np.float32)))
        self.g_row = np.repeat(np.arange(self.n, dtype=np.int32), [len(g) for g, _ in held])
        self.g_gram, self.g_count = (np.concatenate(x) for x in zip(*held))

    def lexicon(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Log ratio of rates of each gram, 0 for all but those whose rate follows y beyond doubt, by the documents in use."""
        n, size = int(use.sum()), len(self.names)
        ratio = np.zeros(size)
        mean = y[use].mean() if n else 0.0
        if not 0 < mean < 1:
            return ratio
        k = use[self.g_row]
        row, gram, count = self.g_row[k], self.g_gram[k], self.g_count[k]
        v = np.sqrt(count / np.maximum(self.length[row], 20))
        sums = lambda w=None: np.bincount(gram, w, size)
        seen, m, spread = sums(), sums(v) / n, sums(v * v) / n
        z = (sums(v * y[row]) / n - m * mean) * np.sqrt(n) / np.sqrt(np.maximum(spread - m * m, 1e-12) * mean * (1 - mean))
        few = np.minimum(count, 50)
        marked, all_ = self.length[use & (y > 0)].sum(), self.length[use].sum()
        log = np.log((sums(few * y[row]) + 0.5) / (marked + 1000)) - np.log((sums(few * (1 - y[row])) + 0.5) / (all_ - marked + 1000))
        good = np.flatnonzero((z > DOUBT) & (seen >= max(LEAST_SEEN, n / 2000)) & (log > 0))
        good = good[np.argsort(-z[good], kind="stable")[:ENTRIES]]
        ratio[good] = log[good]
        return ratio

    def features(self, ratio: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(ratio[self.word_grams], self.word_start) if len(self.word_start) else np.zeros(0)
        weight = np.bincount(self.row, self.count * best[self.word], self.n)
        return np.c_[np.array(lexical(weight, self.length)).T, self.shape]


def train(samples: list[tuple[str, int, int]], folds: int = FOLDS) -> Classifier | None:
    """samples: (text, quality, toxic). Lexicon weights that the scores are fitted on come from folds without the text, so that nothing is learned by heart."""
    if not samples:
        return None
    texts = [t for t, _, _ in samples]
    fold = np.array([digest(t)[0] % folds for t in texts])
    s, every = Sample(texts), np.ones(len(samples), bool)
    lexicons, models, own = [], [], []
    for sign, k in ((-1, 1), (1, 2)):  # quality is told by what documents without it have
        y = np.array([x[k] for x in samples], float)
        marked = y if sign > 0 else 1 - y
        x = np.zeros((s.n, 3 + s.shape.shape[1]))
        for f in range(folds):
            x[fold == f] = s.features(s.lexicon(marked, fold != f))[fold == f]
        models.append(logistic_fit(x, y))
        out = np.zeros(s.n)
        for f in range(folds):
            if (fold != f).any():
                center, scale, w = logistic_fit(x[fold != f], y[fold != f])
                out[fold == f] = np.clip((x[fold == f] - center) / scale @ w[:-1] + w[-1], -30, 30)
        own.append(out)
        ratio = s.lexicon(marked, every)
        lexicons.append({s.names[i]: float(ratio[i]) for i in np.flatnonzero(ratio)})
    return Classifier(lexicons, models, {digest(t): (float(a), float(b)) for t, a, b in zip(texts, *own)})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier | None:
    """From at most per_class labelled documents of each pair of labels; that many whole texts reach the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    first = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = usable.select("doc_id", "quality", "toxic").distinct().withColumn("nth", first).where(F.col("nth") <= per_class).drop("nth")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text").collect()
    return train(sorted({(r["text"], int(r["quality"]), int(r["toxic"])) for r in rows}))


def evidence(docs: DataFrame, model: Classifier | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, e_quality, e_toxic: the classifier's log likelihood ratios of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.lexicons, model.models, model.learned))

    def score(batches):
        m = Classifier(*shared.value) if shared.value else None
        for batch in batches:
            got = [m.score(t.as_py() or "") if m else (0.0, 0.0) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "host", "path", "e_quality", "e_toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")
    return rows.mapInArrow(score, "doc_id long, host string, path string, e_quality double, e_toxic double")


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def strength(sites: DataFrame, mean: str, prior: Column) -> Column:
    """Pseudo-documents behind a prior, by moments: how little the rates of sites differ beyond what their size explains."""
    spread = F.sum(F.col("n") * F.pow(F.col(mean) - prior, 2)) / F.sum("n")
    noise = F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-6))
    level = F.sum(F.col("n") * F.col(mean)) / F.sum("n")
    return F.least(F.greatest(level * (1 - level) / between - 1, F.lit(1.0)), F.lit(1e4))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, p_quality, p_toxic: path rates shrunk to their host's, hosts' to the global one. Sums are combined before the shuffle, so a site of any size is one row a task."""
    soft = {t: F.sum(logistic(F.col(f"e_{t}"))).alias(f"s_{t}") for t in TARGETS}
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *soft.values())
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS))
    world = hosts.agg(F.sum("n").alias("world_n"), *((F.sum(f"s_{t}") / F.sum("n")).alias(f"g_{t}") for t in TARGETS))  # one row
    rated = hosts.crossJoin(F.broadcast(world)).withColumns({f"r_{t}": F.col(f"s_{t}") / F.col("n") for t in TARGETS})
    kappa = rated.agg(*(strength(rated, f"r_{t}", F.col(f"g_{t}")).alias(f"k_{t}") for t in TARGETS))  # one row
    host = rated.crossJoin(F.broadcast(kappa)).select("host", *((F.col(f"s_{t}") + F.col(f"k_{t}") * F.col(f"g_{t}")) / (F.col("n") + F.col(f"k_{t}")) for t in TARGETS)).toDF("host", *(f"h_{t}" for t in TARGETS))
    under = paths.join(host, "host").withColumns({f"r_{t}": F.col(f"s_{t}") / F.col("n") for t in TARGETS})
    within = under.agg(*(strength(under, f"r_{t}", F.col(f"h_{t}")).alias(f"k_{t}") for t in TARGETS))  # one row
    return under.crossJoin(F.broadcast(within)).select("host", "path", *(((F.col(f"s_{t}") + F.col(f"k_{t}") * F.col(f"h_{t}")) / (F.col("n") + F.col(f"k_{t}"))).alias(f"site_{t}") for t in TARGETS))


def joined_by_salt(scored: DataFrame, sites: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every document with its site's row. A site may hold a third of all documents: its rows are dealt to `salts` tasks, the sites' (a row each) copied to them."""
    copies = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "e_quality", "e_toxic"), F.lit(salts)).cast("int")).join(copies, ["host", "path", "salt"]).drop("salt")


def classify(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column | None = None, model: Classifier | None = None) -> DataFrame:
    """doc_id, p_quality, p_toxic, site_quality, site_toxic, keep, a row per input row.

    The posterior odds of a document are its own likelihood ratio times the odds of its path; keep:
    good more likely than not, toxic less. Site rates take the texts that taught the classifier by the evidence of folds without them. path: by default host and language, as sites split their pages. Null text: scored
    as empty. Null host or path: a site of its own name ''. No labels: no evidence, all at even odds. Repeated rows: one
    result each. Empty table: no rows. Other columns are dropped.
    """
    host = F.col(host) if isinstance(host, str) else host
    path = F.concat_ws("/", host, F.col("lang")) if path is None else F.col(path) if isinstance(path, str) else path
    model = model or fit(docs, labels)
    scored = staged(evidence(docs, model, host, path), "quality-evidence")
    sites = site_posteriors(scored)
    joined = joined_by_salt(scored, sites)
    post = {t: logistic(F.col(f"e_{t}") + logit(F.col(f"site_{t}"))) for t in TARGETS}
    return joined.select("doc_id", post["quality"].alias("p_quality"), post["toxic"].alias("p_toxic"), "site_quality", "site_toxic", ((post["quality"] >= 0.5) & (post["toxic"] < 0.5)).alias("keep"))

"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w . x - theta_k): one weight vector shared by all ordered
thresholds. x holds ln(1 + count) of each lower-case word, known by a 64-bit hash. The output is the
expected grade, the sum of P(grade >= k) over k, with the probability of any toxicity.

The labels say toxic or not; grades within toxic come from thirds of the amount of marked
words, which are those that toxic labelled documents have far more often than others
(log odds above ``MARKED`` in at least ``LEAST_SHARE`` of them). The model is fitted on a
bounded sample of labelled documents (``most_labelled``, those with the smallest id
hashes) over all words in at least ``LEAST_DOCS`` of them whose share of toxic and other
documents surely differs (z score of at least ``LEAST_Z``). Toxic documents are few, so a
document counts as toxic from a cut-off on the probability that is chosen on labelled
documents, each scored by a model fitted without it (``FOLDS``): the one that finds most toxic
documents while at most ``FALSE_ALARMS`` of the others are taken for toxic. Scoring covers all
documents and whole texts.

Defined results: null and empty texts have no features and the grade of the thresholds
alone; without labelled documents of both kinds every grade is 0 and nothing is toxic;
null labels and labels of unknown documents are ignored; an id labelled toxic anywhere
counts as toxic; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
MOST_LABELLED, GRADES = 8000, 3
LEAST_DOCS, LEAST_Z = 3, 4.0
FALSE_ALARMS, FOLDS = 0.005, 5
MARKED, LEAST_SHARE = 3.0, 0.03
REMEMBERED = 400_000
BLOCK = 1024


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and their counts."""
    counts = Counter(WORD.findall((text or "").lower()))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts))
    return hashes, np.fromiter(counts.values(), np.float64, len(counts))


class OrdinalModel:
    """Shared ``weights`` by word hash, ascending ``thresholds`` and the cut-off; no thresholds: nothing is toxic.

    ``held_out`` has shares of the labelled documents, each scored by a model fitted without it.
    """

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray, cut: float = 0.5, held_out: dict[str, float] | None = None) -> None:
        self.weights, self.thresholds, self.cut, self.held_out = weights, thresholds, cut, held_out or {}
        self.seen: set[str] = set()
        self.weighty: dict[str, float] = {}

    def above(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        if not len(self.thresholds):
            return np.zeros(GRADES)
        words = WORD.findall((text or "").lower())
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        fresh = set(words).difference(self.seen)
        for word in fresh:
            weight = self.weights.get(xxhash.xxh64_intdigest(word))
            if weight:
                self.weighty[word] = weight
        self.seen |= fresh
        used = Counter(filter(self.weighty.__contains__, words))
        score = sum(self.weighty[word] * np.log1p(n) for word, n in used.items())
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))

    def of_counts(self, hashes: np.ndarray, counts: np.ndarray) -> float:
        """P(grade >= 1) of a document given as ``word_counts``."""
        if not len(self.thresholds):
            return 0.0
        score = sum(self.weights.get(h, 0.0) * np.log1p(n) for h, n in zip(hashes.tolist(), counts))
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds[0], -60, 60)))


class Sample:
    """Labelled documents as sparse rows over the words of the sample."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> None:
        self.toxic, self.n = toxic, len(toxic)
        self.rows = np.repeat(np.arange(self.n), [len(h) for h, _ in sets])
        self.words, self.cols = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        self.counts = np.concatenate([c for _, c in sets])

    def marked(self) -> np.ndarray:
        """Which words toxic documents have far more often than others."""
        kind = self.toxic[self.rows]
        bad, good = (np.bincount(self.cols[kind == k], minlength=len(self.words)) for k in (1, 0))
        n_bad = self.toxic.sum()
        odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (self.n - n_bad + 1))
        return (odds > MARKED) & (bad >= LEAST_SHARE * n_bad)

    def grades(self, grades: int) -> np.ndarray:
        """0 for documents that are not toxic, else 1 .. ``grades`` by equal parts of their marked words, sum of ln(1 + count)."""
        weight = np.bincount(self.rows, np.log1p(self.counts) * self.marked()[self.cols], minlength=self.n)
        cuts = np.quantile(weight[self.toxic == 1], np.arange(1, grades) / grades)
        return np.where(self.toxic == 1, 1 + np.searchsorted(cuts, weight, "right"), 0)

    def telling_words(self, least_docs: int, least_z: float) -> np.ndarray:
        """The words of enough documents whose shares among toxic and other documents differ by a z score of at least ``least_z``."""
        kind = self.toxic[self.rows]
        bad, good = (np.bincount(self.cols[kind == k], minlength=len(self.words)) for k in (1, 0))
        n_bad, share = self.toxic.sum(), (bad + good) / self.n
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_bad + 1 / (self.n - n_bad)))
        z = np.abs(bad / n_bad - good / (self.n - n_bad)) / spread
        return np.flatnonzero((z >= least_z) & (bad + good >= least_docs))

    def features(self, used: np.ndarray) -> np.ndarray:
        place = np.full(len(self.words), -1)
        place[used] = np.arange(len(used))
        keep = place[self.cols] >= 0
        x = np.zeros((self.n, len(used)))
        x[self.rows[keep], place[self.cols[keep]]] = np.log1p(self.counts[keep])
        return x


def fitted(x: np.ndarray, y: np.ndarray, grades: int, ridge: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood; the documents' own gradients give the curvature."""
    n, m = x.shape
    rows = np.arange(n)
    theta = np.log([((y < k).sum() + 0.5) / ((y >= k).sum() + 0.5) for k in range(1, grades + 1)]) + 1e-3 * np.arange(grades)
    beta = np.concatenate([np.zeros(m), theta])
    fine = np.concatenate([np.full(m, ridge), np.zeros(grades)])

    def parts(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x @ beta[:m])[:, None] - beta[None, m:]
        c = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(at, -35, 35))), np.zeros((n, 1))], axis=1)  # P(y >= k)
        return c, np.maximum(c[rows, y] - c[rows, y + 1], 1e-15)

    def loss(beta: np.ndarray) -> float:
        ordered = np.all(np.diff(beta[m:]) > 1e-6)
        return float(-np.log(parts(beta)[1]).sum() + 0.5 * (fine * beta**2).sum()) if ordered else np.inf

    now = loss(beta)
    for _ in range(rounds):
        c, p = parts(beta)
        slope = c * (1 - c)
        gradient, curvature = -fine * beta, np.diag(fine + 1e-6)
        for at in range(0, n, BLOCK):  # the vocabulary has no fixed bound, so the documents' gradients are never held at once
            b = slice(at, at + BLOCK)
            own = np.zeros((len(rows[b]), m + grades))
            own[:, :m] = x[b] * ((slope[rows, y] - slope[rows, y + 1]) / p)[b, None]
            for k in range(1, grades + 1):
                own[:, m + k - 1] = (((y == k - 1) * slope[:, k] - (y == k) * slope[:, k]) / p)[b]
            gradient += own.sum(0)
            curvature += own.T @ own
        step = np.linalg.solve(curvature, gradient)
        size = 1.0
        while size > 1e-4 and not (then := loss(beta + size * step)) < now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * n:
            break
        beta, now = beta + size * step, then
    return beta[:m], beta[m:]


def best_cut(p: np.ndarray, toxic: np.ndarray, false_alarms: float = FALSE_ALARMS) -> float:
    """The cut-off that finds most toxic documents with at most a share of ``false_alarms`` of the others; in the middle of its gap."""
    others = np.sort(p[toxic == 0])[::-1]
    above = others[int(false_alarms * len(others))]  # the first that may not be taken for toxic
    found = p[(toxic == 1) & (p > above)]
    if not len(found):
        return max(0.5, float(np.nextafter(above, 2)))
    lowest = found.min()
    return float((lowest + p[p < lowest].max(initial=above)) / 2)


def fit_words(sets: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int, ridge: float) -> OrdinalModel:
    """The model with a cut-off of one half."""
    if not len(toxic) or toxic.min() == toxic.max():
        return OrdinalModel({}, np.empty(0))
    sample = Sample(sets, toxic)
    used = sample.telling_words(LEAST_DOCS, LEAST_Z)
    graded = sample.grades(grades)
    levels = np.unique(graded)  # equal amounts of marked words leave grades empty; an empty grade shares the next one's threshold
    weights, thresholds = fitted(sample.features(used), np.searchsorted(levels, graded), len(levels) - 1, ridge)
    thresholds = np.append(thresholds, np.inf)[np.searchsorted(levels, np.arange(1, grades + 1)) - 1]
    return OrdinalModel(dict(zip(sample.words[used].tolist(), weights.tolist())), thresholds)


def fit(sets: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = GRADES, ridge: float = 0.5) -> OrdinalModel:
    """The cumulative-link model of a labelled sample, with its cut-off from documents that the scoring model has not seen."""
    model = fit_words(sets, toxic, grades, ridge)
    if not len(model.thresholds) or min(toxic.sum(), (1 - toxic).sum()) < 2 * FOLDS:
        return model
    fold = np.array([int(h.sum(dtype=np.uint64) % np.uint64(FOLDS)) for h, _ in sets])  # copies of a text are left out together
    p = np.empty(len(toxic))
    for k in range(FOLDS):
        part = fit_words([x for x, f in zip(sets, fold) if f != k], toxic[fold != k], grades, ridge)
        for i in np.flatnonzero(fold == k):
            p[i] = part.of_counts(*sets[i])
    model.cut = best_cut(p, toxic)
    sample = Sample(sets, toxic)
    marked = np.bincount(sample.rows, sample.counts * sample.marked()[sample.cols], minlength=sample.n)
    hit, bad = p >= model.cut, toxic == 1
    one = bad & (marked == 1)
    model.held_out = {"documents": len(p), "toxic": int(bad.sum()), "recall": hit[bad].mean(), "false_alarms": hit[~bad].mean(), "one_marked": int(one.sum()), "recall_one_marked": hit[one].mean() if one.any() else 1.0, "recall_at_half": (p[bad] >= 0.5).mean()}
    return model


def labelled_sets(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Features and labels of a bounded sample: at most ``most_labelled`` documents reach the driver, as counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    picked = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), "id").select("id", "toxic", "text")  # at most `most_labelled` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_counts(text.as_py()) for text in batch.column(2)]
            hashes = pa.array([h.tobytes() for h, _ in made], pa.binary())
            counts = pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, counts], ["id", "toxic", "hashes", "counts"])

    found = rows.mapInArrow(run, "id long, toxic int, hashes binary, counts binary").toArrow()
    read = lambda name, kind: (np.frombuffer(x.as_py(), kind) for x in found.column(name))
    sets = [(h, c.astype(np.float64)) for h, c in zip(read("hashes", np.uint64), read("counts", np.uint32))]
    return sets, np.minimum(1, np.array(found.column("toxic").to_pylist(), np.int64))


def scored(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``doc_id, grade, expected_severity, p_toxic, toxic``: one row per document.

    Toxic is a probability of at least ``threshold``, the model's cut-off if not given. The grade
    of a toxic document is the largest k with P(grade >= k) >= 1/2, at least 1; of others it is 0.
    """
    cut = model.cut if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.above(text.as_py()) for text in batch.column(1)]).reshape(batch.num_rows, -1)
            toxic = p[:, 0] >= cut
            grade = np.where(toxic, np.maximum(1, (p >= 0.5).sum(1)), 0)
            cols = [pa.array(grade, pa.int64()), pa.array(p.sum(1), pa.float64()), pa.array(p[:, 0], pa.float64()), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, grade long, expected_severity double, p_toxic double, toxic boolean")


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> OrdinalModel:
    return fit(*labelled_sets(docs, labels, most_labelled))

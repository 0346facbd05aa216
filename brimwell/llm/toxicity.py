"""Toxicity by a classifier chain of linear models.

Label columns are predicted in a fixed order, `quality` and then `toxic` by default.  Each model sees the word
features and the probabilities of the earlier categories; in training those come from models of the other folds
(out of fold), in use from the model of all rows.  A text's fold is a hash of the text, so equal texts are in one.

The models are fitted on a bounded sample: the SAMPLE labelled documents with the least hash of their id and
text.  Which they are is found from the ids alone; the texts are then read once, with the sample's ids
broadcast, and no text outside the sample is moved.  Word features are the `WORDS` words whose presence
in the sample tells most about the last category (G statistic, an aggregation in Spark).

Defined results: null and empty texts have no features and get the base rate; without labels, or with
labels of one kind only, no text is toxic and probabilities are that rate; equal texts get equal values;
rows of labels of one id all teach, equal ones once; a null in the last category teaches nothing, in an earlier one it
counts as 0, and a category that labels lacks is left out.  All columns of the input stay as they are: a result column whose name is
taken, in any letter case, gets `_` put behind its name.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import blocks, readable, split_words, text_bytes, unused, written

WORDS, SAMPLE, FOLDS, CUT = 128, 20_000, 5, 0.5
CATEGORIES = ("quality", "toxic")


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n, bad): labelled rows that hold the word, and how many of them are of the last category."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = split_words(data, offsets)
                pair = np.unique(np.column_stack([w.hash, w.text_of().astype(np.uint64)]), axis=0) if len(w.hash) else np.zeros((0, 2), np.uint64)
                y = part.column("y").to_numpy()
                word, at = np.unique(pair[:, 0], return_inverse=True)
                bad = np.bincount(at, y[pair[:, 1].astype(np.int64)], len(word)) if len(word) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, minlength=len(word)).astype(np.int64)), pa.array(bad.astype(np.int64))], names=["word", "n", "bad"])

    return labelled.mapInArrow(count, "word long, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _tellers(counts: DataFrame, rows: int, bad: int, words: int) -> np.ndarray:
    """Hashes of the words that tell most about the label."""
    cell = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    n, b = F.col("n").cast("double"), F.col("bad").cast("double")
    rate = bad / rows
    g = cell(b, n * rate) + cell(n - b, n * (1 - rate)) + cell(bad - b, (rows - n) * rate) + cell(rows - bad - n + b, (rows - n) * (1 - rate))
    top = counts.where((n < rows) | (b < bad)).withColumn("g", g).orderBy(F.desc("g"), "word").limit(words).select("word").collect()
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Presence of each word (the last column is free)."""
    w = split_words(data, offsets)
    x = np.zeros((len(offsets) - 1, len(words) + 1))
    if len(words) and len(w.hash):
        at = np.minimum(np.searchsorted(words, w.hash), len(words) - 1)
        hit = words[at] == w.hash
        x[w.text_of()[hit], at[hit]] = 1
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, targets: list[np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """A model for each target; later ones are taught with the earlier ones' out-of-fold probabilities."""
    models = []
    for k, y in enumerate(targets):
        models.append(fit_linear(x, y))
        if k + 1 < len(targets):
            p = np.zeros(len(x))
            for f in np.unique(fold):
                own = fold == f
                p[own] = apply_linear(fit_linear(x[~own], y[~own]) if (~own).any() else models[-1], x[own])
            x = np.column_stack([x, p])
    return models


def apply_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = []
    for w in models:
        out.append(apply_linear(w, x))
        x = np.column_stack([x, out[-1]])
    return np.array(out)


def sampled(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], *, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(h, text, y, targets) of at most `sample` labelled documents: `targets` holds 0 or 1 for each category, y the last."""
    kinds = [F.coalesce((F.col(c) != 0).cast("double"), F.lit(0.0)) for c in categories]
    own = labels.where(F.col(categories[-1]).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.array(*kinds).alias("targets"))
    own = own.distinct().join(docs.select(F.col(id).alias("id")), "id", "left_semi")
    chosen = written(own.orderBy(F.xxhash64("id"), "id", "targets").limit(sample))
    # one id may stand on any number of rows: equal ones collapse, and a hash of id and text bounds the rest
    texts = docs.select(F.col(id).alias("id"), text_bytes(text).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id", "text", "targets"])
    texts = written(texts.select(F.xxhash64("id", "text").alias("h"), "text", F.element_at("targets", -1).cast("long").alias("y"), "targets"))
    if texts.count() <= sample:
        return texts
    cut = texts.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return texts.where(F.col("h") <= cut).limit(sample)


def train_chain(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", categories: tuple[str, ...] = CATEGORIES, words: int = WORDS, sample: int = SAMPLE):
    """(categories, word hashes, models, base rates) from the labelled rows.

    A category that labels lacks is left out.  Without the last one, whose probability decides, there is no model and nothing is toxic.
    """
    last = categories[-1]
    categories = tuple(c for c in categories if c in labels.columns)
    if last not in categories:
        return categories, np.zeros(0, np.uint64), [], [0.0] * len(categories)
    labelled = sampled(docs, labels, categories, id=id, text=text, sample=sample)
    rows, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rates = [r or 0.0 for r in labelled.agg(*[F.avg(F.col("targets")[k]) for k in range(len(categories))]).first()]
    if bad in (0, rows):
        return categories, np.zeros(0, np.uint64), [], rates
    chosen = _tellers(_word_counts(labelled.select("text", "y")), rows, bad, words)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                x = features(data, offsets, chosen)
                yield pa.RecordBatch.from_arrays([part.column("fold"), part.column("targets"), pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32()))], names=["fold", "targets", "at"])

    folds = labelled.select("text", "targets", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    taught = folds.mapInArrow(sparse, "fold int, targets array<double>, at array<int>").collect()  # `sample` rows at most
    taught.sort(key=lambda r: (r.fold, r.targets, r.at))
    x = np.zeros((len(taught), len(chosen) + 1))
    for i, r in enumerate(taught):
        x[i, r.at] = 1
    targets = list(np.array([r.targets for r in taught]).T)
    return categories, chosen, fit_chain(x, targets, np.array([r.fold for r in taught])), rates


def toxicity(docs: DataFrame, model, *, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows and columns of docs with a probability p_<category> for each link of the chain, and is_toxic (the last reaches `cut`)."""
    categories, words, models, rates = model
    names = docs.columns
    *new, flag = unused([*(f"p_{c}" for c in categories), "is_toxic"], names)
    frame, own = readable(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((words, models))
    schema = StructType(list(docs.schema))
    for n in new:
        schema = schema.add(n, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, models = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, own):
                p = apply_chain(models, features(data, offsets, words)) if models else np.repeat(np.array(rates)[:, None], part.num_rows, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(names))] + list(map(pa.array, p)), names=[*names, *new])

    out = frame.mapInArrow(run, schema)
    return out.withColumn(flag, (F.col(f"`{new[-1]}`") >= cut) if models else F.lit(False))

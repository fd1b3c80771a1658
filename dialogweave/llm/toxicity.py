"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over words
and beginnings of words, each as present, repeated and frequent, with the probabilities of the earlier categories as further features. In training these are
out-of-fold predictions: a document's earlier probabilities come from models that have not
seen it, as they will when unseen documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogweave.llm.common import written
from dialogweave.llm.textkit import MARKS, U, between, flat, lower, mix, prefix_hashes, slices, word_spans

MAX_LABELLED = 5_000
MAX_WORDS = 512  # features of one model
FOLDS = 3
BEGINNINGS = (5, 7)  # bytes
OFTEN = (2, 4)
_RUN = 1 << 18
EVIDENCE = 30.0  # least chi-square of a word that becomes a feature


@dataclass
class Linear:
    """Word features by hash, their weights, those of earlier categories, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probabilities(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        score = present @ self.weights + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _parts(n: int) -> Iterator[slice]:
    """The numbers below n in runs, so that what is made of a run is small."""
    return (slice(at, at + _RUN) for at in range(0, n, _RUN))


def telling_words(
    words: np.ndarray, owner: np.ndarray, target: np.ndarray, rows: np.ndarray, max_words: int = MAX_WORDS
) -> np.ndarray:
    """The words whose presence goes with the category, by chi-square over these rows; the
    ``max_words`` with the most evidence."""
    names = np.unique(words[rows[owner]])
    if not len(names):
        return names
    with_word, hits = np.zeros(len(names)), np.zeros(len(names))
    for part in _parts(len(words)):
        use = rows[owner[part]]
        number = np.searchsorted(names, words[part][use])
        with_word += np.bincount(number, minlength=len(names))
        hits += np.bincount(number, weights=target[owner[part][use]], minlength=len(names))
    n, t = float(rows.sum()), float(target[rows].sum())
    if t in (0.0, n):
        return names[:0]
    expected = with_word * t / n
    spread = expected * (1 - t / n) * (1 - with_word / n)
    chi = np.where(spread > 0, (hits - expected) ** 2 / np.maximum(spread, 1e-12), 0.0)
    chosen = np.flatnonzero((chi >= EVIDENCE) & (with_word >= 3))
    chosen = chosen[np.lexsort((names[chosen], -chi[chosen]))][:max_words]
    return np.sort(names[chosen])


def presence(words: np.ndarray, owner: np.ndarray, count: int, features: np.ndarray) -> np.ndarray:
    """One row per document, one column per feature: 1 where the word occurs."""
    out = np.zeros((count, len(features)))
    for part in _parts(len(words) if len(features) else 0):
        at = np.minimum(np.searchsorted(features, words[part]), len(features) - 1)
        hit = features[at] == words[part]
        out[owner[part][hit], at[hit]] = 1.0
    return out


def fit_linear(present: np.ndarray, before: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> tuple:
    """Logistic regression with a ridge by Newton steps."""
    x = np.hstack([present, before, np.ones((len(target), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (target - p) - penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    k = present.shape[1]
    return w[:k], w[k:-1], float(w[-1])


def fit_chain(
    words: np.ndarray, owner: np.ndarray, targets: Sequence[np.ndarray], folds: int = FOLDS, max_words: int = MAX_WORDS
) -> list[Linear]:
    """One model per category in order, each fed the out-of-fold log odds of those before it."""
    count = len(targets[0]) if targets else 0
    fold = np.arange(count) % folds
    before = np.zeros((count, 0))
    chain = []
    for target in targets:
        target = target.astype(float)
        held_out = np.zeros(count)
        for k in range(folds):
            rows = fold != k
            held_out[~rows] = _fitted(words, owner, target, before, rows, max_words)[1][~rows]
        chain.append(_fitted(words, owner, target, before, np.ones(count, bool), max_words)[0])
        before = np.hstack([before, _log_odds(held_out)[:, None]])
    return chain


def _fitted(words, owner, target, before, rows, max_words) -> tuple[Linear, np.ndarray]:
    """The model of these rows, and its probabilities for all rows."""
    features = telling_words(words, owner, target, rows, max_words)
    present = presence(words, owner, len(target), features)
    weights = (np.zeros(len(features)), np.zeros(before.shape[1]), -30.0)
    if rows.any():
        weights = fit_linear(present[rows], before[rows], target[rows])
    model = Linear(features, *weights)
    return model, model.probabilities(present, before)


def chain_probabilities(chain: list[Linear], words: np.ndarray, owner: np.ndarray, count: int) -> list[np.ndarray]:
    """The categories' probabilities of ``count`` texts, each model fed those before it."""
    before, out = np.zeros((count, 0)), []
    for model in chain:
        out.append(model.probabilities(presence(words, owner, count, model.words), before))
        before = np.hstack([before, _log_odds(out[-1])[:, None]])
    return out


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, and the offsets of the texts in them."""
    starts, ends, to = word_spans(data, offsets, MARKS)
    sums = prefix_hashes(lower(data))
    kinds = [mix(between(sums, starts, ends))]
    for size in BEGINNINGS:
        part = mix(between(sums, starts, np.minimum(starts + size, ends)) + U(size))
        kinds.append(part)
    every = np.stack(kinds)
    found = []
    for a, b in zip(to[:-1], to[1:], strict=True):
        names, times = np.unique(every[:, a:b], return_counts=True)
        found.append(np.concatenate([names, *(mix(names[times >= n] + U(n)) for n in OFTEN)]))
    sizes = np.cumsum([0, *map(len, found)])
    return (np.concatenate(found) if found else np.zeros(0, U)), sizes


def _words_of(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the packed distinct word hashes of each text."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(len(keep)))
            packed = []
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                words, to = text_features(data[at[0] : at[-1]], at - at[0])
                packed.extend(words[to[i] : to[i + 1]].tobytes() for i in range(last - first))
            columns = [*batch.columns[: len(keep)], pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "words"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", words binary")


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS,
) -> list[Linear]:
    """The chain for these categories (name to condition on ``labels``).

    It is fitted on at most ``max_labelled`` labels, the least by a hash of the id; labels that
    are NULL or repeat an id with other values are left out. The different texts of these ids
    are used, each once, and at most twice ``max_labelled`` in all, again the least by a hash.
    A model has at most ``max_words`` features (a word may be nine), those with the most
    evidence. Without labels every category has probability 0.

    Evidence is counted in Spark, per word and fold; what comes to the driver of a text is
    which of the telling words it has, some hundred at most."""
    names = [f"is_{i}" for i in range(len(categories))]
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), *(c.cast("int").alias(n) for c, n in zip(categories.values(), names, strict=True)))
    known = known.dropna().groupBy("label_id").agg(*(F.min(n).alias(n) for n in names), *(F.max(n).alias(f"max_{n}") for n in names))
    known = known.where(" and ".join(f"{n} = max_{n}" for n in names) or "true").select("label_id", *names)
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "digest", F.coalesce(F.md5("text"), F.lit(""))
    )
    # At most max_labelled narrow rows are broadcast.
    labelled = rows.join(F.broadcast(known), F.col("id") == F.col("label_id"))
    keys = labelled.select("id", "digest", *names).distinct().orderBy(F.xxhash64("id", "digest"), "id", "digest").limit(2 * max_labelled)
    in_order = F.row_number().over(Window.orderBy("id", "digest"))
    keys = written(keys.withColumn("row", in_order).withColumn("fold", (F.col("row") - 1) % FOLDS), "labelled")
    # So are these, twice as many.
    sample = rows.join(F.broadcast(keys), ["id", "digest"]).dropDuplicates(["row"])
    sample = written(_words_of(sample, ["row", "fold", *names]), "label-words")
    telling = np.sort(np.array([r["w"] for r in _telling(sample, keys, names, max_words).collect()], np.int64).view(U))
    found = sorted(_only(sample, telling, ["row", *names]).collect(), key=lambda r: r["row"])
    targets = [np.array([r[n] for r in found], int) for n in names]
    each = [np.frombuffer(r["words"], U) for r in found]
    owner = np.repeat(np.arange(len(each), dtype=np.int32), [len(w) for w in each])
    return fit_chain(np.concatenate(each) if each else np.zeros(0, U), owner, targets, max_words=max_words)


def _telling(sample: DataFrame, keys: DataFrame, names: Sequence[str], max_words: int) -> DataFrame:
    """(w): the words with enough evidence for some model, those of all rows and those without
    one fold; of each model twice as many at most as it may have, so that rounding cannot
    exclude any that it would choose."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column("fold"))
            for k in range(FOLDS):
                mine = np.flatnonzero(fold == k)
                each = [np.frombuffer(batch.column("words")[i].as_py(), U) for i in mine]
                if not any(map(len, each)):
                    continue
                words, number = np.unique(np.concatenate(each), return_inverse=True)
                owner = np.repeat(mine, [len(w) for w in each])
                hits = [np.bincount(number, weights=np.asarray(batch.column(n))[owner], minlength=len(words)) for n in names]
                columns = [words.view(np.int64), np.full(len(words), k), np.bincount(number), *(h.astype(np.int64) for h in hits)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["w", "fold", "n", *names])

    counted = sample.mapInArrow(count, "w long, fold long, n long, " + ", ".join(f"{n} long" for n in names))
    per_fold = [
        F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).cast("double").alias(f"{c}_{k}")
        for k in range(FOLDS) for c in ("n", *names)
    ]
    words = counted.groupBy("w").agg(*per_fold).where(" + ".join(f"n_{k}" for k in range(FOLDS)) + " >= 3")
    totals = {r["fold"]: r for r in keys.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names)).collect()}
    models = []
    for c in names:
        for left_out in (*range(FOLDS), None):
            folds = [k for k in range(FOLDS) if k != left_out]
            n, t = (float(sum(totals[k][x] for k in folds if k in totals)) for x in ("n", c))
            if t in (0.0, n):
                continue
            having, hits = (sum((F.col(f"{x}_{k}") for k in folds), F.lit(0.0)) for x in ("n", c))
            expected = having * (t / n)
            spread = expected * (1 - t / n) * (1 - having / n)
            chi = F.when((spread > 0) & (having >= 3), (hits - expected) ** 2 / spread)
            models.append(F.when(chi >= EVIDENCE * (1 - 1e-9), F.struct(F.lit(len(models)).alias("m"), chi.alias("chi"))))
    if not models:
        return words.select("w").limit(0)
    strongest = Window.partitionBy("m").orderBy(F.col("chi").desc(), "w")
    return (
        words.select("w", F.explode(F.array_compact(F.array(*models))).alias("e")).select("w", "e.*")
        .withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= 2 * max_words).select("w").distinct()
    )


def _only(sample: DataFrame, telling: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """The kept columns and which of the sorted telling words each text has."""
    kinds = dict(sample.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column("words"):
                words = np.frombuffer(value.as_py(), U)
                at = np.minimum(np.searchsorted(telling, words), max(len(telling) - 1, 0))
                packed.append((words[telling[at] == words] if len(telling) else words[:0]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(packed, pa.binary())], names=[*keep, "words"])

    return sample.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", words binary")


def _frequent(words: np.ndarray) -> np.ndarray:
    """Where words are that three texts or more have; others never become features."""
    ordered = np.sort(words)
    ordered = ordered[2:][ordered[2:] == ordered[:-2]]
    names = ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered
    held = np.zeros(len(words), bool)
    for part in _parts(len(words) if len(names) else 0):
        held[part] = names[np.minimum(np.searchsorted(names, words[part]), len(names) - 1)] == words[part]
    return held


def scored(docs: DataFrame, chain: list[Linear], names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) per row of docs. NULL and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = [np.zeros(batch.num_rows) for _ in chain]
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                words, to = text_features(data[at[0] : at[-1]], at - at[0])
                owner = np.repeat(np.arange(last - first), np.diff(to))
                for i, p in enumerate(chain_probabilities(chain, words, owner, last - first)):
                    out[i][first:last] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in out)], names=["doc_id", *columns])

    columns = [f"p_{n}" for n in names]
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = found.mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in columns))
    return found.withColumnRenamed("doc_id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) per row of docs, the models trained on labels
    (doc_id, quality, toxic). Repeated rows score alike; other columns are not read."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = train(docs, labels, categories, **options)
    rows = scored(docs, chain, list(categories))
    return rows.withColumn("toxic", F.col("p_toxic") >= threshold)


def rejected_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``toxicity_scores`` that are toxic."""
    return toxicity_scores(docs, labels, threshold, **options).where("toxic")


def keep_clean(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options
) -> DataFrame:
    """docs without those that the chain rejects, all columns kept; no shuffle.

    Rows with NULL id or text are judged by their text like all others."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    model = train(docs, labels, categories, text_col=text_col, **options)
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(names.index(text_col)))
            keep = np.ones(batch.num_rows, bool)
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                words, to = text_features(data[at[0] : at[-1]], at - at[0])
                owner = np.repeat(np.arange(last - first), np.diff(to))
                keep[first:last] = chain_probabilities(model, words, owner, last - first)[-1] < threshold
            yield batch.filter(pa.array(keep))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, kinds)

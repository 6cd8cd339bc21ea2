"""Toxicity: a counterfactual-regularised classifier of whole texts.

Fit. A bounded sample of labelled rows (``SAMPLE``; the least hashes of doc_id of each
class) is taken from the rows that may be learnt from. Features of a text are the
distinct lower-cased words, their beginnings and their endings; document counts by
label, summed in Spark, choose the ``TERMS`` that tell most. A logistic regression is
then fitted on these with two penalties: the squared weights, and the squared change of
a sentence's score when a group term in it is swapped for another of its group. So a
mention of a group can't move the score by itself, and neutral sentences about groups
aren't taken for toxic ones. Every sentence of every sampled text is swapped, a term at
a time; equal changes are counted in Spark, and the ``PAIRS`` commonest are penalised by
their counts.

Group terms are the fixed ``IDENTITY`` ones and, since texts mention groups that no list
has, the ``WORDS`` commonest words that the model would weigh, by themselves or their
beginning or ending, though most of the sampled texts with them aren't toxic. Those of
like frequency form a group.

Score. One pass over all texts without an exchange; a worker keeps a bounded memo of
words and the features they have.

Defined results: a null or empty text has the score of no features; repeated rows get
equal scores; rows without a label are scored like others; labels of several rows for
one doc_id count as toxic if any is; of a sampled doc_id that repeats with several texts
that of the least hash is learnt from; labels other than 0 and 1, or null, are no labels. Very
long texts are scored whole. Without labelled rows of both classes every score is the
prior. An empty table gives no rows. Extra columns are ignored by ``score`` and carried
by ``reject``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import small_batches, stage

#: Labelled rows to learn from: at most so many toxic ones, and other ones.
SAMPLE = (3000, 9000)
#: Features of the model.
TERMS = 1200
#: Distinct changes by swaps that are penalised.
PAIRS = 4000
#: Words of the sampled texts taken for group terms, and the size of a group.
WORDS, GROUP = 400, 4
LEAST_TEXTS = 4
LEAST_G2 = 15.0
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Identity terms, in groups whose members may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)


def features(word: str) -> list[str]:
    """A word's features: itself, its beginnings and its endings."""
    out = [f"={word}"]
    for n in (4, 5, 6):
        if len(word) > n:
            out += (f"^{word[:n]}", f"${word[-n:]}")
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swaps(words: set[str], groups: Iterable[tuple[str, ...]] = IDENTITY) -> Iterator[set[str]]:
    """The words with one group term swapped for the next of its group, or the next but one."""
    for g in groups:
        for i, term in enumerate(g):
            if term in words:
                for step in (1, 2):
                    other = g[(i + step) % len(g)]
                    if other != term:
                        yield (words - {term}) | {other}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    #: distinct changes by swaps that the fit has penalised
    pairs: int = 0

    def scorer(self):
        """A function of a text that keeps a memo of words."""
        index = {t: i for i, t in enumerate(self.weights)}
        w = list(self.weights.values())
        memo: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for word in words_of(text):
                found = memo.get(word)
                if found is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    found = memo[word] = tuple(index[f] for f in features(word) if f in index)
                if found:
                    hit.update(found)
            # summed in a fixed order, so that equal texts have equal scores everywhere
            z = max(-35.0, min(35.0, self.bias + math.fsum(w[i] for i in hit)))
            return 1 / (1 + math.exp(-z))

        return score


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def sample_ids(labels: DataFrame, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of the rows to learn from, at most sum(most) rows."""
    rows = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    bad = rows.filter("toxic = 1").orderBy(order, "doc_id").limit(most[0])
    return bad.unionByName(rows.filter("toxic = 0").orderBy(order, "doc_id").limit(most[1]))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label, summed within a task as far as memory allows."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        out = [[c[t] for t in terms] for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(out[1], pa.int64()), pa.array(out[0], pa.int64())], ["term", "bad", "good"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({f for w in words_of(text.as_py()) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield flush()
    yield flush()


def choose_terms(rates: DataFrame, n_bad: int, n_good: int, most: int = TERMS) -> list[str]:
    """The ``most`` features (term, bad, good) whose presence tells most about the label, by likelihood ratio."""
    share = F.lit(n_bad / (n_bad + n_good))
    seen = F.col("bad") + F.col("good")

    def part(k: F.Column, expected: F.Column) -> F.Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    total = n_bad + n_good
    g2 = 2 * (
        part(F.col("bad"), seen * share) + part(F.col("good"), seen * (1 - share))
        + part(n_bad - F.col("bad"), (total - seen) * share) + part(n_good - F.col("good"), (total - seen) * (1 - share))
    )
    told = rates.withColumn("z", g2).filter(F.col("z") > LEAST_G2)
    return [r["term"] for r in told.orderBy(F.desc("z"), "term").limit(most).collect()]


def mentioned_groups(rates: DataFrame, terms: list[str]) -> tuple[tuple[str, ...], ...]:
    """Groups of words with a feature among ``terms`` whose texts mostly aren't toxic; alike in frequency."""
    word = F.substring("term", 2, 2**31 - 1)
    common = rates.filter(F.col("term").startswith("=") & (F.col("good") > F.col("bad"))).select(word.alias("word"), (F.col("bad") + F.col("good")).alias("seen"))
    part = lambda n: F.when(F.length("word") > n, F.array(F.concat(F.lit("^"), F.left("word", F.lit(n))), F.concat(F.lit("$"), F.right("word", F.lit(n)))))
    held = F.flatten(F.filter(F.array(F.array(F.concat(F.lit("="), F.col("word"))), part(4), part(5), part(6)), lambda a: a.isNotNull()))
    chosen = rates.sparkSession.createDataFrame([(t,) for t in terms], "feature string")
    weighed = common.withColumn("feature", F.explode(held)).join(F.broadcast(chosen), "feature").select("word", "seen").distinct()
    found = [r["word"] for r in weighed.orderBy(F.desc("seen"), "word").limit(WORDS).collect()]
    groups = (tuple(found[i : i + GROUP]) for i in range(0, len(found), GROUP))
    return tuple(g for g in groups if len(g) > 1)


def _index_terms(terms: list[str], groups: tuple):
    """A row a text: toxic and the indices of its terms; and rows of changes by swaps: change and n.

    A change lists the terms that come as index + 1 and those that go as its negative.
    Changes are counted within a task, as far as memory allows.
    """
    index = {t: i for i, t in enumerate(terms)}
    held = {w: [g for g in groups if w in g] for g in groups for w in g}

    def of(words: set[str]) -> set[int]:
        return {index[f] for w in words for f in features(w) if f in index}

    def flush(counts: Counter) -> pa.RecordBatch:
        changes, n = list(counts), list(counts.values())
        counts.clear()
        none = [None] * len(n)
        return pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), pa.array(none, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.int32())), pa.array(n, pa.int64())], names)

    names = ["toxic", "own", "change", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            own = []
            for text in batch.column(0):
                said = text.as_py() or ""
                own.append(sorted(of(words_of(said))))
                for sentence in SENTENCE.split(said):
                    words = words_of(sentence)
                    near = {g for w in words & held.keys() for g in held[w]}
                    if near:
                        here = of(words)
                        for other in swaps(words, sorted(near)):
                            there = of(other)
                            if there != here:
                                counts[(*sorted(-i - 1 for i in here - there), *sorted(i + 1 for i in there - here))] += 1
            none = [None] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(none, pa.list_(pa.int32())), pa.array(none, pa.int64())], names)
            if len(counts) > 200_000:
                yield flush(counts)
        yield flush(counts)

    return run


def solve(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, times: np.ndarray, ridge: float = 3e-4, pairing: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression; ``pairs`` holds x swapped less x, each seen ``times``.

    Both classes count alike, so that 0.5 divides them where their evidence is equal.
    """
    n, k = x.shape
    times = (times / max(times.sum(), 1)).astype(np.float32)
    share = np.where(y == 1, 0.5 * n / max(y.sum(), 1), 0.5 * n / max(n - y.sum(), 1)).astype(np.float32)
    w, b = np.zeros(k, np.float32), np.float32(0)
    moment, square, mb, sb = np.zeros(k, np.float32), np.zeros(k, np.float32), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = share * (p - y)
        g = x.T @ error / n + ridge * w
        if len(pairs):
            g += pairing * 2 * pairs.T @ (times * (pairs @ w))
        gb = float(error.mean())
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate, c1, c2 = 0.05, 1 - 0.9**step, 1 - 0.999**step
        w -= (rate * (moment / c1) / (np.sqrt(square / c2) + 1e-8)).astype(np.float32)
        b -= np.float32(rate * (mb / c1) / (math.sqrt(sb / c2) + 1e-8))
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, groups: tuple = IDENTITY, pairing: float = 1.0) -> Model:
    """The classifier, from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    # at most sum(most) rows of two numbers
    ids = [tuple(r) for r in sample_ids(labels, most).collect()]
    n_bad, n_good = sum(t for _, t in ids), sum(1 - t for _, t in ids)
    if not n_bad or not n_good:
        return Model({}, math.log((n_bad + 0.5) / (n_good + 0.5)))
    taken = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(taken, "doc_id")
    # one text an id, else repeated rows would be learnt as often as they come, and be collected so below
    texts = stage(said.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"), "sampled")
    counted = texts.mapInArrow(_count_terms, "term string, bad long, good long")
    rates = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") + F.col("good") >= LEAST_TEXTS)
    rates = stage(rates, "rates")
    terms = choose_terms(rates, n_bad, n_good)
    groups = (*groups, *mentioned_groups(rates, terms))
    indexed = stage(texts.mapInArrow(_index_terms(terms, groups), "toxic int, own array<int>, change array<int>, n long"), "indexed")
    # of each sampled text, only which of the chosen terms it has; of all swaps, the commonest changes
    rows = indexed.filter("change IS NULL").select("toxic", "own").collect()
    changes = indexed.filter("change IS NOT NULL").groupBy("change").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "change").limit(PAIRS).collect()
    x, y, pairs = np.zeros((len(rows), len(terms)), np.float32), np.zeros(len(rows), np.float32), np.zeros((len(changes), len(terms)), np.float32)
    for i, (toxic, own) in enumerate(rows):
        x[i, own], y[i] = 1, toxic
    for i, (change, _) in enumerate(changes):
        for t in change:
            pairs[i, abs(t) - 1] = 1 if t > 0 else -1
    order = np.lexsort((y, x @ np.arange(1, len(terms) + 1, dtype=np.float64)))  # the same sums in any order of rows
    w, b = solve(x[order], y[order], pairs, np.array([n for _, n in changes], np.float32), pairing=pairing)
    return Model(dict(zip(terms, map(float, w), strict=True)), b, len(changes))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            ids = batch.column(0)
            out = [of(t.as_py()) for t in batch.column(1)]
            held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

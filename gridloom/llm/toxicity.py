"""Toxic passages by maximum-scoring segment search.

Words get log-odds between toxic and clean training texts under a Dirichlet prior;
those whose odds are surely high are evidence. A linear-time scan finds every maximal run of words whose summed
log-odds stands out, extreme-value statistics turn run scores into e-values and a
document statistic, and a table of label rates over that statistic, fitted on the
training documents, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

WORD = re.compile(r"[^\W_]+")
ALPHA = 0.5
SURE = 1.645
MIN_LOG_ODDS = 2.3
MIN_TOXIC_TEXTS = 3
#: Size of the model: the words of the highest sure log-odds that may carry evidence.
MAX_LEXICON = 50_000
MAX_E = 0.05
THRESHOLD = 0.3
BINS = 64
FOLD = 2


@dataclass
class Model:
    """Word weights, the weight of any other word, extreme-value parameters and label rates by bin."""

    weights: dict[str, float]
    other: float
    lam: float
    k: float
    rates: list[float] | None = None


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves FOLD modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic (0/1) of the labelled texts outside the held-out fold, equal texts once.

    Of several labels of a document or text the largest counts. Equal texts are found by
    their hashes, and of each only the row of the least doc_id (with its exact repeats)
    is read. The joins are sort-merge joins at any size, as texts must not be collected
    beside a table of labels that grows with them.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("key"))
    chosen = rows.select("doc_id", "key").join(known.hint("merge"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    return rows.join(chosen.hint("merge"), ["doc_id", "key"]).select("text", "toxic")


def word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: texts of either class that hold it, and uses in clean texts. The empty word counts texts."""

    def run(batches):
        for batch in batches:
            texts = (Counter(), Counter())
            uses: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                texts[toxic == 1].update({"", *words})
                if toxic != 1:
                    uses.update(words)
            words = list({**texts[0], **texts[1]})
            columns = [words, [texts[1][w] for w in words], [texts[0][w] for w in words], [uses[w] for w in words]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "toxic", "clean", "uses"])

    parts = rows.mapInArrow(run, "word string, toxic bigint, clean bigint, uses bigint")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "uses")])


def log_odds(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """word, weight (log ratio of the classes' rates under the prior) and sure, its lower confidence bound."""
    a, b = F.col("toxic") + ALPHA, F.col("clean") + ALPHA
    weight = F.log(a / (n1 + 2 * ALPHA)) - F.log(b / (n0 + 2 * ALPHA))
    return counts.select("word", "toxic", "uses", weight.alias("weight"), (weight - SURE * F.sqrt(1 / a + 1 / b)).alias("sure"))


def karlin(scores: np.ndarray, probs: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law of segment scores of independent words.

    lambda solves E[exp(lambda s)] = 1. K is an approximation, lambda * |E[s]| * P(s > 0) kept
    within (0, 1], so e-values rank passages; their level is set by the label rates.
    """
    low, high = 1e-6, 1.0
    value = lambda x: float(np.dot(probs, np.exp(x * scores))) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    lam = (low + high) / 2
    drift = abs(float(np.dot(probs, scores)))
    return lam, min(1.0, max(1e-4, drift * lam * float(probs[scores > 0].sum()) + 1e-4))


def learn(docs: DataFrame, labels: DataFrame, max_lexicon: int = MAX_LEXICON) -> Model:
    """Model of the labelled training rows; without toxic rows no word carries evidence."""
    rows = labelled(docs, labels)
    counts = cut(word_counts(rows))
    total = counts.filter("word = ''").first()
    if not total or not total.toxic or not total.clean:
        return Model({}, -1.0, 1.0, 1.0)
    n0 = int(counts.agg(F.sum("uses")).first()[0])
    scored = log_odds(counts.filter("word <> ''"), total.toxic, total.clean).filter((F.col("sure") >= MIN_LOG_ODDS) & (F.col("toxic") >= MIN_TOXIC_TEXTS))
    lexicon = scored.orderBy(F.desc("sure"), "word").limit(max_lexicon).select("word", "weight", "uses").toPandas()
    weights = dict(zip(lexicon.word, lexicon.weight.astype(float), strict=True))
    # words without evidence cost so much that a clean text drifts down by 0.05 a word on average
    p_up = float(lexicon.uses.sum() + 1) / (n0 + 2)
    gain = float(np.average(lexicon.weight, weights=lexicon.uses + 1)) if len(lexicon) else 1.0
    other = -(p_up * gain + 0.05) / (1 - p_up)
    probs = np.array([*((lexicon.uses.to_numpy() + 1) / (lexicon.uses.sum() + len(lexicon) + 1e-9) * p_up), 1 - p_up])
    lam, k = karlin(np.array([*lexicon.weight, other], dtype=float), probs / probs.sum())
    return Model(weights, other, lam, k)


def segments(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    """start, end (word places) and score of all maximal-scoring runs, in one pass over the evidence words.

    The list of candidates keeps for each the score before it and at its end; a new
    candidate joins all back to the last one that starts lower, as long as it ends higher.
    """
    found: list[list[float]] = []  # start, end, score before start, score at end
    total, at = 0.0, 0
    weights = model.weights
    for i, word in enumerate(words):
        if (weight := weights.get(word)) is None:
            continue
        before = total + model.other * (i - at)
        total, at = before + weight, i + 1
        cand = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cand[2]:
                j -= 1
            if j < 0 or found[j][3] >= cand[3]:
                found.append(cand)
                break
            cand = [found[j][0], cand[1], found[j][2], cand[3]]
            del found[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in found]


def statistic(runs: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """Evidence of a document: -log10 of the chance that n clean words hold such runs, 0 without runs.

    Significant runs add up; otherwise the best one counts.
    """
    e = sorted(model.k * max(1, n) * math.exp(-min(600.0, model.lam * s)) for _, _, s in runs)
    if not e:
        return 0.0
    log_p = lambda x: -math.log10(max(1e-300, -math.expm1(-x)))
    strong = [x for x in e if x <= MAX_E]
    return sum(map(log_p, strong)) if strong else log_p(e[0])


def _bin(x: float) -> int:
    """Bins of the statistic: none, then twelfths of its logarithm."""
    return 0 if x <= 0 else max(1, min(BINS - 1, int(32 + 12 * math.log10(x))))


SCANNED = "doc_id bigint, n_words bigint, stat double, bin int, passages array<struct<start:int,end:int,score:double,e_value:double>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, stat, bin and the significant passages (word places) of every row."""

    def run(batches):
        lexicon = model.weights.keys()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                runs = [] if lexicon.isdisjoint(words) else segments(words, model)
                stat = statistic(runs, len(words), model)
                spans = [{"start": a, "end": b, "score": s, "e_value": e} for a, b, s in runs if (e := model.k * max(1, len(words)) * math.exp(-min(600.0, model.lam * s))) <= MAX_E]
                rows.append((doc, len(words), stat, _bin(stat), spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "stat", "bin", "passages"])

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))]
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCANNED)


def _rates(table: list[tuple[int, int, int]]) -> list[float]:
    """Label rate by bin of the statistic, monotone by pooling neighbours that fall, shrunk to the overall rate."""
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for b, count, toxic in table:
        n[b], hits[b] = count, toxic
    base = (hits.sum() + 0.5) / (n.sum() + 1)
    pools: list[list[float]] = []
    for b in range(BINS):
        pools.append([hits[b] + base * 0.5, n[b] + 0.5, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            h, c, k = pools.pop()
            pools[-1][0] += h
            pools[-1][1] += c
            pools[-1][2] += k
    return [h / c for h, c, k in pools for _ in range(int(k))]


def train(docs: DataFrame, labels: DataFrame, max_lexicon: int = MAX_LEXICON) -> tuple[Model, DataFrame]:
    """The calibrated model, and the scan of all docs that calibrated it."""
    model = learn(docs, labels, max_lexicon)
    scanned = cut(scan(docs, model))
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    table = scanned.filter(~held_out(F.col("doc_id"))).join(known, "doc_id").groupBy("bin").agg(F.count("*"), F.sum("toxic")).collect()
    model.rates = _rates([(int(b), int(c), int(t)) for b, c, t in table])
    return model, scanned


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, stat and passages of every row of docs.

    score (0 to 1) is the training label rate at the row's evidence; predicted is 1 from
    threshold on. Null and empty texts have no evidence and get the rate of such texts.
    Rows are scored one by one, repeats too; a null doc_id is in no fold. Labels outside
    the training folds are not read. Other columns are ignored.
    """
    model, scanned = train(docs, labels)
    score = F.element_at(F.array(*[F.lit(float(r)) for r in model.rates]), F.col("bin") + 1)
    rows = scanned.withColumn("score", score)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "stat", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents predicted toxic; a doc_id goes where any of its rows does."""
    bad = toxicity(docs, labels, threshold).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)

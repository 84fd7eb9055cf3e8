"""Toxicity by multiple-instance learning: a document is a bag of sentences, of which labels say only whether some are toxic.

A sentence's probability is logistic in its distinct words; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Weights are
fitted to document labels alone; the sentences' probabilities then say where the offence is. A sentence's prior odds fall with the number of
sentences, so that a document's don't rise with its length: n clean sentences together are as likely toxic as one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_batches, table, written

#: The bound of the labelled sample that weights are fitted to: documents of either label, and code points of all (whole documents, in the order of hashed ids, as long as they fit).
FIT_DOCS = 1500
FIT_CHARS = 20_000_000
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W_]+")


#: Letters of a word's beginning that are a feature of their own, for words whose endings vary.
STEM = 4


def features(sentence: str) -> set[str]:
    """Different words of a lower-case sentence, and beginnings of the longer ones."""
    words = {*WORD.findall(sentence)}
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def bag(text: str) -> list[set[str]]:
    """The features of each sentence that has words, in order; one without any if none has."""
    return [f for f in map(features, SENTENCE.split(text.lower())) if f] or [set()]


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    bias: float

    def logit(self, words: set[str], n: int) -> float:
        """Of a sentence, one of n."""
        get = self.words.get
        return self.bias - math.log(n) + math.fsum(get(w, 0.0) for w in words)

    def logits(self, text: str) -> list[float]:
        sentences = bag(text)
        return [self.logit(f, len(sentences)) for f in sentences]

    def score(self, text: str) -> float:
        return noisy_or(self.logits(text))

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that are at least so likely toxic, in code points of the text; if the document is and none of them, of the likeliest."""
        found, start = [], 0
        ends = [(m.start(), m.end()) for m in SENTENCE.finditer(text)] + [(len(text), len(text))]
        for stop, after in ends:
            if f := features(text[start:stop].lower()):
                found.append((start, stop, f))
            start = after
        out = [(a, b, 1 / (1 + math.exp(-max(-700.0, self.logit(f, len(found)))))) for a, b, f in found]
        sure = [x for x in out if x[2] >= least]
        return sure or [max(out, key=lambda x: x[2])] * bool(out)


def softplus(z: float) -> float:
    return z if z > 35 else math.log1p(math.exp(z))


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - sigmoid(z)): log(1 - sigmoid(z)) is -softplus(z)."""
    return -math.expm1(-math.fsum(map(softplus, logits)))


def fit(texts: list[str], toxic: list[int], steps: int = 300, decay: float = 2e-4) -> Model:
    """Weights by gradient descent (Adam) on the documents' log loss; without both labels, every score is the share of label 1.

    Words have a weight that at least four documents have and whose log odds of either label differ by more than 2.5 standard errors.
    """
    y = np.asarray(toxic, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return Model({}, math.log(1e-3 if not len(y) or not y.any() else 1e3))
    ids: dict[str, int] = {}
    doc, size, col, pair_doc, pair_word = (array("q") for _ in range(5))
    for d, t in enumerate(texts):
        seen: set[int] = set()
        for words in bag(t):
            own = [ids.setdefault(w, len(ids)) for w in words]
            doc.append(d)
            size.append(len(own))
            col.extend(own)
            seen.update(own)
        pair_doc.extend([d] * len(seen))
        pair_word.extend(seen)
    doc, size, col, pair_doc, pair_word = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, dtype=np.int64) for x in (doc, size, col, pair_doc, pair_word))
    n0, n1 = int((~y).sum()), int(y.sum())
    c1 = np.bincount(pair_word[y[pair_doc]], minlength=len(ids))
    c0 = np.bincount(pair_word[~y[pair_doc]], minlength=len(ids))
    a, b = c1 + 0.5, c0 + 0.5
    z = np.abs(np.log(a / (n1 - c1 + 0.5)) - np.log(b / (n0 - c0 + 0.5))) / np.sqrt(1 / a + 1 / b)
    chosen = (c0 + c1 >= 4) & (z > 2.5)
    # numbered in the order of words, so that sums don't depend on the order in which words were met
    names = sorted(w for w, i in ids.items() if chosen[i])
    at = np.full(len(ids), -1)
    at[[ids[w] for w in names]] = np.arange(len(names))
    n = len(doc)
    row, col = np.repeat(np.arange(n), size), at[col] if len(col) else col
    row, col = row[col >= 0], col[col >= 0]
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    prior = np.log(np.bincount(doc, minlength=len(y)))[doc]
    weight = np.where(y, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), -2.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b - prior + np.bincount(row, w[col], n)
        a = np.bincount(doc, np.logaddexp(0, z), len(y)) + 1e-9
        slope = weight * np.where(y, -1 / np.expm1(np.minimum(a, 500)), 1.0)  # of the loss by a
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(col, dz[row], len(names)) + decay * w / max(1, len(names)) ** 0.5, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({x: float(w[i]) for i, x in enumerate(names) if abs(w[i]) > 1e-3}, float(b))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs(doc_id, text) with labels(doc_id, toxic) but for held-out ids (crc32(doc_id as text) mod 5 is 0).

    Of each label, the FIT_DOCS documents whose hashed ids are least are taken, as long as their whole texts have FIT_CHARS code points together: what the driver gets
    is bounded, and does not depend on the order of rows. Null texts count as empty; null ids and labels are left out; of rows that repeat an id the longest text counts.
    """
    y = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    picks = None
    for label in (0, 1):
        one = y.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
        picks = one if picks is None else picks.union(one)
    text = F.coalesce("text", F.lit(""))
    sample = docs.select("doc_id", F.struct(F.length(text).alias("n"), text.alias("text")).alias("t")).join(F.broadcast(picks), "doc_id").groupBy("doc_id").agg(F.max("t").alias("t"), F.max("toxic").alias("toxic"))
    sample = written(sample.select("doc_id", F.xxhash64("doc_id").alias("h"), "t.n", "t.text", "toxic"), "toxicity-sample")
    before = F.sum("n").over(Window.orderBy("h", "doc_id"))  # of a few thousand numbers
    fits = sample.select("doc_id", "h", "n").withColumn("upto", before).where(F.col("upto") <= FIT_CHARS).select("doc_id")
    rows = sample.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.toxic for r in rows])


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and offending: start, end and probability of each toxic sentence, for scores of 0.5 at least.

    Whole texts are read; null counts as empty. Own columns of those names are replaced, rows that repeat stay, no rows give no rows.
    """
    byte_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                score = m.score(t)
                spans = m.offending(t) if score >= 0.5 else []
                rows.append((score, [{"start": a, "end": b, "p": p} for a, b, p in spans]))
            yield pd.DataFrame(rows, columns=["score", "offending"])

    udf = F.pandas_udf(work, "score double, offending array<struct<start:int,end:int,p:double>>")
    own = [c for c in docs.columns if c not in ("score", "offending")]
    return docs.select(*own, udf(F.col(text_col)).alias("_scored")).select(*own, "_scored.score", "_scored.offending")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every row of documents, also without text or doc_id (which then isn't held out)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    s = scored(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("offending").alias("offending_sentences"))

"""Toxicity (operator 1): multiple-instance learning. A document's score is the noisy-or of its sentences' scores, and
the sentence scorer is trained from document labels alone; the same scores then locate the offending sentences."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, removed, session, written
from .pretokens import Cache

SENTENCE = re.compile(r"[.!?\n]+")
EDGE = ".,;:!?\"'()[]{}<>*#&%$@-_|/\\~^+=…«»“”‘’"
#: Hashed feature space; labelled documents that a model is fitted on at most, clean and toxic; cut of the verdict.
FEATURES, SAMPLE, CUT = 1 << 20, (4000, 2000), 0.7
#: A feature is used if it is in so many documents of the sample, and so many deviations oftener in toxic ones than by chance.
LEAST, SIGNIFICANT = 4, 3.5


def features(word: str) -> list[int]:
    """The word and its first letters, hashed: stems show what inflected and compound words share."""
    w = word.strip(EDGE).lower()
    if not w:
        return []
    return [_hash(f"w {w}"), *(_hash(f"{n} {w[:n]}") for n in (4, 5, 6, 7, 8) if len(w) > n)]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & (FEATURES - 1)


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


@dataclass
class Model:
    """Weights of the hashed features; a sentence's logit is their sum, the bias, and less ``slope`` times the logarithm of the
    sentences of its document: so the share that clean sentences add to the noisy-or doesn't grow with the document."""

    weights: np.ndarray
    bias: float
    slope: float = 0.0

    def scorer(self):
        """score(text) -> (document score, index of its highest sentence, that sentence's score)."""
        weights, bias, slope = self.weights, self.bias, self.slope

        def word(w: str) -> float:
            return float(sum(weights[f] for f in features(w)))

        words = Cache(lambda new: map(word, new))

        def of(texts: list[str]) -> list[tuple[float, int, float]]:
            split = [[s.split() for s in SENTENCE.split(t)] for t in texts]
            every = {w for ss in split for s in ss for w in s}
            value = words(every).__getitem__
            out = []
            for ss in split:
                logits = np.array([sum(map(value, s)) for s in ss if s] or [0.0])
                logits += bias - slope * np.log(len(logits))
                log_clean = -np.logaddexp(0, logits)  # log(1 - p) of each sentence
                top = int(logits.argmax())
                out.append((float(-np.expm1(log_clean.sum())), top, float(-np.expm1(log_clean[top]))))
            words.trim(every)
            return out

        return of


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.15, l2: float = 1e-4) -> Model:
    """Gradient steps (Adam) on the noisy-or likelihood, both classes weighing alike.

    A row is (label, lengths of its sentences, features of all of them in turn). Without rows of both classes, the model says the one class there is (0 if none).
    """
    labels = np.array([y for y, _, _ in rows], float)
    w, b, slope = np.zeros(FEATURES), -6.0, 0.5
    if not len(rows) or labels.min() == labels.max():
        return Model(w.astype(np.float32), 2.0 if len(rows) and labels[0] == 1 else b)
    lengths = [x if len(x) else np.zeros(1, np.int32) for _, x, _ in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in lengths])
    n = len(doc)
    feat = np.concatenate([f for _, _, f in rows])
    sent = np.repeat(np.arange(n), np.concatenate(lengths))
    used, feat = np.unique(feat, return_inverse=True)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(rows)
    v = np.zeros(len(used))
    several = np.log(np.bincount(doc))[doc]
    m1, m2 = np.zeros(len(used) + 2), np.zeros(len(used) + 2)  # moments of v, b and slope
    for t in range(1, steps + 1):
        z = np.bincount(sent, weights=v[feat], minlength=n) + b - slope * several
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(rows))  # log P(no sentence offends)
        dirty = -np.expm1(np.minimum(clean, -1e-12))
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        dz = (weight * np.where(labels == 1, -np.exp(clean) / dirty, 1.0))[doc] * p
        g = np.r_[np.bincount(feat, weights=dz[sent], minlength=len(used)) + l2 * v, dz.sum(), -(dz * several).sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        go = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        v, b, slope = v - go[:-2], b - go[-2], max(0.0, slope - go[-1])
    w[used] = v
    return Model(w.astype(np.float32), float(b), float(slope))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _frequencies(batches):
    """(feature, documents, toxic documents) over the rows (y, text) of a task."""
    n, toxic = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    words = Cache(lambda new: map(features, new))
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = set(text.split())
            value = words(own)
            found = np.unique(np.array([f for w in own for f in value[w]], np.int64))
            n[found] += 1
            toxic[found] += y
            words.trim(own)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(toxic[seen])], names=["f", "n", "toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits a model on at most ``sample`` clean and toxic documents, the first by a hash of their id.

    Ids that the split holds out, null ids and labels other than 0 and 1 aren't used; of repeated labels of an id
    the highest counts. The ids are chosen on labels alone, then that many documents are read out of docs by a
    broadcast of those ids and written, one row for each id. Executors count the features of whole texts, of which those that tell the classes
    apart are kept (a bounded table); what comes to the driver is those features of the sample's sentences.
    """
    spark = session(docs)
    y, key = F.col(f"`{label}`"), F.col(f"`{doc_id}`").cast("long")
    of = labels.select(key.alias("doc_id"), y.cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    of = of.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [of.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[c]).collect() for c in (0, 1)]
    ids = [(r.doc_id, r.y) for rows in chosen for r in rows]
    if not ids:
        return fit([])
    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))  # as many rows as the sample at most
    src = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # of the rows of a sampled id one is used, the least by a hash, so there are as many texts as the sample at most
    texts = written(src.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    rate = len(chosen[1]) / len(ids)
    told = texts.select("y", "text").mapInArrow(_frequencies, "f long, n long, toxic long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    beyond = F.col("toxic") - F.col("n") * rate >= SIGNIFICANT * F.sqrt(F.col("n") * rate * (1 - rate))
    kept = {r.f for r in told.where((F.col("n") >= LEAST) & beyond).select("f").collect()}

    def make():
        words = Cache(lambda new: ([f for f in features(w) if f in kept] for w in new))

        def of(texts):
            lengths, found = [], []
            for t in texts:
                split = [s.split() for s in sentences(t)]
                every = {w for s in split for w in s}
                value = words(every).__getitem__
                each = [[f for w in s for f in value(w)] for s in split]
                words.trim(every)
                lengths.append(np.array([len(s) for s in each], np.int32).tobytes())
                found.append(np.array([f for s in each for f in s], np.int32).tobytes())
            return [lengths, found]

        return of

    fields = [T.StructField("lengths", T.BinaryType()), T.StructField("features", T.BinaryType())]
    rows = map_text(texts, ["doc_id", "y"], fields, make).collect()
    removed(texts)
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    return fit([(r.y, np.frombuffer(r.lengths, np.int32), np.frombuffer(r.features, np.int32)) for r in rows])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", cut: float = CUT) -> DataFrame:
    """``keep``, score (0 to 1), predicted (1 if score >= cut), top_sentence and top_score of each whole text.

    Null, empty or blank texts have the score of one empty sentence. The highest sentence is numbered among those that
    hold a word, from 0; the first of equals. Repeated rows and null ids are scored each; an empty table gives an empty
    one; other columns are dropped. One narrow stage; the model is a fixed-size array.
    """
    known = session(docs).sparkContext.broadcast(model)

    def make():
        of = known.value.scorer()

        def scored(texts):
            got = of(texts)
            return [[s for s, _, _ in got], [int(s >= cut) for s, _, _ in got], [i for _, i, _ in got], [p for _, _, p in got]]

        return scored

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("top_sentence", T.IntegerType()), T.StructField("top_score", T.DoubleType())]
    return map_text(docs, keep, fields, make, text)


def located(docs: DataFrame, model: Model, keep: list[str], text: str = "text", cut: float = 0.5) -> DataFrame:
    """``keep`` and sentences array<struct<text, score>>: the sentences whose own score is at least cut, in their order.

    Null, empty and clean texts have none; repeated rows and null ids are kept each, an empty table gives an empty one, other
    columns are dropped, and one named sentences can't be kept (ValueError)."""
    known = session(docs).sparkContext.broadcast(model)

    def make():
        of = known.value.scorer()

        def found(texts):
            out = []
            for t in texts:
                ss = sentences(t)
                out.append([{"text": s, "score": p} for s, (_, _, p) in zip(ss, of(ss)) if p >= cut])
            return [out]

        return found

    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))
    return map_text(docs, keep, [T.StructField("sentences", kind)], make, text)

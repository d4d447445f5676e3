"""Toxicity by multiple-instance learning.

A document is a bag of sentences (runs between line ends and . ! ? or their like in other scripts). A sentence's score is a
logistic function of hashed features of its distinct words (the word, and its first 3 to 6
bytes, which catches inflected stems); the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Weights are learned from document labels alone, by Adagrad on the noisy-or
likelihood with an L1 shrinkage that keeps them sparse. `offending` then locates the
sentences that carry the score.

Training takes a bounded sample, `max_docs` (4,000) labelled documents, half of each label at most, those of the
smallest hash, while together they hold at most `max_chars` (64 million) characters; texts are whole, and a long one is as likely
to be taken as a short one. All statistics of the sample are the classifier's own. Scoring reads every text.

Edge cases: empty or null text scores the bag with one empty sentence; a doc_id with several
labels takes the largest; null labels do not train; without any label every sentence has the
untrained, low score; a null doc_id is held out; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table
from .textids import crc

BITS = 18
#: Sentence ends beyond ASCII (Chinese and full-width, Arabic and Urdu, Hindi, Ethiopic, Armenian, Burmese, Khmer, Tibetan, ellipsis).
ENDS = str.maketrans(dict.fromkeys("。！？．｡؟۔।॥።፧፨։၊။។៕།…‼⁇⁈⁉", "."))
_MAP = bytes(46 if chr(c) in ".!?\n" else 32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def _features(word: bytes) -> tuple[int, ...]:
    m = (1 << BITS) - 1
    if word == b".":
        return ()
    return (crc(b"w" + word) & m, *(crc(b"p" + word[:k]) & m for k in (3, 4, 5, 6) if len(word) >= k))


def words_of(text: str) -> list[bytes]:
    if not text.isascii():
        text = text.translate(ENDS)
    return text.encode("utf-8", "replace").lower().translate(_MAP).replace(b".", b" . ").split()


def bag(text: str | None) -> list[np.ndarray]:
    """The distinct features of each sentence."""
    out, cur = [], set()
    for w in words_of(text or ""):
        if w == b".":
            if cur:
                out.append(np.fromiter(cur, np.int64))
            cur = set()
        else:
            cur.update(_features(w))
    if cur:
        out.append(np.fromiter(cur, np.int64))
    return out or [np.zeros(0, np.int64)]


def train(texts: list[str | None], labels: list[int], epochs: int = 12, rate: float = 0.3, l1: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights by feature, and the bias of a sentence."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), -5.0, 1.0
    if not labels:
        return w, bias
    bags = []
    for t in texts:
        parts = bag(t)
        bags.append((np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])[:-1], np.array([len(p) for p in parts])))
    pos = max(1, sum(labels))
    weight = {1: min(10.0, len(labels) / 2 / pos), 0: len(labels) / 2 / max(1, len(labels) - pos)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, _, n = bags[k]
            owner = np.repeat(np.arange(len(n)), n)
            s = np.clip(np.bincount(owner, w[ids], len(n)) + bias, -30, 30)
            p = 1 / (1 + np.exp(-s))
            keep = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()  # log of prod(1 - p)
            doc = -np.expm1(keep)
            # d loss / d s: for label 0 it is p, for label 1 it is -p (1 - doc) / doc
            gs = weight[labels[k]] * (p if not labels[k] else -p * np.exp(keep) / max(doc, 1e-9))
            u, at = np.unique(ids, return_inverse=True)
            g = np.bincount(at, gs[owner], len(u))
            g2[u] += g * g
            step = rate / np.sqrt(g2[u])
            v = w[u] - step * g
            w[u] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
            gb = gs.sum()
            b2 += gb * gb
            bias -= rate * gb / np.sqrt(b2)
    return w, float(bias)


class Places:
    """Memo of words in a worker: each word's features, as a row padded with the weightless feature 2**BITS.
    It forgets everything at `bound` words; a sentence's end is the place -1."""

    def __init__(self, bound: int = 100_000):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {b".": -1}
        self.rows = np.full((1 << 12, 5), 1 << BITS, np.int32)

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.bound:
            self.clear()
        for w in [w for w in set(words) if w not in self.index]:
            k = len(self.index) - 1
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.full_like(self.rows, 1 << BITS)])
            f = _features(w)
            self.rows[k, : len(f)] = f
            self.index[w] = k
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def scorer(w: np.ndarray, bias: float):
    """text -> p of each of its sentences, by their distinct features, as in training."""
    memo, padded = Places(), np.append(w, 0).astype(w.dtype)

    def score(text: str | None) -> np.ndarray:
        place = memo.look(words_of(text or ""))
        is_end = place < 0
        if is_end.all():
            return 1 / (1 + np.exp(-np.full(1, bias)))
        owner = np.cumsum(is_end)[~is_end]
        owner = np.cumsum(np.diff(owner, prepend=owner[0]) > 0)  # sentences without a word do not count
        f = memo.rows[place[~is_end]]
        row, col = np.nonzero(padded[f])
        seen = np.unique((owner[row] << BITS) | f[row, col])
        s = np.bincount(seen >> BITS, padded[seen & ((1 << BITS) - 1)], owner[-1] + 1) + bias
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    return score


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int) -> tuple[list, list]:
    """At most max_docs labelled texts outside the held-out fold, half of each label at most, with max_chars characters at most."""
    lab = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 5))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    ids = lab.withColumn("o", order)
    ids = ids.where("toxic = 1").orderBy("o", "doc_id").limit(max_docs // 2).union(
        ids.where("toxic <> 1").orderBy("o", "doc_id").limit(max_docs // 2))
    chosen = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # max_docs rows at most
    d = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id may stand on several rows: sizes come first, max_docs of them at most
    sizes = d.select("o", "doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct().orderBy("o", "doc_id", "key").limit(max_docs).collect()
    kept, left = [], max_chars
    for r in sizes:
        if r["n"] <= left:
            kept.append((r["doc_id"], r["key"]))
            left -= r["n"]
    if not kept:
        return [], []
    kept = docs.sparkSession.createDataFrame(kept, "doc_id long, key long")
    rows = d.withColumn("key", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "key"]).groupBy("doc_id", "key", "toxic").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["key"]))
    return [r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (noisy-or), n_sentences, worst (index of the likeliest sentence, from 0)."""
    w, bias = model
    sc = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer(*sc.value)
        for pdf in batches:
            ps = [score(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "score": [float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) for p in ps],
                "n_sentences": [len(p) for p in ps], "worst": [int(p.argmax()) for p in ps]})

    # ids pass the worker as text: beside a null, pandas would hold them as doubles
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double, n_sentences long, worst long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def offending(text: str, model: tuple[np.ndarray, float], least: float = 0.5) -> list[tuple[int, float]]:
    """(index, p) of the sentences that are toxic by themselves."""
    return [(k, float(p)) for k, p in enumerate(scorer(*model)(text)) if p >= least]


def op4_toxicity(spark, sf_dir: str, max_docs: int = 4000, max_chars: int = 64_000_000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*sample(docs, table(spark, sf_dir, "labels"), max_docs, max_chars))
    out = toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_sentences", "worst")

"""Language identification.

Texts become runs of lower-case letters with single spaces between; character n-grams of
one to three are hashed to 2**BITS features. A feature's value is its share of the text's
n-grams times its inverse document frequency; document frequencies are counted over all
training documents. A sparse multinomial logistic regression is trained by
follow-the-regularised-leader (per coordinate, elastic net: L1 and L2) on a bounded sample
of whole texts: of every language some `per_lang` (500), those of the smallest hashes while together they hold at most
`max_chars` (16 million) characters, and one at least. A tenth of each language's sample (none of fewer than ten texts), kept out
of training, sets the temperature that calibrates the scores. The table of weights takes 256 kB a language.

As the value is linear in occurrences, a text is scored by summing one table row per n-gram.

Edge cases: a text that is null or has no letter is `und` with score 0; with no labelled
document everything is `und`; null lang does not train; ties between languages go to the
name that sorts first; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, table

BITS = 16
SCALE = 30.0
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    if not _TABLE:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                t[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def codes(text: str) -> np.ndarray:
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    space = c == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    c = c[keep]
    if not len(c) or (c == 32).all():
        return np.zeros(0, np.uint32)
    return np.pad(c, (int(c[0] != 32), int(c[-1] != 32)), constant_values=32)


def features(c: np.ndarray) -> np.ndarray:
    """The hashed n-grams of one text, in no particular order; never 0."""
    m = np.uint32((1 << BITS) - 2)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([((h ^ (h >> np.uint32(15))) % m) + np.uint32(1) for h in (one, two, three)])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature, over all rows of docs(text): at most 2**BITS sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                if len(c := codes(text or "")):
                    seen = np.zeros(1 << BITS, bool)
                    seen[features(c)] = True
                    df += seen
                    n += 1
        df[0] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"k": at, "n": df[at]})

    rows = docs.select("text").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    n, out[0] = int(out[0]), 0
    return out, n


def _values(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    c = codes(text or "")
    if not len(c):
        return None
    f = features(c)
    u, n = np.unique(f, return_counts=True)
    return u.astype(np.int64), SCALE * n / len(f) * idf[u]


def train(texts: list, langs: list[str], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
          l2: float = 0.02, seed: int = 5) -> tuple[list[str], np.ndarray, float]:
    """Names, weights (feature, language) and temperature."""
    names = sorted(set(langs))
    place = {name: k for k, name in enumerate(names)}
    rows = [(place[y], *v) for t, y in zip(texts, langs) if (v := _values(t, idf))]
    if not rows:
        return [], np.zeros((1 << BITS, 1), np.float32), 1.0
    z, n = np.zeros((1 << BITS, len(names)), np.float32), np.zeros((1 << BITS, len(names)), np.float32)

    def weights(zu: np.ndarray, nu: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(nu)) / alpha + l2))

    rng = np.random.default_rng(seed)
    hold, fit, seen, of = [], [], [0] * len(names), np.bincount([r[0] for r in rows], minlength=len(names))
    for r in rng.permutation(len(rows)):
        y = rows[r][0]
        seen[y] += 1
        (hold if seen[y] <= of[y] // 10 else fit).append(r)
    for _ in range(epochs):
        for r in rng.permutation(fit):
            y, u, x = rows[r]
            zu, nu = z[u], n[u]
            w = weights(zu, nu)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = nu + g * g
            z[u] = zu + g - (np.sqrt(more) - np.sqrt(nu)) / alpha * w
            n[u] = more
    best, w_of = (np.inf, 1.0), lambda u: weights(z[u], n[u])
    if hold:
        s = np.array([rows[r][2] @ w_of(rows[r][1]) for r in hold])
        y = np.array([rows[r][0] for r in hold])
        for t in np.geomspace(0.1, 10, 41):
            a = s / t
            a = a - a.max(1, keepdims=True)
            best = min(best, (float(np.mean(np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y])), float(t)))
    w = weights(z, n).astype(np.float32)
    w[0] = 0
    return names, w, best[1]


def sample(docs: DataFrame, per_lang: int, max_chars: int) -> tuple[list, list]:
    """Whole texts, about per_lang of each language, in all at most max_chars characters but for each language's first."""
    counts = cut(docs.groupBy("lang").count(), "languages")  # one row a language
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"))
    d = docs.withColumn("place", place).join(counts, "lang")
    d = d.withColumn("room", F.col("place") / share)  # below 1: in the sample
    k = counts.count()
    # ids alone are ranked; texts follow once it is known how far the characters reach
    light = d.where("room < 1").select("lang", "room", F.length("text").alias("n")).limit(2 * per_lang * max(1, k)).collect()
    light += d.groupBy("lang").agg(F.min(F.struct("room", F.length("text").alias("n"))).alias("s")).select("lang", "s.room", "s.n").collect()
    last, left, seen = {}, max_chars, set()
    for room, lang, n in sorted({(r["room"], r["lang"], r["n"] or 0) for r in light}):
        if lang not in last or (lang not in seen and n <= left):
            last[lang] = room
            left -= n
        else:
            seen.add(lang)
    if not last:
        return [], []
    ends = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last double")
    rows = d.join(F.broadcast(ends), "lang").where("room <= last").select("text", "lang", "room").collect()
    rows.sort(key=lambda r: (r["room"], r["lang"], r["text"] or ""))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, per_lang: int = 500, max_chars: int = 16_000_000):
    """The model, learned from docs(doc_id, text, lang) whose lang is not null."""
    docs = docs.where("lang is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    names, w, t = train(*sample(docs, per_lang, max_chars), idf)
    return names, (w * idf[:, None] * (SCALE / t)).astype(np.float32)


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs' columns and __l_pred, __l_score."""
    names, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((names, weights))

    @F.pandas_udf("pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, weights = shared.value
        pred, score = [], []
        for t in texts:
            c = codes(t or "")
            if not len(c) or not names:
                pred.append("und")
                score.append(0.0)
                continue
            f = features(c)
            s = np.zeros(len(names))
            for a in range(0, len(f), 1 << 20):
                s += weights.take(f[a: a + (1 << 20)], axis=0).sum(0, dtype=np.float64)
            s /= len(f)
            p = np.exp(s - s.max())
            p /= p.sum()
            pred.append(names[int(p.argmax())])
            score.append(float(p.max()))
        return pd.DataFrame({"pred": pred, "score": score})

    out = docs.withColumn("__l_r", run(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__l_r.pred").alias("__l_pred"), F.col("__l_r.score").alias("__l_score"))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), F.col("__l_pred").alias("lang_pred"), F.col("__l_score").alias("score"))

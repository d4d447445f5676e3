"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

A text is its words (A-Z lowered, split at ASCII white space) and one end. Word counts are
taken over all training documents and stay a distributed table. They give the base score, and,
through the tokenizer, how often each subword id occurs in the corpus: the HEAD most
frequent ids get a two-level softmax (CLASSES of MEMBERS), the others share one tail id
and are told apart by their corpus frequency, smoothed over the whole vocabulary. So the model is a proper
distribution over sequences of ids.

The model: embeddings, one layer of causal attention with a learned bias by distance, a
hidden layer on the current id and what attention brings, the two-level softmax. Training texts of any length are cut into
pieces of PIECE characters (words that a cut goes through are left out), dealt by hash. A first model is
trained on some FIRST of them on the driver, which also settle which ids share a class; where there are more, all pieces of the whole corpus go to as
many workers as are needed for PER_WORKER pieces each, which train on from that model, one pass in which every id is predicted once, and their
parameters are averaged. So everything is learned from, and no task or driver holds more than a bounded part of it. Scoring cuts a text's ids into windows of WINDOW that
overlap; each id is scored once, in the first window that holds it, with at least WINDOW - STRIDE
ids of context (or the whole text before it); windows of many texts are batched with one causal mask.

Words that make up at least 1/`heavy` of all tokens (at most `heavy` of them) are broadcast with their
counts; the rest, none of which can be hot, meet their counts in a join.

Edge cases: null text is empty and scores its end alone; rows without a doc_id are held out;
repeated rows count and are scored each; without any training text counts are zero and the
model is untrained, but scores stay finite; extra columns are ignored. The vocabulary file (VOCAB_PATH, a parameter) must be at the same
path on the driver and all executors.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, table

VOCAB_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_WORD = b"\n"  # white space never is a word
CLASSES, MEMBERS, DIM, ATTN, HIDDEN, WINDOW, STRIDE = 64, 32, 32, 16, 32, 24, 18
HEAD = CLASSES * MEMBERS
PIECE, FIRST, PER_WORKER = 2000, 4000, 3000
LOG10 = float(np.log(10))


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Encoder:
    """Subword ids of many words at once: each word is taken with a space before it, and an id whose
    bytes begin with a space begins a word."""

    def __init__(self, path: str):
        self.enc, self.n = encoding(path)
        self.begins = np.zeros(self.n, bool)
        for b in self.enc.token_byte_values():
            self.begins[self.enc.encode_single_token(b)] = b[:1] == b" "

    @staticmethod
    @lru_cache(1)
    def at(path: str) -> "Encoder":
        """One for all tasks of a Python worker."""
        return Encoder(path)

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each word's ids begin."""
        ids = np.array(self.enc.encode_ordinary("".join([" " + w.decode("utf-8", "replace") for w in words])), np.int64)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words) or (len(words) and first[0] != 0):  # odd white space: one by one
            parts = [self.enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            n = [len(x) for x in parts]
            return np.array([i for x in parts for i in x], np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        return ids, first


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, c) over all rows of docs(text), ends included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[bytes] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    c.update(text.lower().split())
                c[END_WORD] += 1
                if len(c) > flush:
                    yield pd.DataFrame({"word": list(c), "c": list(c.values())})
                    c.clear()
        if c:
            yield pd.DataFrame({"word": list(c), "c": list(c.values())})

    return docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str) -> tuple[np.ndarray, int]:
    """How often each id occurs in the corpus behind the word counts; the end is the last id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.at(path)
        total = np.zeros(enc.n + 1, np.int64)
        for pdf in batches:
            is_end = (pdf["word"] == END_WORD).to_numpy()
            total[enc.n] += pdf["c"][is_end].sum()
            words, c = pdf["word"][~is_end].tolist(), pdf["c"][~is_end].to_numpy()
            if words:
                ids, first = enc.many(words)
                np.add.at(total, ids, np.repeat(c, np.diff(np.append(first, len(ids)))))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    rows = counts.mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = encoding(path)[1]
    out = np.zeros(n + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out, n


class Vocabulary:
    """Ids by frequency: head ids 0..HEAD-2 and the tail id HEAD-1; each head id has a class and a place in it."""

    def __init__(self, freq: np.ndarray):
        order = np.lexsort((np.arange(len(freq)), -freq))
        end = len(freq) - 1
        head = [end, *[int(i) for i in order if i != end][: HEAD - 2]]
        self.of = np.full(len(freq), HEAD - 1, np.int64)
        self.of[head] = np.arange(len(head))
        tail = np.ones(len(freq), bool)
        tail[head] = False
        f = freq[tail] + 0.5
        self.tail = np.zeros(len(freq), np.float32)
        self.tail[tail] = np.log(f / f.sum())
        self.freq = np.ones(HEAD)
        self.freq[: len(head)] += freq[head]
        self.freq[HEAD - 1] += freq[tail].sum()
        self.end = 0
        self.cls = np.arange(HEAD) // MEMBERS
        self.mem = np.arange(HEAD) % MEMBERS

    def cluster(self, docs: list[np.ndarray], seed: int = 1) -> None:
        """Classes of ids that follow similar ids: halve along the main axis of their contexts."""
        rng = np.random.default_rng(seed)
        proj = rng.standard_normal((HEAD, 48)).astype(np.float32)
        ctx = np.zeros((HEAD, 96), np.float32)
        n = np.ones(HEAD)
        for d in docs:
            np.add.at(ctx[:, :48], d[1:], proj[d[:-1]])
            np.add.at(ctx[:, 48:], d[:-1], proj[d[1:]])
            np.add.at(n, d, 1)
        ctx /= np.maximum(np.linalg.norm(ctx, axis=1, keepdims=True), 1e-6)
        groups = [np.arange(HEAD)]
        while len(groups) < CLASSES:
            nxt = []
            for g in groups:
                x = ctx[g] - ctx[g].mean(0)
                v = rng.standard_normal(x.shape[1])
                for _ in range(12):
                    v = x.T @ (x @ v)
                    v /= np.linalg.norm(v) + 1e-12
                o = np.argsort(x @ v, kind="stable")
                nxt += [g[o[: len(g) // 2]], g[o[len(g) // 2:]]]
            groups = nxt
        for c, g in enumerate(groups):
            self.cls[g] = c
            self.mem[g] = np.arange(len(g))


def _init(vocab: Vocabulary, seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    g = lambda *s, k=1.0: (rng.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
    p = {"E": (rng.standard_normal((HEAD, DIM)) * 0.5).astype(np.float32), "Q": g(DIM, ATTN), "K": g(DIM, ATTN), "V": g(DIM, ATTN),
         "R": np.zeros(WINDOW, np.float32), "W": g(DIM + ATTN, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
         "C": g(HIDDEN, CLASSES, k=0.3), "c": np.zeros(CLASSES, np.float32), "M": g(CLASSES, HIDDEN, MEMBERS, k=0.3), "m": np.zeros((CLASSES, MEMBERS), np.float32)}
    p["c"] = np.log(np.bincount(vocab.cls, vocab.freq, CLASSES) / vocab.freq.sum()).astype(np.float32)
    for k in range(HEAD):
        p["m"][vocab.cls[k], vocab.mem[k]] = np.log(vocab.freq[k])
    p["m"] -= p["m"].max(1, keepdims=True)
    return p


_I = np.arange(WINDOW)
_ONES = np.ones(max(WINDOW, CLASSES, MEMBERS), np.float32)
_DIST = np.clip(_I[:, None] - _I[None, :], 0, None)
_MASK = np.where(_I[:, None] >= _I[None, :], 0.0, -1e9).astype(np.float32)


def _attend(p: dict, x: np.ndarray):
    """x: (B, WINDOW) ids -> queries, keys, values, attention weights and what they bring."""
    q, k, v = p["EQ"].take(x, 0), p["EK"].take(x, 0), p["EV"].take(x, 0)
    s = q @ k.transpose(0, 2, 1)
    s += p["bias"]
    np.exp(s, out=s)
    n = (s.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(len(x), WINDOW, 1)
    return q, k, v, s, n, (s @ v) / n


def _tables(p: dict) -> dict:
    """What does not depend on the text: one row per id."""
    return p | {"EQ": p["E"] @ p["Q"] * np.float32(ATTN ** -0.5), "EK": p["E"] @ p["K"], "EV": p["E"] @ p["V"],
                "EW": p["E"] @ p["W"][:DIM] + p["b"], "bias": (p["R"][_DIST] + _MASK).astype(np.float32)}


def _log_probs(p: dict, h: np.ndarray, y: np.ndarray, vocab_cls: np.ndarray, vocab_mem: np.ndarray) -> np.ndarray:
    """log P(y) for hidden states h, class by class."""
    c = vocab_cls[y].astype(np.int16)
    order = np.argsort(c, kind="stable")
    c, m = c[order], vocab_mem[y[order]]
    x = np.ones((len(y), h.shape[1] + 1), np.float32)  # the last one takes the biases along
    x[:, :-1] = h.take(order, 0)
    to_class, to_member = np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["M"], p["m"][:, None]], axis=1)
    edge = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    own, z = np.empty(len(y), np.float32), np.empty(len(y), np.float32)
    for a in range(0, len(y), 1024):  # small enough for a core's cache
        s = x[a: a + 1024] @ to_class
        own[a: a + 1024] = s.ravel()[np.arange(0, s.size, CLASSES) + c[a: a + 1024]]
        np.exp(s, out=s)
        z[a: a + 1024] = s @ _ONES[:CLASSES]  # sums by BLAS: a row is too short for numpy's own
    for k in range(CLASSES):
        a, b = edge[k], edge[k + 1]
        if a < b:
            s = x[a:b] @ to_member[k]
            own[a:b] += s.ravel()[np.arange(0, s.size, MEMBERS) + m[a:b]]
            np.exp(s, out=s)
            z[a:b] *= s @ _ONES[:MEMBERS]
    out = np.empty(len(y), np.float32)
    out[order] = own - np.log(z)
    return out


def window_starts(first: np.ndarray, lens: np.ndarray, shift: int = 0) -> np.ndarray:
    """Where windows begin that predict every id of the sequences but their first: once with shift 0."""
    per = -(-np.maximum(lens - 1 - shift, 0) // WINDOW)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    grid = np.repeat(first + shift, per) + k * WINDOW
    return np.concatenate([first, grid]) if shift else grid


def train(docs: list[np.ndarray], vocab: Vocabulary, steps: int | None = 1200, batch: int = 160, rate: float = 8e-3, seed: int = 4, start: dict | None = None) -> dict[str, np.ndarray]:
    """docs: id sequences; a text's first begins, its last ends with the end. Adam on all windows in turn, in random order, in as many
    passes as the steps allow; without steps, in one."""
    first_values = _init(vocab) if start is None else start
    keys = sorted(first_values)
    theta = np.concatenate([first_values[k].ravel() for k in keys]).astype(np.float32)
    p = _views(theta, first_values, keys)
    docs = [d for d in docs if len(d) > 1]
    if not docs:
        return p
    flat = np.concatenate([np.concatenate([d, np.full(WINDOW, -1)]) for d in docs])
    lens = np.array([len(d) for d in docs])
    first = np.cumsum(lens + WINDOW) - lens - WINDOW
    rng = np.random.default_rng(seed)
    todo = rng.permutation(window_starts(first, lens))
    steps = -(-len(todo) // batch) if steps is None else steps
    # parameters, gradients and moments are one vector each, p and g are their parts
    grad, m1, m2, tmp = (np.zeros_like(theta) for _ in range(4))
    g = _views(grad, p, keys)
    cls, scale = vocab.cls.astype(np.int16), np.float32(ATTN ** -0.5)
    parts = [slice(0, ATTN), slice(ATTN, 2 * ATTN), slice(2 * ATTN, 3 * ATTN), slice(3 * ATTN, 3 * ATTN + HIDDEN)]
    for t in range(1, steps + 1):
        if not len(todo):
            todo = rng.permutation(window_starts(first, lens, int(rng.integers(WINDOW))))
        at, todo = todo[:batch, None] + np.arange(WINDOW + 1), todo[batch:]
        z = flat[np.minimum(at, len(flat) - 1)]
        ok = np.minimum.accumulate(z >= 0, axis=1)
        z = np.where(ok, z, 0)
        x, y, ok = z[:, :-1].ravel(), z[:, 1:].ravel(), ok[:, 1:].ravel()
        n = len(y)
        # what depends on one id alone: its query, key, value and part of the hidden layer, side by side
        wall = np.concatenate([p["Q"] * scale, p["K"], p["V"], p["W"][:DIM]], axis=1)
        ids = p["E"] @ wall
        ids[:, parts[3]] += p["b"]
        of = ids.take(x, 0)
        q, k, v = (of[:, s].reshape(-1, WINDOW, ATTN) for s in parts[:3])
        a = q @ k.transpose(0, 2, 1)
        a += p["R"][_DIST] + _MASK
        np.exp(a, out=a)
        a /= (a.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(-1, WINDOW, 1)
        o = (a @ v).reshape(-1, ATTN)
        u = o @ p["W"][DIM:]
        u += of[:, parts[3]]
        # in the order of the classes, so that each class is one slice
        c = cls[y]
        order = np.argsort(c, kind="stable")
        c, mem = c[order], vocab.mem[y[order]]
        h = np.ones((n, HIDDEN + 1), np.float32)  # the last one takes the biases along
        np.maximum(u.take(order, 0), 0, out=h[:, :HIDDEN])
        to_class, to_member = np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["M"], p["m"][:, None]], axis=1)
        g_class, g_member = np.zeros_like(to_class), np.zeros_like(to_member)
        share = (ok[order] / ok.sum()).astype(np.float32)
        grad[:] = 0
        gh, r = np.empty((n, HIDDEN), np.float32), np.empty((n, MEMBERS), np.float32)
        for i in range(0, n, 1024):  # small enough for a core's cache
            hi, e = h[i: i + 1024], slice(i, i + 1024)
            s = _softmax_less_target(hi @ to_class, share[e], c[e])
            g_class += hi.T @ s
            np.matmul(s, p["C"].T, out=gh[e])
        edge = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        own = [(j, slice(edge[j], edge[j + 1])) for j in range(CLASSES) if edge[j] < edge[j + 1]]
        for j, e in own:
            np.matmul(h[e], to_member[j], out=r[e])
        r = _softmax_less_target(r, share, mem)
        for j, e in own:
            np.matmul(h[e].T, r[e], out=g_member[j])
            gh[e] += r[e] @ p["M"][j].T
        g["C"][:], g["c"][:], g["M"][:], g["m"][:] = g_class[:-1], g_class[-1], g_member[:, :-1], g_member[:, -1]
        gh *= h[:, :HIDDEN] > 0
        gof = np.empty_like(of)
        gu = np.empty_like(gh)
        gu[order] = gh
        gof[:, parts[3]] = gu
        g["W"][DIM:] = o.T @ gu
        go = (gu @ p["W"][DIM:].T).reshape(-1, WINDOW, ATTN)
        gof[:, parts[2]] = (a.transpose(0, 2, 1) @ go).reshape(-1, ATTN)
        gs = go @ v.transpose(0, 2, 1)
        gs -= ((gs * a).reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(-1, WINDOW, 1)
        gs *= a
        gof[:, parts[0]] = (gs @ k).reshape(-1, ATTN)
        gof[:, parts[1]] = (gs.transpose(0, 2, 1) @ q).reshape(-1, ATTN)
        g["R"][:] = np.bincount(_DIST.ravel(), (gs.sum(0) * (_MASK == 0)).ravel(), WINDOW)
        # an id's gradients are added up before they meet the weights
        by_id = np.argsort(x.astype(np.int16), kind="stable")
        xs = x[by_id]
        begin = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
        total, seen = _sums(gof.take(by_id, 0), begin), xs[begin]
        g["E"][seen] = total @ wall.T
        gwall = p["E"][seen].T @ total
        g["Q"][:], g["K"][:], g["V"][:], g["W"][:DIM] = gwall[:, parts[0]] * scale, gwall[:, parts[1]], gwall[:, parts[2]], gwall[:, parts[3]]
        g["b"][:] = total[:, parts[3]].sum(0)
        lr = rate * min(1.0, t / 20) * (0.05 + 0.95 * (1 - t / steps))
        np.subtract(grad, m1, out=tmp)
        tmp *= np.float32(0.1)
        m1 += tmp
        grad *= grad
        grad -= m2
        grad *= np.float32(0.01)
        m2 += grad
        np.multiply(m2, np.float32(1 / (1 - 0.99 ** t)), out=tmp)
        np.sqrt(tmp, out=tmp)
        tmp += np.float32(1e-8)
        np.divide(m1, tmp, out=tmp)
        tmp *= np.float32(lr / (1 - 0.9 ** t))
        theta -= tmp
    return p


def _views(flat: np.ndarray, like: dict, keys: list[str]) -> dict[str, np.ndarray]:
    """The parameters that lie one after another in `flat`."""
    ends = np.cumsum([like[k].size for k in keys])
    return {k: flat[e - like[k].size: e].reshape(like[k].shape) for k, e in zip(keys, ends)}


def _softmax_less_target(s: np.ndarray, share: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logits s become, in place, the loss's gradients by them: (softmax - 1 at the target) times the row's share."""
    if s.max() > 60:  # beyond what floats hold when it is summed up
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    z = s @ _ONES[: s.shape[1]]
    s *= (share / np.maximum(z, np.float32(1e-30)))[:, None]
    s.ravel()[np.arange(0, s.size, s.shape[1]) + target] -= share
    return s


def _sums(x: np.ndarray, begin: np.ndarray, long: int = 8) -> np.ndarray:
    """Sums of the runs of rows of x that begin at `begin`. numpy's own reduceat goes down every column of every run."""
    n = np.diff(np.append(begin, len(x)))
    order = np.argsort(-n, kind="stable")
    out = np.empty((len(begin), x.shape[1]), x.dtype)
    many = int(np.count_nonzero(n > long))
    for k in order[:many].tolist():
        out[k] = np.ones(n[k], x.dtype) @ x[begin[k]: begin[k] + n[k]]
    few = order[many:]
    total, at, size = x.take(begin[few], 0), begin[few], n[few]
    for i in range(1, min(long, int(size[0])) if len(few) else 0):
        m = int(np.count_nonzero(size > i))  # the longer ones stand first
        total[:m] += x.take(at[:m] + i, 0)
    out[few] = total
    return out


class Words:
    """Memo of words in a worker: their subword ids and log10 base probability (nan: look it up). It forgets
    everything at `bound` words."""

    def __init__(self, enc: Encoder, base: dict[bytes, float], bound: int = 300_000):
        self.enc, self.base, self.bound = enc, base, bound
        self.clear()

    @staticmethod
    @lru_cache(1)
    def of_pieces(path: str) -> "Words":
        """One for all models that a Python worker trains."""
        return Words(Encoder.at(path), {})

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.n, self.start, self.len, self.lp = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14)

    def add(self, words: list[bytes]) -> None:
        k, m = len(self.index), len(words)
        ids, first = self.enc.many(words)
        while k + m > len(self.start):
            self.start, self.len, self.lp = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.len, self.lp))
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n: self.n + len(ids)] = ids
        self.start[k: k + m], self.len[k: k + m] = self.n + first, np.diff(np.append(first, len(ids)))
        self.lp[k: k + m] = [self.base.get(w, np.nan) for w in words]
        self.n += len(ids)
        self.index.update(zip(words, range(k, k + m)))

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.bound:
            self.clear()
        found = list(map(self.index.get, words))
        if None in found:
            self.add(sorted({w for w, k in zip(words, found) if k is None}))
            found = list(map(self.index.__getitem__, words))
        return np.array(found, np.int64)

    def expand(self, k: np.ndarray) -> np.ndarray:
        n = self.len[k]
        at = np.repeat(self.start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.ids[at]


def score_batch(f: dict, v: Vocabulary, seqs: list[np.ndarray], chunk: int = 256, block: int = 16_384) -> np.ndarray:
    """log10 probability of each id sequence (full ids, the end not included)."""
    lens = np.array([len(s) + 1 for s in seqs])
    end = len(v.of) - 1
    full = np.concatenate([x for s in seqs for x in (s, [end])]).astype(np.int64)
    y = v.of[full]
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[first] = v.end
    per = 1 + np.maximum(0, -(-(lens - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(seqs)), per)
    j = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    begin = first[owner] + j * STRIDE
    stop = first[owner] + lens[owner]
    out, hidden, places, held = np.empty(len(y), np.float32), [], [], 0

    def give() -> None:
        at = np.concatenate(places)
        out[at] = _log_probs(f, np.concatenate(hidden), y[at], v.cls, v.mem)
        hidden.clear()
        places.clear()

    # windows by small chunks, which a core's cache holds; the softmax takes more at once, as it goes class by class
    for a in range(0, len(begin), chunk):
        at = begin[a: a + chunk, None] + _I
        new = (at < stop[a: a + chunk, None]) & ((j[a: a + chunk, None] == 0) | (_I >= WINDOW - STRIDE))
        o = _attend(f, x[np.minimum(at, len(x) - 1)])[5]
        pos = at[new]
        h = f["EW"].take(x[pos], 0)
        h += o[new] @ f["W"][DIM:]
        hidden.append(np.maximum(h, 0, out=h))
        places.append(pos)
        held += len(pos)
        if held >= block:
            give()
            held = 0
    if places:
        give()
    out += v.tail[full]
    return np.add.reduceat(out.astype(np.float64), first) / LOG10


def pieces(docs: DataFrame, low: float, high: float) -> DataFrame:
    """(o, piece, first, last): the pieces of docs(doc_id, text) whose hash, a number from 0 to 1, is in [low, high)."""
    span = float(1 << 40)
    o = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), k, F.lit("lm")), F.lit(1 << 40)) / span
    d = docs.where(F.length("text") > 0).withColumn("n", F.ceil(F.length("text") / PIECE).cast("int"))
    d = d.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (o(k) >= low) & (o(k) < high))))
    return d.select(o(F.col("k")).alias("o"), F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"), (F.col("k") == 0).alias("first"), (F.col("k") == F.col("n") - 1).alias("last"))


def piece_words(piece: str, first: bool, last: bool) -> list[bytes]:
    """The whole words of a piece; one without white space is a word."""
    words = words_of(piece)
    if not first and len(words) > 1 and not piece[:1].isspace():
        words = words[1:]
    if not last and len(words) > 1 and not piece[-1:].isspace():
        words = words[:-1]
    return words


def _sequences(rows, vocab: Vocabulary, path: str) -> list[np.ndarray]:
    """rows of pieces, in the order of their hashes, as head ids."""
    words, out, end = Words.of_pieces(path), [], [vocab.end]
    for _, piece, first, last in sorted(map(tuple, rows)):
        ids = vocab.of[words.expand(words.look(piece_words(piece, first, last)))]
        out.append(np.concatenate([end if first else [], ids, end if last else []]).astype(np.int64))
    return out


def fit(counts: DataFrame, docs: DataFrame, path: str = VOCAB_PATH, steps: int = 1200) -> tuple[dict, Vocabulary]:
    """The model, learned from the word counts and docs(doc_id, text)."""
    freq, _ = subword_counts(counts, path)
    vocab = Vocabulary(freq)
    total = docs.agg(F.coalesce(F.sum(F.ceil(F.length("text") / PIECE)), F.lit(0)).cast("long").alias("n")).first()["n"]
    begin = min(1.0, FIRST / max(1, total))
    # pieces of the smallest hashes: FIRST of them expected, and so many that twice as many never come
    sequences = _sequences(pieces(docs, 0.0, begin).limit(2 * FIRST).collect(), vocab, path)
    vocab.cluster(sequences)
    model = train(sequences, vocab, steps)
    if total <= FIRST:  # the first model has seen everything
        return model, vocab
    return _averaged(docs, model, vocab, path, -(-total // PER_WORKER)), vocab


def _averaged(docs: DataFrame, model: dict, vocab: Vocabulary, path: str, workers: int, steps: int | None = None, begin: float = 0.0) -> dict:
    """The mean of the models that the workers make of `model`, each with its share of the pieces from the hash `begin` on."""
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        start, v = shared.value
        rows = list(pdf[["o", "piece", "first", "last"]].itertuples(index=False))
        p = train(_sequences(rows, v, path), v, steps, batch=320, rate=2e-3, seed=5 + int(key[0]), start=start)
        return pd.DataFrame({"worker": [int(key[0])], "n": [1], "p": [np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "p": [np.sum([np.frombuffer(x, np.float64) for x in pdf["p"]], axis=0).tobytes()]})

    drawn = pieces(docs, begin, 1.0).withColumn("worker", F.floor((F.col("o") - begin) / (1 - begin) * workers).cast("int"))
    each = cut(drawn.groupBy("worker").applyInPandas(learn, "worker int, n long, p binary"), "models")
    # sums of about as many models as there are sums reach the driver
    some = each.groupBy(F.pmod("worker", F.lit(max(1, int(workers ** 0.5)))).alias("g")).applyInPandas(add, "n long, p binary").collect()
    if not some:
        return model
    flat = np.sum([np.frombuffer(r["p"], np.float64) for r in some], axis=0) / sum(r["n"] for r in some)
    out, at = {}, 0
    for k in sorted(model):
        out[k] = flat[at: at + model[k].size].reshape(model[k].shape).astype(np.float32)
        at += model[k].size
    return out


def score(docs: DataFrame, counts: DataFrame, model: tuple[dict, Vocabulary], heavy: int = 1_000_000, path: str = VOCAB_PATH) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, denom = total["n"], total["n"] + 0.1 * (total["v"] + 1)
    hot = F.col("c") * heavy >= n
    often = {bytes(r["word"]): float(np.log10((r["c"] + 0.1) / denom)) for r in counts.where(hot).collect()}
    f, vocab = _tables(model[0]), model[1]
    shared = spark.sparkContext.broadcast((often, f, vocab))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, f, vocab = shared.value
        Words.of_pieces.cache_clear()  # its room is needed
        table_ = Words(Encoder.at(path), often)
        end_lp = often.get(END_WORD, np.nan)

        def flush(rows: list, seqs: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "known", "base", "rare"])
            out["score"] = score_batch(f, vocab, seqs)
            return out

        for pdf in batches:
            rows, seqs, size = [], [], 0
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                words = text.lower().split() if text else []
                k = table_.look(words)
                lp = table_.lp[k]
                at = np.flatnonzero(np.isnan(lp))
                rare = [words[a] for a in at]
                known, base = len(words) - len(at), float(np.nansum(lp))
                if np.isnan(end_lp):
                    rare.append(END_WORD)
                else:
                    known, base = known + 1, base + end_lp
                seqs.append(table_.expand(k))
                rows.append((i, len(words) + 1, known, base, rare))
                size += len(seqs[-1])
                if size > 100_000:
                    yield flush(rows, seqs)
                    rows, seqs, size = [], [], 0
            if rows:
                yield flush(rows, seqs)

    # ids pass the worker as text: beside a null, pandas would hold them as doubles
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    d = d.mapInPandas(run, "doc_id string, n_tokens long, known long, base double, rare array<binary>, score double")
    # one row per rare word; the first one carries the document's own values
    d = d.withColumn("row", F.monotonically_increasing_id())
    d = d.select("row", F.struct("doc_id", "n_tokens", "known", "base", "score").alias("doc"), F.posexplode_outer("rare"))
    none = F.concat(F.lit(b"\x00"), F.col("row").cast("string").cast("binary"))  # no word begins so: no shared null key
    d = d.select("row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("doc")).alias("doc"), F.col("col").isNotNull().alias("some"), F.coalesce("col", none).alias("word"))
    d = d.join(counts.where(~hot), "word", "left")
    c = F.coalesce("c", F.lit(0))
    g = d.groupBy("row").agg(F.max("doc").alias("doc"), F.sum((F.col("some") & (c > 0)).cast("long")).alias("known"),
                             F.sum(F.when(F.col("some"), F.log10((c + 0.1) / F.lit(denom))).otherwise(F.lit(0.0))).alias("base"))
    return g.select(F.col("doc.doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "doc.n_tokens", (F.col("doc.known") + F.col("known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("doc.base") + F.col("base")).alias("base_score"), F.col("doc.score").alias("score"))


def op2_lm_score(spark, sf_dir: str, steps: int = 1200) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(~held_out(F.col("doc_id"), 10))
    counts = cut(word_counts(learn), "counts")
    out = score(docs, counts, fit(counts, learn, steps=steps))
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""PII: information-theoretic sanitisation.

Base entities come from four patterns (email, ip, card, phone); failing matches are dropped
without a retry. The corpus then says which other terms reveal an entity: over all
documents it counts in two ways where each term (a run of letters, lower case) stands: among all
words and those within `reach` terms of an entity of each kind, and among all texts and those that
hold an entity of each kind anywhere. A term t discloses kind c when, by either count,

    PMI(c; t) = log2( p(c, t) / (p(c) p(t)) )  >=  alpha * IC(c),   IC(c) = -log2 p(c)

that is, when seeing t gives at least the share alpha of the information that c itself
holds, and when t was seen with c at least `support` times, whatever the corpus size; a kind that is
everywhere (IC 0) is disclosed by nothing. The list stays a table and is counted: up to
MAX_BROADCAST terms are broadcast; a longer list is joined to the terms that the texts hold.

Disclosing terms become spans of kind `term` wherever they stand, also in texts without an entity,
unless they overlap an entity; sanitise() replaces entities by their kind and, by default, terms by
the generalisation `[term]` (or removes them).

Spans are kind:start:end in code points, end exclusive. Edge cases: null text is empty; a
text without entities and disclosing terms stays unchanged; repeated rows give repeated rows and
count again in the statistics; an empty table has no terms; extra columns are carried by sanitise().
Long texts are scanned in time linear in their length: emails are looked for around each
'@' only, and digits' patterns start at a run's first digit only.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits can only fail as the run's first digit did, or lie in a match
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        m = HOST.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0") or "0") < 4 and int(q) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = m.group()
        if len(d) >= 13:
            d = d.replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= x <= "9" for x in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def words_of(text: str) -> list[str]:
    return TERM.findall(text.lower()) if text.isascii() else [w.lower() for w in TERM.findall(text)]


def outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms that overlap no span, by start."""
    inside: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if inside and a <= inside[-1][1]:
            inside[-1][1] = max(b, inside[-1][1])
        else:
            inside.append([a, b])
    out, k = [], 0
    for m in TERM.finditer(text):
        x, y = m.span()
        while k < len(inside) and inside[k][1] <= x:
            k += 1
        if k == len(inside) or inside[k][0] >= y:
            out.append((m.group().lower(), x, y))
    return out


def near_words(terms: list[tuple[str, int, int]], spans: list[tuple[str, int, int]], reach: int) -> dict[str, list[str]]:
    """By kind: those of the terms outside the spans that are within `reach` terms of a span of that kind, each place once."""
    starts = [a for _, a, _ in terms]
    places: dict[str, set[int]] = {}
    for kind, a, b in spans:
        places.setdefault(kind, set()).update(range(max(0, bisect_left(starts, a) - reach), min(len(terms), bisect_left(starts, b) + reach)))
    return {kind: [terms[k][0] for k in at] for kind, at in places.items()}


FLUSH = 100_000  # distinct terms that a task holds before it hands its sums on


def term_counts(docs: DataFrame, reach: int) -> DataFrame:
    """(term, n, n_<kind> near entities, d texts, d_<kind> texts with entities), summed over all rows
    of docs; the term '' stands in every text that is not empty."""
    names = ["n", *[f"n_{k}" for k in KINDS], "d", *[f"d_{k}" for k in KINDS]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter[str]] = {c: Counter() for c in names}

        def flush() -> pd.DataFrame:
            terms = list(sums["d"].keys() | sums["n"].keys())
            out = pd.DataFrame({"term": terms} | {c: [sums[c][t] for t in terms] for c in names})
            for c in sums.values():
                c.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                if not text:
                    continue
                words = words_of(text)
                sums["n"].update(words)
                if spans := base_spans(text):
                    terms = outside(text, spans)
                    held = {t for t, _, _ in terms} | {""}
                    for kind, found in near_words(terms, spans, reach).items():
                        sums[f"n_{kind}"].update(found)
                        sums[f"d_{kind}"].update(held)
                else:
                    held = {*words, ""}
                sums["d"].update(held)
                if len(sums["n"]) > FLUSH:
                    yield flush()
        if sums["d"]:
            yield flush()

    schema = "term string, " + ", ".join(f"{c} long" for c in names)
    sums = docs.select("text").mapInPandas(count, schema)
    return sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def disclosing(docs: DataFrame, reach: int = 3, alpha: float = 0.5, support: int = 20) -> DataFrame:
    """(kind, term): the terms that disclose a kind."""
    counts = term_counts(docs, reach)
    sums = [F.sum(c).alias(c) for c in counts.columns[1:]]
    often = F.expr(" or ".join(f"{x}_{k} >= {support}" for x in "nd" for k in KINDS))
    seen = cut(counts.groupBy(often.alias("often"), F.when(often | (F.col("term") == ""), F.col("term")).alias("term")).agg(*sums), "terms")
    words, texts = seen.agg(*sums).first(), seen.where("term = ''").first()
    kinds = []
    for k in KINDS:
        for x, total in (("n", words), ("d", texts)):
            if total and (c := total[f"{x}_{k}"] or 0) and c < total[x]:
                ic = -math.log2(c / total[x])
                pmi = F.log2(F.col(f"{x}_{k}")) - F.log2(F.col(x)) + F.lit(ic)
                kinds.append(F.when((F.col(f"{x}_{k}") >= support) & (pmi >= alpha * ic), F.lit(k)))
    found = F.array_distinct(F.array_compact(F.array(*kinds))) if kinds else F.array().cast("array<string>")
    return cut(seen.where("often and term <> ''").select(F.explode(found).alias("kind"), "term"), "disclosing")


def _by_kind(rows) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {k: set() for k in KINDS}
    for kind, term in rows:
        out[kind].add(term)
    return out


def disclosing_terms(docs: DataFrame, reach: int = 3, alpha: float = 0.5, support: int = 20) -> dict[str, set[str]]:
    """By kind, the terms that disclose it, all of them brought to the driver."""
    return _by_kind(disclosing(docs, reach, alpha, support).collect())


MAX_BROADCAST = 200_000  # terms; some 20 MB in a Python worker


def _held_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(__p_key, __p_terms): for each text that holds some of the terms, those it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols, rows = ["__p_key", "term"], []
        for pdf in batches:
            for key, text in zip(pdf["__p_key"], pdf["text"]):
                rows += [(key, t) for t in set(words_of(text))]
                if len(rows) > FLUSH:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
        yield pd.DataFrame(rows, columns=cols)

    held = docs.where("text is not null").select(F.unhex(F.md5("text")).alias("__p_key"), "text").mapInPandas(run, "__p_key binary, term string")
    return held.join(terms.select("term").distinct(), "term").groupBy("__p_key").agg(F.collect_set("term").alias("__p_terms"))


def with_terms(docs: DataFrame, terms: DataFrame | dict[str, set[str]], max_broadcast: int = MAX_BROADCAST):
    """docs with __p_terms, and a function that gives a row's terms from that column: the terms of
    the row's own text if the list is long, else null, which stands for the whole list."""
    none = F.lit(None).cast("array<string>")
    if isinstance(terms, DataFrame):
        if terms.count() > max_broadcast:
            held = cut(_held_terms(docs, terms), "held")
            docs = docs.withColumn("__p_key", F.unhex(F.md5("text"))).join(held, "__p_key", "left").drop("__p_key")
            return docs, lambda own: set() if own is None else set(own)
        terms = _by_kind(terms.collect())
    shared = docs.sparkSession.sparkContext.broadcast(set().union(*terms.values()))
    return docs.withColumn("__p_terms", none), lambda own: shared.value


def all_spans(text: str, terms: set[str]) -> tuple[list, list]:
    """Base spans, and terms' spans that overlap none of them, by start."""
    base = base_spans(text)
    if not terms or terms.isdisjoint(words_of(text)):
        return base, []
    return base, [("term", a, b) for t, a, b in outside(text, base) if t in terms]


def sanitise(docs: DataFrame, terms: DataFrame | dict[str, set[str]] | None = None, reach: int = 3, remove_terms: bool = False,
             max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with its own columns; entities in `text` are replaced by [KIND], disclosing terms
    by [term] or by nothing. n_chars, if there, follows the text."""
    known, terms_of = with_terms(docs, disclosing(docs, reach) if terms is None else terms, max_broadcast)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, held: pd.Series) -> pd.Series:
        def one(text, own):
            if not text:
                return text
            base, extra = all_spans(text, terms_of(own))
            if not base and not extra:
                return text
            out, last, spans = [], 0, sorted([(a, -b, k) for k, a, b in base] + [(a, -b, k) for k, a, b in extra])
            for a, b, k in spans:
                b = -b
                if b <= last:
                    continue
                out += [text[last:max(a, last)], "" if k == "term" and remove_terms else "[term]" if k == "term" else f"[{k.upper()}]"]
                last = b
            return "".join([*out, text[last:]])

        return pd.Series([one(t, own) for t, own in zip(texts, held)], dtype=object)

    out = known.withColumn("text", clean("text", "__p_terms")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    reach = 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known, terms_of = with_terms(docs, disclosing(docs, reach))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, own in zip(pdf["text"], pdf["__p_terms"]):
                base, extra = all_spans(text or "", terms_of(own))
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + extra)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    # ids pass the worker as text: beside a null, pandas would hold them as doubles
    known = known.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = known.mapInPandas(scan, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))

"""Benchmark decontamination (native).

A broadcast set of normalised benchmark windows is probed at every word of every text;
survivors are verified word for word, then spans or whole documents can be removed.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is
`window` consecutive words of an item; an item of fewer words (but not none) is one window.

The probe is a byte table of hashed windows (one slot per hash): first of word pairs, so
that most positions cost one pair hash, then of whole windows. It only ever lets too much
through; the join on the window's text decides. The windows of the benchmark are counted first. A table of at most `max_table` bytes
(64 MB, for 8 million windows) goes to the tasks as a literal of the plan; more windows take more passes over the documents, each with the
table of its share of them. The windows' texts are broadcast while there are at most `max_broadcast` (200,000, some 20 MB); beyond that the
survivors of the probe, not all document windows, meet them by shuffle.

Edge cases: null text has no words and no hits; null item text has none; a null item_id
still marks words as hit but is not listed; repeated rows give repeated rows; with an
empty benchmark nothing is hit. Extra columns are carried by `decontaminate` and ignored
by `contamination`; internal names begin with `__d_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(win, len, first, items): each distinct window once."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.withColumn("i", F.explode(F.expr("sequence(1, size(w) - len + 1)")))
    s = F.slice("w", F.col("i"), F.col("len"))
    w = w.select("item", "len", F.array_join(s, " ").alias("win"), F.xxhash64(s).alias("h"),
                 F.when(F.col("len") > 1, F.xxhash64(F.expr("w[i-1]"), F.expr("w[i]"))).alias("pair"))
    return w.groupBy("win").agg(F.first("len").alias("len"), F.first("h").alias("h"),
                                F.first("pair").alias("pair"), F.collect_set("item").alias("items"))


def _slots(values: DataFrame, n: int, max_table: int) -> bytes:
    """A table with a 1 in the slot of each hash of values(h): 8 to 16 slots a hash while that is at most max_table bytes."""
    bits = min(max(12, (8 * n).bit_length()), max_table.bit_length() - 1)
    slots = values.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("s")).distinct()
    out = bytearray(1 << bits)
    # a task's share at a time reaches the driver
    for r in slots.groupBy(F.pmod("s", F.lit(max(1, n // 10_000))).alias("k")).agg(F.collect_list("s").alias("s")).toLocalIterator():
        for v in r["s"]:
            out[v] = 1
    return bytes(out)


def _in(slots: bytes, h: Column) -> Column:
    """Whether the hash's slot is taken."""
    at = h.bitwiseAND(F.lit(len(slots) - 1)).cast("int") + 1
    return F.substring(F.lit(slots), at, F.lit(1)) == F.lit(b"\x01")


def _candidates(wins: DataFrame, sizes: dict[int, int], max_table: int) -> Column:
    """Array of (i, len): positions of the word array `w` whose window may be one of wins."""
    parts = []
    for n, count in sorted(sizes.items()):
        own = wins.where(F.col("len") == n)
        whole = _slots(own.select("h"), count, max_table)
        pairs = _slots(own.select(F.col("pair").alias("h")), count, max_table) if n > 1 else b""
        parts.append(_places(n, whole, pairs))
    if not parts:
        return F.array().cast("array<struct<i:int,len:int>>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _places(n: int, whole: bytes, pairs: bytes) -> Column:
    """Structs (i, n) of the places i where n words begin that may be a window."""
    def test(i: Column) -> Column:
        t = _in(whole, F.xxhash64(F.slice("w", i, n)))
        return t if n < 2 else _in(pairs, F.xxhash64(F.get("w", i - 1), F.get("w", i))) & t

    at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, test), lambda i: F.struct(i.alias("i"), F.lit(n).alias("len")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_broadcast: int = 200_000, max_table: int = 1 << 26) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, items (sorted), spans (word
    ranges [start, end) that are hit, merged), contaminated."""
    wins = cut(benchmark_windows(benchmark, window), "windows")
    sizes = dict(wins.groupBy("len").count().collect())  # at most `window` rows
    total = sum(sizes.values())
    small = total <= max_broadcast
    d = docs.select("doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    passes, found = max(1, -(-8 * total // max_table)), None
    for k in range(passes):
        own = wins.where(F.pmod("h", F.lit(passes)) == k) if passes > 1 else wins
        size = dict(own.groupBy("len").count().collect()) if passes > 1 else sizes
        e = d.withColumn("c", _candidates(own, size, max_table)).select("doc_id", "text_key", F.size("w").alias("n_words"), F.posexplode_outer(
            F.transform("c", lambda c: F.struct(c["i"].alias("i"), c["len"].alias("len"), F.array_join(F.slice("w", c["i"], c["len"]), " ").alias("win")))))
        e = e.select("doc_id", "text_key", "n_words",
                     # each row of docs counts once, in the first pass
                     F.when((F.coalesce(F.col("pos"), F.lit(0)) == 0) & F.lit(k == 0), 1).otherwise(0).alias("row"),
                     F.col("col.i").alias("i"), F.col("col.len").alias("len"),
                     # rows without a candidate must not share one null key
                     F.coalesce("col.win", F.concat(F.lit("\x00"), F.col("text_key").cast("string"))).alias("win"))
        found = e if found is None else found.union(e)
    d = found
    right = wins.select("win", "items", F.lit(True).alias("hit"))
    d = d.join(F.broadcast(right) if small else right, "win", "left")
    # text_key is part of the group, so equal ids of different texts stay apart; `row` counts repeats
    g = d.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum("row").alias("n_rows"),
        F.collect_set(F.when(F.col("hit"), F.struct(F.col("i").alias("s"), (F.col("i") + F.col("len")).alias("e")))).alias("hits"),
        F.collect_set(F.when(F.col("hit"), F.col("items"))).alias("items"))
    merged = F.aggregate(
        F.array_sort("hits"), F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))))
    g = g.select("doc_id", "text_key", "n_words", "n_rows", merged.alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    g = g.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["e"] - x["s"]))
    return g.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        "items", "spans", (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = 10,
                  max_broadcast: int = 200_000, max_table: int = 1 << 26) -> DataFrame:
    """docs with its own columns. action 'documents' drops hit rows; 'spans' cuts the hit
    words out of the text (the remaining text keeps its own characters)."""
    if action not in ("documents", "spans"):
        raise ValueError("action must be 'documents' or 'spans'")
    found = contamination(docs, benchmark, window, max_broadcast, max_table).where("contaminated").select(
        F.col("doc_id").alias("__d_id"), F.col("text_key").alias("__d_key"), F.col("spans").alias("__d_spans")
    ).dropDuplicates(["__d_id", "__d_key"])
    # the hit documents go to the texts while their counted number is small, else both are shuffled
    found = cut(found, "hit")
    found = F.broadcast(found) if found.count() <= max_broadcast else found
    on = F.col("doc_id").eqNullSafe(F.col("__d_id")) & (F.xxhash64("text") == F.col("__d_key"))
    if action == "documents":
        return docs.join(found, on, "left_anti")
    names = docs.columns
    out = docs.join(found, on, "left")
    # tokens alternate word, separator, ...; a separator of spaces keeps texts readable
    pieces = F.expr(r"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")
    # the words before a piece: pieces alternate, so their number follows from the place
    out = out.withColumn("__d_p", F.when(F.col("__d_spans").isNotNull(), pieces))
    out = out.withColumn("__d_lead", F.when(F.expr(r"__d_p[0] rlike '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]'"), 1).otherwise(0))
    keep = F.expr("""array_join(filter(__d_p, (p, k) -> not exists(__d_spans,
        s -> s.s <= cast(floor((k - __d_lead) / 2) as int) + 1 and cast(floor((k - __d_lead) / 2) as int) + 1 < s.e)), '')""")
    out = out.withColumn("text", F.when(F.col("__d_spans").isNotNull(), keep).otherwise(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    r = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with dw as (select doc_id, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bwin as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0)),
lens as (select distinct n from bwin),
dwin as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hit as (select r, i, dwin.n as n, item from dwin join bwin using (win)),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
its as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (r) left join its using (r)
"""

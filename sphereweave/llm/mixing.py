"""Mixing sources to target weights (native).

A tree domain > language > source gets a token budget at its root. Every level shares a
node's budget among its children by weight; a child that holds too few tokens gets all it
has, and its shortage goes to its siblings, by weight again, before any of it reaches the
siblings of an ancestor: a node's budget never exceeds what its leaves hold, so only what
the whole subtree lacks is passed upwards. The level that each parent settles at is found in
closed form (children sorted by capacity per weight, running sums), so there is no loop.

A leaf then takes a token prefix of its seeded epochs: epoch e orders the leaf's rows by
md5(seed:e:doc_id:md5(text)); whole epochs come first, then rows of the next one until the first row
that would pass the budget. The texts are read once, for a light table of ids, token counts and hashes in which rows that
are equal in every column are one with a count. A leaf's rows are never brought together: they are summed by
`BUCKETS` ranges of the md5, the ranges' running sum says which are in, which are out
and which one holds the boundary, and only light rows of that one are ordered. The md5 is
uniform, so a hot source, or a hot id with different texts, is spread over all ranges, and a hot row is one light row.

Tokens are runs of characters other than space and \\x09-\\x0D.

Edge cases: null text has no tokens and is selected with the rows around it; null lang or
source is the leaf '(none)'; a leaf without a stated weight has weight 1; a leaf whose budget is 0 (it has
weight 0 or no tokens, or the budget is too small) gives no rows, not even empty ones; repeated rows are separate rows; an
empty table gives no rows; extra columns are carried by `mix`, internal names begin with `__m_`.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 4096  # three hexadecimal digits
LEVELS = ("domain", "language", "source")


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+"), ""))


def default_domain(source: Column) -> Column:
    """The production mapping: sources whose number is even are 'web', the others 'books'."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(n == "", F.lit("other")).when(F.pmod(F.substring(n, -1, 1).cast("int"), F.lit(2)) == 0, F.lit("web")).otherwise(F.lit("books"))


#: Production weights of domains and languages (integers; others, and all sources, weigh 1).
WEIGHTS = {"domain": {"web": 3, "books": 2, "other": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 2}, "source": {}}


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for k, v in (weights.get(level) or {}).items():
        if int(v) != v or v < 0:
            raise ValueError("weights are non-negative integers")
        out = F.when(F.col(level) == k, F.lit(int(v))).otherwise(out)
    return out.cast("decimal(10,0)")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes has name, cap, w and the parent's budget; adds `alloc` (whole tokens)."""
    ratio = (F.col("cap").cast("double") / F.col("w").cast("double"))
    live = F.col("w") > 0
    order = Window.partitionBy(*parent).orderBy(F.when(live, ratio).asc_nulls_last(), F.col(name))
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    d = nodes.withColumn("cap_before", F.coalesce(F.sum(F.when(live, F.col("cap"))).over(upto), F.lit(0)).cast("decimal(28,0)"))
    d = d.withColumn("w_from", F.sum("w").over(after).cast("decimal(18,0)"))
    d = d.withColumn("left", (F.greatest(F.col("budget") - F.col("cap_before"), F.lit(0))).cast("decimal(19,0)"))
    # saturated: its share of what is left at its turn covers all it holds
    d = d.withColumn("full", live & (F.col("cap") * F.col("w_from") <= F.col("left") * F.col("w")))
    whole = Window.partitionBy(*parent)
    d = d.withColumn("rest", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).cast("decimal(19,0)"))
    d = d.withColumn("open_w", F.when(live & ~F.col("full"), F.col("w")).otherwise(F.lit(0)))
    d = d.withColumn("w_open", F.sum("open_w").over(whole).cast("decimal(18,0)"))
    run = Window.partitionBy(*parent).orderBy(name)
    d = d.withColumn("w_run", F.sum("open_w").over(run.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,0)"))
    cum = lambda w: F.floor(F.col("rest") * w / F.when(F.col("w_open") > 0, F.col("w_open")))
    part = cum(F.col("w_run")) - cum(F.col("w_run") - F.col("open_w"))
    alloc = F.when(F.col("full"), F.col("cap")).when(F.col("open_w") > 0, F.least(F.col("cap"), part)).otherwise(F.lit(0))
    return d.withColumn("alloc", alloc.cast("long")).drop("cap_before", "w_from", "left", "full", "rest", "open_w", "w_open", "w_run", "budget")


def budgets(sizes: DataFrame, weights: Mapping, share: float | None, budget: int | None, epochs: int) -> DataFrame:
    """sizes(domain, language, source, tokens) -> the same with cap and alloc, one row a leaf."""
    leaf = sizes.withColumn("cap", (F.col("tokens") * epochs).cast("long"))
    total = leaf.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    root = (F.lit(int(budget)) if budget is not None else F.floor(F.col("t").cast("decimal(20,0)") * F.lit(Decimal(repr(float(share)))).cast("decimal(18,15)"))).cast("long")
    b = total.select(root.alias("budget"), F.lit(1).alias("k"))
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = leaf.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap"))
        nodes = nodes.withColumn("w", _weight(LEVELS[depth - 1], weights))
        parent = keys[:-1] or ["k"]
        nodes = (nodes.withColumn("k", F.lit(1)) if depth == 1 else nodes).join(b, parent)
        nodes = _share(nodes, parent, keys[-1]).drop("k")
        b = nodes.select(*keys, F.col("alloc").alias("budget"))
    return leaf.join(b.withColumnRenamed("budget", "alloc"), list(LEVELS))


KEY = ("__m_domain", "__m_lang", "__m_source")


def _hashable(docs: DataFrame) -> list[Column]:
    """All columns, maps (which Spark doesn't hash) as their JSON."""
    return [F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields]


def _keyed(docs: DataFrame, domain: Column | None) -> DataFrame:
    """docs with its leaf, and a hash of the whole row."""
    return docs.withColumns({
        "__m_domain": F.coalesce(default_domain(F.col("source")) if domain is None else domain, F.lit("(none)")),
        "__m_lang": F.coalesce(F.col("lang"), F.lit("(none)")), "__m_source": F.coalesce(F.col("source"), F.lit("(none)")),
        "__m_x": F.xxhash64(*_hashable(docs))})


def _place(epoch: Column, seed: int) -> Column:
    """Where a row with doc_id and __m_text stands in an epoch: a hexadecimal md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__m_text").cast("binary"))


def _at(epoch: Column | None = None, place: Column | None = None) -> Column:
    """The range that a row stands in."""
    return F.struct((F.col("__m_epoch") if epoch is None else epoch).alias("e"), (F.col("__m_b") if place is None else F.substring(place, 1, 3)).alias("b"))


def _text_columns() -> list[Column]:
    return [n_tokens(F.col("text")).alias("__m_tokens"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__m_text")]


def _bounds(docs: DataFrame, weights: Mapping, share: float | None, budget: int | None, epochs: int, seed: int, domain: Column | None) -> tuple[DataFrame, DataFrame]:
    """One light row per epoch and distinct row of docs, and, one row a leaf that has a budget, the range that would pass it first."""
    key = list(KEY)
    d = _keyed(docs, domain).select(*key, "doc_id", "lang", "source", "__m_x", *_text_columns())
    # the hash of the row stands first: a hot source meets partial sums, and no key of the exchange is hot
    light = cut(d.groupBy("__m_x", *key, "doc_id", "lang", "source", "__m_tokens", "__m_text").agg(F.count("*").alias("__m_n")), "light")
    e = light.withColumn("__m_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("__m_h", _place(F.col("__m_epoch"), seed)).withColumn("__m_b", F.substring("__m_h", 1, 3))
    parts = cut(e.groupBy(*key, "__m_epoch", "__m_b").agg(F.sum(F.col("__m_tokens") * F.col("__m_n")).alias("__m_t")), "ranges")
    sizes = parts.where("__m_epoch = 0").groupBy(*key).agg(F.sum("__m_t").alias("tokens")).toDF(*LEVELS, "tokens")
    leaf = budgets(sizes, weights, share, budget, epochs).where("alloc > 0").select(*[F.col(a).alias(b) for a, b in zip(LEVELS, key)], F.col("alloc").alias("__m_alloc"))
    # at most epochs * BUCKETS sums a leaf; the first range that would pass the budget is the boundary
    run = Window.partitionBy(*key).orderBy("__m_epoch", "__m_b").rowsBetween(Window.unboundedPreceding, 0)
    at = _at()
    over, spare = F.col("__m_run") > F.col("__m_alloc"), F.col("__m_alloc") - F.col("__m_run") + F.col("__m_t")
    bound = (parts.withColumn("__m_run", F.sum("__m_t").over(run)).join(leaf, key).groupBy(*key)
             .agg(F.min(F.when(over, F.struct(at.alias("at"), spare.alias("room")))).alias("__m_end")))
    # as a written table its size is known, and Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold
    return e, cut(bound, "bounds")


def _border(e: DataFrame) -> DataFrame:
    """Of the light rows e, joined with the bounds, those of a leaf's boundary range that are in."""
    key, at = list(KEY), _at()
    edge = Window.partitionBy(*key, "__m_epoch", "__m_b").orderBy("__m_h", "doc_id", "__m_tokens", "lang", "source", "__m_x").rowsBetween(Window.unboundedPreceding, -1)
    border = e.where(at == F.col("__m_end.at")).withColumn("__m_left", F.col("__m_end.room") - F.coalesce(F.sum(F.col("__m_tokens") * F.col("__m_n")).over(edge), F.lit(0)))
    fit = F.when(F.col("__m_tokens") > 0, F.least(F.col("__m_n"), F.floor(F.col("__m_left") / F.col("__m_tokens")))).otherwise(F.col("__m_n"))
    border = border.where("__m_left >= 0").withColumn("__m_take", fit.cast("long")).where("__m_take > 0")
    return border


def choose(docs: DataFrame, weights: Mapping = WEIGHTS, share: float | None = 0.5, budget: int | None = None, epochs: int = 2,
           seed: int = 7, domain: Column | None = None) -> DataFrame:
    """What is selected, without the texts: one row per epoch and distinct row of docs that is in it: its leaf, doc_id, lang, source,
    __m_x, __m_epoch, __m_tokens and __m_take, how many of the equal rows are taken, of __m_n."""
    e, bounds = _bounds(docs, weights, share, budget, epochs, seed, domain)
    e = e.join(bounds, list(KEY))
    inside = e.where(F.col("__m_end").isNull() | (_at() < F.col("__m_end.at"))).withColumn("__m_take", F.col("__m_n"))
    cols = [*KEY, "doc_id", "lang", "source", "__m_x", "__m_epoch", "__m_tokens", "__m_n", "__m_take"]
    return inside.select(*cols).union(_border(e).select(*cols))


def mix(docs: DataFrame, weights: Mapping = WEIGHTS, share: float | None = 0.5, budget: int | None = None, epochs: int = 2,
        seed: int = 7, domain: Column | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """docs' columns, and __m_epoch, __m_tokens, __m_domain: one row per selected (row, epoch).
    The budget is `budget` tokens, or `share` of all tokens, rounded down.

    No text is shuffled while there are at most `broadcast_rows` leaves and rows in boundary ranges: a row's own hash and its leaf's bound
    tell the epochs that it is inside of, and only the rows of boundary ranges are looked up."""
    e, bounds = _bounds(docs, weights, share, budget, epochs, seed, domain)
    border = cut(_border(e.join(bounds, list(KEY))).select("__m_x", *KEY, "__m_epoch", "__m_tokens", "__m_n", "__m_take"), "border")
    few = lambda x: F.broadcast(x) if x.count() <= broadcast_rows else x
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = [*names, "__m_domain", "__m_epoch", "__m_tokens"]
    d = _keyed(docs, domain)
    end = F.col("__m_end")
    inside = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda k: end.isNull() | (_at(k, _place(k, seed)) < F.col("__m_end.at")))
    whole = d.select("*", *_text_columns()).join(few(bounds), list(KEY)).withColumn("__m_epoch", F.explode(inside)).select(*out)
    # of rows that are equal in every column the first ones can be any
    edge = d.join(few(border), ["__m_x", *KEY])
    whole = whole.union(edge.where("__m_n = 1").select(*out))
    if not border.where("__m_n > 1").limit(1).count():
        return whole
    again = edge.where("__m_n > 1").groupBy("__m_x", *KEY, "__m_epoch").agg(F.first(F.struct(*names)).alias("__m_row"), F.first("__m_take").alias("__m_take"), F.first("__m_tokens").alias("__m_tokens"))
    again = again.withColumn("__m_copy", F.explode(F.sequence(F.lit(1), F.col("__m_take").cast("int"))))
    own = [F.col(f"__m_row.`{c}`").alias(c) for c in docs.columns]
    return whole.union(again.select(*own, "__m_domain", "__m_epoch", "__m_tokens"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    m = choose(table(spark, sf_dir, "documents"))
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__m_take").cast("int"))))
    return m.select("doc_id", F.col("__m_domain").alias("domain"), "lang", "source", F.col("__m_epoch").cast("long").alias("epoch"),
                    F.col("__m_tokens").cast("long").alias("n_tokens"))


def _sql_weight(level: str) -> str:
    w = WEIGHTS[level]
    return "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in w.items()) + " else 1 end" if w else "1"


def _sql_level(keys: list[str], parent: list[str], budget: str, name: str) -> str:
    """One level of the tree, as _share does it."""
    k, p = ", ".join(keys), ", ".join(parent)
    part = f"partition by {p}" if parent else ""
    using = f"join {budget} using ({p})" if parent else f"cross join {budget}"
    return f"""
n{name} as (select {k}, cast(sum(cap) as hugeint) as cap, cast({_sql_weight(keys[-1])} as hugeint) as w from leaf group by {k}),
o{name} as (select *, coalesce(sum(cap) filter (w > 0) over (b rows between unbounded preceding and 1 preceding), 0) as cap_before,
  sum(w) over (b rows between current row and unbounded following) as w_from
  from n{name} {using} window b as ({part} order by case when w > 0 then cap / w end nulls last, {keys[-1]})),
f{name} as (select *, w > 0 and cap * w_from <= greatest(budget - cap_before, 0) * w as full_ from o{name}),
r{name} as (select *, budget - coalesce(sum(cap) filter (full_) over ({part}), 0) as rest, case when w > 0 and not full_ then w else 0 end as ow from f{name}),
q{name} as (select *, sum(ow) over ({part}) as wo, sum(ow) over ({part} order by {keys[-1]} rows unbounded preceding) as wr from r{name}),
b{name} as (select {k}, case when full_ then cap when ow > 0 then least(cap, (rest * wr) // wo - (rest * (wr - ow)) // wo) else 0 end as budget from q{name})"""


ORACLE = r"""
with base as (select doc_id, lang as lang0, source as source0, th, n_tokens,
  case when num = '' then 'other' when cast(right(num, 1) as int) % 2 = 0 then 'web' else 'books' end as domain,
  coalesce(lang, '(none)') as language, coalesce(source, '(none)') as source
  from (select *, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as num, md5(coalesce(text, '')) as th,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')) as n_tokens from documents)),
leaf as (select domain, language, source, sum(n_tokens) * 2 as cap from base group by all),
b0 as (select cast(floor(coalesce(sum(cap), 0) // 2 * 500 / 1000) as hugeint) as budget from leaf),""" + _sql_level(
    ["domain"], [], "b0", "1") + "," + _sql_level(["domain", "language"], ["domain"], "b1", "2") + "," + _sql_level(
    ["domain", "language", "source"], ["domain", "language"], "b2", "3") + """,
e as (select *, md5(concat('7:', epoch, ':', coalesce(cast(doc_id as varchar), ''), ':', th)) as h from base, (select unnest([0, 1]) as epoch)),
run as (select *, sum(n_tokens) over (partition by domain, language, source order by epoch, h, doc_id nulls first, n_tokens, lang0 nulls first, source0 nulls first rows unbounded preceding) as run from e)
select doc_id, domain, lang0 as lang, source0 as source, cast(epoch as bigint) as epoch, cast(n_tokens as bigint) as n_tokens
from run join b3 using (domain, language, source) where run <= budget and budget > 0
"""

"""WARC: archives written and read by Spark's own text files, records found by boundary chains.

Writing: a record is header, blank line, block; the text writer's line separator is the
CR LF CR LF that ends a record, so the archives go to any store that Spark can write to, each
task its own file. Of records with equal payloads of at least `min_bytes` bytes, the one with the
smallest page_id is a `response`, the others are `revisit` records without a block that refer to
it and keep the payload's digest and length. Digests alone are grouped, payloads are not shuffled:
the list of repeated digests is broadcast while it has at most `broadcast_rows` rows (counted
first), beyond that it is joined by shuffle. Of rows that repeat the smallest page_id of a payload one is the response (the
one with the smallest url, nulls last); the others, which have no block, are written from their counts.

Reading: files are split at the magic `WARC/1.1 CR LF`, so tasks see byte ranges. Every magic is
only a candidate: its header gives the offset of its successor. Candidates whose successor
is the very next candidate form runs; pointer jumping over runs (links double every round) from
offset 0 keeps the reachable ones, so a magic inside a payload is rejected and
its record is put together again. Windows run over lengths and offsets of one task's part of a file, and over a file's parts;
payloads move only where a record has a magic inside, and then only to that record's other pieces.

Edge cases: null html is an empty payload; null url has no target line, control characters in
it are percent-encoded; a null page_id has no id line, is read back as null and is a response
only if its payload has no row with an id; an
empty table gives no records; extra columns are ignored. A file whose chain breaks (cut off
or damaged) yields the records before the break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, table

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100, broadcast_rows: int = 200_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """pages(page_id, url, html) as archives below path."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("page_id", "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("bytes"))
    each = p.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "c"))).alias("f")
    first = each.groupBy("digest").agg(least, F.sum("c").alias("n")).where("n > 1 and f is not null")
    first = cut(first.select("digest", F.col("f.page_id").alias("first"), F.col("f.c").alias("ties")), "repeated")
    hint = F.broadcast if first.count() <= broadcast_rows else lambda x: x
    p = p.join(hint(first.select("digest", "first")), "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    ties = first.where("ties > 1").select("digest", "ties")
    if ties.limit(1).count():
        p = p.join(hint(ties), "digest", "left")
        tied = p.where(F.coalesce("ties", F.lit(0)) > 1).where(F.col("page_id") == F.col("first")).drop("ties")
        cols = ["page_id", "url", "html", "digest", "bytes", "first"]
        p = p.where((F.coalesce("ties", F.lit(0)) <= 1) | ~F.col("page_id").eqNullSafe(F.col("first"))).withColumn("again", again).select(*cols, "again")
        # one group by url gives counts, and the payload from any of its rows
        g = tied.groupBy("digest", "page_id", "url", "bytes", "first").agg(F.count("*").alias("n"), F.first("html").alias("html"))
        g = cut(g, "tied")
        lead = g.groupBy("digest").agg(F.min("url").alias("lead"))
        g = g.join(hint(lead), "digest").withColumn("own", F.col("url").eqNullSafe(F.col("lead")).cast("int"))
        p = p.unionByName(g.where("own = 1").withColumn("again", F.lit(False)).select(*cols, "again"))
        more = g.where("n > own").withColumn("k", F.explode(F.expr("sequence(1, cast(n - own as int))")))
        p = p.unionByName(more.withColumn("html", F.lit("")).withColumn("again", F.lit(True)).select(*cols, "again"))
        again = F.col("again")
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Record-ID", uri(F.col("page_id"))), line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.when(again, uri(F.col("first")))),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html\r\n"), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, value): what stands between magics, in file order by (start, seq)."""
    t = spark.read.option("lineSep", MAGIC).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("seq"), "value")


def _head() -> Column:
    return F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1))


def _field(head: Column, name: str) -> Column:
    v = F.regexp_extract(F.coalesce(head, F.lit("")), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(v != "", v)


def _offsets(seg: DataFrame) -> DataFrame:
    """Adds part (the segment's place among those of one task's part of a file) and off, the offset of the magic before it;
    a file's first segment, which has no magic, is dropped. seg(file, start, seq, len, ...) holds no payloads."""
    w = Window.partitionBy("file", "start").orderBy("seq")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seg = seg.withColumn("part", F.row_number().over(w)).withColumn("before", before)
    sums = seg.groupBy("file", "start").agg(F.sum("len").alias("t"), F.count("*").alias("m"))
    up = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "start", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"__{c}") for c in ("t", "m")])
    seg = seg.join(sums, ["file", "start"]).withColumn("k", F.col("__m") + F.col("part"))
    off = F.col("__t") + F.col("before") + F.lit(len(MAGIC)) * (F.col("k") - 2)
    return seg.withColumn("off", off.cast("long")).where("k > 1").drop("k", "before", "__t", "__m")


def reachable(cand: DataFrame, max_rounds: int = 64) -> DataFrame:
    """cand(file, start, off, succ) -> its rows on the chain that begins at offset 0. Runs end with a task's part of a file."""
    w = Window.partitionBy("file", "start").orderBy("off")
    c = cand.withColumn("run", F.sum(F.when(F.lag("succ").over(w) == F.col("off"), 0).otherwise(1)).over(w))
    c = cut(c.withColumn("run", F.struct("start", "run")), "runs")
    exits = c.groupBy("file", "run").agg(F.max_by("succ", "off").alias("off"))
    hop = exits.join(c.select("file", "off", F.col("run").alias("to")), ["file", "off"]).select("file", "run", "to", F.col("off").alias("entry"))
    hop = cut(hop.where("to <> run"), "hops")
    reached = c.where("off = 0").select("file", "run", F.col("off").alias("entry"))
    for _ in range(max_rounds):
        if not hop.limit(1).count():
            break
        step = reached.select("file", "run").join(hop, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = cut(reached.union(step).distinct(), "reached")
        again = hop.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("entry").alias("far_entry"))
        hop = cut(hop.select("file", "run", "to").join(again, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("far_entry").alias("entry")), "hops")
    return c.join(reached, ["file", "run"]).where("off >= entry").drop("run", "entry")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a true record: file, off, succ, type, page_id, refers_to, url, digest and bytes of the
    full payload. Digests of responses are computed from their blocks."""
    return _records(spark, path)[0]


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records; all segments without their values; the records with their places among the segments."""
    seg = _segments(spark, path).withColumn("head", _head())
    size = F.octet_length("head") + len(END)
    seg = seg.withColumn("len", F.octet_length("value")).withColumn("body", size).withColumn("clen", _field(F.col("head"), "Content-Length").cast("long"))
    whole = F.col("len") == F.col("body") + F.col("clen") + len(END)
    # binary substring: the block's bytes
    block = F.expr("substring(cast(value as binary), cast(body as int) + 1, cast(clen as int))")
    meta = cut(seg.select(
        "file", "start", "seq", "len", "body", "clen", _field(F.col("head"), "WARC-Type").alias("type"),
        F.regexp_extract(F.coalesce("head", F.lit("")), r"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?[0-9]+)>", 1).alias("page_id"),
        F.regexp_extract(F.coalesce("head", F.lit("")), r"(?im)^WARC-Refers-To:[ \t]*<urn:page:(-?[0-9]+)>", 1).alias("refers_to"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"), _field(F.col("head"), "WARC-Payload-Digest").alias("said"),
        _field(F.col("head"), "X-Payload-Length").cast("long").alias("full"), F.when(whole, F.sha2(block, 256)).alias("sha")), "segments")
    c = _offsets(meta).withColumn("succ", F.col("off") + len(MAGIC) + F.col("body") + F.col("clen") + len(END))
    total = meta.groupBy("file").agg((F.sum("len") + len(MAGIC) * (F.count("*") - 1)).alias("total"))
    c = c.where("succ is not null").join(total, "file").where("succ <= total").drop("total")
    r = cut(reachable(c), "reachable")
    split = r.where("sha is null")
    if split.limit(1).count():
        blocks = _join_blocks(spark, path, meta, split).select("file", "off", F.sha2("block", 256).alias("joined"))
        r = r.join(blocks, ["file", "off"], "left").withColumn("sha", F.coalesce("sha", "joined")).drop("joined")
    is_revisit = F.col("type") == "revisit"
    num = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    out = r.select("file", "off", "succ", "type", num("page_id").alias("page_id"), num("refers_to").alias("refers_to"), "url",
                   F.when(is_revisit, F.regexp_replace("said", "^sha256:", "")).otherwise(F.col("sha")).alias("digest"),
                   F.when(is_revisit, F.col("full")).otherwise(F.col("clen")).alias("bytes"))
    return out, meta, r


def _values(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """(file, start, part, value) of all segments: a part's segments follow one another in one task."""
    base = F.broadcast(_segments(spark, path).drop("value").groupBy("file", "start").agg(F.min("seq").alias("__base")))  # one row a part of a file
    return _segments(spark, path).join(base, ["file", "start"]).select("file", "start", (F.col("seq") - F.col("__base") + 1).cast("int").alias("part"), "value")


def _join_blocks(spark: SparkSession, path: str, meta: DataFrame, records: DataFrame) -> DataFrame:
    """(file, off, block) of records(file, off, succ, body, clen): a block is all segments from its record to
    the successor, with the magics between them. Which segments these are follows from offsets alone; only their values are moved."""
    at = _offsets(meta.select("file", "start", "seq", "len")).select("file", "start", "part", F.col("off").alias("place"))
    r = records.select("file", F.col("off").alias("place"), F.struct("off", "succ", "body", "clen").alias("own"))
    at = at.join(r, ["file", "place"], "left")
    # the record that a segment is in began last before it, in this part of the file or an earlier one
    upto = Window.partitionBy("file", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at = cut(at.withColumn("rec", F.last("own", ignorenulls=True).over(upto)).drop("own"), "places")
    ends = at.groupBy("file", "start").agg(F.max_by("rec", "place").alias("end"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "start", F.last("end", ignorenulls=True).over(before).alias("carried"))
    at = at.join(ends, ["file", "start"]).withColumn("rec", F.coalesce("rec", "carried"))
    pieces = at.where("place < rec.succ").select("file", "start", "part", "place", "rec.off", "rec.body", "rec.clen")
    g = _values(spark, path, meta).join(pieces, ["file", "start", "part"]).groupBy("file", "off").agg(
        F.sort_array(F.collect_list(F.struct("place", "value"))).alias("s"), F.first("body").alias("body"), F.first("clen").alias("clen"))
    text = F.array_join(F.transform("s", lambda x: x["value"]), MAGIC)
    return g.withColumn("t", text).select("file", "off", F.expr("substring(cast(t as binary), cast(body as int) + 1, cast(clen as int))").alias("block"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """read_records with `block`, the record's bytes (a revisit has none)."""
    out, meta, r = _records(spark, path)
    return out.join(_join_blocks(spark, path, meta, r), ["file", "off"], "left")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    r = read_records(spark, path)
    return r.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select d, min(page_id) as first_ from p where n >= 100 group by d having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when first_ is not null and (page_id is distinct from first_ or k > 1) then 'revisit' else 'response' end as record_type,
  case when first_ is not null and (page_id is distinct from first_ or k > 1) then first_ end as refers_to
from (select *, row_number() over (partition by d, page_id) as k from p) left join f using (d)
"""

"""More of the catalogue: selections, mappings, captures, ledgers and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid, intervals, selection
from ..streaming import ingest
from .catalogue import _ELEMENTS_SQL, _digests, _extents, query, table

_AXES = [(4, 16, 12, 3), (2, 8, 6, 2)]


@query(f"""select vec_id as i0, p as i1, ((vec_id - 4) // 16 * 3 + (vec_id - 4) % 16) * 12 + (p - 2) // 8 * 2 + (p - 2) % 8 as k
from {_ELEMENTS_SQL} where vec_id between 4 and 4 + 12 * 16 - 1 and (vec_id - 4) % 16 < 3 and p between 2 and 2 + 6 * 8 - 1 and (p - 2) % 8 < 2""")
def q38_hyperslab_rank(spark, sf_dir):
    """The elements of a regular hyperslab with their place in it."""
    cells = grid.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("i0", "i1")
    return cells.withColumn("k", selection.rank([F.col("i0"), F.col("i1")], _AXES)).where("k is not null")


@query("""with m as (select 0 as mapping, 'first' as source, k as v, k * 2 as s from range(60) t(k) union all select 1, 'second', k + 40, k from range(50) t(k)
union all select 2, 'third', 10 + k * 5, 100 + k from range(8) t(k))
select v, source, s, c_custkey as value, case when c_custkey is null then 0 else 1 end as status from (select *, row_number() over (partition by v order by mapping desc) as nth from m)
left join (select c_custkey from customer where c_custkey % 4 <> 0) on c_custkey = s where nth = 1""")
def q39_last_mapping(spark, sf_dir):
    """Virtual points take the last mapping's source point; a missing value stays unknown."""
    maps = [
        ([(0, 1, 60, 1)], "first", [(0, 2, 60, 1)]),
        ([(40, 1, 50, 1)], "second", [(0, 1, 50, 1)]),
        ([(10, 5, 8, 1)], "third", [(100, 1, 8, 1)]),
    ]
    chosen = selection.last_mapping(selection.mapped(spark, maps), ["v0"])
    values = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("value"))
    found = chosen.join(values, F.col("s0") == F.col("value"), "left")
    return found.select(
        F.col("v0").alias("v"), "source", F.col("s0").alias("s"), "value", F.when(F.col("value").isNull(), 0).otherwise(1).alias("status")
    )


@query("""with b as (select doc_id, k as block, substr(text, k * 512 + 1, 512) as now from documents, unnest(range((length(text) + 511) // 512)) t(k)),
c as (select doc_id, block, sha256(now) as now, sha256(case when (doc_id + block) % 9 = 0 then now || 'x' else now end) as was from b)
select doc_id, count(*) as blocks, count(*) filter (now = was) as matching, case when bool_and(now = was) then 1 when bool_or(now = was) then 4 else 2 end as status from c group by 1""")
def q40_capsule_blocks(spark, sf_dir):
    """Block digests against a capsule; a unit with only some matching blocks is partial."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the blocks themselves are exploded, so no row carries the whole text
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,512}"), F.lit(0))
    blocks = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(cut).alias("block", "now"))
    now = F.col("now")
    told = blocks.select(
        "doc_id",
        F.sha2(now, 256).alias("now"),
        F.sha2(F.when((F.col("doc_id") + F.col("block")) % 9 == 0, F.concat(now, F.lit("x"))).otherwise(now), 256).alias("was"),
    )
    same = F.col("now") == F.col("was")
    return told.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count(F.when(same, 1)).alias("matching"),
        F.when(F.bool_and(same), 1).when(F.bool_or(same), 4).otherwise(2).alias("status"),
    )


@query("""select outcome, count(*) as n from (select source, case when count(*) filter (quality is null) = 0 then 'complete' when count(quality) > 0 then 'partial' else 'failed' end as outcome
from (select documents.source || '-' || documents.doc_id // 4 as source, quality from documents left join labels using (doc_id)) group by 1) group by 1""")
def q41_outcomes(spark, sf_dir):
    """How many batches had each outcome."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    batch = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 4))
    seen = rows.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("k"))
    outcome = F.when(F.col("k") == F.col("n"), "complete").when(F.col("k") > 0, "partial").otherwise("failed")
    return seen.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_suppkey as manager, cast(sum(cast(l_quantity as bigint)) as bigint) as length, count(*) as sections, sum(cast(l_quantity as bigint)) <= 15000 and count(*) <= 620 as sound from lineitem group by 1""")
def q42_free_space(spark, sf_dir):
    """Sections of each manager against what its header allows."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("manager"))
    out = rows.agg(F.sum(F.col("l_quantity").cast("bigint")).alias("length"), F.count(F.lit(1)).alias("sections"))
    return out.withColumn("sound", (F.col("length") <= 15000) & (F.col("sections") <= 620))


@query("""with s as (select o_custkey as file, o_orderkey as nth, o_orderkey % 90 + 10 as length, o_orderkey % 6 <> 0 as present from orders),
w as (select *, coalesce(sum(length) over (partition by file order by nth rows between unbounded preceding and 1 preceding), 0) as start from s)
select file, cast(sum(length) as bigint) as declared, cast(sum(case when present then length else 0 end) as bigint) as here, cast(max(case when not present then start end) as bigint) as last_gap from w group by 1""")
def q43_external_segments(spark, sf_dir):
    """Declared segments laid end to end, and where bytes are missing."""
    key = F.col("o_orderkey")
    segments = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file"), key.alias("nth"), (key % 90 + 10).alias("length"), (key % 6 != 0).alias("present")
    )
    laid = selection.segment_starts(segments, "nth", "length", ["file"])
    return laid.groupBy("file").agg(
        F.sum("length").alias("declared"),
        F.sum(F.when(F.col("present"), F.col("length")).otherwise(0)).alias("here"),
        F.max(F.when(~F.col("present"), F.col("start"))).alias("last_gap"),
    )


@query("""with c as (select o_custkey as chain, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as nth, case when o_orderkey % 211 = 0 then -1 else o_orderkey end as child,
lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders),
l as (select *, lag(child) over (partition by chain order by nth) as before from c)
select chain, count(*) as links, bool_and(nth = 1 or before = parent) and count(distinct child) = count(*) as unbroken from l group by 1""")
def q44_link_chains(spark, sf_dir):
    """Each link's parent must be the child before it, without repeats."""
    order = Window.partitionBy("chain").orderBy("id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("id"))
    rows = rows.select(
        "chain",
        "id",
        F.lag("id").over(order).alias("parent"),
        F.when(F.col("id") % 211 == 0, F.lit(-1)).otherwise(F.col("id")).alias("child"),
    )
    rows = rows.withColumn("before", F.lag("child").over(order))
    whole = F.bool_and(F.col("parent").isNull() | (F.col("before") == F.col("parent")))
    return rows.groupBy("chain").agg(
        F.count(F.lit(1)).alias("links"), (whole & (F.count_distinct("child") == F.count(F.lit(1)))).alias("unbroken")
    )


@query("""select o_orderkey as k, cast(floor(log2(o_orderkey // 2 + 1)) as bigint) as "row", cast((o_orderkey // 8) & 1 as bigint) as bit, (o_orderkey * 12) % 16 = 0 as aligned from orders""")
def q45_array_schedule(spark, sf_dir):
    """The row of an extensible array's element, a bitmap test, and alignment, all in integers."""
    k = F.col("o_orderkey")
    row = F.length(F.bin((F.floor(k / 2) + 1).cast("bigint"))).cast("bigint") - 1
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        row.alias("row"),
        F.getbit(F.floor(k / 8).cast("bigint"), F.lit(0)).cast("bigint").alias("bit"),
        (k * 12 % 16 == 0).alias("aligned"),
    )


@query("""select l_orderkey // 1024 as chunk, count(*) as elements, count(*) filter (l_orderkey % 97 <> 0) as verified from lineitem group by 1""")
def q46_element_baseline(spark, sf_dir):
    """Element by element against a prior capture."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    element = lambda part: F.sha2(F.concat_ws(",", "l_orderkey", "l_linenumber", part), 256)
    changed = F.col("l_partkey") + (F.col("l_orderkey") % 97 == 0).cast("int")
    now, was = element(changed), element(F.col("l_partkey"))
    return rows.groupBy(grid.chunk_of("l_orderkey", 1024).alias("chunk")).agg(
        F.count(F.lit(1)).alias("elements"), F.count(F.when(now == was, 1)).alias("verified")
    )


@query("""with c as (select l_orderkey // 64 as chunk, sha256(string_agg(cast(l_partkey as varchar), ',' order by l_partkey)) as digest from lineitem group by 1)
select chunk // 16 as part, sha256(string_agg(digest, '' order by chunk)) as digest from c group by 1""")
def q47_digest_tree(spark, sf_dir):
    """Digests of digests in coordinate order, a level that distributes."""
    parts = _digests(spark, sf_dir).groupBy(grid.chunk_of("chunk", 16).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "digest")))
    return parts.agg(F.sha2(F.array_join(ordered["digest"], ""), 256).alias("digest"))


@query("""with g as (select k as chunk from range((select max(l_orderkey) // 64 + 1 from lineitem)) t(k)), a as (select distinct l_orderkey // 64 as chunk, true as here from lineitem where l_orderkey // 64 % 7 <> 3)
select chunk, coalesce(here, false) as allocated from g left join a using (chunk)""")
def q48_allocated(spark, sf_dir):
    """The dense grid with what is allocated; the rest is unknown."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    n = (rows.agg(F.max("l_orderkey")).first()[0] or 0) // 64 + 1
    here = rows.select(grid.chunk_of("l_orderkey", 64).alias("chunk")).where("chunk % 7 <> 3").distinct().withColumn("here", F.lit(True))
    return grid.grid(spark, (n,), (1,)).select(F.col("c0").alias("chunk")).join(here, "chunk", "left").select(
        "chunk", F.coalesce("here", F.lit(False)).alias("allocated")
    )


@query("""select epoch(date_trunc('hour', ts)) as window_start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,6))) as varchar) as total from events group by 1, 2""")
def q49_windowed_events(spark, sf_dir):
    """Event-time windows with a watermark; the same code serves streams."""
    rows = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.unix_timestamp("window_start").cast("double").alias("window_start"), "event_type", "n", F.col("total").cast("string").alias("total"))


@query("""select a.l_orderkey, a.l_linenumber, a.l_partkey as value from lineitem a join (select l_orderkey, l_linenumber, case when l_orderkey % 31 = 0 then null when l_orderkey % 37 = 0 then l_partkey + 1 else l_partkey end as v from lineitem) b
on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey is not distinct from b.v where a.l_linenumber = 1""")
def q50_two_readers(spark, sf_dir):
    """Values on which two independent readers agree bit for bit. Of lines numbered 1, as in the SQL;
    q55_two_readers_of_all takes all."""
    return _two_readers(table(spark, sf_dir, "lineitem").where("l_linenumber = 1"))


def _two_readers(lines):
    one = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("value"))
    k = F.col("l_orderkey")
    other = one.select(
        "l_orderkey", "l_linenumber", F.when(k % 31 != 0, F.when(k % 37 == 0, F.col("value") + 1).otherwise(F.col("value"))).alias("other")
    )
    both = one.join(other, ["l_orderkey", "l_linenumber"])
    return both.where(F.col("value").eqNullSafe(F.col("other"))).select("l_orderkey", "l_linenumber", "value")


@query()
def q55_two_readers_of_all(spark, sf_dir):
    """q50_two_readers over all lines."""
    return _two_readers(table(spark, sf_dir, "lineitem"))


@query("""with was as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as digest from documents where doc_id % 3 <> 0)
select d.doc_id, coalesce(sha256(d.text) = was.digest, false) as reused from documents d left join was using (doc_id)""")
def q51_batch_resume(spark, sf_dir):
    """Rows of an earlier run count again only if their source has the same digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    was = docs.where("doc_id % 3 <> 0").select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest")
    )
    return docs.join(was, "doc_id", "left").select("doc_id", F.coalesce(F.sha2("text", 256) == F.col("digest"), F.lit(False)).alias("reused"))


@query("""with e as (select l_suppkey as source, cast(floor(l_extendedprice) as bigint) as start, cast(floor(l_extendedprice) as bigint) + cast(floor(l_quantity) as bigint) as stop, l_orderkey, l_linenumber from lineitem where l_suppkey <= 20 and l_orderkey % 4 = 0)
select a.source, a.l_orderkey as first_order, b.l_orderkey as second_order, a.l_linenumber as first_line, b.l_linenumber as second_line from e a join e b
on a.source = b.source and a.start < b.stop and b.start < a.stop and (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber)""")
def q52_conflicting_proposals(spark, sf_dir):
    """Pairs of proposals of a source that claim a common byte. Of 20 sources and every fourth order, as in the SQL;
    q56_all_conflicting_proposals takes all."""
    return _conflicts(_extents(spark, sf_dir).where("source <= 20 and l_orderkey % 4 = 0"))


def _conflicts(rows):
    side = lambda a, b: rows.select(
        "source", F.col("start").alias(f"{a}_start"), F.col("stop").alias(f"{a}_stop"), F.col("l_orderkey").alias(f"{b}_order"), F.col("l_linenumber").alias(f"{b}_line")
    )
    pairs = intervals.range_join(side("l", "first"), side("r", "second"), 256, ["source"])
    earlier = F.struct("first_order", "first_line") < F.struct("second_order", "second_line")
    return pairs.where(earlier).select("source", "first_order", "second_order", "first_line", "second_line")


@query()
def q56_all_conflicting_proposals(spark, sf_dir):
    """All pairs of proposals of a source that claim a common byte."""
    return _conflicts(_extents(spark, sf_dir))


@query("""select l_orderkey // 512 as stripe, count(*) as members, cast(sum(l_partkey % 3) as bigint) as checks, count(distinct l_partkey) = count(*) as distinct_ids from lineitem group by 1""")
def q53_distinctness(spark, sf_dir):
    """Unique ids and subtree totals."""
    rows = table(spark, sf_dir, "lineitem").groupBy(grid.chunk_of("l_orderkey", 512).alias("stripe"))
    return rows.agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.col("l_partkey") % 3).alias("checks"),
        (F.count_distinct("l_partkey") == F.count(F.lit(1))).alias("distinct_ids"),
    )

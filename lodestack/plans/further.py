"""More of the catalogue: joins whose sides are tables of their own, budgets, context, segments of unequal length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture, grid, intervals, ledger
from .catalogue import query, table


@query("""with k as (select l_orderkey, l_linenumber from lineitem group by all),
now as (select l_orderkey, l_linenumber, sha256(string_agg(cast(l_partkey + case when l_orderkey % 97 = 0 then 1 else 0 end as varchar), ',' order by l_partkey)) as d from lineitem where l_orderkey % 11 <> 0 group by all),
was as (select l_orderkey, l_linenumber, sha256(string_agg(cast(l_partkey as varchar), ',' order by l_partkey)) as d from lineitem where l_orderkey % 13 <> 0 group by all)
select l_orderkey // 1024 as chunk, case when now.d is null then 'allocation_unknown' when was.d is null then 'unverified' when now.d = was.d then 'accepted' else 'unavailable' end as status, count(*) as elements
from k left join now using (l_orderkey, l_linenumber) left join was using (l_orderkey, l_linenumber) group by 1, 2""")
def q57_element_join(spark, sf_dir):
    """The elements of a damaged copy joined with those of a capture, each side with elements that the other lacks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    on = ["l_orderkey", "l_linenumber"]
    changed = rows.withColumn("l_partkey", F.col("l_partkey") + (F.col("l_orderkey") % 97 == 0).cast("int"))
    now = capture.digest(changed.where("l_orderkey % 11 <> 0"), on, "l_partkey")
    was = capture.digest(rows.where("l_orderkey % 13 <> 0"), on, "l_partkey")
    found = capture.compare_baseline(rows.select(*on).distinct(), now, was, on)
    return found.groupBy(grid.chunk_of("l_orderkey", 1024).alias("chunk"), "status").agg(F.count(F.lit(1)).alias("elements"))


@query("""with c as (select l_orderkey // 64 as chunk, bit_xor(l_partkey) as v from lineitem group by 1),
j as (select c.chunk, w.v as was, n.v as now, a.v as r0, b.v as r1, d.v as r2 from (select chunk from c) c
left join (select * from c where chunk % 13 <> 0) w using (chunk) left join (select * from c where chunk % 4 <> 0) n using (chunk)
left join (select chunk, case when chunk % 3 = 0 then v + 1 else v end as v from c where chunk % 10 <> 9) a using (chunk)
left join (select * from c where chunk % 3 <> 1) b using (chunk) left join (select chunk, case when chunk % 5 = 0 then v - 1 else v end as v from c) d using (chunk)),
m as (select *, case when r0 = was then 0 when r1 = was then 1 when r2 = was then 2 else -1 end as hit, was is not null and now is not null and now = was as ok,
(r0 is not null and r0 <> r2) or (r1 is not null and r1 <> r2) or (r0 is not null and r1 is not null and r0 <> r1) as differ from j)
select chunk, case when ok then 'accepted' when was is not null and hit >= 0 then 'recovered' when was is null and differ then 'ambiguous' else 'unavailable' end as status,
case when ok then -1 when was is not null and hit >= 0 then hit end as source from m""")
def q58_replica_join(spark, sf_dir):
    """The damaged copy, its capture and three replicas, each a table with gaps of its own, joined by unit."""
    rows = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 64).alias("chunk"), "l_partkey")
    units = rows.groupBy("chunk").agg(F.bit_xor("l_partkey").alias("v"))
    c, v = F.col("chunk"), F.col("v")
    sides = {
        "was": units.where(c % 13 != 0),
        "now": units.where(c % 4 != 0),
        "r0": units.where(c % 10 != 9).withColumn("v", F.when(c % 3 == 0, v + 1).otherwise(v)),
        "r1": units.where(c % 3 != 1),
        "r2": units.withColumn("v", F.when(c % 5 == 0, v - 1).otherwise(v)),
    }
    met = units.select("chunk")
    for name, side in sides.items():
        met = met.join(side.withColumnRenamed("v", name), "chunk", "left")
    return capture.choose_replica(met, ["r0", "r1", "r2"]).select("chunk", "status", "source")


@query("""with r as (select l_suppkey as source, cast(floor(l_quantity) as bigint) as size, sum(cast(floor(l_quantity) as bigint)) over (partition by l_suppkey
order by l_orderkey, l_linenumber, l_partkey, floor(l_quantity) rows unbounded preceding) as total from lineitem)
select source, count(*) as elements, count(*) filter (total <= 4000) as admitted, cast(coalesce(sum(size) filter (total <= 4000), 0) as bigint) as bytes, max(total) > 4000 as partial from r group by 1""")
def q59_byte_budget(spark, sf_dir):
    """Elements of a source in coordinate order until its budget is used up; what is over it is reported, not lost."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), "l_orderkey", "l_linenumber", "l_partkey", F.floor("l_quantity").cast("bigint").alias("size")
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "size"]
    told = ledger.running_total(rows, ["source"], order, "size", 4096)
    inside = F.col("total") <= 4000
    return told.groupBy("source").agg(
        F.count(F.lit(1)).alias("elements"),
        F.count(F.when(inside, 1)).alias("admitted"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("bytes"),
        (F.max("total") > 4000).alias("partial"),
    )


@query("""select n_regionkey as top, n_nationkey as grp, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as names, count(*) filter (c_mktsegment like '%BUILD%') as units,
count(*) filter (c_custkey % 3 = 0) as hard, count(*) filter (c_custkey % 3 = 1) as soft, count(*) filter (c_custkey % 3 = 2) as external
from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)""")
def q60_context(spark, sf_dir):
    """Names of attributes, unit attributes and kinds of links of each group and of the groups above it."""
    groups = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    members = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    met = members.join(groups, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 3
    return met.rollup(F.col("n_regionkey").alias("top"), F.col("n_nationkey").alias("grp")).agg(
        F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("names"),
        F.count(F.when(F.col("c_mktsegment").contains("BUILD"), 1)).alias("units"),
        F.count(F.when(kind == 0, 1)).alias("hard"),
        F.count(F.when(kind == 1, 1)).alias("soft"),
        F.count(F.when(kind == 2, 1)).alias("external"),
    )


@query("""select l_suppkey as source, cast(floor(l_extendedprice) as bigint) as start, l_orderkey, l_linenumber from lineitem order by all""")
def q61_sorted_extents(spark, sf_dir):
    """Extents by source and offset; a range-partitioned sort, so no task gets more than its share."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.floor("l_extendedprice").cast("bigint").alias("start"), "l_orderkey", "l_linenumber"
    )
    return rows.orderBy("source", "start", "l_orderkey", "l_linenumber")


@query("""with c as (select doc_id, case when doc_id % 4 = 0 then text || 'x' else text end as text from documents where doc_id % 6 <> 5),
w as (select d.doc_id, c.doc_id is not null as held, sha256(d.text) = sha256(c.text) as same from documents d left join c using (doc_id)),
nb as (select doc_id, k as block, sha256(substr(text, k * 512 + 1, 512)) as h from documents, unnest(range((length(text) + 511) // 512)) t(k)),
cb as (select doc_id, k as block, sha256(substr(text, k * 512 + 1, 512)) as h from c, unnest(range((length(text) + 511) // 512)) t(k)),
m as (select doc_id, count(*) as n from nb join cb using (doc_id, block) where nb.h = cb.h group by 1)
select doc_id, case when same then 'accepted' when not held then 'unverified' when coalesce(n, 0) > 0 then 'partial' else 'unavailable' end as status,
case when held and not same then coalesce(n, 0) end as matching from w left join m using (doc_id)""")
def q62_capsule_join(spark, sf_dir):
    """Units against the table of a capsule by coordinate; only those that differ are joined again, block by block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.where("doc_id % 6 <> 5")
    held = held.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    whole = F.sha2("text", 256)
    told = docs.select("doc_id", whole.alias("now")).join(held.select("doc_id", whole.alias("was")), "doc_id", "left")
    differ = told.where("now <> was").select("doc_id")

    def blocks(rows, name):
        cut = F.regexp_extract_all("text", F.lit("(?s).{1,512}"), F.lit(0))
        some = rows.join(differ, "doc_id", "left_semi").where(F.length("text") > 0)
        return some.select("doc_id", F.posexplode(cut).alias("block", "b")).select("doc_id", "block", F.sha2("b", 256).alias(name))

    same = blocks(docs, "bn").join(blocks(held, "bw"), ["doc_id", "block"]).where("bn = bw")
    told = told.join(same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("now") == F.col("was"), "accepted")
        .when(F.col("was").isNull(), "unverified")
        .when(n > 0, "partial")
        .otherwise("unavailable")
    )
    return told.select("doc_id", status.alias("status"), F.when(F.col("now") != F.col("was"), n).alias("matching"))


@query("""with s as (select s_suppkey as segment, s_suppkey * s_suppkey * 100 as start, (s_suppkey + 1) * (s_suppkey + 1) * 100 as stop from supplier)
select segment, count(*) as points, cast(sum(cast(floor(l_extendedprice) as bigint) - start) as bigint) as offsets from lineitem join s on cast(floor(l_extendedprice) as bigint) >= start and cast(floor(l_extendedprice) as bigint) < stop group by 1""")
def q63_unequal_segments(spark, sf_dir):
    """Which segment holds a byte, where segments differ in length."""
    key = F.col("s_suppkey").cast("bigint")
    # null where it is above any bigint: a segment that starts there holds no byte, one that ends there holds all bytes from its start
    edge = lambda k: F.try_multiply(F.try_multiply(k, k), F.lit(100))
    segments = table(spark, sf_dir, "supplier").select(
        key.alias("segment"),
        edge(key).alias("r_start"),
        F.coalesce(edge(F.try_add(key, F.lit(1))), F.lit(2**63 - 1)).alias("r_stop"),
    )
    at = F.floor("l_extendedprice").cast("bigint")
    # bytes asked for are counted before they meet the segments
    points = table(spark, sf_dir, "lineitem").groupBy(at.alias("l_start")).agg(F.count(F.lit(1)).alias("n"))
    met = intervals.holders(points, segments, "l_start")
    return met.groupBy("segment").agg(
        F.sum("n").alias("points"), F.sum(F.col("n") * (F.col("l_start") - F.col("r_start"))).alias("offsets")
    )


@query("""with r as (select doc_id, text, doc_id % 40 as a, doc_id % 40 + 64 as b, doc_id % 40 + 32 + doc_id % 80 as c, doc_id % 40 + 96 + doc_id % 80 as d from documents)
select doc_id, sha256(substr(text, 1, a) || case when c > b then substr(text, b + 1, c - b) else '' end || substr(text, d + 1)) as digest from r where text is not null""")
def q64_complement_digest(spark, sf_dir):
    """The digest of what captured ranges leave out; ranges may overlap. Within a row, nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    a = F.col("doc_id") % 40
    ranges = F.array(
        F.struct(a.cast("int").alias("start"), (a + 64).cast("int").alias("stop")),
        F.struct((a + 32 + F.col("doc_id") % 80).cast("int").alias("start"), (a + 96 + F.col("doc_id") % 80).cast("int").alias("stop")),
    )
    return docs.select("doc_id", F.sha2(capture.complement(F.col("text"), ranges), 256).alias("digest"))

"""The query catalogue: every entry with its DataFrame form and, where SQL can express it, DuckDB's.

The tables stand in for array containers: ``embeddings`` is a rank-two array, ``lineitem`` rows are elements of chunks and byte
extents, ``orders`` are metadata ranges and updates, ``documents`` and ``labels`` are objects with partial evidence. Faults are
injected by modulo rules. Prices are cut with ``floor``, so both engines see the same integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import capture, graph, grid, intervals, ledger

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status(i):
    return F.when(i % 7 == 0, 6).when(i % 5 == 0, 2).otherwise(1)


_STATUS_SQL = "case when vec_id % 7 = 0 then 6 when vec_id % 5 = 0 then 2 else 1 end"
_ELEMENTS_SQL = "(select vec_id, unnest(range(len(embedding))) as p, unnest(embedding) as v from embeddings)"


@query(f"select vec_id // 32 as c0, p // 16 as c1, count(*) as n from {_ELEMENTS_SQL} group by all")
def q01_grid_cells(spark, sf_dir):
    """Elements of each chunk of a rank-two array."""
    cells = grid.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cells.groupBy(grid.chunk_of("i0", 32).alias("c0"), grid.chunk_of("i1", 16).alias("c1")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    f"select vec_id as i0, cast(p as bigint) as i1, case when {_STATUS_SQL} = 1 then cast(v as double) end as value, "
    f"{_STATUS_SQL} as status from {_ELEMENTS_SQL} where vec_id >= 10 and vec_id < 40 and p >= 8 and p < 24"
)
def q02_masked_slice(spark, sf_dir):
    """A hyperslab whose value is null unless its status is accepted. The row filter reaches the scan."""
    rows = grid.hyperslab(table(spark, sf_dir, "embeddings"), vec_id=(10, 40))
    cells = grid.hyperslab(grid.long_form(rows, "vec_id", "embedding"), i1=(8, 24))
    status = _status(F.col("i0"))
    return cells.select("i0", "i1", grid.masked(F.col("value").cast("double"), status).alias("value"), status.alias("status"))


@query("""with s as (select d.doc_id // 64 as chunk, case when count(l.doc_id) >= 24 then 1 when count(l.doc_id) > 0 then 4 else 0 end as status
from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1)
select doc_id, doc_id // 64 as chunk, status from documents join s on doc_id // 64 = chunk""")
def q03_expand_chunk_status(spark, sf_dir):
    """Chunk status from partial evidence, spread over the chunk's elements."""
    docs = table(spark, sf_dir, "documents").select("doc_id", grid.chunk_of("doc_id", 64).alias("chunk"))
    seen = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(1))
    n = F.count("seen")
    status = docs.join(seen, "doc_id", "left").groupBy("chunk").agg(F.when(n >= 24, 1).when(n > 0, 4).otherwise(0).alias("status"))
    return grid.expand(docs, status, ["chunk"]).select("doc_id", "chunk", "status")


@query(f"""select vec_id // 32 as chunk, count(*) filter ({_STATUS_SQL} = 1) as accepted, count(*) filter ({_STATUS_SQL} = 2) as missing,
count(*) filter ({_STATUS_SQL} = 6) as refused, case when bool_and({_STATUS_SQL} = 1) then 'complete' else 'partial' end as outcome
from embeddings group by 1""")
def q04_status_histogram(spark, sf_dir):
    """Status counts and outcome of each chunk."""
    rows = table(spark, sf_dir, "embeddings").select(
        grid.chunk_of("vec_id", 32).alias("chunk"), _status(F.col("vec_id")).alias("status")
    )
    n = lambda code: F.count(F.when(F.col("status") == code, 1))
    return rows.groupBy("chunk").agg(
        n(1).alias("accepted"), n(2).alias("missing"), n(6).alias("refused"), grid.outcome(F.col("status")).alias("outcome")
    )


@query("""with d as (select max(vec_id) + 1 as n from embeddings),
g as (select c0, c1, least(32, n - c0 * 32) * least(24, 64 - c1 * 24) as elements from d, unnest(range((n + 31) // 32)) a(c0), unnest(range(3)) b(c1))
select cast(sum(case when (c0 + c1) % 3 <> 0 then elements else 0 end) as bigint) as accepted, cast(sum(elements) as bigint) as total, count(*) as chunks from g""")
def q05_accepted_elements(spark, sf_dir):
    """Accepted elements, edge chunks weighted by what they hold. Only the extent comes to the driver."""
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n")).first()["n"] or 0
    cells = grid.grid(spark, (n, 64), (32, 24))
    return cells.agg(
        F.sum(F.when((F.col("c0") + F.col("c1")) % 3 != 0, F.col("elements")).otherwise(0)).alias("accepted"),
        F.sum("elements").alias("total"),
        F.count(F.lit(1)).alias("chunks"),
    )


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as least from documents where text is not null group by 1 having count(*) > 1")
def q06_duplicate_digests(spark, sf_dir):
    """Texts that stand more than once, by digest."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return capture.repeated(docs, ["digest"], "doc_id")


_DIGEST_SQL = "select l_orderkey // 64 as chunk, sha256(string_agg(cast(l_partkey as varchar), ',' order by l_partkey)) as digest from lineitem group by 1"


def _digests(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 64).alias("chunk"), "l_partkey")
    return capture.digest(rows, ["chunk"], "l_partkey")


@query(_DIGEST_SQL)
def q07_chunk_digests(spark, sf_dir):
    """SHA-256 of each chunk."""
    return _digests(spark, sf_dir)


@query("select l_orderkey // 512 as stripe, bit_xor(l_partkey) as parity from lineitem group by 1")
def q08_xor_parity(spark, sf_dir):
    """XOR parity of each stripe."""
    rows = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 512).alias("stripe"), "l_partkey")
    return capture.xor_parity(rows, ["stripe"], "l_partkey")


@query("""with c as (select l_orderkey // 64 as chunk, l_orderkey // 512 as stripe, bit_xor(l_partkey) as v from lineitem group by all),
p as (select stripe, bit_xor(v) as parity from c group by 1),
m as (select stripe, count(*) filter (chunk % 8 = stripe % 8 or (stripe % 5 = 0 and chunk % 8 = (stripe + 1) % 8)) as missing,
bit_xor(v) filter (not (chunk % 8 = stripe % 8 or (stripe % 5 = 0 and chunk % 8 = (stripe + 1) % 8))) as companions,
max(v) filter (chunk % 8 = stripe % 8) as truth from c group by 1)
select stripe, missing, case when missing = 1 then xor(parity, coalesce(companions, 0)) end as restored,
coalesce(missing = 1 and xor(parity, coalesce(companions, 0)) = truth, false) as exact from m join p using (stripe)""")
def q09_xor_restore(spark, sf_dir):
    """One lost member of a stripe comes back, two do not."""
    rows = table(spark, sf_dir, "lineitem").select(
        grid.chunk_of("l_orderkey", 64).alias("chunk"), grid.chunk_of("l_orderkey", 512).alias("stripe"), "l_partkey"
    )
    members = rows.groupBy("chunk", "stripe").agg(F.bit_xor("l_partkey").alias("v"))
    first = F.col("chunk") % 8 == F.col("stripe") % 8
    second = (F.col("stripe") % 5 == 0) & (F.col("chunk") % 8 == (F.col("stripe") + 1) % 8)
    damaged = members.withColumn("left", F.when(~(first | second), F.col("v")))
    back = capture.xor_restore(damaged.drop("v"), capture.xor_parity(members, ["stripe"], "v"), ["stripe"], "left")
    truth = members.where(first).select("stripe", F.col("v").alias("truth"))
    exact = F.coalesce(F.col("restored") == F.col("truth"), F.lit(False))
    return back.join(truth, "stripe", "left").select("stripe", "missing", "restored", exact.alias("exact"))


@query(f"""with was as ({_DIGEST_SQL}), now as (select l_orderkey // 64 as chunk, sha256(string_agg(cast(l_partkey + case when l_orderkey % 197 = 0 then 1 else 0 end as varchar), ','
order by l_partkey + case when l_orderkey % 197 = 0 then 1 else 0 end)) as digest from lineitem where l_orderkey // 64 % 11 <> 0 group by 1)
select was.chunk, case when now.digest is null then 'allocation_unknown' when was.chunk % 13 = 0 then 'unverified' when now.digest = was.digest then 'accepted' else 'unavailable' end as status
from was left join now using (chunk)""")
def q10_baseline_compare(spark, sf_dir):
    """Digests of a damaged copy against a prior capture."""
    rows = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 64).alias("chunk"), "l_orderkey", "l_partkey")
    changed = rows.withColumn("l_partkey", F.col("l_partkey") + (F.col("l_orderkey") % 197 == 0).cast("int"))
    now = capture.digest(changed.where("chunk % 11 <> 0"), ["chunk"], "l_partkey")
    was = _digests(spark, sf_dir).where("chunk % 13 <> 0")
    units = rows.select("chunk").distinct()
    return capture.compare_baseline(units, now, was, ["chunk"]).select("chunk", "status")


@query("""with c as (select l_orderkey // 64 as chunk, bit_xor(l_partkey) as v from lineitem group by 1),
r as (select chunk, case when chunk % 13 <> 0 then v end as was, case when chunk % 4 <> 0 then v end as now,
case when chunk % 3 = 0 then v + 1 else v end as r0, case when chunk % 3 = 1 then null else v end as r1, case when chunk % 5 = 0 then v - 1 else v end as r2 from c),
m as (select *, case when r0 = was then 0 when r1 = was then 1 when r2 = was then 2 else -1 end as hit, was is not null and now is not null and now = was as ok,
(r0 <> r2) or (r1 is not null and (r0 <> r1 or r1 <> r2)) as differ from r)
select chunk, case when ok then 'accepted' when was is not null and hit >= 0 then 'recovered' when was is null and differ then 'ambiguous' else 'unavailable' end as status,
case when ok then -1 when was is not null and hit >= 0 then hit end as source from m""")
def q11_replica_choice(spark, sf_dir):
    """Which replica restores a unit; without a capture, disagreement stays ambiguous."""
    rows = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 64).alias("chunk"), "l_partkey")
    units = rows.groupBy("chunk").agg(F.bit_xor("l_partkey").alias("v"))
    c, v = F.col("chunk"), F.col("v")
    units = units.select(
        "chunk",
        F.when(c % 13 != 0, v).alias("was"),
        F.when(c % 4 != 0, v).alias("now"),
        F.when(c % 3 == 0, v + 1).otherwise(v).alias("r0"),
        F.when(c % 3 != 1, v).alias("r1"),
        F.when(c % 5 == 0, v - 1).otherwise(v).alias("r2"),
    )
    return capture.choose_replica(units, ["r0", "r1", "r2"]).select("chunk", "status", "source")


_EXTENT_SQL = """select l_suppkey as source, l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint) as start,
cast(floor(l_extendedprice) as bigint) + cast(floor(l_quantity) as bigint) as stop from lineitem"""


def _extents(spark, sf_dir) -> DataFrame:
    start = F.floor("l_extendedprice").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"),
        "l_orderkey",
        "l_linenumber",
        start.alias("start"),
        (start + F.floor("l_quantity").cast("bigint")).alias("stop"),
    )


@query(f"""select source, l_orderkey, l_linenumber, start, stop from (select *, max(stop) over (partition by source order by start, l_orderkey, l_linenumber
rows between unbounded preceding and 1 preceding) as reach from ({_EXTENT_SQL})) where reach > start""")
def q12_overlapping_extents(spark, sf_dir):
    """Extents that overlap an earlier one of their source, nested ones included."""
    return intervals.overlapping(_extents(spark, sf_dir), ["source"], ["l_orderkey", "l_linenumber"])


@query(f"""select m.o_orderkey, count(*) as hits, cast(sum(least(e.stop, m.stop) - greatest(e.start, m.start)) as bigint) as bytes
from (select o_orderkey, cast(floor(o_totalprice) as bigint) as start, cast(floor(o_totalprice) as bigint) + 8 as stop from orders) m
join ({_EXTENT_SQL}) e on e.start < m.stop and m.start < e.stop group by 1""")
def q13_payload_in_metadata(spark, sf_dir):
    """Payload extents that run into metadata ranges: a bucketed range join."""
    start = F.floor("o_totalprice").cast("bigint")
    ranges = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("r_start"), (start + 8).alias("r_stop"))
    payload = _extents(spark, sf_dir).select(F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    both = intervals.range_join(payload, ranges, 64)
    shared = F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")
    return both.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("hits"), F.sum(shared).alias("bytes"))


_UNION_SQL = """with e as ({extents}), f as (select *, case when start < max(stop) over (partition by source order by start, stop, l_orderkey, l_linenumber
rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from e),
g as (select *, sum(fresh) over (partition by source order by start, stop, l_orderkey, l_linenumber rows unbounded preceding) as island from f),
u as (select source, min(start) as start, max(stop) as stop, count(*) as members from g group by source, island)"""


@query(
    _UNION_SQL.format(extents=_EXTENT_SQL)
    + """ select o_orderkey, exists (select 1 from u where u.source = o_custkey % 100 + 1 and u.start <= cast(floor(o_totalprice) as bigint) and cast(floor(o_totalprice) as bigint) + 4 <= u.stop) as covered from orders"""
)
def q14_covered_updates(spark, sf_dir):
    """Updates that one island of the checked ranges holds entirely."""
    start = F.floor("o_totalprice").cast("bigint")
    updates = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 100 + 1).alias("source"), start.alias("start"), (start + 4).alias("stop")
    )
    return intervals.covered(updates, _extents(spark, sf_dir), ["source"], ["o_orderkey"], 1024).select("o_orderkey", "covered")


@query(_UNION_SQL.format(extents=_EXTENT_SQL) + " select source, start, stop, members from u")
def q15_interval_union(spark, sf_dir):
    """Merged extents; touching ones stay apart."""
    return intervals.union(_extents(spark, sf_dir), ["source"]).select("source", "start", "stop", "members")


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as run from events)
select user_id, event_type, count(*) as n, min(event_id) as first_event_id, max(event_id) as last_event_id from r group by user_id, event_type, run having count(*) > 1""")
def q16_runs(spark, sf_dir):
    """Runs of equal events of a user."""
    found = intervals.runs(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.where("n > 1").select("user_id", "event_type", "n", "first_event_id", "last_event_id")


@query("""with c as (select conv_id, row_number() over (partition by conv_id order by turn, role) as slot, case when conv_id % 10 = 0 and turn = 2 then turn - 2 else turn end as turn from conversations)
select conv_id, slot, turn, before from (select *, lag(turn) over (partition by conv_id order by slot) as before from c) where turn <= before""")
def q17_ordered_keys(spark, sf_dir):
    """Keys that don't increase; a fault is injected."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    slot = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    faulty = turns.withColumn("slot", slot).withColumn(
        "turn", F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 2), F.col("turn") - 2).otherwise(F.col("turn"))
    )
    return intervals.not_increasing(faulty, ["conv_id"], ["slot"], "turn").select("conv_id", "slot", "turn", "before")


@query("""select n_regionkey, left_key, right_key from (select n_regionkey, n_nationkey // 2 as left_key, lead(n_nationkey // 2) over (partition by n_regionkey order by n_nationkey // 2) as right_key
from (select distinct n_regionkey, n_nationkey // 2 * 2 as n_nationkey from nation where n_nationkey % 5 <> 3)) where right_key - left_key > 1""")
def q18_missing_slots(spark, sf_dir):
    """Missing slots with the neighbours that bracket them."""
    slots = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 3").select(
        "n_regionkey", F.floor(F.col("n_nationkey") / 2).cast("int").alias("slot")
    ).distinct()
    return intervals.gaps(slots, ["n_regionkey"], "slot")


@query("""select l_partkey, l_suppkey, l_orderkey, cast(l_quantity as bigint) as coverage from (select *, row_number() over (partition by l_partkey
order by l_quantity desc, l_orderkey, l_linenumber, l_suppkey) as nth from lineitem) where nth = 1""")
def q19_best_route(spark, sf_dir):
    """The attempt with the highest coverage, the first of a tie. An aggregate, so nothing is sorted and it combines early."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("coverage"))
    best = ledger.best(rows, ["l_partkey"], "coverage", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return best.select("l_partkey", "l_suppkey", "l_orderkey", "coverage")


@query("""select chunk, nth, l_orderkey, l_linenumber from (select l_orderkey // 4096 as chunk, l_orderkey, l_linenumber,
row_number() over (partition by l_orderkey // 4096 order by l_orderkey, l_linenumber) as nth from lineitem where l_discount > 0.09) where nth <= 3""")
def q20_first_failures(spark, sf_dir):
    """At most three failures of each chunk."""
    rows = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(
        grid.chunk_of("l_orderkey", 4096).alias("chunk"), "l_orderkey", "l_linenumber"
    )
    return ledger.first_n(rows, ["chunk"], ["l_orderkey", "l_linenumber"], 3)


@query("""select reason, count(*) as n from (select unnest(list_filter([case when text is null or text = '' then 'empty' end, case when n_chars < 200 then 'short' end,
case when n_chars > 8000 then 'long' end, case when lang <> 'en' then 'lang_' || lang end, case when contains(text, '|') then 'table' end,
case when contains(text, '!!') then 'shouting' end], lambda x: x is not null)) as reason from documents) group by 1 order by n desc, reason limit 20""")
def q21_reason_counts(spark, sf_dir):
    """The most frequent reason codes."""
    docs = table(spark, sf_dir, "documents")
    why = F.array_compact(
        F.array(
            F.when(F.col("text").isNull() | (F.col("text") == ""), "empty"),
            F.when(F.col("n_chars") < 200, "short"),
            F.when(F.col("n_chars") > 8000, "long"),
            F.when(F.col("lang") != "en", F.concat(F.lit("lang_"), "lang")),
            F.when(F.col("text").contains("|"), "table"),
            F.when(F.col("text").contains("!!"), "shouting"),
        )
    )
    return ledger.reason_counts(docs.select(why.alias("reasons")), "reasons", 20)


@query("""select source, case when bool_or(coalesce(toxic = 1, false)) then 'reject_corrupt' when bool_or(n_chars > 20000) then 'reject_dependencies'
when bool_or(quality is null) then 'incomplete' when bool_or(quality = 0) then 'accept_with_warnings' else 'accept' end as decision
from (select source || '-' || (documents.doc_id // 50) as source, n_chars, quality, toxic from documents left join labels using (doc_id)) group by 1""")
def q22_decision_precedence(spark, sf_dir):
    """The strongest finding decides."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50)).alias("source"), "n_chars"
    )
    found = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "source",
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("corrupt"),
        (F.col("n_chars") > 20000).alias("missing"),
        F.col("quality").isNull().alias("incomplete"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("warning"),
    )
    return found.groupBy("source").agg(ledger.precedence().alias("decision"))


@query("""select r_name, sum(case when asserted is null or n_nationkey is null then 1 else 0 end) as unobserved, sum(case when asserted = n_nationkey then 1 else 0 end) as matches,
sum(case when asserted <> n_nationkey then 1 else 0 end) as conflicts from (select n_nationkey, r_name, case when c_custkey % 7 <> 0 then c_nationkey + case when c_custkey % 11 = 0 then 1 else 0 end end as asserted
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) group by 1""")
def q23_hints(spark, sf_dir):
    """Asserted against observed values."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asserted = F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") + (F.col("c_custkey") % 11 == 0).cast("int"))
    told = rows.select("r_name", ledger.hint(asserted, F.col("n_nationkey")).alias("hint"))
    n = lambda h: F.sum((F.col("hint") == h).cast("bigint")).alias(h)
    return told.groupBy("r_name").agg(n("unobserved"), n("matches"), n("conflicts"))


@query("""select coalesce(declared, supplied) as name, case when declared is null then 'unused' when supplied is null then 'missing' else 'present' end as status
from (select distinct o_custkey as declared from orders where o_custkey % 3 <> 0) full join (select c_custkey as supplied from customer where c_custkey % 5 <> 0) on declared = supplied""")
def q23_manifest(spark, sf_dir):
    """Declared dependencies against a manifest."""
    declared = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("declared")).distinct()
    supplied = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("supplied"))
    both = declared.join(supplied, F.col("declared") == F.col("supplied"), "full")
    status = F.when(F.col("declared").isNull(), "unused").when(F.col("supplied").isNull(), "missing").otherwise("present")
    return both.select(F.coalesce("declared", "supplied").alias("name"), status.alias("status"))


_LINKS_SQL = """select 'r' || n_regionkey as source, 'n' || n_nationkey as target from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer
union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select 'n' || n_nationkey, 'r' || n_regionkey from nation where n_nationkey % 4 = 0"""


def _links(spark, sf_dir) -> DataFrame:
    link = lambda t, a, x, b, y: table(spark, sf_dir, t).select(
        F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target")
    )
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0")
    back = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return (
        link("nation", "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(link("customer", "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(link("orders", "c", "o_custkey", "o", "o_orderkey"))
        .unionByName(back)
    )


@query(f"""with recursive links as ({_LINKS_SQL}), walk as (select 'r' || r_regionkey as node, 0 as depth from region where r_regionkey < 3
union select target, depth + 1 from walk join links on node = source where depth < 6) select node, min(depth) as depth from walk group by 1""")
def q24_reachability(spark, sf_dir):
    """Nodes that links reach from the roots, with cycles."""
    roots = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.reachable(_links(spark, sf_dir), roots)


@query("""select c_custkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment, cast(floor(c_acctbal / 500) as bigint)) as "primary",
c_custkey <> min(c_custkey) over (partition by c_nationkey, c_mktsegment, cast(floor(c_acctbal / 500) as bigint)) as alias from customer""")
def q24_aliases(spark, sf_dir):
    """One primary path of each identity; the others are aliases."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500).alias("level"))
    return graph.primary(rows, ["c_nationkey", "c_mktsegment", "level"], "c_custkey").select("c_custkey", "primary", "alias")


@query("select o_custkey, count(*) as observed, any_value(o_custkey % 12) as declared from orders group by 1 having count(*) > o_custkey % 12")
def q25_link_counts(spark, sf_dir):
    """Objects with more links than declared."""
    links = table(spark, sf_dir, "orders").select("o_custkey")
    declared = links.distinct().withColumn("declared", F.col("o_custkey") % 12)
    return graph.over_linked(links, declared, "o_custkey", "declared")


@query("""select l_partkey, case when p_partkey is null then 4 else 1 end as status, count(*) as n from lineitem left join (select p_partkey from part where p_partkey % 10 <> 0) on l_partkey = p_partkey group by 1, 2""")
def q26_deferred_references(spark, sf_dir):
    """References without a target get status 4."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    found = graph.resolve(table(spark, sf_dir, "lineitem").select("l_partkey"), parts, ["l_partkey"])
    return found.groupBy("l_partkey", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with e as ({_EXTENT_SQL}), d as (select source, start, count(*) as n from e group by all),
r as (select e.*, max(e.stop) over (partition by e.source order by e.start, e.l_orderkey, e.l_linenumber rows between unbounded preceding and 1 preceding) > e.start as overlap,
n > 1 as duplicate, l_orderkey % 17 = 0 as failed, e.stop - e.start < 3 as short from e join d on e.source = d.source and e.start = d.start),
t as (select *, case when not (coalesce(overlap, false) or duplicate or failed or short) then 'accepted' when coalesce(overlap, false) or duplicate then 'contradicted' else 'unassigned' end as decision from r)
select l_orderkey, l_linenumber, decision, array_to_string(list_sort(list_filter([case when duplicate then 'duplicate_coordinate' end, case when coalesce(overlap, false) then 'overlap' end, case when failed then 'required_check' end, case when short then 'length' end], lambda x: x is not null)), ',') as reasons from t""")
def q27_reconcile(spark, sf_dir):
    """Every proposal with its reasons and the decision that follows from them."""
    rows = _extents(spark, sf_dir)
    order = Window.partitionBy("source").orderBy("start", "l_orderkey", "l_linenumber")
    same = Window.partitionBy("source", "start")
    told = rows.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "copies", F.count(F.lit(1)).over(same)
    )
    why = ledger.reasons(
        overlap=F.col("reach") > F.col("start"),
        duplicate_coordinate=F.col("copies") > 1,
        required_check=F.col("l_orderkey") % 17 == 0,
        length=F.col("stop") - F.col("start") < 3,
    )
    told = told.withColumn("why", why)
    return told.select("l_orderkey", "l_linenumber", ledger.decide(F.col("why")).alias("decision"), F.array_join("why", ",").alias("reasons"))


@query("""with v as (select n_regionkey, n_nationkey as virtual_point, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation),
s as (select c_nationkey % 5 as region, c_custkey as source_point, row_number() over (partition by c_nationkey % 5 order by c_custkey) as k from customer where c_custkey % 97 = 0)
select n_regionkey, virtual_point, source_point, case when source_point is null then 0 else 1 end as status from v left join s on region = n_regionkey and s.k = v.k""")
def q28_positional_pairs(spark, sf_dir):
    """The k-th virtual point takes the k-th source point; a missing one stays unknown. Every 97th customer is a source, as in
    the SQL; q54_all_positional_pairs takes all."""
    return _positional_pairs(spark, sf_dir, table(spark, sf_dir, "customer").where("c_custkey % 97 = 0"))


def _positional_pairs(spark, sf_dir, customers: DataFrame) -> DataFrame:
    at = lambda by, key: F.row_number().over(Window.partitionBy(by).orderBy(key))
    virtual = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("virtual_point"))
    most = max((r["count"] for r in virtual.groupBy("n_regionkey").count().collect()), default=0)  # a row a region
    virtual = virtual.withColumn("k", at("n_regionkey", "virtual_point"))
    source = customers.select((F.col("c_nationkey") % 5).alias("n_regionkey"), F.col("c_custkey").alias("source_point"))
    # later points have no partner; the bound lets every task drop them before the shuffle
    source = source.withColumn("k", at("n_regionkey", "source_point")).where(F.col("k") <= most)
    return virtual.join(source, ["n_regionkey", "k"], "left").select(
        "n_regionkey", "virtual_point", "source_point", F.when(F.col("source_point").isNull(), 0).otherwise(1).alias("status")
    )


@query()
def q54_all_positional_pairs(spark, sf_dir):
    """q28_positional_pairs with every customer as a source."""
    return _positional_pairs(spark, sf_dir, table(spark, sf_dir, "customer"))


@query(f"""select member, count(*) as parts, cast(sum(least(stop, (member + 1) * 1000) - greatest(start, member * 1000)) as bigint) as bytes
from (select start, stop, unnest(range(start // 1000, (stop - 1) // 1000 + 1)) as member from (select start, start + (stop - start) * 40 as stop from ({_EXTENT_SQL}))) group by 1""")
def q29_member_addresses(spark, sf_dir):
    """Extents cut at the borders of a family's members."""
    wide = _extents(spark, sf_dir).withColumn("stop", F.col("start") + (F.col("stop") - F.col("start")) * 40)
    parts = intervals.split_members(wide.select("start", "stop"), 1000)
    return parts.groupBy("member").agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("bytes"))


@query("""with e as (select o_orderkey, o_orderkey * 16 as start, o_orderkey * 16 + 16 as stop from orders), p as (select o_orderkey, unnest(range(start // 40, (stop - 1) // 40 + 1)) as segment from e)
select o_orderkey, bool_and(segment % 3 <> 0 and segment % 40 <> 7) as valid from p group by 1""")
def q30_wholly_present(spark, sf_dir):
    """An element counts only if all its bytes are there."""
    at = F.col("o_orderkey") * 16
    elements = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("start"), (at + 16).alias("stop"))
    top = intervals.split_members(elements, 40).select(F.col("member").alias("segment")).distinct()
    return intervals.wholly_present(elements, top.where("segment % 3 <> 0 and segment % 40 <> 7"), ["o_orderkey"], 40)


#: Markers that the signature query looks for.
MARKERS = ("<title", "<p>", "</p>", "<div", "<!--", "href=")


@query(
    " union all ".join(
        f"select page_id, '{m}' as signature, (length(html) - length(replace(html, '{m}', ''))) // {len(m)} as n, instr(html, '{m}') - 1 as first_offset from pages where contains(html, '{m}')"
        for m in MARKERS
    )
)
def q31_signatures(spark, sf_dir):
    """Occurrences and first offsets of signatures; one pass over the texts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = F.array(
        *[
            F.struct(
                F.lit(m).alias("signature"),
                F.floor((F.length("html") - F.length(F.replace("html", F.lit(m), F.lit("")))) / len(m)).alias("n"),
                (F.instr("html", m) - 1).cast("bigint").alias("first_offset"),
            )
            for m in MARKERS
        ]
    )
    return pages.select("page_id", F.explode(found).alias("m")).where("m.n > 0").select("page_id", "m.*")


@query("""select 'only_first' as side, k as key from (select c_custkey as k from customer where c_custkey % 9 <> 0 except all select o_custkey from (select distinct o_custkey from orders))
union all select 'only_second', k from (select distinct o_custkey as k from orders except all select c_custkey from customer where c_custkey % 9 <> 0)""")
def q32_set_difference(spark, sf_dir):
    """What either of two key sets has alone; both empty means equal."""
    first = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("key"))
    second = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    left = first.exceptAll(second).select(F.lit("only_first").alias("side"), "key")
    return left.unionByName(second.exceptAll(first).select(F.lit("only_second").alias("side"), "key"))


@query("""select chunk, count(*) as changed, array_to_string(list_slice(list(offset_ order by offset_), 1, 8), ',') as first_offsets
from (select l_orderkey // 1024 as chunk, l_orderkey * 8 + l_linenumber as offset_ from lineitem where l_orderkey % 97 = 0) group by 1""")
def q33_changed_positions(spark, sf_dir):
    """Changed positions of two versions, their number and the first eight."""
    rows = table(spark, sf_dir, "lineitem").select(
        grid.chunk_of("l_orderkey", 1024).alias("chunk"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"),
        F.col("l_partkey").alias("before"),
        (F.col("l_partkey") + (F.col("l_orderkey") % 97 == 0).cast("int")).alias("after"),
    )
    changed = rows.where(~F.col("before").eqNullSafe(F.col("after"))).select("chunk", "at")
    counts = changed.groupBy("chunk").agg(F.count(F.lit(1)).alias("changed"))
    # the rank limit is applied before the shuffle, too, so that no chunk's positions are gathered
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy("at"))
    few = changed.withColumn("nth", nth).where("nth <= 8").groupBy("chunk").agg(F.array_sort(F.collect_list("at")).alias("first"))
    return counts.join(few, "chunk").select("chunk", "changed", F.array_join("first", ",").alias("first_offsets"))


@query("""with r as (select o_orderkey % 8 as part, count(*) as n, sum(o_custkey) as keys from orders group by 1),
l as (select l_orderkey % 8 as part, count(distinct l_orderkey) as n, sum(l_linenumber) as lines from lineitem group by 1)
select part, 'orders' as "check", r.n as reported, l.n as recomputed, r.n = l.n as passed from r join l using (part)
union all select part, 'lines', 4 * r.n, cast(lines as bigint), 4 * r.n = lines from r join l using (part)""")
def q34_totals(spark, sf_dir):
    """Reported totals against recomputed ones, a row for each check."""
    reported = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 8).alias("part")).agg(F.count(F.lit(1)).alias("reported"))
    seen = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("part")).agg(
        F.count_distinct("l_orderkey").alias("orders"), F.sum("l_linenumber").cast("bigint").alias("lines")
    )
    checks = F.array(
        F.struct(F.lit("orders").alias("check"), F.col("reported").alias("r"), F.col("orders").alias("recomputed")),
        F.struct(F.lit("lines").alias("check"), (F.col("reported") * 4).alias("r"), F.col("lines").alias("recomputed")),
    )
    rows = reported.join(seen, "part").select("part", F.explode(checks).alias("c"))
    return rows.select("part", "c.check", F.col("c.r").alias("reported"), "c.recomputed", (F.col("c.r") == F.col("c.recomputed")).alias("passed"))


@query("select distinct l_orderkey // 256 as unit from lineitem where l_orderkey // 256 not in (select distinct o_orderkey // 256 from orders where o_orderkey // 256 % 3 = 0)")
def q35_resume(spark, sf_dir):
    """Units that remain when the committed ones are taken out."""
    units = table(spark, sf_dir, "lineitem").select(grid.chunk_of("l_orderkey", 256).alias("unit")).distinct()
    done = table(spark, sf_dir, "orders").select(grid.chunk_of("o_orderkey", 256).alias("unit")).where("unit % 3 = 0").distinct()
    return units.join(done, "unit", "left_anti")


@query(f"""with was as ({_DIGEST_SQL}) select w.chunk, case when w.chunk % 6 = 0 then 0 when w.chunk % 4 = 0 then 0 else 1 end as status,
case when w.chunk % 6 = 0 then 'no_capture' when w.chunk % 4 = 0 then 'changed' else 'prior_capture' end as history from was w""")
def q36_history(spark, sf_dir):
    """A value counts as historical only where a prior capture matches."""
    was = _digests(spark, sf_dir)
    prior = was.where("chunk % 6 <> 0").withColumn("digest", F.when(F.col("chunk") % 4 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    found = capture.compare_baseline(was.select("chunk"), was, prior, ["chunk"])
    history = F.when(F.col("was").isNull(), "no_capture").when(F.col("status") == capture.ACCEPTED, "prior_capture").otherwise("changed")
    return found.select("chunk", F.when(history == "prior_capture", 1).otherwise(0).alias("status"), history.alias("history"))


def _gf_sql(value: str, factor: int) -> str:
    out, power = [], value
    while factor:
        if factor & 1:
            out.append(power)
        factor >>= 1
        power = f"(case when ({power}) * 2 > 255 then xor(({power}) * 2, 285) else ({power}) * 2 end)"
    sql = out[0]
    for x in out[1:]:
        sql = f"xor({sql}, {x})"
    return sql


@query(
    "select l_orderkey // 512 as stripe, "
    + ", ".join(
        "bit_xor(case "
        + " ".join(f"when l_orderkey // 64 % 8 = {i} then {_gf_sql('l_partkey % 256', f)}" for i, f in enumerate(fs))
        + f" end) as p{j}"
        for j, fs in enumerate(((1,) * 8, tuple(range(1, 9))))
    )
    + " from lineitem group by 1"
)
def q37_gf256_parity(spark, sf_dir):
    """Two parity rows over GF(256); row j weighs member i by (i + 1)^j."""
    rows = table(spark, sf_dir, "lineitem").select(
        grid.chunk_of("l_orderkey", 512).alias("stripe"),
        (grid.chunk_of("l_orderkey", 64) % 8).alias("member"),
        (F.col("l_partkey") % 256).cast("int").alias("byte"),
    )
    weighed = F.coalesce(*[F.when(F.col("member") == i, capture.gf_times(F.col("byte"), i + 1)) for i in range(8)])
    return rows.groupBy("stripe").agg(
        F.bit_xor(F.col("byte").cast("bigint")).alias("p0"), F.bit_xor(weighed.cast("bigint")).alias("p1")
    )

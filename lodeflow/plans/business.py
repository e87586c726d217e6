"""Queries over the star schema and the event stream: graphs, windows, lookups and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodeflow.operators import flows, graphs, tables, text
from lodeflow.session import table
from lodeflow.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLE[func.__name__] = sql
        return func

    return register


# Goods go from suppliers (odd nodes) to customers (even nodes), returned ones back. All line items are edges.
_SOLD = "select l_suppkey * 2 + 1 as s, o_custkey * 2 as c, l_returnflag = 'R' as back from lineitem join orders on l_orderkey = o_orderkey"
_EDGES = f"(select distinct s as src, c as dst from ({_SOLD}) union select distinct c, s from ({_SOLD}) where back)"
_NODES = "(select s_suppkey * 2 + 1 as node from supplier union all select c_custkey * 2 from customer)"
_NATION = "(select s_suppkey * 2 + 1 as node from supplier where s_nationkey = 7)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of goods between suppliers and customers; all line items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 2 + 1).alias("s"), (F.col("l_returnflag") == "R").alias("back"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 2).alias("c"))
    sold = items.join(orders, "l_orderkey").groupBy("s", "c").agg(F.max("back").alias("back"))
    there, again = F.struct(F.col("s").alias("src"), F.col("c").alias("dst")), F.struct(F.col("c").alias("src"), F.col("s").alias("dst"))
    return sold.select(F.explode(F.when(F.col("back"), F.array(there, again)).otherwise(F.array(there))).alias("e")).select("e.src", "e.dst")


def traders(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return suppliers.unionByName(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node")))


def of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated starts of searches: the suppliers of a nation."""
    return table(spark, sf_dir, "supplier").where("s_nationkey = 7").select((F.col("s_suppkey") * 2 + 1).alias("node"))


@_query(
    f"with e as materialized {_EDGES}, o as (select src, count(*) as n from e group by 1), i as (select dst, count(*) as n from e group by 1) "
    f"select node, coalesce(o.n, 0)::BIGINT as out_degree, coalesce(i.n, 0)::BIGINT as in_degree from {_NODES} left join o on src = node left join i on dst = node"
)
def trade_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out- and in-degrees of all suppliers and customers."""
    return graphs.degrees(traders(spark, sf_dir), trade(spark, sf_dir))


@_query(f"with e as materialized {_EDGES} select node from {_NODES} where node not in (select src from e) and node not in (select dst from e)")
def trade_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers without any trade."""
    return graphs.orphans(traders(spark, sf_dir), trade(spark, sf_dir))


def _rank_sql(rounds: int) -> str:
    steps = [f"e as materialized {_EDGES}", f"v as materialized {_NODES}", "o as materialized (select src, count(*) as n from e group by 1)", "r0 as materialized (select node, 1.0::DOUBLE / (select count(*) from v) as score from v)"]
    for i in range(rounds):
        steps.append(f"g{i} as materialized (select e.dst as node, sum(q.score / o.n) as got from e join r{i} q on q.node = e.src join o on o.src = e.src group by 1)")
        steps.append(
            f"r{i + 1} as materialized (select r.node, (0.15::DOUBLE + 0.85::DOUBLE * (select coalesce(sum(score), 0) from r{i} where node not in (select src from o))) / (select count(*) from v)"
            f" + 0.85::DOUBLE * coalesce(g.got, 0) as score from r{i} r left join g{i} g on g.node = r.node)"
        )
    return "with " + ", ".join(steps)


@_query(_rank_sql(10) + " select node, round(score, 9) as score from r10")
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of page rank on the goods graph."""
    ranks = graphs.pagerank(traders(spark, sf_dir), trade(spark, sf_dir), 10)
    return ranks.select("node", F.round("score", 9).alias("score"))


@_query(_rank_sql(10) + " select node, round((score - (select min(score) from r10)) / ((select max(score) from r10) - (select min(score) from r10)), 5) as score from r10")
def pagerank_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks scaled to [0, 1]."""
    ranks = graphs.pagerank(traders(spark, sf_dir), trade(spark, sf_dir), 10)
    return graphs.min_max(ranks, "score").select("node", F.round("score", 5).alias("score"))


@_query(f"with e as materialized {_EDGES}, a as (select src, dst from e where src in {_NATION}), b as (select a.src, e.dst from a join e on e.src = a.dst) select src, dst from a union select src, dst from b")
def trade_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goods of the suppliers of a nation reach in two steps: customers, and suppliers that these return goods to."""
    return graphs.closure(trade(spark, sf_dir), 2, of_nation(spark, sf_dir))


@_query(f"select distinct unnest([s, c]) as node from ({_SOLD}) where back")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers between whom goods go round: who has a returned item, as each was sold before."""
    return graphs.cycle_nodes(trade(spark, sf_dir))


@_query(f"with l as (select s_suppkey * 2 + 1 as node from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1) select distinct src as node from {_EDGES} e where dst in (select node from l) and src not in (select node from l)")
def propagate_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that returned goods to a supplier of a region."""
    region = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    labelled = table(spark, sf_dir, "supplier").join(region, "s_nationkey").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return graphs.propagate(labelled, trade(spark, sf_dir))


@_query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def without_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order (anti join)."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@_query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) where rn <= 3")
def topk_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three richest suppliers of each nation."""
    return tables.top_k_per(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], 3, F.desc("s_acctbal"), "s_suppkey")


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders by price."""
    return tables.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 50, F.desc("o_totalprice"), "o_orderkey")


_RULES = (("(small|tiny)", 0.4), ("red|blue", 0.6), ("widget$", 0.8), ("^large", 0.9))


@_query("select p_partkey, round(greatest(0.0::DOUBLE, " + ", ".join(f"case when regexp_matches(p_name, '{p}') then {s}::DOUBLE else 0.0::DOUBLE end" for p, s in _RULES) + "), 6) as score from part")
def pattern_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule that each part name matches."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.best_pattern(F.col("p_name"), list(_RULES)), 6).alias("score"))


@_query(
    "select l_returnflag, l_linestatus, count(*)::BIGINT as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, grouping(l_returnflag, l_linestatus)::BIGINT as level from lineitem group by rollup (l_returnflag, l_linestatus)"
)
def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and revenue by flag and status, with subtotals."""
    items = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return items.agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping_id().cast("bigint").alias("level")
    )


@_query("select event_type, (try_cast(json_extract_string(props, '$.k') as INT) // 10)::INT as decile, count(*)::BIGINT as n from events group by 1, 2")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and the tens of a JSON field."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 10).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@_query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(*)::BIGINT as n, round(sum(value), 2) as total from events group by 1, 2")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type (tumbling windows; an extension)."""
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "1 day").withColumn("total", F.round("total", 2))


@_query(
    "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as no from g) "
    "select user_id, min(ts) as session_start, max(ts) as last_event, count(*)::BIGINT as n from s group by user_id, no"
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps below six hours (an extension)."""
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


_PHASES = {"signup": (0.0, 0.1), "view": (0.1, 0.3), "click": (0.3, 0.7), "purchase": (0.7, 1.0)}


@_query(
    "select event_id, round(case event_type "
    + " ".join(f"when '{k}' then {lo}::DOUBLE + ((event_id % 100) / 100.0::DOUBLE) * ({hi}::DOUBLE - {lo}::DOUBLE)" for k, (lo, hi) in _PHASES.items())
    + " else 0.0::DOUBLE end, 6) as progress from events"
)
def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress over weighted phases, piecewise linear."""
    inner = (F.col("event_id") % 100) / F.lit(100.0)
    out = F.lit(0.0)
    for name, (lo, hi) in _PHASES.items():
        out = F.when(F.col("event_type") == name, F.lit(lo) + inner * (F.lit(hi) - F.lit(lo))).otherwise(out)
    return table(spark, sf_dir, "events").select("event_id", F.round(out, 6).alias("progress"))


@_query(
    "select event_id, user_id, (select max(p.event_id) from events p where p.user_id = e.user_id and p.event_type = 'view' and p.event_id < e.event_id) as last_view from events e where event_type = 'purchase'"
)
def last_view_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase of the same user: an as-of lookup by a window, not by a join (an extension)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "user_id", "event_type", seen.alias("last_view")).where("event_type = 'purchase'").drop("event_type")


@_query("select p_brand, p_type, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as rn from part) where rn = 1")
def keep_first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part of each brand and type."""
    return flows.keep_first(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice"), ["p_brand", "p_type"], [F.desc("p_retailprice"), "p_partkey"])


_HOPS = "{0}1 as (select distinct src as start, dst as node from e where src in " + _NATION + " and {1}), {0}2 as (select distinct start, dst as node from {0}1 join e on src = node where {1})"
_FREE = "dst % 5 <> 0"


@_query(
    f"with e as materialized {_EDGES}, {_HOPS.format('a', _FREE)}, x as (select start, node, 1 as hops from a1 union all select start, node, 2 from a2) select start, node, min(hops)::INT as hops from x group by 1, 2"
)
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers of a nation reach in two hops that avoid blocked nodes."""
    return graphs.reachable(of_nation(spark, sf_dir), trade(spark, sf_dir), 2, traders(spark, sf_dir).where("node % 5 = 0"))


@_query(
    f"with e as materialized {_EDGES}, {_HOPS.format('a', 'true')}, {_HOPS.format('b', _FREE)}, a as (select * from a1 union select * from a2), b as (select * from b1 union select * from b2) "
    "select start, node, not exists (select 1 from b where b.start = a.start and b.node = a.node) as is_sanitized from a where node % 3 = 1"
)
def sanitized_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all ways of two hops from the suppliers of a nation pass a blocked node."""
    n = traders(spark, sf_dir)
    return graphs.sanitized_paths(of_nation(spark, sf_dir), n.where("node % 3 = 1"), trade(spark, sf_dir), n.where("node % 5 = 0"), 2)

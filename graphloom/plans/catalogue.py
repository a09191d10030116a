"""The registered queries over the tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.runtime import new_folder
from graphloom.operators import clustering, connectivity, covering, paths, patterns, primitives, ranking
from graphloom.sources import files
from graphloom.sources import graphs as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Shared pieces of SQL: the canonical graphs, s being both directions.
PART = """po as (select distinct l_orderkey o, l_partkey p from lineitem),
und as (select x.p a, y.p b, count(*) w from po x join po y on x.o = y.o and x.p < y.p group by 1, 2 having count(*) >= 2),
s as (select a, b, w from und union all select b, a, w from und),
src as (select a v from s group by a order by count(*) desc, a limit 1)"""
FLOW = """bought as (select user_id u, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) v from events where event_type = 'purchase'),
e as (select u a, v b, count(*) w from bought where v is not null and u <> v group by 1, 2)"""
SYM = FLOW + """,
und as (select a, b, min(w) w from (select least(a, b) a, greatest(a, b) b, w from e) group by 1, 2),
s as (select a, b, w from und union all select b, a, w from und),
src as (select a v from s group by a order by count(*) desc, a limit 1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parts(spark: SparkSession, sf_dir: str) -> Graph:
    return sources.part_graph(spark, sf_dir).store()


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    return sources.user_flow(spark, sf_dir).store()


def friends(spark: SparkSession, sf_dir: str) -> Graph:
    return sources.user_flow(spark, sf_dir).symmetrised().store()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- graphs, primitives, aggregates


@query(f"with {PART} select a as src, b as dst, w from und")
def part_pairs(spark, sf_dir):
    return sources.part_graph(spark, sf_dir).und()


@query(f"with {PART} select p_partkey as id, coalesce(n, 0) as degree from part left join (select a, count(*) n from s group by a) on a = p_partkey")
def part_degrees(spark, sf_dir):
    return sources.part_graph(spark, sf_dir, isolated=True).degrees()


@query(f"with {PART} select a as id, count(*) as degree from s group by a order by 2 desc, 1 limit 20")
def top_parts(spark, sf_dir):
    return sources.part_graph(spark, sf_dir).degrees().orderBy(F.col("degree").desc(), "id").limit(20)


@query(f"with {FLOW} select a as src, b as dst, w from e")
def user_flow_edges(spark, sf_dir):
    return sources.user_flow(spark, sf_dir).edges


@query("select o_custkey as src, l_suppkey + 1000000000 as dst, count(*) as w from orders join lineitem on o_orderkey = l_orderkey group by 1, 2")
def customer_supplier_edges(spark, sf_dir):
    return sources.customer_supplier(spark, sf_dir).und()


@query(f"with {FLOW} select b as src, a as dst, w from e")
def transpose(spark, sf_dir):
    return sources.user_flow(spark, sf_dir).transpose().edges


@query(f"with {SYM} select a as src, b as dst, w from und")
def undirect(spark, sf_dir):
    return sources.user_flow(spark, sf_dir).symmetrised().und()


@query(f"with {FLOW} select a as src, b as dst, w from e where (a + b) % 3 = 0 and a < b")
def filter_graph(spark, sf_dir):
    return sources.user_flow(spark, sf_dir).filter_edges(lambda s, d, w: ((s + d) % 3 == 0) & (s < d)).edges


@query(f"with {FLOW} select 'kept' as part, count(*) as n from e where (a + b) % 3 = 0 union all select 'extracted', count(*) from e where (a + b) % 3 = 2")
def split_edges(spark, sf_dir):
    kept, out = flow(spark, sf_dir).split_edges(lambda s, d, w: (s + d) % 3)
    return kept.edges.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).union(out.agg(F.lit("extracted"), F.count("*")))


@query(f"with {FLOW}, v as (select a id from e union select b from e) select id, count(x.a) as degree from v left join e x on x.a = id and x.w >= 2 group by id")
def pack_edges(spark, sf_dir):
    return flow(spark, sf_dir).pack(lambda s, d, w: w >= 2)[1]


@query(f"with {FLOW} select a as id, count(*) filter (where b % 2 = 0) as value from e where a % 5 = 0 group by a")
def src_count(spark, sf_dir):
    g = flow(spark, sf_dir)
    return primitives.src_count(g, g.edges.select(F.col("src").alias("id")).distinct().where("id % 5 = 0"), F.col("dst") % 2 == 0)


@query(f"with {FLOW} select b as id, min(a) as value from e where a % 10 = 0 and b % 10 <> 0 group by b")
def edge_map(spark, sf_dir):
    g = flow(spark, sf_dir)
    front = g.vertices.where("id % 10 = 0").select("id")
    return primitives.edge_map(g, front, seen=front)


@query(f"with {FLOW} select a as id, sum(w * b) as value from e where b % 10 = 0 group by a")
def edge_map_reduce(spark, sf_dir):
    g = flow(spark, sf_dir)
    return primitives.edge_map(g, g.vertices.where("id % 10 = 0").select("id"), F.col("w") * F.col("dst"), F.sum, direction="in")


@query(f"with {FLOW} select b as id, count(*) as value from e where a % 10 = 0 group by b")
def edge_map_count(spark, sf_dir):
    g = flow(spark, sf_dir)
    return primitives.edge_map_count(g, g.vertices.where("id % 10 = 0").select("id"))


@query(f"with {FLOW} select b as id from e where a % 10 = 0")
def edge_map_induced(spark, sf_dir):
    g = flow(spark, sf_dir)
    return primitives.edge_map_induced(g, g.vertices.where("id % 10 = 0").select("id"))


@query(f"with {FLOW} select count(*) as edges, cast(sum(w) as bigint) as total, max(w) as most from e")
def reduce_edges(spark, sf_dir):
    return primitives.reduce_edges(sources.user_flow(spark, sf_dir), edges=F.count("*"), total=F.sum("w"), most=F.max("w"))


@query(f"with {FLOW} select a as id, b as neighbour from (select a, b, row_number() over (partition by a order by b) r from e) where r = 3")
def ith_neighbour(spark, sf_dir):
    return primitives.ith_neighbour(sources.user_flow(spark, sf_dir), 2)


@query(f"with {PART} select u.a as src, u.b as dst, count(y.b) as common from und u left join s x on x.a = u.a left join s y on y.a = u.b and y.b = x.b group by 1, 2")
def common_neighbours(spark, sf_dir):
    g = parts(spark, sf_dir)
    return primitives.common_neighbours(g, g.und())


@query(f"with {FLOW} select degree, count(*) as n from (select a, count(*) degree from e group by a) group by degree")
def degree_histogram(spark, sf_dir):
    return primitives.histogram(sources.user_flow(spark, sf_dir).degrees().where("degree > 0"), "degree")


@query(f"with {PART}, d as (select a id, count(*) n from s group by a) select id, row_number() over (order by n, id) - 1 as new from d")
def degree_order(spark, sf_dir):
    return primitives.degree_order(parts(spark, sf_dir))


@query(f"with {FLOW}, c as (select distinct a % 7 x, b % 7 y from e where a % 7 <> b % 7 and a % 7 <> 3 and b % 7 <> 3), k as (select x from c union select y from c), r as (select x, row_number() over (order by x) - 1 n from k) select p.n as src, q.n as dst from c join r p on p.x = c.x join r q on q.x = c.y")
def contract(spark, sf_dir):
    g = flow(spark, sf_dir).filter_edges(lambda s, d, w: (s % 7 != 3) & (d % 7 != 3))
    return primitives.contract(g, g.vertices.select("id", (F.col("id") % 7).alias("cluster")))[0].edges.select("src", "dst")


@query(f"with {FLOW}, d as (select id, count(e.a) n from (select a id from e union select b from e) left join e on e.a = id group by id) select count(*) as vertices, cast(sum(n) as bigint) as edges, count(*) filter (where n = 0) as isolated, min(n) as least_degree, round(avg(n), 6) as mean_degree, max(n) as greatest_degree, (select min(w) from e) as least_w, (select round(avg(w), 6) from e) as mean_w, (select max(w) from e) as greatest_w from d")
def graph_summary(spark, sf_dir):
    return rounded(files.summary(flow(spark, sf_dir)), "mean_degree", "mean_w")


@query(f"with {PART}, v as (select a, row_number() over (order by a) - 1 n from (select distinct a from s)) select x.n as src, y.n as dst, w from s join v x on x.a = s.a join v y on y.a = s.b")
def clean_graph(spark, sf_dir):
    return files.cleaned(parts(spark, sf_dir)).edges


# --- paths

BFS = """r(v, d) using key (v) as (
  select v, 0 from src union
  select s.b, min(r.d) + 1 from r join s on s.a = r.v left join recurring.r o on o.v = s.b where o.v is null group by s.b)"""


@query(f"with recursive {PART}, {BFS} select v as id, d as dist from r")
def bfs_distance(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.bfs_distance(g, g.hub())


@query(f"with recursive {PART}, {BFS} select v as id, d as dist from r where d <= 3")
def bfs_distance_capped(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.bfs_distance(g, g.hub(), cap=3)


@query(f"with recursive {PART}, {BFS} select x.v as id, coalesce(min(y.v), x.v) as parent from r x left join s on s.b = x.v left join r y on y.v = s.a and y.d = x.d - 1 group by x.v")
def bfs_parent(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.bfs(g, g.hub())


@query(f"with recursive {PART}, {BFS.replace('select v, 0 from src', 'select distinct a, 0 from s where a % 100 = 0')} select v as id, d as dist from r")
def bfs_multi_source(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.bfs_distance(g, g.vertices.where("id % 100 = 0").select("id"))


SSSP = """r(v, d) using key (v) as (
  select v, 0::bigint from src union
  select s.b, min(r.d + s.w) from r join s on s.a = r.v left join recurring.r o on o.v = s.b group by s.b, o.d having o.d is null or min(r.d + s.w) < o.d)"""


@query(f"with recursive {PART}, {SSSP} select v as id, d as dist from r")
def sssp(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.sssp(g, g.hub())


@query(f"with recursive {PART}, {SSSP} select v as id, d as dist from r")
def sssp_delta_stepping(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.sssp(g, g.hub(), delta=4)


@query(f"with recursive {PART}, {SSSP} select v as id, d as dist from r where d <= 9")
def sssp_capped(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.sssp(g, g.hub(), cap=9)


@query(f"with recursive {PART}, {SSSP.replace('select v, 0::bigint from src', 'select distinct a, 0::bigint from s where a % 100 = 0')} select v as id, d as dist from r")
def sssp_multi_source(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.sssp(g, g.vertices.where("id % 100 = 0").select("id", F.lit(0).cast("long").alias("dist")))


@query(f"with recursive {PART}, {SSSP.replace('select v, 0::bigint from src', 'select distinct a, case when v = a then 0 else 1 end::bigint from s, src where a % 100 = 0 or a = v')} select v as id, d as dist from r")
def sssp_repair(spark, sf_dir):
    g = parts(spark, sf_dir)
    before = paths.sssp(g, g.hub())
    return paths.repair(g, before, g.vertices.where("id % 100 = 0").select("id", F.lit(1).cast("long").alias("dist")))[0]


@query(f"with recursive {PART.replace('s as (select a, b, w from und union all select b, a, w from und)', 's as (select a, b, w from (select a, b, w from und union all select 1, 500, 1 where exists (select 1 from und where a = 1 or b = 1) and exists (select 1 from und where a = 500 or b = 500)) union all select b, a, w from (select a, b, w from und union all select 1, 500, 1 where exists (select 1 from und where a = 1 or b = 1) and exists (select 1 from und where a = 500 or b = 500)))').replace('src as (select a v from s', 'src as (select a v from (select a from und union all select b from und)')}, {SSSP} select v as id, d as dist from r")
def sssp_dynamic(spark, sf_dir):
    g = parts(spark, sf_dir)
    state = paths.DynamicPaths(g, g.hub())
    ends = g.vertices.where("id in (1, 500)").agg(F.count("*").alias("n"))
    state.insert(ends.where("n = 2").select(F.lit(1).cast("long").alias("src"), F.lit(500).cast("long").alias("dst"), F.lit(1).cast("long").alias("w")))
    return state.state


@query(f"with recursive {PART}, {SSSP}, p as (select x.v from r x) select s.a as src, s.b as dst from s join r x on x.v = s.a join r y on y.v = s.b where x.d + s.w = y.d")
def shortest_path_support(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.DynamicPaths(g, g.hub()).support().select("src", "dst")


@query(f"""with recursive {PART}, r(v, d) using key (v) as (
  select v, 2147483647::bigint from src union
  select s.b, max(least(r.d, s.w)) from r join s on s.a = r.v left join recurring.r o on o.v = s.b group by s.b, o.d having o.d is null or max(least(r.d, s.w)) > o.d) select v as id, d as width from r""")
def widest_path(spark, sf_dir):
    g = parts(spark, sf_dir)
    return paths.widest_path(g, g.hub())


@query(f"""with recursive {PART},
r(v, d, g) using key (v) as (
  select v, 0, 1.0::double from src union
  select s.b, min(r.d) + 1, sum(r.g) from r join s on s.a = r.v left join recurring.r o on o.v = s.b where o.v is null group by s.b),
f as materialized (select v, d, g from r), mx as (select max(d) m from f),
z(i, v, dl) as (
  select (select m from mx), v, 0.0::double from f where d = (select m from mx) union all
  select i - 1, v, dl from (
    select z.i, x.v, coalesce(sum(case when y.d = x.d + 1 then x.g / y.g * (1 + z2.dl) end), 0.0) dl
    from (select distinct i from z) z join f x on x.d = z.i - 1 left join s on s.a = x.v left join f y on y.v = s.b
      left join z z2 on z2.v = y.v and z2.i = z.i where z.i > 0 group by 1, 2))
select v as id, round(dl, 6) as score from z""")
def betweenness(spark, sf_dir):
    g = parts(spark, sf_dir)
    return rounded(paths.betweenness(g, g.hub()), "score")


@query()
def low_diameter_decomposition(spark, sf_dir):
    return paths.low_diameter_decomposition(parts(spark, sf_dir), 0.6)


@query()
def spanner(spark, sf_dir):
    return paths.spanner(parts(spark, sf_dir), 4)


# --- connectivity

CC = """cc(v, l) using key (v) as (
  select distinct a, a from s union
  select s.b, min(cc.l) from cc join s on s.a = cc.v join recurring.cc o on o.v = s.b group by s.b, o.l having min(cc.l) < o.l)"""


@query(f"with recursive {PART}, {CC} select p_partkey as id, coalesce(l, p_partkey) as label from part left join cc on v = p_partkey")
def components(spark, sf_dir):
    return connectivity.components(sources.part_graph(spark, sf_dir, isolated=True).store())


@query(f"with recursive {PART}, {CC} select v as id, l as label from cc")
def components_hashmin(spark, sf_dir):
    return connectivity.components(parts(spark, sf_dir), "hashmin")


@query(f"with recursive {PART}, s3 as (select * from s where w >= 3 or (a + b) % 2 = 0), {CC.replace(' s ', ' s3 ').replace(' s.', ' s3.').replace('= s.b', '= s3.b').replace('distinct a, a from s3', 'distinct a, a from s')} select v as id, l as label from cc")
def components_predicate(spark, sf_dir):
    return connectivity.components(parts(spark, sf_dir), keep=lambda s, d, w: (w >= 3) | ((s + d) % 2 == 0))


@query(f"with recursive {PART}, {CC}, z as (select l, count(*) n from cc group by l) select count(*) as components, max(n) as largest from z")
def component_stats(spark, sf_dir):
    return connectivity.component_stats(connectivity.components(parts(spark, sf_dir)))


@query(f"with recursive {PART}, {CC} select (select count(*) from cc) - count(distinct l) as n from cc")
def spanning_forest_size(spark, sf_dir):
    return connectivity.spanning_forest(parts(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"""with recursive {PART}, {CC}, r(v, d) using key (v) as (
  select distinct l, 0 from cc union
  select s.b, min(r.d) + 1 from r join s on s.a = r.v left join recurring.r o on o.v = s.b where o.v is null group by s.b),
p as (select x.v, min(y.v) u from r x join s on s.b = x.v join r y on y.v = s.a and y.d = x.d - 1 group by x.v)
select least(u, v) as src, greatest(u, v) as dst from p""")
def spanning_forest(spark, sf_dir):
    return connectivity.spanning_forest(parts(spark, sf_dir))


@query(f"""with recursive {SYM}, g as (select *, row_number() over (order by w, a, b) rk from und),
t as (select a, b, rk from g union all select b, a, rk from g),
r(a, b, k) using key (a, b) as (
  select a, b, rk from t union
  select r.a, t.b, min(greatest(r.k, t.rk)) from r join t on t.a = r.b left join recurring.r o on o.a = r.a and o.b = t.b where r.a <> t.b group by r.a, t.b, o.k having o.k is null or min(greatest(r.k, t.rk)) < o.k)
select g.a as src, g.b as dst, g.w from g join r on r.a = g.a and r.b = g.b where r.k = g.rk""")
def minimum_spanning_forest(spark, sf_dir):
    return connectivity.minimum_spanning_forest(friends(spark, sf_dir))


@query(f"""with recursive {FLOW}, dd as (select distinct a, b from e),
r as (select a, b from dd union select r.a, dd.b from r join dd on dd.a = r.b), vs as (select a v from dd union select b from dd)
select v as id, least(v, (select min(x.b) from r x join r y on y.a = x.b and y.b = x.a where x.a = v)) as label from vs""")
def strongly_connected(spark, sf_dir):
    return connectivity.strongly_connected(flow(spark, sf_dir))


@query()
def biconnected(spark, sf_dir):
    return connectivity.biconnected(parts(spark, sf_dir))


@query()
def articulation_points(spark, sf_dir):
    return connectivity.articulation_points(connectivity.biconnected(parts(spark, sf_dir)))


@query(f"with recursive {PART}, {CC} select v as id, l as label from cc")
def incremental_components(spark, sf_dir):
    g = parts(spark, sf_dir)
    state = connectivity.IncrementalComponents(g.vertices)
    for batch in (0, 1):
        state.process(g.und().where((F.col("src") + F.col("dst")) % 2 == batch).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit("insert").alias("op")))
    return state.labels


# --- ranking

PR = """dg as (select a, count(*) d from s group by 1), n as (select count(*)::double n from dg),
p(i, v, r) as (select 0, a, 1 / n from dg, n union all
  select i + 1, b, 0.15 / (select n from n) + 0.85 * sum(r / d) from p join dg on dg.a = p.v join s on s.a = p.v where i < 10 group by i, b)"""


@query(f"with recursive {PART}, {PR} select v as id, round(r, 6) as rank from p where i = 10")
def pagerank(spark, sf_dir):
    return rounded(ranking.pagerank(parts(spark, sf_dir), eps=0.0, max_iters=10), "rank")


@query(f"""with recursive {PART}, dg as (select a, sum(w)::double d from s group by 1), n as (select count(*)::double n from dg),
p(i, v, r) as (select 0, a, 1 / n from dg, n union all
  select i + 1, b, 0.15 / (select n from n) + 0.85 * sum(r * w / d) from p join dg on dg.a = p.v join s on s.a = p.v where i < 10 group by i, b)
select v as id, round(r, 6) as rank from p where i = 10""")
def pagerank_weighted(spark, sf_dir):
    return rounded(ranking.pagerank(parts(spark, sf_dir), eps=0.0, max_iters=10, weighted=True), "rank")


@query(f"""with recursive {PART}, dg as (select a, count(*) d from s group by 1),
p(i, v, r) as (select 0, a, case when a = (select v from src) then 1.0::double else 0.0 end from dg union all
  select i + 1, b, case when b = (select v from src) then 0.15::double else 0.0 end + 0.85 * sum(r / d) from p join dg on dg.a = p.v join s on s.a = p.v where i < 10 group by i, b)
select v as id, round(r, 6) as rank from p where i = 10""")
def pagerank_personalised(spark, sf_dir):
    g = parts(spark, sf_dir)
    return rounded(ranking.pagerank(g, eps=0.0, max_iters=10, sources=[g.hub()]), "rank")


@query()
def pagerank_delta(spark, sf_dir):
    return rounded(ranking.pagerank_delta(parts(spark, sf_dir), max_iters=10), "rank")


@query(f"""with recursive {PART}, dg as (select a, count(*) d from s group by 1), t as (select b v from s join src on s.a = src.v order by b limit 1),
x(i, v, p) as (select 0, v, 1.0::double from src union all select i + 1, s.b, sum(p / d) from x join dg on dg.a = x.v join s on s.a = x.v where i < 6 group by i, s.b),
y(i, v, p) as (select 0, v, 1.0::double from t union all select i + 1, s.b, sum(p / d) from y join dg on dg.a = y.v join s on s.a = y.v where i < 6 group by i, s.b)
select round(coalesce(sum(pow(0.85, x.i) * x.p * y.p), 0), 6) as sim from x join y using (i, v) where i > 0""")
def cosimrank(spark, sf_dir):
    g = parts(spark, sf_dir)
    u = g.hub()
    v = g.edges.where(F.col("src") == u).agg(F.min("dst")).first()[0]
    return rounded(ranking.cosimrank(g, u, v, iters=6), "sim")


# --- patterns


@query(f"with {SYM} select count(*) as n from und x join und y on x.b = y.a join und z on z.a = x.a and z.b = y.b")
def triangles(spark, sf_dir):
    return patterns.count_cliques(friends(spark, sf_dir), 3)


@query(f"with {SYM}, t as (select x.a p, x.b q, y.b r from und x join und y on x.b = y.a join und z on z.a = x.a and z.b = y.b) select id, count(*) as n from (select p id from t union all select q from t union all select r from t) group by id")
def triangles_by_vertex(spark, sf_dir):
    return patterns.members(patterns.cliques(friends(spark, sf_dir), 3))


@query(f"with {SYM} select count(*) as n from und ab join und ac on ac.a = ab.a and ac.b > ab.b join und bc on bc.a = ab.b and bc.b = ac.b join und ad on ad.a = ab.a and ad.b > ac.b join und bd on bd.a = ab.b and bd.b = ad.b join und cd on cd.a = ac.b and cd.b = ad.b")
def four_cliques(spark, sf_dir):
    return patterns.count_cliques(friends(spark, sf_dir), 4)


@query(f"with {PART} select count(*) as n from und ab join und ac on ac.a = ab.a and ac.b > ab.b join und bc on bc.a = ab.b and bc.b = ac.b")
def triangles_by_core_order(spark, sf_dir):
    g = parts(spark, sf_dir)
    order = primitives.dense_ranks(patterns.degeneracy_order(g), [F.col("round"), F.col("id")])
    return patterns.count_cliques(g, 3, order)


@query(f"""with {PART} select count(*) as n from s e1 join s e2 on e2.a = e1.b and e2.b <> e1.a join s e3 on e3.a = e2.b and e3.b not in (e1.a, e1.b)
join s e4 on e4.a = e3.b and e4.b not in (e1.a, e1.b, e2.b) join s e5 on e5.a = e4.b and e5.b = e1.a
where e1.a < least(e1.b, e2.b, e3.b, e4.b) and e1.b < e4.b""")
def five_cycles(spark, sf_dir):
    return patterns.five_cycles(parts(spark, sf_dir))


@query(f"""with recursive {PART}, h(i, v, c) as (
  select 0, a, count(*) from s group by a union all
  select i + 1, v, max(least(c, rn)) from (
    select i, s.a v, h.c, row_number() over (partition by s.a order by h.c desc) rn from h join s on s.b = h.v where i < 30) group by i, v)
select v as id, c as core from h where i = 30""")
def core_numbers(spark, sf_dir):
    return patterns.core_numbers(parts(spark, sf_dir))


@query(f"""with recursive {PART}, h(i, v, c) as (
  select 0, a, count(*) from s group by a union all
  select i + 1, v, max(least(c, rn)) from (
    select i, s.a v, h.c, row_number() over (partition by s.a order by h.c desc) rn from h join s on s.b = h.v where i < 30) group by i, v)
select v as id, c as core from h where i = 30""")
def core_numbers_by_peeling(spark, sf_dir):
    return patterns.degeneracy_order(parts(spark, sf_dir)).select("id", "core")


@query()
def approximate_order(spark, sf_dir):
    return patterns.approximate_order(parts(spark, sf_dir))


@query()
def approximate_order_threshold(spark, sf_dir):
    return patterns.approximate_order(parts(spark, sf_dir), rule="threshold")


@query()
def clique_cores(spark, sf_dir):
    return patterns.clique_cores(parts(spark, sf_dir), 3)


@query(f"""with recursive {PART}, f(i, a, b) as (
  select 0, a, b from und union all
  select i, a, b from (select f.i + 1 i, f.a, f.b from f
      join (select i, a, b from f union all select i, b, a from f) x on x.i = f.i and x.a = f.a
      join (select i, a, b from f union all select i, b, a from f) y on y.i = f.i and y.a = f.b and y.b = x.b
    where f.i < 8 group by 1, 2, 3 having count(*) >= 1)) select a as src, b as dst from f where i = 8""")
def truss(spark, sf_dir):
    return patterns.truss(parts(spark, sf_dir), 3)


@query(f"""with recursive {PART}, d(i, v) as (
  select 0, v from (select distinct a v from s) union all
  select i, v from (select d.i + 1 i, d.v, count(y.v) g, avg(count(y.v)) over (partition by d.i) m from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i where d.i < 30 group by d.i, d.v) where g > 1.1 * m),
k as (select d.i, count(distinct d.v) n, count(y.v) / 2.0 m from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i group by d.i)
select round(max(m / n), 6) as density from k""")
def densest_peeling(spark, sf_dir):
    return rounded(patterns.densest_peeling(parts(spark, sf_dir)), "density")


@query()
def densest_greedy(spark, sf_dir):
    return rounded(patterns.densest_greedy(parts(spark, sf_dir)), "density")


@query(f"""with recursive {PART}, h(i, v, c) as (
  select 0, a, count(*) from s group by a union all
  select i + 1, v, max(least(c, rn)) from (
    select i, s.a v, h.c, row_number() over (partition by s.a order by h.c desc) rn from h join s on s.b = h.v where i < 30) group by i, v),
l(t, v, load) as (
  select 0, v, (20 * c)::bigint from h where i = 30 union all
  select x.t + 1, x.v, x.load + sum(case when x.load < y.load then 2 when x.load = y.load then 1 else 0 end)::bigint
  from l x join s on s.a = x.v join l y on y.v = s.b where x.t < 20 group by x.t, x.v, x.load),
o as (select v, row_number() over (order by load desc, v) r from l where t = 20),
m as (select greatest(x.r, y.r) r, count(*) m from und join o x on x.v = und.a join o y on y.v = und.b group by 1),
d as (select o.r, sum(coalesce(m.m, 0)) over (order by o.r) m from o left join m on m.r = o.r)
select round(max(m / r), 6) as density from d""")
def densest_greedy_plus(spark, sf_dir):
    return rounded(patterns.densest_greedy_plus(parts(spark, sf_dir), 20), "density")


@query()
def densest_by_triangles(spark, sf_dir):
    return rounded(patterns.densest_by_cliques(parts(spark, sf_dir), 3), "density")


# --- covering


@query(f"""with recursive {PART}, m(i, v, st) as (
  select 0, a, 0 from (select distinct a from s) union all
  select m.i + 1, m.v, case when m.st <> 0 then m.st when bool_or(o.st = 1) then 2 when not bool_or(o.st = 0 and o.v < m.v) then 1 else 0 end
  from m join s on s.a = m.v join m o on o.v = s.b and o.i = m.i where m.i < 60 group by m.i, m.v, m.st) select v as id from m where i = 60 and st = 1""")
def independent_set(spark, sf_dir):
    return covering.independent_set(parts(spark, sf_dir))


@query()
def independent_set_hashed(spark, sf_dir):
    return covering.independent_set(parts(spark, sf_dir), "hash")


@query()
def independent_set_local(spark, sf_dir):
    g = parts(spark, sf_dir)
    return covering.local_status(g, g.vertices.select("id"))


@query(f"""with recursive {PART}, m(i, a, b, st) as (
  select 0, a, b, 0 from und union all
  select i + 1, a, b, case when st <> 0 then st when bl then 2 when fst then 1 else 0 end from (
    select m.i, m.a, m.b, m.st, bool_or(o.st = 1 and (o.a <> m.a or o.b <> m.b)) bl, not bool_or(o.st = 0 and (o.a, o.b) < (m.a, m.b)) fst
    from m join (select i, a, b, st, a x from m union all select i, a, b, st, b x from m) o on o.i = m.i and (o.x = m.a or o.x = m.b) where m.i < 25 group by 1, 2, 3, 4))
select a as src, b as dst from m where i = 25 and st = 1""")
def maximal_matching(spark, sf_dir):
    return covering.maximal_matching(parts(spark, sf_dir))


@query(f"""with recursive {PART}, m(i, v, c) as (
  select 0, a, -1::bigint from (select distinct a from s) union all
  select m.i + 1, m.v, case when m.c >= 0 then m.c when bool_or(o.v < m.v and o.c < 0) then -1
    else (select min(g) from range(0, 64) t(g) where not list_contains(list(o.c), g)) end
  from m join s on s.a = m.v join m o on o.v = s.b and o.i = m.i where m.i < 60 group by m.i, m.v, m.c) select v as id, c as color from m where i = 60""")
def colouring(spark, sf_dir):
    return covering.colouring(parts(spark, sf_dir))


@query()
def colouring_by_degree(spark, sf_dir):
    return covering.colouring(parts(spark, sf_dir), "degree")


@query()
def set_cover(spark, sf_dir):
    return covering.set_cover(parts(spark, sf_dir), 0.2)


# --- clustering

NB = "nb as (select a, list(distinct b) n from s group by a)"
JAC = f"{NB}, sim as (select s.a, s.b, (len(list_intersect(p.n, q.n)) + 2.0) / (len(p.n) + len(q.n) - len(list_intersect(p.n, q.n))) x from s join nb p on p.a = s.a join nb q on q.a = s.b)"
COS = f"{NB}, sim as (select s.a, s.b, (len(list_intersect(p.n, q.n)) + 2.0) / sqrt((len(p.n) + 1) * (len(q.n) + 1)) x from s join nb p on p.a = s.a join nb q on q.a = s.b)"


@query(f"with {PART}, {JAC} select a as src, b as dst, round(x, 6) as sim from sim")
def jaccard_similarity(spark, sf_dir):
    return rounded(clustering.similarities(parts(spark, sf_dir), "jaccard"), "sim")


@query(f"with {PART}, {COS} select a as src, b as dst, round(x, 6) as sim from sim")
def cosine_similarity(spark, sf_dir):
    return rounded(clustering.similarities(parts(spark, sf_dir), "cosine"), "sim")


@query(f"""with {PART}, l as (select a, b, w::double w from s union all select distinct a, a, 1.0 from s), nrm as (select a, sqrt(sum(w * w)) z from l group by a)
select s.a as src, s.b as dst, round(sum(x.w * y.w) / max(p.z * q.z), 6) as sim from s join l x on x.a = s.a join l y on y.a = s.b and y.b = x.b join nrm p on p.a = s.a join nrm q on q.a = s.b group by s.a, s.b""")
def weighted_cosine_similarity(spark, sf_dir):
    return rounded(clustering.similarities(parts(spark, sf_dir), "weighted"), "sim")


@query()
def minhash_similarity(spark, sf_dir):
    return rounded(clustering.approximate_similarities(parts(spark, sf_dir)), "sim")


@query()
def simhash_similarity(spark, sf_dir):
    return rounded(clustering.approximate_similarities(parts(spark, sf_dir), "cosine", 64), "sim")


@query()
def minhash_similarity_threshold(spark, sf_dir):
    """Edges with an end of fewer than 8 neighbours exactly, the others from sketches."""
    return rounded(clustering.approximate_similarities(parts(spark, sf_dir), threshold=8), "sim")


@query()
def simhash_similarity_threshold(spark, sf_dir):
    return rounded(clustering.approximate_similarities(parts(spark, sf_dir), "cosine", 64, threshold=8), "sim")


SCAN = f"""near as (select a, b, x from sim where x >= 0.6), core as (select a v from near group by a having count(*) >= 2),
k as (select near.* from near join core p on p.v = a join core q on q.v = b),
cc(v, l) using key (v) as (
  select v, v from core union
  select k.b, min(cc.l) from cc join k on k.a = cc.v join recurring.cc o on o.v = k.b group by k.b, o.l having min(cc.l) < o.l),
bd as (select b v, l from (select near.b, cc.l, row_number() over (partition by near.b order by near.x desc, near.a) r from near join cc on cc.v = near.a where near.b not in (select v from core)) where r = 1),
every as (select v, l from cc union all select v, l from bd),
cl as (select p.a id, every.l from (select distinct a from s) p left join every on every.v = p.a)"""


@query(f"with recursive {PART}, {COS}, {SCAN} select id, l as cluster from cl")
def scan(spark, sf_dir):
    g = parts(spark, sf_dir)
    return clustering.scan(g, clustering.similarities(g), 3, 0.6)


@query(f"with recursive {PART}, {COS}, {SCAN} select id, case when l is not null then 'member' when (select count(distinct c.l) from s join cl c on c.id = s.b where s.a = cl.id) >= 2 then 'hub' else 'outlier' end as role from cl")
def scan_roles(spark, sf_dir):
    g = parts(spark, sf_dir)
    return clustering.roles(g, clustering.scan(g, clustering.similarities(g), 3, 0.6))


def scan_index(spark, sf_dir):
    """The similarities of the parts, indexed in a folder of their own."""
    g = parts(spark, sf_dir)
    return clustering.ScanIndex.build(g, clustering.similarities(g), new_folder(spark, "scan-index"))


def _sweep(index, settings):
    out = None
    for mu, eps in settings:
        row = index.scan(mu, eps).select(F.lit(mu).alias("mu"), F.lit(eps).alias("eps"), "id", "cluster")
        out = row if out is None else out.union(row)
    return out


@query()
def scan_sweep(spark, sf_dir):
    return _sweep(scan_index(spark, sf_dir), [(3, eps) for eps in (0.4, 0.6, 0.8)]).drop("mu")


@query(f"""with recursive {PART}, {COS}, t as (select m, e::double e from (values (2, 0.7), (3, 0.5), (5, 0.55)) t(m, e)),
near as (select m, e, a, b, x from sim, t where x >= e), core as (select m, e, a v from near group by m, e, a having count(*) >= m - 1),
k as (select near.* from near join core p on p.v = a and p.m = near.m join core q on q.v = b and q.m = near.m),
cc(m, v, l) using key (m, v) as (
  select m, v, v from core union
  select k.m, k.b, min(cc.l) from cc join k on k.a = cc.v and k.m = cc.m join recurring.cc o on o.v = k.b and o.m = k.m group by k.m, k.b, o.l having min(cc.l) < o.l),
bd as (select near.m, near.b v, cc.l, row_number() over (partition by near.m, near.b order by near.x desc, near.a) r from near join cc on cc.v = near.a and cc.m = near.m
  where (near.m, near.b) not in (select m, v from core)),
every as (select m, v, l from cc union all select m, v, l from bd where r = 1)
select p.m as mu, p.e as eps, p.a as id, every.l as cluster from (select distinct a, m, e from s, t) p left join every on every.v = p.a and every.m = p.m""")
def scan_settings(spark, sf_dir):
    return _sweep(scan_index(spark, sf_dir), [(2, 0.7), (3, 0.5), (5, 0.55)])


@query()
def scan_overlapping(spark, sf_dir):
    g = parts(spark, sf_dir)
    return clustering.scan_overlapping(g, clustering.similarities(g), 3, 0.6).select("id", F.concat_ws(" ", F.transform("clusters", lambda x: x.cast("string"))).alias("clusters"))


@query(f"with {PART}, k as (select a % 5 c, count(*) k, count(*) filter (where a % 5 = b % 5) i from s group by 1) select round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) as q from k")
def modularity(spark, sf_dir):
    g = parts(spark, sf_dir)
    return rounded(clustering.modularity(g, g.vertices.select("id", (F.col("id") % 5).alias("cluster"))), "q")


@query(f"""with recursive {PART}, l(i, v, x) as (
  select 0, a, a from (select distinct a from s) union all
  select i, v, x from (select l.i + 1 i, s.a v, l.x, row_number() over (partition by s.a order by sum(s.w) desc, l.x desc) rn from l join s on s.b = l.v where l.i < 100 group by l.i, s.a, l.x) where rn = 1)
select v as id, x as label from l where i = 100""")
def label_propagation(spark, sf_dir):
    return clustering.label_propagation(parts(spark, sf_dir))


@query(f"with {FLOW}, c as (select id, id % 4 k from (select a id from e union select b from e)) select count(distinct k) as clusters, count(*) as clustered, (select count(*) from (select distinct least(a, b) a, greatest(a, b) b from e) where a % 4 <> b % 4) as crossing from c")
def cluster_stats(spark, sf_dir):
    g = friends(spark, sf_dir)
    return clustering.cluster_stats(g, g.vertices.select("id", (F.col("id") % 4).alias("cluster")))


@query()
def k_centres(spark, sf_dir):
    return clustering.k_centres(friends(spark, sf_dir), 3)


@query()
def k_centres_approximate(spark, sf_dir):
    return clustering.k_centres(friends(spark, sf_dir), 3, epsilon=0.5)


@query()
def k_centres_by_radius(spark, sf_dir):
    return clustering.k_centres_by_radius(friends(spark, sf_dir), 4)


@query()
def k_centres_sampled(spark, sf_dir):
    return clustering.k_centres_by_radius(friends(spark, sf_dir), 4, sampled=True)


@query(f"""with recursive {PART}, cand as (select distinct a from s where a % 5 = 0), r(c, v, d) using key (c, v) as (
  select a, a, 0::bigint from cand union
  select r.c, s.b, min(r.d + s.w) from r join s on s.a = r.v left join recurring.r o on o.v = s.b and o.c = r.c where r.d + s.w <= 4 group by r.c, s.b, o.d having o.d is null or min(r.d + s.w) < o.d)
select a as id from cand where a not in (select v from r where c <> v)""")
def separated_vertices(spark, sf_dir):
    """Of every fifth vertex, those that have no other one within distance 4."""
    g = parts(spark, sf_dir)
    return clustering.apart(g, g.vertices.where("id % 5 = 0"), 4)


@query(f"with recursive {SYM}, {SSSP.replace('select v, 0::bigint from src', 'select distinct a, 0::bigint from s where a in (1, 2)')} select max(d) as radius, (select count(distinct a) from s) - count(*) as unreachable from r")
def centre_quality(spark, sf_dir):
    return clustering.centre_quality(friends(spark, sf_dir), [1, 2])


@query()
def centre_assignment(spark, sf_dir):
    return clustering.centre_assignment(friends(spark, sf_dir), [1, 2])


@query()
def distance_independent_set(spark, sf_dir):
    return clustering.distance_independent_set(parts(spark, sf_dir), 2)


# --- generators


@query()
def sparsified_triangles(spark, sf_dir):
    return patterns.count_cliques(patterns.sparsified(friends(spark, sf_dir), colours=2), 3)


@query()
def random_order(spark, sf_dir):
    return primitives.random_order(parts(spark, sf_dir), 7)

"""Further registered queries: scalar functions, vertex subsets, files, generators, verifiers; and SQL for the catalogue's hashed and peeling queries.

hash_priority() is the first 15 hexadecimal digits of an MD5, so SQL repeats every hashed choice exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.graph import Graph
from graphloom.operators import connectivity, covering, paths, primitives
from graphloom.plans.catalogue import BFS, CC, COS, FLOW, PART, SQL, SSSP, SYM, flow, friends, parts, query
from graphloom.runtime import new_folder, table
from graphloom.sources import files, generators


def hashed(*keys: str, seed: int | str = 0) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, {seed})), 1, 15) as bigint)"


# --- SQL of queries of the catalogue

SQL["colouring_by_degree"] = f"""with recursive {PART}, dg as (select a, count(*) n from s group by a), m(i, v, n, c) as (
  select 0, a, n, -1::bigint from dg union all
  select m.i + 1, m.v, m.n, case when m.c >= 0 then m.c when bool_or((o.n > m.n or (o.n = m.n and o.v < m.v)) and o.c < 0) then -1
    else (select min(g) from range(0, 64) t(g) where not list_contains(list(o.c), g)) end
  from m join s on s.a = m.v join m o on o.v = s.b and o.i = m.i where m.i < 60 group by m.i, m.v, m.n, m.c) select v as id, c as color from m where i = 60"""

SWEEP = f"""{COS}, near as (select e::double e, a, b, x from sim, (values (0.4), (0.6), (0.8)) t(e) where x >= e::double), core as (select e, a v from near group by e, a having count(*) >= 2),
k as (select near.* from near join core p on p.v = a and p.e = near.e join core q on q.v = b and q.e = near.e),
cc(e, v, l) using key (e, v) as (
  select e, v, v from core union
  select k.e, k.b, min(cc.l) from cc join k on k.a = cc.v and k.e = cc.e join recurring.cc o on o.v = k.b and o.e = k.e group by k.e, k.b, o.l having min(cc.l) < o.l),
bd as (select near.e, near.b v, cc.l, row_number() over (partition by near.e, near.b order by near.x desc, near.a) r from near join cc on cc.v = near.a and cc.e = near.e where (near.e, near.b) not in (select e, v from core))"""
SQL["scan_sweep"] = f"""with recursive {PART}, {SWEEP}, every as (select e, v, l from cc union all select e, v, l from bd where r = 1)
select p.e as eps, p.a as id, every.l as cluster from (select distinct a, t.e::double e from s, (values (0.4), (0.6), (0.8)) t(e)) p left join every on every.v = p.a and every.e = p.e"""
SQL["scan_overlapping"] = f"""with recursive {PART}, {SWEEP}, every as (select v, l from cc where e = 0.6::double union select v, l from bd where e = 0.6::double)
select p.a as id, coalesce(array_to_string(list_sort(list(distinct every.l) filter (where every.l is not null)), ' '), '') as clusters from (select distinct a from s) p left join every on every.v = p.a group by p.a"""

SQL["centre_assignment"] = f"""with recursive {SYM}, r(c, v, d) using key (c, v) as (
  select distinct a, a, 0::bigint from s where a in (1, 2) union
  select r.c, s.b, min(r.d + s.w) from r join s on s.a = r.v left join recurring.r o on o.v = s.b and o.c = r.c group by r.c, s.b, o.d having o.d is null or min(r.d + s.w) < o.d)
select p.a as id, arg_min(r.c, (r.d, r.c)) as cluster from (select distinct a from s) p left join r on r.v = p.a group by p.a"""

SQL["pagerank_delta"] = f"""with recursive {PART}, dg as (select a, count(*) d from s group by 1), n as (select count(*)::double n from dg),
p(i, v, r, dl) as (select 0, a, 0.0::double, 1 / n from dg, n union all
  select i + 1, v, case when i = 0 then g + 0.15 / (select n from n) else r + g end, case when i = 0 then g + 0.15 / (select n from n) - dl else g end from (
    select p.i, p.v, p.r, p.dl, 0.85 * coalesce(sum(case when p.i = 0 or abs(o.dl) > 0.01 * o.r then o.dl / dg.d end), 0) g,
      sum(abs(p.dl)) over (partition by p.i) total from p join s on s.a = p.v join p o on o.v = s.b and o.i = p.i join dg on dg.a = o.v where p.i < 10 group by 1, 2, 3, 4)
  where i = 0 or total >= 1e-6 * (select n from n))
select v as id, round(r, 6) as rank from p where i = (select max(i) from p)"""

SQL["clique_cores"] = f"""with recursive {PART}, t as (select row_number() over () c, x.a p, x.b q, y.b r from und x join und y on x.b = y.a join und z on z.a = x.a and z.b = y.b),
m as (select c, p v from t union all select c, q from t union all select c, r from t),
h(i, v, c) as (select 0, v, count(*) from m group by v union all
  select i + 1, v, max(least(own, least(val, rn))) from (
    select i, v, own, val, row_number() over (partition by i, v order by val desc) rn from (
      select h.i, m.v, h.c own, m.c cl, min(o.c) val from m join h on h.v = m.v join m n on n.c = m.c and n.v <> m.v join h o on o.v = n.v and o.i = h.i where h.i < 20 group by 1, 2, 3, 4)) group by i, v)
select p.a as id, coalesce(h.c, 0) as core from (select distinct a from s) p left join h on h.v = p.a and h.i = 20"""

PEELED = """st as materialized (select d.i, d.v, d.k, count(y.v) g from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i group by 1, 2, 3)"""
SQL["approximate_order_threshold"] = f"""with recursive {PART}, d(i, v, k) as (
  select 0, v, 0::bigint from (select distinct a v from s) union all
  select i + 1, v, k from (select i, v, g, ceil(1.1::double * avg(g) over (partition by i))::bigint k from (
    select d.i, d.v, count(y.v) g from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i group by d.i, d.v)) where g > k),
{PEELED}, z as (select i, v, g, ceil(1.1::double * avg(g) over (partition by i))::bigint k from st)
select v as id, i as round, k as core from z where g <= k"""

SQL["approximate_order"] = f"""with recursive {PART}, d(i, v, k) as (
  select 0, v, 0::bigint from (select distinct a v from s) union all
  select i + 1, v, k from (select i, v, g, quantile_disc(g, 1 / 2.1) over (partition by i) k from (
    select d.i, d.v, count(y.v) g from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i group by d.i, d.v)) where g > k),
{PEELED}, z as (select i, v, g, quantile_disc(g, 1 / 2.1) over (partition by i) k from st)
select v as id, i as round, k as core from z where g <= k"""

SQL["densest_greedy"] = f"""with recursive {PART}, d(i, v, k) as (
  select 0, v, 0::bigint from (select distinct a v from s) union all
  select i + 1, v, kk from (select i, v, g, greatest(k, min(g) over (partition by i)) kk from (
    select d.i, d.v, d.k, count(y.v) g from d left join s on s.a = d.v left join d y on y.v = s.b and y.i = d.i group by d.i, d.v, d.k)) where g > kk),
{PEELED} select round(max(m), 6) as density from (select sum(g) / 2.0 / count(*) m from st group by i)"""

SQL["densest_by_triangles"] = f"""with recursive {PART}, t as (select row_number() over () c, x.a p, x.b q, y.b r from und x join und y on x.b = y.a join und z on z.a = x.a and z.b = y.b),
tv as (select c, unnest([p, q, r]) v from t),
d(i, v, g) as (select 0, a, (select count(*) from tv where tv.v = a) from (select distinct a from s) union all
  select * from (with kept as (select i + 1 i, v from (select i, v, g, sum(g) over (partition by i) / 3 m, count(*) over (partition by i) n from d) where g > 3 * 1.1::double * m / n),
    held as (select i, v, count(*) over (partition by i, c) here from (select kept.i, tv.v, tv.c from kept join tv on tv.v = kept.v))
    select kept.i, kept.v, count(held.v) from kept left join held on held.i = kept.i and held.v = kept.v and held.here = 3 group by 1, 2))
select round(max(m / 3 / n), 6) as density from (select sum(g)::double m, count(*) n from d group by i)"""

# From each neighbour of x, what it reaches without x: the least neighbour that reaches a names a's side of x.
SIDES = """sides(x, v, l) using key (x, v) as (
  select a, b, b from s union
  select sides.x, s.b, min(sides.l) from sides join s on s.a = sides.v and s.b <> sides.x left join recurring.sides o on o.x = sides.x and o.v = s.b group by sides.x, s.b, o.l having o.l is null or min(sides.l) < o.l)"""
SQL["articulation_points"] = f"""with recursive {PART}, {SIDES} select s.a as id from s join sides on sides.x = s.a and sides.v = s.b group by s.a having count(distinct sides.l) > 1"""
SQL["biconnected"] = f"""with recursive {PART}, {SIDES}, near as (select s.a x, s.b v, sides.l from s join sides on sides.x = s.a and sides.v = s.b),
lead as (select x, l, min(least(x, v)) over w p, min(v) over w f, v from near window w as (partition by x, l)),
lk as (select least(x, v) a1, greatest(x, v) b1, least(x, f) a2, greatest(x, f) b2 from lead),
el as (select * from lk union all select a2, b2, a1, b1 from lk),
r(a, b, f) using key (a, b) as (
  select a, b, a * 10000000000 + b from und union
  select el.a2, el.b2, min(r.f) from r join el on el.a1 = r.a and el.b1 = r.b join recurring.r o on o.a = el.a2 and o.b = el.b2 group by el.a2, el.b2, o.f having min(r.f) < o.f)
select a as src, b as dst, f // 10000000000 as first_src, f % 10000000000 as first_dst from r"""

MIS = """m(i, v, st) as (
  select 0, a, 0 from (select distinct a from s) union all
  select m.i + 1, m.v, case when m.st <> 0 then m.st when bool_or(o.st = 1) then 2 when not bool_or(o.st = 0 and {less}) then 1 else 0 end
  from m join s{two} s on s.a = m.v join m o on o.v = s.b and o.i = m.i where m.i < {n} group by m.i, m.v, m.st)"""
SQL["distance_independent_set"] = f"""with recursive {PART}, s2 as (select a, b from s union select x.a, y.b from s x join s y on x.b = y.a where x.a <> y.b), {MIS.format(less='o.v < m.v', two='2', n=60)} select v as id from m where i = 60 and st = 1"""
EARLIER = f"({hashed('o.v')}, o.v) < ({hashed('m.v')}, m.v)"
SQL["independent_set_hashed"] = f"""with recursive {PART}, {MIS.format(less=EARLIER, two='', n=24)} select v as id from m where i = 24 and st = 1"""

SQL["independent_set_local"] = f"""with recursive {PART}, {MIS.format(less=EARLIER, two='', n=24)}, h as materialized (select a v, {hashed('a')} k from (select distinct a from s)),
down as materialized (select s.a, s.b from s join h x on x.v = s.a join h y on y.v = s.b where (y.k, y.v) < (x.k, x.v)),
r as (select v root, v from h union select r.root, down.b from r join down on down.a = r.v), z as (select root, count(*) n from r group by root)
select z.root as id, case when m.st = 1 then 'in' else 'out' end as status, z.n as work from z join m on m.v = z.root and m.i = 24"""

SQL["random_order"] = f"with {PART} select a as id, row_number() over (order by {hashed('a', seed=7)}, a) - 1 as new from (select distinct a from s)"
SQL["sparsified_triangles"] = f"with {SYM}, k as (select a, b from und where {hashed('a')} % 2 = {hashed('b')} % 2) select count(*) as n from k x join k y on x.b = y.a join k z on z.a = x.a and z.b = y.b"

CLOSED = "c as (select a, b x from s union all select distinct a, a from s)"
SQL["minhash_similarity"] = f"""with {PART}, {CLOSED}, sk as (select a, {hashed('x')} % 128 slot, min({hashed('x')}) v from c group by 1, 2), f as (select a, count(*) n from sk group by a)
select s.a as src, s.b as dst, round(coalesce(z.same, 0) / (p.n + q.n - coalesce(z.both_, 0))::double, 6) as sim from s join f p on p.a = s.a join f q on q.a = s.b
left join (select s.a, s.b, count(*) both_, count(*) filter (where x.v = y.v) same from s join sk x on x.a = s.a join sk y on y.a = s.b and y.slot = x.slot group by 1, 2) z on z.a = s.a and z.b = s.b"""
SQL["simhash_similarity"] = f"""with {PART}, {CLOSED}, bits as (select a, g bit, sum(2 * (({hashed('x', seed='(g // 48)')} >> (g % 48)) & 1) - 1) >= 0 v from c, range(0, 64) t(g) group by 1, 2)
select s.a as src, s.b as dst, round(cos(pi() * (count(*) filter (where x.v <> y.v) / 64.0)), 6) as sim from s join bits x on x.a = s.a join bits y on y.a = s.b and y.bit = x.bit group by s.a, s.b"""

DEGREE = "dg as (select a, count(*) n from s group by a)"
LOW = "(least(p.n, q.n) < 8)"
COMMON = "cm as (select s.a, s.b, count(y.b) c from s join s x on x.a = s.a left join s y on y.a = s.b and y.b = x.b group by 1, 2)"
SQL["minhash_similarity_threshold"] = f"""with {PART}, {CLOSED}, {DEGREE}, {COMMON}, sk as (select a, {hashed('x')} % 128 slot, min({hashed('x')}) v from c group by 1, 2), f as (select a, count(*) n from sk group by a),
z as (select s.a, s.b, count(*) both_, count(*) filter (where x.v = y.v) same from s join sk x on x.a = s.a join sk y on y.a = s.b and y.slot = x.slot group by 1, 2)
select s.a as src, s.b as dst, round(case when {LOW} then (cm.c + 2) / (p.n + q.n - cm.c)::double else coalesce(z.same, 0) / (u.n + t.n - coalesce(z.both_, 0))::double end, 6) as sim
from s join dg p on p.a = s.a join dg q on q.a = s.b join cm on cm.a = s.a and cm.b = s.b join f u on u.a = s.a join f t on t.a = s.b left join z on z.a = s.a and z.b = s.b"""
SQL["simhash_similarity_threshold"] = f"""with {PART}, {CLOSED}, {DEGREE}, {COMMON}, bits as (select a, g bit, sum(2 * (({hashed('x', seed='(g // 48)')} >> (g % 48)) & 1) - 1) >= 0 v from c, range(0, 64) t(g) group by 1, 2),
h as (select s.a, s.b, cos(pi() * (count(*) filter (where x.v <> y.v) / 64.0)) sim from s join bits x on x.a = s.a join bits y on y.a = s.b and y.bit = x.bit group by s.a, s.b)
select s.a as src, s.b as dst, round(case when {LOW} then (cm.c + 2) / sqrt((p.n + 1) * (q.n + 1)) else h.sim end, 6) as sim
from s join dg p on p.a = s.a join dg q on q.a = s.b join cm on cm.a = s.a and cm.b = s.b join h on h.a = s.a and h.b = s.b"""


def _decomposition(beta: str) -> str:
    return f"""rk as (select a v, row_number() over (order by {hashed('a')}, a) - 1 r, count(*) over () n, {beta} beta from (select distinct a from s)),
up as (select g i, sum(floor(exp(g * (select max(beta) from rk)))) over (order by g) u from range(0, 80) t(g)),
st(i, v, c, p, t) as (
  select -1, v, null::bigint, null::bigint, null::bigint from rk union all
  select i + 1, v, coalesce(c, g // 10000000000, case when r < u then v end), coalesce(p, g % 10000000000, case when r < u then v end),
    coalesce(t, case when g is not null or r < u then i + 1 end) from (
    select st.i, st.v, st.c, st.p, st.t, rk.r, up.u, min(o.c::hugeint * 10000000000 + s.b) g from st join rk on rk.v = st.v join up on up.i = st.i + 1
      left join s on s.a = st.v left join st o on o.v = s.b and o.i = st.i and o.t = st.i where st.i < 79 group by 1, 2, 3, 4, 5, 6, 7)),
ldd as (select v, c, p from st where i = 79)"""


SQL["low_diameter_decomposition"] = f"with recursive {PART}, {_decomposition('0.6::double')} select v as id, c::bigint as cluster, p::bigint as parent from ldd"
SQL["spanner"] = f"""with recursive {PART}, {_decomposition('ln(count(*) over ()) / 8')}, x as (select und.a, und.b, least(p.c, q.c) c1, greatest(p.c, q.c) c2 from und join ldd p on p.v = und.a join ldd q on q.v = und.b where p.c <> q.c)
select least(v, p)::bigint as src, greatest(v, p)::bigint as dst from ldd where v <> p union select m.a, m.b from (select min((a, b)) e, min(a * 10000000000::hugeint + b) k from x group by c1, c2) z join und m on m.a = z.k // 10000000000 and m.b = z.k % 10000000000"""


def _centres(k: int, order: str) -> str:
    out = [f"with recursive {SYM}, every as (select distinct a from s), c0 as (select min(a) v from every)"]
    for j in range(k):
        start = "select v, 0::bigint from c0" if j == 0 else f"select v, d from f{j - 1} union select v, 0 from c{j}"
        out.append(f"""r{j}(v, d) using key (v) as ({start.replace('union', 'where v not in (select v from c' + str(j) + ') union all') if j else start} union
  select s.b, min(r{j}.d + s.w) from r{j} join s on s.a = r{j}.v left join recurring.r{j} o on o.v = s.b group by s.b, o.d having o.d is null or min(r{j}.d + s.w) < o.d),
f{j} as materialized (select v, d from r{j}), c{j + 1} as materialized (select a v from every left join f{j} on f{j}.v = a order by {order} limit 1)""")
    rows = " union all ".join(f"select {j}::int as position, (select v from c{j}) as id, (select max(d)::double from f{j}) as radius" for j in range(k))
    return ", ".join(out) + " " + rows


SQL["k_centres"] = _centres(3, "(d is not null), -d, a")
SQL["k_centres_approximate"] = _centres(3, f"case when d is null then '-infinity'::double when d <= 0 then 1 else -ceil(ln(d) / {math.log1p(0.25)!r}) end, {hashed('a')}, a")

# the greedy cover of every radius up to 32, then the doubling and halving search over which of them need 4 centres at most
SQL["k_centres_by_radius"] = f"""with recursive {SYM}, h as materialized (select a v, {hashed('a')} k from (select distinct a from s)),
d(c, v, d) using key (c, v) as (
  select v, v, 0::bigint from h union
  select d.c, s.b, min(d.d + s.w) from d join s on s.a = d.v left join recurring.d o on o.v = s.b and o.c = d.c group by d.c, s.b, o.d having o.d is null or min(d.d + s.w) < o.d),
near as materialized (select d.c, d.v, d.d, (y.k, y.v) < (x.k, x.v) earlier from d join h x on x.v = d.c join h y on y.v = d.v where d.c <> d.v),
m(i, r, v, st) as (
  select 0, r, v, 0 from h, range(0, 33) t(r) union all
  select m.i + 1, m.r, m.v, case when m.st <> 0 then m.st when coalesce(bool_or(o.st = 1), false) then 2 when not coalesce(bool_or(o.st = 0 and near.earlier), false) then 1 else 0 end
  from m left join near on near.c = m.v and near.d <= m.r left join m o on o.v = near.v and o.r = m.r and o.i = m.i where m.i < 16 group by m.i, m.r, m.v, m.st),
ok as materialized (select r, count(*) filter (where st = 1) <= 4 and count(*) filter (where st = 0) = 0 ok from m where i = 16 group by r),
z(lo, hi) as (
  select hi // 2, hi from (select min(r) hi from ok where ok and r in (0, 1, 2, 4, 8, 16, 32)) union all
  select case when ok then lo else r end, case when ok then r else hi end from z join ok on r = (lo + hi) // 2 where hi - lo > 1)
select (row_number() over (order by h.k, h.v) - 1)::int as position, h.v as id, m.r::double as radius from m join h using (v) where m.i = 16 and m.st = 1 and m.r = (select min(hi) from z)"""

SQL["set_cover"] = f"""with recursive {PART}, l(i, id, e) as (
  select 0, a, b from s union all
  select i + 1, id, e from (select i, id, e, bool_or(won) over (partition by i, e) gone from (
    select i, id, e, sum(case when w = id then 1 else 0 end) over (partition by i, id) >= greatest(1, ceil(pow(1.2::double, bk - 1))) and top won from (
      select i, id, e, bk, top, min(case when top then id end) over (partition by i, e) w from (
        select i, id, e, floor(ln(max(n) over (partition by i)) / {math.log1p(0.2)!r}) bk, floor(ln(n) / {math.log1p(0.2)!r}) >= floor(ln(max(n) over (partition by i)) / {math.log1p(0.2)!r}) top from (
          select i, id, e, count(*) over (partition by i, id) n from l))))) where not gone),
f as (select i, id, e, count(*) over (partition by i, id) n from l), g as (select *, floor(ln(max(n) over (partition by i)) / {math.log1p(0.2)!r}) bk from f),
h as (select *, floor(ln(n) / {math.log1p(0.2)!r}) >= bk top from g), w as (select *, min(case when top then id end) over (partition by i, e) w from h)
select id from w where top group by i, id, bk having count(*) filter (where w = id) >= greatest(1, ceil(pow(1.2::double, bk - 1)))"""

# --- scalar functions


@query(f"with {PART} select a as id, {hashed('a', seed=3)} as priority from (select distinct a from s)")
def hash_priorities(spark, sf_dir):
    return parts(spark, sf_dir).vertices.select("id", scalars.hash_priority("id", seed=3).alias("priority"))


@query(f"with {PART} select a as id from (select distinct a from s) where {hashed('a')} % 1000000007 < 300000002")
def bernoulli_vertices(spark, sf_dir):
    return parts(spark, sf_dir).vertices.where(scalars.bernoulli(0.3, "id")).select("id")


@query("select l_orderkey as id, l_linenumber as line, case when l_extendedprice <= 0 then -1 else ceil(ln(l_extendedprice::double) / ln(2.0::double)) end::bigint as bucket from lineitem")
def geometric_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), scalars.geometric_bucket(F.col("l_extendedprice").cast("double"), 2.0).alias("bucket"))


@query("""select s_suppkey as id, round(2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(s_suppkey % 17 - n_nationkey) / 2), 2)
  + cos(radians(n_nationkey::double)) * cos(radians((s_suppkey % 17)::double)) * pow(sin(radians(2.0 * n_nationkey - s_suppkey % 90) / 2), 2)))), 3) as metres from supplier join nation on s_nationkey = n_nationkey""")
def haversine_distances(spark, sf_dir):
    """From a place made of the nation's number to one made of the supplier's."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, k = F.col("n_nationkey").cast("double"), F.col("s_suppkey")
    far = scalars.haversine(n, (k % 90).cast("double"), (k % 17).cast("double"), 2.0 * n)
    return both.select(k.alias("id"), F.round(far, 3).alias("metres"))


@query("select event_id as id, case when event_id % 7 = 0 then null else (event_id % 30) * 3600 + (event_id % 60) * 60 + event_id % 59 end::bigint as seconds from events")
def clock_times(spark, sf_dir):
    """Seconds of clock texts past midnight, every seventh of them broken."""
    k = F.col("event_id")
    text = F.concat_ws(":", (k % 30).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 7 == 0, "x").otherwise((k % 59).cast("string")))
    return table(spark, sf_dir, "events").select(k.alias("id"), scalars.clock_seconds(text).alias("seconds"))


@query(f"with {FLOW} select a as id, array_to_string(list_sort(list(distinct b)), ' ') as members from e group by a")
def cluster_texts(spark, sf_dir):
    return primitives.adjacency(flow(spark, sf_dir)).select("id", scalars.clusters_text(F.col("neighbours")).alias("members"))


@query(f"with {PART} select a as src, b as dst, 1 + {hashed('a', 'b', seed=5)} % 20 as w from und")
def uniform_weights(spark, sf_dir):
    return generators.with_uniform_weights(parts(spark, sf_dir), 20, 5).und()


# --- vertex subsets, neighbourhoods, vectors


@query(f"with {FLOW} select distinct b as id, b % 7 as class from e where a % 10 = 0 and b % 3 = 1")
def vertex_map_filter(spark, sf_dir):
    g = flow(spark, sf_dir)
    front = primitives.edge_map_induced(g, g.vertices.where("id % 10 = 0").select("id")).distinct()
    return primitives.vertex_map(primitives.vertex_filter(front, F.col("id") % 3 == 1), **{"class": F.col("id") % 7})


@query(f"with {PART} select a as src, b as dst, w from s where {hashed('least(a, b)', 'greatest(a, b)', seed=1)} % 1000000 < 250000")
def sampled_edges(spark, sf_dir):
    return parts(spark, sf_dir).sample_edges(0.25, 1)


@query(f"with {FLOW}, v as (select a id from e union select b from e) select v.id, count(e.a) as degree from v left join e on e.a = v.id and e.a % 11 <> 0 and e.b % 11 <> 0 group by v.id")
def isolated_degrees(spark, sf_dir):
    g = flow(spark, sf_dir)
    return g.isolate(g.vertices.where("id % 11 = 0").select("id")).degrees()


@query(f"with {FLOW} select a as id, b as neighbour, w * 2 as value from e where w % 2 = 1")
def neighbour_map_filter(spark, sf_dir):
    return flow(spark, sf_dir).edges.where("w % 2 = 1").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), (F.col("w") * 2).alias("value"))


@query(f"with {FLOW} select a as src, b as dst, w from (select *, row_number() over (partition by a order by b) r from e) where r <= 2")
def first_two_neighbours(spark, sf_dir):
    return primitives.first_neighbours(flow(spark, sf_dir), 2)


VECTORS = "x as (select a id, count(*)::double v from e group by a), y as (select b id, sum(w)::double v from e group by b)"


@query(f"with {FLOW}, {VECTORS} select (select sum(x.v * y.v) from x join y using (id)) as inner_product, (select sum(abs(coalesce(x.v, 0) - coalesce(y.v, 0))) from x full join y using (id)) as l1")
def vector_operations(spark, sf_dir):
    e = flow(spark, sf_dir).edges
    x = e.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("value"))
    y = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").cast("double").alias("value"))
    return primitives.inner_product(x, y).select(F.col("value").alias("inner_product")).join(primitives.l1_distance(x, y).select(F.col("value").alias("l1")))


@query(f"with recursive {PART}, {CC}, z as (select l, count(*) n from cc group by l) select l as label, n from z order by n desc, l limit 1")
def most_frequent_label(spark, sf_dir):
    return primitives.most_frequent(connectivity.components(parts(spark, sf_dir)), "label")


@query(f"with recursive {PART}, {CC} select v as id, l as label from cc")
def components_sampled(spark, sf_dir):
    """k-out sampling first, then only the edges that leave the most frequent label."""
    return connectivity.components(parts(spark, sf_dir), "sampled")


@query(f"with recursive {PART}, {CC} select v as id, l as label from cc")
def components_by_search(spark, sf_dir):
    """What a search reaches first, then only the edges that leave the most frequent label."""
    return connectivity.components(parts(spark, sf_dir), "bfs")


@query(f"with recursive {PART}, {CC} select v as id, l as label from cc")
def components_by_decomposition(spark, sf_dir):
    """Clusters of a low-diameter decomposition first."""
    return connectivity.components(parts(spark, sf_dir), "ldd")


@query(f"with {SYM}, r as (select *, row_number() over (order by w, a, b) k from und) select a as src, b as dst, w from r where k <= 100")
def lightest_edges(spark, sf_dir):
    return primitives.lightest_edges(friends(spark, sf_dir), 100)


# --- paths and verifiers


@query(f"with recursive {PART}, {BFS.replace('select v, 0 from src', 'select distinct a, 0 from s where a % 100 = 0 or a = (select v from src)')} select v as id, d as dist from r")
def bfs_repair(spark, sf_dir):
    """Hops after every hundredth vertex became a source too."""
    g = parts(spark, sf_dir)
    hop = Graph(g.vertices, g.edges.withColumn("w", F.lit(1)), False)
    return paths.repair(g, paths.sssp(hop, g.hub()), g.vertices.where("id % 100 = 0").select("id", F.lit(0).alias("dist")), hops=True)[0]


@query(f"with recursive {PART}, {SSSP.replace('select v, 0::bigint from src', 'select v, 0::bigint from src union select max(a), 0::bigint from s')} select v as id, d as dist from r")
def sssp_new_source(spark, sf_dir):
    g = parts(spark, sf_dir)
    state = paths.DynamicPaths(g, g.hub())
    state.insert_source(g.vertices.agg(F.max("id")).first()[0])
    return state.state


@query("select 'colouring' as what, true as holds union all select 'independent set', true union all select 'matching', true union all select 'spanning forest', true")
def verifiers(spark, sf_dir):
    """Each verifier on the operator that it belongs to."""
    g = parts(spark, sf_dir)
    found = [
        ("colouring", covering.colour_conflicts(g, covering.colouring(g)).first()[0] == 0),
        ("independent set", covering.is_maximal_independent(g, covering.independent_set(g, "hash"))),
        ("matching", covering.is_maximal_matching(g, covering.maximal_matching(g, "hash"))),
        ("spanning forest", connectivity.is_spanning_forest(g, connectivity.spanning_forest(g))),
    ]
    return spark.createDataFrame(found, "what string, holds boolean")


LOCAL = """m(i, a, b, st) as (
  select 0, a, b, 0 from und union all
  select i + 1, a, b, case when st <> 0 then st when bl then 2 when fst then 1 else 0 end from (
    select m.i, m.a, m.b, m.st, bool_or(o.st = 1 and (o.a <> m.a or o.b <> m.b)) bl, not bool_or(o.st = 0 and (o.h, o.a, o.b) < (h.k, m.a, m.b)) fst
    from m join hs h on h.a = m.a and h.b = m.b join (select m.i, m.a, m.b, m.st, x.v x, x.k h from m join (select a, b, k, a v from hs union all select a, b, k, b from hs) x on x.a = m.a and x.b = m.b) o on o.i = m.i and (o.x = m.a or o.x = m.b) where m.i < 16 group by 1, 2, 3, 4))"""


@query(f"with recursive {PART}, hs as (select a, b, {hashed('a', 'b')} k from und), {LOCAL} select a as src, b as dst, case when st = 1 then 'in' else 'out' end as status from m where i = 16")
def matching_local(spark, sf_dir):
    return covering.local_matching(parts(spark, sf_dir)).select("src", "dst", "status")


# --- files


@query(f"with {PART} select a as src, b as dst, w::double as w from s")
def edge_list_file(spark, sf_dir):
    """Written as a weighted edge list and read again."""
    path = new_folder(spark, "edge-list")
    files.write_edge_list(parts(spark, sf_dir), path, True)
    return files.read_edge_list(spark, path, True).edges


RANKED = "v as (select a, row_number() over (order by a) - 1 n from (select distinct a from s))"


@query(f"with {PART}, {RANKED} select x.n as src, y.n as dst, w from s join v x on x.a = s.a join v y on y.a = s.b")
def adjacency_file(spark, sf_dir):
    """Written in the weighted adjacency format and read again."""
    path = new_folder(spark, "adjacency")
    files.write_adjacency(files.cleaned(parts(spark, sf_dir)), path, True)
    return files.read_adjacency(spark, path).edges


@query(f"with {PART}, {RANKED} select x.n as src, y.n as dst, w from s join v x on x.a = s.a join v y on y.a = s.b")
def binary_file(spark, sf_dir):
    """Written as weighted binary rows and read again."""
    path = new_folder(spark, "binary")
    files.write_binary(files.cleaned(parts(spark, sf_dir)), path, True)
    return files.read_binary(spark, path, weighted=True).edges


@query(f"with {PART} select a as src, b as dst, w from s")
def parquet_graph(spark, sf_dir):
    path = new_folder(spark, "graph")
    files.write_parquet(parts(spark, sf_dir), path)
    return files.read_parquet(spark, path).edges


@query(f"with {FLOW} select w, count(*) as n from e group by w")
def weight_histogram(spark, sf_dir):
    return primitives.histogram(flow(spark, sf_dir).edges, "w")


@query(f"""with {FLOW}, p as (select * from e order by {hashed('a', 'b', seed=42)}, a, b limit 100)
select 'all' as part, count(*) as n, min(w) as least, avg(w) as mean, max(w) as greatest from e union all select 'sample', count(*), min(w), avg(w), max(w) from p""")
def weight_summary(spark, sf_dir):
    """Of all weights and of those of 100 edges in hashed order."""
    return files.weight_summary(flow(spark, sf_dir), 100)


@query("""with st as (select o_custkey trip, o_orderkey k, o_orderkey % 40 stop from orders),
ord as (select *, row_number() over (partition by trip order by k) r from st),
step as (select stop a, lead(stop) over w b, (lead(r) over w * 60 + lead(k) over w % 30) - (r * 60 + k % 30) t from ord window w as (partition by trip order by r))
select a as src, b as dst, min(t)::bigint as w from step where b is not null and t >= 0 and a <> b group by 1, 2""")
def transit(spark, sf_dir):
    """A customer's orders as a trip: the order's rest is the stop, its place in the row the minute."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    stops = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip_id"), place.alias("stop_sequence"), (F.col("o_orderkey") % 40).alias("stop_id"), "o_orderkey")
    minute, second = F.col("stop_sequence") % 60, F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0")
    clock = F.concat_ws(":", F.floor(F.col("stop_sequence") / 60).cast("string"), F.lpad(minute.cast("string"), 2, "0"), second)
    return generators.transit_edges(stops.withColumn("arrival_time", clock).withColumn("departure_time", clock))


# --- generators sized by the tables


def _rows(spark, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


U = f"({hashed('k', 'g')} % 1073741824 / 1073741824.0::double)"
QUADRANT = f"select k, sum(case when u >= 0.6 then 1 else 0 end << (sc - g)::int) x, sum(case when (u >= 0.5 and u < 0.6) or u >= 0.7 then 1 else 0 end << (sc - g)::int) y from (select k, g, sc, {U} u from (select ceil(log2(count(*)))::bigint sc, (select count(*) from orders) m from part), range(0, m) t(k), range(1, sc + 1) z(g)) group by k"
PAIRS = "select least(x, y)::bigint as src, greatest(x, y)::bigint as dst, min(w)::bigint as w from ({}) where x <> y group by 1, 2"


@query(PAIRS.format(f"select *, 1 w from ({QUADRANT})"))
def rmat(spark, sf_dir):
    """2 ** k vertices, as many as there are parts at least, and an edge for each order."""
    return generators.rmat(spark, math.ceil(math.log2(max(1, _rows(spark, sf_dir, "part")))), _rows(spark, sf_dir, "orders")).und()


ENDS = f"select {hashed('k', '1')} % n x, {hashed('k', '2')} % n y from (select (select count(*) from part) n, (select count(*) from orders) m), range(0, m) t(k)"


@query(PAIRS.format(f"select *, 1 + {hashed('least(x, y)', 'greatest(x, y)')} % 10 w from ({ENDS})"))
def erdos_renyi(spark, sf_dir):
    return generators.erdos_renyi(spark, _rows(spark, sf_dir, "part"), _rows(spark, sf_dir, "orders"), 10).und()


@query(f"""with recursive p as (select k, k // 3 src, {hashed('k')} % (2 * (k // 3) * 3) r from (select count(*) n from customer), range(3, 3 * n) t(k)),
q as (select k, src, case when r % 2 = 0 then r // 6 when r // 2 < 3 then 0 end d, case when r % 2 = 1 and r // 2 >= 3 then r // 2 end nx from p),
j(k, d, nx) as (select k, d, nx from q union all select j.k, q.d, q.nx from j join q on q.k = j.nx where j.d is null)
""" + PAIRS.format("select q.src x, j.d y, 1 w from j join q using (k) where j.d is not null"))
def barabasi_albert(spark, sf_dir):
    return generators.barabasi_albert(spark, _rows(spark, sf_dir, "customer"), 3).und()


# --- batches with queries


@query(f"with recursive {PART}, {CC} select p.a as u, p.b as v, x.l = y.l as connected from (select least(a, 1 + a // 2) a, greatest(a, 1 + a // 2) b from (select distinct a from s)) p join cc x on x.v = p.a join cc y on y.v = p.b")
def incremental_queries(spark, sf_dir):
    """Two batches of insertions; the second one's queries are answered after it."""
    g = parts(spark, sf_dir)
    state = connectivity.IncrementalComponents(g.vertices)
    batch = lambda k: g.und().where((F.col("src") + F.col("dst")) % 2 == k).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit("insert").alias("op"))
    state.process(batch(0))
    other = F.floor(F.col("id") / 2) + 1
    asked = g.vertices.select(F.least("id", other).alias("u"), F.greatest("id", other).alias("v"), F.lit("query").alias("op"))
    known = g.vertices.select("id")
    asked = asked.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    return state.process(batch(1).unionByName(asked.select("u", "v", "op")))


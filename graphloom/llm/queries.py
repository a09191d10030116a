"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.runtime import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.jaccard import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pieces import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.brown import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.tokens import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.personal import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lines import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op8_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.semantic import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffixes import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.periods import run_digest

    return run_digest(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.licenses import license_digest

    return license_digest(table(spark, sf_dir, "documents"))


def op13_interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.intervals import sale_sessions

    return sale_sessions(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) g from d),
n as (select d.doc_id, count(s.g) n from d left join s using (doc_id) group by d.doc_id),
p as (
  select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join n m on m.doc_id = x join n o on o.doc_id = y where 100 * c >= 75 * (m.n + o.n - c)),
e as (select x, y from l union all select y, x from l),
r(v, k) using key (v) as (
  select doc_id, doc_id from n union
  select e.y, min(r.k) from r join e on e.x = r.v join recurring.r o on o.v = e.y group by e.y, o.k having min(r.k) < o.k)
select n.doc_id, n.n as n_shingles, r.k as component_id from n join r on r.v = n.doc_id
"""


#: CRC-32 of a decimal number's text, a bit at a time
OP13_SQL = """
with c as (
  select client_id, ts, max(case when kind = 'click' then 1 else 0 end) k from clicks
  where client_id is not null and ts is not null group by client_id, ts),
g as (
  select *, case when ts - lag(ts) over w <= interval 5 minute then 0 else 1 end b from c window w as (partition by client_id order by ts)),
n as (select *, sum(b) over (partition by client_id order by ts) x from g),
r as (select client_id, min(ts) a, max(ts) z, max_by(k, ts) k from n group by client_id, x),
t as (
  select client_id, k, cast(floor(epoch_us(a) / 86400000000.0) as bigint) s,
    case when k = 1 then 1000000000 else cast(floor(epoch_us(z) / 86400000000.0) as bigint) end e,
    xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(epoch_us(a)::varchar, ''), lambda y: ord(y)::bigint)),
      lambda q, y: list_reduce(list_concat([xor(q, y)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda v, o: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end))) crc
  from r),
l as (select sale_id, max(shipped_at) m from sale_lines where sale_id is not null group by sale_id),
d as (
  select s.sale_id, s.client_id, case when s.status = 'held' then 1 else 0 end h, cast(floor(epoch_us(s.sold_at) / 86400000000.0) as bigint) s,
    case when s.status = 'held' then 1000000000 else cast(floor(epoch_us(greatest(s.sold_at, coalesce(l.m, s.sold_at))) / 86400000000.0) as bigint) end e
  from sales s left join l using (sale_id) where s.client_id is not null and s.sold_at is not null),
p as (
  select d.sale_id, t.crc, case when d.h = 1 and t.k = 1 then null else least(d.e, t.e) - greatest(d.s, t.s) + 1 end shared,
    case when d.s < t.s then case when d.e < t.e then 'overlaps' when d.e = t.e then 'finished_by' else 'contains' end
      when d.s = t.s then case when d.e < t.e then 'starts' when d.e = t.e then 'equals' else 'started_by' end
      else case when d.e < t.e then 'during' when d.e = t.e then 'finishes' else 'overlapped_by' end end relation
  from d join t on d.client_id = t.client_id and d.s <= t.e and t.s <= d.e)
select sale_id, relation, count(*) as n_pairs, sum(shared)::bigint as overlap_slots, sum(crc)::bigint as sessions_crc from p group by sale_id, relation
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op13_interval_overlaps": OP13_SQL}

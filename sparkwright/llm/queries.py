"""The queries of this subpackage: each operator over its whole table, with the parameters for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import ann, bpe, codes, lines, mixing, passages, quality, secrets, topk, urlfilter, warc, whitening
from sparkwright.llm.neardup import NearDup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""


#: The rules (verdict, host, path) and the listed hosts of op4.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return urlfilter.judge(_table(spark, sf_dir, "pages"), listed, RULES)


OP4_SQL = f"""
with split as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(verdict, h, p) as (values {", ".join(map(str, RULES))}),
listed(h) as (values {", ".join(f"('{h}')" for h in LISTED)}),
hosts as (
  select host, exists (select 1 from listed where host = h or ends_with(host, '.' || h)) as hit
  from (select distinct host from split)),
fits as (
  select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from (select distinct page_id, host, path from split) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by page_id, host, path)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, case when hosts.hit then 'block' else 'allow' end) as verdict
from split s join hosts on s.host = hosts.host
left join fits f on s.page_id is not distinct from f.page_id and s.host = f.host and s.path = f.path
"""


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDup(shingle=4).run(_table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) end as sh
  from w),
u as (select doc_id, len(sh) as n, unnest(sh) as one from s),
e as (
  select a.doc_id as x, b.doc_id as y from u a join u b on a.one = b.one and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(x, y) as (select doc_id, doc_id from s union select r.x, e.y from r join e on r.y = e.x)
select s.doc_id, len(sh)::bigint as n_shingles, min(r.y) as component_id, min(r.y) = s.doc_id as kept
from s join r on s.doc_id = r.x group by s.doc_id, sh
"""


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f
"""


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 is not drawn: sizes and targets."""
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: Sources reach their caps in the order of the level at which they do; a run of the first k of them is right if the level that is left reaches the k-th and not the next one.
MIX_TARGETS = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size) as n, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
every as (select sum(n) as n, sum(w) as w from s),
capped as (
  select k.cap, (any_value(every.n) - 3 * coalesce(sum(s.n) filter (3.0 * s.n / s.w <= k.cap), 0)) / nullif(any_value(every.w) - coalesce(sum(s.w) filter (3.0 * s.n / s.w <= k.cap), 0), 0) as level
  from (select 0.0 as cap union select 3.0 * n / w from s) k, s, every group by k.cap),
level as (select max(level) as level from capped)
select doc_id, size, s.n::bigint as source_size, round(least(3.0 * s.n, level * s.w), 3) as target from d join s on d.source is not distinct from s.source, level
"""


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def secret_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 is known by its form."""
    return op10_secret_scan(spark, sf_dir).drop("spans")


SECRET_FORMS = """
with kinds(kind, turn, pattern, least) as (values
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  ('access', 1, '(AKIA[A-Z0-9]+)', 16), ('hex', 2, '([0-9a-f]+)', 32)),
m as (
  select doc_id, kind, turn, least, string_split_regex(coalesce(text, ''), pattern) as between,
    regexp_extract_all(coalesce(text, ''), pattern, 0) as found,
    regexp_extract_all(coalesce(text, ''), pattern, 1) as value
  from documents, kinds),
e as (select *, unnest(range(1, len(found) + 1)) as i from m),
spans as (
  select doc_id, kind, turn, list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as low, length(found[i]) as size
  from e where length(value[i]) >= least),
g as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || low::bigint || ':' || (low + size)::bigint, ',' order by low, turn) as line
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(line, '')) as base_sha256 from documents d left join g using (doc_id)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(_table(spark, sf_dir, "embeddings"))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds without bounds: every part against every entry, ties to the lower index."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select id, part, arg_min(k, (d, k)) as k, min(d) as d from (
    select v.id, v.part, c.k, list_sum(list_transform(list_zip(v.xs, c.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v join c{r} c on v.part = c.part)
  group by id, part)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} as materialized (
  select c.part, c.k, coalesce(m.xs, c.xs) as xs from c{r} c left join (
    select part, k, list(x order by pos) as xs from (
      select part, k, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x
      from (select v.part, a.k, unnest(range(1, len(v.xs) + 1)) as pos, unnest(v.xs) as x from v join a{r} a using (id, part)) group by part, k, pos)
    group by part, k) m on c.part = m.part and c.k = m.k)""")
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as id, vec_id, label, [floor(4096 * x::double)::hugeint for x in embedding] as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (
  select id, p.part, e[p.part * (len(e) // {parts}) + 1 : (p.part + 1) * (len(e) // {parts})] as xs from kept, (select unnest(range({parts})) as part) p),
c0 as materialized (select part, id - 1 as k, xs from v where id <= {entries}),{",".join(steps)},
s as (select id, string_agg(printf('%02x', k::int), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by id),
h as (select sha256(string_agg(array_to_string(xs, ','), ',' order by part, k)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from s join kept using (id), h
"""


OP12_SQL = _op12_sql()


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files, in order, make up to four batches."""
    docs = _table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    size = -(-len(files) // 4)
    batches = [spark.read.schema(docs.schema).parquet(*files[i : i + size]) for i in range(0, len(files), size)] if size else None
    return lines.drop_lines(docs, batches).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
with l as (
  select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{urlfilter.UPPER}', '{urlfilter.LOWER}') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_top_k, op4_url_filter, op5_near_dup, op6_passages, op7_warc, op8_source_mix, op9_nearest, op10_secret_scan, op11_whitening, op12_vector_codes, op13_line_dedup, mix_targets, secret_forms)}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_near_dup": OP5_SQL, "op7_warc": OP7_SQL, "op12_vector_codes": OP12_SQL, "op13_line_dedup": OP13_SQL, "mix_targets": MIX_TARGETS, "secret_forms": SECRET_FORMS}

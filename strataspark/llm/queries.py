"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable
from . import ann, decontam, html_text, license_scan, mixing, pii, quality, sharding, substring_dedup
from .near_dedup import NearDuplicates


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles at 80 per cent."""
    return NearDuplicates(words=2, percent=80).run(_read(spark, sf_dir, "documents"))


#: The key of the registered query; a real run brings its own secret.
PII_KEY = b"strataspark surrogate key"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data and secrets replaced by surrogates."""
    return pii.replace_entities(_read(spark, sf_dir, "documents"), PII_KEY)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that started earlier, in three batches with a compaction."""
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), batches=3, digest=True, max_runs=2)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart, uniformly shuffled.

    The method shuffles rows one by one, so its law is ``rows`` and equal texts aren't kept together.
    """
    out = sharding.shard_rows(_read(spark, sf_dir, "documents"), 16, seed=5)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorisation machine scores of all documents."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    scores = quality.score(docs, model)
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy drawn when sources are mixed to the square root of their masses, in shuffled order."""
    docs = _read(spark, sf_dir, "documents")
    out = mixing.mix_sources(docs, alpha=0.5, seed=8, with_copy=True)
    return out.select("doc_id", "source", F.round("rate", 6).alias("rate"), F.col("copy").cast("long").alias("copy"), "shuffle_key")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document leaks within 15 per cent of word edits."""
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), rate=0.15, recall=0.99)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose id is divisible by 20."""
    embeddings = _read(spark, sf_dir, "embeddings")
    return ann.NeighbourGraph(embeddings, k=20).search(embeddings.where("vec_id % 20 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_near_duplicates, op3_pii_surrogates, op4_substring_dedup, op5_shards, op6_html_text, op7_quality, op8_mix_sources, op9_decontamination, op10_neighbours)
    return {f.__name__: f for f in found}


def _op1() -> str:
    """All blocks against all templates, without the operator's filters."""
    rows = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
with words as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
templates(t, label, tw) as (values {rows}),
blocks as (select id, list_distinct(w[s + 1 : s + {license_scan.BLOCK}]) as b from (select id, w, unnest(range(0, greatest(len(w) - {license_scan.STRIDE}, 1), {license_scan.STRIDE})) as s from words)),
shares as (
  select id, label, max(len(list_intersect(b, tw)) / len(list_distinct(tw))::double) as share
  from blocks, templates where len(list_intersect(b, tw)) >= ceil({license_scan.THETA} * len(list_distinct(tw)) - 1e-9) group by id, label),
places as (
  select id, i, case when w[i + 1] = 'mit' then 'mit' when w[i + 1] = 'apache' then 'apache' else 'gpl' end as label
  from (select id, w, unnest(range(0, len(w))) as i from words)
  where (w[i + 1] in ('mit', 'apache') and w[i + 2] = 'license') or (w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license')),
base as (select id, count(*) as n, min(i) as lo, max(i) as hi, list(distinct label) as labels from places group by id),
found as (select id, list(distinct label) as labels, max(share) as share from shares group by id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
  case when b.n > 0 then 1.0::double else coalesce(f.share, 0.0)::double end as score
from words w left join base b on w.id = b.id left join found f on w.id = f.id
"""


#: References as in HTML, where the old names go without a semicolon too.
_OP6 = r"""
with blocks as (
  select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') as raw from pages),
texts as (
  select page_id, url, list_filter(list_transform(raw, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', chr(39), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') as bs
  from blocks)
select page_id, url, array_to_string(bs, chr(10)) as text, length(array_to_string(bs, chr(10)))::bigint as n_chars from texts
"""
#: Words as in the operator: lists of an empty text are emptied first.
_OP2 = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as i
  from items x join items y on x.g = y.g and x.doc_id < y.doc_id and 100 * x.n >= 80 * y.n and 100 * y.n >= 80 * x.n
  group by 1, 2),
links as (select a, b from shared where 100 * i >= 80 * (na + nb - i)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, root) as (
  select a, a from both_ways
  union
  select e.b, r.root from reach r join both_ways e on e.a = r.node),
comp as (select node, min(root) as root from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.root, s.doc_id) as component_id, coalesce(c.root, s.doc_id) = s.doc_id as kept
from sets s left join comp c on c.node = s.doc_id
"""


_OP4 = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i as start, array_to_string(w[i + 1 : i + 20], ' ') as seq from (select doc_id, w, unnest(range(0, len(w) - 19)) as i from words)),
ranked as (
  select doc_id, start, min((doc_id, start)) over (partition by seq) as first from windows),
covered as (
  select distinct doc_id, unnest(range(start, start + 20)) as p from ranked where (doc_id, start) > first),
gone as (select doc_id, list(p) as ps from covered group by doc_id),
kept as (
  select w.doc_id, len(w.w) as n, coalesce(len(g.ps), 0) as r,
    case when g.ps is null then w.w else (select list(x.v order by x.p) from (select unnest(w.w) as v, unnest(range(0, len(w.w))) as p) x where not list_contains(g.ps, x.p)) end as k
  from words w left join gone g on w.doc_id = g.doc_id)
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
"""
_OP8 = r"""
with recursive masses as (
  select source, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as mass from documents group by source),
rates as (
  select source, sum(mass) over () * pow(mass::double, 0.5) / (sum(pow(mass::double, 0.5)) over () * mass) as rate from masses),
parts as (select source, rate, greatest(1, ceil(rate / 256))::int as parts from rates),
cdf(source, rate, parts, k, last, term, f) as (
  select source, rate, parts, 0, ceil(rate / parts + 12 * sqrt(rate / parts) + 40)::int, exp(-rate / parts), exp(-rate / parts) from parts
  union all
  select source, rate, parts, k + 1, last, term * (rate / parts) / (k + 1), f + term * (rate / parts) / (k + 1) from cdf where k < last),
lists as (select source, any_value(rate) as rate, any_value(parts) as parts, list(f order by k) as cdf from cdf group by source),
draws as (
  select d.doc_id, d.source, l.rate,
    list_sum(list_transform(range(1, l.parts + 1), lambda i: len(list_filter(l.cdf, lambda c: c <= cast('0x' || substr(md5('draw8|' || coalesce(d.doc_id::varchar, 'null') || '|' || i), 1, 13) as bigint) / 4503599627370496.0))))::bigint as n
  from documents d join lists l on d.source is not distinct from l.source),
copies as (select doc_id, source, rate, unnest(range(1, n + 1)) as copy from draws)
select doc_id, source, round(rate, 6) as rate, copy, cast('0x' || substr(md5('order8|' || coalesce(doc_id::varchar, 'null') || '|' || copy), 1, 13) as bigint) as shuffle_key
from copies
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1(), "op6_html_text": _OP6, "op2_near_duplicates": _OP2, "op4_substring_dedup": _OP4, "op8_mix_sources": _OP8}

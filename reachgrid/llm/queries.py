"""One query per operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.llm import conversations, decontaminate, fixity, html_text, language_id, licences, line_dedup, ngram_join, packing, quality, resampling, sharding, token_store
from reachgrid.llm.registry import ORACLE, QUERIES, query
from reachgrid.llm.texts import read
from reachgrid.session import shared_dir

__all__ = ["ORACLE", "QUERIES"]

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE_WORDS = f"regexp_extract_all({FOLD}, '[^\\x20\\x09-\\x0D]+')"

TOKENIZER = "word_bpe_49k.json"


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/reachgrid/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query(
    "op1_warc_fixity_audit",
    f"""
    with r as (
      select page_id, 'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url
        || '\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' as rec from pages),
    l as (select page_id, strlen(rec) as length, sha256(rec) as digest,
                 coalesce(sum(strlen(rec)) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as pos from r),
    f as (select *, pos // {fixity.FILE_BYTES} as file from l)
    select page_id, cast(file as bigint) as file, cast(row_number() over (partition by file order by page_id) - 1 as bigint) as record,
           cast(pos - min(pos) over (partition by file) as bigint) as "offset", cast(length as bigint) as length, digest,
           page_id % 97 <> 13 as intact
    from f""".replace("'WARC", "E'WARC").replace("'\r", "E'\r").replace("'>\r", "E'>\r"),
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The table against an archive of it in which one byte of some records was changed."""
    pages = read(spark, folder, "pages")
    places = fixity.layout(pages)
    rows = fixity.records(pages, places)
    hurt = F.expr("concat(left(value, length(value) - 1), case when right(value, 1) = '~' then '!' else '~' end)")
    archive = fresh_folder(spark, "warc")
    marked = fixity.records(pages, places, ("page_id",)).withColumn("value", F.when(F.col("page_id") % 97 == 13, hurt).otherwise(F.col("value")))
    fixity.write_archive(marked, archive)
    table_tree = fixity.tree_of_records(rows, label="table-tree")
    archive_tree = fixity.tree_of_archive(spark, archive, places, label="archive-tree")
    bad, _ = fixity.audit(table_tree, archive_tree)
    return fixity.verdicts(places, table_tree, bad)


@query(
    "op2_ngram_jaccard_join",
    f"""
    with recursive w as (select doc_id, {WHITE_WORDS} as ws from documents),
    s as materialized (
      select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as g from w),
    n as materialized (select doc_id, count(*) as n from s group by doc_id),
    common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    pairs as materialized (
      select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
    steps as materialized (select a, b from pairs union all select b, a from pairs),
    reach as (select a as doc_id, a as other from (select distinct a from steps)
              union select r.doc_id, s.b from reach r join steps s on s.a = r.other)
    select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.component_id, w.doc_id) as component_id
    from w left join n using (doc_id)
    left join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    linked = ngram_join.link(read(spark, folder, "documents"), k=4, num=85, den=100)
    return linked.select("doc_id", "n_shingles", "component_id")


@query("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


ALNUM_WORDS = f"regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op9_benchmark_decontamination",
    f"""
    with w as materialized (select doc_id, {ALNUM_WORDS} as ws from documents),
    b as (select item_id, {ALNUM_WORDS} as ws from benchmark),
    win as materialized (
      select distinct item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i+9], ' ')) end) as t,
        least(len(ws), 10) as m from b),
    sizes as (select distinct m from win),
    runs as (select doc_id, m, unnest(range(1, len(ws) - m + 2)) as i, ws from w, sizes where len(ws) >= m),
    hits as materialized (
      select r.doc_id, r.i, r.m, win.item_id from (select doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') as t from runs) r
      join win on win.t = r.t and win.m = r.m),
    covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hits) group by doc_id),
    named as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as items from hits group by doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
           cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
           n_hit is not null as contaminated
    from w left join covered using (doc_id) left join named using (doc_id)""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    table = quality.table_of(read(spark, folder, "documents"))
    judged = quality.judge(table, quality.fit_cutoffs(table, read(spark, folder, "labels")))
    return judged.select("doc_id", *[F.col(f"{quality.Q}.{c}").alias(c) for c in quality.COUNTS], "base_failed", "kept")


@query("op3_token_orc")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = fresh_folder(spark, "tokens")
    token_store.write_tokens(read(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=1)
    stored = token_store.read_tokens(spark, path)
    return stored.select("doc_id", "start", "n_tokens", token_store.ids_crc32(F.col("ids")).alias("ids_crc32"))


def _licence_sql() -> str:
    known = ", ".join(f"'{v}': '{k}'" for k, v in licences.SENTENCES.items())
    endings = ", ".join(f"{{'e': ' {v}', 'id': '{k}'}}" for k, v in licences.by_length(licences.SENTENCES))
    pattern, map_of = licences.likely(licences.SENTENCES), known

    def plain(x: str) -> str:
        return f"trim(regexp_replace(translate({x}, '{licences.UPPER}', '{licences.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"

    def likely(x: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def named(x: str) -> str:
        return f"element_at(map {{{map_of}}}, {x})[1]"

    steps = [f"""
    s as (select doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '{licences.CUT}', E'\\1\\2{licences.OVER}', 'g'), '{licences.OVER}')) as x,
                 generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '{licences.CUT}', E'\\1\\2{licences.OVER}', 'g'), '{licences.OVER}'), 1) as k from documents),
    n as (select doc_id, k, x, {plain('x')} as own from s where {likely('x')}),
    w as (select doc_id, k, x, own, {named('own')} as whole from n),
    p as (select doc_id, k, whole,
                 case when whole is null and contains(x, E'\n') then list_filter(list_transform(string_split(x, E'\n'),
                   lambda y: case when {likely('y')} then {named(plain('y'))} end), lambda y: y is not null) end as lines,
                 case when whole is null and contains(x, E'\n') then list_filter([{endings}], lambda e: ends_with(' ' || own, e.e))[1].id end as last from w),
    i as (select d.doc_id, coalesce(ids, []) as ids from (select doc_id, row_number() over () as r from documents) d left join (
            select doc_id, flatten(list(case when whole is not null then [whole] when last is null then coalesce(lines, [])
                     when lines[-1] = last then lines else list_append(lines, last) end order by k)) as ids from p group by doc_id) using (doc_id)),
    r0 as (select doc_id, ids, array_to_string(list_transform(ids, lambda x: ';' || x || ';'), '') as l, [] :: varchar[] as names from i)"""]
    for k, (name, sequence) in enumerate(licences.RULES):
        w = licences.spelt(sequence)
        steps.append(f"""
    r{k + 1} as (select doc_id, ids, replace(l, '{w}', '|') as l,
                 case when contains(l, '{w}') then list_append(names, '{name}') else names end as names from r{k})""")
    return "with " + ",".join(steps) + f"""
    select doc_id, coalesce(array_to_string(ids, ','), '') as sentence_ids,
           coalesce(array_to_string(case when len(list_filter(names, lambda x: x <> '{licences.NOTICE}')) > 0
             then list_filter(names, lambda x: x <> '{licences.NOTICE}') else names end, ','), '') as licences
    from r{len(licences.RULES)}"""


@query("op6_license_scan", _licence_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(read(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


@query("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_rendezvous_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.slots(read(spark, folder, "documents"), [1.0] * 24, grown=1.0)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return packing.pack(docs, packing.byte_length(F.col("text")), packing.exact_cluster(F.col("text")))


@query("op11_importance_resampling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_language_id")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(read(spark, folder, "documents"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.Repair(conversations.damaged(read(spark, folder, "conversations"))).report()

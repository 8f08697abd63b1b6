"""The registered queries of the training-data operators, with their production parameters and check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import ann, brown, conversation_sql, decontam, fm_dedup, langid, lines, neardup, packing, prefix_trie, repair, simhash, suffix_dedup, urls

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(doc_id, folds: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge_urls(_table(spark, folder, "pages"), URL_RULES, model, ["page_id"])


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"])
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.array_min("items").alias("item_id"), "items")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), SEQUENCE)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(fold_of("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.predict(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"), 50, digest=True)


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, folder, "embeddings"), 10, 100)


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score_documents(_table(spark, folder, "documents"))


def op9_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    return fm_dedup.remove_repeated_words(_table(spark, folder, "documents"), 35, digest=True)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_boilerplate(_table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(_table(spark, folder, "conversations")))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.shared_prefix_trie(_table(spark, folder, "conversations"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


_SPACE = r"'[\x20\x09-\x0D]+'"
_LINES_SQL = rf"""
with pages as (select row_number() over () as r, doc_id, text, coalesce(source, chr(1)) as site from documents),
lines as (
    select r, doc_id, site, text, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from pages
),
trimmed as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as t from lines),
totals as (select site, count(distinct coalesce(text, '')) as pages from pages group by 1),
common as (
    select site, t from (select site, t, count(distinct text) as n from trimmed where t <> '' group by 1, 2) join totals using (site)
    where n >= {lines.LEAST_PAGES} and n > {lines.MOST_SHARE} * pages
),
found as (select l.*, c.t is not null as common from trimmed l left join common c on c.site = l.site and c.t = l.t),
flagged as (
    select *, common and not sum(case when common then length(t) else 0 end) over (partition by r)
        > {lines.MOST_OF_PAGE} * sum(length(t)) over (partition by r) as dropped from found
),
per_page as (
    select r, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
        coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '') as kept
    from flagged group by r
)
select p.doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(n_dropped, 0)::int as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from pages p left join per_page using (r)
"""

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_NEAR_SQL = f"""
with recursive words as (select doc_id, {_WORDS_SQL} as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
    from words
),
sizes as (select doc_id, len(s) as n from sets),
shingles as (select doc_id, unnest(s) as g from sets),
both_have as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select a, b from both_have join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)
),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a)
select doc_id, n::bigint as n_shingles, component_id, doc_id = component_id as kept from sizes join least on a = doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [
        op1_url_filter, op2_decontamination, op3_packing, op4_language_id, op5_minhash, op6_suffix_array, op7_nearest_neighbours,
        op8_lm_scoring, op9_fm_index, op10_line_dedup, op11_conversation_repair,
        op12_prefix_trie, op13_simhash,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op10_line_dedup": _LINES_SQL, "op5_minhash": _NEAR_SQL}
    found |= {"op11_conversation_repair": conversation_sql.REPAIR, "op12_prefix_trie": conversation_sql.TRIE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

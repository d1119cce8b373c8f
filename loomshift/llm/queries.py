"""The queries of the subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_near_dedup

    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).drop("text", "mix_source")


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weaklabel import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *train(docs))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_dedup

    deduped = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_toxic", "expected_severity", "grade", "toxic")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenbin import token_binary

    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_pii_spans": op2_pii_spans,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_weak_label_quality": op5_weak_label_quality,
    "op6_sentencepiece_codec": op6_sentencepiece_codec,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_binary": op10_token_binary,
}
SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        with recursive v as (select vec_id, embedding::double[] as e from embeddings),
        ok as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
        links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
        reach as (select vec_id as node, vec_id as other from v union select r.node, l.b from reach r join links l on l.a = r.other),
        component as (select node, min(other) as component_id from reach group by node),
        counted as (select a, count(*) as n from links group by a)
        select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join component on node = vec_id left join counted on a = vec_id""",
    "op8_line_dedup": """
        with raw as (select doc_id, string_split(text, chr(10)) as lines from documents),
        lines as (select doc_id, unnest(lines) as raw, generate_subscripts(lines, 1) as line from raw),
        sets as (select doc_id, line, raw, list_sort(list_distinct(list_filter(string_split_regex(raw, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) as words from lines),
        classes as (select doc_id, line, words, row_number() over (order by doc_id, line) as id from sets where len(words) > 0 qualify row_number() over (partition by words order by doc_id, line) = 1),
        often as (select word, count(*) as n from (select unnest(words) as word from classes) group by word),
        placed as (select id, c.word, len(words) as size, row_number() over (partition by id order by n, c.word) as place from (select id, words, unnest(words) as word from classes) c join often using (word)),
        first as (select id, word, size from placed where place <= size - ceil(0.8 * size - 1e-9) + 1),
        pairs as (select distinct y.id as y, x.id as x from first y join first x on y.word = x.word and x.id < y.id and least(x.size, y.size) >= 0.8 * greatest(x.size, y.size) - 1e-9),
        late as (select distinct y as id from (select p.y, len(list_intersect(a.words, b.words)) as n, len(a.words) + len(b.words) as total from pairs p join classes a on a.id = p.y join classes b on b.id = p.x) where n >= 0.8 * (total - n) - 1e-9),
        stays as (select doc_id, line from classes anti join late using (id) union all select doc_id, line from sets where len(words) = 0),
        left_over as (select s.doc_id, string_agg(raw, chr(10) order by s.line) as text, count(*) as n from sets s join stays using (doc_id, line) group by s.doc_id)
        select d.doc_id, coalesce(len(lines), 0)::int as n_lines, (coalesce(len(lines), 0) - coalesce(n, 0))::int as n_removed_lines, case when lines is not null then sha256(coalesce(l.text, '')) end as text_sha256
        from raw d left join left_over l using (doc_id)""",
}

"""Registered queries of the subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.llm.url_rules import TASK_RULES, TASK_SQL
from tremor.sources.tables import load_table

#: all anchors against all rows, in whole numbers
TASK_NEGATIVES_SQL = """
with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as v
           from embeddings
           where vec_id is not null and label is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
      from r a join r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::integer as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
     and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@_register("op2_bpe_transducer")
def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.bpe import bpe_round_trip
    return bpe_round_trip(load_table(spark, sf_dir, "documents"))


@_register("op3_retrieval_packing")
def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.packing import pack_documents
    return pack_documents(load_table(spark, sf_dir, "documents"))


@_register("op4_jaccard_components")
def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.jaccard_join import jaccard_components
    return jaccard_components(load_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@_register("op10_secret_worklist")
def op10_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.secret_scan import scan_documents
    return scan_documents(load_table(spark, sf_dir, "documents"))


@_register("op9_ngram_likelihood_ratio")
def op9_ngram_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.quality import judge, quality_ratio
    docs = load_table(spark, sf_dir, "documents")
    return judge(docs, quality_ratio(docs, load_table(spark, sf_dir, "labels")))


@_register("op1_projection_tree_search")
def op1_projection_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tremor.llm.ann import nearest
    return nearest(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_register("op7_url_rules", TASK_SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.url_rules import judge_urls, rules_table
    return judge_urls(load_table(spark, sf_dir, "pages"), rules_table(spark, TASK_RULES))


@_register("op6_language_families")
def op6_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.language import fit, identify
    docs = load_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


@_register("op5_boosted_toxicity")
def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.toxicity import score_documents
    return score_documents(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@_register("op8_license_windows")
def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.licenses import best_licenses
    return best_licenses(load_table(spark, sf_dir, "documents"))


@_register("op11_simhash_components")
def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.simhash import simhash_components
    return simhash_components(load_table(spark, sf_dir, "documents"), n=3, radius=2)


@_register("op12_range_tree_negatives", TASK_NEGATIVES_SQL)
def op12_range_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tremor.llm.hard_negatives import mine
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return mine(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label).drop("anchor_row")


@_register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.llm.conversations import repair_conversations
    return repair_conversations(load_table(spark, sf_dir, "conversations"))

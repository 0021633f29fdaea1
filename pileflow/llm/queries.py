"""The ten operators as queries over their whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pileflow.llm import caps, jaccard, langid, maxent, mixing, packing, quality, secrets, token_counts, topk


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack(s, _docs(s, d)),
        "op2_language_id": lambda s, d: langid.identify(s, _docs(s, d)),
        "op3_token_counts": lambda s, d: token_counts.count_tokens(_docs(s, d)),
        "op4_quality_classifier": lambda s, d: quality.classify(s, _docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op5_lm_scoring": lambda s, d: maxent.lm_scores(s, _docs(s, d)),
        "op6_mixing": lambda s, d: mixing.mix(s, _docs(s, d))[0],
        "op7_exact_top_k": lambda s, d: topk.top_k(s, _vectors(s, d)),
        "op8_secret_scans": lambda s, d: secrets.find_secrets(_docs(s, d)),
        "op9_ngram_jaccard_join": lambda s, d: jaccard.near_duplicates(s, _docs(s, d)),
        "op10_embedding_near_dedup": lambda s, d: caps.cap_links(s, _vectors(s, d)),
    }


_FINITE = "{0} is not null and len(list_filter({0}, lambda x: x is null or not isfinite(x))) = 0"
#: Every node that links lead to, from the table ``links`` of both directions.
_REACHED = "reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a)"

TOP_K = f"""with whole as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where {_FINITE.format("embedding")}),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from whole q join whole c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) r where rank <= 10"""

JACCARD = rf"""with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingled as (select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as s from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from worded where len(w) > 0) u),
sizes as (select doc_id, count(*) as n from shingled group by 1),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as both_have from shingled x join shingled y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from shared join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * both_have >= 75 * (m.n + n.n - both_have)),
{_REACHED}
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, least(d.doc_id, min(r.b)) as component_id from documents d left join sizes s on s.doc_id = d.doc_id left join reached r on r.a = d.doc_id group by d.doc_id"""

CAPS = f"""with recursive good as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where {_FINITE.format("embedding")} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACHED}
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, least(e.vec_id, min(r.b)) as component_id, e.vec_id = least(e.vec_id, min(r.b)) as kept from embeddings e left join reached r on r.a = e.vec_id group by e.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": TOP_K, "op9_ngram_jaccard_join": JACCARD, "op10_embedding_near_dedup": CAPS}

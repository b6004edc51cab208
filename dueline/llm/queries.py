"""One query per operator over its whole table, and the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.llm.exact_dedup import mark_duplicates
from dueline.llm.hard_negatives import mine, relabelled
from dueline.llm.licenses import scan_licenses, scan_sql
from dueline.llm.main_text import extract
from dueline.llm.mixing import mix
from dueline.llm.packing import pack
from dueline.llm.pii import find_personal_data
from dueline.llm.quality import score
from dueline.llm.shared import LOWER, UPPER, read
from dueline.llm.simhash import near_duplicates
from dueline.llm.token_counts import count_tokens
from dueline.llm.token_files import read_files, write_files
from dueline.llm.topk import top_k
from dueline.llm.whitening import whitened_components
from dueline.plans.shared import shared_folder

#: Target shares of the mixture; all sources that aren't named share the rest.
RECIPE = {"src0": 0.10, "src1": 0.15, "src2": 0.15, "src3": 0.10, "src4": 0.05}
REST = 0.45
SEED = 42


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    manifest = write_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_files(spark, manifest, with_ids=False)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), RECIPE, REST, seed=SEED, details=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read(spark, sf_dir, "embeddings"), k=8)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", relabelled(F.col("label"), F.col("vec_id")))
    return mine(vectors, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_license_scan,
        op3_pii,
        op4_token_files,
        op5_topk,
        op6_packing,
        op7_token_counts,
        op8_quality,
        op9_mix_sources,
        op10_simhash,
        op11_embedding_whitening,
        op12_html_extraction,
        op13_hard_negatives,
    )
}

_SHARES = " ".join(f"when '{name}' then {share / (sum(RECIPE.values()) + REST)!r}::double" for name, share in RECIPE.items())
_NAMES = ", ".join(f"'{name}'" for name in RECIPE)

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') x from documents),
g as (select x, max(doc_id) keep_id, count(*) group_size, sha256(x) text_sha256 from t group by x)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id kept, text_sha256 from t join g using (x)
""",
    "op2_license_scan": scan_sql(),
    "op5_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
                  list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) e from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id anchor_id, c.vec_id, q.label = c.label same,
             cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) rank, vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify rank <= 10
""",
    "op9_mix_sources": f"""
with d as (select doc_id, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) id, length(coalesce(text, '')) n,
                  case when source in ({_NAMES}) then source else 'other' end source_key from documents),
z as (select source_key, sum(n) n, sum(sum(n)) over () total from d group by source_key),
r as (select source_key, case when total = 0 then 1.0::double when n = 0 then 0.0::double else 1.0::double * total::double
             * (case source_key {_SHARES} else {REST / (sum(RECIPE.values()) + REST)!r}::double end) / n::double end rate from z),
m as (select *, cast(greatest(1, ceil(rate / 64.0)) as integer) draws from r),
p as (select source_key, rate, draws, rate / draws mean, k,
             exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)) pmf
      from m, unnest(range(0, cast(ceil(rate / draws + 12 * sqrt(rate / draws) + 24) as integer) + 1)) u(k)),
c as (select source_key, rate, draws, list(s) cdf from (select *, sum(pmf) over (partition by source_key order by k) s from p) group by all),
n as (select doc_id, id, source_key, rate, cast(list_sum([len(list_filter(cdf, lambda s: s <= ('0x' || substr(md5('{SEED}|' || id || '|' || i), 1, 13))::bigint / 4503599627370496.0))
             for i in range(1, draws + 1)]) as integer) copies from d join c using (source_key))
select doc_id, source_key, rate, copies, cast(copy as integer) copy, md5('order {SEED}|' || id || '|' || copy) shuffle_key
from n, unnest(range(1, copies + 1)) u(copy)
""",
}

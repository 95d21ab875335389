"""One query per operator over its whole table, with production parameters, and SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import all_turns, format_digests
from .common import held_out, stage
from .decontaminate import contaminated_passages
from .html_text import extract_main_text
from .language_id import fit_language_id, identify_language
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_components
from .quality import fit_quality, score_quality
from .token_rollup import TokenRollup, count_tokens, inserts, revisions
from .tokenizer import DEFAULT_VOCABULARY, read_vocabulary
from .toxicity import fit_toxicity, score_toxicity
from .vector_search import nearest_neighbours


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return identify_language(docs, fit_language_id(docs.where(~held_out(F.col("doc_id")))))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_read(spark, sf_dir, "documents"), n=5, share=75)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), least=0.5)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_digests(all_turns(_read(spark, sf_dir, "conversations")), read_vocabulary(DEFAULT_VOCABULARY))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels), threshold=0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score_quality(docs, fit_quality(docs, labels), threshold=0.3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents with counts guessed from their length, revises them to true counts, and repeats a batch, which does nothing."""
    version = "byte_bpe_50k"
    docs = _read(spark, sf_dir, "documents")
    guessed = docs.select("source", "lang", F.coalesce(F.col("n_chars"), F.lit(0)).cast("long").alias("n_tokens"))
    counted = stage(count_tokens(docs, read_vocabulary(DEFAULT_VOCABULARY)), "token-counts")
    rollup = TokenRollup(spark)
    rollup.commit("load", inserts(guessed, version))
    rollup.commit("count", revisions(guessed, counted, version))
    rollup.commit("load", inserts(guessed, version))
    rollup.compact()
    return rollup.totals()


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), weights=[1.0, 2.0, 3.0], epochs=3, seed=42).drop("source")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from words
), grams as (
  select doc_id, unnest(g) x from sets
), pairs as (
  select a.doc_id a, b.doc_id b, count(*) k from grams a join grams b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join sets s on s.doc_id = a join sets t on t.doc_id = b where 100 * k >= 75 * (len(s.g) + len(t.g) - k)
), ends as (
  select a, b from links union select b, a from links
), reach as (
  select a, b from ends union select r.a, e.b from reach r join ends e on r.b = e.a
)
select s.doc_id, cast(len(any_value(s.g)) as bigint) n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) component_id
from sets s left join reach r on r.a = s.doc_id group by s.doc_id
""",
    "op9_mix_sources": r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
    cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) k
  from documents
), totals as (
  select source, cast(sum(size) as bigint) source_size, row_number() over (order by source is null, source) i from sized group by source
), caps as (
  select *, cast((i - 1) % 3 + 1 as double) weight, cast(source_size as double) * 3 cap, cast(source_size as double) * 3 / cast((i - 1) % 3 + 1 as double) f from totals
), levels as (
  select *, (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by f, weight, i rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by f, weight, i rows between current row and unbounded following) lev
  from caps
), plan as (
  select *, least(cap, (select arg_min(lev, f) from levels where lev <= f) * weight) target from levels
), cuts as (
  select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end rounds from plan
), run as (
  select s.doc_id, s.size, c.source_size, c.target, c.rounds, greatest(cast(floor(c.target) as bigint) - c.rounds * c.source_size, 0) rest,
    coalesce(sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) before
  from sized s join cuts c on s.source is not distinct from c.source
)
select doc_id, size, source_size, target, cast(rounds * size + least(greatest(rest - before, 0), size) as bigint) taken from run
""",
}

"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tightknit.llm import (
    bpe,
    decontamination,
    hard_negatives,
    jaccard_join,
    language_id,
    paragraph_dedup,
    ppm,
    quality_model,
    quality_rules,
    simhash,
    spelling,
    suffix_dedup,
    token_counts,
)
from tightknit.llm.batches import crc_of_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), crc_of_id() % 5 == 0
    model = quality_model.train_on(docs, table(spark, sf_dir, "labels"), ~out)
    return quality_model.score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = paragraph_dedup.without_repeated_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, p: n + p["n_words"]).alias("n_words_removed"),
        F.array_distinct(F.transform("removed", lambda p: p["first_doc_id"])).alias("first_doc_ids"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), crc_of_id() % 4 == 2
    net = language_id.train_on(docs, ~out)
    return language_id.identify(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=moved)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.counted_words(table(spark, sf_dir, "documents")))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_bpe": op6_bpe,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_language_id": op9_language_id,
        "op10_quality_rules": op10_quality_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_simhash_dedup": op13_simhash_dedup,
    }


#: White space between words, as the character class of both engines.
BLANK = r"[\x20\x09-\x0D]"

OP10_SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (
  select r, list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '') as w from texts),
windows as (
  select r, i, w[i:i + 4] as five from (select r, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, five) as n from windows) where n > 1),
repeats as (
  select r, count(*) as n from (select distinct r, i + unnest(range(5)) as at from twice) group by r),
lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup
  from (select r, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_replace(line, '{BLANK}', '', 'g') <> '' group by r),
base as (
  select t.doc_id, len(w.w)::bigint as n_words,
    length(regexp_replace(text, '{BLANK}', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(l.n_dup, 0)::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words,
    coalesce(l.n_lines, 0) as n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper_letters,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters,
    length(regexp_replace(text, '[^0-9]', '', 'g')) as digits,
    length(regexp_replace(text, '[^!?]', '', 'g')) as bangs
  from texts t join words w using (r) left join lines l using (r) left join repeats p using (r)),
failed as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= 3 * n_words and 10 * n_dup_lines <= 3 * n_lines
  and word_chars <= 15 * n_words and word_chars >= 2 * n_words and 2 * upper_letters <= letters
  and 2 * digits <= word_chars and 10 * bangs <= 5 * n_words as kept
from failed"""


#: Words as in the contract, and every window of every item with its occurrences.
OP1_SQL = r"""
with spelled as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
items as (
  select item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 13) as size, w[i:i + least(len(w), 13) - 1] as part
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select r, i, size, w[i:i + size - 1] as part
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from spelled, sizes where len(w) >= size)),
found as (
  select r, i, p.size, item_id from places p join windows v on p.size = v.size and p.part = v.part),
hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from found) group by r),
ids as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct r, item_id from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from spelled left join hit using (r) left join ids using (r)"""


#: Every anchor against every row, and the windows as they are stated.
OP11_SQL = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
    coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])), 0)::bigint as score
  from vectors a join vectors r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select * from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, p.other_id as positive_id,
  row_number() over (partition by anchor_id, p.other_id order by n.score desc, n.other_id)::int as rank,
  n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n using (anchor_id)
where not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5"""

#: crc32 byte by byte, and neighbors by the parts around the edited character.
OP12_SQL = """
with recursive steps(b, i, c) as (
  select b, 0, b from range(256) t(b)
  union all select b, i + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where i < 8),
crc as (select list(c order by b) as t from steps where i = 8),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')) as run from documents),
lowered as (
  select translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, id, count(*) as n from runs group by all),
hashed as (
  select run, n, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(id || ':' || run))),
        lambda i: ('0x' || hex(encode(id || ':' || run))[2 * i + 1:2 * i + 2])::bigint)),
      lambda acc, x: xor(acc >> 8, crc.t[1 + (xor(acc, x) & 255)])), 4294967295) as h
  from lowered, crc),
thinned as (
  select case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed),
words as (
  select word, sum(n)::bigint as n from thinned where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cuts as (select word, n, i, word[:i - 1] as x, word[i + 1:] as y from places),
near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.x = b.x and a.y = b.y and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.x || a.y = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.x || a.y = b.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, encode(other)) as other, max(other_n) as other_n
  from near group by word),
forms as (
  select word, n, coalesce(n_near, 0)::bigint as n_near,
    case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end::bigint as form_n
  from words left join best using (word)),
paths(word, reached) as (
  select word, word from forms
  union all select p.word, f.form from paths p join forms f on f.word = p.reached where f.form is not null),
roots as (
  select p.word, p.reached as root from paths p join forms f on f.word = p.reached where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op1_decontamination": OP1_SQL,
        "op10_quality_rules": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
    }

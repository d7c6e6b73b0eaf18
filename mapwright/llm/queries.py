"""The operators' queries over the test tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.storage import read_table

from . import conversations, decontam, divergence, fingerprint, linededup, minhash, packing, pieces, pii, quality, substring, toxicity, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of being poor, and whether it stays, for every document."""
    return quality.score_quality(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines, links of its lines and digest of what is left, for every document."""
    return linededup.line_report(read_table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced; the key is the session's, or a public one for test tables."""
    return pii.surrogates(read_table(spark, sf_dir, "documents"), key=spark.conf.get("spark.mapwright.piiKey", "not a secret"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.edited_report(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learned from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, learn="crc32(cast(id as string)) % 4 <> 2")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' records against a replica with known damage."""
    return warc.audit_pages(read_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once passages that start earlier elsewhere are taken out."""
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every two sources of a language, and the terms that mark each source."""
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after known damage, its cheapest repair and what that gives."""
    table = read_table(spark, sf_dir, "conversations")
    return conversations.repair_report(table, conversations.damage(table))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return pieces.piece_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_line_dedup, op3_pii_surrogates, op4_decontamination, op5_fingerprints, op6_toxicity, op7_packing, op8_warc_fixity, op9_substring_dedup, op10_near_duplicates, op11_source_divergence, op12_conversation_repair, op13_sentencepiece)
} | {"pipeline": corpus_pipeline.run}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP4_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (
  select distinct item_id, least(13, len(w)) size, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') win
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) p from i where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (
  select doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) p from d, sizes where len(w) >= size)),
hit as (select doc_id, p, dw.size, item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
pos as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + size)) q from hit) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from hit) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP9_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) w from documents),
win as (
  select doc_id, p, array_to_string(w[p : p + 19], ' ') s
  from (select doc_id, w, unnest(range(1, len(w) - 18)) p from d where len(w) >= 20)),
ranked as (select doc_id, p, row_number() over (partition by s order by doc_id, p) r from win),
gone as (select distinct doc_id, unnest(range(p, p + 20)) q from ranked where r > 1),
words as (select doc_id, generate_subscripts(w, 1) q, unnest(w) word from d where len(w) > 0),
kept as (
  select words.doc_id, string_agg(word, ' ' order by words.q) filter (where gone.q is null) s, count(gone.q) n
  from words left join gone on words.doc_id = gone.doc_id and words.q = gone.q group by words.doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join kept using (doc_id)
"""

OP10_SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) w from documents),
sh as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[p : p + 4], ' ') end s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) p from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
both_ as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select x, y from both_ join n na on x = na.doc_id join n nb on y = nb.doc_id where 100 * c >= 75 * (na.n + nb.n - c)),
ends as (select x a, y b from e union select y, x from e),
reach as (select a root, a v from ends union select root, b from reach join ends on v = a),
comp as (select v doc_id, min(root) c from reach group by v)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept
from d left join n using (doc_id) left join comp using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op8_warc_fixity": warc.ORACLE_SQL, "op9_substring_dedup": OP9_SQL, "op10_near_duplicates": OP10_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_conversation_repair": conversations.ORACLE_SQL}

"""Rewriting stored relationships onto the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions.keys import entity_key, relationship_key
from mapwright.functions.vocab import canonical_relation


def rewritten(edges: DataFrame) -> DataFrame:
    """Edges with ``new_relation``, ``new_key`` and ``changed``, from their original wording where there is one."""
    # each is a column before it is used: the vocabulary and the slugs cost more than all else, and are asked once for an edge
    edges = edges.withColumn("_original", F.coalesce(F.nullif("relation_phrase", F.lit("")), F.coalesce("relation", F.lit(""))))
    edges = edges.withColumn("_new", canonical_relation(F.col("_original"))).withColumn("changed", F.col("_new") != F.coalesce("relation", F.lit("")))
    new, changed = F.col("_new"), F.col("changed")
    key = relationship_key(F.col("company_name"), F.col("source"), new, F.col("target"))
    named = edges.withColumns({"new_relation": F.when(changed, new).otherwise(F.col("relation")), "new_key": F.when(changed, key).otherwise(F.col("key")), "phrase": F.when(changed, F.col("_original")).otherwise(F.col("relation_phrase"))})
    return named.drop("_original", "_new")


def canonicalize(edges: DataFrame) -> DataFrame:
    """The table after the rewrite: one edge for each key.

    Edges are handled in order of their old key; of those that meet in a key the last rewritten one gives the fields,
    the articles are joined in order, and an edge rewritten onto a key of its own is open again. A rewrite changes no end,
    so edges that :func:`merge.fold_edges` has dealt by their ends (``_ends``) are grouped where they are.
    """
    r = rewritten(edges)
    order = F.struct(F.col("changed").cast("int").alias("c"), F.col("key").alias("k"))
    last = F.max_by(F.struct("source", "target", F.col("new_relation").alias("relation"), F.col("phrase").alias("relation_phrase"), "as_of"), order)
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("changed").cast("int").alias("c"), F.col("key").alias("k"), "source_article_ids"))), lambda x: x["source_article_ids"])))
    kept = F.max(F.when(F.col("new_key") == F.col("key"), F.col("invalid_at")))
    dealt = ["_ends"] if "_ends" in edges.columns else []
    grouped = r.groupBy(*dealt, "company_name", F.col("new_key").alias("key")).agg(last.alias("l"), ids.alias("source_article_ids"), kept.alias("invalid_at"))
    company = F.col("company_name")
    return grouped.select("company_name", "key", entity_key(company, F.col("l.source")).alias("source_key"), entity_key(company, F.col("l.target")).alias("target_key"), "l.*", "source_article_ids", "invalid_at")


def counters(edges: DataFrame) -> DataFrame:
    """By company: edges examined, rewritten, and rewritten onto a key that is taken."""
    r = rewritten(edges)
    # one pass: an edge stands under its new key and, to say that this is taken, under its old one
    own = F.struct("new_key", F.lit(1).alias("n"), "changed", "key", (F.col("new_key").eqNullSafe(F.col("key")) & F.col("company_name").isNotNull()).alias("taken"))
    old = F.struct(F.col("key").alias("new_key"), F.lit(0).alias("n"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("key"), F.col("company_name").isNotNull().alias("taken"))
    rows = r.select("company_name", F.explode(F.when(F.col("new_key").eqNullSafe(F.col("key")), F.array(own)).otherwise(F.array(own, old))).alias("e")).select("company_name", "e.*")
    met = rows.groupBy("company_name", "new_key").agg(F.sum("n").alias("n"), F.count_if("changed").alias("changed"), F.max("taken").alias("taken"), F.min(F.when(F.col("changed"), F.col("key"))).alias("first"))
    # of several that meet in a new key, all but the first find it written; the first does if it was another's
    first = ((F.col("n") > F.col("changed")) | (F.col("taken") & (F.col("first") != F.col("new_key")))).cast("int")
    hits = F.when(F.col("changed") > 0, F.col("changed") - 1 + first).otherwise(0)
    return met.groupBy("company_name").agg(F.sum("n").alias("examined"), F.sum("changed").alias("rewritten"), F.sum(hits).alias("collapsed"))

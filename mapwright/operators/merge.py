"""Folding mentions into entities and stated edges into relationships, in the order in which articles arrive.

The order of two rows is that of (extracted_at, article_id, position in the article). What a loop over articles would
leave behind is stated as aggregates over that order, so a fold is one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.functions.keys import entity_key, normalized, relationship_key, slug
from mapwright.functions.vocab import is_generic, strip
from mapwright.storage import materialize

REPLACED_BY = "replaced_by"


def order_of(*more: str) -> Column:
    return F.struct("extracted_at", "article_id", *more)


def fold_entities(mentions: DataFrame) -> DataFrame:
    """Entities from mentions (company_name, name, kind, domain, description, article_id, extracted_at, item).

    The first mention of a key gives name, kind, domain and article; the first description that is not empty counts.
    """
    seen = order_of("item")
    first = F.min_by(F.struct("name", "kind", "domain", "article_id"), seen)
    return (
        mentions.withColumn("key", entity_key(F.col("company_name"), F.col("name")))
        .groupBy("company_name", "key")
        .agg(first.alias("first"), F.min_by(F.when(F.col("description") != "", F.col("description")), F.when(F.col("description") != "", seen)).alias("description"), F.count("*").alias("n_mentions"))
        .select("company_name", "key", "first.name", "first.kind", "first.domain", F.col("first.article_id").alias("first_seen_article_id"), "description", "n_mentions")
    )


def fold_spellings(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each distinct spelling folded: company_name, raw_name, norm, ``known_name`` (the first spelling of the same norm), ``name`` by
    the exact tier, ``first`` mention, first ``described`` one, ``n`` mentions, and the ``method`` of its latest mention.

    A mention's exact name depends on its spelling only, so mentions need no join of their own. ``stored`` (company_name,
    name): entities of earlier runs, known before the first article.
    """
    seen = ("extracted_at", "article_id", "item")
    described = F.min(F.when(F.col("description") != "", F.struct(*seen, "description")))
    spelled = mentions.groupBy("company_name", "raw_name").agg(F.min(F.struct(*seen, "kind", "domain")).alias("first"), described.alias("described"), F.count("*").alias("n"), F.max(F.struct(*seen[:2])).alias("latest"))
    spelled = materialize(spelled.withColumn("norm", normalized(F.col("raw_name"))), "spelled")
    known = spelled.where("norm <> ''").groupBy("company_name", "norm").agg(F.min(F.struct(*[f"first.{c}" for c in seen], "raw_name")).alias("f"))
    known = known.select("company_name", "norm", F.col("f.raw_name").alias("known_name"), F.struct(*[F.col(f"f.{c}").alias(c) for c in seen[:2]]).alias("known_at"))
    if stored is not None:
        # a stored name is known before all mentions
        old = stored.select("company_name", normalized(F.col("name")).alias("norm"), "name").where("norm <> ''").groupBy("company_name", "norm").agg(F.min("name").alias("old_name"))
        known = known.join(old, ["company_name", "norm"], "left").select("company_name", "norm", F.coalesce("old_name", "known_name").alias("known_name"), F.when(F.col("old_name").isNull(), F.col("known_at")).alias("known_at"))
    exact = ~is_generic(F.col("raw_name")) & F.col("known_name").isNotNull()
    method = F.when(exact & F.coalesce(F.col("known_at") < F.col("latest"), F.lit(True)), F.lit("exact")).alias("method")
    found = spelled.join(known, ["company_name", "norm"], "left")
    return found.select(*[c for c in spelled.columns if c != "latest"], "known_name", F.when(exact, F.col("known_name")).otherwise(F.col("raw_name")).alias("name"), method)


def exact_entities(mentions: DataFrame) -> DataFrame:
    """What :func:`fold_entities` makes of mentions (raw_name) that the exact tier has resolved, in one step: the first
    mention of a key is the first of its norm too, or has none, so that its own spelling is the entity's name."""
    seen = ("extracted_at", "article_id", "item")
    described = F.min(F.when(F.col("description") != "", F.struct(*seen, "description")))
    folded = mentions.groupBy("company_name", slug(F.col("raw_name")).alias("_s")).agg(F.min(F.struct(*seen, "raw_name", "kind", "domain")).alias("f"), described.alias("d"), F.count("*").alias("n_mentions"))
    key = F.concat_ws("--", slug(F.col("company_name")), "_s")
    return folded.select("company_name", key.alias("key"), F.col("f.raw_name").alias("name"), "f.kind", "f.domain", F.col("f.article_id").alias("first_seen_article_id"), "d.description", "n_mentions")


def name_id(name: Column) -> Column:
    """What two names share exactly if the exact tier gives them one name in the end: the slug, or the name itself, behind
    a zero byte, where its norm is empty."""
    return F.when(normalized(name) == "", F.concat(F.lit("\0"), name)).otherwise(slug(name))


def spelled_entities(spellings: DataFrame) -> DataFrame:
    """What :func:`fold_entities` makes of exactly resolved mentions, from :func:`fold_spellings`."""
    keyed = spellings.withColumn("key", entity_key(F.col("company_name"), F.col("name")))
    folded = keyed.groupBy("company_name", "key").agg(F.min(F.struct("first", "name")).alias("f"), F.min("described").alias("d"), F.sum("n").alias("n_mentions"))
    return folded.select("company_name", "key", "f.name", "f.first.kind", "f.first.domain", F.col("f.first.article_id").alias("first_seen_article_id"), "d.description", "n_mentions")


def spelled_aliases(spellings: DataFrame) -> DataFrame:
    """What :func:`fold_aliases` makes of exactly resolved mentions, from :func:`fold_spellings`."""
    other = spellings.where(F.col("raw_name") != F.col("name")).withColumn("key", entity_key(F.col("company_name"), F.col("name")))
    return other.groupBy("company_name", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("raw_name").alias("name"), "method"))).alias("aliases"))


def fold_aliases(mentions: DataFrame) -> DataFrame:
    """``company_name, key, aliases``: other spellings of an entity with the latest method, in order of name.

    mentions: as for :func:`fold_entities`, with raw_name and method.
    """
    other = mentions.where(F.col("raw_name") != F.col("name")).withColumn("key", entity_key(F.col("company_name"), F.col("name")))
    latest = other.groupBy("company_name", "key", "raw_name").agg(F.max_by("method", order_of("item")).alias("method"))
    return latest.groupBy("company_name", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("raw_name").alias("name"), "method"))).alias("aliases"))


def keyed_edges(edges: DataFrame) -> DataFrame:
    company = F.col("company_name")
    return edges.withColumn("key", relationship_key(company, F.col("source"), F.col("relation"), F.col("target"))).withColumn("source_key", entity_key(company, F.col("source"))).withColumn("target_key", entity_key(company, F.col("target")))


def fold_edges(edges: DataFrame, articles: bool = True, tasks: int | None = None, by_id: bool = False, by_ends: bool = False, closed_by: str | None = None) -> DataFrame:
    """Relationships from stated edges (company_name, source, target, relation, relation_phrase, as_of, article_id, extracted_at, item).

    The last statement of a key gives its fields; the articles are listed in order of first appearance, unless nobody asks
    for ``articles``. Slugs hold no two hyphens in a row, so that those of the ends and of the relation stand for the keys;
    these are put together at the end. Statements are dealt as they are to ``tasks`` tasks (the session's number without),
    by a hash of their slugs, which are made again where they arrive: nearly every key is stated once, so that folding
    beforehand would only widen the rows. ``by_id``: the ends are :func:`name_id` of names. ``by_ends``: statements are dealt by
    their company and ends alone, whose hash stays as ``_ends``, so that grouping by it and more needs no other shuffle.
    ``closed_by``, a run's time: ``invalid_at`` is made too, as :func:`close_windows` does; statements are then dealt by their
    source (a hot one's by part of it), so that its closings meet its edges where these are folded, without a second shuffle.
    """
    seen, fields = ("extracted_at", "article_id", "item"), [c for c in ("source", "target", "relation", "relation_phrase", "as_of") if c in edges.columns]
    end = lambda c: F.when(F.col(c).startswith("\0"), F.lit("x")).otherwise(F.col(c)) if by_id else slug(F.col(c))
    slugs = [end("source"), slug(F.col("relation")), end("target")]
    of = ["_h", "company_name", *[c.alias(n) for c, n in zip(slugs, ("_s", "_r", "_t"), strict=True)]]
    if closed_by is None:
        rows = edges.select("company_name", *seen, *fields, F.hash("company_name", *(slugs[::2] if by_ends else slugs)).alias("_h"))
    else:
        is_close = (F.col("relation") == REPLACED_BY) & F.col("company_name").isNotNull()
        rows = _in_parts(edges, edges.select("company_name", end("source").alias("_of")), end("source"), F.hash(end("target")), is_close)
        rows = rows.select("company_name", *seen, *fields, "_h", "_own")
    rows = rows.repartition(tasks, "_h") if tasks else rows.repartition("_h")
    key = lambda *c: F.concat_ws("--", slug(F.col("company_name")), *c)
    own = F.col("_own") if closed_by is not None else F.lit(True)
    when_own = lambda x: x if closed_by is None else F.when(own, x)
    first, last = F.struct(*seen), F.struct(*seen, *fields)
    stated = F.array_sort(F.collect_list(when_own(first))) if articles else F.array(F.min(when_own(first)))
    aggregates = [F.max(when_own(last)).alias("last"), stated.alias("stated")]
    if closed_by is not None:
        aggregates.append(F.collect_list(F.when(is_close, F.struct(F.struct(*seen[:2]).alias("first_seq"), "item", _closed_at(closed_by).alias("at")))).alias("closes"))
    folded = rows.groupBy(*of).agg(*aggregates)
    ids = [F.array_distinct("stated.article_id").alias("source_article_ids")] if articles else []
    first = F.struct(*[F.col("stated")[0][c].alias(c) for c in ("extracted_at", "article_id")]).alias("first_seq")
    ends = [F.col("_h").alias("_ends")] if by_ends else []
    if closed_by is not None:
        folded = _closed_in_place(folded, ["_h", "company_name", "_s"], ["_r", "_t", "last", "stated"], F.col("last").isNotNull(), first)
        ends = [F.when(F.col("last.relation") != REPLACED_BY, F.col("_at")).alias("invalid_at")]
    return folded.select("company_name", key("_s", "_r", "_t").alias("key"), key("_s").alias("source_key"), key("_t").alias("target_key"), *[f"last.{c}" for c in fields], *ids, first, *ends)


#: Statements of a source beyond which it is dealt in parts of so many, about; one in LOOK_AT of them is looked at for this.
HOT_SOURCE = 500_000
LOOK_AT = 64


def _in_parts(rows: DataFrame, statements: DataFrame, source: Column, of: Column, is_close: Column) -> DataFrame:
    """``rows`` with ``_h``, to deal them by: the hash of company and source, and for a hot source of its part by ``of``. A hot
    source's closings go to all its parts; all but one of these are copies, not ``_own``."""
    by = ["company_name", "_of"]
    looked = statements.where(F.rand(7) < 1 / LOOK_AT).groupBy(*by).agg(F.ceil(F.count("*") * LOOK_AT / HOT_SOURCE).cast("int").alias("_parts"))
    hot = materialize(looked.where("_parts > 1"), "hot-sources")
    if hot.isEmpty():
        return rows.withColumns({"_h": F.hash("company_name", source), "_own": F.lit(True)})
    parts = rows.withColumn("_of", source).join(F.broadcast(hot), by, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_mine", F.pmod(of, "_parts"))
    parts = parts.withColumn("_part", F.explode(F.when(is_close, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array("_mine"))))
    return parts.withColumns({"_h": F.hash("company_name", source, F.nullif("_part", F.lit(0))), "_own": F.col("_part") == F.col("_mine")}).drop("_of", "_parts", "_mine", "_part")


def _closed_at(run_ts: str) -> Column:
    return F.coalesce(F.nullif("as_of", F.lit("")), F.lit(run_ts))


def _closing_so_far(of: list[str], seq: str, close: str, item: str, at: str) -> Column:
    """The earliest closing that is not before a row: the last one met from the latest moment down. Of one article's closings
    the first counts, so it comes last, but before the article's edges."""
    order = W.partitionBy(*of).orderBy(F.desc(seq), F.desc(close), F.desc(item))
    return F.last(at, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))


def _closed_in_place(grouped: DataFrame, of: list[str], columns: list[str], exists: Column, first_seq: Column) -> DataFrame:
    """Edges, grouped in the tasks that have their source's ``closes`` (first_seq, item, at) too, with ``_at``, what closes them: each
    becomes a row for itself, if it ``exists`` and is not only copies of closings, and a row for each of its closings."""
    closings = F.transform("closes", lambda c: F.struct(F.lit(1).alias("close"), c["first_seq"].alias("first_seq"), c["item"].alias("item"), c["at"].alias("at")))
    item = grouped.schema["closes"].dataType.elementType["item"].dataType
    itself = F.array(F.struct(F.lit(0).alias("close"), first_seq.alias("first_seq"), F.lit(None).cast(item).alias("item"), F.lit(None).cast("string").alias("at")))
    rows = grouped.withColumn("e", F.explode(F.when(exists, F.concat(itself, closings)).otherwise(closings)))
    rows = rows.select(*of, *[F.when(F.col("e.close") == 0, F.col(c)).alias(c) for c in columns], "e")
    return rows.withColumn("_at", _closing_so_far(of, "e.first_seq", "e.close", "e.item", "e.at")).where("e.close = 0").drop("e")


def close_windows(folded: DataFrame, edges: DataFrame, run_ts: str, tasks: int | None = None) -> DataFrame:
    """``folded`` with ``invalid_at``: a ``replaced_by`` closes the open edges that leave its source.

    An edge is closed by the earliest such statement in its own or a later article; the time is that statement's
    ``as_of``, or ``run_ts`` where that is null or empty. Edges into the source stay open, and so do edges first stated
    after it. Edges and closings are dealt once by source, a hot source in parts that each have all its closings, so that
    ``folded`` is made once (a deal by range would make it twice) and nothing is joined back.
    """
    of, columns = ["company_name", "source_key"], folded.columns
    source_key = entity_key(F.col("company_name"), F.col("source"))
    closes = edges.where((F.col("relation") == REPLACED_BY) & F.col("company_name").isNotNull()).select(
        "company_name", source_key.alias("source_key"), F.struct("extracted_at", "article_id").alias("first_seq"),
        F.lit(1).alias("_is_close"), F.col("item").alias("_item"), _closed_at(run_ts).alias("_closed_at"),
    )
    rows = folded.withColumn("_is_close", F.lit(0)).unionByName(closes, allowMissingColumns=True)
    n = tasks or max(1, int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _in_parts(rows, edges.select("company_name", source_key.alias("_of")), F.col("source_key"), F.hash("key" if "key" in columns else "first_seq"), F.col("_is_close") == 1)
    dealt = rows.repartition(n, "_h").withColumn("_at", _closing_so_far(["_h", *of], "first_seq", "_is_close", "_item", "_closed_at"))
    return dealt.where("_is_close = 0").select(*columns, F.when(F.col("relation") != REPLACED_BY, F.col("_at")).alias("invalid_at"))


def merge_entities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities (as of :func:`fold_entities`, with ``aliases``) after a further run: stored fields win, an empty
    description is filled, mentions add up, and of an alias the later method counts."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, ["company_name", "key"], "full_outer")
    first = [F.coalesce(F.col(f"s.{c}"), F.col(f"i.{c}")).alias(c) for c in ("name", "kind", "domain", "first_seen_article_id")]
    description = F.coalesce(F.nullif(F.col("s.description"), F.lit("")), F.col("i.description")).alias("description")
    count = (F.coalesce("s.n_mentions", F.lit(0)) + F.coalesce("i.n_mentions", F.lit(0))).cast("long").alias("n_mentions")
    none = F.array().cast("array<struct<name:string,method:string>>")
    old, new = F.coalesce("s.aliases", none), F.coalesce("i.aliases", none)
    kept = F.filter(old, lambda x: ~F.exists(new, lambda y: y["name"] == x["name"]))
    return both.select("company_name", "key", *first, description, count, F.array_sort(F.concat(kept, new)).alias("aliases"))


def merge_relationships(stored: DataFrame, incoming: DataFrame, edges: DataFrame, run_ts: str, tasks: int | None = None) -> DataFrame:
    """Relationships (as of :func:`fold_edges`, with ``invalid_at``) after a further run that stated ``edges``.

    The later statement's fields win, articles are appended once. A ``replaced_by`` of this run closes what is open;
    what was closed before stays as it was.
    """
    fields, key = ("source", "target", "relation", "relation_phrase", "as_of"), ["company_name", "source_key", "target_key", "key"]
    closes = edges.where((F.col("relation") == REPLACED_BY) & F.col("company_name").isNotNull())
    closes = closes.select("company_name", entity_key(F.col("company_name"), F.col("source")).alias("source_key"), F.struct(F.struct("extracted_at", "article_id").alias("first_seq"), "item", _closed_at(run_ts).alias("at")).alias("c"))
    # stored, incoming and closing rows meet in one deal by source; rows without a company meet no others
    rows = stored.select(*key, F.struct(*fields, "source_article_ids", "invalid_at").alias("s"), F.lit(0).alias("_side"))
    rows = rows.unionByName(incoming.select(*key, F.struct(*fields, "source_article_ids", "first_seq").alias("i"), F.lit(1).alias("_side")), allowMissingColumns=True)
    rows = rows.unionByName(closes, allowMissingColumns=True).withColumn("_side", F.when(F.col("company_name").isNull(), F.col("_side")))
    rows = _in_parts(rows, edges.select("company_name", entity_key(F.col("company_name"), F.col("source")).alias("_of")), F.col("source_key"), F.hash("key"), F.col("c").isNotNull())
    dealt = rows.repartition(tasks, "_h") if tasks else rows.repartition("_h")
    both = dealt.groupBy("_h", *key, "_side").agg(F.max("s").alias("s"), F.max("i").alias("i"), F.collect_list("c").alias("closes"))
    is_new, is_old = F.col("i").isNotNull(), F.col("s").isNotNull()
    # a stored edge is older than any statement of this run
    before = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in incoming.schema["first_seq"].dataType.fields])
    r = _closed_in_place(both, ["_h", *key[:2]], [*key[2:], "s", "i"], is_new | is_old, F.when(is_old, before).otherwise(F.col("i.first_seq")))
    last = [F.when(is_new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fields]
    none = F.array().cast(incoming.schema["source_article_ids"].dataType)
    ids = F.array_distinct(F.concat(F.coalesce("s.source_article_ids", none), F.coalesce("i.source_article_ids", none))).alias("source_article_ids")
    closed = r.select("company_name", "key", "source_key", "target_key", *last, ids, F.col("s.invalid_at").alias("was"), "_at")
    return closed.withColumn("invalid_at", F.coalesce("was", F.when(F.col("relation") != REPLACED_BY, F.col("_at")))).drop("was", "_at")


def upsert_edges(stored: DataFrame, items: DataFrame) -> DataFrame:
    """The sink of single edges: ``items`` (company_name, source, target, relation, relation_phrase, as_of,
    source_article_ids) are written in order of ``item`` over ``stored``; none of them closes or opens a window."""
    keyed, order = keyed_edges(items), F.struct("item")
    fields = ("source", "target", "relation", "relation_phrase", "as_of")
    last = F.max_by(F.struct(*fields), order)
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item", "source_article_ids"))), lambda x: x["source_article_ids"])))
    new = keyed.groupBy("company_name", "key", "source_key", "target_key").agg(last.alias("last"), ids.alias("source_article_ids"))
    new = new.select("company_name", "key", "source_key", "target_key", "last.*", "source_article_ids", F.lit(None).cast("string").alias("invalid_at"))
    old = stored.select("key", F.col("source_article_ids").alias("_ids"))
    joined = new.join(old, "key", "left").withColumn("source_article_ids", F.array_distinct(F.concat(F.coalesce("_ids", F.array().cast(new.schema["source_article_ids"].dataType)), "source_article_ids")))
    return upsert(stored, joined.select(stored.columns), "key", ["invalid_at"])


def merge_counters(mentions: DataFrame, edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """By article: entities new to the company, matched ones, those that a model settled, and relationships.

    ``mentions`` have ``name`` and ``method`` resolved; an entity of ``stored`` (company_name, key) is never new.
    """
    keyed = mentions.withColumn("key", entity_key(F.col("company_name"), F.col("name")))
    keyed = keyed.groupBy("company_name", "article_id", "extracted_at", "key").agg(F.max((F.col("method") == "llm").cast("int")).alias("llm"))
    order_columns = ("extracted_at", "article_id", "item")
    # an entity is new in one article only, so that new ones are counted from the entities, and no mention is numbered
    new = mentions.select("company_name", entity_key(F.col("company_name"), F.col("name")).alias("key"), *order_columns).groupBy("company_name", "key").agg(F.min(F.struct(*order_columns)).alias("first"))
    if stored is not None:
        new = new.join(stored.select("company_name", "key"), ["company_name", "key"], "left_anti")
    parts = [
        keyed.select("company_name", "article_id", F.lit(1).alias("met"), F.lit(0).alias("new"), "llm", F.lit(0).alias("rel")),
        new.select("company_name", "first.article_id", F.lit(0), F.lit(1), F.lit(0), F.lit(0)),
        edges.select("company_name", "article_id", F.lit(0), F.lit(0), F.lit(0), F.lit(1)),
    ]
    total = parts[0].union(parts[1]).union(parts[2]).groupBy("company_name", "article_id").agg(*[F.sum(c).alias(c) for c in ("met", "new", "llm", "rel")])
    counts = [F.col("new").alias("new_count"), (F.col("met") - F.col("new")).alias("matched_count"), F.coalesce("llm", F.lit(0)).cast("long").alias("llm_count"), F.col("rel").alias("relationship_count")]
    return total.where("met > 0").select("company_name", "article_id", *counts)


def _by_article(items: DataFrame, tasks: int | None) -> DataFrame:
    """Dealt by article as they are: what is folded within an article gains nothing from folding before the shuffle."""
    return items.repartition(tasks, "article_id") if tasks else items.repartition("article_id")


def merge_chunks_entities(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """First wins by the stripped, lower-cased name (article_id, chunk, item, name, kind, domain, description)."""
    name, items = F.lower(strip(F.col("name"))), _by_article(items, tasks)
    return items.where(name != "").groupBy("article_id", name.alias("name_key")).agg(F.min_by(F.struct("name", "kind", "domain", "description", "chunk", "item"), F.struct("chunk", "item")).alias("f")).select("article_id", "name_key", "f.*")


def merge_chunks_edges(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """First wins by lower-cased ends and relation (article_id, chunk, item, source, target, relation, ...)."""
    items = _by_article(items, tasks)
    src, dst = F.lower(strip(F.col("source"))), F.lower(strip(F.col("target")))
    rows = items.where((src != "") & (dst != "")).withColumn("source_lc", src).withColumn("target_lc", dst)
    rest = [c for c in items.columns if c not in ("article_id", "relation")]
    return rows.groupBy("article_id", "source_lc", "target_lc", "relation").agg(F.min_by(F.struct(*rest), F.struct("chunk", "item")).alias("f")).select("article_id", "source_lc", "target_lc", "relation", "f.*")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Stored rows overwritten by incoming ones of the same key; columns of ``keep`` keep a stored value that is set."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    cols = []
    for c in stored.columns:
        old, new = F.col(f"s.{c}"), F.col(f"i.{c}")
        cols.append((F.coalesce(old, new) if c == key or c in keep else F.when(F.col(f"i.{key}").isNotNull(), new).otherwise(old)).alias(c))
    return both.select(*cols)

"""Entity resolution: exact on the normalised name, then by similarity, else new.

Exact matches do not depend on order. Similar ones do: a spelling becomes a known name only if no earlier article has a
name like it. Candidate pairs are found by an equi-join (blocked on a shared run of letters and on length); only names that
have a candidate pass through an ordered step, in rounds over all names at once.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.functions.keys import normalized
from mapwright.functions.similarity import long_score, method_text, sorted_words
from mapwright.functions.vocab import is_generic
from mapwright.storage import discard, materialize, tasks_for

THRESHOLD = 92.0
MIN_FUZZY = 5
CANDIDATES = 40
#: Names in a block of the exact comparison.
BLOCK = 2000
#: So many subsequences of one length are made of a name at most.
SUBSEQUENCES = 3000
#: Rows of subsequences that are handed on at a time.
HANDED_ROWS = 20_000
#: Once at most so many links between undecided names are left, a company's are decided in one step.
LAST_LINKS = 300_000
#: Pairs of texts are sent to all tasks up to so many, and shuffled beyond.
SENT_TEXTS = 300_000
#: So many links between open names are made at a time, about; the place to cut is found from so many names, about.
LINKS = 5_000_000
CUT_FROM = 2000
#: Mentions to a task.
MENTIONS = 500_000


def known_names(mentions: DataFrame, tasks: int | None = None) -> DataFrame:
    """``company_name, norm, known_name, seq``: the first spelling of each normalised name.

    mentions: company_name, raw_name, article_id, extracted_at, item. Generic names are known like all others: they only
    never ask to be matched themselves. With ``tasks``, mentions are dealt to so many, and sorted in none but these.
    """
    m = mentions.withColumn("norm", normalized(F.col("raw_name"))).where(F.col("norm") != "")
    m = m.select("company_name", "norm", "raw_name", "extracted_at", "article_id", "item").repartition(tasks, "company_name", "norm") if tasks else m
    order = F.struct("extracted_at", "article_id", "item")
    return m.groupBy("company_name", "norm").agg(F.min_by("raw_name", order).alias("known_name"), F.min(F.struct("extracted_at", "article_id")).alias("seq"))


def resolve_exact(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Mentions with ``name`` and ``method``: ``exact`` where an earlier article has the name, else null (new).

    ``stored`` (company_name, name): entities of earlier runs, known before the first article.
    """
    key = ["company_name", "norm"]
    m = mentions.withColumn("norm", normalized(F.col("raw_name"))).withColumn("generic", is_generic(F.col("raw_name")))
    known = known_names(mentions)
    if stored is not None:
        old = stored_names(stored.join(mentions.select("company_name").distinct(), "company_name", "left_semi"))
        old = old.select(*key, "known_name", F.lit(None).cast(known.schema["seq"].dataType).alias("seq"))
        known = known.join(old, key, "left_anti").unionByName(old)
    joined = m.join(known, key, "left")
    found = ~F.col("generic") & F.col("known_name").isNotNull()
    hit = found & F.coalesce(F.col("seq") < F.struct("extracted_at", "article_id"), F.lit(True))
    return joined.select(*mentions.columns, F.when(found, F.col("known_name")).otherwise(F.col("raw_name")).alias("name"), F.when(hit, F.lit("exact")).alias("method"))


def _run_length(threshold: float) -> int:
    """A run of letters that two names of at least MIN_FUZZY letters share if their score reaches ``threshold``.

    Names of n letters and more, together of at most n + n * threshold / (200 - threshold) ones, lose d of them at most;
    d changes leave n - d letters in d + 1 runs.
    """
    least = 4
    for n in range(MIN_FUZZY, 400):
        longer = int(n * (200 - threshold) / threshold)
        d = int((n + longer) * (1 - threshold / 100))
        least = min(least, max(1, -(-(n - d) // (d + 1))))
    return least


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _share(n: int, m: int, threshold: float) -> int:
    """The length of a subsequence that names of n and m letters have in common exactly if they reach ``threshold``."""
    return -(-(n + m - math.floor((n + m) * (1 - threshold / 100) + 1e-9)) // 2)


def _classes(lengths: list[int], threshold: float) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
    """By length the lengths of the subsequences to deal a name out by, and the pairs of lengths that go by shared runs."""
    kept, rest = {n: set() for n in lengths}, []
    for n in lengths:
        for m in lengths:
            if m <= n and 200 * m >= threshold * (n + m):
                share = _share(n, m, threshold)
                if math.comb(n, share) <= SUBSEQUENCES:
                    kept[n].add(share)
                    kept[m].add(share)
                else:
                    rest.append((n, m))
    return {n: sorted(k) for n, k in kept.items()}, rest


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD, asked: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """``company_name, a, b, score`` for pairs of different normalised names at or over ``threshold``.

    Each pair once, with a < b; with ``asked`` (company_name, norm), each pair with its ``a`` among these; so too where
    ``names`` have a column ``asks``. Columns ``carried`` of the names stand beside their pairs as ``a_...`` and ``b_...``.

    ``names``: company_name, norm. Their sorted words are compared once for all companies. Two that are alike have a
    subsequence of known length in common, a few letters shorter than they are; short ones are dealt out by all theirs, so
    that only names meet that are alike, however dense. Where these would be too many, runs of letters deal the names out.
    """
    if asked is not None:
        names = names.join(asked.select("company_name", "norm", F.lit(True).alias("asks")).distinct(), ["company_name", "norm"], "left")
    directed = "asks" in names.columns
    long, turned = _alike(names, threshold, carried)
    named = lambda end, text: [F.col("norm").alias(end), F.col("s").alias(text), *[F.col(c).alias(f"{end}_{c}") for c in carried]]
    left, right = long.where("asks").select("company_name", *named("a", "x")), long.select("company_name", *named("b", "y"))
    different = F.col("a") != F.col("b") if directed else F.col("a") < F.col("b")
    ends = [f"{end}_{c}" for c in carried for end in "ab"]
    return left.join(turned, "x").join(right.hint("shuffle_hash"), ["company_name", "y"]).where(different).select("company_name", "a", "b", "score", *ends)


def _alike(names: DataFrame, threshold: float, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The names that are long enough, as company_name, norm, s, asks and ``carried``, and ``x, y, score`` of texts ``s`` that are
    alike: both directions, and each text with itself. Without a column ``asks`` all names ask."""
    asks = F.coalesce("asks", F.lit(False)) if "asks" in names.columns else F.lit(True)
    long = materialize(names.where(F.char_length("norm") >= MIN_FUZZY).select("company_name", "norm", sorted_words(F.col("norm")).alias("s"), asks.alias("asks"), *carried), "similar-names")
    texts = materialize(long.groupBy("s").agg(F.max("asks").alias("asks")).select("s", F.char_length("s").alias("n"), "asks"), "similar-texts")
    kept, rest = _classes([r["n"] for r in texts.select("n").distinct().collect()], threshold)
    columns = ["s", "n", "asks", "share", "v"]

    def subsequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for b in batches:
            for s, n, asks in zip(b["s"], b["n"], b["asks"], strict=True):
                rows += [(s, n, asks, k, v) for k in kept[n] for v in {"".join(c) for c in itertools.combinations(s, k)}]
                if len(rows) >= HANDED_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    # few bytes make many rows here, so the texts are spread over all tasks first
    dealt = texts.repartition(_tasks(texts), "s").mapInPandas(subsequences, "s string, n int, asks boolean, share int, v string")
    dealt = materialize(dealt.select("s", "n", "asks", "share", F.xxhash64("v").alias("v")), "similar-dealt")
    both = dealt.toDF("x", "n_x", "asks_x", "share", "v").join(dealt.toDF("y", "n_y", "asks_y", "share", "v"), ["share", "v"]).where("x < y and (asks_x or asks_y)")
    total = F.col("n_x") + F.col("n_y")
    share = F.ceil((total - F.floor(total * (1 - threshold / 100) + 1e-9)) / 2)
    near = both.where(F.col("share") == share).select("x", "y").distinct()
    if rest:
        near = near.union(_near_by_runs(texts, rest, threshold))
    # most pairs left are alike, so the score is taken in Arrow batches, with integers of any length
    scored = near.mapInPandas(long_scores, "x string, y string, score double").where(F.col("score") >= threshold)
    scored = materialize(scored, "similar-scored")
    turned = scored.union(scored.select("y", "x", "score")).union(texts.select("s", "s", F.lit(100.0)))
    return long, F.broadcast(turned) if 2 * scored.count() + texts.count() <= SENT_TEXTS else turned


def _near_by_runs(texts: DataFrame, lengths: list[tuple[int, int]], threshold: float) -> DataFrame:
    """``x, y`` of texts (s, n, asks) whose lengths, longer first, are one of ``lengths``, and that a shared run of letters and the
    edit distance do not rule out."""
    of = sorted({n for pair in lengths for n in pair})
    size, loss = _run_length(threshold), 1 - threshold / 100
    grams = texts.where(F.col("n").isin(of)).select("s", "n", "asks", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, n - {size - 1})), i -> substring(s, i, {size}))"))).alias("gram"))
    # d changes spoil at most size * d runs, so of each name's size * d + 1 rarest ones two such names share one
    often = grams.groupBy("gram").agg(F.count("*").alias("times"))
    rank = F.row_number().over(W.partitionBy("s").orderBy("times", "gram"))
    changes = F.expr(f"int(floor((n + floor(n * {(200 - threshold) / threshold})) * {loss} + 1e-9))")
    grams = grams.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= size * changes + 1)
    met = grams.select(F.col("s").alias("x"), F.col("n").alias("n_x"), F.col("asks").alias("asks_x"), "gram").join(grams.select(F.col("s").alias("y"), F.col("n").alias("n_y"), F.col("asks").alias("asks_y"), "gram"), "gram")
    wanted = F.array(*[F.lit(n * 100_000 + m) for n, m in lengths])
    met = met.where("x < y and (asks_x or asks_y)").where(F.array_contains(wanted, F.greatest("n_x", "n_y") * 100_000 + F.least("n_x", "n_y")))
    # insertions and deletions number at least the edit distance, which has a fast banded form
    return met.where(F.expr(f"levenshtein(x, y, int(floor((n_x + n_y) * {loss} + 1e-9))) >= 0")).select("x", "y").distinct()


def moment(mentions: DataFrame, of: str = "") -> Column:
    """An article's place in the order of arrival as text; numbers are padded, so that their order is kept."""
    number = mentions.schema["article_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    article = F.col(f"{of}article_id").cast("string")
    return F.concat_ws("|", F.date_format(f"{of}extracted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(article, 20, "0") if number else article)


def _leaders(rows: DataFrame, followers: DataFrame | None = None) -> DataFrame:
    """``company_name, norm, leader``: which names stay names of their own, as no earlier leader is like them.

    ``rows``: company_name, norm, seq, other, other_seq, both directions of each pair. ``followers`` (company_name, norm)
    are decided beforehand. In each round a name follows if
    one of its earlier names leads, and leads if all of them are decided and none does. A round decides at least the
    earliest open name of each company, and once few links are left, a step by company decides all that are.
    """
    key = ["company_name", "norm"]
    links, every = rows.where("other_seq < seq").select(*key, "other").distinct(), rows.select(*key).distinct()
    if followers is not None:
        links, every = links.join(followers, key, "left_anti"), every.join(followers, key, "left_anti")
    links = materialize(links, "resolve-links")
    new = every.join(links.select(*key).distinct(), key, "left_anti").withColumn("leader", F.lit(True))
    if followers is not None:
        new = new.union(followers.select(*key).distinct().withColumn("leader", F.lit(False)))
    new = materialize(new, "resolve-decided")
    decided = new
    while left_over := links.count():
        met = links.join(new.select("company_name", F.col("norm").alias("other"), "leader"), ["company_name", "other"], "left")
        if left_over <= LAST_LINKS:
            return decided.union(met.groupBy("company_name").applyInPandas(_last_leaders, "company_name string, norm string, leader boolean"))
        state = met.groupBy(*key).agg(F.max("leader").alias("led"), F.count_if(F.col("leader").isNull()).alias("waiting"))
        new = materialize(state.where("led or waiting = 0").select(*key, (~F.coalesce("led", F.lit(False))).alias("leader")), "resolve-decided")
        decided = decided.union(new)
        left = materialize(met.where("leader is null").select(*key, "other").join(new.select(*key), key, "left_anti"), "resolve-links")
        discard(links)
        links = left
    return decided


def _pairs_with(others: DataFrame, alike: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (company_name, norm, s, ...) beside each of ``others`` (company_name, other, s, ...) that is like them, with ``score``.

    The others meet the texts that are like theirs first, so that they should be the fewer."""
    near = others.withColumnRenamed("s", "y").join(alike, "y").drop("y")
    return names.withColumnRenamed("s", "x").hint("shuffle_hash").join(near, ["company_name", "x"]).where("norm <> other").drop("x")


def _leading(long: DataFrame, alike: DataFrame) -> DataFrame:
    """``company_name, norm`` of the names (company_name, norm, s, open_at, fixed_at) that stay names of their own: no name that
    is like them is ``fixed_at`` before they are open, and none that leads is open before.

    Where all links between open names would be more than LINKS, the earliest names are decided first, so many that they
    have about so many links among them; all names that are like one of their leaders are then decided too, without a link.
    """
    key = ["company_name", "norm"]
    waiting, fixed = long.where("open_at is not null").select(*key, "s", "open_at"), long.where("fixed_at is not null")
    if not fixed.isEmpty():
        others = fixed.select("company_name", F.col("norm").alias("other"), "s", "fixed_at")
        late = materialize(_pairs_with(others, alike, waiting).where("fixed_at < open_at").select(*key).distinct(), "resolve-followers")
        waiting = materialize(waiting.join(late, key, "left_anti"), "resolve-waiting")
    as_others = lambda d: d.select("company_name", F.col("norm").alias("other"), "s", F.col("open_at").alias("other_at"))
    degrees = alike.groupBy(F.col("x").alias("s")).agg((F.count("*") - 1).alias("links"))
    leaders = None
    while True:
        n, links = waiting.join(degrees, "s").agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first()
        now, cut = waiting, None
        if links > LINKS:
            # only where to cut is taken from some of the names
            some = waiting.where(F.pmod(F.xxhash64(*key), F.lit(max(1, n // CUT_FROM))) == 0).select("open_at").collect()
            cut = sorted(r["open_at"] for r in some)[int(len(some) * math.sqrt(LINKS / links))] if some else None
        if cut is not None:
            now = waiting.where(F.col("open_at") <= cut)
        pairs = _pairs_with(as_others(now), alike, now).select(*key, F.col("open_at").alias("seq"), "other", F.col("other_at").alias("other_seq"))
        decided = _leaders(materialize(pairs, "resolve-pairs"))
        lead = now.join(decided.where("not leader"), key, "left_anti").select(*key, "s", "open_at")
        if cut is None:
            return lead.select(*key) if leaders is None else leaders.union(lead.select(*key))
        lead = materialize(lead, "resolve-leading")
        leaders = lead.select(*key) if leaders is None else leaders.union(lead.select(*key))
        rest = waiting.where(F.col("open_at") > cut)
        late = _pairs_with(as_others(lead), alike, rest).where("other_at < open_at").select(*key).distinct()
        waiting = materialize(rest.join(late, key, "left_anti"), "resolve-waiting")


def _last_leaders(links: pd.DataFrame) -> pd.DataFrame:
    """The undecided names of a company (norm, other, leader of the other if decided), each after all that it waits for."""
    leads, waits = {}, {}
    for norm, other, leader in zip(links["norm"], links["other"], links["leader"], strict=True):
        waits.setdefault(norm, []).append(other)
        if not pd.isna(leader):
            leads[other] = bool(leader)
    for name in waits:
        open_ = [name]
        while open_:
            first = [other for other in waits[open_[-1]] if other not in leads]
            if not first:
                at = open_.pop()
                leads[at] = not any(leads[other] for other in waits[at])
            open_ += first
    return pd.DataFrame({"company_name": links["company_name"].iloc[0], "norm": list(waits), "leader": [leads[name] for name in waits]})


def stored_names(entities: DataFrame) -> DataFrame:
    """``company_name, norm, known_name, known_at`` of stored entities (company_name, name); of equal names the first counts.

    ``known_at`` is the stored moment where there is one, else before all others.
    """
    at = F.col("known_at") if "known_at" in entities.columns else F.lit("")
    e = entities.select("company_name", "name", normalized(F.col("name")).alias("norm"), at.alias("known_at")).where("norm <> ''")
    return e.groupBy("company_name", "norm").agg(F.min_by("name", F.struct("known_at", "name")).alias("known_name"), F.min("known_at").alias("known_at"))


def resolve_known(names: DataFrame, entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Names (company_name, raw_name) against a fixed table of entities (company_name, name): ``name`` and ``method``.

    The names do not see each other. One without a match, or a generic one, has null in both.
    """
    asked = names.select("company_name", "raw_name").distinct()
    met = materialize(asked.withColumn("norm", normalized(F.col("raw_name"))).withColumn("generic", is_generic(F.col("raw_name"))), "resolve-asked")
    known = materialize(stored_names(entities).drop("known_at").join(asked.select("company_name").distinct(), "company_name", "left_semi"), "resolve-known")
    every = known.select("company_name", "norm").union(met.where("norm <> '' and not generic").select("company_name", "norm")).distinct()
    open_ = met.where("norm <> '' and not generic").join(known, ["company_name", "norm"], "left_anti").select("company_name", "norm").distinct()
    pairs = similar_pairs(every, threshold, asked=open_).join(known.select("company_name", F.col("norm").alias("b"), "known_name"), ["company_name", "b"])
    best = pairs.groupBy("company_name", F.col("a").alias("norm")).agg(F.min_by(F.struct("known_name", "score"), F.struct((-F.col("score")).alias("s"), "b")).alias("best"))
    exact = F.col("known_name").isNotNull() & ~F.col("generic")
    found = met.join(known, ["company_name", "norm"], "left").join(best, ["company_name", "norm"], "left")
    likest = F.col("best").isNotNull() & ~F.col("generic")
    return found.select(
        "company_name",
        "raw_name",
        F.when(exact, F.col("known_name")).when(likest, F.col("best.known_name")).alias("name"),
        F.when(exact, F.lit("exact")).when(likest, method_text(F.col("best.score"))).alias("method"),
    )


def resolve(mentions: DataFrame, threshold: float = THRESHOLD, stored: DataFrame | None = None) -> DataFrame:
    """Mentions with ``name`` and ``method`` (``exact``, ``fuzzy:<score>`` or null for new).

    ``stored`` (company_name, name, optionally ``known_at`` as :func:`moment` gives it): entities of earlier runs, all of
    them known before the first article.

    A name matches only names of earlier articles, never others of its own. Of several similar names the likest wins,
    then the earliest, then the first by name. Generic names and names that normalise to nothing are always new; generic
    ones are known to later articles all the same, as are stored ones.
    """
    mentions = materialize(mentions, "resolve-mentions")
    key = ["company_name", "norm"]
    first = lambda c: F.min(F.when(c, F.struct("extracted_at", "article_id", "item", "raw_name")))
    # a name is known from its first generic mention on at the latest, and from its first other one if it leads
    seen = mentions.select("*", normalized(F.col("raw_name")).alias("norm"), is_generic(F.col("raw_name")).alias("generic")).where("norm <> ''").groupBy(*key).agg(first(~F.col("generic")).alias("open"), first(F.col("generic")).alias("fixed"))
    seen = seen.withColumns({n: F.when(F.col(n).isNotNull(), F.struct(moment(mentions, f"{n}.").alias("here"), f"{n}.item", f"{n}.raw_name")) for n in ("open", "fixed")})
    if stored is not None:
        old = stored_names(stored.join(mentions.select("company_name").distinct(), "company_name", "left_semi"))
        old = old.select(*key, F.struct(F.col("known_at").alias("here"), F.lit(None).cast(seen.schema["fixed"].dataType["item"].dataType).alias("item"), F.col("known_name").alias("raw_name")).alias("old"))
        is_old = F.col("old").isNotNull()
        # a stored name asks for similar ones only where it is met no later than it became known
        met = F.col("open").isNotNull() & (~is_old | ~F.coalesce(F.col("old.here") < F.col("open.here"), F.lit(False)))
        seen = seen.join(old, key, "full_outer").select(*key, F.when(~is_old, F.col("open")).alias("open"), F.coalesce("old", "fixed").alias("fixed"), met.alias("asks"))
    else:
        seen = seen.withColumn("asks", F.col("open").isNotNull())
    seen = materialize(seen.withColumn("open", F.when(F.col("fixed").isNull() | (F.col("open.here") <= F.col("fixed.here")), F.col("open"))), "resolve-known")
    # a name's times go with it; of all that are alike only pairs with a known name, which are few, are ever made
    long, alike = _alike(seen.select(*key, "asks", F.col("open.here").alias("open_at"), F.col("fixed.here").alias("fixed_at")), threshold, ("open_at", "fixed_at"))
    led = _leading(long, alike).withColumn("leader", F.lit(True))
    leads = F.col("open").isNotNull() & (F.col("leader").isNotNull() | (F.char_length("norm") < MIN_FUZZY))
    by_generic = F.coalesce((F.col("fixed.here") == F.col("open.here")) & (F.col("fixed.item") < F.col("open.item")), F.lit(False))
    known = seen.join(led, key, "left").select(*key, F.when(leads, F.col("open.here")).otherwise(F.col("fixed.here")).alias("known_at"), F.when(leads & ~by_generic, F.col("open.raw_name")).otherwise(F.col("fixed.raw_name")).alias("known_name"))
    known = materialize(known.where("known_at is not null"), "resolve-leaders")
    # a name's likest leader so far changes with time: each change is kept, so that a mention looks its own up
    others = known.where(F.char_length("norm") >= MIN_FUZZY).select("company_name", F.col("norm").alias("other"), sorted_words(F.col("norm")).alias("s"), F.col("known_at").alias("other_at"), F.col("known_name").alias("other_name"))
    options = _pairs_with(others, alike, long.where("asks").select(*key, "s"))
    in_time = W.partitionBy(*key).orderBy("other_at", F.desc("score"), "other").rowsBetween(W.unboundedPreceding, -1)
    better = options.withColumn("before", F.max("score").over(in_time)).where("before is null or score > before")
    steps = better.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("other_at", "score", "other_name"))).alias("steps"))
    # mentions are dealt by their norm as they are; what else follows from their columns is made where they arrive
    m = mentions.repartition(tasks_for(mentions.sparkSession, mentions.count(), MENTIONS), "company_name", normalized(F.col("raw_name")))
    m = m.withColumn("norm", normalized(F.col("raw_name"))).join(known.join(steps, key, "full_outer").hint("shuffle_hash"), key, "left")
    m = m.withColumns({"asks": ~is_generic(F.col("raw_name")) & (F.col("norm") != ""), "here": moment(mentions)})
    exact = F.col("asks") & F.coalesce(F.col("known_at") < F.col("here"), F.lit(False))
    earlier = F.filter("steps", lambda x: x["other_at"] < F.col("here"))
    out = m.withColumn("best", F.when(~exact & F.col("asks"), F.try_element_at(earlier, F.lit(-1))))
    likest = F.col("asks") & F.col("best").isNotNull()
    return out.select(
        *mentions.columns,
        F.when(exact, F.col("known_name")).when(likest, F.col("best.other_name")).when(F.col("asks"), F.coalesce("known_name", "raw_name")).otherwise(F.col("raw_name")).alias("name"),
        F.when(exact, F.lit("exact")).when(likest, method_text(F.col("best.score"))).alias("method"),
    )


def candidate_names(unresolved: DataFrame, known: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``company_name, candidate``: the known names to show with a company's unresolved ones.

    All of them where there are at most ``limit``; else, for each unresolved name, its likest ``max(1, limit // n)``.
    ``unresolved``: company_name, raw_name; ``known``: company_name, name. The known names of one company are compared
    with its own unresolved ones only.

    Names with the same words come first, then those at or over THRESHOLD, from shared runs of letters. Both are whole,
    so a name that has enough of them is done; only the others are compared with all known names, block by block.
    """
    u = unresolved.select("company_name", "raw_name").distinct().withColumn("n_u", F.count("*").over(W.partitionBy("company_name")))
    k = known.select("company_name", "name").distinct()
    n_k = k.groupBy("company_name").agg(F.count("*").alias("n_k"))
    k = k.join(n_k, "company_name")
    few = k.where(F.col("n_k") <= limit).join(u.select("company_name").distinct(), "company_name", "left_semi").select("company_name", F.col("name").alias("candidate"))
    words = lambda c: F.coalesce(sorted_words(F.col(c)), F.lit(""))
    norm = lambda c: F.coalesce(normalized(F.col(c)), F.lit(""))
    u = u.join(n_k.where(F.col("n_k") > limit), "company_name", "left_semi").withColumn("each", F.greatest(F.lit(1), F.expr(f"{limit} div n_u")))
    u = materialize(u.select("company_name", "raw_name", "each", words("raw_name").alias("x"), norm("raw_name").alias("a")), "candidates-asked")
    k = materialize(k.where(F.col("n_k") > limit).select("company_name", "name", words("name").alias("y"), norm("name").alias("b")), "candidates-known")
    ask, row = ["company_name", "raw_name"], ["company_name", "raw_name", "each", "name", "score"]
    # of names with the same words only the first so many can be shown, and they are the same for all who ask
    same = W.partitionBy("company_name", "y").orderBy("name")
    first = k.withColumn("r", F.row_number().over(same)).where(F.col("r") <= limit)
    found = u.join(first, (u.company_name == first.company_name) & (u.x == first.y) & (F.col("r") <= F.col("each"))).select(u.company_name, "raw_name", "each", "name", F.lit(100.0).alias("score"))
    found = materialize(found, "candidates-same")
    short = lambda f: u.join(f.groupBy(*ask).agg(F.count("*").alias("n")), ask, "left").where(F.coalesce("n", F.lit(0)) < F.col("each")).drop("n")
    rest = materialize(short(found), "candidates-rest")
    if not rest.isEmpty():
        names = rest.select("company_name", F.col("a").alias("norm")).union(k.join(rest.select("company_name").distinct(), "company_name", "left_semi").select("company_name", "b")).distinct()
        pairs = similar_pairs(names, asked=rest.select("company_name", F.col("a").alias("norm")))
        near = rest.join(pairs, ["company_name", "a"]).join(k, ["company_name", "b"]).where("x <> y").select(*row)
        found = materialize(found.union(near), "candidates-near")
        rest = materialize(short(found), "candidates-rest")
    if not rest.isEmpty():
        found = found.join(rest.select(*ask), ask, "left_anti").union(_likest(rest, k))
    top = F.row_number().over(W.partitionBy(*ask).orderBy(F.desc("score"), "name"))
    return few.union(found.withColumn("r", top).where(F.col("r") <= F.col("each")).select("company_name", F.col("name").alias("candidate"))).distinct()


def _likest(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each asked name its likest known ones of every block, ``each`` at most: company_name, raw_name, each, name, score."""
    parts = lambda d: d.groupBy("company_name").agg(F.expr(f"int(ceil(count(*) / {BLOCK}.0))").alias("parts"))
    n_u, n_k = parts(asked).withColumnRenamed("parts", "n_u"), parts(known).withColumnRenamed("parts", "n_k")
    u = asked.join(n_u, "company_name").join(n_k, "company_name").withColumn("i", F.pmod(F.xxhash64("raw_name"), F.col("n_u"))).withColumn("j", F.explode(F.expr("sequence(0, n_k - 1)")))
    k = known.join(n_u, "company_name").join(n_k, "company_name").withColumn("j", F.pmod(F.xxhash64("name"), F.col("n_k")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0L, n_u - 1L)")))
    u, k = u.select("company_name", "i", "j", "raw_name", "each", "x"), k.select("company_name", "i", "j", "name", "y")
    return u.groupBy("company_name", "i", "j").cogroup(k.groupBy("company_name", "i", "j")).applyInPandas(_block_likest, "company_name string, raw_name string, each int, name string, score double")


def _block_likest(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    out = []
    names = list(zip(known["name"], known["y"], strict=True))
    for company, raw, each, x in zip(asked["company_name"], asked["raw_name"], asked["each"], asked["x"], strict=True):
        best = heapq.nsmallest(int(each), ((-long_score(x, y), n) for n, y in names))
        out += [(company, raw, int(each), n, -s) for s, n in best]
    return pd.DataFrame(out, columns=["company_name", "raw_name", "each", "name", "score"])


def long_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas``: scores of pairs (x, y) of any length."""
    for b in batches:
        yield b.assign(score=[long_score(x, y) for x, y in zip(b["x"], b["y"], strict=True)])

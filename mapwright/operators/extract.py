"""Extraction replies: parsing and checking them, and pluggable extractors that make them.

No model is called here. An :class:`Extractor` turns a chunk into a JSON reply; the default finds names of a gazetteer
and the wording between them. Replies of any extractor go through the same checks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions.json_repair import repaired
from mapwright.functions.vocab import ENTITY_KINDS, RELATION_KINDS, canonical_relation, kept_phrase, matched_relation, strip


class Extractor(Protocol):
    def __call__(self, text: str) -> str: ...


class Resolver(Protocol):
    """Settles names that no rule could: a request as JSON, a reply ``{"resolved": [{"article_name", "canonical_name"}]}``."""

    def __call__(self, request: str) -> str: ...


class Reviewer(Protocol):
    """Maps wordings to predicates: a JSON list of them, a reply ``{"resolved": [{"phrase", "canonical"}]}``."""

    def __call__(self, phrases: str) -> str: ...


class Gazetteer:
    """Finds given names in a text; two names in one sentence are related by the words between them."""

    def __init__(self, kinds: dict[str, str]) -> None:
        self.kinds = kinds
        self.find = re.compile("|".join(re.escape(n) for n in sorted(kinds, key=lambda n: (-len(n), n))) or "(?!)")

    def __call__(self, text: str) -> str:
        entities, relationships = {}, []
        for sentence in re.split(r"[.\n]", text):
            found = [(m.start(), m.end(), m.group()) for m in self.find.finditer(sentence)]
            for _, _, name in found:
                entities.setdefault(name, {"name": name, "kind": self.kinds[name], "domain": "Other", "description": None})
            for (_, end, a), (start, _, b) in zip(found, found[1:], strict=False):
                words = sentence[end:start].strip()
                if words and a != b:
                    relationships.append({"source": a, "target": b, "relation": words, "relation_phrase": None, "as_of": None})
        return json.dumps({"entities": list(entities.values()), "relationships": relationships})


def _first_answer(models: list, request: str, attempts: int) -> tuple[str | None, str | None]:
    """(reply, null), or (null, the last error) where every attempt of every model fails."""
    error = None
    for model in models:
        for _ in range(attempts):
            try:
                return model(request), None
            except Exception as e:  # noqa: BLE001  the next attempt or model takes over
                error = f"{type(e).__name__}: {e}"[:1000]
    return None, error


@dataclass(frozen=True)
class Models:
    """What a run may ask, each kind in order of preference."""

    extractors: tuple[Extractor, ...] = ()
    reviewers: tuple[Reviewer, ...] = ()
    resolvers: tuple[Resolver, ...] = ()


def ask(chunks: DataFrame, extractors: list[Extractor], attempts: int = 3, recorded: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``reply`` and ``error``: extractors are asked in order, each so often while it fails; where all
    fail the reply is null and the error is the last one.

    Texts with a ``recorded`` (text, reply) answer get that one and are not asked for; of several the least counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            have = b["reply"].astype(object).where(b["reply"].notna(), None)
            found = [_first_answer(extractors, t, attempts) if r is None else (r, None) for t, r in zip(b["text"], have, strict=True)]
            yield b.assign(reply=[r for r, _ in found], error=[e for _, e in found])

    if recorded is None:
        known = chunks.withColumn("reply", F.lit(None).cast("string"))
    else:
        known = chunks.join(recorded.where("reply is not null").groupBy("text").agg(F.min("reply").alias("reply")), "text", "left").select(*chunks.columns, "reply")
    known = known.withColumn("error", F.lit(None).cast("string"))
    return known.mapInPandas(run, known.schema) if extractors else known


def _kind(of: str) -> str:
    """SQL: the JSON type at ``of`` (a variant): null where there is nothing, ``VOID`` for a JSON null."""
    return f"regexp_extract(schema_of_variant({of}), '^[A-Z]+', 0)"


def _texts(item: str, must: tuple[str, ...], may: tuple[str, ...], other: tuple[str, ...] = ()) -> str:
    """SQL: whether an item is an object with strings at ``must``; strings or nothing at ``other``; or nulls at ``may``."""
    def at(name: str) -> str:
        return _kind(f"try_variant_get({item}, '$.{name}', 'variant')")
    tests = [f"coalesce({_kind(item)}, '') = 'OBJECT'", *(f"coalesce({at(n)}, '') = 'STRING'" for n in must)]
    tests += [f"coalesce({at(n)}, 'STRING') = 'STRING'" for n in other] + [f"coalesce({at(n)}, 'VOID') in ('STRING', 'VOID')" for n in may]
    return "(" + " and ".join(tests) + ")"


def _text(item: str, name: str) -> str:
    return f"try_variant_get({item}, '$.{name}', 'string')"


def _mended(reply: str) -> Column:
    """A reply as it is where it is JSON, else repaired."""
    whole = F.try_parse_json(reply).isNotNull()
    return F.coalesce(F.when(whole, F.col(reply)), repaired(F.when(~whole, F.col(reply))))


def parse(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """``replies`` with ``graph`` and ``valid``. Code fences and words around the object are dropped; what is no JSON then
    is repaired (:func:`mapwright.functions.json_repair.repair`), in Python for such replies only.

    A missing list counts as empty, a missing kind as ``service``, a missing domain as ``Other``. One item with a wrong
    type or an unknown kind makes the whole reply invalid.
    """
    bare = F.regexp_extract(F.col(reply_col), r"(?s)\{.*\}", 0)
    r = replies.withColumn("_v", F.try_parse_json(bare))
    r = r.withColumn("_mended", repaired(F.when(F.col("_v").isNull(), F.col(reply_col)))).withColumn("_v", F.coalesce("_v", F.try_parse_json("_mended")))
    for name in ("entities", "relationships"):
        r = r.withColumn(f"_{name}", F.expr(f"try_variant_get(_v, '$.{name}', 'variant')"))
        r = r.withColumn(f"_{name}_ok", F.expr(f"coalesce({_kind(f'_{name}')}, 'ARRAY') = 'ARRAY'"))
        r = r.withColumn(f"_{name}", F.expr(f"if(_{name} is null, array(), try_variant_get(_{name}, '$', 'array<variant>'))"))
    kinds = ", ".join(f"'{k}'" for k in ENTITY_KINDS)
    good_entity = _texts("x", ("name",), ("description",), ("kind", "domain")) + f" and coalesce({_text('x', 'kind')}, 'service') in ({kinds})"
    good_edge = _texts("x", ("source", "target", "relation"), ("relation_phrase", "as_of"))
    valid = F.expr(
        f"coalesce({_kind('_v')} = 'OBJECT' and _entities_ok and _relationships_ok and forall(_entities, x -> {good_entity}) and forall(_relationships, x -> {good_edge}), false)"
    )
    entity = f"named_struct('name', {_text('x', 'name')}, 'kind', coalesce({_text('x', 'kind')}, 'service'), 'domain', coalesce({_text('x', 'domain')}, 'Other'), 'description', {_text('x', 'description')})"
    edge = "named_struct(" + ", ".join(f"'{n}', {_text('x', n)}" for n in ("source", "target", "relation", "relation_phrase", "as_of")) + ")"
    graph = F.expr(f"named_struct('entities', transform(_entities, x -> {entity}), 'relationships', transform(_relationships, x -> {edge}))")
    r = r.withColumn("valid", valid).withColumn("graph", F.when(F.col("valid"), graph))
    return r.select(*replies.columns, "graph", "valid")


def relationships_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the valid replies' relationships, canonical, with the wording kept and whether it needs a review."""
    rows = parsed.where("valid").select(*keys, F.posexplode("graph.relationships").alias("item", "r")).select(*keys, "item", "r.*")
    raw = F.col("relation")
    return rows.select(*keys, "item", "source", "target", canonical_relation(raw).alias("relation"), kept_phrase(raw, F.col("relation_phrase")).alias("relation_phrase"), "as_of", matched_relation(raw).isNull().alias("needs_review"))


def entities_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.where("valid").select(*keys, F.posexplode("graph.entities").alias("item", "e")).select(*keys, "item", "e.*")


def apply_relation_reply(edges: DataFrame, reply: DataFrame) -> DataFrame:
    """Edges under review take the predicate that ``reply`` (phrase, canonical) gives for their wording, if it is one."""
    good = reply.where(F.col("canonical").isin(*RELATION_KINDS)).select(F.col("phrase").alias("_phrase"), F.col("canonical").alias("_canonical")).dropDuplicates(["_phrase"])
    hit = edges.join(good, F.col("needs_review") & (F.col("relation_phrase") == F.col("_phrase")), "left")
    return hit.withColumn("relation", F.coalesce("_canonical", "relation")).withColumn("needs_review", F.col("needs_review") & F.col("_canonical").isNull()).select(edges.columns)


def unresolved_phrases(edges: DataFrame) -> DataFrame:
    return edges.where("needs_review").select(F.col("relation_phrase").alias("phrase")).distinct().orderBy("phrase")


def review(edges: DataFrame, reviewers: list[Reviewer], attempts: int = 3, batch: int = 200) -> DataFrame:
    """Edges whose predicate was a fallback, after the reviewers were asked for their distinct wordings, ``batch`` at a
    time over all articles. What they do not know, or answer with a predicate that there is not, keeps the fallback."""
    phrases = unresolved_phrases(edges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                own = f["phrase"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"reply": [_first_answer(reviewers, json.dumps(own), attempts)[0]]})

    replies = phrases.mapInPandas(run, "reply string")
    items = replies.select(F.explode(F.from_json(_mended("reply"), "resolved array<struct<phrase:string,canonical:string>>").resolved).alias("r")).select("r.*")
    return apply_relation_reply(edges, items).withColumn("needs_review", F.lit(False))


def settle(mentions: DataFrame, candidates: DataFrame, resolvers: list[Resolver], attempts: int = 3) -> DataFrame:
    """Mentions that no rule resolved (``method`` is null), after the resolvers were asked once for each article.

    ``mentions``: company_name, article_id, raw_name, kind, domain, description, name, method. ``candidates``:
    company_name, candidate. A pair of a reply counts if both its names are more than white space; its mention takes
    the name, with the method ``llm``; of two answers for a name the last counts. Names that were not asked for, and broken replies, change nothing.
    """
    key = ["company_name", "article_id"]
    asked = mentions.where("method is null").groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(F.col("raw_name").alias("name"), "kind", "domain", "description"))).alias("names"))
    shown = candidates.groupBy("company_name").agg(F.sort_array(F.collect_set("candidate")).alias("known"))
    none = F.array().cast("array<string>")
    requests = asked.join(shown, "company_name", "left").select(*key, F.to_json(F.struct("company_name", "names", F.coalesce("known", none).alias("known"))).alias("request"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[key].assign(reply=[_first_answer(resolvers, r, attempts)[0] for r in f["request"]])

    kinds = dict(mentions.dtypes)
    replies = requests.mapInPandas(run, f"company_name {kinds['company_name']}, article_id {kinds['article_id']}, reply string")
    pairs = replies.select(*key, F.posexplode(F.from_json(_mended("reply"), "resolved array<struct<article_name:string,canonical_name:string>>").resolved).alias("_k", "r"))
    pairs = pairs.select(*key, "_k", strip(F.col("r.article_name")).alias("_asked"), strip(F.col("r.canonical_name")).alias("_to")).where("_asked <> '' and _to <> ''")
    last = pairs.groupBy(*key, "_asked").agg(F.max_by("_to", "_k").alias("_to"))
    # what a rule has resolved stays where it is; only the others meet the answers
    hit = mentions.where("method is null").withColumn("_asked", F.col("raw_name")).join(last, [*key, "_asked"], "left")
    hit = hit.withColumn("name", F.coalesce("_to", "name")).withColumn("method", F.when(F.col("_to").isNotNull(), "llm").otherwise(F.col("method")))
    return hit.select(mentions.columns).unionByName(mentions.where("method is not null"))

"""Controlled vocabularies and the columns that map free wording onto them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the data model.
ENTITY_KINDS = ("service", "datastore", "queue", "external_system", "library", "model", "team")
RELATION_KINDS = (
    "calls", "routes_to", "reads_from", "writes_to", "publishes_to", "subscribes_to", "depends_on", "composes", "replaced_by",
    "deployed_on", "deploys", "caches", "owns", "authenticates_with", "replicates_to", "monitors", "derived_from",
)
FALLBACK_RELATION = "depends_on"
DOMAINS = (
    "Authentication", "Recommendation Engine", "Messaging & Real-Time", "Compute Orchestration", "Observability", "Data Platform",
    "ML/Detection", "Media/Content Pipeline", "Network Infrastructure", "Developer Platform", "Other",
)
ARTICLE_STAGES = ("scraped", "cleaned", "extracted", "merged")
JOB_STATES = ("pending", "scraping", "cleaning", "extracting", "merging", "done", "error")
NON_ARTICLE_SEGMENTS = ("/tagged/", "/tag/", "/category/", "/categories/", "/author/", "/about")
CHALLENGE_MARKERS = ("Attention Required! | Cloudflare", "Just a moment...", "cf-chl")
GENERIC_QUALIFIERS = ("new", "old", "legacy", "current", "existing", "updated", "original", "previous")
GENERIC_NOUNS = (
    "service", "microservice", "api", "system", "gateway", "layer", "app", "application", "component",
    "database", "db", "pipeline", "engine", "cluster", "worker", "endpoint", "module", "tool",
)
SYNONYMS = {
    "calls": ("calls", "invokes", "requests", "sends requests to", "sends traffic to", "talks to", "communicates with"),
    "routes_to": ("routes", "routes requests to", "routes to", "proxies", "proxies calls to", "forwards", "load balances", "dispatches to"),
    "reads_from": ("queries", "reads from", "reads", "loads from", "fetches", "fetches from", "downloads", "pulls", "consumes from", "retrieves"),
    "writes_to": ("writes to", "writes", "persists to", "stores data in", "stores in", "stores", "saves to", "ingests into", "indexes into"),
    "publishes_to": ("publishes to", "publishes", "produces to", "produces", "emits to", "emits", "pushes", "sends events to"),
    "subscribes_to": ("subscribes to", "subscribes", "consumes", "listens to"),
    "depends_on": ("depends on", "uses", "relies on", "built on", "integrates with", "leverages"),
    "composes": ("includes", "composes", "aggregates", "comprises", "contains", "consists of", "made up of", "part of"),
    "replaced_by": ("replaced by", "replaces", "migrated to", "migrates", "succeeded by", "deprecated by"),
    "deployed_on": ("deployed on", "runs on", "hosted on", "scheduled on"),
    "deploys": ("deploys", "provisions", "orchestrates", "schedules"),
    "caches": ("caches", "cached by", "fronts"),
    "owns": ("owns", "maintains", "operates", "built by", "developed by", "hosts"),
    "authenticates_with": ("authenticates with", "authenticates via", "authorizes with"),
    "replicates_to": ("replicates to", "syncs to", "mirrors to"),
    "monitors": ("monitors", "observes", "traces", "alerts on", "captures", "instruments"),
    "derived_from": ("derived from", "computed from", "generated from", "trained on"),
}

SYNONYM_WORDS = 3


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def collapsed(raw: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))


def matched_relation(raw: Column) -> Column:
    """The predicate of a wording, or null: a predicate's own words, a synonym, or a synonym as its leading words.

    No synonym has more than three words, so the longest that fits is found by looking up the first three, two and one.
    A predicate's own name counts only as the whole wording.
    """
    words, own = collapsed(raw), {k.replace("_", " "): k for k in RELATION_KINDS}
    table = _literal_map({phrase: kind for kind, phrases in SYNONYMS.items() for phrase in phrases})
    lead = [F.substring_index(words, " ", n) for n in range(SYNONYM_WORDS, 0, -1)]
    return F.coalesce(F.try_element_at(_literal_map(own), words), F.try_element_at(table, words), *[F.try_element_at(table, x) for x in lead])


def canonical_relation(raw: Column) -> Column:
    return F.coalesce(matched_relation(raw), F.lit(FALLBACK_RELATION))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def kept_phrase(raw: Column, phrase: Column) -> Column:
    """The original wording: ``phrase`` if given, else the stripped ``raw`` where it differs from its predicate."""
    own = strip(raw)
    return F.coalesce(phrase, F.when(own != canonical_relation(raw), own))


def is_generic(name: Column) -> Column:
    """A description such as "the new service", which two articles may use for different things."""
    qualifier, noun = "|".join(GENERIC_QUALIFIERS), "|".join(GENERIC_NOUNS)
    return name.rlike(rf"(?i)^(?U:\s*)(the |a |an |this |that )?({qualifier})\b.*\b({noun})\b")


def humanized(relation: Column) -> Column:
    return F.translate(relation, "_", " ")


def label(text: Column) -> Column:
    """White space as single spaces; ``?`` where nothing is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")), F.lit("?"))

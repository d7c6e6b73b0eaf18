"""The library's functions for SQL text: ``register(spark)``, then ``select entity_key(company, name) from ...``.

They are SQL functions of the session, so Catalyst inlines their bodies like any other expression: no Python runs.
Vocabularies come from :mod:`vocab`; tests hold every function against its column form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .vocab import FALLBACK_RELATION, GENERIC_NOUNS, GENERIC_QUALIFIERS, NON_ARTICLE_SEGMENTS, RELATION_KINDS, SYNONYM_WORDS, SYNONYMS


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{x}'" for pair in pairs.items() for x in pair) + ")"


def _matched(raw: str) -> str:
    own = _map({k.replace("_", " "): k for k in RELATION_KINDS})
    table = _map({phrase: kind for kind, phrases in SYNONYMS.items() for phrase in phrases})
    lead = ", ".join(f"try_element_at({table}, substring_index(collapsed({raw}), ' ', {n}))" for n in range(SYNONYM_WORDS, 0, -1))
    return f"coalesce(try_element_at({own}, collapsed({raw})), try_element_at({table}, collapsed({raw})), {lead})"


def _bodies() -> list[tuple[str, str, str, str]]:
    """(name, arguments, result, body); later ones may use earlier ones."""
    generic = rf"(?i)^(the |a |an |this |that )?({'|'.join(GENERIC_QUALIFIERS)})\b.*\b({'|'.join(GENERIC_NOUNS)})\b"
    segments = "|".join(NON_ARTICLE_SEGMENTS)
    words = "transform(array(filter(split(collapsed(name), ' '), w -> w <> '')), a -> array_join(array_sort(a), ' '))[0]"
    count = "case when n <= size then 1L when overlap >= size then cast(raise_error('the overlap must be smaller than a chunk') as bigint) else 1L + cast(ceil((n - size) / (size - overlap)) as bigint) end"
    return [
        ("collapsed", "raw string", "string", "trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' '))"),
        ("stripped", "raw string", "string", r"regexp_replace(raw, r'(?U)^\s+|\s+$', '')"),
        ("slug", "raw string", "string", "coalesce(nullif(translate(collapsed(raw), ' ', '-'), ''), 'x')"),
        ("normalized_name", "name string", "string", "collapsed(name)"),
        ("sorted_words", "name string", "string", words),
        ("entity_key", "company string, name string", "string", "concat_ws('--', slug(company), slug(name))"),
        ("relationship_key", "company string, source string, relation string, target string", "string", "concat_ws('--', slug(company), slug(source), slug(relation), slug(target))"),
        ("url_path", "url string", "string", "regexp_extract(url, r'^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"),
        ("url_host", "url string", "string", "regexp_extract(url, r'^(?:[^:/?#]+:)?//([^/?#]*)', 1)"),
        ("url_key", "url string", "string", "coalesce(nullif(regexp_extract(regexp_replace(url_path(url), '/+$', ''), '-([0-9a-f]{12})$', 1), ''), nullif(regexp_replace(regexp_replace(url_path(url), '/+$', ''), '^/+', ''), ''), url_host(url))"),
        ("is_article_url", "url string", "boolean", f"url_path(url) not in ('', '/') and not url rlike '{segments}'"),
        ("is_generic", "name string", "boolean", f"stripped(name) rlike r'{generic}'"),
        ("matched_relation", "raw string", "string", _matched("raw")),
        ("canonical_relation", "raw string", "string", f"coalesce(matched_relation(raw), '{FALLBACK_RELATION}')"),
        ("kept_phrase", "raw string, phrase string", "string", "coalesce(phrase, case when stripped(raw) <> canonical_relation(stripped(raw)) then stripped(raw) end)"),
        ("humanized", "relation string", "string", "translate(relation, '_', ' ')"),
        ("label", "raw string", "string", r"coalesce(nullif(stripped(regexp_replace(raw, r'(?U)\s+', ' ')), ''), '?')"),
        ("text_tokens", "raw string", "array<string>", r"regexp_extract_all(raw, r'\s*\S+|\s+', 0)"),
        ("n_chunks", "n bigint, size int, overlap int", "bigint", count),
    ]


#: Chunks of one text, for a lateral join: ``from docs, lateral text_chunks(docs.text, 8000, 500)``.
_CHUNKS = """create or replace temporary function text_chunks(raw string, size int, overlap int)
returns table (chunk bigint, first_token bigint, n_tokens int, text string)
return select c, c * (size - overlap), cardinality(slice(t, cast(c * (size - overlap) + 1 as int), size)), array_join(slice(t, cast(c * (size - overlap) + 1 as int), size), '')
from (select t, n_chunks(cardinality(t), size, overlap) n from (select text_tokens(coalesce(raw, '')) t)) lateral view explode(sequence(0L, n - 1)) e as c"""


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names. Functions of the same names are replaced."""
    names = []
    for name, arguments, result, body in _bodies():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
        names.append(name)
    spark.sql(_CHUNKS)
    return [*names, "text_chunks"]

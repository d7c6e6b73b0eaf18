"""Keys that articles, entities and relationships are stored under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import collapsed


def slug(text: Column) -> Column:
    """Lower case; runs of other characters than a-z and 0-9 as one hyphen, none at the ends; ``x`` if nothing is left."""
    return F.coalesce(F.nullif(F.translate(collapsed(text), " ", "-"), F.lit("")), F.lit("x"))


def normalized(name: Column) -> Column:
    """The form in which names are compared; may be empty."""
    return collapsed(name)


def entity_key(company: Column, name: Column) -> Column:
    return F.concat_ws("--", slug(company), slug(name))


def relationship_key(company: Column, source: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws("--", slug(company), slug(source), slug(relation), slug(target))


def url_path(url: Column) -> Column:
    """The path of a URL, by the generic syntax; malformed ones included."""
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def url_key(url: Column, with_host: bool = False) -> Column:
    """An article's key: the 12 hexadecimal digits that end its path, else the path without outer slashes, else the
    host. Query, fragment and host play no part otherwise; ``with_host`` puts the host in front."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    ending = F.regexp_extract(path, "-([0-9a-f]{12})$", 1)
    key = F.coalesce(F.nullif(ending, F.lit("")), F.nullif(F.regexp_replace(path, "^/+", ""), F.lit("")), url_host(url))
    return F.concat_ws("/", url_host(url), key) if with_host else key

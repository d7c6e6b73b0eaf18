"""Functions in SQL text against their column forms."""

import pytest
from pyspark.sql import functions as F

from mapwright.functions import keys, similarity, sql, vocab
from mapwright.operators import articles, chunk
from mapwright.plans import adapters
from mapwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "Kafka Connect", "\tThe new  API \n", "a new service", "legacy Kafka cluster", "New Relic", "Ünï-Côde/Ñ", "writes to", "Writes-To the disk", "sends requests to x", "frobnicates", "uses", "part of the", "calls", "https://x.com/a-b-0123456789ab/", "https://x.com", "//h/p?q#f", "http://x.com/tag/y", "mailto:a", "/p//", "x_y_z", None]


@pytest.fixture(scope="module")
def own(spark):
    session = spark.newSession()
    sql.register(session)
    sql.register(session)  # again, in place of the first
    return session


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("collapsed", vocab.collapsed), ("stripped", vocab.strip), ("slug", keys.slug), ("normalized_name", keys.normalized), ("sorted_words", similarity.sorted_words),
        ("url_path", keys.url_path), ("url_host", keys.url_host), ("url_key", keys.url_key), ("is_article_url", articles.is_article_url), ("is_generic", vocab.is_generic),
        ("matched_relation", vocab.matched_relation), ("canonical_relation", vocab.canonical_relation), ("humanized", vocab.humanized), ("label", vocab.label), ("text_tokens", chunk.tokens),
    ],
)
def test_functions_of_one_text(own, name, column):
    df = own.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    df.createOrReplaceTempView("texts")
    got = {r["k"]: r["x"] for r in own.sql(f"select k, {name}(t) x from texts").collect()}
    assert got == {r["k"]: r["x"] for r in df.select("k", column(F.col("t")).alias("x")).collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_queries_as_sql_text(own):
    """Queries of the test tables, written as SQL with these functions; no Python in their plans."""
    for name in ("pages", "part", "documents"):
        own.read.parquet(f"{SF}/{name}.parquet").createOrReplaceTempView(name)
    adapters.mentions(own, SF).createOrReplaceTempView("mentions")
    adapters.edges(own, SF).createOrReplaceTempView("edges")
    texts = {
        "q01_url_key": "select page_id, url_key(url) key from pages",
        "q02_slug": "select page_id, slug(url) slug from pages",
        "q03_entity_key": "select distinct company_name, raw_name, entity_key(company_name, raw_name) key from mentions",
        "q04_relationship_key": "select distinct relationship_key(company_name, source, relation, target) key, relation from edges",
        "q05_normalized_names": "select p_partkey, normalized_name(p_name || '/' || p_brand) norm from part",
        "q06_is_generic": "select p_partkey, name, is_generic(name) generic from (select p_partkey, element_at(array('The new ', 'legacy ', 'New', '', 'a previous '), cast(p_partkey % 5 + 1 as int)) || p_name || element_at(array(' service', ' Relic', ' database cluster', '', ' APIs', ' tool set'), cast(p_partkey % 6 + 1 as int)) name from part)",
        "q07_labels": r"select p_partkey, label(humanized('  ' || p_name || '\n\t' || lower(p_type) || '_x ')) label from part",
        "q42_chunks": "select doc_id, chunk, first_token, c.n_tokens, length(c.text) n_chars from documents, lateral text_chunks(documents.text, 200, 20) c",
    }
    for name, text in texts.items():
        df = own.sql(text)
        assert rows(df) == rows(QUERIES[name](own, SF)), name
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    relations = QUERIES["q08_canonical_relation"](own, SF)
    relations.createOrReplaceTempView("wordings")
    assert rows(own.sql("select p_partkey, raw, canonical_relation(raw) relation, kept_phrase(raw, null) phrase from wordings")) == rows(relations)


def test_chunks_in_sql(own):
    df = own.createDataFrame([(1, ""), (2, None), (3, "a b  c d e f g "), (4, "one")], "id int, text string")
    df.createOrReplaceTempView("short")
    got = rows(own.sql("select id, c.* from short, lateral text_chunks(short.text, 3, 1) c"))
    assert got == rows(chunk.chunk(df, "id", "text", 3, 1))
    with pytest.raises(Exception, match="overlap"):
        own.sql("select n_chunks(10L, 3, 3)").collect()

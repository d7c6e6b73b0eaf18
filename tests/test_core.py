"""The reference's behaviours on small tables."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from mapwright.functions import similarity
from mapwright.functions.keys import entity_key, relationship_key, slug, url_key
from mapwright.functions.vocab import canonical_relation, is_generic, kept_phrase, label, matched_relation
from mapwright.operators import articles as art
from mapwright.operators import backfill, chunk, clean, extract, jobs, merge, resolve, views
from mapwright.sources import sitemap
from mapwright.sources.store import MergeLock, Snapshots


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://m.com/@x/a-title-e7607acebde8", "e7607acebde8"),
        ("https://m.com/@x/a-title-e7607acebde8/", "e7607acebde8"),
        ("https://blog.x.com/2020/a-b/?q=1#top", "2020/a-b"),
        ("https://blog.x.com/", "blog.x.com"),
        ("https://blog.x.com", "blog.x.com"),
        ("a/b c", "a/b c"),
    ],
)
def test_url_key(spark, url, key):
    assert one(spark, url, url_key) == key


def test_keys(spark):
    assert one(spark, " Auth/Service! ", slug) == "auth-service" and one(spark, "日本", slug) == "x"
    assert one(spark, "A b", lambda c: entity_key(F.lit("Co. X"), c)) == "co-x--a-b"
    keys = {one(spark, n, lambda c: relationship_key(F.lit("c"), c, F.lit("writes_to"), F.lit("K"))) for n in ("User Service", "user-service", "user/service", "USER  SERVICE")}
    assert keys == {"c--user-service--writes-to--k"}


@pytest.mark.parametrize(
    ("raw", "kind", "matched"),
    [
        ("Writes To", "writes_to", True), ("writes-to", "writes_to", True), ("persists to", "writes_to", True), ("stores data in", "writes_to", True), ("writes_to", "writes_to", True),
        ("uses for distributed tracing", "depends_on", True), ("pushes schema to", "publishes_to", True), ("hosts migrated route handlers from", "owns", True), ("sends requests to the edge", "calls", True),
        ("userland thing", "depends_on", False), ("", "depends_on", False), ("routes requests to", "routes_to", True), ("deploys quickly", "deploys", True), ("caches", "caches", True), ("writes to", "writes_to", True),
    ],
)
def test_relations(spark, raw, kind, matched):
    assert one(spark, raw, canonical_relation) == kind
    assert (one(spark, raw, matched_relation) is not None) == matched


def test_phrase_is_kept(spark):
    assert one(spark, " userland thing ", lambda c: kept_phrase(c, F.lit(None).cast("string"))) == "userland thing"
    assert one(spark, "calls", lambda c: kept_phrase(c, F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("name", "generic"), [("new microservice", True), ("the old service", True), ("legacy Kafka cluster", True), ("New Relic", False), ("Open Connect", False), ("newservice", False)])
def test_generic(spark, name, generic):
    assert one(spark, name, is_generic) is generic


def test_labels(spark):
    assert one(spark, " a\n b\t", label) == "a b" and one(spark, " \n", label) == "?"


def test_scores_are_those_of_the_plain_recurrence(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc é") for _ in range(rng.randint(1, 30))), "".join(rng.choice("abc é") for _ in range(rng.randint(1, 50)))) for _ in range(60)]
    pairs += [("ab" * 30 + "x" * n, "ba" * 30 + "y" * n) for n in (0, 1, 5)] + [("a" * 69, "a" * 68 + "b"), ("é" * 61, "é" * 64), ("", "a" * 70)]

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", similarity.score("x", "y").alias("s")).collect()
    for r in got:
        want = 100.0 if r["x"] == r["y"] else 200 * slow(r["x"], r["y"]) / (len(r["x"]) + len(r["y"]))
        assert abs(r["s"] - want) < 1e-9 and similarity.lcs(r["x"], r["y"]) == slow(r["x"], r["y"])


def names(spark, rows):
    return spark.createDataFrame([("c", n, a, f"2024-01-{a:02d} 00:00:00", i) for i, (a, n) in enumerate(rows)], "company_name string, raw_name string, article_id long, t string, item long").withColumn("extracted_at", F.to_timestamp("t")).drop("t")


def plain_resolve(rows, threshold=92):
    import re

    def norm(n):
        return re.sub(r"[^a-z0-9]+", " ", n.lower()).strip()

    def key(n):
        return " ".join(sorted(norm(n).split()))

    known, out, k = {}, {}, 0
    articles = sorted({a for a, _ in rows})
    for a in articles:
        pool = dict(known)
        for i, (b, n) in enumerate(rows):
            if a != b:
                continue
            generic = bool(re.match(r"(the |a |an |this |that )?(new|old|legacy)\b.*\b(service|gateway)\b", n.strip(), re.IGNORECASE))
            if generic or not norm(n):  # never asks, but is known to later articles
                k += 1
                out[i] = (n, None)
                if norm(n):
                    known.setdefault(norm(n), (n, f"{a:05d}"))
                continue
            if norm(n) in pool:
                out[i] = (pool[norm(n)][0], "exact")
                continue
            best = sorted(((-similarity.long_score(key(n), key(m)), at, m) for m, (_, at) in pool.items() if len(norm(n)) >= 5 and len(m) >= 5))
            if best and -best[0][0] >= threshold:
                out[i] = (pool[best[0][2]][0], f"fuzzy:{round(-best[0][0])}")
                continue
            k += 1
            out[i] = (known.setdefault(norm(n), (n, f"{a:05d}"))[0], None)
    return out


def some_names(seed):
    """(article, name): spellings, likenesses, generic names with and without a qualifier that counts, blanks, all within one article too."""
    rng = random.Random(seed)
    base = ["User Service", "Payments Gateway", "Kafka Connect", "Kafka", "S3", "S4", "Title Search", "Service Registry Node", "the new service", "The  New Service", "new services", "legacy gateway", "legacy gateways", "..", "", "the new gateway"]
    rows = []
    for _ in range(140):
        n = rng.choice(base)
        n = rng.choice([n, n.upper(), n.replace(" ", "-"), n + "s", "s" + n, n[::-1] if rng.random() < 0.2 else n])
        rows.append((rng.randint(1, 25), n))
    return sorted(dict.fromkeys(rows), key=lambda r: r[0])


def lowered(found):
    return {i: (w[0].lower(), w[1]) for i, w in found.items()}


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_resolve_is_the_loop_over_articles(spark, seed):
    rows = some_names(seed)
    want = plain_resolve(rows)
    assert {(w[1] or "new").partition(":")[0] for w in want.values()} == {"new", "exact", "fuzzy"}
    got = {r["item"]: (r["name"], r["method"]) for r in resolve.resolve(names(spark, rows)).collect()}
    assert lowered(got) == lowered(want)


@pytest.mark.parametrize("seed", [6, 9])
def test_runs_and_batches_end_where_one_run_does(spark, tmp_path, seed):
    """Fed in parts, with what is known carried on as stored names, generic, blank and same-article names included."""
    from mapwright.streaming.incremental import NamesByBatch, run_available

    m = names(spark, some_names(seed)).cache()
    want = {r["item"]: (r["name"], r["method"]) for r in resolve.resolve(m).collect()}
    handler, source, ddl = NamesByBatch(spark, str(tmp_path / "state")), str(tmp_path / "in"), ", ".join(f"{n} {t}" for n, t in m.dtypes)
    for lo, hi in ((0, 3), (3, 4), (4, 12), (12, 30)):
        m.where((F.col("article_id") > lo) & (F.col("article_id") <= hi)).coalesce(1).write.mode("append").parquet(source)
        run_available(spark, source, m.schema, str(tmp_path / "checkpoint"), handler)
    assert lowered({r["item"]: (r["name"], r["method"]) for r in handler.resolved(ddl).collect()}) == lowered(want)
    # a batch that is handed over again changes nothing
    known = sorted(map(tuple, handler.names().collect()))
    handler(m.where("article_id > 3 and article_id <= 4"), 1)
    assert sorted(map(tuple, handler.names().collect())) == known
    assert lowered({r["item"]: (r["name"], r["method"]) for r in handler.resolved(ddl).collect()}) == lowered(want)
    assert handler.names().groupBy("company_name", F.lower("name")).count().where("count > 1").isEmpty()


def test_names_that_wait_for_each_other_are_decided_in_one_step(spark, monkeypatch):
    """a chain of names, each like the one before, took a round of tables for each of them."""
    rows = [(k + 1, f"{'z' * k}{'abcdefghijklmnop'}{'y' * (24 - k)}") for k in range(25)] + [(28, "quite another")]
    tags, real = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    got = {r["item"]: (r["name"], r["method"]) for r in resolve.resolve(names(spark, rows)).collect()}
    assert lowered(got) == lowered(plain_resolve(rows)) and any(m and m.startswith("fuzzy") for _, m in got.values())
    assert len(tags) <= 12, tags
    # stored names that nobody asks for are not paired with each other
    pairs = resolve.similar_pairs(spark.createDataFrame([("c", "abcdefghij", False, 1), ("c", "abcdefghijk", False, 2), ("c", "abcdefghijl", True, 3)], "company_name string, norm string, asks boolean, at int"), carried=("at",))
    assert {(r["a"], r["b"], r["a_at"], r["b_at"]) for r in pairs.collect() if r["a"] != r["b"]} <= {("abcdefghijl", "abcdefghij", 3, 1), ("abcdefghijl", "abcdefghijk", 3, 2)} and not pairs.isEmpty()


@pytest.mark.parametrize("seed", [6, 11])
def test_names_are_paired_with_known_ones_only(spark, monkeypatch, seed):
    """the earliest names are decided first, and of all that are alike no pair is made without a known name."""
    monkeypatch.setattr(resolve, "LINKS", 2)
    monkeypatch.setattr(resolve, "SENT_TEXTS", 0)
    rows = some_names(seed) + [(26 + k % 4, f"supplier {k:06d}") for k in range(60)]
    tags, real = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    got = {r["item"]: (r["name"], r["method"]) for r in resolve.resolve(names(spark, rows)).collect()}
    assert lowered(got) == lowered(plain_resolve(rows)) and "resolve-leading" in tags


def test_generic_names_are_known_to_the_next_run(spark):
    first, second = names(spark, [(1, "new service"), (1, "New Services")]), names(spark, [(2, "New Services"), (2, "new service")])
    both = resolve.resolve(names(spark, [(1, "new service"), (2, "New Services")])).orderBy("item").collect()
    assert [(r["name"], r["method"]) for r in both] == [("new service", None), ("new service", "fuzzy:96")]
    stored = resolve.resolve(first).select("company_name", "name")
    assert [(r["name"], r["method"]) for r in resolve.resolve(second, stored=stored).orderBy("item").collect()] == [("New Services", "exact"), ("new service", None)]


def test_every_order_line_is_mentioned(spark):
    from mapwright.plans import adapters

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert adapters.mentions(spark, sf).count() == 2 * n and adapters.edges(spark, sf).count() == n


def test_resolve_queries_take_all_mentions(spark):
    from mapwright.plans import adapters
    from mapwright.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["q34_resolve"](spark, sf).select("company_name", "article_id", "item", "raw_name")
    want = adapters.mentions(spark, sf).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_leaders_are_the_loop_and_spread_by_name(spark):
    rng, n = random.Random(5), 60
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(150)} | {(k, k + 1) for k in range(20)}
    seq = {k: f"{k // 2:03d}" for k in range(n)}
    data = [("c", f"n{a}", seq[a], f"n{b}", seq[b]) for x, y in pairs for a, b in ((x, y), (y, x))]
    led: set = set()
    for k in range(n):
        if not any(b in led and seq[b] < seq[k] for x, y in pairs for a, b in ((x, y), (y, x)) if a == k):
            led.add(k)
    df = resolve._leaders(spark.createDataFrame(data, "company_name string, norm string, seq string, other string, other_seq string"))
    met = {k for p in pairs for k in p}
    assert {(r["norm"], r["leader"]) for r in df.collect()} == {(f"n{k}", k in led) for k in met} and df.count() == len(met)


def test_candidates_are_capped(spark):
    known = spark.createDataFrame([("c", f"svc number {k}") for k in range(200)] + [("c", "payments gateway")], "company_name string, name string")
    got = {r["candidate"] for r in resolve.candidate_names(spark.createDataFrame([("c", "payment gateway")], "company_name string, raw_name string"), known, 10).collect()}
    assert len(got) <= 10 and "payments gateway" in got


def test_candidates_are_the_likest_of_all(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 20)
    rng, plain = random.Random(4), lambda n: " ".join(sorted(n.lower().replace("-", " ").split()))
    known = [f"{rng.choice(['svc', 'job', 'api'])} {rng.choice(['red', 'blue', 'green'])} {k}" for k in range(60)] + ["Payments Gateway", "gateway-payments", "x" * 70 + " a", "x" * 70 + " b", "payments gateways"]
    asked = ["gateway payments", "payments gatewayss", "x" * 70 + " c", "svc blu 12", "nothing like it", "s3"]
    df = spark.createDataFrame([("c", n) for n in known] + [("d", "only")], "company_name string, name string")
    ask = spark.createDataFrame([("c", n) for n in asked] + [("d", "other"), ("e", "none")], "company_name string, raw_name string")
    for limit in (3, 12, 24):
        each = max(1, limit // len(asked))
        want = {("c", n) for a in asked for _, n in sorted((-similarity.long_score(plain(a), plain(n)), n) for n in known)[:each]} | {("d", "only")}
        got = [(r["company_name"], r["candidate"]) for r in resolve.candidate_names(ask, df, limit).collect()]
        assert set(got) == want and len(got) == len(want)


def test_queries_take_all_companies(spark):
    from mapwright.plans import adapters
    from mapwright.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    stated = adapters.edges(spark, sf).where("relation in ('replaced_by', 'composes')").select("company_name").distinct()
    assert QUERIES["q44_reachable"](spark, sf).select("company_name").distinct().count() == stated.count() > 2
    companies = adapters.mentions(spark, sf).select("company_name").distinct().count()
    assert QUERIES["q35_candidates"](spark, sf).select("company_name").distinct().count() == companies > 2


def stated(spark, rows):
    data = [("c", s, r, t, None, a_of, art_, i) for i, (art_, s, r, t, a_of) in enumerate(rows)]
    return spark.createDataFrame(data, "company_name string, source string, relation string, target string, relation_phrase string, as_of string, article_id long, item long").withColumn("extracted_at", F.expr("timestamp_seconds(article_id)"))


def test_windows_close_as_in_the_loop(spark):
    rng, rows = random.Random(9), []
    for _ in range(200):
        rows.append((rng.randint(1, 30), rng.choice("ABC"), rng.choice(["calls", "replaced_by", "uses"]), rng.choice("XYZ"), rng.choice([None, "", "2020", "2021"])))
    rows.sort(key=lambda r: r[0])
    rows += [(a, "H", "calls", f"T{a}", None) for a in range(1, 31)] + [(a, "H", "replaced_by", "Z", f"h{a}") for a in (9, 20)]  # a hot source, in many parts
    rows.sort(key=lambda r: r[0])
    edges, store = stated(spark, rows), {}
    for a in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == a]
        for _, s, r, t, _of in mine:
            store.setdefault((s, r, t), None)
        for _, s, r, _t, of in mine:
            if r == "replaced_by":
                for k in store:
                    if k[0] == s and k[1] != "replaced_by" and store[k] is None:
                        store[k] = of or "RUN"
    got = {(r["source"], r["relation"], r["target"]): r["invalid_at"] for r in merge.close_windows(merge.fold_edges(edges), edges, "RUN").collect()}
    assert got == store


def test_entity_fold_and_incremental_runs_agree(spark):
    rows = [("c", n, "service", "Other", d, a, a, i) for i, (a, n, d) in enumerate([(1, "Kafka", None), (2, "kafka", "a log"), (3, "KAFKA", "other"), (2, "Zuul", ""), (4, "Zuul", "edge")])]
    m = spark.createDataFrame(rows, "company_name string, name string, kind string, domain string, description string, article_id long, s long, item long").withColumn("extracted_at", F.expr("timestamp_seconds(s)"))
    full = {r["key"]: r.asDict() for r in merge.fold_entities(m).collect()}
    assert full["c--kafka"]["name"] == "Kafka" and full["c--kafka"]["description"] == "a log" and full["c--zuul"]["description"] == "edge"
    none = F.lit(None).cast("array<struct<name:string,method:string>>").alias("aliases")
    two = merge.merge_entities(merge.fold_entities(m.where("s <= 2")).select("*", none), merge.fold_entities(m.where("s > 2")).select("*", none))
    assert {r["key"]: r.asDict() for r in two.select(*merge.fold_entities(m).columns).collect()} == full


def test_view(spark):
    e = spark.createDataFrame([("c", "A", "service", "D1"), ("c", "B", None, ""), ("c", "T", "team", "D1"), ("c", "P", "service", "D2")], "company_name string, name string, kind string, domain string")
    r = spark.createDataFrame([("c", "k1", "A", "B", "calls", "2020", None), ("c", "k2", "A", "T", "calls", None, None), ("c", "k3", "B", "A", "writes_to", None, "2021"), ("c", "k4", "P", "B", "composes", None, ""), ("c", "k5", "A", "P", "calls", None, None)], "company_name string, key string, source string, target string, relation string, as_of string, invalid_at string")
    n, g = views.nodes(e), views.edges(e, r)
    assert {(x["id"], x["kind"], x["domain"]) for x in n.collect()} == {("a", "service", "D1"), ("b", "service", "Other"), ("p", "service", "D2")}
    assert {(x["key"], x["label"]) for x in g.collect()} == {("k1", "calls (2020)"), ("k4", "composes"), ("k5", "calls")}
    # b is folded into its parent p, so the two edges of a meet
    assert {(x["source"], x["target"], x["n"], x["label"]) for x in views.bundles(n, g).collect()} == {("a", "p", 2, "calls (2020) (+1 more)")}
    assert {(x["source"], x["target"], x["n"]) for x in views.bundles(n, g, expanded=("p",)).collect()} == {("a", "b", 1), ("a", "p", 1), ("p", "b", 1)}
    assert {(x["source"], x["target"], x["n"]) for x in views.bundles(n, g, collapsed=("D1", "D2")).collect()} == {("__domain__D1", "b", 1), ("__domain__D1", "__domain__D2", 1), ("__domain__D2", "b", 1)}


def test_backfill_collapses_and_can_rerun(spark):
    rows = [(1, "A", "sends requests to", "B", None), (2, "A", "invokes", "B", "2020"), (3, "A", "calls", "B", None), (4, "A", "odd", "C", None)]
    stored = merge.fold_edges(stated(spark, rows)).withColumn("invalid_at", F.lit(None).cast("string"))
    counts = backfill.counters(stored).first()
    assert (counts["examined"], counts["rewritten"], counts["collapsed"]) == (4, 3, 2)
    done = backfill.canonicalize(stored)
    assert {(r["source"], r["relation"], r["target"]) for r in done.collect()} == {("A", "calls", "B"), ("A", "depends_on", "C")}
    assert backfill.counters(done).first()["rewritten"] == 0


def test_chunks_overlap(spark):
    d = spark.createDataFrame([(1, "word " * 1000), (2, "short"), (3, None)], "id long, t string")
    rows = chunk.chunk(d, "id", "t", 300, 50).orderBy("id", "chunk").collect()
    assert [(r["id"], r["first_token"], r["n_tokens"]) for r in rows][:5] == [(1, 0, 300), (1, 250, 300), (1, 500, 300), (1, 750, 251), (2, 0, 1)]
    assert rows[0]["text"][-5 * 50 :] == rows[1]["text"][: 5 * 50]
    with pytest.raises(Exception):
        chunk.chunk(d, "id", "t", 50, 50).collect()


def test_graph_json_is_joined_part_by_part(spark):
    """A company's nodes and edges lie in several parts; their order and the edges' numbers go on from part to part."""
    n = [(c, f"n{k}", f"L{k % 7}", "service", None if k % 5 == 0 else f'D"{k}') for c, size in (("a", 200), ("b", 3)) for k in range(size)]
    e = [("a", f"k{k % 40:02d}", f"n{k}", "n1", None if k % 9 == 0 else "x", "calls") for k in range(300)]
    nodes, edges = spark.createDataFrame(n, "company_name string, id string, label string, kind string, domain string"), spark.createDataFrame(e, "company_name string, key string, source string, target string, label string, relation string")
    assert views._numbered(edges, ["key", "source"], "test").groupBy("_part").count().count() > 1
    got = {r["company_name"]: json.loads(r["graph"]) for r in views.graph_json(nodes, edges).collect()}
    first = lambda v: (v is not None, v or "")
    for c in "ab":
        rows = sorted((r for r in n if r[0] == c), key=lambda r: (r[2], r[1], r[3], first(r[4])))
        assert got[c]["nodes"] == [{k: v for k, v in zip(("id", "label", "kind", "domain"), r[1:], strict=True) if v is not None} for r in rows]
        rows = sorted((r for r in e if r[0] == c), key=lambda r: (r[1], r[2], r[3], first(r[4]), r[5]))
        assert got[c]["edges"] == [{k: v for k, v in zip(("id", "source", "target", "label", "relation"), (f"__edge_{i}", *r[2:]), strict=True) if v is not None} for i, r in enumerate(rows)]


def test_open_references_stay_text():
    page = "<article><h1>a &amp; b&amp</h1><p>x &copy; &copy y &notit; &lt;b&gt; &#65; & &amp;amp;</p></article>"
    assert clean.clean_html(page) == "a & b&amp\nx © &copy y &notit; <b> A & &amp;"


def test_clean_html():
    html = '<html><body><nav>menu</nav><article><h1>T</h1><p>One <b>two</b><p>three<div class="sidebar">ads</div><pre><code class="language-yaml">' + "a: 1\n" * 20 + "</code></pre><pre>x = 1</pre></article><footer>f</footer></body></html>"
    text = clean.clean_html(html)
    assert "menu" not in text and "ads" not in text and "[code omitted: 21 lines, language: yaml]" in text and "x = 1" in text and text.startswith("T\nOne\ntwo\nthree")
    assert clean.clean_html(None) is None and clean.clean_html("plain") == "plain"


def test_main_block_of_pages_that_mark_none():
    menu = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(12))
    text = "".join(f"<p>Paragraph {k} says at some length what the service does, and why it was rebuilt.</p>" for k in range(6))
    page = f'<html><head><title>T</title></head><body><ul>{menu}</ul><div><table><tr><td><div id="x"><h2>Head</h2>{text}<div><a href="/s">share this on every network now</a></div><p>See <a href="/b">the book</a> for more of it.</p><ul><li>one point here</li></ul></div><td><p>Short note at the side.</p></table></div><p>All rights reserved.</p></body></html>'
    got = clean.clean_html(page)
    assert got.startswith("Head\nParagraph 0") and got.endswith("one point here") and "the book" in got
    assert not any(x in got for x in ("Section", "share", "rights", "Short note"))
    marked = clean.clean_html(page.replace('<div id="x">', "<article>"))
    assert marked.startswith("Head\nParagraph 0") and "share" not in marked
    two = f"<body><div>{text}</div><div>{text}</div></body>"
    assert clean.clean_html(two).count("Paragraph") == 12  # neither has most of it
    assert clean.clean_html('<body><div><a href="/">only links here</a></div></body>') == "only links here"
    assert clean.clean_html("<div>" * 3000 + "deep text stays readable" + "</div>" * 3000) == "deep text stays readable"
    assert clean.clean_html("<main><p>a</main><article>b</article>") == "b" and clean.clean_html("") == ""


def test_main_block_against_known_articles(spark):
    from mapwright.plans.queries import QUERIES

    rows = QUERIES["q57_main_content"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 250
    assert sum(r["n_common"] / max(1, r["n_found"]) for r in rows) / 250 > 0.97 and sum(r["n_common"] / r["n_known"] for r in rows) / 250 > 0.99
    assert sum(r["n_common"] for r in rows) / sum(r["n_found"] for r in rows) > 0.99


def test_replies(spark):
    good = '{"entities":[{"name":"A","kind":"service"}],"relationships":[{"source":"A","target":"B","relation":"pushes things to"}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, "no"), (4, good.replace("service", "robot")), (5, '{"entities":{}}'), (6, None)]
    p = extract.parse(spark.createDataFrame(rows, "id long, reply string"))
    assert [r["id"] for r in p.where("valid").orderBy("id").collect()] == [1, 2]
    r = extract.relationships_of(p, ["id"]).where("id = 1").first()
    assert (r["relation"], r["relation_phrase"], r["needs_review"]) == ("publishes_to", "pushes things to", False)
    asked = extract.ask(spark.createDataFrame([(1, "A calls B. x")], "id long, text string"), [lambda t: 1 / 0, extract.Gazetteer({"A": "service", "B": "queue"})])
    assert extract.relationships_of(extract.parse(asked), ["id"]).first()["relation"] == "calls"


@pytest.mark.parametrize(
    ("reply", "valid"),
    [
        ("{}", True), ('{"entities":[{"name":"A"}]}', True), ('{"entities":[{"name":"A","kind":null}]}', False), ('{"entities":[{"name":"A","domain":5}]}', False), ('{"entities":[{"name":"A","domain":null}]}', False),
        ('{"entities":[{"name":"A","description":null}]}', True), ('{"entities":["A"]}', False), ('{"entities":[{"kind":"service"}]}', False), ('{"entities":null}', False), ("[]", False), ('{"relationships":[]}', True),
        ('{"relationships":[{"source":"A","target":"B","relation":"uses"}]}', True), ('{"relationships":[{"source":"A","target":"B"}]}', False), ('{"relationships":[{"source":"A","target":"B","relation":"uses","as_of":2020}]}', False),
        ('Here: {"entities":[{"name":"A",}],} done', True), ('{"entities":[],"more":1}', True),
    ],
)
def test_reply_defaults_and_types(spark, reply, valid):
    r = extract.parse(spark.createDataFrame([(reply,)], "reply string")).first()
    assert r["valid"] is valid and (r["graph"] is not None) is valid
    if valid and r["graph"]["entities"]:
        assert r["graph"]["entities"][0][:3] == ("A", "service", "Other")


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
URLS = f'<?xml version="1.0"?><urlset {NS}><url><loc> https://x.com/a-b </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x.com/tag/z</loc></url><url><loc>https://x.com/</loc></url><url><loc>https://x.com/c?a=1&amp;b=2</loc></url></urlset>'


def index_of(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


BROKEN = {
    "cut": (URLS[:-20].encode(), "broken XML"), "open": (b"<urlset><url><loc>x", "broken XML"), "gzip": (gzip.compress(URLS.encode())[:-12], "broken gzip"), "notgzip": (b"\x1f\x8bnonsense", "broken gzip"),
    "page": (b"<!DOCTYPE html><HTML>no</HTML>", "an HTML page"), "none": (b"  \n", "empty"), "feed": (b"<rss><channel/></rss>", "no urlset"), "entity": (b"<urlset>&nope;</urlset>", "broken XML"), "code": (b'<?xml version="1.0" encoding="no-such"?><urlset/>', "broken XML"),
}


def test_sitemaps_as_files(spark, tmp_path):
    """Broken files are rows with a reason; indexes are followed by joins, and those that point to each other end."""
    p = str(tmp_path)
    files = {"one": gzip.compress(URLS.encode()), "index": index_of(f"file:{p}/one", f"file:{p}/index", f"file:{p}/cut", f"file:{p}/missing").encode(), "other": b"<urlset><url><loc>https://y.com/not-reached</loc></url></urlset>", "bare": b"<urlset/>"}
    files |= {f"deep{k}": index_of(f"file:{p}/deep{k + 1}" if k < 8 else f"file:{p}/index").encode() for k in range(9)} | {n: c for n, (c, _) in BROKEN.items()}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = sitemap.entries(sitemap.read_files(spark, p)).cache()
    bad = {r["path"].rpartition("/")[2]: r["reason"] for r in sitemap.quarantine(found).collect()}
    assert bad.keys() == BROKEN.keys() and all(bad[n].startswith(r) for n, (_, r) in BROKEN.items())
    assert found.where("lastmod is not null").select("loc", "lastmod").collect() == [("https://x.com/a-b", "2024-01-02")]
    start = spark.createDataFrame([(f"file:{p}/deep0",)], "path string")
    reached = sitemap.crawl(found, start)
    assert sorted(r["url"] for r in sitemap.article_urls(reached).collect()) == ["https://x.com/a-b", "https://x.com/c?a=1&b=2"]
    assert [r["path"][-3:] for r in sitemap.quarantine(reached).collect()] == ["cut"]
    by_name = lambda loc: F.regexp_replace(loc, "^https://blog[.]com", f"file:{p}")
    assert [r["url"] for r in sitemap.resolve_urls(found, "https://blog.com/page", by_name).collect()] == ["https://blog.com/page"]
    assert len(sitemap.resolve_urls(found, "https://blog.com/one", by_name).collect()) == 2
    assert sitemap.entries(spark.createDataFrame([("a", None)], "path string, content binary")).first()["reason"] == "empty"
    assert sitemap.entries(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_deep_chains_of_sitemaps_are_folded(spark, monkeypatch):
    """Long chains take few rounds; rings, twofold names and what lies below unreached files are told apart."""
    links = [(f"c{k}", f"c{k + 1}") for k in range(200)] + [(f"d{k}", x) for k in range(20) for x in (f"l{k}", f"r{k}")] + [(f"{s}{k}", f"d{k + 1}") for k in range(20) for s in "lr"]
    links += [("c200", "d0"), ("ring1", "ring2"), ("ring2", "ring1"), ("ring2", "below"), ("below", "c7"), ("a", "b"), ("d20", "b"), ("b", "b"), ("b", "c0"), ("lost", "hidden")]
    rows = [(p, "sitemap", loc, None, None) for p, loc in links] + [(p, "url", f"https://x.com/{p}", None, None) for p in ("c150", "l9", "d20", "b", "below", "hidden", "a", "ring1", "c0")]
    written, plain = [], sitemap.materialize
    monkeypatch.setattr(sitemap, "materialize", lambda df, tag: written.append(tag) or plain(df, tag))
    found = spark.createDataFrame(rows, sitemap.ENTRIES)
    for first, few in (("c0", 60), ("ring1", 60)):
        want, new = {first}, [first]
        while new:
            at = new.pop()
            new += [t for p, t in links if p == at and t not in want]
            want.update(t for p, t in links if p == at)
        written.clear()
        got = sitemap.crawl(found, spark.createDataFrame([(first,)], "path string"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[0] in want), key=str)
        assert len(written) < few


def test_sitemaps_as_a_source(spark, tmp_path):
    """Over HTTP: a partition for each file of the first index, nested indexes below, errors as rows."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            host = f"http://127.0.0.1:{self.server.server_port}"
            served = {"/": index_of(f"{host}/one", f"{host}/nested", f"{host}/gone", f"{host}/", f"{host}/cut").encode(), "/one": gzip.compress(URLS.encode()), "/nested": index_of(f"{host}/two", f"{host}/nested").encode(), "/two": b"<urlset><url><loc>https://x.com/two</loc></url></urlset>", "/cut": BROKEN["cut"][0], "/page": BROKEN["page"][0]}
            self.send_response(200 if self.path in served else 404)
            self.end_headers()
            self.wfile.write(served.get(self.path, b""))

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(sitemap.SitemapSource)
        rows = spark.read.format("sitemap").load(f"{host}/")
        assert rows.rdd.getNumPartitions() == 4
        found = rows.collect()
        assert {r["loc"] for r in found if r["kind"]} == {"https://x.com/a-b", "https://x.com/tag/z", "https://x.com/", "https://x.com/c?a=1&b=2", "https://x.com/two"}
        assert {r["path"].removeprefix(host): r["reason"].partition(":")[0] for r in found if r["reason"]} == {"/gone": "HTTP 404", "/cut": "broken XML"}
        assert {r["url"] for r in sitemap.listed(spark, f"{host}/").collect()} == {"https://x.com/a-b", "https://x.com/c?a=1&b=2", "https://x.com/two"}
        assert [r["url"] for r in sitemap.listed(spark, f"{host}/page").collect()] == [f"{host}/page"]
        (tmp_path / "map").write_text(URLS)
        assert sitemap.listed(spark, f"{tmp_path}/map {tmp_path}/none").count() == 2
    finally:
        server.shutdown()


def test_jobs(spark):
    rows = [(k, s, k, None) for k, s in enumerate(["done", "pending", "error", "done", "scraping"])]
    j = spark.createDataFrame(rows, "job_id long, status string, created_at long, error string")
    assert sorted(r["job_id"] for r in jobs.retain(j, 3).collect()) == [1, 3, 4]
    assert sorted(r["job_id"] for r in jobs.retain(j, 2).collect()) == [1, 4] and jobs.retain(j, 9).count() == 5
    many = spark.range(500).selectExpr("id job_id", "if(id % 10 = 0, 'pending', 'done') status", "id % 7 created_at", "cast(null as string) error")
    oldest = sorted((k % 7, k) for k in range(500) if k % 10)[:300]
    assert {r["job_id"] for r in jobs.retain(many, 200).collect()} == set(range(500)) - {k for _, k in oldest}
    again = jobs.save(j, j.where("job_id = 1").withColumn("status", F.lit("done")))
    assert again.count() == 5 and again.where("job_id = 1").first()["status"] == "done" and jobs.delete(again, [1, 2]).count() == 3
    assert {r["job_id"]: r["status"] for r in jobs.recover(j).collect()} == {0: "done", 1: "error", 2: "error", 3: "done", 4: "error"}


def test_store_and_lock(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.read("t", "a long, company_name string").count() == 0
    s.write("t", spark.createDataFrame([(1, "c"), (2, "d")], "a long, company_name string"))
    s.write("t", s.read("t").where("a > 1"))
    s.delete("t", F.col("a") == 9)
    assert [r["a"] for r in s.read("t").collect()] == [2]
    now = [0.0]
    lock = MergeLock(str(tmp_path / "l"), 10, lambda: now[0])
    assert lock.acquire("c") and not lock.acquire("c") and lock.acquire("d")
    now[0] = 11
    assert lock.acquire("c")
    lock.release("c")


@pytest.mark.parametrize("remote", [False, True])
def test_an_expired_holder_can_neither_release_nor_commit(spark, tmp_path, remote):
    from mapwright.sources.store import MergeInProgress

    now = [0.0]
    a, b, c = (MergeLock(str(tmp_path / "l"), 10, lambda: now[0], spark if remote else None) for _ in range(3))
    s = Snapshots(spark, str(tmp_path / "s"))
    s.write("t", spark.createDataFrame([(1, "c"), (2, "d")], "a long, company_name string"))
    first = a.acquire("c")
    s.fence("t", {"c": first})
    assert first == 1 and b.acquire("c") == 0 and b.acquire("cc") == 1
    now[0] = 11
    second = b.acquire("c")
    assert second == 2 and c.acquire("c") == 0
    a.release("c")
    assert c.acquire("c") == 0  # the lock of b still holds
    s.fence("t", {"c": second})
    rows = lambda k: spark.createDataFrame([(k, "c")], "a long, company_name string")
    with pytest.raises(MergeInProgress):
        s.replace("t", rows(7), ["c"], {"c": first})
    s.replace("t", rows(8), ["c"], {"c": second})
    assert sorted(r["a"] for r in s.read("t").collect()) == [2, 8]
    s.write("t", s.read("t"))  # a new version of the whole table keeps the fences
    with pytest.raises(MergeInProgress):
        s.replace("t", rows(7), ["c"], {"c": first})
    s.replace("t", rows(9), ["d"], {"d": 1})
    b.release("c")
    b.release("c")
    assert c.acquire("c") == 3 and a.acquire("c") == 0


def test_article_state(spark):
    rows = [("a", "c", "<p>", None, None, None), ("b", "c", None, "t", None, None), ("d", "c", None, "t", "2020", None)]
    a = spark.createDataFrame(rows, "key string, company_name string, raw_html string, cleaned_text string, extracted_at string, graph_merged_at string")
    assert [r["key"] for r in art.pending(a, "clean").collect()] == ["a"] and [r["key"] for r in art.pending(a, "extract").collect()] == ["b"]
    with pytest.raises(ValueError):
        art.pending(a, "x")
    done = art.mark_cleaned(a, spark.createDataFrame([("a", "text")], "key string, text string"))
    assert done.where("key = 'a'").select("raw_html", "cleaned_text").first() == (None, "text")
    assert art.pending_merge(a).count() == 1 and art.reset_graph(a, "c").where("graph_merged_at is not null").count() == 0


def test_streaming_ingest_once(spark, tmp_path):
    from mapwright.streaming.incremental import known_names_stream, run_available

    src, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "k")], "id long, key string").write.mode("append").parquet(src)
    handle = lambda df, n: out.extend(r["id"] for r in df.collect())
    run_available(spark, src, "id long, key string", str(tmp_path / "cp"), handle)
    spark.createDataFrame([(2, "k")], "id long, key string").write.mode("append").parquet(src)
    run_available(spark, src, "id long, key string", str(tmp_path / "cp"), handle)
    assert out == [1, 2]
    names_in = str(tmp_path / "names")
    schema = "company_name string, raw_name string, article_id long, item long"
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("c", "Kafka", 1, 1), ("c", "kafka", 1, 2), ("c", "the new service", 1, 3), ("c", "..", 1, 4)]
    more = [("c", "KAFKA", 2, 5), ("c", "Zuul", 2, 6), ("c", "zuul", 2, 7), ("c", "The New Service", 2, 8), ("c", "The  new service", 2, 9), ("c", "--", 2, 10), ("c", None, 2, 11)]
    for part in (rows, more):  # state is kept from run to run
        spark.createDataFrame(part, schema).write.mode("append").parquet(names_in)
        stream = known_names_stream(own.readStream.schema(schema).parquet(names_in))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "named")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start().awaitTermination()
    got = {r["item"]: (r["name"], r["method"]) for r in spark.read.parquet(str(tmp_path / "named")).collect()}
    assert got == {
        1: ("Kafka", None), 2: ("Kafka", None), 3: ("the new service", None), 4: ("..", None), 5: ("Kafka", "exact"), 6: ("Zuul", None), 7: ("Zuul", None),
        8: ("The New Service", None), 9: ("the new service", "exact"), 10: ("--", None), 11: (None, None),
    }
    m = spark.createDataFrame(rows + more, schema).withColumn("extracted_at", F.to_timestamp(F.lit("2024-01-01")))
    batch = {r["item"]: (r["name"], r["method"]) for r in resolve.resolve_exact(m).collect()}
    assert batch == got


def scraped(spark, store, pages, run_ts="2024-01-01T00:00:00"):
    from mapwright import cli

    known = extract.Gazetteer({"Zuul": "service", "Kafka": "queue", "Envoy": "service"})
    for company, rows in pages.items():
        cli.scrape(store, spark.createDataFrame([(f"https://{company}.com/{n}", f"<article>{t}</article>") for n, t in rows], "url string, html string"), company, run_ts)
    cli.clean_stage(store)
    return cli.extract_stage(store, [known], run_ts)


def graph_rows(store, company="c"):
    r = store.read("relationships").where(F.col("company_name") == company).collect()
    return {(x["source"], x["relation"], x["target"]): (x["invalid_at"], tuple(x["source_article_ids"])) for x in r}


def test_run_end_to_end(spark, tmp_path):
    from mapwright import cli

    store, locks = Snapshots(spark, str(tmp_path / "store")), MergeLock(str(tmp_path / "locks"))
    pages = spark.createDataFrame([("https://x.com/a", "<article>Zuul calls Kafka. Zuul replaced by Envoy.</article>"), ("https://x.com/b", "<article>Envoy writes to Kafka.</article>"), ("https://x.com/c", "Just a moment...")], "url string, html string")
    assert cli.scrape(store, pages, "c", "2024-01-01T00:00:00") == 2 and cli.scrape(store, pages, "c", "2024-01-02T00:00:00") == 0
    with pytest.raises(RuntimeError):
        cli.merge_stage(store, locks, "2024-01-02T00:00:00", "c")
    cli.clean_stage(store)
    assert cli.extract_stage(store, [extract.Gazetteer({"Zuul": "service", "Kafka": "queue", "Envoy": "service"})], "2024-01-03T00:00:00") == 2
    assert locks.acquire("c")
    with pytest.raises(cli.MergeInProgress):
        cli.merge_stage(store, locks, "2024-01-04T00:00:00", "c")
    assert cli.merge_pending(store, locks, "2024-01-04T00:00:00") == {"c": None}
    locks.release("c")
    assert cli.merge_stage(store, locks, "2024-01-04T00:00:00", "c") == {"articles_merged": 2, "entities": 3, "relationships": 3}
    got = [r["line"] for r in cli.lines(store, "c").collect()]
    assert "[queue] Kafka (Other)" in got and "Zuul --replaced_by--> Envoy" in got and "Envoy --writes_to--> Kafka" in got
    first = graph_rows(store)
    assert first["Zuul", "calls", "Kafka"] == ("2024-01-04T00:00:00", ("a",))
    assert art.pending_merge(cli.articles(store)).isEmpty()
    # a second run merges nothing and leaves history as it is
    assert cli.merge_stage(store, locks, "2024-02-01T00:00:00", "c") == {"articles_merged": 0, "entities": 3, "relationships": 3}
    assert graph_rows(store) == first
    cli.reset_graph(store, "c")
    assert store.read("entities").isEmpty() and store.read("relationships").isEmpty() and art.pending_merge(cli.articles(store)).count() == 2


def test_failures_of_models_are_kept_as_errors(spark):
    def fail(text):
        if "bad" in text:
            raise ValueError("no answer to " + text)
        return "ok"

    rows = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "known")], "k int, text string")
    recorded = spark.createDataFrame([("known", "r2"), ("known", "r1"), ("bad one", None)], "text string, reply string")
    got = {r["k"]: (r["reply"], r["error"]) for r in extract.ask(rows, [lambda t: 1 / 0, fail], 2, recorded).collect()}
    assert got == {1: ("ok", None), 2: (None, "ValueError: no answer to bad one"), 3: ("r1", None)}
    assert {r["k"]: (r["reply"], r["error"]) for r in extract.ask(rows, [], 2, recorded).collect()} == {1: (None, None), 2: (None, None), 3: ("r1", None)}


def test_listing_in_locale_order_and_single_articles(spark, tmp_path):
    from mapwright import cli

    store = Snapshots(spark, str(tmp_path / "s"))
    names_ = ["zebra", "Éclair", "eagle", "egg", "Zoo", "ärger", "apple", "Apple"]
    blank = [(None,) * 4 for _ in names_]
    e = spark.createDataFrame([("c", n, n, "service", "Other", *b) for n, b in zip(names_, blank, strict=True)], "company_name string, key string, name string, kind string, domain string, first_seen_article_id string, description string, n_mentions long, aliases array<struct<name:string,method:string>>")
    store.write("entities", e)
    store.create({"relationships": cli.RELATIONSHIPS})
    got = [r["line"].split()[1] for r in cli.lines(store, "c").collect()]
    assert got == ["apple", "Apple", "ärger", "eagle", "Éclair", "egg", "zebra", "Zoo"]
    a = spark.createDataFrame([("k", "c"), ("k2", "c"), ("k", None)], "key string, company_name string")
    assert art.for_company(a, "c", "k").count() == 1 and art.for_company(a, "d", "k").count() == 0
    df = spark.createDataFrame([("<b>'\"&",)], "x string")
    assert df.select(views.as_attribute(F.struct("x")).alias("a")).first()["a"] == "{&quot;x&quot;:&quot;&lt;b&gt;&#x27;\\&quot;&amp;&quot;}"


def test_reach_in_cycles(spark):
    edges = [("c", a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d"), ("d", "d"))] + [("e", "a", "b")]
    got = {(r["company_name"], r["start"], r["id"]): r["hops"] for r in views.reachable(spark.createDataFrame(edges, "company_name string, source string, target string"), 4).collect()}
    want = {}
    for company in ("c", "e"):
        for start in {a for c, a, _ in edges if c == company}:
            now = {start}
            for n in range(1, 5):
                now = {b for c, a, b in edges if c == company and a in now}
                for x in now:
                    want.setdefault((company, start, x), n)
    assert got == want


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    """Models, prompts, recorded replies and a sitemap by name; a row for every job's last state; upkeep."""
    from mapwright import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "p/extraction/default").mkdir(parents=True)
    (tmp_path / "p/extraction/default/user.md").write_text("Find names in {content}")
    (tmp_path / "s.yaml").write_text("attempts: 2\nmerge_companies: 1\njobs_kept: 4\n")
    (tmp_path / "map.xml").write_text(f"<urlset {NS}><url><loc>https://x.com/a</loc></url><url><loc>https://x.com/b</loc></url></urlset>")
    rows = [("https://x.com/a", "<article>Zuul zaps Kafka.</article>"), ("https://x.com/b", "<article>the new gateway calls Kafka.</article>"), ("https://x.com/c", "<article>not listed</article>")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("recorded text", '{"entities":[{"name":"Envoy"}]}'), ("recorded text", None)], "text string, reply string").write.parquet(str(tmp_path / "replies"))
    spark.createDataFrame([("https://y.com/r", "<article>recorded text</article>")], "url string, html string").write.parquet(str(tmp_path / "more"))
    base = ["--store", str(tmp_path / "store"), "--settings", "s.yaml", "--run-ts", "2024-01-01T00:00:00"]
    cli.main([*base, "scrape", "--pages", str(tmp_path / "pages"), "--company", "c", "--sitemap", str(tmp_path / "map.xml")], spark)
    cli.main([*base, "scrape", "--pages", str(tmp_path / "more"), "--company", "d"], spark)
    with pytest.raises(SystemExit):
        cli.main([*base, "run-all"], spark)
    cli.main([*base, "--models", "tests.some_models:broken", "extract"], spark)
    assert capsys.readouterr().out.split() == ["2", "1", "extracted", "0"]
    cli.main([*base, "--models", "tests.some_models:make", "--prompts", "p", "run-all", "--replies", str(tmp_path / "replies")], spark)
    said = capsys.readouterr().out
    assert "extracted 3" in said and "c: merged 2 articles (2 entities, 1 relationships)" in said and "d: merged 1 articles (1 entities, 0 relationships)" in said
    store = Snapshots(spark, str(tmp_path / "store"))
    # the reviewer's predicate, given in broken JSON, and the resolver's name
    assert set(graph_rows(store)) == {("Zuul", "calls", "Kafka")}
    with pytest.raises(RuntimeError):
        cli.main([*base, "merge-graph", "--company", "nobody"], spark)
    capsys.readouterr()
    cli.main([*base, "jobs"], spark)
    listed = [x.split(" ", 1)[1] for x in capsys.readouterr().out.splitlines()]
    assert listed == ["merge-graph nobody error RuntimeError: no extracted articles of nobody", "run-all - done ", "extract - done ", "run-all - error SystemExit: name models, a gazetteer or recorded replies: without them nothing can be found", "scrape d done ", "scrape c done "]
    states = [r["status"] for r in store.read("jobs").where("command = 'run-all'").orderBy("created_at").collect()]
    assert states == ["pending", "cleaning", "extracting", "error", "pending", "cleaning", "extracting", "merging", "done"]
    cli.Job(store, "extract", None).say("extracting")  # its process died
    cli.main([*base, "maintain", "--interrupted"], spark)
    left = [(r["command"], r["status"], r["error"]) for r in jobs.recent(cli.jobs_of(store), 9).collect()]
    assert len(left) == 4 and left[0] == ("extract", "error", "interrupted")
    with pytest.raises(ValueError):
        cli.main([*base, "--models", "tests.some_models:make", "--prompts", "none", "extract"], spark)


def test_incremental_merges_end_where_one_run_does(spark, tmp_path):
    from mapwright import cli, config

    texts = {"c": [("a", "Zuul calls Kafka."), ("b", "ZUUL writes to Kafka. Zuul replaced by Envoy."), ("d", "Zuul calls Kafka. Zuul calls Envoy."), ("e", "Envoy calls Kafka.")], "d": [("x", "Envoy calls Kafka.")]}
    stores = [Snapshots(spark, str(tmp_path / n)) for n in ("full", "steps")]
    locks = MergeLock(str(tmp_path / "locks"))
    for s in stores:
        assert scraped(spark, s, texts) == 5
    assert cli.merge_pending(stores[0], locks, "T")["c"]["articles_merged"] == 4
    one = config.Settings(graph_article_limit=1)
    seen = []
    while done := cli.merge_pending(stores[1], locks, "T", one):
        seen.append({c: t["articles_merged"] for c, t in done.items()})
    assert seen == [{"c": 1, "d": 1}, {"c": 1}, {"c": 1}, {"c": 1}]
    # pages and texts were written once each, whatever was merged since
    assert all(len(s._manifest(t)[1]["folders"]) == n for s in stores for t, n in (("articles", 3), ("texts", 2), ("graphs", 2)))
    for company in texts:
        assert graph_rows(stores[0], company) == graph_rows(stores[1], company)
    assert graph_rows(stores[0])["Zuul", "calls", "Kafka"] == ("T", ("a", "d")) and graph_rows(stores[0])["Zuul", "calls", "Envoy"] == (None, ("d",))
    tables = [sorted(s.read("entities").drop("n_mentions").collect()) for s in stores]
    assert tables[0] == tables[1] and len(tables[0]) == 5


def test_models_settle_names_and_wordings(spark):
    import json

    m = spark.createDataFrame([("c", "a", "Kafka", "queue", "Other", None, "Kafka", "exact"), ("c", "a", "the bus", "queue", "Other", None, "the bus", None), ("c", "b", "the bus", "queue", "Other", None, "the bus", None), ("c", "b", "Zuul", "service", "Other", None, "Zuul", None)], "company_name string, article_id string, raw_name string, kind string, domain string, description string, name string, method string")
    known = spark.createDataFrame([("c", "Kafka")], "company_name string, candidate string")

    def model(request):
        asked = json.loads(request)
        assert asked["known"] == ["Kafka"]
        if len(asked["names"]) > 1:
            return json.dumps({"resolved": [{"article_name": "the bus", "canonical_name": "Zookeeper"}, {"article_name": " the bus\n", "canonical_name": "Kafka\t"}, {"article_name": "Zuul", "canonical_name": " "}, {"article_name": "Kafka", "canonical_name": "X"}]})
        return "sorry"

    got = {(r["article_id"], r["raw_name"]): (r["name"], r["method"]) for r in extract.settle(m, known, [lambda r: 1 / 0, model]).collect()}
    assert got == {("a", "Kafka"): ("Kafka", "exact"), ("a", "the bus"): ("the bus", None), ("b", "the bus"): ("Kafka", "llm"), ("b", "Zuul"): ("Zuul", None)}
    edges = spark.createDataFrame([(1, "depends_on", "zaps", True), (2, "depends_on", "odd", True), (3, "calls", "calls up", False)], "id int, relation string, relation_phrase string, needs_review boolean")
    reply = json.dumps({"resolved": [{"phrase": "zaps", "canonical": "calls"}, {"phrase": "odd", "canonical": "nonsense"}, {"phrase": "calls up", "canonical": "owns"}]})
    assert [(r["relation"], r["needs_review"]) for r in extract.review(edges, [lambda p: reply]).orderBy("id").collect()] == [("calls", False), ("depends_on", False), ("calls", False)]


def test_resolve_against_a_fixed_table(spark):
    e = spark.createDataFrame([("c", "User Service"), ("c", "Kafka"), ("d", "Zuul")], "company_name string, name string")
    n = spark.createDataFrame([("c", x) for x in ("user-service", "User Services", "the new service", "Zuul", "kafka", "", "Payments")], "company_name string, raw_name string")
    got = {r["raw_name"]: (r["name"], r["method"]) for r in resolve.resolve_known(n, e).collect()}
    assert got == {"user-service": ("User Service", "exact"), "User Services": ("User Service", "fuzzy:96"), "the new service": (None, None), "Zuul": (None, None), "kafka": ("Kafka", "exact"), "": (None, None), "Payments": (None, None)}


def test_upsert_keeps_windows(spark):
    shape = "company_name string, key string, source_key string, target_key string, source string, target string, relation string, relation_phrase string, as_of string, source_article_ids array<string>, invalid_at string"
    old = spark.createDataFrame([("c", "c--a--calls--b", "c--a", "c--b", "A", "B", "calls", None, "2019", ["1"], "T")], shape)
    items = spark.createDataFrame([("c", "a", "b", "calls", None, None, ["2", "1"], 0), ("c", "X", "Y", "owns", "has", None, ["3"], 1)], "company_name string, source string, target string, relation string, relation_phrase string, as_of string, source_article_ids array<string>, item int")
    got = {r["key"]: r for r in merge.upsert_edges(old, items).collect()}
    assert len(got) == 2 and got["c--x--owns--y"]["invalid_at"] is None
    assert (got["c--a--calls--b"]["source"], got["c--a--calls--b"]["as_of"], got["c--a--calls--b"]["source_article_ids"], got["c--a--calls--b"]["invalid_at"]) == ("a", None, ["1", "2"], "T")


def test_settings_and_prompts(spark, tmp_path):
    from mapwright import config

    (tmp_path / "s.yaml").write_text("chunk_size: 10\nattempts: 7\nfuzzy_threshold: 80\nother: 1\n")
    (tmp_path / ".env").write_text("# note\nexport MAPWRIGHT_ATTEMPTS='8'\nMAPWRIGHT_CHUNK_SIZE=11\n")
    (tmp_path / "secrets").mkdir()
    (tmp_path / "secrets" / "api_key").write_text("s3\n")
    s = config.load(env_file=str(tmp_path / ".env"), yaml_file=str(tmp_path / "s.yaml"), secrets=str(tmp_path / "secrets"), environ={"MAPWRIGHT_CHUNK_SIZE": "12"}, chunk_overlap=5)
    assert (s.chunk_overlap, s.chunk_size, s.attempts, s.fuzzy_threshold, s.api_key, s.candidate_names) == (5, 12, 8, 80.0, "s3", 40)
    with pytest.raises(ValueError):
        config.load(environ={}, nothing=1)
    for variant in ("zeta", "default", "alpha"):
        (tmp_path / "p" / "extraction" / variant).mkdir(parents=True)
    text = tmp_path / "p" / "extraction" / "alpha" / "user.md"
    text.write_text("Read {title} {{x}}\n")
    p = config.Prompts(str(tmp_path / "p"))
    assert p.variants() == ["default", "alpha", "zeta"] and p.variants("merge") == [] and p.filled("alpha", "user", {"title": "T"}) == "Read T {x}"
    text.write_text("New {title}")
    import os

    os.utime(text, ns=(1, 1))
    assert p.filled("alpha", "user", {"title": "T"}) == "New T"
    with pytest.raises(ValueError):
        p.checked("nope")
    assert one(spark, "2024-01-02T03:04:05.678+00:00", config.short_time) == "2024-01-02T03:04:05"


def test_versions_of_a_table(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.create({"t": "a long, company_name string"})
    s.create({"t": "a long, company_name string"})
    assert s.current("t") == "000000000001"
    s.write("t", spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "a long, company_name string"))
    seen = s.read("t")
    s.replace("t", spark.createDataFrame([(9, "1"), (8, "other")], "a long, company_name string"), ["1"])
    assert sorted((r["a"], r["company_name"]) for r in s.read("t").collect()) == [(2, "2"), (3, None), (9, "1")] and seen.count() == 3
    s.replace("t", s.read("t").limit(0), ["1", "2"])
    assert [r["a"] for r in s.read("t").collect()] == [3]
    # rows are added beside the others; what another writer has added meanwhile is not added again
    s.append_new("t", spark.createDataFrame([(3, "x"), (4, "4"), (5, "5")], "a long, company_name string"), ["a"])
    base = s._last("t")
    other = Snapshots(spark, str(tmp_path / "s"))
    other.append_new("t", spark.createDataFrame([(6, "1")], "a long, company_name string"), ["a"])
    assert not s.append("t", spark.createDataFrame([(6, "1")], "a long, company_name string"), base)
    s.append_new("t", spark.createDataFrame([(6, "1"), (7, "1")], "a long, company_name string"), ["a"])
    assert sorted(r["a"] for r in s.read("t").collect()) == [3, 4, 5, 6, 7]
    s.replace("t", spark.createDataFrame([(60, "1")], "a long, company_name string"), ["1"])
    rows, before = sorted(map(tuple, s.read("t").collect()), key=str), s.read("t")
    assert len(rows) == 4 and not s.compact("t", 50) and s.compact("t", 2) and len(s._manifest("t")[1]["folders"]) == 1
    assert sorted(map(tuple, s.read("t").collect()), key=str) == rows and before.count() == 4
    assert s.vacuum("t") == 0 and s.vacuum("t", 0) > 3 and sorted(map(tuple, s.read("t").collect()), key=str) == rows
    # of two writers that start from one version the later commits on top of the other's
    number, manifest = s._manifest("t")
    assert s._commit("t", number + 1, manifest) and not s._commit("t", number + 1, manifest)


def test_tables_on_a_cluster_need_a_shared_folder():
    from types import SimpleNamespace

    from mapwright.storage import shared_dir

    def session(master, place=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: place if name == "spark.checkpoint.dir" else default), sparkContext=SimpleNamespace(master=master, applicationId="app-x"))

    assert shared_dir(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")).startswith("file:") and shared_dir(session("local")) == shared_dir(session("local[2]"))


def test_dense_short_names_meet_by_common_subsequences(spark, monkeypatch):
    """All pairs of a dense group of short names without shared runs of letters; long names still go by these."""
    rng = random.Random(5)
    short = {f"supplier 000000{k:03d}" for k in range(0, 400, 3)} | {"".join(rng.choice("abc 12") for _ in range(rng.randint(5, 24))).strip() for _ in range(150)}
    short |= {w[:k] + w[k + 1 :] for w in sorted(short)[:60] for k in (3, 9)} | {w + "s" for w in sorted(short)[:40]}
    long = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(30, 60))) for _ in range(20)}
    long |= {w[:k] + w[k + 1 :] for w in long for k in (5, 20)}
    words = lambda n: " ".join(sorted(w for w in n.split(" ") if w))
    for names, by_runs in ((short, False), (short | long, True)):
        names = sorted({" ".join(n.split()) for n in names})
        if not by_runs:
            monkeypatch.setattr(resolve, "_near_by_runs", lambda *a: pytest.fail("runs of letters"))
        else:
            monkeypatch.undo()
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if min(len(a), len(b)) >= 5 and similarity.long_score(words(a), words(b)) >= 92}
        got = [(r["a"], r["b"]) for r in resolve.similar_pairs(spark.createDataFrame([("c", n) for n in names], "company_name string, norm string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_folds_by_spelling_and_without_articles(spark):
    """Entities folded from distinct spellings equal those of single mentions; edges folded without articles the others' rest."""
    rng = random.Random(2)
    names = ["User Svc", "user-svc", "USER/SVC", "the new service", "The New Service", "..", "", "Kafka", "kafka "]
    rows = [("c" if k % 3 else "Co. D", rng.choice(names), rng.choice([None, "service", "queue"]), f"D{k % 4}", rng.choice([None, "", f"text {k}"]), k // 4, 9 - k // 40, k) for k in range(300)]
    m = spark.createDataFrame(rows, "company_name string, raw_name string, kind string, domain string, description string, article_id long, extracted_at int, item long")
    want = merge.fold_entities(resolve.resolve_exact(m))
    assert sorted(map(tuple, merge.spelled_entities(merge.fold_spellings(m)).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    e = m.select("company_name", F.col("raw_name").alias("source"), F.lit("Kafka").alias("target"), F.coalesce("kind", F.lit("calls")).alias("relation"), F.col("description").alias("relation_phrase"), F.lit("2020").alias("as_of"), "article_id", "extracted_at", "item")
    whole = merge.fold_edges(e)
    assert sorted(map(str, merge.fold_edges(e, articles=False).collect())) == sorted(map(str, whole.drop("source_article_ids").collect()))
    key = relationship_key(F.col("company_name"), F.col("source"), F.col("relation"), F.col("target"))
    ids = {r["key"]: r["ids"] for r in e.groupBy("company_name", key.alias("key")).agg(F.expr("array_distinct(transform(array_sort(collect_list(struct(extracted_at, article_id, item))), x -> x.article_id)) ids")).collect()}
    assert {r["key"]: r["source_article_ids"] for r in whole.collect()} == ids

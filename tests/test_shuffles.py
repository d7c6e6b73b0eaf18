"""Steps that deal rows out once: the same results in many parts, and no shuffle that they do without."""

import random

import pytest
from pyspark.sql import functions as F

from mapwright.functions.vocab import canonical_relation
from mapwright.operators import backfill, extract, merge, resolve, views
from mapwright.plans import adapters

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stated(spark, seed, sources=2, n=400):
    draw, rows = random.Random(seed), []
    for item in range(n):
        relation = draw.choice(["calls", "replaced_by", "owns"])
        rows.append(("c", f"s{draw.randrange(sources)}", f"t{draw.randrange(60)}", relation, None, draw.choice([None, "", "2020", "2021"]), draw.randrange(80), item))
    e = spark.createDataFrame(rows, "company_name string, source string, target string, relation string, relation_phrase string, as_of string, article_id long, item long")
    return e.withColumn("extracted_at", F.timestamp_seconds(F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("article_id") % 40)), rows


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_a_hot_source_is_closed_over_many_parts(spark, tasks):
    """one source over all parts, against a plain loop."""
    edges, rows = stated(spark, tasks, sources=1)
    got = {r["key"]: r["invalid_at"] for r in merge.close_windows(merge.fold_edges(edges, tasks=tasks), edges, "RUN", tasks).collect()}
    seq = lambda r: (r[6] % 40, r[6])
    closes = sorted((seq(r), r[7], r[5] or "RUN") for r in rows if r[3] == "replaced_by")
    want = {}
    for r in rows:
        key = f"c--{r[1]}--{r[3].replace('_', '-')}--{r[2]}"
        first = min(seq(x) for x in rows if x[1:4] == r[1:4])
        later = [at for s, _, at in closes if s >= first]
        want[key] = later[0] if later and r[3] != "replaced_by" else None
    assert got == want and len(set(want.values())) > 2


def test_edges_fold_by_ids_as_by_names(spark):
    """folded by the ids of names, names without a norm included."""
    names = spark.createDataFrame([("A b", "a b"), ("x", "x"), ("..", "\0.."), ("日本", "\0日本"), ("a-B!", "a-b")], "name string, id string")
    assert {r["name"]: r["id"] for r in names.select("name", merge.name_id(F.col("name")).alias("id")).collect()} == {"A b": "a-b", "x": "x", "..": "\0..", "日本": "\0日本", "a-B!": "a-b"}
    edges, _ = stated(spark, 3, 4)
    edges = edges.withColumn("target", F.when(F.col("item") % 9 == 0, "..").when(F.col("item") % 9 == 1, "x").otherwise(F.upper("target")))
    by_id = edges.withColumns({c: merge.name_id(F.col(c)) for c in ("source", "target")})
    same = ["company_name", "key", "source_key", "target_key", "relation", "as_of", "first_seq"]
    rows = lambda d: sorted(map(str, d.select(same).collect()))
    assert rows(merge.fold_edges(by_id, articles=False, tasks=5, by_id=True)) == rows(merge.fold_edges(edges))


def test_entities_of_the_exact_tier_in_one_step(spark):
    """names of one norm, generic ones, and ones without a norm that share a key."""
    names = ["Auth", "AUTH", "auth!", "..", "x", "X", "日本", "the new auth service", "The New Auth Service", "--"]
    draw, rows = random.Random(5), []
    for item in range(300):
        rows.append((draw.choice(["c", "d"]), draw.choice(names), draw.choice(["team", None, "model"]), draw.choice(["D1", ""]), draw.choice(["", None, f"d{item}"]), draw.randrange(50), item))
    m = spark.createDataFrame(rows, "company_name string, raw_name string, kind string, domain string, description string, article_id long, item long").withColumn("extracted_at", F.timestamp_seconds(F.col("article_id") % 7))
    want = merge.fold_entities(resolve.resolve_exact(m))
    assert sorted(map(str, merge.exact_entities(m).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_lines_are_not_shuffled_by_wording(spark):
    """the vocabulary is asked without a join, suppliers are sent, and orders and parts need no sort."""
    text = plan(adapters.edges(spark, SMOKE))
    assert text.count("Join") == 5 and "Aggregate" not in text and "shuffle_hash" in text and "broadcast" in text


@pytest.mark.parametrize("slice_", [1_000_000, 7])
def test_reach_in_slices(spark, monkeypatch, slice_):
    """ways stay lists until all of a start's meet; against a plain search."""
    monkeypatch.setattr(views, "SLICE", slice_)
    draw = random.Random(slice_)
    edges = {(f"c{draw.randrange(2)}", f"n{draw.randrange(20)}", f"n{draw.randrange(20)}") for _ in range(60)}
    result = views.reachable(spark.createDataFrame(sorted(edges), "company_name string, source string, target string"), 3)
    want = {}
    for c, s, _ in edges:
        level, seen = {s}, {}
        for n in (1, 2, 3):
            level = {t for k, a, t in edges if k == c and a in level} - seen.keys()
            seen |= dict.fromkeys(level, n)
        want |= {(c, s, t): n for t, n in seen.items()}
    rows = result.collect()
    assert {(r["company_name"], r["start"], r["id"]): r["hops"] for r in rows} == want and len(rows) == len(want)
    assert "Generate explode" in plan(result) and "LeftAnti" not in plan(result)


def test_chunks_are_dealt_before_they_are_folded(spark):
    """As many tasks as asked for, however few the session shuffles into, and each with its own share."""
    items = spark.range(500).select((F.col("id") % 20).alias("article_id"), (F.col("id") % 3).alias("chunk"), F.col("id").alias("item"), F.concat(F.lit("N"), (F.col("id") % 70).cast("string")).alias("name"), F.lit("k").alias("kind"), F.lit("d").alias("domain"), F.lit(None).cast("string").alias("description"))
    assert "RepartitionByExpression [article_id" in plan(merge.merge_chunks_entities(items, 31)) and merge.merge_chunks_entities(items, 31).count() == merge.merge_chunks_entities(items).count()
    m = items.select(F.lit("c").alias("company_name"), F.col("name").alias("raw_name"), "article_id", F.timestamp_seconds("item").alias("extracted_at"), "item")
    assert sorted(map(str, resolve.known_names(m, 31).collect())) == sorted(map(str, resolve.known_names(m).collect()))


def test_settled_names_leave_resolved_ones_where_they_are(spark):
    """only mentions without a method are joined with answers."""
    m = spark.createDataFrame([("c", 1, "a", None, None, None, "a", None), ("c", 1, "b", None, None, None, "B", "exact")], "company_name string, article_id long, raw_name string, kind string, domain string, description string, name string, method string")
    out = extract.settle(m, spark.createDataFrame([], "company_name string, candidate string"), [lambda r: '{"resolved": [{"article_name": "a", "canonical_name": "A"}, {"article_name": "b", "canonical_name": "Z"}]}'])
    assert {(r["raw_name"], r["name"], r["method"]) for r in out.collect()} == {("a", "A", "llm"), ("b", "B", "exact")}
    assert "Union" in plan(out)


def test_counters_need_no_window(spark):
    """new entities and taken keys are counted from groups."""
    m = spark.createDataFrame([("c", 1, "a", 1), ("c", 2, "a", 2), ("c", 2, "b", 3), ("c", 2, "B", 4)], "company_name string, article_id long, name string, item long").withColumns({"extracted_at": F.timestamp_seconds("article_id"), "method": F.lit(None).cast("string")})
    counts = merge.merge_counters(m, m.where("article_id = 1"), m.where("name = 'b'").select("company_name", F.lit("c--b").alias("key")))
    assert {r["article_id"]: (r["new_count"], r["matched_count"], r["relationship_count"]) for r in counts.collect()} == {1: (1, 0, 1), 2: (0, 2, 0)}
    stored = spark.createDataFrame([("c", f"c--s--{r}--t", "s", "t", k, None) for r, k in (("persists-to", "persists to"), ("stores", "stores"), ("calls", "calls"), ("invokes", "invokes"))], "company_name string, key string, source string, target string, relation string, relation_phrase string")
    counts = backfill.counters(stored)
    assert tuple(counts.first()) == ("c", 4, 3, 2) and "Window" not in plan(counts)


def test_spellings_of_two_runs_give_what_mentions_give(spark):
    """entities and aliases from spellings, stored names included, equal those folded from resolved mentions."""
    names = ["Auth", "AUTH", "auth!", "..", "x", "X", "the new auth service", "The New Auth Service", "--", "Kafka", "kafka"]
    draw = random.Random(17)
    rows = [("c", draw.choice(names), "team", "D1", draw.choice(["", None, f"d{k}"]), draw.randrange(40), k) for k in range(200)]
    m = spark.createDataFrame(rows, "company_name string, raw_name string, kind string, domain string, description string, article_id long, item long")
    m = m.withColumn("extracted_at", F.timestamp_seconds("article_id")).cache()
    rows_of = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    stored = None
    for part in (m.where("article_id < 15"), m.where("article_id >= 15")):
        named, spelled = resolve.resolve_exact(part, stored), merge.fold_spellings(part, stored)
        assert rows_of(merge.spelled_entities(spelled)) == rows_of(merge.fold_entities(named))
        assert rows_of(merge.spelled_aliases(spelled)) == rows_of(merge.fold_aliases(named))
        stored = merge.fold_entities(named)


def test_backfill_groups_edges_where_the_fold_has_dealt_them(spark):
    """edges dealt by their ends are rewritten and grouped without a shuffle of their own."""
    edges, _ = stated(spark, 20, 4)
    edges = edges.withColumn("relation", F.element_at(F.array(*[F.lit(x) for x in ("calls", "sends requests to", "Writes To", "frobnicates")]), (F.col("item") % 4 + 1).cast("int")))
    plain, dealt = (merge.fold_edges(edges, tasks=5, by_ends=e).withColumn("invalid_at", F.lit(None).cast("string")) for e in (False, True))
    got, want = backfill.canonicalize(dealt), backfill.canonicalize(plain)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")
    assert exchanges(backfill.canonicalize(dealt)) == 1 < exchanges(backfill.canonicalize(plain))


@pytest.mark.parametrize(("slice_", "block", "cells", "hops"), [(1_000_000, 50_000, 16_000_000, 3), (7, 5, 30, 3), (7, 5, 30, 4), (7, 5, 30, 2), (9, 6, 1, 1)])
def test_reach_marks_pairs_where_blocks_meet_slices(spark, monkeypatch, slice_, block, cells, hops):
    """no way and no pair is shuffled or grouped, only lists of numbers; starts without a name lead on, targets without one are none."""
    for name, value in (("SLICE", slice_), ("BLOCK", block), ("CELLS", cells), ("IDS", 8)):
        monkeypatch.setattr(views, name, value)
    draw = random.Random(hops)
    edges = {(f"c{draw.randrange(2)}", f"n{draw.randrange(20)}", f"n{draw.randrange(20)}") for _ in range(50)} | {("c0", None, "n3"), ("c0", "n3", None), (None, "n1", "n2"), (None, "n2", "n3")}
    result = views.reachable(spark.createDataFrame(sorted(edges, key=str), "company_name string, source string, target string"), hops)
    want = {}
    for c, s, _ in edges:
        level, seen = {s}, {}
        for n in range(1, hops + 1):
            level = {t for k, a, t in edges if k == c and a in level and t is not None and (n == 1 or c and a)} - seen.keys()
            seen |= dict.fromkeys(level, n)
        want |= {(c, s, t): n for t, n in seen.items()}
    rows = result.collect()
    assert {(r["company_name"], r["start"], r["id"]): r["hops"] for r in rows} == want and len(rows) == len(want)
    assert "Aggregate" not in plan(result).split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize(("sources", "hot"), [(1, 500_000), (1, 50), (3, 20)])
def test_edges_are_closed_where_they_are_folded(spark, monkeypatch, sources, hot):
    """One deal folds and closes, a hot source in parts; against a plain loop."""
    monkeypatch.setattr(merge, "HOT_SOURCE", hot)
    monkeypatch.setattr(merge, "LOOK_AT", 1)
    edges, rows = stated(spark, 30 + sources, sources)
    seq = lambda r: (r[6] % 40, r[6])
    want = {}
    for r in rows:
        same = sorted(((seq(x), x[7], x) for x in rows if x[1:4] == r[1:4]), key=lambda x: x[:2])
        later = [at for s, _, at in sorted((seq(x), x[7], x[5] or "RUN") for x in rows if x[3] == "replaced_by" and x[1] == r[1]) if s >= same[0][0]]
        ids = list(dict.fromkeys(x[2][6] for x in same))
        want[f"c--{r[1]}--{r[3].replace('_', '-')}--{r[2]}"] = (same[-1][2][5], ids, later[0] if later and r[3] != "replaced_by" else None)
    one = merge.fold_edges(edges, tasks=9, closed_by="RUN")
    for df in (one, merge.close_windows(merge.fold_edges(edges, tasks=9), edges, "RUN", 9)):
        got = df.collect()
        assert {r["key"]: (r["as_of"], r["source_article_ids"], r["invalid_at"]) for r in got} == want and len(got) == len(want)
    assert one.columns == merge.close_windows(merge.fold_edges(edges), edges, "RUN").columns
    exchanges = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert exchanges.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in exchanges


@pytest.mark.parametrize("hot", [500_000, 20])
def test_runs_are_merged_and_closed_in_one_deal(spark, monkeypatch, hot):
    """stored, incoming and closing rows meet once; against the join and the closing as they are defined."""
    monkeypatch.setattr(merge, "HOT_SOURCE", hot)
    monkeypatch.setattr(merge, "LOOK_AT", 1)
    edges, _ = stated(spark, 70, 3)
    early, late = edges.where("item < 150"), edges.where("item >= 150")
    cut = lambda d: d.withColumn("extracted_at", F.col("extracted_at") + F.make_dt_interval(F.lit(1)))
    late = cut(late)
    stored = merge.fold_edges(early, tasks=5, closed_by="ONE").drop("first_seq").localCheckpoint()
    incoming = merge.fold_edges(late, tasks=5).localCheckpoint()
    result = merge.merge_relationships(stored, incoming, late, "TWO", 5)
    old, new = ({r["key"]: r for r in d.collect()} for d in (stored, incoming))
    closes = sorted(((r["extracted_at"], r["article_id"]), r["item"], r["as_of"] or "TWO", r["source"]) for r in late.where("relation = 'replaced_by'").collect())
    want = {}
    for k in old.keys() | new.keys():
        o, n = old.get(k), new.get(k)
        later = [at for s, _, at, source in closes if source == (n or o)["source"] and (o or s >= tuple(n["first_seq"]))]
        ids = list(dict.fromkeys((o["source_article_ids"] if o else []) + (n["source_article_ids"] if n else [])))
        want[k] = ((n or o)["as_of"], ids, (o and o["invalid_at"]) or (later[0] if later and (n or o)["relation"] != "replaced_by" else None))
    got = result.collect()
    assert {r["key"]: (r["as_of"], r["source_article_ids"], r["invalid_at"]) for r in got} == want and len(got) == len(want)
    assert "Join FullOuter" not in plan(result)


def test_backfill_asks_the_vocabulary_once(spark):
    """an edge's wording was mapped again for each column that follows from it."""
    stored = spark.createDataFrame([("c", "c--s--stores--t", "s", "t", "stores", None, None, [1], None)], "company_name string, key string, source string, target string, relation string, relation_phrase string, as_of string, source_article_ids array<long>, invalid_at string")
    once = plan(stored.select(canonical_relation(F.col("relation")))).count("load balances")
    assert 0 < plan(backfill.rewritten(stored)).count("load balances") <= once
    assert [tuple(r) for r in backfill.canonicalize(stored).select("key", "relation", "relation_phrase").collect()] == [("c--s--writes-to--t", "writes_to", "stores")]

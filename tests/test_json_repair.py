"""Broken replies and the objects that they mean, in a plain loop and in Spark."""

import json
import random

import pytest

from mapwright.functions.json_repair import repair, repaired
from mapwright.operators import extract

K = {"entities": [{"name": "Kafka", "kind": "queue"}]}
TWO = {"entities": [{"name": "Kafka", "kind": "queue"}, {"name": "Zuul"}]}
CASES = [
    ('{"entities":[{"name":"Kafka","kind":"queue"}]}', K),
    ('```json\n{"entities":[{"name":"Kafka","kind":"queue"}]}\n```', K),
    ('Sure! Here it is: {"entities":[{"name":"Kafka","kind":"queue"}]} Hope {that} helps.', K),
    ("{'entities': [{'name': 'Kafka', 'kind': 'queue'}]}", K),
    ("{entities: [{name: Kafka, kind: queue}]}", K),
    ("{“entities”: [{“name”: “Kafka”, “kind”: “queue”}]}", K),
    ('{"entities":[{"name":"Kafka","kind":"queue",},],}', K),
    ('{"entities":[{"name":"Kafka" "kind":"queue"}]}', K),
    ('{"entities":[{"name":"Kafka"\n"kind":"queue"}]}', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"}', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zu', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zuul",', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"na', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zuul","kind":nul', K),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zuul"', TWO),
    ('{"entities":[{"name":"Kafka","kind":"queue"} {"name":"Zuul"}]}', TWO),
    ('{"entities":[{"name":"Kafka","kind":"queue"},,{"name":"Zuul"}]}', TWO),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zuul"]}', TWO),
    ('{"entities":[{"name":"Kafka","kind":"queue"},{"name":"Zuul"}}', TWO),
    ('// note\n{"entities":[/* one */{"name":"Kafka","kind":"queue"} # end\n]}', K),
    ('{"a":True,"b":False,"c":None,"d":NaN}', {"a": True, "b": False, "c": None, "d": None}),
    ('{"a":"say "hi" now","b":1}', {"a": 'say "hi" now', "b": 1}),
    ('{"a":"one, "two", three","b":1}', {"a": 'one, "two", three', "b": 1}),
    ("{'a':'it's here','b':2}", {"a": "it's here", "b": 2}),
    ('{"a":"line\nend\ttab","b":"\\u00e9\\n\\"x\\" \\d"}', {"a": "line\nend\ttab", "b": 'é\n"x" \\d'}),
    ('{"a":"\\ud83d\\ude00"}', {"a": "😀"}),
    ('{"a":}', {"a": None}),
    ('{"a":,"b":1}', {"a": None, "b": 1}),
    ('{"a":1,"b":-2.5e3,"c":007,"d":[1,2,3', {"a": 1, "b": -2500.0, "c": "007", "d": [1, 2]}),
    ('{"a":[1,2,3,', {"a": [1, 2, 3]}),
    ('{} then {"a":1}', {"a": 1}),
    ('{"a":{"b":[{"c":"x"},{"d":{"e":"cut', {"a": {"b": [{"c": "x"}]}}),
    ('{"a":1,"a":2}', {"a": 2}),
    ('{"k":"v","cut":"of', {"k": "v"}),
    ('[{"a":1}]', {"a": 1}),
    ("sorry", None),
    ("", None),
    (None, None),
    ("{", None),
    ("{" * 5000, None),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_broken_replies(text, want):
    got = repair(text)
    assert (None if got is None else json.loads(got)) == want


def test_whole_json_stays_and_prefixes_never_fail():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 2:
            return "".join(rng.choice("ab ,:{}[]\"'\\\n/#é😀") for _ in range(rng.randrange(8)))
        if kind == 2:
            return rng.choice([True, False, None, 3, -1.5])
        if kind == 3:
            return rng.randrange(10**6)
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 5 else {f"k{j}": value(depth - 1) for j in range(rng.randrange(4))}

    for _ in range(300):
        plain = {f"k{j}": rng.choice(["x", "two words", 1, None, [1, {"a": "b"}]]) for j in range(rng.randrange(1, 5))}
        text = json.dumps(plain, indent=rng.choice([None, 2]))
        assert json.loads(repair(text)) == plain
        for end in range(len(text)):
            part = repair(text[:end])
            if part is not None:
                found = json.loads(part)
                assert all(k in plain for k in found)
        odd = json.dumps({"k": value(3)}, ensure_ascii=False)
        for end in (len(odd), rng.randrange(len(odd))):
            part = repair(odd[:end])
            assert part is None or isinstance(json.loads(part), dict)


def test_items_that_are_cut_off_are_never_kept_in_part():
    items = [{"name": f"Name {k}", "kind": "service"} for k in range(6)]
    text = json.dumps({"entities": items})
    for end in range(15, len(text)):
        found = json.loads(repair(text[:end]) or '{"entities":[]}')["entities"]
        assert all(f["name"] == items[k]["name"] and f.get("kind", "service") == "service" for k, f in enumerate(found))


def test_column_is_the_loop_and_replies_are_repaired(spark):
    rows = [(k, text) for k, (text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, reply string").repartition(3)
    assert {r["k"]: r["x"] for r in df.select("k", repaired(df.reply).alias("x")).collect()} == {k: repair(t) for k, t in rows}
    valid = {r["k"]: (r["valid"], len(r["graph"]["entities"]) if r["graph"] else None) for r in extract.parse(df).collect()}
    for k, (_, want) in enumerate(CASES):
        assert valid[k] == ((True, len(want.get("entities", []))) if want is not None else (False, None)), CASES[k]

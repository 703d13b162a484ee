"""JSON containment and path removal, SIMILAR TO, bound parameters and quoted names against plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sqlsift.functions import jsons
from sqlsift.functions.analyze import analyze_text
from sqlsift.operators.relational import similar_to


def document(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind > 5:
        return {rng.choice(["a", "b", "c d", "é'\"."]): document(rng, depth + 1) for _ in range(rng.randrange(3))}
    if kind == 5:
        return [document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, 1, 2, 1.5, -3, 10**17 + 1, "1", "true", "a", ""])


def brute(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and brute(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(brute(x, y, False) for x in a) for y in b)
    if isinstance(a, list):
        return top and any(brute(x, b, False) for x in a)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def part_of(rng, d):
    if isinstance(d, dict):
        return {k: part_of(rng, v) for k, v in d.items() if rng.random() < 0.7}
    if isinstance(d, list):
        return [part_of(rng, rng.choice(d)) for _ in range(rng.randrange(3))] if d else []
    return d if rng.random() < 0.9 else document(rng, 3)


def test_containment(spark):
    rng = random.Random(6)
    docs = [document(rng) for _ in range(400)] + [{"a": {"b": 1, "c": 2}}, {"a": [1, 2]}, [1, 2], [{"a": 1, "b": 2}], [{"a": 1}, {"b": 2}]]
    parts = [{"a": {"b": 1}}, {"a": [1]}, [1], 1, [{"a": 1}, {"b": 2}], [{"a": 1, "b": 2}], {}, [], None, True, "1", [[1]]] + [part_of(rng, rng.choice(docs)) for _ in range(25)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(-1, None), (-2, "{no json")], "k long, doc string")
    got = df.select("k", *[jsons.json_contains(F.col("doc"), json.dumps(p)).alias(f"p{i}") for i, p in enumerate(parts)]).collect()
    for r in got:
        want = [None] * len(parts) if r.k < 0 else [brute(docs[r.k], p) for p in parts]
        assert list(r)[1:] == want, docs[r.k] if r.k >= 0 else None
    pairs = [(json.dumps(d), json.dumps(part_of(rng, d)), brute(d, None)) for d in docs]
    for r in spark.createDataFrame(pairs, "a string, b string, n boolean").select("a", "b", jsons.json_contains(F.col("a"), F.col("b")).alias("has"), jsons.json_contained(F.col("b"), F.col("a")).alias("part")).collect():
        assert r.has == r.part == brute(json.loads(r.a), json.loads(r.b))


def cut(d, path):
    k, rest = path[0], path[1:]
    if isinstance(d, dict):
        return {x: (cut(v, rest) if x == k else v) for x, v in d.items() if rest or x != k}
    if isinstance(d, list) and k.lstrip("-").isdigit():
        at = int(k) + (len(d) if int(k) < 0 else 0)
        return [(cut(v, rest) if i == at else v) for i, v in enumerate(d) if rest or i != at]
    return d


def test_path_removal_and_keys(spark):
    rng = random.Random(8)
    docs = [d for d in (document(rng) for _ in range(600)) if isinstance(d, (dict, list))] + [{"a": [1, {"b": 2, "c d": [3]}]}, ["a", "b"]]
    paths = [("a",), ("a", "b"), ("0",), ("-1",), ("a", "1", "c d", "0"), ("a", "-1", "b"), ("zz",), ("é'\".",)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k long, doc string")
    columns = [jsons.json_delete_path(F.col("doc"), *p).alias(f"p{i}") for i, p in enumerate(paths)] + [jsons.json_has(F.col("doc"), ["a", "b"], every).alias(f"h{every}") for every in (False, True)]
    for r in df.select("k", *columns).collect():
        assert [json.loads(x) for x in list(r)[1:-2]] == [cut(docs[r.k], p) for p in paths]
        keys = set(docs[r.k]) if isinstance(docs[r.k], dict) else {x for x in docs[r.k] if isinstance(x, str)}
        assert list(r)[-2:] == [bool(keys & {"a", "b"}), keys >= {"a", "b"}]


def similar(text, pattern):
    """SIMILAR TO by trying all splits."""
    if not pattern:
        return not text
    c = pattern[0]
    if c == "%":
        return any(similar(text[k:], pattern[1:]) for k in range(len(text) + 1))
    if c == "[":
        end = pattern.index("]", 2)
        inner = pattern[1:end]
        held = inner.lstrip("^") if inner[0] == "^" else inner
        return bool(text) and ((text[0] in held) != (inner[0] == "^")) and similar(text[1:], pattern[end + 1 :])
    return bool(text) and (c == "_" or c == text[0]) and similar(text[1:], pattern[1:])


def test_similar_to_against_brute_force(spark):
    atoms = ["%", "_", "a", ".", "[%_]", "[^%]", "[a.]", "[^a_]", "[&[]"]
    patterns = ["".join(p) for n in (1, 2, 3) for p in itertools.product(atoms, repeat=n)][:400]
    texts = ["", "a", "%x", ".x", "_", "a.", "%", "aa", ".%_", "[", "&a", "^"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lo in range(0, len(patterns), 100):
        some = patterns[lo : lo + 100]
        for r in df.select("t", *[similar_to(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(some)]).collect():
            assert list(r)[1:] == [similar(r.t, p) for p in some], r.t
    assert df.select(similar_to(F.lit("%x"), "[%_]x").alias("a"), similar_to(F.lit("q7"), "[[:alpha:]][0-9]").alias("b"), similar_to(F.lit("77"), "[[:alpha:]][0-9]").alias("c")).first() == (True, True, False)


@pytest.mark.parametrize("sql, columns", [
    ("select array['x', y] from t", {("public", "t", "y")}),
    ('select "T".a, "u""v" from "T"', {("public", "T", "a"), ("public", "T", 'u"v')}),
    ("select pay[1] from t", {("public", "t", "pay")}),
])
def test_quoted_names_and_arrays(sql, columns):
    s = analyze_text(sql)["statements"][0]
    assert {(c["schema_name"], c["table_name"], c["column_name"]) for c in s["columns"]} == columns
    assert {(t["schema_name"], t["table_name"]) for t in s["tables"]} == {c[:2] for c in columns}

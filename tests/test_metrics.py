import math
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.operators import metrics as M

CASES = [
    ("abc", ["ab", "a", "c"], (5 / 6, 5 / 9, 1, 2)),
    ("ab", ["ab", "ab"], (0, 0, 0, 1)),
    ("ab", ["a", "b"], (1, 0.5, 1, 2)),
    ("ab", ["a", "ab", "b"], (None, None, None, 1)),
    ("f", ["f"], (0, 0, 0, 1)),
    ("", ["", ""], (0, 0, 1, 2)),
    ("f", ["", ""], (2.0, 1.0, 1, 2)),
]


def test_lcom_table(spark):
    types, methods, fields, accesses = [], [], [], []
    for k, (fs, ms, _) in enumerate(CASES):
        types.append((str(k), "struct", "f.rs"))
        fields += [(str(k), f) for f in [*fs, *fs]]
        for i, used in enumerate(ms):
            methods.append((str(k), f"m{i}"))
            accesses += [(str(k), f"m{i}", f) for f in [*used, *used, "ghost"]]
    types.append(("trait", "trait", "f.rs"))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    r = {"types": df(types, "type string, kind string, file string"), "methods": df(methods, "type string, method string"), "fields": df(fields, "type string, field string"), "accesses": df(accesses, "type string, method string, field string")}
    inputs = M.lcom_inputs(**r)
    of = lambda d: {x.type: x.value for x in d.collect()}
    values = [of(M.lcom96a(inputs)), of(M.lcom96b(inputs)), of(M.lcom1(**r)), of(M.lcom4(**r))]
    for k, (_, _, want) in enumerate(CASES):
        for got, w in zip(values, want, strict=True):
            assert w is None or math.isclose(got[str(k)], w), (k, want)
    assert "trait" not in values[0]


def test_cohesion_equals_brute_force(spark):
    """Random types against pairs and graph search; large types by joins as well as in the row."""
    rng = random.Random(3)
    methods, fields, accesses = [], [], []
    for t in range(25):
        fields += [(f"T{t}", f"f{i}") for i in range(rng.randint(1, 5))]
        for m in range(rng.randint(1, 9)):
            methods.append((f"T{t}", f"m{m}"))
            accesses += [(f"T{t}", f"m{m}", f"f{rng.randint(0, 6)}") for _ in range(rng.randint(0, 3))]
    df = spark.createDataFrame
    r = {"types": df([(f"T{t}", "struct", "x.rs") for t in range(25)], "type string, kind string, file string"), "methods": df(methods, "type string, method string"), "fields": df(fields, "type string, field string"), "accesses": df(accesses, "type string, method string, field string")}
    one, four, joined = ({x.type: x.value for x in d.collect()} for d in (M.lcom1(**r), M.lcom4(**r), M.lcom4(**r, folded=3)))
    for t in range(25):
        own = [m for x, m in methods if x == f"T{t}"]
        uses = {m: {f for x, y, f in accesses if (x, y) == (f"T{t}", m) and (x, f) in fields} for m in own}
        shared = sum(bool(uses[a] & uses[b]) for a in own for b in own if a < b)
        groups = []
        for m in own:
            met = [g for g in groups if uses[m] & g[1]]
            groups = [g for g in groups if g not in met] + [({m}.union(*(g[0] for g in met)), uses[m].union(*(g[1] for g in met)))]
        assert one[f"T{t}"] == max(len(own) * (len(own) - 1) // 2 - 2 * shared, 0)
        assert four[f"T{t}"] == joined[f"T{t}"] == len(groups)


def test_lcom1_compares_methods_in_the_row_by_bits_by_names_and_by_joins(spark, monkeypatch):
    """All three ways on types of up to 90 fields, undeclared and null fields included; small types make no join over fields."""
    rng = random.Random(5)
    sizes = [3, 20, 64, 65, 90] * 3
    fields = [(f"T{t}", f"f{i}") for t, n in enumerate(sizes) for i in range(n) for _ in range(2)]
    methods = [(f"T{t}", f"m{m}") for t in range(len(sizes)) for m in range(12)]
    accesses = [(t, m, rng.choice([None, "ghost", *(f"f{rng.randrange(sizes[int(t[1:])])}" for _ in range(6))])) for t, m in methods for _ in range(rng.randint(0, 7))]
    df = spark.createDataFrame
    r = {"types": df([(f"T{t}", "struct", "x.rs") for t in range(len(sizes))], "type string, kind string, file string"), "methods": df(methods, "type string, method string"), "fields": df(fields, "type string, field string"), "accesses": df(accesses, "type string, method string, field string")}
    want = {}
    for t in {t for t, _ in methods}:
        uses = [{f for x, y, f in accesses if (x, y) == (t, m) and (t, f) in set(fields)} for x, m in methods if x == t]
        shared = sum(bool(a & b) for i, a in enumerate(uses) for b in uses[:i])
        want[t] = max(len(uses) * (len(uses) - 1) // 2 - 2 * shared, 0)
    assert len({*want.values()}) > 3
    assert {x.type: x.value for x in M.lcom1(**r, folded=5).collect()} == want
    monkeypatch.setattr(M, "field_sets", None)
    assert {x.type: x.value for x in M.lcom1(**r).collect()} == want


def test_distance_table(spark):
    rows = [(2, 2, 1, 3, 5, 50), (0, 0, 0, 0, 1, 0), (1, 0, 0, 0, 2, 50), (1, 0, 0, 0, 2, 500)]
    df = spark.createDataFrame(rows, "concrete bigint, traits bigint, ca bigint, ce bigint, n bigint, loc bigint")
    got = [(r.abstractness, r.instability, r.distance, r.coupling_factor, r.normalized_distance) for r in M.distance_metrics(df).collect()]
    assert got[0] == (0.5, 0.75, 0.25, 0.5, 0.1875)
    assert got[1] == (0, 0, 1, 0, 1)
    assert (got[2][4], got[3][4]) == (0.75, 0.5)
    zones = spark.createDataFrame([(3, 1, 3, 1, 5, 1), (7, 3, 7, 3, 11, 1), (1, 3, 1, 3, 5, 1), (3, 7, 3, 7, 11, 1)], df.schema)
    assert [r.concrete for r in M.in_zone_of_pain(M.distance_metrics(zones)).collect()] == [3]
    assert [r.concrete for r in M.in_zone_of_uselessness(M.distance_metrics(zones)).collect()] == [1]


def test_thresholds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "value double")
    bad = lambda verb: sorted(r.value for r in M.threshold_violations(df, verb, 2).collect())
    assert [bad(v) for v in ("below", "above", "equal", "below_or_equal", "above_or_equal")] == [[2, 3], [1, 2], [1, 3], [3], [1]]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "value double")
    assert [math.isnan(r.value) for r in M.threshold_violations(odd, "above", 0).collect()] == [True]
    for bad_value in (float("nan"), float("inf")):
        with pytest.raises(UserError):
            M.threshold_violations(df, "above", bad_value)
    with pytest.raises(UserError):
        M.custom_metric(df, " ", "d", F.lit(1))


def test_many_impls_of_one_simple_name_meet_one_type_at_most(spark):
    impls = spark.range(10_000).selectExpr("id as impl_id", "concat('m', id % 100, '::Error') as name", "concat('f', id % 10) as file")
    types = spark.range(1_000).selectExpr("concat('t', id, '::Error') as type", "concat('f', id % 20) as file")
    own = spark.createDataFrame([("m7::Error", "elsewhere"), ("m8::Error", "a"), ("m8::Error", "b"), ("x::Other", "f3")], "type string, file string")
    more = spark.createDataFrame([(-1, "y::Other", "f3"), (-2, "z::Other", "f4"), (-3, "None", "f4"), (-4, None, None)], "impl_id long, name string, file string")
    got = M.associate_impls(impls.unionByName(more), types.unionByName(own)).toPandas()
    assert set(got[got.type == "m7::Error"].impl_id) == set(range(7, 10_000, 100)) and len(got) == 102
    assert set(got[got.impl_id < 0].impl_id) == {-1, -2} and set(got[got.impl_id < 0].type) == {"x::Other"}

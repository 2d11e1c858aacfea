"""Rules over many nodes of equal fields: the same pairs as one by one, without listing more than the pairs asked for."""

import random

import pytest
from pyspark.sql import functions as F

from linkgraph.model import PropertyGraph
from linkgraph.operators import rules
from linkgraph.operators.rules import All, Any, FieldEqual, NumericWithin, Overlap, RuleDef


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    made = [(r.randint(0, 3), r.choice([None, 1.5, 2.0, 2.5, 9.0, 9.25]), r.choice([None, [], ["x"], ["x", "y", None], ["y", "z"], ["z", "w", "v"]])) for _ in range(60)]
    return [(f"n{i:03}", *x) for i, x in enumerate(made)]


@pytest.fixture(scope="module")
def g(spark, rows):
    return PropertyGraph(spark).with_nodes("N", spark.createDataFrame(rows, "key string, c int, x double, ts array<string>"))


def score(p, a, b):
    """By the definition, one pair at a time; None where the predicate doesn't hold."""
    if isinstance(p, (All, Any)):
        parts = [score(q, a, b) for q in p.parts]
        if isinstance(p, All):
            return None if None in parts else min(parts)
        return max((x for x in parts if x is not None), default=None)
    if isinstance(p, FieldEqual):
        return 1.0 if a[1] == b[1] else None
    if isinstance(p, NumericWithin):
        if a[2] is None or b[2] is None or abs(a[2] - b[2]) > p.tolerance:
            return None
        return 1 - abs(a[2] - b[2]) / p.tolerance if p.tolerance else 1.0
    s, t = ({v for v in x[3] or [] if v} for x in (a, b))
    return len(s & t) / len(s | t) if s & t and len(s & t) / len(s | t) >= p.min else None


PREDICATES = [FieldEqual("c"), NumericWithin("x", 0.5), NumericWithin("x", 0.0), Overlap("ts", 0.3), All((Overlap("ts", 0.2), NumericWithin("x", 1.0))), Any((FieldEqual("c"), NumericWithin("x", 0.5), Overlap("ts", 0.5))), All((NumericWithin("x", 1.0), Any((FieldEqual("c"), Overlap("ts", 0.5)))))]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("p", PREDICATES, ids=range(len(PREDICATES)))
def test_pairs_are_those_of_the_definition(g, rows, p, small, monkeypatch):
    monkeypatch.setattr(rules, "CHUNK", 4)
    if not small:
        monkeypatch.setattr(rules, "SENT_NODES", 0)
        monkeypatch.setattr(rules, "FEW_TOKENS", 0)
    got = sorted((e.src, e.dst, round(e.score, 9)) for e in rules.fire(g, RuleDef("r", "N", "N", p, "E")).collect())
    want = sorted((a[0], b[0], round(score(p, a, b), 9)) for a in rows for b in rows if a[0] != b[0] and score(p, a, b) is not None)
    assert got == want
    got = sorted((e.src, e.dst) for e in rules.fire(g, RuleDef("r", "N", "N", p, "E", max_edges=3)).collect())
    best = [(a[0], d) for a in rows for _, d in sorted((-score(p, a, b), b[0]) for b in rows if a[0] != b[0] and score(p, a, b) is not None)[:3]]
    assert got == sorted(best)


def test_sets_of_many_common_tokens_meet_in_blocks(spark):
    r = random.Random(3)
    sets = [(f"k{i}", r.sample([f"t{j}" for j in range(1300)], 700)) for i in range(30)]
    g = PropertyGraph(spark).with_nodes("N", spark.createDataFrame(sets, "key string, ts array<string>"))
    df = rules.fire(g, RuleDef("r", "N", "N", Overlap("ts", 0.37), "E"))
    of = {k: set(v) for k, v in sets}
    want = sorted((a, b) for a in of for b in of if a != b and len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.37)
    assert want and sorted((e.src, e.dst) for e in df.collect()) == want
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()  # no pair comes once for each token


def test_the_nearest_of_a_number_are_few(spark):
    n = spark.range(2000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("key"), F.col("id").cast("double").alias("x"))
    s = rules._classes(n, ["x"])
    assert rules._nearest(NumericWithin("x", 1e6), s, s, 3).count() <= 2000 * 10
    g = PropertyGraph(spark).with_nodes("N", n)
    got = {(e.src, e.dst) for e in rules.fire(g, RuleDef("r", "N", "N", NumericWithin("x", 1e6), "E", max_edges=2)).where("src in ('n0', 'n7', 'n1999')").collect()}
    assert got == {("n0", "n1"), ("n0", "n2"), ("n7", "n6"), ("n7", "n8"), ("n1999", "n1998"), ("n1999", "n1997")}


def test_an_approximate_rule_of_a_small_cosine_compares_in_blocks():
    assert rules.hashing(0.3) is None and rules.hashing(0.6) is None
    assert rules.hashing(0.95)[0] * rules.HASHED_COST < 1 << rules.hashing(0.95)[1]


def test_owners_and_changes_list_no_other_pairs(g, rows):
    two = [RuleDef("near", "N", "N", NumericWithin("x", 0.5), "E"), RuleDef("same", "N", "N", FieldEqual("c"), "E")]
    e = rules.derive(g, two).edges["E"].df
    want = {(a[0], b[0]): "near" if score(two[0].predicate, a, b) is not None else "same" for a in rows for b in rows if a[0] != b[0] and (a[1] == b[1] or score(two[0].predicate, a, b) is not None)}
    assert sorted((r.src, r.dst, r.rule) for r in e.collect()) == sorted((*k, v) for k, v in want.items())
    assert "LeftAnti" not in e._jdf.queryExecution().optimizedPlan().toString()
    for cap in (None, 2):
        r = [RuleDef("same", "N", "N", FieldEqual("c"), "E", max_edges=cap)]
        df = rules.what_if(g, r, "N", "n000", "c", 77)
        other = g.with_nodes("N", g.nodes["N"].withColumn("c", F.when(F.col("key") == "n000", 77).otherwise(F.col("c"))))
        before, after = ({(x.src, x.dst) for x in rules.fire(y, r[0]).collect()} for y in (g, other))
        assert {(x.change, x.src, x.dst) for x in df.collect()} == {("lost", *x) for x in before - after} | {("gained", *x) for x in after - before}


def test_nodes_of_one_name_are_not_linked_pair_by_pair(spark, monkeypatch):
    from linkgraph.operators import components, search

    linked = []
    whole = components.components
    monkeypatch.setattr(components, "components", lambda links, scratch: linked.append(links.count()) or whole(links, scratch))
    names = ["Blue Fox", "fox, blue", "Blue fox inc", None, "--"] * 40 + ["blue fox inc ltd"]
    g = PropertyGraph(spark).with_nodes("N", spark.createDataFrame([(f"n{i:03}", x) for i, x in enumerate(names)], "key string, name string"))
    got = {r.key: r.cluster for r in search.identity_clusters(g, "N", "name").collect()}
    assert linked == [2]  # two names of three: blue fox - blue fox inc - blue fox inc ltd
    assert got == {f"n{i:03}": ("n000" if i % 5 < 3 and i < 200 else f"n{i:03}") for i in range(201)}


def test_recall_joins_only_sources_that_differ(spark):
    from linkgraph.queries import QUERIES

    df = QUERIES["rule_vector_recall"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.collect() == [(True, True)]

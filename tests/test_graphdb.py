"""The handle: writes, rules, transactions, memory, snapshots."""

import pytest

from linkgraph.graphdb import Conflict, Denied, DuplicateKey, GraphDb, KeyNotFound, RuleOwned
from linkgraph.model import PropertyGraph
from linkgraph.operators import access, rules


@pytest.fixture
def db(spark):
    db = GraphDb(PropertyGraph(spark))
    people = [{"label": "Person", "key": f"p{i}", "props": {"name": f"Ann {i}", "age": 30 + i, "org_id": f"o{i % 2}"}} for i in range(4)]
    orgs = [{"label": "Org", "key": f"o{i}", "props": {"name": f"Org {i}"}} for i in range(2)]
    db.ingest_batch(people + orgs, [{"edge_type": "KNOWS", "src": "p0", "dst": "p1"}])
    return db


def edges(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_writes(db):
    assert db.upsert_node("Person", "p9", {"name": "Zoe"}) == "inserted" and db.upsert_node("Person", "p9", {"age": 9}) == "updated"
    assert db.node_info("p9") == {"key": "p9", "label": "Person", "props": {"name": "Zoe", "age": 9}}
    with pytest.raises(DuplicateKey):
        db.insert_node("Person", "p0", {})
    db.set_prop("p0", "age", None)
    assert "age" not in db.node_info("p0")["props"] and not db.remove_prop("p0", "age") and db.remove_prop("p1", "name")
    assert not db.insert_edge("KNOWS", "p0", "p1") and db.insert_edge("KNOWS", "p1", "p2")
    assert db.batch_edges([{"edge_type": "KNOWS", "src": "p2", "dst": "p3"}], [{"edge_type": "KNOWS", "src": "p0", "dst": "p1"}]) == {"edges_inserted": 1, "edges_deleted": 1}
    with pytest.raises(KeyNotFound):
        db.insert_edge("KNOWS", "p0", "nobody")
    assert db.insert_edge_upsert("LIKES", "p0", "x", "Thing") == {"nodes_created": 1, "edge_inserted": True}
    db.rename_node("p2", "q2")
    assert edges(db.neighbors("q2", "KNOWS", "both"), "key") == [("p1",), ("p3",)]
    assert db.delete_node("q2") == {"manual_edges": 2, "derived_edges": 0} and db.node_info("q2") is None
    done = db.ingest_batch([{"label": "Person", "key": "p0", "props": {"name": "New"}}, {"label": "Org", "key": "p1"}, {"label": "Org", "key": "o7"}], on_conflict="replace")
    assert (done["inserted"], done["replaced"], [i for i, _ in done["row_errors"]]) == (1, 1, [1]) and db.node_info("p0")["props"] == {"name": "New"}
    db.query_write("MATCH (p:Person) WHERE p.name = 'New' SET p.age = 77")
    assert edges(db.query("MATCH (p:Person) WHERE p.age > $a RETURN p.key AS k", {"a": 70}), "k") == [("p0",)]


def test_rules_and_their_life(db):
    spec = {"name": "works", "src_label": "Person", "dst_label": "Org", "predicate": {"kind": "KeyMatch", "field": "org_id"}, "edge_type": "WORKS_AT"}
    assert db.create_rule(spec) and not db.create_rule(spec, if_not_exists=True) and db.rules()[0]["max_edges"] == 512
    assert edges(db.neighbors("o1", "WORKS_AT", "in"), "key") == [("p1",), ("p3",)]
    with pytest.raises(RuleOwned):
        db.delete_edge("WORKS_AT", "p1", "o1")
    db.set_prop("p1", "org_id", "o0")
    assert edges(db.neighbors("o1", "WORKS_AT", "in"), "key") == [("p3",)]
    assert db.create_rule(rules.RuleDef("near", "Person", "Person", rules.NumericWithin("age", 1.0), "NEAR"))
    assert {r["name"]: r["edges"] for r in db.stats()["rules"]} == {"works": 4, "near": 6}
    assert edges(db.explain("p1", "o0"), "rule", "evidence") == [("works", "org_id = o0")]
    assert edges(db.what_if_set_prop("p0", "org_id", "o1").where("rule = 'works'"), "change", "dst") == [("gained", "o1"), ("lost", "o0")]
    assert db.rebuild_rule("near").count() == 6 and db.degree("p1", "NEAR") == 4
    db.edge_budget = 5
    assert db.check_budget() == ["near"] and "NEAR" not in db.graph.edges
    db.edge_budget = 50
    db.rebuild_rule("near")
    db.delete_rule("works")
    assert set(db.graph.edges) == {"KNOWS", "NEAR"}
    assert all(db.create_rule(x["create_rule_args"]) for x in db.suggest_rules()["suggestions"][:1])


def test_transactions_hold_or_leave_no_trace(db):
    with pytest.raises(KeyNotFound), db.transaction() as tx:
        tx.insert_node("Person", "a", {})
        tx.insert_edge("KNOWS", "a", "nobody")
    assert db.node_info("a") is None
    with pytest.raises(Conflict), db.transaction() as tx:
        tx.insert_node("Person", "a", {})
        db.insert_node("Person", "b", {})
    assert db.node_info("a") is None and db.node_info("b") is not None
    with db.transaction() as tx:
        tx.insert_node("Person", "a", {})
        tx.insert_edge("KNOWS", "a", "b")
    assert edges(db.neighbors("a", "KNOWS", "out"), "key") == [("b",)]


def test_scopes_and_snapshots(db, spark, tmp_path):
    role = access.Role("clerk", labels=("Person",), write_labels=("Person",))
    seen = db.scoped(role)
    assert seen.base.all_nodes().select("label").distinct().count() == 1
    with pytest.raises(Denied):
        seen.set_prop("p0", "age", 1)
    with db.writing_as(role):
        db.set_prop("p0", "age", 1)
        db.query_write("MATCH (p:Person) SET p.seen = true")
        with pytest.raises(PermissionError):
            db.set_prop("o0", "name", "x")
    db.create_rule(rules.RuleDef("any", "Person", "Org", rules.Any((rules.KeyMatch("org_id"), rules.FieldEqual("name"))), "AT"))
    db.enable_fulltext("Person", "name")
    db.compact()
    db.snapshot(str(tmp_path / "snap"))
    back = GraphDb.open(spark, str(tmp_path / "snap"), read_only=True)
    assert back.rules() == db.rules() and back.fulltext_pairs() == [("Person", "name")]
    assert edges(back.graph.all_edges(), "etype", "src", "dst") == edges(db.graph.all_edges(), "etype", "src", "dst")
    with pytest.raises(Denied):
        back.insert_node("Person", "z", {})


def test_memory(db):
    done = db.remember("Ann 0 ships the parsers on Monday", about=["p0", "unknown"], ts=5, kind="todo", entities=[{"key": "parser", "label": "Tool", "props": {"name": "The Parser"}}], facts=[{"subject": "p0", "predicate": "OWNS", "object": "parser"}])
    assert (done["created"], done["provisional"], done["fulltext_declared"]) == (["parser"], ["unknown"], True)
    again = db.remember("Ann 0 ships the parsers on Monday", about=["p0"], ts=5)
    assert again["note"] == done["note"] and not again["fulltext_declared"] and db.base.nodes["Note"].count() == 1
    assert edges(db.neighbors("p0", "OWNS", "out"), "key") == [("parser",)]
    found = db.recall("monday parser")
    assert found["indexed"] and [(r["key"], r["covered"]) for r in found["hits"].collect()] == [(done["note"], 2)]
    report = db.schema_report()
    assert report["provisional"] == 1 and report["provisional_sample"] == ["unknown"] and {x["label"] for x in report["brief"]["labels"]} == {"Person", "Org", "Note", "Tool", "Entity"}
    out = db.upsert_entity("unknown", {"name": "Someone"}, aliases=["nn"])
    assert not out["created"] and out["updated_fields"] == ["name"] and db.node_info("unknown")["props"] == {"id": "unknown", "name": "Someone", "aliases": ["unknown", "someone"], "alias_keys": ["nn"]}
    with pytest.raises(ValueError):
        db.upsert_entity("unknown", {}, label="Other")
    assert db.forget(key="unknown", prop="name")["changed"] and db.node_info("unknown")["props"]["aliases"] == ["unknown"]
    assert db.forget(fact={"subject": "p0", "predicate": "OWNS", "object": "parser"})["changed"]
    gone = db.forget(key="p0")
    assert gone["notes"] == [done["note"]] and db.node_info("p0") is None
    with pytest.raises(ValueError):
        db.forget()

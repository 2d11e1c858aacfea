import random

import pytest

from linkgraph.plans import syntax as S


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "RETURN", "RETURN 1 AS a,", "MATCH (a)-[*3..2]->(b) RETURN a", "MATCH (a)-[*0..2]->(b) RETURN a", "MATCH (a)-[*1..11]->(b) RETURN a", "MATCH (a)<-[:T]->(b) RETURN a", "WITH DISTINCT 1 AS a RETURN a", "RETURN CASE 1 WHEN 1 THEN 2 END AS x", "RETURN EXISTS { (a)-->(b) } AS x", "MATCH (a:B:C) RETURN a", "RETURN 'open", "WITH 1 + 1 RETURN 1", "FOREACH (x IN [1] | SET x.a = 1)", "LOAD CSV FROM 'x' AS l RETURN l"])
def test_refused(text):
    with pytest.raises(S.QueryError):
        S.parse(text)


def test_precedence():
    e = S.parse("RETURN NOT a.x = 1 + 2 * 3 AND true OR false XOR true AS r").parts[0][0].items[0].expr
    assert e.op == "or" and e.args[0].op == "and" and e.args[0].args[0].op == "not" and e.args[1].op == "xor"
    chain = S.parse("RETURN 1 < 2 <= 3 AS r").parts[0][0].items[0].expr
    assert chain.op == "and" and [x.op for x in chain.args] == ["<", "<="]


def test_patterns():
    q = S.parse("MATCH p = (a:A {k: 1})<-[r:T|:U*2..3]-(b)--(c)-[:X]->(d) RETURN p").parts[0][0].paths[0]
    assert q.var == "p" and [r.direction for r in q.rels] == ["in", "both", "out"] and (q.rels[0].low, q.rels[0].high) == (2, 3) and q.rels[0].types == ("T", "U")


def test_names_of_columns():
    items = S.parse("MATCH (n) RETURN n.a, n, COUNT(*), toUpper(n.b), 1 + n.c, sum(DISTINCT n.d)").parts[0][1].items
    assert [i.alias for i in items] == ["n.a", "n", "COUNT(*)", "toUpper(n.b)", "1 + n.c", "sum(DISTINCT n.d)"]


def test_literals():
    items = S.parse(r"RETURN 'a\'\nA' AS a, -1.5e3 AS b, `odd name` AS c, [1, null] AS d, {x: true} AS e // note").parts[0][0].items
    assert [items[0].expr.value, items[1].expr.value, items[2].expr.name] == ["a'\nA", -1500.0, "odd name"]


def test_random_tokens_raise_query_errors_only():
    r = random.Random(1)
    bits = "MATCH RETURN WITH WHERE ( ) [ ] { } - -> <- : , . .. * + = <> 'a' 1 2.5 $p n r AS IN NOT AND CASE WHEN THEN END all reduce | count UNION OPTIONAL null IS shortestPath ORDER BY LIMIT CREATE SET MERGE DELETE CALL SHOW INDEX".split()
    for _ in range(3000):
        text = " ".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        try:
            S.parse(text)
        except S.QueryError:
            pass

"""SQL that gives the same rows as the queries of operators that SQL can express."""

from __future__ import annotations

from . import urls

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5"""

_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK = rf"""with i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where text is not null),
iw as (select distinct item, w as win from i where len(w) between 1 and 9 union
  select distinct item, w[s:s + 9] from (select item, w, unnest(range(1, len(w) - 8)) as s from i where len(w) >= 10)),
d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
lens as (select distinct len(win) as n from iw),
dw as (select doc_id, s, s + n as e, w[s:s + n - 1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)),
hit as (select distinct dw.doc_id, s, e, iw.item from dw join iw using (win)),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(s, e)) as k from hit) group by 1),
found as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as h from hit group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""

NEAR = rf"""with recursive d as (select doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), []) as w from documents),
sh as (select distinct doc_id, array_to_string(w[s:s + 3], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 2)) as s from d where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') || '|' || len(w) from d where len(w) between 1 and 3),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both as (select a, b from links union all select b, a from links),
c(doc_id, other) as (select doc_id, doc_id from d union select c.doc_id, l.b from c join both l on l.a = c.other)
select doc_id, coalesce(n.n, 0) as n_shingles, comp as component_id, comp = doc_id as kept from (select doc_id, min(other) as comp from c group by 1) left join n using (doc_id)""".replace("both", "two_way")


def url_sql(model: urls.Trees, rules=urls.RULES) -> str:
    count = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    only = lambda c, letters: f"(length({c}) - length(translate({c}, '{letters}', '')))"
    share = lambda k, n: f"case when {n} > 0 then {k} / {n} else 0.0 end"
    counts = ", ".join(count("host", c) for c in urls._ENTROPY)
    suffix = "case " + " ".join(f"when list_extract(labs, -1) = '{k}' then {v!r}" for k, v in sorted(model.suffixes.items()) if k) + f" else {model.suffixes.get('', 0.0)!r} end"
    query = "split_part(u, '#', 1)"
    feats = {"length": "length(u)", "host_length": "length(host)", "depth": count("path", "/"), "digits": share(only("u", "0123456789"), "length(u)"), "host_digits": share(only("host", "0123456789"), "length(host)"), "hyphens": count("host", "-"), "labels": "len(labs)", "params": f"case when contains({query}, '?') then {count(f'substr({query}, instr({query}, {chr(39)}?{chr(39)}))', '&')} + 1 else 0 end", "entropy": "case when total > 0 then round(list_sum(list_transform(list_filter(cs, lambda c: c > 0), lambda c: -(c / total) * log2(c / total))), 6) else 0.0 end", "longest_label": "list_max(list_transform(labs, lambda x: length(x)))", "suffix": suffix, "upper": only("u", urls._UP), "escapes": count("u", "%")}

    def tree(t) -> str:
        return repr(t) if isinstance(t, float) else f"(case when f_{urls.FEATURES[t[0]]} <= {t[1]!r} then {tree(t[2])} else {tree(t[3])} end)"

    z = " + ".join([f"cast({model.base!r} as double)", *[f"cast({tree(t)} as double)" for t in model.trees]])
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in ordered) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{'allow' if a else 'block'}'" for a, h, p in ordered) + " when z > 0 then 'block' else 'allow' end"
    return f"""with a as (select page_id, coalesce(url, '') as u from pages), b as (select page_id, u, case when instr(u, '://') > 0 then substr(u, instr(u, '://') + 3) else '' end as rest from a),
c as (select page_id, u, rest, regexp_extract(rest, '^[^/?#]*') as raw from b),
d as (select page_id, u, translate(raw, '{urls._UP}', '{urls._LOW}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from c),
e as (select *, [{counts}] as cs, string_split(host, '.') as labs, list_sum([{counts}]) as total from d),
f as (select page_id, host, path, {', '.join(f'cast({v} as double) as f_{k}' for k, v in feats.items())} from e),
g as (select page_id, host, path, {z} as z from f)
select page_id, host, path, {rule} as rule, {verdict} as verdict, round(1 / (1 + exp(-z)), 6) as score from g"""


ORACLES = {"op3_impact_topk": TOP_K, "op6_minhash_forest": NEAR, "op7_url_trees": url_sql(urls.train(urls.labelled_urls())), "op10_decontaminate": BENCHMARK}

"""Near-duplicates, line windows, benchmark passages and mixing, held against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from linkgraph.llm import decontam, linededup, mixing, neardup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed, n=60, hot=25):
    """Texts of random words, near copies of some at different distances, and a group of near copies of one text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    texts = [make(r.randint(1, 120)) for _ in range(n)]
    for t in list(texts[:20]):
        c = list(t)
        for _ in range(r.randint(0, 6)):
            c[r.randrange(len(c))] = r.choice(vocabulary)
        texts.append(c)
    base = make(100)
    for _ in range(hot):
        c = list(base)
        for _ in range(r.randint(0, 2)):
            c[r.randrange(len(c))] = r.choice(vocabulary)
        texts.append(c)
    r.shuffle(texts)
    return [" ".join(w.upper() if r.random() < 0.1 else w for w in t) for t in texts]


def groups(docs):
    sets = {}
    for i, t in docs:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    docs = list(enumerate(corpus(seed)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups(docs)


def star(seed, spokes, words=200, edits=5):
    """A text and copies of it, each with edits in other places: all are linked to it, hardly any to each other."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = [base]
    for k in range(spokes):
        c = list(base)
        for at in r.sample(range(4, words - 4, 4), edits):
            c[at] = f"e{k}-{at}"
        texts.append(c)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [256, 4096])
def test_a_star_of_thousands_is_one_group(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = [(i + 10, t) for i, t in enumerate(star(3, 3000)[::-1])]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 4).collect()
    assert len(got) == 3001 and {r.component_id for r in got} == {10}


@pytest.mark.parametrize("first", [1, 4])
def test_a_star_among_other_texts_equals_brute_force(spark, monkeypatch, first):
    monkeypatch.setattr(neardup, "FIRST", first)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    docs = list(enumerate(star(5, 250)[::-1] + star(6, 120, edits=6) + corpus(7, hot=40)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups(docs)


def templated(seed, pairs, slots=15, words=100):
    """Pairs of texts at 0.9 that share three quarters of their shingles with those of all other pairs."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for p in range(pairs):
        one = list(base)
        at = r.sample(range(words // 4 * 3, words), slots)
        for x in at:
            one[x] = f"p{p}-{x}"
        two = list(one)
        two[0] = f"q{p}"  # the first word is in one shingle only
        two[-1] = f"r{p}"
        two[words // 2] = f"s{p}"
        texts += [one, two]
    return [" ".join(t) for t in texts]


def test_pairs_of_one_template_equal_brute_force(spark):
    docs = list(enumerate(templated(9, 150)))
    random.Random(2).shuffle(docs)
    want = groups(docs)
    assert sum(kept for _, _, kept in want.values()) == 150
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_no_pair_of_thousands_of_one_template_is_lost(spark):
    docs = list(enumerate(templated(10, 2000)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 4).collect()}
    assert all(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(2000))


def test_rows_of_one_document_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (7, c), (5, ""), (None, a)], "doc_id bigint, text string").repartition(3)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 3, True), *[(5, 3, False)] * 4, (7, 7, True)]
    left = [(r.doc_id, r.text) for r in neardup.one_of_each(docs).collect()]
    assert sorted(left, key=str) == sorted([(3, a), (5, b), (7, c), (5, ""), (None, a)], key=str)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[7].component_id == 1 and by[1].kept and not by[2].kept
    assert (by[3].n_shingles, by[3].component_id, by[3].kept) == (0, 3, True) and by[4].component_id == 4 and by[5].component_id == 5
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    one = neardup.one_of_each(odd_docs)
    assert one.columns == odd_docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 7 not in ids and ids.count(None) == 2 and {3, 4, 5, 6} <= set(ids)
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.one_of_each(no_docs).count() == 0


def removed_lines(docs):
    """Lines that aren't blank of each document, and those of them that windows of three wrapped lines remove."""
    windows, lines, whole = [], {}, {}
    for i, t in docs:
        ls = [SPACED.findall(x.translate(LOW)) for x in t.split("\n")]
        ls = [x for x in ls if x]
        lines[i] = len(ls)
        rows = [(n, tuple(x[k : k + 24])) for n, x in enumerate(ls) for k in range(0, len(x), 24)]
        whole[i] = [{k for k, (m, _) in enumerate(rows) if m == n} for n in range(len(ls))]
        windows += [(tuple(x for _, x in rows[s : s + 3]), i, s) for s in range(len(rows) - 2)]
    first = {}
    for w, i, s in windows:
        first[w] = min(first.get(w, (i, s)), (i, s))
    covered = defaultdict(set)
    for w, i, s in windows:
        if first[w] != (i, s):
            covered[i] |= set(range(max(s, first[w][1] + 3) if first[w][0] == i else s, s + 3))
    return lines, {i: {n for n, rows in enumerate(whole[i]) if rows <= covered[i]} for i in whole}


def test_line_windows_equal_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 30))) for _ in range(40)]
    long_line = " ".join(f"long{i}" for i in range(55))
    docs = []
    for i in range(60):
        ls = [r.choice(pool) if r.random() < 0.5 else f"own {i} {k}" for k in range(r.randint(1, 12))]
        if r.random() < 0.3:
            at = r.randint(0, len(ls))
            ls[at:at] = pool[:4]
        if r.random() < 0.2:
            ls.insert(r.randint(0, len(ls)), long_line)
        docs.append((i, "\n".join(x if r.random() < 0.8 else x + "\n" for x in ls)))
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    lines, gone = removed_lines(docs)
    assert sum(map(len, gone.values())) > 30
    for row in out:
        text, n = dict(docs)[row.doc_id], 0
        kept = []
        for x in text.split("\n"):
            if x.strip():
                if n not in gone[row.doc_id]:
                    kept.append(x)
                n += 1
            else:
                kept.append(x)
        assert (row["_lines"].n, row["_lines"].removed) == (lines[row.doc_id], len(gone[row.doc_id]))
        assert row.text == ("\n".join(kept) if len(gone[row.doc_id]) < n else "")
    assert sum(long_line in row.text for row in out) == 1


def test_a_run_of_equal_lines_and_passages_of_two_lines(spark):
    a, b = " ".join(f"a{i}" for i in range(45)), "and its end"
    docs = [(1, "\n".join(["same"] * 4)), (2, f"one\n{a}\n{b}\ntwo"), (3, f"x\n\n{a}\n{b}"), (4, f"{a} more\ny"), (5, a), (6, f"{a}\n"), (7, "A\nB\nC"), (7, "q\nr\ns\nt"), (8, "q\nr\ns\nu\n"), (8, "q\nr\ns\nu\n"), (None, "q\nr\ns")]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, "q\nr\ns"), (1, "same\nsame\nsame"), docs[1], (3, "x\n"), docs[3], (5, a), (6, f"{a}\n"), docs[6], docs[7], (8, "u\n"), (8, "u\n")])


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs).drop("_lines")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    rows = out.collect()
    by = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert by[3] is None and by[4] == "" and by[1] and by[2] == ""
    assert all(r.text == o for r, o in [(r, r.text) for r in rows if r.doc_id is None])
    assert linededup.dedup_lines(no_docs).count() == 0


def passages(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        if 0 < len(w) < 10:
            windows[tuple(w)].add(i)
        for k in range(len(w) - 9):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_benchmark_passages_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"t{i}" for i in range(30)] + ["é", "The", "x"]
    make = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, make(r.choice([1, 3, 7, 9, 10, 11, 25, 40]))) for i in range(100, 130)] + [(130, ["x"] * 30), (131, []), (132, ["x"] * 12)]
    docs = []
    for d in range(80):
        t = make(r.randint(0, 60))
        if r.random() < 0.6:
            src = r.choice(items)[1]
            a = r.randint(0, len(src))
            t[len(t) // 2 : len(t) // 2] = src[a : a + r.randint(5, 30)]
        docs.append((d, ", ".join(t)))
    docs += [(80, " ".join(["x"] * 200)), (81, "x-y z")]
    items = [(i, " ".join(t)) for i, t in items] + [(133, None)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = passages(docs, items)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(x[4] for x in want.values()) > 20


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_benchmark_judges_each_row_by_its_own_text(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    item = " ".join(f"i{k}" for k in range(40))
    docs = spark.createDataFrame([(1, item), (1, "q"), (1, item), (None, item), (None, "q"), (2, "a nameless one"), (3, None)], "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([(7, item), (None, "nameless one"), (7, "other text of the same item")], "item_id bigint, text string")
    got = decontam.decontaminate(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 1, 0, 0, False), (0, 40, 40, 1, True), (1, 1, 0, 0, False), (1, 40, 40, 1, True), (1, 40, 40, 1, True), (2, 3, 2, 0, True), (3, 0, 0, 0, False)]
    assert sorted(map(str, (r.doc_id for r in decontam.clean_rows(docs, items).collect()))) == ["1", "3", "None"]


def test_benchmark_of_odd_rows(spark, odd_docs, no_docs):
    long_text = odd_docs.where("doc_id = 6").first().text
    items = spark.createDataFrame([(1, " ".join(long_text.split()[20_000:20_030]), "x"), (None, "the of", "x"), (2, None, "x"), (3, "", "x")], "item_id bigint, text string, id string")
    got = {r.doc_id: r for r in decontam.decontaminate(odd_docs, items).collect()}
    assert got[6].contaminated and got[6].n_items == 1 and got[3].n_words == 0 and not got[3].contaminated
    left = decontam.clean_rows(odd_docs, items)
    assert left.columns == odd_docs.columns and left.where("doc_id = 6").count() == 0
    assert decontam.clean_rows(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontam.decontaminate(no_docs, items).count() == 0 and decontam.clean_rows(no_docs, items).count() == 0


def test_mix_reaches_its_targets(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 200)), "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "d", None])) for i in range(1500)] + [(9000, "one two three", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))  # reruns agree
    by = defaultdict(list)
    for g in got:
        by[dict((i, s) for i, _, s in rows)[g.doc_id]].append(g)
    total = sum(g.size for g in got)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(g.size for g in by[s]) for s in order}
    target, left, open_ = {}, total, set(order)
    while True:  # shares by weight, what is above three times a source's words goes to the others
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    for s in order:
        assert all(g.source_size == size[s] and abs(g.target - target[s]) < 1e-6 * total for g in by[s])
        assert all(g.taken in (0, g.size, 2 * g.size, 3 * g.size) for g in by[s])
        assert abs(sum(g.taken for g in by[s]) - target[s]) <= 400, s
    assert total - 200 <= sum(g.taken for g in got) <= total


@pytest.mark.parametrize("ranges", [4096, 3])
def test_mix_equals_a_queue(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "SORTED", 5)
    r = random.Random(9)
    rows = [(r.choice([i, i, 7, None]), " ".join(["w"] * r.randint(0, 9)), r.choice("aaaabcd")) for i in range(400)] + [(i, "one two", f"s{i}") for i in range(1000, 1090)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {(g.doc_id, g.src, g.size): g for g in mixing.takings(df.repartition(3), repeats=3, seed=5).collect()}
    keyed = spark.createDataFrame(list(got), "doc_id bigint, src string, size bigint").select("*", mixing.shuffle_key(5).alias("m")).collect()
    queues, copies = defaultdict(list), []
    for k in sorted(keyed, key=lambda x: (x.src, x.m)):
        queues[k.src].append(k)
    for src, queue in queues.items():  # each source sends its documents in the shuffled order, three times
        sent = 0
        for turn in range(3):
            for k in queue:
                g = got[k.doc_id, src, k.size]
                sent += k.size * g.n
                if k.size:
                    copies.append((sent / g.target, k.m, src, k.doc_id or 0, k.size, turn, k.size * g.n, (k.doc_id, src, k.size)))
    taken, spent, budget = defaultdict(int), 0, sum(len(t.split()) for _, t, _ in rows)
    for c in sorted(copies, key=lambda c: c[:6]):
        spent += c[6]
        if spent > budget:
            break
        taken[c[7]] += 1
    assert {k: g.turns for k, g in got.items()} == {k: taken[k] for k in got} and sum(taken.values()) > 200


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(g.taken <= 3 * g.size for g in got)
    assert all(g.taken == 0 for g in got if g.doc_id in (3, 4, 5))
    rows = mixing.mixed_rows(odd_docs)
    assert rows.columns == [*odd_docs.columns, "mix_copies"] and 0 < rows.count() <= odd_docs.count()
    assert rows.where("mix_copies < 1 or mix_copies > 3").count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [g.taken for g in mixing.mix(nothing).collect()] == [0, 0] and mixing.mixed_rows(nothing).count() == 0

"""URL filters with DataFrame functions only.

Host rules decide first: a rule fits its host and all subdomains if the path starts as the rule's
does, and the longest rule wins. Where none fits, gradient-boosted trees on lexical statistics of
the URL judge it; they are trained from labelled URLs and become one column expression.

A null URL, or one without ://, has an empty host and path, fits no rule, and is judged by the trees
on the statistics of an empty URL. Every row is judged alone: repeated rows get the same verdict.
Rules of the same length can't both fit a URL; log-odds of just 0 allow. URLs of any length are read in
whole. Columns other than page_id and url don't matter, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

#: (allow, host, path)
RULES = ((False, "com", "/en/"), (True, "example.com", "/en/7"), (True, "net", "/de/"), (False, "example.net", "/de/8"), (False, "org", "/es/"))
FEATURES = ("length", "host_length", "depth", "digits", "host_digits", "hyphens", "labels", "params", "entropy", "longest_label", "suffix", "upper", "escapes")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTROPY = "abcdefghijklmnopqrstuvwxyz0123456789-._"


def labelled_urls(n: int = 3000, seed: int = 3) -> list[tuple[str, int]]:
    """(url, 1 to block, 0 to allow): the sample that the default trees are trained from."""
    r = random.Random(seed)
    syllables = "ba be co da de en er fo ha in ka le ma mo na ne on or pa pe ra re sa se ta te th ti to un ve wa".split()
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    bad = "cheap free win casino pills loan spam bonus sale deal offer click farm best cash bet luck".split()
    out = []
    for _ in range(n):
        host = r.choice(["", "www.", "blog.", "m.", "news.", "docs."]) + word(r.randint(2, 4)) + r.choice([".com", ".org", ".net", ".de", ".fr", ".io", ".edu", ".gov"])
        path = "/".join([r.choice(["en", "de", "fr", "es", "a", "blog", "wiki"]), *[word(r.randint(1, 3)) for _ in range(r.randint(0, 3))], str(r.randint(1, 999))])
        tail = r.choice(["", "", "/", ".html", "#top", "?page=2", "?page=2&ref=x", "?utm_source=feed"])
        out.append((f"http{r.choice(['', 's'])}://{host}.example/{path}{tail}" if r.random() < 0.3 else f"http{r.choice(['', 's'])}://{host}/{path}{tail}", 0))
        kind = r.randrange(4)
        if kind == 0:
            host = "-".join(r.choice(bad) for _ in range(r.randint(2, 4))) + r.choice([".com", ".xyz", ".top", ".info", ".example.com", ".example.org", ".example.net"])
        elif kind == 1:
            host = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(12, 28))) + r.choice([".com", ".xyz", ".top", ".click", ".ru"])
        elif kind == 2:
            host = ".".join(str(r.randint(1, 254)) for _ in range(4))
        else:
            host = ".".join([r.choice(bad), r.choice(bad), word(2), r.choice(bad) + str(r.randint(1, 99)), r.choice(["xyz", "top", "info", "biz"])])
        host = r.choice(["", "", "www."]) + host
        path = "/".join(r.choice([word(2), r.choice(bad), str(r.randint(10**5, 10**9))]) for _ in range(r.randint(1, 6)))
        args = "&".join(f"{r.choice(['id', 'aff', 'ref', 'sid', 'c', 'clk'])}={r.randint(0, 10**8)}" for _ in range(r.randint(0, 7)))
        out.append((f"http://{host}/{path}" + (f"?{args}" if args else ""), 1))
    return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the columns give them, for training and tests."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host.translate(str.maketrans(_UP, _LOW)), rest[:end]


def features(url: str | None, suffixes: dict[str, float]) -> list[float]:
    """The statistics of one URL in plain Python, for training and tests."""
    u = url or ""
    host, path = parts(url)
    share = lambda k, n: k / n if n else 0.0
    digits = lambda s: sum(c in "0123456789" for c in s)
    counts = [host.count(c) for c in _ENTROPY]
    total = sum(counts)
    entropy = -sum(share(c, total) * np.log2(share(c, total)) for c in counts if c)
    labels = host.split(".")
    query = u.split("#", 1)[0].split("?", 1)[1] if "?" in u.split("#", 1)[0] else None
    return [float(len(u)), float(len(host)), float(path.count("/")), share(digits(u), len(u)), share(digits(host), len(host)), float(host.count("-")), float(len(labels)), float(0 if query is None else query.count("&") + 1), round(float(entropy), 6), float(max(map(len, labels))), suffixes.get(labels[-1], suffixes.get("", 0.0)), float(sum(c in _UP for c in u)), float(u.count("%"))]


def _columns(suffixes: dict[str, float]) -> dict[str, Column]:
    """The same statistics as columns over u, host and path; entropy needs the columns of counts, cs."""
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    only = lambda c, letters: F.length(c) - F.length(F.translate(c, letters, ""))
    share = lambda k, n: F.when(n > 0, k / n).otherwise(F.lit(0.0))
    before = F.substring_index(u, "#", 1)
    labels = F.split(host, r"\.")
    total = F.aggregate("cs", F.lit(0), lambda a, x: a + x)
    entropy = F.aggregate(F.filter("cs", lambda c: c > 0), F.lit(0.0), lambda a, c: a - c / F.col("n") * F.log2(c / F.col("n")))
    last = F.element_at(labels, -1)
    suffix = F.lit(float(suffixes.get("", 0.0)))
    for name, value in sorted(suffixes.items()):
        if name:
            suffix = F.when(last == name, F.lit(float(value))).otherwise(suffix)
    return {"n": total, "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "depth": count(path, "/").cast("double"), "digits": share(only(u, "0123456789"), F.length(u)), "host_digits": share(only(host, "0123456789"), F.length(host)), "hyphens": count(host, "-").cast("double"), "labels": F.size(labels).cast("double"), "params": F.when(F.contains(before, F.lit("?")), count(before.substr(F.instr(before, "?"), F.length(before)), "&") + 1).otherwise(0).cast("double"), "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"), "suffix": suffix, "upper": only(u, _UP).cast("double"), "escapes": count(u, "%").cast("double"), "entropy": F.when(F.col("n") > 0, F.round(entropy, 6)).otherwise(0.0)}


@dataclass
class Trees:
    base: float
    trees: list  # nested (feature, threshold, low, high) or leaf values
    suffixes: dict[str, float]

    def column(self) -> Column:
        def of(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.col(FEATURES[t[0]]) <= t[1], of(t[2])).otherwise(of(t[3]))

        z = F.lit(self.base)
        for t in self.trees:
            z = z + of(t)
        return z

    def margin(self, x: list[float]) -> float:
        z = self.base
        for t in self.trees:
            while not isinstance(t, float):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            z += t
        return z


def train(samples: list[tuple[str, int]], trees: int = 25, depth: int = 3, rate: float = 0.3) -> Trees:
    tops: dict[str, list[int]] = {}
    for u, label in samples:
        tops.setdefault(parts(u)[0].split(".")[-1], []).append(label)
    mean = float(np.mean([y for _, y in samples]))
    odds = lambda p: round(float(np.log(p / (1 - p))), 4)
    suffixes = {s: odds((sum(ys) + 2 * mean) / (len(ys) + 2)) for s, ys in tops.items() if len(ys) >= 20} | {"": odds(mean)}
    x = np.array([features(u, suffixes) for u, _ in samples])
    y = np.array([label for _, label in samples], float)
    values = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33))) for k in range(x.shape[1])]
    cuts = [np.round((v[1:] + v[:-1]) / 2, 6) for v in values]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    z = np.full(len(y), odds(mean))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        tg, th = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if left and len(rows) >= 20:
            for k, c in enumerate(cuts):
                if len(c):
                    a = np.cumsum(np.bincount(bins[rows, k], g[rows], len(c) + 1))[:-1]
                    b = np.cumsum(np.bincount(bins[rows, k], h[rows], len(c) + 1))[:-1]
                    gain = a**2 / (b + 1) + (tg - a) ** 2 / (th - b + 1) - tg**2 / (th + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), k, i)
        if best[1] < 0:
            value = round(float(rate * tg / (th + 1)), 6)
            z[rows] += value
            return value
        _, k, i = best
        low = bins[rows, k] <= i
        return (k, float(cuts[k][i]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return Trees(odds(mean), out, suffixes)


def judge(pages: DataFrame, model: Trees | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability to block) for each row of pages (page_id, url)."""
    model = model or train(labelled_urls())
    d = packed(pages, "page_id", "url").withColumn("u", F.coalesce("url", F.lit("")))
    at = F.instr("u", "://")
    d = d.withColumn("rest", F.when(at > 0, F.expr("substr(u, instr(u, '://') + 3)")).otherwise(F.lit("")))
    d = d.withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    d = d.select("page_id", "u", F.translate("raw_host", _UP, _LOW).alias("host"), F.regexp_extract(F.expr("substr(rest, length(raw_host) + 1)"), r"^[^?#]*", 0).alias("path"))
    d = d.withColumn("cs", F.array(*[F.length("host") - F.length(F.replace("host", F.lit(c), F.lit(""))) for c in _ENTROPY]))
    cols = _columns(model.suffixes)
    d = d.withColumn("n", cols.pop("n")).withColumns(cols)
    d = d.withColumn("z", model.column())
    block = F.lit("block")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("z") > 0, block).otherwise(F.lit("allow"))
    for allow, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is the outermost
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit("allow") if allow else block).otherwise(verdict)
    return d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round(1 / (1 + F.exp(-F.col("z"))), 6).alias("score"))

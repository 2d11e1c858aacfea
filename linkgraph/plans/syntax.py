"""Lexer and recursive-descent parser of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that can't be parsed, or means nothing on this graph."""


# ---- expressions -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (name, expression)


@dataclass(frozen=True)
class Call:
    name: str  # in lower case
    args: tuple
    distinct: bool = False
    text: str = ""


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class HasLabel:
    of: Any
    label: str


@dataclass(frozen=True)
class Case:
    whens: tuple  # of (condition, value)
    other: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    source: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    init: Any
    var: str
    source: Any
    value: Any


# ---- patterns and clauses ----------------------------------------------------------------------


@dataclass(frozen=True)
class NodeP:
    var: str | None
    label: str | None
    props: tuple = ()


@dataclass(frozen=True)
class RelP:
    var: str | None
    types: tuple
    direction: str  # out, in or both
    low: int | None = None
    high: int | None = None
    props: tuple = ()

    @property
    def many(self) -> bool:
        return self.low is not None


@dataclass(frozen=True)
class PathP:
    var: str | None
    nodes: tuple
    rels: tuple
    shortest: bool = False


@dataclass
class Match:
    paths: list
    where: Any = None
    optional: bool = False


@dataclass
class Unwind:
    source: Any
    var: str


@dataclass
class Item:
    expr: Any
    alias: str
    named: bool = False


@dataclass
class Project:
    """WITH or RETURN."""

    items: list
    star: bool = False
    distinct: bool = False
    order: list = field(default_factory=list)  # of (expression, descending)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass
class Write:
    kind: str  # create, merge, set, remove, delete
    paths: list = field(default_factory=list)
    sets: list = field(default_factory=list)
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)
    names: list = field(default_factory=list)
    detach: bool = False


@dataclass
class Query:
    parts: list  # of lists of clauses
    union_all: list  # one for each part but the first
    explain: bool = False


@dataclass
class Command:
    """DDL, SHOW and CALL."""

    kind: str
    args: dict


_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+)
  | (?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<par>\$[A-Za-z_]\w*)
  | (?P<quoted>`[^`]+`)
  | (?P<name>[A-Za-z_]\w*)
  | (?P<op><>|<=|>=|\.\.|\+=|->|<-|[-+*/%^=<>()\[\]{},.:|;])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "'": "'", '"': '"', "\\": "\\"}


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str
    at: int
    end: int


def lex(text: str) -> list[Tok]:
    out, i = [], 0
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise QueryError(f"unexpected character {text[i]!r} at {i}")
        kind = m.lastgroup
        if kind == "num" and text[m.end() - 1 : m.end()].isdigit() and text[i:].startswith(tuple("0123456789")) and text[m.end() : m.end() + 1].isalpha():
            raise QueryError(f"malformed number at {i}")
        if kind != "ws":
            out.append(Tok(kind, m[0], i, m.end()))
        i = m.end()
    out.append(Tok("end", "", i, i))
    return out


def _unquote(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
_RESERVED = {"match", "optional", "where", "with", "return", "unwind", "union", "order", "skip", "limit", "create", "merge", "set", "remove", "delete", "detach", "and", "or", "xor", "not", "in", "is", "as", "case", "when", "then", "else", "end", "starts", "ends", "contains", "call", "explain", "show", "drop", "foreach", "load"}
MAX_HOPS = 10


class Parser:
    def __init__(self, text: str) -> None:
        self.source, self.toks, self.i = text, lex(text), 0

    # -- tokens
    @property
    def tok(self) -> Tok:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> Tok:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def is_kw(self, *words: str, at: int = 0) -> bool:
        return all((t := self.peek(at + k)).kind == "name" and t.text.lower() == w for k, w in enumerate(words))

    def kw(self, *words: str) -> bool:
        if self.is_kw(*words):
            self.i += len(words)
            return True
        return False

    def need_kw(self, *words: str) -> None:
        if not self.kw(*words):
            self.fail(" ".join(words).upper())

    def is_op(self, op: str, at: int = 0) -> bool:
        t = self.peek(at)
        return t.kind == "op" and t.text == op

    def op(self, op: str) -> bool:
        if self.is_op(op):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    def fail(self, wanted: str) -> None:
        raise QueryError(f"expected {wanted} at {self.tok.at}, found {self.tok.text or 'the end'!r}")

    def name(self) -> str:
        t = self.tok
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1]
        if t.kind != "name":
            self.fail("a name")
        self.i += 1
        return t.text

    # -- statements
    def statement(self) -> Query | Command:
        explain = self.kw("explain")
        if (command := self.command()) is not None:
            self.done()
            return command
        parts, union_all = [self.clauses()], []
        while self.kw("union"):
            union_all.append(self.kw("all"))
            parts.append(self.clauses())
        self.done()
        return Query(parts, union_all, explain)

    def done(self) -> None:
        self.op(";")
        if self.tok.kind != "end":
            self.fail("the end of the query")

    def command(self) -> Command | None:
        if self.kw("show"):
            what = self.name().lower()
            return Command("show", {"what": what.rstrip("s").rstrip("e") if what.startswith("index") else what.rstrip("s")})
        for create in ("create", "drop"):
            if self.is_kw(create, "index") or self.is_kw(create, "constraint"):
                self.i += 1
                return self.ddl(create, self.name().lower())
        if self.is_kw("call"):
            self.i += 1
            proc = self.name()
            while self.op("."):
                proc += "." + self.name()
            if self.op("("):
                self.need(")")
            return Command("call", {"proc": proc.lower()})
        return None

    def ddl(self, verb: str, kind: str) -> Command:
        name = None
        if self.tok.kind in ("name", "quoted") and not self.is_kw("for") and not self.is_kw("if"):
            name = self.name()
        quiet = self.kw("if", "not", "exists") or self.kw("if", "exists")
        args = {"kind": kind, "name": name, "quiet": quiet}
        if verb == "create":
            self.need_kw("for")
            self.need("(")
            var = self.name()
            self.need(":")
            args["label"] = self.name()
            self.need(")")
            self.need_kw("on" if kind == "index" else "require")
            paren = self.op("(")
            if self.name() != var:
                self.fail(var)
            self.need(".")
            args["field"] = self.name()
            if paren:
                self.need(")")
            if kind == "constraint":
                self.need_kw("is", "unique")
        return Command(f"{verb}_{kind}", args)

    def clauses(self) -> list:
        out: list = []
        while True:
            if self.is_kw("optional", "match") or self.is_kw("match"):
                optional = self.kw("optional")
                self.need_kw("match")
                paths = [self.path()]
                while self.op(","):
                    paths.append(self.path())
                out.append(Match(paths, self.expr() if self.kw("where") else None, optional))
            elif self.kw("unwind"):
                source = self.expr()
                self.need_kw("as")
                out.append(Unwind(source, self.name()))
            elif self.kw("with"):
                out.append(self.project(False))
            elif self.kw("return"):
                out.append(self.project(True))
                return out
            elif self.kw("create"):
                out.append(Write("create", self.paths()))
            elif self.kw("merge"):
                w = Write("merge", [self.path()])
                while self.is_kw("on"):
                    self.i += 1
                    to = w.on_create if self.kw("create") else w.on_match if self.kw("match") else self.fail("CREATE or MATCH")
                    self.need_kw("set")
                    to += self.sets()
                out.append(w)
            elif self.kw("set"):
                out.append(Write("set", sets=self.sets()))
            elif self.kw("remove"):
                names = [self.postfix()]
                while self.op(","):
                    names.append(self.postfix())
                out.append(Write("remove", names=names))
            elif self.is_kw("detach") or self.is_kw("delete"):
                detach = self.kw("detach")
                self.need_kw("delete")
                names = [self.name()]
                while self.op(","):
                    names.append(self.name())
                out.append(Write("delete", names=names, detach=detach))
            elif self.is_kw("foreach") or self.is_kw("load") or self.is_kw("call"):
                raise QueryError(f"{self.tok.text.upper()} is not supported inside a query")
            else:
                if not out:
                    self.fail("a clause")
                return out

    def paths(self) -> list:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return out

    def sets(self) -> list:
        out = []
        while True:
            target = self.postfix()
            how = "+=" if self.op("+=") else "="
            if how == "=":
                self.need("=")
            out.append((target, how, self.expr()))
            if not self.op(","):
                return out

    def project(self, final: bool) -> Project:
        p = Project([], distinct=self.kw("distinct"), final=final)
        if p.distinct and not final:
            raise QueryError("WITH DISTINCT is not supported")
        if self.op("*"):
            p.star = True
            if not self.op(","):
                return self.tail(p)
        while True:
            at = self.tok.at
            e = self.expr()
            end = self.peek(-1).end
            named = self.kw("as")
            alias = self.name() if named else None
            if not named and not final and not isinstance(e, Var):
                raise QueryError(f"an expression in WITH needs an alias, at {at}")
            p.items.append(Item(e, alias or column_name(e, self.source[at:end]), named))
            if not self.op(","):
                return self.tail(p)

    def tail(self, p: Project) -> Project:
        if self.kw("order"):
            self.need_kw("by")
            while True:
                e = self.expr()
                down = self.kw("desc") or self.kw("descending")
                if not down:
                    self.kw("asc") or self.kw("ascending")
                p.order.append((e, bool(down)))
                if not self.op(","):
                    break
        if self.kw("skip"):
            p.skip = self.expr()
        if self.kw("limit"):
            p.limit = self.expr()
        if not p.final and self.kw("where"):
            p.where = self.expr()
        return p

    # -- patterns
    def path(self) -> PathP:
        var = None
        if self.tok.kind in ("name", "quoted") and self.is_op("=", 1):
            var = self.name()
            self.need("=")
        if self.is_kw("shortestpath") and self.is_op("(", 1):
            self.i += 2
            p = self.chain()
            self.need(")")
            if len(p.rels) != 1 or not p.rels[0].many:
                raise QueryError("shortestPath takes one relationship of variable length")
            if p.rels[0].low > 1:
                raise QueryError("shortestPath takes no least length")
            return PathP(var, p.nodes, p.rels, True)
        p = self.chain()
        return PathP(var, p.nodes, p.rels)

    def chain(self) -> PathP:
        nodes, rels = [self.node()], []
        while self.is_op("-") or self.is_op("<-") or (self.is_op("<") and self.is_op("-", 1)):
            rels.append(self.rel())
            nodes.append(self.node())
        return PathP(None, tuple(nodes), tuple(rels))

    def node(self) -> NodeP:
        self.need("(")
        var = label = None
        if self.tok.kind in ("name", "quoted"):
            var = self.name()
        if self.op(":"):
            label = self.name()
            if self.is_op(":"):
                raise QueryError("a node has one label")
        props = self.map_items() if self.is_op("{") else ()
        self.need(")")
        return NodeP(var, label, props)

    def rel(self) -> RelP:
        left = self.op("<-")
        if not left and self.is_op("<"):
            self.i += 1
            left = True
        if not left or self.is_op("-"):
            self.op("-")
        var, types, low, high, props = None, [], None, None, ()
        if self.op("["):
            if self.tok.kind in ("name", "quoted"):
                var = self.name()
            if self.op(":"):
                types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
            if self.op("*"):
                low, high = 1, MAX_HOPS
                if self.tok.kind == "num":
                    t = self.tok.text
                    self.i += 1
                    if re.fullmatch(r"\d+\.", t) or "." in t:
                        raise QueryError(f"malformed length {t}")
                    low = high = int(t)
                if self.op(".."):
                    high = MAX_HOPS
                    if self.tok.kind == "num":
                        high = int(self.tok.text)
                        self.i += 1
                if not 1 <= low <= high <= MAX_HOPS:
                    raise QueryError(f"a length is between 1 and {MAX_HOPS}")
            if self.is_op("{"):
                props = self.map_items()
            self.need("]")
        right = self.op("->")
        if not right:
            self.need("-")
            right = self.op(">")
        if left and right:
            raise QueryError("a relationship has one direction")
        return RelP(var, tuple(types), "in" if left else "out" if right else "both", low, high, props)

    def map_items(self) -> tuple:
        self.need("{")
        out = []
        while not self.op("}"):
            if out:
                self.need(",")
            k = _unquote(self.tok.text) if self.tok.kind == "str" else None
            if k is not None:
                self.i += 1
            else:
                k = self.name()
            self.need(":")
            out.append((k, self.expr()))
        return tuple(out)

    # -- expressions
    def expr(self) -> Any:
        e = self.xor()
        while self.kw("or"):
            e = Op("or", (e, self.xor()))
        return e

    def xor(self) -> Any:
        e = self.conj()
        while self.kw("xor"):
            e = Op("xor", (e, self.conj()))
        return e

    def conj(self) -> Any:
        e = self.neg()
        while self.kw("and"):
            e = Op("and", (e, self.neg()))
        return e

    def neg(self) -> Any:
        return Op("not", (self.neg(),)) if self.kw("not") else self.comparison()

    def comparison(self) -> Any:
        e = self.sum()
        links = []
        while True:
            if (t := self.tok).kind == "op" and t.text in ("=", "<>", "<", "<=", ">", ">="):
                self.i += 1
                right = self.sum()
                links.append(Op(t.text, (e, right)))
                e = right
                continue
            base = links.pop() if links else None
            found = self.predicate(e)
            if found is None:
                if base is not None:
                    links.append(base)
                break
            if base is not None:
                raise QueryError("a predicate follows a comparison")
            e = found
        if not links:
            return e
        out = links[0]
        for x in links[1:]:
            out = Op("and", (out, x))
        return out

    def predicate(self, e: Any) -> Any:
        if self.kw("is", "not", "null"):
            return Op("is not null", (e,))
        if self.kw("is", "null"):
            return Op("is null", (e,))
        if self.kw("in"):
            return Op("in", (e, self.sum()))
        for words, op in ((("starts", "with"), "starts with"), (("ends", "with"), "ends with"), (("contains",), "contains")):
            if self.kw(*words):
                return Op(op, (e, self.sum()))
        return None

    def sum(self) -> Any:
        e = self.product()
        while self.is_op("+") or self.is_op("-"):
            op = self.tok.text
            self.i += 1
            e = Op(op, (e, self.product()))
        return e

    def product(self) -> Any:
        e = self.power()
        while self.is_op("*") or self.is_op("/") or self.is_op("%"):
            op = self.tok.text
            self.i += 1
            e = Op(op, (e, self.power()))
        return e

    def power(self) -> Any:
        e = self.unary()
        while self.op("^"):
            e = Op("^", (e, self.unary()))
        return e

    def unary(self) -> Any:
        if self.op("-"):
            e = self.unary()
            return Lit(-e.value) if isinstance(e, Lit) and isinstance(e.value, (int, float)) and not isinstance(e.value, bool) else Op("neg", (e,))
        self.op("+")
        return self.postfix()

    def postfix(self) -> Any:
        e = self.atom()
        while True:
            if self.op("."):
                e = Prop(e, self.name())
            elif self.is_op("["):
                self.i += 1
                e = Index(e, self.expr())
                self.need("]")
            elif self.is_op(":") and isinstance(e, Var):
                self.i += 1
                e = HasLabel(e, self.name())
            else:
                return e

    def atom(self) -> Any:
        t = self.tok
        if t.kind == "num":
            self.i += 1
            return Lit(float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "str":
            self.i += 1
            return Lit(_unquote(t.text))
        if t.kind == "par":
            self.i += 1
            return Param(t.text[1:])
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.is_op("["):
            return self.list_or_comprehension()
        if self.is_op("{"):
            return MapOf(self.map_items())
        if t.kind == "quoted":
            return Var(self.name())
        if t.kind != "name":
            self.fail("an expression")
        word = t.text.lower()
        if word in ("true", "false", "null") and not self.is_op("(", 1):
            self.i += 1
            return Lit({"true": True, "false": False, "null": None}[word])
        if word == "case":
            return self.case()
        if word == "exists" and (self.is_op("{", 1) or self.is_op("(", 1) and self.is_op("(", 2)):
            raise QueryError("EXISTS with a pattern is not supported; use OPTIONAL MATCH and IS NULL, or WITH and count")
        if word in ("all", "any", "none", "single") and self.is_op("(", 1) and self.peek(2).kind == "name" and self.is_kw("in", at=3):
            self.i += 2
            var = self.name()
            self.need_kw("in")
            source = self.expr()
            self.need_kw("where")
            where = self.expr()
            self.need(")")
            return Quantifier(word, var, source, where)
        if word == "reduce" and self.is_op("(", 1):
            self.i += 2
            acc = self.name()
            self.need("=")
            init = self.expr()
            self.need(",")
            var = self.name()
            self.need_kw("in")
            source = self.expr()
            self.need("|")
            value = self.expr()
            self.need(")")
            return Reduce(acc, init, var, source, value)
        # a function, with dots perhaps
        k = 1
        while self.is_op(".", k) and self.peek(k + 1).kind == "name":
            k += 2
        if self.is_op("(", k) and (k == 1 or word in ("date", "datetime", "localdatetime", "duration")):
            name = "".join(x.text for x in self.toks[self.i : self.i + k])
            self.i += k + 1
            if name.lower() == "count" and self.op("*"):
                self.need(")")
                return Call("count", ())
            distinct = self.kw("distinct")
            args = []
            while not self.op(")"):
                if args:
                    self.need(",")
                args.append(self.expr())
            return Call(name.lower(), tuple(args), distinct, name)
        if word in _RESERVED:
            self.fail("an expression")
        return Var(self.name())

    def case(self) -> Case:
        self.i += 1
        whens, other = [], None
        if not self.is_kw("when"):
            raise QueryError("CASE takes WHEN with conditions")
        while self.kw("when"):
            c = self.expr()
            self.need_kw("then")
            whens.append((c, self.expr()))
        if self.kw("else"):
            other = self.expr()
        self.need_kw("end")
        return Case(tuple(whens), other if other is not None else Lit(None))

    def list_or_comprehension(self) -> Any:
        self.need("[")
        if self.peek(0).kind == "name" and self.is_kw("in", at=1):
            var = self.name()
            self.need_kw("in")
            source = self.expr()
            where = self.expr() if self.kw("where") else None
            value = self.expr() if self.op("|") else None
            self.need("]")
            return Comprehension(var, source, where, value)
        items = []
        while not self.op("]"):
            if items:
                self.need(",")
            items.append(self.expr())
        return ListOf(tuple(items))


def column_name(e: Any, source: str) -> str:
    if isinstance(e, Var):
        return e.name
    if isinstance(e, Prop) and isinstance(e.of, Var):
        return f"{e.of.name}.{e.name}"
    if isinstance(e, Call):
        if e.name == "count" and not e.args:
            return "COUNT(*)"
        args = ", ".join(column_name(a, "") for a in e.args)
        return f"{e.text or e.name}({'DISTINCT ' if e.distinct else ''}{args})"
    if isinstance(e, Lit):
        return repr(e.value) if isinstance(e.value, str) else "null" if e.value is None else str(e.value).lower() if isinstance(e.value, bool) else str(e.value)
    return source.strip() or "<expr>"


def parse(text: str) -> Query | Command:
    return Parser(text).statement()


def children(e: Any) -> list:
    """Expressions directly inside an expression."""
    if isinstance(e, (Prop, HasLabel)):
        return [e.of]
    if isinstance(e, Index):
        return [e.of, e.at]
    if isinstance(e, ListOf):
        return list(e.items)
    if isinstance(e, MapOf):
        return [v for _, v in e.items]
    if isinstance(e, (Call, Op)):
        return list(e.args)
    if isinstance(e, Case):
        return [x for w in e.whens for x in w] + [e.other]
    if isinstance(e, Comprehension):
        return [x for x in (e.source, e.where, e.value) if x is not None]
    if isinstance(e, Quantifier):
        return [e.source, e.where]
    if isinstance(e, Reduce):
        return [e.init, e.source, e.value]
    return []


def walk(e: Any):
    yield e
    for c in children(e):
        yield from walk(c)


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))

"""Lexer and recursive-descent parser of the query language."""

from __future__ import annotations

import re

from knotwork.plans import syntax as S


class QueryError(ValueError):
    """A query that cannot be parsed or planned."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      |(?P<int>\d+)
      |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      |(?P<quoted>`(?:``|[^`])*`)
      |(?P<name>[^\W\d]\w*)
      |(?P<op><>|<=|>=|=~|\.\.|\+=|[-+*/%^=<>()\[\]{}.,:|$])""",
    re.X | re.S,
)
#: The escapes that string literals know.
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_REJECTED = {"MERGE", "CALL", "FOREACH", "LOAD", "START", "EXPLAIN", "PROFILE"}
_CLAUSES = {"MATCH", "OPTIONAL", "UNWIND", "WITH", "RETURN", "CREATE", "SET", "REMOVE", "DELETE", "DETACH", "UNION"}


def _string(raw: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise QueryError(f"unknown escape \\{m[1]}")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, raw[1:-1], flags=re.S)


class Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if text[at] == ";" and not text[at + 1 :].strip():
                    break
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            at = m.end()
            if m.lastgroup != "space":
                self.toks.append((m.lastgroup or "", m.group()))
        self.i = 0
        self.fresh = 0

    # tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def word(self, *words: str, k: int = 0) -> bool:
        kind, text = self.peek(k)
        return kind == "name" and text.upper() in words

    def op(self, *ops: str, k: int = 0) -> bool:
        kind, text = self.peek(k)
        return kind == "op" and text in ops

    def take(self, *texts: str) -> bool:
        if self.op(*texts) or self.word(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise QueryError(f"expected {text}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind == "quoted":
            self.i += 1
            return text[1:-1].replace("``", "`")
        if kind != "name":
            raise QueryError(f"expected a name, found {text or 'the end'!r}")
        self.i += 1
        return text

    def integer(self) -> int:
        kind, text = self.peek()
        if kind != "int":
            raise QueryError(f"expected a whole number, found {text or 'the end'!r}")
        self.i += 1
        return int(text)

    # clauses

    def query(self) -> S.Query:
        clauses = []
        while self.peek()[0] != "end" and not self.word("UNION"):
            clauses.append(self.clause())
        if not clauses:
            raise QueryError("empty query")
        for c in clauses[:-1]:
            if isinstance(c, S.Project) and c.final:
                raise QueryError("RETURN must come last")
        if isinstance(clauses[-1], (S.Match, S.Unwind)) or (isinstance(clauses[-1], S.Project) and not clauses[-1].final):
            raise QueryError("a query must end in RETURN or an update")
        if self.take("UNION"):
            every = self.take("ALL")
            return S.Query(tuple(clauses), self.query(), every)
        return S.Query(tuple(clauses))

    def clause(self):
        if self.take("OPTIONAL"):
            self.need("MATCH")
            return self.match(True)
        if self.take("MATCH"):
            return self.match(False)
        if self.take("UNWIND"):
            e = self.expr()
            self.need("AS")
            return S.Unwind(e, self.name())
        if self.take("WITH"):
            return self.project(False)
        if self.take("RETURN"):
            return self.project(True)
        if self.take("CREATE"):
            return S.Create(self.patterns())
        if self.take("SET"):
            return S.Update(self.updates(False))
        if self.take("REMOVE"):
            return S.Update(self.updates(True), True)
        if self.take("DETACH"):
            self.need("DELETE")
            return S.Delete(self.names(), True)
        if self.take("DELETE"):
            return S.Delete(self.names())
        word = self.peek()[1]
        raise QueryError(f"{word} is not supported" if word.upper() in _REJECTED else f"unexpected {word!r}")

    def match(self, optional: bool) -> S.Match:
        parts = self.patterns()
        return S.Match(parts, self.expr() if self.take("WHERE") else None, optional)

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return tuple(out)

    def updates(self, remove: bool):
        out = []
        while True:
            var = self.name()
            if self.op(":"):
                out.append(S.SetKinds(var, self.kinds()))
            else:
                self.need(".")
                key = self.name()
                if self.op("+="):
                    raise QueryError("+= is not supported")
                if remove:
                    out.append(S.SetProp(var, key, S.Lit(None)))
                else:
                    self.need("=")
                    out.append(S.SetProp(var, key, self.expr()))
            if not self.take(","):
                return tuple(out)

    def project(self, final: bool) -> S.Project:
        distinct, items, star = self.take("DISTINCT"), [], False
        while True:
            if self.op("*") and not items:
                self.i += 1
                star = True
            else:
                start = self.i
                e = self.expr()
                if self.take("AS"):
                    alias = self.name()
                else:
                    alias = e.name if isinstance(e, S.Var) else self.source(start)
                    if not final and not isinstance(e, S.Var):
                        raise QueryError("expressions in WITH need an alias")
                items.append(S.Item(e, alias))
            if not self.take(","):
                break
        order, skip, limit = [], None, None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                order.append(S.SortKey(e, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            skip = self.integer()
        if self.take("LIMIT"):
            limit = self.integer()
        where = self.expr() if not final and self.take("WHERE") else None
        return S.Project(tuple(items), star, distinct, tuple(order), skip, limit, where, final)

    def source(self, start: int) -> str:
        out = ""
        for kind, text in self.toks[start : self.i]:
            out += (" " if out and kind != "op" and out[-1] not in "(.[$" else "") + text
        return out

    # patterns

    def patterns(self) -> tuple[S.PatternPart, ...]:
        out = [self.part()]
        while self.take(","):
            out.append(self.part())
        return tuple(out)

    def part(self) -> S.PatternPart:
        var = None
        if self.peek()[0] in ("name", "quoted") and self.op("=", k=1):
            var = self.name()
            self.need("=")
        if self.word("SHORTESTPATH", "ALLSHORTESTPATHS") and self.op("(", k=1):
            kind = "one" if self.name().upper() == "SHORTESTPATH" else "all"
            self.need("(")
            chain = self.chain()
            self.need(")")
            if len(chain.rels) != 1 or not chain.rels[0].variable:
                raise QueryError("a shortest path needs one variable-length step")
            return S.PatternPart(chain.nodes, chain.rels, var, kind)
        chain = self.chain()
        return S.PatternPart(chain.nodes, chain.rels, var)

    def chain(self) -> S.PatternPart:
        nodes, rels = [self.node()], []
        while self.op("-") or (self.op("<") and self.op("-", k=1)):
            rels.append(self.rel())
            nodes.append(self.node())
        return S.PatternPart(tuple(nodes), tuple(rels))

    def node(self) -> S.NodePattern:
        self.need("(")
        var = self.name() if self.peek()[0] in ("name", "quoted") else None
        kinds = self.kinds() if self.op(":") else ()
        props = self.inline()
        self.need(")")
        return S.NodePattern(var, kinds, props)

    def kinds(self) -> tuple[str, ...]:
        out = []
        while self.take(":"):
            out.append(self.name())
        return tuple(out)

    def inline(self) -> S.Expr | None:
        if self.op("{"):
            return self.map()
        if self.take("$"):
            return S.Param(self.name())
        return None

    def rel(self) -> S.RelPattern:
        left = self.take("<")
        self.need("-")
        var, kinds, props, low, high, variable = None, [], None, None, None, False
        if self.take("["):
            if self.peek()[0] in ("name", "quoted"):
                var = self.name()
            if self.take(":"):
                kinds.append(self.name())
                while self.take("|"):
                    self.take(":")
                    kinds.append(self.name())
            if self.take("*"):
                variable = True
                if self.peek()[0] == "int":
                    low = self.integer()
                    high = low
                if self.take(".."):
                    high = self.integer() if self.peek()[0] == "int" else None
            props = self.inline()
            self.need("]")
        self.need("-")
        right = self.take(">")
        direction = "both" if left == right else "in" if left else "out"
        return S.RelPattern(var, tuple(kinds), props, direction, low, high, variable)

    # expressions

    def expr(self) -> S.Expr:
        e = self.xor()
        while self.take("OR"):
            e = S.Bin("or", e, self.xor())
        return e

    def xor(self) -> S.Expr:
        e = self.conj()
        while self.take("XOR"):
            e = S.Bin("xor", e, self.conj())
        return e

    def conj(self) -> S.Expr:
        e = self.negation()
        while self.take("AND"):
            e = S.Bin("and", e, self.negation())
        return e

    def negation(self) -> S.Expr:
        return S.Un("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> S.Expr:
        left = e = self.sum()
        out = None
        while True:
            if self.op("=", "<>", "<", "<=", ">", ">=", "=~"):
                o = self.peek()[1]
                self.i += 1
                right = self.sum()
                link = S.Bin(o, left, right)
                out, left = (link if out is None else S.Bin("and", out, link)), right
                continue
            if self.take("IN"):
                e = S.Bin("in", out or left, self.sum())
            elif self.word("STARTS", "ENDS") and self.word("WITH", k=1):
                o = self.name().lower()
                self.need("WITH")
                e = S.Bin(o, out or left, self.sum())
            elif self.take("CONTAINS"):
                e = S.Bin("contains", out or left, self.sum())
            elif self.word("IS"):
                self.i += 1
                negated = self.take("NOT")
                self.need("NULL")
                e = S.IsNull(out or left, negated)
            else:
                return out or e
            out, left = None, e

    def sum(self) -> S.Expr:
        e = self.product()
        while self.op("+", "-"):
            o = self.peek()[1]
            self.i += 1
            e = S.Bin(o, e, self.product())
        return e

    def product(self) -> S.Expr:
        e = self.power()
        while self.op("*", "/", "%"):
            o = self.peek()[1]
            self.i += 1
            e = S.Bin(o, e, self.power())
        return e

    def power(self) -> S.Expr:
        e = self.unary()
        while self.take("^"):
            e = S.Bin("^", e, self.unary())
        return e

    def unary(self) -> S.Expr:
        if self.op("+", "-"):
            o = self.peek()[1]
            self.i += 1
            e = self.unary()
            return S.Lit(-e.value) if o == "-" and isinstance(e, S.Lit) and isinstance(e.value, (int, float)) else S.Un(o, e)
        return self.postfix()

    def postfix(self) -> S.Expr:
        e = self.atom()
        while True:
            if self.op(".") and self.peek(1)[0] in ("name", "quoted"):
                self.i += 1
                e = S.Prop(e, self.name())
            elif self.op("["):
                self.i += 1
                at = self.expr()
                self.need("]")
                e = S.Index(e, at)
            elif self.op(":") and isinstance(e, S.Var):
                e = S.HasKinds(e, self.kinds())
            else:
                return e

    def atom(self) -> S.Expr:
        kind, text = self.peek()
        if kind == "int" or kind == "float":
            self.i += 1
            return S.Lit(int(text) if kind == "int" else float(text))
        if kind == "string":
            self.i += 1
            return S.Lit(_string(text))
        if self.take("$"):
            return S.Param(self.name())
        if self.op("["):
            return self.list()
        if self.op("{"):
            return self.map()
        if self.op("("):
            start = self.i
            try:  # a pattern in an expression is a predicate
                chain = self.chain()
                if chain.rels:
                    return S.PatternExists(chain)
            except QueryError:
                pass
            self.i = start
            self.need("(")
            e = self.expr()
            self.need(")")
            return e
        if kind == "name":
            up = text.upper()
            if up in ("TRUE", "FALSE", "NULL"):
                self.i += 1
                return S.Lit({"TRUE": True, "FALSE": False, "NULL": None}[up])
            if up == "CASE":
                return self.case()
            if self.op("(", k=1):
                return self.call()
        if kind in ("name", "quoted"):
            return S.Var(self.name())
        raise QueryError(f"unexpected {text or 'the end'!r}")

    def case(self) -> S.Expr:
        self.need("CASE")
        subject = None if self.word("WHEN") else self.expr()
        whens, other = [], None
        while self.take("WHEN"):
            test = self.expr()
            self.need("THEN")
            whens.append((S.Bin("=", subject, test) if subject is not None else test, self.expr()))
        if self.take("ELSE"):
            other = self.expr()
        self.need("END")
        return S.Case(tuple(whens), other)

    def list(self) -> S.Expr:
        self.need("[")
        if self.peek()[0] in ("name", "quoted") and self.word("IN", k=1):
            var = self.name()
            self.need("IN")
            source = self.expr()
            where = self.expr() if self.take("WHERE") else None
            out = self.expr() if self.take("|") else None
            self.need("]")
            return S.Comprehension(var, source, where, out)
        items = []
        while not self.op("]"):
            items.append(self.expr())
            if not self.take(","):
                break
        self.need("]")
        return S.ListOf(tuple(items))

    def map(self) -> S.Expr:
        self.need("{")
        items = []
        while not self.op("}"):
            key = self.name()
            self.need(":")
            items.append((key, self.expr()))
            if not self.take(","):
                break
        self.need("}")
        return S.MapOf(tuple(items))

    def call(self) -> S.Expr:
        name = self.name().lower()
        self.need("(")
        if name in ("any", "all", "none", "single") and self.word("IN", k=1):
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("WHERE")
            where = self.expr()
            self.need(")")
            return S.Quantifier(name, var, source, where)
        distinct, args = self.take("DISTINCT"), []
        if self.op("*") and name == "count":
            self.i += 1
            self.need(")")
            return S.Call(name, (), star=True)
        while not self.op(")"):
            args.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        return S.Call(name, tuple(args), distinct)


def parse(text: str) -> S.Query:
    p = Parser(text)
    q = p.query()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r}")
    return q

"""Tokens to syntax tree, by recursive descent with operator precedence."""

from __future__ import annotations

from . import syntax as S
from .lexer import Token, tokens
from .syntax import CypherSyntaxError

_COMPARE = {"=", "<>", "<", "<=", ">", ">=", "=~"}


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    # Tokens.

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.i += t.kind != "end"
        return t

    def fail(self, wanted: str):
        got = "end of query" if self.now.kind == "end" else repr(str(self.now.value))
        raise CypherSyntaxError(f"expected {wanted}, got {got}", self.now.at)

    def sign(self, *values: str) -> bool:
        if self.now.kind == "sign" and self.now.value in values:
            self.i += 1
            return True
        return False

    def is_sign(self, *values: str) -> bool:
        return self.now.kind == "sign" and self.now.value in values

    def need(self, value: str) -> None:
        if not self.sign(value):
            self.fail(repr(value))

    def is_word(self, *words: str) -> bool:
        return all(self.ahead(n).word() == w for n, w in enumerate(words))

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += len(words)
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def name(self, what: str = "a name") -> str:
        if self.now.kind in ("name", "quoted"):
            return self.take().value
        self.fail(what)

    # Clauses.

    def query(self) -> S.Query:
        stream = self.word("STREAM")
        arms, flags = [self.arm()], []
        while self.word("UNION"):
            flags.append(self.word("ALL"))
            arms.append(self.arm())
        self.sign(";")
        if self.now.kind != "end":
            self.fail("a clause")
        return S.Query(tuple(arms), tuple(flags), stream)

    def arm(self) -> tuple[S.Clause, ...]:
        out = []
        while self.now.kind != "end" and not self.is_word("UNION") and not self.is_sign(";"):
            out.append(self.clause())
        if not out:
            self.fail("a clause")
        return tuple(out)

    def clause(self) -> S.Clause:
        if self.word("OPTIONAL"):
            self.need_word("MATCH")
            return self.match(True)
        if self.word("MATCH"):
            return self.match(False)
        if self.word("WITH"):
            p = self.projection()
            return S.With(p, self.expr() if self.word("WHERE") else None)
        if self.word("RETURN"):
            return S.Return(self.projection())
        if self.word("UNWIND"):
            e = self.expr()
            self.need_word("AS")
            return S.Unwind(e, self.name())
        if self.word("CREATE"):
            if self.is_word("INDEX") or self.is_word("CONSTRAINT"):
                return self.create_schema()
            return S.Create(self.parts())
        if self.word("DROP"):
            kind = "index" if self.word("INDEX") else "constraint" if self.word("CONSTRAINT") else self.fail("INDEX or CONSTRAINT")
            return S.Schema(f"drop {kind}", self.name(), lenient=self.word("IF", "EXISTS"))
        if self.word("SHOW"):
            if self.word("INDEX") or self.word("INDEXES"):
                return S.Schema("show indexes")
            if self.word("CONSTRAINT") or self.word("CONSTRAINTS"):
                return S.Schema("show constraints")
            self.fail("INDEXES or CONSTRAINTS")
        if self.word("MERGE"):
            return self.merge()
        if self.word("SET"):
            return S.Set(self.set_items())
        if self.word("REMOVE"):
            items = [self.remove_item()]
            while self.sign(","):
                items.append(self.remove_item())
            return S.Remove(tuple(items))
        detach = self.word("DETACH")
        if self.word("DELETE"):
            exprs = [self.expr()]
            while self.sign(","):
                exprs.append(self.expr())
            return S.Delete(tuple(exprs), detach)
        self.fail("a clause")

    def match(self, optional: bool) -> S.Match:
        parts = self.parts()
        return S.Match(parts, self.expr() if self.word("WHERE") else None, optional)

    def projection(self) -> S.Projection:
        distinct = self.word("DISTINCT")
        star, items = False, []
        if self.sign("*"):
            star = True
        else:
            items.append(self.item())
        while self.sign(","):
            items.append(self.item())
        order = []
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                key = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                order.append((key, down))
                if not self.sign(","):
                    break
        skip = self.expr() if self.word("SKIP") else None
        limit = self.expr() if self.word("LIMIT") else None
        return S.Projection(tuple(items), star, distinct, tuple(order), skip, limit)

    def item(self) -> S.Item:
        e = self.expr()
        return S.Item(e, self.name() if self.word("AS") else None)

    def create_schema(self) -> S.Schema:
        if self.word("INDEX"):
            name = None if self.is_word("FOR") else self.name()
            self.need_word("FOR")
            self.need("(")
            if self.sign(")"):
                self.need("-")
                self.need("[")
                var = self.name()
                self.need(":")
                label = self.name()
                self.need("]")
                self.need("-")
                self.sign(">")
                self.need("(")
                self.need(")")
                entity = "RELATIONSHIP"
            else:
                var = self.name()
                self.need(":")
                label = self.name()
                self.need(")")
                entity = "NODE"
            self.need_word("ON")
            self.need("(")
            key = self.key_of(var)
            self.need(")")
            return S.Schema("create index", name, label, key, entity)
        self.need_word("CONSTRAINT")
        name = None if self.is_word("FOR") or self.is_word("IF", "NOT") else self.name()
        lenient = self.word("IF", "NOT", "EXISTS")
        self.need_word("FOR")
        self.need("(")
        var = self.name()
        self.need(":")
        label = self.name()
        self.need(")")
        self.need_word("REQUIRE")
        key = self.key_of(var)
        self.need_word("IS", "UNIQUE")
        return S.Schema("create constraint", name, label, key, lenient=lenient)

    def key_of(self, var: str) -> str:
        at = self.now.at
        if self.name() != var:
            raise CypherSyntaxError(f"expected a property of {var}", at)
        self.need(".")
        return self.name()

    def merge(self) -> S.Merge:
        part = self.part()
        made, met = [], []
        while self.word("ON"):
            into = made if self.word("CREATE") else met if self.word("MATCH") else self.fail("CREATE or MATCH")
            self.need_word("SET")
            into.extend(self.set_items())
        return S.Merge(part, tuple(made), tuple(met))

    def set_items(self) -> tuple[S.SetItem, ...]:
        items = [self.set_item()]
        while self.sign(","):
            items.append(self.set_item())
        return tuple(items)

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.sign(":"):
            out.append(self.name("a label"))
        return tuple(dict.fromkeys(out))

    def set_item(self) -> S.SetItem:
        at = self.now.at
        target: S.Expr = S.Var(self.name(), at)
        if self.is_sign(":"):
            return S.SetItem("labels", target, labels=self.labels())
        if self.sign("="):
            return S.SetItem("replace", target, value=self.expr())
        if self.sign("+="):
            return S.SetItem("merge", target, value=self.expr())
        keys = []
        while self.sign("."):
            keys.append(self.name("a property"))
        if not keys:
            self.fail("'.', ':', '=' or '+='")
        for k in keys[:-1]:
            target = S.Prop(target, k)
        self.need("=")
        return S.SetItem("prop", target, keys[-1], self.expr())

    def remove_item(self) -> S.SetItem:
        target = S.Var(self.name(), self.now.at)
        if self.is_sign(":"):
            return S.SetItem("labels", target, labels=self.labels())
        self.need(".")
        return S.SetItem("prop", target, self.name("a property"))

    # Patterns.

    def parts(self) -> tuple[S.Part, ...]:
        out = [self.part()]
        while self.sign(","):
            out.append(self.part())
        return tuple(out)

    def part(self, nested: bool = False) -> S.Part:
        at, path = self.now.at, None
        if self.now.kind in ("name", "quoted") and self.ahead().kind == "sign" and self.ahead().value == "=":
            if nested:
                self.fail("a node pattern")
            path = self.name()
            self.need("=")
        if not nested and self.now.word() in ("SHORTESTPATH", "ALLSHORTESTPATHS") and self.ahead().value == "(":
            kind = "one" if self.take().word() == "SHORTESTPATH" else "all"
            self.need("(")
            inner = self.part(True)
            self.need(")")
            return S.Part(inner.nodes, inner.rels, path, kind, at)
        nodes, rels = [self.node()], []
        while self.is_sign("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return S.Part(tuple(nodes), tuple(rels), path, None, at)

    def node(self) -> S.NodePattern:
        at = self.now.at
        self.need("(")
        var = self.name() if self.now.kind in ("name", "quoted") else None
        labels = self.labels()
        props = self.map() if self.is_sign("{") else None
        self.need(")")
        return S.NodePattern(var, labels, props, at)

    def rel(self) -> S.RelPattern:
        at = self.now.at
        left = self.sign("<")
        self.need("-")
        var, types, variable, low, high, props = None, [], False, 1, None, None
        if self.sign("["):
            var = self.name() if self.now.kind in ("name", "quoted") else None
            if self.sign(":"):
                types.append(self.name("a type"))
                while self.sign("|"):
                    types.append(self.name("a type"))
            if self.sign("*"):
                variable = True
                given = self.now.kind == "int"
                if given:
                    low = high = self.take().value
                if self.sign(".."):
                    high = self.take().value if self.now.kind == "int" else None
            props = self.map() if self.is_sign("{") else None
            self.need("]")
        self.need("-")
        right = self.sign(">")
        if left and right:
            raise CypherSyntaxError("a relationship has one direction at most", at)
        if variable and props:
            raise CypherSyntaxError("a variable-length relationship takes no properties", at)
        return S.RelPattern(var, tuple(types), "in" if left else "out" if right else "both", variable, low, high, props, at)

    def map(self) -> S.MapOf:
        self.need("{")
        items: dict[str, S.Expr] = {}
        while not self.sign("}"):
            if items:
                self.need(",")
            key = self.take().value if self.now.kind == "string" else self.name("a key")
            self.need(":")
            items[key] = self.expr()
        return S.MapOf(tuple(items.items()))

    # Expressions.

    def expr(self) -> S.Expr:
        left = self.conjunction()
        while self.word("OR"):
            left = S.Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> S.Expr:
        left = self.negation()
        while self.word("AND"):
            left = S.Binary("AND", left, self.negation())
        return left

    def negation(self) -> S.Expr:
        return S.Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> S.Expr:
        left = self.sum()
        while True:
            if self.now.kind == "sign" and self.now.value in _COMPARE:
                left = S.Binary(self.take().value, left, self.sum())
            elif self.word("IN"):
                left = S.Binary("IN", left, self.sum())
            elif self.word("STARTS", "WITH"):
                left = S.Binary("STARTS WITH", left, self.sum())
            elif self.word("ENDS", "WITH"):
                left = S.Binary("ENDS WITH", left, self.sum())
            elif self.word("CONTAINS"):
                left = S.Binary("CONTAINS", left, self.sum())
            elif self.word("IS", "NOT", "NULL"):
                left = S.Unary("IS NOT NULL", left)
            elif self.word("IS", "NULL"):
                left = S.Unary("IS NULL", left)
            else:
                return left

    def sum(self) -> S.Expr:
        left = self.product()
        while self.is_sign("+", "-"):
            left = S.Binary(self.take().value, left, self.product())
        return left

    def product(self) -> S.Expr:
        left = self.minus()
        while self.is_sign("*", "/", "%"):
            left = S.Binary(self.take().value, left, self.minus())
        return left

    def minus(self) -> S.Expr:
        return S.Unary("-", self.minus()) if self.sign("-") else self.postfix()

    def postfix(self) -> S.Expr:
        e = self.primary()
        while True:
            if self.is_sign(".") and self.ahead().kind in ("name", "quoted"):
                self.i += 1
                e = S.Prop(e, self.name())
            elif self.sign("["):
                if self.sign(".."):
                    e = S.Slice(e, None, None if self.is_sign("]") else self.expr())
                else:
                    low = self.expr()
                    if self.sign(".."):
                        e = S.Slice(e, low, None if self.is_sign("]") else self.expr())
                    else:
                        e = S.Index(e, low)
                self.need("]")
            elif self.is_sign(":") and self.ahead().kind in ("name", "quoted"):
                return S.HasLabels(e, self.labels())
            else:
                return e

    def primary(self) -> S.Expr:
        t = self.now
        if t.kind in ("int", "float", "string"):
            return S.Lit(self.take().value)
        if t.kind == "param":
            return S.Param(self.take().value)
        if self.sign("("):
            e = self.expr()
            self.need(")")
            return e
        if self.sign("["):
            return self.list_rest()
        if self.is_sign("{"):
            return self.map()
        if t.kind == "name":
            w = t.word()
            called = self.ahead().kind == "sign" and self.ahead().value == "("
            if not called and w in ("NULL", "TRUE", "FALSE"):
                self.i += 1
                return S.Lit({"NULL": None, "TRUE": True, "FALSE": False}[w])
            if w == "CASE" and not called:
                return self.case()
            if called:
                return self.call()
        if t.kind in ("name", "quoted"):
            return S.Var(self.take().value, t.at)
        self.fail("an expression")

    def list_rest(self) -> S.Expr:
        if self.now.kind in ("name", "quoted") and self.ahead().word() == "IN":
            var = self.name()
            self.i += 1
            source = self.expr()
            where = self.expr() if self.word("WHERE") else None
            result = self.expr() if self.sign("|") else None
            self.need("]")
            return S.Comprehension(var, source, where, result)
        items = []
        while not self.sign("]"):
            if items:
                self.need(",")
            items.append(self.expr())
        return S.ListOf(tuple(items))

    def case(self) -> S.Expr:
        self.need_word("CASE")
        operand = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.word("WHEN"):
            a = self.expr()
            self.need_word("THEN")
            whens.append((a, self.expr()))
        if not whens:
            self.fail("WHEN")
        default = self.expr() if self.word("ELSE") else None
        self.need_word("END")
        return S.Case(operand, tuple(whens), default)

    def call(self) -> S.Expr:
        at, name = self.now.at, self.name()
        self.need("(")
        if name.lower() in ("any", "all", "none", "single") and self.now.kind in ("name", "quoted") and self.ahead().word() == "IN":
            var = self.name()
            self.i += 1
            source = self.expr()
            self.need_word("WHERE")
            where = self.expr()
            self.need(")")
            return S.Quantifier(name.lower(), var, source, where)
        if self.sign("*"):
            self.need(")")
            return S.Call(name, (), star=True, at=at)
        distinct = self.word("DISTINCT")
        args = []
        while not self.sign(")"):
            if args:
                self.need(",")
            args.append(self.expr())
        return S.Call(name, tuple(args), distinct, at=at)


def parse(text: str) -> S.Query:
    return _Parser(text).query()

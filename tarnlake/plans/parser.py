"""Reads the dialect: tokens by one pattern, then a recursive descent that accepts whole statements only."""

from __future__ import annotations

import re
from typing import NamedTuple

from tarnlake.errors import DialectError
from tarnlake.plans import syntax as S

KEYWORDS = frozenset(
    "select from where group by having order asc desc limit offset distinct as join inner left right outer on insert into values update set delete "
    "create drop table index unique if not exists primary key null and or in is like between true false begin commit rollback transaction "
    "int integer float real double text varchar blob count sum avg min max".split()
) - {"key", "transaction"}
TYPES = {"int": "int", "integer": "int", "float": "float", "real": "float", "double": "float", "text": "text", "varchar": "text", "blob": "blob"}
AGGREGATES = ("count", "sum", "avg", "min", "max")
COMPARISONS = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
TOKEN = re.compile(
    r"""\s+|(?P<number>\d+\.\d+|\d+)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"[^"]*")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign><=|>=|<>|!=|[-+*/=<>(),.;])"""
)


class Token(NamedTuple):
    kind: str  #: number, string, name, keyword, sign or end
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if m is None:
            if sql[at] in "'\"":
                raise DialectError("unterminated quote", at)
            raise DialectError(f"unexpected character {sql[at]!r}", at)
        kind = m.lastgroup
        if kind == "string":
            out.append(Token("string", m[0][1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("name", m[0][1:-1], at))
        elif kind == "word":
            low = m[0].lower()
            out.append(Token("keyword", low, at) if low in KEYWORDS else Token("name", m[0], at))
        elif kind:
            out.append(Token(kind, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


def parse(sql: str) -> S.Statement:
    """The one statement of a text, which may end with a semicolon."""
    return Parser(sql).statement()


class Parser:
    def __init__(self, sql: str) -> None:
        self.tokens = tokenize(sql)
        self.at = 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> DialectError:
        return DialectError(f"expected {wanted}, found {self.now.text or 'the end'!r}", self.now.at)

    def take(self, *texts: str) -> str:
        """The next token's text if it is one of these keywords or signs, else an empty text."""
        if self.now.kind in ("keyword", "sign") and self.now.text in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return ""

    def need(self, *texts: str) -> None:
        for t in texts:
            if not self.take(t):
                raise self.fail(t.upper())

    def ahead(self, *texts: str) -> bool:
        return all(t.kind in ("keyword", "sign") and t.text == x for t, x in zip(self.tokens[self.at :], texts, strict=False))

    def name(self, what: str = "a name") -> str:
        if self.now.kind != "name":
            raise self.fail(what)
        self.at += 1
        return self.tokens[self.at - 1].text

    def listed(self, one):
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def in_parentheses(self, one):
        self.need("(")
        out = self.listed(one)
        self.need(")")
        return out

    # --- statements

    def statement(self) -> S.Statement:
        starts = {"select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete, "create": self.create, "drop": self.drop}
        word = self.take(*starts, "begin", "commit", "rollback")
        if not word:
            raise self.fail("a statement")
        if word in starts:
            out = starts[word]()
        else:
            if self.now.kind == "name" and self.now.text.lower() == "transaction":
                self.at += 1
            out = S.Transaction(word)
        self.take(";")
        if self.now.kind != "end":
            raise self.fail("the end of the statement")
        return out

    def select(self) -> S.Select:
        distinct = bool(self.take("distinct"))
        items = self.listed(self.item)
        relation, joins = None, []
        if self.take("from"):
            relation = self.relation()
            while self.now.kind == "keyword" and self.now.text in ("join", "inner", "left", "right"):
                kind = self.take("inner", "left", "right") or "inner"
                if kind != "inner":
                    self.take("outer")
                self.need("join")
                joined = self.relation()
                self.need("on")
                joins.append(S.Join(kind, joined, self.expr()))
        where = self.expr() if self.take("where") else None
        group = ()
        if self.take("group"):
            self.need("by")
            group = self.listed(self.column)
        having = self.expr() if self.take("having") else None
        order = ()
        if self.take("order"):
            self.need("by")
            order = self.listed(self.sort_key)
        limit = self.whole_number() if self.take("limit") else None
        offset = self.whole_number() if self.take("offset") else None
        return S.Select(items, relation, tuple(joins), where, group, having, order, limit, offset, distinct)

    def item(self) -> S.Item:
        if self.take("*"):
            return S.Item(S.Star())
        if self.now.kind == "name" and self.tokens[self.at + 1].text == "." and self.tokens[self.at + 2] .text == "*" and self.tokens[self.at + 2].kind == "sign":
            table = self.name()
            self.need(".", "*")
            return S.Item(S.Star(table))
        value = self.expr()
        return S.Item(value, self.name("an alias") if self.take("as") else None)

    def relation(self) -> S.Relation:
        name = self.name("a table")
        alias = self.name("an alias") if self.take("as") or self.now.kind == "name" else name
        return S.Relation(name, alias)

    def sort_key(self) -> S.SortKey:
        value = self.expr()
        return S.SortKey(value, self.take("asc", "desc") == "desc")

    def whole_number(self) -> int:
        if self.now.kind != "number" or "." in self.now.text:
            raise self.fail("a whole number")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def insert(self) -> S.Insert:
        self.need("into")
        table = self.name("a table")
        columns = self.in_parentheses(self.name) if self.ahead("(") else ()
        self.need("values")
        return S.Insert(table, columns, self.listed(lambda: self.in_parentheses(self.literal)))

    def literal(self) -> S.Literal:
        at, e = self.now.at, self.expr()
        match e:
            case S.Literal():
                return e
            case S.Unary("-", S.Literal(int() | float() as v)) if not isinstance(v, bool):
                return S.Literal(-v)
        raise DialectError("expected literal", at)

    def update(self) -> S.Update:
        table = self.name("a table")
        self.need("set")

        def change() -> tuple[str, S.Expr]:
            column = self.name("a column")
            self.need("=")
            return column, self.expr()

        changes = self.listed(change)
        return S.Update(table, changes, self.expr() if self.take("where") else None)

    def delete(self) -> S.Delete:
        self.need("from")
        table = self.name("a table")
        return S.Delete(table, self.expr() if self.take("where") else None)

    def create(self) -> S.CreateTable | S.CreateIndex:
        if self.take("table"):
            lenient = self.if_exists("not")
            name = self.name("a table")
            return S.CreateTable(name, self.in_parentheses(self.column_def), lenient)
        unique = bool(self.take("unique"))
        self.need("index")
        lenient = self.if_exists("not")
        name = self.name("an index")
        self.need("on")
        table = self.name("a table")
        return S.CreateIndex(name, table, self.in_parentheses(self.name), unique, lenient)

    def if_exists(self, *negated: str) -> bool:
        if not self.take("if"):
            return False
        self.need(*negated, "exists")
        return True

    def column_def(self) -> S.ColumnDef:
        name = self.name("a column")
        word = self.take(*TYPES)
        if not word:
            raise self.fail("a type")
        if word == "varchar" and self.take("("):
            self.whole_number()
            self.need(")")
        nullable, key = True, False
        while word2 := self.take("primary", "not", "null"):
            if word2 == "primary":
                if self.now.kind != "name" or self.now.text.lower() != "key":
                    raise self.fail("KEY")
                self.at += 1
                key, nullable = True, False
            elif word2 == "not":
                self.need("null")
                nullable = False
        return S.ColumnDef(name, TYPES[word], nullable, key)

    def drop(self) -> S.DropTable | S.DropIndex:
        word = self.take("table", "index")
        if not word:
            raise self.fail("TABLE or INDEX")
        lenient = self.if_exists()
        return S.DropTable(self.name("a table"), lenient) if word == "table" else S.DropIndex(self.name("an index"), lenient)

    # --- expressions, from the loosest operator to the tightest

    def expr(self) -> S.Expr:
        out = self.conjunction()
        while self.take("or"):
            out = S.Binary("or", out, self.conjunction())
        return out

    def conjunction(self) -> S.Expr:
        out = self.negation()
        while self.take("and"):
            out = S.Binary("and", out, self.negation())
        return out

    def negation(self) -> S.Expr:
        return S.Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> S.Expr:
        left = self.sum()
        if self.take("is"):
            negated = bool(self.take("not"))
            self.need("null")
            return S.IsNull(left, negated)
        negated = bool(self.take("not"))
        if self.take("in"):
            return S.In(left, self.in_parentheses(self.expr), negated)
        if self.take("between"):
            low = self.sum()
            self.need("and")
            return S.Between(left, low, self.sum(), negated)
        if self.take("like"):
            like = S.Binary("like", left, self.sum())
            return S.Unary("not", like) if negated else like
        if negated:
            raise self.fail("IN, BETWEEN or LIKE")
        if sign := self.take(*COMPARISONS):
            return S.Binary(COMPARISONS[sign], left, self.sum())
        return left

    def sum(self) -> S.Expr:
        out = self.product()
        while sign := self.take("+", "-"):
            out = S.Binary(sign, out, self.product())
        return out

    def product(self) -> S.Expr:
        out = self.factor()
        while sign := self.take("*", "/"):
            out = S.Binary(sign, out, self.factor())
        return out

    def factor(self) -> S.Expr:
        if self.take("-"):
            return S.Unary("-", self.factor())
        if self.take("("):
            out = self.expr()
            self.need(")")
            return out
        t = self.now
        if t.kind == "number":
            self.at += 1
            return S.Literal(float(t.text) if "." in t.text else int(t.text))
        if t.kind == "string":
            self.at += 1
            return S.Literal(t.text)
        if word := self.take("true", "false", "null"):
            return S.Literal({"true": True, "false": False, "null": None}[word])
        if word := self.take(*AGGREGATES):
            self.need("(")
            if self.take("*"):
                if word != "count":
                    raise DialectError(f"{word.upper()} requires an argument", t.at)
                out = S.Aggregate(word, None)
            else:
                distinct = bool(self.take("distinct"))
                out = S.Aggregate(word, self.expr(), distinct)
            self.need(")")
            return out
        return self.column()

    def column(self) -> S.Column:
        name = self.name("an expression")
        return S.Column(self.name("a column"), name) if self.take(".") else S.Column(name)

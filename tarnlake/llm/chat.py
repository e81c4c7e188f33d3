r"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python closure; nothing is
evaluated from strings. The language has text, {{ value }}, {% for x in y %}, {% if %} {% elif %} {% else %}, {% set %}
and {% generation %}, which marks what a loss is taken over; values are literals, names, fields, comparison, and, or,
not, in, +, ~ and the filters of FILTERS. Names outside the scope, attributes of Python objects and calls don't exist.

guard makes control strings inside a text harmless and unguard gives the text back: each < that backslashes and | follow
gets one more backslash. One that has k of them came from one with k - 1.

Defined results: turns go by (turn, role, text), nulls first, so ties and repeated rows have one order; a null role or
text is empty; a null conversation id is a conversation of its own; an empty table has no conversations. A conversation
streams through its task in parts of PART characters at the end of a turn, so memory is bounded by a turn and a part if
the template goes over the messages once, in a loop of its own; a template that uses them otherwise has them as a list,
which holds a conversation. Turns that a template leaves unread are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import partitions, with_columns

PART = 1 << 20
TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role | line | guard }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}"
    "{% else %}{{ message.text | guard }}{% endif %}<|im_end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def guard(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unguard(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    """The text on one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"guard": guard, "line": line, "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": len}


def shown(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    cases: tuple  #: of (condition, body); the condition of else is None


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>()\[\].|,=]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}


class Values:
    """Parses one value; a recursive descent with or < and < not < comparison < + ~ < filter < field."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else ""

    def take(self, *texts: str) -> str:
        if self.peek() and self.peek() in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text} is missing")

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return Op(sign, (out, self.joined()))
        if self.take("not"):
            self.need("in")
            return Op("not in", (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.filtered()
        while sign := self.take("+", "~"):
            out = Op(sign, (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.fields()
        while self.take("|"):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def fields(self) -> Any:
        out = self.single()
        while sign := self.take(".", "["):
            if sign == ".":
                out = Field(out, Const(self.tokens[self.at][1]))
                self.at += 1
            else:
                out = Field(out, self.either())
                self.need("]")
        return out

    def single(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)
        if text == "(":
            out = self.either()
            self.need(")")
            return out
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> tuple:
    """The template's syntax tree."""
    pieces = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", template, flags=re.S) if p and not p.startswith("{#")]
    at = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p.startswith("{{"):
                out.append(Output(Values(p[2:-2]).whole()))
            elif not p.startswith("{%"):
                out.append(Output(Const(p)))
            else:
                inner = p[2:-2].strip(" -")
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return out, inner
                out.append(block(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def block(word: str, rest: str) -> Any:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            inner, _ = body("endfor")
            return For(m[1], Values(m[2]).whole(), tuple(inner))
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not name.strip().isidentifier():
                raise TemplateError(f"set {rest}")
            return Set(name.strip(), Values(value).whole())
        if word == "generation":
            inner, _ = body("endgeneration")
            return Generation(tuple(inner))
        if word == "if":
            cases, test = [], Values(rest).whole()
            while True:
                inner, end = body("elif", "else", "endif")
                cases.append((test, tuple(inner)))
                if end == "endif":
                    return If(tuple(cases))
                test = None if end == "else" else Values(end.partition(" ")[2]).whole()
        raise TemplateError(f"no block {word!r}")

    out, _ = body()
    return tuple(out)


def fold(node: Any) -> Any:
    """The tree with constant values worked out, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            kept = x if isinstance(x, tuple) else (x,)
            for y in kept:
                if isinstance(y, Output) and isinstance(y.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(shown(out[-1].value.value) + shown(y.value.value)))
                elif not (isinstance(y, Output) and y.value == Const("")):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        node = Op(node.kind, tuple(map(fold, node.args)))
        if all(isinstance(x, Const) for x in node.args):
            return Const(closure(node)({}))
        return node
    if isinstance(node, Filter):
        node = Filter(node.name, fold(node.of))
        return Const(closure(node)({})) if isinstance(node.of, Const) else node
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases = []
        for test, inner in ((None if t is None else fold(t), fold(b)) for t, b in node.cases):
            if isinstance(test, Const) and not test.value:
                continue
            if test is None or isinstance(test, Const):
                if not cases:
                    return inner
                cases.append((None, inner))
                break
            cases.append((test, inner))
        return If(tuple(cases)) if cases else ()
    return node


def closure(node: Any) -> Callable[[dict], Any]:
    """A function of the scope that gives the node's value."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, key = closure(node.of), closure(node.key)

        def get(scope: dict) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple, str)) and isinstance(k, int) and k < len(x) else None

        return get
    if isinstance(node, Filter):
        of, run = closure(node.of), FILTERS[node.name]
        return lambda scope: run("" if (x := of(scope)) is None else x)
    kind, args = node.kind, [closure(x) for x in node.args]
    if kind == "not":
        return lambda scope: not args[0](scope)
    if kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if kind == "~":
        return lambda scope: shown(args[0](scope)) + shown(args[1](scope))
    if kind == "+":

        def add(scope: dict) -> Any:
            a, b = args[0](scope), args[1](scope)
            return a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b)

        return add
    test = COMPARE[kind]
    return lambda scope: test(args[0](scope), args[1](scope))


@dataclass
class Part:
    """Text, the spans of it under the loss mask, and the code points of the conversation before it."""

    begin: int = 0
    texts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def next(self) -> Part:
        return Part(self.begin + self.size)


def uses(node: Any, name: str) -> int:
    """How often a name occurs in a tree."""
    if isinstance(node, tuple):
        return sum(uses(x, name) for x in node)
    if isinstance(node, Name):
        return int(node.name == name)
    return sum(uses(getattr(node, f.name), name) for f in fields(node)) if is_dataclass(node) else 0


class Template:
    """A compiled template. parts(messages) renders a stream of messages, without holding them if it can."""

    def __init__(self, template: str) -> None:
        self.tree = fold(parse(template))
        #: Whether one loop, inside no other, is all that reads the messages.
        self.streams = uses(self.tree, "messages") == sum(isinstance(x, For) and x.over == Name("messages") for x in self.tree) <= 1
        self.run = self.body(self.tree)

    def body(self, nodes: tuple) -> Callable[[dict, list[Part], int], Iterator[None]]:
        steps = [self.step(x) for x in nodes]

        def run(scope: dict, out: list[Part], part: int) -> Iterator[None]:
            for s in steps:
                yield from s(scope, out, part)

        return run

    def step(self, node: Any) -> Callable[[dict, list[Part], int], Iterator[None]]:
        """A generator that yields where a part may end."""
        if isinstance(node, Output):
            value = closure(node.value)

            def put(scope: dict, out: list[Part], part: int) -> Iterator[None]:
                text = shown(value(scope))
                out[0].texts.append(text)
                out[0].size += len(text)
                return iter(())

            return put
        if isinstance(node, Set):
            name, value = node.name, closure(node.value)

            def assign(scope: dict, out: list[Part], part: int) -> Iterator[None]:
                scope[name] = value(scope)
                return iter(())

            return assign
        if isinstance(node, Generation):
            inner = self.body(node.body)

            def generation(scope: dict, out: list[Part], part: int) -> Iterator[None]:
                begin = out[0].size
                for _ in inner(scope, out, part):
                    pass  # no part ends inside a marked span
                out[0].spans.append((begin, out[0].size))
                return iter(())

            return generation
        if isinstance(node, If):
            cases = [(None if t is None else closure(t), self.body(b)) for t, b in node.cases]

            def choose(scope: dict, out: list[Part], part: int) -> Iterator[None]:
                for test, inner in cases:
                    if test is None or test(scope):
                        yield from inner(scope, out, part)
                        return

            return choose
        name, over, inner = node.name, closure(node.over), self.body(node.body)

        def loop(scope: dict, out: list[Part], part: int) -> Iterator[None]:
            items, outer = iter(over(scope) or ()), {k: scope.get(k) for k in (name, "loop")}
            item, i, end = next(items, scope), 0, scope
            while item is not end:
                after = next(items, end)
                scope[name] = item
                scope["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": after is end}
                yield from inner(scope, out, part)
                if out[0].size >= part:
                    yield None
                item, i = after, i + 1
            scope.update(outer)

        return loop

    def parts(self, messages: Iterable[dict], part: int = PART) -> Iterator[Part]:
        out = [Part()]
        for _ in self.run({"messages": messages if self.streams else list(messages)}, out, part):
            done, out[0] = out[0], out[0].next()
            yield done
        if out[0].size or not out[0].begin:
            yield out[0]

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans under the loss mask, in code points."""
        parts = list(self.parts(messages))
        return "".join(t for p in parts for t in p.texts), [(p.begin + a, p.begin + b) for p in parts for a, b in p.spans]


# --- over tables

PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, last, text, spans): each conversation's formatted text in parts, in order and next to each other in a partition; spans are [begin, end) in the part under the loss mask."""
    turns = with_columns(turns, conv_id="bigint", turn="bigint", role="string", text="string").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    rows = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        held: list = []

        def read() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        rows, ready, size = read(), [], 0

        def messages(conv: object) -> Iterator[dict]:
            while held and held[0][0] == conv:
                row = held.pop()
                yield {"role": row[1] or "", "text": row[2] or ""}
                held.extend(x for x in [next(rows, None)] if x is not None)

        held.extend(x for x in [next(rows, None)] if x is not None)
        while held:
            conv, k, before = held[0][0], 0, None
            turns = messages(conv)
            for p in compiled.parts(turns):
                if before is not None:
                    ready.append((conv, k, False, "".join(before.texts), before.spans))
                    size, k = size + before.size, k + 1
                before = p
                if size >= PART:
                    yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, x, strict=True)) for x in ready], PARTS)
                    ready, size = [], 0
            for _ in turns:  # that the template left unread
                pass
            ready.append((conv, k, True, "".join(before.texts), before.spans))
            size += before.size
            if size >= PART or len(ready) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, x, strict=True)) for x in ready], PARTS)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, x, strict=True)) for x in ready], PARTS)

    return rows.mapInArrow(run, "conv_id bigint, part int, last boolean, text string, spans array<array<bigint>>")


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}: {text[at:at + 40]!r}")
        out.append((unline(unguard(m[1])), unguard(m[2])))
        at = m.end()
    return out


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: the turns' and the loss mask's digests. parts: as format_conversations gives them, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = loss = None
        n = chars = size = 0
        for b in batches:
            out = []
            for conv, last, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "last", "text", "spans")), strict=True):
                if turns is None:
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in parse_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, z in spans:
                    said = unguard(text[a:z])
                    loss.update(said.encode())
                    chars += len(said)
                size += len(text)
                if last:
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    turns = None
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, x, strict=True)) for x in out], DIGESTS)

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

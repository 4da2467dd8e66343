"""Chat formatting: a small template language, compiled to closures, and a reader for its output."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the format (fixed values), and the mark that breaks them inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
MARK = "\\"
TEMPLATE = (
    "{% for m in messages %}"
    '{% if m.role == "system" %}<<SYS>>{{ m.text | escape }}<</SYS>>'
    '{% elif m.role == "user" %}[INST]{{ m.text | escape }}[/INST]'
    '{% elif m.role == "assistant" %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>'
    "{% else %}<<ROLE>>{{ m.role | escape }}<</ROLE>>{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)
_SPECIAL = re.compile("|".join(map(re.escape, (MARK, *CONTROLS))))
_TURN = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<text>.*?)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    """Double each mark and put one behind the first character of each control string."""
    return _SPECIAL.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template isn't in the language."""


# Syntax tree: expressions.
@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    """A named operation on expressions."""

    op: str
    args: tuple


# Syntax tree: statements.
@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: Name
    body: tuple


@dataclass(frozen=True)
class Choice:
    """Conditions with their bodies, tried in turn."""

    arms: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: text_of(a) + text_of(b), "not": lambda a: not a,
} | {f"|{k}": (lambda f: lambda a: f(text_of(a)))(f) for k, f in FILTERS.items()}


def text_of(value: object) -> str:
    """How a value is written; nothing is empty."""
    return "" if value is None else value if isinstance(value, str) else str(value)


class Parser:
    """Recursive descent over a template. Names are looked up in data only: no calls, no attributes."""

    EXPR = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z]\w*(?:\.[A-Za-z]\w*)*)|(==|!=|[|+()]))""")

    def __init__(self, source: str):
        self.parts = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL) if p]
        self.at = 0

    def parse(self) -> tuple:
        body, end = self.body({"messages"})
        if end:
            raise TemplateError(f"{end} without a beginning")
        return body

    def body(self, names: set[str]) -> tuple[tuple, str]:
        """Statements up to a tag that doesn't begin one; also that tag."""
        out: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                out.append(Out(self.expression(part[2:-2], names)))
            elif not part.startswith("{%"):
                out.append(Out(Literal(part)))
            else:
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word == "for":
                    if not (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*(?:\.[A-Za-z]\w*)*)", tag)):
                        raise TemplateError(tag)
                    over = self.expression(m[2], names)
                    body, end = self.body(names | {m[1], "loop"})
                    self.expect(end, "endfor")
                    out.append(Loop(m[1], over, body))
                elif word == "if":
                    arms, test = [], self.expression(tag[2:], names)
                    while True:
                        body, end = self.body(names)
                        arms.append((test, body))
                        if end.startswith("elif"):
                            test = self.expression(end[4:], names)
                        elif end == "else":
                            test = Literal(True)
                        else:
                            self.expect(end, "endif")
                            break
                    out.append(Choice(tuple(arms)))
                elif word == "generation":
                    body, end = self.body(names)
                    self.expect(end, "endgeneration")
                    out.append(Generation(body))
                else:
                    return tuple(out), tag
        return tuple(out), ""

    @staticmethod
    def expect(found: str, wanted: str) -> None:
        if found != wanted:
            raise TemplateError(f"{wanted} is missing")

    def expression(self, source: str, names: set[str]) -> object:
        tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := self.EXPR.match(source, at)):
                raise TemplateError(source)
            tokens.append(m)
            at = m.end()
        value, rest = self.either(tokens, names)
        if rest:
            raise TemplateError(source)
        return value

    def _chain(self, word: str, below: Callable, tokens: list, names: set[str]) -> tuple:
        left, tokens = below(tokens, names)
        while tokens and tokens[0][3] == word:
            right, tokens = below(tokens[1:], names)
            left = Apply(word, (left, right))
        return left, tokens

    def either(self, tokens: list, names: set[str]) -> tuple:
        return self._chain("or", self.both, tokens, names)

    def both(self, tokens: list, names: set[str]) -> tuple:
        return self._chain("and", self.negated, tokens, names)

    def negated(self, tokens: list, names: set[str]) -> tuple:
        if tokens and tokens[0][3] == "not":
            value, tokens = self.negated(tokens[1:], names)
            return Apply("not", (value,)), tokens
        left, tokens = self.joined(tokens, names)
        if tokens and (op := tokens[0][4] or tokens[0][3]) in ("==", "!=", "in"):
            right, tokens = self.joined(tokens[1:], names)
            left = Apply(op, (left, right))
        return left, tokens

    def joined(self, tokens: list, names: set[str]) -> tuple:
        left, tokens = self.filtered(tokens, names)
        while tokens and tokens[0][4] == "+":
            right, tokens = self.filtered(tokens[1:], names)
            left = Apply("+", (left, right))
        return left, tokens

    def filtered(self, tokens: list, names: set[str]) -> tuple:
        if not tokens:
            raise TemplateError("an expression ends early")
        text, number, name, sign = tokens[0].groups()
        rest = tokens[1:]
        if sign == "(":
            value, rest = self.either(rest, names)
            if not rest or rest[0][4] != ")":
                raise TemplateError(") is missing")
            rest = rest[1:]
        elif text is not None:
            value = Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        elif number is not None:
            value = Literal(int(number))
        elif name in ("true", "false"):
            value = Literal(name == "true")
        elif name and name.split(".")[0] in names:
            value = Name(tuple(name.split(".")))
        else:
            raise TemplateError(f"unknown: {name or sign}")
        while rest and rest[0][4] == "|":
            if len(rest) < 2 or rest[1][3] not in FILTERS:
                raise TemplateError("unknown filter")
            value, rest = Apply(f"|{rest[1][3]}", (value,)), rest[2:]
        return value, rest


def fold(node: object) -> object:
    """An expression with its constant parts worked out."""
    if not isinstance(node, Apply):
        return node
    args = tuple(map(fold, node.args))
    if node.op in ("and", "or"):
        if isinstance(args[0], Literal):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
    elif all(isinstance(a, Literal) for a in args):
        return Literal(OPS[node.op](*(a.value for a in args)))
    return Apply(node.op, args)


def simplify(body: tuple) -> tuple:
    """Statements with constants folded: arms that can't be reached go, neighbouring texts join."""
    out: list = []
    for node in body:
        if isinstance(node, Out):
            node = Out(fold(node.value))
        elif isinstance(node, Loop):
            node = Loop(node.name, node.over, simplify(node.body))
        elif isinstance(node, Generation):
            node = Generation(simplify(node.body))
        else:
            arms = []
            for test, inner in node.arms:
                test = fold(test)
                if isinstance(test, Literal) and not test.value:
                    continue
                arms.append((test, simplify(inner)))
                if isinstance(test, Literal):
                    break
            if not arms or isinstance(arms[0][0], Literal):
                more = arms[0][1] if arms else ()
            else:
                more = (Choice(tuple(arms)),)
            out += more
            continue
        out.append(node)
    joined: list = []
    for node in out:
        if joined and all(isinstance(x, Out) and isinstance(x.value, Literal) for x in (joined[-1], node)):
            joined[-1] = Out(Literal(text_of(joined[-1].value.value) + text_of(node.value.value)))
        else:
            joined.append(node)
    return tuple(joined)


class Page:
    """What a template writes, and the spans of generated text in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def value_of(node: object) -> Callable[[dict], object]:
    """A closure that works an expression out."""
    if isinstance(node, Literal):
        return lambda data, v=node.value: v
    if isinstance(node, Name):
        first, *rest = node.path
        if len(rest) == 1:
            return lambda data, a=first, b=rest[0]: data[a].get(b)

        def look(data: dict) -> object:
            found = data[first]
            for key in rest:
                found = found.get(key) if isinstance(found, dict) else None
            return found

        return look
    args = tuple(map(value_of, node.args))
    if node.op == "and":
        return lambda data: args[0](data) and args[1](data)
    if node.op == "or":
        return lambda data: args[0](data) or args[1](data)
    if len(args) == 1:
        return lambda data, f=OPS[node.op], a=args[0]: f(a(data))
    return lambda data, f=OPS[node.op], a=args[0], b=args[1]: f(a(data), b(data))


def writer_of(body: tuple) -> Callable[[dict, Page], None]:
    """A closure that renders statements."""
    steps: list[Callable[[dict, Page], None]] = []
    for node in body:
        if isinstance(node, Out) and isinstance(node.value, Literal):
            steps.append(lambda data, page, t=text_of(node.value.value): page.write(t))
        elif isinstance(node, Out):
            steps.append(lambda data, page, f=value_of(node.value): page.write(text_of(f(data))))
        elif isinstance(node, Loop):

            def loop(data: dict, page: Page, name: str = node.name, over=value_of(node.over), inner=writer_of(node.body)) -> None:
                items = over(data) or []
                for i, item in enumerate(items):
                    inner(data | {name: item, "loop": {"index": i + 1, "first": i == 0, "last": i + 1 == len(items)}}, page)

            steps.append(loop)
        elif isinstance(node, Choice):

            def choice(data: dict, page: Page, arms=tuple((value_of(t), writer_of(b)) for t, b in node.arms)) -> None:
                for test, inner in arms:
                    if test(data):
                        return inner(data, page)

            steps.append(choice)
        else:

            def generation(data: dict, page: Page, inner=writer_of(node.body)) -> None:
                start = page.size
                inner(data, page)
                page.spans.append((start, page.size))

            steps.append(generation)

    def run(data: dict, page: Page) -> None:
        for step in steps:
            step(data, page)

    return run


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the text and the spans of generated text in it."""
    write = writer_of(simplify(Parser(source).parse()))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        write({"messages": messages}, page)
        return "".join(page.parts), page.spans

    return render


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a text made by ``TEMPLATE``."""
    turns, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup if m.lastgroup != "text" else None
        turns.append((kind, unescape(m[kind])) if kind else (unescape(m["role"]), unescape(m["text"])))
        at = m.end()
    return turns


def _rendered(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    render = compile_template(source)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        done = [render([{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]) for turns in batch.column(1).to_pylist()]
        spans = [[{"start": a, "stop": b} for a, b in s] for _, s in done]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, span)], names=["conv_id", "formatted", "loss"])


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Render conversations: rows (conv_id, formatted, loss), where loss holds spans of code points.

    ``rows`` has conv_id, turn, role, text. Turns are taken in the order of turn, equal turns by
    role and text; repeated rows stay. Null text and null role are empty. Rows with a null conv_id
    are one conversation. A conversation is one value of the result and so within one task. An
    empty table gives an empty result; other columns are ignored. A template that isn't in the
    language is refused here, before anything runs.
    """
    compile_template(template)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    return whole.mapInArrow(lambda x: _rendered(x, template), "conv_id long, formatted string, loss array<struct<start: long, stop: long>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        turns, learned = [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns.append([{"role": r, "text": t} for r, t in read_turns(text)])
            learned.append("".join(unescape(text[s["start"] : s["stop"]]) for s in spans))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, turn), pa.array(learned, pa.string())], names=[*batch.schema.names, "turns", "loss_text"])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``format_conversations`` undone: adds turns (role, text) and loss_text, the generated texts."""
    ddl = "conv_id long, formatted string, loss array<struct<start: long, stop: long>>, turns array<struct<role: string, text: string>>, loss_text string"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read, ddl)

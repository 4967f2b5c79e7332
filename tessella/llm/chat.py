"""Chat formatting by a template compiler.

Templates are a sandboxed language: text, {{ expression }}, {% for name in messages %},
{% if %}/{% elif %}/{% else %}, {% generation %}. Expressions have strings, whole numbers, names given
to the template, .attribute and ['attribute'] of a message, ==, !=, +, and, or, not, loop.first,
loop.last, loop.index and the filters escape, trim, upper, lower. There are no calls, no imports and
no Python attributes. compile_template() parses to a syntax tree, folds constants (text runs, constant
expressions, branches on constants) and returns a closure that renders messages lazily, so that a
conversation is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import arrow_map

#: Every string that steers the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}[INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m['text'] | escape }}{% endif %}"
    "[/INST]</s>{{ '\\n' }}{% endfor %}"
)

_ESCAPE = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Breaks control strings after their first character with a backslash and doubles backslashes."""
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# --- syntax tree: ("text", s) ("out", e) ("for", name, source, body) ("if", [(e, body)], else) ("gen", body)
# --- expressions: ("const", v) ("name", n) ("attr", e, n) ("filter", e, n) ("not", e) ("and"|"or"|"=="|"!="|"+", a, b)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent: or > and > not > comparison > sum > filters > attributes."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) else None

    def take(self, what: str | None = None) -> tuple[int, str]:
        if self.at >= len(self.tokens) or what is not None and self.peek() != what:
            raise TemplateError(f"expected {what or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def all(self) -> tuple:
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> tuple:
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.peek() == "and":
            self.take()
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negation())
        left = self.sum()
        if self.peek() in ("==", "!="):
            return (self.take()[1], left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.attribute()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", left, name)
        return left

    def attribute(self) -> tuple:
        left = self.atom()
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != 3:
                    raise TemplateError("expected a name")
            else:
                kind, name = self.take()
                if kind != 1:
                    raise TemplateError("expected a string")
                name = name[1:-1]
                self.take("]")
            if name.startswith("_"):
                raise TemplateError(f"{name!r} is closed to templates")
            left = ("attr", left, name)
        return left

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 2:
            return ("const", int(value))
        if value == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind != 3 or value.startswith("_"):
            raise TemplateError(f"unexpected {value!r}")
        return ("const", {"true": True, "false": False}[value]) if value in ("true", "false") else ("name", value)


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("out", _Expression(m[1]).all()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal pos
        found: list[tuple] = []
        while pos < len(pieces):
            kind, value = pieces[pos]
            pos += 1
            if kind != "tag":
                found.append((kind, value))
                continue
            word = value.split(None, 1)[0] if value else ""
            if word in ends:
                return found, value
            if word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", value, re.S)
                if not m:
                    raise TemplateError(value)
                inner, _ = body(("endfor",))
                found.append(("for", m[1], _Expression(m[2]).all(), inner))
            elif word == "if":
                branches, otherwise, test = [], [], value[2:]
                while True:
                    inner, end = body(("elif", "else", "endif"))
                    branches.append((_Expression(test).all(), inner))
                    if end.startswith("elif"):
                        test = end[4:]
                        continue
                    if end == "else":
                        otherwise, _ = body(("endif",))
                    break
                found.append(("if", branches, otherwise))
            elif word == "generation":
                inner, _ = body(("endgeneration",))
                found.append(("gen", inner))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return found, ""

    return body(())[0]


def _value(op: str, *args):
    if op == "filter":
        return FILTERS[args[1]](str(args[0]))
    if op == "+":
        return args[0] + args[1] if type(args[0]) is type(args[1]) else f"{args[0]}{args[1]}"
    return {"not": lambda a: not a, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}[op](*args)


def fold_expression(e: tuple) -> tuple:
    op = e[0]
    if op in ("const", "name"):
        return e
    if op in ("attr", "filter"):
        inner = fold_expression(e[1])
        return ("const", _value("filter", inner[1], e[2])) if op == "filter" and inner[0] == "const" else (op, inner, e[2])
    args = [fold_expression(a) for a in e[1:]]
    return ("const", _value(op, *(a[1] for a in args))) if all(a[0] == "const" for a in args) else (op, *args)


def fold(tree: list[tuple]) -> list[tuple]:
    """The tree with constants computed, constant branches chosen and neighbouring text joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", str(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "gen":
            add(("gen", fold(node[1])))
        elif node[0] == "if":
            branches, otherwise = [], node[2]
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    otherwise = inner
                    break
                branches.append((test, fold(inner)))
            if branches:
                add(("if", branches, fold(otherwise)))
            else:
                for n in fold(otherwise):
                    add(n)
        else:
            add(node)
    return out


def _closure(e: tuple):
    op = e[0]
    if op == "const":
        return lambda env, v=e[1]: v
    if op == "name":
        return lambda env, n=e[1]: env.get(n, "")
    if op == "attr":
        inner = _closure(e[1])
        return lambda env, n=e[2]: x.get(n, "") if isinstance(x := inner(env), dict) else ""
    if op == "filter":
        inner, f = _closure(e[1]), FILTERS[e[2]]
        return lambda env: f(str(inner(env)))
    a = [_closure(x) for x in e[1:]]
    if op == "not":
        return lambda env: not a[0](env)
    if op == "and":
        return lambda env: a[0](env) and a[1](env)
    if op == "or":
        return lambda env: a[0](env) or a[1](env)
    return lambda env: _value(op, a[0](env), a[1](env))


def _renderer(tree: list[tuple], generated: bool):
    """A closure env -> pieces (text, generated)."""
    parts = []
    for node in tree:
        if node[0] == "text":
            parts.append(lambda env, s=node[1]: ((s, generated),))
        elif node[0] == "out":
            parts.append(lambda env, f=_closure(node[1]): ((str(f(env)), generated),))
        elif node[0] == "gen":
            parts.append(_renderer(node[1], True))
        elif node[0] == "if":
            tests, last = [(_closure(t), _renderer(b, generated)) for t, b in node[1]], _renderer(node[2], generated)
            parts.append(lambda env, tests=tests, last=last: next((b(env) for t, b in tests if t(env)), None) or last(env))
        else:
            parts.append(_loop(node[1], _closure(node[2]), _renderer(node[3], generated)))

    def render(env) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(env)

    return render


def _loop(name: str, source, body):
    def run(env):
        items, index = iter(source(env) or ()), 0
        item = next(items, None)
        while item is not None:
            following = next(items, None)  # one message ahead, for loop.last
            index += 1
            yield from body(env | {name: item, "loop": {"first": index == 1, "last": following is None, "index": index}})
            item = following

    return run


def compile_template(source: str = TEMPLATE, **names):
    """A closure that takes messages (dicts, any iterable) and yields pieces (text, whether it is generated)."""
    run = _renderer(fold(parse(source)), False)
    return lambda messages: run({**names, "messages": messages})


#: Code points in an output segment, about.
SEGMENT = 1 << 16
SEGMENTS = StructType([StructField("conv_id", LongType()), StructField("segment", LongType()), StructField("text", StringType()), StructField("loss", ArrayType(ArrayType(LongType())))])


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def _groups(rows: Iterable[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, segment, text, loss: each conversation's formatted text in segments of about SEGMENT code points.

    loss: spans [start, end) in the segment's code points that count for the loss. Turns are put in order by
    (turn, role, text), nulls first, and repeated rows are repeated turns; null role and text are empty; null conv_ids are one
    conversation; an empty table gives no rows; other columns are not read. Messages stream through the
    template, so memory does not grow with a conversation.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    def run(rows):
        render = compile_template(template)
        for conv, turns in _groups(rows):
            held, loss, size, segment = [], [], 0, 0
            for piece, generated in render({"role": role, "text": text} for _, _, role, text in turns):
                if generated and piece:
                    if loss and loss[-1][1] == size:
                        loss[-1][1] += len(piece)
                    else:
                        loss.append([size, size + len(piece)])
                held.append(piece)
                size += len(piece)
                if size >= SEGMENT:
                    yield conv, segment, "".join(held), loss
                    held, loss, size, segment = [], [], 0, segment + 1
            if size or not segment:
                yield conv, segment, "".join(held), loss

    return arrow_map(_ordered(turns, "turn", "role", "text"), run, SEGMENTS)


READ = StructType([StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

#: The default template's turn, read back.
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.S)


def read_back(formatted: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Parses the default template's output back, from the segments alone, and digests turns and loss text.

    in_order: the segments of a conversation already stand together and in order, as format_conversations() leaves them.
    """
    segments = formatted.select("conv_id", "segment", "text", "loss")

    def run(rows):
        for conv, parts in _groups(rows):
            turns, loss, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            tail, masked = "", ""
            for _, _, text, spans in parts:
                n_chars += len(text)
                for a, b in spans:
                    piece = masked + text[a:b]
                    # an escape may be cut between two segments: its backslashes wait for the next one
                    keep = (len(piece) - len(piece.rstrip("\\"))) if b == len(text) else 0
                    piece, masked = (piece[: len(piece) - keep], piece[len(piece) - keep :]) if keep else (piece, "")
                    piece = unescape(piece)
                    n_loss += len(piece)
                    loss.update(piece.encode())
                tail += text
                end = 0
                for m in TURN.finditer(tail):
                    n_turns += 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    end = m.end()
                tail = tail[end:]
            if masked:
                piece = unescape(masked)
                n_loss += len(piece)
                loss.update(piece.encode())
            if tail:
                raise ValueError(f"conversation {conv}: {tail[:80]!r} is no turn")
            yield conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

    return arrow_map(segments if in_order else _ordered(segments, "segment"), run, READ)

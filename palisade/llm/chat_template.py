"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures. The language
has text, {{ expression | filter }}, {% for x in xs %}, {% if %}/{% elif %}/{% else %}, {% set x = ... %} and
{% generation %}...{% endgeneration %}, which marks the span that a model is trained on. Expressions reach only the
values given to them: names, keys, literals, comparisons, arithmetic and registered filters; nothing is called or
looked up on Python objects.
"""

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox doesn't allow."""


# ---------------------------------------------------------------- escaping

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def guard(text: str) -> str:
    """Text without "<|": each "<" and backslashes before "|" get one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unguard(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def guard_line(text: str) -> str:
    """As guard, on one line."""
    return guard(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(text))


FILTERS: dict[str, Callable] = {
    "guard": lambda x: guard("" if x is None else str(x)), "line": lambda x: guard_line("" if x is None else str(x)),
    "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "length": len, "default": lambda x, y="": y if x is None else x, "replace": lambda x, a, b: str(x).replace(a, b)}

# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "%"))


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at, pos = [], 0, 0
        source = source.strip()
        while pos < len(source):
            if not (m := _TOKEN.match(source, pos)):
                raise TemplateError(f"can't read {source[pos:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str:
        if self.at >= len(self.tokens) or wanted and not self.peek(*wanted):
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def level(self, k: int = 0):
        if k == len(_LEVELS):
            return self.filtered()
        if _LEVELS[k] == ("not",):
            if self.peek("not"):
                self.take()
                return Op("not", (self.level(k),))
            return self.level(k + 1)
        left = self.level(k + 1)
        while self.peek(*_LEVELS[k]) or k == 3 and self.peek("not"):
            op = self.take()
            if op == "not":
                self.take("in")
                left = Op("not", (Op("in", (left, self.level(k + 1))),))
            else:
                left = Op(op, (left, self.level(k + 1)))
        return left

    def filtered(self):
        value = self.postfix()
        while self.peek("|"):
            self.take()
            name, args = self.take(), [value]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    args.append(self.level())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
            value = Filter(name, tuple(args))
        return value

    def postfix(self):
        value = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                key = self.take()
                if key.startswith("_"):
                    raise TemplateError(f"no access to {key}")
                value = Key(value, Const(key))
            else:
                value = Key(value, self.level())
                self.take("]")
        if self.peek("("):
            raise TemplateError("calls aren't allowed")
        return value

    def atom(self):
        if self.peek("("):
            self.take()
            value = self.level()
            self.take(")")
            return value
        if self.peek("-"):
            self.take()
            return Op("-", (Const(0), self.atom()))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Const(float(text) if "." in text else int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            words = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if text in words:
                return Const(words[text])
            if text.startswith("_"):
                raise TemplateError(f"no access to {text}")
            return Name(text)
        raise TemplateError(f"unexpected {text}")


def expression(source: str):
    parser = _Expression(source)
    value = parser.level()
    if parser.at != len(parser.tokens):
        raise TemplateError(f"can't read {parser.tokens[parser.at][1]!r} in {source!r}")
    return value


_LITERAL = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
_PARTS = re.compile(rf"(\{{\{{(?:{_LITERAL}|(?!\}}\}}).)*+\}}\}}|\{{%(?:{_LITERAL}|(?!%\}}).)*+%\}}|\{{#.*?#\}})", re.S)


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts = _PARTS.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    stack: list[tuple[str, object, list]] = [("", None, [])]
    for i, part in enumerate(parts):
        body = stack[-1][2]
        if i % 2 == 0:
            body += [Text(part)] if part else []
            continue
        inner = part[2:-2].strip("-").strip()
        if part.startswith("{#"):
            continue
        if part.startswith("{{"):
            body.append(Out(expression(inner)))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                raise TemplateError(f"can't read {part}")
            stack.append(("for", (m[1], expression(m[2])), []))
        elif word == "if":
            stack.append(("if", [[], expression(rest)], []))
        elif word in ("elif", "else"):
            kind, held, done = stack.pop()
            if kind != "if" or held[1] is None:
                raise TemplateError(f"{word} without if")
            stack.append(("if", [[*held[0], (held[1], tuple(done))], expression(rest) if word == "elif" else None], []))
        elif word == "set":
            if not (m := re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest.strip(), re.S)):
                raise TemplateError(f"can't read {part}")
            body.append(Assign(m[1], expression(m[2])))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, held, done = stack.pop()
            if word != "end" + kind:
                raise TemplateError(f"{word} closes {kind or 'nothing'}")
            node = For(*held, tuple(done)) if kind == "for" else Generation(tuple(done)) if kind == "generation" else If((*held[0], (Const(True) if held[1] is None else held[1], tuple(done))))
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"no statement {word}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: _bounded(a + b), "-": lambda a, b: _bounded(a - b), "*": lambda a, b: _times(a, b),
    "%": lambda a, b: _modulo(a, b), "~": lambda a, b: _shown(a) + _shown(b)}


MOST_CHARS, MOST_BITS = 1 << 20, 1 << 12


def _bounded(x):
    """A value made by an operator; texts and lists it repeats and numbers it multiplies are bounded before."""
    if isinstance(x, int) and x.bit_length() > MOST_BITS:
        raise TemplateError("a number is too large")
    return x


def _times(a, b):
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, list, tuple)) and isinstance(n, int) and len(x) * n > MOST_CHARS:
            raise TemplateError(f"a product of more than {MOST_CHARS} characters")
    return _bounded(a * b)


def _modulo(a, b):
    if isinstance(a, str):
        raise TemplateError("% is for numbers")
    return a % b


def _checked(op: str, f: Callable, *args):
    """f of the arguments; what Python says against their kinds is an error of the template."""
    try:
        return f(*args)
    except (TypeError, ValueError, ZeroDivisionError, OverflowError) as error:
        raise TemplateError(f"{op}: {error}") from None


def _shown(x) -> str:
    return "" if x is None else str(x)


def fold(node):
    """The tree with constant parts evaluated, dead branches removed and texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_operate(node.op, [lambda c, v=a.value: v for a in args])({}))
        return Op(node.op, args)
    if isinstance(node, Filter):
        args = tuple(map(fold, node.args))
        return Const(_checked(node.name, FILTERS[node.name], *(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Filter(node.name, args)
    if isinstance(node, Key):
        return Key(fold(node.of), fold(node.key))
    if isinstance(node, Out):
        value = fold(node.value)
        return Text(_shown(value.value)) if isinstance(value, Const) else Out(value)
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return () if not arms else arms[0][1] if isinstance(arms[0][0], Const) else If(tuple(arms))
    return node


def _operate(op: str, args: list[Callable]) -> Callable:
    if op == "not":
        return lambda c: not args[0](c)
    if op in ("and", "or"):
        return (lambda c: args[0](c) and args[1](c)) if op == "and" else (lambda c: args[0](c) or args[1](c))
    f = _BINARY[op]
    return lambda c: _checked(op, f, args[0](c), args[1](c))


def _value(node) -> Callable:
    if isinstance(node, Const):
        return lambda c: node.value
    if isinstance(node, Name):
        return lambda c: c.get(node.name)
    if isinstance(node, Key):
        of, key = _value(node.of), _value(node.key)

        def look(c):
            x, k = of(c), key(c)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else None
            return None
        return look
    if isinstance(node, Filter):
        f, args = FILTERS[node.name], [_value(a) for a in node.args]
        return lambda c: f(*(a(c) for a in args))
    return _operate(node.op, [_value(a) for a in node.args])


def _generate(nodes: tuple) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, under the generation marker?)."""
    steps = [_step(n) for n in nodes]

    def body(c: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(c)
    return steps[0] if len(steps) == 1 else body


def _step(node) -> Callable[[dict], Iterable[tuple[str, bool]]]:
    if isinstance(node, Text):
        held = ((node.text, False),)
        return lambda c: held
    if isinstance(node, Out):
        value = _value(node.value)
        return lambda c: ((_shown(value(c)), False),)
    if isinstance(node, Assign):
        value = _value(node.value)
        return lambda c: c.__setitem__(node.name, value(c)) or ()
    if isinstance(node, Generation):
        inner = _generate(node.body)
        return lambda c: (("".join(t for t, _ in inner(c)), True),)
    if isinstance(node, If):
        arms = [(_value(condition), _generate(body)) for condition, body in node.arms]

        def choose(c):
            for condition, body in arms:
                if condition(c):
                    return body(c)
            return ()
        return choose
    over, inner = _value(node.over), _generate(node.body)

    def repeat(c):
        nothing = object()
        items, k = iter(over(c) or ()), 0
        item = next(items, nothing)
        while item is not nothing:
            after = next(items, nothing)
            yield from inner(c | {node.name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is nothing}})
            item, k = after, k + 1
    return repeat


def compile_template(source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from a context to pieces (text, under the generation marker?); messages may be any iterable."""
    return _generate(fold(parse(source)) or (Text(""),))


#: Turns between control strings; each role on its line, each text guarded, assistants' texts under the loss mask.
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}"
    "{{ '<|im_end|>' ~ '\n' }}{% endfor %}")

# ---------------------------------------------------------------- conversations

FORMATTED = "conv_id long, part int, formatted string, loss_start array<int>, loss_end array<int>"


def format_conversations(rows: DataFrame, template: str = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = 4 << 20) -> DataFrame:
    """conv_id, part, formatted, loss_start, loss_end: each conversation's turns in order, as one string.

    A string of more than part_chars goes on in further parts (cut after a piece of the template's output), so a
    conversation of any length needs bounded memory; parts of a conversation stand in order in one partition. The spans
    under the generation marker are code point offsets in their part. Turns are ordered by turn (nulls first), then role
    and text, so repeated turns are all kept. Null roles and texts are empty; rows with a null conversation are one
    conversation with a null id. Further columns are dropped; an empty table gives no rows.
    """
    ordered = (rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), rows[role_col].alias("role"), rows[text_col].alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        source = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        ahead = [next(source, None)]

        def turns(conv):
            while ahead[0] is not None and ahead[0][0] == conv:
                message = ahead[0][1]
                ahead[0] = next(source, None)
                yield message

        out, held = [], 0
        while ahead[0] is not None:
            conv, part, texts, spans, at = ahead[0][0], 0, [], [], 0
            for text, loss in render({"messages": turns(conv)}):
                if at and at + len(text) > part_chars:
                    out.append((conv, part, "".join(texts), [s for s, _ in spans], [e for _, e in spans]))
                    part, texts, spans, held, at = part + 1, [], [], held + at, 0
                if loss:
                    spans.append((at, at + len(text)))
                texts.append(text)
                at += len(text)
                if held > part_chars:
                    yield _batch(out)
                    out, held = [], 0
            for _ in turns(conv):  # what the template left unread
                pass
            out.append((conv, part, "".join(texts), [s for s, _ in spans], [e for _, e in spans]))
            held += at
            if held > part_chars:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, FORMATTED)


_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of each whole turn of CHATML output, unescaped, and the rest."""
    done, at = [], 0
    while (end := text.find("<|im_end|>\n", at)) >= 0:
        if not text.startswith("<|im_start|>", at):
            raise ValueError("not a turn: " + text[at:at + 20])
        role, _, body = text[at + 12:end].partition("\n")
        done.append((unguard_line(role), unguard(body)))
        at = end + 11
    return done, text[at:]

"""A parser for the public Jinja template grammar, with the generation block and loop controls; nothing is ever rendered.

Nodes are plain objects; :meth:`Node.children` gives a node's parts in the grammar's field order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any


class TemplateError(Exception):
    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.message, self.line = message, line


class Node:
    """kind is the grammar's name of the node; parts are its fields in order: values, nodes or lists of nodes."""

    __slots__ = ("kind", "line", "parts")

    def __init__(self, kind: str, line: int, **parts: Any):
        self.kind, self.line, self.parts = kind, line, parts

    def __getattr__(self, name: str):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self) -> Iterator[Node]:
        for part in self.parts.values():
            if isinstance(part, Node):
                yield part
            elif isinstance(part, list):
                yield from (x for x in part if isinstance(x, Node))


def walk(root: Node) -> Iterator[Node]:
    """Every node below, parents first and the last child before the others."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(node.children())


def depth(root: Node) -> int:
    most, waiting = 0, [(root, 1)]
    while waiting:
        node, d = waiting.pop()
        most = max(most, d)
        waiting.extend((c, d + 1) for c in node.children())
    return most


_OPEN = re.compile(r"\{%[-+]?|\{\{[-+]?|\{#[-+]?")
_RAW = re.compile(r"\{%[-+]?\s*raw\s*[-+]?%\}")
_ENDRAW = re.compile(r"\{%([-+]?)\s*endraw\s*([-+]?)%\}")
_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<float>(?<!\.)(?:\d+_)*\d+(?:(?:\.(?:\d+_)*\d+)?e[+\-]?(?:\d+_)*\d+|\.(?:\d+_)*\d+))
    |(?P<integer>0b(?:_?[0-1])+|0o(?:_?[0-7])+|0x(?:_?[\da-f])+|[1-9](?:_?\d)*|0(?:_?0)*)
    |(?P<name>[^\W\d]\w*)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<op>\*\*|//|==|!=|>=|<=|[+\-/*%~\[\](){}><=.:|,;])""",
    re.X | re.S | re.I,
)
_PAIRS = {"}": "{", ")": "(", "]": "["}


class Token:
    __slots__ = ("kind", "value", "line")

    def __init__(self, kind: str, value: Any, line: int):
        self.kind, self.value, self.line = kind, value, line

    def named(self, *names: str) -> bool:
        return self.kind == "name" and self.value in names

    def op(self, *ops: str) -> bool:
        return self.kind == "op" and self.value in ops


def tokens(source: str) -> Iterator[Token]:
    source = re.sub(r"\r\n|\r", "\n", source)
    if source.endswith("\n"):
        source = source[:-1]
    at, line, strip = 0, 1, False

    def data(text: str, trimmed: bool) -> Iterator[Token]:
        nonlocal line, strip
        start = line
        line += text.count("\n")
        if strip:
            kept = text.lstrip()
            start += text[: len(text) - len(kept)].count("\n")
            text = kept
        if trimmed:
            text = text.rstrip()
        strip = False
        if text:
            yield Token("data", text, start)

    while True:
        m = _OPEN.search(source, at)
        if m is None:
            yield from data(source[at:], False)
            break
        trimmed = m[0].endswith("-")
        yield from data(source[at : m.start()], trimmed)
        raw = _RAW.match(source, m.start())
        if raw:
            end = _ENDRAW.search(source, raw.end())
            if end is None:
                raise TemplateError("raw block has no end", line)
            line += raw[0].count("\n")
            strip = raw[0].endswith("-%}")
            yield from data(source[raw.end() : end.start()], end[1] == "-")
            line += end[0].count("\n")
            at, strip = end.end(), end[2] == "-"
            continue
        if m[0].startswith("{#"):
            end = source.find("#}", m.end())
            if end < 0:
                raise TemplateError("comment has no end", line)
            line += source.count("\n", m.start(), end)
            at, strip = end + 2, source[end - 1] in "-" and end > m.end()
            continue
        block = m[0].startswith("{%")
        yield Token("begin_block" if block else "begin_print", m[0], line)
        at, held = m.end(), []
        close = "%}" if block else "}}"
        while True:
            if not held:
                for sign in ("-", "+", ""):
                    if source.startswith(sign + close, at):
                        break
                else:
                    sign = None
                if sign is not None:
                    yield Token("end_block" if block else "end_print", close, line)
                    at, strip = at + len(sign) + 2, sign == "-"
                    break
            t = _TOKEN.match(source, at)
            if t is None:
                raise TemplateError("unexpected end of template" if at >= len(source) else f"unexpected character {source[at]!r}", line)
            kind, value = t.lastgroup, t[0]
            if kind == "op":
                if value in "([{":
                    held.append(value)
                elif value in ")]}":
                    if not held or held.pop() != _PAIRS[value]:
                        raise TemplateError(f"unexpected {value!r}", line)
                yield Token("op", value, line)
            elif kind == "string":
                text = value[1:-1]
                try:
                    text = text.encode("ascii", "backslashreplace").decode("unicode-escape")
                except UnicodeDecodeError as e:
                    raise TemplateError(str(e), line) from None
                yield Token("string", text, line)
            elif kind == "integer":
                yield Token("integer", int(value.replace("_", ""), 0), line)
            elif kind == "float":
                yield Token("float", float(value.replace("_", "")), line)
            elif kind == "name":
                yield Token("name", value, line)
            line += value.count("\n")
            at = t.end()
    yield Token("eof", "", line)


_COMPARE = {"==": "eq", "!=": "ne", "<": "lt", "<=": "lteq", ">": "gt", ">=": "gteq"}
_SUMS, _PRODUCTS = {"+": "Add", "-": "Sub"}, {"*": "Mul", "/": "Div", "//": "FloorDiv", "%": "Mod"}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


class Parser:
    def __init__(self, source: str):
        self.stream = list(tokens(source))
        self.at = 0

    @property
    def now(self) -> Token:
        return self.stream[self.at]

    def look(self, n: int = 1) -> Token:
        return self.stream[min(self.at + n, len(self.stream) - 1)]

    def step(self) -> Token:
        t = self.now
        self.at = min(self.at + 1, len(self.stream) - 1)
        return t

    def fail(self, message: str, line: int | None = None):
        raise TemplateError(message, self.now.line if line is None else line)

    def skip_op(self, *ops: str) -> bool:
        return self.now.op(*ops) and bool(self.step())

    def skip_name(self, *names: str) -> bool:
        return self.now.named(*names) and bool(self.step())

    def need(self, kind: str, value: str | None = None) -> Token:
        if self.now.kind != kind or value is not None and self.now.value != value:
            self.fail(f"expected {value or kind}, got {self.now.value!r}")
        return self.step()

    # --- statements ---

    def template(self) -> Node:
        body = self.body(())
        if self.now.kind != "eof":
            self.fail("unexpected end tag")
        return Node("Template", 1, body=body)

    def body(self, ends: tuple[str, ...]) -> list[Node]:
        """Statements up to a block tag named in ``ends``, whose name is then the current token."""
        out: list[Node] = []
        held: list[Node] = []

        def flush():
            if held:
                out.append(Node("Output", held[0].line, nodes=held.copy()))
                held.clear()

        while self.now.kind != "eof":
            t = self.step()
            if t.kind == "data":
                held.append(Node("TemplateData", t.line, data=t.value))
            elif t.kind == "begin_print":
                held.append(self.tuple(with_if=True))
                self.need("end_print")
            else:
                flush()
                if self.now.named(*ends):
                    return out
                out.append(self.statement())
                self.need("end_block")
        flush()
        if ends:
            self.fail(f"unexpected end of template, expected {' or '.join(ends)}")
        return out

    def inner(self, *ends: str) -> list[Node]:
        """The body of a tag after its head; the end tag's name is the current token."""
        self.skip_op(":")
        self.need("end_block")
        return self.body(ends)

    def block(self, end: str) -> list[Node]:
        body = self.inner(end)
        self.step()
        return body

    def statement(self) -> Node:
        t = self.now
        if t.kind != "name":
            self.fail("tag name expected")
        method = getattr(self, f"tag_{t.value}", None)
        if method is None:
            self.fail(f"unknown tag {t.value!r}")
        return method(self.step().line)

    def tag_if(self, line: int) -> Node:
        result = Node("If", line, test=self.tuple(with_if=False), body=self.inner("elif", "else", "endif"), elif_=[], else_=[])
        while True:
            t = self.step()
            if t.value == "elif":
                result.elif_.append(Node("If", t.line, test=self.tuple(with_if=False), body=self.inner("elif", "else", "endif"), elif_=[], else_=[]))
            elif t.value == "else":
                result.parts["else_"] = self.inner("endif")
            else:
                return result

    def tag_for(self, line: int) -> Node:
        target = self.target(ends=("in",))
        if not self.skip_name("in"):
            self.fail("expected 'in'")
        over = self.tuple(with_if=False, ends=("recursive",))
        test = self.expression() if self.skip_name("if") else None
        recursive = self.skip_name("recursive")
        body = self.inner("endfor", "else")
        other = self.inner("endfor") if self.step().value == "else" else []
        if other or self.now.named("endfor"):
            self.skip_name("endfor")
        return Node("For", line, target=target, iter=over, body=body, else_=other, test=test, recursive=recursive)

    def tag_set(self, line: int) -> Node:
        target = self.target(namespaced=True)
        if self.skip_op("="):
            return Node("Assign", line, target=target, node=self.tuple(with_if=True))
        applied = self.filters(None) if self.now.op("|") else None
        return Node("AssignBlock", line, target=target, filter=applied, body=self.block("endset"))

    def signature(self) -> tuple[list[Node], list[Node]]:
        args: list[Node] = []
        defaults: list[Node] = []
        self.need("op", "(")
        while not self.now.op(")"):
            if args:
                self.need("op", ",")
            t = self.need("name")
            args.append(Node("Name", t.line, name=t.value))
            if self.skip_op("="):
                defaults.append(self.expression())
            elif defaults:
                self.fail("an argument without a default follows one with it")
        self.step()
        return args, defaults

    def tag_macro(self, line: int) -> Node:
        name = self.need("name").value
        args, defaults = self.signature()
        return Node("Macro", line, name=name, args=args, defaults=defaults, body=self.block("endmacro"))

    def tag_call(self, line: int) -> Node:
        args, defaults = self.signature() if self.now.op("(") else ([], [])
        call = self.expression()
        if call.kind != "Call":
            self.fail("expected a call", line)
        return Node("CallBlock", line, call=call, args=args, defaults=defaults, body=self.block("endcall"))

    def tag_filter(self, line: int) -> Node:
        applied = self.filters(None, inline=True)
        return Node("FilterBlock", line, body=self.block("endfilter"), filter=applied)

    def tag_with(self, line: int) -> Node:
        targets: list[Node] = []
        values: list[Node] = []
        while self.now.kind != "end_block":
            if targets:
                self.need("op", ",")
            targets.append(self.target())
            self.need("op", "=")
            values.append(self.expression())
        return Node("With", line, targets=targets, values=values, body=self.block("endwith"))

    def tag_block(self, line: int) -> Node:
        name = self.need("name").value
        scoped, required = self.skip_name("scoped"), self.skip_name("required")
        body = self.block("endblock")
        self.skip_name(name)
        return Node("Block", line, name=name, body=body, scoped=scoped, required=required)

    def tag_generation(self, line: int) -> Node:
        return Node("Scope", line, body=self.block("endgeneration"))

    def tag_autoescape(self, line: int) -> Node:
        value = self.expression()
        options = Node("Keyword", line, key="autoescape", value=value)
        return Node("Scope", line, body=[Node("ScopedEvalContextModifier", line, options=[options], body=self.block("endautoescape"))])

    def tag_break(self, line: int) -> Node:
        return Node("Break", line)

    def tag_continue(self, line: int) -> Node:
        return Node("Continue", line)

    def tag_print(self, line: int) -> Node:
        out: list[Node] = []
        while self.now.kind != "end_block":
            if out:
                self.need("op", ",")
            out.append(self.expression())
        return Node("Output", line, nodes=out)

    def tag_extends(self, line: int) -> Node:
        return Node("Extends", line, template=self.expression())

    def context(self, default: bool) -> bool:
        if self.now.named("with", "without") and self.look().named("context"):
            default = self.step().value == "with"
            self.step()
        return default

    def tag_include(self, line: int) -> Node:
        template = self.expression()
        missing = self.now.named("ignore") and self.look().named("missing")
        if missing:
            self.step(), self.step()
        return Node("Include", line, template=template, with_context=self.context(True), ignore_missing=missing)

    def tag_import(self, line: int) -> Node:
        template = self.expression()
        if not self.skip_name("as"):
            self.fail("expected 'as'")
        target = self.need("name").value
        return Node("Import", line, template=template, target=target, with_context=self.context(False))

    def tag_from(self, line: int) -> Node:
        template = self.expression()
        if not self.skip_name("import"):
            self.fail("expected 'import'")
        names: list = []
        while self.now.kind == "name" and not (self.now.named("with", "without") and self.look().named("context")):
            name = self.step().value
            names.append((name, self.need("name").value) if self.skip_name("as") else name)
            if not self.skip_op(","):
                break
        if not names:
            self.fail("expected a name")
        return Node("FromImport", line, template=template, names=names, with_context=self.context(False))

    # --- targets and tuples ---

    def target(self, ends: tuple[str, ...] = (), namespaced: bool = False) -> Node:
        if namespaced and self.now.kind == "name" and self.look().op("."):
            t = self.step()
            self.step()
            return Node("NSRef", t.line, name=t.value, attr=self.need("name").value)
        out = self.tuple(with_if=False, ends=ends, simple=True)
        items = out.items if out.kind == "Tuple" else [out]
        if not all(x.kind in ("Name", "NSRef", "Tuple", "List") for x in items) or not items:
            self.fail("can't assign to this", out.line)
        return out

    def tuple(self, with_if: bool = True, ends: tuple[str, ...] = (), simple: bool = False, parens: bool = False) -> Node:
        line = self.now.line
        parse = self.primary if simple else (lambda: self.expression(with_if))
        items: list[Node] = []
        many = False
        while True:
            if items:
                if not self.skip_op(","):
                    break
                many = True
            if self.now.kind in ("end_print", "end_block", "eof") or self.now.op(")") or self.now.named(*ends):
                break
            items.append(parse())
        if not many and items:
            return items[0]
        if not items and not parens:
            self.fail("expected an expression")
        return Node("Tuple", line, items=items)

    # --- expressions, loosest first ---

    def expression(self, with_if: bool = True) -> Node:
        if not with_if:
            return self.either()
        line = self.now.line
        out = self.either()
        while self.skip_name("if"):
            test = self.either()
            other = self.expression() if self.skip_name("else") else None
            out = Node("CondExpr", line, test=test, expr1=out, expr2=other)
            line = self.now.line
        return out

    def _left(self, names: dict, below, is_name: bool = False) -> Node:
        line = self.now.line
        out = below()
        while (self.now.kind == "name" if is_name else self.now.kind == "op") and self.now.value in names:
            kind = names[self.step().value]
            out = Node(kind, line, left=out, right=below())
            line = self.now.line
        return out

    def either(self) -> Node:
        return self._left({"or": "Or"}, self.both, True)

    def both(self) -> Node:
        return self._left({"and": "And"}, self.negation, True)

    def negation(self) -> Node:
        if self.now.named("not"):
            line = self.step().line
            return Node("Not", line, node=self.negation())
        return self.comparison()

    def comparison(self) -> Node:
        line = self.now.line
        out = self.sums()
        ops: list[Node] = []
        while True:
            t = self.now
            if t.kind == "op" and t.value in _COMPARE:
                self.step()
                ops.append(Node("Operand", t.line, op=_COMPARE[t.value], expr=self.sums()))
            elif self.skip_name("in"):
                ops.append(Node("Operand", t.line, op="in", expr=self.sums()))
            elif t.named("not") and self.look().named("in"):
                self.step(), self.step()
                ops.append(Node("Operand", t.line, op="notin", expr=self.sums()))
            else:
                return Node("Compare", line, expr=out, ops=ops) if ops else out

    def sums(self) -> Node:
        return self._left(_SUMS, self.concatenation)

    def concatenation(self) -> Node:
        line = self.now.line
        out = [self.products()]
        while self.skip_op("~"):
            out.append(self.products())
        return out[0] if len(out) == 1 else Node("Concat", line, nodes=out)

    def products(self) -> Node:
        return self._left(_PRODUCTS, self.power)

    def power(self) -> Node:
        return self._left({"**": "Pow"}, self.unary)

    def unary(self, filtered: bool = True) -> Node:
        t = self.now
        if t.op("-", "+"):
            self.step()
            out = Node("Neg" if t.value == "-" else "Pos", t.line, node=self.unary(False))
        else:
            out = self.postfix(self.primary())
        return self.applied(out) if filtered else out

    def primary(self) -> Node:
        t = self.now
        if t.kind == "name":
            self.step()
            return Node("Const", t.line, value=_CONSTANTS[t.value]) if t.value in _CONSTANTS else Node("Name", t.line, name=t.value)
        if t.kind == "string":
            text = self.step().value
            while self.now.kind == "string":
                text += self.step().value
            return Node("Const", t.line, value=text)
        if t.kind in ("integer", "float"):
            return Node("Const", t.line, value=self.step().value)
        if self.skip_op("("):
            out = self.tuple(parens=True)
            self.need("op", ")")
            return out
        if self.skip_op("["):
            items: list[Node] = []
            while not self.now.op("]"):
                if items:
                    self.need("op", ",")
                    if self.now.op("]"):
                        break
                items.append(self.expression())
            self.step()
            return Node("List", t.line, items=items)
        if self.skip_op("{"):
            pairs: list[Node] = []
            while not self.now.op("}"):
                if pairs:
                    self.need("op", ",")
                    if self.now.op("}"):
                        break
                key = self.expression()
                self.need("op", ":")
                pairs.append(Node("Pair", key.line, key=key, value=self.expression()))
            self.step()
            return Node("Dict", t.line, items=pairs)
        self.fail(f"unexpected {t.value!r}")

    def postfix(self, out: Node) -> Node:
        while True:
            if self.now.op(".", "["):
                out = self.subscript(out)
            elif self.now.op("("):
                out = self.call(out)
            else:
                return out

    def applied(self, out: Node) -> Node:
        while True:
            if self.now.op("|"):
                out = self.filters(out)
            elif self.now.named("is"):
                out = self.test(out)
            elif self.now.op("("):
                out = self.call(out)
            else:
                return out

    def subscript(self, of: Node) -> Node:
        t = self.step()
        if t.value == ".":
            a = self.step()
            if a.kind == "name":
                return Node("Getattr", t.line, node=of, attr=a.value)
            if a.kind != "integer":
                self.fail("expected a name or number", a.line)
            return Node("Getitem", t.line, node=of, arg=Node("Const", a.line, value=a.value))
        args: list[Node] = []
        while not self.now.op("]"):
            if args:
                self.need("op", ",")
            args.append(self.subscribed())
        self.step()
        if not args:
            self.fail("expected a subscript", t.line)
        return Node("Getitem", t.line, node=of, arg=args[0] if len(args) == 1 else Node("Tuple", t.line, items=args))

    def subscribed(self) -> Node:
        line = self.now.line
        bounds: list[Node | None] = []
        if not self.now.op(":"):
            first = self.expression()
            if not self.now.op(":"):
                return first
            bounds.append(first)
        else:
            bounds.append(None)
        while self.skip_op(":") and len(bounds) < 3:
            bounds.append(None if self.now.op(":", "]", ",") else self.expression())
        bounds += [None] * (3 - len(bounds))
        return Node("Slice", line, start=bounds[0], stop=bounds[1], step=bounds[2])

    def arguments(self) -> dict[str, Any]:
        self.need("op", "(")
        args: list[Node] = []
        kwargs: list[Node] = []
        star = stars = None
        first = True
        while not self.now.op(")"):
            if not first:
                self.need("op", ",")
                if self.now.op(")"):
                    break
            first = False
            if self.skip_op("*"):
                star = self.expression()
            elif self.skip_op("**"):
                stars = self.expression()
            elif self.now.kind == "name" and self.look().op("="):
                t = self.step()
                self.step()
                kwargs.append(Node("Keyword", t.line, key=t.value, value=self.expression()))
            else:
                if kwargs or stars:
                    self.fail("a positional argument follows a named one")
                args.append(self.expression())
        self.step()
        return {"args": args, "kwargs": kwargs, "dyn_args": star, "dyn_kwargs": stars}

    def call(self, of: Node) -> Node:
        line = self.now.line
        return Node("Call", line, node=of, **self.arguments())

    def dotted(self) -> str:
        name = self.need("name").value
        while self.skip_op("."):
            name += "." + self.need("name").value
        return name

    def filters(self, of: Node | None, inline: bool = False) -> Node:
        while self.now.op("|") or inline:
            if not inline:
                self.step()
            line = self.now.line
            name = self.dotted()
            parts = self.arguments() if self.now.op("(") else {"args": [], "kwargs": [], "dyn_args": None, "dyn_kwargs": None}
            of = Node("Filter", line, node=of, name=name, **parts)
            inline = False
        return of

    def test(self, of: Node) -> Node:
        line = self.step().line
        negated = self.skip_name("not")
        name = self.dotted()
        parts: dict[str, Any] = {"args": [], "kwargs": [], "dyn_args": None, "dyn_kwargs": None}
        if self.now.op("("):
            parts = self.arguments()
        elif (self.now.kind in ("name", "string", "integer", "float") or self.now.op("[", "{")) and not self.now.named("else", "or", "and", "if"):
            if self.now.named("is"):
                self.fail("tests can't be chained with 'is'")
            parts["args"] = [self.postfix(self.primary())]
        out = Node("Test", line, node=of, name=name, **parts)
        return Node("Not", line, node=out) if negated else out


def parse(source: str) -> Node:
    """The template's tree; raises :class:`TemplateError`, or RecursionError where it nests too deep."""
    return Parser(source).template()

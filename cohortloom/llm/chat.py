"""Chat formatting: a template compiler for a small sandboxed template language, and its use on conversation tables.

`compile_template` parses a template to a syntax tree, folds constant parts and generates Python closures.  The language
has text, {{ expression }}, {# comment #}, {% for x in y %}, {% if %}/{% elif %}/{% else %}, {% set x = e %} and
{% generation %} ... {% endgeneration %}; a dash inside a tag's brackets strips the white space on that side.  Expressions
have literals, names, x.key, x[e], + ~ == != < > <= >= in, and/or/not and filters.  There are no calls, no attributes of
Python objects and no names beyond those given to render, so a template can't reach anything but its data.  Rendering
returns the text and the spans, in code points, that generation blocks produced: the loss mask.

The default template writes <s>role[INST]text[/INST]</s> for each turn, assistant texts under a generation block.  The
`escape` filter doubles a backslash and puts one behind each < and [, so no control string survives in a text and
`unescape` gives the text back.

Distribution: one shuffle by conv_id, rows sorted inside partitions and streamed; memory holds one conversation at a time.

Odd rows: a null role or text is empty; a null conv_id is one conversation; turns sort nulls first, ties by role, then text;
repeated rows are turns of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import lean, ship

TEMPLATE = "{% for m in messages %}<s>{{ m.role | escape }}[INST]{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}[/INST]</s>{% endfor %}"


class TemplateError(ValueError):
    """The template isn't in the language, or reaches for something it may not."""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


_ESCAPED = re.compile(r"([<\[\\])\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}
BINARY: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b, "+": operator.add, "~": lambda a, b: f"{a}{b}"}
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#)(.*?)(-?\}\}|-?%\}|#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()]))")
_ENDS = {"{{": "}}", "{%": "%}", "{#": "#}"}
_STRING = {"n": "\n", "t": "\t"}


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while code[at:].strip():
        if not (m := _TOKEN.match(code, at)):
            raise TemplateError(f"cannot read {code[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent; nodes are tuples whose first item names the kind."""

    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0

    def peek(self, *values: str) -> bool:
        return self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        kind, value = self.tokens[self.at]
        if values and value not in values:
            raise TemplateError(f"{value or 'the end'!r} where {' or '.join(values)} was due")
        self.at += 1
        return value

    def whole(self) -> tuple:
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.peek("or"):
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        out = self.joined()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            out = ("binary", self.take(), out, self.joined())
        return out

    def joined(self) -> tuple:
        out = self.filtered()
        while self.peek("+", "~"):
            out = ("binary", self.take(), out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while self.peek("|", ".", "["):
            mark = self.take()
            if mark == "|":
                if (name := self.take()) not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                out = ("filter", name, out)
            elif mark == ".":
                out = ("item", out, ("constant", self.take()))
            else:
                out = ("item", out, self.either())
                self.take("]")
        return out

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("constant", re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("constant", float(value) if "." in value else int(value))
        if kind == "name" and value in ("true", "false", "none"):
            return ("constant", {"true": True, "false": False, "none": None}[value])
        if kind == "name":
            return ("name", value)
        if value == "(":
            out = self.either()
            self.take(")")
            return out
        raise TemplateError(f"{value or 'the end'!r} where a value was due")


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: a list of statement nodes."""
    pieces, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        if _ENDS[m[1][:2]] != m[3][-2:]:
            raise TemplateError(f"{m[1]} closed by {m[3]}")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces += [("text", text.rstrip() if m[1].endswith("-") else text), (m[1][:2], m[2].strip())]
        at, strip = m.end(), m[3].startswith("-")
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(mark in x for kind, x in pieces if kind == "text" for mark in ("{{", "{%", "{#")):
        raise TemplateError("a tag isn't closed")
    stream = iter(pieces)

    def block(*ends: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        for kind, code in stream:
            if kind == "text":
                out += [("output", ("constant", code))] if code else []
            elif kind == "{{":
                out.append(("output", _Expression(code).whole()))
            elif kind == "{%":
                word, _, rest = code.partition(" ")
                if word in ends:
                    return out, code
                if word == "for":
                    if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                        raise TemplateError(f"cannot read {code!r}")
                    out.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    branches, test, other = [], rest, []
                    while True:
                        body, end = block("elif", "else", "endif")
                        branches.append((_Expression(test).whole(), body))
                        if end.startswith("elif"):
                            test = end[4:]
                            continue
                        if end == "else":
                            other = block("endif")[0]
                        break
                    out.append(("if", branches, other))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                        raise TemplateError(f"cannot read {code!r}")
                    out.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    out.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"no statement {word!r} here")
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, ""

    return block()[0]


def _fold(e: tuple) -> tuple:
    parts = tuple(_fold(x) if isinstance(x, tuple) else x for x in e)
    if e[0] in ("binary", "filter", "not", "and", "or", "item") and all(x[0] == "constant" for x in parts if isinstance(x, tuple)):
        return ("constant", _evaluate(parts)({}))
    return parts


def fold(tree: list[tuple]) -> list[tuple]:
    """Evaluate constant expressions, choose constant branches and join neighbouring constant outputs."""
    out: list[tuple] = []
    for node in tree:
        kind = node[0]
        if kind == "output":
            e = _fold(node[1])
            if e[0] == "constant":
                e = ("constant", _shown(e[1]))
                if out and out[-1][0] == "output" and out[-1][1][0] == "constant":
                    out[-1] = ("output", ("constant", out[-1][1][1] + e[1]))
                    continue
            out.append(("output", e))
        elif kind == "for":
            out.append(("for", node[1], _fold(node[2]), fold(node[3])))
        elif kind == "if":
            branches, other = [], fold(node[2])
            for test, body in node[1]:
                test = _fold(test)
                if test[0] == "constant" and test[1]:
                    other = fold(body)
                    break
                if test[0] != "constant":
                    branches.append((test, fold(body)))
            out += [("if", branches, other)] if branches else other
        elif kind == "set":
            out.append(("set", node[1], _fold(node[2])))
        else:
            out.append(("generation", fold(node[1])))
    return out


def _shown(x) -> str:
    return "" if x is None else str(x)


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple, str)) and type(key) is int:
        return x[key] if -len(x) <= key < len(x) else None
    return None


def _evaluate(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "constant":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "item":
        x, key = _evaluate(e[1]), _evaluate(e[2])
        if e[2][0] == "constant":
            return lambda scope, x=x, k=e[2][1]: _item(x(scope), k)
        return lambda scope: _item(x(scope), key(scope))
    if kind == "filter":
        f, x = FILTERS[e[1]], _evaluate(e[2])
        return lambda scope: f(x(scope))
    if kind == "not":
        x = _evaluate(e[1])
        return lambda scope: not x(scope)
    if kind == "binary":
        f, a, b = BINARY[e[1]], _evaluate(e[2]), _evaluate(e[3])
        return lambda scope: f(a(scope), b(scope))
    a, b = _evaluate(e[1]), _evaluate(e[2])
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else lambda scope: a(scope) or b(scope)


class _Out:
    __slots__ = ("parts", "at", "spans")

    def __init__(self):
        self.parts, self.at, self.spans = [], 0, []


def _generate(tree: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_step(node) for node in tree]

    def run(scope, out):
        for f in steps:
            f(scope, out)

    return steps[0] if len(steps) == 1 else run


def _step(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "output":
        value = _evaluate(node[1])
        if node[1][0] == "constant":
            text, n = node[1][1], len(node[1][1])

            def put_text(scope, out):
                out.parts.append(text)
                out.at += n

            return put_text

        def put(scope, out):
            out.parts.append(x := _shown(value(scope)))
            out.at += len(x)

        return put
    if kind == "set":
        value = _evaluate(node[2])
        return lambda scope, out, n=node[1]: scope.__setitem__(n, value(scope))
    if kind == "generation":
        body = _generate(node[1])

        def mark(scope, out):
            start = out.at
            body(scope, out)
            out.spans.append((start, out.at))

        return mark
    if kind == "if":
        branches, other = [(_evaluate(t), _generate(b)) for t, b in node[1]], _generate(node[2])

        def choose(scope, out):
            for test, body in branches:
                if test(scope):
                    return body(scope, out)
            return other(scope, out)

        return choose
    name, items, body = node[1], _evaluate(node[2]), _generate(node[3])

    def loop(scope, out):
        inner = dict(scope)
        rows = items(scope) or ()
        for i, x in enumerate(rows):
            inner[name] = x
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i + 1 == len(rows), "length": len(rows)}
            body(inner, out)

    return loop


def compile_template(source: str = TEMPLATE) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that gives the rendered text and its generation spans."""
    run = _generate(fold(parse(source)))

    def render(**scope):
        out = _Out()
        run(scope, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that the default template made."""
    turns = []
    for part in formatted.split("</s>")[:-1]:
        role, mark, text = part.removeprefix("<s>").partition("[INST]")
        if not part.startswith("<s>") or not mark or not text.endswith("[/INST]"):
            raise TemplateError(f"not a formatted turn: {part[:80]!r}")
        turns.append((unescape(role), unescape(text.removesuffix("[/INST]"))))
    return turns


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, formatted, loss_spans array<struct<start, end>>; one row a conversation."""
    ship(conversations.sparkSession)
    compile_template(template)  # a bad template fails here, not in a task
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        render, key, turns, ids, texts, spans = compile_template(template), None, [], [], [], []

        def flush():
            text, found = render(messages=turns)
            ids.append(key)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in found])

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_spans"])
            for x in (ids, texts, spans):
                x.clear()
            return out

        size = 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv != key:
                    flush()
                    turns = []
                    if len(ids) >= 1000 or size > 1 << 24:
                        yield full()
                        size = 0
                key = conv
                turns.append({"role": role, "text": text})
                size += len(text)
        if turns:
            flush()
        if ids:
            yield full()

    return rows.mapInArrow(lean(run), "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted texts, as counts and digests."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return formatted.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op7_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return digest_conversations(format_conversations(rows.unionByName(probe)))


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') AS r,
         replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS t FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>' || r || '[INST]' || t || '[/INST]</s>'))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

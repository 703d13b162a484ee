"""Texts that differ in their literals alone are analysed once: a text's shape has a mark of the same kind for each literal, and what is found for the shape holds the marks where the text's literals go.

The front-end never looks into a literal, apart from what stays in the shape as it is: whole numbers with a leading zero (some are errors),
E-strings, and whatever stands behind a dot, which may be taken apart as a name. Where a literal comes out changed or in a name, or a string is part of the masked text (as in
TIMESTAMP '...'), the shape gives no template, and its texts are analysed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Words, comments and quoted texts as in `lexer`, in its order; all else is passed over sign by sign. `#-` would else begin a comment with a further dash.
_LITERAL = re.compile(
    r"""--[^\n]*|/\*.*?\*/|\#-|[eE]'[^'\\]*(?:(?:''|\\.)[^'\\]*)*'
      |(?P<string>'[^']*(?:''[^']*)*')
      |"[^"]*(?:""[^"]*)*"|[^\W\d]\w*
      |(?P<float>\d+\.\d*|\.\d+)|(?P<int>\d+)|\$\d+|\.\s*(?!\d)""",
    re.X | re.S,
)
_CORE = "739184620"
_FORM = {"int": f" {_CORE}5{{:04}} ", "float": f" {_CORE}6{{:04}}. ", "string": f" 'q{_CORE}7{{:04}}q' "}  # apart from their neighbours, as tokens are
_MARK = re.compile(rf"{_CORE}5(\d{{4}})|{_CORE}6(\d{{4}})\.|'q{_CORE}7(\d{{4}})q'")
#: Texts with more literals or characters are analysed as they are; templates that are kept, and their characters.
MOST_LITERALS, LONGEST, KEPT, KEPT_CHARACTERS = 500, 1 << 15, 10_000, 1 << 25


def shape(sql: str) -> tuple[str, list[str]] | None:
    """The text with marks, and the literals they stand for; None for a text that is to be analysed as it is."""
    if len(sql) > LONGEST or _CORE in sql:
        return None
    parts, values, at, dotted = [], [], 0, -1
    for m in _LITERAL.finditer(sql):
        kind = m.lastgroup
        if kind is None:
            word = m.group()
            if word[0] == "." or dotted == m.start() and word[:2] in ("--", "/*"):
                dotted = m.end()  # white space and comments behind a dot
            continue
        text = m.group()
        if sql[dotted : m.start()].strip() == "" and dotted >= 0 or kind == "int" and len(text) > 1 and text[0] == "0":
            continue
        parts += sql[at : m.start()], _FORM[kind].format(len(values))
        values.append(text)
        at = m.end()
        if len(values) > MOST_LITERALS:
            return None
    parts.append(sql[at:])
    return "".join(parts), values


def _strings(found):
    if isinstance(found, str):
        yield found
    elif isinstance(found, dict):
        for x in found.values():
            yield from _strings(x)
    elif isinstance(found, list):
        for x in found:
            yield from _strings(x)


def _filled(found) -> Callable[[list[str]], object]:
    """A function of a text's literals that gives `found` with them; what has no mark is shared, not copied."""
    if isinstance(found, str) and _MARK.search(found):
        pieces = _MARK.split(found)  # text and the three groups, in turn
        numbers = [next(int(n) for n in pieces[k : k + 3] if n is not None) for k in range(1, len(pieces), 4)]
        texts = pieces[::4]
        return lambda values: texts[0] + "".join([values[n] + t for n, t in zip(numbers, texts[1:])])
    if isinstance(found, (dict, list)):
        keys = list(found) if isinstance(found, dict) else range(len(found))
        makers = [(k, f) for k in keys if (f := _filled(found[k]))]
        if makers:

            def make(values):
                out = found.copy()
                for k, f in makers:
                    out[k] = f(values)
                return out

            return make
    return None


def template(found: dict) -> Callable[[list[str]], dict] | None:
    """What was found for a shape, as a function of literals; None if these did not all come out as they went in, or as (part of) a name, which is taken apart and compared."""
    if any(len(_MARK.findall(text)) != text.count(_CORE) for text in _strings(found)):
        return None
    for s in found["statements"]:
        named = [s["command"], *(s[k] for k in ("columns", "tables", "joins", "functions")), *({k: v for k, v in c.items() if k not in ("expression", "where_clause")} for c in s["creates"])]
        if f"'q{_CORE}" in s["masked"] or any(_CORE in text for text in _strings(named)):
            return None
    return _filled(found) or (lambda values: found)


class Templates:
    """`analyse` of texts, once for each shape as long as it is kept."""

    def __init__(self, analyse: Callable[[str | None], dict]):
        self.analyse, self.kept, self.characters = analyse, {}, 0

    def __call__(self, sql: str | None) -> dict:
        found = shape(sql) if sql else None
        if found is None:
            return self.analyse(sql)
        text, values = found
        if text not in self.kept:
            if len(self.kept) >= KEPT or self.characters > KEPT_CHARACTERS:
                self.kept.clear()
                self.characters = 0
            self.kept[text] = template(self.analyse(text))
            self.characters += len(text)
        make = self.kept[text]
        return make(values) if make else self.analyse(sql)

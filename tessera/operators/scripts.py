"""Declarations of JavaScript and TypeScript files, found by a lexer: functions and classes at the top level, and imports.

The lexer knows strings, templates with nested substitutions, comments, and regex literals by what stands before them; brackets
are kept on a stack.  A declaration counts where a statement begins, ``export`` and ``default`` before it are left out, and its text ends
with the bracket that closes its body; signatures without a body and anonymous ones don't count.  Offsets are those of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

LEXEMES = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<word>(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<number>\d(?:\w|\.)*)
    |(?P<sign>=>|[^\s])""",
    re.S | re.X,
)
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which an expression follows, so that a slash begins a regex literal there.
BEFORE_EXPRESSION = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
#: What a type can follow, so that a bracket after it is no body.
BEFORE_TYPE = frozenset([":", "|", "&", "=>", "<", ",", "?", "=", "extends", "implements", "keyof", "typeof", "is", "infer", "asserts"])
PAIRS = {")": "(", "]": "[", "}": "{"}


def lexemes(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of what isn't blank; a template is a string, of which substitutions are left out."""
    at, before, stack = 0, ("", ""), []  # stack: opening braces, and marks of substitutions
    while at < len(text):
        if text[at] == "`" or (text[at] == "}" and stack and stack[-1] == "$"):
            if text[at] == "}":
                stack.pop()
            end = TEMPLATE.match(text, at + 1).end()
            if text.startswith("${", end):
                stack.append("$")
                end += 1
            yield "string", text[at : end + 1], at, min(end + 1, len(text))
            at, before = end + 1, ("sign", "(") if stack and stack[-1] == "$" and text[end : end + 1] == "{" else ("string", "`")
            continue
        if text[at] == "/" and (before[0] in ("", "sign") and before[1] not in (")", "]") or before[1] in BEFORE_EXPRESSION) and (found := REGEX.match(text, at)):
            kind = "string"
        else:
            found = LEXEMES.match(text, at)
            kind = found.lastgroup
        word, at = found.group(), found.end()
        if kind == "blank":
            continue
        if word == "{":
            stack.append("{")
        elif word == "}" and stack:
            stack.pop()
        yield kind, word, found.start(), at
        before = (kind, word)


def _closed(tokens: list[tuple[str, str, int, int]], at: int) -> int | None:
    """The index of what closes the bracket at ``at``."""
    stack = []
    for i in range(at, len(tokens)):
        kind, word, *_ = tokens[i]
        if kind == "string":
            opened, closed = word.endswith("${"), word.startswith("}")
            if closed and stack and stack[-1] == "$":
                stack.pop()
            if opened:
                stack.append("$")
        elif word in ("(", "[", "{"):
            stack.append(word)
        elif word in PAIRS and kind == "sign":
            if not stack or stack.pop() != PAIRS[word]:
                return None
        if not stack:
            return i
    return None


def _body(tokens: list[tuple[str, str, int, int]], at: int) -> int | None:
    """The index of the bracket that closes the body of a declaration whose name is at ``at``; None without a body."""
    angles, i = 0, at + 1
    while i < len(tokens):
        kind, word, *_ = tokens[i]
        if word == "{" and angles == 0 and tokens[i - 1][1] not in BEFORE_TYPE:
            return _closed(tokens, i)
        if word == ";" and angles == 0:
            return None
        if kind == "sign" and word in ("(", "[", "{"):
            if (end := _closed(tokens, i)) is None:
                return None
            i = end
        elif word in ("<", ">"):
            angles = max(0, angles + (1 if word == "<" else -1))
        i += 1
    return None


def declarations(text: str) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(kind, name, source) of the top-level functions and classes, and the imported modules; a bare import is its whole statement."""
    tokens, found, imports, i = list(lexemes(text)), [], [], 0
    fresh = True  # a statement may begin here
    while i < len(tokens):
        kind, word, begin, _ = tokens[i]
        if fresh and word in ("import", "export") and kind == "word":
            imports += _module(tokens, i, text)
        if fresh and kind == "word" and word in ("export", "default", "abstract", "declare"):
            plain = word in ("export", "default")
            i += 1
            if not plain and i < len(tokens) and tokens[i][1] == "class":
                fresh = False  # an abstract or ambient class is another kind of declaration
            continue
        first = i
        if fresh and word == "async" and i + 1 < len(tokens) and tokens[i + 1][1] == "function":
            i += 1
        if fresh and kind == "word" and tokens[i][1] in ("function", "class"):
            name = i + 1 + (i + 1 < len(tokens) and tokens[i + 1][1] == "*")
            if name < len(tokens) and tokens[name][0] == "word" and (end := _body(tokens, name)) is not None:
                found.append(("class" if tokens[i][1] == "class" else "function", tokens[name][1], text[tokens[first][2] : tokens[end][3]].strip()))
                i, fresh = end + 1, True
                continue
        if fresh and word == "@":  # a decorator: its name and arguments, then the statement goes on
            i += 1
            while i < len(tokens) and (tokens[i][0] == "word" and tokens[i - 1][1] in ("@", ".") or tokens[i][1] == "."):
                i += 1
            if i < len(tokens) and tokens[i][1] == "(":
                i = (_closed(tokens, i) or i) + 1
            continue
        if tokens[i][1] in ("(", "[", "{") and tokens[i][0] == "sign":
            if (end := _closed(tokens, i)) is None:
                break
            i = end
        elif tokens[i][0] == "string" and tokens[i][1].endswith("${"):
            if (end := _closed(tokens, i)) is None:
                break
            i = end
        now = tokens[i]
        broken = i + 1 < len(tokens) and "\n" in text[now[3] : tokens[i + 1][2]]
        fresh = now[1] in (";", "}") or broken and (now[0] != "sign" or now[1] in (")", "]")) and now[1] not in BEFORE_EXPRESSION
        i += 1
    return found, imports


def _module(tokens: list[tuple[str, str, int, int]], at: int, text: str) -> list[str]:
    """The module that an import or export statement names."""
    if at + 1 < len(tokens) and tokens[at + 1][0] == "string" and tokens[at][1] == "import":
        end = tokens[at + 2][3] if at + 2 < len(tokens) and tokens[at + 2][1] == ";" else tokens[at + 1][3]
        return [text[tokens[at][2] : end].strip()]
    for i in range(at + 1, len(tokens) - 1):
        kind, word, *_ = tokens[i]
        if word in (";", "=", "(", "function", "class") or i > at + 1 and word in ("import", "export"):
            return []
        if word == "from" and tokens[i + 1][0] == "string":
            return [tokens[i + 1][1].strip("\"'")]
    return []

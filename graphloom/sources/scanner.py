"""Declarations and calls of source files in six languages, from tokens and matched brackets.

A file is cut into tokens: comments and strings are single ones, so nothing in them counts, and every bracket
knows its partner, so parameter lists, bodies and types may spread over any number of lines and nest. Rules for
each language then look at the tokens around a keyword or an opening bracket. Facts are rows. The function around a
call is found in the same pass, as the file's functions are at hand; operators.sweep does it over rows of any number.

Files that differ only in their numbers have the same facts but for these, so such a shape is read once in a worker,
when it comes the second time, and filled in afterwards (Shapes). A file of its own shape is read as it is.

Taken as declarations and calls is what the usual grammars' plain queries take: named functions with bodies, methods,
arrow functions bound to a name; calls of a name or of a member, but no constructors, macros or paths such as a::b().
A Java call on an object counts twice, once for its name and once for its object. Calls inside interpolated
strings are found in templates of JavaScript and TypeScript only. A file's tokens stand in memory while it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LANGUAGES = ("go", "python", "javascript", "typescript", "rust", "java")

STRING = r'"(?:\\.|[^"\\\n])*"?'
CHAR = r"'(?:\\.|[^'\\\n])*'?"
BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
#: Comments, then strings, of each language.
QUOTED = {
    "go": (rf"//[^\n]*|{BLOCK}", rf"{STRING}|`[^`]*`?|{CHAR}"),
    "python": (r"#[^\n]*", r"""(?i:\b[rbuf]{1,2})?(?:"{3}(?:\\[\s\S]|[^\\])*?(?:"{3}|\Z)|'{3}(?:\\[\s\S]|[^\\])*?(?:'{3}|\Z)|"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)"""),
    "javascript": (rf"//[^\n]*|{BLOCK}", rf"{STRING}|{CHAR}"),
    "rust": (rf"//[^\n]*|{BLOCK}", r'b?r(?P<hash>#*)"[\s\S]*?(?:"(?P=hash)|\Z)|b?"(?:\\[\s\S]|[^"\\])*"?' + r"|b?'(?:\\[^\n]+?|[^'\\\n])'"),
    "java": (rf"//[^\n]*|{BLOCK}", rf'"{{3}}(?:\\[\s\S]|[^\\])*?(?:"{{3}}|\Z)|{STRING}|{CHAR}'),
}
QUOTED["typescript"] = QUOTED["javascript"]
WORD = r"[^\W\d][\w$]*|\$[\w$]*"
SIGNS = r"=>|->|::|:=|\.\.\.|\?\.|==|!=|<=|>=|&&|\|\||[^\s\w]"
TOKENS = {k: re.compile(rf"(?P<comment>{c})|(?P<string>{s})|(?P<word>{WORD})|(?P<number>\d[\w.]*)|(?P<sign>{SIGNS})") for k, (c, s) in QUOTED.items()}
SPACE = re.compile(r"\s+")
TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^`\\])*")
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: What a slash may follow to begin a regular expression.
BEFORE_REGEX = {None, "(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "==", "return", "typeof"}
CLOSE = {"(": ")", "[": "]", "{": "}"}

# Words in front of a bracket that call nothing.
NO_CALL = {
    "go": "if for switch select func return case go defer range var const type import map chan interface struct",
    "python": "def class if elif else while for in not and or is return yield await assert except del with raise lambda import from async global nonlocal",
    "javascript": "if for while switch catch return function new super import typeof void delete in of await yield throw case do else with instanceof constructor",
    "rust": "if for while match return fn in as let mut ref move loop pub use impl where else Fn FnMut FnOnce unsafe async dyn",
    "java": "if for while switch catch return new super this synchronized try throw assert else do instanceof case",
}
NO_CALL["typescript"] = NO_CALL["javascript"]
NO_CALL = {k: frozenset(x.split()) for k, x in NO_CALL.items()}
MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare accessor".split())
JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native strictfp default transient volatile".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    line: int
    last: int  # the line it ends on


def tokens_of(text: str, language: str) -> list[Token]:
    """Tokens without comments. A template is cut into its texts and the tokens between them."""
    out, at, line, pattern = [], 0, 1, TOKENS[language]
    if language not in ("javascript", "typescript"):
        for m in pattern.finditer(text):
            line += text.count("\n", at, m.start())
            last = line + text.count("\n", m.start(), m.end())
            if m.lastgroup != "comment":
                out.append(Token(m.lastgroup, m.group(), m.start(), line, last))
            at, line = m.end(), last
        return out
    inside = []  # open brackets, to know where a template goes on

    def add(kind: str, end: int) -> None:
        nonlocal at, line
        body = text[at:end]
        last = line + body.count("\n")
        if kind != "comment":
            out.append(Token(kind, body, at, line, last))
        at, line = end, last

    while at < len(text):
        if inside and inside[-1] == "`":
            end = TEMPLATE.match(text, at).end()
            add("string", end)
            if text.startswith("${", at):
                inside.append("${")
                at += 1
                add("sign", at + 1)
            elif at < len(text):
                inside.pop()
                at += 1
            continue
        if text[at].isspace():
            m = SPACE.match(text, at)
            line += m.group().count("\n")
            at = m.end()
            continue
        if text[at] == "`":
            inside.append("`")
            at += 1
            continue
        if text[at] == "/" and (out[-1].text if out else None) in BEFORE_REGEX and (m := REGEX.match(text, at)):
            add("string", m.end())
            continue
        m = pattern.match(text, at)
        if m is None:
            at += 1
            continue
        if m["sign"] in ("{", "}"):
            if m["sign"] == "{":
                inside.append("{")
            elif inside and inside[-1] != "`":
                inside.pop()
        add(m.lastgroup, m.end())
    return out


def brackets(tokens: list[Token]) -> tuple[dict[int, int], list[int]]:
    """Of every bracket its partner, where what is never closed is closed by the last token; of every token the innermost open bracket, or -1."""
    out, inside, open_ = {}, [], []
    for i, t in enumerate(tokens):
        if t.kind == "sign" and t.text in (")", "]", "}"):
            for k in range(len(open_) - 1, -1, -1):
                if CLOSE[tokens[open_[k]].text] == t.text:
                    out[open_[k]], out[i] = i, open_[k]
                    del open_[k:]
                    break
        inside.append(open_[-1] if open_ else -1)
        if t.kind == "sign" and t.text in CLOSE:
            open_.append(i)
    return out | {i: len(tokens) - 1 for i in open_}, inside


class File:
    """The tokens of a file, and the facts found in them: (kind, line, end line, name, detail, params, result, args)."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.tokens = tokens_of(text, language)
        self.partner, self.inside = brackets(self.tokens)
        self.facts: list[tuple] = []
        self.names: set[int] = set()  # tokens that declare, and so don't call

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != "string" else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def span(self, a: int, b: int) -> str:
        """The text from token a to token b."""
        return self.text[self.tokens[a].start : self.tokens[b].start + len(self.tokens[b].text)] if a <= b else ""

    def angle(self, i: int) -> int:
        """The number after a bracket of generic parameters at i; i if there is none."""
        if self.word(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.tokens):
            text = self.word(k)
            depth += (text == "<") - (text == ">")
            if text in CLOSE and k in self.partner:
                k = self.partner[k]
            elif text in ("{", ";", ")", "]", "}"):
                return i
            k += 1
            if depth == 0:
                return k
        return i

    def until(self, i: int, stops: tuple[str, ...], line_end: bool = False) -> int:
        """The first of stops at or after i, outside brackets; with line_end also the first token on a later line."""
        k = i
        while k < len(self.tokens):
            if self.word(k) in stops or (line_end and k > 0 and self.tokens[k].line > self.tokens[k - 1].last):
                return k
            if self.word(k) in (")", "]", "}"):
                return k
            k = self.partner.get(k, k) + 1
        return k

    def function(self, first: int, name: int, params: int, last: int, result: str = "", receiver: str = "") -> None:
        self.names.add(name)
        t = self.tokens
        self.facts.append(("function", t[name].line, t[first].line, t[min(last, len(t) - 1)].last, t[name].text, receiver, self.span(params, self.partner[params]), result.strip(), 0))

    def type(self, name: int, kind: str) -> None:
        self.names.add(name)
        self.facts.append(("type", self.tokens[name].line, 0, 0, self.tokens[name].text, kind, "", "", 0))

    def imported(self, name: str, i: int) -> None:
        self.facts.append(("import", self.tokens[i].line, 0, 0, name, "", "", "", 0))

    # -- calls -----------------------------------------------------------------------------------

    def head(self, i: int) -> int:
        """The first token of the chain of members that ends with the name at i."""
        closes = (")", "]", "}") if self.language == "go" else (")", "]")
        while i > 1 and self.word(i - 1) in (".", "?."):
            i -= 2
            while i > 0 and (self.word(i) in closes and i in self.partner or self.word(i) == ">" and self.language == "rust"):
                if self.word(i) == ">":  # type arguments, as in a::<b>()
                    depth = 1
                    while depth and i > 0:
                        i -= 1
                        depth += (self.word(i) == ">") - (self.word(i) == "<")
                    i -= 2
                else:
                    i = self.partner[i]
                    if not (self.is_word(i - 1) and self.word(i - 1) not in NO_CALL[self.language] or self.word(i - 1) in (*closes, ">")):
                        break
                    i -= 1
        return max(i, 0)

    def calls(self, skip: set[int]) -> None:
        language, no = self.language, NO_CALL[self.language]
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or t.text in no or i in self.names or i in skip:
                continue
            at = self.angle(i + 1) if language == "typescript" else i + 1
            if self.word(at) != "(" or at not in self.partner:
                continue
            before, close = self.word(i - 1), self.partner[at]
            member = before in (".", "?.")
            if language == "go" and before == "]" or language == "rust" and (before in ("::", "fn", "struct") or self.word(close + 1) in ("=>", "=") or before == "let"):
                continue
            if language == "python" and before in ("def", "class") or language == "java" and before == "@" or before == "#" or before == "*" and self.word(i - 2) == "function":
                continue
            head = self.head(i)
            if (self.word(head - 1) == "new" and language != "go" or self.word(head - 1) == "@" and language == "java") and not (member and self.word(i - 2) in (")", "]")):
                continue
            inner = self.span(at, close)[1:-1]
            args = inner.count(",") + 1 if inner.strip() else 0
            receiver = self.span(head - (self.word(head - 1) == "new"), i - 2) if member else ""
            for _ in range(2 if language == "java" and member else 1):
                self.facts.append(("call", t.line, 0, 0, t.text, receiver, "", "", args))

    # -- languages -------------------------------------------------------------------------------

    def go(self) -> set[int]:
        skip: set[int] = set()
        for i, t in enumerate(self.tokens):
            if t.kind != "word":
                continue
            if t.text == "func":
                name, receiver = i + 1, ""
                if self.word(name) == "(" and self.is_word(self.partner.get(name, name) + 1):
                    receiver, name = self.span(name, self.partner[name]), self.partner[name] + 1
                params = self.partner.get(name + 1, name) + 1 if self.word(name + 1) == "[" else name + 1
                if self.is_word(name) and self.word(params) == "(" and params in self.partner:
                    close = self.partner[params]
                    body = close + 1
                    while body < len(self.tokens) and self.word(body) != "{" and self.tokens[body].line == self.tokens[body - 1].last:
                        # The braces of interface{} and struct{} belong to a result.
                        ends = self.word(body) in ("interface", "struct") and self.word(body + 1) == "{"
                        body = self.partner.get(body + ends, body + ends) + 1
                    ended = self.word(body) == "{" and self.tokens[body].line == self.tokens[body - 1].last
                    self.function(i, name, params, self.partner[body] if ended else body - 1, self.span(close + 1, body - 1), receiver)
            elif t.text == "type" or self.word(i - 1) in ("(", "") or self.tokens[i].line > self.tokens[i - 1].last:
                self.go_type(i + 1 if t.text == "type" else i, t.text == "type")
            if t.text == "interface" and self.word(i + 1) == "{":
                self.members(i + 1, skip)
            if t.text == "import":
                grouped = self.word(i + 1) == "("
                for k in range(i + 1, self.partner.get(i + 1, i + 1) + 1 if grouped else min(i + 3, len(self.tokens))):
                    s = self.tokens[k]
                    if s.kind == "string" and s.text.startswith('"') and (grouped or s.line == t.line):
                        self.imported(s.text.strip("\"'"), k)
        return skip

    def go_type(self, name: int, told: bool) -> None:
        """A type's name at a token: after the word type, or at the start of a line in its group."""
        kind = self.partner.get(name + 1, name) + 1 if self.word(name + 1) == "[" and self.word(name + 2) != "]" else name + 1
        if not (self.is_word(name) and self.word(kind) in ("struct", "interface") and self.word(kind + 1) == "{"):
            return
        if not told and not self.grouped(name):
            return
        self.type(name, self.word(kind))

    def grouped(self, name: int) -> bool:
        return self.word(self.inside[name]) == "(" and self.word(self.inside[name] - 1) == "type"

    def members(self, brace: int, skip: set[int]) -> None:
        """Names right inside braces, which declare and don't call."""
        k = brace + 1
        while k < self.partner.get(brace, brace):
            if self.is_word(k):
                skip.add(k)
            k = self.partner.get(k, k) + 1

    def python(self) -> set[int]:
        # Logical lines: a token that is the first on its line, outside brackets.
        firsts, k = [], 0
        while k < len(self.tokens):
            before = self.tokens[k - 1].start + len(self.tokens[k - 1].text) if k else 0
            if k == 0 or (self.tokens[k].line > self.tokens[k - 1].last and not re.search(r"\\\r?\n[ \t]*$", self.text[before : self.tokens[k].start])):
                firsts.append(k)
            k = max(k, self.partner.get(k, k)) + 1
        column = {k: self.tokens[k].start - (self.text.rfind("\n", 0, self.tokens[k].start) + 1) for k in firsts}
        for n, first in enumerate(firsts):
            i = first + (self.word(first) == "async")
            word = self.word(i)
            if word in ("def", "class") and self.is_word(i + 1):
                if word == "class":
                    self.type(i + 1, "class")
                    continue
                params = self.partner.get(i + 2, i + 1) + 1 if self.word(i + 2) == "[" else i + 2
                if self.word(params) == "(" and params in self.partner:
                    colon = self.until(self.partner[params] + 1, (":",))
                    result = self.span(self.partner[params] + 2, colon - 1) if self.word(self.partner[params] + 1) == "->" else ""
                    after = next((firsts[k] for k in range(n + 1, len(firsts)) if column[firsts[k]] <= column[first]), len(self.tokens))
                    self.function(first, i + 1, params, after - 1, result)
            elif word == "import":
                k = i + 1
                while self.is_word(k):
                    end = k
                    while self.word(end + 1) == ".":
                        end += 2
                    if self.word(end + 1) != "as":
                        self.imported(self.span(k, end), k)
                    else:
                        end += 2
                    k = end + 2 if self.word(end + 1) == "," else len(self.tokens)
            elif word == "from":
                end = self.until(i + 1, ("import",))
                if end > i + 1:
                    self.imported(self.span(i + 1, end - 1), i + 1)
        return set()

    def javascript(self) -> set[int]:
        typed = self.language == "typescript"
        skip: set[int] = set()
        kinds = {"class": "class"} | ({"interface": "interface", "type": "alias", "enum": "enum"} if typed else {})
        for i, t in enumerate(self.tokens):
            if t.kind != "word":
                continue
            before, fresh = self.word(i - 1), i == 0 or t.line > self.tokens[i - 1].last
            statement = before in ("", ";", "{", "}", "export", "default", "async", "declare", ")", "const") or (fresh and before not in ("=", "(", ",", ":", "?", "=>", "["))
            if t.text == "function" and self.is_word(i + 1):
                params = self.angle(i + 2)
                if self.word(params) == "(" and params in self.partner:
                    self.names.add(i + 1)
                    body = self.body(self.partner[params] + 1)
                    if statement and body:
                        self.function(i - (before == "async"), i + 1, params, self.partner[body], self.result(self.partner[params], body))
            elif t.text in kinds and self.is_word(i + 1) and statement and before != "abstract" and (t.text != "type" or self.word(self.angle(i + 2)) == "="):
                self.type(i + 1, kinds[t.text])
                if t.text in ("interface", "enum", "type"):
                    brace = self.until(i + 2, ("{", ";"))
                    if self.word(brace) == "{":
                        skip.update(range(brace, self.partner.get(brace, brace)))
            elif t.text == "import" and self.word(i + 1) not in ("(", ".") and before not in (".", "?."):
                k = i + 1
                while k < len(self.tokens) and self.tokens[k].kind != "string" and self.word(k) not in (";", "=", "("):
                    k += 1
                if k < len(self.tokens) and self.tokens[k].kind == "string":
                    self.imported(self.tokens[k].text.strip("\"'"), k)
            elif t.text == "require" and not typed and self.word(i + 1) == "(" and before not in (".", "?."):
                for k in range(i + 2, self.partner.get(i + 1, i + 1)):
                    if self.tokens[k].kind == "string":
                        self.imported(self.tokens[k].text.strip("\"'"), k)
            elif before in ("const", "let", "var"):
                self.arrow(i)
            elif self.method(i, before, fresh):
                params = self.angle(i + 1)
                body = self.body(self.partner[params] + 1)
                first = i
                while self.word(first - 1) in MODIFIERS and self.tokens[first - 1].line == self.tokens[first].line:
                    first -= 1
                self.function(first, i, params, self.partner[body], self.result(self.partner[params], body))
            elif before == "abstract" or (typed and self.word(i + 1) == "(" and self.word(self.partner.get(i + 1, i) + 1) == ":" and before in (";", "{", "}", *MODIFIERS) and self.member(i)):
                skip.add(i)  # a signature without a body
        return skip

    typescript = javascript

    def member(self, i: int) -> bool:
        """Whether a name stands right inside the braces of a class."""
        k = self.inside[i] - 1
        while k >= 0 and self.word(k) not in (";", "{", "}", "class", ")"):
            k -= 1
        return self.word(self.inside[i]) == "{" and k >= 0 and self.word(k) == "class"

    def body(self, i: int) -> int:
        """The brace of a body after a parameter list, or 0. A result's type may come between."""
        if self.word(i) == ":":
            i += 1
            while i < len(self.tokens):
                if self.word(i) == "{" and (self.word(i - 1) not in (":", "|", "&", "<", "=>", "is")):
                    break
                if self.word(i) in (";", "}", ")", "=", ",") or self.is_word(i) and self.tokens[i].line > self.tokens[i - 1].last and self.word(i - 1) not in ("|", "&", ":", "=>"):
                    return 0
                i = self.partner.get(i, i) + 1
        return i if self.word(i) == "{" and i in self.partner else 0

    def result(self, close: int, body: int) -> str:
        return self.span(close + 2, body - 1) if self.word(close + 1) == ":" else ""

    def method(self, i: int, before: str, fresh: bool) -> bool:
        params = self.angle(i + 1)
        if self.word(params) != "(" or params not in self.partner or self.word(i) in NO_CALL["javascript"] - {"constructor", "delete", "import", "of", "in"}:
            return False
        body = self.body(self.partner[params] + 1)
        if not body or self.tokens[body].line > self.tokens[body - 1].last:
            return False
        if before == "*" and self.word(i - 2) == "function":
            return False
        return before in ("{", "}", ";", ",", "*", *MODIFIERS) or (fresh and before not in (".", "?.", "=", "("))

    def arrow(self, i: int) -> None:
        """const name = (params) => ..., with types in between."""
        k = i + 1
        if self.word(k) == ":":
            k = self.until(k + 1, ("=", ";", ","))
        if self.word(k) != "=":
            return
        k += 1
        if self.word(k) == "async":
            self.names.add(k)
            k += 1
        k = self.angle(k)
        if self.word(k) != "(" or k not in self.partner:
            return
        params, k = k, self.partner[k] + 1
        close = k - 1
        if self.word(k) == ":":
            k = self.until(k + 1, ("=>", ";", "="))
        if self.word(k) != "=>":
            return
        result, k = self.result(close, k), k + 1
        if self.word(k) == "{":
            last = self.partner.get(k, k)
        else:
            last = k
            while last < len(self.tokens) and self.word(last) not in (";", ",", ")", "]", "}"):
                last = self.partner.get(last, last) + 1
                if last < len(self.tokens) and self.tokens[last].line > self.tokens[last - 1].last and (self.tokens[last].kind != "sign" or self.word(last) in ("{", "[", "(")) and self.tokens[last - 1].kind != "sign":
                    break
            last -= 1
        self.function(i, i, params, last, result)

    def rust(self) -> set[int]:
        skip: set[int] = set()
        for i, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text == "!" and self.word(i + 1) in CLOSE or t.text == "#" and self.word(i + 1 + (self.word(i + 1) == "!")) == "[":
                k = i + 1 + (t.text == "#" and self.word(i + 1) == "!")
                if t.text == "#" or self.is_word(i - 1):
                    skip.update(range(i - 1, self.partner.get(k, k)))  # tokens of macros and attributes
            if t.kind != "word" or i in skip:
                continue
            if t.text == "fn" and self.is_word(i + 1):
                self.names.add(i + 1)
                params = self.angle(i + 2)
                if self.word(params) == "(" and params in self.partner:
                    close = self.partner[params]
                    body = self.until(close + 1, ("{", ";"))
                    if self.word(body) == "{":
                        where = self.until(close + 1, ("where", "{"))
                        first = i
                        while self.word(first - 1) in ("async", "const", "unsafe", "extern", "pub") or self.word(first - 1) == ")" and self.word(self.partner.get(first - 1, 0) - 1) == "pub" or first and self.tokens[first - 1].kind == "string":
                            first = self.partner.get(first - 1, first - 1)
                        self.function(first, i + 1, params, self.partner.get(body, body), self.span(close + 2, where - 1) if self.word(close + 1) == "->" else "")
            elif t.text in ("struct", "enum", "trait") and self.is_word(i + 1):
                self.type(i + 1, t.text)
                if t.text == "enum":
                    brace = self.until(i + 2, ("{", ";"))
                    if self.word(brace) == "{":
                        skip.update(range(brace, self.partner.get(brace, brace)))
            elif t.text == "mod" and self.is_word(i + 1) and self.word(i + 2) in (";", "{"):
                self.imported(self.word(i + 1), i + 1)
            elif t.text == "use":
                end = self.until(i + 1, (";",))
                if end > i + 1 and all(self.is_word(k) if (k - i) % 2 else self.word(k) == "::" for k in range(i + 1, end)):
                    self.imported(re.sub(r"\s", "", self.span(i + 1, end - 1)), i + 1)
        return skip

    def java(self) -> set[int]:
        skip: set[int] = set()
        bodies: list[tuple[int, int, str]] = []  # braces of classes and their names
        for i, t in enumerate(self.tokens):
            while bodies and i > bodies[-1][1]:
                bodies.pop()
            if t.kind != "word":
                continue
            if t.text in ("class", "interface", "enum", "record") and self.is_word(i + 1) and self.word(i - 1) != ".":
                if t.text != "record" and self.word(i - 1) != "@":
                    self.type(i + 1, t.text)
                self.names.add(i + 1)
                brace = self.until(i + 2, ("{", ";"))
                if self.word(brace) == "{" and brace in self.partner:
                    bodies.append((brace, self.partner[brace], self.word(i + 1)))
                    if t.text == "enum":
                        k = brace + 1
                        while k < self.partner[brace] and self.word(k) != ";":
                            skip.add(k)
                            if self.word(k) == "{":  # a constant's own body
                                bodies.append((k, self.partner[k], ""))
                            k = self.partner.get(k, k) + 1
                    bodies.sort()
            elif t.text == "new":
                # The body of a nameless class declares methods, too.
                k = self.until(i + 1, ("(", ";"))
                brace = self.partner.get(k, k) + 1 if self.word(k) == "(" else k
                if self.word(brace) == "{" and brace in self.partner:
                    bodies.append((brace, self.partner[brace], ""))
                    bodies.sort()
            elif t.text == "import" and not bodies:
                k = i + 1 + (self.word(i + 1) == "static")
                end = self.until(k, (";",)) - 1
                end -= 2 * (self.word(end) == "*")
                if end > k:
                    self.imported(re.sub(r"\s", "", self.span(k, end)), k)
            elif self.word(i + 1) == "(" and i + 1 in self.partner:
                inside = next((b for b in reversed(bodies) if b[0] < i < b[1]), None)
                if inside is None or self.inside[i] != inside[0]:
                    continue
                k = self.partner[i + 1] + 1
                while self.word(k) in ("[", "]"):
                    k += 1
                if self.word(k) == "throws":
                    k = self.until(k, ("{", ";"))
                first = i
                while self.word(first - 1) not in ("", ";", "{", "}") or self.word(first - 1) == "}" and self.partner.get(first - 1, inside[0]) > inside[0] and self.word(self.partner[first - 1] - 1) == "(":
                    first = min(first - 1, self.partner.get(first - 1, first - 1))
                before = self.word(i - 1)
                kind = self.span(first, i - 1) if first < i else ""
                made = t.text == inside[2] and self.word(k) == "{"
                if "=" in [self.word(x) for x in range(first, i)] or not (made or self.word(k) in ("{", ";") and (before in (">", "]") or self.is_word(i - 1) and before not in JAVA_MODIFIERS and before not in NO_CALL["java"])):
                    continue
                words = [w for w in kind.split() if w not in JAVA_MODIFIERS and not w.startswith("@")]
                self.function(first, i, i + 1, self.partner.get(k, k) if self.word(k) == "{" else k, "" if made else " ".join(words))
        return skip

    def read(self) -> list[tuple]:
        skip = getattr(self, self.language)()
        self.calls(skip)
        return self.facts


def callers_of(facts: list[tuple]) -> list[str]:
    """For each fact of a file the name of the last function that holds its line, if it is a call in one, or an empty text."""
    ranges = sorted((f[2], f[3], k) for k, f in enumerate(facts) if f[0] == "function" and f[2] <= f[3])
    out, at, open_ = [""] * len(facts), 0, []
    for line, k in sorted((f[1], k) for k, f in enumerate(facts) if f[0] == "call"):
        while at < len(ranges) and ranges[at][0] <= line:
            heappush(open_, (-ranges[at][2], ranges[at][1]))
            at += 1
        while open_ and open_[0][1] < line:
            heappop(open_)
        if open_:
            out[k] = facts[-open_[0][0]][4]
    return out


FACTS = "path string, language string, kind string, ord int, line int, start_line int, end_line int, name string, detail string, params string, result string, args int, caller string, first boolean"
KINDS = ("function", "type", "import", "call")
#: Text columns and the kinds of facts that have them; numbers are the others.
TEXTS = {"name": KINDS, "detail": ("function", "type", "call"), "params": ("function",), "result": ("function",), "caller": ("call",)}

#: A number that can stand for any other. In Rust it stays behind a quote, as its length tells a character from a lifetime.
NUMBER, UNQUOTED, QUOTED_NUMBER = re.compile("([0-9]+)"), re.compile(r"(?<!['\d])([0-9]+)"), re.compile("'[0-9]")
#: Digits that mark the places of numbers in a shape, and with the null character may not be in a text that has one.
MARK = {ord(str(k)): chr(0x1D7CE + k) for k in range(10)}
MARKED = re.compile("([\U0001D7CE-\U0001D7D7]+)")
ODD = re.compile("[\0\U0001D7CE-\U0001D7D7]")


class Facts:
    """The facts of files of one shape: their numbers, and a form for their texts, column by column, that takes the files' numbers."""

    def __init__(self, text: str, language: str, kinds: tuple[str, ...], marked: bool):
        all_ = File(text, language).read()
        rows = [(k, f, c) for k, (f, c) in enumerate(zip(all_, callers_of(all_), strict=True)) if f[0] in kinds]
        self.n = len(rows)
        self.numbers = np.array([(KINDS.index(f[0]), k, f[1], f[2], f[3], f[8]) for k, f, _ in rows], np.int32).reshape(-1, 6)
        columns = {"name": [f[4] for _, f, _ in rows], "detail": [f[5] for _, f, _ in rows], "params": [f[6] for _, f, _ in rows], "result": [f[7] for _, f, _ in rows], "caller": [c for *_, c in rows]}
        self.texts = [x for c in used(kinds) for x in columns[c]]
        own = [[i for i, (_, f, _) in enumerate(rows) if f[0] == kind] for kind in KINDS[:3]]
        self.groups = [(x, itemgetter(*x)) for x in own if len(x) > 1]
        pieces = MARKED.split("\0".join(self.texts)) if marked else [""]
        self.form = "%s".join(x.replace("%", "%%") for x in pieces[::2])
        self.pick = itemgetter(*map(int, pieces[1::2])) if len(pieces) > 1 else None

    def filled(self, numbers: list[str]) -> list[str]:
        return (self.form % self.pick(numbers)).split("\0") if self.pick else self.texts

    def again(self, texts: list[str]) -> list[int]:
        """Declarations whose name the same kind has before in the file."""
        out = []
        for at, get in self.groups:
            names = get(texts)
            if len(set(names)) < len(names):
                before: set[str] = set()
                for i, name in zip(at, names, strict=True):
                    if name in before:
                        out.append(i)
                    before.add(name)
        return out


def used(kinds: tuple[str, ...]) -> list[str]:
    return [c for c, of in TEXTS.items() if not set(of).isdisjoint(kinds)]


class Shapes:
    """Reads files; what came twice but for its numbers is not read a third time. Holds so many characters of shapes at most, and then begins anew."""

    LONGEST, ROOM, ONCE = 50_000, 4_000_000, 200_000

    def __init__(self, kinds: tuple[str, ...]):
        self.kinds, self.known, self.once, self.room = kinds, {}, set(), self.ROOM

    def read(self, text: str, language: str) -> tuple[Facts, list[str]]:
        """A file's facts, and their texts."""
        if len(text) > self.LONGEST or "\0" in text or not text.isascii() and ODD.search(text):
            one = Facts(text, language, self.kinds, False)
            return one, one.texts
        parts = (UNQUOTED if language == "rust" and QUOTED_NUMBER.search(text) else NUMBER).split(text)
        numbers = parts[1::2]
        # Java tells a constructor by the name of its class, so there it counts which numbers are equal.
        same = None
        if language == "java":
            first: dict[str, int] = {}
            same = tuple(first.setdefault(x, i) for i, x in enumerate(numbers))
        key = (language, "\0".join(parts[::2]), same)
        one = self.known.get(key)
        if one is None:
            if hash(key) not in self.once:
                if len(self.once) >= self.ONCE:
                    self.once.clear()
                self.once.add(hash(key))
                one = Facts(text, language, self.kinds, False)
                return one, one.texts
            parts[1::2] = [str(i if same is None else same[i]).translate(MARK) for i in range(len(numbers))]
            one = Facts("".join(parts), language, self.kinds, True)
            self.room -= len(text)
            if self.room < 0:
                self.known.clear()
                self.room = self.ROOM - len(text)
            self.known[key] = one
        return one, one.filled(numbers)


@cache
def shapes(kinds: tuple[str, ...]) -> Shapes:
    """The same in all tasks of a worker."""
    return Shapes(kinds)


#: Files whose facts are one batch of rows.
FILES = 500


def scanned(files: DataFrame, kinds: tuple[str, ...] = KINDS, by: tuple[str, ...] = ()) -> DataFrame:
    """The facts of these kinds of files(path, language, text) in LANGUAGES, in the order of the text for each kind.

    kind is function (detail: the receiver), type (detail: its kind), import or call (detail: what it is called on; caller: the
    last function of the file whose lines hold it). first says that a declaration is the first of its kind and name in the file. Null
    texts have no facts. With `by`, rows of these columns of FACTS and n: how many facts of a file have these values; path is one of them.
    """
    kinds = tuple(k for k in KINDS if k in kinds)
    texts = used(kinds)

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, memo, labels = [x.split()[0] for x in FACTS.split(", ")], shapes(kinds), pa.array(KINDS)
        for batch in frames:
            for a in range(0, batch.num_rows, FILES):
                part = batch.slice(a, FILES)
                counts, numbers, columns, again, n = [], [], [[] for _ in texts], [], 0
                for language, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    facts, found = memo.read(text or "", language)
                    counts.append(m := facts.n)
                    if m:
                        numbers.append(facts.numbers)
                        for c, column in enumerate(columns):
                            column += found[c * m : (c + 1) * m]
                        again += [n + i for i in facts.again(found)]
                        n += m
                if not n:
                    continue
                of = np.concatenate(numbers)
                kind, at, line, start, end, args = (pa.array(np.ascontiguousarray(of[:, k])) for k in range(6))
                first = np.ones(n, bool)
                first[again] = False
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                made = {c: pa.array(column, pa.string()) for c, column in zip(texts, columns, strict=True)}
                made = {c: made[c] if c in made else pa.repeat(pa.scalar("", pa.string()), n) for c in TEXTS}
                path = part.column(0).take(rows)
                inside = pc.and_(pc.not_equal(made["caller"], ""), pc.is_valid(path))
                caller = pc.if_else(inside, made["caller"], pa.scalar(None, pa.string()))
                found = pa.record_batch([path, part.column(1).take(rows), labels.take(kind), at, line, start, end, made["name"], made["detail"], made["params"], made["result"], args, caller, pa.array(first)], names)
                if not by:
                    yield found
                else:  # all rows of a file are in this batch
                    same = pa.Table.from_batches([found]).group_by(list(by)).aggregate([([], "count_all")])
                    yield from same.select([*by, "count_all"]).rename_columns([*by, "n"]).combine_chunks().to_batches()

    schema = FACTS if not by else ", ".join([x for c in by for x in FACTS.split(", ") if x.split()[0] == c] + ["n long"])
    return files.filter(files["language"].isin(*LANGUAGES)).select("path", "language", "text").mapInArrow(scan, schema)

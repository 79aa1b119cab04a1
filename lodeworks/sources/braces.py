"""Definitions and calls of brace languages: a scanner for their words and marks, and one pass over its tokens.

No grammar is at hand, so headings are judged by what stands between the last statement's end and a brace. Strings,
template literals, raw strings, character literals, lifetimes, regular expressions, comments and directives are known
to the scanner, so braces inside them count for nothing; code inside a template literal counts as code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SCRIPT = frozenset(("javascript", "typescript"))
BRACED = SCRIPT | {"rust", "java", "csharp", "cpp", "go"}

# Which words head a container in each language.
CONTAINERS = {
    "javascript": frozenset(("class",)),
    "typescript": frozenset(("class", "interface", "enum", "namespace", "module")),
    "rust": frozenset(("impl", "trait", "mod", "struct", "enum", "union")),
    "java": frozenset(("class", "interface", "enum")),
    "csharp": frozenset(("namespace", "class", "struct", "interface", "enum")),
    "cpp": frozenset(("class", "struct", "namespace", "enum")),
    "go": frozenset(),
}
# Words that head a callable by themselves.
CALLABLES = {"javascript": "function", "typescript": "function", "rust": "fn", "go": "func"}
# Words before a parenthesis that neither call nor define, in any language and in one.
NO_CALL = frozenset(
    "if for foreach while do switch catch return sizeof alignof decltype typeof match else using lock fixed synchronized case "
    "when where in of not and or throw yield await delete void new class struct interface checked unchecked nameof default super base this".split()
)
OWN_NO_CALL = {
    "javascript": frozenset(("function", "async", "with")), "typescript": frozenset(("function", "async", "with")), "rust": frozenset(("fn",)),
    "go": frozenset(("func", "map", "chan", "range", "defer", "go")),
}
# Words after which a name begins an expression, not a declared thing's name.
EXPRESSION = frozenset("return throw else do in of await yield case new delete typeof not and or go defer range when co_return co_await".split())
# Words that a script's statement goes on after, or begins no statement with.
GOES_ON = frozenset("export default async static public private protected abstract readonly declare extends implements class function new return const let var".split())
CONTINUES = frozenset("extends implements instanceof in of as satisfies from".split())
# Words before a constructor's name.
MODIFIERS = frozenset("public private protected internal static final abstract synchronized native default strictfp extern unsafe async override virtual sealed partial".split())

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v\n]+)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<mark>=>|::|->|&&|\|\||\?\?|\?\.|\.\.\.|[-+*/%&|^!<>=]=|.)",
    re.S,
)
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_CHARACTER = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'", re.S)
_RAW = {
    "rust": re.compile(r"b?r(#*)\".*?\"\1", re.S),
    "cpp": re.compile(r"(?:u8|[uUL])?R\"([^()\\\s]{0,16})\(.*?\)\1\"", re.S),
    "csharp": re.compile(r"(?:[@$]+\"(?:\"\"|[^\"])*\")|(\"{3,}).*?\1", re.S),
    "java": re.compile(r"\"\"\"(?:\\.|.)*?\"\"\"", re.S),
    "go": re.compile(r"`[^`]*`"),
}
_REGULAR = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_DIRECTIVE = re.compile(r"[ \t]*#(?:\\\r?\n|[^\n])*")
_ATTRIBUTE = re.compile(r"#!?\[")


@dataclass
class Definition:
    qualified: str
    kind: str
    start: int  # lines from 1; wrappers and decorators belong to a chunk, not to the definition
    end: int
    top: int
    inner: int | None  # line of the first definition inside
    nested: bool  # inside a callable
    graph: bool = True  # False: a chunk of its own, but no symbol


@dataclass
class Token:
    text: str
    kind: str  # word, number, text or mark
    line: int


def tokens(lang: str, text: str) -> list[Token]:
    """Words and marks in order; strings and regular expressions are one token of kind text, all else is left out."""
    out: list[Token] = []
    line, at, n = 1, 0, len(text)
    templates: list[int] = []  # open braces inside each template literal's code
    raw = _RAW.get(lang)

    def skip(end: int, kind: str | None = None) -> None:
        nonlocal at, line
        if kind:
            out.append(Token(text[at:end] if kind != "text" else "''", kind, line))
        line += text.count("\n", at, end)
        at = end

    def template(from_: int) -> int:
        """The place after a literal's text: behind its closing mark, or behind the next opening of code."""
        i = from_
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                templates.append(0)
                return i + 2
            else:
                i += 1
        return n

    while at < n:
        c = text[at]
        if c == "/" and text.startswith("//", at):
            end = text.find("\n", at)
            skip(n if end < 0 else end)
        elif c == "/" and text.startswith("/*", at):
            end, depth = at + 2, 1
            while depth and end < n:
                close, deeper = text.find("*/", end), text.find("/*", end) if lang == "rust" else -1
                if close < 0:
                    end = n
                elif 0 <= deeper < close:
                    depth, end = depth + 1, deeper + 2
                else:
                    depth, end = depth - 1, close + 2
            skip(end)
        elif raw and (m := raw.match(text, at)) and not (out and out[-1].kind == "word" and text[at - 1 : at].isalnum()):
            skip(m.end(), "text")
        elif c == "`" and lang in SCRIPT:
            skip(template(at + 1), "text")
        elif c == "}" and templates and not templates[-1]:
            templates.pop()
            skip(template(at + 1))
        elif c == '"' or (c == "'" and lang in SCRIPT):
            skip(_QUOTED[c].match(text, at).end(), "text")
        elif c == "'":
            m = _CHARACTER.match(text, at)
            skip(m.end() if m else at + 1, "text" if m else None)  # else a lifetime's mark or a digit separator
        elif c == "/" and lang in SCRIPT and _begins_expression(out) and (m := _REGULAR.match(text, at)):
            skip(m.end(), "text")
        elif c == "#" and lang in ("cpp", "csharp") and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            skip(_DIRECTIVE.match(text, at).end())
        elif c == "#" and lang == "rust" and (m := _ATTRIBUTE.match(text, at)):
            depth, end = 1, m.end()
            while end < n and depth:
                if text[end] == '"':
                    end = _QUOTED['"'].match(text, end).end()
                    continue
                depth += (text[end] == "[") - (text[end] == "]")
                end += 1
            skip(end)
        else:
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if templates and kind == "mark":
                templates[-1] += (c == "{") - (c == "}")
            skip(m.end(), None if kind == "space" else kind)
    return out


def _begins_expression(before: list[Token]) -> bool:
    last = before[-1] if before else None
    return last is None or last.text in EXPRESSION or last.text == "void" or (last.kind == "mark" and last.text not in (")", "]", "}"))


@dataclass
class _Scope:
    """An open brace or parenthesis."""

    close: str
    role: str  # container, callable, object, code or group
    heading: list[int]  # what the heading was, to go on with where the brace was part of an expression
    at: int | None = None  # its definition
    names: tuple[str, ...] = ()
    in_callable: bool = False


@dataclass
class Parsed:
    definitions: list[Definition] = field(default_factory=list)
    calls: list[tuple[str, int, int]] = field(default_factory=list)  # name, line, definition or -1


class _Parser:
    def __init__(self, lang: str, text: str) -> None:
        self.lang, self.tokens = lang, tokens(lang, text)
        self.no_call = NO_CALL | OWN_NO_CALL.get(lang, frozenset())
        self.out = Parsed()
        self.scopes = [_Scope("", "code", [])]
        self.heading: list[int] = []  # tokens since the last statement ended, at this level
        self.call_at: list[int] = []  # the token of each call

    # Headings ------------------------------------------------------------------

    def word(self, i: int) -> str:
        return self.tokens[i].text

    def bare(self, heading: list[int]) -> list[int]:
        """A heading without decorators, annotations, attributes and the words that only wrap."""
        h, k = heading, 0
        while k < len(h):
            t = self.word(h[k])
            if t == "@" and k + 1 < len(h) and self.word(h[k + 1]) != "interface":
                k += 2
                while k + 1 < len(h) and self.word(h[k]) == ".":
                    k += 2
                if k < len(h) and self.word(h[k]) == "(":
                    k += 2
            elif t in ("export", "default") and self.lang in SCRIPT:
                k += 1
            elif t == "[" and self.lang == "csharp":
                k += 2
            elif t == "template" and self.lang == "cpp":
                k, angle = k + 1, 0
                while k < len(h):
                    angle += (self.word(h[k]) == "<") - (self.word(h[k]) == ">")
                    k += 1
                    if angle <= 0:
                        break
            else:
                break
        return h[k:]

    def container(self, h: list[int]) -> tuple[str, int] | None:
        """Name and first token of the container that a heading opens."""
        kinds = CONTAINERS[self.lang]
        angle = 0
        for k, i in enumerate(h):
            t = self.tokens[i]
            angle += (t.text == "<") - (t.text == ">")
            if t.kind == "word" and t.text == CALLABLES.get(self.lang) and not angle:
                return None
            if t.kind != "word" or t.text not in kinds or angle > 0:
                continue
            before = self.word(h[k - 1]) if k else ""
            if before in (".", "=", ",", "(", ":", "return", "new", "?", "=>", "&&", "||"):
                return None
            rest = h[k + 1 :]
            if self.lang == "cpp" and (rest and self.word(rest[-1]) == ")" or any(self.word(j) == "=" for j in rest)):
                return None  # a function that returns one, or a value of one
            if t.text == "module" and (not rest or self.tokens[rest[0]].kind == "mark"):
                return None
            name = self.container_name(t.text, rest)
            start = 0
            for j in range(k, -1, -1):  # modifiers before the word, back to another statement's end without a mark
                if j < k and not (self.tokens[h[j]].kind == "word" or self.word(h[j]) in ("(", ")", "<", ">", ",", "[", "]", "@", ".")):
                    start = j + 1
                    break
            if self.lang in SCRIPT:
                start = k - (before in ("abstract", "declare", "const"))
            return name, h[start]
        return None

    def container_name(self, word: str, rest: list[int]) -> str:
        k, angle = 0, 0
        if word in ("impl", "enum", "namespace"):
            while k < len(rest):  # generics of an impl, and the second word of an enum class
                t = self.word(rest[k])
                angle += (t == "<") - (t == ">")
                if angle <= 0 and self.tokens[rest[k]].kind == "word" and t not in ("class", "struct", "const", "unsafe", "dyn", "inline"):
                    break
                k += 1
        elif self.lang == "cpp":  # attributes and export macros come first
            words = []
            for j in rest:
                if self.word(j) in (":", "<", "final"):
                    break
                if self.tokens[j].kind == "word":
                    words.append(self.word(j))
            return words[-1] if words else word
        name = ""
        while k < len(rest) and (self.tokens[rest[k]].kind == "word" or self.word(rest[k]) in (".", "::")):
            if name and self.tokens[rest[k]].kind == "word" and self.word(rest[k - 1]) not in (".", "::"):
                break
            name += self.word(rest[k])
            k += 1
        return name.replace("::", ".") if word in ("namespace", "module") else re.split(r"\.|::", name)[-1] or word

    def callable(self, h: list[int], ended: bool) -> tuple[str, int] | None:
        """Name and first token of the callable that a heading opens; ``ended``: by a semicolon."""
        scope, word = self.scopes[-1], CALLABLES.get(self.lang)
        for k, i in enumerate(h if word and not ended else []):
            if self.word(i) != word or self.tokens[i].kind != "word":
                continue
            rest = [j for j in h[k + 1 :] if self.word(j) != "*"]
            if self.lang == "go" and rest and self.word(rest[0]) == "(":
                rest = rest[2:]  # the receiver; a literal has no name after it
            if not rest or self.tokens[rest[0]].kind != "word":
                return None
            if self.lang == "go" and k:
                return None
            before = self.word(h[k - 1]) if k else ""
            if self.lang in SCRIPT and (scope.role in ("group", "object") or before in ("=", ":", "return", ",", "new", "!", "=>", "(", "&&", "||", "?")):
                return None
            start = k
            while start and (self.tokens[h[start - 1]].kind in ("word", "text") or self.word(h[start - 1]) in ("(", ")")) and self.lang == "rust":
                start -= 1
            if before == "async":
                start = k - 1
            return self.word(rest[0]), h[start]
        if self.lang in ("rust", "go") or scope.role in ("callable", "group"):
            return None
        close = self.parameters(h)
        if close is None:
            return None
        name = close - 1  # the place before the parameters' parenthesis, past generics
        if name >= 0 and self.word(h[name]) == ">":
            angle = 0
            while name >= 0:
                angle += (self.word(h[name]) == ">") - (self.word(h[name]) == "<")
                name -= 1
                if not angle:
                    break
        if name < 0:
            return None
        t, before = self.tokens[h[name]], self.word(h[name - 1]) if name else ""
        if self.lang in SCRIPT:
            if scope.role not in ("container", "object") or t.kind not in ("word", "text") and t.text != "]" or t.text in self.no_call:
                return None
            if before in ("=", "new", ".") or ended and not any(self.word(i) == "abstract" for i in h):
                return None
            start = name
            while start and self.tokens[h[start - 1]].kind == "word" and self.tokens[h[start - 1]].line == t.line or start and self.word(h[start - 1]) in ("*", "#"):
                start -= 1
            return (t.text if t.kind == "word" else "computed"), h[start]
        if t.kind != "word" or t.text in self.no_call or before in ("new", ".", "=", "return", "->"):
            return None
        if self.lang == "cpp":
            if ended and not any(self.word(a) == "=" and self.word(b) in ("default", "delete") for a, b in zip(h, h[1:])):
                return None
            if scope.in_callable or not name and scope.role != "container":
                return None  # a macro's use, or a statement
            text = t.text
            if name >= 1 and before == "~":
                text, name = "~" + text, name - 1
            return text, h[0] if self.word(h[0]) not in ("public", "private", "protected") else h[min(2, len(h) - 1)]
        if scope.in_callable and scope.role != "container" or scope.role == "code" and not scope.names:
            return None
        if any(self.word(i) in ("=", "=>") for i in h[:close]):
            return None
        typed = before in (">", "]", "?") or name and self.tokens[h[name - 1]].kind == "word" and before not in MODIFIERS
        if not typed and (ended or not scope.names or t.text != scope.names[-1]):
            return None  # an enumeration's constant
        return t.text, h[0]

    def parameters(self, h: list[int]) -> int | None:
        """The place in a heading of the parenthesis that opens the parameters; what may follow them is passed over."""
        k = len(h) - 1
        while k >= 0 and self.word(h[k]) != "(":
            k -= 1
        if self.lang == "cpp":  # the first list whose name is not a macro's; initialisers come after it
            k = next((j for j in range(len(h)) if self.word(h[j]) == "(" and j and self.tokens[h[j - 1]].kind == "word" and self.word(h[j - 1]) not in ("noexcept", "__attribute__", "alignas", "explicit", "decltype")), -1)
            if any(self.word(i) == "=" for i in h[:max(k, 0)]):
                return None
        elif self.lang == "csharp":
            k = next((j for j in range(len(h)) if self.word(h[j]) == "(" and j and (self.tokens[h[j - 1]].kind == "word" or self.word(h[j - 1]) == ">")), -1)
        if k < 1 or self.word(h[k + 1]) != ")" if k + 1 < len(h) else True:
            return None
        tail = [self.word(i) for i in h[k + 2 :]]
        if self.lang == "java" and tail and tail[0] not in ("throws", "default"):
            return None
        if self.lang in SCRIPT and tail and tail[0] != ":":
            return None
        if self.lang == "csharp" and tail and tail[0] not in ("where", ":", "=>"):
            return None
        return k

    # The pass ------------------------------------------------------------------

    def define(self, name: str, kind: str, first: int, line: int, heading: list[int], graph: bool = True) -> int:
        scope = self.scopes[-1]
        one = Definition(".".join([*scope.names, name]), kind, self.tokens[first].line, line, min(self.tokens[heading[0]].line, self.tokens[first].line), None, scope.in_callable, graph)
        for s in self.scopes:
            if s.at is not None:
                around = self.out.definitions[s.at]
                around.inner = around.inner or one.start
        self.out.definitions.append(one)
        at = len(self.out.definitions) - 1
        kept, places = [], []
        for (called, n, by), i in zip(self.out.calls, self.call_at):  # calls met in the heading
            if i < first:
                kept.append((called, n, by)), places.append(i)
            elif called != name.lstrip("~") and not (self.lang == "cpp" and i in heading):
                kept.append((called, n, at if graph else by)), places.append(i)
        if len(kept) != len(self.out.calls) or self.call_at and self.call_at[-1] >= first:
            self.out.calls, self.call_at = kept, places
        return at

    def arrow(self, heading: list[int]) -> tuple[str, int] | None:
        """``const name = … =>`` or ``= function``, which is a chunk but no symbol."""
        h = self.bare(heading)
        if self.lang in SCRIPT and len(h) > 2 and self.word(h[0]) in ("const", "let") and self.tokens[h[1]].kind == "word":
            text = [self.word(i) for i in h]
            if "=" in text and (text[-1] == "=>" or "function" in text[text.index("=") :]):
                return text[1], h[0]
        return None

    def open_brace(self, i: int) -> None:
        h, scope, line = self.bare(self.heading), self.scopes[-1], self.tokens[i].line
        last = self.word(h[-1]) if h else ""
        inside = scope.in_callable
        if h:
            open_angle = self.lang in SCRIPT and sum((self.word(j) == "<") - (self.word(j) == ">") for j in h) > 0
            found = self.container(h) if scope.role != "group" and not open_angle else None
            if found:
                at = self.define(found[0], "container", found[1], line, self.heading)
                self.push("}", "container", at, (*scope.names, found[0]), inside)
                return
            value = open_angle or last in ("=", "(", ",", ":", "[", "?", "&&", "||", "??", "return", "...", "<", "|", "&", "=>") and not (last == ":" and self.word(h[0]) in ("case", "default", "public", "private", "protected"))
            if not (value and last != "=>") and (found := self.callable(h, False)) and not (self.lang == "go" and last in ("interface", "struct")):
                at = self.define(found[0], "callable", found[1], line, self.heading)
                self.push("}", "callable", at, (*scope.names, found[0]), True)
                return
            if value or self.lang == "go" and last in ("interface", "struct") and not (self.lang == "go" and self.word(h[0]) == "type"):
                held = self.arrow(self.heading) if scope.role == "code" else None
                at = self.define(held[0], "callable", held[1], line, self.heading, graph=False) if held else None
                role = "code" if last == "=>" else "object"
                self.push("}", role, at, scope.names, inside or at is not None, keep=True)
                return
            if self.lang == "go" and self.word(h[0]) == "type" and scope.role == "code" and not inside and len(h) > 1:
                at = self.define(self.word(h[1]), "container", h[0], line, self.heading, graph=False)
                self.push("}", "types", at, scope.names, inside)
                return
            if any(self.word(j) == "new" for j in h) and last == ")":  # a class without a name
                self.push("}", "container", None, scope.names, inside, keep=True)
                return
            held = self.arrow(self.heading) if scope.role == "code" else None
            if held:
                at = self.define(held[0], "callable", held[1], line, self.heading, graph=False)
                self.push("}", "code", at, scope.names, True, keep=True)
                return
            if self.lang == "csharp" and scope.role == "container" or scope.role == "group" or self.lang in SCRIPT and scope.role == "object":
                self.push("}", "code", None, scope.names, inside, keep=scope.role != "container")
                return
        elif scope.role in ("group", "object"):
            self.push("}", "object", None, scope.names, inside, keep=True)
            return
        role = "callable" if scope.role == "callable" else "code"
        self.push("}", role, None, scope.names, inside)

    def push(self, close: str, role: str, at: int | None, names: tuple[str, ...], in_callable: bool, keep: bool = False) -> None:
        self.scopes.append(_Scope(close, role, self.heading if keep else [], at, names, in_callable))
        self.heading = []

    def call(self, i: int) -> None:
        """A name right before the parenthesis at ``i``, or before generics that end there, is called."""
        k, t = i - 1, self.tokens
        if k >= 0 and t[k].text == "!" and self.lang == "rust":
            k -= 1
        elif k >= 0 and t[k].text == "?." and self.lang in SCRIPT:
            k -= 1
        elif k >= 0 and t[k].text == ">":
            angle, j = 0, k
            while j >= 0 and k - j < 64:
                angle += (t[j].text == ">") - (t[j].text == "<")
                j -= 1
                if not angle or t[j].text in (";", "{", "}"):
                    break
            if angle:
                return
            k = j - (t[j].text == "::") if j >= 0 else -1
        if k < 0 or t[k].kind != "word" or t[k].text in self.no_call and not (k and t[k - 1].text in (".", "::", "?.")):
            return
        scope = self.scopes[-1]
        if scope.role == "types" or scope.role == "container" and not any(self.word(h) in ("=", "=>", "@") for h in self.heading):
            return  # a method without a body, or a constant
        if self.lang == "csharp" and scope.close == "]" and not self.bare(scope.heading[:-1]):
            return  # an attribute
        j = k - 1
        while j >= 1 and t[j].text in (".", "::", "?.") and t[j - 1].kind == "word":
            j -= 2
        before = t[j] if j >= 0 else None
        fresh = before is not None and before.text == "new"
        opens = before is not None and (before.text in EXPRESSION or before.text == "void" and self.lang in SCRIPT)
        if before is not None and before.kind == "word" and not fresh and not opens and j == k - 1:
            newline = before.line < t[k].line and (self.lang in SCRIPT or self.lang == "go")
            if not newline:
                return  # a declared name, or a function's
        if before is not None and before.text == "@" and self.lang == "java":
            return
        if fresh and self.lang == "cpp":
            return  # creates, but is no call there
        self.add_call(k)

    def add_call(self, k: int) -> None:
        by = next((s.at for s in reversed(self.scopes) if s.at is not None and self.out.definitions[s.at].graph), -1)
        self.out.calls.append((self.tokens[k].text, self.tokens[k].line, by))
        self.call_at.append(k)

    def end_statement(self, i: int) -> None:
        h, scope, line = self.bare(self.heading), self.scopes[-1], self.tokens[i].line
        if h and scope.role in ("container", "code"):
            first = self.container(h) if self.lang == "rust" and self.word(h[-1]) != "=" else None
            if first and not scope.in_callable:
                self.define(first[0], "container", first[1], line, self.heading)
            elif self.lang != "rust" and scope.role == "container" and (found := self.callable(h, True)):
                self.define(found[0], "callable", found[1], line, self.heading)
            elif self.lang in SCRIPT and scope.role == "code" and (held := self.arrow_line(h)):
                self.define(held[0], "callable", held[1], line, self.heading, graph=False)
            elif self.lang == "go" and self.word(h[0]) == "type" and len(h) > 1 and scope.role == "code":
                self.define(self.word(h[1]), "container", h[0], line, self.heading, graph=False)
        self.heading = []

    def arrow_line(self, h: list[int]) -> tuple[str, int] | None:
        """An arrow function without braces."""
        text = [self.word(i) for i in h]
        if text[0] in ("const", "let") and len(h) > 3 and text[2] == "=" and "=>" in text and "}" not in text:
            return text[1], h[0]
        return None

    def parse(self) -> Parsed:
        for i, t in enumerate(self.tokens):
            scope = self.scopes[-1]
            if self.heading and t.line > self.tokens[i - 1].line and self.ends_at_line(scope, t):
                self.end_statement(i - 1)
            if t.kind == "mark" and t.text == "{":
                if self.lang == "csharp" or self.lang == "java":
                    self.created(i)
                self.open_brace(i)
            elif t.kind == "mark" and t.text in ("(", "["):
                if t.text == "(":
                    self.call(i)
                self.heading.append(i)
                self.push(")" if t.text == "(" else "]", "group", None, scope.names, scope.in_callable, keep=True)
            elif t.kind == "mark" and t.text in (")", "]", "}"):
                self.close(i)
            elif t.kind == "mark" and (t.text == ";" or t.text == "," and scope.role == "object"):
                if scope.role != "group":
                    self.end_statement(i)
            elif t.kind == "mark" and t.text == ":" and self.lang == "cpp" and self.heading and self.word(self.heading[-1]) in ("public", "private", "protected"):
                self.heading = []
            else:
                self.heading.append(i)
        while len(self.scopes) > 1:
            s = self.scopes.pop()
            if s.at is not None:
                one = self.out.definitions[s.at]
                one.end = max(one.end, self.tokens[-1].line if self.tokens else one.start)
        return self.out

    def ends_at_line(self, scope: _Scope, following: Token) -> bool:
        """Whether a statement ends with its line, where no semicolon says so."""
        last = self.tokens[self.heading[-1]]
        if scope.role == "group" or last.kind == "mark" and last.text not in (")", "]", "}"):
            return False
        if self.lang == "go":
            return True
        return (
            self.lang in SCRIPT and scope.role != "object" and following.kind == "word" and following.text not in CONTINUES
            and last.text not in GOES_ON and self.word(self.heading[0]) != "@"
        )

    def created(self, i: int) -> None:
        """C#'s ``new Name { … }`` creates without a parenthesis."""
        if self.lang == "csharp" and i >= 2 and self.tokens[i - 1].kind == "word" and self.tokens[i - 2].text == "new":
            self.add_call(i - 1)

    def close(self, i: int) -> None:
        mark = self.tokens[i].text
        at = next((k for k in range(len(self.scopes) - 1, 0, -1) if self.scopes[k].close == mark), None)
        if at is None:
            return
        if mark == "}" and self.heading and len(self.scopes) - 1 == at:
            self.end_statement(i)
        while len(self.scopes) > at:
            s = self.scopes.pop()
            if s.at is not None:
                self.out.definitions[s.at].end = self.tokens[i].line
        self.heading = s.heading
        if mark == "]" or mark == ")" or s.heading:
            self.heading.append(i)


def parse(lang: str, text: str) -> Parsed:
    """Definitions in the order of their headings, and calls in the order of the text."""
    return _Parser(lang, text).parse()

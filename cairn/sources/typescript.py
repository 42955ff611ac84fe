"""A tolerant reader of TypeScript and JavaScript sources: declarations, imports, exports, heritage, calls, guards.

No compiler is at hand, so a tokenizer (comments, strings, templates, regular expressions) feeds one
pass over the tokens that keeps a stack of open braces and what each belongs to. It doesn't check
types or grammar; unbalanced brackets and unterminated strings become diagnostics. Offsets count
UTF-16 units, as editors do. All of it is behind `parsed`, one Arrow pass over (id, path, text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*.*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<word>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[{}()\[\];,.:<>=!&|?+*/%^~@-])|(?P<other>.)""",
    re.S,
)
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "export", "default", "accessor"}
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super", "import", "async", "class", "constructor", "throw", "else", "do", "in", "of", "instanceof", "void", "delete", "yield", "case"}
#: Words that are no identifiers, beside the keywords.
LITERALS = {"this", "true", "false", "null", "let", "const", "var", "if", "as", "is"}
# Fields that hold a state, literals that name one, calls that round, and identifiers of a pattern at most.
STATE_FIELD, STATE_LITERAL = re.compile(r"(?:status|state)\Z", re.I), re.compile(r"[A-Za-z0-9_-]{1,100}\Z")
ROUNDING = {"Math.ceil", "Math.floor", "Math.round", "Math.trunc"}
MOST_IDENTIFIERS = 50
PUBLISHING = {"emit": "emit", "emitAsync": "emit", "publish": "publish", "publishAll": "publish"}
HANDLING = {"OnEvent", "EventsHandler"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int


@dataclass
class Source:
    """What a file declares and does; ranges are offsets in code units."""

    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    heritage: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    decorators: list[dict] = field(default_factory=list)
    injections: list[dict] = field(default_factory=list)
    guards: list[dict] = field(default_factory=list)
    roundings: list[dict] = field(default_factory=list)
    states: list[dict] = field(default_factory=list)
    transitions: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    technical: list[dict] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)


def tokens(text: str) -> tuple[list[Token], list[str]]:
    """Tokens without space and comments (documentation comments stay), and diagnostics."""
    out: list[Token] = []
    faults: list[str] = []
    at = 0
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            if end < 0:
                faults.append("unterminated template")
                end = len(text)
            out.append(Token("string", text[at:end], at, end))
            at = end
            continue
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and _regex_may_start(out):
            m = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, at)
            if m:
                out.append(Token("string", m[0], at, m.end()))
                at = m.end()
                continue
        if text.startswith("/*", at) and text.find("*/", at + 2) < 0:
            faults.append("unterminated comment")
            break
        m = TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "other" and m[0] in "'\"":
            faults.append("unterminated string")
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0], at, m.end()))
        at = m.end()
    return out, faults


def _template_end(text: str, at: int) -> int:
    depth, at = 0, at + 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return at + 1
        elif c == "$" and text[at + 1 : at + 2] == "{":
            depth, at = depth + 1, at + 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            at = _template_end(text, at) - 1
            if at < 0:
                return -1
        at += 1
    return -1


def _regex_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.text in KEYWORDS or last.kind == "op" and last.text not in (")", "]", "}")


class Reader:
    def __init__(self, text: str):
        self.text = text
        every, faults = tokens(text)
        self.docs, self.members = {}, set()
        self.t: list[Token] = []
        held = None
        for x in every:
            if x.kind == "doc":
                held = x
            else:
                if held is not None:
                    self.docs[len(self.t)] = held
                    held = None
                self.t.append(x)
        self.source = Source(diagnostics=list(faults))
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """Index of the bracket that closes each opening one; an unclosed one reaches to the end."""
        close, pairs, stack = {"(": ")", "[": "]", "{": "}"}, {}, []
        for k, x in enumerate(self.t):
            if x.kind != "op":
                continue
            if x.text in close:
                stack.append(k)
            elif x.text in close.values():
                if stack and close[self.t[stack[-1]].text] == x.text:
                    pairs[stack.pop()] = k
                else:
                    self.source.diagnostics.append(f"unexpected {x.text}")
        for k in stack:
            self.source.diagnostics.append(f"unclosed {self.t[k].text}")
            pairs[k] = len(self.t) - 1
        return pairs

    def text_at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def read(self) -> Source:
        self._block(0, len(self.t), [], None)
        self._flow()
        return self.source

    # Declarations.

    def _block(self, at: int, end: int, containers: list[str], member_of: str | None) -> None:
        """Statements, or members where member_of names the kind of the surrounding declaration."""
        while at < end:
            at = max(at + 1, self._statement(at, end, containers, member_of))

    def _statement(self, at: int, end: int, containers: list[str], member_of: str | None) -> int:
        begin, own, exported, default, visibility = at, [], False, False, None
        while at < end:
            x = self.t[at]
            if x.text == "@" and self.t[at + 1 : at + 2] and self.t[at + 1].kind == "word":
                at, name, args = self._decorator(at)
                own.append((name, args))
            elif x.kind == "word" and x.text in MODIFIERS and self.text_at(at + 1) not in ("(", "=", ":", ";", ",", "}", "?", "<", "."):
                exported |= x.text == "export"
                default |= x.text == "default"
                visibility = x.text if x.text in ("public", "private", "protected") else visibility
                at += 1
                if exported and self.text_at(at) in ("{", "*"):
                    return self._export_list(begin, at, end)
                if exported and self.text_at(at) == "type" and self.text_at(at + 1) in ("{", "*"):
                    return self._export_list(begin, at + 1, end, True)
            else:
                break
        if at >= end:
            return end
        word = self.text_at(at)
        if member_of is None and word == "import" and self.text_at(at + 1) != "(":
            return self._import(at, end)
        if word in ("class", "interface", "enum", "type", "function", "namespace") or word == "const" and self.text_at(at + 1) == "enum":
            done = self._declaration(begin, at, end, containers, exported, default, own)
            if done > 0:
                return done
        if member_of is None and word in ("const", "let", "var"):
            return self._variable(begin, at, end, containers, exported)
        if member_of in ("class", "interface"):
            return self._member(begin, at, end, containers, visibility, own)
        if exported and default:
            self._export("default", self.text_at(at) if self.t[at : at + 1] and self.t[at].kind == "word" else None, "default", None, False, begin)
        return self._expression(at, end, containers)

    def _declaration(self, begin: int, at: int, end: int, containers: list[str], exported: bool, default: bool, decorators: list) -> int:
        word = self.text_at(at)
        at += 2 if word == "const" else 1
        if self.text_at(at) == "*":
            at += 1
        if at >= end or self.t[at].kind != "word" or self.t[at].text in ("extends", "implements"):
            return 0
        name, kind = self.t[at].text, {"const": "enum", "type": "type_alias", "namespace": None}.get(word, word)
        if word == "type" and self.text_at(at + 1) not in ("=", "<"):
            return 0
        open_ = self._body(at + 1, end)
        stop = self.match.get(open_, open_) + 1 if open_ is not None else self._end_of(at, end)
        if word == "type":
            open_, stop = None, self._end_of(at, end)
        symbol = None
        if kind:
            symbol = self._symbol(begin, stop, open_ if open_ is not None else stop, name, kind, containers, exported, default, None)
            self._attach(decorators, symbol)
            if exported:
                self._export("default" if default else "declaration", name, "default" if default else name, None, word in ("interface", "type"), begin)
        inner = [*containers, name]
        if word in ("class", "interface") and open_ is not None:
            self._heritage(at + 1, open_, symbol)
            self._block(open_ + 1, stop - 1, inner, word)
        elif kind == "enum" and open_ is not None:
            self._enum(open_, stop, symbol)
        elif word == "function":
            if open_ is not None:
                self._block(open_ + 1, stop - 1, inner, None)
        elif word == "namespace" and open_ is not None:
            self._block(open_ + 1, stop - 1, inner, None)
        return stop

    def _member(self, begin: int, at: int, end: int, containers: list[str], visibility: str | None, decorators: list) -> int:
        if self.text_at(at) in ("get", "set") and self.text_at(at + 1) not in ("(", "=", ":", ";", "?"):
            at += 1
        if self.text_at(at) == "*":
            at += 1
        if at >= end:
            return end
        name = self.text_at(at).strip("'\"")
        after = at + 1
        if self.text_at(after) in ("?", "!"):
            after += 1
        if self.text_at(after) == "<":
            after = self._angle(after, end)
        if self.t[at].kind in ("word", "string") and self.text_at(after) == "(":
            params = self.match[after]
            open_ = self._body(params + 1, end, member=True)
            stop = self.match[open_] + 1 if open_ is not None else self._end_of(params, end)
            symbol = self._symbol(begin, stop, open_ if open_ is not None else stop, name, "method", containers, False, False, visibility or "public")
            self._attach(decorators, symbol)
            if name == "constructor":
                self._injections(after, params, symbol)
            self._expression_range(after + 1, params, containers)
            if open_ is not None:
                self._block(open_ + 1, stop - 1, containers, None)
            return stop
        stop = self._end_of(at, end)
        self.members.add(at)
        self._expression_range(at, stop, containers)
        return stop

    def _variable(self, begin: int, at: int, end: int, containers: list[str], exported: bool) -> int:
        stop = self._end_of(at, end)
        name, k = self.text_at(at + 1), at + 2
        while k < stop and self.t[k].text != "=":
            k = self.match.get(k, k) + 1
        if k < stop and self.t[at + 1].kind == "word" and self._is_function(k + 1, stop):
            self._symbol(begin, stop, self._arrow_body(k + 1, stop), name, "function", containers, exported, False, None)
        if exported and self.t[at + 1 : at + 2] and self.t[at + 1].kind == "word":
            self._export("declaration", name, name, None, False, begin)
        self._expression_range(k, stop, containers)
        return stop

    def _is_function(self, at: int, end: int) -> bool:
        at += self.text_at(at) == "async"
        if self.text_at(at) == "function":
            return True
        if self.text_at(at) == "<":
            at = self._angle(at, end)
        if self.text_at(at) == "(":
            k = self.match[at] + 1
            while k < end and self.t[k].text not in ("=>", ";", "=", "{", ","):
                k = self.match.get(k, k) + 1
            return self.text_at(k) == "=>" or self.text_at(k) == "{" and self.text_at(self.match[k] + 1) == "=>"
        return self.t[at : at + 1] != [] and self.t[at].kind == "word" and self.text_at(at + 1) == "=>"

    def _arrow_body(self, at: int, end: int) -> int:
        while at < end and self.t[at].text not in ("=>", "{"):
            at = self.match.get(at, at) + 1
        return at

    def _body(self, at: int, end: int, member: bool = False) -> int | None:
        """The brace that opens a declaration's body: the first outside of brackets and of type literals; None before the statement ends."""
        typed = False
        while at < end:
            x = self.t[at].text
            if x == ";":
                return None
            if x == "{":
                if not typed:
                    return at
                at, typed = self.match[at] + 1, False
                continue
            if member and x in ("}", ",") or member and at > 0 and "\n" in self.text[self.t[at - 1].end : self.t[at].at] and self.t[at].kind == "word" and self.t[at - 1].text not in (":", "|", "&"):
                return None
            typed = x in (":", "|", "&", "<")
            at = self.match.get(at, at) + 1 if x in ("(", "[") else at + 1
        return None

    def _end_of(self, at: int, end: int) -> int:
        """After the statement: its semicolon, or a line break that can't go on."""
        while at < end:
            x = self.t[at]
            if x.text == ";":
                return at + 1
            at = self.match.get(at, at) + 1 if x.text in ("(", "[", "{") else at + 1
            if at < end and "\n" in self.text[self.t[at - 1].end : self.t[at].at] and self.t[at].text not in (".", "?.", "?", ":", "|", "&", "=", "=>", "+", "-", ")", "]", ",", "(", "[", "{", "<", ">", "as") and self.t[at - 1].text not in ("=", "=>", ",", "(", "[", "{", "|", "&", "+", "-", "?", ":", "."):
                return at
        return end

    def _angle(self, at: int, end: int) -> int:
        depth = 0
        while at < end:
            depth += {"<": 1, ">": -1}.get(self.t[at].text, 0)
            at = self.match.get(at, at) + 1
            if depth == 0:
                return at
        return end

    def _decorator(self, at: int) -> tuple[int, str, tuple[int, int] | None]:
        at += 1
        name = self.text_at(at)
        at += 1
        while self.text_at(at) == ".":
            name, at = f"{name}.{self.text_at(at + 1)}", at + 2
        if self.text_at(at) == "(":
            return self.match[at] + 1, name, (at + 1, self.match[at])
        return at, name, None

    def _symbol(self, begin: int, stop: int, body: int, name: str, kind: str, containers: list[str], exported: bool, default: bool, visibility: str | None) -> dict:
        first, last = self.t[begin].at, self.t[min(stop, len(self.t)) - 1].end
        cut = self.t[body].at if body < len(self.t) else last
        doc = self.docs.get(begin)
        lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in doc.text[3:-2].strip().split("\n")] if doc else None
        symbol = {"kind": kind, "name": name, "qualified_name": ".".join([*containers, name]), "exported": exported, "default_export": default, "visibility": visibility, "signature": " ".join(self.text[first:cut].split()).removesuffix("=>").rstrip(" ;{"), "documentation": "\n".join(lines).strip() if lines else None, "start_offset": self._units(first), "end_offset": self._units(last), "start_line": self.text.count("\n", 0, first) + 1}
        self.source.symbols.append(symbol)
        return symbol

    def _units(self, at: int) -> int:
        return at if self.text.isascii() else len(self.text[:at].encode("utf-16-le", "surrogatepass")) // 2

    def _attach(self, decorators: list, symbol: dict) -> None:
        for name, args in decorators:
            words = [self.t[k].text for k in range(*args) if self.t[k].kind in ("word", "string")] if args else []
            self.source.decorators.append({"symbol": symbol["qualified_name"], "name": name, "arguments": words})
            if name.split(".")[-1] in HANDLING:
                for w in words:
                    self.source.events.append({"event": w.strip("'\"`"), "operation": "handle", "offset": symbol["start_offset"]})

    def _heritage(self, at: int, end: int, symbol: dict) -> None:
        kind = None
        while at < end:
            x = self.t[at].text
            if x in ("extends", "implements"):
                kind = x
            elif x == "<":
                at = self._angle(at, end) - 1
            elif kind and self.t[at].kind == "word":
                name, start = x, at
                while self.text_at(at + 1) == ".":
                    name, at = f"{name}.{self.text_at(at + 2)}", at + 2
                self.source.heritage.append({"source": symbol["qualified_name"], "kind": kind, "target": name, "offset": self._units(self.t[start].at)})
            at += 1

    def _enum(self, open_: int, stop: int, symbol: dict) -> None:
        expect = True
        k = open_ + 1
        while k < stop - 1:
            x = self.t[k]
            if expect and x.kind in ("word", "string"):
                last = k  # the member with its value
                while last + 1 < stop - 1 and self.t[last + 1].text != ",":
                    last = min(self.match.get(last + 1, last + 1), stop - 2)
                self.source.states.append({"state_set": symbol["name"], "state": x.text.strip("'\""), "how": "enum_member", "confidence_pct": 100, "offset": self._units(x.at), "end_offset": self._units(self.t[last].end)})
                expect = False
            elif x.text == ",":
                expect = True
            k = self.match.get(k, k) + 1

    def _injections(self, open_: int, close: int, symbol: dict) -> None:
        """Parameters of a constructor: their name and type."""
        k = open_ + 1
        while k < close:
            if self.t[k].text == "@":
                k, name, args = self._decorator(k)
                continue
            if self.t[k].kind == "word" and self.t[k].text not in MODIFIERS and self.text_at(k + 1) in (":", "?"):
                at = k + 1 + (self.text_at(k + 1) == "?")
                kind = self.text_at(at + 1)
                while self.text_at(at + 2) == ".":
                    kind, at = f"{kind}.{self.text_at(at + 3)}", at + 2
                self.source.injections.append({"symbol": symbol["qualified_name"], "parameter": self.t[k].text, "type": kind})
                while k < close and self.t[k].text != ",":
                    k = self._angle(k, close) if self.t[k].text == "<" else self.match.get(k, k) + 1
            k += 1

    # Imports and exports.

    def _import(self, at: int, end: int) -> int:
        begin, stop = at, self._end_of(at, end)
        at += 1
        type_only = self.text_at(at) == "type" and self.text_at(at + 1) not in ("from", ",")
        at += type_only
        row = {"module": None, "default_import": None, "namespace_import": None, "named": [], "type_only": type_only, "offset": self._units(self.t[begin].at)}
        while at < stop:
            x = self.t[at]
            if x.kind == "string":
                row["module"] = x.text[1:-1]
                break
            if x.text == "*":
                row["namespace_import"], at = self.text_at(at + 2), at + 3
                continue
            if x.text == "{":
                row["named"] = [{"imported": a, "local": b, "type_only": type_only or t} for a, b, t in self._names(at)]
                at = self.match[at]
            elif x.kind == "word" and x.text != "from":
                row["default_import"] = x.text
            at += 1
        if row["module"] is not None:
            self.source.imports.append(row)
        return stop

    def _names(self, open_: int) -> list[tuple[str, str, bool]]:
        out: list[tuple[str, str, bool]] = []
        own: list[str] = []
        for k in range(open_ + 1, self.match[open_] + 1):
            if self.t[k].text in (",", "}"):
                t = len(own) > 1 and own[0] == "type" and own[1] != "as"
                own = own[1:] if t else own
                if own:
                    out.append((own[0], own[-1], t))
                own = []
            else:
                own.append(self.t[k].text)
        return out

    def _export_list(self, begin: int, at: int, end: int, type_only: bool = False) -> int:
        stop = self._end_of(at, end)
        module = next((self.t[k].text[1:-1] for k in range(at, stop) if self.t[k].kind == "string"), None)
        if self.text_at(at) == "*":
            name = self.text_at(at + 2) if self.text_at(at + 1) == "as" else None
            self._export("namespace" if name else "all", None, name, module, type_only, begin)
        else:
            for a, b, t in self._names(at):
                self._export("re_export" if module else "named", a, b, module, type_only or t, begin)
        return stop

    def _export(self, kind: str, local: str | None, name: str | None, module: str | None, type_only: bool, at: int) -> None:
        self.source.exports.append({"kind": kind, "local": local, "exported": name, "module": module, "type_only": type_only, "offset": self._units(self.t[at].at)})

    # Expressions.

    def _expression(self, at: int, end: int, containers: list[str]) -> int:
        x = self.t[at]
        if x.text == "if" and self.text_at(at + 1) == "(":
            self._guard(at, end)
            close = self.match[at + 1]
            self._expression_range(at + 2, close, containers)
            return close + 1
        if x.text == "{":
            self._block(at + 1, self.match[at], containers, None)
            return self.match[at] + 1
        stop = self._end_of(at, end)
        self._expression_range(at, stop, containers)
        return stop

    def _expression_range(self, at: int, end: int, containers: list[str]) -> None:
        """Calls, assignments of states, and what is declared inside."""
        while at < end:
            x = self.t[at]
            if x.text == "{" and self.text_at(at - 1) in ("=>", ")"):
                self._block(at + 1, self.match[at], containers, None)
                at = self.match[at] + 1
                continue
            if x.text == "class" and self.text_at(at - 1) not in (".", "?."):
                done = self._declaration(at, at, end, containers, False, False, [])
                if done > at:
                    at = done
                    continue
            if x.kind == "word" and (x.text in ("const", "let", "var") or x.text == "if" and self.text_at(at + 1) == "(") and at > 0 and self.text_at(at - 1) in ("{", "}", ";"):
                at = max(at + 1, self._statement(at, end, containers, None))
                continue
            if x.kind == "word" and (x.text not in KEYWORDS or x.text in ("super",)) and self.text_at(at - 1) not in (".", "?.", "function", "@"):
                at = self._chain(at, end)
                continue
            at += 1

    def _chain(self, at: int, end: int) -> int:
        """A name and the members after it; a call where an argument list follows."""
        start, parts = at, [self.t[at].text]
        while self.text_at(at + 1) in (".", "?.") and at + 2 < end and self.t[at + 2].kind == "word":
            parts.append(self.t[at + 2].text)
            at += 2
        after = at + 1
        if self.text_at(after) == "(" and self.text_at(start - 1) != "new" and after < end:
            self.source.calls.append({"callee": ".".join(parts), "receiver": ".".join(parts[:-1]) or None, "member": parts[-1], "offset": self._units(self.t[start].at)})
            if parts[-1] in PUBLISHING:
                first = self.text_at(after + 2) if self.text_at(after + 1) == "new" else self.text_at(after + 1)
                self.source.events.append({"event": first.strip("'\"`"), "operation": PUBLISHING[parts[-1]], "offset": self._units(self.t[start].at)})
        return after

    def _guard(self, at: int, end: int) -> None:
        """What an if does where its condition holds: it throws, returns, calls or assigns; of several the least nested, then the first."""
        close = self.match[at + 1]
        outcome = self._outcome(close + 1)
        if outcome:
            self.source.guards.append({"condition": self._identifiers(at + 2, close), "operation": self._operator(at + 2, close), "target": self._condition_target(at + 2, close), **outcome, "offset": self._units(self.t[at].at), "end_offset": self._units(self.t[self._statement_end(at) - 1].end)})

    def _identifiers(self, at: int, end: int) -> list[str]:
        words = {self.t[k].text for k in range(at, end) if self.t[k].kind == "word" and self.t[k].text not in KEYWORDS and self.t[k].text not in LITERALS}
        return sorted(words)[:MOST_IDENTIFIERS]

    def _outcome(self, at: int) -> dict | None:
        found = []
        end = self._statement_end(at)
        inner = (at + 1, end - 1) if self.text_at(at) == "{" else (at, end)
        k = inner[0]
        while k < inner[1]:
            stop = min(max(self._statement_end(k), k + 1), inner[1])
            own = self._outcome_of(k, stop)
            if own:
                found.append(own)
                if own[0] == 0:
                    break
            k = stop
        if not found:
            return None
        _, kind, identifiers, operation, target = min(found, key=lambda x: x[0])
        return {"outcome": identifiers, "outcome_kind": kind, "outcome_operation": operation, "outcome_target": target}

    def _outcome_of(self, at: int, stop: int) -> tuple | None:
        """How deep the outcome of a statement lies, its kind, identifiers, operation and target."""
        word = self.text_at(at)
        if word in ("throw", "return"):
            return 0, word, self._identifiers(at + 1, stop), None, None
        deep = 1 + (word == "await")
        first = at + (word == "await")
        if self.t[first].kind == "word" and (word := self.text_at(first)) not in ("if", "for", "while", "switch", "try", "do", "const", "let", "var", "function", "class", "else"):
            parts, after = self._names_from(first)
            if self.text_at(after) == "(":
                last = self.match[after]
                return deep, "call", self._identifiers(first, last), ".".join(parts), None
            compound = self.text_at(after) + self.text_at(after + 1) if self.text_at(after) in ("+", "-", "*", "/", "%", "&", "|", "^") else self.text_at(after)
            if compound[-1:] == "=" and self.text_at(after + len(compound)) != "=":
                return deep, "assignment", self._identifiers(first, stop), compound, ".".join(parts)
        # inside of other statements: the first that throws, returns or calls
        for k in range(at + 1, stop):
            if self.text_at(k) in ("throw", "return"):
                return 3, self.text_at(k), self._identifiers(k + 1, min(self._end_of(k, stop), stop)), None, None
            if self.t[k].kind == "word" and self.text_at(k) not in KEYWORDS and self.text_at(k + 1) == "(" and k + 1 < stop:
                begin = k
                while self.text_at(begin - 1) in (".", "?.") and begin - 2 > at:
                    begin -= 2
                return 3, "call", self._identifiers(begin, self.match[k + 1]), ".".join(self._names_from(begin)[0]), None
        return None

    def _names_from(self, at: int) -> tuple[list[str], int]:
        """The names of a chain, and the place after it."""
        parts = [self.text_at(at)]
        while self.text_at(at + 1) in (".", "?.") and at + 2 < len(self.t) and self.t[at + 2].kind == "word":
            parts.append(self.text_at(at + 2))
            at += 2
        return parts, at + 1

    def _operator(self, at: int, end: int) -> str | None:
        """The operator of a condition: ! in front of one operand, or the loosest one between operands."""
        depth, found = at, None
        order = ["||", "??", "&&", "|", "^", "&", "===", "!==", "==", "!=", "<=", ">=", "<", ">", "+", "-", "*", "/", "%"]
        while depth < end:
            text, k = self.text_at(depth), depth
            if text in "|&=!<>?^+-*/%" and self.t[depth].kind == "op" and depth > at or text == "!" and self.text_at(depth + 1) == "=":
                while depth + 1 < end and self.t[depth + 1].text in "=|&?" and self.t[depth + 1].at == self.t[depth].end:
                    depth += 1
                    text += self.text_at(depth)
                if text in order and (found is None or order.index(text) < order.index(found)):
                    found = text
            depth = self.match.get(k, depth) + 1
        return found or ("!" if self.text_at(at) == "!" else None)

    def _condition_target(self, at: int, end: int) -> str | None:
        """The name that a condition begins with, inside of parentheses and negations."""
        while at < end and (self.text_at(at) == "!" or self.text_at(at) == "(" and self.match[at] == end - 1):
            end -= self.text_at(at) == "("
            at += 1
        return ".".join(self._names_from(at)[0]) if at < end and self.t[at].kind == "word" and self.text_at(at) not in KEYWORDS - {"super"} else None

    # States: what an assignment makes of a state, and the guard that tells the state before it.

    def _statement_end(self, at: int) -> int:
        """After the statement that begins here, with its else, catch and finally parts."""
        n = len(self.t)
        while at < n:
            word = self.text_at(at)
            if word == "{":
                return self.match[at] + 1
            if word in ("if", "for", "while", "switch", "with", "catch") and self.text_at(at + 1 + (self.text_at(at + 1) == "await")) == "(":
                body = self.match[at + 1 + (self.text_at(at + 1) == "await")] + 1
                if word != "if":
                    at = body
                    continue
                after = self._statement_end(body)
                if self.text_at(after) != "else":
                    return after
                at = after + 1
                continue
            if word in ("try", "finally", "do", "catch") and self.text_at(at + 1) == "{":
                after = self.match[at + 1] + 1
                if word == "do":
                    return self._end_of(after, n)
                if self.text_at(after) not in ("catch", "finally"):
                    return after
                at = after
                continue
            return self._end_of(at, n)
        return n

    def _flow(self) -> None:
        """Transitions: assignments of a status or state, with the state that the nearest guard around them names, and roundings.

        One walk over the tokens keeps the branches and function bodies that are open. The condition of an
        if holds for all that its branch contains, up to the function around it.
        """
        opened: dict[int, list[tuple[int, str, tuple[int, int]]]] = {}
        for k, x in enumerate(self.t):
            if x.kind == "word" and x.text == "if" and self.text_at(k + 1) == "(" and self.text_at(k - 1) not in (".", "?."):
                close = self.match[k + 1]
                opened.setdefault(close + 1, []).append((self._statement_end(close + 1), "if", (k + 2, close)))
            elif x.text == "=>":
                opened.setdefault(k + 1, []).append((self.match[k + 1] + 1 if self.text_at(k + 1) == "{" else self._argument_end(k + 1), "function", (k, k)))
            elif x.kind == "word" and x.text == "function" or x.text == "{" and self._is_method(k):
                body = k if x.text == "{" else self._body(k, len(self.t))
                if body is not None:
                    opened.setdefault(body, []).append((self.match.get(body, body) + 1, "function", (k, k)))
        around: list[tuple[int, str, tuple[int, int]]] = []
        for k, x in enumerate(self.t):
            while around and around[-1][0] <= k:
                around.pop()
            around += sorted(opened.get(k, []), key=lambda y: -y[0])
            if x.text == "=" and self.text_at(k + 1) not in ("=",) and self.t[k - 1 : k] and self.t[k - 1].kind == "word" and k:
                self._assignment(k, around)
            elif x.text == "(" and k and self.t[k - 1].kind == "word":
                self._rounding(k)

    def _is_method(self, k: int) -> bool:
        """Whether a brace opens the body of a method, and not that of a statement."""
        if self.text_at(k - 1) != ")":
            return False
        open_ = self._opening().get(k - 1, 0)
        return open_ > 0 and self.t[open_ - 1].kind == "word" and self.text_at(open_ - 1) not in ("if", "for", "while", "switch", "catch", "with", "constructor", "await")

    def _opening(self) -> dict[int, int]:
        if not hasattr(self, "_openings"):
            self._openings = {b: a for a, b in self.match.items()}
        return self._openings

    def _argument_end(self, at: int) -> int:
        while at < len(self.t) and self.text_at(at) not in (",", ";", ")", "]", "}"):
            at = self.match.get(at, at) + 1
        return at

    def _assigned_name(self, k: int) -> tuple[list[str], int] | None:
        """The names left of an =, from the last receiver that has none, and where they begin; None where the = declares something."""
        at, parts = k - 1, [self.text_at(k - 1)]
        while self.text_at(at - 1) in (".", "?.") and at >= 2 and self.t[at - 2].kind == "word":
            at -= 2
            parts.insert(0, self.text_at(at))
        if self.text_at(at - 1) in (".", "?."):  # behind a call or an index
            return parts, at
        if len(parts) == 1 and (self.text_at(at - 1) in ("const", "let", "var", "type", ":", "|", "&", "<", "readonly", "static", "public", "private", "protected", "declare", "override", "@") or self._declares(at)):
            return None
        return (parts[1:] if parts[0] == "super" else parts), at

    def _declares(self, at: int) -> bool:
        """Whether a bare name in front of = is a member of a class, a parameter, or one of several variables."""
        if at in self.members:
            return True
        k, depth = at - 1, 0
        while k >= 0 and self.text_at(k) not in (";", "{", "}"):
            if k in self._opening():
                k = self._opening()[k]
            elif self.text_at(k) == "(":
                after = self.text_at(self.match[k] + 1)
                return after in ("=>", "{", ":") and self.text_at(k - 1) not in ("if", "for", "while", "switch", "catch")
            elif self.text_at(k) in ("const", "let", "var"):
                return self.text_at(at - 1) == ","
            k -= 1
        return False

    def _operand(self, at: int, end: int) -> tuple[list[str] | str | None, int]:
        """The names of a chain, or the text of a literal; and the place after it."""
        if at >= end:
            return None, at
        if self.t[at].kind == "string":
            text = self.t[at].text
            return (None if text[0] == "/" or text[0] == "`" and "${" in text else text[1:-1]), at + 1
        if self.t[at].kind == "word" and (self.text_at(at) not in KEYWORDS or self.text_at(at) == "super"):
            parts, after = self._names_from(at)
            return parts, after
        return None, at

    def _state(self, operand: list[str] | str | None, target: str, how: str) -> dict | None:
        if isinstance(operand, list) and len(operand) > 1:
            return {"state_set": ".".join(operand[:-1]), "state": operand[-1], "how": how, "confidence_pct": 100}
        if isinstance(operand, str) and STATE_LITERAL.match(operand):
            return {"state_set": target, "state": operand, "how": how, "confidence_pct": 90}
        return None

    def _guarded(self, condition: tuple[int, int], target: str) -> dict | None:
        """The state that a condition names for target: target == state, either way round, and nothing else."""
        left, at = self._operand(*condition)
        n = 0
        while self.text_at(at + n) == "=" and (n == 0 or self.t[at + n].at == self.t[at + n - 1].end):
            n += 1
        if n not in (2, 3) or at + n >= condition[1]:
            return None
        right, after = self._operand(at + n, condition[1])
        if after != condition[1]:
            return None
        name = lambda x: ".".join(x) if isinstance(x, list) else None
        if name(left) == target:
            return self._state(right, target, "condition")
        return self._state(left, target, "condition") if name(right) == target else None

    def _assignment(self, k: int, around: list[tuple[int, str, tuple[int, int]]]) -> None:
        named = self._assigned_name(k)
        if named is None or not named[0] or not STATE_FIELD.match(named[0][-1]):
            return
        target = ".".join(named[0])
        value, after = self._operand(k + 1, len(self.t))
        if after < len(self.t) and self.text_at(after) not in (";", ")", "}", ",", "]", ":") and self._end_of(k + 1, after + 1) > after:
            return
        to = self._state(value, target, "assignment")
        if to is None:
            return
        place = {"offset": self._units(self.t[self._begin_of(named[1])].at), "end_offset": self._units(self.t[after - 1].end)}
        came, condition = None, None
        for _, kind, span in reversed(around):
            if kind == "function":
                break
            came = self._guarded(span, target)
            if came:
                condition = {"offset": self._units(self.t[span[0]].at), "end_offset": self._units(self.t[span[1] - 1].end)}
                break
        self.source.states.append(to | place)
        if came:
            self.source.states.append(came | condition)
        own = [s for s in self.source.symbols if s["start_offset"] <= place["offset"] and s["end_offset"] >= place["end_offset"]]
        inner = min(own, key=lambda s: s["end_offset"] - s["start_offset"], default=None)
        sure = min([to["confidence_pct"], *([came["confidence_pct"]] if came else [])])
        self.source.transitions.append({
            "subject": ".".join(named[0][:-1]) or "local", "field": named[0][-1], "from_set": came and came["state_set"], "from_state": came and came["state"], "to_set": to["state_set"], "to_state": to["state"], "container": inner and inner["qualified_name"], "confidence_pct": sure,
            "deterministic": bool(came) and sure == 100, **place, "condition_offset": condition and condition["offset"], "condition_end": condition and condition["end_offset"],
        })

    def _begin_of(self, at: int) -> int:
        """Where the whole left side of an assignment begins, calls and indexes included."""
        while self.text_at(at - 1) in (".", "?.") and at >= 2:
            at -= 2
            while at in self._opening():
                at = self._opening()[at] - 1
        return at

    def _rounding(self, k: int) -> None:
        begin = k - 1
        while self.text_at(begin - 1) in (".", "?.") and begin >= 2 and self.t[begin - 2].kind == "word":
            begin -= 2
        name = ".".join(self._names_from(begin)[0])
        if self.text_at(begin - 1) in (".", "?.") or not (name in ROUNDING or name.endswith(".toFixed")):
            return
        target, before = None, self.text_at(begin - 1)
        if before == "return":
            target = "return"
        elif before == "=" and self.text_at(begin - 2) != "=":
            at = begin - 2
            at -= self.text_at(at) in ("+", "-", "*", "/", "%")
            if self.t[at].kind == "word":
                start = at
                while self.text_at(start - 1) in (".", "?.") and start >= 2 and self.t[start - 2].kind == "word":
                    start -= 2
                typed = self.text_at(start - 1) == ":" and self.t[start - 2].kind == "word"
                target = self.text_at(start - 2) if typed else ".".join(self._names_from(start)[0])
        after = self.text_at(self.match[k] + 1)
        if target is not None and after in ("+", "-", "*", "/", "%", "?", "|", "&", ".", "?.", "["):
            target = None  # the call is only a part of the value
        self.source.roundings.append({"operation": name, "identifiers": self._identifiers(k + 1, self.match[k]), "target": target, "offset": self._units(self.t[begin].at), "end_offset": self._units(self.t[self.match[k]].end)})


def read_source(text: str | None, technical: bool = False) -> Source:
    """What text declares and does, its technical facts only if wanted; a file nested too deeply to be followed gives only a diagnostic."""
    if not text:
        return Source()
    try:
        reader = Reader(text)
        own = reader.read()
        if technical:
            from cairn.sources.technical import technical as facts

            own.technical = facts(reader)
        return own
    except RecursionError:
        return Source(diagnostics=["nested too deeply"])


# The columns of a parsed file, as Spark and Arrow types in one.
_FIELDS = {
    "symbols": "kind:string,name:string,qualified_name:string,exported:boolean,default_export:boolean,visibility:string,signature:string,documentation:string,start_offset:int,end_offset:int,start_line:int",
    "imports": "module:string,default_import:string,namespace_import:string,named:array<struct<imported:string,local:string,type_only:boolean>>,type_only:boolean,offset:int",
    "exports": "kind:string,local:string,exported:string,module:string,type_only:boolean,offset:int",
    "heritage": "source:string,kind:string,target:string,offset:int",
    "calls": "callee:string,receiver:string,member:string,offset:int",
    "decorators": "symbol:string,name:string,arguments:array<string>",
    "injections": "symbol:string,parameter:string,type:string",
    "guards": "condition:array<string>,operation:string,target:string,outcome:array<string>,outcome_kind:string,outcome_operation:string,outcome_target:string,offset:int,end_offset:int",
    "roundings": "operation:string,identifiers:array<string>,target:string,offset:int,end_offset:int",
    "states": "state_set:string,state:string,how:string,confidence_pct:int,offset:int,end_offset:int",
    "transitions": "subject:string,field:string,from_set:string,from_state:string,to_set:string,to_state:string,container:string,confidence_pct:int,deterministic:boolean,offset:int,end_offset:int,condition_offset:int,condition_end:int",
    "events": "event:string,operation:string,offset:int",
    "technical": "fact:string,name:string,receiver:string,member:string,arguments:int,optional:boolean,target_kind:string,target_name:string,token:string,type_name:string,literals:string,module_metadata:string,container:string,offset:int,end_offset:int",
}
SCHEMA = "id long, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in _FIELDS.items()) + ", diagnostics array<string>"


def parsed(files: DataFrame, id_col: str = "id", text_col: str = "text", only: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per file: id and arrays of what it holds. Null text gives empty arrays. Parse once, save, and join from the saved frame.

    only: which arrays are wanted, all by default; keep: text columns of files that go along. Files are dealt
    over all tasks first, as reading takes longest and many small texts may come from one task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    every = StructType.fromDDL(SCHEMA)
    wanted = StructType([every["id"], *[every[c] for c in every.names[1:] if only is None or c in only]])
    for c in keep:
        wanted = wanted.add(c, "string")
    schema, names = to_arrow_schema(wanted), [c for c in wanted.names[1:] if c not in keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 64):
                own = part.slice(k, 64)
                read = [vars(read_source(t, "technical" in names)) for t in own.column(1).to_pylist()]
                arrays = [pa.array([r[c] for r in read], type=schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([own.column(0), *arrays, *[own.column(2 + n).cast(pa.string()) for n in range(len(keep))]], schema=schema)

    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = files.select(files[id_col].cast("long").alias("id"), files[text_col].cast("string").alias("text"), *[files[c].cast("string").alias(c) for c in keep])
    return own.repartition(tasks, "id", "text").mapInArrow(run, wanted)

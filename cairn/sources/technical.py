"""Technical facts of a source: call sites, decorators with the metadata of modules, and constructor injections.

One walk over the reader's tokens. A bracket is that of a call when what stands before it is a value and
neither declares a function nor belongs to a statement; what is inside of a decorator is no call site.
A call whose target no name tells stays, without a callee. Substitutions of templates are read as sources of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

from cairn.sources.typescript import KEYWORDS, MODIFIERS, Reader, _template_end

# The longest name that is kept, the arrays of a module, types that are no reference, and literals.
MOST_NAME = 512
MODULE_FIELDS = {"controllers", "providers", "imports", "exports"}
PLAIN_TYPES = {"any", "unknown", "never", "void", "null", "undefined", "string", "number", "boolean", "object", "symbol", "bigint", "this", "true", "false"}
WORDS = {"true": True, "false": False, "null": None}
#: Words before a bracket that call nothing, and those that do only where no value is in front of them.
NOT_CALLED = (KEYWORDS - {"super", "import", "async", "of", "constructor"}) | {"with", "extends", "keyof", "infer", "export", "default", "const", "let", "var"}
BETWEEN = {"as", "is", "of", "satisfies"}
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}


def cooked(token: str) -> str:
    """What a string's text stands for."""
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else ESCAPED.get(m[4], m[4]), token[1:-1])


def short(name: str | None) -> str | None:
    return name if name and len(name) <= MOST_NAME else None


class Technical:
    def __init__(self, reader: Reader, base: int = 0):
        self.r, self.t, self.text_at, self.match, self.base = reader, reader.t, reader.text_at, reader.match, base
        self.opening = {b: a for a, b in self.match.items()}
        self.facts: list[dict] = []
        self.called: dict[int, int] = {}  # brackets of calls and of new, and the token where each expression begins
        self.declared: set[int] = set()
        self.targets: dict[int, tuple[str, str | None]] = {}
        self.runs: dict[int, int] = {}  # after a decorator: where the first of its run begins
        self.inside: list[int] = []
        stack: list[int] = []
        for k in range(len(self.t)):
            while stack and self.match[stack[-1]] <= k:
                stack.pop()
            self.inside.append(stack[-1] if stack else -1)
            if k in self.match:
                stack.append(k)

    def read(self) -> list[dict]:
        self.bodies = {self._body_of(k) for k, x in enumerate(self.t) if x.kind == "word" and x.text == "class" and self.text_at(k - 1) not in (".", "?.") and self._names_class(k)}
        for k in sorted(x for x in self.bodies if x is not None):
            self._members(k)
        for k, x in enumerate(self.t):
            if x.text == "interface" and x.kind == "word" and self.t[k + 1 : k + 2] and self.t[k + 1].kind == "word" and (own := self._body_of(k)) is not None:
                self._members(own, False)
        until = -1
        for k, x in enumerate(self.t):
            if x.text == "@" and x.kind == "op":
                until = max(until, self._decorator(k))
            elif k >= until and x.text == "(" and x.kind == "op":
                self._call(k)
            elif k >= until and x.kind == "string" and x.text[0] == "`" and "${" in x.text:
                self._template(x.text, x.at)
        return self.facts

    def _fact(self, fact: str, first: int, last: int, **own) -> None:
        """A fact with its range, from the token first to the token last."""
        self.facts.append({"fact": fact, "at": self.base + self.t[first].at, "end": self.base + self.t[last].end, **own})

    # Classes.

    def _names_class(self, k: int) -> bool:
        return self.text_at(k + 1) in ("{", "<") or self.t[k + 1 : k + 2] != [] and self.t[k + 1].kind == "word"

    def _body_of(self, k: int) -> int | None:
        """The brace that opens the body of a class or interface."""
        at = k + 1
        while at < len(self.t) and self.text_at(at) not in ("{", ";", "}"):
            at = self.r._angle(at, len(self.t)) if self.text_at(at) == "<" else self.match.get(at, at) + 1
        return at if self.text_at(at) == "{" else None

    def _members(self, open_: int, of_class: bool = True) -> None:
        """What members declare: brackets of their parameters, targets of their decorators, and what constructors are given."""
        at, end = open_ + 1, self.match[open_]
        while at < end:
            decorators, accessor, begin = [], False, at
            while at < end:
                if self.text_at(at) == "@":
                    decorators.append(at)
                    at = self._expression(at)[0]
                elif self.text_at(at) in MODIFIERS and self.text_at(at + 1) not in ("(", "=", ":", ";", ",", "}", "?", "<", "!", "."):
                    at += 1
                else:
                    break
            if self.text_at(at) in ("get", "set") and self.text_at(at + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
                accessor, at = True, at + 1
            at += self.text_at(at) == "*"
            if at >= end or self.text_at(at) in (";", "{", ","):
                at = max(begin + 1, self.match.get(at, at) + 1)
                continue
            name = at
            at = self.match.get(at, at) + 1
            at += self.text_at(at) in ("?", "!")
            if self.text_at(at) == "<":
                at = self.r._angle(at, end)
            kind = "property"
            if self.text_at(at) == "(":
                self.declared.add(at)
                kind = "declaration" if accessor else "method"
                if of_class and self.t[name].text.strip("'\"") == "constructor":
                    self._injections(at)
                close = self.match[at]
                body = self.r._body(close + 1, end, member=True)
                stop = self.match[body] + 1 if body is not None else self.r._end_of(close, end)
            else:
                stop = self.r._end_of(name, end)
            for d in decorators:
                self.targets[d] = kind, None if kind == "declaration" else self._name(name)
            at = max(stop, name + 1)

    def _name(self, k: int) -> str | None:
        """The name of a member or parameter; a pattern's and a computed one's is its text."""
        x = self.t[k]
        if x.kind == "string":
            return cooked(x.text)
        return x.text if x.kind in ("word", "number") else short(self.r.text[x.at : self.t[self.match.get(k, k)].end])

    def _parameters(self, open_: int) -> Iterator[tuple[int, int, int, list[int], tuple[int, int] | None]]:
        """Of each parameter its first and last token, its name, its decorators and the range of its type."""
        at, end = open_ + 1, self.match[open_]
        while at < end:
            begin, decorators, type_ = at, [], None
            while at < end:
                if self.text_at(at) == "@":
                    decorators.append(at)
                    at = self._expression(at)[0]
                elif self.text_at(at) == "..." or self.text_at(at) in MODIFIERS and self.text_at(at + 1) not in (":", ",", "?", "=", ")"):
                    at += 1
                else:
                    break
            if at >= end:
                return
            name, at = at, self.match.get(at, at) + 1
            at += self.text_at(at) == "?"
            if self.text_at(at) == ":":
                first = at = at + 1
                while at < end and self.text_at(at) not in (",", "="):
                    at = self.r._angle(at, end) if self.text_at(at) == "<" else self.match.get(at, at) + 1
                type_ = first, at
            while at < end and self.text_at(at) != ",":
                at = self._past(at, end)
            yield begin, at - 1, name, decorators, type_
            at += 1

    def _past(self, at: int, end: int) -> int:
        """After a token of an expression, what its bracket holds, or a list of types."""
        if self.text_at(at) == "<" and at and self.t[at].at == self.t[at - 1].end and self.t[at - 1].kind == "word":
            after = self.r._angle(at, end)
            if self.text_at(after - 1) == ">" and (after >= end or self.text_at(after) in ("(", ")", ",", "=>", "{", "[", "]", "|", "&", "=", ";", ">")):
                return after
        return self.match.get(at, at) + 1

    def _injections(self, open_: int) -> None:
        for begin, last, name, decorators, type_ in self._parameters(open_):
            token, optional, asked = None, False, False
            for d in decorators:
                _, own, args = self._expression(d)
                own = own and own.split(".")[-1]
                optional |= own == "Optional"
                if own == "Inject" and not asked:
                    asked = True
                    first = next(self._arguments(*args), None) if args else None
                    if first:
                        value = self._literal(*first)
                        token = value if isinstance(value, str) else json.dumps(value) if type(value) in (int, float) else self._reference(*first)
            type_name = type_ and self._type(*type_)
            parameter = self._name(name)
            target = type_name if token is None else token
            if parameter and target:
                self._fact("injection", begin, last, name=parameter, target_name=target, token=token, type_name=type_name, optional=optional)

    def _type(self, at: int, end: int) -> str | None:
        """The name of a type that is a reference, or the type of one; null for any other."""
        asked = self.text_at(at) == "typeof"
        at += asked
        if at >= end or self.t[at].kind != "word" or not asked and self.text_at(at) in PLAIN_TYPES:
            return None
        parts = [self.text_at(at)]
        while self.text_at(at + 1) == "." and at + 2 < end:
            at += 2
            parts.append(self.text_at(at))
        at = self.r._angle(at + 1, end) if self.text_at(at + 1) == "<" else at + 1
        if at != end:
            return None
        return parts[0] if len(parts) == 1 else short(".".join(parts))

    # Decorators.

    def _expression(self, at: int) -> tuple[int, str | None, tuple[int, int] | None]:
        """After the decorator that begins here, its name, and where its arguments are if it is a call."""
        k = at + 1
        if self.text_at(k) == "(":
            return self.match[k] + 1, None, None
        parts = [self.text_at(k)]
        while self.text_at(k + 1) == "." and k + 2 < len(self.t):
            k += 2
            parts.append(self.text_at(k))
        k, name, args = k + 1, short(".".join(parts)), None
        if self.text_at(k) == "<" and self.text_at(after := self.r._angle(k, len(self.t))) == "(":
            k = after
        if self.text_at(k) == "(":
            args, k = (k + 1, self.match[k]), self.match[k] + 1
            while self.text_at(k) in ("(", "."):  # of what a call gave
                name, args = None, (k + 1, self.match[k]) if self.text_at(k) == "(" else None
                k = self.match[k] + 1 if self.text_at(k) == "(" else k + 2
        return k, name, args

    def _decorator(self, at: int) -> int:
        after, name, args = self._expression(at)
        given = [v for x in self._arguments(*args) if (v := self._literal(*x)) is not ...] if args else []
        begin = at
        while begin > 0 and self.text_at(begin - 1) in MODIFIERS:
            begin -= 1
        begin = self.runs[after] = self.runs.get(begin, begin)
        kind, target = self.targets.get(at) or self._target(at, begin)
        module = self._module(*args) if args and name and name.split(".")[-1] == "Module" else None
        canonical = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        self._fact("decorator", at, min(after, len(self.t)) - 1, name=name, target_kind=kind, target_name=target, literals=canonical(given), module_metadata=module and canonical(module))
        return after

    def _target(self, at: int, begin: int) -> tuple[str, str | None]:
        """What a decorator outside of a class's members is for, a class or a parameter; begin is where the first decorator or modifier of it is."""
        k = at
        while k < len(self.t):
            if self.text_at(k) == "@":
                k = self._expression(k)[0]
            elif self.text_at(k) == "..." or self.text_at(k) in MODIFIERS and self.text_at(k + 1) not in (":", ",", "?", "=", ")"):
                k += 1
            else:
                break
        if self.text_at(k) == "class":
            if begin > 0 and self.text_at(begin - 1) in ("=", "(", ",", "[", ":", "?", "return", "=>"):
                return "declaration", None  # a class that is a value
            name = self.text_at(k + 1)
            return "class", name if name not in ("extends", "implements", "{", "<", "") else None
        if k < len(self.t) and self.text_at(self.inside[at]) == "(" and self.inside[at] >= 0:
            return "parameter", self._name(k)
        return "declaration", None

    def _module(self, at: int, end: int) -> dict[str, list[str]] | None:
        """Arrays of references of a module's only object: controllers, providers, imports and exports that are written out."""
        first = next(self._arguments(at, end), None)
        if not first or self.text_at(first[0]) != "{" or self.match[first[0]] + 1 != first[1]:
            return None
        out: dict[str, list[str]] = {}
        for k, stop in self._arguments(first[0] + 1, first[1] - 1):
            if self.text_at(k + 1) != ":" or self.t[k].kind not in ("word", "string") or self.text_at(k)[0] in "`/":
                continue
            field = cooked(self.text_at(k)) if self.t[k].kind == "string" else self.text_at(k)
            if field in MODULE_FIELDS and self.text_at(k + 2) == "[" and self.match[k + 2] + 1 == stop:
                out[field] = [own for x in self._arguments(k + 3, stop - 1) if (own := self._reference(*x))]
        return out or None

    def _arguments(self, at: int, end: int) -> Iterator[tuple[int, int]]:
        """Ranges of what commas part."""
        while at < end:
            begin = at
            while at < end and self.text_at(at) != ",":
                at = min(self._past(at, end), end)
            if at > begin:
                yield begin, at
            at += 1

    def _literal(self, at: int, end: int):
        """The value of a literal; ... for anything else."""
        x = self.t[at]
        if end != at + 1:
            return ...
        if x.kind == "string":
            return ... if x.text[0] == "/" or x.text[0] == "`" and "${" in x.text else cooked(x.text)
        if x.kind == "number" and not x.text.endswith("n"):
            try:
                text = x.text.replace("_", "")
                value = int(text, 0) if re.match(r"0[xXoObB]", text) else float(text)
                return int(value) if value == int(value) else value
            except (ValueError, OverflowError):
                return ...
        return WORDS.get(x.text, ...) if x.kind == "word" else ...

    def _reference(self, at: int, end: int) -> str | None:
        """A name, or names with dots, that fill a range."""
        if self.t[at].kind != "word" or self.text_at(at) in KEYWORDS - {"super", "async", "of", "constructor"} or self.text_at(at) in WORDS:
            return None
        parts, after = self.r._names_from(at)
        return short(".".join(parts)) if after == end else None

    # Calls.

    def _value(self, k: int) -> bool:
        """Whether a value may end at this token."""
        if k < 0:
            return False
        x = self.t[k]
        if x.kind == "word":
            return self.text_at(k - 1) in (".", "?.") or x.text not in NOT_CALLED
        return x.kind in ("string", "number") or x.text in (")", "]", "}")

    def _newline(self, k: int) -> bool:
        """Whether a line ends in front of this token."""
        return k > 0 and "\n" in self.r.text[self.t[k - 1].end : self.t[k].at]

    def _types(self, k: int) -> int | None:
        """Where the list of types in front of a bracket opens, None for none."""
        if self.t[k].at != self.t[k - 1].end:
            return None
        depth, at = 0, k - 1
        while at > 0:
            x = self.t[at]
            depth += {">": 1, "<": -1}.get(x.text, 0)
            if depth == 0:
                return at if self.t[at].at == self.t[at - 1].end else None
            if x.text in (";", "=", "+", "*", "/", "%", "^", "~", "!", "@", "(", "{") or x.kind == "other":
                return None
            at = self.opening.get(at, at) - 1
        return None

    def _start(self, k: int) -> tuple[int, bool]:
        """Where the expression that ends at this token begins, and whether it holds a call."""
        while k > 0:
            x = self.text_at(k)
            if k in self.opening:
                open_ = self.opening[k]
                if open_ in self.called:
                    return self.called[open_], True
                if x == "]" and (self._value(open_ - 1) or self.text_at(open_ - 1) in ("?.", "!")):
                    k = open_ - 1 - (self.text_at(open_ - 1) == "?.")
                    continue
                if x == "}":
                    return self._function(open_) if self._function(open_) is not None else open_, False
                return open_, False
            if x == "!":
                k -= 1
            elif self.t[k].kind == "word" and self.text_at(k - 1) in (".", "?."):
                k -= 2
            elif self.t[k].kind == "string" and x[0] == "`" and self._value(k - 1) and self.t[k - 1].end == self.t[k].at:
                k -= 1
            else:
                break
        return max(k, 0), False

    def _function(self, brace: int) -> int | None:
        """Where the function expression begins whose body a brace opens; None for other braces, and for functions that are statements."""
        k = brace - 1
        if self.text_at(k) != ")" or k not in self.opening:
            return None
        k = self.opening[k] - 1
        k -= self.text_at(k) != "function" and self.text_at(k) != "*"
        k -= self.text_at(k) == "*"
        if self.text_at(k) != "function":
            return None
        k -= self.text_at(k - 1) == "async"
        before = self.text_at(k - 1)
        return k if k > 0 and (before in ("=", "(", ",", "!", "+", "-", "~", "?", ":", "&", "|", "=>", "[", "return", "void", "typeof", "await", "new")) else None

    def _call(self, k: int) -> None:
        """The call, if this bracket holds the arguments of one."""
        p, optional, close = k - 1, False, self.match[k]
        if p < 0 or k in self.declared or self.text_at(close + 1) == "=>":
            return
        if self.text_at(p) == ">":
            lower = self._types(k)
            if lower is None:
                return
            p = lower - 1
        if self.text_at(p) == "?.":
            optional, p = True, p - 1
        sure = self.text_at(p) == "!" and self._value(p - 1) and self.t[p].at == self.t[p - 1].end
        if not sure and not self._value(p):
            return
        x, callee, receiver, member = self.t[p], None, None, None
        if x.kind == "word":
            found = self._named(p, close)
            if found is None:
                return
            callee, receiver, member = found
        elif x.kind == "number" or x.kind == "string" and not (x.text[0] == "`" and self._value(p - 1) and self.t[p - 1].end == x.at):
            return
        elif x.text == ")":
            open_ = self.opening.get(p, -1)
            before = open_ - 1 - (self.text_at(open_ - 1) == "await")
            if open_ in self.declared or open_ not in self.called and self.text_at(before) in ("if", "for", "while", "switch", "catch", "with") and self.text_at(before - 1) not in (".", "?."):
                return
        elif x.text == "]":
            open_ = self.opening.get(p, 0)
            if not (self._value(open_ - 1) or self.text_at(open_ - 1) in ("?.", "!")) or open_ - 1 < 0:
                return
        elif x.text == "}" and self._function(self.opening.get(p, 0)) is None:
            return
        start, holds = self._start(p)
        if self.text_at(start - 1) == "new" and start > 0 and not holds and self.text_at(start - 2) not in (".", "?."):
            self.called[k] = start - 1
            return
        self.called[k] = start
        self._fact("call", start, close, name=callee, receiver=receiver, member=member, optional=optional, arguments=sum(1 for _ in self._arguments(k + 1, close)))
        if callee is None:
            self._fact("diagnostic", start, close, name="unsupported_computed_call_target")

    def _named(self, p: int, close: int) -> tuple[str | None, str | None, str | None] | None:
        """Callee, receiver and member of a call by name; None where the name declares a function or is no name."""
        word, after = self.text_at(p), self.text_at(close + 1)
        if self.text_at(p - 1) in (".", "?."):
            parts, s = [word], p
            while self.text_at(s - 1) in (".", "?.") and s >= 2 and self.t[s - 2].kind == "word":
                s -= 2
                parts.insert(0, self.text_at(s))
            known = self.text_at(s - 1) not in (".", "?.") and parts[0] not in ("new", "import")
            receiver = short(".".join(parts[:-1])) if known else None
            return short(f"{receiver}.{word}") if receiver else None, receiver, word
        if word in NOT_CALLED or word in BETWEEN and self._value(p - 1) and not self._newline(p):
            return None
        if self.text_at(p - 1) == "function" or self.text_at(p - 1) == "*" and self.text_at(p - 2) == "function":
            return None
        first = p
        while self.text_at(first - 1) in ("async", "get", "set", "*") and first > 1:
            first -= 1
        before = self.text_at(first - 1)
        if after == "{" and not self._newline(close + 1) and close + 1 not in self.bodies:
            return None  # a method of an object
        if after == ":" and (word == "async" and before != "?" or self.inside[p] >= 0 and self.text_at(self.inside[p]) == "{" and (before in ("{", ",", ";") or self._newline(first) and self._value(first - 1))):
            return None  # with the type that it returns
        return (None, None, None) if word == "import" else (word, None, None) if word == "super" else (short(word), None, word)

    def _template(self, text: str, at: int) -> None:
        k = 1
        while k < len(text):
            if text[k] == "\\":
                k += 1
            elif text.startswith("${", k):
                end, depth = k + 2, 1
                while end < len(text):
                    c = text[end]
                    if c == "`":
                        end = max(_template_end(text, end) - 1, end)
                    elif c in "'\"":
                        m = re.compile(r"(['\"])(?:\\.|(?!\1)[^\\\n])*\1").match(text, end)
                        end = m.end() - 1 if m else end
                    depth += {"{": 1, "}": -1}.get(c, 0)
                    if depth == 0:
                        break
                    end += 1
                self.facts += Technical(Reader(text[k + 2 : end]), self.base + at + k + 2).read()
                k = end
            k += 1


def technical(reader: Reader) -> list[dict]:
    """The facts of a source that was read, in their order, with ranges in code units and the name of the narrowest symbol around each."""
    facts = sorted(Technical(reader).read(), key=lambda f: (f["at"], -f["end"]))
    units = None if reader.text.isascii() else [0, *accumulate(1 + (ord(c) > 0xFFFF) for c in reader.text)]
    symbols = sorted(reader.source.symbols, key=lambda s: (s["start_offset"], -s["end_offset"]))
    around, at = [], 0
    for f in facts:
        begin, end = f.pop("at"), f.pop("end")
        f["offset"], f["end_offset"] = (begin, end) if units is None else (units[begin], units[end])
        while at < len(symbols) and symbols[at]["start_offset"] <= f["offset"]:
            while around and around[-1]["end_offset"] <= symbols[at]["start_offset"]:
                around.pop()
            around.append(symbols[at])
            at += 1
        while around and around[-1]["end_offset"] <= f["offset"]:
            around.pop()
        f["container"] = next((s["qualified_name"] for s in reversed(around) if s["end_offset"] >= f["end_offset"]), None)
    return facts

"""The preprocessor of the light C front end: tokens of a file after conditionals and macros.

Conditionals are decided with the macros that the file itself defines and the few in PREDEFINED; headers aren't read, so other names
count as not defined. Object-like and function-like macros are expanded, with ``#``, ``##`` and ``__VA_ARGS__``; a macro isn't expanded inside
itself. Tokens of an expansion stand where the macro's use stands in the file and are marked. Offsets are code points of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LEX = re.compile(
    r"(?P<ws>[ \t\r\f\v]+|\\\r?\n)|(?P<nl>\n)|(?P<comment>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<num>(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[uUlLfF]*)"
    r"|(?P<id>[A-Za-z_$][\w$]*)|(?P<str>(?:L|u8|u|U)?\"(?:\\.|[^\"\\\n])*\")|(?P<chr>(?:L|u|U)?'(?:\\.|[^'\\\n])+')"
    r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|##?|[-+*/%&|^~!<>=?:;,.(){}\[\]@])|(?P<bad>.)",
    re.S,
)
#: Names that conditions find defined although no file defines them, with their values.
PREDEFINED = {"__STDC__": "1", "__STDC_VERSION__": "201710", "__STDC_HOSTED__": "1", "__GNUC__": "4", "__clang__": "1", "__linux__": "1", "__unix__": "1", "__x86_64__": "1", "__LP64__": "1", "NULL": "0", "EOF": "(-1)", "INT_MAX": "2147483647", "UINT_MAX": "4294967295", "LONG_MAX": "9223372036854775807", "CHAR_BIT": "8"}
_DIRECTIVE = re.compile(r"#\s*(\w*)\s*(.*)", re.S)
_PLAIN = {"&&": " and ", "||": " or ", "!": " not ", "/": "//"}


@dataclass
class Token:
    kind: str
    text: str
    begin: int
    end: int
    line: int
    macro: bool = False
    hidden: frozenset = frozenset()


@dataclass
class Macro:
    body: list[Token]
    params: list[str] | None = None  # None: object-like


@dataclass
class Source:
    tokens: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    macros: dict[str, Macro] = field(default_factory=dict)
    n_errors: int = 0


def _raw(text: str) -> list[Token]:
    """Tokens of a piece of text, without blanks and comments."""
    return [Token(m.lastgroup, m[0], 0, 0, 0) for m in LEX.finditer(text) if m.lastgroup not in ("ws", "nl", "comment")]


def _macro(rest: str) -> tuple[str, Macro] | None:
    m = re.match(r"([A-Za-z_$][\w$]*)(\(([^)]*)\))?(.*)", rest, re.S)
    if not m:
        return None
    params = None if m[2] is None else [p.strip().removesuffix("...").strip() or "__VA_ARGS__" for p in m[3].split(",")] if m[3].strip() else []
    return m[1], Macro(_raw(m[4]), params)


class Preprocessor:
    def __init__(self, text: str) -> None:
        self.text = text
        self.out = Source()
        self.macros = self.out.macros
        self.room = 100_000 + 20 * len(text)  # tokens that expansions may make

    # --- conditions

    def holds(self, condition: str) -> bool:
        """A condition's value; one that can't be read is false."""
        condition = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: str(int(self.known(m[1] or m[2]))), condition)
        parts = []
        for t in self.expand(_raw(condition)):
            if t.kind == "num" and re.fullmatch(r"(0[xX][0-9a-fA-F]+|\d+)[uUlL]*", t.text):
                digits = t.text.rstrip("uUlL")
                parts.append(str(int(digits, 8 if re.fullmatch(r"0[0-7]+", digits) else 0) if digits != "0" else 0))
            elif t.kind == "id":
                parts.append(PREDEFINED.get(t.text, "0"))
            elif t.kind == "chr":
                parts.append(str(ord(t.text[-2])))
            elif t.kind == "op" and t.text in "+ - * % ( ) < > <= >= == != & | ^ ~".split():
                parts.append(t.text)
            elif t.kind == "op" and t.text in _PLAIN:
                parts.append(_PLAIN[t.text])
            else:
                return False
        try:
            return len(parts) < 200 and bool(eval(" ".join(parts), {"__builtins__": {}}))  # digits, brackets and operators only
        except (SyntaxError, ArithmeticError, TypeError, ValueError, MemoryError, RecursionError):
            return False

    def known(self, name: str) -> bool:
        return name in self.macros or name in PREDEFINED

    # --- expansion

    def expand(self, tokens: list[Token]) -> list[Token]:
        out: list[Token] = []
        todo = tokens[::-1]
        while todo:
            t = todo.pop()
            m = self.macros.get(t.text) if t.kind == "id" and t.text not in t.hidden else None
            if m is None:
                out.append(t)
                continue
            end, args = t.end, None
            if m.params is not None:
                if not todo or todo[-1].text != "(":
                    out.append(t)
                    continue
                end, args = self.arguments(todo, t)
                if args is None:
                    out.append(t)
                    continue
            made = self.substituted(m, args)
            self.room -= len(made)
            if self.room < 0:
                raise RecursionError("macros grow without end")
            end = t.end if t.macro else end
            todo += [Token(x.kind, x.text, t.begin, end, t.line, True, x.hidden | t.hidden | {t.text}) for x in reversed(made)]
        return out

    @staticmethod
    def arguments(todo: list[Token], name: Token) -> tuple[int, list[list[Token]] | None]:
        """Takes the arguments after a macro's name; none if the bracket doesn't close."""
        depth, args, at = 0, [[]], len(todo) - 1
        while at >= 0:
            t = todo[at]
            if t.text in ("(", "[", "{") and t.kind == "op":
                depth += 1
            if t.text in (")", "]", "}") and t.kind == "op":
                depth -= 1
                if not depth:
                    del todo[at:]
                    return t.end, args
            if depth == 1 and t.text == "," and t.kind == "op":
                args.append([])
            elif depth > 1 or t.text != "(":
                args[-1].append(t)
            at -= 1
        return name.end, None

    @staticmethod
    def substituted(m: Macro, args: list[list[Token]] | None) -> list[Token]:
        given: dict[str, list[Token]] = {}
        if m.params is not None and args is not None:
            for i, p in enumerate(m.params):
                if i == len(m.params) - 1 and (p == "__VA_ARGS__" or len(args) > len(m.params)):
                    rest: list[Token] = []
                    for k, a in enumerate(args[i:]):
                        rest += [Token("op", ",", 0, 0, 0)] * (k > 0) + a
                    given[p] = rest
                else:
                    given[p] = args[i] if i < len(args) else []
        out: list[Token] = []
        i, paste = 0, False
        while i < len(m.body):
            t = m.body[i]
            if t.text == "##" and t.kind == "op":
                paste = bool(out)
                i += 1
                continue
            if t.text == "#" and t.kind == "op" and i + 1 < len(m.body) and m.body[i + 1].text in given:
                said = " ".join(x.text for x in given[m.body[i + 1].text]).replace("\\", "\\\\").replace('"', '\\"')
                new = [Token("str", f'"{said}"', 0, 0, 0)]
                i += 1
            else:
                new = given.get(t.text, [t]) if t.kind == "id" else [t]
            if paste and new:
                joined = _raw(out[-1].text + new[0].text)
                out[-1:] = joined
                new = new[1:]
            out += new
            paste = False
            i += 1
        return out

    # --- lines

    def run(self) -> Source:
        text, line, at, fresh = self.text, 1, 0, True
        waiting: list[Token] = []  # active tokens since the last directive that changed a macro
        stack: list[list[bool]] = []  # active now, some branch taken, active outside
        active = True
        while at < len(text):
            m = LEX.match(text, at)
            kind, word = m.lastgroup, m[0]
            if kind == "op" and word in ("#", "##") and fresh:
                end = self.line_end(at)
                said = re.sub(r"/\*.*?(?:\*/|\Z)|//[^\n]*", " ", text[at:end].replace("\\\r\n", " ").replace("\\\n", " "), flags=re.S)
                d = _DIRECTIVE.match(said)
                name, rest = (d[1], d[2].strip()) if d else ("", "")
                if name in ("define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif"):
                    self.flush(waiting)
                    active = self.directive(name, rest, stack, active)
                elif name == "error" and active:
                    self.out.n_errors += 1
                line += text.count("\n", at, end)
                at = end
                continue
            if kind == "comment":
                self.out.comments.append((at, m.end()))
            elif kind == "nl":
                fresh = True
            elif kind != "ws":
                if active:
                    waiting.append(Token(kind, word, at, m.end(), line))
                fresh = False
            line += word.count("\n")
            at = m.end()
        self.flush(waiting)
        self.out.n_errors += len(stack)
        self.out.tokens.append(Token("eof", "", len(text), len(text), line))
        return self.out

    def flush(self, waiting: list[Token]) -> None:
        self.out.tokens += self.expand(waiting) if self.macros else waiting
        waiting.clear()

    def line_end(self, at: int) -> int:
        """Where the directive's line ends, continued lines included."""
        while True:
            nl = self.text.find("\n", at)
            if nl < 0:
                return len(self.text)
            if not self.text[max(0, nl - 2) : nl].rstrip("\r").endswith("\\"):
                return nl
            at = nl + 1

    def directive(self, name: str, rest: str, stack: list[list[bool]], active: bool) -> bool:
        """Carries a directive out; whether what follows is active."""
        word = re.match(r"\w*", rest)[0]
        if name == "define" and active:
            found = _macro(rest)
            if found:
                self.macros[found[0]] = found[1]
            else:
                self.out.n_errors += 1
        elif name == "undef" and active:
            self.macros.pop(word, None)
        elif name in ("if", "ifdef", "ifndef"):
            holds = active and (self.holds(rest) if name == "if" else self.known(word) == (name == "ifdef"))
            stack.append([holds, holds, active])
            return holds
        elif name in ("elif", "else", "endif") and not stack:
            self.out.n_errors += 1
        elif name in ("elif", "else"):
            _, taken, outside = stack[-1]
            holds = outside and not taken and (name == "else" or self.holds(rest))
            stack[-1] = [holds, taken or holds, outside]
            return holds
        elif name == "endif":
            return stack.pop()[2]
        return active


def preprocess(text: str) -> Source:
    return Preprocessor(text).run()

"""A light front end for C: one file's functions, expression and statement nodes with types, as plain rows.

Conditionals and macros are carried out first (``preproc``); headers aren't read. Types that can't
be known are ``Unknown`` and match nothing. Errors are counted, never raised; after one the parser goes on behind the next ``;`` or
closing brace. Offsets are code points of the text.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from .preproc import Token, preprocess

@dataclass(frozen=True)
class Type:
    """kind: Int, UInt, Char, SChar, UChar, Short, UShort, Long, ULong, LongLong, ULongLong, Float, Double, LongDouble, Bool, Void, Enum, Record, Pointer, Array, Function, Unknown."""

    kind: str
    text: str
    inner: Type | None = None
    params: tuple = ()
    tag: str = ""

    def star(self) -> Type:
        return Type("Pointer", self.text + ("*" if self.text.endswith("*") else " *"), self)


def basic(kind: str, text: str) -> Type:
    return Type(kind, text)


UNKNOWN, VOID, INT, CHAR = basic("Unknown", "?"), basic("Void", "void"), basic("Int", "int"), basic("Char", "char")
UINT, LONG, ULONG, DOUBLE = basic("UInt", "unsigned int"), basic("Long", "long"), basic("ULong", "unsigned long"), basic("Double", "double")
_RANK = {"Int": 1, "UInt": 2, "Long": 3, "ULong": 4, "LongLong": 5, "ULongLong": 6, "Float": 7, "Double": 8, "LongDouble": 9}
_SMALL = {"Bool", "Char", "SChar", "UChar", "Short", "UShort", "Enum"}
#: Type words in sorted order and the type they make.
_WORDS = {
    "void": VOID, "char": CHAR, "char signed": basic("SChar", "signed char"), "char unsigned": basic("UChar", "unsigned char"), "short": basic("Short", "short"), "short unsigned": basic("UShort", "unsigned short"),
    "int": INT, "unsigned": UINT, "long": LONG, "long unsigned": ULONG, "long long": basic("LongLong", "long long"), "long long unsigned": basic("ULongLong", "unsigned long long"), "float": basic("Float", "float"), "double": DOUBLE,
    "double long": basic("LongDouble", "long double"), "_Bool": basic("Bool", "_Bool"), "bool": basic("Bool", "_Bool"),
}
_TYPE_WORDS = set("void char short int long float double signed unsigned _Bool bool _Complex __signed__ __int128".split())
_QUALIFIERS = set("const volatile restrict __restrict __restrict__ inline __inline __inline__ _Noreturn register auto __extension__ __const _Atomic _Thread_local __thread".split())
_STORAGE = {"extern", "static", "typedef"}
_KEYWORDS = _TYPE_WORDS | _QUALIFIERS | _STORAGE | set("struct union enum if else while do for switch case default return goto break continue sizeof typeof __typeof__ _Alignof".split())
#: Names that standard headers define.
_TYPEDEFS = {
    "size_t": ULONG, "ssize_t": LONG, "ptrdiff_t": LONG, "intptr_t": LONG, "uintptr_t": ULONG, "time_t": LONG, "clock_t": LONG, "int8_t": _WORDS["char signed"], "uint8_t": _WORDS["char unsigned"], "int16_t": _WORDS["short"],
    "uint16_t": _WORDS["short unsigned"], "int32_t": INT, "uint32_t": UINT, "int64_t": LONG, "uint64_t": ULONG, "intmax_t": LONG, "uintmax_t": ULONG, "wchar_t": INT, "FILE": Type("Record", "FILE"), "va_list": Type("Record", "va_list"),
    "jmp_buf": Type("Array", "jmp_buf"), "sigjmp_buf": Type("Array", "sigjmp_buf"), "div_t": Type("Record", "div_t"), "fpos_t": Type("Record", "fpos_t"),
}
_LIBC = {
    INT: "printf fprintf sprintf snprintf vprintf vfprintf vsprintf vsnprintf scanf fscanf sscanf puts putchar putc fputs fputc getchar getc fgetc fclose fflush fseek feof ferror remove rename rand abs atoi strcmp strncmp memcmp strcoll toupper tolower isalpha isdigit isalnum isspace isupper islower ispunct isprint isxdigit setjmp sigsetjmp system atexit raise isnan isinf",
    LONG: "atol labs ftell strtol time clock", ULONG: "strlen fread fwrite strtoul strspn strcspn", DOUBLE: "sqrt pow sin cos tan asin acos atan atan2 exp log log10 fabs floor ceil fmod round atof strtod difftime hypot",
    VOID: "free exit abort srand qsort perror rewind longjmp siglongjmp assert reach_error __assert_fail clearerr setbuf", VOID.star(): "malloc calloc realloc memcpy memmove memset memchr bsearch signal",
    CHAR.star(): "strcpy strncpy strcat strncat strchr strrchr strstr strtok strdup fgets gets getenv strerror ctime asctime", Type("Record", "FILE").star(): "fopen freopen tmpfile fdopen",
}
LIBC = {name: t for t, names in _LIBC.items() for name in names.split()}
_MACROS = {"NULL": VOID.star(), "EOF": INT, "true": INT, "false": INT, "errno": INT, "INT_MAX": INT, "INT_MIN": INT, "UINT_MAX": UINT, "LONG_MAX": LONG, "RAND_MAX": INT, "EXIT_SUCCESS": INT, "EXIT_FAILURE": INT}
_NAMES = {"stdin": VOID.star(), "stdout": VOID.star(), "stderr": VOID.star(), "__func__": CHAR.star(), **_MACROS}


def promote(t: Type) -> Type:
    return INT if t.kind in _SMALL else t


def arithmetic(a: Type, b: Type) -> Type:
    a, b = promote(a), promote(b)
    if a.kind not in _RANK or b.kind not in _RANK:
        return UNKNOWN
    return a if _RANK[a.kind] >= _RANK[b.kind] else b


@dataclass
class Unit:
    """What a file has: rows of functions and nodes, and counts."""

    functions: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # declared at file scope
    undeclared: list[str] = field(default_factory=list)  # called, but not declared or known
    first: int = -1  # where the line of the first declaration begins
    n_errors: int = 0
    unknown_type_nodes: int = 0


class Bad(Exception):
    pass


class Parser:
    def __init__(self, text: str) -> None:
        self.text = text
        source = preprocess(text)
        self.tokens, self.comments, self.macros = source.tokens, source.comments, source.macros
        self.comment_ends = [e for _, e in self.comments]
        self.at = 0
        self.unit = Unit(n_errors=source.n_errors)
        self.scopes: list[dict[str, tuple[str, Type]]] = [{n: ("typedef", t) for n, t in _TYPEDEFS.items()}]
        self.records: dict[str, dict[str, Type]] = {}
        self.function = "Program"
        self.above: list[int] = [0]
        self.kids: dict[int, list[dict]] = {}  # nodes by parent, in order
        self.anonymous = 0

    # --- tokens

    @property
    def tok(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.tok
        if t.kind != "eof":
            self.at += 1
        return t

    def eat(self, text: str) -> bool:
        if self.tok.text == text and self.tok.kind in ("op", "id"):
            self.at += 1
            return True
        return False

    def want(self, text: str) -> Token:
        if self.tok.text != text:
            raise Bad(text)
        return self.next()

    @property
    def last_end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    # --- rows

    def open(self, kind: str, begin: int, line: int) -> dict:
        row = {"node_id": len(self.unit.nodes) + 1, "parent_id": self.above[-1], "kind": kind, "op": "", "type_kind": "", "type_str": "", "callee": "", "func": self.function, "begin": begin, "end": begin, "line": line}
        self.unit.nodes.append(row)
        self.kids.setdefault(self.above[-1], []).append(row)
        self.kids[row["node_id"]] = []
        self.above.append(row["node_id"])
        return row

    def close(self, row: dict, t: Type | None = None) -> None:
        row["end"] = self.last_end
        self.above.pop()
        if t is not None:
            row["type_kind"], row["type_str"] = t.kind, t.text
            if t.kind == "Unknown":
                self.unit.unknown_type_nodes += 1

    def wrap(self, first: int, kind: str, begin: int, line: int) -> dict:
        """A node around those made since ``first``, which becomes the parent of the topmost of them."""
        row = self.open(kind, begin, line)
        beside, taken = self.kids[row["parent_id"]], []
        beside.pop()
        while beside and beside[-1]["node_id"] > first:
            taken.append(beside.pop())
            taken[-1]["parent_id"] = row["node_id"]
        beside.append(row)
        self.kids[row["node_id"]] = taken[::-1]
        return row

    # --- names

    def lookup(self, name: str) -> tuple[str, Type] | None:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return None

    def is_type(self, t: Token) -> bool:
        if t.kind != "id":
            return False
        if t.text in _TYPE_WORDS or t.text in _QUALIFIERS or t.text in ("struct", "union", "enum", "typeof", "__typeof__"):
            return True
        found = self.lookup(t.text)
        return found is not None and found[0] == "typedef"

    def starts_declaration(self) -> bool:
        t = self.tok
        if t.text in _STORAGE or t.text in ("__attribute__", "_Static_assert"):
            return True
        if self.is_type(t):
            return not (self.peek().text == ":" and self.peek(2).text != ":")
        # a name that isn't known followed by a name: a type that some header defines
        return t.kind == "id" and t.text not in _KEYWORDS and self.lookup(t.text) is None and (self.peek().kind == "id" and self.peek().text not in _KEYWORDS or self.peek().text == "*" and self.peek(2).kind == "id" and self.peek(3).text in (";", "=", ",", "["))

    def skip_group(self) -> None:
        """Skips a bracketed group whose opening is next."""
        depth = 0
        while self.tok.kind != "eof":
            t = self.next().text
            if t in "([{" and t:
                depth += 1
            elif t in ")]}" and t:
                depth -= 1
                if depth <= 0:
                    return

    def attributes(self) -> None:
        while self.tok.text in ("__attribute__", "__asm__", "asm", "__asm", "__declspec", "_Alignas"):
            self.next()
            if self.tok.text in ("volatile", "__volatile__"):
                self.next()
            if self.tok.text == "(":
                self.skip_group()

    # --- declarations

    def specifiers(self) -> tuple[str, Type]:
        storage, words, base, shown = "", [], None, ""
        while True:
            self.attributes()
            t = self.tok
            if t.text in _STORAGE:
                storage = self.next().text
            elif t.text in _QUALIFIERS:
                if t.text in ("const", "volatile"):
                    shown += t.text + " "
                self.next()
            elif t.text in ("struct", "union"):
                base = self.record()
            elif t.text == "enum":
                base = self.enum()
            elif t.text in ("typeof", "__typeof__"):
                self.next()
                self.skip_group()
                base = UNKNOWN
            elif t.text in _TYPE_WORDS and t.kind == "id":
                words.append(self.next().text)
            elif t.kind == "id" and not words and base is None and t.text not in _KEYWORDS:
                found = self.lookup(t.text)
                if found is not None and found[0] == "typedef":
                    base = Type(found[1].kind, t.text, found[1].inner, found[1].params, found[1].tag)
                elif found is None and (self.peek().kind == "id" or self.peek().text == "*"):
                    base = Type("Unknown", t.text)
                    self.unit.n_errors += 1
                else:
                    break
                self.next()
            else:
                break
        if words:
            plain = sorted(w for w in words if w not in ("signed", "__signed__") or "char" in words)
            if "int" in plain and len(plain) > 1:
                plain.remove("int")
            base = _WORDS.get(" ".join(plain or ["int"]), UNKNOWN)
        if base is None:
            base = INT if storage else UNKNOWN
        return storage, Type(base.kind, shown + base.text, base.inner, base.params, base.tag) if shown else base

    def record(self) -> Type:
        word = self.next().text
        self.attributes()
        if self.tok.kind == "id":
            tag = self.next().text
        else:
            self.anonymous += 1
            tag = f"#{self.anonymous}"
        self.attributes()
        t = Type("Record", f"{word} {tag}", tag=tag)
        if self.tok.text == "{":
            self.next()
            fields = self.records.setdefault(tag, {})
            while self.tok.text != "}" and self.tok.kind != "eof":
                begin = self.at
                _, base = self.specifiers()
                while self.tok.text not in (";", "}") and self.tok.kind != "eof":
                    name, ft, _ = self.declarator(base)
                    if self.eat(":"):
                        self.quietly(self.conditional)
                    if name:
                        fields[name] = ft
                    self.attributes()
                    if not self.eat(","):
                        break
                if base.kind == "Record" and base.tag.startswith("#"):
                    fields.update({k: v for k, v in self.records.get(base.tag, {}).items() if k not in fields})
                if not self.eat(";") and self.at == begin:
                    raise Bad("field")
            self.want("}")
        return t

    def quietly(self, parse) -> Type:
        """Parses an expression whose nodes don't count as code."""
        n = len(self.unit.nodes)
        t = parse()
        del self.unit.nodes[n:]
        beside = self.kids.get(self.above[-1], [])
        while beside and beside[-1]["node_id"] > n:
            beside.pop()
        return t

    def enum(self) -> Type:
        self.next()
        self.attributes()
        tag = self.next().text if self.tok.kind == "id" else ""
        if self.eat("{"):
            while self.tok.text != "}" and self.tok.kind != "eof":
                name = self.next().text
                self.scopes[-1][name] = ("enumerator", INT)
                if self.eat("="):
                    self.conditional()
                if not self.eat(","):
                    break
            self.want("}")
        return Type("Enum", f"enum {tag}")

    def declarator(self, base: Type) -> tuple[str, Type, dict]:
        """Name, type, and for functions where the name stands and the named parameters."""
        while self.tok.text == "*":
            self.next()
            base = base.star()
            while self.tok.text in _QUALIFIERS:
                self.next()
            self.attributes()
        self.attributes()
        name, where, inner = "", {}, None
        if self.tok.text == "(" and (self.peek().text in ("*", "(", "^") or self.peek().kind == "id" and not self.is_type(self.peek()) and self.peek().text not in ("__attribute__",)):
            self.next()
            inner = self.at
            depth = 1
            while depth and self.tok.kind != "eof":
                x = self.next().text
                depth += (x == "(") - (x == ")")
        elif self.tok.kind == "id" and self.tok.text not in _KEYWORDS:
            t = self.next()
            name, where = t.text, {"name_begin": t.begin, "line": t.line, "in_macro": t.macro}
        t = self.suffixes(base, where)
        if inner is not None:
            after, self.at = self.at, inner
            name, t, got = self.declarator(t)
            where = got | ({"params": where["params"]} if "params" in where and "params" not in got else {})
            self.at = after
        return name, t, where

    def suffixes(self, base: Type, where: dict) -> Type:
        if self.tok.text == "[":
            self.next()
            while self.tok.text in _QUALIFIERS | {"static", "*"}:
                self.next()
            if self.tok.text != "]":
                self.assignment()
            self.want("]")
            of = self.suffixes(base, where)
            return Type("Array", of.text + "[]", of)
        if self.tok.text == "(":
            self.next()
            params = self.parameters()
            where.setdefault("params", params)
            self.want(")")
            self.attributes()
            back = self.suffixes(base, {})
            return Type("Function", back.text + " ()", back, tuple(p["t"] for p in params))
        return base

    def parameters(self) -> list[dict]:
        params: list[dict] = []
        if self.tok.text == "void" and self.peek().text == ")":
            self.next()
            return params
        while self.tok.text != ")" and self.tok.kind != "eof":
            if self.eat("..."):
                break
            begin, line = self.tok.begin, self.tok.line
            if not self.is_type(self.tok) and self.tok.kind == "id" and self.peek().text in (",", ")"):  # an old-style list of names
                t, name = INT, self.next().text
            else:
                _, base = self.specifiers()
                name, t, _ = self.declarator(base)
            self.attributes()
            params.append({"name": name, "t": t, "begin": begin, "end": self.last_end, "line": line})
            if not self.eat(","):
                break
        return params

    def comment_before(self, begin: int) -> tuple[int, int]:
        """The comments that end right before an offset, nothing but white space between; (-1, -1) if none."""
        start, end = -1, -1
        at = bisect.bisect_right(self.comment_ends, begin) - 1
        while at >= 0 and not self.text[self.comments[at][1] : begin].strip():
            start, end = self.comments[at][0], max(end, self.comments[at][1])
            begin, at = start, at - 1
        return start, end

    def add_function(self, name: str, t: Type, where: dict, storage: str, begin: int, is_def: bool) -> dict:
        ret = t.inner or UNKNOWN
        cb, ce = self.comment_before(begin)
        line_start = self.text.rfind("\n", 0, where["name_begin"]) + 1
        row = {
            "func": name, "ord": len(self.unit.functions), "line": where["line"], "is_def": is_def, "storage": storage, "ret_type_str": ret.text, "ret_type_kind": ret.kind,
            "params": [{"name": p["name"], "type_str": p["t"].text, "type_kind": p["t"].kind} for p in where.get("params", [])],
            "name_line_off": line_start, "begin": begin, "end": self.last_end, "comment_begin": cb, "comment_end": ce, "in_macro": where["in_macro"], "is_main": name == "main", "body_begin": -1, "body_end": -1,
        }
        self.unit.functions.append(row)
        return row

    def parameter_nodes(self, name: str, params: list[dict]) -> None:
        """Parameters are variables of the function that declares them."""
        outer, self.function = self.function, name
        for p in params:
            row = self.open("ParmVarDecl", p["begin"], p["line"])
            row["op"] = p["name"]
            self.close(row, p["t"])
            row["end"] = p["end"]
        self.function = outer

    def declaration(self, top: bool = False) -> None:
        if self.tok.text == "_Static_assert":
            self.next()
            self.skip_group()
            self.eat(";")
            return
        begin = self.tok.begin
        storage, base = self.specifiers()
        if self.eat(";"):
            return
        while True:
            start = self.tok
            name, t, where = self.declarator(base)
            self.attributes()
            if not name:
                raise Bad("name")
            if top:
                self.unit.names.append(name)
            if storage == "typedef":
                self.scopes[-1][name] = ("typedef", t)
            elif t.kind == "Function":
                self.scopes[0 if not top else -1][name] = ("function", t)
                old_style = top and self.tok.text != "{" and self.tok.text not in (";", ",", "=") and self.is_type(self.tok)
                if top and (self.tok.text == "{" or old_style):
                    self.definition(name, t, where, storage, begin, old_style)
                    return
                self.add_function(name, t, where, storage, begin, False)
                self.parameter_nodes(name, where.get("params", []))
            else:
                row = self.open("VarDecl", begin if start.begin == begin else start.begin, start.line)
                row["op"] = name
                self.scopes[-1][name] = ("variable", t)
                if self.eat("="):
                    self.initializer()
                self.close(row, t)
            if not self.eat(","):
                break
        self.want(";")

    def definition(self, name: str, t: Type, where: dict, storage: str, begin: int, old_style: bool) -> None:
        params = where.get("params", [])
        self.scopes.append({p["name"]: ("variable", p["t"]) for p in params if p["name"]})
        if old_style:
            while self.tok.text != "{" and self.tok.kind != "eof":
                _, base = self.specifiers()
                while True:
                    pname, pt, _ = self.declarator(base)
                    self.scopes[-1][pname] = ("variable", pt)
                    for p in params:
                        if p["name"] == pname:
                            p["t"] = pt
                    if not self.eat(","):
                        break
                self.want(";")
        row = self.add_function(name, t, where, storage, begin, True)
        self.parameter_nodes(name, params)
        self.function = name
        row["body_begin"] = self.tok.begin
        try:
            self.compound()
        finally:
            row["end"] = row["body_end"] = self.last_end
            self.function = "Program"
            self.scopes.pop()

    def initializer(self) -> None:
        if self.eat("{"):
            while self.tok.text != "}" and self.tok.kind != "eof":
                while self.tok.text in (".", "["):
                    if self.next().text == ".":
                        self.next()
                    else:
                        self.conditional()
                        self.want("]")
                    self.eat("=")
                self.initializer()
                if not self.eat(","):
                    break
            self.want("}")
        else:
            self.assignment()

    # --- statements

    def compound(self) -> None:
        self.want("{")
        self.scopes.append({})
        try:
            while self.tok.text != "}" and self.tok.kind != "eof":
                self.guarded(self.statement)
            self.want("}")
        finally:
            self.scopes.pop()

    def guarded(self, parse) -> None:
        """Parses; behind an error goes on after the next ``;`` or before the brace that closes."""
        begin, above = self.at, len(self.above)
        try:
            parse()
        except Bad:
            self.unit.n_errors += 1
            del self.above[above:]
            depth = 0
            while self.tok.kind != "eof":
                t = self.tok.text
                if t == "{":
                    depth += 1
                elif t == "}":
                    if not depth:
                        break
                    depth -= 1
                    if not depth:
                        self.next()
                        break
                elif t == ";" and not depth:
                    self.next()
                    break
                self.next()
            if self.at == begin and self.tok.text != "}":
                self.next()

    def statement(self) -> None:
        t = self.tok
        if t.text == "{":
            self.compound()
        elif t.text == ";":
            self.next()
        elif t.text == "if":
            row = self.open("IfStmt", t.begin, t.line)
            self.next()
            self.want("(")
            cond = self.expression()
            self.want(")")
            row["type_kind"], row["type_str"] = cond.kind, cond.text
            self.statement()
            if self.eat("else"):
                self.statement()
            self.close(row)
        elif t.text in ("while", "switch"):
            row = self.open("WhileStmt" if t.text == "while" else "SwitchStmt", t.begin, t.line)
            self.next()
            self.want("(")
            self.expression()
            self.want(")")
            self.statement()
            self.close(row)
        elif t.text == "do":
            row = self.open("DoStmt", t.begin, t.line)
            self.next()
            self.statement()
            self.want("while")
            self.want("(")
            self.expression()
            self.want(")")
            self.want(";")
            self.close(row)
        elif t.text == "for":
            row = self.open("ForStmt", t.begin, t.line)
            self.next()
            self.want("(")
            self.scopes.append({})
            try:
                if self.starts_declaration():
                    self.declaration()
                else:
                    if self.tok.text != ";":
                        self.expression()
                    self.want(";")
                if self.tok.text != ";":
                    self.expression()
                self.want(";")
                if self.tok.text != ")":
                    self.expression()
                self.want(")")
                self.statement()
            finally:
                self.scopes.pop()
            self.close(row)
        elif t.text == "return":
            self.next()
            if self.tok.text != ";":
                self.expression()
            self.want(";")
        elif t.text in ("break", "continue"):
            self.next()
            self.want(";")
        elif t.text == "goto":
            self.next()
            self.next()
            self.want(";")
        elif t.text == "case":
            self.next()
            self.conditional()
            if self.eat("..."):
                self.conditional()
            self.want(":")
        elif t.text == "default":
            self.next()
            self.want(":")
        elif t.kind == "id" and self.peek().text == ":" and t.text not in _KEYWORDS:
            self.next()
            self.next()
        elif t.text in ("asm", "__asm__", "__asm"):
            self.attributes()
            self.eat(";")
        elif self.starts_declaration():
            self.declaration()
        else:
            self.expression()
            self.want(";")

    # --- expressions: each returns its type

    def expression(self) -> Type:
        t = self.assignment()
        while self.eat(","):
            t = self.assignment()
        return t

    def assignment(self) -> Type:
        begin, line, first = self.tok.begin, self.tok.line, len(self.unit.nodes)
        t = self.conditional()
        if self.tok.text in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=") and self.tok.kind == "op":
            op = self.next().text
            row = self.wrap(first, "BinaryOperator" if op == "=" else "CompoundAssignOperator", begin, line)
            row["op"] = op
            self.assignment()
            self.close(row, t)
        return t

    def conditional(self) -> Type:
        begin, line, first = self.tok.begin, self.tok.line, len(self.unit.nodes)
        t = self.binary(0)
        if self.tok.text == "?":
            self.next()
            if self.eat(":"):
                row = self.wrap(first, "BinaryConditionalOperator", begin, line)
                b = self.conditional()
                t = self.either(t, b)
                self.close(row, t)
                return t
            row = self.wrap(first, "ConditionalOperator", begin, line)
            row["op"] = "?:"
            a = self.expression()
            self.want(":")
            t = self.either(a, self.conditional())
            self.close(row, t)
        return t

    @staticmethod
    def either(a: Type, b: Type) -> Type:
        if a.kind in ("Pointer", "Array"):
            return a
        if b.kind in ("Pointer", "Array"):
            return b
        if a.kind == b.kind and a.kind in ("Void", "Record"):
            return a
        return arithmetic(a, b)

    _LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]

    def binary(self, level: int) -> Type:
        if level == len(self._LEVELS):
            return self.cast()
        begin, line, first = self.tok.begin, self.tok.line, len(self.unit.nodes)
        a = self.binary(level + 1)
        while self.tok.kind == "op" and self.tok.text in self._LEVELS[level]:
            op = self.next().text
            row = self.wrap(first, "BinaryOperator", begin, line)
            row["op"] = op
            b = self.binary(level + 1)
            if level < 2 or level in (5, 6):
                a = INT
            elif op in ("<<", ">>"):
                a = promote(a)
            elif op in ("+", "-") and (a.kind in ("Pointer", "Array") or b.kind in ("Pointer", "Array")):
                both = a.kind in ("Pointer", "Array") and b.kind in ("Pointer", "Array")
                a = LONG if both else Type("Pointer", (a if a.kind in ("Pointer", "Array") else b).text, (a if a.kind in ("Pointer", "Array") else b).inner)
            else:
                a = arithmetic(a, b)
            self.close(row, a)
        return a

    def type_name(self) -> Type:
        _, base = self.specifiers()
        _, t, _ = self.declarator(base)
        return t

    def cast(self) -> Type:
        if self.tok.text == "(" and self.is_type(self.peek()):
            begin, line = self.tok.begin, self.tok.line
            self.next()
            t = self.type_name()
            self.want(")")
            if self.tok.text == "{":
                self.initializer()
                return self.postfix_of(t, begin, line, len(self.unit.nodes), "")
            row = self.open("CastExpr", begin, line)
            self.cast()
            self.close(row, t)
            return t
        return self.unary()

    def unary(self) -> Type:
        t = self.tok
        if t.kind == "op" and t.text in ("++", "--", "+", "-", "~", "!", "&", "*", "&&"):
            row = self.open("UnaryOperator", t.begin, t.line)
            row["op"] = "pre" + t.text if t.text in ("++", "--") else t.text
            self.next()
            if t.text == "&&":  # the address of a label
                self.next()
                of = VOID
            else:
                of = self.unary() if t.text in ("++", "--") else self.cast()
            if t.text in ("++", "--"):
                out = of
            elif t.text == "!":
                out = INT
            elif t.text in ("&", "&&"):
                out = of.star()
            elif t.text == "*":
                out = of if of.kind == "Function" else of.inner or UNKNOWN
            else:
                out = promote(of)
            self.close(row, out)
            return out
        if t.text in ("sizeof", "_Alignof", "__alignof__") and t.kind == "id":
            self.next()
            row = self.open("UnaryExprOrTypeTraitExpr", t.begin, t.line)
            if self.tok.text == "(" and self.is_type(self.peek()):
                self.next()
                self.type_name()
                self.want(")")
            else:
                self.unary()
            self.close(row, ULONG)
            return ULONG
        return self.postfix()

    def postfix(self) -> Type:
        t, first = self.tok, len(self.unit.nodes)
        name = ""
        if t.kind == "num":
            self.next()
            out = self.number(t.text)
        elif t.kind == "chr":
            self.next()
            out = INT
        elif t.kind == "str":
            while self.tok.kind == "str" or self.tok.kind == "id" and self.peek(-1).kind == "str" and self.tok.text in self.macros | {"PRId64": 1, "PRIu64": 1}:
                self.next()
            out = Type("Array", "char[]", CHAR)
        elif t.text == "(":
            self.next()
            if self.tok.text == "{":
                self.compound()
                out = UNKNOWN
            else:
                out = self.expression()
            self.want(")")
        elif t.kind == "id" and t.text not in _KEYWORDS:
            self.next()
            name = "" if t.macro else t.text  # what a macro calls has no place in the file where it could be rewritten
            out = self.reference(t)
        else:
            raise Bad("expression")
        return self.postfix_of(out, t.begin, t.line, first, name)

    @staticmethod
    def number(text: str) -> Type:
        low = text.lower()
        if not low.startswith("0x") and re.search(r"[.e]", low):
            return _WORDS["float"] if low.endswith("f") else _WORDS["double long"] if low.endswith("l") else DOUBLE
        suffix = re.search(r"[ul]*$", low)[0]
        kind = {"": INT, "u": UINT, "l": LONG, "ul": ULONG, "lu": ULONG, "ll": _WORDS["long long"], "ull": _WORDS["long long unsigned"], "llu": _WORDS["long long unsigned"]}.get(suffix, INT)
        digits = low[: len(low) - len(suffix)]
        try:
            value = int(digits, 0) if not re.match(r"0\d", digits) else int(digits, 8)
        except ValueError:
            return INT
        if kind is INT and value >= 1 << 31:
            return UINT if digits.startswith("0") and value < 1 << 32 else LONG
        return kind

    def reference(self, t: Token) -> Type:
        found = self.lookup(t.text)
        calls = self.tok.text == "("
        known = found[1] if found else _NAMES.get(t.text) or (Type("Function", "", LIBC[t.text]) if t.text in LIBC else None)
        if known is None:
            if calls:
                self.unit.undeclared.append(t.text)
                known = Type("Function", "int ()", INT)
            else:
                self.unit.n_errors += 1
                known = UNKNOWN
        if found is None and t.text in _MACROS:  # expands to no reference
            return known
        row = self.open("DeclRefExpr", t.begin, t.line)
        row["op"], row["callee"] = t.text, t.text if known.kind == "Function" else ""
        self.close(row, known)
        row["end"] = t.end
        return known

    def postfix_of(self, t: Type, begin: int, line: int, first: int, name: str) -> Type:
        while self.tok.kind == "op":
            op = self.tok.text
            if op == "(":
                row = self.wrap(first, "CallExpr", begin, line)
                self.next()
                while self.tok.text != ")" and self.tok.kind != "eof":
                    if self.is_type(self.tok) and self.tok.text not in self.macros:  # offsetof, va_arg
                        self.type_name()
                    else:
                        self.assignment()
                    if not self.eat(","):
                        break
                self.want(")")
                if t.kind == "Pointer" and t.inner is not None and t.inner.kind == "Function":
                    t = t.inner
                direct = t.kind == "Function"
                row["callee"] = name if direct else ""
                t = (t.inner or UNKNOWN) if direct else UNKNOWN
                self.close(row, t)
            elif op == "[":
                row = self.wrap(first, "ArraySubscriptExpr", begin, line)
                self.next()
                i = self.expression()
                self.want("]")
                t = (t.inner if t.kind in ("Pointer", "Array") else i.inner) or UNKNOWN
                self.close(row, t)
            elif op in (".", "->"):
                row = self.wrap(first, "MemberExpr", begin, line)
                self.next()
                member = self.next().text
                of = t.inner if op == "->" else t
                t = self.records.get(of.tag if of else "", {}).get(member, UNKNOWN)
                row["op"] = member
                self.close(row, t)
            elif op in ("++", "--"):
                row = self.wrap(first, "UnaryOperator", begin, line)
                row["op"] = "post" + self.next().text
                self.close(row, t)
            else:
                break
            name = ""
        return t

    def run(self) -> Unit:
        while self.tok.kind != "eof":
            if self.eat(";"):
                continue
            if self.tok.text == "}":
                self.unit.n_errors += 1
                self.next()
                continue
            if self.unit.first < 0:
                self.unit.first = self.text.rfind("\n", 0, self.tok.begin) + 1
            self.function = "Program"
            self.guarded(lambda: self.declaration(top=True))
        return self.unit


def parse(text: str | None) -> Unit:
    """A file's rows. Nesting too deep for the parser counts as an error."""
    try:
        p = Parser(text or "")
    except RecursionError:  # macros that grow without end
        return Unit(n_errors=1)
    try:
        return p.run()
    except (RecursionError, IndexError):
        p.unit.n_errors += 1
        return p.unit

"""Code transforms that keep a C program's meaning, over its tokens.

A program is cut into tokens once; declarations tell which names are numbers, pointers or functions. A transform lists
candidate rewrites, each a set of edits that belong together. A level names how many transforms run (1 one, 2 a third,
3 two thirds, 4 all) and what share of each one's candidates they take. Which ones is decided by a hash of the seed, so a
row gives the same result wherever it runs. Rewrites that would leave the program with more faults than it had are taken
back one by one. Strings, characters, comments and directives never change.

What is read out of a program (its tokens, candidates and faults) depends on its code alone and is remembered, so a program is
read once however many transforms look at it, and programs that come again, as rows or as steps to others, are not read anew.
So is what all candidates of a transform together make of a program, where they meet neither one another nor a fault and the
seed has no say in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

SHARE = {1: 0.0, 2: 0.33, 3: 0.66, 4: 1.0}
Edit = tuple[int, int, str]
#: Characters, or their like in edits, that a worker remembers of each of the functions below.
REMEMBERED = 1 << 23

# Operators of a compound assignment, comparisons turned round, scalar types that an alias may stand for, names that stay.
COMPOUND = ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>")
TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
SCALARS = (
    "bool", "char", "signed char", "unsigned char", "short", "short int", "unsigned short", "unsigned short int", "int", "unsigned", "unsigned int", "long", "long int", "unsigned long",
    "unsigned long int", "long long", "long long int", "unsigned long long", "unsigned long long int", "float", "double", "long double",
)
INT_ALIAS_HINTS = ("int", "count", "size", "offset", "id", "index", "num", "len")
ENTRY_MARKS = ("__global__", "__kernel", "__kernel__", "blockIdx", "threadIdx", "get_global_id", "get_local_id")

_TYPE_WORDS = frozenset("bool char short int long float double unsigned signed size_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
_QUALIFIERS = frozenset("const volatile static register extern inline restrict __restrict__ struct".split())
_KEYWORDS = _TYPE_WORDS | _QUALIFIERS | frozenset("if else for while do switch case default return break continue goto sizeof typedef void union enum NULL true false main auto".split())
_REAL = frozenset("float double".split())
#: Binary operators by how tightly they bind.
_BINDS = {op: k for k, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")) for op in ops.split()}
_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<directive>\#(?:\\\n|[^\n])*)|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<mark><<<|>>>|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|.)", re.S | re.M,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Function:
    name: str
    head: int  # token after the last ";" or "}" before it
    opened: int  # its "{" and "}"
    closed: int


@dataclass
class Program:
    code: str
    tokens: list[Token] = field(default_factory=list)
    directives: str = ""
    match: dict[int, int] = field(default_factory=dict)  # a bracket's partner
    functions: list[Function] = field(default_factory=list)  # in their order; none is inside another
    ends: list[int] = field(default_factory=list)  # where each is closed
    variables: dict[tuple[str, str], tuple[str, bool]] = field(default_factory=dict)  # (function or "", name): type, whether a pointer or array
    types: set[str] = field(default_factory=set)  # names that typedefs make
    members: set[int] = field(default_factory=set)  # tokens in the bodies of structures
    faults: int = 0

    def __post_init__(self) -> None:
        for m in _TOKEN.finditer(self.code):
            if m.lastgroup == "directive":
                self.directives += m[0] + "\n"
            elif m.lastgroup == "skip":
                self.faults += m[0].startswith("/*") and not (m[0].endswith("*/") and len(m[0]) > 3)
            else:
                self.tokens.append(Token(m.lastgroup, m[0], m.start(), m.end()))
                self.faults += m.lastgroup == "text" and (len(m[0]) < 2 or m[0][0] != m[0][-1])
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in "([{":
                open_.append(i)
            elif t.kind == "mark" and t.text in ")]}":
                if open_ and "([{".index(self.tokens[open_[-1]].text) == ")]}".index(t.text):
                    self.match[i] = open_.pop()
                    self.match[self.match[i]] = i
                else:
                    self.faults += 1
        self.faults += len(open_)
        for i, t in enumerate(self.tokens):
            if t.text in ("struct", "union", "enum"):
                at = i + 1 + (self.text(i + 1) != "{")
                if self.text(at) == "{" and at in self.match:
                    self.members.update(range(at, self.match[at] + 1))
            elif t.text == "typedef":
                end = i
                while end < len(self.tokens) and self.text(end) != ";":
                    end = self.match.get(end, end) + 1
                self.types.add(self.text(end - 1))
        self._functions()
        self._declarations()

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def source(self, a: int, b: int) -> str:
        """The code of tokens a to b, b not included."""
        return self.code[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""

    def _functions(self) -> None:
        i = head = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "mark" and t.text == "{" and i in self.match:
                if self.text(i - 1) == ")" and i - 1 in self.match and self.tokens[self.match[i - 1] - 1].kind == "name":
                    self.functions.append(Function(self.text(self.match[i - 1] - 1), head, i, self.match[i]))
                i = self.match[i]
                head = i + 1
            elif t.text == ";":
                head = i + 1
            i += 1
        self.ends = [f.closed for f in self.functions]

    def owner(self, i: int) -> str:
        """The function that token i is in, its head included."""
        k = bisect_left(self.ends, i)
        return self.functions[k].name if k < len(self.ends) and self.functions[k].head <= i else ""

    def _declarations(self) -> None:
        kinds, taken = _TYPE_WORDS | _QUALIFIERS | self.types, _KEYWORDS | self.types
        for i in range(1, len(self.tokens) - 1):  # of a structure, after its body
            if self.text(i - 1) == "}" and i - 1 in self.members and self.tokens[i].kind == "name" and self.text(i) not in taken and self.text(i + 1) in (";", ",", "=", "["):
                self.variables[self.owner(i), self.text(i)] = ("struct", self.text(i + 1) == "[")
        i = 0
        while i < len(self.tokens):
            before = self.text(i - 1)
            if i in self.members or not (self.tokens[i].text in kinds and (i == 0 or before in ("{", "}", ";", "(", ",", ")", ":") or self.tokens[i - 1].kind != "mark")):
                i += 1
                continue
            words = []
            while self.text(i) in kinds:
                words.append(self.text(i))
                i += 1
            kind = " ".join(w for w in words if w not in _QUALIFIERS)
            while kind or "struct" in words:
                stars = 0
                while self.text(i) in ("*", "&", "const", "__restrict__", "restrict"):
                    stars += self.text(i) == "*"
                    i += 1
                if i >= len(self.tokens) or self.tokens[i].kind != "name" or self.text(i) in _KEYWORDS or self.text(i + 1) == "(":
                    break
                name, after = self.text(i), self.text(i + 1)
                if after not in (";", "=", ",", ")", "[", ":"):
                    break
                self.variables[self.owner(i), name] = (kind, stars > 0 or after == "[")
                i += 1
                depth = 0
                while i < len(self.tokens) and not (depth == 0 and self.text(i) in (",", ";", ")")):
                    depth += (self.text(i) in ("(", "[", "{")) - (self.text(i) in (")", "]", "}"))
                    if depth < 0:
                        break
                    i += 1
                if self.text(i) != "," or self.text(i + 1) in kinds:
                    break
                i += 1

    def variable(self, i: int) -> tuple[str, bool] | None:
        """What the name at token i is declared as."""
        name = self.text(i)
        return self.variables.get((self.owner(i), name)) or self.variables.get(("", name))

    def aliases(self) -> list[tuple[str, str]]:
        """(alias, scalar type) of every typedef that may be expanded."""
        out = []
        for i, t in enumerate(self.tokens):
            if t.text != "typedef":
                continue
            end = next((k for k in range(i, len(self.tokens)) if self.text(k) in (";", "{", "(", "*", "[")), len(self.tokens))
            if self.text(end) == ";" and end > i + 2:
                kind = " ".join(self.text(k) for k in range(i + 1, end - 1) if self.text(k) not in ("const", "volatile"))
                alias = self.text(end - 1)
                if kind in SCALARS and (kind != "int" or any(x in alias.lower() for x in INT_ALIAS_HINTS)):
                    out.append((alias, " ".join(self.text(k) for k in range(i + 1, end - 1))))
        return out

    def member(self, i: int) -> bool:
        return self.text(i - 1) in (".", "->")


def _quiet(p: Program, a: int, b: int) -> bool:
    """Whether tokens a to b neither call, assign, count nor choose, so that they may change places."""
    return a < b and not any(
        p.text(i) in ("=", "++", "--", "?", ",", ";", "{", "}") or (p.tokens[i].kind == "mark" and len(p.text(i)) > 1 and p.text(i)[-1] == "=" and p.text(i) not in TURNED) or (p.tokens[i].kind == "name" and p.text(i + 1) == "(")
        for i in range(a, b)
    )


def _operand(p: Program, i: int, step: int, binds: int) -> int:
    """The last token, seen from i onwards in a direction, of an operand of an operator that binds so."""
    at = i
    while 0 <= at < len(p.tokens):
        text = p.text(at)
        if text in ("([{" if step < 0 else ")]}") and p.tokens[at].kind == "mark":
            return at - step
        if at in p.match and text in (")]}" if step < 0 else "([{"):
            at = p.match[at]
        elif text in (";", ",", "?", ":", "=", "return", "&&", "||") or (text in _BINDS and _BINDS[text] <= binds and p.tokens[at].kind == "mark" and not _prefix(p, at)):
            return at - step
        at += step
    return at - step


def _prefix(p: Program, i: int) -> bool:
    """Whether an operator stands before its only operand."""
    if p.text(i - 1) == ")" and p.text(p.match.get(i - 1, 0) - 1) in ("if", "while", "for", "switch"):
        return True
    return i == 0 or (p.tokens[i - 1].kind == "mark" and p.text(i - 1) not in (")", "]")) or p.text(i - 1) in ("return", "case", "else")


def _conditions(p: Program) -> Iterator[tuple[int, int]]:
    """Token ranges of the conditions of if, while and for."""
    for i, t in enumerate(p.tokens):
        if t.text in ("if", "while") and p.text(i + 1) == "(" and i + 1 in p.match:
            yield i + 2, p.match[i + 1]
        elif t.text == "for" and p.text(i + 1) == "(" and i + 1 in p.match:
            ends = [k for k in range(i + 2, p.match[i + 1]) if p.text(k) == ";"]
            if len(ends) == 2:
                yield ends[0] + 1, ends[1]


def arithmetic(p: Program) -> Iterator[list[Edit]]:
    """x += e to x = x + (e), and x = x + e to x += e for whole numbers; whole statements only."""
    for i, t in enumerate(p.tokens):
        if t.kind != "name" or p.member(i) or p.text(i - 1) not in (";", "{", "}", ")", "else") or not (known := p.variable(i)) or known[1]:
            continue
        if p.text(i - 1) == ")" and p.text(p.match.get(i - 1, 0) - 1) not in ("if", "while", "for"):
            continue
        end = next((k for k in range(i, len(p.tokens)) if p.text(k) in (";", "{", "}", ",")), -1)
        if end < i + 3 or p.text(end) != ";":
            continue
        op = p.text(i + 1)
        if op[-1] == "=" and op[:-1] in COMPOUND:
            yield [(t.start, p.tokens[end - 1].end, f"{t.text} = {t.text} {op[:-1]} ({p.source(i + 2, end)})")]
        elif op == "=" and p.text(i + 2) == t.text and p.text(i + 3) in COMPOUND and end > i + 4 and not set(known[0].split()) & _REAL:
            if _operand(p, i + 4, 1, _BINDS[p.text(i + 3)]) == end - 1:  # the rest is one operand
                yield [(t.start, p.tokens[end - 1].end, f"{t.text} {p.text(i + 3)}= {p.source(i + 4, end)}")]


def swapped(p: Program) -> Iterator[list[Edit]]:
    """a < b to b > a in conditions, where neither side does anything."""
    for begin, end in _conditions(p):
        for i in range(begin + 1, end - 1):
            if p.text(i) in TURNED and p.tokens[i].kind == "mark":
                a, b = _operand(p, i - 1, -1, _BINDS[p.text(i)]), _operand(p, i + 1, 1, _BINDS[p.text(i)])
                if begin <= a < i < b < end and _quiet(p, a, i) and _quiet(p, i + 1, b + 1) and not any(p.text(k) in TURNED for k in (a - 1, b + 1)):
                    yield [(p.tokens[a].start, p.tokens[b].end, f"{p.source(i + 1, b + 1)} {TURNED[p.text(i)]} {p.source(a, i)}")]


def indexed(p: Program) -> Iterator[list[Edit]]:
    """*(a + i) and *(i + a) to (a)[i], for a pointer or array and a whole number."""
    for i in range(len(p.tokens) - 5):
        if p.text(i) != "*" or not _prefix(p, i) or p.text(i + 1) != "(" or p.text(i + 3) != "+" or p.match.get(i + 1) != i + 5:
            continue
        for base, place in ((i + 2, i + 4), (i + 4, i + 2)):
            of, by = p.variable(base), p.variable(place)
            whole = p.text(place).isdigit() or (by and not by[1] and not set(by[0].split()) & _REAL)
            if p.tokens[base].kind == "name" and of and of[1] and whole:
                yield [(p.tokens[i].start, p.tokens[i + 5].end, f"({p.text(base)})[{p.text(place)}]")]
                break


def expanded(p: Program) -> Iterator[list[Edit]]:
    """An alias of a scalar type to that type, wherever it is used."""
    known = dict(p.aliases())
    for i, t in enumerate(p.tokens):
        if t.kind == "name" and t.text in known and not p.member(i) and not (p.text(i + 1) == ";" and any(p.text(k) == "typedef" for k in range(max(0, i - 5), i))):
            yield [(t.start, t.end, known[t.text])]


def _fresh(p: Program, stem: str) -> Iterator[str]:
    used, k = set(re.findall(r"\w+", p.code)), 0
    while True:
        k += 1
        if f"{stem}{k}" not in used:
            yield f"{stem}{k}"


def renamed(p: Program) -> Iterator[list[Edit]]:
    """A local variable or parameter by another name, at every use; those that directives name stay."""
    fresh, spoken = _fresh(p, "v"), set(re.findall(r"\w+", p.directives))
    for (owner, name), _ in list(p.variables.items()):
        f = next((x for x in p.functions if x.name == owner), None)
        if f is None or name in spoken:
            continue
        at = [k for k in range(f.head, f.closed) if p.tokens[k].kind == "name" and p.text(k) == name and not p.member(k) and k not in p.members and p.text(k + 1) != "("]
        if len(at) > 1:
            new = next(fresh)
            yield [(p.tokens[k].start, p.tokens[k].end, new) for k in at]


def renamed_functions(p: Program) -> Iterator[list[Edit]]:
    """A static function by another name, at its definition and calls; entry points and names that strings spell stay."""
    fresh, spoken = _fresh(p, "fn"), set(re.findall(r"\w+", p.directives + " ".join(t.text for t in p.tokens if t.kind == "text")))
    for f in p.functions:
        inside = {p.text(k) for k in range(f.head, f.closed)}
        if f.name in spoken | {"main"} or "static" not in {p.text(k) for k in range(f.head, f.opened)} or inside & set(ENTRY_MARKS):
            continue
        at = [k for k, t in enumerate(p.tokens) if t.kind == "name" and t.text == f.name and not p.member(k)]
        if len(at) > 1 and sum(g.name == f.name for g in p.functions) == 1:
            new = next(fresh)
            yield [(p.tokens[k].start, p.tokens[k].end, new) for k in at]


#: In the order in which those that run are applied.
TRANSFORMS: dict[str, Callable[[Program], Iterator[list[Edit]]]] = {
    "ArithmeticTransform": arithmetic, "SwapCondition": swapped, "PointerArithmeticToArrayIndex": indexed, "TypedefExpansion": expanded, "ChangeNames": renamed, "ChangeFunctionNames": renamed_functions,
}


def applied(code: str, edits: list[Edit]) -> str:
    for a, b, new in sorted(set(edits), reverse=True):
        code = code[:a] + new + code[b:]
    return code


def _remembered(read: Callable) -> Callable:
    """A function of a code and more with what it gave before; all is forgotten when it comes to about ``REMEMBERED`` characters."""
    known: dict[tuple, object] = {}
    held = 0

    @wraps(read)
    def f(*key):
        nonlocal held
        if (found := known.get(key)) is None:
            found = read(*key)
            size = 100 + len(key[0]) + (sum(100 + len(new) for edits in found for _, _, new in edits) if isinstance(found, list) else 0)
            if held + size > REMEMBERED:
                known.clear()
                held = 0
            held += size
            known[key] = found
        return found

    return f


@lru_cache(4)
def _read(code: str) -> Program:
    return Program(code)


@_remembered
def _candidates(code: str, transform: Callable[[Program], Iterator[list[Edit]]]) -> list[list[Edit]]:
    return list(transform(_read(code)))


@_remembered
def faults(code: str) -> int:
    """Unbalanced brackets, open texts, and names used as variables that nothing declares."""
    p = _read(code)
    known = {n for _, n in p.variables} | _KEYWORDS | {f.name for f in p.functions} | p.types | {p.text(i) for i in p.members} | {p.text(i + 1) for i, t in enumerate(p.tokens) if t.text in ("struct", "union", "enum")} | set(re.findall(r"\w+", p.directives))
    loose = {t.text for i, t in enumerate(p.tokens) if t.kind == "name" and t.text not in known and p.text(i + 1) != "(" and not p.member(i)}
    return p.faults + len(loose)


def _by(seed: str, what: str) -> bytes:
    return hashlib.sha256(f"{seed}:{what}".encode()).digest()


@_remembered
def _all_of(code: str, transform: Callable[[Program], Iterator[list[Edit]]]) -> list[list[Edit]]:
    """The one edit from the code to what all of a transform's candidates make of it; none where they overlap or make faults, so that the seed decides."""
    edits = sorted(e for edits in _candidates(code, transform) for e in edits)
    if any(b[0] < a[1] or a[0] == b[0] for a, b in zip(edits, edits[1:])) or faults(new := applied(code, edits)) > faults(code):
        return []
    return [[(0, len(code), new)]]


def rewritten(code: str, name: str, share: float, seed: str) -> str:
    """The code after a share of a transform's candidates, one at least; those that overlap earlier ones or make faults are left out."""
    if share == 1 and (whole := _all_of(code, TRANSFORMS[name])):
        return whole[0][0][2]
    found = _candidates(code, TRANSFORMS[name])
    order = sorted(range(len(found)), key=lambda i: _by(seed, f"{name}:{i}"))
    chosen, taken = [], []
    for i in order[: max(1, round(share * len(found)))]:
        if not any(a < y and x < b for a, b, _ in found[i] for x, y, _ in taken):
            chosen.append(found[i])
            taken += found[i]
    most = faults(code)
    if faults(applied(code, taken)) <= most:
        return applied(code, taken)
    kept: list[Edit] = []
    for edits in chosen:
        if faults(applied(code, kept + edits)) <= most:
            kept += edits
    return applied(code, kept)


def transformed(code: str, level: int, seed: str) -> tuple[str, list[str]]:
    """UDF-01: the code at a level, and the names of the transforms that changed it."""
    if level not in SHARE:
        return code, []
    pool = sorted(TRANSFORMS, key=lambda name: _by(seed, name))
    run = set(pool[: max(1, int(len(pool) * SHARE[level]))])
    names = []
    for name in TRANSFORMS:
        if name in run and (new := rewritten(code, name, SHARE[level], seed)) != code:
            code = new
            names.append(name)
    return code, names


def single(code: str, seed: str) -> tuple[str, list[str]]:
    """UDF-03: all candidates of exactly one transform, chosen by the seed among those that apply."""
    for name in sorted(TRANSFORMS, key=lambda x: _by(seed, x)):
        if (new := rewritten(code, name, 1.0, seed)) != code:
            return new, [name]
    return code, []


_RESULT = StructType([StructField("code", StringType()), StructField("transforms", ArrayType(StringType())), StructField("valid", BooleanType())])


def _rows(made: list[tuple[str, list[str]]], code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(c, names, faults(c) <= faults(old or "")) for (c, names), old in zip(made, code, strict=True)], columns=["code", "transforms", "valid"])


@F.pandas_udf(_RESULT)
def transform_code(code: pd.Series, level: pd.Series, seed: pd.Series) -> pd.DataFrame:
    return _rows([transformed(c or "", int(n), s) for c, n, s in zip(code, level, seed, strict=True)], code)


@F.pandas_udf(_RESULT)
def one_transform(code: pd.Series, seed: pd.Series) -> pd.DataFrame:
    return _rows([single(c or "", s) for c, s in zip(code, seed, strict=True)], code)


def validation_report(made: DataFrame, transforms: Column, valid: Column, changed: Column) -> DataFrame:
    """UDF-03: by transform, how many programs it was applied to, how many changed and how many have no new faults."""
    rows = made.select(F.explode_outer(transforms).alias("transform"), valid.alias("valid"), changed.alias("changed"))
    return rows.groupBy(F.coalesce("transform", F.lit("none")).alias("transform")).agg(F.count("*").alias("programs"), F.count_if("changed").alias("changed"), F.count_if("valid").alias("valid"))



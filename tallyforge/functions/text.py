"""Text and code functions (PRJ-11 to PRJ-16, PRJ-18, PRJ-26, PRJ-27, PRJ-29) as columns; a scanner where state is needed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def strip_reasoning(s: Column, tag: str = "think") -> Column:
    """PRJ-11: without whole <think> blocks; then, if only a closing tag is left, without all up to the first one; if
    only an opening one is left, without all from it on."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    whole = F.regexp_replace(s, f"(?s){opening}.*?{closing}", "")
    lone_end = whole.contains(closing) & ~whole.contains(opening)
    lone_start = whole.contains(opening) & ~whole.contains(closing)
    return stripped(F.when(lone_end, F.regexp_replace(whole, rf"(?s)\A.*?{closing}\s*", "")).when(lone_start, F.substring_index(whole, opening, 1)).otherwise(whole))


def fenced_named(s: Column) -> Column:
    """PRJ-12, first two tiers: file name -> body of fences that name their file as ``filename=x`` or after a blank."""
    pattern = r"(?s)```[\w+#-]*[ \t]+(?:filename=)?[\"']?(?:[\w./-]*/)?([\w.-]+\.\w+)[\"']?[^\n]*\n(.*?)```"
    names, bodies = F.regexp_extract_all(s, F.lit(pattern), 1), F.regexp_extract_all(s, F.lit(pattern), 2)
    pairs = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    first = F.filter(pairs, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["body"])))


_FENCE = re.compile(r"```\w*[^\n]*\n(.*?)```", re.S)


@F.pandas_udf(MapType(StringType(), StringType()))
def fenced_for_targets(texts: pd.Series, targets: pd.Series) -> pd.Series:
    """PRJ-12, last two tiers, for target names that come with each row: a name within 500 characters before a fence,
    or the one block for the one target."""

    def find(text: str | None, names) -> dict[str, str]:
        blocks = [(m.start(), m[1]) for m in _FENCE.finditer(text or "")]
        out: dict[str, str] = {}
        for name in names if names is not None else ():
            base = name.rsplit("/", 1)[-1]
            for at, body in blocks:
                if re.search(rf"(?<![\w.]){re.escape(base)}(?![\w])", text[max(0, at - 500) : at]):
                    out[base] = body
                    break
        left = [n for n in (x.rsplit("/", 1)[-1] for x in (names if names is not None else ())) if n not in out]
        if len(left) == 1 and len(blocks) == 1:
            out[left[0]] = blocks[0][1]
        return out

    return pd.Series([find(t, n) for t, n in zip(texts, targets, strict=True)])


def renamed(files: Column, names: dict[str, str]) -> Column:
    """PRJ-13: keys of a file map, and quoted uses of them in the bodies, set back to their real names."""
    keys = F.transform_keys(files, lambda k, _: F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[k], k))

    def body(_: Column, v: Column) -> Column:
        for old, new in names.items():
            for quote in "\"'":
                v = F.replace(v, F.lit(f"{quote}{old}{quote}"), F.lit(f"{quote}{new}{quote}"))
        return F.regexp_replace(v, r"(?m)^make \w+\n?", "")

    return F.transform_values(keys, body)


def without_comments(code: str) -> str:
    """C and C++ source without comments; strings, characters and raw strings stay as they are."""
    out, i, n = [], 0, len(code)
    while i < n:
        c = code[i]
        if code.startswith("//", i):
            while i < n and code[i] != "\n":
                i += 2 if code.startswith("\\\n", i) else 1
        elif code.startswith("/*", i):
            end = code.find("*/", i + 2)
            body = code[i : n if end < 0 else end + 2]
            out.append("\n" * body.count("\n") or " ")
            i += len(body)
        elif code.startswith('R"', i) and not (i and (code[i - 1].isalnum() or code[i - 1] == "_")) and (m := re.compile(r'R"([^()\\\s]{0,16})\(').match(code, i)):
            end = code.find(f'){m[1]}"', m.end())
            stop = n if end < 0 else end + len(m[1]) + 2
            out.append(code[i:stop])
            i = stop
        elif c in "\"'":
            j = i + 1
            while j < n and code[j] != c and code[j] != "\n":
                j += 2 if code[j] == "\\" else 1
            out.append(code[i : j + 1])
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def strip_comments(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """PRJ-14; a scanner with state, which no regular expression replaces."""
    for part in codes:
        yield part.map(lambda c: None if c is None else without_comments(c))


def non_blank_lines(s: Column) -> Column:
    """PRJ-15, simple form."""
    return F.size(F.filter(F.split(s, "\n"), lambda x: stripped(x) != ""))


def physical_sloc(s: Column) -> Column:
    """PRJ-15: lines with code outside comments, by a fold over lines that carries whether a block comment is open."""

    def step(a: Column, line: Column) -> Column:
        closed = F.when(a["open"], F.when(line.contains("*/"), F.regexp_replace(line, r"^.*?\*/", "")).otherwise("")).otherwise(line)
        bare = F.regexp_replace(F.regexp_replace(closed, r"/\*.*?\*/", ""), r"//.*$", "")
        opens = (a["open"] & ~line.contains("*/")) | bare.contains("/*")
        code = stripped(F.regexp_replace(bare, r"/\*.*$", "")) != ""
        return F.struct(opens.alias("open"), (a["n"] + F.when(code, 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))
    return F.aggregate(F.split(s, "\n"), start, step, lambda a: a["n"])


def head_and_tail(s: Column, most: int = 1500) -> Column:
    """PRJ-16."""
    half = most // 2
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(half)), F.lit("\n...[truncated]...\n"), F.right(s, F.lit(half)))).otherwise(s)


def substituted(s: Column, variables: Column) -> Column:
    """PRJ-26: ${VAR} by its value in a map; unknown names stay."""
    return F.aggregate(F.map_entries(variables), s, lambda a, e: F.replace(a, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def cpu_seconds(s: Column) -> Column:
    """PRJ-27: user plus system seconds; null if either is absent."""
    part = lambda name: F.nullif(F.regexp_extract(s, rf"(?m)^{name}\s+(\d+(?:\.\d+)?)\s*$", 1), F.lit("")).cast("double")
    return part("user") + part("sys")


# Reasons to reject an output, in order, with their patterns (case does not matter).
ERROR_SIGNS = {
    "OpenCL kernel build failure": r"clBuildProgram\s*\(\)\s*=>\s*-\d+",
    "OpenCL kernel compile failure": r"clCompileProgram\s*\(\)\s*=>\s*-\d+",
    "Segfault in stdout": r"Segmentation fault",
    "CUDA runtime error": r"CUDA error:",
    "CUDA error": r"cudaError(?!Success)\w*:",
}


def error_sign(s: Column) -> Column:
    """PRJ-29: "reason: match" of the first sign found, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ERROR_SIGNS.items()):
        out = F.when(s.rlike(f"(?i){pattern}"), F.concat(F.lit(f"{name}: "), F.regexp_extract(s, f"(?i)({pattern})", 1))).otherwise(out)
    return out

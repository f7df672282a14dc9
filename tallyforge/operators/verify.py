"""Verification of runs against an oracle's strategies: conjunctive, ordered, fail-closed (VER-01 to VER-06)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A strategy; which fields count depends on its type.
STRATEGY = "type string, expected string, pattern string, multiline boolean, tolerance string, path string, sha256 string"


def exit_code(expected: Column, actual: Column) -> Column:
    """VER-02: equal to a whole number; anything else expected is an ERROR."""
    number = expected.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & ~F.lower(expected).isin("true", "false")
    return F.when(~F.coalesce(whole, F.lit(False)), "ERROR").when(number == actual, "PASS").otherwise("FAIL")


def numeric(stdout: Column, pattern: str, expected: Column, tolerance: Column) -> Column:
    """VER-04 for a pattern known to the plan: group 1 as a number within the tolerance, which is 0 where there is none."""
    e, t = expected.try_cast("double"), F.when(tolerance.isNull(), 0.0).otherwise(tolerance.try_cast("double"))
    got = F.nullif(F.regexp_extract(stdout, pattern, 1), F.lit("")).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    bad = ~finite(e) | ~finite(t) | (t < 0)
    return F.when(F.coalesce(bad, F.lit(True)), "ERROR").when(got.isNull() | F.isnan(got), "FAIL").when(F.abs(got - e) <= t, "PASS").otherwise("FAIL")


def file_hash(expected: Column, actual: Column, escapes: Column) -> Column:
    """VER-05: a missing file or a path out of the tree fails; a malformed expectation is an ERROR."""
    return F.when(~F.coalesce(expected.rlike("^[0-9a-f]{64}$"), F.lit(False)), "ERROR").when(escapes | actual.isNull(), "FAIL").when(expected == actual, "PASS").otherwise("FAIL")


def _number(x) -> float | None:
    if x is None or str(x).strip().lower() in ("true", "false"):
        return None
    try:
        v = float(x)
    except ValueError:
        return None
    return v if math.isfinite(v) else None


def judge(strategy: dict, run: dict) -> str:
    """PASS, FAIL or ERROR of one strategy; a type or a field it does not know is an ERROR."""
    kind = strategy.get("type")
    stdout = run.get("stdout") or ""
    if kind == "exit_code":
        want = _number(strategy.get("expected"))
        return "ERROR" if want is None or want != int(want) else "PASS" if run.get("exit_code") == int(want) else "FAIL"
    if kind in ("stdout_pattern", "stdout_exclude_pattern", "numeric_comparison"):
        if not strategy.get("pattern"):
            return "ERROR"
        try:
            found = re.search(strategy["pattern"], stdout, re.M if strategy.get("multiline") else 0)
        except re.error:
            return "ERROR"
        if kind == "stdout_pattern":
            return "PASS" if found else "FAIL"
        if kind == "stdout_exclude_pattern":
            return "FAIL" if found else "PASS"
        given = strategy.get("tolerance")
        want, tolerance = _number(strategy.get("expected")), 0.0 if given is None else _number(given)
        if want is None or tolerance is None or tolerance < 0:
            return "ERROR"
        got = _number(found[1] if found and found.re.groups else found[0]) if found else None
        return "FAIL" if got is None or abs(got - want) > tolerance else "PASS"
    if kind in ("file_hash", "file_diff"):
        path, want = strategy.get("path"), strategy.get("sha256")
        if not path or not re.fullmatch(r"[0-9a-f]{64}", want or ""):
            return "ERROR"
        if path.startswith("/") or ".." in path.split("/"):
            return "FAIL" if kind == "file_hash" else "ERROR"
        return "PASS" if (run.get("files") or {}).get(path) == want else "FAIL"
    return "ERROR"


def verify_run(strategies: list[dict], run: dict) -> tuple[str, str]:
    """VER-01: the first that does not pass, with its type; all types joined by '+' on PASS; SKIP without any."""
    if not strategies:
        return "SKIP", ""
    for s in strategies:
        status = judge(s, run)
        if status != "PASS":
            return status, s.get("type") or ""
    return "PASS", "+".join(s["type"] for s in strategies)


def verify(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, status, strategy) for rows of (key, exit_code, stdout, files map, strategies array).

    Patterns come with the rows, and an invalid one must give ERROR for its row alone, so this part is Python; rows
    are judged on their own and no shuffle is needed. Null stdout counts as empty, null strategies as none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, code, stdout, files, s in zip(f[key], f.exit_code, f.stdout, f["files"], f.strategies, strict=True):
                given = [x if isinstance(x, dict) else x.asDict() for x in s] if s is not None else []
                code = None if code is None or code != code else int(code)
                out.append((k, *verify_run(given, {"exit_code": code, "stdout": stdout, "files": dict(files) if files is not None else {}})))
            yield pd.DataFrame(out, columns=[key, "status", "strategy"])

    chosen = runs.select(key, "exit_code", "stdout", "files", "strategies")
    return chosen.mapInPandas(run, f"`{key}` {dict(runs.dtypes)[key]}, status string, strategy string")


def metrics(stdout: Column, definitions: dict[str, str]) -> Column:
    """VER-06: (name, value) of each metric that its pattern finds a number for; others give no row."""
    entry = lambda name, pattern: F.struct(F.lit(name).alias("name"), F.nullif(F.regexp_extract(stdout, pattern, 1), F.lit("")).try_cast("double").alias("value"))
    return F.filter(F.array(*[entry(n, p) for n, p in definitions.items()]), lambda x: x["value"].isNotNull())

"""The command line, in the session of the tests."""

import json

import pytest

from tallyforge import cli


def test_list_and_run(spark, data, capsys):
    assert cli.main(["list"]) == 0 and "agg03_dimension_slices: " in capsys.readouterr().out
    assert cli.main(["run", "agg01_status_breakdown", data]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", data])


def test_chain_ends_with_the_first_failure(spark, data, capsys, tmp_path):
    assert cli.main(["chain", "agg01_status_breakdown,top01_top_n", data]) == 0
    assert capsys.readouterr().out.splitlines() == ["agg01_status_breakdown: 3 rows", "top01_top_n: 3 rows"]
    assert cli.main(["chain", "agg01_status_breakdown,top01_top_n", str(tmp_path)]) == 1
    assert len(capsys.readouterr().out.splitlines()) == 1


def test_pairs_need_their_specifications(spark, tmp_path, capsys):
    entry = lambda k, api, there: {"kernel_name": k, "parallel_api": api, "source_suite": "s", "spec_file": f"specs/s-{k}-{api}.json", "source_dir": "", "category": ""}
    rows = [entry("a", "cuda", 1), entry("a", "omp", 1), entry("a", "omp", 1), entry("a", "opencl", 0), entry("b", "cuda", 1)]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    (tmp_path / "specs").mkdir()
    for name in ("s-a-cuda", "s-a-omp", "s-b-cuda"):
        (tmp_path / "specs" / f"{name}.json").write_text(json.dumps({"identity": {"unique_id": name if name != "s-b-cuda" else "s-a-cuda"}}, indent=1))
    (tmp_path / "specs" / "z.json").write_text("{\n")
    got = [tuple(r) for r in cli.stored_pairs(spark, str(tmp_path / "manifest.jsonl"), str(tmp_path / "specs")).collect()]
    assert got == [("s", "a", "cuda", "omp"), ("s", "a", "omp", "cuda")]
    assert cli.main(["info", str(tmp_path / "specs")]) == 0
    out = capsys.readouterr().out
    assert "duplicate id" in out and "malformed" in out and "s-a-omp.json" in out


def test_verify_stored_runs(spark, tmp_path):
    good = {"run_id": "r1", "exit_code": 0, "stdout": "ok", "strategies": [{"type": "exit_code", "expected": "0"}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"run_id": "r2", "strategies": []}) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(good | {"exit_code": 3}) + "\n")
    assert cli.main(["verify", str(tmp_path / "a.jsonl")]) == 0 and cli.main(["verify", str(tmp_path / "b.jsonl")]) == 1

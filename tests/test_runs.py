"""The index over files of many runs, and rows rebuilt from artefacts."""

import json

from hindcast.sources import runs

FULL = {"run_summary": {"generated_at": "2024-01-02", "inputs": {"cohort_hash": "c1"}, "watermark": {"db_max_event_occurred_at": "2024-01-01"}, "hashes": {"report_json_sha256": "h"}},
        "manifest": {"generated_at": "2023-01-01", "db_max_watermark_updated_at": "w"}, "report": {}}
LINES = [
    {"pr_number": 7, "cutoff": "2024", "truth_status": "observed", "gates": {"missing_issue": True, "merged": "no", "missing_provenance": 2.0},
     "routers": {"b": {}, "A": {}, "C": {}}, "truth": {"primary_policy": " first "}},
    {"pr_number": "8"}, [1], "not json", {"pr_number": 9, "gates": 3, "routers": [], "repo_profile": {"qa_path": "q.json"}},
    {"pr_number": 9, "truth_status": " ", "gates": {"merged": None, "missing_issue": "maybe"}},
]


def _put(root, run, docs, lines=None, repo="o/n"):
    folder = root / repo / "eval" / run
    folder.mkdir(parents=True)
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
    if lines is not None:
        (folder / "per_pr.jsonl").write_text("\n\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return folder


def test_index_of_runs(spark, tmp_path):
    r1 = _put(tmp_path, "r1", FULL, LINES)
    (r1 / "prs/7/repo_profile").mkdir(parents=True)
    (r1 / "prs/7/repo_profile/profile.json").write_text("{}")
    _put(tmp_path, "r2", {"manifest": "{broken", "report": {"generated_at": "g"}, "experiment_manifest": {"cohort_hash": "e"}}, [{"pr_number": 1}], "o/m")
    _put(tmp_path, "r3", {"manifest": {}}, [{"pr_number": 1}])
    _put(tmp_path, "r4", {"manifest": {}, "report": ""})
    _put(tmp_path, "_builds", FULL, LINES)
    found = {(r.repo, r.run_id): r for r in runs.runs(spark, str(tmp_path)).collect()}
    assert {k: r.skipped for k, r in found.items()} == {
        ("o/n", "r1"): None, ("o/m", "r2"): None, ("o/n", "r3"): "missing report.json or manifest.json", ("o/n", "r4"): "missing per_pr.jsonl"}
    one, two = found["o/n", "r1"], found["o/m", "r2"]
    assert (one.generated_at, one.cohort_hash, one.db_max_event_occurred_at, one.db_max_watermark_updated_at, one.report_json_sha256) == ("2024-01-02", "c1", "2024-01-01", "w", "h")
    assert one.run_dir_rel == "github/o/n/eval/r1" and (two.generated_at, two.cohort_hash, two.manifest_json_sha256) == ("g", "e", None)

    table, rows = runs.index_runs(spark, str(tmp_path))
    got = {(r.run_id, r.pr_number): r for r in rows.collect()}
    assert set(got) == {("r1", 7), ("r1", 9), ("r2", 1)}
    seven, nine = got["r1", 7], got["r1", 9]
    assert (seven.missing_issue, seven.missing_ai_disclosure, seven.missing_provenance, seven.merged) == (1, None, 1, 0)
    assert seven.routers_json == '["A","b","C"]' and seven.primary_policy == "first" and seven.indexed_at == "2024-01-02"
    assert json.loads(seven.artifact_paths_json) == {
        "pr_dir": "prs/7", "snapshot_json": "prs/7/snapshot.json", "inputs_json": "prs/7/inputs.json", "repo_profile_profile_json": "prs/7/repo_profile/profile.json",
        "routes_by_router": {r: f"prs/7/routes/{r}.json" for r in "AbC"}}
    assert (nine.truth_status, nine.merged, nine.missing_issue, nine.routers_json) == (None, None, None, "[]")  # the last line wins
    assert "repo_profile_qa_json" not in json.loads(nine.artifact_paths_json)
    assert {r.run_id for r in runs.examples(spark, str(tmp_path), include_incomplete=True).collect()} == {"r1", "r2", "r3"}

    # A later state of the same runs: changed rows are replaced, others stay, and a second pass changes nothing.
    before = spark.createDataFrame([("o/n", "r1", 7, "old"), ("o/n", "r0", 5, "kept")], "repo string, run_id string, pr_number long, truth_status string").join(
        rows.drop("repo", "run_id", "pr_number", "truth_status").limit(0), how="left").select(rows.columns)
    once = runs.index_runs(spark, str(tmp_path), table, before)
    again = runs.index_runs(spark, str(tmp_path), *once)
    for a, b in zip(once, again):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    status = {(r.run_id, r.pr_number): r.truth_status for r in once[1].collect()}
    assert status == {("r1", 7): "observed", ("r1", 9): None, ("r2", 1): None, ("r0", 5): "kept"}


def test_no_runs_at_all(spark, tmp_path):
    table, rows = runs.index_runs(spark, str(tmp_path))
    assert table.count() == 0 and rows.count() == 0
    assert runs.rebuilt_rows(spark, str(tmp_path)).count() == 0 and runs.derived_report(spark, str(tmp_path)).count() == 0


def test_rows_rebuilt_from_artefacts(spark, tmp_path):
    folder = _put(tmp_path, "r1", {"manifest": {}})
    artefacts = {
        "a/1.json": {"payload": {"router_id": "x", "result": {"pr_number": 3, "risk": "high", "a": 1}}},
        "a/2.json": {"payload": {"router_id": "y", "result": {"pr_number": "3"}}},
        "a/3.json": {"payload": {"router_id": "x", "result": {"pr_number": 3, "risk": "low"}}},
        "a/4.json": {"payload": {"router_id": 5, "result": {"pr_number": 12}}},
        "a/5.json": {"payload": {"router_id": "x", "result": []}},
        "a/6.json": "[1]",
    }
    (folder / "a").mkdir()
    for name, a in artefacts.items():
        (folder / name).write_text(a if isinstance(a, str) else json.dumps(a))
    listed = [{"artifact_type": "route_result", "relative_path": n} for n in [*artefacts, "a/none.json"]]
    listed += [{"artifact_type": "snapshot", "relative_path": "a/1.json"}, {"artifact_type": "route_result", "relative_path": 4}]
    (folder / "artifact_index.jsonl").write_text("\n".join(map(json.dumps, listed)))
    rows = runs.rebuilt_rows(spark, str(tmp_path))
    got = {r.pr_number: r.routers for r in rows.collect()}
    assert set(got) == {3, 12} and got[12] == {}
    assert {k: json.loads(x) for k, x in got[3].items()} == {"x": {"pr_number": 3, "risk": "low"}, "y": {"pr_number": "3"}}
    lines = sorted(r.value for r in runs.rebuilt_lines(rows).collect())
    assert lines == ['{"pr_number":12,"routers":{}}', '{"pr_number":3,"routers":{"x":{"route_result":{"pr_number":3,"risk":"low"}},"y":{"route_result":{"pr_number":"3"}}}}']
    assert {r.router_id: r.n for r in runs.derived_report(spark, str(tmp_path)).collect()} == {"x": 3, "y": 1}
    # The rebuilt lines are what the index reads.
    runs.rebuilt_lines(rows).select("value").write.text(str(folder / "per_pr.jsonl"))
    assert runs.rebuilt_rows(spark, str(tmp_path)).count() == 0
    assert {r.pr_number: r.routers_json for r in runs.examples(spark, str(tmp_path), include_incomplete=True).collect()} == {3: '["x","y"]', 12: "[]"}


def test_artefacts_of_a_run_share_a_folder(spark, tmp_path, monkeypatch):
    """one file per artefact, none of them in a folder of its own, and none looked up by its own path."""
    from hindcast.catalog import runs as queries
    from hindcast.sources.binding import DriverTables

    monkeypatch.setattr(queries, "_folder", lambda t: str(tmp_path / "root"))
    rows = {r.pr_number: r for r in queries.run_rebuild(DriverTables(spark, "/root/testdata/sf0.001")).collect()}
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()
    assert {s.s_suppkey + 1: (2, s.s_acctbal) if s.s_suppkey % 5 == 0 else (1, None) for s in suppliers} == {n: (r.routers, r.balance) for n, r in rows.items()}
    found = list((tmp_path / "root").glob("shop/parts/eval/*/artifacts/**/*.json"))
    assert len(found) == sum(r.routers for r in rows.values()) and len({f.parent for f in found}) == 2

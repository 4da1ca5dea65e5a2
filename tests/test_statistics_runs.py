import json

from proofmark.functions.tails import mann_whitney_two_sided
from proofmark.operators.statistics_runs import run_requests, trace_parts
from proofmark.operators.trace import assemble_trace

REQUESTS = [
    {"method": "auto", "outcome": "v", "group": "g"},
    {"method": "nothing", "x": "v"},
    {"method": "chi_square", "x": "g", "y": "one"},
    {"x": "v", "y": "w"},
    {"method": "correlation", "x": "v", "y": "gone"},
]


def table(spark):
    rows = [("a" if i % 2 else "b", float(i * 7 % 11), float(i), "same") for i in range(20)]
    return spark.createDataFrame(rows, "g string, v double, w double, one string")


def test_failures_are_rows_and_the_others_go_on(spark):
    runs = sorted(run_requests(table(spark), REQUESTS).collect(), key=lambda r: r["position"])
    assert [r["status"] for r in runs] == ["completed", "failed", "failed", "completed", "failed"]
    for r in runs:
        done = r["status"] == "completed"
        assert (r["error"] is None) == done and (r["answer"] is not None) == done
    assert runs[0]["answer"].startswith(f"Metode {runs[0]['method']}; p-value=")
    assert json.loads(runs[3]["result_json"])["p_value"] == runs[3]["p_value"]
    assert "gone" in runs[4]["error"] and "nothing" in runs[1]["error"]


def test_every_run_has_a_trace(spark):
    parts = trace_parts(run_requests(table(spark), REQUESTS))
    trace = assemble_trace(**parts).collect()
    steps = {r["analysis_id"]: json.loads(r["payload"]) for r in trace if r["part"] == "step"}
    assert len(steps) == 5 and all(s["agent"] == "statistics_agent" for s in steps.values())
    assert [steps[f"statistics-{i}"]["status"] for i in (1, 2)] == ["success", "failure"]
    assert "nothing" in json.loads(steps["statistics-2"]["output"])["error"]
    assert {r["analysis_id"] for r in trace if r["part"] == "evaluation"} == {"statistics-1", "statistics-4"}


def test_no_requests(spark):
    assert run_requests(table(spark), []).collect() == []


def test_exact_p_equals_enumeration():
    """All orderings of two small groups, counted one by one."""
    from itertools import combinations

    for k, m in ((3, 4), (2, 6), (5, 5)):
        us = []
        for chosen in combinations(range(k + m), k):
            us.append(sum(chosen) - k * (k - 1) // 2)
        for u in range(k * m + 1):
            larger = max(u, k * m - u)
            expected = min(1.0, 2 * sum(x >= larger for x in us) / len(us))
            assert abs(mann_whitney_two_sided(u, k, m, 0) - expected) < 1e-12

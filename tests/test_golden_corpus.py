"""Acceptance run over a golden corpus, when one is given as data.

GOLDEN_CORPUS names a folder with ``datasets/*.csv`` and ``questions/*.json``; each record
has a dataset, a question or statistics request, a selector and an expected value.
"""

import json
import os
from math import isclose
from pathlib import Path

import pytest

from proofmark.operators.statistics import run_statistics
from proofmark.plans.answer import answer_question, reproducible
from proofmark.plans.questions import question_catalog
from proofmark.sources.readers import scan_csv
from proofmark.workspace import settle

CORPUS = os.environ.get("GOLDEN_CORPUS")
pytestmark = pytest.mark.skipif(not CORPUS, reason="no golden corpus given")


def records():
    if not CORPUS:
        return []
    found = []
    for path in sorted(Path(CORPUS, "questions").glob("*.json")):
        found += json.loads(path.read_text(encoding="utf-8-sig"))
    return found


@pytest.fixture(scope="module")
def tables(spark):
    found = {}
    for path in Path(CORPUS, "datasets").glob("*.csv"):
        df = scan_csv(spark, str(path))
        found[path.name] = (df, settle(question_catalog("dataset", df), "catalog"))
    return found


def matches(actual, expected):
    if "one_of" in expected:
        return actual in expected["one_of"]
    if "lt" in expected:
        return actual < expected["lt"]
    if "gt" in expected:
        return actual > expected["gt"]
    target = expected["value"]
    if isinstance(target, (int, float)) and not isinstance(target, bool):
        tolerance = expected.get("tolerance", 1e-6)
        return isclose(float(actual), target, rel_tol=tolerance, abs_tol=tolerance)
    return actual == target


@pytest.mark.parametrize("record", records(), ids=lambda r: r["id"])
def test_record(spark, tables, record):
    df, catalog = tables[record["dataset"]]
    selector = record["selector"]
    if record.get("kind") == "statistics":
        actual = run_statistics(df, **record["request"]).first()[selector["path"]]
    else:
        answer = answer_question(df, record["question"], "benchmark", catalog)
        assert answer.status == "completed", answer.validation
        item = next(e for e in answer.evidence if e["key"] == selector["evidence_key"])
        actual = item["rows"][selector["row"]][selector["field"]]
        assert all(f"evidence:{e['key']}" in answer.text for e in answer.evidence)
        assert reproducible(df, answer.evidence)
    assert matches(actual, record["expected"]), (actual, record["expected"])

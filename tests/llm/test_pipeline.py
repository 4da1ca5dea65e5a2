from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests import oracle
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_run_over_their_tables(spark, name):
    frame = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert oracle.compare(frame, oracle.connect(SMALL), sql) == ""
        return
    source = {"op1_": "pages", "op2_": "pages", "op13": "embeddings"}.get(name[:4], "documents")
    rows = frame.collect()
    if not name.startswith(("op6_", "op8_")):
        per_row = 32 if name.startswith("op13_") else 1
        assert len(rows) == per_row * spark.read.parquet(f"{SMALL}/{source}.parquet").count()


def test_near_duplicates_of_the_table_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    wanted, sizes = brute.components(texts, 2, 80)
    for r in entry.queries()["op5_minhash_near_dedup"](spark, SMALL).collect():
        assert (r["component_id"], r["n_shingles"]) == (wanted[r["doc_id"]], sizes[r["doc_id"]])


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        if i == 1:
            texts = {k: before[k]["text"] for k in kept}
            wanted, _ = brute.components(texts, 5, 80)
            assert {r["doc_id"] for r in rows} == {k for k in kept if wanted[k] == k}
        if i == 2:
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        kept = {r["doc_id"] for r in rows}
    assert {r["sequence_id"] for r in rows} and len(rows) > 0
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows)


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "some words", "en", "a", 10), (3, "x " * 9000, None, "b", 18000),
            (4, "plain words here", "de", "b", 16), (4, "plain words here", "de", "b", 16)]
    clash = ("size", "target", "repeats", "score", "predicted", "component_id", "start", "_doc")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(*r, *[f"own {c}" for c in clash]) for r in rows], schema)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SMALL)
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert all(r[c] == f"own {c}" for c in clash), name
            if some is not docs:
                assert out.count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, SMALL).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "3", "4", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 5 + 5  # the long text is cut into five


def test_nothing_else_imports_the_folder():
    root = Path(entry.__file__).parent
    for path in [*root.glob("proofmark/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "proofmark.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()

"""CSV with line breaks inside quotes: the same rows as Spark's one-task reader, at any split."""

import random

import numpy as np
import pytest

from proofmark.sources import csv_records, readers
from proofmark.workspace import pin

NASTY = [
    'plain', '', 'two words', 'a,b', 'he said "no"', '"', '""', 'line\nbreak', '\n', 'x\n\ny', '"quoted"\n,"again"',
    'ends with quote"', '" starts', 'é ü\n', 'mark \ue000\ue002 here', '', 'tab\there', "'single'",
]


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') or value == "" else value


def write(path, rows):
    lines = ["id,text,number,more"] + [",".join([str(i), quoted(t), str(n), quoted(m)]) for i, t, n, m in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")


def one_task(spark, path):
    return (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", True).option("inferSchema", True).csv(path)
    )


@pytest.mark.parametrize("split", [64, 333, 5_000, 10_000_000])
def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, split):
    r = random.Random(split)
    for k in range(3):
        rows = [(i, r.choice(NASTY), r.randrange(100), r.choice(NASTY)) for i in range(60)]
        write(tmp_path / f"part{k}.csv", rows)
    (tmp_path / "long.csv").write_text(
        'id,text,number,more\n1,"' + "many\nlines\n" * 300 + '",5,"end"\n2,plain,6,x\n', encoding="utf-8", newline=""
    )
    expected = one_task(spark, str(tmp_path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = readers.scan_csv(spark, str(tmp_path))
        rows = sorted(map(repr, found.collect()))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found.dtypes == expected.dtypes
    assert rows == sorted(map(repr, expected.collect()))


def test_quotes_inside_plain_fields_and_short_rows(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a,b,c\n5" pipe,x,1\ny,6" and 7",2\n"in ""it""",z\n\n"open\nline",w,3\nlast,row,4', encoding="utf-8")
    found = readers.scan_csv(spark, str(path))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, one_task(spark, str(path)).collect()))


def test_windows_lines_and_a_given_schema(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b'id,text\r\n1,"two\r\nlines"\r\n2,\r\n3,"x"\r\n')
    found = readers.scan_csv(spark, str(path), "id long, text string").orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "two\r\nlines"), (2, None), (3, "x")]


def test_only_a_header(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n")
    found = readers.scan_csv(spark, str(path))
    assert found.columns == ["a", "b"] and found.count() == 0


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    with open(path, "w", newline="") as file:
        file.write("id,text\n")
        for i in range(60_000):
            file.write(f'{i},"row {i}\nsecond line"\n' if i % 3 == 0 else f"{i},row {i}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        from proofmark.sources.csv_records import _lines

        assert _lines(spark, str(path)).rdd.getNumPartitions() > 8
        found = readers.scan_csv(spark, str(path))
        assert found.count() == 60_000 and found.where("text LIKE '%second line'").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_not_shuffled(spark, tmp_path, monkeypatch):
    """A task holds a batch of lines and one record, however large the splits are."""
    write(tmp_path / "t.csv", [(i, "line\nbreak", i, "x") for i in range(50)])
    plans = {}
    monkeypatch.setattr(csv_records, "pin", lambda df, label: plans.setdefault(label, df) and pin(df, label))
    assert csv_records.csv_records(spark, str(tmp_path / "t.csv")).count() == 50
    texts = {k: df for k, df in plans.items() if {"line", "lines", "record"} & set(df.columns)}
    assert texts
    for label, df in texts.items():
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString(), label


def test_states_do_not_depend_on_batches():
    r = random.Random(6)
    out, into = ([r.random() < 0.5 for _ in range(40)] for _ in range(2))
    for state in (False, True):
        expected = [state]
        for a, b in zip(out, into):
            expected.append(b if expected[-1] else a)
        found = csv_records._states(np.array(out), np.array(into), state).tolist()
        assert found == expected
        for cut in range(1, 40):
            first = csv_records._states(np.array(out[:cut]), np.array(into[:cut]), state)
            assert csv_records._states(np.array(out[cut:]), np.array(into[cut:]), bool(first[-1])).tolist() == expected[cut:]

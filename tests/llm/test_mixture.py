from collections import defaultdict

import pytest

from proofmark.llm.mixture import OP3_SQL, mix, water_level, word_count
from tests.oracle import connect, plain

SCHEMA = "doc_id long, source string, text string, size string, target string"


def target_by_hand(sizes, weights, share, epochs):
    """Water-filling by repeated redistribution."""
    amount, free, clamped = share * sum(sizes.values()), dict(weights), {}
    while free:
        level = amount / sum(free.values())
        over = {s: epochs * sizes[s] for s in free if level * free[s] >= epochs * sizes[s]}
        if not over:
            return clamped | {s: level * w for s, w in free.items()}
        clamped |= over
        amount -= sum(over.values())
        free = {s: w for s, w in free.items() if s not in over}
    return clamped


@pytest.fixture(scope="module")
def documents(spark):
    rows = []
    for s, count in (("b", 400), ("A", 30), ("ä", 60), (None, 50), ("", 10), ("z", 3)):
        rows += [(len(rows) + i, s, "w " * ((i * 7919) % 40)) for i in range(count)]
    rows += [(None, "A", "null id"), (9000, "A", None), (9001, "zero", ""), (9002, "zero", "\t\n ")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_targets_and_passes(documents):
    rows = mix(documents).collect()
    assert len(rows) == documents.count()
    sizes, taken, targets, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        n = len((r["text"] or "").split())
        assert r["size"] == n and r["taken"] == r["repeats"] * n and r["taken"] <= 2 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], n)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    wanted = target_by_hand(sizes, weights, 1.5, 2)
    for s in names:
        assert abs(targets[s] - wanted[s]) < 1e-6
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_reruns_agree_in_any_layout(documents):
    one, other = (
        sorted((r["doc_id"] or -1, r["taken"]) for r in mix(d).collect())
        for d in (documents, documents.repartition(7))
    )
    assert one == other


def test_everything_at_the_limit_and_empty_tables(spark, documents):
    rows = mix(documents, share=2.5, epochs=2).collect()
    assert all(r["taken"] == 2 * r["size"] for r in rows)
    assert mix(documents.limit(0)).count() == 0
    empty = mix(spark.createDataFrame([(1, "a", None, "", "")], SCHEMA)).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)]


def test_water_level(spark):
    sources = spark.createDataFrame([("a", 10, 5), ("b", 100, 1)], "s string, source_size long, weight int")
    assert water_level(sources, 1.5, 2) == (165 - 20) / 1
    assert water_level(sources, 3.0, 2) is None


def test_words(spark):
    df = spark.createDataFrame([("a\u00a0b c\u000bd",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [3, 0, 0]


def test_sql_on_the_smallest_table(spark):
    from proofmark.llm.mixture import op3_source_mixture

    d = "/root/testdata/sf0.001"
    cursor = connect(d).execute(OP3_SQL)
    names = [c[0] for c in cursor.description]
    wanted = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in op3_source_mixture(spark, d).select(*names).collect()) == wanted


def test_a_source_at_its_limit_takes_no_empty_text_once_more(spark):
    from proofmark.llm.mixture import mix

    rows = [(i, "" if i % 2 else "two words", "small") for i in range(20)]
    rows += [(100 + i, "many words " * 50, "large") for i in range(20)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 50))
    assert {r["repeats"] for r in found.collect() if r["source"] == "small"} <= {0, 1, 2}
    assert max(r["repeats"] for r in found.collect()) <= 2

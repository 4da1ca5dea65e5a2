import random

import numpy as np

from proofmark.llm import neardup
from proofmark.llm.components import connected_components
from tests.llm import brute

VOCABULARY = [f"w{i}" for i in range(400)]


def families(seed=1):
    """Texts in families of graded likeness, copies, and odd rows."""
    r = random.Random(seed)
    texts = {}
    for family in range(12):
        base = [r.choice(VOCABULARY) for _ in range(60)]
        for member in range(12):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6])):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
            texts[len(texts) * 3] = " ".join(words)
    texts |= {1: "", 2: None, 4: "  \n ", 5: "Lone", 7: "lone", 8: "two words", 10: "TWO  words", 11: "Ünï cödé"}
    return texts


def check(spark, texts, width, percent=80, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumnRenamed("x", "y")
    rows = neardup.near_duplicates(df, shingle=width, percent=percent, **options).collect()
    wanted, sizes = brute.components(texts, width, percent)
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        assert r["n_shingles"] == sizes[i] and r["component_id"] == wanted[i], i
        assert r["kept"] == (wanted[i] == i)


def test_groups_equal_brute_force(spark):
    check(spark, families(), 2)
    check(spark, families(2), 5)


def test_buckets_with_several_components_are_finished_in_blocks(spark, monkeypatch):
    # One row per band: very many loose buckets; blocks of three members.
    monkeypatch.setattr(neardup, "BLOCK", 3)
    texts = dict(list(families(3).items())[:60])
    check(spark, texts, 2, rows=1, minima_count=8)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (None, text), (3, text + " "), (None, None), (9, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(
        ((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()),
        key=str,
    )
    assert found == sorted(
        [(1, 1, True), (1, 1, True), (3, 1, False), (9, 9, True), (None, None, True), (None, None, True)], key=str
    )
    kept = neardup.keep_one(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "9", "None", "None"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *hub, (300, 300), (7, 301), (301, 7), (7, 301)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(found[i] == 100 for i in range(100, 161))
    assert found[5] == 5 and all(found[i] == 5 for i in range(200, 260))
    assert found[301] == found[7] == 7 and 300 not in found
    assert connected_components(edges.limit(0)).count() == 0


def test_minima_are_universal_hash_minima():
    sets = [np.array([3, 9, 27], np.uint64), np.array([5], np.uint64)]
    a, b = np.array([7], np.uint64), np.array([1], np.uint64)
    assert neardup.minima(sets, a, b).tolist() == [[22], [36]]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    from proofmark.llm.neardup import keep_one

    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "a"), (1, "totally different text of its own", "b"),
        (2, words, "c"), (2, words, "d"), (2, words, "d"), (3, words + " more", "e"),
        (None, words, "f"), (4, None, "g"), (4, "", "h"), (1, words + " again", "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rows string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r[0]), r[1] or "", r[2]) for r in kept.collect())
    assert [x for x in found if x[0] == "1"] == sorted(("1", t, n) for i, t, n in rows if i == 1)
    assert [x[0] for x in found].count("2") == 0 and [x[0] for x in found].count("3") == 0
    assert [x[0] for x in found].count("None") == 1 and [x[0] for x in found].count("4") in (1, 2)
    again = keep_one(docs.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))

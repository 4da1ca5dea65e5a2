import zlib

import numpy as np
import pyarrow as pa
import pytest

from proofmark.llm import language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return quality.judge_quality(documents, labels).join(labels, "doc_id", "left").toPandas()


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(judged):
    assert len(judged) == 1000 and judged.score.between(0, 1).all()
    assert (judged.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in judged.doc_id]).all()
    assert (judged.predicted == (judged.score >= 0.3)).all()
    test = judged[judged.held_out & judged.quality.notna()]
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.98
    assert (test.predicted == test.quality).mean() > 0.93


def test_identity_equals_all_pairs():
    random = np.random.default_rng(1)
    x, w, v = random.normal(size=(5, 7)), random.normal(size=7), random.normal(size=(7, 3))
    pairs = [
        0.3 + r @ w + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(7) for j in range(i + 1, 7)) for r in x
    ]
    assert np.allclose(quality.raw_scores(x, (0.3, w, v)), pairs)


def test_pairs_are_learned():
    """The label is the product of two features: no linear model can tell."""
    random = np.random.default_rng(2)
    x = random.choice([-1.0, 1.0], size=(3000, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(np.float32)
    assert auc(quality.raw_scores(x, quality.fit(x, y)), y) > 0.99


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5), (None, "other"), (3, "word " * 5), (4, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.judge_quality(df, none).collect()
    assert len(found) == 6 and all(abs(r["score"] - 0.5) < 1e-9 for r in found)
    one = spark.createDataFrame([(3, 1), (3, 1), (99, 0), (4, None), (None, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.judge_quality(df, one).collect())
    assert quality.judge_quality(df.limit(0), one).count() == 0


def test_languages_of_pages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language.identify_languages(pages, documents).collect()
    assert len(rows) == pages.count()
    right = [r["language"] == r["declared"] for r in rows if r["declared"]]
    assert np.mean(right) > 0.97 and all(0 < r["posterior"] <= 1 for r in rows)


def test_evidence_is_fused(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    german = documents.where("lang = 'de'").select("text").first()["text"]
    rows = [(i, "https://a.x.de/p", f"<html lang='de'><p>{german}") for i in range(20)]
    rows += [(i, "https://b.y.fr/p", "<html lang='fr'><p>" + r["text"]) for i, r in
             enumerate(documents.where("lang = 'fr'").limit(20).collect(), 20)]
    rows += [(90, "https://a.x.de/q", None), (91, "https://b.y.fr/q", "<html><p></p>"), (92, None, None),
             (93, "https://new.y.fr/", ""), (94, "http://a.x.de/r", f"<html lang='fr'><script>{'le la les ' * 50}</script><p>{german}")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, host int")
    found = {r["page_id"]: r for r in language.identify_languages(pages, documents).collect()}
    assert found[90]["language"] == "de" and found[90]["text_language"] is None
    assert found[91]["language"] == "fr" and found[93]["language"] == "fr"
    assert found[92]["language"] is not None and found[94]["language"] == "de"
    assert language.identify_languages(pages.limit(0), documents).count() == 0
    nothing = language.identify_languages(pages, documents.limit(0)).collect()
    assert len(nothing) == len(rows) and all(r["language"] is None for r in nothing)


def test_host_shares_equal_counting(spark):
    """Smoothing level by level, by hand."""
    rows = [("h1.a.de", "a.de", "de", "", 0, 3), ("h1.a.de", "a.de", "de", "", 1, 1), ("h2.a.de", "a.de", "de", "", 1, 4)]
    facts = spark.createDataFrame(rows, "host string, domain string, suffix string, declared string, _text int, _pages int")
    shares = {r["host"]: (r["_n"], list(r["_of"])) for r in language._shares(facts, ["host"], 2).collect()}
    assert shares == {"h1.a.de": (4, [3.0, 1.0]), "h2.a.de": (4, [0.0, 4.0])}


def test_a_declaration_is_found_wherever_it_begins(spark):
    documents = spark.createDataFrame([("de", "der die das und"), ("fr", "le la les et")], "lang string, text string")
    pages = {
        "de": "<!-- " + "licence " * 2000 + "-->\n<!DOCTYPE html>\n<html class='a' lang='DE'><p>und",
        "fr": " " * 300_000 + "<html lang=fr><p>et",
        "en": "<script>" + "var x = '<html lang=xx>';" * 400 + "</script><!-- <html lang=yy> --><html lang=\"en-GB\">",
        "": "<!-- <html lang=de> --><html><p>le la",
    }
    df = spark.createDataFrame(list(pages.items()), "expected string, html string").selectExpr("*", "'http://a.b/' AS url")
    found = language.identify_languages(df, documents).collect()
    assert {x["expected"]: x["declared"] for x in found} == {k: k for k in pages}


def test_more_languages_than_were_ever_counted(spark):
    """Every language of the documents can be found, however rare."""
    r = np.random.default_rng(6)
    count = 150
    letters = [[chr(0x4E00 + 12 * i + j) for j in range(12)] for i in range(count)]
    prose = lambda i: "".join(r.choice(letters[i], 200))
    rows = [(f"l{i:03d}", prose(i)) for i in range(count) for _ in range(1 + (i < 100))]
    documents = spark.createDataFrame(rows, "lang string, text string")
    pages = spark.createDataFrame(
        [(i, f"https://h{i}.s{i}/", f"<p>{prose(i)}") for i in range(count)],
        "page_id long, url string, html string",
    )
    found = language.identify_languages(pages, documents).collect()
    assert len(found) == count
    assert all(x["text_language"] == x["language"] == f"l{x['page_id']:03d}" for x in found)
    batch = pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows]), pa.array([x[0] for x in rows])], ["t", "l"])
    languages = sorted({x[0] for x in rows})
    parts = list(language._counted(languages)([batch, batch]))
    assert len(parts) > 2
    sums = np.zeros((count, language.BUCKETS), np.int64)
    for part in parts:
        np.add.at(sums, (part.column(0).to_numpy(), part.column(1).to_numpy()), part.column(2).to_numpy())
    for i in (0, 120):
        assert (sums[i] == 2 * sum(language._trigrams(x[1].encode()) for x in rows if x[0] == languages[i])).all()

"""Operator 1: language of web pages by fusing evidence in Bayes' rule.

- Text: smoothed log-likelihoods of byte trigrams (hashed into a fixed number of buckets) per
  language, counted over all documents whose language is given.  Trigrams overlap, so their
  sum is tempered.
- Declared markup language (of the first <html lang> of the whole page outside comments,
  scripts and styles) and address suffix: how often each value comes with each language,
  counted over all pages by what their text says.
- Host: the share of each language among the host's pages with text, smoothed towards its
  domain, towards its suffix, towards all pages.

All counts are grouped aggregates; what is sent to the tasks has one row of buckets per
language of the documents, all of which take part.  The tables by value and by host are joined, and Spark chooses how.

Cases: a null or empty page has no text evidence, a null text_language and is judged by the
rest; a missing declaration or address is a value
of its own; ties between languages go to the alphabetically first; without any document with
a language every language is null; an empty table gives an empty result; repeated rows are
judged row by row.  Columns of the input that carry the name of a result column are replaced.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators.ordering import join_on_keys
from proofmark.registry.base import table
from proofmark.workspace import pin

BUCKETS = 1 << 14
# One trigram counts this much, and a text not more than this many trigrams.
TEMPER = 0.2
MOST = 200
# Weight of the wider level in a smoothed share, in pages.
STRENGTH = 8.0
# A task writes its counts when it holds this many languages.
HELD = 64

_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(rb"(?s)<[^>]*>|&[a-zA-Z#0-9]{1,10};")
_RESULT = ("host", "domain", "suffix", "declared", "text_language", "language", "posterior")


def _trigrams(data: bytes) -> np.ndarray:
    """Counts per bucket of the byte trigrams of a lower-cased text."""
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return np.bincount(codes, minlength=BUCKETS)


def visible(page: bytes) -> bytes:
    """The text of a page without scripts, styles, comments, tags and entities."""
    return _TAG.sub(b" ", _HIDDEN.sub(b" ", page))


def _counted(languages: list[str]):
    """Batches (text, language) to rows (language, bucket, n), added up in the task."""
    places = {x: i for i, x in enumerate(languages)}

    def rows(counts):
        held = np.array(list(counts), np.int32)
        table_of = np.stack(list(counts.values()))
        at, of = np.nonzero(table_of)
        return pa.RecordBatch.from_arrays(
            [pa.array(held[at]), pa.array(of.astype(np.int32)), pa.array(table_of[at, of])],
            ["language", "bucket", "n"],
        )

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    found = _trigrams(text.as_py().encode("utf-8", "surrogatepass"))
                    place = places[language.as_py()]
                    if place in counts:
                        counts[place] += found
                        continue
                    if len(counts) >= HELD:
                        yield rows(counts)
                        counts = {}
                    counts[place] = found
        if counts:
            yield rows(counts)

    return run


def train_text_model(
    documents: DataFrame, text: str = "text", language: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket), from all documents with a language."""
    given = documents.select(
        F.col(text).cast("string").alias("text"), F.col(language).alias("lang")
    ).where(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in given.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, BUCKETS))
    # At most BUCKETS rows a language.
    found = (
        given.mapInArrow(_counted(languages), "language int, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[found.column("language").to_numpy(), found.column("bucket").to_numpy()] += (
        found.column("n").to_numpy()
    )
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(html: str, model: np.ndarray) -> Column:
    """Array of tempered log-likelihoods of a page's visible text, one per language."""
    table_of = model.T.copy()

    @F.arrow_udf("array<double>")
    def evidence(pages: pa.Array) -> pa.Array:
        found = np.zeros((len(pages), table_of.shape[1]))
        for i, page in enumerate(pages):
            if page.is_valid:
                data = visible(page.as_py().encode("utf-8", "surrogatepass"))
                counts = _trigrams(data)
                used = np.flatnonzero(counts)
                total = counts.sum()
                if total:
                    scale = TEMPER * min(1.0, MOST / total)
                    found[i] = scale * (counts[used] @ table_of[used])
        ends = np.arange(len(pages) + 1, dtype=np.int32) * table_of.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))

    return evidence(F.col(html).cast("string"))


def _best(values: str) -> Column:
    """Index of the largest entry, the first among equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _said() -> Column:
    """Language index by the text alone; null where the text says nothing."""
    return F.when(F.array_max("_ll") > F.array_min("_ll"), _best("_ll"))


def _shares(pages: DataFrame, by: list[str], count: int) -> DataFrame:
    """Per key: the number of pages and how many of them each language has (by text)."""
    cells = pages.groupBy(*by, "_text").agg(F.sum("_pages").alias("_pages"))
    # At most one entry a language is gathered in a row.
    entry = F.when(F.col("_text").isNotNull(), F.struct("_text", "_pages"))
    return (
        cells.groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.when(F.col("_text").isNotNull(), F.col("_pages"))), F.lit(0)).alias("_n"),
            F.map_from_entries(F.collect_list(entry)).alias("_cells"),
        )
        .withColumn(
            "_of",
            F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda i: F.coalesce(F.try_element_at("_cells", i), F.lit(0)).cast("double"),
            ),
        )
        .drop("_cells")
    )


def _smoothed(shares: DataFrame, wider: str) -> DataFrame:
    """Shares of the languages, drawn towards those of the wider level."""
    return shares.withColumn(
        "_share",
        F.zip_with(
            "_of", wider, lambda n, p: (n + STRENGTH * p) / (F.col("_n") + STRENGTH)
        ),
    )


def identify_languages(
    pages: DataFrame,
    documents: DataFrame,
    url: str = "url",
    html: str = "html",
    text: str = "text",
    language: str = "lang",
) -> DataFrame:
    """The pages with host, domain, suffix, declared, text_language, language, posterior."""
    languages, model = train_text_model(documents, text, language)
    own = pages.drop(*[c for c in pages.columns if c in _RESULT])
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split("host", r"\.")
    shown = F.regexp_replace(
        F.coalesce(F.col(html).cast("string"), F.lit("")),
        r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->",
        " ",
    )
    declared = F.lower(
        F.regexp_extract(
            shown,
            r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""",
            1,
        )
    )
    parsed = own.withColumns({"host": host, "declared": declared}).withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
        }
    )
    if not languages:
        return parsed.withColumns(
            {
                "text_language": F.lit(None).cast("string"),
                "language": F.lit(None).cast("string"),
                "posterior": F.lit(None).cast("double"),
            }
        )
    count = len(languages)
    facts = pin(
        parsed.select("host", "domain", "suffix", "declared", text_evidence(html, model).alias("_ll"))
        .withColumn("_text", _said())
        .groupBy("host", "domain", "suffix", "declared", "_text")
        .agg(F.count(F.lit(1)).alias("_pages")),
        "facts",
    )
    even = F.array(*[F.lit(1.0 / count)] * count)

    everywhere = _smoothed(_shares(facts, [], count).withColumn("_wider", even), "_wider")
    total = everywhere.select("_share", "_of").first()
    overall = F.array(*[F.lit(float(x)) for x in total["_share"]])
    suffixes = _smoothed(
        _shares(facts, ["suffix"], count).withColumn("_wider", overall), "_wider"
    ).select("suffix", F.col("_share").alias("_suffix_share"))
    domains = _smoothed(
        _shares(facts, ["domain", "suffix"], count).join(suffixes, "suffix"), "_suffix_share"
    ).select("domain", F.col("_share").alias("_domain_share"))
    hosts = pin(
        _smoothed(
            _shares(facts, ["host", "domain"], count).join(domains, "domain"), "_domain_share"
        ).select("host", F.col("_share").alias("_prior")),
        "hosts",
    )
    held = F.array(*[F.lit(float(x)) for x in total["_of"]])

    def likelihoods(column: str) -> DataFrame:
        """log P(value | language), drawn towards the share of the value among all pages."""
        shares = _shares(facts, [column], count)
        common = (F.col("_n") + 0.5) / (float(sum(total["_of"])) + 1.0)
        logs = F.zip_with(
            "_of", held, lambda n, all_: F.log((n + STRENGTH * common) / (all_ + STRENGTH))
        )
        return shares.select(column, logs.alias(f"_by_{column}"))

    declarations, endings = pin(likelihoods("declared"), "declared"), pin(likelihoods("suffix"), "suffix")
    judged = parsed.withColumn("_ll", text_evidence(html, model))
    for part, on in ((hosts, "host"), (declarations, "declared"), (endings, "suffix")):
        judged = join_on_keys(judged, part, [on], "left")
    prior = F.transform("_prior", lambda p: F.log(p))
    parts = [F.col("_ll"), prior, F.col("_by_declared"), F.col("_by_suffix")]
    fused = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    names = F.array(*[F.lit(x) for x in languages])
    judged = judged.withColumn("_fused", fused).withColumns(
        {
            "text_language": F.get(names, _said()),
            "language": F.get(names, _best("_fused")),
        }
    )
    top = F.array_max("_fused")
    mass = F.aggregate(
        "_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(F.col("_fused")))
    )
    return judged.withColumn("posterior", F.when(top.isNotNull(), 1 / mass)).drop(
        "_ll", "_prior", "_by_declared", "_by_suffix", "_fused"
    )


def op1_page_language(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select("page_id", "url", "html")
    documents = table(spark, directory, "documents").select("text", "lang")
    return identify_languages(pages, documents).select(
        "page_id", "host", "declared", "text_language", "language", "posterior"
    )

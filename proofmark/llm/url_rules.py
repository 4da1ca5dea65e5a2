"""Operator 2: URL filters by mined association rules.

Fixed rules judge the urls they fit; the longest one wins.  Their verdicts are the labels
from which FP-growth mines combinations of url tokens: a combination whose share of one
verdict reaches the confidence, with enough support, becomes a rule for the other urls.
Mined rules are found through an inverted index: each is listed under its rarest token, so
a url meets only rules that share a token with it, and the remaining tokens are checked on
the spot.  A url that no mined rule fits is allowed.

Cases: a null url or one without ``://`` has empty host and path, no rule and no tokens, so
it is allowed; repeated rows and ids are judged row by row; ties between rules go to the
higher confidence, then the higher support, then the longer and finally the alphabetically
first combination; an empty table gives an empty result, and without labels nothing is
mined.  Columns of the input that carry the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.registry.base import table
from proofmark.workspace import pin

# (verdict, host, path): judged with the host and all its subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT = 0.01
CONFIDENCE = 0.8

_RESULT = ("host", "path", "rule", "verdict", "mined", "confidence")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return (
        F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER),
        F.regexp_extract(text, parts, 2),
    )


def fixed_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    choice = F.lit(None).cast("struct<rule:string,ruled:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (
            (F.col("host") == host) | F.col("host").endswith("." + host)
        ) & F.col("path").startswith(path)
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("ruled"))
        choice = F.when(fits, found).otherwise(choice)
    return choice


def url_tokens(url: str = "url") -> Column:
    """Distinct tokens: scheme, host labels by level, path parts, extension, query names."""
    text = F.coalesce(F.col(url), F.lit(""))
    labels = F.reverse(F.split("host", r"\."))
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    asked = F.regexp_extract(text, r"(?s)://[^?#]*\?([^#]*)", 1)
    named = [
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))),
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
        F.transform(steps, lambda x: F.concat(F.lit("path="), x)),
        F.array(F.concat(F.lit("kind="), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))),
        F.transform(
            F.filter(F.split(asked, "&"), lambda x: x != ""),
            lambda x: F.concat(F.lit("asks="), F.substring_index(x, "=", 1)),
        ),
    ]
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(*named))
    )


def mine_rules(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, token) from rows (tokens, ruled).

    The verdict is one more item of each row.  A frequent combination with a verdict,
    divided by the same combination without, gives the confidence.  A rule is dropped when
    a shorter one with the same verdict is at least as confident.  ``token`` is the rarest
    token of a rule, its key in the index.
    """
    marked = labelled.select(
        F.array_append("tokens", F.concat(F.lit("\u0000"), "ruled")).alias("items")
    )
    sets = pin(
        FPGrowth(itemsCol="items", minSupport=support).fit(marked).freqItemsets.select(
            F.filter("items", lambda x: ~x.startswith("\u0000")).alias("items"),
            F.get(F.filter("items", lambda x: x.startswith("\u0000")), F.lit(0)).alias("mark"),
            "freq",
        ).withColumn("items", F.array_sort("items")),
        "itemsets",
    )
    plain = sets.where(F.col("mark").isNull()).select("items", F.col("freq").alias("all"))
    rules = pin(
        sets.where(F.col("mark").isNotNull() & (F.size("items") > 0))
        .join(plain, "items")
        .select(
            "items",
            F.substring("mark", 2, 100).alias("ruled"),
            (F.col("freq") / F.col("all")).alias("confidence"),
            F.col("freq").alias("support"),
        )
        .where(F.col("confidence") >= confidence),
        "rules",
    )
    shorter = rules.select(
        F.explode(
            F.transform(
                "items", lambda x: F.array_remove(F.col("items"), x)
            )
        ).alias("part"), "items", "ruled", "confidence"
    )
    implied = shorter.join(
        rules.select(F.col("items").alias("part"), "ruled", F.col("confidence").alias("_sure")),
        ["part", "ruled"],
    ).where(F.col("_sure") >= F.col("confidence")).select("items", "ruled").distinct()
    rare = plain.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), F.col("all").alias("_often")
    )
    return (
        rules.join(implied, ["items", "ruled"], "left_anti")
        .withColumn("token", F.explode("items"))
        .join(rare, "token")
        .groupBy("items", "ruled", "confidence", "support")
        .agg(F.min(F.struct("_often", "token"))["token"].alias("token"))
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The pages with host, path, rule, verdict and, where mined, the rule and confidence.

    Equal token sets are judged once; that also takes the hot ones apart from their rows.
    """
    host, path = host_and_path(url)
    own = pages.drop(*[c for c in pages.columns if c in _RESULT])
    parsed = own.withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("_fixed", fixed_rule(rules)).withColumn("tokens", url_tokens(url))
    sets = pin(
        parsed.groupBy("tokens", F.col("_fixed.ruled").alias("ruled")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "urls",
    )
    labelled = sets.where(F.col("ruled").isNotNull()).select(
        F.explode(F.array_repeat(F.struct("tokens", "ruled"), F.col("n").cast("int"))).alias("r")
    ).select("r.*")
    mined = pin(mine_rules(labelled, support, confidence), "mined")
    better = F.struct(
        F.col("confidence"),
        F.col("support"),
        F.size("items").alias("length"),
        F.col("ruled"),
        F.col("items"),
    )
    found = pin(
        sets.where(F.col("ruled").isNull())
        .select("tokens", F.explode("tokens").alias("token"))
        .join(mined, "token")
        .where(F.size(F.array_except("items", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max(better).alias("_best")),
        "matches",
    )
    verdict = F.coalesce(F.col("_fixed.ruled"), F.col("_best.ruled"), F.lit("allow"))
    needs = F.when(F.col("_fixed").isNull(), F.col("tokens"))
    return (
        parsed.withColumn("_needs", needs)
        .join(found.withColumnRenamed("tokens", "_tokens"), F.col("_needs") == F.col("_tokens"), "left")
        .withColumns(
            {
                "rule": F.col("_fixed.rule"),
                "verdict": verdict,
                "mined": F.array_join("_best.items", " "),
                "confidence": F.col("_best.confidence"),
            }
        )
        .drop("_fixed", "_needs", "_tokens", "_best", "tokens")
    )


def op2_url_rules(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select("page_id", "url")
    return judge_urls(pages).select(
        "page_id", "host", "path", "rule", "verdict", "mined", "confidence"
    )

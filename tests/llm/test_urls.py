from urllib.parse import urlsplit

from proofmark.llm import url_rules as u

URLS = [
    None, "", "no scheme", "http://", "http:///en/", "://example.com/en/x", "HTTP://WWW.Example.COM/en/a?b#c",
    "https://example.com/en/", "https://example.com/en", "https://a.example.com/en/x.html", "https://example.com/de/",
    "https://notexample.com/en/", "https://x.net/es/1", "https://net/fr/", "https://x.net/en/1", "http://www.example.com/EN/",
    "https://a.b.www.example.com/en/?q=1", "https://x.org?u=http://example.com/en/", "https://x.org#/en/",
    "https://example.com:80/en/", "http://x.com", "ftp://Ünï.net/fr/ä", "a://b://c/d", "http://x.net/es/\nz",
]


def by_hand(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, h, p in u.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(URLS)], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in u.judge_urls(df).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = by_hand(url)
        assert (rows[i]["host"], rows[i]["path"]) == (host, path), url
        assert rows[i]["rule"] == (best[0] if best else None), url
        assert rows[i]["verdict"] in ("allow", "block")
        if best:
            assert rows[i]["verdict"] == best[1]


def pages(spark):
    """Under example.com English is blocked and all else allowed; .org has no rule."""
    rows = []
    for i in range(120):
        rows.append(f"https://s{i % 5}.example.com/{('en', 'de', 'fr')[i % 3]}/{i}.html")
        rows.append(f"http://s{i % 5}.example.org/{('en', 'de')[i % 2]}/{i}")
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "page_id long, url string")


def test_mined_rules_equal_counting(spark):
    df = pages(spark)
    rows = u.judge_urls(df).collect()
    for r in rows:
        if ".org" in r["url"]:
            assert r["rule"] is None and r["confidence"] >= u.CONFIDENCE
            assert r["verdict"] == ("block" if "/en/" in r["url"] else "allow")
            # The confidence of the rule, counted on the labelled urls.
            tokens = set(r["mined"].split(" "))
            fits = [x for x in rows if x["rule"] and tokens <= set(tokens_of(x["url"]))]
            same = sum(x["verdict"] == r["verdict"] for x in fits)
            assert abs(same / len(fits) - r["confidence"]) < 1e-12


def tokens_of(url):
    parts = urlsplit(url)
    labels = parts.netloc.split(".")[::-1]
    found = [f"scheme={parts.scheme}", *[f"host{i}={x}" for i, x in enumerate(labels)]]
    found += [f"path={x}" for x in parts.path.split("/") if x]
    return [*found, "kind=" + (parts.path.rpartition(".")[2] if "." in parts.path.rpartition("/")[2] else "")]


def test_repeats_no_labels_and_empty_table(spark):
    df = pages(spark)
    twice = u.judge_urls(df.unionAll(df)).collect()
    assert len(twice) == 2 * df.count()
    unruled = df.where("url LIKE '%.org%'")
    assert {r["verdict"] for r in u.judge_urls(unruled).collect()} == {"allow"}
    assert u.judge_urls(df.limit(0)).count() == 0

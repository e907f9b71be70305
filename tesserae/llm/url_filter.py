"""URL filters: rules by host and path, and a classifier of hashed character n-grams for the rest.

Everything that runs over the pages is DataFrame expressions. The classifier is a logistic regression over binary
features, the hashed n-grams of host and of path; it is trained on the driver from a small
labelled table of URLs, whose features the same expressions make, and its weights go into the plan as a literal of
a fixed size.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is the classifier's to
judge, like any other; repeated rows and ids are judged each; an empty table gives an empty one; extra columns of
the pages are ignored. Of rules that fit, the one with the longest text wins; the rules' host and path are literal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams; their lengths; steps, rate and L2 penalty of the training; rows of the labelled table at most.
BUCKETS, GRAMS, STEPS, RATE, PENALTY, LABELLED = 2048, (3, 4, 5), 400, 0.5, 1e-3, 20_000

# The labelled table. Hosts and paths of the kinds that a crawl blocks and keeps.
BLOCKED = [
    "http://generic-meds.example.com/en/12", "https://www.meds-without-rx.example.net/buy/now", "http://cheap-watches.example.org/sale", "https://buy-pills-online.example.net/order", "http://discount-pharmacy.example.com/viagra",
    "https://spammy-seo.example.org/en/4", "http://www.content-farm.example.net/links/1", "https://link-farm.example.com/page/9", "http://seo-spam.example.net/backlinks", "https://spam-links.example.com/fr/2",
    "https://sports-bets.example.net/es/7", "http://www.betting-bonus.example.com/bonus", "https://online-casino.example.org/slots", "http://casino-bonus.example.net/free-spins", "https://best-bets.example.org/odds", "http://poker-bets.example.com/play",
    "http://free-money.example.net/win", "https://win-prizes.example.com/claim", "http://payday-loans.example.org/apply", "https://easy-loans.example.net/cash", "http://adult-cams.example.com/live", "https://hot-singles.example.net/chat",
    "http://free-downloads.example.org/crack.exe", "https://warez-crack.example.com/keygen", "http://miracle-diet.example.net/pills", "https://fake-watches.example.com/replica", "http://click-bait.example.org/shocking", "https://free-gift.example.net/claim-now",
    "http://ads.example.com/banner/3", "https://ads-server.example.org/en/5", "http://track.example.net/pixel", "https://ad-tracker.example.com/click/77", "https://ad-pixels.example.net/de/8", "https://www.lucky-casino.example.com/en/21", "http://casino-games.example.net/fr/6", "https://big-win.example.org/es/13",
    "http://www.spam-site.example.org/en/9", "https://www.spam-host.example.net/en/2", "http://farm-of-links.example.org/en/7", "https://www.link-spam.example.org/en/31",
]
ALLOWED = [
    "http://example.org/en/1", "https://www.example.net/de/22", "https://example.net/en/300.html", "http://blog.example.org/en/15/", "https://m.example.net/en/8?page=2", "https://news.example.org/world/2024", "http://www.example.org/about", "https://docs.example.net/guide/install",
    "https://library.example.org/books/9", "http://museum.example.net/art/4", "https://university.example.org/physics", "https://blog.gardening.example.net/en/5", "http://weather.example.org/de/77", "https://history.example.net/en/12.html", "https://m.travel.example.org/es/3",
    "http://www.recipes.example.net/de/45/", "https://science.example.org/en/81", "https://cooking.example.net/en/6?utm_source=feed", "http://sports.example.org/fr/19", "https://music.example.net/de/2#top", "https://blog.health.example.org/en/64", "http://forum.example.net/thread/18",
    "https://city.example.org/council", "https://www.painting.example.net/en/31", "http://river.example.org/en/90?page=2&ref=x", "https://wiki.example.net/en/article", "https://m.stones.example.org/en/27.html", "http://blog.weaving.example.net/en/70/",
    "http://thread.example.org/fr/414", "https://m.thorn.example.net/en/742/", "https://leather.example.com/es/52", "http://brother.example.net/de/481", "https://harbor.example.com/en/19", "http://nation.example.com/fr/33", "https://www.station.example.org/es/70", "https://tradition.example.net/en/464",
    "http://www.stream.example.org/en/3", "https://www.meadow.example.net/en/9", "http://forest.example.org/en/7", "https://www.lantern.example.org/en/52",
]

#: Rules of the registered query: (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: str) -> tuple[Column, Column]:
    """What stands between the first `://` and the next `/`, `?`, `#`, in lower case; and the path up to `?`, `#`."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substr(F.col(url), begin + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(text: str, mark: str, n: int) -> Column:
    """Buckets of the n-grams of ^text$; shorter texts have none."""
    s = F.concat(F.lit("^"), F.col(text), F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
    return F.when(F.length(s) >= n, grams).otherwise(F.array().cast("array<int>"))


def features(df: DataFrame) -> DataFrame:
    """Adds `buckets`, the distinct buckets of host and path."""
    return df.withColumn("buckets", F.array_distinct(F.concat(*[_grams(text, mark, n) for text, mark in (("host", "h"), ("path", "p")) for n in GRAMS])))


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from (url, blocked); at most LABELLED rows, all of them used."""
    host, path = host_and_path("url")
    rows = features(labelled.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"))).where("y is not null").select("buckets", "y").limit(LABELLED + 1).collect()
    if len(rows) > LABELLED:
        raise ValueError(f"the labelled table has more than {LABELLED} rows")
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r["y"] for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r["buckets"]] = 1 / np.sqrt(max(1, len(r["buckets"])))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS if len(rows) else 0):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= RATE * (x.T @ (p - y) / len(y) * 10 + PENALTY * w)
        b -= RATE * (p - y).mean()
    return w, b


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, blocked."""
    values = ", ".join(f"('{u}', {k})" for k, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls)
    return spark.sql(f"SELECT * FROM VALUES {values} AS labelled(url, blocked)")


def _rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for _, h, p in ordered]
    chain = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), list(zip(fits, values, strict=True))[1:], F.when(fits[0], F.lit(values[0]))) if fits else F.lit(None).cast("string")
    return chain([h + p for _, h, p in ordered]), chain([a for a, _, _ in ordered])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule (its text or null), verdict (allow or block), score (the classifier's)."""
    weights, bias = train(labelled)
    host, path = host_and_path("url")
    rule, action = _rule(rules)
    parts = features(pages.select("page_id", host.alias("host"), path.alias("path")))
    table = F.lit([float(round(x, 6)) for x in weights])
    total = F.aggregate("buckets", F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    score = 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("buckets"), F.lit(1)).cast("double")) + F.lit(bias))))
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))

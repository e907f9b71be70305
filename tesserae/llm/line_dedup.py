"""Line dedup by site-relative frequency, in DataFrame operations only.

Lines of a page are counted once a page and host. A line on more than a given share of its host's
pages (and on two of them at least, so that a lone page keeps its lines) is boilerplate there, and is dropped from that host's pages. Counts
have a partial stage on the mappers' side. A host has few boilerplate lines by the ratio's
definition (their shares add up to the lines of a mean page at most), so they fit a list for each host; the
lists are broadcast if they're small by bytes, and joined by shuffle otherwise. Texts themselves are
not shuffled in the first case.

Lines are split at newlines and compared as they are, by 64-bit hash within a host.

Defined results: blank lines are never counted nor dropped; null text stays null, with no lines; an empty text
has one blank line; a null host counts as the empty one; repeated rows are pages of their own; a host's only page keeps all
lines; a page of boilerplate alone keeps an empty text; extra columns are kept by `clean`, whatever their names, but `n_lines` and `n_removed`, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_table

#: A line is boilerplate on more than so many hundredths of its host's pages, and on more than one page.
PERCENT, PAGES = 10, 2
#: Bytes of hosts' lists that are broadcast.
LISTS = 16 << 20


def _lines(text: str) -> Column:
    return F.split(text, "\n", -1)


def _full(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def boilerplate(documents: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, pages: int = PAGES) -> DataFrame:
    """(host, boilerplate): hashes of each host's boilerplate lines; hosts without any are left out."""
    page = documents.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    lines = page.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines("text"), _full), lambda x: F.xxhash64(x)))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pages)
    totals = page.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    return often.join(totals, "host").where(F.col("n") * 100 > F.col("total") * percent).groupBy("host").agg(F.collect_list("line").alias("boilerplate"))


def clean(documents: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, pages: int = PAGES) -> DataFrame:
    """The documents without their hosts' boilerplate lines, with n_lines and n_removed; documents' own columns of these names go."""
    name, gone, kept = (fresh(x, documents.columns) for x in ("_host", "_boilerplate", "_kept"))
    found = shared_table(documents.sparkSession, boilerplate(documents, host, text, percent, pages), "boilerplate").toDF(name, gone)
    size = found.agg(F.sum(F.size(gone) * 8 + F.octet_length(name) + 32)).first()[0] or 0
    marked = documents.withColumn(name, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(F.broadcast(found) if size <= LISTS else found, name, "left")
    left = F.filter(_lines(text), lambda x: ~(_full(x) & F.array_contains(gone, F.xxhash64(x))))
    marked = marked.withColumn(kept, F.when(F.col(gone).isNotNull() & F.col(text).isNotNull(), left))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    removed = F.coalesce(n - F.size(kept), F.lit(0)).cast("long")
    own = [F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    return marked.select(*own, n.alias("n_lines"), removed.alias("n_removed"))


ORACLE = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
per_page AS (SELECT host, unnest(list_distinct(list_filter(lines, lambda x: length(trim(x, ' ')) > 0))) AS line FROM pages),
counted AS (SELECT host, line, count(*) AS n FROM per_page GROUP BY 1, 2),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY 1),
boilerplate AS (SELECT host, list(line) AS b FROM counted JOIN totals USING (host) WHERE n >= {PAGES} AND n * 100 > total * {PERCENT} GROUP BY host),
cleaned AS (
  SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(b, []), x)) AS kept
  FROM pages LEFT JOIN boilerplate USING (host))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM cleaned
"""

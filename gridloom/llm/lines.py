"""Line dedup by site-relative frequency.

The documents of a host are its pages. A line found on more than a given share of the host's pages
is boilerplate of that host and is dropped from them; the same line on another host may stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, fresh, materialize, table

BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class SiteRule:
    """A line goes if it is on more than max_ratio of its host's pages and on least_pages pages at least."""

    max_ratio: float = 0.1
    least_pages: int = 3


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    """128 bits of a line; shuffled and compared in place of the line."""
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit(1), _bare(line)).alias("b"))


def _host(host: str) -> Column:
    """Hosts as keys that are never null: the null host is one of its own."""
    return F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit(""))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", rule: SiteRule = SiteRule()) -> DataFrame:
    """host_key, line (128-bit key), pages, ratio of the lines that exceed the rule, materialized.

    Lines are counted once a page; counting starts on the map side, so a line of a third of all
    pages is one row a task. A host has at most (lines a page) / max_ratio of them.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: _bare(x) != ""), _key))
    on_pages = docs.select(_host(host).alias("host_key"), F.explode(lines).alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= rule.least_pages)
    totals = docs.groupBy(_host(host).alias("host_key")).agg(F.count(F.lit(1)).alias("of"))
    found = on_pages.join(totals, "host_key").where(F.col("pages") > rule.max_ratio * F.col("of"))
    return materialize(found.select("host_key", "line", "pages", (F.col("pages") / F.col("of")).alias("ratio")), "boilerplate")


def site_line_dedup(docs: DataFrame, host: str = "source", text: str = "text", rule: SiteRule = SiteRule()) -> DataFrame:
    """Replace the text by what is left of it, and add n_lines and n_dropped (lines with a word).

    Lines are compared without the white space around them; blank lines are never dropped. Every
    row of docs comes back, even with no line left (then empty text); a null text stays null with
    no lines. Repeated rows are pages each. Columns of docs named n_lines or n_dropped are
    replaced, others pass through.
    """
    found = boilerplate_lines(docs, host, text, rule)
    key, drop = fresh(docs, "host_key"), fresh(docs, "drop")
    per_host = found.groupBy(F.col("host_key").alias(key)).agg(F.collect_list("line").alias(drop))
    left = docs.withColumn(key, _host(host))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = left.join(F.broadcast(per_host), key, "left")
    else:  # pages of a hot host meet copies of its one row in 64 tasks
        salt = fresh(docs, "salt")
        copies = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = left.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(64)).cast("int")).join(copies, [key, salt], "left").drop(salt)
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col(drop), _key(x)))
    words_in = lambda c: F.size(F.filter(c, lambda x: _bare(x) != "")).cast("long")
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(words_in(lines)).cast("long")
    out = joined.withColumns({"n_lines": n, "n_dropped": F.when(F.col(drop).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(n - words_in(kept)).cast("long")})
    return out.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(key, drop)


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return site_line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def line_dedup_sql(docs: str = "documents", rule: SiteRule = SiteRule(), columns: str = "doc_id, n_lines, n_dropped, text") -> str:
    return f"""
WITH pages AS (SELECT *, row_number() OVER () AS page FROM {docs}),
cut AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM pages),
trimmed AS (SELECT *, {_TRIM.format("line")} AS bare FROM cut),
counted AS (SELECT source, bare, count(DISTINCT page) AS n FROM trimmed WHERE bare <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS of FROM pages GROUP BY source),
bad AS (SELECT c.source, bare FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {rule.least_pages} AND n > {rule.max_ratio}::DOUBLE * of),
kept AS (
  SELECT t.page, count(*) FILTER (WHERE t.bare <> '') AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL) AS n_dropped, string_agg(t.line, chr(10) ORDER BY t.at) FILTER (WHERE b.bare IS NULL) AS rest
  FROM trimmed t LEFT JOIN bad b ON t.source IS NOT DISTINCT FROM b.source AND t.bare = b.bare GROUP BY t.page
)
SELECT {columns} FROM (
  SELECT p.* EXCLUDE (text, page), coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN p.text IS NOT NULL THEN coalesce(rest, '') END AS text FROM pages p LEFT JOIN kept USING (page)
)
"""


OP2_SQL = line_dedup_sql()

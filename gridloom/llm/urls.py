"""URL filters: explicit host rules first, then rules mined from labelled pages.

The mined rules are association rules. Each URL becomes a set of tokens (top-level domain, host
suffixes, words of subdomains and paths, query keys). FP-growth over the blocked URLs gives token
combinations with enough support; how many of all labelled URLs have them, and so their confidence, is
counted by matching. Matching is by an inverted index on the rarest token of each combination, for
counting as for judging.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_ROWS, add_from_column, materialize, table

#: (host, path, verdict)
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

@dataclass(frozen=True)
class Mining:
    """support: least share of the labelled URLs with the tokens and the block label, and least_rows
    the least number of them; confidence: least share of blocked URLs among those with the tokens;
    longest: most tokens of a rule."""

    support: float = 0.002
    least_rows: int = 10
    confidence: float = 0.8
    longest: int = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What the first :// is followed by: up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substring(whole, F.instr(whole, "://") + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A few rules, so plain expressions."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


_CUT = re.compile(r"[^0-9a-z]+")


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL. Digits are written as 0, so that page numbers don't make tokens of their own."""
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    tail = rest[len(host) :]
    parts = host.lower().split(".")
    out = {f"tld={parts[-1]}"}
    out |= {f"host={'.'.join(parts[i:])}" for i in range(max(0, len(parts) - 4), len(parts) - 1)}
    out |= {f"h:{w}" for part in parts[:-2] for w in _CUT.split(part) if w}
    path, _, query = tail.split("#", 1)[0].partition("?")
    out |= {f"p:{re.sub('[0-9]+', '0', w)}" for w in _CUT.split(path.lower()) if w}
    out |= {f"q:{k}" for k in (x.split("=", 1)[0].lower() for x in query.split("&")) if k}
    return sorted(out)


def with_tokens(pages: DataFrame, url: str) -> DataFrame:
    return add_from_column(pages, url, [T.StructField("tokens", T.ArrayType(T.StringType()))], lambda: lambda urls: {"tokens": [url_tokens(u) for u in urls]})


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """labelled: tokens, blocked. Returns tokens, confidence, support of the rules kept, materialized.

    support is the share of all labelled rows that are blocked and have the tokens. A rule that another
    with some of its tokens matches in confidence is left out, since it decides nothing. An empty
    table, or one without blocked rows, has no rules.
    """
    spark = labelled.sparkSession
    rows = materialize(labelled.where(F.size("tokens") > 0).select("tokens", F.col("blocked").alias("blocked")), "transactions")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    least = max(mining.support * n, mining.least_rows)
    if not bad or least > bad:
        return empty
    items = rows.where("blocked").select(F.col("tokens").alias("items")).repartition(spark.sparkContext.defaultParallelism)
    found = FPGrowth(itemsCol="items", minSupport=least / bad, minConfidence=1.0, numPartitions=spark.sparkContext.defaultParallelism).fit(items).freqItemsets
    sets = materialize(found.where((F.size("items") <= mining.longest) & (F.col("freq") >= least)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")), "itemsets")
    counted = _matches(rows.select("tokens"), sets.select("tokens")).join(sets, "tokens")
    rules = counted.select("tokens", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support")).where(F.col("confidence") >= mining.confidence)
    rules = materialize(rules, "rules")
    shorter = F.filter(F.transform(F.sequence(F.lit(1), F.lit((1 << mining.longest) - 2)), lambda bits: F.filter("tokens", lambda _, i: F.floor(bits / F.pow(F.lit(2), i)) % 2 == 1)), lambda t: (F.size(t) > 0) & (F.size(t) < F.size("tokens")))
    parts = rules.select("tokens", "confidence", F.explode(F.array_distinct(shorter)).alias("part"))
    beaten = parts.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("as_good")), "part").where("as_good >= confidence").select("tokens").distinct()
    return materialize(rules.join(beaten, "tokens", "left_anti"), "rules")


def _postings(rules: DataFrame) -> DataFrame:
    """tokens of each rule under its rarest token: t, need."""
    freq = rules.select(F.explode("tokens").alias("t")).groupBy("t").count()
    return rules.select(F.col("tokens").alias("need"), F.explode("tokens").alias("t")).join(freq, "t").groupBy("need").agg(F.min_by("t", F.struct("count", "t")).alias("t"))


def _matches(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens of each rule and the number n of transactions (column tokens) that have them.

    Sums start in the tasks. The index goes to the tasks while it has up to BROADCAST_ROWS rules;
    a larger one is joined on the rarest tokens, over distinct transactions with their counts.
    """
    postings = materialize(_postings(rules), "postings")
    if postings.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = defaultdict(list)
        for r in postings.collect():
            index[r.t].append((frozenset(r.need), tuple(r.need)))

        def run(batches: Iterable[pa.RecordBatch]):
            sums: Counter = Counter()
            for b in batches:
                for have in b.column(0).to_pylist():
                    whole = set(have)
                    sums.update(name for t in have for need, name in index.get(t, ()) if need <= whole)
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in sums], pa.list_(pa.string())), pa.array(list(sums.values()), pa.int64())], names=["tokens", "n"])

        return transactions.mapInArrow(run, "tokens array<string>, n long").groupBy("tokens").agg(F.sum("n").alias("n"))
    distinct = transactions.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    hits = distinct.withColumn("t", F.explode("tokens")).join(postings, "t").where(F.size(F.array_except("need", "tokens")) == 0)
    return hits.groupBy(F.col("need").alias("tokens")).agg(F.sum("n").alias("n"))


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add mined: the highest confidence of a rule whose tokens the URL has, null if there is none.

    The index goes to the tasks while it has up to BROADCAST_ROWS rules, and the pages are then
    matched where they are. A larger one is joined on the rules' rarest token, over distinct URLs.
    """
    postings = materialize(_postings(rules).join(rules.select(F.col("tokens").alias("need"), "confidence"), "need"), "postings")
    if postings.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = defaultdict(list)
        for r in postings.collect():
            index[r.t].append((frozenset(r.need), r.confidence))

        def best(u):
            have = url_tokens(u)
            whole = set(have)
            return max((c for t in have for need, c in index.get(t, ()) if need <= whole), default=None)

        return add_from_column(pages, url, [T.StructField("mined", T.DoubleType())], lambda: lambda urls: {"mined": [best(u) for u in urls]})
    distinct = with_tokens(pages.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct(), "u")
    hits = distinct.withColumn("t", F.explode("tokens")).join(postings, "t").where(F.size(F.array_except("need", "tokens")) == 0)
    mined = materialize(hits.groupBy("u").agg(F.max("confidence").alias("mined")), "mined")
    left = pages.drop("mined")
    return left.join(mined.withColumnRenamed("u", "__u"), left[url] == F.col("__u"), "left").drop("__u")


def judge_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=HOST_RULES, mining: Mining = Mining()) -> DataFrame:
    """Add host, path, rule, verdict and mined to pages.

    labelled: url, blocked. A null URL or one without :// has empty host and path and no tokens and
    is allowed; so are all that no rule fits. Rows are judged one by one, repeated rows alike;
    columns of pages with the new names are replaced.
    """
    known = with_tokens(labelled.where(F.col("blocked").isNotNull()).select("url", "blocked"), "url")
    out = match_rules(pages, mine_rules(known, mining), url)
    host, path = host_and_path(F.col(f"`{url}`"))
    out = out.withColumns({"host": host, "path": path})
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", name)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")))


def op4_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the row of labels with its number: blocked if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge_urls(pages, pages.join(marks, "page_id").select("url", "blocked")).select("page_id", "host", "path", "rule", "verdict", "mined")

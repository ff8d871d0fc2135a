"""Personal data: fixed patterns, and more found by bootstrapped contexts. Spark expressions only.

The fixed patterns give emails, IP addresses, cards and phones. Phones, cards, runs of digit groups
with one blank between them, and tokens with a digit or an @ are instances, each as a whole; the
words around them are lexical patterns. Instances that the fixed patterns cover are
seeds of their kind. Patterns are scored by their instances and instances by their patterns, in
turn; instances that no fixed pattern covers but good patterns hold are added.

No expression here backtracks over more than one run of characters: runs are possessive and may
start only where a run begins (or where the last match ended), so long texts take linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh, let, lookup, materialize, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 14 to 19 digits; shorter and longer runs fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Phones and cards as the fixed patterns find them, without the checks of their digits but the number.
SPACED = rf"(?:\+[0-9](?:[ ().-]*+[0-9]){{9,14}}+(?![ ().-]*+[0-9])|{CARD})"
#: Digit groups of up to 12 characters, up to 8 of them with one blank between two; longer numbers stand alone.
GROUP = r"[0-9](?:[0-9().-]{0,9}[0-9)])?+(?![0-9])"
RUN = rf"[^\s\p{{L}}0-9@]*+{GROUP}(?:[ \t]\(?{GROUP}(?=[^\s\p{{L}}0-9@]*+(?:\s|$))){{1,7}}+"
INSTANCE = rf"{SPACED}|(?<!\S)(?![^\s0-9@+]*+{SPACED})(?:{RUN}|[^\s0-9@]*+[0-9@]\S*+)"


@dataclass(frozen=True)
class Bootstrap:
    """rounds: of scoring, which ends when one finds nothing new; more than this many raise. support: least distinct seeds of a pattern; confidence: least share of
    a pattern's instances, and least score of an instance."""

    rounds: int = 100
    support: int = 5
    confidence: float = 0.9


def _starts(pieces: Column, found: Column, step: int = 512) -> Column:
    """Start of each match in code points, from the pieces between the matches; sums go by blocks of step.

    Both arrays must be lambda variables or columns.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    lens = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    block = lambda i: F.floor(i / step).cast("int")

    def by_blocks(lens: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(found))), lambda b: total(F.slice(lens, b * step + 1, F.lit(step))))
        before = let(blocks, lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))
        return let(before, lambda t: F.transform(found, lambda m, i: F.get(t, block(i)) + total(F.slice(lens, block(i) * step + 1, i % step)) + F.length(F.get(pieces, i))))

    return let(lens, by_blocks)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    digits = lambda: F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return _luhn(digits())
    if kind == "phone":
        return F.length(digits()).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: array of (start, kind, end); the texts that can't have any skip the search."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}[kind]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))

    def spans(z: Column) -> Column:
        starts = F.zip_with(_starts(z.pieces, z.found), z.found, lambda a, m: F.struct(a.alias("start"), m.alias("m")))
        good = F.filter(starts, lambda x: _passes(kind, x.m))
        return F.transform(good, lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x.start + F.length(x.m)).alias("end")))

    return F.when(may, let(both, spans)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    every = [_spans(F.coalesce(text, F.lit("")), k).cast("array<struct<start:int,kind:int,end:int>>") for k in KINDS]
    return F.array_sort(F.concat(*every))


def _last_words(before: Column, tail: int = 60) -> Column:
    """The last two words. Mostly the end of the text shows both; else, as among very long words, all of it is cut."""
    end = F.substring(before, F.greatest(F.length(before) - tail, F.lit(0)) + 1, F.lit(tail))
    near = F.regexp_extract(end, r"(?:\S+\s+)?\S+\s*$", 0)
    every = let(F.split(F.trim(F.regexp_replace(before, r"\s+", " ")), " "), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "))
    return F.when((F.length(before) <= tail) | end.rlike(r"\s\S+\s+\S+\s*$"), near).otherwise(every)


def _key(c: Column, most: int = 100) -> Column:
    """A string to tell equal tokens or contexts by: longer ones as their digest."""
    return F.when(F.length(c) > most, F.concat(F.lit("sha2 "), F.sha2(c, 256))).otherwise(c)


def _instances(text: Column) -> Column:
    """Matches of INSTANCE: array of (start, end, token, left, right), two words on either side (fewer only at the text's ends), digits as 0.

    Tokens and words may have any length; those of more than 100 characters are told by their digests.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(INSTANCE), F.lit(0)).alias("found"), F.split(text, INSTANCE, -1).alias("pieces"))

    def before(z: Column, i: Column) -> Column:  # up to two instances back, so that neighbours are context too
        return F.concat(F.coalesce(F.get(z.found, i - 2), F.lit("")), F.when(i > 0, F.get(z.pieces, i - 1)).otherwise(""), F.coalesce(F.get(z.found, i - 1), F.lit("")), F.get(z.pieces, i))

    def after(z: Column, i: Column) -> Column:
        return F.concat(F.get(z.pieces, i + 1), F.coalesce(F.get(z.found, i + 1), F.lit("")), F.coalesce(F.get(z.pieces, i + 2), F.lit("")), F.coalesce(F.get(z.found, i + 2), F.lit("")))

    def around(z: Column) -> Column:
        return let(_starts(z.pieces, z.found), lambda t: F.transform(z.found, lambda m, i: F.struct(F.get(t, i).alias("start"), m.alias("m"), before(z, i).alias("before"), after(z, i).alias("after"))))

    def cut(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x.m, r"^(?:(?!\([0-9]+\))[^\p{L}\p{N}@+])*+", 0))
        core = F.regexp_replace(F.substring(x.m, lead + 1, F.length(x.m)), r"[^\p{L}\p{N}]++$", "")
        plain = lambda c: _key(F.regexp_replace(F.lower(c), "[0-9]", "0"))
        left = let(x.before, _last_words)
        right = F.regexp_extract(x.after, r"^[^\s\p{L}\p{N}]*+\s*+(\S++(?:\s++\S++)?+)", 1)
        return F.struct((x.start + lead).alias("start"), (x.start + lead + F.length(core)).alias("end"), _key(core).alias("token"), plain(F.trim(F.regexp_replace(left, r"\s+", " "))).alias("left"), plain(F.regexp_replace(right, r"\s+", " ")).alias("right"))

    out = F.filter(F.transform(let(both, around), cut), lambda x: x.end > x.start)
    kind = "array<struct<start:int,end:int,token:string,left:string,right:string>>"
    return F.when(text.rlike("[0-9@]"), out).otherwise(F.array().cast(kind)).cast(kind)


def discover(scanned: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """token, kind of the instances that contexts mark and no fixed pattern covers, materialized.

    scanned: spans and instances of each text. The graph's edges are distinct pairs of pattern and
    token; every sum over a pattern or token starts on the map side, so a pattern that a third of
    all instances share is a few rows a task.
    """
    one = scanned.select("spans", F.explode("instances").alias("i"))
    cover = F.filter("spans", lambda s: (s.start < F.col("i.end")) & (s.end > F.col("i.start")))
    seen = one.select("i.token", F.get(cover, F.lit(0)).kind.alias("seed"), F.explode(F.array(
        F.when(F.col("i.left") != "", F.concat(F.lit("L "), "i.left")),
        F.when((F.col("i.left") != "") & (F.col("i.right") != ""), F.concat(F.lit("S "), F.substring_index("i.left", " ", -1), F.lit(" _ "), F.substring_index("i.right", " ", 1))),
        F.when(F.col("i.right") != "", F.concat(F.lit("R "), "i.right")),
    )).alias("pattern"))
    edges = materialize(seen.where("pattern is not null").groupBy("pattern", "token").agg(F.min("seed").alias("seed")), "edges")
    seeds = edges.groupBy("token").agg(F.min("seed").alias("kind")).where("kind is not null").withColumn("score", F.lit(1.0))
    believed = materialize(seeds, "believed")
    new = believed.limit(0)
    for _ in range(how.rounds):
        sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= how.support)
        per = edges.join(believed, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.support)
        good = per.join(sizes, "pattern").where(F.col("mass") >= how.confidence * F.col("of")).select("pattern", "kind", (F.col("mass") / F.col("of")).alias("trust"))
        good = materialize(good, "patterns")
        held = lookup(edges.join(believed, "token", "left_anti"), good, ["pattern"], "inner", spread=F.xxhash64("token"))
        found = held.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust") * how.confidence, F.lit(1e-9)))))).alias("score"), F.max("trust").alias("trust"))
        found = found.where(F.greatest("score", "trust") >= how.confidence)
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "kind"))).where("r = 1")
        step = materialize(best.select("token", "kind", "score"), "found")
        if step.isEmpty():
            break
        new = new.unionByName(step)
        believed = materialize(believed.unionByName(step), "believed")
    else:
        raise RuntimeError(f"contexts still find identifiers after {how.rounds} rounds")
    return new.select("token", "kind")


def personal_data(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """Add base (spans of the fixed patterns) and spans (with those that contexts add) to the rows of docs.

    Spans are (start, kind, end) in code points, end exclusive, by start and then kind; kinds count as in
    KINDS. Null and empty texts have none. Spans depend on the text alone, so repeated rows have equal
    ones. Columns of docs named base or spans are replaced; others but the text pass through.
    """
    a, b, held, more = (fresh(docs, x) for x in ("hash_a", "hash_b", "instances", "extra"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text.lower(), "base", "spans")]
    scanned = docs.select(*rest, F.xxhash64(whole).alias(a), F.xxhash64(F.lit(1), whole).alias(b), base_spans(whole).alias("base"), _instances(whole).alias(held))
    scanned = materialize(scanned, "scanned")
    found = discover(scanned.select(F.col("base").alias("spans"), F.col(held).alias("instances")), how)
    out = scanned.drop(held)
    found = materialize(found, "identifiers")
    at = scanned.where(F.size(held) > 0).select(a, b, "base", F.explode(held).alias("i"))
    hits = lookup(at.withColumn("token", F.col("i.token")), found, ["token"], "inner", spread=F.xxhash64(a, "i.start"))
    free = ~F.exists("base", lambda s: (s.start < F.col("i.end")) & (s.end > F.col("i.start")))
    extra = hits.where(free).groupBy(a, b).agg(F.collect_set(F.struct(F.col("i.start").alias("start"), F.col("kind").alias("kind"), F.col("i.end").alias("end"))).alias(more))
    both = lookup(out, materialize(extra, "extra"), [a, b], "left", spread=F.xxhash64(*rest) if rest else None)
    return both.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(more, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))).drop(a, b, more)


def _line(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(_line("base"), 256).alias("base_sha256"), _line("spans").alias("spans"))

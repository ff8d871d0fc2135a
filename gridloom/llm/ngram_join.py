"""Exact Jaccard self-join of documents on word shingles, with prefix filters of several orders.

For sets of similarity t or more, prefixes of n - ceil(t n) + 1 tokens share a token, whatever the
global order of the tokens. Several orders are used:

* The first puts a slice of the tokens, cut by hash, before the rest, and in the slice the tokens
  of fewest documents first. Most prefixes then hold tokens of one document only and match nothing.
  Documents that share prefix tokens are joined into classes; linked documents are in one class.
* Classes too large for a task are split by two more orders by independent hashes: documents stay
  together only if they share prefix tokens, directly or by others, under each of them as well.
* Inside a class, those two orders are intersected for each pair before its sets are compared.
  Pairs already connected are not compared.

Documents with equal sets are one node from the start. No pair is emitted but the links that join
two parts of a component, so a group of near copies costs its size, not its square, in rows. Tokens
of very many documents are found on a sample and salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, few_rows, fresh, lookup, materialize, spread, table
from .graph import components

#: Seeds of the orders by hash.
ORDERS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Join:
    """words of a shingle; percent: least similarity; slice_: tokens whose documents are counted, as
    multiples of the prefix; block: most documents of a class that one task compares; hot: a token of more
    than this share of the documents is salted."""

    words: int = 3
    percent: int = 90
    slice_: float = 2.0
    block: int = 1000
    hot: float = 0.001

    def prefix(self, n):
        """Length of the prefix of a set of n tokens, in whole numbers."""
        return n - (self.percent * n + 99) // 100 + 1

    @property
    def bar(self) -> int:
        """Tokens below it, as signed 64-bit numbers, are in the slice."""
        return int(-(1 << 63) + min(1.0, self.slice_ * (1 - self.percent / 100)) * (1 << 64)) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of fewer than k words, the whole sequence is one."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    a = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(k, len(w))
    n = len(a) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mix(h + a[j : n + j], _B)
    return np.unique(h.view(np.int64))


def fingerprint(tokens: bytes) -> int:
    """A set, by its sorted tokens, as a signed 64-bit number; sets are told by it."""
    return xxhash.xxh64_intdigest(tokens) - (1 << 63)


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _first_pass(docs: DataFrame, id_col: str, text: str, how: Join) -> DataFrame:
    """id, h, n, fp (of the set; null if empty), slice and spill: the slice's tokens, and those of the rest that the prefix reaches."""
    names = ["id", "h", "n", "fp", "slice", "spill"]

    def run(batches: Iterable[pa.RecordBatch]):
        known = _Hashes()
        bar = how.bar
        for b in few_rows(batches):
            rows: list[list] = [[] for _ in range(4)]
            for t in b.column(2).to_pylist():
                s = shingles(t, how.words, known)
                cut = int(np.searchsorted(s, bar))
                need = how.prefix(len(s)) - cut if len(s) else 0
                for to, v in zip(rows, (len(s), fingerprint(s.tobytes()) if len(s) else None, s[:cut], s[cut : cut + max(0, need)]), strict=True):
                    to.append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], longs), pa.array(rows[3], longs)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), _text_hash(text).alias("h"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, h long, n long, fp long, slice array<long>, spill array<long>")


def _hot_tokens(nodes: DataFrame, n: int, how: Join, rows: int = 20_000) -> DataFrame:
    """Tokens of the slices that more than how.hot of a sample of nodes have; at most the tokens of a node / how.hot of them."""
    some = nodes if n <= rows else nodes.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 20)) < int(rows / n * (1 << 20)) + 1)
    return some.select(F.explode("slice").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(2, int(how.hot * min(n, rows)))).select("token", F.lit(True).alias("hot"))


def _prefixes(nodes: DataFrame, how: Join, salts: int = 64) -> DataFrame:
    """token, node of the prefixes by the first order, without tokens of one document."""
    hot = materialize(_hot_tokens(nodes, nodes.count(), how), "hot")
    salt = F.when(F.col("hot"), F.pmod("node", F.lit(salts)) + 1).otherwise(0).cast("int")
    # dealt by token once: counting and joining both read this exchange (counting node keeps its column in it)
    rows = nodes.select("node", F.explode("slice").alias("token")).where("node is not null and token is not null")
    rows = rows.join(F.broadcast(hot), "token", "left").select("token", salt.alias("salt"), "node").repartition("token", "salt")
    counts = rows.groupBy("token", "salt").agg(F.count("node").alias("df")).where("df > 1 or salt > 0")
    shared = rows.join(counts, ["token", "salt"])
    totals = nodes.select(F.explode("slice").alias("token")).join(F.broadcast(hot), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("total"))
    shared = shared.join(F.broadcast(totals), "token", "left").withColumn("df", F.coalesce("total", "df")).where("df > 1")
    shared = shared.groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    need = F.expr(f"n - ({how.percent} * n + 99) div 100 + 1") - (F.size("slice") - F.size("shared"))
    picked = F.transform(F.slice(F.array_sort("shared"), F.lit(1), F.greatest(need, F.lit(0)).cast("int")), lambda x: x.token)
    first = nodes.join(shared, "node").select("node", F.explode(picked).alias("token"))
    return first.union(nodes.select("node", F.explode("spill").alias("token")))


def _classes(entries: DataFrame, how: Join) -> DataFrame:
    """node, component of the nodes that share a token with another; each token ties its nodes to the smallest. entries: materialized."""
    hubs = materialize(entries.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1"), "hubs")
    many = max(100, int(how.hot * (hubs.agg(F.sum("c")).first()[0] or 0)))
    hot = F.broadcast(hubs.where(F.col("c") > many).drop("c"))  # fewer than 1 / how.hot
    ties = entries.join(hot, "token").union(entries.join(hot, "token", "left_anti").join(hubs.where(F.col("c") <= many).drop("c"), "token").select("token", "node", "hub"))
    return components(ties.select(F.col("node").alias("u"), F.col("hub").alias("v")))


def linked(sets: list[np.ndarray], part: list[int], how: Join, other: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join different parts of the sets of one class; part: known part of each.

    With other, only pairs of a set before it and one from it on.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    up = {p: i for i, p in reversed(list(enumerate(part)))}
    root = np.array([up[p] for p in part])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    vocab, local = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    posts = []
    for salt in ORDERS:
        order = _mix(vocab.view(np.uint64), salt).argsort().argsort()[local]
        by = np.lexsort((order, owner))
        at = np.arange(len(flat)) - starts[owner]
        head = at < how.prefix(sizes)[owner]  # owner is unchanged by the sort, which stays within documents
        token, who = local[by][head], owner[head]
        o = np.argsort(token, kind="stable")
        token, who = token[o], who[o]
        low, high = np.searchsorted(token, np.arange(len(vocab)), "left"), np.searchsorted(token, np.arange(len(vocab)), "right")
        mine = [[] for _ in range(m)]
        for t, w in zip(local[by][head].tolist(), owner[head].tolist(), strict=True):
            if high[t] - low[t] > 1:
                mine[w].append(t)
        posts.append((who, low, high, mine))
    links, mark = [], np.zeros(len(vocab), bool)
    for i in range(m):
        near = None
        for who, low, high, mine in posts:
            hit = np.zeros(m, bool)
            for t in mine[i]:
                hit[who[low[t] : high[t]]] = True
            near = hit if near is None else near & hit
        near[: i + 1] = False
        if other is not None:
            if i >= other:
                break
            near[:other] = False
        n = sizes[i]
        small, large = np.minimum(sizes, n), np.maximum(sizes, n)
        near &= (root != root[i]) & (100 * small >= how.percent * large)
        cand = np.flatnonzero(near)
        if not len(cand):
            continue
        mine_tokens = local[starts[i] : starts[i + 1]]
        mark[mine_tokens] = True
        for lo in range(0, len(cand), 512):
            some = cand[lo : lo + 512]
            lens = sizes[some]
            cuts = np.cumsum(lens) - lens
            index = np.arange(lens.sum()) - np.repeat(cuts, lens) + np.repeat(starts[some], lens)
            common = np.add.reduceat(mark[local[index]].astype(np.int64), cuts)
            for j in some[100 * common >= how.percent * (n + lens - common)].tolist():
                if root[j] != root[i]:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
        mark[mine_tokens] = False
    return links


def _compare(rows: DataFrame, how: Join) -> DataFrame:
    """u, v: links inside the groups of rows (grp, side, node, part, tokens); sides -1 stand alone, 0 and 1 face each other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"]).reset_index(drop=True)
        sets = [np.frombuffer(t, np.int64) for t in pdf["tokens"]]
        other = int((pdf["side"] < 1).sum()) if pdf["side"].iloc[-1] == 1 else None
        got = linked(sets, pdf["part"].tolist(), how, other) if len(sets) > 1 else []
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"u": node[[i for i, _ in got]], "v": node[[j for _, j in got]]}, dtype="int64")

    return rows.groupBy("grp").applyInPandas(run, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Join = Join()) -> DataFrame:
    """id, n_shingles and component_id, the smallest id reachable by links, of each row of docs. Ids may be of any type with an order.

    Null texts, empty texts and texts without words have no shingles and are linked with nothing:
    their component is their own. Rows with equal sets are linked. A null id takes part under no
    name: it gets a null component unless linked. Repeated rows come back as often as they stand.
    Where an id stands on different texts, each text is a document of its own with its own links.
    Whole texts count, whatever their length; columns other than id and text are left out. Shingles
    are compared by 64-bit hashes. An empty table gives no rows.
    """
    return _components(docs, id_col, text, how).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text: str, how: Join) -> DataFrame:
    """id, h (hash of the text), n, fp, part (null without shingles) and least, the smallest id of the part; materialized."""
    first = materialize(_first_pass(docs, id_col, text, how), "shingles")
    nodes = first.where("fp is not null").groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("slice").alias("slice"), F.first("spill").alias("spill"), F.count(F.lit(1)).alias("c"))
    nodes = materialize(nodes, "nodes")
    classes = _classes(materialize(_prefixes(nodes, how), "prefixes"), how)
    links = _links(docs, id_col, text, nodes.select("node", "id").join(classes, "node"), how)
    linked_ = components(links)
    smallest = materialize(nodes.join(linked_, "node").groupBy("component").agg(F.min("id").alias("least")), "smallest")
    named = lookup(linked_, smallest, ["component"], "inner", spread=F.xxhash64("node"))
    found = nodes.select("node", "id", "c").join(named, "node", "left").select(F.col("node").alias("fp"), "c", F.coalesce("component", "node").alias("part"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"))
    found = materialize(found, "parts")
    rows = first.select("id", "h", "n", "fp")
    many = max(100, int(how.hot * rows.count()))
    hot = F.broadcast(found.where(F.col("c") > many))  # texts of very many copies; fewer than 1 / how.hot
    cold = rows.join(hot, "fp", "left_anti").join(found.where(F.col("c") <= many), "fp", "left")
    return materialize(rows.join(hot, "fp").unionByName(cold).drop("c"), "components_of")


def _links(docs: DataFrame, id_col: str, text: str, classes: DataFrame, how: Join) -> DataFrame:
    """Links that hold the components together: (u, v). classes: node, id of a row with its text, component."""
    classes = materialize(classes.where("id is not null"), "members")
    few = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(classes) if few else classes, "id")

    def whole(batches: Iterable[pa.RecordBatch]):
        known = _Hashes()
        for b in few_rows(batches):
            sets = [shingles(t, how.words, known).tobytes() for t in b.column(2).to_pylist()]
            own = [i for i, (g, node) in enumerate(zip(sets, b.column(0).to_pylist(), strict=True)) if fingerprint(g) == node]  # an id may stand on other texts too
            got = [sets[i] for i in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), b.column(1).take(pa.array(own, pa.int64())), pa.array([len(g) // 8 for g in got], pa.int64()), pa.array(got, pa.binary())], names=["node", "cls", "n", "tokens"])

    sets = some.select("node", "component", "text").mapInArrow(whole, "node long, cls long, n long, tokens binary")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    for seed in ORDERS:
        large = sets.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > how.block).select("cls")
        large = materialize(large, "large")
        if large.isEmpty():
            break
        sets = _split(sets, large, seed, how)
    bin_ = F.floor(F.log("n") / math.log(100 / how.percent)).cast("int")  # linked sets are in one bin or in two next to each other
    binned = sets.withColumn("bin", bin_)
    sizes = binned.groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    parts = F.ceil(F.greatest(F.col("m") / how.block, F.col("all") / (how.block * 300))).cast("int")
    per_class = sizes.groupBy("cls").agg(F.sum("m").alias("of"), F.sum("all").alias("tokens_of"))
    plain = sizes.select("cls", "bin", parts.alias("blocks")).join(per_class, "cls")
    plain = materialize(plain.select("cls", "bin", "blocks", ((F.col("of") <= how.block) & (F.col("tokens_of") <= how.block * 300)).alias("small")), "classes")
    tagged = binned.join(plain, ["cls", "bin"])
    alone = tagged.where("small").select(F.struct("cls", F.lit("").alias("i"), F.lit("").alias("j")).alias("grp"), F.lit(-1).alias("side"), "node", F.col("node").alias("part"), "tokens")
    found = materialize(_compare(alone, how), "links")
    if plain.where("not small").isEmpty():
        return found
    return found.union(_large_classes(tagged.where("not small"), how))


def _split(sets: DataFrame, large: DataFrame, seed: np.uint64, how: Join) -> DataFrame:
    """The sets, with the large classes split by shared prefix tokens under one more order; who shares none goes. Materialized."""

    def heads(batches: Iterable[pa.RecordBatch]):
        for b in few_rows(batches):
            nodes, tokens = [], []
            for node, cls, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = np.frombuffer(raw, np.int64)
                order = _mix(s.view(np.uint64), seed)
                head = s[np.argsort(order)[: how.prefix(len(s))]]
                tokens.append(_mix(head.view(np.uint64), np.uint64(cls & (1 << 64) - 1) | np.uint64(1)).view(np.int64))  # a token of this class
                nodes.append(np.full(len(head), node))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    of = sets.join(F.broadcast(large), "cls", "left_semi")
    entries = materialize(of.select("node", "cls", "tokens").mapInArrow(heads, "token long, node long"), "heads")
    finer = _classes(entries, how)
    split = of.drop("cls").join(finer.withColumnRenamed("component", "cls"), "node").select("node", "cls", "n", "tokens")
    return materialize(sets.join(F.broadcast(large), "cls", "left_anti").select("node", "cls", "n", "tokens").union(split), "sets")


def _large_classes(rows: DataFrame, how: Join) -> DataFrame:
    """Classes beyond one task: first blocks of sets of similar size alone, then each pair of blocks of the same or the next bin that holds more than one part."""
    cut = rows.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    name = lambda *c: F.concat_ws(":", *c)
    alone = cut.select(F.struct("cls", name("bin", "sub").alias("i"), F.lit("").alias("j")).alias("grp"), F.lit(-1).alias("side"), "node", F.col("node").alias("part"), "tokens")
    inside = materialize(_compare(alone, how), "links")
    parts = components(inside)
    known = cut.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    largest = known.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("cls").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    known = known.join(largest, "cls").withColumn("is_main", (F.col("part") == F.col("main")).cast("int"))
    known = materialize(known.select("cls", "bin", name("bin", "is_main", "sub").alias("blk"), "is_main", "node", "part", "tokens"), "known")
    ids = known.select("cls", "bin", "blk", "is_main").distinct()
    right = ids.select("cls", F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), F.col("bin").alias("bin2"), F.col("blk").alias("blk2"), F.col("is_main").alias("main2"))
    pairs = ids.join(right, ["cls", "bin"]).where(((F.col("bin2") > F.col("bin")) | (F.col("blk") < F.col("blk2"))) & (F.col("is_main") + F.col("main2") < 2))
    pairs = materialize(pairs.select("cls", F.col("blk").alias("i"), F.col("blk2").alias("j")), "pairs")
    face = pairs.select("cls", F.struct("cls", "i", "j").alias("grp"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("blk")), F.struct(F.lit(1).alias("side"), F.col("j").alias("blk")))).alias("e"))
    rows2 = face.select("cls", "grp", "e.side", "e.blk").join(known, ["cls", "blk"]).select("grp", "side", "node", "part", "tokens")
    return inside.union(_compare(rows2, how))


def op5_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Join = Join(words=5, percent=80)) -> DataFrame:
    """The rows of docs of smallest id in their component, once each; rows with a null id stay.

    Documents without shingles stay, one row for each id and text. Of one id on several texts of a
    component, the text of smallest hash stays; on texts of different components, one of each does.
    Repeated rows become one, and a null text counts as empty. Other columns pass through; of rows equal
    in id and text one stays. An empty table gives no rows.
    """
    h, gone, name = fresh(docs, "text_hash"), fresh(docs, "gone"), F.col(f"`{id_col}`")
    found = _components(docs.where(name.isNotNull()), id_col, text, how)
    best = found.where("part is not null").groupBy("part").agg(F.min(F.struct("id", "h")).alias("best"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    marked = lookup(found, materialize(best, "best"), ["part"], "left", spread=F.xxhash64("id", "h")).select("id", "h", F.coalesce(F.struct("id", "h") != F.col("best"), F.lit(False)).alias(gone))
    marked = materialize(marked.groupBy("id", "h").agg(F.max(gone).alias(gone), F.count(F.lit(1)).alias("times")), "marked")
    keys = lambda d: d.select(F.col("id").alias(id_col), F.col("h").alias(h))
    out, mine = docs.withColumn(h, _text_hash(text)), marked.where(F.col(gone))
    few = mine.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = out.join(F.broadcast(keys(mine)) if few else keys(mine), [id_col, h], "left_anti")
    again = marked.where(~F.col(gone) & (F.col("times") > 1))
    if not again.isEmpty():
        few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        side = F.broadcast(keys(again)) if few else keys(again)
        out = out.join(side, [id_col, h], "left_anti").unionByName(out.join(side, [id_col, h], "left_semi").dropDuplicates([id_col, h]))
    return out.select(*docs.columns)


#: Reachability over verified links, for tables of some thousand documents; ids must be distinct.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x
)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""

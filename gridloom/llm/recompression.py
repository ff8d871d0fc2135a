"""Substring dedup by recompression.

Rounds name the runs of a token and the pairs of tokens of each text by 64-bit fingerprints of
their parts, which are the same in every task, so equal stretches get equal symbols without a
dictionary. A symbol depends on the words of its surrounds alone: its neighbours decided where a
run ends and whether it was paired. Those words are its context. A window sees the symbols whose
contexts it holds, and takes one of the highest round as its anchor, the least by a hash; equal
windows take equal anchors, wherever they lie. Spark brings equal anchors together, in the order
of the ids, and the windows around them are compared there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import few_rows, fresh, materialize, spread, table

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)

#: The base of fingerprints of stretches, and its inverse modulo 2^64.
BASE = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Bytes kept of the fingerprint of a window; its anchor's 64 bits come on top.
KEPT = 5


@dataclass(frozen=True)
class Repeats:
    """window: words of the shortest repeat; rounds: of runs and pairs; held: windows of one anchor that a task
    holds before it hands the rest on; words: of texts that are compared before anything is shuffled."""

    window: int = 13
    rounds: int = 2
    held: int = 200_000
    words: int = 1 << 18


def _mix(x: np.ndarray, by: np.uint64 = _B) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_names(data: np.ndarray, begins: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first byte of each word of texts that lie one after the other; begins: where each text begins.

    A word's bytes are hashed with their places and summed, some bytes at a time.
    """
    first = np.empty(len(data), bool)
    space = _SPACE[data]
    if len(data):
        first[0] = True
        first[1:] = space[:-1]
        first[begins[begins < len(data)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    sums = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(data):
        part = slice(at, min(at + step, len(data)))
        base = np.searchsorted(starts, part.start, "right") - 1  # the word that reaches into the part, or -1
        word = base + np.cumsum(first[part])
        word -= first[part.start] and base >= 0 and starts[base] == part.start
        ink = ~space[part]
        place = np.arange(part.start, part.stop)[ink] - starts[word[ink]]
        values = _mix((place.astype(np.uint64) << np.uint64(8)) | data[part][ink])
        heads = np.flatnonzero(np.diff(word[ink], prepend=-1))
        if len(heads):
            sums[word[ink][heads]] += np.add.reduceat(values, heads)
        at = part.stop
    return _mix(sums, _C), starts


@dataclass
class Symbols:
    """Symbols of a round from left to right; low and high bound their contexts, in words."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _runs(s: Symbols) -> Symbols:
    """Each longest run of a symbol becomes one; a run also depends on the symbols beside it."""
    heads = np.flatnonzero(np.concatenate([[True], s.name[1:] != s.name[:-1]]))
    size = np.diff(heads, append=len(s.name))
    name = s.name[heads]
    long = size > 1
    name[long] = _mix(name[long] + _mix(size[long].astype(np.uint64), _C))
    return Symbols(name, s.low[np.maximum(heads - 1, 0)], s.high[np.minimum(heads + size, len(s.name) - 1)])


def _pairs(s: Symbols, salt: int) -> Symbols:
    """Each symbol is a left or a right one by its name; a left one before a right one become a pair."""
    right = (_mix(s.name ^ _mix(np.uint64([salt]), _C)) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(right), bool)
    pair[:-1] = ~right[:-1] & right[1:]
    second = np.concatenate([[False], pair[:-1]])
    at = np.flatnonzero(~second)
    paired, alone_right = pair[at], right[at]
    after = np.minimum(at + 1, len(right) - 1)
    name = s.name[at]
    name[paired] = _mix(_mix(name[paired], _C) + s.name[after[paired]])
    return Symbols(name, s.low[np.where(alone_right, np.maximum(at - 1, 0), at)], s.high[np.where(alone_right, at, after)])


def parse(names: np.ndarray, rounds: int) -> list[Symbols]:
    """The symbols of each round, round 0 being the words themselves."""
    at = np.arange(len(names))
    out = [Symbols(names, at, at + 1)]
    for k in range(rounds):
        out.append(_pairs(_runs(out[-1]), k + 1))
    return out


class Stretches:
    """Fingerprints of stretches of a sequence of names, from one running sum."""

    def __init__(self, names: np.ndarray):
        with np.errstate(over="ignore"):
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(names), BACK)]))
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(names) - 1, 0), BASE)]))[: len(names)]
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(names * up)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))


def anchors(names: np.ndarray, bars: np.ndarray, how: Repeats) -> tuple[np.ndarray, ...]:
    """The windows of texts with bars (places that are no words) around them, by the anchor they take.

    For each stretch of windows with one anchor: its first window, the number of windows, the
    anchor's key (fingerprint of the words of its context), and where its context begins in the first window.
    Last the fingerprints of all windows, by place.
    """
    n, w = len(names) - how.window + 1, how.window
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    closed = np.concatenate([[0], np.cumsum(bars)])
    inside = closed[w:] == closed[:-w]
    stretches = Stretches(names)
    todo = np.flatnonzero(inside)
    taken_low = np.zeros(n, np.int64)
    taken_high = np.zeros(n, np.int64)
    for s in reversed(parse(names, how.rounds)):
        if not len(todo):
            break
        key = stretches.of(s.low, s.high)
        begun = np.cumsum(np.bincount(np.minimum(s.low, len(names)), minlength=len(names) + 1))  # symbols whose context begins up to a place
        ended = np.cumsum(np.bincount(s.high, minlength=len(names) + 1))
        first = np.where(todo > 0, begun[np.maximum(todo - 1, 0)], 0)
        last = ended[todo + w] - 1
        seen = last >= first
        rows, first, last = todo[seen], first[seen], last[seen]
        best, least = first.copy(), key[first]
        k = 1
        live = np.flatnonzero(last >= first + k)
        while len(live):
            other = key[first[live] + k]
            less = other < least[live]
            hit = live[less]
            best[hit], least[hit] = first[hit] + k, other[less]
            k += 1
            live = live[last[live] >= first[live] + k]
        taken_low[rows], taken_high[rows] = s.low[best], s.high[best]
        todo = todo[~seen]
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(taken_low[at]) != 0) | (np.diff(taken_high[at]) != 0)])) if len(at) else np.zeros(0, np.int64)
    begin = at[heads]
    count = np.diff(heads, append=len(at))
    place = np.arange(n)
    return begin, count, stretches.of(taken_low[begin], taken_high[begin]), taken_low[begin] - begin, stretches.of(place, place + w)


def _slices(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of texts, one after the other, and where each begins and the last ends."""
    raw = [t or b"" for t in text.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _occurrences(ids: pa.Array, texts: pa.Array, how: Repeats) -> dict[str, np.ndarray | pa.Array]:
    """What a slice of texts hands on: its anchors with their windows, and the stretches already found in it.

    Of one anchor with the same windows around it only the smallest id is handed on; the windows of
    the others are repeats whatever the other tasks hold. Rows without fps are such stretches, of n words.
    """
    data, offsets = _bytes(texts)
    names, starts = word_names(data, offsets[:-1])
    of = np.searchsorted(offsets, starts, "right") - 1
    place = np.arange(len(names)) + of + 1
    full = np.zeros(len(names) + len(texts) + 1, np.uint64)
    full[place] = names
    bars = np.ones(len(full), bool)
    bars[place] = False
    full[bars] = _mix(np.flatnonzero(bars).astype(np.uint64) + np.uint64(1 << 40))
    begin, count, key, first, windows = anchors(full, bars, how)
    doc = np.cumsum(bars)[begin] - 1 if len(begin) else begin
    head = np.flatnonzero(bars)[doc] + 1 if len(begin) else begin
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    around = Stretches(full).of(begin, begin + count + how.window - 1)
    same = _mix(_mix(key + around) + (first * 16 + count).astype(np.uint64))
    by = np.lexsort((order[doc], same))
    groups = np.concatenate([[True], same[by][1:] != same[by][:-1]]) if len(by) else np.zeros(0, bool)
    least = order[doc[by]][np.maximum.accumulate(np.where(groups, np.arange(len(by)), 0))]
    found = np.zeros(len(by), bool)
    found[by] = order[doc[by]] > least

    on = np.flatnonzero(found)
    joined = (doc[on][1:] == doc[on][:-1]) & (begin[on][1:] == begin[on][:-1] + count[on][:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~joined])) if len(on) else on
    ends = np.append(heads[1:], len(on)) - 1 if len(on) else on
    left, right = on[heads], on[ends]
    out = np.flatnonzero(~found)
    sizes = count[out]
    flat = np.repeat(begin[out] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    kept = np.ascontiguousarray(windows[flat].view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes() if len(flat) else b""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * KEPT
    blobs = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(kept)])
    rows = np.concatenate([out, left])
    return {
        "key": key[rows].view(np.int64), "doc": doc[rows], "at": (begin - head)[rows] * 16 + first[rows],
        "n": np.concatenate([np.zeros(len(out), np.int64), begin[right] + count[right] + how.window - 1 - begin[left]]),
        "fps": pa.concat_arrays([blobs, pa.nulls(len(left), pa.binary())]),
    }


def _compare(batches: Iterable[pa.RecordBatch], how: Repeats) -> Iterator[pa.RecordBatch]:
    """Stretches of repeats from occurrences sorted by key and id; one key's windows are held at a time.

    A window is a repeat if an earlier id of its key has it. Beyond ``held`` windows of a key, the
    ones seen and those still to come are handed on as rows of one window, to be sorted by window.
    """
    current, seen, covers, full = None, {}, {}, False

    for b in batches:
        keys = b.column(0).to_numpy()
        if not len(keys):
            continue
        stays = np.concatenate([[keys[0] == current], keys[1:] == keys[:-1]])
        goes_on = np.concatenate([stays[1:], [True]])
        rows = b.take(pa.array(np.flatnonzero(stays | goes_on | b.column(5).is_null().to_numpy(zero_copy_only=False))))
        out: list[tuple] = []
        for key, i, at, t, n, fps in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if fps is None:
                out.append((None, i, at, t, n, None))
                continue
            if key != current:
                current, seen, covers, full = key, {}, {}, False
            first = at & 15
            if full:
                out.extend(_singly(key, i, at, t, fps))
                continue
            if covers.setdefault((first, fps), i) != i:
                out.append((None, i, at & ~15, t, len(fps) // KEPT + how.window - 1, None))
                continue
            run = 0
            size = len(fps) // KEPT
            for k in range(size + 1):
                if k < size and seen.setdefault((first - k, fps[k * KEPT : k * KEPT + KEPT]), i) != i:
                    run += 1
                elif run:
                    out.append((None, i, (at & ~15) + 16 * (k - run), t, run + how.window - 1, None))
                    run = 0
            if len(seen) > how.held:
                full = True
                for (j, w), earlier in seen.items():
                    out.extend(_singly(key, earlier, j - 16, t, w))  # a place before the text: known already
                seen, covers = {}, {}
        current = int(keys[-1])
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, b.schema, strict=True)], names=b.schema.names)


def _singly(key: int, i, at: int, t: int, fps: bytes) -> list[tuple]:
    """An occurrence as rows of one window, keyed by anchor, place and window together."""
    size = len(fps) // KEPT
    first = at & 15
    parts = np.frombuffer(fps, np.uint8).reshape(size, KEPT)
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :KEPT] = parts
    mixed = _mix(_mix(wide.view(np.uint64)[:, 0] + np.uint64(key & (1 << 64) - 1)) + (first - np.arange(size)).astype(np.uint64), _C).view(np.int64).tolist()
    return [(mixed[k], i, (at >> 4) * 16 + 16 * k if at >= 0 else -16, t, 0, fps[k * KEPT : k * KEPT + KEPT]) for k in range(size)]


def text_key(docs: DataFrame, id: str, text: str) -> Column:
    """What tells apart the texts of one id: 0 where no id comes twice, so that it costs nothing to shuffle."""
    twice = docs.groupBy(F.col(f"`{id}`")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) if twice else F.lit(0).cast("long")


def repeated_stretches(docs: DataFrame, t: Column, id: str = "doc_id", text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """id, t, start, end: stretches of words that are covered by windows which a smaller id has too. They may overlap."""
    kind = docs.schema[id].dataType
    schema = f"key long, id {kind.simpleString()}, at long, t long, n long, fps binary"
    names = ["key", "id", "at", "t", "n", "fps"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, 2000):
            for lo, hi in _slices(b.column(2), 6 * how.words):
                part = b.slice(lo, hi - lo)
                got = _occurrences(part.column(0), part.column(2), how)
                doc = pa.array(got["doc"])
                yield pa.RecordBatch.from_arrays([pa.array(got["key"]), part.column(0).take(doc), pa.array(got["at"]), part.column(1).take(doc), pa.array(got["n"]), got["fps"]], names=names)

    def meet(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("key").sortWithinPartitions("key", F.col("id").asc_nulls_last())
        return materialize(ordered.mapInArrow(lambda batches: _compare(batches, how), schema), "stretches")

    found = meet(docs.select(F.col(f"`{id}`"), t.alias("t"), F.col(f"`{text}`")).mapInArrow(scan, schema))
    later = found.where(F.col("fps").isNotNull())
    if later.limit(1).count():
        found = found.where(F.col("fps").isNull()).unionByName(meet(later).where("at >= 0"))
    return found.select("id", "t", F.shiftright("at", 4).cast("int").alias("start"), (F.shiftright("at", 4) + F.col("n")).cast("int").alias("end"))


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a text with a smaller id.

    The text of each row becomes its kept words joined by one space; n_words, n_removed and removed
    (word spans, start and end, ascending) are added. Windows are judged on the input. Every row
    comes back: null texts have no words and become empty, as do texts of which nothing is left. Rows with equal ids
    do not remove each other's words; null ids come after all others. Repeated rows are treated alike, an empty table
    stays empty. Columns of docs named like the new ones are replaced, others pass through.
    """
    new = {"n_words", "n_removed", "removed"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    key = text_key(docs, id, text)
    marks = repeated_stretches(docs, key, id, text, how)
    i, t, spans = fresh(docs, "id"), fresh(docs, "t"), fresh(docs, "spans")
    marks = marks.groupBy(F.col("id").alias(i), F.col("t").alias(t)).agg(F.collect_list(F.struct("start", "end")).alias(spans))
    on = F.col(f"`{id}`").eqNullSafe(F.col(i)) & (key == F.col(t))
    kept = docs.columns
    at = [c.lower() for c in kept].index(text.lower())
    out = docs.join(marks, on, "left").select(*[F.col(f"`{c}`") for c in kept], F.col(spans))
    longs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            texts, totals, gone, removed = [], [], [], []
            for x, found in zip(b.column(at).to_pylist(), b.column(len(kept)).to_pylist(), strict=True):
                w = x.encode("utf-8", "surrogatepass").split() if x else []
                merged: list[dict] = []
                for s in sorted(found or [], key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(s)
                left, last = [], 0
                for s in merged:
                    left += w[last : s["start"]]
                    last = s["end"]
                left += w[last:]
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                totals.append(len(w))
                gone.append(len(w) - len(left))
                removed.append(merged)
            own = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, longs)], names=[*kept, "n_words", "n_removed", "removed"])

    return out.mapInArrow(apply, f"{types}, n_words long, n_removed long, removed array<struct<start:int,end:int>>")


def op11_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), win AS (
  SELECT doc_id, r, i, array_to_string(words[i : i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM doc)
), least AS (
  SELECT w, min(doc_id) AS first FROM win GROUP BY w
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM win JOIN least USING (w) WHERE first < coalesce(doc_id, 9223372036854775807)
), word AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM doc
), kept AS (
  SELECT w.r, count(g.i) AS n, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS rest FROM word w LEFT JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)
"""

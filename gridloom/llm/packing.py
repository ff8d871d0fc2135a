"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``limit`` tokens. Best-fit decreasing runs over the number of
pieces of each length, at most ``limit`` numbers, instead of over pieces: for each length, from
the longest down, the tightest open sequences are filled many at a time. The plan says which
sequence and offset the k-th piece of a length takes; pieces find their slot by joining on their
rank within their length.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import few_rows, held, materialize, rank_within, spread, table

LIMIT = 4096
END = 1

#: Words that are looked up together; those that are new are merged together.
AT_ONCE = 1 << 17

#: Pieces of words are merged in groups of up to so many bytes each; none is longer than the last.
WIDTHS = (4, 8, 12, 16, 24, 64)

#: No id, where a piece has ended.
PAD = 0xFFFF


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a word (UTF-8) as little-endian unsigned 32-bit numbers, computed on first use.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words one after the other. Printable Latin words are merged here by the tokenizer's own merge
    list, which costs far less than a call for each; all others go to the tokenizer. New words that come
    together are merged together, as arrays. A word is kept from the second time on, by a bit map of those seen,
    and two generations bound the memory.
    """

    def __init__(self, path: str, most: int):
        super().__init__()
        self.tokenizer, self.most, self.old, self.fresh = Tokenizer.from_file(path), most, {}, {}
        self.seen, self.marks = bytearray(1 << 23), 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner = [vocab[alphabet[b]] for b in range(256)]
        self.final = [vocab[alphabet[b] + spec["model"]["end_of_word_suffix"]] for b in range(256)]
        assert max(vocab.values()) < PAD
        # the same as arrays; pairs are found by hash, in the next free slot from there on
        self.arrays = [np.array(x, np.uint32) for x in (self.inner, self.final, self.merged)]
        slots, at_rank = [PAD << 16 | PAD] * (1 << 18), [len(pairs)] * (1 << 18)
        for i, (a, b) in enumerate(pairs):
            key = vocab[a] << 16 | vocab[b]
            at = (key * 2654435761 & 0xFFFFFFFF) >> 14
            while slots[at] != PAD << 16 | PAD:
                at = at + 1 & 0x3FFFF
            slots[at], at_rank[at] = key, i
        self.slots, self.at_rank = np.array(slots, np.uint32), np.array(at_rank, np.int32)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.fresh.get(word)
            if ids is None:
                parts = self.parts(word)
                got = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids if parts is None else [i for p in parts for i in self.merge(p)]
                ids = struct.pack(f"<{len(got)}I", *got)
            at = hash(word) & 0x7FFFFF
            if not self.seen[at]:
                self.seen[at] = 1
                self.marks += 1
                if self.marks > 1 << 21:
                    self.seen, self.marks = bytearray(1 << 23), 0
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def parts(self, word: bytes) -> list[bytes] | None:
        """Pieces of a word that are merged each for itself; None: a word for the tokenizer."""
        if len(word) < 64:
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and word[-1] in b".,;:!?":
                return [word[:-1].lower(), word[-1:]]
            text = word.decode("utf-8")
            if text.isprintable() and "<|" not in text and max(text) < "Ā":
                return [part.encode() for part in self.cut.findall(text.lower())]
        return None

    def all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; those that are not known are merged together."""
        found = [*map(self.get, words)]
        gaps = [*compress(range(len(words)), map(not_, found))]
        if gaps:
            new = set(map(words.__getitem__, gaps))
            cut = {w: p for w in new if w not in self.old and (p := self.parts(w))}
            pieces = list({p for parts in cut.values() for p in parts})
            of = dict(zip(pieces, self.merge_all(pieces), strict=True))
            self.fresh = {w: of[p[0]] if len(p) == 1 else b"".join(map(of.__getitem__, p)) for w, p in cut.items()}
            for i in gaps:
                found[i] = self[words[i]]
            self.fresh = {}
        return found

    def texts(self, texts: Iterable[str | None], end: int | None = END) -> Iterable[bytes]:
        """text_ids of each text; words of several texts, or of a stretch of a long one, are looked up together."""
        held: list[list[bytes]] = []
        n = 0
        for t in texts:
            held.append(t.encode().split() if t else [])
            n += len(held[-1])
            if n >= AT_ONCE:
                yield from self._joined(held, end)
                held, n = [], 0
        yield from self._joined(held, end)

    def _joined(self, held: list[list[bytes]], end: int | None) -> Iterable[bytes]:
        tail = struct.pack("<I", end) if end is not None else b""
        ids = self.all([*chain.from_iterable(w for w in held if len(w) < AT_ONCE)])
        at = 0
        for words in held:
            if len(words) < AT_ONCE:
                yield b"".join(ids[at : at + len(words)]) + tail
                at += len(words)
            else:
                yield b"".join([b"".join(self.all(words[i : i + AT_ONCE])) for i in range(0, len(words), AT_ONCE)]) + tail

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids in the merge list, its length where they are not in it."""
        key = a << 16 | b
        at = key * np.uint32(2654435761) >> 14
        found = self.slots[at]
        out = np.where(found == key, self.at_rank[at], np.int32(len(self.merged)))
        on = np.nonzero((found != key) & (found != (PAD << 16 | PAD)))
        while len(on[0]):
            at[on] = at[on] + 1 & 0x3FFFF
            found, k = self.slots[at[on]], key[on]
            out[on] = np.where(found == k, self.at_rank[at[on]], out[on])
            on = tuple(x[(found != k) & (found != (PAD << 16 | PAD))] for x in on)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: merge for all of them, a merge of each piece a step, by groups of like length."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(group):
                ids = self._merge_group([pieces[i] for i in group.tolist()], sizes[group], width)
                there = ids != PAD
                flat, ends = ids[there].astype("<u4").tobytes(), (4 * np.cumsum(there.sum(1))).tolist()
                for i, x, y in zip(group.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[x:y]
        return out

    def _merge_group(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        inner, final, merged = self.arrays
        none, cols, rows = len(merged), np.arange(width), np.arange(len(pieces))
        raw = np.array(pieces, f"S{width}").view(np.uint8).reshape(-1, width)
        ids = inner[raw]
        ids[rows, sizes - 1] = final[raw[rows, sizes - 1]]
        ids[cols >= sizes[:, None]] = PAD
        out, live = np.full_like(ids, PAD), rows
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            go = best < none
            if not go.all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
            n, w = ids.shape
            rows = np.arange(n)
            ids[rows, at] = merged[best]
            ids = ids[cols[:w] != at[:, None] + 1].reshape(n, w - 1)
            rank = rank[cols[: w - 1] != at[:, None]].reshape(n, w - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            rank[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        out[live, : ids.shape[1]] = ids
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece of a word: the pair of lowest rank is merged, the first of equals, while there is one."""
        rank, merged, none = self.ranks.get, self.merged, len(self.merged)
        ids = [*map(self.inner.__getitem__, raw)]
        ids[-1] = self.final[raw[-1]]
        near = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while near and (best := min(near)) < none:
            i = near.index(best)
            ids[i] = merged[best]
            del ids[i + 1], near[i]
            if i < len(near):
                near[i] = rank(ids[i] << 20 | ids[i + 1], none)
            if i:
                near[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
        return ids


#: Words whose ids a worker remembers, twice over.
REMEMBERED = 350_000


@cache
def word_ids(path: str, most: int = REMEMBERED) -> WordIds:
    return WordIds(path, most)


held.append(word_ids)


def text_ids(text: str | None, known: WordIds, end: int | None = END) -> bytes:
    body = b"".join(map(known.__getitem__, text.encode().split())) if text else b""
    return body + (struct.pack("<I", end) if end is not None else b"")


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece of each row.

    Null and empty texts are one piece with the end token alone. remembered: words whose ids a worker
    keeps, some 400 bytes each; fewer cost time and change nothing else.
    """
    kind = docs.schema[id_col].dataType
    path = tokenizer or default_tokenizer()
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches: Iterable[pa.RecordBatch]):
        known = word_ids(path, remembered)
        for b in few_rows(batches, keep=word_ids):
            rows: list[list] = [[] for _ in names]
            for i, raw in zip(b.column(0).to_pylist(), known.texts(b.column(1).to_pylist()), strict=True):
                for k in range(0, len(raw), 4 * limit):
                    part = raw[k : k + 4 * limit]
                    for to, v in zip(rows, (i, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part), struct.unpack(f"<{len(part) // 4}I", part) if ids else None), strict=False):
                        to.append(v)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(r, type=t) for r, t in zip(rows, types, strict=False)], names=names)

    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(id_col, text).mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, first sequence, pieces a sequence, offset).

    The pieces of a length with ranks from first rank up to the next record's fill sequences one
    after the other, with so many pieces each. The number of records depends on limit, not on the
    number of pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # sequences by room left: (first, how many)
    rooms: list[int] = []
    made = 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            if r not in room:
                insort(rooms, r)
                room[r] = []
            room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            else:
                r, first = limit, made
                n = -(-left // (limit // length))
                made += n
            per = r // length
            whole = min(n, left // per)
            if whole:
                out.append((length, rank, first, per, limit - r))
                put(r - per * length, first, whole)
                left, rank, first, n = left - whole * per, rank + whole * per, first + whole, n - whole
            if n and 0 < left < per:
                out.append((length, rank, first, per, limit - r))
                put(r - left * length, first, 1)
                left, rank, first, n = 0, rank + left, first + 1, n - 1
            put(r, first, n)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all rows of docs with their sequence_id and offset.

    Each row gives its pieces: repeated rows are packed as often as they stand; columns other than
    id and text are left out. An empty table gives no rows. The driver sees the histogram of
    lengths, at most ``limit`` rows.
    """
    pieces = materialize(cut_pieces(docs, id_col, text, tokenizer, limit, ids, remembered), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list] = {}
    for length, *rest in plan_slots(counts, limit):
        slots.setdefault(length, []).append(rest)
    spark = docs.sparkSession
    plan = materialize(spark.createDataFrame(list(slots.items()) or [], "length long, __slots array<struct<rank: long, first: long, per: long, offset: long>>"), "slots")
    ranked = rank_within(pieces, ["length"], [id_col, "piece"], "__rank", plan=plan)
    slot = F.element_at(F.filter("__slots", lambda s: s.rank <= F.col("__rank")), -1)
    out = ranked.withColumn("__slot", slot).withColumn("__k", F.col("__rank") - F.col("__slot.rank"))
    per = F.col("__slot.per")
    return out.withColumns({
        "sequence_id": F.col("__slot.first") + F.expr("`__k` div `__slot`.`per`"), "offset": F.col("__slot.offset") + (F.col("__k") % per) * F.col("length"),
    }).drop("__slots", "__rank", "__slot", "__k")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each packed sequence, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))


def op6_histogram_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

"""Compression bands: a quality rule from the ratio of compressed to plain bytes.

Very repetitive text compresses far better than prose and random text far worse. What is usual
depends on the length, since short texts carry the fixed cost of the format, and on the corpus, so the
band of each length is fitted to the ratios of all the texts themselves. Fixed chunks
are held against a band as well, so that a long text whose half is junk doesn't hide behind its average.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import percentiles
from ._common import add_from_column, fresh, materialize, spread, table, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the rule.

    bands: (least bytes, lowest ratio, highest ratio) for whole texts, by rising length; shorter
    texts than the first pass. fitted: (lowest, highest ratio) of octaves of length, which come
    before bands; between the middles of two octaves the limits change in a line over the logarithm of the
    length. chunk: bytes of a chunk; chunk_low, chunk_high: its band; a text longer than a chunk
    fails if more than chunk_share of its chunks are outside.
    """

    bands: tuple[tuple[int, float, float], ...] = ((64, 0.35, 1.60), (128, 0.30, 1.25), (256, 0.30, 1.02), (512, 0.28, 0.85), (1024, 0.26, 0.76), (4096, 0.24, 0.70), (32768, 0.20, 0.66), (1 << 20, 0.16, 0.66))
    fitted: tuple[tuple[int, float, float], ...] = ()
    chunk: int = 1024
    chunk_low: float = 0.26
    chunk_high: float = 0.76
    chunk_share: float = 0.1
    level: int = 3

    def limits(self, n: int) -> tuple[float, float]:
        """Lowest and highest ratio of a text of n bytes."""
        octave = n.bit_length() - 1
        known = {o: (low, high) for o, low, high in self.fitted}
        if octave not in known:
            at = bisect_right([b[0] for b in self.bands], n) - 1
            return self.bands[at][1:] if at >= 0 else (0.0, float("inf"))
        past = math.log2(n) - octave - 0.5  # from the middle of the octave
        (a, b), (c, d) = known[octave], known.get(octave + (1 if past > 0 else -1), known[octave])
        return a + (c - a) * abs(past), b + (d - b) * abs(past)


@dataclass(frozen=True)
class Fit:
    """least: fewest texts of an octave that gets a band of its own; below, above: how many interquartile
    ranges under the first and over the third quartile a ratio may be; sort_rows: ratios of an octave that
    one task may sort, quartiles of more are found by narrowing ranks."""

    least: int = 50
    below: float = 3.0
    above: float = 6.0
    sort_rows: int = 100_000


def _ratio(raw: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(packer.compress(raw)) / len(raw)


def _chunks(raw: bytes, size: int) -> list[bytes]:
    """Chunks of a text; the last may overlap the one before it, and a text shorter than a chunk has none."""
    n = -(-len(raw) // size) if len(raw) >= size else 0
    return [raw[min(i * size, len(raw) - size) :][:size] for i in range(n)]


def ratios(text: str | None, chunk: int, packer: zstandard.ZstdCompressor) -> tuple[int, float | None, list[float]]:
    """Bytes of a text, ratio of the whole (null if it has no bytes) and of each chunk."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), _ratio(raw, packer) if raw else None, [_ratio(c, packer) for c in _chunks(raw, chunk)]


def judge(n: int, ratio: float | None, chunks: list[float], bands: Bands) -> tuple[int, bool]:
    """Chunks outside their band, and the verdict on a text of n bytes."""
    if ratio is None:
        return 0, True
    low, high = bands.limits(n)
    odd = sum(not bands.chunk_low <= c <= bands.chunk_high for c in chunks)
    return odd, low <= ratio <= high and odd <= bands.chunk_share * len(chunks)


def compression(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text (null if it has no bytes), chunks, chunks outside their band, verdict."""
    n, ratio, chunks = ratios(text, bands.chunk, packer)
    return ratio, len(chunks), *judge(n, ratio, chunks, bands)


def fit_bands(measured: DataFrame, copy: str, size: str, chunks: str, fit: Fit = Fit(), bands: Bands = Bands()) -> Bands:
    """Bands of each octave of length, and of chunks, from the exact quartiles of the ratios of all texts.

    measured: rows with base_failed and ratio, and, in the columns named, a hash of the text, its bytes and
    the ratios of its chunks. Texts that fail the base rule don't count, and copies count once. Octaves
    with too few texts keep the bands given.
    """
    texts = measured.where(~F.col("base_failed")).select(copy, size, "ratio", chunks).dropDuplicates([copy, size])
    octave = F.length(F.bin(size)) - 1
    of_text, of_chunks = F.array(F.struct(octave.alias("octave"), F.col("ratio").alias("value"))), F.transform(chunks, lambda c: F.struct(F.lit(-1).alias("octave"), c.alias("value")))
    values = texts.select(F.inline(F.concat(of_text, of_chunks)))
    quartiles = percentiles(values, ["octave"], [0.25, 0.75], fit.sort_rows)
    got = {r.octave: (r.value[0] - fit.below * (r.value[1] - r.value[0]), r.value[1] + fit.above * (r.value[1] - r.value[0])) for r in quartiles.where(F.col("count") >= fit.least).collect()}  # a row an octave
    low, high = got.pop(-1, (bands.chunk_low, bands.chunk_high))
    return Bands(bands.bands, tuple((o, *got[o]) for o in sorted(got)), bands.chunk, low, high, bands.chunk_share, bands.level)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = words(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
    return len(w), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(w)


def repeated_words(w: list[bytes], size: int = 5) -> int:
    """Words in windows of so many words that are found twice or more; a window is told by the numbers of its words."""
    n = len(w) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
    now = ids
    for _ in range(size - 1):  # number pairs of a window and its next word, so that no number grows
        now = np.unique(now[:-1] * len(number) + ids[len(ids) - len(now) + 1 :], return_inverse=True)[1]
    twice = np.bincount(now)[now] > 1
    cover = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_odd_chunks", T.LongType()),
]

#: Fields that need the bands.
LATER = ("kept", "n_chunks", "n_odd_chunks")


def compression_bands(docs: DataFrame, text: str = "text", bands: Bands | None = None, drop: tuple[str, ...] = (), fit: Fit = Fit()) -> DataFrame:
    """Add counts, the base rule's and the bands' verdict to each row; bands: fitted to docs if not given.

    Each text is counted and compressed once, whatever its length. To fit, these measures are written down with
    the columns that pass through, and the texts are judged by them; with bands given there is one
    pass without shuffle. Null and empty texts have no words: base_failed, not kept, null ratio. Repeated rows are
    judged one by one, and as one text in the fit. Columns of docs with the names of the new ones are
    replaced; other columns but those in drop pass through. An empty table gives no rows.
    """
    copy, size, chunks, own = (fresh(docs, x) for x in ("copy", "bytes", "chunks", "measures"))
    chunk, level = (bands or Bands()).chunk, (bands or Bands()).level
    at_once, later = [f for f in FIELDS if f.name not in LATER], [f for f in FIELDS if f.name in LATER]
    extra = [T.StructField(size, T.LongType()), T.StructField(chunks, T.ArrayType(T.DoubleType()))]

    def make():
        packer = zstandard.ZstdCompressor(level=level)

        def measure(texts: list) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in (*at_once, *extra)}
            for t in texts:
                counts = base_counts(t)
                n, ratio, parts = ratios(t, chunk, packer)
                for k, v in zip(out, (*counts, base_failed(counts), ratio, n, parts), strict=True):
                    out[k].append(v)
            return out

        return measure

    measured = add_from_column(docs.withColumn(copy, F.xxhash64(F.col(f"`{text}`"))), text, [*at_once, *extra], make, (*LATER, *drop))
    if bands is None:
        measured = materialize(measured, "measures")
        bands = fit_bands(measured, copy, size, chunks, fit)

    def judging():
        def run(rows: list) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in later}
            for failed, n, ratio, parts in ((r["base_failed"], r[size], r["ratio"], r[chunks]) for r in rows):
                odd, good = judge(n, ratio, parts, bands)
                for k, v in zip(out, (good and not failed, len(parts), odd), strict=True):
                    out[k].append(v)
            return out

        return run

    done = add_from_column(measured.withColumn(own, F.struct("base_failed", size, "ratio", chunks)), own, later, judging, (own, copy, size, chunks))
    new = {f.name for f in FIELDS}
    return done.select(*[f"`{c}`" for c in done.columns if c not in new], *[f.name for f in FIELDS])


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), drop=("text",))

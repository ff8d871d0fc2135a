"""The pipeline's stages against plain Python, and mixing against a plain solver."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _common, mixing, packing, toxicity

from test_corpus import plain_components
from test_text_rules import plain_scores


def corpus() -> tuple[list, list]:
    r = random.Random(21)
    clean = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs = []
    for i in range(150):
        toxic = i % 6 == 0
        lines = [" ".join(r.choice(["idiot", "scum", "moron"] if toxic and r.random() < 0.25 else clean) for _ in range(r.randint(6, 14))) for _ in range(r.randint(2, 5))]
        if i % 3 == 1 and i % 2:
            lines.insert(1, "home about contact")
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 10 else None, 1))
    docs += [(200 + i, docs[7 + i][1], "de", "s0", 1) for i in range(4)]
    near = docs[20][1].split(" ")
    near[3] = "changed"
    docs += [(300, " ".join(near), "en", "s1", 1), (301, None, None, None, None), (302, "", "en", "s1", 0), (303, "one two", "en", "s2", 7), docs[9], docs[9], (304, "\n\n", "en", "s2", 2)]
    return docs, [(i, int(i % 6 == 0)) for i in range(150)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = corpus()
    sf = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, docs, labels


def plain_drop_lines(docs: list, ratio: float, least: int) -> list:
    pages, of = defaultdict(Counter), Counter()
    for _, text, _, source, _ in docs:
        of[source] += 1
        pages[source].update({x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""})
    bad = {(s, x) for s, c in pages.items() for x, n in c.items() if n >= least and n > ratio * of[s]}
    out = []
    for i, text, lang, source, _ in docs:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if (source, x.strip(" \t\n\x0b\x0c\r")) not in bad)
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_stages_equal_plain_python(spark, tables):
    import corpus_pipeline

    sf, docs, labels = tables
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    by_text = plain_scores([(i, t) for i, t, *_ in docs], learned, toxicity.Votes())
    kept = [d for d in docs if by_text[d[0]] < 0.5]
    assert 15 <= len(docs) - len(kept) <= 40
    assert rows_of(stages["toxicity"](spark, frame(docs), sf)) == Counter(kept)

    lines = plain_drop_lines(kept, 0.05, 3)
    assert Counter(lines) != Counter(kept)
    assert rows_of(stages["line_dedup"](spark, frame(kept), sf)) == Counter(lines)

    groups = plain_components({d[0]: d[1] for d in lines}, 5, 80)
    first = {d[0]: d for d in lines if groups[d[0]][1] == d[0]}
    assert len(first) < len({d[0] for d in lines})
    assert rows_of(stages["ngram_join"](spark, frame(lines), sf)) == Counter(first.values())

    once = list(first.values())
    mixed = rows_of(stages["mix"](spark, frame(once), sf))
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in once}
    assert set(mixed) <= set(once) and max(mixed.values()) <= 2
    totals = Counter()
    for d, n in sizes.items():
        totals[d[3]] += n
    goal = mixing.targets({s or "": totals[s] for s in sorted(totals, key=lambda s: (s is None, s or ""))})
    for s in totals:
        took = sum(n * sizes[d] for d, n in mixed.items() if d[3] == s)
        assert abs(took - goal[s or ""]) <= max(sizes.values())

    many = list(mixed.elements())
    packed = stages["pack"](spark, frame(many), sf).collect()
    ids = packing.word_ids(packing.default_tokenizer())
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((d[0], len(packing.text_ids(d[1], ids)) // 4) for d in many)
    assert len({r.sequence_id for r in packed}) == math.ceil(sum(r.length for r in packed) / packing.LIMIT)


def test_run_and_empty_tables(spark, tables):
    import corpus_pipeline

    sf, docs, _ = tables
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and set(out.select("doc_id").distinct().toPandas()["doc_id"]) <= {d[0] for d in docs}
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf)
        assert got.count() == 0 and (name == "pack" or got.columns == none.columns)


def test_stages_hold_few_texts(spark, tables, monkeypatch):
    import corpus_pipeline

    sf, docs, _ = tables
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    try:
        spark.conf.set(key, "10000")
        frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        monkeypatch.setattr(mixing, "add_from_column", None)  # sizes are counted without Python
        for stage in dict(corpus_pipeline.STAGES).values():
            spark.conf.set(key, "10000")
            stage(spark, frame, sf)
            assert max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()) <= 1000
        spark.conf.set(key, "7")
        _common.small_batches(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_a_grown_heap_of_the_driver_is_collected(spark, monkeypatch):
    """At each intermediate table, so that a long run's heap does not grow to its limit by garbage."""
    done = []

    class Jvm:
        """A driver whose heap has grown to so many of 750 MB."""

        def __init__(self, mb: int):
            heap = SimpleNamespace(totalMemory=lambda: mb << 20, maxMemory=lambda: 750 << 20)
            self.java = SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: done.append(mb))))

    for mb in (200, 370, 380, 750):
        _common.tidy(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=Jvm(mb))))
    assert done == [380, 750]
    monkeypatch.setattr(_common, "HEAP_SHARE", 0.0)
    monkeypatch.setattr(spark.sparkContext, "_jvm", tap := Tap(spark.sparkContext._jvm))
    assert _common.materialize(spark.range(10), "ten").count() == 10 and tap.collected == 1


class Tap:
    """The JVM, with its explicit collections counted."""

    def __init__(self, jvm):
        self._real, self.collected = jvm, 0
        lang = SimpleNamespace(Runtime=jvm.java.lang.Runtime, System=SimpleNamespace(gc=self.collect))
        self.java = SimpleNamespace(lang=lang)

    def collect(self):
        self.collected += 1
        self._real.java.lang.System.gc()

    def __getattr__(self, name):
        return getattr(self._real, name)


def test_workers_drop_what_others_held():
    known = packing.word_ids(packing.default_tokenizer())
    assert not list(_common.few_rows([], keep=packing.word_ids)) and packing.word_ids(packing.default_tokenizer()) is known
    assert not list(_common.few_rows([])) and packing.word_ids.cache_info().currsize == 0


def test_native_sizes_equal_words(spark):
    texts = [None, "", " ", "a", "\u00a0a b", "\x0ba\x0c\x1cb\x85c", "  x\n\n y\t", "\u2003a \ufeff b\x00c", " \n", "one " * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", _common.word_count(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(_common.words(t)) for i, t in enumerate(texts)}


def test_rates_equal_bisection(spark):
    r = random.Random(5)
    cells = [(s, size, r.randint(1, 9)) for s in "abcd" for size in r.sample(range(1, 400), 30)]
    totals = {s: sum(z * n for x, z, n in cells if x == s) for s in "abcd"}
    goal = {"a": 0.3 * totals["a"], "b": 1.2 * totals["b"], "c": 1.97 * totals["c"], "d": 2.0 * totals["d"]}
    df = _common.materialize(spark.createDataFrame(cells, "key string, size long, n long"), "cells")
    lam = mixing.solve_rates(df, goal, totals)
    have = lambda s, x: sum(z * n * min(math.exp(x * z), 2) for k, z, n in cells if k == s)
    for s in "abc":
        low, high = -5.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if have(s, mid) < goal[s] else (low, mid)
        assert lam[s] == pytest.approx(low, rel=1e-5, abs=1e-9) and have(s, lam[s]) == pytest.approx(goal[s], rel=1e-6)
    assert lam["d"] == math.inf

"""Substring dedup by recompression, the Merkle manifest and whitening, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, mixing, neighbours, ngram_join, pii, recompression, toxicity, whitening
from gridloom.llm.recompression import Repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


# -- recompression --------------------------------------------------------------------------------


def plain_removal(docs, window=13):
    """(id, kept text, words, removed) of each row; null ids come last."""
    rank = lambda i: (i is None, i if i is not None else 0)
    first = {}
    words = [WORD.findall(t or "") for _, t in docs]
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, rank(i)), rank(i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone |= set(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def found(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect()), key=repr)


def stitched(seed: int, n: int):
    """Texts that share passages, with runs and with words of few kinds, so that windows repeat at every offset."""
    r = random.Random(seed)
    few = ["a", "b", "ab", "é", "x" * 40]
    passages = [[r.choice(few if r.random() < 0.4 else [f"w{r.randrange(400)}" for _ in range(9)]) for _ in range(r.choice((5, 12, 13, 14, 20, 60)))] for _ in range(12)]
    passages += [["run"] * 40, ["run"] * 13, ["p", "q"] * 15]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(passages) if r.random() < 0.6 else [f"u{r.randrange(10**6)}" for _ in range(r.randrange(20))]
        out.append((i * 3 % 97, r.choice((" ", "\n", "\t  ")).join(w)))
    return out


@pytest.mark.parametrize("how", [Repeats(), Repeats(rounds=3), Repeats(rounds=0, words=40), Repeats(window=5, held=3, words=40)])
def test_repeats_equal_brute_force(spark, how):
    docs = [*stitched(how.rounds, 150), (None, None), (500, ""), (501, " \n"), (None, "run " * 30), (None, "a b c d e f g h i j k l m n"), (7, "a b c d e f g h i j k l m n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = sorted(plain_removal(docs, how.window), key=repr)
    assert found(recompression.drop_repeats(df, how=how)) == want
    assert sum(w[3] for w in want) > 200


def test_repeats_of_odd_rows(odd, void):
    got = recompression.drop_repeats(odd)
    assert set(got.columns) == {*odd.columns, "n_removed"}  # n_words and removed stand there already and are replaced
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(got) == sorted(plain_removal(docs), key=repr)
    assert recompression.drop_repeats(void).count() == 0


def test_repeats_with_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("b", text), ("a", text), ("c", "x " + text)], "name string, body string")
    got = {r.name: r.n_removed for r in recompression.drop_repeats(df, "name", "body").collect()}
    assert got == {"a": 0, "b": 20, "c": 20}


def test_names_do_not_depend_on_the_place(spark):
    r = random.Random(3)
    core = [f"w{r.randrange(50)}" for _ in range(40)]
    def keys(words):
        data = " ".join(words).encode()
        names, _ = recompression.word_names(np.frombuffer(data, np.uint8), np.zeros(1, np.int64))
        full = np.concatenate([[np.uint64(1)], names, [np.uint64(2)]])
        bars = np.zeros(len(full), bool)
        bars[[0, -1]] = True
        begin, count, key, first, _ = recompression.anchors(full, bars, Repeats())
        return [(int(b) - 1 + j, int(k), int(f) - j) for b, c, k, f in zip(begin, count, key, first) for j in range(c)]
    alone = keys(core)
    inside = keys(["z", "w1"] + core + ["w2", "y", "y"])
    assert {(p + 2, k, f) for p, k, f in alone} <= set(inside)


# -- Merkle manifest ------------------------------------------------------------------------------


def leaf(row, text=None):
    vals = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = plain_tree([leaf(r) for r in by[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = plain_proof(trees[s], i) + plain_proof(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            h = leaf(r, None if r["text"] is None else "".join(c.lower() if c.isascii() else c for c in r["text"])) if hit else leaf(r)
            for before, after in path:
                h = sha("".join(before) + h + "".join(after))
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in path)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_plain_python(spark, tmp_path):
    r = random.Random(1)
    rows = [{"doc_id": i, "text": r.choice([None, "", f"Text {i} É", "same", "UP é" * 50]), "lang": r.choice([None, "en"]), "source": s, "n_chars": r.choice([None, i])}
            for i, s in enumerate([None] * 3 + ["hot"] * 600 + ["z"] + ["é"] * 17 + [""] * 16 + [f"s{k}" for k in range(40)] * 2)]
    rows += [dict(rows[5]), dict(rows[5]), {**rows[5], "text": "other"}, {**rows[5], "doc_id": None}, {**rows[5], "doc_id": -12}]
    r.shuffle(rows)
    spark.createDataFrame([tuple(x.values()) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted([tuple(x) for x in got], key=repr) == plain_manifest(rows)
    assert {x.verified for x in got} == {True, False}


def test_manifest_of_odd_rows(odd, void):
    made = merkle.manifest(odd)
    got = made.proofs().select("id", "hash", "root", merkle.fold(F.col("path"), F.col("hash")).alias("back")).collect()
    assert len(got) == odd.count() and all(x.back == x.root for x in got) and len({x.root for x in got}) == 1
    assert merkle.manifest(void).proofs().count() == 0


# -- whitening ------------------------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.asarray(vectors, float)).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, q = np.linalg.eigh(np.cov(u.T.astype(float), bias=True))
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ q / np.sqrt(values), values / np.trace(np.cov(u.T.astype(float), bias=True))


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 7)) * [5, 4, 3, 2, 1, 1, 1] + 3
    vectors = [*base.tolist(), *[base[0].tolist()] * 150]  # a third of the rows are one vector
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None, *[0.0] * 5]), (902, [float("nan")] * 7), (903, [float("inf")] * 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_tsqr_whitening(spark, str(tmp_path)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, z, share = plain_whitening(vectors)
    assert len(got) == 4 * len(vectors) and set(got["n"]) == {n}
    assert got["deviation"].to_numpy().reshape(-1, 4)[:, 0].tolist() == deviation.tolist()
    mine = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:4], share, rtol=1e-9) and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_whitening_corner_cases(spark):
    rows = [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, [2.0, 4.0], "x"), (4, [4.0, 8.0], "y"), (5, [], "y"), (6, [1.0], "y"), (7, [0.5, 1.0, 2.0], "z"), (8, [1e300, 1.0, 2.0], "z"), (9, [-1e300, 3.0, 2.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = {r.vec_id: r for r in whitening.whiten(df).collect()}
    assert len(got) == 9 and [got[i].n for i in (1, 2, 3, 4, 5, 6)] == [3, 3, 3, 3, 1, 1]
    assert len(got[1].whitened) == 1 and got[1].whitened == got[2].whitened and got[1].explained == [1.0]  # the second dimension is twice the first
    assert got[5].whitened == [] and got[6].whitened == [] and got[6].deviation == 0 and got[8].deviation is None
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 5")).count() == 1


def test_merged_factors_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))], "vec_id long, embedding array<double>")
    whole, parts = (whitening.whiten(df.repartition(p)).orderBy("vec_id").toPandas() for p in (1, 60))
    assert np.allclose(np.stack(whole["whitened"]), np.stack(parts["whitened"]), atol=1e-10)


# -- ids that are no numbers, and clashing names, in the general forms of other operators ---------


def test_string_ids(spark):
    r = random.Random(5)
    words = [[f"w{r.randrange(300)}" for _ in range(60)] for _ in range(6)]
    docs = spark.createDataFrame([(f"d{i}", " ".join(w)) for i, w in enumerate([*words, words[2], words[2][:-1] + ["end"]])], "doc_id string, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(docs).collect()}
    assert got["d6"] == got["d7"] == got["d2"] == "d2" and got["d1"] == "d1"
    labels = spark.createDataFrame([("d0", 1), ("d1", 0), ("d2", 0)], "doc_id string, toxic int")
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == 8 and all(e.id in ("d0", "d1", "d2") for x in scored for e in x.evidence)
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(rng.normal(size=(30, 4)))], "vec_id string, embedding array<double>")
    near = neighbours.nearest(vectors, lambda i: i == "v3", k=3).collect()
    assert [x.rank for x in sorted(near, key=lambda x: x.rank)] == [1, 2, 3] and all(x.query_id == "v3" != x.vec_id for x in near)


def test_clashing_names(odd):
    assert pii.personal_data(odd).count() == odd.count()
    mixed = mixing.mix_sources(odd)
    assert mixed.count() == odd.count() and {"extra", "__n", "__copies"} <= set(mixed.columns)

"""Mixing, packing, joins, neighbours, URLs, chats and the pipeline."""

import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import _common, chat, graph, mixing, neighbours, ngram_join, packing, urls
from gridloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rank_within_hot_groups(spark):
    df = _common.materialize(spark.range(3000).selectExpr("id", "case when id < 2000 then 'hot' else concat('k', id % 50) end as k"), "t")
    got = _common.rank_within(df, ["k"], ["id"], "r", per_task=100).collect()
    by = defaultdict(list)
    for x in got:
        by[x.k].append(x.r)
    assert len(got) == 3000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_without_broadcasts(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(odd).select("doc_id", "taken").collect()))
    seqs = packing.pack(odd).agg({"sequence_id": "max"}).first()[0]
    groups = sorted(map(str, ngram_join.jaccard_components(odd).collect()))
    for module in (_common, ngram_join):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix_sources(odd).select("doc_id", "taken").collect())) == want
    assert packing.pack(odd).agg({"sequence_id": "max"}).first()[0] == seqs
    assert sorted(map(str, ngram_join.jaccard_components(odd).collect())) == groups


def test_targets():
    totals = {"a": 10, "b": 100, "c": 100, "d": 1000, "": 0}
    got = mixing.targets(totals)
    assert got["a"] == 20 and got[""] == 0 and abs(sum(got.values()) - 1.5 * 1210) < 1e-6 and all(got[s] <= 2 * totals[s] + 1e-9 for s in totals)


def test_mixing(odd, void):
    first = mixing.mix_sources(odd).select("doc_id", "source", "size", "source_size", "target", "taken")
    a, b = sorted(map(str, first.collect())), sorted(map(str, mixing.mix_sources(odd.repartition(5)).select(*first.columns).collect()))
    assert a == b and len(a) == odd.count()
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in first.collect():
        assert r.taken <= 2 * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
        taken[r.source] += r.taken
        goal[r.source] = r.target
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(60, largest[s] / 2)
    assert mixing.mix_sources(void).count() == 0
    assert mixing.repeat_copies(mixing.mix_sources(odd)).count() > 0


def test_plan_slots():
    r = random.Random(4)
    for _ in range(30):
        limit = r.choice([10, 50, 64])
        counts = {k: r.randint(1, 40) for k in r.sample(range(1, limit + 1), r.randint(1, 8))}
        pieces = {}
        for length, rank, first, per, offset in sorted(packing.plan_slots(counts, limit)):
            pieces.setdefault(length, []).append((rank, first, per, offset))
        used = defaultdict(set)
        for length, n in counts.items():
            for k in range(n):
                rank, first, per, offset = [p for p in pieces[length] if p[0] <= k][-1]
                at = offset + (k - rank) % per * length
                new = set(range(at, at + length))
                seq = first + (k - rank) // per
                assert not used[seq] & new and at + length <= limit
                used[seq] |= new
        assert all(v == set(range(len(v))) for v in used.values())


def test_word_ids():
    ids = packing.word_ids(packing.default_tokenizer())
    r, al = random.Random(1), "aAbΣσςİıßéе́ͅ \t\n\r\x0b\x0c\x1c\x85\xa0'sStT<|endoftext|>.,1२三🙂\u00001µªº½²×÷\xad"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|> b", "I'LL don't", "Thequickbrown, fox."]
    for t, e in zip(texts, ids.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packing.text_ids(t, ids, None), "<u4").tolist() == e.ids


def test_new_words_are_merged_together(monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("eeetaoinshrdluéèÀß.,'1-") for _ in range(r.randint(1, 70)))
    texts = [" ".join(word() for _ in range(r.randint(0, 80))) for _ in range(200)] + [None, "", "a", "the " * 500, " ".join(word() for _ in range(3000)), "Жук 🙂 <|endoftext|> \x00a"]
    own, small = packing.WordIds(packing.default_tokenizer(), 100_000), packing.WordIds(packing.default_tokenizer(), 500)
    want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    want = [[*w, packing.END] for w in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in small.texts(texts)] == want and len(small) <= 500
    one_by_one = []
    monkeypatch.setattr(packing.WordIds, "merge", lambda self, raw: one_by_one.append(raw))
    for at_once in (1 << 17, 100, 1):  # 1: every text is a long one
        monkeypatch.setattr(packing, "AT_ONCE", at_once)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.texts(texts)] == want
    assert not one_by_one and not own.fresh


def test_packing_round_trip(odd, void):
    packed = packing.pack(odd, ids=True)
    rows, n = packed.collect(), odd.count()
    tok = packing.word_ids(packing.default_tokenizer()).tokenizer
    by_seq = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) <= 4096
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len([r for r in rows if r.piece == 0]) == n and len(by_seq) == -(-sum(r.length for r in rows) // 4096)
    long = [r for r in odd.collect() if r.doc_id == 300][0].text
    whole = [i for r in sorted((r for r in rows if r.doc_id == 300), key=lambda r: r.start) for i in r.ids]
    assert whole == [*tok.encode(long, add_special_tokens=False).ids, 1]
    assert packing.sequences(packed).count() == len(by_seq) and packing.pack(void).count() == 0


def plain_components(texts: dict, k: int, percent: int) -> dict:
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent,block", [(3, 90, 1000), (5, 80, 1000), (3, 80, 4)])
def test_jaccard_join(spark, k, percent, block):
    r = random.Random(k)
    texts, base = {}, [f"w{r.randint(0, 300)}" for _ in range(80)]
    for i in range(120):
        t = list(base) if i % 3 else [f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4) if i % 3 else 0):
            t[r.randrange(len(t))] = f"v{r.randint(0, 50)}"
        texts[1000 - i] = " ".join(t)
    texts |= {2000: None, 2001: "", 2002: "a b", 2003: "A b", 2004: "a"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, how=ngram_join.Join(k, percent, block=block)).collect()}
    assert got == plain_components(texts, k, percent)


def test_join_odd_rows(odd, void):
    out = ngram_join.jaccard_components(odd)
    assert out.count() == odd.count()
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got[100] == got[102] == got[3] and got[200] == 200 and got[201] == 201
    assert ngram_join.jaccard_components(void).count() == 0
    kept = ngram_join.one_of_each(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert 100 not in ids and 3 in ids and ids.count(7) == 1 and None in ids and kept.columns == odd.columns


def test_join_of_one_id_on_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(1, " ".join(base), "a"), (1, "quite another text of this id, with words of its own", "b"), (2, near, "c"), (3, "quite another text of this id, with words of its own", "d"), (3, "a third one", "e"), (4, "", "f"), (4, None, "g"), (4, "", "h"), (2, near, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    assert got == sorted([(1, 58, 1), (1, 9, 1), (2, 58, 1), (2, 58, 1), (3, 9, 1), (3, 1, 3), (4, 0, 4), (4, 0, 4), (4, 0, 4)])
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id, (r.text or "")[:9]) for r in kept.collect()) == [(1, "quite ano"), (1, "w0 w1 w2 "), (3, "a third o"), (4, "")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
    assert components(edges.limit(0)).count() == 0


def test_few_edges_take_few_jobs(spark):
    # a path of 3,000 nodes in random order, which rounds alone contract some ten times
    r = random.Random(3)
    names = r.sample(range(100_000), 3000)
    edges = _common.materialize(spark.createDataFrame([*zip(names, names[1:], strict=False)], "u long, v long"), "path")
    spark.sparkContext.setJobGroup("few", "few")
    try:
        got = {x.node: x.component for x in components(edges).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(names, min(names))
    assert jobs <= 8, jobs


@pytest.mark.parametrize("few", [0, 3, 40])
def test_components_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    r = random.Random(few)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(110)] + [("hub", f"n{i}") for i in range(0, 150, 5)] + [(None, "n1"), ("n2", "n2")]
    group = {x: {x} for p in pairs for x in p if x}
    for u, v in pairs:
        if u and v and group[u] is not group[v]:
            both = group[u] | group[v]
            group |= dict.fromkeys(both, both)
    want = {x: min(g) for x, g in group.items() if len(g) > 1}
    got = [(x.node, x.component) for x in components(spark.createDataFrame(pairs, "u string, v string")).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_hilbert_keys():
    side = 8
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side * side))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).astype("float32")
    v[50] = v[60] = v[70]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None] * 8), (980, [1.0]), (None, v[0].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest(df, lambda i: i % 20 == 0).collect()
    full = v.astype("float64")
    hits, of = 0, defaultdict(dict)
    for r in got:
        of[r.query_id][r.rank] = (r.vec_id, r.score)
        assert abs(r.score - full[r.query_id] @ full[r.vec_id]) < 1e-9
    assert sorted(of) == list(range(0, 400, 20)) and all(sorted(x) == list(range(1, 21)) for x in of.values())
    for q, best in of.items():
        s = full @ full[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(400), -s))[:20]) & {i for i, _ in best.values()})
    assert hits >= 0.9 * 20 * len(of)
    assert [i for i, _ in (of[60][1], of[60][2])] == [50, 70]
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert {r.vec_id for r in neighbours.nearest(df.where("vec_id < 3"), lambda i: i == 0).collect()} == {1, 2}


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=(300, 12)), rng.normal(size=(90, 3)) * 1e9
    rows = [(i, x.tolist()) for i, x in enumerate(long)] + [(1000 + i, x.tolist()) for i, x in enumerate(short)] + [(40, long[41].tolist()), (40, long[40].tolist()), (2000, [1e-300] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    of = defaultdict(dict)
    for r in neighbours.nearest(df, lambda i: i % 20 == 0, k=10).collect():
        of[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(of) == {i for i, _ in rows if i % 20 == 0} and all(sorted(x) == list(range(1, 11)) for x in of.values())
    assert all(v < 1000 or v == 2000 for q, x in of.items() if q < 1000 for v, _ in x.values()) and all(1000 <= v < 2000 for q, x in of.items() if 1000 <= q < 2000 for v, _ in x.values())
    hits = 0
    for q in range(1000, 1090, 20):
        s = short @ short[q - 1000]
        s[q - 1000] = -np.inf
        for v, score in of[q].values():
            assert score == pytest.approx(s[v - 1000], rel=1e-12)
        hits += len(set(np.argsort(-s)[:10] + 1000) & {v for v, _ in of[q].values()})
    assert hits >= 45
    assert all(v != 40 for v, _ in of[40].values())  # two vectors of one id: one list, nothing of its own id
    best = {v: max(long[v] @ long[40], long[v] @ long[41]) for v in range(300) if v != 40}
    assert [v for v, _ in (of[40][i] for i in (1, 2))] == sorted(best, key=best.get)[::-1][:2]


def test_urls(spark):
    good = [f"https://news{i}.example.net/en/{i}?page=2" for i in range(60)]
    bad = [f"http://www.spam{i % 5}.example.net/casino/{i}?win=1" for i in range(60)]
    known = spark.createDataFrame([(u, False) for u in good] + [(u, True) for u in bad], "url string, blocked boolean")
    cases = ["http://new.example.net/casino/3?win=2", "https://x.example.net/en/5", "https://A.ORG/x", "http://sub.example.org/es/1", "http://example.org/en/17", "http://shop.com/de/1", "http://shop.com/fr/1", "http://x.org", None, "no scheme", "ftp://h?x", ""]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judge_urls(pages, known).collect()}
    assert [got[i].verdict for i in range(8)] == ["block", "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert [got[i].rule for i in (2, 3, 4, 5, 6, 7)] == ["org/", "example.org/es/", "example.org/en/1", "com/de/", "com/fr/", None]
    assert (got[2].host, got[2].path, got[8].host, got[9].path, got[10].host, got[10].path) == ("a.org", "/x", "", "", "h", "")
    assert urls.judge_urls(pages, known.limit(0)).where("verdict = 'block'").count() == 3 and urls.judge_urls(pages.limit(0), known).count() == 0


def plain_rules(rows: list[tuple[list, bool]], how) -> dict:
    """Confidence of every token combination that passes, by trying all."""
    has = defaultdict(lambda: [0, 0])
    for tokens, blocked in rows:
        for k in range(1, how.longest + 1):
            for c in combinations(tokens, k):
                has[c][0] += 1
                has[c][1] += blocked
    return {c: b / n for c, (n, b) in has.items() if b >= max(how.support * len(rows), how.least_rows) and b / n >= how.confidence}


@pytest.mark.parametrize("limit", [_common.BROADCAST_ROWS, 0])
def test_mined_rules_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
    r = random.Random(8)
    how = urls.Mining(support=0.01, least_rows=4, confidence=0.7)

    def url():
        w = lambda x: r.choice(x)
        return f"http://{w(['www', 'm', 'shop1', 'x-y'])}.{w(['a', 'b', 'c'])}.{w(['net', 'io'])}/{w(['en', 'de', 'casino', 'news'])}/{w(['win', 'read', '77', 'İİx'])}?{w(['page', 'ref', 'id'])}=1"

    known = [(u, r.random() < (0.9 if "casino" in u and "win" in u else 0.8 if "b.io" in u else 0.2)) for u in (url() for _ in range(700))] + [("http://" + "a" * 60_000 + ".net/" + "/".join(map(str, range(3000))), True), (None, True), ("none", False)]
    rows = [(urls.url_tokens(u), b) for u, b in known if urls.url_tokens(u)]
    want = plain_rules(rows, how)
    df = spark.createDataFrame(known, "url string, blocked boolean").repartition(3)
    rules = urls.mine_rules(urls.with_tokens(df, "url").select("tokens", "blocked"), how)
    got = {tuple(x.tokens): x.confidence for x in rules.collect()}
    assert got and all(want[c] == pytest.approx(p) for c, p in got.items())
    assert {c for c in want if all(want.get(s, 0) < want[c] for k in range(1, len(c)) for s in combinations(c, k))} == set(got)
    asked = [url() for _ in range(300)] + [None, "x://İİ.net/casino/win"]
    best = [max((p for c, p in want.items() if set(c) <= set(urls.url_tokens(u))), default=None) for u in asked]
    out = urls.match_rules(spark.createDataFrame(list(enumerate(asked)), "i int, url string"), rules)
    assert [x.mined for x in out.orderBy("i").collect()] == [p if p is None else pytest.approx(p) for p in best]
    assert 50 < sum(p is not None for p in best) < 250


def test_urls_large_index(spark, monkeypatch):
    rules = _common.materialize(spark.createDataFrame([(["p:casino", "q:win"], 0.9, 0.1), (["p:casino"], 0.8, 0.1), (["p:x"], 0.7, 0.1)], "tokens array<string>, confidence double, support double"), "r")
    pages = spark.createDataFrame([(0, "http://a.net/casino?win=1"), (1, "http://a.net/casino"), (2, "http://a.net/y"), (3, None), (0, "http://a.net/casino?win=1")], "page_id long, url string")
    small = sorted(map(str, urls.match_rules(pages, rules).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert sorted(map(str, urls.match_rules(pages, rules).select("page_id", "url", "mined").collect())) == small


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "~1[NEXT]~", "[TURN]x[TEXT]", "", None, "é🙂[", "a</s", "~~00", "<s></s>[/INST", "plain"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "[TEXT]"]), r.choice(odd), 1) for c in range(60) for t in range(r.randint(1, 9))] + [(None, 0, "user", "x", 1), (5, None, "user", "first", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    for x in chat.read_chats(chat.format_chats(df)).collect():
        turns = sorted(want[x.conv_id])
        assert [tuple(t) for t in x.turns] == [t[2:] for t in turns]
        assert x.loss_texts == [t[3] for t in turns if t[2] == "assistant"]
        marks = sum(a[2] != b[2] for a, b in zip(turns, turns[1:], strict=False)) + 1
        assert x.formatted.count("[TURN]") == marks
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.range(2000).selectExpr("1L as conv_id", "id as turn", "case when id % 3 = 0 then 'user' else 'assistant' end as role", "concat('text ', id) as text")
    one = chat.read_chats(chat.format_chats(long)).first()
    assert [t.text for t in one.turns] == [f"text {i}" for i in range(2000)] and one.loss_texts == [f"text {i}" for i in range(2000) if i % 3]


def test_pipeline_drops_lines_of_a_thirteenth(spark):
    import corpus_pipeline

    rows = [(i, f"menu\nbody {i}" if i < 3 else f"twice\nbody {i}" if i < 5 else f"body {i}", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert [got[i].text for i in (0, 1, 2, 5)] == ["body 0", "body 1", "body 2", "body 5"] and got[0].n_chars == 6
    assert got[3].text == "twice\nbody 3"


def test_pipeline_small(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = _common.materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0 < out.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where("piece = 0").count() == docs.count()

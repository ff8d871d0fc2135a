"""Compression bands, line dedup, personal data and toxicity."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import lines, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, hit = Counter(wins), set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(hit)


def test_base_counts(odd):
    texts = [r.text for r in odd.select("text").collect()] + ["a b c d e f a b c d e", "é# é#\n\né# é#\n<", "a b c d e " * 9]
    for t in texts:
        if t is None or len(t) < 50_000:
            assert quality.base_counts(t) == plain_counts(t)


def test_compression_bands(odd, void):
    out = quality.compression_bands(odd)
    assert out.count() == odd.count() and out.columns.count("kept") == 1
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[3].kept and not got[200].kept and got[200].ratio is None and got[201].base_failed and not got[301].kept and not got[302].kept
    assert got[300].kept
    assert quality.compression_bands(void).count() == 0


def test_compression_judges_junk():
    import zstandard

    packer, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(12)) for _ in range(500))
    assert not quality.compression(noise, bands, packer)[3]
    loop = " ".join(f"buy now {i % 7}" for i in range(2000))
    assert not quality.compression(loop, bands, packer)[3]
    assert quality.compression("A short plain sentence, which is fine as it stands.", bands, packer)[3]


def test_compression_judges_every_chunk():
    import zstandard

    packer, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = " ".join(r.choice(words) for _ in range(20_000))
    noise = "".join(chr(r.randint(33, 126)) for _ in range(20_000))
    for good, bad in ((3900, 4096), (1500, 700), (6000, 1500), (60_000, 15_000)):
        assert quality.compression(prose[:good], bands, packer)[3]
        for text in (prose[:good] + noise[:bad], noise[:bad] + prose[:good], prose[:good] + "x" * bad):
            assert not quality.compression(text, bands, packer)[3]
    assert [quality.compression(prose[:n], bands, packer)[1] for n in (1023, 1024, 1025, 2048, 2049)] == [0, 1, 2, 2, 3]


def test_fitted_bands_equal_brute_force(spark):
    import numpy as np
    import zstandard

    packer, r = zstandard.ZstdCompressor(level=3), random.Random(7)
    vocab = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(r.randint(33, 126)) for _ in range(6)) for _ in range(n))
    loop = lambda n: " ".join(f"{r.choice(vocab[:3])}{i % 40:02}" for i in range(n))
    texts = [prose(r.randint(20, 900)) for _ in range(600)] + [noise(300), noise(200), loop(400), prose(500) + noise(500), prose(300) + " " + loop(300)]
    texts += [texts[0]] * 500 + [None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fit = quality.Fit()
    got = {x.doc_id: x for x in quality.compression_bands(df).collect()}
    raws = {t: t.encode() for t in texts if t and not quality.base_failed(plain_counts(t))}
    ratio = lambda b: len(packer.compress(b)) / len(b)
    cut = lambda b: [b[i : i + 1024] if i + 1024 <= len(b) else b[-1024:] for i in range(0, len(b), 1024)] if len(b) >= 1024 else []
    by = {}
    for raw in raws.values():
        by.setdefault(int(np.log2(len(raw))), []).append(ratio(raw))
        by.setdefault("chunk", []).extend(map(ratio, cut(raw)))
    band = {}
    for o, x in by.items():
        if len(x) >= fit.least:
            q1, q3 = np.quantile(x, [0.25, 0.75])
            band[o] = (q1 - fit.below * (q3 - q1), q3 + fit.above * (q3 - q1))
    assert len(band) > 3
    for i, t in enumerate(texts):
        if t in raws:
            raw = raws[t]
            o = int(np.log2(len(raw)))
            if o not in band:
                continue
            past = np.log2(len(raw)) - o - 0.5
            other = band.get(o + (1 if past > 0 else -1), band[o])
            low, high = (a + (b - a) * abs(past) for a, b in zip(band[o], other, strict=True))
            odd = sum(not band["chunk"][0] <= ratio(c) <= band["chunk"][1] for c in cut(raw))
            assert got[i].kept == (low <= ratio(raw) <= high and odd <= 0.1 * len(cut(raw))), i
        else:
            assert not got[i].kept
    assert [got[i].kept for i in range(600, 605)] == [False] * 5 and sum(got[i].kept for i in range(600)) >= 597


def test_bands_are_fitted_to_all_texts(spark):
    import zstandard

    r = random.Random(9)
    vocab = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    block = [r.choice(vocab) for _ in range(600)]
    shuffled = " ".join(w for _ in range(3) for w in r.sample(block, len(block)))  # usual chunks, but the same words again and again
    texts = [prose(12) for _ in range(20_000)] + [prose(r.randint(1700, 1900)) for _ in range(60)] + [shuffled]
    assert quality.compression(shuffled, quality.Bands(), zstandard.ZstdCompressor(level=3))[3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rejected = lambda **k: {x.doc_id for x in quality.compression_bands(df, **k).where("not kept and doc_id >= 20000").collect()}
    assert rejected() == {20_060}  # 61 texts are this long, of which a sample of 8,192 rows holds too few for a band
    assert rejected(fit=quality.Fit(sort_rows=100)) == {20_060}


def test_fitted_bands_reject_junk_of_the_sample_table(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.op1_compression_bands(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    n = {r.quality: (r.bad, r.of) for r in out.where("not base_failed").groupBy("quality").agg(F.count_if(~F.col("kept")).alias("bad"), F.count(F.lit(1)).alias("of")).collect()}
    assert n[0][0] >= 50 and n[1][0] <= 0.002 * n[1][1]


def test_line_dedup(spark, odd, void):
    pages = [(i, "host", f"menu\nbody {i} only\n\nmenu " if i < 6 else f"body {i}", "x") for i in range(12)] + [(99, None, "menu\nalone", "x"), (98, "small", "menu\nmenu", "x"), (97, "host", None, "x")]
    df = spark.createDataFrame(pages, "doc_id long, source string, text string, n_dropped string")
    got = {r.doc_id: r for r in lines.site_line_dedup(df).collect()}
    assert got[0].text == "body 0 only\n" and got[0].n_lines == 3 and got[0].n_dropped == 2
    assert got[99].text == "menu\nalone" and got[98].text == "menu\nmenu" and got[97].text is None and got[97].n_lines == 0 and got[8].text == "body 8"
    assert lines.site_line_dedup(odd).count() == odd.count() and lines.site_line_dedup(void).count() == 0


def test_line_dedup_large_side(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, "h", f"menu\nbody {i}") for i in range(10)], "doc_id long, source string, text string")
    assert {r.text for r in lines.site_line_dedup(df).collect()} == {f"body {i}" for i in range(10)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = [(EMAIL, lambda m: True), (IP, lambda m: all(int(x) <= 255 for x in m.split("."))), (CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (PHONE, lambda m: 10 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (r, ok) in enumerate(tests) for m in r.finditer(t or "") if ok(m.group()))


def test_fixed_patterns(spark):
    r = random.Random(5)
    parts = ["@", ".", "..", "a", "B", "-", "_", "%", "+", "1", "23", "456", "7890", "12345678901234", " ", "  ", "(", ")", "\n", "é", "4111111111111111", "+1 ", "255.", "1.2.3.4", "256"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(1500)] + [None, "", "a" * 100_000, "1" * 100_000, "a@" + "b." * 20_000, "1.2.3.4 " * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in df.select("i", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [tuple(x) for x in row.s] == plain_spans(texts[row.i])


def test_bootstrapped_contexts(spark, odd, void):
    known = [(i, f"please call me at +1 555 010 {1000 + i} today or write to user{i}@mail.example.org soon") for i in range(30)]
    hidden = [(100, "please write to user[at]99mail soon"), (101, "nothing 12345678 here"), (102, "then write to secretuser77 soon")]
    df = spark.createDataFrame(known + hidden, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert [tuple(s) for s in got[102].spans] == [(14, 0, 26)] and got[102].base == []
    assert got[101].spans == [] and len(got[3].base) == 2 and got[3].spans == got[3].base
    assert pii.personal_data(odd).count() == odd.count() and pii.personal_data(void).count() == 0


def test_spaced_instances(spark):
    def instances(text):
        got = spark.createDataFrame([(text,)], "text string").select(pii._instances(F.col("text")).alias("i")).first().i
        assert all(text[x.start : x.end] == x.token for x in got)
        return [(x.token, x.left, x.right) for x in got]

    assert instances("so call me +1 (017) 555-7713, then wait") == [("+1 (017) 555-7713", "call me", "then wait")]
    assert instances("é (tel:+49 30 1234567890) ok") == [("+49 30 1234567890", "é (tel:", "ok")]
    assert instances("4111 1111 1111 1111 is mine") == [("4111 1111 1111 1111", "", "is mine")]
    assert instances("a (017) 555-7713\nb 12 34 x") == [("(017) 555-7713", "a", "b 00"), ("12 34", "000-0000 b", "x")]
    assert instances("7536784127813050 4845168114407329 z") == [("7536784127813050", "", "0000000000000000 z"), ("4845168114407329", "0000000000000000", "z")]


def test_bootstrapped_contexts_of_each_kind(spark):
    def luhn(n):
        return next(c for c in range(10) if sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(str(n)))) % 10 == (10 - c) % 10)

    cards = [f"{400000111122220 + 7 * i}{luhn(400000111122220 + 7 * i)}" for i in range(12)]
    spaced = [" ".join(c[i : i + 4] for i in (0, 4, 8, 12)) for c in cards]
    known = [f"you can reach me at +1 ({200 + i}) 555-77{10 + i} all day" for i in range(12)]
    known += [f"my card number {c} will expire" for c in spaced] + [f"a host named 10.0.{i}.7 went down" for i in range(12)]
    known += [f"please write to user{i}@mail.example.org very soon" for i in range(12)] + [f"+1 ({300 + i}) 555-88{10 + i} rings every night" for i in range(12)]
    hidden = {"you can reach me at (017) 555-7713 all day": (20, 3, 34), "my card number 1234 5678 will expire": (15, 2, 24), "a host named box-77a went down": (13, 1, 20), "please write to secret77 very soon": (16, 0, 24), "(018) 555-9999 rings every night": (0, 3, 14)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*known, *hidden])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, span in enumerate(hidden.values(), len(known)):
        assert [tuple(s) for s in got[i].spans] == [span] and got[i].base == []


def plain_discover(edges: set, seeds: dict, how) -> dict:
    """token: kind of the instances that the patterns find, turn by turn; edges: (pattern, token)."""
    tokens, patterns = {}, {}
    for p, t in edges:
        tokens.setdefault(t, set()).add(p)
        patterns.setdefault(p, set()).add(t)
    score = {t: (k, 1.0) for t, k in seeds.items()}
    found = {}
    while True:
        trust = {}
        for p, ts in patterns.items():
            for kind in range(4):
                mass = [score[t][1] for t in ts if t in score and score[t][0] == kind]
                if len(ts) >= how.support and len(mass) >= how.support and sum(mass) >= how.confidence * len(ts) - 1e-12:
                    trust[p, kind] = sum(mass) / len(ts)
        step = {}
        for t, ps in tokens.items():
            if t in score:
                continue
            best = None
            for kind in range(4):
                c = [trust[p, kind] for p in ps if (p, kind) in trust]
                if c:
                    s = 1 - math.prod(max(1 - x * how.confidence, 1e-9) for x in c)
                    if max(s, *c) >= how.confidence and (best is None or (-s, kind) < best):
                        best = (-s, kind)
            if best:
                step[t] = (best[1], -best[0])
        if not step:
            return found
        score |= step
        found |= {t: k for t, (k, _) in step.items()}


def test_scores_equal_brute_force(spark):
    r = random.Random(11)
    how = pii.Bootstrap(support=3, confidence=0.75)
    edges, seeds = set(), {}
    for g in range(40):  # groups of tokens round a pattern, most of one kind, that overlap with the next group
        kind = r.randrange(4)
        for i in range(r.randint(3, 12)):
            t = f"t{g}-{i}" if r.random() < 0.7 else f"t{max(0, g - 1)}-{r.randrange(6)}"
            edges.add((f"L p{g}", t))
            if r.random() < 0.75 and t not in seeds:
                seeds[t] = kind if r.random() < 0.95 else r.randrange(4)
    rows = [([(0, seeds[t], 20)] if t in seeds else [], [(0, 20, t, p[2:], "")]) for p, t in sorted(edges)]
    df = spark.createDataFrame(rows, "spans array<struct<start:int,kind:int,end:int>>, instances array<struct<start:int,end:int,token:string,left:string,right:string>>")
    want = plain_discover(edges, seeds, how)
    assert dict(tuple(x) for x in pii.discover(df, how).collect()) == want and len(want) > 3 and len(set(want.values())) > 1


def test_contexts_find_planted_identifiers(spark):
    """Handles of a kind that no fixed pattern knows stand where emails stand; half of other codes stand in contexts that are shared with others."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    frames = [("write to", "for details"), ("reach us at", "any day"), ("account of", "was closed"), ("long" * 40 + " before", "after " + "w" * 200)]
    texts, want = [], {}
    for i in range(600):
        left, right = frames[i % 4]
        hidden = i % 15 == 0
        token = f"u{i}[at]{word()}{'x' * (120 if i % 30 == 0 else 0)}{i}" if hidden else f"{word()}{i}@mail.example.org"
        lead = f"{word()} {word()} {left} "
        texts.append(f"{lead}{token} {right} {word()}")
        if hidden:
            want[i] = (len(lead), 0, len(lead) + len(token))
    texts += [f"{word()} code {word()}{r.randint(10, 10**6)} {word()} {word()}" for _ in range(400)]
    got = {x.doc_id: [tuple(s) for s in x.spans if s not in x.base] for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = sum(got[i] == [s] for i, s in want.items())
    extra = sum(map(len, got.values())) - hits
    assert hits >= 0.95 * len(want) and extra == 0, (hits, len(want), extra)


def test_bootstrapping_goes_on_until_nothing_is_new(spark):
    mails, level = [f"u{i}@mail.example.org" for i in range(44)], lambda k: [f"key{k}x{i}77" for i in range(3)] if k else ["v1@a.org", "v2@a.org", "v3@a.org"]
    rows = [([(0, 0, 20)] if "@" in t else [], [(0, 20, t, f"left {k}", "")]) for k in range(1, 6) for t in [*mails, *level(k - 1), *level(k)]]
    df = spark.createDataFrame(rows, "spans array<struct<start:int,kind:int,end:int>>, instances array<struct<start:int,end:int,token:string,left:string,right:string>>")
    assert sorted(tuple(r) for r in pii.discover(df).collect()) == sorted((t, 0) for k in range(1, 6) for t in level(k))
    with pytest.raises(RuntimeError):
        pii.discover(df, pii.Bootstrap(rounds=3))


CLEAN = ["the", "house", "stands", "near", "river", "and", "people", "walk", "there", "often", "while", "birds", "sing"]


def toxic_cases() -> tuple[list, list]:
    r = random.Random(3)

    def text(toxic):
        return " ".join(r.choice(["idiot", "scum", "moron", "loser"] if toxic and r.random() < 0.2 else CLEAN) + r.choice(["", "", ",", "!"]) for _ in range(r.randint(20, 60)))

    docs = [(i, text(i % 5 == 0)) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "idiot scum moron"), (903, "words of no example"), (904, "12 34"), (905, docs[10][1]), (906, docs[10][1].upper()), (907, "the " * 50_000)]
    return docs, [(i, int(i % 5 == 0)) for i in range(0, 200)] + [(None, 1), (5, None), (901, 0), (11, 0)]


def plain_scores(docs, labels, how) -> dict:
    """Score of each text by cosines with all examples, one after the other."""
    toxic = {}
    for i, y in labels:
        if i is not None and y is not None:
            toxic[i] = max(y, toxic.get(i, 0))
    bags = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in docs}
    ex = {i: y for i, y in toxic.items() if i in bags}
    n1 = sum(ex.values())
    n0, n = len(ex) - n1, len(docs)
    df = Counter(w for b in bags.values() for w in b)
    has = [Counter(w for i, y in ex.items() if y == k for w in bags[i]) for k in (0, 1)]

    def weight(w):
        if not has[0][w] + has[1][w]:
            return how.floor * (math.log((1 + n) / 2) + 1)
        a, b = has[1][w] + 0.5, has[0][w] + 0.5
        c, d = n1 + 1 - a, n0 + 1 - b
        odds = abs(math.log(a / c) - math.log(b / d)) - how.sure * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        return (math.log((1 + n) / (1 + df[w])) + 1) * (how.floor + max(0, odds))

    def unit(bag):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {i: unit(bags[i]) for i in ex if bags[i]}
    share = n1 / len(ex)
    bare = [i for i in ex if not bags[i]]
    out = {}
    for i, _ in docs:
        q = unit(bags[i])
        cos = sorted(((sum(x * units[e].get(w, 0) for w, x in q.items()), e) for e in units), reverse=True)
        cos = [(c, e) for c, e in cos if 0 < c < 1 - 1e-9]
        near = [(c, e) for c, e in cos if len(cos) <= how.k or c >= cos[how.k - 1][0] - 1e-9]
        if near:
            out[i] = (sum(c * c * ex[e] for c, e in near) + how.prior * share) / (sum(c * c for c, e in near) + how.prior)
        else:
            out[i] = (sum(ex[e] for e in bare) + how.prior * share) / (len(bare) + how.prior)
    return out


def test_toxicity_equals_brute_force(spark):
    docs, labels = toxic_cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    for how in (toxicity.Votes(), toxicity.Votes(block=8, common=0.1, k=7), toxicity.Votes(block=4, common=0.02)):
        got = {x.doc_id: x for x in toxicity.score_toxicity(df, known, how=how).collect()}
        want = plain_scores(docs, labels, how)
        assert {i: round(x.score, 6) for i, x in got.items()} == {i: round(x, 6) for i, x in want.items()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(200, 300))
    assert got[902].predicted == 1 and got[902].evidence and got[900].score == got[901].score == got[903].score == got[904].score
    assert got[905].score == got[906].score == got[10].score and got[905].evidence[0].id != 10


def test_toxicity_odd_rows(spark, odd, void):
    docs, labels = toxic_cases()
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_toxicity(odd, known)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    assert toxicity.score_toxicity(void, known).count() == 0
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.score for x in toxicity.score_toxicity(df, known.limit(0)).collect()} == {0.0}
    twice = df.union(spark.createDataFrame([(0, "another text of this id")], df.schema))
    assert toxicity.score_toxicity(twice, known).count() == len(docs) + 1
    assert toxicity.clean_only(odd, known).columns == odd.columns


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op10_nearest_examples(spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in both.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 4 and n.get((0, 1), 0) <= 2
    assert got.where("size(evidence) = 0").count() <= 10 and got.select("score").distinct().count() > 500

"""Importance resampling and source divergence against plain versions."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from fixtures import awkward, frame, sentence

from firmground.llm import divergence, resampling


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def runs(text, longest):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_draw(texts, target, share, least, buckets, longest, seed):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = (Counter(crc(f) for t in some for f in runs(t, longest)[1]) for some in ([t for _, t in texts], target))
    s, t = source.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for i, text in texts:
        n, found = runs(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(crc(f)) for f in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[3], -x[2], -x[1]))
    drawn = able[:share * len(able) // 100]
    ranked = Counter((*x, r + 1) for r, x in enumerate(drawn))
    return ranked + Counter((*x, None) for x in (Counter(out) - Counter(drawn)).elements())


@pytest.mark.parametrize("how", [{}, {"longest": 3, "buckets": 500}, {"share": 100}, {"share": 55, "slack": 1e-9, "least_words": 0}])
def test_draw(spark, how):
    rng = random.Random(11)
    texts = awkward() + [(100 + i, sentence(rng, rng.randrange(0, 90), 200)) for i in range(300)] + [(900 + i % 3, "same words " * 20) for i in range(60)]
    target = [sentence(rng, 40, 60) for _ in range(20)] + [None, ""]
    docs = frame(spark, texts).repartition(3)
    bench = spark.createDataFrame([(7, t) for t in target], "n long, text string")
    got = Counter(tuple(r) for r in resampling.resample(docs, bench, **how).collect())
    asked = {"share": 10, "least_words": 20, "buckets": 10_000, "longest": 1, **how}
    assert got == plain_draw(texts, target, asked["share"], asked["least_words"], asked["buckets"], asked["longest"], 2024)
    assert resampling.resample(docs.limit(0), bench, **how).count() == 0
    none = resampling.resample(docs, bench.limit(0), **how)
    assert none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and none.count() == len(texts)


def test_bracket_is_proved(spark):
    scores = spark.createDataFrame([(v,) for v in [5] * 700 + list(range(300))], "score long")
    flat = sorted([5] * 700 + list(range(300)), reverse=True)
    for k in (1, 290, 294, 295, 500, 995, 996, 1000):
        for slack in (1e-9, 0.005, 1.0):
            low, high, above = resampling.bracket(scores, 1000, k, slack)
            assert above == sum(high is not None and v > high for v in flat) < k
            assert low is None or low <= flat[k - 1]
            assert high is None or high >= flat[k - 1]


def plain_divergence(rows, top, least):
    terms = {i: Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for i, (t, _, _) in enumerate(rows)}
    groups = {}
    for i, (_, lang, source) in enumerate(rows):
        groups.setdefault((lang or "", source or ""), Counter()).update(terms[i])
    out = []
    for lang in {g[0] for g in groups}:
        mine = [i for i, r in enumerate(rows) if (r[1] or "") == lang]
        seen = Counter(t for i in mine for t in terms[i])
        kept = [t for t, n in seen.items() if n >= least]
        whole = Counter({t: sum(terms[i][t] for i in mine) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q = share(whole)
        p = {s: share(c) for (g, s), c in groups.items() if g == lang}
        for s in p:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("slot", [256, 2])
def test_divergence(spark, monkeypatch, slot):
    monkeypatch.setattr(divergence, "SLOT", slot)
    rng = random.Random(13)
    letters = ["ab", "Ab", "é", "straße", "中文", "x1y", "ZÜ", "\U0001f600"]
    word = lambda: rng.choice(letters) + rng.choice("abcdefghij") * rng.randrange(0, 4)
    rows = [(" ".join(word() for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ç", None, "z"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "fr", "a"), (None, "fr", None), ("1 2 3", "fr", "b"), ("one two", "it", "only"), ("long " * 30_000, "en", "b")]
    docs = spark.createDataFrame([(i, *r, 5, 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, block int").repartition(5)
    for top, terms in ((200, 2000), (5, 7), (1, 1)):
        got = sorted(tuple(r) for r in divergence.divergence(docs, top=top, block_terms=terms).collect())
        assert got == plain_divergence(rows, top, 3)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_band_keeps_what_few_dominate():
    import numpy as np

    rng = np.random.default_rng(3)
    n, rest = rng.integers(1, 30, (2, 3000))
    for top in (1, 20):
        band = divergence.Band(top)
        for at in range(0, 3000, 256):
            band.add([str(i) for i in range(at, min(3000, at + 256))], n[at:at + 256], rest[at:at + 256], n[at:at + 256])
        want = [str(i) for i in range(3000) if ((n[:i] >= n[i]) & (rest[:i] <= rest[i])).sum() < top]
        assert band.names == want and len(want) < 1500


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_source_divergence"])
def test_queries_against_sql(spark, name):
    from firmground.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

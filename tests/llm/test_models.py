"""Toxicity, personal data and decontamination: held-out accuracy and plain versions."""
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from fixtures import awkward, frame, sentence

from firmground.llm import decontam, pii, toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    hits = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert hits / (found.predicted == 1).sum() > 0.93 and hits / (found.toxic == 1).sum() > 0.9


def test_toxicity_edges(spark):
    rng = random.Random(0)
    texts = awkward() + [(100 + i, sentence(rng, 60) + (" vile rotten" * 3 if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    wrong = [r for r in got if r.doc_id and 100 <= r.doc_id < 300 and r.predicted != int((r.doc_id - 100) % 4 == 0)]
    assert len(wrong) <= 6
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and none[0][0] < 0.01


def plain_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {k: [] for k in patterns}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            check = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if d else False
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or (
                    kind == "card" and 13 <= len(d) <= 19 and check) or kind == "phone" and 9 <= len(d) <= 15:
                out[kind].append(m.span())
    return out


def test_base_spans():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4539578763621486", "4539 5787 6362-1486", "+1 (826) 555-4081",
              "+", "+1", "12-34", "é", " ", "\n", ".", "-", "%", "word", "+49 30 1234567", "\U0001f600", "1234567890123456", "a@b..c", "@@a.b", "x+@y.z-.q"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == {k: [] for k in pii.KINDS}


def test_network_learns_and_windows_agree():
    query = "select text from '/root/testdata/sf0.1/documents.parquet' where regexp_matches(text, '[0-9@]') order by doc_id"
    texts = [t for (t,) in duckdb.sql(query).fetchall()]
    windows = lambda some: (np.stack(x) for x in zip(*(r for t in some for r in pii.training_rows(t))))
    codes, tags = windows(texts[:450])
    model = pii.Tagger().fit(codes, tags)
    held, want = windows(texts[450:])
    found = np.concatenate([model.decode(held[i:i + 512]) for i in range(0, len(held), 512)])
    right = ((found == want) & (want > 0)).sum()
    assert right > 0.9 * (want > 0).sum() and right > 0.9 * (found > 0).sum()
    # a window border changes nothing: the same passage, shifted over the grid
    body = "reach me at (826) 555-4081 today"
    shifted = ["x " * k + body for k in range(0, 40)]
    spans = [pii.added_spans(t, tag, pii.base_spans(t)) for t, tag in zip(shifted, pii.decode_texts(model, shifted))]
    assert sum(bool(f) and shifted[i][f[0][1]:f[0][2]] == "(826) 555-4081" for i, f in enumerate(spans)) > 35


def test_gradients_by_differences():
    model = pii.Tagger(hidden=3)
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 99, (7, 4)), rng.integers(0, pii.TAGS, (7, 4))
    _, grads = model.gradients(codes, tags)
    for name in ("hf", "hb", "out", "move", "first", "bias", "xf"):
        place = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept, step = model.p[name][place], 1e-2
        model.p[name][place] = kept + step
        up, _ = model.gradients(codes, tags)
        model.p[name][place] = kept - step
        down, _ = model.gradients(codes, tags)
        model.p[name][place] = kept
        assert abs((up - down) / (2 * step) - grads[name][place]) < 0.02 * max(0.1, abs(grads[name][place]))


def test_personal_data_edges(spark):
    texts = awkward() + [(200 + i, f"mail a{i}@b.example.com or +1 (826) 555-4{i:03d}, host 10.0.0.{i}") for i in range(60)]
    docs = frame(spark, texts)
    got = {(r.doc_id, len(r.base)) for r in pii.personal_data(docs).collect()}
    assert {(200 + i, 3) for i in range(60)} <= got and (4, 0) in got and (None, 0) in got
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.choice([3, 7, 8, 20, 60]), 3000)) for i in range(40)] + [(90, None), (None, "w1 w2 w3"), (91, ""), (92, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fill = lambda n: sentence(rng, n, 3000)
    texts = awkward() + [(300 + i, fill(100)) for i in range(30)]
    want = set()
    for i, t in items[:40]:
        w = t.split(" ")
        if len(w) >= 20:
            w[rng.randrange(8, 12)] = "changed"
        texts.append((500 + i, f"{fill(50)} {', '.join(w).upper()}! {fill(30)}"))
        want.add((500 + i, i))
    docs = frame(spark, texts).repartition(3)
    for how in ({}, {"block_words": 100}):
        got = decontam.overlaps(docs, bench, **how).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.matched >= 0.75 * r.item_words and r.start >= 0 for r in got)
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(texts) - 40
    assert decontam.clean(docs, bench.limit(0)).count() == len(texts) and decontam.overlaps(docs.limit(0), bench).count() == 0


def test_seeds_survive_a_substitution():
    words = [f"t{i}" for i in range(8)]
    block = decontam.Block(np.array([1]), pa.array([" ".join(words)]))
    for i in range(8):
        text = " ".join([*words[:i], "zz", *words[i + 1:]])
        rows, _ = decontam.search(block, [5], pa.array([text]), 0.75)
        assert rows == [(5, 1, 8, 7, min(1, i == 0), 8 - (i in (0, 7)))]


def test_parts_of_long_items_and_changed_short_ones(spark):
    rng = random.Random(12)
    fill = lambda n: sentence(rng, n, 10**6)
    items = [(0, fill(59)), (1, fill(200)), (2, fill(7)), (3, fill(4)), (4, fill(100)), (5, fill(7))]
    w = {i: t.split(" ") for i, t in items}
    cut = w[0][10:50]
    cut[20] = "changed"
    texts = [(10, f"{fill(30)} {' '.join(cut)} {fill(9)}"), (11, f"{' '.join(w[1][60:])} {fill(40)}"), (12, " ".join([*w[2][:3], "other", *w[2][4:]])),
             (13, f"{fill(8)} {' '.join(w[3][:2])} other {w[3][3]}"), (14, f"{fill(8)} {' '.join(w[4][50:62])} {fill(8)}"), (15, " ".join(w[5][1:]))]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.start, r.length) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(10, 0): (39, 30, 40), (11, 1): (140, 0, 140), (12, 2): (6, 0, 7), (13, 3): (3, 8, 4), (15, 5): (6, 0, 6)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [14]


def plain_log_ratios(texts, classes, order=7, discount=0.75, strength=40.0):
    """The difference of two Kneser-Ney models, with dictionaries: ``classes[i]`` is 1, 0 or None for text i."""
    from collections import Counter

    def grams(text):
        for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
            b = bytes(order - 1) + bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) + b" "
            yield from (b[i:i + order] for i in range(len(b) - order + 1))

    levels = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def tables(counts):
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return counts, total, kinds

    levels = {k: tables(c) for k, c in levels.items()}
    sides = [tables(Counter(g for t, c in zip(texts, classes) if c == y for g in grams(t))) for y in (1, 0)]

    def mixed(table, g, low, more=0.0):
        counts, total, kinds = table
        n = total[g[:-1]]
        spare = min(discount * max(kinds[g[:-1]], 1), n) + more
        return (max(counts[g] - discount, 0) + spare * low) / (n + more) if n + more else low

    def ratio(g):
        low = 1 / 256
        for k in range(1, order + 1):
            low = mixed(levels[k], g[-k:], low)
        toxic, ordinary = (mixed(s, g, low, strength) for s in sides)
        return np.log(toxic / ordinary)

    known = {g: ratio(g) for g in levels[order][0]}
    return [sum(known[g] for g in grams(t)) for t in texts]


def test_toxicity_equals_plain_models(spark):
    import zlib

    rng = random.Random(21)
    words = ["vile", "rotten", "nice", "zürich", "Calm", "x9", "aa", "the"]
    word = lambda: rng.choice(words) + rng.choice(["", "ly", "s", "é", "ness"]) * rng.randrange(2)
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, None), (301, "vile " * 5000), (302, "!!")]
    truth = {i: int("vile" in (t or "")) for i, t in texts if i % 3}
    found = {r.doc_id: r for r in toxicity.toxicity(frame(spark, texts).repartition(3), spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")).collect()}
    free = [truth[i] if i in truth and zlib.crc32(str(i).encode()) % 5 else None for i, _ in texts]
    want = plain_log_ratios([t for _, t in texts], free)
    assert any(w > 5 for w in want) and any(w < -5 for w in want)
    for (i, t), w in zip(texts, want):
        assert abs(found[i].log_ratio - w) < 1e-4 * max(1, len(t or ""))


def test_toxicity_keeps_columns_of_any_name(spark):
    docs = frame(spark, awkward())
    docs = docs.withColumns({c: docs["n"] for c in ("_tox_total", "_tox_score", "__TOX_score", "y", "gram")})
    labels = spark.createDataFrame([(1, 0), (9, 1), (7, 0), (12, 1)], "doc_id long, toxic int")
    kept = toxicity.kept(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert toxicity.kept(docs.limit(0), labels).count() == 0

"""Exact and near deduplication, lines and passages against plain versions."""
import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SPACE, awkward, frame, sentence, shingle_set, words_of

from firmground.llm import exact_dedup, lines, near_dedup, passages


def plain_exact(texts):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(texts):
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), i is None, i or 0, k, i))
    out = {}
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(body.encode()).hexdigest())
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("how", [{}, {"capacity": 1, "max_depth": 6, "held_bytes": 50}, {"hash_of": len, "capacity": 2}])
def test_exact(spark, how):
    texts = awkward()
    docs = frame(spark, texts).repartition(3)
    got = exact_dedup.exact_groups(docs, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    want = plain_exact(texts)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_directory_splits_and_doubles():
    depth, slots, depths = exact_dedup.directory({0: 10, 1: 10, 8: 1, 12: 1}, 12, 4)
    assert depth == 4 and len(slots) == 16
    assert slots[0] != slots[1] and slots[8] == slots[15] and sorted(depths) == [1, 2, 3, 4, 4]


def plain_near(texts, share=0.75):
    ids = sorted({i for i, _ in texts if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in texts if i is not None]
    for x, (i, s) in enumerate(sets):
        for j, r in sets[:x]:
            if s and r and len(s & r) >= share * len(s | r):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return find


def edited(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near(spark):
    rng = random.Random(1)
    texts = awkward()
    for g in range(12):
        base = sentence(rng, rng.randrange(30, 300), 5000)
        texts += [(100 * g + 100 + k, edited(rng, base, rng.randrange(0, 6))) for k in range(rng.randrange(2, 12))]
    got = near_dedup.near_groups(frame(spark, texts).repartition(4)).collect()
    find = plain_near(texts)
    want = sorted(repr((i, len(shingle_set(t)), None if i is None else find(i), i is None or find(i) == i)) for i, t in texts)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert near_dedup.near_groups(frame(spark, texts).limit(0)).count() == 0


def test_neighbours_across_partitions(spark, monkeypatch):
    rng = random.Random(2)
    base = sentence(rng, 200, 5000)
    texts = [(i, edited(rng, base, 3)) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = near_dedup.near_groups(frame(spark, texts)).select("component_id").distinct().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[0] for r in got] == [0]


def test_near_pairs_within_a_crowded_family(spark):
    """Thousands of documents at 0.73 on one template hide pairs at 0.76 from neighbours in any order."""
    rng = random.Random(11)
    base = sentence(rng, 85, 10**6)
    texts = [(i, f"{base} {sentence(rng, 15, 10**9)}") for i in range(3000)]
    for k in range(40):
        texts.append((5000 + k, f"{texts[60 * k][1].rsplit(' ', 13)[0]} {sentence(rng, 13, 10**9)}"))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, texts).repartition(4)).collect()}
    assert got == {i: 60 * (i - 5000) if i >= 5000 else i for i, _ in texts}


def plain_lines(texts):
    first = {}
    keys = []
    for i, t in texts:
        mine = []
        for line in (t or "").split("\n"):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
            mine.append((line, key))
            if len(key) >= 10 and i is not None:
                first[key] = min(first.get(key, i), i)
        keys.append(mine)
    out = []
    for (i, _), mine in zip(texts, keys):
        kept = [line for line, key in mine if i is None or len(key) < 10 or first[key] == i]
        out.append((i, len(mine), len(mine) - len(kept), "\n".join(kept)))
    return out


def line_texts():
    rng = random.Random(3)
    pool = [sentence(rng, 3) for _ in range(30)] + ["short", "  Padded Line Here \t", "padded line here", "é" * 9, "é" * 10, ""]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    return [*texts, *awkward(), *((1000 + i, "the one very common line\n" + sentence(rng, 4)) for i in range(300)), (1000, texts[0][1])]


@pytest.mark.parametrize("partitions", [4, 37])
def test_lines(spark, partitions):
    texts = line_texts()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = lines.kept_lines(frame(spark, texts).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_lines(texts)))
    assert lines.kept_lines(frame(spark, texts).limit(0)).count() == 0


def test_bitmap_round_trip():
    assert lines.dropped_of(lines.bitmap([0, 3, 70_000])) == {0, 3, 70_000}
    assert lines.dropped_of(None) == set()


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 60).astype(np.uint64)
    values[10] = values[20] = values[40]
    bounds = np.array([0, 25, 25, 60])
    left, centre, right = passages.compact_windows(values, bounds, 6)
    bits = np.uint64(int(len(values)).bit_length())
    coarse = values >> bits  # ties are broken by place once the lowest bits give way to it
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        for i in range(lo, hi):
            for j in range(i + 5, hi):
                c = i + int(np.argmin(coarse[i:j + 1]))
                hits = (left <= i) & (i <= centre) & (centre <= j) & (j <= right)
                assert hits.sum() == 1 and centre[hits][0] == c


def test_passages(spark):
    rng = random.Random(9)
    common, other, near = sentence(rng, 60, 9000), sentence(rng, 51, 9000), sentence(rng, 90, 9000)
    fill = lambda n: sentence(rng, n, 9000)
    texts = [(i, f"{fill(70)} {common.upper() if i % 2 else common}\n{fill(40)}") for i in range(1, 30)]
    texts += [(40, f"{other} {fill(300)}"), (41, f"{fill(200)} {other}"), (42, f"{fill(90)} {edited(rng, near, 2)} {fill(80)}"), (43, f"{fill(30)} {near} {fill(5)}")]
    texts += [(50 + i, fill(200)) for i in range(20)] + [(90, " ".join(fill(45) for _ in range(2))), (91, None), (92, ""), (None, common), (93, fill(20)), (95, f"{common} {fill(60)} {common}")]
    got = passages.repeated_passages(frame(spark, texts).repartition(3)).collect()
    flagged = {r.doc_id for r in got} | {r.other_id for r in got}
    assert flagged == set(range(1, 30)) | {40, 41, 42, 43, 95}
    text = {i: words_of(t) for i, t in texts if i is not None}
    for r in got:
        a, b = text[r.doc_id][r.start:r.start + r.length], text[r.other_id][r.other_start:r.other_start + r.other_length]
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 50
        s, t = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert abs(len(s & t) / len(s | t) - r.similarity) < 1e-9 and r.similarity >= 0.75
    linked = {r.doc_id for r in got}
    assert set(range(2, 30)) <= linked and {41, 43, 95} <= linked
    assert passages.repeated_passages(frame(spark, texts).limit(0)).count() == 0


def test_exact_passage_beside_lightly_edited_text(spark):
    rng = random.Random(13)
    exact, around = sentence(rng, 60, 10**6), [sentence(rng, 100, 10**6).split(" ") for _ in range(2)]
    other = [[f"e{k}" if k % 8 == 4 else v for k, v in enumerate(w)] for w in around]
    one, two = (f"{' '.join(p)} {exact} {' '.join(q)}" for p, q in (around, other))
    made, at = (passages.shingles(*passages.words(*passages.text_bytes(pa.array([one, two])))[:2], 5))
    got = passages.common_passages(made[at[0]:at[1]], made[at[1]:at[2]], 5, 50, 0.75)
    assert len(got) == 1
    s, n, t, m, like = got[0]
    assert s <= 100 and s + n >= 160 and t <= 100 and t + m >= 160 and like >= 0.75
    found = passages.repeated_passages(frame(spark, [(1, one), (2, two)])).collect()
    assert any(r.start <= 100 and r.start + r.length >= 160 for r in found)


def frequent_lines(rng, docs: int, pairs: int):
    """Texts made of 40 lines that hundreds of documents hold, and pairs that share seven of them in a row."""
    lines = [sentence(rng, 10, 10**6) for _ in range(40)]
    draw = lambda n: [rng.choice(lines) for _ in range(n)]
    texts = [(i, "\n".join(draw(30))) for i in range(docs)]
    for k in range(pairs):
        shared = draw(7)
        texts += [(1000 + 2 * k + side, "\n".join(draw(12) + [sentence(rng, 7, 10**6)] + shared + [sentence(rng, 4, 10**6)] + draw(10))) for side in (0, 1)]
    return texts


def test_links_follow_from_the_windows_alone(spark):
    """Streams over 1, 7 and 60 slots, some of them within one key or run, against the rule on sorted windows."""
    rng = random.Random(21)
    common = sentence(rng, 60, 9000)
    texts = [(i, f"{sentence(rng, 20, 9000)} {common} {sentence(rng, 20, 9000)}") for i in range(60)] + frequent_lines(rng, 60, 5)
    docs = frame(spark, texts + texts[:3]).select("doc_id", "text")
    none = [np.zeros(0, np.int64)] * 4
    rows = sorted((r.key, r.near, r.doc, r.place) for r in docs.mapInArrow(passages._window_task(5, 5, 46, none), passages.WINDOWS).collect())
    wanted, key_first, run_first = set(), None, None
    for before, row in zip([None, *rows], rows):
        if before is None or before[0] != row[0]:
            key_first = run_first = row
            continue
        if before[1] != row[1]:
            run_first, tops = row, [(key_first, False), (before, False)]
        else:
            tops = [(run_first, True), (before, True)]
        for to, same in tops:
            if to[2] != row[2]:
                one, two = sorted([to[2:], row[2:]])
                spans = [v for _, p in (one, two) for v in (p >> 32, (p >> 32) + (p & 0xFFFFFFFF) - 1)]
                wanted.add((one[0], two[0], (1 << (row[0] & 15)) * (32769 if same else 1), *spans))
    for parts, least in ((1, 4), (7, 1), (60, 1), (60, 2), (60, 4)):
        at = np.linspace(0, len(rows), parts + 1)[1:-1].astype(int)
        cuts = passages.whole_runs([np.array([rows[i][c] for i in at], np.int64) for c in range(4)], least)
        made = docs.mapInArrow(passages._window_task(5, 5, 46, cuts), passages.WINDOWS)
        streamed = made.repartitionById(parts, "slot").sortWithinPartitions("key", "near", "doc", "place").select(
            "key", "near", "doc", "place").mapInArrow(passages._stream_task(cuts), passages.STREAMED).cache()
        assert {tuple(r) for r in passages._links(streamed).collect()} == wanted


def test_passages_of_frequent_lines(spark):
    texts = frequent_lines(random.Random(22), 400, 40)
    found = [{tuple(r) for r in passages.repeated_passages(frame(spark, texts).repartition(n)).collect()} for n in (2, 23)]
    assert found[0] == found[1]
    caught = {(r[3], r[0]) for r in found[0]}
    assert sum((1000 + 2 * k, 1001 + 2 * k) in caught for k in range(40)) >= 36


def alike_pairs(texts):
    """Pairs of documents that share a passage, by comparing all whole texts."""
    ids, column = zip(*[(i, t) for i, t in texts if t])
    made, at = passages.shingles(*passages.words(*passages.text_bytes(pa.array(column)))[:2], 5)
    rows = [made[at[n]:at[n + 1]] for n in range(len(ids))]
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if passages.common_passages(rows[a], rows[b], 5, 50, 0.75)}


def test_passages_of_documents_unlike_the_first_of_their_key(spark):
    rng = random.Random(31)
    line, texts = sentence(rng, 12, 10**6), []
    for k in range(8):  # the members of a family stand apart, and all families hold one line
        one, two = sentence(rng, 50, 10**6), sentence(rng, 50, 10**6)
        for n in range(4):
            texts.append((8 * n + k + 1, f"{sentence(rng, 20, 10**6)} {one} {line} {edited(rng, two, 1)} {sentence(rng, 20, 10**6)}"))
    texts = sorted(texts) + [(100 + i, t) for i, t in texts[:6]]
    wanted = {(a, b) for a, b in alike_pairs(texts) if b < 100}
    for most in (64, 8, 1):  # keys that are compared whole, and keys told apart by what stands around the line
        found = passages.repeated_passages(frame(spark, texts).repartition(3), most=most).collect()
        got = {(r.other_id, r.doc_id) for r in found}
        assert len(wanted) > 20 and (most == 1 or wanted <= got) and len(wanted - got) <= 2
        assert {(r.other_id, r.start, r.other_start, r.length == r.other_length, r.similarity) for r in found if r.doc_id == 100 + texts[0][0]} == {(texts[0][0], 0, 0, True, 1.0)}


def test_all_pairs_of_a_large_family_of_near_copies(spark):
    """More documents than a block compares at once, each unlike the first and its neighbours in places of its own."""
    rng = random.Random(37)
    base, line = sentence(rng, 150, 10**6), sentence(rng, 60, 10**6)
    texts = [(i, edited(rng, base, 4)) for i in range(90)]
    copies = [(200 + i, f"{sentence(rng, 30, 10**6)} {line} {sentence(rng, 30, 10**6)}") for i in range(80)]
    wanted = alike_pairs(texts)
    found = passages.repeated_passages(frame(spark, texts + copies).repartition(3), most=8).collect()
    got = {(r.other_id, r.doc_id) for r in found}
    assert len(wanted) > 1500 and len(wanted - got) <= 5
    # word for word the same, so one may stand for all
    assert any({(min(i, n), max(i, n)) for n in range(200, 280) if n != i} <= got for i in range(200, 280))


def test_tiles_hold_all_pairs():
    r = np.random.default_rng(5)
    flags = r.random((60, passages.BITS)) < 0.05
    flags[:, :60] = r.random((60, 60)) < 0.75
    bits, common = np.packbits(flags, axis=1).view(np.uint64), 40
    crowds = [[16], None, [17, 32]]  # the lowest bits say how a run lies to the minimum
    rows = [{"key": 16 * (n % 2) + 3, "doc": n, "place": n, "piece": n % 3, "bits": bits[n].tobytes(), "common": common, "crowds": crowds[n // 7 % 3]} for n in range(60)]
    wanted = sorted((x["doc"], y["doc"]) for x in rows for y in rows if x["key"] == y["key"] and x["doc"] < y["doc"]
                    and not set(x["crowds"] or []) & set(y["crowds"] or []) and (flags[x["doc"]] & flags[y["doc"]]).sum() >= common)
    tiles = [{**x, "lo": min(x["piece"], p), "hi": max(x["piece"], p)} for x in rows for p in range(3)]
    tiles.sort(key=lambda x: tuple(x[c] for c in ("key", "lo", "hi", "piece", "doc", "place")))
    schema = pa.schema([(c, pa.int64()) for c in ("key", "lo", "hi", "piece", "doc", "place", "common")] + [("bits", pa.binary()), ("crowds", pa.list_(pa.int64()))])
    for size in (7, 1000):
        batches = pa.Table.from_pylist(tiles, schema).to_batches(max_chunksize=size)
        got = sorted(tuple(sorted((x["doc"], x["other"]))) for b in passages._tile_task(iter(batches)) for x in b.to_pylist())
        assert 20 < len(wanted) < 700 and got == wanted


def test_pairs_of_small_keys():
    made = {(int(i), int(j)) for a, b in passages.all_pairs(np.array([0, 3, 4]), np.array([3, 1, 2])) for i, j in zip(a, b)}
    assert made == {(1, 0), (2, 1), (2, 0), (5, 4)}
    none = [np.zeros(0, np.int64)] * 4
    rows = [(1, 0, d, 9) for d in range(3)] + [(2, 0, 5, 9)] + [(3, d % 2, d, 9) for d in range(9)] + [(4, 0, 7, 9), (4, 0, 7, 9), (4, 0, 8, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + 4])], names=["key", "near", "doc", "place"]) for i in range(0, len(rows), 4)]
    parts = [(small, x[0].tolist()) for small, x in passages._by_size(iter(batches), none, 4)]
    assert sorted(k for small, keys in parts if small for k in keys) == [1, 1, 1, 4, 4]
    assert [k for small, keys in parts if not small for k in keys] == [3] * 9


def test_kept_with_columns_of_any_name(spark):
    from firmground.llm import exact_dedup, near_dedup

    docs = frame(spark, awkward())
    docs = docs.withColumns({c: docs["n"] for c in ("_stay_id", "_stay_turn", "_gone", "__Gone", "component_id")})
    for stage in (exact_dedup.kept, near_dedup.kept):
        got = stage(docs)
        assert got.columns == docs.columns and 0 < got.count() < docs.count()
        assert stage(docs.limit(0)).count() == 0


def test_edges_of_many_partitions():
    from firmground.llm import near_dedup

    rows = [{"part": p, "edge": e, "prefix": p // 2, "a": 10 * p + e, "hi": 0, "lo": 0} for p in range(20_000) for e in (0, 1)]
    assert near_dedup._edge_pairs(rows, 2) == [(20 * i + 1, 20 * i + 10, near_dedup.DEPTH) for i in range(10_000)]


def test_of_a_text_only_the_words_of_the_place_are_sent_on():
    texts = {7: " ".join(f"Wört{i}" for i in range(300)), 9: "\n".join(f"x{i}" for i in range(90))}
    places = [(7, 0, 45), (7, 100, 160), (7, 250, 295), (9, 3, 85)]  # the last shingle of a place has five words
    batch = pa.RecordBatch.from_pylist([{"b": n, "id_a": a, "la": la, "ra": ra, "lb": 1, "rb": 2, "a": a, "text": texts[a]} for n, (a, la, ra) in enumerate(places)])
    got = [r for b in passages._passage_task(5)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [r["passage"].split() for r in got] == [texts[a].split()[la:ra + 5] for a, la, ra in places]
    assert [(r["b"], r["id_a"], r["la"], r["ra"]) for r in got] == [(n, *p) for n, p in enumerate(places)]


def test_shuffle_files_of_a_kept_table_go_when_it_is_written(spark):
    files = lambda: set(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    work = passages.Workspace(spark, "tidy")
    before = files()
    kept = work.keep(spark.range(5000).repartition(7, "id"), "kept", tidy=True)
    deadline = time.time() + 20
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < deadline:
        time.sleep(0.2)
    assert not left and kept.count() == 5000
    work.drop("kept")
    with pytest.raises(Exception):
        kept.count()


def test_a_cut_before_a_block_leaves_it_whole():
    r = random.Random(8)
    line = " ".join(f"w{i}" for i in range(60))
    texts = [" ".join([*(f"a{r.random()}" for _ in range(40)), line, *(f"b{r.random()}" for _ in range(40))]) for _ in range(20)]
    made, bounds = passages.shingles(*passages.words(*passages.text_bytes(pa.array(texts)))[:2], 5)
    block, body, row, place = passages.blocks_of(made, bounds, 5, 50, np.full(1 << 10, 255, np.uint8), 0.75)
    values, sizes = np.unique(block, return_counts=True)
    shared = values[sizes > 5]
    assert len(shared)
    cuts = [np.array(c, np.int64) for c in zip(*((int(v), *passages.BEFORE[1:]) for v in shared))]
    slot = passages.slots_of([block, body, row, place], cuts)
    assert all(len(np.unique(slot[block == v])) == 1 for v in shared)


def test_a_text_goes_once_to_the_places_that_follow_it(spark):
    texts = {1: "one " * 50, 2: "two " * 60, 3: "three"}
    parts = {1: 3, 2: 1, 3: 0}
    bodies = spark.createDataFrame([(i, 10 * i, t, parts[i]) for i, t in texts.items()], "doc_id long, id long, text string, as_a int")
    spots = spark.createDataFrame([(1 + (n >= 2500), n, n, n + 1, 2, 3) for n in range(2503)], "a long, b long, la int, ra int, lb int, rb int")
    rows = passages._behind(bodies, spots, "a", "as_a")
    at = [sorted((r.a, r.part) for r in part if r.kind == 0) for part in rows.rdd.glom().collect()]
    assert sorted(sum(at, [])) == [(1, 0), (1, 1), (1, 2), (2, 0)]  # before, each of the 2,503 places came with its text
    assert rows.where("kind = 1 and text is not null").count() == 0
    table = rows.coalesce(1).toArrow()
    got = [(r["a"], r["b"], r["id_a"], t) for b in (7, 10_000) for batch, t_, which in passages._by_text(
        passages._beside(iter(table.to_batches(max_chunksize=b)), "a", "id_a"), "a") for r, t in zip(batch.to_pylist(), t_.take(pa.array(which)).to_pylist())]
    want = sorted((a, n, 10 * a, texts[a]) for n in range(2503) for a in [1 + (n >= 2500)])
    assert sorted(got[:2503]) == want and sorted(got[2503:]) == want


def test_places_without_repeated_shingles_are_compared_as_all_others():
    r = random.Random(4)
    found = 0
    for n in range(400):
        x = [r.getrandbits(63) for _ in range(r.choice([45, 60, 150, 400]))]
        rate = r.choice([0, 0.05, 0.15, 0.3])
        y = [r.getrandbits(63) if r.random() < rate else v for v in x[r.randrange(5):]]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(y))
            y[at:at] = [r.getrandbits(63) for _ in range(r.randrange(20))]
        if n % 4 == 0:  # moved within the drift
            at = r.randrange(len(y) - 10)
            y[at:at + 10] = y[at + 5:at + 10] + y[at:at + 5]
        repeated = [*y, *[r.getrandbits(63)] * 2]  # a foreign shingle that repeats, behind the rest
        x, y, repeated = (np.array(v, np.uint64) for v in (x, y, repeated))
        got = passages.common_passages(x, y, 5, 50, 0.75)
        assert got == passages.common_passages(x, repeated, 5, 50, 0.75)
        found += len(got)
    assert found > 200


def test_windows_of_deep_trees():
    rng = np.random.default_rng(3)
    rows = [np.full(1500, 7, np.uint64), rng.integers(0, 2**63, 1500).astype(np.uint64), rng.integers(0, 3, 700).astype(np.uint64) << np.uint64(40)]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in rows])])
    values = np.concatenate(rows)
    low = np.uint64((1 << int(len(values)).bit_length()) - 1)
    keyed = ((values & ~low) | np.arange(len(values), dtype=np.uint64)).tolist()
    want = set()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        todo = [(lo, hi)]
        while todo:
            s, e = todo.pop()
            if e - s >= 46:
                c = min(range(s, e), key=keyed.__getitem__)
                want.add((s, c, e - 1))
                todo += [(s, c), (c + 1, e)]
    got = list(zip(*(v.tolist() for v in passages.compact_windows(values, bounds, 46))))
    assert len(got) == len(want) and set(got) == want and len(want) > 1500

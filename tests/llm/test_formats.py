"""Packing round trip, edit-aware counts against full encoding, linked tool calls, and the pipeline."""
import json
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from fixtures import awkward, frame, sentence

import public_tokenizers

from firmground.llm import packing, token_counts, tool_calls

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = awkward() + [(100 + i, sentence(rng, rng.randrange(0, 900))) for i in range(40)] + [(900, "it's café İ <|endoftext|>x ΣΣ 42's　é \x1c \x85")]
    pieces = packing.pack(frame(spark, texts).repartition(3), WORD).cache()
    got = pieces.collect()
    plain = Tokenizer.from_file(WORD)
    want = sorted(repr((i, plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts)
    docs = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        if r.start == 0:
            docs.setdefault((r.doc_id, r.doc_tokens), []).append([])
        docs[r.doc_id, r.doc_tokens][-1].extend(ids)
    assert sorted(repr((i, ids)) for (i, _), many in docs.items() for ids in many) == want
    full = packing.sequences(pieces).collect()
    total = sum(r.length for r in got)
    assert sorted(r.sequence_id for r in full) == list(range(-(-total // 2048)))
    assert all(len(r.ids) == 4 * 2048 for r in full if (r.sequence_id + 1) * 2048 <= total)
    assert packing.pack(frame(spark, texts).limit(0), WORD).count() == 0


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    coder, plain, rng = packing.WordIds(WORD, most=500), Tokenizer.from_file(WORD), random.Random(3)
    assert coder.cut
    alphabet = [chr(c) for c in range(0x250)] + list("abcdefgh ABC'.,12 \n") * 20 + ["\u0301", "\u03a3", "\u4e2d", "'s", "'LL", "<|endoftext|>", "the", " and "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(400)]
    for i in range(0, len(texts), 50):
        ids, bounds, _ = coder.encode(pa.array(texts[i:i + 50]))
        got = [ids[bounds[k]:bounds[k + 1]].tolist() for k in range(50)]
        assert got == [e.ids for e in plain.encode_batch(texts[i:i + 50], add_special_tokens=False)]


def test_hilbert_visits_every_cell_by_neighbours():
    bits, dims = 3, 3
    axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = packing.hilbert(axes, bits)
    assert sorted(key) == list(range(len(axes)))
    path = axes[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_edits_against_full_encoding():
    counter = token_counts.Counter(BYTE)
    rng = random.Random(8)
    alphabet = ["a", "bc", " ", "  ", "\n", "'", "s", "re", "1", "23", "é", "中", "!", "...", "\t", " ", " the", "don't", "'ll", "\U0001f600"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))
        tree = token_counts.load(token_counts.build(text, counter).dump())
        for _ in range(6):
            n = len(text)
            edit = (rng.randrange(n + 1), rng.randrange(0, 30), "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 6))))
            want = text[:edit[0]] + edit[2] + text[edit[0] + edit[1]:]
            text, _ = token_counts.apply_edit(text, tree, *edit, counter)
            parts = counter.any.findall(text)
            assert text == want and tree.tokens == len(counter.encoding.encode_ordinary(text)) and counter.pattern(text).findall(text) == parts
            assert [s for leaf in tree.leaves() for s in leaf.sizes] == [len(p) for p in parts] and tree.chars == len(text)


def test_edit_touches_little():
    counter = token_counts.Counter(BYTE)
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = token_counts.build(text, counter)
    _, encoded = token_counts.apply_edit(text, tree, len(text) // 2, 3, "xyz", counter)
    assert encoded < 10


def depth(tree):
    todo, most = [(tree, 1)], 0
    while todo:
        node, d = todo.pop()
        most = max(most, d)
        if node.left is not None:
            todo += [(node.left, d + 1), (node.right, d + 1)]
    return most


def test_many_edits_at_one_place_keep_the_tree_flat():
    counter, rng = token_counts.Counter(BYTE), random.Random(6)
    text = "start " + " ".join(f"w{i}" for i in range(300))
    tree = token_counts.build(text, counter)
    for place in ("end", "start", "middle"):
        for _ in range(10_000 if place == "end" else 2_000):
            at = {"end": len(text), "start": 0, "middle": len(text) // 2}[place]
            text, _ = token_counts.apply_edit(text, tree, at, 0, f" word{rng.randrange(1000)}", counter)
    assert depth(tree) < 40 and tree.tokens == len(counter.encoding.encode_ordinary(text)) and tree.chars == len(text)
    for _ in range(10_000):
        text, _ = token_counts.apply_edit(text, tree, len(text) // 3, 9, "", counter)
    assert depth(tree) < 40 and tree.tokens == len(counter.encoding.encode_ordinary(text)) and tree.chars == len(text)
    while text:
        text, _ = token_counts.apply_edit(text, tree, 0, 400, "", counter)
    assert depth(tree) == 1 and tree.tokens == tree.items == 0


def test_patterns_agree():
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x250)] + list(" '\n\tsmd12ab") * 40
    own, public = regex.compile(token_counts.PATTERN), regex.compile(public_tokenizers.PATTERN.replace(r"\s", f"[{token_counts._WHITE}]").replace(r"\S", f"[^{token_counts._WHITE}]").replace(
        f"[^[{token_counts._WHITE}]", f"[^{token_counts._WHITE}"))
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(100))
        assert own.findall(text) == token_counts.LATIN.findall(text) == public.findall(text)


def test_counts_on_spark(spark):
    texts = awkward()
    docs = frame(spark, texts)
    edits = spark.createDataFrame([(1, 1, 0, 3, "abc"), (1, 2, 5, 0, None), (9, 1, 10**9, 5, "end"), (8, 1, None, None, "x")], "doc_id long, seq int, start long, length long, replacement string")
    trees = token_counts.count_trees(token_counts.with_edits(docs, edits), BYTE, keep=["edits"])
    got = token_counts.edited_counts(trees, BYTE).collect()
    counter = token_counts.Counter(BYTE)
    assert len(got) == len(texts)
    assert all(r.n_tokens == token_counts.build(r.text, counter).tokens for r in got)
    assert {r.doc_id for r in got if r.encoded} == {1, 8, 9}
    assert token_counts.edited_counts(trees.limit(0), BYTE).count() == 0


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "add", '{"y": 2, "x" : 1}', []), (1, "b", 2, "add", '{"x":1,"y":"2"}', ["a"]), (1, "c", 4, "add", '{"x":1}', ["a", "b", "zz"]),
        (1, "d", 6, "add", "no json", ["c"]), (1, "p", 1, "add", '{"x":1,"y":2}', ["q"]), (1, "q", 3, "add", '{"x":1,"y":2}', ["p"]), (1, "r", 3, "add", '{"x":1,"y":2}', ["q"]),
        (2, "a", 0, "note", '{"z":{"b":1,"a":[1, 2]},"extra":null}', None), (2, "e", 1, "gone", "{}", []), (2, "a", 5, "note", "{}", []), (None, "n", 0, "add", '{"x":1,"y":2}', []),
        (3, "s", 0, "add", None, ["s"]), (4, "only", 0, "add", '{"x":1.5,"y":2}', []),
    ]
    results = [(1, "a", 1, 'line "one"\né'), (1, "b", 3, None), (1, "c", 5, "x"), (2, "lost", 9, "y"), (1, "a", 0, "early"), (None, None, 0, "z"), (4, "only", 1, "")]
    schemas = [("add", "x", "number", True), ("add", "y", "integer", True), ("note", "z", "object", True)]
    got = tool_calls.linked_calls(
        spark.createDataFrame(calls, CALLS).withColumn("layer", tool_calls.F.lit(9)), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        spark.createDataFrame(schemas, "name string, field string, type string, required boolean"))
    rows = {(r.conv_id, r.call_id): r for r in got.collect()}
    state = {k: (r.layer, r.status, r.problems) for k, r in rows.items()}
    assert state[1, "a"] == (0, "ok", []) and state[1, "b"] == (1, "invalid", ["wrong type y"]) and state[1, "c"] == (2, "invalid", ["missing y"])
    assert state[1, "d"] == (3, "invalid", ["not an object"])
    assert state[1, "p"][:2] == state[1, "q"][:2] == state[1, "r"][:2] == (None, "cycle") and state[3, "s"][1] == "cycle"
    assert state[2, "a"] == (0, "invalid", ["unexpected extra"]) and state[2, "e"] == (0, "invalid", ["unknown tool"])
    assert state[2, "lost"][1] == "orphan" and state[None, None][1] == "orphan" and state[None, "n"][1] == "unanswered" and state[4, "only"] == (0, "ok", [])
    assert json.loads(rows[1, "a"].line) == {"arguments": {"x": 1, "y": 2}, "content": "early", "id": "a", "name": "add", "order": 0}
    assert rows[2, "a"].line == '{"arguments":{"extra":null,"z":{"a":[1,2],"b":1}},"content":null,"id":"a","name":"note","order":0}'
    assert json.loads(rows[1, "d"].line)["arguments"] == "no json"
    empty = spark.createDataFrame([], CALLS)
    assert tool_calls.linked_calls(empty, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"),
                                   spark.createDataFrame(schemas, "name string, field string, type string, required boolean")).count() == 0


def test_turns_of_all_roles_and_whole_conversations(spark):
    turns = [(1, 0, "system", "rules")] + [(1, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(1, 13)] + [(1, 13, "tool", None), (2, 0, None, "who"), (None, 0, "note", "x")]
    talks = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.from_turns(talks)
    got = tool_calls.linked_calls(calls, results, tool_calls.reply_schemas(spark), tool_calls.other_turns(talks)).collect()
    assert {r.turn: (r.layer, r.status) for r in got if r.status != "message"} == {n: (n // 2, "ok") for n in range(1, 13, 2)}
    lines = {(r.conv_id, r.turn): r.line for r in got if r.status == "message"}
    assert lines == {k: json.dumps({"arguments": None, "content": t, "id": None, "name": n, "order": None}, separators=(",", ":"))
                     for k, n, t in (((1, 0), "system", "rules"), ((1, 13), "tool", None), ((2, 0), None, "who"), ((None, 0), "note", "x"))}
    told = [t for r in got for t in (json.loads(r.line)["content"], (json.loads(r.line)["arguments"] or {}).get("prompt")) if t]
    assert sorted(told) == sorted(t[3] for t in turns if t[3])  # every text is in one line
    short = tool_calls.from_turns(talks, run=8)[0].collect()
    assert {r.turn for r in short if r.needs} == {3, 5, 7, 11}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_line_dedup", "op5_tool_call_linking"])
def test_queries_against_sql(spark, name):
    from firmground.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

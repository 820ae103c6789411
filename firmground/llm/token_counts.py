"""Token counts that follow edits.

A byte-level tokenizer counts each pre-token by itself, so a document's count is a sum over its pre-tokens. A segment tree
keeps it: leaves hold the lengths and counts of some pre-tokens, inner nodes the sums below. An edit re-splits the text only
from the first pre-token whose end it may move to the place where the old and the new boundaries agree again, encodes those
pre-tokens, splices them into the leaves and updates the sums on the way up.

A pre-token is decided by its own characters and at most two that follow its last one; that is the boundary context.
"""
from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import per_worker, slices

LEAF = 64
CONTEXT = 1
# Fixed value: white space as this kind of tokenizer knows it.
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# The same pattern for text without characters beyond Latin: letters and numbers are spelled out.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_ONLY = re.compile(r"[\x00-\u024f]*")
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_WHITE}{_L}{_N}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
EDITS = "array<struct<start: long, length: long, replacement: string>>"


class Counter:
    """Token counts of pre-tokens, each distinct one encoded once while it is remembered.

    ``path`` names a file of merge ranks. Latin text is cut by an equal pattern of the standard library, which is faster.
    """

    def __init__(self, path: str, most: int = 700_000):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.any, self.most, self.known = regex.compile(PATTERN), most, {}

    def pattern(self, text: str):
        return LATIN if text.isascii() or LATIN_ONLY.fullmatch(text) else self.any

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known = {}
        known, encode = self.known, self.encoding.encode_ordinary
        for p in [p for p in set(parts) if p not in known]:
            known[p] = len(encode(p))
        return list(map(known.__getitem__, parts))


class Node:
    """A leaf with the lengths and counts of its pre-tokens, or an inner node with two children; both know their sums."""

    __slots__ = ("left", "right", "sizes", "counts", "items", "chars", "tokens")

    def __init__(self, sizes: list[int], counts: list[int]):
        self.left = self.right = None
        self.sizes, self.counts = sizes, counts
        self._settle()

    def _settle(self):
        """Split a leaf that has grown too large, rebuild a subtree that leans or has shrunk to a leaf, and add up. A side never
        has much over three quarters of the pre-tokens, so the depth stays logarithmic whatever the edits are."""
        if self.left is not None:
            items = self.left.items + self.right.items
            if items <= LEAF or max(self.left.items, self.right.items) > 0.75 * items + 2 * LEAF:
                leaves = list(self.leaves())
                self.sizes, self.counts = ([x for n in leaves for x in getattr(n, c)] for c in ("sizes", "counts"))
                self.left = self.right = None
        if self.left is None and len(self.sizes) > 2 * LEAF:
            half = len(self.sizes) // 2
            self.left, self.right = Node(self.sizes[:half], self.counts[:half]), Node(self.sizes[half:], self.counts[half:])
            self.sizes = self.counts = None
        if self.left is None:
            self.items, self.chars, self.tokens = len(self.sizes), sum(self.sizes), sum(self.counts)
        else:
            self.items, self.chars, self.tokens = (getattr(self.left, c) + getattr(self.right, c) for c in ("items", "chars", "tokens"))

    def boundary(self, at: int) -> int:
        """Start of the pre-token that holds character ``at``; the end of the text for a place beyond it."""
        node, base = self, 0
        while node.left is not None:
            if at - base < node.left.chars:
                node = node.left
            else:
                base += node.left.chars
                node = node.right
        for size in node.sizes:
            if at < base + size:
                break
            base += size
        return base

    def splice(self, lo: int, hi: int, sizes: list[int], counts: list[int]):
        """Replace the pre-tokens of characters lo..hi, which are boundaries, and update the sums up to here."""
        if self.left is None:
            base, i = 0, 0
            while i < len(self.sizes) and base < lo:
                base += self.sizes[i]
                i += 1
            j = i
            while j < len(self.sizes) and base < hi:
                base += self.sizes[j]
                j += 1
            self.sizes[i:j], self.counts[i:j] = sizes, counts
        else:
            cut = self.left.chars
            if hi <= cut:
                self.left.splice(lo, hi, sizes, counts)
            elif lo >= cut:
                self.right.splice(lo - cut, hi - cut, sizes, counts)
            else:
                self.left.splice(lo, cut, sizes, counts)
                self.right.splice(0, hi - cut, [], [])
        self._settle()

    def leaves(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node
            else:
                todo += [node.right, node.left]

    def dump(self) -> bytes:
        """All leaves as numbers of the smallest width that holds them; the inner sums follow from them."""
        leaves = list(self.leaves())
        flat = np.array([list(chain.from_iterable(n.sizes for n in leaves)), list(chain.from_iterable(n.counts for n in leaves))], np.int64)
        kind = np.uint8 if flat.size == 0 or flat.max() < 256 else np.uint32
        return bytes([np.dtype(kind).itemsize]) + zlib.compress(flat.astype(kind).tobytes(), 1)


def load(packed: bytes) -> Node:
    flat = np.frombuffer(zlib.decompress(packed[1:]), np.uint8 if packed[0] == 1 else np.uint32).reshape(2, -1)
    return Node(flat[0].tolist(), flat[1].tolist())


def build(text: str, counter: Counter) -> Node:
    parts = counter.pattern(text).findall(text)
    return Node(list(map(len, parts)), counter.counts(parts))


def apply_edit(text: str, tree: Node, start: int, length: int, replacement: str, counter: Counter) -> tuple[str, int]:
    """The edited text and the number of pre-tokens encoded for it; the tree is updated in place.

    ``start`` and ``length`` are cut to the text.
    """
    start = min(max(start, 0), len(text))
    stop = min(start + max(length, 0), len(text))
    after = text[:start] + replacement + text[stop:]
    # pre-tokens that end at start - CONTEXT - 1 or before cannot change
    lo = tree.boundary(max(start - CONTEXT - 1, 0)) if start else 0
    shift, edge = len(after) - len(text), start + len(replacement)
    at, parts, hi = lo, [], len(text)
    pattern = counter.pattern(after)
    while at < len(after):
        if at >= edge and tree.boundary(at - shift) == at - shift:
            hi = at - shift
            break
        match = pattern.match(after, at)
        parts.append(match[0])
        at = match.end()
    tree.splice(lo, hi, [len(p) for p in parts], counter.counts(parts))
    return after, len(parts)


def _build_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("counter", path), lambda: Counter(path))
        for batch in slices(batches, "text"):
            trees = [build(t or "", counter) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())],
                                             names=[*batch.schema.names, "n_tokens", "tree"])

    return run


def _edit_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("counter", path), lambda: Counter(path))
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text, packed, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits"))):
                text, tree, encoded = text or "", load(packed), 0
                for e in edits or []:
                    text, n = apply_edit(text, tree, e["start"] or 0, e["length"] or 0, e["replacement"] or "", counter)
                    encoded += n
                for col, value in zip(out, (text, tree.tokens, encoded, tree.dump())):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0]), batch.column("n_tokens"), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["doc_id", "text", "tokens_before", "n_tokens", "encoded", "tree"])

    return run


def count_trees(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, text, (keep…), n_tokens, tree`` of every document. Null and empty texts have no tokens; repeated and null ids
    are counted row by row; an empty table gives an empty result. Write the result to keep the trees."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(keep or []))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(_build_task(tokenizer), f"doc_id long, text string{extra}, n_tokens long, tree binary")


def edited_counts(trees: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """``doc_id, text, tokens_before, n_tokens, encoded, tree`` after the edits of each row.

    ``edits`` is a column of ``EDITS``, applied one after another; each counts characters in the text as it then is. Places
    beyond the text are cut to it, and null parts of an edit count as 0 or empty. A null or empty list leaves a row as it
    is. ``encoded`` is the number of pre-tokens that had to be encoded.
    """
    return trees.select("doc_id", "text", "n_tokens", "tree", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(
        _edit_task(tokenizer), "doc_id long, text string, tokens_before long, n_tokens long, encoded long, tree binary")


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents with their edits from a table ``(doc_id, seq, start, length, replacement)``, in the order of ``seq``."""
    lists = edits.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("e")).select(
        doc_id, F.transform("e", lambda x: F.struct(x["start"].cast("long").alias("start"), x["length"].cast("long").alias("length"), x["replacement"].alias("replacement"))).alias("edits"))
    return docs.join(lists, doc_id, "left")

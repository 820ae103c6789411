"""Byte-level BPE: token ids of whole texts with character offsets, and back.

A rank file lists byte strings by merge rank. Byte-level vocabularies name each byte by a printable character; under those
names the ranks become a vocabulary and a merge list for the tokenizers library: every pair of tokens whose bytes together
are a token may merge, in the order of the result's rank. Each match of the public pattern is encoded by itself. Texts come
in Arrow batches; a batch's distinct pre-tokens go to the library once, and its ids and offsets are laid out by position.

A token may end inside a character. Its offsets then span that whole character, so the next token's start lies before its
end. Decoding looks the bytes of each id up and joins bytes, never characters, so split characters come back whole; where a
piece of a document is cut inside one, the bytes that belong to a neighbour are told apart from the text between.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from firmground.llm.store import per_worker, ragged, slices
from firmground.llm.token_counts import LATIN, LATIN_ONLY, PATTERN


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Ids and offsets of pre-tokens; what it remembers, up to ``most`` characters, changes no result."""

    def __init__(self, path: str, most: int = 1_500_000):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, named = read_ranks(path), byte_names()
        name = {token: "".join(named[b] for b in token) for token in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.any, self.most = regex.compile(PATTERN), most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.ids, self.spans, self.bounds = 0, np.zeros(0, np.uint32), np.zeros((2, 0), np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        found = self.library.encode_batch(parts, add_special_tokens=False)
        lengths = np.array([len(e) for e in found])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, lengths.sum())])
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * lengths.sum())
        self.spans = np.concatenate([self.spans, spans.reshape(-1, 2).T], axis=1)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
        self.size += sum(map(len, parts))

    def encode(self, texts: list[str]):
        """``(ids, bounds, starts, ends)``: tokens of text i are ``bounds[i]:bounds[i + 1]``, with the characters they touch."""
        cut = [(LATIN if t.isascii() or LATIN_ONLY.fullmatch(t) else self.any).findall(t) for t in texts]
        parts = list(chain.from_iterable(cut))
        if self.size > self.most:
            self._forget()
        new = [p for p in set(parts) if p not in self.known]
        for at in range(0, len(new), 2000):
            self._learn(new[at:at + 2000])
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        per_text = np.array([len(c) for c in cut], np.int64)
        firsts = np.cumsum(sizes) - sizes
        of_text = np.cumsum(per_text) - per_text
        firsts = firsts - np.repeat(firsts[np.minimum(of_text, max(len(parts) - 1, 0))] if len(parts) else of_text, per_text)
        lengths = self.bounds[at + 1] - self.bounds[at]
        place = ragged(self.bounds[at], lengths)
        first = np.repeat(firsts, lengths)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        bounds = upto[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[place], bounds, first + self.spans[0, place], first + self.spans[1, place]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows ``data[bounds[i]:bounds[i + 1]]`` as bytes."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _encode_task(path: str, keep: list[str], text: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(("byte coder", path), lambda: Coder(path))
        for batch in slices(batches, text, 1 << 20):
            ids, bounds, starts, ends = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            again = np.zeros(len(ids) + 1, np.int64)
            again[2:] = np.cumsum(starts[1:] < ends[:-1]) if len(ids) else 0
            lengths = np.diff(bounds)
            split = np.where(lengths > 0, again[bounds[1:]] - again[np.minimum(bounds[:-1] + 1, len(ids))], 0)
            out = [pa.array(lengths), _binary(ids.astype("<u4"), bounds), pa.array(split)]
            if offsets:
                out += [_binary(x.astype("<u4"), bounds) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + out, names=[*keep, *ENCODED[:len(out)]])

    return run


ENCODED = ["n_tokens", "ids", "n_split", "starts", "ends"]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = True) -> DataFrame:
    """Token ids of every whole text by the rank file ``path``, without special tokens.

    Returns the columns ``keep``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``n_split`` (tokens that begin
    inside a character) and, with ``offsets``, ``starts`` and ``ends``: for each token, in the form of ids, the characters it
    touches. A null or empty text has no tokens. Very long texts and pre-tokens are encoded whole. Repeated rows and ids give
    a row each, an empty table none; columns not kept, of whatever name, are ignored, and a kept one may not bear a name
    of the result's.
    """
    if clash := set(keep) & set(ENCODED):
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    source = docs.select(*keep, *([] if text in keep else [text]))
    types = [T.LongType(), T.BinaryType(), T.LongType(), T.BinaryType(), T.BinaryType()][:5 if offsets else 3]
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(ENCODED, types)])
    return source.mapInArrow(_encode_task(path, list(keep), text, offsets), schema)


class Table:
    """The bytes of each id."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = {r: t for t, r in ranks.items()}
        self.data = np.frombuffer(b"".join(tokens[r] for r in sorted(tokens)), np.uint8)
        self.lengths = np.zeros(max(tokens) + 2, np.int64)  # the last one is for ids without a token
        self.lengths[sorted(tokens)] = [len(tokens[r]) for r in sorted(tokens)]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, bounds: np.ndarray):
        """``(bytes, bounds)`` of the rows."""
        ids = np.minimum(ids, len(self.lengths) - 1)
        lengths = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.data[ragged(self.starts[ids], lengths)], upto[bounds]


def _decode_task(path: str, keep: list[str], ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(("byte table", path), lambda: Table(path))
        for batch in slices(batches, ids):
            column = batch.column(ids).fill_null(b"").cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            held = column.buffers()[2]
            held = np.frombuffer(held, np.uint8)[at[0]:at[-1]] if held is not None else np.zeros(0, np.uint8)
            data, bounds = table.decode(np.frombuffer(held.tobytes(), "<u4").astype(np.int64), (at - at[0]) // 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _binary(data, bounds)], names=[*keep, "data"])

    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``data``, the bytes of each row's ids (null ids: none; ids without a token give no bytes)."""
    if "data" in keep:
        raise ValueError("a column to keep is named like the result: data")
    source = encoded.select(*keep, *([] if ids in keep else [ids]))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("data", T.BinaryType())])
    return source.mapInArrow(_decode_task(path, list(keep), ids), schema)


def whole_characters(decoded: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``head``, ``text`` and ``tail``: bytes that end a character begun in an earlier piece, the whole characters (bytes
    that are no UTF-8 count as U+FFFD), and the bytes of a character that ends in a later piece."""
    x, n = F.col(data), F.length(data)
    byte = lambda at: F.conv(F.hex(F.substring(x, at, F.lit(1))), 16, 10).cast("int")
    inner = lambda at: F.coalesce(byte(at).between(128, 191), F.lit(False))
    lead = F.when(~inner(F.lit(1)), 0).when(~inner(F.lit(2)), 1).when(~inner(F.lit(3)), 2).otherwise(3)
    open_ = F.lit(0)
    for back, least in ((3, 240), (2, 224), (1, 192)):  # a first byte so far from the end that its character has more bytes
        open_ = F.when((n >= back) & (byte(n - back + 1) >= least), back).otherwise(open_)
    lead, tail = F.least(lead, n), F.coalesce(open_, F.lit(0))
    tail = F.when(lead + tail > n, 0).otherwise(tail)
    return decoded.withColumns({
        "head": F.substring(x, F.lit(1), lead), "tail": F.substring(x, n - tail + 1, tail),
        "text": F.make_valid_utf8(F.substring(x, lead + 1, n - lead - tail).cast("string"))})


def decode_pieces(pieces: DataFrame, path: str, doc_id: str = "doc_id", start: str = "start", ids: str = "ids") -> DataFrame:
    """``doc_id, data, text``: pieces of a document (rows of one id, ordered by ``start``) decoded as one, so that characters
    split between pieces come back whole. One document's pieces meet in one row."""
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(start).alias("start"), F.hex(ids).alias("part")))), lambda x: x["part"]), "")
    joined = pieces.groupBy(F.col(doc_id).alias("doc_id")).agg(F.unhex(hexed).alias("ids"))
    return decode(joined, path).withColumn("text", F.make_valid_utf8(F.col("data").cast("string")))

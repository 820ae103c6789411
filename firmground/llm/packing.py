"""Packing of documents into full token sequences along a space-filling curve.

Each document's token counts are hashed to a signed vector, which a fixed random projection takes to four dimensions. The
dimensions, scaled by their spread over the corpus, become a Hilbert key, so documents near in content are near in
order. The documents are range-sorted by key and laid end to end; every 2048 tokens the line is cut. Only the last sequence
has padding. What is sorted are lengths; the tokens are shuffled once, to meet their places.
"""
from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import Workspace, per_worker, ragged, slices
from firmground.llm.words import mix

END = 1
DIMENSIONS, BITS, FEATURES = 4, 8, 64
# Fixed value: the pre-tokens of such a tokenizer within lower-cased Latin text.
_LATIN = re.compile(r"[\x00-\u017f]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
                    r"[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+")
_PROBE = ["Hello,World's", "it've'LL", "x2y\xb2\xbd", "\xc9t\xe9-\xfc", "e\u0301", "\xd7\xf7!?", "a_b", "\u0130'd", "12.5%"]
TOKENS = "row long, doc_id long, n long, c0 double, c1 double, c2 double, c3 double, ids binary"
PLACED = "part int, row long, doc_id long, n long, before long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(vocabulary: int) -> np.ndarray:
    """Per token: its signed hashed feature, projected to ``DIMENSIONS`` numbers."""
    rng = np.random.default_rng(31)
    down = rng.normal(size=(FEATURES, DIMENSIONS)).astype(np.float32)
    code = mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(99))
    sign = np.where(code >> np.uint64(63), 1, -1).astype(np.float32)
    return down[(code % np.uint64(FEATURES)).astype(np.int64)] * sign[:, None]


class WordIds:
    """Token ids of texts, each distinct word encoded once while it is remembered.

    White space separates pre-tokens and is itself dropped by this kind of tokenizer, so a text's ids are those of its
    words one after another. Latin words are cut into pre-tokens first, which many words share; a probe at the start makes
    sure that this changes no id, else words are encoded whole. ``most`` words and twice as many pre-tokens are remembered,
    then all are forgotten.
    """

    def __init__(self, path: str, most: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.table = projection(max(self.tokenizer.get_vocab_size(), END + 1))
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.pieces = True, {}  # pre-token to ids
        plain = [e.ids for e in self.tokenizer.encode_batch(_PROBE, add_special_tokens=False)]
        self.cut = [np.frombuffer(x, np.uint32).tolist() for x in self._ids(_PROBE)] == plain
        self._forget()

    def _pieces_of(self, word: str) -> list[str] | None:
        if not self.cut or not _LATIN.fullmatch(word) or any(x in word for x in self.special):
            return None
        return _PIECE.findall(word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower())

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as unsigned 32-bit numbers."""
        if len(self.pieces) > 2 * self.most:
            self.pieces = {}
        cut = [self._pieces_of(w) for w in words]
        fresh = list({p for ps in cut if ps for p in ps if p not in self.pieces})
        if fresh:  # a pre-token ends where an id says so; many in one text spare the calls
            lines = [" ".join(fresh[i:i + 50]) for i in range(0, len(fresh), 50)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(fresh) and ends[-1] == len(ids):
                at, raw = [0, *(4 * ends).tolist()], ids.tobytes()
                self.pieces.update((p, raw[at[k]:at[k + 1]]) for k, p in enumerate(fresh))
            else:
                each = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
                self.pieces.update((p, np.array(e.ids, np.uint32).tobytes()) for p, e in zip(fresh, each))
        whole = [w for w, ps in zip(words, cut) if ps is None]
        direct = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        get = self.pieces.__getitem__
        return [np.array(next(direct).ids, np.uint32).tobytes() if ps is None else b"".join(map(get, ps)) for ps in cut]

    def _forget(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.coords = np.zeros((1 << 14, DIMENSIONS), np.float32)
        self.used = 0

    def _learn(self, fresh: list[str]):
        found = self._ids(fresh)
        sizes = np.array([len(x) for x in found]) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        base, top = len(self.known), self.used + len(flat)
        while top > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(fresh) > len(self.starts):
            self.starts, self.lengths, self.coords = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.coords))
        at = np.cumsum(sizes) - sizes
        self.ids[self.used:top] = flat
        self.starts[base:base + len(fresh)] = at + self.used
        self.lengths[base:base + len(fresh)] = sizes
        owner = np.repeat(np.arange(len(fresh)), sizes)
        for k in range(DIMENSIONS):
            self.coords[base:base + len(fresh), k] = np.bincount(owner, self.table[flat, k], len(fresh))
        self.known.update(zip(fresh, range(base, base + len(fresh))))
        self.used = top

    def encode(self, texts: pa.Array):
        """``(ids, bounds, coordinate sums)`` of the texts, without the closing id."""
        if len(self.known) > self.most:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        fresh = [w for w in names if w not in self.known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        which = place[flat.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(texts)), counts)
        sizes = self.lengths[which]
        ids = self.ids[ragged(self.starts[which], sizes)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, len(texts)).astype(np.int64))])
        sums = np.stack([np.bincount(row, self.coords[which, k], len(texts)) for k in range(DIMENSIONS)], axis=1)
        return ids, bounds, sums


def _token_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base, rows = per_worker(("word ids", path), lambda: WordIds(path)), TaskContext.get().partitionId() << 33, 0
        kind = np.uint16 if coder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in slices(batches, "text"):
            ids, bounds, sums = coder.encode(batch.column("text"))
            n = np.diff(bounds)
            short = ids.astype(kind)
            bodies = [short[bounds[i]:bounds[i + 1]].tobytes() for i in range(len(n))]
            coords = sums / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(base + rows, base + rows + len(n))), batch.column("doc_id"), pa.array(n + 1)]
                + [pa.array(coords[:, k]) for k in range(DIMENSIONS)] + [pa.array(bodies, pa.binary())],
                names=[x.split()[0] for x in TOKENS.split(", ")])
            rows += len(n)

    return run


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with whole coordinates of ``bits`` bits, one row each."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell to the finest
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _key_task(centre: list[float], spread: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(DIMENSIONS)], axis=1)
            cells = np.clip(((points - centre) / spread + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(cells, BITS)), *(batch.column(c) for c in ("doc_id", "row", "n"))],
                                             names=["key", "doc_id", "row", "n"])

    return run


def _place_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each document within its partition of the sorted order."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        ends = np.cumsum(n) + total
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), *(batch.column(c) for c in ("row", "doc_id", "n")),
                                          pa.array(ends - n)], names=["part", "row", "doc_id", "n", "before"])
        total = int(ends[-1]) if len(n) else total


def _piece_task(size: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1 << 20):
            out: list[list] = [[] for _ in range(8)]
            for doc, n, at, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "at", "ids"))):
                ids = np.append(np.frombuffer(body, np.uint32 if wide else np.uint16).astype("<u4"), np.uint32(END)).astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % size
                    length = min(size - offset, n - start)
                    piece = ids[start:start + length].tobytes()
                    for col, value in zip(out, (doc, start, length, zlib.crc32(piece), n, (at + start) // size, offset, piece)):
                        col.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:-1]] + [pa.array(out[-1], pa.binary())],
                                             names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Every document gives its token ids and then id 1. Sequences hold ``size`` ids, the last one fewer. ``ids`` are
    little-endian unsigned 32-bit numbers; see :func:`sequences`. A null or empty text is the closing id alone. Documents
    are ordered by Hilbert key, then id (null first), then the row's place in the input, so repeated rows and ids are
    packed one by one. Other columns are ignored; an empty table gives an empty result.

    ``tokenizer`` is the path of a tokenizer file, the same on all hosts, of a kind that drops white space.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = work.keep(source.mapInArrow(_token_task(tokenizer), TOKENS), "tokens")
    names = [f"c{k}" for k in range(DIMENSIONS)]
    spread = tokens.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
                        F.max(F.try_divide(F.length("ids"), F.col("n") - 1)).alias("width")).first()
    centre = [spread[f"m_{c}"] or 0.0 for c in names]
    scale = [spread[f"s_{c}"] or 1.0 for c in names]
    keyed = work.keep(tokens.select("row", "doc_id", "n", *names).mapInArrow(
        _key_task(centre, scale), "key long, doc_id long, row long, n long"), "keys")
    order = ["key", "doc_id", "row"]
    placed = work.keep(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_place_task, PLACED), "placed")
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a number per partition
    first, starts = 0, []
    for r in totals:
        starts.append((r["part"], first))
        first += r["n"]
    starts = spark.createDataFrame(starts, "part int, first long")
    at = placed.join(F.broadcast(starts), "part").select("row", (F.col("first") + F.col("before")).alias("at"))
    return tokens.select("row", "doc_id", "n", "ids").join(at, "row").select("doc_id", "n", "at", "ids").mapInArrow(
        _piece_task(size, spread["width"] == 4), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of :func:`pack` joined to sequences of bounded length."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"))

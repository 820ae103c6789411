"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay. The network, written in numpy and trained on windows labelled by those
spans and on altered copies of them, adds spans the patterns miss: numbers without the plus sign, other separators, spelled-out
at-signs. Texts are cut into overlapping windows; each character takes its tag from the window in whose middle half it lies,
and spans are read from the tags of the whole text, so a window border neither splits nor doubles one.

Every span of these kinds holds a digit, an at-sign or a bracketed "at"; a window without any is all "outside" by that fact and
is not decoded.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import slices

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The look-behind only spares restarts inside a run of digits, where no match can begin.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)

WINDOW, STRIDE = 64, 32
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SYMBOLS = 100


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip_ok(text: str) -> bool:
    # leading zeros do not matter; a long part never becomes a long integer
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at-sign outwards, which is linear; the local part begins where its characters, or the last match, do."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each pattern that pass their check, by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _HINT.search(text):
        return out
    out["email"] = list(_emails(text))
    out["ip"] = [m.span() for m in _IP.finditer(text) if _ip_ok(m[0])]
    out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the network ------------------------------------------------------------------------------------------------------


def encode(text: str) -> np.ndarray:
    """Symbols 0..94 are the printable ASCII characters, then white space, other letters, other characters; 99 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((points >= 32) & (points < 127), points - 32, 97)
    out[(points >= 9) & (points <= 13)] = 95
    out[points >= 192] = 96
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding folded into the input weights, one LSTM each way, a linear layer and a linear-chain CRF."""

    def __init__(self, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) * 0.2).astype(np.float32)
        self.hidden = hidden
        self.p = {f"{n}{d}": x for d in "fb" for n, x in (("x", f(SYMBOLS, 4 * hidden)), ("h", f(hidden, 4 * hidden)))}
        for d in "fb":
            self.p[f"x{d}"][:, hidden:2 * hidden] += 1  # forget gates open at first
        self.p |= {"out": f(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32),
                   "first": np.zeros(TAGS, np.float32)}

    def _run(self, codes: np.ndarray, d: str, keep: bool):
        """States over time of one direction; codes are (time, row)."""
        h, (steps, rows) = self.hidden, codes.shape
        x, u = self.p[f"x{d}"], self.p[f"h{d}"]
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        states, saved = np.zeros((steps, rows, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = x[codes[t]] + state @ u
            g = _sigmoid(gates[:, :3 * h])
            i, f, o = g[:, :h], g[:, h:2 * h], g[:, 2 * h:]
            new = np.tanh(gates[:, 3 * h:])
            before, last = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            states[t] = state
            if keep:
                saved.append((t, i, f, o, new, before, squashed, last))
        return states, saved

    def emissions(self, codes: np.ndarray, keep: bool = False):
        forward, a = self._run(codes, "f", keep)
        backward, b = self._run(codes, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, a, b)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags, (row, time), of (row, time) codes."""
        e, _ = self.emissions(codes.T)
        score, back = e[0] + self.p["first"], []
        for t in range(1, len(e)):
            paths = score[:, :, None] + self.p["move"]
            back.append(paths.argmax(axis=1))
            score = paths.max(axis=1) + e[t]
        tags = [score.argmax(axis=1)]
        rows = np.arange(len(tags[0]))
        for b in reversed(back):
            tags.append(b[rows, tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def gradients(self, codes: np.ndarray, tags: np.ndarray):
        """Loss per row and its gradients; both inputs are (time, row)."""
        e, (both, *runs) = self.emissions(codes, True)
        e = e.astype(np.float64)
        move, first = self.p["move"].astype(np.float64), self.p["first"].astype(np.float64)
        steps, rows, _ = e.shape
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        each = np.arange(rows)
        marginal = np.exp(alpha + beta - z[:, None])
        gold = np.zeros_like(e)
        np.put_along_axis(gold, tags[:, :, None], 1, axis=2)
        pairs = np.zeros_like(move)
        for t in range(1, steps):
            pairs += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.subtract.at(pairs, (tags[t - 1], tags[t]), 1)
        path = first[tags[0]] + sum(e[t][each, tags[t]] for t in range(steps)) + sum(move[tags[t - 1], tags[t]] for t in range(1, steps))
        de = ((marginal - gold) / rows).astype(np.float32)
        grads = {"move": (pairs / rows).astype(np.float32), "first": de[0].sum(axis=0), "bias": de.sum(axis=(0, 1)),
                 "out": np.einsum("tbh,tbk->hk", both, de)}
        dboth = de @ self.p["out"].T
        h = self.hidden
        for d, saved, dstates in (("f", runs[0], dboth[:, :, :h]), ("b", runs[1], dboth[:, :, h:])):
            u = self.p[f"h{d}"]
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
            dstate, dcell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            for t, i, f, o, new, before, squashed, last in reversed(saved):
                ds = dstates[t] + dstate
                dc = dcell + ds * o * (1 - squashed**2)
                dg = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                np.add.at(gx, codes[t], dg)
                gu += last.T @ dg
                dstate, dcell = dg @ u.T, dc * f
            grads[f"x{d}"], grads[f"h{d}"] = gx, gu
        return float((z - path).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 0) -> "Tagger":
        """Adam over shuffled batches of (row, time) windows."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, max(1, epochs * -(-len(codes) // batch))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(codes)), max(1, -(-len(codes) // batch))):
                if not len(at):
                    continue
                step += 1
                _, g = self.gradients(codes[at].T, tags[at].T)
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                now = rate * (1 - 0.9 * step / total)
                for k, x in g.items():
                    x = x * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


# --- windows and spans ------------------------------------------------------------------------------------------------


def tags_of(length: int, spans: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for k, kind in enumerate(KINDS):
        for s, e in spans[kind]:
            out[s:e] = 2 + 2 * k
            out[s] = 1 + 2 * k
    return out


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a hint, on the grid of strides; the last windows run over the end."""
    at = np.fromiter((m.start() for m in _HINT.finditer(text)), np.int64)
    cells = np.unique(np.concatenate([at // STRIDE, at // STRIDE - 1]))
    return cells[cells >= 0] * STRIDE if len(text) > STRIDE else cells[cells == 0] * STRIDE


def read_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Maximal runs of one kind's tags; a begin tag opens a new span."""
    kind = (tags + 1) // 2
    if not kind.any():
        return []
    opens = np.ones(len(tags), bool)
    opens[1:] = (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(tags))
    return [(KINDS[kind[s] - 1], int(s), int(e)) for s, e in zip(starts, ends) if kind[s]]


_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+", re.I)


def plausible(kind: str, text: str) -> bool:
    """What the network adds must still look like its kind: enough digits, a true check digit, an address with a domain."""
    digits = _digits(text)
    if kind == "email":
        return bool(_SPELLED.fullmatch(text))
    if kind == "ip":
        parts = re.split(r"[ .,:_-]+", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ._/-]", text)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().\/-]*[0-9]", text)) and bool(re.search(r"[ ().\/-]", text))


def added_spans(text: str, tags: np.ndarray, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the whole text's tags that are plausible and touch no base span."""
    taken = np.zeros(len(text) + 1, bool)
    for spans in base.values():
        for s, e in spans:
            taken[s:e] = True
    out = []
    for kind, s, e in read_spans(tags):
        while s < e and text[s] in " \t\n\r,;:|":
            s += 1
        while e > s and text[e - 1] in " \t\n\r,;:|.":
            e -= 1
        beside = text[s - 1:s] + text[e:e + 1]
        if s < e and not taken[s:e].any() and not any(c.isalnum() for c in beside) and plausible(kind, text[s:e]):
            out.append((kind, s, e))
    return out


def decode_texts(model: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Tags of whole texts, reconciled over their windows."""
    codes, where = [], []
    tags = [np.zeros(len(t), np.int64) for t in texts]
    for i, text in enumerate(texts):
        starts = window_starts(text)
        if len(starts):
            coded = np.concatenate([encode(text), np.full(WINDOW, SYMBOLS - 1)])
            codes.append(coded[starts[:, None] + np.arange(WINDOW)])
            where += [(i, int(s)) for s in starts]
    if not codes:
        return tags
    codes = np.concatenate(codes)
    quarter = (WINDOW - STRIDE) // 2
    for at in range(0, len(codes), 512):
        best = model.decode(codes[at:at + 512])
        for (i, s), row in zip(where[at:at + 512], best):
            lo = 0 if s == 0 else quarter
            hi = WINDOW if s + WINDOW >= len(texts[i]) else WINDOW - quarter
            part = tags[i][s + lo:s + hi]
            part[:] = row[lo:lo + len(part)]
    return tags


def altered(kind: str, text: str, rng: np.random.Generator) -> str:
    """A span as people also write it."""
    digits = _digits(text)
    if kind == "email":
        at = [" [at] ", "(at)", " (at) ", "[at]"][rng.integers(4)]
        return text.replace("@", at)
    if kind == "phone":
        d = digits[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", "00" + digits[:1] + f" {d[:3]} {d[3:6]} {d[6:]}"][rng.integers(5)]
    if kind == "card":
        sep = ["-", " ", ".", "_"][rng.integers(4)]
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return text.replace(".", [" . ", "-", ":"][rng.integers(3)])


def training_rows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and tags of labelled windows: as written, and with their spans altered."""
    base = base_spans(text)
    spans = sorted((s, e, k) for k in KINDS for s, e in base[k])
    whole, coded = tags_of(len(text), base), encode(text)
    pad = lambda x, fill: np.concatenate([x, np.full(max(0, WINDOW - len(x)), fill)])[:WINDOW]
    for s in window_starts(text):
        yield pad(coded[s:s + WINDOW], SYMBOLS - 1), pad(whole[s:s + WINDOW], 0)
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
    for s, e, kind in spans:
        lead = int(rng.integers(2, 24))
        before, new, after = text[max(0, s - lead):s], altered(kind, text[s:e], rng), text[e:e + WINDOW]
        k = KINDS.index(kind)
        tags = np.concatenate([np.zeros(len(before), np.int64), [1 + 2 * k], np.full(len(new) - 1, 2 + 2 * k), np.zeros(len(after), np.int64)])
        yield pad(encode(before + new + after), SYMBOLS - 1), pad(tags, 0)


def _window_task(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                for codes, tags in training_rows(text or ""):
                    both = np.concatenate([codes, tags]).astype(np.uint8).tobytes()
                    rows.append((xxhash.xxh3_64_intdigest(both) >> 1, both))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                                 names=["place", "row"])

    return run


def train(docs: DataFrame, text: str = "text", most: int = 4000) -> Tagger:
    """A tagger fitted on at most ``most`` distinct windows, those with the smallest hash of their content."""
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(r"[0-9@]")).mapInArrow(_window_task(most), "place long, row binary")
    found = rows.groupBy("place").agg(F.min("row").alias("row")).orderBy("place").limit(most).collect()
    model = Tagger()
    if found:
        both = np.frombuffer(b"".join(bytes(r["row"]) for r in found), np.uint8).reshape(len(found), 2, WINDOW).astype(np.int64)
        model.fit(both[:, 0], both[:, 1])
    return model


def _find_task(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, every = [], []
            for text, tags in zip(texts, decode_texts(model, texts)):
                found = base_spans(text)
                own = [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]]
                more = [{"kind": k, "start": s, "end": e} for k, s, e in added_spans(text, tags, found)]
                base.append(own)
                every.append(sorted(own + more, key=lambda x: (KINDS.index(x["kind"]), x["start"])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    return run


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 4000) -> DataFrame:
    """``doc_id, base, spans`` of every document: arrays of ``(kind, start, end)`` in code points, end exclusive, by kind in
    the order of ``KINDS`` and then start. ``spans`` holds the base spans and those the network adds.

    Null and empty texts have no spans. Rows with repeated or null ids are handled one by one. Other columns are ignored;
    an empty table gives an empty result. ``most`` bounds the training windows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, text, most))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    span = "array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(_find_task(shipped), f"doc_id long, base {span}, spans {span}")

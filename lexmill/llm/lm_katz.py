"""Katz backoff language model of the corpus, and its score of every document.

N-grams of all orders up to ``order`` are counted over all documents.  Counts r up
to ``k`` are discounted by Good and Turing.  With c(h) the count of a history h of
n - 1 words, h' its last n - 2 words and B(h) the n-grams kept of it,

    p(w | h) = d * c(h, w) / c(h)              where (h, w) is in B(h)
             = alpha(h) * p(w | h')            elsewhere,
    alpha(h) = (1 - sum of p(w | h) over B(h)) / (1 - sum of p(w | h') over B(h)),

down to the discounted p(w), so each history's probabilities, with the unknown
word's, sum to 1 exactly; alpha is 1 for a history without any n-gram kept.  All
n-grams are kept but those of order 3 and more that occur once: their mass goes to
the backoff, as in Katz's paper and the usual toolkits.  A text is scored as
<s> words </s>, token by token; the first word has one word of history.

Words are known by 64-bit hashes (see ``textkernel``), n-grams by the chained hash
of their words.  What is counted grows with the corpus and never comes to the
driver: a chunk of documents sends its distinct n-grams as sorted slices to the
shard of their hash, where they are merged in numpy, and the counts travel back in
the same order (see ``blobs``).  Order after order is counted so, and the sums over
B(h) alike, history by history; an n-gram that holds a shorter one of a single
occurrence is known to occur once and isn't sent.  A chunk asks for the weights of
a history only if some of B(h) may lie elsewhere: where the counts of the n-grams
that it has leave too little of c(h) for another one, it reckons them itself.
Alpha is answered only where the chunk backs off, else just what counts are divided by.
Chunks are written once in buckets and stay there; only answers travel to them.
The model is one table, partitioned by order and kind (counts of n-grams, weights
of histories), one sorted slice a shard; any text is scored from it by the same
look-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm import blobs
from lexmill.llm.common import Workspace, need, shards
from lexmill.llm.textkernel import U, mix, word_hashes

END, BEGIN = U(1), U(2)
_NEXT = U(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Katz:
    """Order, discounting, then sizes of chunks and shards; n-grams of order 3 and more need ``least_count`` (1 or 2)."""

    order: int = 3
    k: int = 5
    least_count: int = 2
    chunk_bytes: int = 6 << 20
    shard_words: int = 4 << 20

    def least(self, n: int) -> int:
        return 1 if n < 3 else self.least_count


def discounts(often: list[int], k: int, min_count: int) -> list[float]:
    """d(r) of counts r = 0 to k + 1; the last holds for all larger counts.

    ``often[r]`` is the number of n-grams that occur r times.  Counts below
    ``min_count`` have 0.  Where the Good-Turing estimate of a count isn't in
    (0, 1], for want of data, the count isn't discounted.
    """
    n1, nk = often[1], often[k + 1]
    common = (k + 1) * nk / n1 if n1 else 1.0
    out = [0.0]
    for r in range(1, k + 1):
        d = 1.0
        if n1 and often[r] and common < 1:
            d = ((r + 1) * often[r + 1] / (r * often[r]) - common) / (1 - common)
        out.append(d if 0 < d <= 1 else 1.0)
    return [0.0 if r < min_count else d for r, d in enumerate(out)] + [1.0]


@dataclass
class Figures:
    """What the driver holds: discounts by order, tokens in all and the unknown word's probability."""

    d: dict[int, list[float]] = field(default_factory=dict)
    tokens: int = 0
    unknown: float = 0.0


# ---- a chunk, as far as its replies go -----------------------------------------------------


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, code by item, the first item of each).

    The upper bits of a key's distance from the least one and the item's number
    are sorted as one integer; the few keys that agree in those bits are put in
    order after that.
    """
    n = len(keys)
    if n == 0:
        return keys, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = keys.min()
    far = 64 - int(keys.max() - low).bit_length()
    bits = max(1, int(n - 1).bit_length())
    packed = (((keys - low) << U(min(far, 63))) >> U(bits) << U(bits)) | np.arange(n, dtype=U)
    packed.sort()
    order = (packed & U((1 << bits) - 1)).astype(np.int64)
    held, upper = keys[order], packed >> U(bits)
    new = np.concatenate([[True], held[1:] != held[:-1]])
    mixed = np.flatnonzero(new[1:] & (upper[1:] == upper[:-1]))
    if len(mixed):
        starts = np.unique(np.searchsorted(upper, upper[mixed]))
        for a in starts:
            b = int(np.searchsorted(upper, upper[a], side="right"))
            order[a:b] = order[a:b][np.lexsort((order[a:b], held[a:b]))]
        held = keys[order]
        new = np.concatenate([[True], held[1:] != held[:-1]])
    code = np.empty(n, dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return held[new], code, order[new]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as codes of words, frequent words first, and the words' hashes."""
    for batch in batches:
        for row, ids in zip(batch.drop_columns(["doc_ids"]).to_pylist(), range(len(batch)), strict=True):
            chunk = blobs.read_chunk(row["keys"], row["sizes"], row["texts"])
            strings = pa.LargeStringArray.from_buffers(len(chunk.off) - 1, pa.py_buffer(chunk.off.astype(np.int64)), pa.py_buffer(chunk.data.tobytes()))
            words, offsets = word_hashes(strings)
            distinct, code, _ = _codes(words)
            often = np.argsort(-np.bincount(code, minlength=len(distinct)), kind="stable")
            rank = np.empty(len(often), dtype=np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk").slice(ids, 1),
                    batch.column("doc_ids").slice(ids, 1),
                    pa.array([blobs.planes(np.diff(offsets).astype(np.int64))], type=pa.binary()),
                    pa.array([len(words)], type=pa.int64()),
                    pa.array([pa.compress(blobs.planes(rank[code]), "zstd", asbytes=True)], type=pa.binary()),
                    pa.array([blobs.planes(distinct[often])], type=pa.binary()),
                ],
                names=["chunk", "doc_ids", "sizes", "n", "codes", "words"],
            )


@dataclass
class Sums:
    """Histories of a chunk: by token, then sorted with their counts; which have to be asked for, and which need alpha; (discounted counts, lower probabilities) over the kept n-grams."""

    some: np.ndarray
    code: np.ndarray
    distinct: np.ndarray
    count: np.ndarray
    ask: np.ndarray
    need: np.ndarray
    local: list[np.ndarray]
    owned: list[np.ndarray]


class Reading:
    """The predicted tokens of a chunk: n-grams, histories, counts and probabilities order by order."""

    def __init__(self, row: dict, replies: dict[str, list[dict]], figures: Figures, options: Katz, n_shards: int, among: bool) -> None:
        self.replies, self.figures, self.options, self.n_shards = replies, figures, options, n_shards
        self.among = among  # are the texts among those that were counted?
        size = blobs.unplanes(row["sizes"], np.int64)
        codes = blobs.unplanes(pa.decompress(row["codes"], 4 * row["n"], "zstd", asbytes=True), np.uint32) if row["n"] else np.zeros(0, dtype=np.uint32)
        table = blobs.unplanes(row["words"], U)
        self.size = size + (size > 0)
        self.ends = np.cumsum(self.size)
        n = int(self.ends[-1]) if len(self.ends) else 0
        begins = (self.ends - self.size)[size > 0]
        self.place = np.arange(n) - np.repeat(begins, self.size[size > 0])  # within the text
        last = np.zeros(n, dtype=bool)
        last[self.ends[size > 0] - 1] = True
        if n:
            table = np.append(table, END)
        by_hash = np.argsort(table)
        place = np.empty(len(table), dtype=np.int64)
        place[by_hash] = np.arange(len(table))
        code = np.empty(n, dtype=np.int64)
        code[~last] = place[codes]
        code[last] = place[-1:]
        item = np.empty(len(table), dtype=np.int64)
        item[code[::-1]] = np.arange(n)[::-1]
        self.word = table[by_hash][code]
        self.tokens: dict[int, np.ndarray] = {1: np.arange(n)}  # those that have an n-gram of the order
        self.keys: dict[int, np.ndarray] = {1: self.word}  # by token
        self.distinct, self.code, self.item = {1: table[by_hash]}, {1: code}, {1: item}
        self.counts: dict[int, np.ndarray] = {}  # by token
        self.owned: dict[int, np.ndarray] = {}  # by distinct n-gram: is it this chunk that accounts for it?
        self.sent: dict[int, np.ndarray] = {}

    def history(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, count) of the history of each token of the order."""
        t = self.tokens[n]
        if n > 2:
            return self.keys[n - 1][t - 1], self.counts[n - 1][t - 1]
        end = np.searchsorted(self.distinct[1], END)
        texts = self.counts[1][self.item[1][end]] if len(self.distinct[1]) else 0
        key, count = np.full(len(t), BEGIN, dtype=U), np.full(len(t), texts, dtype=np.int64)
        inner = np.flatnonzero(self.place[t] > 0)
        key[inner], count[inner] = self.word[t[inner] - 1], self.counts[1][t[inner] - 1]
        return key, count

    def grams(self, n: int) -> None:
        """N-grams of the order, and which of them have to be asked for."""
        if n > 1:
            self.tokens[n] = np.flatnonzero(self.place >= n - 2)
            keys = np.zeros(len(self.word), dtype=U)
            history, count = self.history(n)
            keys[self.tokens[n]] = mix(history * _NEXT + self.word[self.tokens[n]] + U(n))
            self.keys[n] = keys
            self.distinct[n], self.code[n], self.item[n] = _codes(keys[self.tokens[n]])
        t = self.tokens[n]
        self.sent[n] = np.ones(len(self.distinct[n]), dtype=bool)
        least = self.options.least(n)
        if least > 1:
            self.sent[n] = (np.minimum(count, self.counts[n - 1][t]) >= least)[self.item[n]]

    def counted(self, n: int) -> None:
        """The counts that came back; what wasn't sent occurs less than it has to."""
        count, owned = np.zeros(len(self.distinct[n]), dtype=np.int64), np.zeros(len(self.distinct[n]), dtype=bool)
        keys = self.distinct[n][self.sent[n]]
        got, own = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        by_shard = {r["shard"]: r for r in self.replies[f"c{n}"]}
        for s, a, b in blobs.slices(keys, self.n_shards):
            got[a:b] = _unsmall(by_shard[s]["b"], U).astype(np.int64)
            own[a:b] = np.unpackbits(np.frombuffer(by_shard[s]["c"], dtype=np.uint8), count=b - a).astype(bool)
        count[self.sent[n]], owned[self.sent[n]] = got, own
        by_token = np.zeros(len(self.word), dtype=np.int64)
        by_token[self.tokens[n]] = count[self.code[n]]
        self.counts[n], self.owned[n] = by_token, owned

    def kept(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(is its n-gram kept, its discounted count) by token of the order."""
        count, d = self.counts[n][self.tokens[n]], np.array(self.figures.d[n])
        return count >= self.options.least(n), d[np.minimum(count, len(d) - 1)] * count

    def first(self) -> np.ndarray:
        """p(w) by token."""
        some, share = self.kept(1)
        return np.where(some, share / max(1, self.figures.tokens), self.figures.unknown)

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which tokens of the order have a history that may have n-grams, its sorted distinct keys, their counts, code by such token)."""
        key, count = self.history(n)
        some = np.flatnonzero(count >= self.options.least(n))
        t, held, code = self.tokens[n][some], self.distinct[n - 1], self.code[n - 1]
        if n > 2:
            code = code[np.searchsorted(self.tokens[n - 1], t - 1)]
        else:
            begin, inner = int(np.searchsorted(held, BEGIN)), self.place[t] > 0
            held = np.insert(held, begin, BEGIN)
            before = code[t - 1]
            code = np.where(inner, before + (before >= begin), begin)
        used = np.zeros(len(held), dtype=bool)
        used[code] = True
        code = (np.cumsum(used) - 1)[code]
        often = np.zeros(int(used.sum()), dtype=np.int64)
        often[code] = count[some]
        return some, held[used], often, code

    def sums(self, n: int, lower: np.ndarray) -> Sums:
        """Over the kept n-grams of each history: those of the chunk, and those that it accounts for."""
        some, distinct, count, code = self.histories(n)
        kept, share = self.kept(n)
        at = np.full(len(self.tokens[n]), -1, dtype=np.int64)
        at[some] = code
        below = lower[self.tokens[n]]

        def over(item: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            return [np.bincount(at[item], weights=x[item], minlength=len(distinct)) for x in values]

        item = self.item[n][at[self.item[n]] >= 0]
        often = self.counts[n][self.tokens[n]]
        (seen,) = over(item, np.maximum(often, 1) if self.among else often)
        own = self.item[n][self.owned[n]]
        item, own = item[kept[item]], own[kept[own] & (at[own] >= 0)]
        need = np.zeros(len(distinct), dtype=bool)
        need[code[~kept[some]]] = True
        return Sums(some, code, distinct, count, count - seen >= self.options.least(n), need, over(item, share, below), over(own, share, below))

    def next(self, n: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p(w | history) by token, which of the order's tokens were backed off)."""
        sums = self.sums(n, lower)
        total, alpha = weights(*sums.local, sums.count.astype(np.float64))
        asked = np.flatnonzero(sums.ask)
        by_shard = {r["shard"]: r for r in self.replies[f"p{n}"]}
        for k, a, b in blobs.slices(sums.distinct[asked], self.n_shards):
            at = asked[a:b]
            total[at], alpha[at] = _unfolded(*_answered(by_shard[k], sums.need[at]), sums.count[at])
        kept, share = self.kept(n)
        t = self.tokens[n]
        by_token = np.ones((2, len(t)))
        by_token[:, sums.some] = total[sums.code], alpha[sums.code]
        out = lower.copy()
        out[t] = np.where(kept, share / by_token[0], by_token[1] * lower[t])
        return out, ~kept

    def evaluate(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(p by token of the order, or of the highest that its place has; is it backed off): recursively from order 1 on."""
        p, backed = self.first(), self.counts[1] == 0
        for n in range(2, upto + 1):
            p, missed = self.next(n, p)
            backed[self.tokens[n]] = missed
        return p, backed


def weights(s: np.ndarray, below: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what counts are divided by, alpha) of histories.

    Where the n-grams kept leave nothing over for unseen words, one more
    occurrence is reckoned; where there is no unseen word, they share all.
    """
    seen_all = (1 - below < 1e-12) & (s > 0)
    total = np.where(seen_all, s, np.where((count - s < 1e-9) & (s > 0), count + 1.0, count))
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(seen_all, 0.0, (1 - s / total) / (1 - below))
    return total, np.where(s > 0, alpha, 1.0)


def _folded(s: np.ndarray, below: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights as one number and its sort: alpha where counts are divided by the history's (0) or by one more (1), or that divisor where alpha is 0 (2)."""
    total, alpha = weights(s, below, count)
    sort = np.where((alpha == 0) & (s > 0), 2, np.where(total == count, 0, 1)).astype(np.uint8)
    return np.where(sort == 2, total, alpha), sort


def _unfolded(value: np.ndarray, sort: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor, alpha) again."""
    return np.where(sort == 2, value, count + (sort == 1)), np.where(sort == 2, 0.0, value)


# ---- what chunks send and shards answer ----------------------------------------------------

def _small(x: np.ndarray) -> bytes:
    """Counts and sums, compressed: mostly few values."""
    return len(x).to_bytes(8, "little") + pa.compress(blobs.planes(x), "zstd", asbytes=True)


def _unsmall(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return blobs.unplanes(pa.decompress(blob[8:], np.dtype(kind).itemsize * n, "zstd", asbytes=True), kind) if n else np.zeros(0, dtype=kind)


def _asked(distinct: np.ndarray, ask: np.ndarray, need: np.ndarray, s: np.ndarray, below: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys; which of them are asked for, need alpha and have sums; these sums and the history's count."""
    some = np.flatnonzero(s > 0)
    marks = np.packbits(np.concatenate([ask, need, s > 0])).tobytes()
    held = [_small(x[some]) for x in (s, below, count.astype(np.int64))]
    return blobs.steps(distinct), marks, b"".join(len(x).to_bytes(8, "little") + x for x in held)


def _unasked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, is it asked for, does it need alpha, which have sums, the sums and the count of these)."""
    keys, held, at = blobs.unsteps(row["a"]), [], 0
    ask, need, some = np.unpackbits(np.frombuffer(row["b"], dtype=np.uint8), count=3 * len(keys)).astype(bool).reshape(3, -1)
    for kind in (np.float64, np.float64, np.int64):
        size = int.from_bytes(row["c"][at : at + 8], "little")
        held.append(_unsmall(row["c"][at + 8 : at + 8 + size], kind))
        at += 8 + size
    return keys, ask, need, np.flatnonzero(some), held


def _answer(value: np.ndarray, sort: np.ndarray, need: np.ndarray) -> tuple[bytes, bytes]:
    """Folded weights, without an alpha that isn't needed."""
    return _small(value[need | (sort == 2)]), _small(sort)


def _answered(row: dict, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sort = _unsmall(row["c"], np.uint8)
    value = np.ones(len(sort))
    value[need | (sort == 2)] = _unsmall(row["b"], np.float64)
    return value, sort


_ROWS = "kind string, shard long, chunk long, a binary, b binary, c binary"
_KINDS = [("kind", pa.string()), ("shard", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, (_, k) in zip(columns, _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def _messages(reading: Reading, chunk: int, step: int) -> list[tuple]:
    """What a chunk sends in a step: its n-grams of order ``step``, and its sums by history of the order before."""
    order, n_shards, out = reading.options.order, reading.n_shards, []
    for n in range(1, min(step, order) + 1):
        reading.grams(n)
        if n < step:
            reading.counted(n)
    if step <= order:
        keys = reading.distinct[step][reading.sent[step]]
        count = np.bincount(reading.code[step], minlength=len(reading.distinct[step]))[reading.sent[step]].astype(U)
        out += [(f"c{step}", s, chunk, blobs.steps(keys[a:b]), _small(count[a:b]), None) for s, a, b in blobs.slices(keys, n_shards)]
        once = int(np.count_nonzero(~reading.sent[step]))
        if once:
            out.append((f"o{step}", 0, chunk, np.array([0, once], dtype=np.int64).tobytes(), None, None))
    if step > 2:
        n = step - 1
        lower, _ = reading.evaluate(n - 1)
        sums = reading.sums(n, lower)
        some = np.flatnonzero(sums.ask | (sums.owned[0] > 0))
        sent = [x[some] for x in (sums.distinct, sums.ask, sums.need, *sums.owned, sums.count)]
        out += [(f"p{n}", k, chunk, *_asked(*[x[a:b] for x in sent])) for k, a, b in blobs.slices(sent[0], n_shards)]
    return out


def _first_step(figures: Figures, options: Katz, n_shards: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows(_messages(Reading(row, {}, figures, options, n_shards, True), row["chunk"], 1))

    return run


def _split(chunk: pa.Table, answers: pa.Table) -> tuple[dict, dict[str, list[dict]]]:
    replies: dict[str, list[dict]] = {f"{kind}{n}": [] for kind in "cp" for n in range(1, 10)}
    for r in answers.to_pylist():
        replies.setdefault(r["kind"], []).append(r)
    return chunk.to_pylist()[0], replies


def _later_step(step: int, figures: Figures, options: Katz, n_shards: int, among: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, replies = _split(chunk, answers)
        return pa.Table.from_batches([_rows(_messages(Reading(row, replies, figures, options, n_shards, among), row["chunk"], step))])

    return run


def _merge(options: Katz) -> Callable[[pa.Table], pa.Table]:
    """Answers to all chunks, and what the model keeps: counts (m) and how often they occur (o), or weights of histories (h)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        kind, n, shard = rows[0]["kind"][0], int(rows[0]["kind"][1:]), rows[0]["shard"]
        if kind == "o":
            once = sum(int(np.frombuffer(r["a"], dtype=np.int64)[1]) for r in rows)
            often = np.zeros(options.k + 3, dtype=np.int64)
            often[1] = once
            return pa.Table.from_batches([_rows([(f"o{n}", shard, None, often.tobytes(), None, None)])])
        asked = [_unasked(r) for r in rows] if kind == "p" else []
        keys = [x[0] for x in asked] if asked else [blobs.unsteps(r["a"]) for r in rows]
        edge = np.cumsum([0, *map(len, keys)])
        together = np.concatenate(keys)
        distinct, code, first = _codes(together)
        if kind == "p":
            out: list[tuple] = []
            sums, count = np.zeros((2, len(distinct))), np.zeros(len(distinct))
            for i, (_, _, _, at, held) in enumerate(asked):  # a chunk's keys are distinct
                at = code[edge[i] + at]
                sums[0, at] += held[0]
                sums[1, at] += held[1]
                count[at] = held[2]
            folded = _folded(*sums, count)
            for i, (r, (_, ask, need, _, _)) in enumerate(zip(rows, asked, strict=True)):
                if ask.any():
                    at = code[edge[i] : edge[i + 1]][ask]
                    out.append((f"p{n}", shard, r["chunk"], None, *_answer(folded[0][at], folded[1][at], need[ask])))
            some = np.flatnonzero(sums[0] > 0)
            out.append((f"h{n}", shard, None, blobs.steps(distinct[some]), *(_small(x[some]) for x in folded)))
            return pa.Table.from_batches([_rows(out)])
        weight = np.concatenate([_unsmall(r["b"], U) for r in rows]).astype(np.float64)
        total = np.bincount(code, weights=weight, minlength=len(distinct)).astype(U)
        own = np.zeros(len(together), dtype=bool)
        own[first] = True
        back = total[code]
        out = [(f"c{n}", shard, r["chunk"], None, _small(back[edge[i] : edge[i + 1]]), np.packbits(own[edge[i] : edge[i + 1]]).tobytes()) for i, r in enumerate(rows)]
        some = np.flatnonzero(total >= options.least(n))
        often = np.bincount(np.minimum(total, options.k + 2).astype(np.int64), minlength=options.k + 3).astype(np.int64)
        out.append((f"m{n}", shard, None, blobs.steps(distinct[some]), _small(total[some]), None))
        out.append((f"o{n}", shard, None, often.tobytes(), np.array([int(total.sum())], dtype=np.int64).tobytes(), None))
        return pa.Table.from_batches([_rows(out)])

    return run


def _look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Answers to chunks of any texts, from the model's slice of the shard."""
    out, rows = [], held.to_pylist()
    keys = blobs.unsteps(rows[0]["a"]) if rows and rows[0]["a"] else np.zeros(0, dtype=U)
    for r in asked.to_pylist():
        wanted = blobs.unsteps(r["a"])
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)

        def found(column: str, kind: type, other: int, hit: np.ndarray = hit, at: np.ndarray = at) -> np.ndarray:
            return np.where(hit, _unsmall(rows[0][column], kind)[at], kind(other)).astype(kind) if len(keys) else np.full(len(hit), other, dtype=kind)

        if r["kind"][0] == "c":
            out.append((r["kind"], r["shard"], r["chunk"], None, _small(found("b", U, 0)), np.packbits(np.zeros(len(wanted), dtype=bool)).tobytes()))
        elif r["kind"][0] == "p":
            out.append((r["kind"], r["shard"], r["chunk"], None, *_answer(found("b", np.float64, 1), found("c", np.uint8, 0), _unasked(r)[2])))
    return pa.Table.from_batches([_rows(out)])


# ---- training and scoring ------------------------------------------------------------------

_CHUNK = ["doc_ids", "sizes", "n", "codes", "words"]


def _with_replies(chunks: DataFrame, replies: list[DataFrame], run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """Each chunk, where it lies, with the answers to it."""
    together = reduce(DataFrame.union, [r.select("kind", "chunk", "shard", "b", "c") for r in replies])
    return chunks.groupBy("chunk").cogroup(together.groupBy("chunk")).applyInArrow(run, schema)


@dataclass
class Model:
    """``table`` (n_words, kind, shard, a, b, c), partitioned by n_words and kind; m: keys and counts, h: keys and weights."""

    table: DataFrame
    figures: Figures
    options: Katz
    n_shards: int


def _chunks(ws: Workspace, docs: DataFrame, options: Katz) -> DataFrame:
    texts = blobs.chunked(docs.select("doc_id", "text"), F.lit(0).cast("long"), options.chunk_bytes)
    fields = [*texts.schema.fields[:2], T.StructField("sizes", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType())]
    return ws.bucketed(texts.mapInArrow(_encode, T.StructType(fields)), "chunks", "chunk")


def _figures(table: DataFrame, n: int, figures: Figures, options: Katz) -> None:
    """Discounts of an order from the shards' short rows."""
    often, tokens = np.zeros(options.k + 3, dtype=np.int64), 0
    for row in table.where(F.col("kind") == f"o{n}").select("a", "b").collect():
        often += np.frombuffer(row["a"], dtype=np.int64)
        tokens += int(np.frombuffer(row["b"], dtype=np.int64)[0]) if row["b"] else 0
    figures.d[n] = discounts(often.tolist(), options.k, options.least(n))
    if n == 1:
        lost = sum((1 - figures.d[1][r]) * r * int(often[r]) for r in range(1, options.k + 1))
        if lost < 1e-9:  # one more occurrence, of an unseen word
            lost, tokens = 1.0, tokens + 1
        figures.tokens, figures.unknown = tokens, lost / tokens


def train(spark: SparkSession, docs: DataFrame, options: Katz = Katz()) -> tuple[Model, DataFrame, list[DataFrame]]:  # noqa: B008
    """(model, chunks, replies to them) of all of ``docs`` (doc_id, text)."""
    need(docs, "doc_id", "text")
    ws = Workspace(spark, "katz")
    chunks = _chunks(ws, docs, options)
    n = max(shards(spark), -(-chunks.count() * options.chunk_bytes // (6 * options.shard_words)))  # a word has about six bytes
    figures, tables = Figures(), []
    for step in range(1, options.order + 2):
        if step == 1:
            sent = chunks.select("chunk", *_CHUNK[1:]).mapInArrow(_first_step(figures, options, n), _ROWS)
        else:
            replies = [t.where(F.col("part").isin("c", "p")) for t in tables]
            sent = _with_replies(chunks.drop("doc_ids"), replies, _later_step(step, figures, options, n, True), _ROWS)
        merged = sent.groupBy("kind", "shard").applyInArrow(_merge(options), _ROWS)
        merged = merged.withColumn("n_words", F.substring("kind", 2, 9).cast("int")).withColumn("part", F.substring("kind", 1, 1))
        tables.append(ws.table(merged, f"step-{step}", partition_by=("n_words", "part")))
        if step <= options.order:
            _figures(tables[-1], step, figures, options)
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    model = Model(whole.where(F.col("part").isin("m", "h")), figures, options, n)
    return model, chunks, [t.where(F.col("part").isin("c", "p")) for t in tables]


def _score(figures: Figures, options: Katz, n_shards: int, among: bool, doc_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, replies = _split(chunk, answers)
        reading = Reading(row, replies, figures, options, n_shards, among)
        for n in range(1, options.order + 1):
            reading.grams(n)
            reading.counted(n)
        p, backed = reading.evaluate(options.order)
        with np.errstate(divide="ignore"):
            value = np.log(p)
        running, missed = np.concatenate([[0.0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(backed)])
        start = reading.ends - reading.size
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], type=doc_type),
                "n_tokens": pa.array(reading.size.astype(np.int64)),
                "n_backoff": pa.array((missed[reading.ends] - missed[start]).astype(np.int64)),
                "log_prob": pa.array(running[reading.ends] - running[start], mask=reading.size == 0),
            }
        )

    return run


def _scored(chunks: DataFrame, replies: list[DataFrame], model: Model, among: bool) -> DataFrame:
    ids = chunks.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField("doc_id", ids), T.StructField("n_tokens", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("log_prob", T.DoubleType())])
    run = _score(model.figures, model.options, model.n_shards, among, to_arrow_type(ids))
    scored = _with_replies(chunks, replies, run, out)
    return scored.withColumn("log_prob", F.round("log_prob", 4))


def score_texts(spark: SparkSession, model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_prob) of any texts, by look-ups in the model's table.

    A word that the model doesn't know has the mass that discounting took from
    the words (if it took none, that of one more occurrence).
    """
    need(docs, "doc_id", "text")
    ws, options, n = Workspace(spark, "katz-score"), model.options, model.n_shards
    chunks, replies = _chunks(ws, docs, options), []
    held = model.table.withColumn("kind", F.concat(F.when(F.col("part") == "m", "c").otherwise("p"), F.col("n_words").cast("string")))
    for step in range(1, options.order + 2):
        if step == 1:
            sent = chunks.select("chunk", *_CHUNK[1:]).mapInArrow(_first_step(model.figures, options, n), _ROWS)
        else:
            sent = _with_replies(chunks.drop("doc_ids"), replies, _later_step(step, model.figures, options, n, False), _ROWS)
        asked = ws.table(sent.where(~F.col("kind").startswith("o")), f"asked-{step}")
        own = held.select("kind", "shard", "chunk", "a", "b", "c")
        found = asked.groupBy("kind", "shard").cogroup(own.groupBy("kind", "shard")).applyInArrow(_look_up, _ROWS)
        replies.append(ws.table(found, f"found-{step}"))
    return _scored(chunks, replies, model, False)


def score_documents(spark: SparkSession, docs: DataFrame, options: Katz = Katz()) -> DataFrame:  # noqa: B008
    """(doc_id, n_tokens, n_backoff, log_prob) of every row of ``docs`` by the model of them all.

    ``n_tokens`` counts the words and the text's end, ``n_backoff`` those whose
    longest n-gram isn't in the model, ``log_prob`` is the natural logarithm of
    the text's probability, rounded to four places.  A text without a word (null,
    empty, punctuation) isn't counted and has 0 tokens and a null ``log_prob``.
    Repeated rows count as often as they occur; null ids are scored like others;
    other columns are ignored.  An empty table gives an empty result.
    """
    model, chunks, replies = train(spark, docs, options)
    return _scored(chunks, replies, model, True)

"""Language-model scores by logistic context mixing over bits.

The model reads a text as its bytes (A-Z lower-cased) and one end mark, each byte as eight binary decisions. ORDERS
bit predictors look at the last 0 to 4 bytes, and at the word so far together with the text's register: hashed
(context, bits so far) slots hold how often a 0 and a 1 followed in the training texts, and each predictor falls back
on the one before it. A mixer adds their stretched probabilities with weights, chosen by a gate (the longest context
that was seen, how often, and how often the word so far was); weights are learned online, batch by batch, by steps on
coding cost that shrink as a weight's curvature adds up, with each decision's own occurrence taken out of the counts.
An adaptive map from (bits so far, mixed probability) to observed frequencies refines the result. The sum of the
decisions' log10 probabilities is the score; total bits per byte follow.

The register is adaptive, too: short words are grouped by which of them follow each other in the training texts
(languages come apart by this), and a word's register is the group most met so far in its text; white space after a
word has the register that the next word would have, whether or not there is one.

All of it is made from counts over all training texts, in one pass of learning at every size: what the tasks gather
grows with the corpus, but is folded into tables of one fixed size, without check tags, so that contexts share slots
in a large corpus. Scoring changes nothing in the model, so scores don't depend on what else is scored or in which order.

The base score is a unigram model with add-one smoothing. Counts of frequent tokens (at most HOT of them) go to the
scoring tasks; rarer tokens are joined by key. Tokens are compared by 64-bit hashes.

Defined results: null texts are empty and have their end only; repeated rows count and are scored each; a null id
is a training row (its remainder isn't 2); without training rows base scores are 0 and bits have probability 1/2; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, SPACE, kept, mix64, pieces, powers, span_hashes, tokens, trim, trimmed

BITS = (8, 16, 18, 20, 21)  # of the slots of the byte contexts
WORD_BITS, SLICE_BITS = 24, 14  # of the slots for words, and of the slices that these are built in
WIDE, MOST, PART = 1 << WORD_BITS - SLICE_BITS, 1 << SLICE_BITS, 1 << 19  # slots of a slice; parts; tokens of a part
STRETCH, FIVES, TURN = 1 << 16, 64, 256  # strings of a row; groups of five-byte strings; slices made at once
ORDERS, END, PAD, HOT, HELD, TOGETHER = len(BITS) + 1, 255, 4, 150_000, 3_000_000, 12 << 20
SPREAD, STEPS, EDGE, UNIT, SHORT, GROUPS, RATE, CURVE = 1.0, 33, 8.0, 1e-12, 256, 6, 1.0, 200.0
OFFSET = np.r_[0, np.cumsum([1 << b for b in BITS])]
SEEN, WORD_SEEN = np.array([1, 2, 3, 5, 17, 65]), np.array([1, 2, 4, 9, 33])  # counts at which a gate changes
WORD_KIND = np.searchsorted(WORD_SEEN, np.arange(WORD_SEEN[-1] + 1), "right")  # by the count, up to the last
GATES = len(BITS) * (len(SEEN) + 1) * (len(WORD_SEEN) + 1)
#: Counts are kept as logarithms in 16 bits; this gives them back, those below 1000 exactly.
COUNT = np.exp2(np.arange(1 << 16) / 2048).astype(np.float32) - 1
COUNT[COUNT < 1000] = np.rint(COUNT[COUNT < 1000])


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    low, high = (np.minimum(np.rint(np.log2(n + 1.0) * 2048), 65535).astype(np.uint32) for n in (zeros, ones))
    return low | high << np.uint32(16)


def short_words(begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The bucket of each word of at most three bytes, -1 for others."""
    return np.where(end - begin <= 3, (h % np.uint64(SHORT)).astype(np.int64), -1)


def registers(short: np.ndarray, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group most met in its row before each word, and before each row's end (GROUPS: none yet)."""
    own = np.where(short >= 0, group[short], -1)
    where = np.flatnonzero(own >= 0)
    before = np.zeros(len(short) + 1, np.int64)  # of these words, those before a word
    np.cumsum(own >= 0, out=before[1:])
    start = before[first]  # and those before a row
    most = np.zeros(len(where) + 1, np.int64)  # after each of them: the most met, and how often
    own, since = own[where], np.repeat(start[:-1], np.diff(start))
    for k in range(GROUPS):
        met = np.zeros(len(where) + 1, np.int64)
        np.cumsum(own == k, out=met[1:])
        np.maximum(most[1:], (met[1:] - met[since]) * (GROUPS + 1) + GROUPS - 1 - k, out=most[1:])
    best = GROUPS - 1 - most % (GROUPS + 1)
    ends, n = before[first[1:]], np.diff(first)
    return np.where(before[:-1] > np.repeat(start[:-1], n), best[before[:-1]], GROUPS), np.where(ends > start[:-1], best[ends], GROUPS)


def read(raw: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands for each byte, and for the end, of all rows one after another; the words' hashes, each row's first word.

    The low 40 bits are five bytes, the last of which is to be predicted, the high 24 a hash of the word before it
    and its register.
    """
    n = np.diff(at)
    row = np.arange(len(n))
    size, start, stop = len(raw) + len(n), at[:-1] + row, at[1:] + row  # places: the bytes with an end after each row
    padded = np.full(size + 7, END, np.uint8)
    padded[7:][np.arange(len(raw)) + np.repeat(row, n)] = LOWERED[raw]
    text = padded[7:]
    word = np.zeros(size + 2, bool)  # of the place before
    np.logical_not(SPACE[text], out=word[1:-1])
    word[stop + 1] = False
    begin, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    first = np.searchsorted(begin, np.r_[start, size])
    power, inverse = powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * power[:size], out=total[1:])
    base, inverse = total[begin], inverse[begin]
    h = mix64((total[end] - base) * inverse)
    state, after = ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) for x in registers(short_words(begin, end, h), first, group))
    # runs of places: before a row's first word, within a word (from its second byte to the place after it), after a word
    of = np.repeat(row, np.diff(first))
    inside, leads = 2 * np.arange(len(begin)) + of + 1, 2 * first[:-1] + row
    runs = np.zeros((4, 2 * len(begin) + len(n)), np.uint64)  # where it begins; the word's base, inverse and register
    runs[0, leads], runs[0, inside], runs[0, inside + 1] = start, begin + 1, end + 1
    runs[1, inside], runs[2, inside], runs[3, inside] = base, inverse, state
    # a place between words has the register of the row's next word, or after its last one
    none = first[1:] == first[:-1]
    runs[3, leads] = np.where(none, after, np.r_[state, np.uint64(0)][first[:-1]])
    runs[3, inside[:-1] + 1] = state[1:]
    runs[3, inside[first[1:][~none] - 1] + 1] = after[~none]
    long = np.diff(np.r_[runs[0].astype(np.int64), size])
    key = total[:size]
    key -= np.repeat(runs[1], long)
    key *= np.repeat(runs[2], long)  # 0 between words
    key += np.repeat(runs[3], long)
    key = mix64(key)
    key &= np.uint64(0xFFFFFF << 40)
    grams = np.ndarray(size, ">u8", padded, 0, (1,)).astype(np.uint64)
    grams &= np.uint64(LOW)
    for k in range(PAD):  # contexts don't reach into the row before
        grams[start[n >= k] + k] |= np.uint64(LOW >> 8 * (k + 1) << 8 * (k + 1))
    key |= grams
    return key.view(np.int64), h, first


def stream(raw: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The strings of read()."""
    return read(raw, at, group)[0]


LOW = (1 << 40) - 1


def nodes(grams: np.ndarray, bit: int) -> np.ndarray:
    """The bits of the last byte before a bit (0 is the highest), with a leading one."""
    return ((1 << bit) | ((grams & 255) >> (8 - bit))).astype(np.uint64)


def byte_slots(grams: np.ndarray, bit: int) -> list[np.ndarray]:
    """The slots that the byte contexts look at for a bit of each string."""
    node, context = nodes(grams, bit), grams.view(np.uint64) >> np.uint64(8)
    out = [node.astype(np.int64)]
    for k in range(1, len(BITS)):
        own = (context & np.uint64((1 << 8 * k) - 1)) << np.uint64(8) | node
        own = own if BITS[k] >= 8 * k + 8 else mix64(own + np.uint64(k << 56)) >> np.uint64(64 - BITS[k])
        out.append(own.astype(np.int64) + OFFSET[k])
    return out


def word_slots(grams: np.ndarray, bit: int) -> np.ndarray:
    """The slot of the word so far, by its slice (the highest bits) and place in it."""
    word = grams.view(np.uint64) >> np.uint64(40)
    low = mix64(word << np.uint64(8) | nodes(grams, bit)) & np.uint64(WIDE - 1)
    return ((word >> np.uint64(24 - SLICE_BITS)) * np.uint64(WIDE) + low).astype(np.int64)


def bit_of(grams: np.ndarray, bit: int) -> np.ndarray:
    return (grams >> (7 - bit)) & 1


class Tables(tuple):
    """The tables of bytes and words, which travel compressed: those of a small corpus are empty for the most part."""

    def __reduce__(self) -> tuple:
        return unpacked, tuple(zstandard.compress(x.tobytes(), 1) for x in self)


def unpacked(*tables: bytes) -> Tables:
    return Tables(np.frombuffer(zstandard.decompress(x), np.uint32) for x in tables)


class Model:
    """Packed counts (for bytes and for words, 0s in the low and 1s in the high half), mixing weights, refining map."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.bytes, self.words = tables
        first = np.tile(np.r_[np.zeros(ORDERS - 2), 0.3, 0.7, 0], (GATES, 1))
        self.weights = (first if weights is None else weights).astype(np.float32)
        self.curve = np.full((GATES, ORDERS + 1), CURVE)  # curvature met so far
        self.refine = refine

    @staticmethod
    def _predict(table: np.ndarray, at: np.ndarray, p: np.ndarray | float, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a 1, falling back on p, and how often a slot was met."""
        both = table[at]
        n0, n1 = COUNT[both & 0xFFFF], COUNT[both >> 16]
        if without is not None:
            n0, n1 = np.maximum(n0 - (without == 0), 0), np.maximum(n1 - (without == 1), 0)
        total = n0 + n1
        return np.clip((n1 + np.float32(SPREAD) * p) / (total + np.float32(SPREAD)), np.float32(1e-6), np.float32(1 - 1e-6)), total

    def lower(self, own: np.ndarray, bit: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct five-byte strings: stretched predictions by byte contexts, gates so far, the last prediction.

        y: the bits themselves, to take one occurrence of each string out of the counts.
        """
        x = np.ones((len(own), ORDERS + 1), np.float32)
        p, gate, often = np.float32(0.5), np.zeros(len(own), np.int64), None
        for k, at in enumerate(byte_slots(own, bit)):  # each predictor falls back on the one before it
            p, total = self._predict(self.bytes, at, p, y)
            x[:, k] = np.log(p / (1 - p))
            seen = total >= 1
            gate[seen] = k
            often = total if often is None else np.where(seen, total, often)
        return x, (gate * (len(SEEN) + 1) + np.searchsorted(SEEN, often, "right")) * (len(WORD_SEEN) + 1), p

    def upper(self, grams: np.ndarray, lower: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray, bit: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (ORDERS + 1 columns) and gates of strings; which: their rows in lower()."""
        x, gate, p = lower
        p, total = self._predict(self.words, word_slots(grams, bit), p[which], y)
        x = x[which]
        x[:, ORDERS - 1] = np.log(p / (1 - p))
        return x, gate[which] + WORD_KIND[np.minimum(total, WORD_SEEN[-1]).astype(np.int64)]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -EDGE * 2, EDGE * 2).astype(np.float64)

    @staticmethod
    def cells(grams: np.ndarray, bit: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell below z in the refining map, and how far z is from it to the next."""
        place = np.clip((z + EDGE) * ((STEPS - 1) / (2 * EDGE)), 0, STEPS - 1.00001)
        low = place.astype(np.int64)
        return nodes(grams, bit).astype(np.int64) * STEPS + low, place - low.astype(place.dtype)

    def learn(self, grams: np.ndarray, n: np.ndarray, seen: np.ndarray, batch: int = 8192) -> None:
        """One pass of online steps over strings that occurred n times each.

        seen (2 x cells) gathers how often a cell of the refining map was met, and met with a 1.
        """
        for k in range(0, len(grams), batch):
            g, times = grams[k : k + batch], n[k : k + batch].astype(np.float64)
            own, which = _five(g)
            for bit in range(8):
                y = bit_of(g, bit)
                x, gate = self.upper(g, self.lower(own, bit, bit_of(own, bit)), which, bit, y)
                z = self.mixed(x, gate)
                p = _squash(z)
                error, bend = (y - p) * times, p * (1 - p) * times
                step = np.stack([np.bincount(gate, error * x[:, j], GATES) for j in range(ORDERS + 1)], 1)
                self.curve += np.stack([np.bincount(gate, bend * x[:, j] ** 2, GATES) for j in range(ORDERS + 1)], 1)
                self.weights += (RATE * step / self.curve).astype(np.float32)
                cell, part = self.cells(g, bit, z)
                for c, w in ((cell, times * (1 - part)), (cell + 1, times * part)):
                    seen[0] += np.bincount(c, w, seen.shape[1])
                    seen[1] += np.bincount(c, w * y, seen.shape[1])

    @staticmethod
    def settled(seen: np.ndarray) -> np.ndarray:
        """The refining map from learn()'s counts."""
        centre = np.tile(_squash(np.linspace(-EDGE, EDGE, STEPS)), 256)
        return (seen[1] + 4 * centre) / (seen[0] + 4)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of each string's last byte after the others."""
        if not (grams[1:] >= grams[:-1]).all():  # neighbours look at one slice of the word table
            out, order = np.empty(len(grams)), np.argsort(grams)
            out[order] = self.log10(grams[order])
            return out
        out, block = np.empty(len(grams)), ((grams >> 8) & 7).astype(np.uint8)
        for k in range(8):  # in blocks of different five-byte strings, to bound memory
            own = np.flatnonzero(block == k)
            out[own] = self._log10(grams[own])
        return out

    def _log10(self, grams: np.ndarray) -> np.ndarray:
        product, (own, which) = np.ones(len(grams)), _five(grams)
        kinds = np.arange(len(WORD_SEEN) + 1)
        refine = None if self.refine is None else np.r_[1 - self.refine, self.refine].astype(np.float32)  # for bits 0, then 1
        for bit in range(8):
            x, gate, last = self.lower(own, bit)
            x[:, ORDERS - 1] = 0
            base = np.stack([np.einsum("ij,ij->i", x, self.weights[gate + k]) for k in kinds], 1).ravel()  # all but the word's part
            for at in range(0, len(grams), 1 << 15):
                g, w = grams[at : at + (1 << 15)], which[at : at + (1 << 15)]
                p, total = self._predict(self.words, word_slots(g, bit), last[w], None)
                kind = WORD_KIND[np.minimum(total, WORD_SEEN[-1]).astype(np.int64)]
                z = base[w * len(kinds) + kind] + np.log(p / (1 - p)) * self.weights[gate[w] + kind, ORDERS - 1]
                z = np.clip(z, np.float32(-EDGE * 2), np.float32(EDGE * 2))
                y = bit_of(g, bit)
                p = _squash(z * (2 * y - 1).astype(np.float32))  # of the bit itself
                if refine is not None:
                    cell, part = self.cells(g, bit, z)
                    cell += y * len(self.refine)
                    p = np.float32(0.5) * (p + refine[cell] + (refine[cell + 1] - refine[cell]) * part)
                product[at : at + (1 << 15)] *= p
        return np.log10(product)


def _five(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct five-byte strings, and which of them each string has."""
    codes, values = pd.factorize(grams & LOW)
    return values, codes


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, values = pd.factorize(keys)
    return values, np.bincount(codes, minlength=len(values))


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_counted() for many keys that repeat, ascending; sorts them in place."""
    keys.sort()
    last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], np.ones(min(1, len(keys)), bool)])
    return keys[last], np.diff(last, prepend=-1)


def gather(training: DataFrame, text_col: str = "text") -> DataFrame:
    """kind (1: token hashes, 2: texts, 3: pairs of short words in a row), key, n of the training texts."""

    def count(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, keys in held.items():
            values, n = _counted(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), pa.array(values), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        size = 0
        for _, raw, at in pieces(batches, text_col):
            raw = LOWERED[raw]
            begin, end, first = tokens(raw, at)
            h = mix64(span_hashes(raw, begin, end, mixed=False))
            short = short_words(begin, end, h)
            where = np.flatnonzero(short >= 0)
            row = np.searchsorted(first, where, "right")
            both = np.flatnonzero(row[1:] == row[:-1]) if len(row) else where
            held[1].append(h.view(np.int64))
            held[2].append(np.zeros(len(at) - 1, np.int64))
            held[3].append(short[where[both]] * SHORT + short[where[both + 1]])
            size += len(raw)
            if size > 24 << 20:
                yield from count(held)
                held, size = {1: [], 2: [], 3: []}, 0
        if held[2]:
            yield from count(held)

    rows = training.select(F.col(text_col)).mapInArrow(trimmed(run), "kind byte, key long, n long")
    return kept(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def group_short(counts: DataFrame) -> np.ndarray:
    """The group of each bucket of short words (-1: rare), by which buckets follow each other; at most SHORT**2 rows."""
    near = np.zeros((SHORT, SHORT))
    for row in counts.where("kind = 3").collect():
        near[row["key"] // SHORT, row["key"] % SHORT] = row["n"]
    near = near + near.T
    mass = near.sum(1)
    use = np.flatnonzero(mass > mass.sum() * 0.001)
    group = np.full(SHORT, -1)
    if len(use) <= GROUPS:
        group[use] = np.arange(len(use))
        return group
    part = near[np.ix_(use, use)]
    part = part / np.sqrt(np.outer(part.sum(1) + 1e-9, part.sum(1) + 1e-9))
    vectors = np.linalg.eigh(part)[1][:, -GROUPS:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = [vectors[np.argmax(mass[use])]]
    while len(centres) < GROUPS:  # farthest first, then k-means
        centres.append(vectors[np.argmin(np.max(np.stack(centres) @ vectors.T, axis=0))])
    for _ in range(20):
        own = np.argmax(vectors @ np.stack(centres).T, axis=1)
        centres = [vectors[own == k].mean(0) if (own == k).any() else centres[k] for k in range(GROUPS)]
    group[use] = own
    return group


def strings(training: DataFrame, group: np.ndarray, parts: int, text_col: str = "text") -> DataFrame:
    """Strings of the training texts and tables of them: kind, at, keys, n (arrays as binaries).

    kind 0: strings (as of stream()) and how often they occur, each once; kind 1: five-byte strings and how often they
    occur in a part, by groups `at`; kind 2: slice `at` of the word table, packed. The strings are dealt to `parts`
    tasks by slice, so that a slice is made by one task; they travel as arrays and not as rows.
    """
    buckets = min(MOST, 4 * parts)
    bounds = np.arange(1, buckets, dtype=np.uint64) * np.uint64(MOST) // np.uint64(buckets) << np.uint64(64 - SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # counted by parts, then together
        for _, raw, at in pieces(batches, text_col, 3 << 20):
            held.append(_sorted(_streams(raw, at, group)[0]))
            if sum(len(n) for _, n in held) > HELD:
                yield from dealt(*_folded(held))
        if held:
            yield from dealt(*_folded(held))

    def dealt(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key.view(np.uint64))
        key, n = key[order], n[order]
        yield from _arrays(0, np.arange(buckets), key, n, np.r_[0, np.searchsorted(key.view(np.uint64), bounds), len(key)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, least = [], 0, 1 << 20
        for b in batches:
            for pair in _read(b):
                held.append(pair)
                rows += len(pair[0])
                if rows > least:
                    held = [_folded(held)]
                    rows = len(held[0][0])
                    least = max(least, 2 * rows)
        if not held:
            return
        key, n = _folded(held)
        order = np.argsort(key.view(np.uint64))  # the same order in each run
        key, n = key[order], n[order]
        edges = np.r_[0 : len(key) : STRETCH, len(key)]
        yield from _arrays(0, np.zeros(len(edges) - 1, np.int64), key, n, edges)
        five, often = _folded([(key & LOW, n)])
        own = (mix64(five.view(np.uint64) >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(FIVES)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        yield from _arrays(1, np.arange(FIVES), five[order], often[order], np.searchsorted(own[order], np.arange(FIVES + 1)))
        of = key.view(np.uint64) >> np.uint64(64 - SLICE_BITS)
        edges = np.searchsorted(of, np.arange(0, MOST + TURN, TURN, dtype=np.uint64))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low < high:
                yield from slices(of[low:high], key[low:high], n[low:high].astype(np.float64))

    def slices(of: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine, place = np.unique(of, return_inverse=True)
        table = np.zeros(2 * len(mine) * WIDE)
        for bit in range(8):
            np.add.at(table, (bit_of(key, bit) * len(mine) + place) * WIDE + (word_slots(key, bit) & WIDE - 1), n)
        table, words = table.reshape(2, -1), np.zeros(len(mine) * WIDE, np.uint32)
        used = np.flatnonzero(table.any(0))
        words[used] = packed(*table[:, used])
        yield from _arrays(2, mine.astype(np.int64), words, words[:0].astype(np.int64), np.arange(len(mine) + 1) * WIDE)

    schema = "kind byte, at long, keys binary, n binary"
    rows = training.select(F.col(text_col)).mapInArrow(trimmed(run), schema).repartition(parts, "at")
    return kept(rows.mapInArrow(trimmed(build), schema))


def _arrays(kind: int, at: np.ndarray, keys: np.ndarray, n: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of strings()'s columns: for each `at` the keys and counts between two edges; none where there are none."""
    for first in range(0, len(at), 64):
        use = [k for k in range(first, min(first + 64, len(at))) if edges[k + 1] > edges[k]]
        cut = [pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in use], pa.binary()) for x in (keys, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), kind, np.int8)), pa.array(at[use].astype(np.int64)), *cut], ["kind", "at", "keys", "n"])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys and counts of strings()'s rows."""
    keys, n = (batch.column(batch.schema.get_field_index(c)) for c in ("keys", "n"))
    for k, c in zip(keys, n, strict=True):
        yield np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64)


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts; empties the list."""
    codes, values = pd.factorize(np.concatenate([v for v, _ in held]))
    n = np.bincount(codes, np.concatenate([n for _, n in held]), len(values)).astype(np.int64)
    held.clear()
    return values, n


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings of a task with their counts, by long stretches, each in a fixed pseudorandom order."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        grams, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        order = np.argsort(mix64(grams.view(np.uint64)))
        return grams[order], n[order]

    for b in batches:
        for pair in _read(b):
            held.append(pair)
            if sum(len(x) for x, _ in held) >= 1 << 19:
                yield joined()
    if held:
        yield joined()


def byte_tables(made: DataFrame, parts: int = 16) -> np.ndarray:
    """The packed table of byte contexts from strings().

    Five-byte strings are dealt by the two bytes before the last, so that slots of the higher orders are met by one
    task for the most part; the driver adds up what is left, which is bounded by the table's size times `parts`.
    """
    total = int(OFFSET[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            own, n = _folded(list(_read(b)))
            n = n.astype(np.float64)  # as the table, else add.at is slow
            table = np.zeros(2 * total) if table is None else table
            for bit in range(8):
                y = bit_of(own, bit) * total
                for at in byte_slots(own, bit):
                    np.add.at(table, at + y, n)
        if table is not None:
            table = table.reshape(2, total)
            used = np.flatnonzero(table.any(0))
            for k in range(0, len(used), 1 << 16):
                u = used[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (u.astype(np.int32), table[0, u], table[1, u])], ["slots", "n0", "n1"])

    dealt = made.where("kind = 1").repartition(parts, "at").select("keys", "n")
    sums = np.zeros((2, total))
    made = kept(dealt.mapInArrow(trimmed(count), "slots binary, n0 binary, n1 binary"))
    for row in made.toLocalIterator():
        slots = np.frombuffer(bytes(row["slots"]), np.int32)
        sums[0, slots] += np.frombuffer(bytes(row["n0"]))
        sums[1, slots] += np.frombuffer(bytes(row["n1"]))
    made.unpersist()
    return packed(*sums)


def train(made: DataFrame, tasks: int = 1) -> tuple[Broadcast, np.ndarray | None, np.ndarray | None]:
    """The model from strings(): its tables (of one size for any corpus) as a broadcast, weights, refining map.

    Each of the tasks learns weights of its own; they are averaged by the curvature that they were learned from, first
    in small groups of tasks.
    """
    spark = made.sparkSession
    words = np.zeros(1 << WORD_BITS, np.uint32)
    for row in made.where("kind = 2").select("at", "keys").repartition(16, "at").toLocalIterator():
        words[row["at"] * WIDE : (row["at"] + 1) * WIDE] = np.frombuffer(bytes(row["keys"]), np.uint32)
    shared = spark.sparkContext.broadcast(Tables((byte_tables(made), words)))
    del words
    sizes = (GATES * (ORDERS + 1), GATES * (ORDERS + 1), 2 * 256 * STEPS)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, met = Model(shared.value), np.zeros((2, 256 * STEPS)), False
        for g, n in _columns(batches):
            own.learn(g, n, seen)
            met = True
        if met:
            yield sums(np.concatenate([(own.weights * own.curve).ravel(), own.curve.ravel(), seen.ravel()]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in b.column(0).to_pylist())  # a fixed order of additions
        if rows:
            yield sums(np.sum([np.frombuffer(x) for x in rows], axis=0))

    def sums(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["sums"])

    learned = made.where("kind = 0").select("keys", "n").coalesce(tasks).mapInArrow(trimmed(weigh), "sums binary")
    rows = learned.repartition(16, F.xxhash64("sums")).mapInArrow(add, "sums binary").collect()
    if not rows:
        return shared, None, None
    weights, curve, seen = np.split(np.sum(sorted((np.frombuffer(bytes(r["sums"])) for r in rows), key=bytes), axis=0), np.cumsum(sizes)[:-1])
    return shared, (weights / curve).reshape(GATES, ORDERS + 1), Model.settled(seen.reshape(2, -1))


def frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of frequent tokens, and these (at most HOT): hashes, ascending, and counts."""
    band = F.floor(F.log2("n") * 8).cast("int")
    bands = sorted(counts.where("kind = 1").groupBy(band.alias("band")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect(), reverse=True)
    least, room = None, HOT
    for _, number, low in bands:  # a few hundred rows at most
        room -= number
        if room < 0:
            break
        least = low
    if least is None:
        return 1 << 62, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(f"kind = 1 and n >= {least}").select("key", "n").toArrow()
    key, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(key)
    return least, key[order], n[order]


def _streams(raw: np.ndarray, at: np.ndarray, group: np.ndarray, part: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """read(), made in small parts that stay in the processor's cache."""
    out, row, done = np.empty(len(raw) + len(at) - 1, np.int64), 0, 0
    hashes, first = [np.zeros(0, np.uint64)], np.zeros(len(at), np.int64)
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + part, "right")) - 1)
        own, h, words = read(raw[at[row] : at[end]], at[row : end + 1] - at[row], group)
        out[done : done + len(own)] = own
        first[row : end + 1] = first[row] + words
        hashes.append(h)
        row, done = end, done + len(own)
    return out, np.concatenate(hashes), first


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    counts = gather(docs.where(training), text_col)
    n, v, texts = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)), F.count_if(F.col("kind") == 1), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0))).first()
    n, v = n + texts, v + (texts > 0)
    least, hot, often = frequent(counts)
    group = group_short(counts)
    parts = int(np.clip(n // PART, 1, MOST))
    met = strings(docs.where(training), group, parts, text_col)
    tables, weights, refine = train(met, max(1, parts // 4))
    met.unpersist()
    shared = spark.sparkContext.broadcast((hot, often))
    unit = lambda c: np.rint(np.log10(c + 1.0) / UNIT).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = shared.value
        model = Model(tables.value, weights, refine)
        units = unit(often)
        held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []  # strings of several parts are scored together
        apart: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            trim()
            sizes, values = [len(v) for v in apart], np.concatenate(apart)
            apart.clear()
            order = np.argsort(values)  # less memory than a hash table
            values, order = values[order], order.astype(np.int32)
            new = np.r_[np.ones(1, bool), values[1:] != values[:-1]]
            values, score, done = values[new], np.empty(len(order)), 0
            score[order] = model.log10(values)[np.cumsum(new) - 1]
            del order, new, values
            for (columns, codes, begin), size in zip(held, sizes, strict=True):
                total = np.add.reduceat(score[done : done + size][codes], begin)
                done += size
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total)], ["row", "id", "words", "known", "units", "rare", "n_bytes", "score"])
            held.clear()

        for part, raw, at in pieces(batches, "text", 2 << 20):
            grams, h, first = _streams(raw, at, group)
            codes, values = pd.factorize(grams)
            codes, h, grams = codes.astype(np.int32), h.view(np.int64), None
            which, distinct = pd.factorize(h)
            place = np.minimum(np.searchsorted(hot, distinct), max(0, len(hot) - 1))
            met = hot[place] == distinct if len(hot) else np.zeros(len(distinct), bool)
            known = met[which]
            upto = lambda x: np.diff(np.r_[0, np.cumsum(x)][first])
            base = upto(np.where(met, units[place], 0)[which] if len(hot) else np.zeros(len(h), np.int64))
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(~known)][first].astype(np.int32)), pa.array(h[~known]))
            ids = [part.column(k).take(pa.array(np.arange(part.num_rows))) for k in (0, 1)]  # copies, so that the texts can go
            held.append(([*ids, pa.array(np.diff(first)), pa.array(upto(known)), pa.array(base), rare, pa.array(np.diff(at))], codes, (at + np.arange(len(at)))[:-1]))
            apart.append(values)
            if sum(len(c) for _, c, _ in held) > TOGETHER:
                yield from flush()
        if held:
            yield from flush()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = kept(source.mapInArrow(trimmed(run), "row long, id long, words long, known long, units long, rare array<long>, n_bytes long, score double"))
    lookup = counts.where(f"kind = 1 and n < {least}").select("key", "n")
    found = scored.select("row", F.explode("rare").alias("key")).join(lookup, "key")
    found = found.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.round(F.log10(F.col("n") + 1.0) / UNIT).cast("long")).alias("extra"))
    out = scored.drop("rare").join(found, "row", "left")
    base = (F.col("units") + F.coalesce("extra", F.lit(0))) * UNIT + float(np.log10(texts + 1)) - (F.col("words") + 1) * float(np.log10(n + v + 1))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(texts > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "n_bytes",
    )


def op4_context_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    scores = lm_scores(docs, ~held_out)
    bits = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))

"""Toxicity by class-conditional Kneser-Ney models over words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from xxhash import xxh64_intdigest

from weftline.llm.common import by_group, fresh, held_out, in_batches, materialise, prepare, quoted, small, without_gc

#: Score from which a text is called toxic.
THRESHOLD = 0.3
#: Steps of evidence between 0 and 1 at which the labelled texts are counted for the logistic curve.
STEPS = 1 << 12
#: Discount of counts; pseudo-count of what no text has; words added to a text's length, which keep one of a few words, or none,
#: near ordinary texts; log-odds a word that count half in the logistic curve.
DISCOUNT, UNSEEN, LENGTH_PRIOR, HALF = 0.75, 0.5, 4.0, 0.015
#: Expressions of an order whose rates are expected to differ between the classes; all others make up the prior odds against it.
#: With an expression's likelihood ratio these give the weight of the class's own counts; the rest is the weight of the backoff.
TELLING = 4.0
#: A log-ratio nearer to zero than this is taken as the backoff's. Expressions of the models that the driver or a worker holds at a time (20 MB of
#: keys and weights): more come in lots, each of which has a pass over the texts.
LEAST_RATIO, MOST_EXPRESSIONS = 0.01, 500_000
#: Lengths of stems (first letters), to which words back off.
STEMS = (3, 4, 5, 6, 7)
#: Words whose ratios a worker keeps.
CACHED = 200_000
_WORD = re.compile(r"[^\W\d_]+")
ORDINARY, TOXIC = 0, 1
#: Kinds of counted expressions: a word, a word after another, all texts; and, by their second word, how many pairs have one text alone.
_OF_WORD, _OF_PAIR, _OF_TEXTS, _OF_SINGLES = range(4)
#: Counts on their way to the tasks that add them up: arrays of one block of texts. First words are numbers in a list of those there
#: are, second words come once with the length of their run, numbers of texts and masks as bytes where they fit (``many``, ``more``).
_BLOCK = "slot long, kind int, v binary, at binary, w binary, runs binary, cell binary, t binary, many binary, mark binary, more binary, heads binary"
#: Words of a block; texts for each of the ``SPREAD`` tasks that hold the pairs of one word.
WORDS_A_BLOCK, TEXTS_A_TASK, SPREAD = 600_000, 4000, 4
#: Texts (t) and context marks (m) of each class and half of the texts.
_CELLS = [f"{c}{h}" for h in (0, 1) for c in (ORDINARY, TOXIC)]
_COUNTED = "kind int, v long, w long, head string, " + ", ".join(f"{x}{c} long" for x in "tm" for c in _CELLS)
_EXPRESSION = "level long, v long, w long, rest double, toxic double, ordinary double"
_START = 1
#: Expected numbers are summed as whole multiples of this part of one, so that no order of the sum shows.
_PART = 1 << 28


#: The same split for texts in Latin-1: what is no letter of a word becomes a space.
_LETTERS = bytes(b if _WORD.fullmatch(chr(b)) else 0x20 for b in range(256))


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def code(word: str) -> int:
    """A word or stem as a signed 64-bit hash."""
    h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


# --- scoring -----------------------------------------------------------------------------------------------------------------


class Curve:
    """What turns a text's log-odds into its score."""

    def __init__(self) -> None:
        self.slope, self.middle, self.usual = 1.0, 0.0, 0.0


class KneserNey(Curve):
    """Both class models where they differ. Each expression e has the odds of toxic to ordinary

        (rest x backoff + own toxic) / (rest + own ordinary)

    with its own discounted probabilities (weighed, relative to the shared one) and the weight ``rest`` of the backoff, whose
    odds are those of the next shorter expression: word after word, word, stems from long to short, nothing (the classes share it:
    odds 1). Pairs of a lot of larger models (``Lots``) come with what they add to the words' log-odds, alone.
    """

    def __init__(self, words: dict[int, tuple[float, float, float]], after: dict[int, dict[int, tuple[float, float, float]]], stems: dict[int, tuple[float, float, float]]) -> None:
        super().__init__()
        self.words, self.after, self.stems = words, after, stems
        self.cache: dict[str, float] = {}
        self.heads: dict[str, dict[int, tuple[float, float, float]]] = {}

    @staticmethod
    def _beyond(backoff: float, own: tuple[float, float, float]) -> float:
        rest, toxic, ordinary = own
        return math.log((rest * math.exp(backoff) + toxic) / (rest + ordinary))

    def ratio(self, word: str) -> float:
        """The word's log-odds."""
        if (r := self.cache.get(word)) is None:
            raw, r = word.encode("utf-8", "surrogatepass"), 0.0
            plain = len(raw) == len(word)
            for n in STEMS:
                if len(word) <= n:
                    break
                h = xxh64_intdigest(raw[:n] if plain else word[:n].encode("utf-8", "surrogatepass"))  # ``code``, without a call
                if (own := self.stems.get(h - (1 << 64) if h >> 63 else h)) is not None:
                    r = self._beyond(r, own)
            h = xxh64_intdigest(raw)
            h = h - (1 << 64) if h >> 63 else h
            if (own := self.words.get(h)) is not None:
                r = self._beyond(r, own)
            if len(self.cache) > CACHED:
                self.cache.clear()
                self.heads.clear()
            self.cache[word] = r
            if h in self.after:
                self.heads[word] = self.after[h]
        return r

    def folded(self, stems: list[int], w: int) -> float:
        """The log-odds of a word by its code and those of its stems, short to long."""
        r = 0.0
        for own in [*map(self.stems.get, stems), self.words.get(w)]:
            if own is not None:
                r = self._beyond(r, own)
        return r

    def forget(self) -> None:
        """Let go of all words' ratios: a worker that waits keeps the models alone."""
        self.cache, self.heads = {}, {}

    def log_odds(self, words: list[str]) -> float:
        """Toxic minus ordinary log-likelihood of the words, each given the one before."""
        found = list(map(self.cache.get, words))
        if None in found:
            for k in [k for k, r in enumerate(found) if r is None]:
                found[k] = self.ratio(words[k])
        total = sum(found)
        if (heads := self.heads) and not heads.keys().isdisjoint(words):
            for k in [k for k, w in enumerate(words[:-1]) if w in heads]:
                if (own := heads[words[k]].get(code(words[k + 1]))) is not None:
                    if len(own) == 1:
                        total += own[0]
                        continue
                    rest, toxic, ordinary = own
                    total += math.log((rest * math.exp(found[k + 1]) + toxic * math.exp(-found[k])) / (rest + ordinary)) - found[k + 1]
        return total

    def evidence(self, total: float, length: int) -> float:
        """Log-odds normalised by the text's length, beyond those of ordinary texts, between -1 and 1."""
        x = (total - self.usual * length) / (length + LENGTH_PRIOR)
        return x / (abs(x) + HALF)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(self.log_odds(words), len(words)) - self.middle), -30, 30))))


class Lots(Curve):
    """Models of more than ``MOST_EXPRESSIONS`` expressions as a table (lot, level, v, w, rest, toxic, ordinary), of which one lot is held at a time. A word
    and its stems are in one lot, so each lot gives a part of a text's log-odds, and these add up."""

    def __init__(self, parts: DataFrame, lots: int) -> None:
        super().__init__()
        self.parts, self.lots = parts, lots

    def lot(self, k: int) -> KneserNey:
        return _of_rows(self.parts.filter(F.col("lot") == k).collect())


def _of_rows(rows: list) -> KneserNey:
    """The model of rows (level, v, w, rest, toxic, ordinary); a pair without ``toxic`` adds ``rest``."""
    model = KneserNey({r.w: (r.rest, r.toxic, r.ordinary) for r in rows if r.level == 0}, {}, {r.w: (r.rest, r.toxic, r.ordinary) for r in rows if r.level == 2})
    for r in rows:
        if r.level == 1:
            model.after.setdefault(r.v, {})[r.w] = (r.rest,) if r.toxic is None else (r.rest, r.toxic, r.ordinary)
    return model


# --- counting ----------------------------------------------------------------------------------------------------------------


def _grouped(v: np.ndarray, w: np.ndarray, u: np.ndarray | None, text: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
    """v, w, cell, texts and mask of context marks ``u`` for each (v, w) in each cell, by w and v. Words come by cell and text."""
    order = np.lexsort((v, w)) if v.any() else np.argsort(w, kind="stable")
    v, w, cell, text = v[order], w[order], cell[order], text[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (cell[1:] != cell[:-1])))
    first = np.flatnonzero(new)
    new[1:] |= text[1:] != text[:-1]
    v, w, cell, t = v[first], w[first], cell[first], np.add.reduceat(new, first, dtype=np.int64)
    mark = np.zeros(len(first), np.int64) if u is None else np.bitwise_or.reduceat(np.left_shift(np.int64(1), u[order] & 63), first)
    return v, w, cell, t, mark


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin; ``x`` is not empty."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))


def _index(values: int) -> str:
    """The type of numbers in a list of so many values."""
    return "<u2" if values <= 1 << 16 else "<u4"


def _packed(kind: int, slots: int, v: np.ndarray, w: np.ndarray, cell: np.ndarray, t: np.ndarray, mask: np.ndarray, heads: dict[int, str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_BLOCK``; a mask of one mark is a byte, and so is a number of fewer than 255 texts."""
    spread = w >> 32 if kind == _OF_WORD else v
    slot = (w.view(np.uint64) % np.uint64(slots // SPREAD)).astype(np.int64) * SPREAD + (spread & (SPREAD - 1))
    order = np.argsort(slot, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
        m, n, second = mask[mine].view(np.uint64), t[mine], w[mine]
        one, runs = np.bitwise_count(m) == 1, _starts(second)
        mark = np.where(one, np.bitwise_count(m - np.uint64(1)), 64)
        firsts, at = np.unique(v[mine], return_inverse=True)
        length = np.diff(runs, append=len(mine))
        arrays = (firsts.astype("<i8"), at.astype(_index(len(firsts))), second[runs].astype("<i8"), length.astype("u1" if length.max() < 256 else "<u4"), cell[mine].astype("u1"))
        arrays += (np.minimum(n, 255).astype("u1"), n[n >= 255].astype("<u4"), mark.astype("u1"), m[~one].astype("<u8"))
        names = "\n".join([heads.get(x, "") for x in second.tolist()]).encode() if heads else b""
        yield pa.RecordBatch.from_arrays([pa.array([int(slot[mine[0]])], pa.int64()), pa.array([kind], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([names], pa.binary())], names=[f.split()[0] for f in _BLOCK.split(", ")])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """v, w, cell, texts and mask of rows of ``_packed``."""

    def column(name: str, dtype: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), dtype) for x in rows.column(name)]

    def filled(small: list[np.ndarray], large: list[np.ndarray], mark: int, out: np.ndarray) -> np.ndarray:
        out[np.concatenate(small) == mark] = np.concatenate(large)
        return out

    v = np.concatenate([x[np.frombuffer(at.as_buffer(), _index(len(x)))] for x, at in zip(column("v", "<i8"), rows.column("at"), strict=True)])
    runs = [np.frombuffer(n.as_buffer(), f"<u{n.as_buffer().size // len(x)}") for x, n in zip(column("w", "<i8"), rows.column("runs"), strict=True)]
    w = np.concatenate([np.repeat(x, n) for x, n in zip(column("w", "<i8"), runs, strict=True)])
    t, mark = column("t", "u1"), column("mark", "u1")
    mask = np.left_shift(np.uint64(1), np.concatenate(mark) & np.uint8(63), dtype=np.uint64)
    return v, w, np.concatenate(column("cell", "u1")), filled(t, column("many", "<u4"), 255, np.concatenate(t).astype(np.uint32)), filled(mark, column("more", "<u8"), 64, mask)


def counted(texts: DataFrame, slots: int) -> DataFrame:
    """Rows of ``_BLOCK`` of texts (label, half, text). A word that has stems carries its first letters; stems are counted from the
    grouped words."""

    def pack(parts: list[np.ndarray], of: list[int], heads: dict[int, str]) -> Iterator[pa.RecordBatch]:
        by_cell = np.argsort(of, kind="stable").tolist()
        parts, of = [parts[k] for k in by_cell], [of[k] for k in by_cell]
        n, cells = np.array([len(p) for p in parts]), np.array(of, np.uint8)
        here, zero = np.unique(cells), np.zeros(len(np.unique(cells)), np.int64)
        yield from _packed(_OF_TEXTS, slots, zero, zero, here, np.bincount(cells)[here], zero, {})
        if not n.sum():
            return
        w, text = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), n)
        at = np.concatenate(([0], np.cumsum(n)[:-1]))[n > 0]
        v = np.concatenate(([_START], w[:-1]))
        v[at] = _START
        u = np.concatenate(([_START], v[:-1]))
        u[at] = 2 * _START
        yield from _packed(_OF_PAIR, slots, *_grouped(v, w, u, text, cells[text]), {})
        yield from _packed(_OF_WORD, slots, *_grouped(np.zeros_like(w), w, None, text, cells[text]), heads or {0: ""})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads, parts, of, held = {}, {}, [], [], 0
        for batch in batches:
            for c, text in zip((2 * batch.column(1).to_numpy() + batch.column(0).to_numpy()).tolist(), batch.column(2), strict=True):
                words = words_of(text.as_py())
                found = list(map(known.get, words))
                if None in found:
                    for k in [k for k, h in enumerate(found) if h is None]:
                        if (h := known.get(x := words[k])) is None:
                            known[x] = h = code(x)
                            if len(x) > STEMS[0]:
                                heads[h] = x[: STEMS[-1] + 1]
                        found[k] = h
                parts.append(np.array(found, np.int64))
                of.append(c)
                held += len(words)
                if held >= WORDS_A_BLOCK:
                    yield from pack(parts, of, heads)
                    parts, of, held = [], [], 0
                    if len(known) > CACHED:
                        known, heads = {}, {}
        if parts:
            yield from pack(parts, of, heads)

    return in_batches(texts.select(F.col("label").cast("long"), F.col("half").cast("long"), "text"), run, _BLOCK)


def _added(table: pa.Table) -> pa.Table:
    """Rows of ``_COUNTED`` of one slot of ``_BLOCK``. A pair of one text alone says nothing by itself; such pairs come as their
    number and that of their context marks, by second word and cell (but for those that begin a text)."""
    names, out = [f.split()[0] for f in _COUNTED.split(", ")], []
    kinds = table.column("kind").to_pylist()
    for kind in (_OF_WORD, _OF_PAIR, _OF_TEXTS):
        rows = table.take(pa.array([k for k, x in enumerate(kinds) if x == kind], pa.int64()))
        if not rows.num_rows:
            continue
        v, w, cell, t, mask = _unpacked(rows)
        order = np.lexsort((cell, v, w))
        v, w, cell, t, mask = v[order], w[order], cell[order], t[order], mask[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        each = np.flatnonzero(new | np.concatenate(([True], cell[1:] != cell[:-1])))
        first, new, cell = np.flatnonzero(new), new[each], cell[each]
        t, mask = np.add.reduceat(t, each, dtype=np.int64), np.bitwise_or.reduceat(mask, each)
        v, w, heads, at = v[first], w[first], np.full(len(first), "", object), np.flatnonzero(new)
        if kind == _OF_WORD:
            heads = np.array([h for x in rows.column("heads") for h in x.as_py().decode().split("\n")], object)[order][first]
        single = (kind == _OF_PAIR) & (np.add.reduceat(t, at) == 1) & (v != _START)  # these have one cell, and are not spread over all
        many, group = ~single, np.cumsum(new) - 1
        more = np.flatnonzero(many[group])
        place = (cell[more], (np.cumsum(many) - 1)[group[more]])
        texts, marks = np.zeros((2, len(_CELLS), many.sum()), np.int64)
        texts[place], marks[place] = t[more], mask[more].view(np.int64)
        out.append([np.full(many.sum(), kind, np.int32), v[many], w[many], heads[many], *texts, *marks])
        if single.any():
            w, cell, bits = w[single], cell[at][single], np.bitwise_count(mask[at][single]).astype(np.int64)
            at = _starts(w)
            sums = [np.add.reduceat(np.where(cell == c, x, 0), at, dtype=np.int64) for x in (1, bits) for c in range(len(_CELLS))]
            out.append([np.full(len(at), _OF_SINGLES, np.int32), np.zeros(len(at), np.int64), w[at], np.full(len(at), "", object), *sums])
    return pa.table([pa.array(np.concatenate(x), pa.string()) if n == "head" else pa.array(np.concatenate(x)) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)


def _stems(words: DataFrame) -> DataFrame:
    """(w, t0, t1) of words (head, t0, t1): each stem once for every word that begins with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(0).to_pylist()
            at = [k for k, x in enumerate(heads) for n in STEMS if len(x) > n]
            stems = [code(x[:n]) for x in heads for n in STEMS if len(x) > n]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.int64()), *[batch.column(c).take(pa.array(at, pa.int64())) for c in (1, 2)]], names=["w", "t0", "t1"])

    return in_batches(words.filter("head != ''").select("head", "t0", "t1"), run, "w long, t0 long, t1 long")


def likelihood_ratio(k: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How surely counts k (2, expressions) out of ``of`` of each class have different rates: twice the log-likelihood ratio (G)."""
    whole, out = k.sum(0), np.zeros(k.shape[1])
    for c in (ORDINARY, TOXIC):
        for n, every in ((k[c], whole), (of[c] - k[c], of.sum() - whole)):
            expected = every * (of[c] / of.sum())
            out += 2 * np.where(n > 0, n * np.log(np.maximum(n, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    return out


def distinct_marks(masks: np.ndarray) -> np.ndarray:
    """How many distinct contexts set the bits of masks (linear counting; at most 266)."""
    bits = np.bitwise_count(masks.astype(np.int64).view(np.uint64)).astype(float)
    return np.where(bits >= 64, 64 * math.log(64), -64 * np.log(1 - np.minimum(bits, 63) / 64))


def weigh(k: np.ndarray, t: np.ndarray, total: np.ndarray, types: tuple[float, float, float], texts: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rest, own toxic, own ordinary, log-odds) of expressions with distinct contexts k and texts t, both (2, expressions); contexts are
    those expected in as many texts as the rarer class has (``count_models``), texts are all there are.

    A class's own probability is absolutely discounted, and the discounted mass spread by the counts that both classes share, the
    smaller of the two (``total``: contexts of all expressions of the order in either class, and shared; ``types``: expressions of
    either class, and in all). Probabilities are relative to that of both classes together. The weight of a class's own follows from how
    surely the rates differ, by contexts and by texts, in one direction (``full``: contexts are too many to tell); so rare
    expressions keep a little of their own, smoothed by the backoff.
    """
    t = np.minimum(t, texts[:, None])
    more = t[TOXIC] * texts[ORDINARY] > t[ORDINARY] * texts[TOXIC]
    by_text, by_context = likelihood_ratio(t, texts), likelihood_ratio(k, total[:2])
    same = full | ((k[TOXIC] * total[ORDINARY] > k[ORDINARY] * total[TOXIC]) == more)
    sure = np.where(same, np.minimum(np.where(full, by_text, by_context), by_text), 0.0)
    weight = 1 / (1 + np.exp(math.log(max(types[2] / TELLING, 1.0)) - np.minimum(sure / 2, 50)))
    pooled = (k.sum(0) + UNSEEN) / (total[:2].sum() + UNSEEN * types[2])
    shared = (k.min(0) + UNSEEN) / (total[2] + UNSEEN * types[2])
    there = 1 - (1 - texts.min() / texts[:, None]) ** t  # 1 or 0 in the rarer class
    own = [weight * (np.maximum(k[c] - DISCOUNT * there[c], 0) + DISCOUNT * types[c] * shared) / total[c] / pooled for c in (ORDINARY, TOXIC)]
    return 1 - weight, own[TOXIC], own[ORDINARY], np.log((1 - weight + own[TOXIC]) / (1 - weight + own[ORDINARY]))


#: Fewer texts of balanced classes cannot give an expression a log-ratio of ``LEAST_RATIO``; of others as many as are as telling.
_LEAST_TEXTS = 4


def _expected(n: Column, texts: tuple[int, int], c: int) -> Column:
    """The chance that any of n texts of a class is in a part of its texts that is as large as the rarer class: 1 or 0 in that class."""
    if texts[c] == min(texts):
        return F.when(n > 0, 1.0).otherwise(0.0)
    return F.lit(1.0) - F.exp(n * math.log1p(-min(texts) / texts[c]))


def _parts(x: Column) -> Column:
    return F.round(x * _PART).cast("long")


def _level(rows: DataFrame, level: int, texts: tuple[int, int], singles: tuple[tuple[int, int], tuple[int, int]] = ((0, 0), (0, 0))) -> DataFrame:
    """(level, v, w, rest, toxic, ordinary) of the expressions of one order that tell the classes apart; ``rows``: v, w,
    texts t0, t1 and expected contexts k0, k1 (in ``_PART``; or masks of all contexts, for level 1); ``singles``: numbers of further expressions of one text, and of their contexts."""
    k, of = [F.col("k0"), F.col("k1")], np.array(texts, float)
    if level == 1:  # of masks the bits are near enough for totals
        bits = [F.bit_count(c) for c in k]
        k = [_parts(b * _expected(F.greatest(F.col(f"t{c}") / F.greatest(b, F.lit(1)), F.lit(1.0)), texts, c)) for c, b in enumerate(bits)]
    there = [_expected(F.least(F.col(f"t{c}"), F.lit(texts[c])), texts, c) for c in (0, 1)]
    either = F.lit(1.0) - (F.lit(1.0) - there[0]) * (F.lit(1.0) - there[1])
    row = rows.agg(*map(F.sum, k), F.sum(F.least(*k)), *[F.sum(_parts(x)) for x in (*there, either)]).first()
    sums = np.array([(x or 0) / _PART for x in row])
    part = of.min() / of[:, None]
    (further, contexts) = (np.array(x) * part[:, 0] for x in singles)
    total, types = np.maximum(sums[:3] + [*contexts, 0], (1, 1, 0)), tuple(sums[3:] + [*further, further.sum()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, *rest = (batch.column(c).to_numpy() for c in range(6))
            k, t, full = np.stack(rest[2:]), np.stack(rest[:2]).astype(float), np.zeros(len(v), bool)
            if level == 1:  # the texts are taken as spread evenly over the contexts
                k = np.stack([distinct_marks(m) for m in k])
                full = (k > 180).all(0)
                k = k * (1 - (1 - part) ** np.maximum(t / np.maximum(k, 1), 1))
            else:
                k = k / _PART
            *own, ratio = weigh(k, t, total, types, of, full)
            keep = np.flatnonzero(np.abs(ratio) >= LEAST_RATIO)
            columns = [np.full(len(keep), level), v[keep], w[keep], *(x[keep] for x in own)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "v", "w", "rest", "toxic", "ordinary"])

    telling = sum(F.col(f"t{c}") * math.log(sum(texts) / texts[c]) for c in (0, 1))
    slim = rows.filter(F.col("t0") + F.col("t1") > 1).filter(telling >= _LEAST_TEXTS * math.log(2) - 1e-9).select("v", "w", "t0", "t1", "k0", "k1")
    return in_batches(slim, run, _EXPRESSION)


def _grams(texts: DataFrame, number: int) -> DataFrame:
    """Rows of ``_COUNTED`` of about so many texts, grouped over the whole table."""
    slots = SPREAD * -(-max(1, number) // TEXTS_A_TASK)
    return materialise(counted(texts, slots).groupBy("slot").applyInArrow(by_group(_added), _COUNTED), "grams")


def count_models(texts: DataFrame) -> KneserNey | Lots | None:
    """Both classes' models from all of ``texts`` (label 0 or 1, text); None if a class has no text.

    Every order counts distinct contexts: a word after another the words before both, a word the words before it, a stem the
    words that begin with it. So copies of a text, exact or near, add nothing, and a stem of a single word says nothing about
    others. Numbers of distinct contexts compare only between texts of like number. So all texts of both classes are counted, and each
    context of the larger class counts as the chance that one of its texts is among as many as the rarer class has: the
    number to be expected there, over every choice of them. Counts are grouped over the whole table; only expressions in which the classes
    differ reach the driver, and about ``MOST_EXPRESSIONS`` at a time.
    """
    return _model(_grams(texts.withColumn("half", F.lit(0)), texts.count()), (0,))


def _named(words: DataFrame) -> DataFrame:
    """(w, p) of words (w, head) and of their stems: ``p`` is what a word shares with all its stems, the code of the shortest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, p = [], []
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [w, *[code(x[:n]) for n in STEMS if len(x) > n]]
                codes += own
                p += [code(x[: STEMS[0]]) if x else w] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(p, pa.int64())], names=["w", "p"])

    return in_batches(words.select("w", "head"), run, "w long, p long").distinct()


def _ratios(rows: pa.Table) -> pa.Table:
    """(w, r) of the words (head) among rows that hold all expressions of them and of their stems too."""
    rows = rows.to_pylist()
    own = lambda level: {r["w"]: (r["rest"], r["toxic"], r["ordinary"]) for r in rows if r["level"] == level}
    model, words = KneserNey(own(0), {}, own(2)), [(r["w"], r["head"]) for r in rows if r["level"] is None]
    r = [model.folded([code(x[:n]) for n in STEMS if len(x) > n], w) for w, x in words]
    return pa.table({"w": pa.array([w for w, _ in words], pa.int64()), "r": pa.array(r, pa.float64())})


def _in_lots(expressions: DataFrame, words: DataFrame, lots: int) -> Lots:
    """``expressions`` (``_EXPRESSION``) dealt to lots, a word's with those of its stems; ``words``: w, head of every word. The log-odds of the words
    of pairs are worked out by lot too, so that a pair needs none but its own lot."""
    lot = F.pmod("p", F.lit(lots)).alias("lot")
    named = materialise(_named(words), "named")
    alone = expressions.filter("level != 1").join(named, "w").select(lot, "level", "v", "w", "rest", "toxic", "ordinary")
    pairs = expressions.filter("level = 1")
    of_pairs = pairs.select(F.explode(F.array("v", "w")).alias("w")).distinct().join(words.select("w", "head"), "w").join(named, "w").select(lot, "w", "head")
    ratios = alone.unionByName(of_pairs, allowMissingColumns=True).groupBy("lot").applyInArrow(by_group(_ratios), "w long, r double")
    ratios = materialise(ratios, "ratios")
    first, second = ratios.select(F.col("w").alias("v"), F.col("r").alias("_v")), ratios.select("w", F.col("r").alias("_w"))
    both = pairs.join(first, "v").join(second, "w")
    more = F.log((F.col("rest") * F.exp("_w") + F.col("toxic") * F.exp(-F.col("_v"))) / (F.col("rest") + F.col("ordinary"))) - F.col("_w")
    none = F.lit(None).cast("double")
    own = both.select(F.pmod(F.xxhash64("v", "w"), F.lit(lots)).alias("lot"), "level", "v", "w", more.alias("rest"), none.alias("toxic"), none.alias("ordinary"))
    return Lots(materialise(alone.unionByName(own), "lots"), lots)


def _model(grams: DataFrame, halves: tuple[int, ...] = (0, 1)) -> KneserNey | Lots | None:
    """The models of the texts of one half or both."""
    t = [sum(F.col(f"t{c}{h}") for h in halves).alias(f"t{c}") for c in (0, 1)]
    m = [F.col(f"m{c}{halves[0]}") if len(halves) == 1 else F.when(F.col("kind") == _OF_SINGLES, F.col(f"m{c}0") + F.col(f"m{c}1")).otherwise(F.col(f"m{c}0").bitwiseOR(F.col(f"m{c}1"))) for c in (0, 1)]
    grams = grams.select("kind", "v", "w", "head", *t, *[x.alias(f"m{c}") for c, x in enumerate(m)]).filter("t0 + t1 > 0")
    whole = {r.kind: tuple(x or 0 for x in r[1:]) for r in grams.filter(F.col("kind").isin(_OF_TEXTS, _OF_SINGLES)).groupBy("kind").agg(*[F.sum(f"{x}{c}") for x in "tm" for c in (0, 1)]).collect()}
    of = whole.get(_OF_TEXTS, (0, 0))[:2]
    if not all(of):
        return None
    one = whole.get(_OF_SINGLES, (0, 0, 0, 0))
    has = [F.sum(_parts(_expected(F.col(f"t{c}"), of, c))).alias(f"k{c}") for c in (0, 1)]
    pairs, zero = grams.filter(F.col("kind") == _OF_PAIR), F.lit(0).cast("long").alias("v")
    met = [F.when(F.col("kind") == _OF_PAIR, _parts(_expected(F.col(f"t{c}"), of, c))).otherwise(F.col(f"t{c}") * _parts(_expected(F.lit(1), of, c))) for c in (0, 1)]
    contexts = grams.filter(F.col("kind").isin(_OF_PAIR, _OF_SINGLES)).groupBy(F.col("w").alias("_w")).agg(*[F.sum(x).alias(f"k{c}") for c, x in enumerate(met)])
    every_word = grams.filter(F.col("kind") == _OF_WORD)
    words = materialise(every_word.join(contexts, F.col("w") == F.col("_w")).select(zero, "w", "k0", "k1", "t0", "t1"), "words")
    stems = materialise(_stems(every_word).groupBy("w").agg(*has, F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).select(zero, "w", "k0", "k1", "t0", "t1"), "stems")
    after = pairs.filter(F.col("v") != _START).select("v", "w", F.col("m0").alias("k0"), F.col("m1").alias("k1"), "t0", "t1")
    every = _level(words, 0, of).union(_level(after, 1, of, (one[:2], one[2:]))).union(_level(stems, 2, of))
    every = materialise(every, "expressions")
    if (n := every.count()) > MOST_EXPRESSIONS:
        return _in_lots(every, every_word.select("w", "head"), 2 * -(-n // MOST_EXPRESSIONS))
    return _of_rows(every.collect())


def calibrate(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and middle of a logistic curve through points that count so many times (Newton steps, lightly regularised towards slope 0)."""
    times = np.ones(len(x)) if times is None else times
    spread = math.sqrt(float(np.average((x - np.average(x, weights=times)) ** 2, weights=times))) or 1.0
    z, w = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (times * (p - y)) + np.array([0.01, 1e-6]) * w
        step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6]) + 1e-9 * np.eye(2), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(float(w[0]) / spread, 1e-6)
    return slope, float(-w[1] / slope)


def _key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _totals(texts: DataFrame, model: Lots) -> DataFrame:
    """(key, odds, n) of each distinct text (``_key``): the sum over all lots, each a pass in which no other is held."""
    parts, spark = [], texts.sparkSession
    keyed = texts.select(_key(F.col("text")).alias("key"), "text")
    for k in range(model.lots):
        shared = spark.sparkContext.broadcast(model.lot(k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                words = [words_of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.log_odds(w) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["key", "odds", "n"])
            m.forget()

        rows = in_batches(keyed, run, "key string, odds double, n long")
        parts.append(materialise(rows.groupBy("key").agg(F.max(F.round(F.col("odds") * 2.0**32).cast("long")).alias("odds"), F.max("n").alias("n")), "part"))
        shared.destroy()
    whole = reduce(DataFrame.union, parts).groupBy("key").agg((F.sum("odds") / 2.0**32).alias("odds"), F.max("n").alias("n"))
    return materialise(whole, "totals")


def _odds(texts: DataFrame, model: KneserNey | Lots) -> DataFrame:
    """(label, odds, n): log-odds and words of texts (label, text)."""
    if isinstance(model, Lots):
        return texts.select("label", _key(F.col("text")).alias("key")).join(_totals(texts, model), "key").select("label", "odds", "n")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.log_odds(w) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["label", "odds", "n"])
        m.forget()

    return in_batches(texts.select("label", "text"), run, "label int, odds double, n long")


def _usual(odds: DataFrame) -> float:
    """Log-odds a word of the ordinary texts of ``_odds``, summed as whole numbers."""
    row = odds.filter(F.col("label") == ORDINARY).agg(F.sum(F.round(F.col("odds") * 2.0**20).cast("decimal(20,0)")), F.sum("n")).first()
    return float(row[0] or 0) / 2.0**20 / max(1, row[1] or 0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> KneserNey | Lots | None:
    """Models of all labelled texts outside the held-out fold. They are counted in two halves (by a hash of the id): each half's own
    models weigh the texts of the other, which they have not seen, and all these texts place the logistic curve; the models of
    both halves together are returned. Counts of texts by label and step of evidence (``STEPS``) reach the driver. Texts of
    the same label, length and log-odds count once there."""
    prepare(docs.sparkSession)
    marked = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id")))
    marked = materialise(marked.distinct().withColumn("half", (F.xxhash64(F.lit(3), "doc_id") < 0).cast("int")), "marked")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(small(marked), F.col("_id") == F.col("doc_id")).select("label", "half", "text")
    grams = _grams(texts, marked.count())
    model = _model(grams)
    if model is None:
        return None
    places: dict[tuple[int, int], int] = {}
    usual: list[float] = []
    for half in (0, 1):
        if (other := _model(grams, (1 - half,))) is None:
            continue
        odds = materialise(_odds(texts.filter(F.col("half") == half), other).distinct(), "odds")
        usual.append(_usual(odds))
        x = (F.col("odds") - F.lit(usual[-1]) * F.col("n")) / (F.col("n") + LENGTH_PRIOR)
        for r in odds.groupBy("label", F.round(x / (F.abs(x) + HALF) * STEPS).cast("int").alias("step")).count().collect():
            places[r.label, r.step] = places.get((r.label, r.step), 0) + r["count"]
    model.usual = sum(usual) / max(1, len(usual))
    if len({label for label, _ in places}) == 2:
        y, x = np.array(sorted(places), float).T
        model.slope, model.middle = calibrate(x / STEPS, y, np.array([places[k] for k in sorted(places)], float))
    return model


def _scored_by_lots(docs: DataFrame, model: Lots, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with scores from the sums over all lots, joined by text."""
    key, odds, n = fresh(docs, "key", "odds", "n")
    totals = _totals(docs.select(*quoted([text_col])).toDF("text"), model).toDF(key, odds, n)
    x = (F.col(odds) - F.lit(model.usual) * F.col(n)) / (F.col(n) + LENGTH_PRIOR)  # as KneserNey.evidence and score
    z = F.lit(model.slope) * (x / (F.abs(x) + HALF) - F.lit(model.middle))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return docs.withColumn(key, _key(*quoted([text_col]))).join(small(totals), key).select(*quoted(docs.columns), score.alias(out_col))


def score_texts(docs: DataFrame, model: KneserNey | Lots | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added as ``out_col``, other columns unchanged; nothing is shuffled unless the models come in
    lots."""
    names = [n for n in docs.columns if n != out_col]
    kept = docs.select(*quoted(names))
    if isinstance(model, Lots):
        return _scored_by_lots(kept, model, text_col, out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_EXPRESSIONS
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        with without_gc():
            for batch in batches:
                found = [0.0 if m is None else m.score(v.as_py()) for v in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, out_col])
        if m is not None:
            m.forget()

    return in_batches(kept, run, StructType([*kept.schema.fields, StructField(out_col, DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold``).

    The models are counted over all labelled texts outside the held-out fold (``learn``); every whole text is
    then scored where it lies. Labels, language, source and id are never inputs of a score.

    Null text and text without words has no evidence and gets the score of that. A null id is not held out and not
    learned from; a label that is neither 0 nor 1 is ignored. If a class has no text every score is 0. Repeated rows are
    scored alike. An empty table gives an empty result. Other columns are ignored.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return score_texts(slim, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``score_toxicity`` predicts toxic, columns unchanged."""
    (name,) = fresh(docs, "toxicity")
    out = score_texts(docs, learn(docs, labels), out_col=name)
    return out.filter(F.col(name) < threshold).select(*quoted(docs.columns))

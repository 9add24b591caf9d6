"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_key, in_batches, kept, materialise, prepare, without_gc

WINDOW, END_ID = 4096, 2
#: Pieces that one task packs, on average.
PIECES_PER_GROUP = 20_000
#: Words whose ids a task keeps, in two generations: a full one becomes the old one, from which words in use are taken over.
CACHED = 200_000
_DOCS_AT_ONCE = 256
#: The normalisation, split and word ending of the tokenizers whose texts are encoded word by word. With any other
#: tokenizer every text is given to it whole.
_NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_ENDING = "</w>"
#: Characters (Latin-1) of ordinary texts. Within them that normalisation is lower-casing and white space, and the split is
#: ``_WORD``; a text with any other, or with what may be a special token, is given to the tokenizer whole.
_USUAL = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def is_usual(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _USUAL) and "<|" not in text
    except UnicodeEncodeError:
        return False


def splits_as_known(definition: str) -> bool:
    """Whether a tokenizer's definition has the normalisation, split and word ending that ``WordEncoder`` knows."""
    d = json.loads(definition)
    steps, splits = (d.get("normalizer") or {}).get("normalizers"), (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = splits[0].get("type") == "Split" and splits[0].get("pattern") == _SPLIT and splits[0].get("invert") and [x.get("type") for x in splits[1:]] == ["ByteLevel"]
    return steps == _NORMALISED and bool(known) and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex") and d["model"].get("end_of_word_suffix") == _ENDING


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own: each distinct word is encoded once
    and kept while in use. A tokenizer that splits in another way than the known one encodes every text whole."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_word = splits_as_known(definition)
        self.of_words = Tokenizer(self.tokenizer.model)  # the same model for words of usual texts: they are normalised and split already
        self.of_words.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_ENDING)]] = True  # the last id of every word, and no other

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets, which nothing needs

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {}
        new = []
        for w in words:
            if (held := self.old.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = held
        if new:
            ids = self._ids(self.of_words, " ".join(new))
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            self.known.update(zip(new, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))

    def forget(self) -> None:
        """Let go of all words: a worker that is used again keeps the tokenizer alone."""
        self.known, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object per text."""
        out, gaps, look = [], [], self.known.get
        for t in texts:
            if not self.by_word or not is_usual(t):
                out.append([self._ids(self.tokenizer, t).tobytes()])
                continue
            words = _WORD.findall(t.lower())
            ids = list(map(look, words))
            if None in ids:
                gaps.append((len(out), [(k, words[k]) for k, x in enumerate(ids) if x is None]))
            out.append(ids)
        if gaps:
            self._learn({w for _, found in gaps for _, w in found})
            known, old = self.known, self.old
            for at, found in gaps:
                ids = out[at]
                for k, w in found:
                    ids[k] = known[w] if w in known else old[w]
        return [b"".join(x) for x in out]


def _encoder(definition: str) -> WordEncoder:
    """One encoder per worker and definition, until the worker begins other work."""
    key, held = hash(definition), kept("packing")
    if key not in held:
        held[key] = WordEncoder(definition)
    return held[key]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each whole text's ids and ``END_ID``, cut at multiples of the
    window; ``ids`` (if asked for) is an array of ints."""
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size
    step, end = 4 * window, END_ID.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        try:
            with without_gc():
                for batch in batches:
                    for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                        ids, texts = (batch.column(k).slice(at, _DOCS_AT_ONCE).to_pylist() for k in (0, 1))
                        rows = []
                        for doc_id, raw in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                            raw += end
                            for k in range(0, len(raw), step):
                                cut = raw[k : k + step]
                                rows.append((doc_id, k // 4, len(cut) // 4, zlib.crc32(cut), len(raw) // 4, *[np.frombuffer(cut, "<u4").astype(np.int32)] * with_ids))
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) if n != "ids" else pa.array(list(c), pa.list_(pa.int32())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
        finally:
            encoder.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(slim, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids, "packing")


def fill_window(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum within ``room``.

    ``lengths`` are the keys of ``counts``, largest first. A bitset holds the sums that the lengths so far can make; a length
    that remains n times enters as 1, 2, 4, ... of it at once. It stops early once the room can be filled exactly. The
    counts are then read off backwards.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return used


def minimum_bin_slack(lengths: list[int], window: int = WINDOW) -> list[dict[int, int]]:
    """Windows as counts of lengths; together they use every length. Each takes the longest that remains and the fill that
    leaves it least slack."""
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    order, out = sorted(counts, reverse=True), []
    while order:
        first = order[0]
        counts[first] -= 1
        used = fill_window(counts, order, window - first)
        used[first] = used.get(first, 0) + 1
        counts[first] += 1
        gone = False
        for x, n in used.items():
            counts[x] -= n
            gone |= counts[x] == 0
        if gone:
            order = [x for x in order if counts[x]]
        out.append(used)
    return out


def _packed(pdf: pd.DataFrame, group: int, window: int) -> pd.DataFrame:
    """Give each piece of a group its sequence and offset."""
    pdf = pdf.sort_values("rid", kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    waiting: dict[int, list[int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[k]), []).append(k)
    sequence, offset, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), group << 32
    for used in minimum_bin_slack(lengths.tolist(), window):
        at = 0
        for x, n in used.items():
            for _ in range(n):
                k = waiting[x].pop()
                sequence[k], offset[k] = number, at
                at += x
        number += 1
    return pdf.assign(sequence_id=sequence, offset=offset)


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (of ``pieces``, without ids) with sequence_id and offset."""
    prepare(cut.sparkSession)
    held = materialise(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-held.count() // PIECES_PER_GROUP))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(pdf.drop(columns="group"), int(key[0]), window)

    dealt = held.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rid long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(by_key(run), shape).drop("rid")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with ``END_ID``; a document longer than the window is cut at multiples of it, any other stays whole.
    Pieces are dealt evenly to groups by a hash of the row, and each group fills one window after the other by a
    subset-sum over its remaining lengths; only the last window of a group can be left much short. Only lengths and
    checksums move; ids stay with their text (see ``sequences``).

    Null text is empty: one piece, ``END_ID``. Null ids and repeated rows are documents like any other. An empty table gives
    an empty result. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer_path, window, id_col, text_col), window)


def sequences(packed: DataFrame, with_ids: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, input_ids): the ids of each sequence, padded to the window unless their number is a power of two.

    ``with_ids``: ``pieces(..., with_ids=True)`` of the same documents, ids unique and not null. A sequence is bounded by the window.
    """
    parts = packed.select("doc_id", "start", "sequence_id", "offset").join(with_ids.select("doc_id", "start", "ids"), ["doc_id", "start"])
    joined = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    short = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("input_ids"))

"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textkit import freed, slices, texts_of

#: Words whose ids a task remembers, and bytes of text whose words are looked up at once.
CACHE_WORDS, BLOCK_BYTES = 250_000, 1 << 21
#: Ids that a task holds and packs together.
BUCKET_IDS = 1 << 20

#: A word of its own in the vocabulary, put between words that are encoded together.
_MARK = "\x01"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Punctuation that may end a word: neither part of a contraction nor of a special token.
_TAIL = b".,;:!?*$#%&()[]{}=+~^_/\\\"-"
#: What the tokenizer file must say for words to be encoded one by one.
_WORD_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "suffix": "</w>",
}


def _byte_letters() -> dict[int, int]:
    """What byte-level vocabularies write for each byte: itself if it is visible, else one of the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 0x100 + k for k, b in enumerate(hidden) if b != 0x20}


_LETTERS = _byte_letters()


class Encoder:
    """Ids of texts, exactly those of a tokenizer file.

    A vocabulary that lower-cases, drops white space and never joins across it
    or across a change between letters, digits and punctuation is served word by
    word, so words can be remembered; words of plain letters go through the bare
    merges of the same vocabulary, without its normaliser. Any other file
    encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        first = ((held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = held.get("normalizer") == _WORD_BY_WORD["normalizer"] and first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORD_BY_WORD["pattern"]} and model.get("end_of_word_suffix") == _WORD_BY_WORD["suffix"]
        # Words and, in their order, how many ids each has and the ids in one row.
        self.known, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")
        if not self.by_word:
            return
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(_WORD_BY_WORD["suffix"])]] = True

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters in one row, and how many are each word's: a word ends with its only id of a word's end."""
        parts = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 2048), len(words)), pa.int32()), words.view(pa.binary()))
        plain = [t.decode("latin-1") for t in pc.binary_join(parts, b" ").to_pylist()]
        plain = [t if t.isascii() else t.translate(_LETTERS) for t in plain]
        ids = [np.array(c.ids, dtype="<u4") for c in self.bare.encode_batch_fast(plain, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, dtype="<u4"), *ids])
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(size) != len(words):
            raise ValueError("a word of letters does not end with one id of a word's end")
        return flat, size

    def _marked(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any words, many at a time: a mark between words shows where each ends."""
        out: dict[bytes, bytes] = {}
        (mark,) = self.whole.encode(_MARK, add_special_tokens=False).ids
        plain = [w for w in words if _MARK.encode() not in w]
        parts = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for part, coded in zip(parts, self.whole.encode_batch_fast([f" {_MARK} ".join([w.decode() for w in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4")
            raw, edge = ids.tobytes(), np.flatnonzero(ids == mark)
            begins, ends = [0, *(4 * (edge + 1)).tolist()], [*(4 * edge).tolist(), len(raw)]
            out.update(zip(part, [raw[a:b] for a, b in zip(begins, ends, strict=True)], strict=True))
        for w in words if len(plain) < len(words) else ():
            if w not in out:
                out[w] = np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit values."""
        if not self.by_word:
            for t in texts:
                yield np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        for lo, hi in _runs([len(t) for t in texts], BLOCK_BYTES):
            if hi - lo == 1:
                yield b"".join([x for part in _segments(texts[lo]) for x in self._words([part])])
            else:
                yield from self._words(texts[lo:hi])

    def _words(self, texts: list[bytes]) -> Iterator[bytes]:
        """Splits and numbers all words outside of Python, which sees only words that are new."""
        column = pa.array(texts, pa.binary()).view(pa.string())
        special = pc.match_substring(column, "<|")
        listed = pc.ascii_split_whitespace(pc.if_else(special, column, pc.ascii_lower(column)))
        coded = listed.flatten().dictionary_encode()
        flat, size = self._coded(coded.dictionary)
        which = coded.indices.to_numpy()
        length = size[which]
        ids = _taken(flat, (np.cumsum(size, dtype=np.int32) - size)[which], length)
        edge = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(length, dtype=np.int32)))[listed.offsets.to_numpy()].tolist()
        for lo, hi in pairwise(edge):
            yield ids[lo:hi].tobytes()

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words in one row, and how many are each word's.

        Most words are Latin letters, with or without punctuation after them; what is looked up is then the letters and the punctuation.
        """
        stem = pc.ascii_rtrim(words, _TAIL.decode())
        plain = _latin(stem)
        data, edge = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), words.buffers()[1]
        edge = np.frombuffer(edge, dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
        tail = np.where(plain.to_numpy(zero_copy_only=False), np.diff(edge) - pc.binary_length(stem).to_numpy(), 0).astype(np.int32)
        tailed = np.flatnonzero(tail)
        length = tail[tailed]
        tails = pa.StringArray.from_buffers(len(tailed), pa.py_buffer(np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(length, dtype=np.int32)))), pa.py_buffer(_taken(data, edge[tailed + 1] - length, length)))
        keys = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(stem), words), tails]).dictionary_encode()
        flat, at, size = self._looked_up(keys.dictionary)
        which = keys.indices.to_numpy()
        # Of each word two runs, the second one empty where no punctuation is cut off.
        begin, length = np.zeros((2, len(words), 2), dtype=np.int32)
        begin[:, 0], length[:, 0] = at[which[: len(words)]], size[which[: len(words)]]
        begin[tailed, 1], length[tailed, 1] = at[which[len(words) :]], size[which[len(words) :]]
        return _taken(flat, begin.reshape(-1), length.reshape(-1)), length.sum(axis=1, dtype=np.int32)

    def _looked_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of ids, and where the ids of each of some different keys begin and how many they are; learns what is new."""
        where = pc.fill_null(pc.index_in(keys, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        new = np.flatnonzero(where < 0)
        fresh = keys.take(pa.array(new))
        # ASCII letters, other Latin letters, the rest.
        kind = 2 - _latin(fresh).to_numpy(zero_copy_only=False).astype(np.int8) - pc.ascii_is_alpha(fresh).to_numpy(zero_copy_only=False)
        order = np.argsort(kind, kind="stable")
        new, fresh, letters = new[order], fresh.take(pa.array(order)), int((kind < 2).sum())
        where[new] = len(self.known) + np.arange(len(new), dtype=np.int32)
        found, count = self._letters(fresh.slice(0, letters))
        split = [_parts(w) for w in fresh.slice(letters).view(pa.binary()).to_pylist()]
        raw = self._marked(list({x for both in split for x in both}))
        others = [raw[s] + raw[t] if t else raw[s] for s, t in split]
        flat = np.concatenate((self.flat, found, np.frombuffer(b"".join(others), dtype="<u4")))
        size = np.concatenate((self.size, count, np.fromiter(map(len, others), dtype=np.int64, count=len(others)) >> 2)).astype(np.int32)
        end = np.cumsum(size, dtype=np.int32)
        # Beyond the limit words are looked up anew in each block.
        if room := min(CACHE_WORDS - len(self.known), len(new)):
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.size, self.flat = size[: len(self.known)].copy(), flat[: end[len(self.known) - 1]].copy()
        return flat, (end - size)[where], size[where]


def _latin(words: pa.Array) -> pa.Array:
    """Whether words are of Latin letters whose lower case is one letter; others depend on what stands beside them."""
    return pc.and_(pc.utf8_is_alpha(words), pc.invert(pc.match_substring_regex(words, "[^\\x{00}-\\x{24F}]|\\x{130}")))


def _taken(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of a row one after the other."""
    end = np.cumsum(length, dtype=np.int32)
    return flat[np.repeat(begin - (end - length), length) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges that together hold ``most`` or are of one text."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and texts of a whole block, from several batches where texts are short, as each block is looked up among all known words."""
    keys, texts, held = [], [], 0
    for batch in batches:
        column = texts_of(batch.column(1))
        for lo, hi in slices(column, BLOCK_BYTES >> 3):
            size = int(column.size[lo:hi].sum()) + 8 * (hi - lo)
            if texts and held + size > BLOCK_BYTES:
                yield pa.concat_arrays(keys), texts
                keys, texts, held = [], [], 0
            keys.append(batch.column(0).take(pa.array(np.arange(lo, hi))))
            texts += column[lo:hi]
            held += size
    if texts:
        yield pa.concat_arrays(keys), texts


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while len(text) - at > BLOCK_BYTES and (blank := _BLANK.search(text, at + BLOCK_BYTES)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word's stem and the punctuation after it, whose ids one after the other are the word's."""
    stem = word.rstrip(_TAIL)
    if not word.isascii() or b"<|" in word:
        return word, b""
    return (stem.lower(), word[len(stem) :]) if stem.isalnum() else (word.lower(), b"")


def plan(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length, sequence and offset of each piece of documents of ``sizes`` ids.

    Whole sequences first. A remainder of r ids is of class capacity // r = k,
    and a bin of class k takes exactly k remainders, uncut (a class's last bin
    may hold fewer). As many bins as the remainders fill are kept, the fullest
    ones; what the others hold is laid into the gaps, in order, and cut where a
    gap ends. What is left then goes to sequences of powers of two. So nothing
    is padded.
    """
    full, rest = np.divmod(sizes.astype(np.int64), capacity)
    doc = np.repeat(np.arange(len(sizes)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    out = [(doc, start, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64))]
    d = np.flatnonzero(rest)
    if len(d):
        d = d[np.argsort(capacity // rest[d], kind="stable")]
        r, k = rest[d], capacity // rest[d]
        begin = sizes[d] - r
        head = (np.arange(len(d)) - np.searchsorted(k, k)) % k == 0
        which = np.cumsum(head) - 1
        before = np.cumsum(r) - r
        inside = before - before[head][which]
        fill = np.add.reduceat(r, np.flatnonzero(head))
        whole, tail = divmod(int(r.sum()), capacity)
        kept = np.zeros(len(fill), dtype=bool)
        kept[np.argsort(-fill, kind="stable")[:whole]] = True
        stays = kept[which]
        out.append((d[stays], begin[stays], r[stays], len(doc) + (np.cumsum(kept) - 1)[which[stays]], inside[stays]))
        # The ids of the other bins in one row, beside the gaps in one row; pieces end where either does.
        d, r, begin = d[~stays], r[~stays], begin[~stays]
        powers = [1 << j for j in reversed(range(tail.bit_length())) if tail >> j & 1]
        room = np.concatenate((capacity - fill[kept], np.array(powers, dtype=np.int64)))
        used = np.concatenate((fill[kept], np.zeros(len(powers), dtype=np.int64)))
        ends, gaps = np.cumsum(r), np.cumsum(room)
        edge = np.union1d(ends, gaps)
        edge = edge[edge > 0]
        at = np.concatenate((np.zeros(1, dtype=np.int64), edge[:-1]))[: len(edge)]
        i, g = np.searchsorted(ends, at, side="right"), np.searchsorted(gaps, at, side="right")
        out.append((d[i], begin[i] + at - (ends[i] - r[i]), edge - at, len(doc) + g, used[g] + at - (gaps[g] - room[g])))
    pieces = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.lexsort((pieces[1], pieces[0]))
    return tuple(c[order] for c in pieces)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Cut and pack documents; one row for each piece.

    Every task packs its own documents, some ``BUCKET_IDS`` ids at a time, as
    ``plan`` says: remainders of a reciprocal-capacity class share bins of a
    fixed count, uncut, and gaps are filled with pieces of the emptiest bins'
    documents. Nothing is shuffled or stored. Sequence ids hold the task's
    number, so a task that runs again replaces its own sequences as a whole.
    Rows that come out of a shuffle should be stored before, as their order, and
    so the packing, may differ in a second run.

    Returns ``id_col``, start, length, doc_tokens, sequence_id, offset,
    ids_crc32 and, if ``with_ids``, the ids as an array. A null text is an empty
    document and holds only ``end_id``. Null or repeated document ids are
    packed like others. Other columns are ignored; an empty table gives no rows.
    Ids are those of the tokenizer file without special tokens of its own.
    """
    if capacity < 1:
        raise ValueError("a sequence holds one id at least")
    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType
    source = documents.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def packed(keys: list[pa.Array], ids: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        doc, start, length, sequence, offset = plan(sizes, capacity)
        key = pa.concat_arrays(keys)
        crc = [zlib.crc32(memoryview(ids[d])[4 * a : 4 * (a + n)]) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        for lo in range(0, len(doc), 1024):
            part = slice(lo, lo + 1024)
            out = [key.take(pa.array(doc[part])), *[pa.array(c, pa.int64()) for c in (start[part], length[part], crc[part], sizes[doc[part]], base + sequence[part], offset[part])]]
            if with_ids:
                raw = b"".join([ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc[part].tolist(), start[part].tolist(), length[part].tolist(), strict=True)])
                edge = np.concatenate(([0], np.cumsum(length[part]))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(edge, pa.array(np.frombuffer(raw, dtype="<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        base, keys, ids, held = TaskContext.get().partitionId() << 32, [], [], 0
        for key, texts in _blocks(batches):
            keys.append(key)
            for raw in encoder.encode(texts):
                ids.append(raw + end)
                held += len(raw) // 4 + 1
            if held >= BUCKET_IDS:
                yield from packed(keys, ids, base)
                base, keys, ids, held = base + held // capacity + 64, [], [], 0
        if ids:
            yield from packed(keys, ids, base)

    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return source.mapInArrow(freed(pieces), schema)

"""Substring deduplication by relative Lempel-Ziv parsing over hashed reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, small_batches
from .textkit import Words, freed, gram, mix, signed, slices, texts_of

#: Words of the k-grams that choose a window's anchor.
SEED_WORDS = 6
_RUN_SALT = 0x2545F4914F6CDD1D
_LAST = (1 << 63) - 1


def _anchored(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that share an anchor: document, first window, count, seed hash, run hash.

    A window's anchor is its k-gram of least hash, the leftmost of equals, so equal
    windows have equal anchors, and runs of equal words govern equal windows.
    """
    w = Words(texts)
    n, width = len(w.hash), window - SEED_WORDS + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty, empty
    prefix, at = w.prefix(), np.arange(n - SEED_WORDS + 1)
    seed = gram(prefix, at, at + SEED_WORDS)
    start = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    if not len(start):
        return empty, empty, empty, empty, empty
    anchor = start + np.lib.stride_tricks.sliding_window_view(seed, width)[start].argmin(axis=1)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    edge = np.flatnonzero(new)
    first, count = start[edge], np.diff(edge, append=len(start))
    run = gram(w.prefix(_RUN_SALT), first, first + count - 1 + window)
    doc = w.doc[first]
    return doc, first - w.first[doc], count, signed(seed[anchor[edge]]), signed(run)


def _settled(a: np.ndarray, b: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among rows of equal (a, b): which are not the earliest, and the earliest's key and position."""
    order = np.lexsort((pos, key, b, a))
    head = np.ones(len(order), dtype=bool)
    sa, sb = a[order], b[order]
    head[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    ref_key, ref_pos = np.empty_like(key), np.empty_like(pos)
    ref_key[order], ref_pos[order] = key[lead], pos[lead]
    later = (key > ref_key) | ((key == ref_key) & (pos > ref_pos))
    return later, ref_key, ref_pos


_ROW = "a long, b long, dkey long, tag binary, place long, ref long"
_NAMES = ["a", "b", "dkey", "tag", "place", "ref"]


def _rows(a: np.ndarray, b: np.ndarray, key: np.ndarray, pos: np.ndarray, count: np.ndarray, tag: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows for the reference index; those that are settled within the batch go to spread keys.

    place: position << 8 | windows << 1 | settled.
    """
    done, ref_key, ref_pos = _settled(a, b, key, pos)
    place = (pos << 8) | (count << 1) | done.astype(np.int64)
    spread = signed(mix((key * 31 + pos).view(np.uint64)))
    cols = [pa.array(c) for c in (np.where(done, spread, a), np.where(done, ref_pos, b), key, place, np.where(done, ref_key, 0))]
    cols.insert(3, tag)
    for lo in range(0, len(a), 20_000):
        yield pa.RecordBatch.from_arrays([c.slice(lo, 20_000) for c in cols], _NAMES)


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _sources(rows: DataFrame, runs: bool) -> DataFrame:
    """Rows that start later than an equal one, with the earliest; for runs also those whose windows must be compared one by one."""
    rows = rows.withColumns({"f": F.shiftright("place", 8), "done": F.col("place").bitwiseAND(F.lit(1)) != 0})
    first = F.min(F.struct("dkey", "f")).over(Window.partitionBy("a", "b"))
    rows = rows.withColumn("src", first)
    if runs:
        by = Window.partitionBy("a")
        rows = rows.withColumn("mixed", F.min("b").over(by) != F.max("b").over(by))
    later = F.struct("dkey", "f") > F.col("src")
    kept = rows.where(F.col("done") | later | F.col("mixed") if runs else F.col("done") | later)
    item = F.struct(
        F.col("f").alias("start"),
        F.shiftright("place", 1).bitwiseAND(F.lit(127)).cast("int").alias("count"),
        (F.col("done") | later).alias("known"),
        F.when(F.col("done"), F.col("ref")).otherwise(F.col("src.dkey")).alias("ref"),
        F.when(F.col("done"), F.col("b")).otherwise(F.col("src.f")).alias("at"),
    )
    return kept.select("dkey", "tag", item.alias("item"))


def factors(n_windows: int, window: int, items: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, words, reference document, start there) of each factor of a document.

    items: (first window, windows, reference document, position there). A factor
    starts at the first window that has a source and goes on while the next
    window has the next position of the same reference as its source; windows
    point to their earliest source, so a factor also ends where the text goes on
    in a reference that is not the earliest one any more. The parse then
    restarts at that next window, so that windows across the boundary are
    checked as well: the spans together are all windows with a source.
    """
    ref = np.full(n_windows, -1, dtype=np.int64)
    at = np.zeros(n_windows, dtype=np.int64)
    has = np.zeros(n_windows, dtype=bool)
    for start, count, document, position in items:
        ref[start : start + count] = document
        at[start : start + count] = np.arange(position, position + count)
        has[start : start + count] = True
    where = np.flatnonzero(has)
    if not len(where):
        return []
    goes_on = (np.diff(where) == 1) & (np.diff(ref[where]) == 0) & (np.diff(at[where]) == 1)
    begin = where[np.concatenate(([True], ~goes_on))]
    end = where[np.concatenate((~goes_on, [True]))]
    return [(int(b), int(e - b + window), int(ref[b]), int(at[b])) for b, e in zip(begin, end, strict=True)]


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier is a smaller id or, in one document, a smaller start; windows are
    judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

    The reference is every document, indexed in blocks by the hash of an anchor
    k-gram; all windows governed by one anchor occurrence form a run, which is
    matched as a whole (128 bits). Where a block holds different runs of one
    anchor, the windows of each run's first occurrence are matched one by one,
    as they may agree in part. A document is then parsed greedily into factors of
    at least ``window`` words with their earliest source, and windows across
    factor boundaries are factors of their own. Equal runs in one batch are
    combined before the shuffle.

    Returns the columns of ``documents`` plus n_words, n_removed, kept_text (the
    kept words joined by one space) and factors (start, words, ref_id,
    ref_start); these replace columns of the same names. Null or blank texts
    have no words and an empty kept_text. Rows with a null id come after all
    others, as one document; rows of one id are one document, so equal starts in
    them are not earlier. Where ids are null or repeat, rows are told apart by
    128 bits of their text, so each keeps what is its own. An empty table gives
    no rows.
    """
    if window <= SEED_WORDS or window - SEED_WORDS >= 127:
        raise ValueError("window must be from 7 to 132 words")
    spark = documents.sparkSession
    small_batches(spark)
    n = partitions(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rest = [c for c in documents.columns if c != text_col and c not in ("n_words", "n_removed", "kept_text", "factors")]
    key = F.col(f"`{id_col}`").cast("long")
    # Without repeated ids a row is known by its id, and only rows without one need more.
    repeat = not documents.select(key.alias("id")).where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    unsure = (F.lit(repeat) | key.isNull()) & text.isNotNull()
    base = documents.select(
        F.coalesce(key, F.lit(_LAST)).alias("dkey"),
        # Never null, as seen by the optimiser too: else the inner join filters nulls and shuffles the texts again.
        F.coalesce(F.when(unsure, F.unhex(F.md5(text.cast("binary")))), F.lit(b"")).alias("tag"),
        text.alias("t"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
    )

    def joined_parts(parts: list[tuple]) -> list:
        *numbers, tags = zip(*parts, strict=True)
        return [*map(np.concatenate, numbers), pa.concat_arrays(tags)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag, texts = _ints(batch.column(0)), batch.column(1), texts_of(batch.column(2))
            parts = []
            for lo, hi in slices(texts):
                doc, first, count, seed, run = _anchored(texts[lo:hi], window)
                parts.append((seed, run, key[doc + lo], first, count, tag.take(pa.array(doc + lo))))
            if parts:
                yield from _rows(*joined_parts(parts))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag, texts = _ints(batch.column(0)), batch.column(1), texts_of(batch.column(2))
            opened = batch.column(3).to_pylist()
            parts = []
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi])
                at = [(i, x["start"], x["count"]) for i in range(lo, hi) for x in opened[i] or () if not x["known"]]
                doc, start, count = (np.array(v, dtype=np.int64) for v in (zip(*at, strict=True) if at else ((), (), ())))
                each = np.repeat(np.arange(len(doc)), count)
                pos = start[each] + np.arange(len(each)) - (np.cumsum(count) - count)[each]
                doc = doc[each]
                begin = w.first[doc - lo] + pos
                one, two = (signed(gram(w.prefix(salt), begin, begin + window)) for salt in (0, _RUN_SALT))
                parts.append((one, two, key[doc], pos, np.ones(len(pos), dtype=np.int64), tag.take(pa.array(doc))))
            if parts:
                yield from _rows(*joined_parts(parts))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, single = texts_of(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for text, runs, ones in zip(texts, marks, single, strict=True):
                words = text.split()
                items = [(x["start"], x["count"], x["ref"], x["at"]) for x in (*(runs or ()), *(ones or ())) if x["known"]]
                found = factors(max(0, len(words) - window + 1), window, items) if items else []
                if found:
                    keep = np.ones(len(words), dtype=bool)
                    for start, size, _, _ in found:
                        keep[start : start + size] = False
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    kept = words
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept), found), strict=True):
                    column.append(value)
            spans = pa.array([[dict(zip(("start", "words", "ref_id", "ref_start"), x, strict=True)) for x in f] for f in out[3]], span)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), spans], ["rest", "t", "n_words", "n_removed", "kept_text", "factors"])

    span = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "words", "ref_id", "ref_start")]))
    # Each text is shuffled once: both joins below read this exchange.
    keyed = base.repartition(n, "dkey", "tag")
    marks = _sources(base.drop("rest").mapInArrow(freed(index), _ROW), True).groupBy("dkey", "tag").agg(F.collect_list("item").alias("marks"))
    opened = marks.where(F.exists("marks", lambda x: ~x.known))
    near = keyed.join(opened, ["dkey", "tag"]).select("dkey", "tag", "t", "marks", "rest")
    ones = _sources(near.mapInArrow(freed(windows), _ROW), False).groupBy("dkey", "tag").agg(F.collect_list("item").alias("ones"))
    joined = keyed.join(marks, ["dkey", "tag"], "left").join(ones, ["dkey", "tag"], "left").select("dkey", "tag", "t", "marks", "ones", "rest")
    schema = f"rest {keyed.schema['rest'].dataType.simpleString()}, t string, n_words long, n_removed long, kept_text string, factors array<struct<start:long,words:long,ref_id:long,ref_start:long>>"
    done = joined.mapInArrow(freed(parse), schema)
    order = [F.col("t").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in documents.columns if c == text_col or c in rest]
    return done.select(*order, "n_words", "n_removed", "kept_text", "factors")

"""Benchmark decontamination: counted word pairs as seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches, stored
from .textkit import NOT_ALNUM, Words, freed, gram, signed, slices, texts_of

#: Bits of the seed filter, whatever the number of test items; the join on seeds decides.
FILTER_BITS = 25
#: Bits of the index of pairs by group of items, and groups (one bit each); fixed as well. Pairs of one slot share groups, which only adds candidates.
SLOT_BITS, GROUPS = 20, 64
#: Items of lengths up to this factor apart share one window of the document filter.
LENGTH_STEP = 1.1


def least_pairs(n: int, threshold: float) -> int:
    """Pairs of neighbouring words that an alignment of ``threshold`` holds of an item of ``n`` words.

    With m matches and e edits the score is m - e; the matches form at most
    e + 1 runs, and a run of k words holds k - 1 pairs: m - (e + 1) in all, the
    score less one. At least one pair is asked for, which follows from the
    score where it is two or more.
    """
    return max(1, ceil(threshold * n - 1e-9) - 1)


def most_words(n: int, threshold: float) -> int:
    """Words of the document that such an alignment spans: matches, and inserted words that leave the score."""
    return n + max(0, int((1 - threshold) * n + 1e-9))


def crowded(pos: np.ndarray, need: int, width: int) -> np.ndarray:
    """For ascending positions, whether each lies in a window of ``width`` words with ``need`` of them or more."""
    last = np.flatnonzero(pos[need - 1 :] - pos[: max(0, len(pos) - need + 1)] < width) if len(pos) >= need else np.zeros(0, dtype=np.int64)
    step = np.zeros(len(pos) + 1, dtype=np.int64)
    np.add.at(step, last, 1)
    np.add.at(step, last + need, -1)
    return np.cumsum(step)[:-1] > 0


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences (1 match, -1 mismatch, -1 gap) and where it ends and begins in ``text``.

    One row of the table for each word of ``item``; gaps along the row are a
    running maximum, so a row is a few array operations.
    """
    n = len(text)
    place = np.arange(1, n + 1)
    score, origin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best, end, begin = 0, 0, 0
    for word in item:
        diagonal = score[:-1] + np.where(text == word, 1, -1)
        above = score[1:] - 1
        take = diagonal >= above
        value, source = np.where(take, diagonal, above), np.where(take, origin[:-1], origin[1:])
        source = np.where(value > 0, source, place)
        value = np.maximum(value, 0)
        # value[j] - gaps from j on: a running maximum of value + position.
        lifted = (value + place) * (n + 1) + (n - place)
        top = np.maximum.accumulate(lifted)
        from_ = n - top % (n + 1) - 1
        value = top // (n + 1) - place
        source = np.where(value > 0, source[from_], place)
        value = np.maximum(value, 0)
        score = np.concatenate(([0], value))
        origin = np.concatenate(([0], source))
        j = int(value.argmax())
        if value[j] > best:
            best, end, begin = int(value[j]), j + 1, int(source[j])
    return best, begin, end


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.4,
) -> DataFrame:
    """Pairs of documents and test items whose best local alignment scores ``threshold`` of a verbatim copy.

    Words are runs of letters, digits and non-ASCII characters, with A-Z
    lower-cased. Seeds are pairs of neighbouring words. An alignment that
    reaches the threshold holds a number of the item's pairs that follows from
    its length (``least_pairs``) within a bounded window of the document, so
    no run of equal words is asked for beyond two. Every pair of every document
    is tried against a filter of fixed size over the items' pairs; those that
    pass and are dense enough for an item of some length, within one of a fixed
    number of groups of items, are joined to all of the items' pairs, frequent
    ones too. Where a document and an item share
    enough of them close together, the document's words are aligned to the
    item's; edits, insertions and deletions cost score and do not end a match.

    Returns ``id_col``, ``item_col``, score (0 to 1, alignment score over the
    item's words), first_word and last_word in the document. Documents that are
    null or shorter than two words match nothing; so do items of fewer words,
    and alignments of a single equal word. Repeated rows each give their own
    rows; null ids are kept. Other columns are ignored; empty tables give no
    rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share of the item's words")
    seed_words = 2
    spark = documents.sparkSession
    small_batches(spark)
    name = documents.schema[id_col].dataType.simpleString()
    item_name = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("t"))

    def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(w.doc[: max(0, len(w.doc) - seed_words + 1)] == w.doc[seed_words - 1 :]) if len(w.doc) >= seed_words else np.zeros(0, dtype=np.int64)
        return gram(w.prefix(), at, at + seed_words), w.doc[at], at - w.first[w.doc[at]]

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))[:]
            w = Words(texts, lower=True, between=NOT_ALNUM)
            h, doc, pos = grams(w)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary()),
                    pa.array([signed(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())),
                    pa.array([pos[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())),
                ],
                ["item", "words", "seeds", "at"],
            )

    known = stored(items.mapInArrow(item_words, f"item {item_name}, words binary, seeds array<long>, at array<long>").withColumn("ino", F.monotonically_increasing_id()), "items")
    seeds = known.select("ino", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("ino", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at"))
    bit = F.explode(F.array(F.shiftrightunsigned("seed", 64 - FILTER_BITS), F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))))
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table = seeds.select(bit.alias("w")).groupBy(F.shiftright("w", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("bits")).toArrow()
    bits[table["k"].to_numpy()] = table["bits"].to_numpy()
    wanted = spark.sparkContext.broadcast(bits.view(np.uint64))
    group = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(ino), {GROUPS}) as int))")
    table = seeds.select(F.col("seed").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("k"), group.alias("g")).groupBy("k").agg(F.bit_or("g").alias("bits")).toArrow()
    masks = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    masks[table["k"].to_numpy()] = table["bits"].to_numpy()
    grouped = spark.sparkContext.broadcast(masks.view(np.uint64))
    # For each class of item lengths the fewest pairs of its shortest and the widest window of its longest.
    lengths = [r["n"] for r in known.where("size(seeds) > 0").select((F.size("seeds") + seed_words - 1).alias("n")).distinct().orderBy("n").collect()]
    classes: list[list[int]] = []
    for n in lengths:
        if classes and n <= classes[-1][0] * LENGTH_STEP:
            classes[-1][1] = n
        else:
            classes.append([n, n])
    windows = [(least_pairs(a, threshold), most_words(b, threshold)) for a, b in classes]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = wanted.value
        low, one = np.uint64((1 << FILTER_BITS) - 1), np.uint64(1)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi], lower=True, between=NOT_ALNUM)
                h, doc, pos = grams(w)
                ok = np.ones(len(h), dtype=bool)
                for x in (h >> np.uint64(64 - FILTER_BITS), h & low):
                    ok &= (has[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & one != 0
                h, doc, pos = h[ok], doc[ok], pos[ok]
                # Each group of items for itself: positions by document and group in one row, so far apart that no window spans two.
                at, g = np.nonzero(np.unpackbits(grouped.value[(h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                row = ((doc[at] * GROUPS + g) << 32) + pos[at]
                order = np.argsort(row, kind="stable")
                row, at, dense = row[order], at[order], np.zeros(len(pos), dtype=bool)
                for need, width in windows:
                    dense[at[crowded(row, need, width)]] = True
                h, doc, pos = h[dense], doc[dense], pos[dense]
                found = np.unique(doc)
                if len(found):
                    edge = np.searchsorted(doc, np.append(found, hi - lo))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(found + lo)),
                            pa.array([w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in found], pa.binary()),
                            pa.array([signed(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())),
                            pa.array([pos[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())),
                        ],
                        ["id", "words", "seeds", "at"],
                    )

    source = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    near = stored(source.mapInArrow(freed(hits), f"id {name}, words binary, seeds array<long>, at array<long>").withColumn("row", F.monotonically_increasing_id()), "hits")
    hit = near.select("row", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.at").alias("pos"))
    # Where in the document each item's pairs are, if there are enough of them at all; how close they lie is seen in the alignment.
    pairs = hit.join(seeds.select("ino", "seed").distinct(), "seed").groupBy("row", "ino").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    need = F.greatest(F.lit(1), F.ceil((F.size("seeds") + seed_words - 1) * threshold - 1e-9) - 1)
    pairs = pairs.join(known.select("ino", need.alias("need")), "ino").where(F.size("places") >= F.col("need")).drop("need")
    pairs = pairs.join(known.select("ino", "item", F.col("words").alias("y")), "ino")
    pairs = pairs.join(near.select("row", "id", F.col("words").alias("x")).repartition(partitions(spark), "row"), "row").select("id", "item", "x", "y", "places")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (x, y, places) in enumerate(zip(*batch.columns[2:], strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                best, width = (0, 0, 0), most_words(len(y), threshold)
                pos = np.asarray(places.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                spans: list[list[int]] = []
                for p in pos[crowded(pos, least_pairs(len(y), threshold), width)].tolist():
                    lo, hi = max(0, p - width), min(len(x), p + width + 1)
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = hi
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    got = align(y, x[lo:hi])
                    if got[0] > best[0]:
                        best = (got[0], got[1] + lo, got[2] + lo)
                if best[0] >= threshold * len(y):
                    out.append((i, best[0] / len(y), best[1], best[2] - 1))
            which, scores, first, last = zip(*out, strict=True) if out else ((), (), (), ())
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(scores, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["id", "item", "score", "first_word", "last_word"])

    found = pairs.mapInArrow(freed(score), f"id {name}, item {item_name}, score double, first_word long, last_word long")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "last_word")

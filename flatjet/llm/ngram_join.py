"""Jaccard self-join of documents on word shingles by rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, partitions, release, small_batches, stored
from .textkit import Words, freed, gram, mix, signed, slices, texts_of

#: Counters of the frequency sketch (2**18, whatever the number of documents: it orders shingles, and frequent ones stand out of any mean).
SKETCH_BITS = 18
#: Most bits of the filter of wanted sets, 2**26; what passes by mistake is only joined in vain.
MOST_FILTER_BITS = 26
#: Rows before it that each row is paired with in small buckets and in draws from large ones, draws before all pairs that are
#: still apart are joined, and the step of sizes (2**3) within which one of them is at random.
NEAR, DRAWS, SIMILAR_SIZE = 3, 4, 3
#: Documents up to which those whose sets are compared are picked by a broadcast of their ids; beyond, all texts pass the filter.
BROADCAST_IDS = 500_000


class Shingles:
    """Distinct shingle hashes of a slice of documents, in order of document and hash."""

    def __init__(self, texts: list[bytes], size: int):
        words = Words(texts, lower=True)
        count = np.diff(words.first)
        grams = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(len(texts)), grams)
        begin = np.cumsum(grams) - grams
        at = words.first[:-1][doc] + np.arange(len(doc)) - begin[doc]
        h = gram(words.prefix(), at, np.minimum(at + size, words.first[1:][doc]))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[fresh], doc[fresh]
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        parts = []
        for salt in (0x1F83D9AB, 0x5BE0CD19137E2179):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(salt)), dtype=np.uint64)))
            parts.append(total[self.first[1:]] - total[self.first[:-1]])
        #: Hash of each document's whole set.
        self.set_hash = mix(parts[0] ^ mix(parts[1] + self.count.astype(np.uint64)))


    def signatures(self) -> pa.Array:
        """Parity of the number of shingles for each value of a hash's low bits: 2 to 4 bits for each shingle, 64 at least."""
        bits = np.full(len(self.count), 64, dtype=np.int64)
        many = self.count > 32
        bits[many] = 1 << (np.ceil(np.log2(self.count[many])).astype(np.int64) + 1)
        edge = np.concatenate(([0], np.cumsum(bits)))
        at = edge[:-1][self.doc] + (self.hash & (bits[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(at, minlength=edge[-1]) & 1).astype(np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer((edge >> 3).astype(np.int32).tobytes()), pa.py_buffer(np.packbits(odd, bitorder="little").tobytes())])


def _least_overlap(n: int | np.ndarray, percent: int):
    return -(-percent * n // 100)


def _differing(x: bytes, y: bytes) -> int:
    """Lower bound of the number of shingles that only one of two sets has, from their signatures."""
    a, b = (np.frombuffer(v, dtype=np.uint64) for v in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures allow enough overlap (a suffix filter over whole sets); no similar pair fails."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([_differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], dtype=np.int64)
            good = pa.array(apart <= n - 2 * -(-percent * n // (100 + percent)))
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in (*batch.columns[:2], *batch.columns[6:])], ["a", "b", "ra", "rb"])

    one, two = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"), F.col("rep").alias(f"r{c}")) for c in "ab")
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb", "ra", "rb").mapInArrow(freed(check), "a long, b long, ra long, rb long"))


def _sets(source: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The shingles of the sets in ``pairs`` (and of few others), one row each, stored; their texts alone are read where they are few."""
    spark = source.sparkSession
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("ra").alias("id")), F.struct(F.col("b").alias("cid"), F.col("rb").alias("id")))).alias("e")).select("e.*")
    ends = cut(ends.distinct())
    count = ends.count()
    if count <= BROADCAST_IDS:
        source = source.join(F.broadcast(ends.select("id").distinct()), "id", "left_semi")
    bits_of = min(MOST_FILTER_BITS, max(18, count.bit_length() + 5))
    word = F.shiftrightunsigned("cid", 64 - bits_of)
    words = ends.select(word.alias("w")).groupBy(F.shiftright("w", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("bits"))
    table = words.toArrow()
    bits = np.zeros(1 << (bits_of - 6), dtype=np.int64)
    bits[table["k"].to_numpy()] = table["bits"].to_numpy()
    wanted = spark.sparkContext.broadcast(bits.view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = wanted.value
        for batch in batches:
            texts, seen = texts_of(batch.column(1)), set()
            for lo, hi in slices(texts):
                s = Shingles(texts[lo:hi], size)
                w = s.set_hash >> np.uint64(64 - bits_of)
                hit = (has[(w >> np.uint64(6)).astype(np.int64)] >> (w & np.uint64(63))) & np.uint64(1) != 0
                cid = signed(s.set_hash)
                take = [i for i in np.flatnonzero(hit & (s.count > 0)).tolist() if not (cid[i] in seen or seen.add(cid[i]))]
                if take:
                    yield pa.RecordBatch.from_arrays([pa.array(cid[take]), pa.array([s.hash[s.first[i] : s.first[i + 1]].tobytes() for i in take], pa.binary())], ["cid", "items"])

    held = stored(source.select("id", "t").mapInArrow(freed(sets), "cid long, items binary").repartition(partitions(spark), "cid").dropDuplicates(["cid"]), "items")
    release(ends)
    return held


def _verified(source: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets are similar enough; each is tried once."""
    held = _sets(source, pairs, size)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                # 100 * common >= percent * (|x| + |y| - common)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if min(len(x), len(y)) < need:
                    continue
                near = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep[i] = np.count_nonzero(y[near] == x) >= need
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    with_a = pairs.select("a", "b").join(held.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    both = with_a.join(held.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    links = cut(both.mapInArrow(freed(check), "a long, b long"))
    release(held)
    return links


def _may_match(n1, p1, n2, p2, percent: int):
    """Length and positional filters on set sizes and positions in the rare-first order."""
    need = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= need)


def class_of(text: Column, shingle: int = 5) -> Column:
    """The class_id that ``jaccard_components`` gives a text."""

    @F.arrow_udf("long")
    def classes(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        parts = [signed(Shingles(texts[lo:hi], shingle).set_hash) for lo, hi in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), pa.int64())

    return classes(text)


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """Link documents whose distinct word shingles have a Jaccard index of percent / 100 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words
    than a shingle is one shingle. Documents of equal sets form one class, which
    is joined once. Each class emits the prefix of its set in rare-first order
    (once for each Arrow batch that holds it; repeats are dropped after);
    frequencies come from a sketch of fixed size over all documents, and only
    the order depends on them. Classes that share a prefix shingle and pass the
    length, positional and suffix filters are verified once.

    In small buckets all pairs are tried; in larger ones each row is paired with
    the bucket's row of least hash, which is the same one in most buckets of a
    group. Buckets that then hold several components pair rows drawn at random
    with a few others of theirs, and in the end every pair whose classes are still in different
    components is joined and tried. So no link between different components is
    lost, while a group of near copies is not expanded into all its pairs.

    Returns one row per document: ``id_col``, n_shingles, component_id (the
    smallest id reachable), class_id (hash of the set) and group_id (one for
    each component, null for rows that link with nothing by definition; unlike
    component_id it tells components apart where an id repeats). Null or blank texts
    have n_shingles 0 and link with nothing; a row with a null id links with
    nothing and has a null component_id. Rows of one id with different texts are
    documents of their own: each has the smallest id of its own group, and an id
    on texts of two groups does not join them. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    source = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["id", "cid", "n", "sig", "slot"]
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                s = Shingles(texts[lo:hi], shingle)
                counts += np.bincount((s.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(signed(s.set_hash)), pa.array(s.count), s.signatures(), pa.nulls(hi - lo, pa.int64())], names)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.int64()), pa.array(counts[slot]), pa.nulls(len(slot), pa.binary()), pa.array(slot)], names)

    known = stored(source.mapInArrow(freed(survey), "id long, cid long, n long, sig binary, slot long"), "sets")
    members = known.where("slot is null").select("id", "cid", "n")
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    table = known.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch[table["slot"].to_numpy()] = table["n"].to_numpy()
    frequency = spark.sparkContext.broadcast(sketch)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in batches:
            texts, seen = texts_of(batch.column(1)), set()
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                s = Shingles(texts[lo:hi], shingle)
                cid = signed(s.set_hash)
                once = np.array([bool(ok) and not (c in seen or seen.add(c)) for c, ok in zip(cid.tolist(), named[lo:hi], strict=True)])
                order = np.lexsort((s.hash, often[(s.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], s.doc))
                place = np.arange(len(order)) - s.first[:-1][s.doc]
                n = s.count[s.doc]
                use = (place < n - _least_overlap(n, percent) + 1) & once[s.doc]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.hash[order][use])), pa.array(cid[s.doc[use]]), pa.array(n[use] << 32 | place[use])], ["token", "cid", "np"])

    n, p = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    bucket = Window.partitionBy("token")

    whole = lambda part: F.struct(F.col("cid"), F.col("np"), F.col(part).alias("part"))

    def fits(o: Column, part: str) -> Column:
        return (o["part"] != F.col(part)) & _may_match(n(F.col("np")), p(F.col("np")), n(o["np"]), p(o["np"]), percent)

    def neighbours(rows: DataFrame, order: list, part: str, use: Column, hub: bool = False) -> DataFrame:
        """Rows with candidates as an array of set hashes: the ``NEAR`` rows before each where ``use``, else, if asked for, the first row."""
        by = bucket.orderBy(*order)
        names = {f"o{k}": F.lag(whole(part), k).over(by) for k in range(1, NEAR + 1)} | ({"hub": F.first(whole(part)).over(by)} if hub else {})
        wanted = F.array(*[F.when(fits(F.col(o), part) & (~use if o == "hub" else use), F.col(f"{o}.cid")) for o in names])
        return rows.withColumns(names).withColumn("near", F.array_compact(wanted)).drop(*names)

    def candidates(rows: DataFrame) -> DataFrame:
        ends = rows.select("cid", F.explode("near").alias("cid2"))
        return ends.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct()

    # A bucket of up to NEAR + 1 rows is settled at once: each row meets all before it. The cid is a hash, so the first one is any row.
    entries = source.mapInArrow(freed(prefixes), "token long, cid long, np long")
    small = F.col("k") <= NEAR + 1
    shared = entries.withColumn("k", F.count("*").over(bucket)).where("k > 1")
    met = neighbours(shared, ["cid"], "cid", small, hub=True)
    buckets = stored(met.where(~small | (F.size("near") > 0)), "buckets")
    sizes = known.where("slot is null and id is not null").select("id", "cid", "n", "sig").join(buckets.select("cid").union(buckets.select(F.explode("near"))).distinct(), "cid", "left_semi")
    sizes = cut(sizes.groupBy("cid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("id").alias("rep")))
    pairs = _plausible(candidates(buckets), sizes, percent)
    tried = cut(pairs.select("a", "b"))
    links = _verified(source, pairs, shingle, percent)
    release(pairs)
    labels = cut(connected_components(links, "a", "b"))
    large = cut(buckets.where(~small).select("token", "cid", "np").dropDuplicates(["token", "cid"]))
    release(buckets)
    for draw in range(DRAWS + 1):
        # Entries of buckets that hold more than one component.
        now = large.select("token", "cid", "np").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left")
        now = now.select("token", "cid", "np", F.coalesce("component", "cid").alias("part"))
        now = now.withColumns({"lo": F.min("part").over(bucket), "hi": F.max("part").over(bucket)}).where("lo <> hi").drop("lo", "hi")
        before, large = large, cut(now)
        release(before)
        if large.isEmpty():
            break
        if draw < DRAWS:
            # First one row of each component of a bucket, by size; then all its rows, by size and at random, and at random alone.
            drawn = F.min(F.struct(F.xxhash64("cid").alias("o"), "cid", "np")).alias("r")
            rows = large if draw else large.groupBy("token", "part").agg(drawn).select("token", "part", "r.cid", "r.np")
            order = [F.shiftright("np", 32 + SIMILAR_SIZE)] * (draw < 2) + [F.xxhash64("cid", F.lit(draw))]
            found = candidates(neighbours(rows, order, "part", F.lit(True)))
        else:
            # Sizes of a pair lie in one band or in neighbouring ones; the smaller set is sent to both.
            band = F.floor(F.log(n(F.col("np")).cast("double")) / F.lit(log(100 / percent)) + 1e-9) if percent < 100 else n(F.col("np"))
            # A smaller set shares one of its first shingles, fewer than a larger one has to show.
            first = p(F.col("np")) <= n(F.col("np")) - F.ceil(F.lit(2 * percent) * n(F.col("np")) / F.lit(100 + percent))
            left = large.where(first).select("token", F.explode(F.array(band, band + 1)).alias("band"), "cid", "np", "part")
            right = large.select("token", band.alias("band"), F.struct("cid", "np", "part").alias("o"))
            ordered = (n(F.col("np")) < n(F.col("o.np"))) | ((n(F.col("np")) == n(F.col("o.np"))) & (F.col("cid") < F.col("o.cid")))
            near = left.join(right, ["token", "band"]).where(ordered & fits(F.col("o"), "part"))
            found = near.select(F.least("cid", "o.cid").alias("a"), F.greatest("cid", "o.cid").alias("b")).distinct()
        pairs = _plausible(found.join(tried, ["a", "b"], "left_anti"), sizes, percent)
        if pairs.isEmpty():
            continue
        new = _verified(source, pairs, shingle, percent)
        before = links, tried, labels
        links, tried = cut(links.union(new)), cut(tried.union(pairs.select("a", "b")))
        labels = cut(connected_components(links, "a", "b"))
        release(*before, new, pairs)
    release(large, links, tried, sizes)
    classes = members.where("n > 0 and id is not null").groupBy("cid").agg(F.min("id").alias("rep"))
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "component").select("cid", "component_id", "component")
    out = members.join(classes, "cid", "left")
    lone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("cid").alias("class_id"), F.when(~lone, F.col("component")).alias("group_id"))

"""Language identification by Bayesian fusion of text, markup and address evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .textkit import freed, slices, texts_of

#: Trigram slots of the text model.
SLOTS = 1 << 14
#: Most languages a model holds unless the caller says otherwise (64 KB each), and rows of each that it is fit on (about, chosen by hash of the text).
MOST_LANGUAGES, SAMPLE_ROWS = 256, 2000
#: Trigrams that count in full; evidence of longer texts is scaled down to as many, as trigrams overlap.
FULL_EVIDENCE = 200
UNKNOWN = "und"
#: Parts that the rows of one host are dealt to.
SALTS = 32
#: Size of the hosts' priors up to which every task gets them all, and no text is shuffled.
BROADCAST_BYTES = 4 << 20

_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of each byte trigram that starts with a letter; A-Z lower-cased, other ASCII as blanks."""
    joined = _LETTER[np.frombuffer(b"  ".join(texts) + b"  ", dtype=np.uint8)].astype(np.uint32)
    code = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    use = np.flatnonzero(joined[:-2] != 0x20)
    slot = (code[use] * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2)))
    return slot.astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(use, begins)))


def _language(c: Column) -> Column:
    """A declared language without its region, lower-cased."""
    return F.lower(F.substring_index(c.cast("string"), "-", 1))


def _drawn(text: Column, language: Column, shares: dict[str, float]) -> Column:
    """Whether a row is one that its language's model is fit on."""
    if not shares:
        return F.lit(False)
    share = F.create_map(*[x for name, part in shares.items() for x in (F.lit(name), F.lit(part))])
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share[language] * (1 << 20), F.lit(False))


def fit(documents: DataFrame, text_col: str, label_col: str, most_languages: int = MOST_LANGUAGES) -> tuple[dict[str, float], np.ndarray]:
    """Languages, each with the share of its rows that is fit on, and their log-probabilities of each slot; the last row is the unknown language, uniform.

    Trigrams are counted on the executors, from about ``SAMPLE_ROWS`` texts of
    each label. More labels than ``most_languages`` are an error, as none is left out.
    """
    rows = documents.select(F.col(f"`{text_col}`").cast("string").alias("t"), _language(F.col(f"`{label_col}`")).alias("lang")).where("lang <> ''")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} declared languages; raise most_languages (a model takes 64 KB for each) or clean the labels")
    shares = {r["lang"]: min(1.0, SAMPLE_ROWS / r["count"]) for r in sorted(sizes, key=lambda r: r["lang"])}
    languages = list(shares)
    if not languages:
        return {}, np.zeros((1, SLOTS)) - np.log(SLOTS)
    chosen = rows.where(_drawn(F.col("t"), F.col("lang"), shares))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS), dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            which = np.searchsorted(languages, batch.column(1).to_pylist())
            for lo, hi in slices(texts):
                slot, doc = trigrams(texts[lo:hi])
                np.add.at(total.reshape(-1), which[lo:hi][doc] * SLOTS + slot, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "n"])

    table = chosen.mapInArrow(freed(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * SLOTS)
    counts[table["at"].to_numpy()] = table["n"].to_numpy()
    counts = counts.reshape(len(languages), SLOTS) + 0.05
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    return shares, np.vstack([model, np.full(SLOTS, -np.log(SLOTS))])


def identify(
    documents: DataFrame,
    text_col: str = "text",
    markup_col: str | None = "lang",
    address_col: str | None = "source",
    label_col: str = "lang",
    trust: float | None = None,
    strength: float = 20.0,
    most_languages: int = MOST_LANGUAGES,
) -> DataFrame:
    """Most probable language of each row from its text, declared language and address.

    The log-likelihoods of the text's trigrams (scaled to ``FULL_EVIDENCE``
    trigrams) are added to log P(declared | language), which is ``trust`` for the
    language itself and the rest spread over the others, and to the log prior of
    the row's host. Unless it is given, ``trust`` is measured: the share of rows
    outside of the fit whose text's own best language is the declared one
    (smoothed by ten rows at 0.9, 0.99 at most), so a label never vouches for
    itself. Priors are counts of the text's own best language: those of
    a host are smoothed with ``strength`` rows of its address suffix, and those
    with ``strength`` rows of all addresses. An address is a URL or a bare host;
    one without a dot has no suffix. A uniform trigram model stands for all
    other languages. Every declared language has a model; more of them than
    ``most_languages`` raise a ValueError.

    Returns the columns of ``documents`` plus language and confidence (its
    posterior probability), which replace columns of these names. Texts that are
    null or without letters are "und" with confidence 0, as are texts that no
    model explains better than the uniform one; a missing declaration or
    address is no evidence. Rows are never dropped or merged, and an empty table
    gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shares, model = fit(documents, text_col, label_col, most_languages)
    languages = list(shares)
    names = [*languages, UNKNOWN]
    held = spark.sparkContext.broadcast(np.ascontiguousarray(model.T.astype(np.float32)))

    @F.arrow_udf("array<double>")
    def likelihood(column: pa.Array) -> pa.Array:
        table, texts, out = held.value, texts_of(column), []
        for lo, hi in slices(texts):
            slot, doc = trigrams(texts[lo:hi])
            size = np.bincount(doc, minlength=hi - lo)
            first = np.concatenate(([0], np.cumsum(size)))
            total = np.zeros((hi - lo, table.shape[1]))
            for k in range(table.shape[1]):
                part = np.concatenate(([0.0], np.cumsum(table[slot, k], dtype=np.float64)))
                total[:, k] = part[first[1:]] - part[first[:-1]]
            out += [None if not n else (row * min(1.0, FULL_EVIDENCE / n)).tolist() for n, row in zip(size.tolist(), total, strict=True)]
        return pa.array(out, pa.list_(pa.float64()))

    # Said to be non-deterministic only so that filters on its result do not run it a second time.
    likelihood = likelihood.asNondeterministic()

    keep = [c for c in documents.columns if c not in ("language", "confidence")]
    address = F.col(f"`{address_col}`").cast("string") if address_col else F.lit(None).cast("string")
    host = F.lower(F.regexp_extract(F.regexp_replace(address, "^[^:/?#]*://", ""), "^[^/?#:]*", 0))
    declared = _language(F.col(f"`{markup_col}`")) if markup_col else F.lit(None).cast("string")
    # Numbered, so that names cannot clash with the working columns and what a caller does not use is pruned.
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    text = F.col(f"`{text_col}`").cast("string")
    salt = F.pmod(F.xxhash64(text), F.lit(SALTS))
    scored = documents.select(*carried, host.alias("host"), salt.alias("salt"), declared.alias("declared"), _drawn(text, _language(F.col(f"`{label_col}`")), shares).alias("drawn"), likelihood(text).alias("ll"))

    # One pass over the texts gives all counts; they are cut, so that what follows does not run it again.
    own = scored.select("host", "declared", "drawn", (F.array_position("ll", F.array_max("ll")) - 1).cast("int").alias("k"))
    counts = cut(own.groupBy("host", "declared", "drawn", "k").agg(F.count("*").alias("n"))).where("k is not null")
    if trust is None:
        told = counts.where(~F.col("drawn") & F.col("declared").isin(languages) & (F.col("k") < len(languages)))
        same = F.sum(F.when(F.col("declared") == F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1), F.col("n")))
        all_rows, agree = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(same, F.lit(0))).first()
        trust = min(0.99, (agree + 9) / (all_rows + 10))
    counts = counts.where("host is not null").withColumn("suffix", F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1)).otherwise(""))
    top = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("by", i), F.lit(0)).cast("double"))

    def vectors(by: list[str]) -> DataFrame:
        summed = counts.groupBy(*by, "k").agg(F.sum("n").alias("n"))
        return summed.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by")).withColumn("v", top).drop("by")

    def smooth(v, prior):
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) + strength
        return F.zip_with(v, prior, lambda x, p: (x + strength * p) / total)

    flat = F.transform(F.col("v"), lambda x: (x + 1.0) / (F.aggregate("v", F.lit(0.0), lambda a, y: a + y) + float(len(names))))
    overall = cut(vectors([]).select(flat.alias("all")))
    suffixes = vectors(["suffix"]).crossJoin(F.broadcast(overall)).select("suffix", smooth(F.col("v"), F.col("all")).alias("sv"))  # one row
    hosts = vectors(["host", "suffix"]).join(suffixes, "suffix").select("host", smooth(F.col("v"), F.col("sv")).alias("prior"))
    hosts = cut(hosts)
    if hosts.count() * (len(names) + 8) * 8 <= BROADCAST_BYTES:
        hosts, by = F.broadcast(hosts), ["host"]
    else:
        # One host may hold a large part of all rows: its rows are dealt out by salt, and every salt has all priors.
        hosts, by = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"]

    agrees = F.array(*[F.when(F.col("declared").isin(languages), F.when(F.col("declared") == name, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log((1 - trust) / max(1, len(names) - 1)))))).otherwise(F.lit(0.0)) for name in names])
    fused = scored.join(hosts, by, "left").select(
        *[f"c{i}" for i in range(len(keep))],
        "ll",
        F.zip_with(F.zip_with("ll", agrees, lambda a, b: a + b), F.coalesce("prior", F.array_repeat(F.lit(1.0 / len(names)), len(names))), lambda a, p: a + F.log(p)).alias("post"),
    )
    best = fused.withColumn("best", F.array_max("post"))
    named = best.withColumns(
        {
            "language": F.when(F.col("ll").isNull(), UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, names)), F.array_position("post", F.col("best")).cast("int"))),
            "confidence": F.coalesce(1.0 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best"))), F.lit(0.0)),
        }
    )
    return named.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "language", "confidence")

"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flatjet.llm import chat_format, components, decontaminate, embedding_dedup, language_id, license_scan, ngram_join, packing, quality_cnn, queries, substring_dedup, url_filter
from flatjet.llm.textkit import Words, gram

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))


def corpus(seed=1):
    """Ids and texts with copies, edits, shared passages, repeats within a text, blanks and a long text."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 120)
    texts = [prose(rng, rng.randrange(1, 150)) for _ in range(25)]
    texts += [base, base, base.replace("alpha", "ALPHA"), prose(rng, 10) + " " + passage + "\n" + prose(rng, 12), passage, prose(rng, 5) + "\t" + passage]
    words = base.split()
    for k in range(6):
        near = list(words)
        near[rng.randrange(120)] = f"edit{k}"
        texts.append(" ".join(near))
    texts += ["", None, "  \n\t ", "one two", "one two", "same " * 90, "same " * 70, prose(rng, 30) * 2, prose(rng, 4000), "É" + "é " * 30]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_hashes_depend_on_words_only():
    w = Words([b"a b c", b"x a b c ", b"", b"ab c"])
    h = gram(w.prefix(), np.array([0, 4]), np.array([3, 7]))
    assert h[0] == h[1] and w.first.tolist() == [0, 3, 7, 7, 9]
    assert w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == 5


def brute_removed(rows, window=20):
    first = {}
    for i, t in sorted((i if i is not None else 1 << 62, t or "") for i, t in rows):
        w = words_of(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = []
    for i, t in rows:
        w = words_of(t)
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i if i is not None else 1 << 62, k):
                covered[k : k + window] = [True] * window
        out.append((len(w), sum(covered), " ".join(x for x, c in zip(w, covered, strict=True) if not c)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    for (i, text), want in zip(rows, brute_removed(rows), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == want
        assert got[i].text == text
        assert all(f.words >= 20 and (f.ref_id, f.ref_start) < (i, f.start) for f in got[i].factors)


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(3, text, "x"), (3, text, "x"), (None, text, "y"), (5, text + " tail", None)]
    got = substring_dedup.remove_repeats(frame(spark, rows, "doc_id long, text string, factors string")).orderBy("doc_id").collect()
    # Rows of one id are one document: equal starts are not earlier. Null ids come last.
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 25), (3, 0), (3, 0), (5, 25)]
    assert [r.kept_text for r in got if r.doc_id == 5] == ["tail"]
    empty = substring_dedup.remove_repeats(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text", "factors"]


def test_substring_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(11)
    first = prose(rng, 25)
    # Copies of an earlier text among many unlike texts without an id, and under one id.
    rows = [(1, first)] + [(None, prose(rng, 25)) for _ in range(1000)] + [(None, first), (7, prose(rng, 30)), (7, first), (7, first + " tail")]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.text) for r in got if r.n_removed) == sorted([(-1, first), (7, first), (7, first + " tail")])
    assert all(r.kept_text == r.text for r in got if not r.n_removed)


def check_packing(rows, got, path, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == part
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    rows = [*corpus(), (900, "a \x01b \x01"), (901, "<|endoftext|> It's 'LL don't é J̌"), (902, "THE end. the, END!! 12.")]
    got = packing.pack(frame(spark, rows), queries.tokenizer_path(), capacity=capacity, with_ids=True).collect()
    check_packing(rows, got, queries.tokenizer_path(), capacity)


def test_packing_edges(spark):
    assert packing.pack(frame(spark, []), queries.tokenizer_path()).collect() == []
    got = packing.pack(frame(spark, [(None, None, "a"), (1, "x", "b"), (1, "x", "b")], "doc_id long, text string, ids string"), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 1), (1, 2), (1, 2)]


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing_plan(capacity):
    rng = np.random.default_rng(capacity)
    for sizes in ([], [1], [capacity], [capacity + 1] * 3, rng.integers(1, 5 * capacity + 2, 300), np.full(50, capacity // 3 + 1), [1] * 100):
        sizes = np.array(sizes, dtype=np.int64)
        doc, start, length, sequence, offset = packing.plan(sizes, capacity)
        assert (length > 0).all()
        for d, n in enumerate(sizes.tolist()):
            parts = sorted(zip(start[doc == d].tolist(), length[doc == d].tolist(), strict=True))
            assert [a for a, _ in parts] == np.cumsum([0, *[x for _, x in parts]])[:-1].tolist() and sum(x for _, x in parts) == n
        used = []
        for q in range(int(sequence.max(initial=-1)) + 1):
            parts = sorted(zip(offset[sequence == q].tolist(), length[sequence == q].tolist(), strict=True))
            assert [a for a, _ in parts] == np.cumsum([0, *[x for _, x in parts]])[:-1].tolist()
            used.append(sum(x for _, x in parts))
        # Nothing is padded: sequences are full or, for what is left, of different powers of two.
        rest = [n for n in used if n < capacity]
        assert max(used, default=0) <= capacity and len(set(rest)) == len(rest) and all(n & (n - 1) == 0 for n in rest)
    # Remainders of one class share bins of a fixed count, uncut.
    doc, start, length, sequence, offset = packing.plan(np.full(9, capacity // 3 or 1), capacity)
    if capacity == 64:
        assert len(doc) < 9 * 2 and sorted(np.bincount(sequence[length == 21]).tolist()) [-1] == 3


def test_packing_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    letters = "abcXYZéÉüßİıŉſµªºΣσςДŁłǅ\u0307\u0301'.,;:!?*$#-_\"()[]{}<|>0123456789½²中 \u0085\u00a0\x01\x1c\u3000"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [f"x{chr(c)}, {chr(c)}.{chr(c)}!!" for c in range(0x80, 0x3000)] + ["İ, xİ. <|endoftext|>, IT'S don't 'LL", "<|ENDOFTEXT|>"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.tokenizer_path(name)
        encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
        assert encoder.by_word == name.startswith("word")
        for lo in range(0, len(texts), 500):
            for text, raw in zip(texts[lo : lo + 500], encoder.encode([t.encode() for t in texts[lo : lo + 500]]), strict=True):
                assert np.frombuffer(raw, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (name, text)


def test_packing_of_very_long_texts(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(1, prose(rng, 20_000)), (2, "x" * 50_000 + " " + prose(rng, 10)), (3, prose(rng, 300))]
    monkeypatch.setattr(packing, "BLOCK_BYTES", 1000)
    encoder = packing.Encoder(queries.tokenizer_path())
    texts = [t.encode() for _, t in rows]
    assert b"".join(packing._segments(texts[0])) == texts[0]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == [encoder.whole.encode(t, add_special_tokens=False).ids for _, t in rows]
    got = packing.pack(frame(spark, rows), queries.tokenizer_path(), with_ids=True).collect()
    check_packing(rows, got, queries.tokenizer_path(), 2048)


def test_packing_sees_only_odd_words_in_python(monkeypatch):
    rng = random.Random(46)
    letters = "abcxyzéüßøñıŉµǆÀÉ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(("", ".", ",", "&&&", "!)")) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(150)] + ["", " ", "91, 中. <|endoftext|> &&& É&&&"]
    seen, parts = [], packing._parts
    monkeypatch.setattr(packing, "_parts", lambda w: seen.append(w) or parts(w))
    monkeypatch.setattr(packing, "BLOCK_BYTES", 4000)
    for most in (100, 250_000):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        encoder = packing.Encoder(queries.tokenizer_path())
        for _ in range(2):
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert 0 < len(encoder.known) <= most
        # Words of Latin letters and the punctuation after them are split without a call for each.
        assert not [w for w in seen if w and w.decode()[0] in letters]


def test_packing_gathers_short_texts_over_batches(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 8000)
    rows = [(i, "" if i % 3 else None if i % 2 else "x" * (i % 50)) for i in range(3000)] + [(3000, "y" * 20_000), (3001, "z")]
    table = pa.table({"k": [k for k, _ in rows], "t": [t for _, t in rows]})
    blocks = [(k.to_pylist(), t) for k, t in packing._blocks(iter(table.to_batches(max_chunksize=7)))]
    assert [(k, t) for keys, texts in blocks for k, t in zip(keys, texts, strict=True)] == [(k, (t or "").encode()) for k, t in rows]
    assert len(blocks) < 15 and all(len(t) == 1 or sum(map(len, t)) + 8 * len(t) <= 8000 for _, t in blocks)


def brute_license(text, base):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in base:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [t for _, t in corpus()] + ["CC-BY 4.0, cc by cc by", "All  Rights\nReserved. all rights all rights reserved", "GNU General Public License general public", "cc", "ccby", "Released under the MIT License.", "This work is licenced under the GNU General Public License", "x " * 500 + "redistribution and use in both source and binary forms with or without modification is permitted"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows, "doc_id long, text string, labels string, n bigint")).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t, license_scan.BASE)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert got[len(rows) - 3].labels == "mit" and got[len(rows) - 1].labels == "bsd"
    assert license_scan.scan(frame(spark, [])).collect() == []
    assert len(license_scan.scan(frame(spark, [(None, None), (1, "cc by"), (1, "cc by")])).collect()) == 3


def test_license_spans_are_verified(spark):
    def labels(*texts):
        got = license_scan.scan(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
        return [(r.labels, round(r.score, 3)) for r in got]

    words = "released under the mit license".split()
    notice = next(t for t, label in license_scan.TEMPLATES if label == "zlib")
    edited = notice.split()
    edited[5:7] = ["quite", "other", "words"]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    got = labels(" x ".join(reversed(pairs)), " one two ".join(pairs), " ".join(words), "so " + " ".join(edited), " ".join(edited[:30]), "mit " * 3000)
    # The same pairs in another order or far apart are no license.
    assert got[0] == ("", 0) and got[1] == ("", 0) and got[2] == ("mit", 1)
    assert got[3][0] == "zlib" and got[3][1] > 0.85 and got[4] == ("", 0) and got[5] == ("", 0)


def test_license_chains_against_every_chain(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        n, width = rng.randrange(2, 7), rng.randrange(3, 12)
        votes = sorted({(rng.randrange(20), rng.randrange(n)) for _ in range(rng.randrange(1, 12))})

        def longest(chain, left, width=width):
            best = len(chain)
            for k, (pos, t) in enumerate(left):
                if not chain or (pos > chain[-1][0] or pos == chain[-1][0]) and t > chain[-1][1] and pos - chain[0][0] < width:
                    best = max(best, longest([*chain, (pos, t)], left[k + 1 :]))
            return best

        rows.append((i, votes, n, width, longest([], votes)))
    df = frame(spark, rows, "i int, votes array<struct<pos:int,tpos:int>>, n int, width int, want int")
    got = df.select("want", license_scan.chain_length(F.col("votes"), F.col("n"), F.col("width")).alias("got")).collect()
    # The best chain that ends at a place may have started too early to go on; one that is shorter by then is found.
    assert all(r.got <= r.want for r in got) and sum(r.got == r.want for r in got) >= len(got) - 3


def test_language_id(spark):
    en, fr = "the cat and the dog went with this house over there", "le chat et les chiens vont avec cette maison dans une rue"
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(t.split(), 9)), lang, f"h{i % 3}.example.{lang}", 1) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 40)]
    rows += [(100, None, "en", None, 0), (101, " 12 !!", None, "", 0), (102, "Привет как дела сегодня хорошо спасибо друзья мои", None, None, 0), (103, "le chat et les chiens vont avec", "en-GB", "https://h1.example.fr/x", 0)]
    out = language_id.identify(frame(spark, rows, COLUMNS)).collect()
    got = {r.doc_id: r for r in out}
    assert all(got[i].language == lang for i, _, lang, _, _ in rows[:80])
    assert [got[i].language for i in (100, 101, 102)] == ["und"] * 3 and got[103].language == "fr"
    assert all(0 <= r.confidence <= 1 for r in out) and len(out) == len(rows)
    assert language_id.identify(frame(spark, [], COLUMNS)).collect() == []


@pytest.mark.parametrize("most", [4 << 20, 0])
def test_language_id_against_plain_fusion(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "BROADCAST_BYTES", most)
    rng = random.Random(25)
    pools = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 6))) for _ in range(6)] for k in ("aa", "bb", "cc")}
    rows = []
    for i in range(90):
        k = rng.choice(["aa", "aa", "bb", "cc"])
        mixed = pools[k] + pools[rng.choice(["aa", "bb", "cc"])]
        told = k if rng.random() < 0.7 else rng.choice(["aa", "bb", "zz", None])
        host = rng.choice([f"h{k}.org", "x.org", "x.net", "plain", None, f"http://y.{k}/p"])
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.randrange(0, 7))), told, host, 0))
    rows += [(200, None, "aa", "x.org", 0), (201, "!!", None, None, 0)]
    docs = frame(spark, rows, COLUMNS)
    shares, model = language_id.fit(docs, "text", "lang")
    names, trust, strength = [*shares, "und"], 0.8, 20.0
    n = len(names)

    def likelihood(text):
        data = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode() + b"  "]
        slots = [(((data[j] << 16 | data[j + 1] << 8 | data[j + 2]) * 0x9E3779B1) % 2**32) >> 18 for j in range(len(data) - 2) if data[j] != 32]
        return [sum(model[k][s] for s in slots) * min(1.0, 200 / len(slots)) for k in range(n)] if slots else None

    ll = {r[0]: likelihood(r[1]) for r in rows}
    host = {r[0]: None if r[3] is None else re.sub("^[^:/?#]*://", "", r[3]).split("/")[0].lower() for r in rows}
    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else ""
    by_host, by_suffix, every = defaultdict(lambda: [0] * n), defaultdict(lambda: [0] * n), [0] * n
    for i, x in ll.items():
        if x is not None and host[i] is not None:
            k = int(np.argmax(x))
            for counts in (by_host[host[i]], by_suffix[suffix(host[i])], every):
                counts[k] += 1
    flat = [(c + 1) / (sum(every) + n) for c in every]
    smooth = lambda counts, prior: [(c + strength * p) / (sum(counts) + strength) for c, p in zip(counts, prior, strict=True)]
    got = {r.doc_id: r for r in language_id.identify(docs, trust=trust).collect()}
    for i, _, told, _, _ in rows:
        if ll[i] is None:
            assert (got[i].language, got[i].confidence) == ("und", 0)
            continue
        prior = smooth(by_host[host[i]], smooth(by_suffix[suffix(host[i])], flat)) if host[i] in by_host else [1 / n] * n
        said = [0.0] * n if told not in shares else [np.log(trust) if name == told else np.log((1 - trust) / (n - 1)) for name in names]
        post = [a + b + np.log(p) for a, b, p in zip(ll[i], said, prior, strict=True)]
        best = int(np.argmax(post))
        assert got[i].language == names[best] and abs(got[i].confidence - 1 / sum(np.exp(x - post[best]) for x in post)) < 1e-4


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    told = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0, F.col("lang"))
    # A third of the labels is neither learned from nor evidence.
    found = language_id.identify(docs.withColumn("truth", F.col("lang")).withColumn("lang", told)).where("lang is null and truth is not null").collect()
    real = [r for r in found if r.language != language_id.UNKNOWN]
    assert len(real) > 0.97 * len(found) and np.mean([r.language == r.truth for r in real]) > 0.95


def test_language_id_keeps_other_columns_and_repeats(spark):
    text = "the cat and the dog went with this house over there"
    rows = [(1, text, "en", "http://a.example.co/x", 5), (1, text, "en", "http://a.example.co/x", 5), (2, text * 4000, None, "a.example.co", 6)]
    got = language_id.identify(frame(spark, rows, "doc_id long, text string, lang string, source string, confidence long")).collect()
    assert sorted((r.doc_id, r.language) for r in got) == [(1, "en"), (1, "en"), (2, "en")] and all(0 < r.confidence <= 1 for r in got)


def test_language_id_of_many_languages(spark):
    rng = random.Random(14)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for _ in range(70)]
    # The last six languages are the rarest.
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), f"x{k:02}", None, 0) for i, k in enumerate([*range(70)] * 2 + [*range(64)])]
    got = {r.doc_id: r.language for r in language_id.identify(frame(spark, rows, COLUMNS)).select("doc_id", "language").collect()}
    assert got == {i: lang for i, _, lang, _, _ in rows}
    with pytest.raises(ValueError):
        language_id.identify(frame(spark, rows, COLUMNS), most_languages=69)


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = words_of((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 3])
def test_ngram_jaccard(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    # A chain: each like the next, the ends unlike.
    words = [f"c{i}" for i in range(80)]
    for k in range(12):
        rows.append((500 + k, " ".join(words)))
        for _ in range(1):
            words[rng.randrange(80)] = f"n{k}"
    sets = brute_sets(rows)
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(ids, links)
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}


def test_ngram_jaccard_edges(spark):
    text = prose(random.Random(9), 30)
    rows = [(None, text, "a"), (4, text, "b"), (4, text, "b"), (2, text.upper(), "c"), (7, None, "d"), (8, "", "e")]
    got = ngram_join.jaccard_components(frame(spark, rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2), (4, 2), (7, 7), (8, 8)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.jaccard_components(frame(spark, [])).collect() == []


def test_ngram_jaccard_of_one_id_on_two_texts(spark):
    rng = random.Random(17)
    a, b = prose(rng, 40), prose(rng, 40)
    got = ngram_join.jaccard_components(frame(spark, [(4, a), (4, b), (2, b), (9, a), (1, prose(rng, 40))])).collect()
    # Each text of an id is a document of its own.
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (4, 2), (4, 4), (9, 4)]


def test_ngram_jaccard_of_large_groups(spark):
    # Several groups that share frequent passages, each too large for one bucket to settle, with sizes far apart.
    rng = random.Random(18)
    shared, rows, words = prose(rng, 12), [], {}
    for g in range(4):
        base = prose(rng, 60 + 30 * g).split()
        for k in range(40):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 * g + k, shared + " " + " ".join(text)))
    rng.shuffle(rows)
    sets = brute_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signatures_bound_differences():
    rng = random.Random(19)
    texts = [prose(rng, n) for n in (3, 40, 41, 90, 300, 1200)]
    texts += [" ".join(t.split()[: rng.randrange(1, 1200)]) for t in texts]
    s = ngram_join.Shingles([t.encode() for t in texts], 5)
    sets = [set(s.hash[a:b].tolist()) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    sigs = s.signatures().to_pylist()
    for x, a in zip(sets, sigs, strict=True):
        for y, b in zip(sets, sigs, strict=True):
            assert ngram_join._differing(a, b) <= len(x ^ y) and (x != y or ngram_join._differing(a, b) == 0)


@pytest.mark.parametrize("most", [50_000, 7])
def test_components_of_random_edges(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(20)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components.connected_components(frame(spark, edges, "a long, b long").repartition(4), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute_components({x for e in real for x in e}, real)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 260)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components.connected_components(frame(spark, [], "a long, b long"), "a", "b").collect() == []


def brute_align(item, text):
    score = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (1 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
    return max(max(r) for r in score)


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x, y = rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64)
        best, begin, end = decontaminate.align(x, y)
        assert best == brute_align(x.tolist(), y.tolist())
        assert best == 0 or best == brute_align(x.tolist(), y[begin:end].tolist())


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 40)) for k in range(8)] + [(20, None), (21, "too short"), (22, "")]
    clean = [(i, prose(rng, 200)) for i in range(30)]
    edited = items[1][1].split()
    for k in range(5, 40, 9):
        edited[k] = "changed"
    del edited[20:22]
    leaks = [(100, clean[0][1] + " " + items[0][1].upper().replace(" ", ", ")), (101, prose(rng, 50) + " " + " ".join(edited) + " " + prose(rng, 50)), (102, items[2][1]), (102, items[2][1]), (None, items[3][1]), (103, None), (104, "")]
    got = decontaminate.find_leaks(frame(spark, clean + leaks), frame(spark, items, "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 3), (100, 0), (101, 1), (102, 2), (102, 2)]
    assert next(r for r in got if r.doc_id == 100).first_word == 200 and next(r for r in got if r.doc_id == 102).score == 1
    assert decontaminate.find_leaks(frame(spark, []), frame(spark, items, "item_id long, text string")).collect() == []
    assert decontaminate.find_leaks(frame(spark, clean), frame(spark, [], "item_id long, text string")).collect() == []


def test_decontamination_of_edited_beside_verbatim_copies(spark):
    # The seeds that survive in the edited copy are then the item's most frequent ones.
    rng = random.Random(16)
    item = [f"w{k}" for k in range(36)]
    edited = [f"new{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    docs = [(1, " ".join(item)), (2, prose(rng, 30) + " " + " ".join(item)), (3, prose(rng, 30) + " " + " ".join(edited) + " " + prose(rng, 30)), (4, prose(rng, 90))]
    got = decontaminate.find_leaks(frame(spark, docs), frame(spark, [(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, round(36 * r.score), r.first_word, r.last_word) for r in got) == [(1, 36, 0, 35), (2, 36, 30, 65), (3, 22, 30, 63)]


def test_decontamination_loses_no_alignment(spark):
    rng = random.Random(26)
    item = [f"w{k}" for k in range(36)]
    fourth = [f"new{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    third = [f"new{k}" if k % 10 in (2, 5, 8) else w for k, w in enumerate(item)]
    spread = [x for k, w in enumerate(item) for x in ([w, f"new{k}"] if k % 2 else [w])]
    items = [(7, " ".join(item))] + [(k, prose(rng, n)) for k, n in enumerate((3, 4, 5, 9, 15, 22, 60, 80), 10)]
    docs = [(i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)) for i, w in enumerate((fourth, third, spread))]
    for i in range(3, 90):
        words, rate = rng.choice(items)[1].split(), rng.uniform(0.05, 0.4)
        edited = [x for w in words for x in ([w] if rng.random() > rate else rng.choice(([w + "x"], [], [w, "new"])))]
        docs.append((i, prose(rng, rng.randrange(60)) + " " + " ".join(edited) + " " + prose(rng, rng.randrange(60))))
    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()])
    want = {(i, k): decontaminate.align(coded(y), coded(x))[0] for i, x in docs for k, y in items}
    want = {p: s for p, s in want.items() if s >= 0.4 * len(dict(items)[p[1]].split()) - 1e-9}
    got = decontaminate.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score * len(dict(items)[r.item_id].split())) for r in got} == want
    assert {(0, 7), (1, 7), (2, 7)} <= set(want)


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, centre = [], rng.standard_normal(32)
    for i in range(150):
        v = centre + 0.08 * rng.standard_normal(32) if i < 70 else rng.standard_normal(32)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(200, rows[100][1], 0), (201, rows[100][1], 0), (202, [2 * x for x in rows[100][1]], 0), (203, None, 0), (204, [0.0] * 32, 0), (205, [float("nan")] * 32, 0), (206, [None, 1.0], 0), (207, rows[0][1], None), (208, [], 0)]
    bad = {203, 204, 205, 206, 207, 208}
    good = [(i, np.array(v), label) for i, v, label in rows if i not in bad]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = brute_components([r[0] for r in rows], links)
    for block in (1024, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = embedding_dedup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<float>, label int"), tables=24)
        # Floats are stored singly; doubles of the table decide.
        out = {r.vec_id: r for r in got.collect()}
        assert len(out) == len(rows)
        assert {i: out[i].n_links for i in out} == {i: count[i] for i in out}
        assert all(out[i].component_id == want[i] and out[i].kept == (want[i] == i) for i in out)
    assert embedding_dedup.near_duplicates(frame(spark, [], "vec_id long, embedding array<float>, label int")).collect() == []


def test_embedding_dedup_of_repeated_ids_and_extreme_values(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    rows = [(5, x, 1), (5, y, 1), (6, z, 1), (7, [1e200 * v for v in z], 1), (8, [1e-200 * v for v in z], 1), (9, [-0.0, 1.0, 0.0], 1), (10, y, 2)]
    got = embedding_dedup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>, label int")).collect()
    # Id 5 stands on two unlike vectors: the one at right angles to the others links with nothing.
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 0, 5), (5, 4, 5), (6, 4, 5), (7, 4, 5), (8, 4, 5), (9, 4, 5), (10, 0, 10)]


def test_embedding_dedup_recall(spark):
    # Groups whose pairs lie on both sides of the threshold, among unlike vectors of the same labels.
    rng = np.random.default_rng(24)
    centres = rng.standard_normal((150, 64))
    near = np.repeat(centres, 12, axis=0) + 0.142 * rng.standard_normal((1800, 64)) * rng.uniform(0.6, 1.05, (1800, 1))
    unit = np.vstack([near, rng.standard_normal((1200, 64))]).astype(np.float32)
    label = np.arange(len(unit)) // 12 % 3
    table = frame(spark, [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(unit, label, strict=True))], "vec_id long, embedding array<float>, label int")
    x = unit.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98) & (label[:, None] == label)
    want = links.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert want.sum() > 4000 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.9999 * want.sum()


def test_chat_format(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n', 1),
        (1, 2, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x","limit":3}},{"id":"b","name":"search","arguments":{"limit":"x"}}],"content":"é"}', 1),
        (1, 1, "tool", '{"tool_call_id":"a","content":"res"}', 1),
        (1, 3, "tool", '{"tool_call_id":"zz","content":"lost"}', 1),
        (1, 4, "assistant", "{broken", 1),
        (2, 0, None, None, 1),
        (None, 0, "tool", '{"tool_call_id":"a"}', 1),
    ]
    schema = "conv_id long, turn long, role string, text string, record int"
    got = chat_format.format_chats(frame(spark, rows, schema), queries.CHAT_TOOLS).orderBy("conv_id", "order_turn", "order_rank", "turn").collect()
    assert [(r.conv_id, r.turn, r.kind) for r in got] == [(None, 0, "result"), (1, 0, "plain"), (1, 2, "call"), (1, 1, "result"), (1, 3, "result"), (1, 4, "plain"), (2, 0, "plain")]
    call = got[2]
    assert (call.n_calls, call.n_valid, call.n_answered) == (2, 1, 1) and [r.linked for r in got if r.kind == "result"] == [False, True, False]
    for r in got:
        assert r.record == json.dumps(json.loads(r.record), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert json.loads(call.record)["tool_calls"][0] == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search"}
    twice = chat_format.format_chats(frame(spark, rows[:1] * 2, schema), queries.CHAT_TOOLS).collect()
    assert len(twice) == 2 and chat_format.format_chats(frame(spark, [], schema), queries.CHAT_TOOLS).collect() == []


def test_chat_format_loses_nothing(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":"{broken","type":"function"},{"id":"b","name":"search","arguments":"{\\"query\\":1,\\"query\\":2}"},{"id":"c","name":"search","arguments":"{\\"query\\":\\"x\\"}"}],"z":{"b":1,"a":[2]},"content":null}'),
        (1, 1, "tool", '{"tool_call_id":"a","content":{"k":[1,"é"]},"is_error":true}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"d"}],"tool_calls":[]}'),
    ]
    got = chat_format.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"), queries.CHAT_TOOLS).orderBy("turn").collect()
    call, result = json.loads(got[0].record), json.loads(got[1].record)
    assert call["z"] == {"a": [2], "b": 1} and call["content"] is None
    assert [c["arguments"] for c in call["tool_calls"]] == ["{broken", '{"query":1,"query":2}', {"query": "x"}] and call["tool_calls"][0]["type"] == "function"
    assert (got[0].n_calls, got[0].n_valid, got[0].n_answered) == (3, 1, 1)
    assert result == {"content": {"k": [1, "é"]}, "is_error": True, "role": "tool", "tool_call_id": "a"}
    assert got[2].kind == "plain" and json.loads(got[2].record)["content"] == rows[2][3]
    for r in got:
        assert r.record == json.dumps(json.loads(r.record), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_chat_order(spark):
    rng = random.Random(21)
    rows = []
    for conv in (1, 2, None):
        for turn in range(60):
            pick = rng.random()
            if pick < 0.3:
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": f"t{rng.randrange(15)}", "name": "search", "arguments": {"query": "x"}}]})))
            elif pick < 0.6:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"t{rng.randrange(15)}", "content": "r"})))
            else:
                rows.append((conv, turn, "user", f"hello {turn}"))
    rows += [(1, 7, "user", "same turn")] * 2 + [(2, None, "user", "no turn")]
    got = chat_format.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"), queries.CHAT_TOOLS).collect()
    assert len(got) == len(rows) and all(r.order_index is None for r in got if r.conv_id is None)
    for conv in (1, 2):
        made = {}
        for c, turn, role, text in rows:
            if c == conv and role == "assistant":
                for call in json.loads(text)["tool_calls"]:
                    made[call["id"]] = min(turn, made.get(call["id"], turn))
        place = {}
        for c, turn, role, text in rows:
            if c == conv:
                at = made.get(json.loads(text)["tool_call_id"]) if role == "tool" else None
                none = (0, 0) if turn is None else (1, turn)
                place.setdefault((none if at is None else max(none, (1, at)), int(at is not None), none), []).append((turn, role, text))
        want, before = {}, 0
        for key in sorted(place):
            for turn, role, text in place[key]:
                want[turn, json.loads(text).get("tool_call_id") if role == "tool" else None] = before
            before += len(place[key])
        mine = [r for r in got if r.conv_id == conv]
        assert {(r.turn, json.loads(r.record).get("tool_call_id")): r.order_index for r in mine} == want
        calls = {c["id"]: r.order_index for r in sorted(mine, key=lambda r: -(r.turn or 0)) if r.kind == "call" for c in json.loads(r.record)["tool_calls"]}
        assert all(r.order_index > calls[json.loads(r.record)["tool_call_id"]] for r in mine if r.linked)


def test_url_filter(spark):
    link = '<html><head><link href="{}" rel="canonical"></head>'
    pages = [
        (0, "http://a.example.com/en/3", None),
        (1, "https://x.test/alias", link.format("http://a.example.com/en/3#top")),
        (2, "https://y.test/far?q=1", '<META HTTP-EQUIV=refresh content="0; url=https://x.test/alias">'),
        (3, "http://b.example.com/en/71", link.format("https://x.test/alias")),
        (4, "HTTP://Shop.Example.NET/de/8x?y#z", ""),
        (5, "http://other.net/de/8", "<p>"),
        (6, None, "x"),
        (7, "no scheme", None),
        (8, "http://z.org/es/", link.format("/new")),
        (9, "https://z.org/new", None),
        (9, "https://z.org/new", None),
        (10, "http://notexample.com/fr/en/", None),
    ]
    schema = "page_id long, url string, html string"
    got = {r.page_id: r for r in url_filter.judge(frame(spark, pages, schema), queries.URL_RULES).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        0: ("com/en/", "block"),
        # The allow rule of page 3 is in the same component and comes first.
        1: (None, "allow"),
        2: (None, "allow"),
        3: ("example.com/en/7", "allow"),
        4: ("example.net/de/8", "block"),
        5: ("net/de/", "block"),
        6: (None, "allow"),
        7: (None, "allow"),
        8: ("org/es/", "block"),
        9: (None, "block"),
        10: (None, "allow"),
    }
    assert (got[4].host, got[4].path, got[7].host, got[7].path, got[6].host) == ("shop.example.net", "/de/8x", "", "", "")
    without = url_filter.judge(frame(spark, pages[:3], schema), queries.URL_RULES).collect()
    assert {r.page_id: r.verdict for r in without} == {0: "block", 1: "block", 2: "block"}
    assert url_filter.judge(frame(spark, [], schema), queries.URL_RULES).collect() == []


def test_url_rules_have_the_words_of_the_contract(spark, tmp_path):
    pages = [
        (0, "http://a.example.com/en/3", "com/en/", "block"),
        (1, "http://a.example.com/en/71", "example.com/en/7", "allow"),
        (2, "http://other.net/de/8", "net/de/", "allow"),
        (3, "https://M.Example.NET/de/7?x=/de/8", "net/de/", "allow"),
        (4, "https://m.example.net/de/81#y", "example.net/de/8", "block"),
        (5, "http://z.org/es/", "org/es/", "block"),
        (6, "http://other.net/fr/1", None, "allow"),
    ]
    frame(spark, [(i, url, None) for i, url, _, _ in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_url_filter(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(i, rule, verdict) for i, _, rule, verdict in pages]


def test_url_filter_of_many_rules_and_of_none(spark, monkeypatch):
    rng = random.Random(22)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    rules = [(rng.choice(("block", "allow")), rng.choice(hosts), "/" + "".join(rng.choice("xy") for _ in range(rng.randrange(3)))) for _ in range(150)]
    link = '<link rel="canonical" href="{}">'
    pages = [(i, f"http://{rng.choice(hosts)}.{rng.choice(hosts)}/{''.join(rng.choice('xy') for _ in range(4))}", link.format(f"http://{rng.choice(hosts)}/x?a=1&amp;b=2") if i % 3 else None) for i in range(120)]
    pages += [(900, None, None), (901, "http://", ""), (901, "http://", "")]
    df = frame(spark, pages, "page_id long, url string, html string")
    one = sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "COMPILED_RULES", 0)
    assert sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str) == one
    for i, url, _ in pages:
        host, path = (re.match(r"http://([^/]*)(.*)", url).groups()) if url else ("", "")
        fits = sorted((-len(h + p), h + p, what) for what, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        for row in one:
            if row[0] == i and fits:
                assert row[3:5] == (fits[0][1], fits[0][2])
            elif row[0] == i:
                assert row[3] is None
    monkeypatch.undo()
    got = url_filter.judge(df, []).collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "allow")} and len(got) == len(pages)
    parts = url_filter.declared_links(frame(spark, [("http://h/a", link.format("/b?x=1&amp;y=2"))], "url string, html string"), "url", "html").collect()
    assert [tuple(r) for r in parts] == [("h/a", "h/b?x=1&y=2")]


def test_url_filter_resolves_relative_targets(spark):
    cases = [("new.html", "h/a/b/new.html"), ("../x?q#f", "h/a/x?q"), ("./", "h/a/b/"), ("..", "h/a/"), ("../../../z", "h/z"), ("?p=1", "h/a/b/c?p=1"), ("/r/../s", "h/s"), ("//K/t", "K/t"), ("ftp://k/u", "k/u"), ("x?u=http://k", "h/a/b/x?u=http://k"), ("mailto:x", None), ("#f", None)]
    df = frame(spark, cases, "t string, want string").select("*", url_filter.node_of(url_filter.resolved(F.lit("http://h/a/b/c?x=/y/z"), F.col("t"))).alias("got"))
    assert [r.got for r in df.collect()] == [w.replace("K", "k") if w else None for _, w in cases]
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://q.test/d/a", link.format("b")), (2, "http://q.test/d/b", link.format("http://a.example.com/en/3")), (3, "http://w.test", None), (4, "http://v.test/x", link.format("http://w.test/")), (5, "http://w.test/", link.format("http://a.example.com/en/3")), (6, "http://u.test", '<meta http-equiv="refresh" content="0;url=n.html">'), (7, "http://u.test/n.html", link.format("http://w.test"))]
    got = url_filter.judge(frame(spark, pages, "page_id long, url string, html string"), queries.URL_RULES).collect()
    assert {r.page_id: r.verdict for r in got} == dict.fromkeys(range(1, 8), "block")


def test_quality_network(spark):
    net = quality_cnn.Network()
    texts = [b"hello there big world of words " * 12, b"", b"x!" * 300, b"short"]
    labels = np.array([1, 0, 0, 1], dtype=np.float32)
    # The gradient against differences, away from the corners of its functions.
    net.weights = [w.astype(np.float64) + 0.013 for w in net.weights]

    def loss():
        return -np.mean([np.log(p if y else 1 - p) for p, y in ((net.score(t), y) for t, y in zip(texts, labels, strict=True))])

    grads = net._gradient(texts, labels)
    for k, g in enumerate(grads):
        flat = net.weights[k].reshape(-1)
        for j in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            old, eps = flat[j], 1e-5
            flat[j] = old + eps
            up = loss()
            flat[j] = old - eps
            down = loss()
            flat[j] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[j]) < 2e-3
    assert sum(len(c) for c in quality_cnn.chunks(b"a" * 1000)) >= 1000 and (quality_cnn.chunks(b"a" * 1000) == 97).any(axis=1).all()


def test_quality_held_out(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper().replace(" ", "!! ")) for i in range(400)] + [(900, None), (901, ""), (None, "x")]
    marks = [(i, 1 if i % 3 else 0) for i in range(400)] + [(None, 1), (5000, None)]
    docs, labels = frame(spark, rows), frame(spark, marks, "doc_id long, quality int")
    net = quality_cnn.train(docs, labels.where(quality_cnn.fold(labels.doc_id) != 0))
    got = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    held = [i for i in range(400) if quality_cnn.held_out(i)]
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in held]) > 0.95
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert quality_cnn.score(frame(spark, []), net).collect() == []
    assert quality_cnn.train(docs, frame(spark, [], "doc_id long, quality int")).score(b"") >= 0


def test_quality_of_texts_together_and_one_by_one(spark):
    rng = random.Random(23)
    net = quality_cnn.Network()
    texts = [prose(rng, rng.randrange(0, 400)).encode() for _ in range(30)] + [b"", b"x", prose(rng, 30_000).encode()]

    def plain(text):
        codes, f, fb, w, wb, o, ob = (x.astype(np.float64) for x in net.weights)
        padded = list(text) + [256] * (max(1, -(-(len(text) - 32) // 224)) * 224 + 32 - len(text))
        pooled = []
        for lo in range(0, len(padded) - 32, 224):
            coded = codes[padded[lo : lo + 256]]
            pooled.append(np.maximum(np.max([coded[p : p + 12].reshape(-1) @ f for p in range(0, 245, 4)], axis=0) + fb, 0))
        hidden = np.maximum(np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ w + wb, 0)
        return 1 / (1 + np.exp(-(hidden @ o + ob)[0]))

    assert np.allclose(net.scores(texts), [plain(t) for t in texts], atol=1e-5)
    got = quality_cnn.score(frame(spark, [(i, t.decode(), 7) for i, t in enumerate(texts)] * 2, "doc_id long, text string, score long"), net).collect()
    assert len(got) == 2 * len(texts) and len({(r.doc_id, r.score) for r in got}) == len(texts)
    before = [w.copy() for w in net.weights]
    net.fit(texts[:20], np.arange(20) % 2, epochs=1)
    assert all((a != b).any() for a, b in zip(before, net.weights, strict=True))


def test_queries_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, sf).collect()}
    for (i, _), (n, gone, kept) in zip(rows, brute_removed(rows), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())

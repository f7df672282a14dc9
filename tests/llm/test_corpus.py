"""Corpus operators against brute force, round trips and held-out accuracy, on small and hostile tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import bytewise, decontaminate, html_text, langid, minhash, packing, queries, sharding, simhash, suffix_dedup, token_counts, tokens, toxicity
from tallyforge.llm import jaccard as similarity
from tallyforge.llm.components import components

DOCS = "doc_id long, text string"
#: Nulls, empty, blank, ties, repeated rows, a long text; further columns clash with the operators' own names.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (None, "no id here at all"), (4, "same text twice in two rows"), (4, "same text twice in two rows"), (5, "ÀÉß Ünïcode 中文 text 😀 é"),
    (6, "<|endoftext|> special"), (7, "word " * 9000), (8, "x" * 5000), (9, "12345 !!! ???"), (10, "\x00 control \x85 text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "c", 1, 1, 2) for r in ODD], DOCS + ", id string, th int, rank int, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# packing


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(vocabulary()), random.Random(2)
    texts = [t or "" for _, t in ODD] + ["Don't 'S I'LL x²³ ½ ªºµ ÀÉÎß × ÷ «a» b", "ïẞ İ I áb Ÿ", "'s's'T 12 3a b!!c"]
    texts += ["".join(rng.choice("aB é'sStT1²½!<|>\n\t ßµ÷") for _ in range(40)) for _ in range(400)]
    want = [b"".join(struct.pack("<I", i) for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens.word_encoder(vocabulary())(texts) == want


def test_words_that_are_forgotten_are_learned_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    whole, encode, rng = Tokenizer.from_file(vocabulary()), tokens.word_encoder(vocabulary()), random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcde") * rng.randint(1, 9) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        assert encode(texts) == [b"".join(struct.pack("<I", i) for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    encode.forget()


def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in docs:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[i, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for placed in places.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n for _, _, _, n, _ in want.elements())
    return len(places), -(-total // capacity)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_packing_round_trip(small, odd, capacity):
    for df in (small, odd):
        used, least = check_packing(packing.pack(df, vocabulary(), capacity).collect(), texts_of(df), capacity)
        assert used <= least * 1.1 + 1


def test_packing_empty(empty):
    assert packing.pack(empty, vocabulary()).count() == 0


def test_plan_places_all_and_packs_as_well_as_best_fit():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [min(64, max(1, int(rng.lognormvariate(2.5, 0.9)))) for _ in range(rng.randint(1, 300))]
        rooms, best = [], 0
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                best += 1
                rooms.append(64 - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        seqs, ranks = defaultdict(list), defaultdict(list)
        for length, first, n, sequence, offset in packing.plan(Counter(lengths), 64):
            ranks[length] += range(first, first + n)
            for k in range(n):
                seqs[sequence + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
        for s in seqs.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:], strict=False)) and sum(n for _, n in s) <= 64
        assert len(seqs) <= best


# sharding


def test_shards(small, odd, monkeypatch):
    for df in (small, odd):
        rows = sharding.shard(df, 16).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(df))
        for s in range(16):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        where = defaultdict(set)
        for r in rows:
            where[r.text_crc32, r["size"]].add(r.shard)
        assert all(len(x) == 1 for x in where.values())
        assert {r.law for r in rows} == {"bytes"}
    sums = Counter()
    for r in sharding.shard(small, 4).collect():
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 0.002 * sum(sums.values())


def test_differencing_over_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rng = random.Random(1)
    groups = spark.createDataFrame([(k, rng.getrandbits(62), rng.randint(1, 1000)) for k in range(1500)], "g1 long, g2 long, bytes long")
    got = {r.g1: r.shard for r in sharding.balanced(groups, 8, per_bucket=100).collect()}
    sums = Counter()
    for r in groups.collect():
        sums[got[r.g1]] += r.bytes
    assert len(got) == 1500 and max(sums.values()) - min(sums.values()) < 200


def test_differencing_beats_greedy_order():
    parts = sharding.differenced([[(x, x)] for x in (8, 7, 6, 5, 4)], 2)
    assert sorted(map(sum, parts)) == [14, 16] and sorted(sum(parts, [])) == [4, 5, 6, 7, 8]


def test_shards_are_nearly_even(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "x" * rng.choice([rng.randint(0, 50), rng.randint(100, 2000)]) + str(i)) for i in range(3000)], DOCS)
    sums = {r.shard: r.total for r in sharding.shard(docs, 16).groupBy("shard").agg(F.sum("size").alias("total")).collect()}
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 4


def test_differencing_against_the_best(spark):
    from itertools import product

    rng = random.Random(8)
    worse = []
    for _ in range(40):
        sizes = [rng.randint(1, 60) for _ in range(8)]
        made = sharding.differenced([[(x, k)] for k, x in enumerate(sizes)], 3)
        assert sorted(k for marks in made for k in marks) == list(range(8))
        got = max(sum(sizes[k] for k in marks) for marks in made)
        best = min(max(sum(x for x, s in zip(sizes, to) if s == i) for i in range(3)) for to in product(range(3), repeat=8))
        assert got <= best * 4 / 3
        worse.append(got / best)
    assert np.mean(worse) < 1.06


def test_shards_empty(empty):
    assert sharding.shard(empty).count() == 0


# language


def test_language_held_out_accuracy(small):
    rows = langid.language_id(small).join(small.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, small, odd, empty):
    net = langid.fit(small)
    got = langid.predict(odd, net).collect()
    assert len(got) == len(ODD)
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id or 0), sorted(ODD, key=lambda r: r[0] or 0), strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.language_id(empty).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], DOCS + ", lang string")
    assert langid.language_id(none).first().lang_pred == "und"


def test_language_uses_the_whole_text(spark, small):
    net = langid.fit(small)
    one = {lang: " ".join(r.text for r in small.where(f"lang = '{lang}' and length(text) > 500").limit(5).collect()) for lang in ("en", "de")}
    both = spark.createDataFrame([(1, one["en"][:300] + one["de"] * 3)], DOCS)
    assert langid.predict(both, net).first().lang_pred == "de"


def test_language_sample_is_bounded_whatever_the_ids(spark, small, monkeypatch):
    texts = [(r.text, r.lang) for r in small.where("lang is not null and length(text) > 200").collect()]
    rows = [(None, t, x) for t, x in texts * 3] + [(7, f"{t} {k}", x) for k in range(4) for t, x in texts] + [(9, "abc def " * 100_000, "en")] + [(8, "the same text", "zz")] * 3000
    docs = spark.createDataFrame(rows, DOCS + ", lang string").repartition(3)
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, label, classes: seen.append((windows, label, classes)))
    langid.fit(docs, per_language=20, windows_per_doc=2)
    windows, label, classes = seen.pop()
    assert classes == sorted({x for _, x in texts} | {"zz"}) and all(20 <= n <= 40 for c, n in zip(classes, np.bincount(label)) if c != "zz")
    assert np.bincount(label)[classes.index("zz")] == 1
    langid.fit(docs, per_language=5, windows_per_doc=1000, languages=2)
    assert len(seen[0][2]) == 2 and "zz" not in seen[0][2]
    nulls = spark.createDataFrame([(None, t, x) for t, x in texts], DOCS + ", lang string")
    langid.fit(nulls, per_language=10)
    assert len(seen[1][0]) >= 10
    monkeypatch.undo()
    got = langid.language_id(nulls.withColumn("want", F.col("lang")))
    assert {(r.held_out, r.doc_id) for r in got.collect()} == {(False, None)} and got.where("lang_pred <> 'und'").count() == len(texts)


# toxicity


def test_toxicity_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    rows = [(i, f"fine words number {i}", "en") for i in range(300)] + [(1000, f"zubel text {k % 50}", "en") for k in range(400)] + [(1, "w " * 60_000, "en"), (None, "x", "en"), (2, None, None)]
    labels = [(i, 0) for i in range(300)] + [(1000, 1), (1000, 0), (None, 1), (5, None), (6, 7)]
    docs, marks = spark.createDataFrame(rows, DOCS + ", lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, label, lang: seen.append((texts, label)))
    toxicity.fit(docs, marks, per_class=40, bytes_per_class=100_000)
    toxicity.fit(docs, marks, per_class=40, bytes_per_class=300)
    toxicity.fit(docs.drop("lang"), marks)
    for (texts, label), most, size in zip(seen, (40, 40, 2500), (100_000, 300, 1 << 25), strict=True):
        for k in (0, 1):
            own = [t for t, x in zip(texts, label, strict=True) if x == k]
            assert 0 < len(own) <= most and sum(map(len, own)) <= size and (k == 0 or len(set(own)) == len(own))
    assert len(seen[0][0]) == 80 and sum(seen[2][1]) == 50


def test_toxicity_by_real_labels_and_language(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    ones, zeros = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert len(ones) >= 30 and np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) >= 0.95
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)


def test_thresholds_by_language():
    texts = [b"aa bb", b"aa zz", b"qq rr", b"qq zz"] * 10
    net = toxicity.train(texts, np.array([0, 1, 0, 1] * 10), ["x", "x", "y", "y"] * 10, visits=200)
    z, lang = net.logits(texts)
    assert (lang == [0, 0, 1, 1] * 10).all()
    shifted = z + np.where(lang == 1, 3.0, 0.0)  # a language whose logits are all higher gets a higher threshold
    net.logits = lambda t: (shifted[: len(t)], lang[: len(t)])
    toxicity.calibrated(net, texts[:40], np.array([0, 1, 0, 1] * 10))
    assert net.threshold[1] > net.threshold[0]


def test_toxicity_learns_stems(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "re", "st"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(20, 80))]
        if toxic:
            w.insert(rng.randrange(len(w)), "zubel" + word())
        rows.append((i, " ".join(w), "xx"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS + ", lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_of_odd_texts(small, odd, empty, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.fit(small, labels)
    assert toxicity.score(odd, net).count() == len(ODD)
    assert toxicity.without_toxic(odd, net).columns == odd.columns
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_features_do_not_depend_on_batches():
    texts = [t.encode() for t in ("Alpha beta-gamma", "", "beta ALPHA x", "ünï code 42")]
    f, w, d = toxicity.featurised(texts)
    g, v, e = toxicity.featurised_in_parts(texts, most=10)
    assert (f[w] == g[v]).all() and (d == e).all()


# repeated substrings


def brute_suffix(rows, width):
    seen, out = Counter(), []
    for _, t in rows:
        b = t.encode()
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    for i, t in rows:
        b = t.encode()
        covered = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                covered[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, y in zip(b, covered, strict=True) if not y)).hexdigest()))
    return Counter(out)


def suffix_rows(df, width):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.suffix_dedup(df, width, digest=True).collect())


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 3])
def test_suffix_dedup_against_brute_force(spark, odd, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (200, 32, split))
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randint(180, 400))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages)[rng.randint(0, 60) :] + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 100)))
        rows.append((i if rng.random() < 0.9 else None, t))
    rows += [(500, ""), (502, "ha" * 600), (503, "x" * 199), (504, "x" * 200), (505, "y" * 201), (3, rows[3][1]), (3, rows[3][1])]
    assert suffix_rows(spark.createDataFrame(rows, DOCS).repartition(5), 200) == brute_suffix(rows, 200)


def test_suffix_dedup_odd(odd, empty, small):
    assert suffix_rows(odd, 200) == brute_suffix(texts_of(odd), 200)
    assert suffix_rows(odd, 20) == brute_suffix(texts_of(odd), 20)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_rows(small, 200) == brute_suffix(texts_of(small), 200)


@pytest.mark.parametrize("wide", [1, 8, 13, 24])
def test_multikey_order(wide):
    rng = random.Random(8)
    keys = [bytes(rng.choice(b"ab") for _ in range(wide)) for _ in range(300)] + [bytes(wide)] * 3
    order = suffix_dedup.multikey_order(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, wide))
    assert [keys[i] for i in order] == sorted(keys)


def test_the_result_comes_through_the_sort(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcd e") for _ in range(500))
    rows = [(i, "".join(rng.choice("abcde") for _ in range(rng.randint(0, 80))) + passage[rng.randint(0, 200) :]) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    assert suffix_rows(docs, 200) == brute_suffix(rows, 200)
    monkeypatch.setattr(suffix_dedup, "multikey_order", lambda keys: np.random.default_rng(1).permutation(len(keys)))
    contexts = [passage.encode()[k : k + 300] for k in range(0, 60, 3)] + [bytes(rng.choice(b"abcde") for _ in range(300)) for _ in range(200)]
    back = np.array([160 - k for k in range(0, 60, 3)] + [100] * 200)
    shuffled = suffix_dedup.repeats(contexts, back, 200, 168)
    monkeypatch.undo()
    sorted_ = suffix_dedup.repeats(contexts, back, 200, 168)
    place = Counter(c[p : p + 200] for c in contexts for p in range(101))
    found = lambda x: {(r, p) for r, p, twice in zip(*x[:3]) if twice}
    want = {(r, p) for r, c in enumerate(contexts) for p in range(101) if place[c[p : p + 200]] > 1}
    assert found(sorted_) == want and found(shuffled) != want


@pytest.mark.parametrize("chunk", [250, 1000, 1 << 18])
def test_anchors_do_not_depend_on_chunks(chunk, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(bytewise, "mix", lambda h: h & np.uint64(0xFFFFFF0000000000))  # many hashes tie
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(150, 1500))) for _ in range(12)] + ["ab" * 500]
    frame = pd.DataFrame({"id": range(13), "th": 0, "text": texts})
    named = {}
    for x in suffix_dedup._find_anchors(200, 32)(iter([frame])):
        for i, at, lo, hi in zip(x.id, x["at"], x.lo, x.hi):
            for s in range(lo, hi + 1):
                assert named.setdefault(texts[i][s : s + 200], at - s) == at - s
    assert len(named) == len({t[s : s + 200] for t in texts for s in range(len(t) - 199)})


def test_repeats_leave_clashing_columns_alone(spark):
    rows = [(i, "x" * 150 + "y" * 150 if i < 3 else None if i == 3 else "short", 7, "r", 2**60 + i, i, "k", 0.5, "o") for i in range(6)]
    names = "doc_id long, text string, n_chars int, ranges string, id long, th int, kept string, part double, _row string"
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, names)).collect()}
    assert [got[i].text for i in range(6)] == ["", "", "", None, "short", "short"] and [got[i].n_chars for i in range(6)] == [0, 0, 0, None, 5, 5]
    assert all((r.ranges, r.id, r.th, r.kept, r.part, r._row) == ("r", 2**60 + i, i, "k", 0.5, "o") for i, r in got.items())
    odd = spark.createDataFrame(rows, names)
    assert [r.ranges for r in suffix_dedup.suffix_dedup(odd, keep=("ranges", "id")).select("ranges").collect()] == ["r"] * 6


# near duplicates


def brute_fingerprint(text, width=3):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(prints, ids, distance=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def near_copies(small):
    rng = random.Random(3)
    rows = texts_of(small)
    base = rows[5][1].split()[:60]
    for k in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(base)
        rows.append((1000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("forced", [None, "heavy", (3, [0, 0, 1]), (2, [1, 1]), (1, [3])])
def test_simhash_components(spark, small, forced, monkeypatch):
    rows = near_copies(small)
    if forced == "heavy":  # most keys are cut into blocks
        forced = None
        monkeypatch.setattr(simhash, "BLOCK", 9)
        monkeypatch.setattr(simhash, "heavy_keys", lambda *a, f=simhash.heavy_keys: heavy.append(f(*a)) or heavy[-1])
    heavy = []
    if forced:
        parts, thresholds = forced
        if parts == 1:
            rows = rows[::40]
        monkeypatch.setattr(simhash, "plan", lambda n, p, related, distance: (simhash.grouped_bits(related, parts), thresholds, 0.0))
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    assert got == set(zip([i for i, _ in rows], prints, brute_components(prints, [i for i, _ in rows]), strict=True))
    assert not heavy or max(heavy[0].values()) > 2


def test_rows_that_differ_elsewhere_are_one(spark):
    rows = [(1, "a b c d e f", "x", 5), (1, "a b c d e f", "y", 6), (None, "a b c d e f", "z", 7), (2, None, "n", 8), (3, " ", "m", 9)] * 30
    names = "doc_id long, text string, _id string, _row long"
    kept = [sorted(map(tuple, simhash.without_near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], names)).collect())) for k in (0, 1, 2)]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2] and kept[0][1] == (2, None, "n", 8)
    assert sorted(map(tuple, similarity.without_similar(spark.createDataFrame(rows, names)).collect())) == kept[0]


def test_simhash_odd(odd, empty):
    rows = texts_of(odd)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], prints, brute_components(prints, [i for i, _ in rows]), strict=True))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(odd).collect()) == want
    assert simhash.simhash_components(empty).count() == 0


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**4, 10**7, 10**9, 10**11):
        groups, thresholds, _ = simhash.plan(n, np.full(64, 0.4), np.eye(64), 3)
        assert sorted(sum(groups, [])) == list(range(64)) and sum(t + 1 for t in thresholds) == 4
        for a in x[:100]:
            b = int(a)
            for bit in rng.choice(64, 3, replace=False):
                b ^= 1 << int(bit)
            assert any(sum((int(a) ^ b) >> k & 1 for k in g) <= t for g, t in zip(groups, thresholds, strict=True) if t >= 0)


def test_bucket_edges_span_links():
    rng = random.Random(6)
    for _ in range(30):
        fp = np.array(sorted({rng.getrandbits(8) for _ in range(rng.randint(1, 80))}), np.uint64)
        a, b = simhash.bucket_edges(fp, 1)
        want = brute_components([int(x) for x in fp], list(range(len(fp))), 1)
        at = {int(x): i for i, x in enumerate(fp)}
        parent = list(range(len(fp)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            parent[find(at[int(x)])] = find(at[int(y)])
        groups, expected = defaultdict(set), defaultdict(set)
        for i in range(len(fp)):
            groups[find(i)].add(i)
            expected[want[i]].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())) and len(a) < max(1, len(fp))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(201)), list(range(1000, 1100)), [2000, 2001]]
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_one_of_each_component_stays(spark, small, odd):
    rows = near_copies(small)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], DOCS + ", th long")
    least = set(brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows]))
    kept = simhash.without_near_duplicates(df)
    assert {r.doc_id for r in kept.collect()} == least and kept.columns == df.columns and kept.count() == len(least)
    prints = [brute_fingerprint(t) for _, t in texts_of(odd)]
    assert simhash.without_near_duplicates(odd).count() == len(set(brute_components(prints, list(range(len(prints))))))


# Jaccard similarity


def brute_similar(rows):
    """Places in ``rows`` of the least document of each component of 5-word Jaccard >= 0.8."""
    words = [t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split() for _, t in rows]
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(runs):
        for j, y in enumerate(runs[:i]):
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if r not in least or (d is not None and (rows[least[r]][0] is None or d < rows[least[r]][0])):
            least[r] = i
    return sorted(least.values())


def similar_copies(small, rng):
    rows = texts_of(small)
    for k, (_, t) in enumerate(rows[:60]):
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):  # similarity on both sides of 0.8
            w[rng.randrange(len(w))] = rng.choice(["other", "words", "here"])
        rows.append((5000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("frequent", "near", "block"), [(similarity.FREQUENT, similarity.NEAR, similarity.BLOCK), (2, 1, 7), (2, 2, 1 << 15)])
def test_similar_documents_go(spark, small, odd, empty, frequent, near, block, monkeypatch):
    for name, value in (("FREQUENT", frequent), ("NEAR", near), ("BLOCK", block)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(11)
    rows = similar_copies(small, rng)
    base = rows[7][1].split()[:100]
    for k in range(60):  # a large group, some of it linked only through others or not at all
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows += [(8000 + k, " ".join(w))] * rng.choice([1, 1, 2])
    got = {r.doc_id for r in similarity.without_similar(spark.createDataFrame([(i, t, i) for i, t in rows], DOCS + ", th long")).collect()}
    assert got == {rows[k][0] for k in brute_similar(rows)} and len(got) < len(rows) - 20
    assert similarity.without_similar(odd).count() == len(brute_similar(texts_of(odd))) and similarity.without_similar(empty).count() == 0


def test_pairs_of_a_group_grow_with_its_size():
    import pandas as pd

    made = []
    for size in (100, 400, 1600):
        frame = pd.DataFrame({"h": np.repeat(np.arange(5), size), "name": np.tile(np.arange(size), 5), "n": 50, "place": 1}).astype({"n": "int32", "place": "int32"})
        parts = list(similarity._near(8, at_once=37)(iter([frame.iloc[: 3 * size], frame.iloc[3 * size :]])))
        far = pd.concat([p[p.place >= 0] for p in parts])
        assert sorted(zip(far.h, far.a)) == [(h, k) for h in range(5) for k in range(size)]
        made.append(sum(len(p) for p in parts))
    assert made[2] <= 20 * made[0]
    few = pd.DataFrame({"h": np.repeat(np.arange(50), 9), "name": np.tile(np.arange(9), 50), "n": 50, "place": 1}).astype({"n": "int32", "place": "int32"})
    parts = pd.concat(similarity._near(8, at_once=10)(iter([few])))
    assert (parts.place < 0).all() and len(parts.drop_duplicates()) == 36


def test_pairs_of_copies_with_changes_of_their_own_grow_with_their_number(spark, monkeypatch):
    made, check = [], similarity._checked

    def counted(texts, pairs, value, test):
        made[-1] += pairs.count()
        return check(texts, pairs, value, test)

    monkeypatch.setattr(similarity, "_checked", counted)
    for size in (150, 600):  # most are less than 0.8 alike, but share hashes
        rng, rows = random.Random(13), []
        for k in range(size):
            w = [f"w{x}" for x in range(150)]
            for x in rng.sample(range(150), rng.choice([1, 2, 3, 3, 3, 5])):
                w[x] = f"x{k}a{x}"
            rows.append((k, " ".join(w), k))
        made.append(0)
        got = {r.doc_id for r in similarity.without_similar(spark.createDataFrame(rows, DOCS + ", th long")).collect()}
        assert got == {rows[k][0] for k in brute_similar([(i, t) for i, t, _ in rows])} and len(got) > 5
    assert made[1] <= 8 * made[0]


def test_rows_that_cannot_pair_go_before_pairing(spark):
    rng, sets_ = random.Random(5), []
    for _ in range(60):  # groups of sets on both sides of 0.8, in one order of hashes; late hashes are common
        base = rng.sample(range(3000), rng.randint(1, 60)) + rng.sample(range(3000, 3040), rng.randint(0, 12))
        for _ in range(rng.randint(1, 5)):
            x = set(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 5])):
                x.discard(rng.choice(base))
                x.add(rng.randrange(3040))
            sets_.append(sorted(x))
    rows = [(h, k, len(x), p) for k, x in enumerate(sets_) for p, h in enumerate(x[: len(x) - -(-4 * len(x) // 5) + 1])]
    got = {(r.h, r.name) for r in similarity.fitting(spark.createDataFrame(rows, "h long, name long, n int, place int")).collect()}
    alike = [(i, j) for i, x in enumerate(sets_) for j, y in enumerate(sets_[:i]) if 9 * len(set(x) & set(y)) >= 4 * (len(x) + len(y))]
    for i, j in alike:
        h = min(set(sets_[i]) & set(sets_[j]))
        assert (h, i) in got and (h, j) in got
    assert len(alike) > 50 and got <= {(h, k) for h, k, _, _ in rows} and 3 * len(got) < 2 * len(rows)
    late = [(7, k, 50, 9) for k in range(100)] + [(8, k, 10 * 2**k, 0) for k in range(20)]  # too late in all, and sizes too far apart
    assert similarity.fitting(spark.createDataFrame(late, "h long, name long, n int, place int")).count() == 0


def test_pipeline_keeps_no_similar_documents(spark, small, data):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = similar_copies(small, random.Random(12))
    left = texts_of(stages["simhash_near_dedup"](spark, spark.createDataFrame(rows, DOCS), data))
    assert len(brute_similar(left)) == len(left)


# benchmark leaks


def test_leaks_as_they_are_and_reparameterised(spark, odd, empty):
    item = "Alice bought 12 apples for 30 dollars and then Alice sold 12 apples to Bob near the old market yesterday"
    bench = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "too short", "z"), (None, item, "z")], "item_id long, text string, doc_id string")
    docs = [
        (1, "So it was. " + item + ", they say."), (2, "Then Carol bought 99 apples for 31 euros and then Carol sold 99 apples to Dan near the old market yesterday"),
        (3, "Then Carol bought 99 apples for 31 euros and then Carol sold 98 apples to Dan near the old market yesterday"), (4, "Alice bought apples near the old market"), (None, item), (5, None),
    ]
    df = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1, False), (2, 1, True), (None, 1, False)}
    assert got == {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(df, bench, block=1).collect()}
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {3, 4, 5}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(df, bench.where("false")).count() == 0


def held(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), DOCS), bench).collect()}


def test_leaks_do_not_depend_on_case_lines_or_places_of_names(spark):
    a = "Anna has 5 apples. Anna buys 7 more apples at the market. How many apples does Anna have now?"
    b = "Anna has 5 apples. Anna buys 7 more apples at the market. How many apples are there now?"
    c = "Der Bauer verkauft der Frau im Dorf 12 Eier, und die Frau gibt dem Bauer im Garten einen Korb voll Birnen"
    docs = [a.replace("Anna", "Bob"), b.replace("Anna", "Bob").replace("5", "6"), c.lower(), c.replace(" ", "\n"), "So " + a.upper(), "Anna has 5 apples. Bob buys 7 more apples. How many are at the market now?"]
    assert held(spark, [a, b, c], docs) >= {(0, 0, True), (1, 1, True), (2, 2, False), (3, 2, False), (4, 0, False)}
    assert not {d for d, _, _ in held(spark, [a, b, c], docs)} & {5}
    wrapped = a.replace("Anna", "Bob").replace(" ", "\n")
    assert held(spark, [a], [wrapped]) == {(0, 0, True)}


def test_items_without_template_windows_are_found_as_they_are(spark):
    items = ["Compute 12 + 34 * 5 - 7", "see Anna, Bob, Carl, Dora, Emil", "Why so?", "1 2 3 4 5 6"]
    docs = ["Now: compute 12 + 34 * 5 - 7, please", "We see Anna, Bob, Carl, Dora, Emil there", "they asked why so? and left", "1 2 3 4 5 6", "Compute 13 + 34 * 5 - 7", "why is it so", "2 3 4 5"]
    assert {(d, i) for d, i, _ in held(spark, items, docs)} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_every_alignment_is_tried(spark):
    item = "Alice bought 12 apples for 30 dollars and then Alice sold 12 apples to Bob near the old market yesterday"
    wrong = "Carol bought 99 apples for 31 euros and then Carol sold 98 apples to Dan near the old market yesterday"
    other = "Carol bought 99 apples for 31 euros and then Carol sold 99 apples to Dan near the old market yesterday"
    between = " Something else stands here, of no matter at all, and goes on for a while. "
    docs = [wrong + between + item, item + between + wrong, wrong + between + other, other + between + wrong, wrong + between + wrong, (wrong + between) * 20 + item, wrong.replace("then", "only then") + between + other.replace("near", "very near")]
    found = held(spark, [item], docs)
    assert {(d, i) for d, i, _ in found} == {(0, 0), (1, 0), (2, 0), (3, 0), (5, 0), (6, 0)}
    assert {d for d, _, differs in found if differs} == {2, 3, 6}


def test_numbers_are_one_word_however_written(spark):
    items = ["A tank holds 3.5 litres of water and loses 0.25 litres every hour until it is empty", "Maria has five red apples and gives two of them to her brother before lunch today"]
    docs = [
        "A tank holds 12 litres of water and loses 1 litres every hour until it is empty", "so a tank holds 1,200.75 litres of water and loses 3 litres every hour until it is empty.",
        "Then Eva has 9 red apples and gives 3 of them to her brother before lunch today", "A tank holds 3.5 litres of water and loses 0.25 litres every hour until it is empty",
        "A tank holds plenty of water and loses 0.25 litres a day until it is empty",
    ]
    assert held(spark, items, docs) == {(0, 0, True), (1, 0, True), (2, 1, True), (3, 0, False)}


def brute_template(item, doc):
    """Whether a stretch of ``doc`` is ``item`` word for word, but for numbers and names, each replaced by one other of its kind."""
    import re

    x, y = (re.findall(r"[A-Za-z0-9]+", t) for t in (item, doc))
    typed = lambda w: "#" if w.isdigit() else "@" if w[:1].isupper() and w[1:].islower() else w.lower()
    for k in range(len(y) - len(x) + 1):
        part = y[k : k + len(x)]
        if [w.lower() for w in part] == [w.lower() for w in x]:
            return True
        if len(x) >= 8 and all(typed(v) == typed(w) for v, w in zip(x, part)):
            slots = {}
            if all(slots.setdefault(v, w) == w for v, w in zip(x, part) if typed(v) in "#@"):
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    verbs, things, names = "takes sells paints counts moves finds".split(), "boxes chairs lamps ropes tiles coins bottles".split(), "Anna Bruno Clara Dario Edgar Frida".split()

    def item():
        return " ".join(f"{rng.choice(names)} {rng.choice(verbs)} {rng.randint(2, 99)} {rng.choice(things)} {rng.choice(['from', 'near', 'behind'])} the {rng.choice(things)} and" for _ in range(rng.randint(2, 4)))

    def replaced(t, slip):
        words, to, out = t.split(), {}, []
        for w in words:
            if w.isdigit() or w in names:
                new = str(rng.randint(100, 999)) if w.isdigit() else rng.choice(["Gustav", "Hanna", "Ingrid"]) + "x" * len(to)
                w = to.setdefault(w, new)
                if slip and w.isdigit() and rng.random() < 0.5:
                    w = str(rng.randint(1000, 9999))
            out.append(w)
        return " ".join(out)

    items = [item() for _ in range(12)] + ["why so", "seven tiles", "Compute 1 + 2"]
    docs = []
    for k in range(150):
        t = rng.choice(items)
        body = [t, replaced(t, False), replaced(t, True), t.lower(), " ".join(rng.sample(things * 3, 12)), " ".join(t.split()[: len(t.split()) // 2])][k % 6]
        docs.append(rng.choice(["", "so it was that ", "In short: "]) + body + rng.choice(["", " they say.", "\nThe end."]))
    found = {(d, i) for d, i, _ in held(spark, items, docs)}
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if brute_template(x, t)}
    assert want <= found and len(want) > 60
    # what else is found shares 0.8 of an item's plain windows, or its template ones (names at a sentence's start, say), never half an item
    assert all(d % 6 not in (4, 5) for d, i in found if i < 12)


def test_leaks_find_whole_items(spark, small, data):
    import re

    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in bench.collect()}
    want = {(i, k) for i, t in texts_of(small) for k, s in items.items() if s in " ".join(re.findall(r"\w+", t.lower()))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(small, bench).collect()}
    assert want and want <= got
    clean = [i for i, t in texts_of(small) if not any(len(set(t.lower().split()) & set(s.split())) > 0.5 * len(set(s.split())) for s in items.values())]
    assert not {i for i, _ in got} & set(clean)


# tokens of sections


def byte_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(small, odd, rule):
    path, pattern = byte_vocabulary()
    encode, size = token_counts._encoder(path, pattern)
    for df in (small, odd):
        want = Counter()
        for i, t in texts_of(df):
            lines = t.encode().splitlines(keepends=True) if False else [x + b"\n" for x in t.encode().split(b"\n")]
            lines[-1] = lines[-1][:-1]
            if len(lines) > 1 and not lines[-1]:
                lines.pop()
            owner = [k for k, x in enumerate(lines) for _ in x]
            n, at = [0] * len(lines), 0
            for token in encode(t):
                own = owner[at : at + size[token]]
                n[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
                at += int(size[token])
            for k, x in enumerate(lines):
                want[i, k, len(x.decode()), n[k]] += 1
        assert Counter((r.doc_id, r.section, r.n_chars, r.n_tokens) for r in token_counts.token_counts(df, path, pattern, rule).collect()) == want


def test_token_counts_of_a_very_long_word_and_line(spark):
    path, pattern = byte_vocabulary()
    encode, _ = token_counts._encoder(path, pattern)
    texts = ["abcdefghij" * 32_000, ("é中x " * 20_000 + "\n") * 2, "\n" * 3000]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), DOCS), path, pattern).collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == len(encode(t)) and sum(r.n_chars for r in own) == len(t) and len(own) == (1, 2, 3000)[i]


def test_short_texts_without_ids_do_not_gather(spark):
    docs = spark.createDataFrame([(None, "")] * 50 + [(k, "x" * 300) for k in range(3)], DOCS).repartition(5)
    out = suffix_dedup.suffix_dedup(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("SortMergeJoin")[1].split("]")[0] if "SortMergeJoin" in plan else "part#" in plan
    assert out.count() == 53 and out.where("n_removed = 300").count() == 3


def test_token_counts_of_fields(spark, empty):
    path, pattern = byte_vocabulary()
    df = spark.createDataFrame([(1, "Ünï title", None, "body text here")], "doc_id long, title string, lang string, text string")
    rows = token_counts.token_counts(df, path, pattern, "first", ["title", "lang", "text"]).collect()
    encode, _ = token_counts._encoder(path, pattern)
    assert [r.n_chars for r in rows] == [10, 1, 14] and sum(r.n_tokens for r in rows) == len(encode("Ünï title\n\nbody text here"))
    assert token_counts.token_counts(empty, path, pattern).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.token_counts(df, path, pattern, "any")


# pages


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("<h1>T</h1>x", "T\n\nx"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>n<th>val<tr><td>one<td>2</table>", "n    val\none  2"), ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide     c\na     b  d"),
        ("<pre> x\n  y</pre>", " x\n  y"), ("<p hidden>no</p>yes", "yes"), ("<div style='display: none'>no<p>no</div>yes", "yes"), ("<script>var t='</p>'</script>ok<style>p{}</style>", "ok"),
        ("<!-- a > b -->ok<!doctype html>", "ok"), ("<title>t</title><body>b", "b"), ("a <b>b</b> c<i>d</i>", "a b cd"), ("</p></div>x</b>", "x"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<dl><dt>k<dd>v</dl>", "k\n  v"), ("x<input type=hidden value=v>y", "xy"), ("<td>loose", "loose"), ("1 < 2 and <3", "1 < 2 and <3"),
    ],
)
def test_rendering(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>T</title><h1>Hi</h1><p>text", "Hi\n\ntext"), ("<head><meta charset=x><link rel=a>\n<style>p{}</style>plain text", "plain text"),
        ("<head><script>x()</script><noscript>no</noscript><template><p>no</template><p>yes</p>", "yes"), ("<html><head><title>T</title></head>\n<h1>Hi</h1>", "Hi"), ("<head><title>T</title><body><p>b", "b"),
    ],
)
def test_an_open_head_ends_at_content(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p title=it's>Hello</p><p>isn't</p>", "Hello\n\nisn't"), ("<p it's \"x>Hello</p>it's", "Hello\n\nit's"), ("<a title = 'x > y' href=a/b>z</a>", "z"), ("<p title=>x", "x"), ("<p style='display:none'>no</p><p style=color:red>x", "x"),
        ("a <textarea rows=2>\nb &amp; <b>\n  c\nd</textarea>", "a b & <b>\n  c\nd"), ("<select><option>one<option selected>two<option>three</select> x", "two x"), ("<select><option disabled>one<option>two</select>", "two"),
        ("<select multiple><option>one<option>two</select>", "one two"), ("<svg><title>no</title><defs><text>no</text></defs><g><text x=1>A<tspan>B</tspan></text><path d=m /><text>C</text></g></svg>d", "AB C d"),
        ("<svg><path d=m><p>out", "out"), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"), ("<div hidden><svg><text>no</text></svg></div>x", "x"),
    ],
)
def test_all_that_browsers_show(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>ff<td>g</table>", "a   b    c\nd        e\nff       g"),
        ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</tbody></table>", "a  b\nc  d"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>z", "yes\n\nz"),
        ("<p style='display:none'>no <b style='display:inline'>no</b></p><p hidden style='display:block'>shown</p>", "shown"),
        ("a<dialog>no<p>no</dialog><dialog open>yes</dialog>b", "a\nyes\nb"),
        ("<details>no<summary>head</summary><summary>no</summary><p>no<summary>no</summary></details>x", "head\nx"),
        ("<details open><summary>head</summary>body</details>x", "head\nbody\nx"),
        ("<details><div><summary>no</summary></div><summary>s<details><summary>t</summary>no</details></summary>no</details>x", "s\nt\nx"),
        ("<table><tr><td>中文<td>a<tr><td>xyz<td>b</table>", "中文  a\nxyz   b"),
        ("<ol><li><p>a</p><p>b</p><ul><li>c<li>d</ul><li><li>e</ol>f", "1. a\n\n   b\n\n   - c\n   - d\n3. e\n\nf"),
        ("<blockquote>a<blockquote>b<pre>c\n\n  d</pre></blockquote></blockquote>e", "  a\n\n    b\n\n    c\n\n      d\n\ne"),
        ("<ul><li><br>a<br><br>b<br></ul>c", "- a\n\n  b\n\nc"),
    ],
)
def test_spans_visibility_and_levels(html, want):
    assert html_text.render(html) == want


class Walker:
    """A plain tree walker: shown words in order, by recursion over a tree of (tag, attributes, children) and strings."""

    def words(self, node, invisible=False):
        if isinstance(node, str):
            return [] if invisible else node.split()
        tag, attributes, children = node
        style = attributes.get("style", "")
        if tag in ("script", "template") or "hidden" in attributes or "display" in style or (tag == "dialog" and "open" not in attributes):
            return []
        invisible = {"visibility:hidden": True, "visibility:visible": False}.get(style, invisible)
        if tag == "details" and "open" not in attributes:
            children = [c for c in children if not isinstance(c, str) and c[0] == "summary"][:1]
        return [w for c in children for w in self.words(c, invisible)]

    def html(self, node):
        if isinstance(node, str):
            return node
        tag, attributes, children = node
        return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attributes.items())}>{''.join(map(self.html, children))}</{tag}>"


def test_rendering_against_a_tree_walker():
    rng, walker = random.Random(6), Walker()

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            return f" w{rng.randrange(1000)} "
        tag = rng.choice(["div", "span", "section", "b", "details", "summary", "dialog", "template", "article", "blockquote", "center"])
        attributes = rng.choice([{}, {}, {}, {"hidden": ""}, {"open": ""}, {"open": ""}, {"style": "display:none"}, {"style": "visibility:hidden"}, {"style": "visibility:visible"}])
        return (tag, attributes, [tree(depth - 1) for _ in range(rng.randint(0, 4))])

    for _ in range(600):
        node = ("div", {}, [tree(6) for _ in range(3)])
        assert html_text.render(walker.html(node)).split() == walker.words(node)


def test_tables_against_a_grid():
    rng = random.Random(7)
    for _ in range(200):
        rows, cells, taken = rng.randint(1, 6), {}, set()
        html = "<table>"
        for y in range(rows):
            html, x = html + "<tr>", 0
            for _ in range(rng.randint(1, 4)):
                while (x, y) in taken:
                    x += 1
                across, down = rng.choice([(1, 1), (1, 1), (2, 1), (1, 2), (2, 2), (1, 3)])
                word = f"v{rng.randrange(10 ** rng.randint(1, 5))}"
                cells[x, y] = word
                taken |= {(x + i, y + j) for i in range(across) for j in range(down)}
                html += f"<td colspan={across} rowspan={down}>{word}"
                x += across
        wide = {}
        for (x, _), w in cells.items():
            wide[x] = max(wide.get(x, 0), len(w))
        begin = {x: sum(wide.get(i, 0) + 2 for i in range(x)) for x, _ in cells}
        lines = [x for x in html_text.render(html + "</table>").split("\n") if x]
        want = [y for y in range(rows) if any(b == y for _, b in cells)]
        assert len(lines) == len(want)
        for line, y in zip(lines, want, strict=True):
            assert line.split() == [w for (_, b), w in sorted(cells.items()) if b == y]
            assert all(line[begin[x] : begin[x] + len(w)] == w for (x, b), w in cells.items() if b == y)


@pytest.mark.parametrize(
    "piece", ["<a ", "<a x='", "<div>", "<p><b>", "<ul><li>", "<ol><li>x", "<blockquote>y", "<table><tr><td>z", "<table>", "<p><button><div>", "<!--", "</p>", "</x>", "<select><option>", "<svg><g>", "<b a='<' ", "&amp", "<td rowspan=9 colspan=9>q", "<details>", "<textarea>", "<title>"]
)
def test_a_megabyte_takes_seconds(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.render(page)
    html_text.render("<table><tr>" + page)
    assert time.process_time() - began < 40


def test_rendering_survives_anything():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "<li>", "<ul>", "</ul>", "<pre>", "</pre>", "x", " y ", "<br>", "<caption>", "<div hidden>", "</div>", "<", "&lt;", "<script>", "</script>", "<b", "<blockquote>", "<dd>", "</tr>", "</li>", "<select><option>"]
    for _ in range(1500):
        html_text.render("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    assert html_text.render("<div>" * 20000 + "x") == "x"


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = html_text.html_text(pages).collect()
    assert len(got) == pages.count() and all("<" not in r.text or "&" for r in got) and not any("track(" in r.text for r in got)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", "t"), (1, None, "", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.html_text(odd).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert html_text.html_text(odd.where("false")).count() == 0


# fingerprints


def shingle_set(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints(small, partitions, spark, monkeypatch):
    rows = sorted(texts_of(small), reverse=True)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.doc_id: r for r in minhash.document_fingerprints(small).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    errors, same = [], {}
    for k, (i, t) in enumerate(rows):
        following, r = rows[(k + 1) % len(rows)][1], got[i]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, following)]
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25


def test_fingerprints_odd(odd, empty, spark):
    got = minhash.document_fingerprints(odd).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in texts_of(odd))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert minhash.document_fingerprints(empty).count() == 0
    alone = minhash.document_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], DOCS)).first()
    assert alone.near_next == 1.0


# hashing, and the whole


def test_string_hashes_agree():
    data = np.frombuffer(b"abcabcabcXYZabc", np.uint8)
    for width in (1, 3, 5, 8):
        h = bytewise.strings(data, width)
        raw = data.tobytes()
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (raw[i : i + width] == raw[j : j + width])


def test_anchors_name_equal_places():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abc ") for _ in range(400))
    for text in (body, b"ab" * 200, b"x" * 400):
        at, lo, hi, _ = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 200, 32)
        named = {s: a - s for a, x, y in zip(at, lo, hi, strict=True) for s in range(x, y + 1)}
        assert sorted(named) == list(range(len(text) - 199)) and all(0 <= o <= 168 for o in named.values())
        first = {}
        for s, o in named.items():
            assert first.setdefault(text[s : s + 200], o) == o


def test_pipeline(spark, data):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, data)
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            rows = texts_of(before)
            close = set(brute_components([brute_fingerprint(t, 5) for _, t in rows], [i for i, _ in rows]))
            rows = [(i, t) for i, t in rows if i in close]
            assert {r.doc_id for r in docs.collect()} == {rows[k][0] for k in brute_similar(rows)}
        if name == "suffix_dedup":
            want = Counter((i, n - r) for (i, n, r, _, _), k in brute_suffix(texts_of(before), 200).items() for _ in range(k))
            assert Counter((r.doc_id, len(r.text.encode())) for r in docs.collect()) == want
        if name == "benchmark_decontamination":
            leaked = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaked
            kept = texts_of(docs)
    check_packing(docs.collect(), kept, 2048)


def test_pipeline_run(spark, data, tmp_path):
    import os
    import shutil

    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copyfile(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    kind = docs.withColumns({"ranges": F.lit("r"), "id": F.col("doc_id").cast("string"), "kept": F.lit(None).cast("string")})
    odd = spark.createDataFrame([(None, None, None, None, None, "r", "i", None), (None, "", "en", "s", 0, "r", "i", "k"), (7, "w " * 30_000, None, "s", 1, None, None, "k"), (7, "w " * 30_000, None, "t", 1, None, None, "k"), (2**60, "one two three", "en", "s", 3, "r", "i", "k")], ", ".join(f"{k} {v}" for k, v in kind.dtypes))
    kind.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    got = rows.collect()
    left = [x for x in os.listdir(root) if x not in before and x.startswith("tallyforge-")]
    assert len(left) <= 4, left  # what the result reads
    assert {r.doc_id for r in got} >= {7, 2**60, None} and 150 < len({r.doc_id for r in got}) < docs.count()
    kind.where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"none/{name}.parquet"))
    odd.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "none")).collect()} == {7, 2**60, None}


def test_equal_rows_are_dealt_over_partitions(spark):
    rows = [(5, "the same row again and again")] * 400 + [(9, "a b c d e f g"), (1, "h i j k l m n")]
    got = minhash.document_fingerprints(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    assert len(got) == 402 and sum(r.near_next == 1.0 for r in got) >= 399 and {r.fingerprint for r in got if r.doc_id == 5} == {next(r.fingerprint for r in got if r.doc_id == 5)}


def test_large_ids_beside_nulls_stay_exact(spark, small):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "die der und das ist nicht"), (None, "the and of to"), (big + 2, None)], DOCS).coalesce(1)
    path, pattern = byte_vocabulary()
    made = [
        packing.pack(docs, vocabulary()), sharding.shard(docs), langid.predict(docs, langid.fit(small)), toxicity.score(docs, None), suffix_dedup.suffix_dedup(docs), simhash.simhash_components(docs),
        token_counts.token_counts(docs, path, pattern), minhash.document_fingerprints(docs), simhash.without_near_duplicates(docs),
    ]
    for df in made:
        assert {r.doc_id for r in df.collect()} == {big, big + 2, None}


def test_ten_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))

"""Edge cases and brute-force twins of the operators over documents."""

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.llm import common, decontamination, hashing, license_scan, line_dedup, lm_scoring, mixing, near_dedup, pii, toxicity

SCHEMA = "doc_id long, text string, source string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows, null ids."""
    rng = random.Random(3)
    out, base = [], words(rng, 120)
    passage = " ".join(words(rng, 60))
    for i in range(60):
        t = " ".join(words(rng, rng.randrange(1, 120)))
        if i % 6 == 0:
            near = list(base)
            for _ in range(i % 5):
                near[rng.randrange(120)] = f"x{i}"
            t = " ".join(near)
        elif i % 6 == 1:
            t += "\n Shared line of every one \n" + passage + "\n" + " ".join(words(rng, 5))
        elif i % 6 == 2:
            t = f"Copy {i % 4} of a text.\nShared LINE of every one\nÉtude Ünder Σ {i % 4}"
        out.append((i, t, f"s{i % 4}" if i % 7 else None))
    out += [(60, None, "s0"), (61, "", "s1"), (62, " \n\t\n", "s1"), (63, "two words", "s2"), (64, "one", "s2"), (None, out[0][1], "s0"), (None, None, None), out[5], out[5], (65, " ".join(words(rng, 20000)), "s3")]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    texts = [r["text"] for r in corpus.where("doc_id in (1, 3, 4, 9)").collect()]
    items = [(1, texts[0][:200]), (2, " ".join(texts[1].split()[:4])), (3, None), (4, ""), (5, "nothing like this at all in any of the documents here"), (None, texts[2]), (1, texts[0][:200]), (6, " ".join(texts[3].upper().split()[2:14]))]
    return spark.createDataFrame(items, "item_id long, text string")


def clashing(df):
    return df.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("score"), F.lit("y").alias("kept"), F.lit(2).alias("_id"), F.lit(3).alias("n_lines"), F.lit(4).alias("size"), F.lit(5).alias("labels"))


def test_line_dedup(spark, duck, corpus):
    docs = corpus.where("doc_id is not null").distinct()
    out = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")).toPandas()
    assert rows(out) == rows(duck(line_dedup.OP9_SQL, documents=docs.toArrow()))
    assert (out.n_dropped > 0).sum() > 10
    every = line_dedup.drop_repeated_lines(clashing(corpus))
    assert every.count() == corpus.count() and every.columns.count("n_lines") == 1
    assert every.where("doc_id is null and n_dropped > 0").count() == 0
    assert line_dedup.drop_repeated_lines(corpus.limit(0)).count() == 0
    three = line_dedup.drop_repeated_lines(docs, min_docs=3).agg(F.sum("n_dropped")).first()[0]
    assert 0 < three <= out.n_dropped.sum()


def test_decontamination(spark, duck, corpus, benchmark):
    docs = corpus.where("doc_id is not null").distinct()
    out = decontamination.contamination(docs, benchmark)
    got = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated").toPandas()
    assert rows(got) == rows(duck(decontamination.OP7_SQL, documents=docs.toArrow(), benchmark=benchmark.toArrow()))
    assert set(got[got.contaminated].doc_id) == {1, 3, 9}
    every = decontamination.contamination(clashing(corpus), benchmark.withColumn("doc_id", F.lit(1)))
    assert every.count() == corpus.count() and every.columns.count("n_words") == 1
    assert decontamination.contamination(corpus, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(corpus.limit(0), benchmark).count() == 0


def brute_windows(words, size):
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def test_decontamination_of_repeated_words(spark):
    """A very long text of one word, and short alphabets: every alignment of an item is a candidate."""
    rng = random.Random(9)
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    texts = {1: "yes " * 100_000, 2: "no " * 700 + "yes", **{i: few(rng.randrange(1, 1500)) for i in range(3, 30)}}
    items = {1: "yes", 2: few(400), 3: few(12), 4: few(3), 5: "yes " * 200, 6: "a a a a", 7: texts[5][100:900]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    for i, t in texts.items():
        w, hit, found = t.split(), set(), set()
        for item, x in items.items():
            windows = brute_windows(x.split(), 10)
            n = min(10, len(x.split()))
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found)), i


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, slop):
    """Against all places of all windows."""
    rng = random.Random(slop)
    texts = {1: "alpha q w beta rest", 2: "alpha q q q q q q q beta", 3: "beta x alpha", 4: None, 5: "x", **{i: " ".join(words(rng, rng.randrange(1, 700), 12)) for i in range(6, 16)}}
    items = {1: "alpha x beta", 2: "", 3: "x", 4: " ".join(words(rng, 4, 12)), 5: " ".join(words(rng, 90, 12)), 6: texts[7]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (None, "q")], "item_id long, text string")
    got = {(r["doc_id"], r["item"], r["at"]) for r in decontamination.proximity_matches(docs, bench, slop).collect()}
    want = set()
    for i, t in texts.items():
        w = (t or "").split()
        places = {}
        for at, x in enumerate(w):
            places.setdefault(x, set()).add(at)
        for item, x in items.items():
            for window in brute_windows(x.split(), 10):
                for at in range(-slop, len(w) + slop):
                    if all(any(at + j + d in places.get(y, ()) for d in range(-slop, slop + 1)) for j, y in enumerate(window)):
                        want.add((i, str(item), at))
    assert got == want


def test_mixing(spark, duck, corpus):
    docs = corpus.distinct()
    out = mixing.mix(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken")).toPandas()
    want = duck(mixing.OP2_SQL, documents=docs.toArrow())
    assert rows(out, ["doc_id", "size", "source_size", "taken"]) == rows(want, ["doc_id", "size", "source_size", "taken"])
    by = docs.select("doc_id", "source").toPandas().merge(out, on="doc_id").dropna(subset="doc_id")
    for _, g in by[by.source != "s3"].groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max() + 1
    assert (out.taken <= 2 * out["size"]).all()
    again = mixing.mix(docs.repartition(3)).select("doc_id", "copies").toPandas()
    assert rows(again) == rows(mixing.mix(docs).select("doc_id", "copies").toPandas())
    assert mixing.mix(clashing(corpus)).count() == corpus.count()
    assert mixing.mix(corpus.limit(0)).count() == 0


def test_targets_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    budget = 1.5 * 1610
    assert got["a"] == 20 and abs(sum(got.values()) - budget) < 1e-9
    assert all(got[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), ("c", 500), (None, 100)))
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def test_near_dedup(spark, duck, corpus):
    docs = corpus.where("doc_id is not null").distinct()
    out = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").toPandas()
    assert rows(out) == rows(duck(near_dedup.OP3_SQL, documents=docs.toArrow()))
    assert (~out.kept).sum() > 10
    every = near_dedup.near_duplicates(clashing(corpus))
    assert every.count() == corpus.count() and every.where("doc_id is null and not kept").count() == 0
    assert near_dedup.near_duplicates(corpus.limit(0)).count() == 0


def test_near_dedup_large_buckets(spark, duck, monkeypatch):
    """Hubs and chunks: groups whose members are linked only through others."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rng = random.Random(5)
    base, out = words(rng, 100, 5000), []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(100)] = f"y{rng.randrange(9)}"
        out.append((i, " ".join(t)))
    docs = spark.createDataFrame(out, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").toPandas()
    assert rows(got) == rows(duck(near_dedup.OP3_SQL, documents=docs.toArrow()))


def test_long_words_that_a_weak_hash_confuses(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    a, b = hashing.WordHasher().words(f"{one} {two}".encode())
    assert a != b
    docs = spark.createDataFrame([(1, " ".join([one, two] * 3)), (2, " ".join([one] * 6))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_shingles"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 2, 2: 1}
    lm = lm_scoring.score_texts(docs, F.col("doc_id") == 2).toPandas().set_index("doc_id")
    assert lm.n_known[1] == 4 and lm.n_tokens[1] == 7 and lm.train_tokens[1] == 7


def test_word_hashes_past_the_limit():
    h = hashing.WordHasher()
    h.LIMIT = 10
    text = " ".join(f"w{i % 40}" for i in range(500)).encode()
    assert h.words(text).tolist() == hashing.WordHasher().words(text).tolist() and len(h) <= 10


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_hot_keys(spark, monkeypatch, share):
    """Keys over the share are broadcast, the others shuffled; the join is the same."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    left = spark.range(1000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    counted = left.where("k % 2 = 1").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("a").alias("top"))
    got = common.join_hot(left, counted, ["k"], 1000).select("a", "k", "top").toPandas()
    assert rows(got) == rows(left.join(counted.drop("_n"), "k").select("a", "k", "top").toPandas())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = {r["nid"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == got[98] == 98


def brute_lm(docs, train, order):
    """The same model by dictionaries over the whole corpus."""
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in docs]
    grams = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for t, yes in zip(tokens, train, strict=True):
            if yes:
                grams[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    total, vocabulary = sum(grams[1].values()), len(grams[1])
    c1 = sum(v == 1 for k in range(2, order + 1) for v in grams[k].values())
    c2 = sum(v == 2 for k in range(2, order + 1) for v in grams[k].values())
    d = min(0.95, max(0.1, c1 / (c1 + 2 * c2))) if c1 else 0.5
    follow = Counter(g[:-1] for k in range(2, order + 1) for g in grams[k])

    def p(g):
        low = (grams[1][g[-1:]] + 0.5) / (total + 0.5 * (vocabulary + 1)) if len(g) == 1 else p(g[1:])
        if len(g) == 1:
            return low
        before = grams[len(g) - 1][g[:-1]]
        return max(grams[len(g)][g] - d, 0) / before + d * follow[g[:-1]] / before * low if before else low

    return [(sum(math.log10(p((w,))) for w in t), sum(math.log10(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(len(t)))) for t in tokens]


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scoring(spark, corpus, order):
    docs = corpus.where("doc_id is not null").distinct().toPandas().sort_values("doc_id")
    train = [i % 5 != 1 for i in docs.doc_id]
    frame = spark.createDataFrame(docs)
    got = lm_scoring.score_texts(frame, F.col("doc_id") % 5 != 1, order=order, block_bytes=20_000).toPandas().sort_values("doc_id")
    for (base, score), b, s in zip(brute_lm(list(zip(docs.doc_id, docs.text, strict=True)), train, order), got.base_score, got.score, strict=True):
        assert abs(base - b) < 1e-6 and abs(score - s) < 1e-6
    assert got[~got.trained].score.sum() > got[~got.trained].base_score.sum()


@pytest.mark.parametrize("order", [2, 3])
def test_lm_merges_in_a_tree(spark, corpus, order):
    """Several levels of merges give what one does."""
    docs = corpus.where("doc_id is not null").distinct()
    flat, tree = (lm_scoring.score_texts(docs, F.col("doc_id") % 5 != 1, order=order, block_bytes=6_000, fan_in=n).toPandas() for n in (8192, 3))
    assert rows(flat.round(9)) == rows(tree.round(9))


def test_lm_counts(spark, corpus):
    docs = corpus.where("doc_id is not null").distinct().toPandas()
    got = lm_scoring.score_texts(spark.createDataFrame(docs), F.col("doc_id") % 5 != 1, block_bytes=20_000).toPandas().set_index("doc_id")
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    known = {w for i, t in tokens.items() if i % 5 != 1 for w in t}
    assert (got.train_tokens == sum(len(t) for i, t in tokens.items() if i % 5 != 1)).all()
    assert all(got.n_tokens[i] == len(t) and got.n_known[i] == sum(w in known for w in t) and got.trained[i] == (i % 5 != 1) for i, t in tokens.items())


def test_lm_edges(spark, corpus):
    every = lm_scoring.score_texts(clashing(corpus), F.col("doc_id") > 3)
    assert every.count() == corpus.count()
    assert lm_scoring.score_texts(corpus.limit(0), F.lit(True)).count() == 0
    none = lm_scoring.score_texts(corpus, F.lit(None).cast("boolean")).agg(F.max("n_known"), F.min("score"), F.max("train_tokens")).first()
    assert tuple(none) == (0, 0.0, 0)


def test_lm_probabilities_sum_to_one():
    """All continuations of a context, one unknown word among them, share probability 1."""
    texts = ["a b a c", "a b b", "c a b"]
    mass = 0.0
    for w in ["a", "b", "c", "zzz", None]:
        more = [(9, "a" if w is None else f"a {w}")]
        whole = brute_lm(list(enumerate(texts)) + more, [True] * 3 + [False], 2)[3][1]
        # log p(a) and, after a word, log p(end | word) are taken off.
        tail = 0.0 if w is None else brute_lm(list(enumerate(texts)) + [(9, w)], [True] * 3 + [False], 2)[3]
        start = brute_lm(list(enumerate(texts)) + [(9, "a")], [True] * 3 + [False], 1)[3][0] - brute_lm(list(enumerate(texts)) + [(9, "")], [True] * 3 + [False], 1)[3][0]
        mass += 10 ** (whole - start - (0.0 if w is None else tail[1] - (tail[0] - brute_lm(list(enumerate(texts)) + [(9, "")], [True] * 3 + [False], 1)[3][0])))
    assert abs(mass - 1) < 1e-9


LICENSES = ["Released UNDER the mit License under the MIT license.", "Apache License, Version 2.0; CC BY-NC 4.0", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception", "SPDX-License-Identifier: (MIT OR", None, "", "plain", "under the mit licenses", "cc by nc" * 3 + " cc by nc cc by nc"]


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSES)] + [(0, LICENSES[0])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in enumerate(LICENSES):
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        places = [(k, label) for phrase, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(k for k, _ in places), max(k for k, _ in places)) if places else (None, None))
    assert got[2]["labels"] == "apache-2,gpl-3,mit" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and license_scan.scan_licenses(docs.limit(0)).count() == 0
    assert license_scan.scan_licenses(clashing(docs)).count() == len(LICENSES) + 1


def test_expressions():
    assert license_scan.parse_expression("MIT OR GPL-2.0 AND ISC") == ["MIT", "GPL-2.0", "ISC", "and", "or"]
    assert license_scan.evaluate(license_scan.parse_expression("(MIT OR GPL-2.0) AND GPL-3.0"))[1] == 0.4
    for bad in ("", "AND MIT", "(MIT", "MIT)", "MIT OR"):
        with pytest.raises(ValueError):
            license_scan.parse_expression(bad)


PII = ["mail a.b+c@x-y.example.com. or d@@e@f.gh, @no.com u@host", "ip 1.2.3.4.5.6.7.8 300.1.1.1 0.0.0.0 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 79927398713", "call +1 (713) 555-8702 now +12 +44 20 7946 0958 9999 99999", None, "", "é" * 3 + " x@y.zz " + "1" * 5000 + "." * 50, "a" * 3000 + "@b.cc"]


def brute_pii(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    found = sorted((m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, t or "") if ok(m[0]))
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)


def test_pii_base(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PII)] + [(0, PII[0])], "doc_id long, text string")
    out = pii.find_pii(docs).select("doc_id", pii.listed(F.col("spans"), True).alias("base")).collect()
    assert len(out) == len(PII) + 1
    for r in out:
        assert r["base"] == brute_pii(PII[r["doc_id"]])
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_bootstraps_patterns(spark):
    """Numbers after a pattern that mostly holds phones are found, those elsewhere are not."""
    seeds = [(i, f"please call me +1 (713) 555-{1000 + i} thanks") for i in range(12)]
    new = [(100, "please call me 713-555-0000 thanks"), (101, "invoice number was 713-555-0000 paid")]
    docs = spark.createDataFrame(seeds + new, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert [(s["kind"], s["base"]) for s in got[100]] == [("phone", False)] and got[101] == []


def test_pii_bootstraps_numbers_with_separators(spark):
    seeds = [(i, f"please call me +1 (713) 555-{1000 + i} thanks") for i in range(12)] + [(20 + i, f"pay by card {c} now") for i, c in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"])]
    new = {100: ("please call me ", "(713) 555-7713", " thanks"), 101: ("please call me ", "713 555 0000", ", thanks"), 102: ("pay by card ", "4111 1111 1111 1112", " now"), 103: ("please call me ", "713-555-0000x", " thanks"), 104: ("please call me (", "7135550000", ") thanks")}
    docs = spark.createDataFrame(seeds + [(i, "".join(p)) for i, p in new.items()] + [(200, "invoice number was (713) 555-7713 paid")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    for i, (before, number, _) in new.items():
        assert [(s["begin"], s["end"], s["kind"], s["base"]) for s in got[i]] == [(len(before), len(before) + len(number), "card" if i == 102 else "phone", False)], i
    assert got[200] == []


def test_pii_recall_by_kind(spark):
    """Unseen forms of three kinds in slots of five forms that seeds share; clean numbers elsewhere stay."""
    rng = random.Random(8)
    filler = lambda: " ".join(words(rng, 6, 3000))
    luhn = lambda n: next(n + str(d) for d in range(10) if brute_pii(n + str(d)))
    slots = [("phone", "{} reach me at {} please {}"), ("phone", "{}\ntel. office: {}\n{}"), ("card", "{} visa number {} exp {}"), ("card", "{} charged {} today {}"), ("email", "{} write to {} about {}")]
    seed = {"phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "card": lambda: luhn(str(rng.randrange(10**14, 10**15))), "email": lambda: f"u{rng.randrange(10**6)}@mail.example.com"}
    unseen = {"phone": lambda: f"{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}", "card": lambda: str(rng.randrange(10**9, 10**10)), "email": lambda: f"u{rng.randrange(10**6)}@intranet"}
    seeds = [slot.format(filler(), seed[kind](), filler()) for kind, slot in slots for _ in range(60)]
    planted, clean = [], []
    while len(planted) < 100:
        kind, slot = slots[len(planted) % 5]
        number = unseen[kind]()
        text = slot.format(filler(), number, filler())
        if not brute_pii(text):
            planted.append((text, kind, text.index(number), text.index(number) + len(number)))
    for _ in range(100):
        clean.append(f"{filler()} order {rng.randrange(10**7, 10**8)} was {filler()}")
    texts = seeds + [p[0] for p in planted] + clean
    got = {r["doc_id"]: [(s["kind"], s["begin"], s["end"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for kind in ("phone", "card", "email"):
        of = [(i, p) for i, p in enumerate(planted, len(seeds)) if p[1] == kind]
        assert sum(got[i] == [p[1:]] for i, p in of) >= 0.9 * len(of), kind
    assert all(not got[i] for i in range(len(seeds) + len(planted), len(texts)))


def test_pii_pattern_scores(spark):
    """The rounds of scoring against plain loops over pairs."""
    rng = random.Random(6)
    seeds = [(rng.randrange(4), rng.randrange(12), rng.randrange(40)) for _ in range(150)]
    more = [(rng.randrange(16), rng.randrange(30, 90)) for _ in range(120)]
    pairs = {(p, i) for _, p, i in seeds} | set(more)
    known = {(i, k): 1.0 for k, _, i in seeds}
    trusted, scores = known, {}
    for _ in range(pii.ROUNDS):
        got = Counter()
        for p, i in pairs:
            for (j, k), t in trusted.items():
                if i == j:
                    got[p, k] += t
        scores = {(p, k): min(1.0, g / (sum(q == p for q, _ in pairs) + 1)) for (p, k), g in got.items() if g >= pii.MIN_SUPPORT}
        left = {}
        for p, i in pairs:
            for (q, k), s in scores.items():
                if p == q and s >= pii.MIN_SCORE and (i, k) not in known:
                    left[i, k] = left.get((i, k), 1.0) * max(1e-6, 1 - s)
        trusted = known | {key: 1 - v for key, v in left.items()}
    out = pii.pattern_scores(spark.createDataFrame(seeds, "k int, p long, i long"), spark.createDataFrame(more, "p long, i long"))
    found = {(r["p"], r["k"]): r["score"] for r in out.collect()}
    assert found.keys() == scores.keys() and all(abs(found[x] - scores[x]) < 1e-9 for x in scores)
    assert any(s >= pii.MIN_SCORE for s in scores.values())


def test_pii_edges(spark):
    long = "x " * 50_000 + "call +1 (713) 555-8702 now " + "7 " * 20_000 + "end"
    docs = spark.createDataFrame([(None, "mail a@b.cc"), (1, long), (1, long), (2, None), (3, "")], "doc_id long, text string").withColumn("p", F.lit(1)).withColumn("_n", F.lit(2))
    out = pii.find_pii(docs).collect()
    assert sorted(len(r["spans"]) for r in out) == [0, 0, 1, 1, 1] and all(r["p"] == 1 and r["_n"] == 2 for r in out)


@pytest.mark.parametrize("kind", ["clean", "toxic"])
def test_toxicity_learns_from_long_documents(spark, kind):
    """Labelled documents of one class are all far over 20,000 code points, those of the other short; null texts and ids without a text change nothing."""
    rng = random.Random(3)

    def text(i, toxic):
        n = 2500 if (kind == "toxic") == toxic else 3
        s = [" ".join(words(rng, 3, 3000)) + "." for _ in range(n)]
        if toxic:
            for k in rng.sample(range(n), 2):
                s[k] = "You scumlo vermin " + s[k]
        return " ".join(s)

    data = [(i, text(i, i % 2 == 0), int(i % 2 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 80] + [(900 + i, 1) for i in range(40)] + [(500, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 40).collect()
    assert len([r for r in rows if r["_y"] == 1]) == 40
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[i] == y for i, _, y in data if i >= 80) and got[500] == 0


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["scumlo", "scumra", "vermin"]

    def text(toxic):
        s = [" ".join(words(rng, 12, 3000)) + "." for _ in range(rng.randrange(1, 12))]
        if toxic:
            for _ in range(2):
                k = rng.randrange(len(s))
                s[k] = f"You {rng.choice(bad)} " + s[k]
        return " ".join(s)

    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]
    labelled = pd.DataFrame(data, columns=["doc_id", "text", "toxic"])
    train = labelled[labelled.doc_id < 900]
    frame = lambda f: spark.createDataFrame(f)
    model = toxicity.fit(frame(train[["doc_id", "text"]]), frame(train[["doc_id", "toxic"]]))
    test = labelled[labelled.doc_id >= 900]
    got = toxicity.score_toxicity(frame(test[["doc_id", "text"]]), model).toPandas().merge(test[["doc_id", "toxic"]], on="doc_id")
    assert (got.predicted == got.toxic).mean() > 0.97
    worst = got[(got.predicted == 1)].iloc[0]
    raw = worst.text.encode()
    assert any(b in raw[worst.offending[0]["begin"] : worst.offending[0]["end"]].decode() for b in bad)


def test_noisy_or_and_its_gradient():
    """Scores by plain products, and weights that no small step of the likelihood improves by much."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(30)}" + (" vermin." if i % 3 == 0 and k == 0 else ".") for k in range(rng.randrange(1, 5))) for i in range(90)]
    y = [int(i % 3 == 0) for i in range(90)]
    m = toxicity.learn(texts, y, rounds=400)
    f = toxicity.Features()

    def score(weights, bias, t):
        none = 1.0
        for b in toxicity.bag(t, f):
            none *= 1 - 1 / (1 + math.exp(-(sum(weights[i] for i in b) + bias)))
        return 1 - none

    assert all(abs(score(m.weights, m.bias, t) - m.score(toxicity.bag(t, f))) < 1e-6 for t in texts)
    loss = lambda w, b: -sum(math.log(max(1e-9, p if k else 1 - p)) for t, k in zip(texts, y, strict=True) for p in [score(w, b, t)]) + 0.5e-4 * len(y) * float((w**2).sum())
    here = loss(m.weights.astype(float), m.bias)
    for i in [*map(int, m.weights.nonzero()[0][:4]), -1]:
        for step in (-0.01, 0.01):
            w = m.weights.astype(float)
            w[i] += step if i >= 0 else 0
            assert loss(w, m.bias + (step if i < 0 else 0)) > here - 0.02


def test_all_offending_sentences(spark):
    """Every likely sentence is located, or the likeliest of many weak ones; a cut is optional."""
    weights = toxicity.np.zeros(1 << toxicity.BITS, "float32")
    for i in toxicity.Features()[b"vermin"]:
        weights[i] = 3.0
    model = toxicity.Model(weights, -8.0)
    docs = spark.createDataFrame([(1, "You vermin. " * 7 + "Fine day. " * 20), (2, "Fine day. " * 2000), (3, "Fine.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got[1]["offending"]) == 7 and len(got[2]["offending"]) == 1 and got[3]["offending"] == []
    assert len(toxicity.score_toxicity(docs, model, worst=2).where("doc_id = 1").first()["offending"]) == 2


def test_toxicity_edges(spark, corpus):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(corpus, labels)
    out = toxicity.score_toxicity(clashing(corpus), model)
    assert out.count() == corpus.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where("text is null and score > 0").count() == 0
    assert toxicity.fit(corpus, labels.limit(0)).score([{1}]) < 0.3
    assert toxicity.score_toxicity(corpus.limit(0), model).count() == 0


def test_hash_of_kept_lines_is_of_utf8(spark):
    docs = spark.createDataFrame([(1, "é\nü")], "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs).select(F.sha2("kept_text", 256)).first()[0]
    assert got == hashlib.sha256("é\nü".encode()).hexdigest()

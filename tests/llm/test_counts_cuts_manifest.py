"""Token counts, fill-in-the-middle cuts and Merkle manifests against brute force, with edge cases."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.llm import fill_in_middle, merkle, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
PARTS = ["'s", "'ve", "'", "''", " ", "  ", "\n", "\n\n", "\t", "a", "the", "The", " x", "é", "ß", "中", "文", "😀", "́", "1", "23", "!!", "<|endoftext|>", "<|end", "of", "text|>", "​", "\x1c", "\x85", "　", "\xa0", "aaaa", "    ", "ll", "re", "Ⅷ", "½", "՘", " ", "\U0010ffff", "-----", "can't"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(*token_counts.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, equal ids, shared passages, marks of the parts, extra columns with clashing names."""
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(300)}" for _ in range(900))
    out = []
    for i in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))) if i % 3 else f"{i} " * (i % 7) + passage + " \n" * (i % 5)
        out.append((i, f"s{i % 4}" if i % 5 else None, None if i % 8 == 1 else "en", None if i % 9 == 2 else len(text), text))
    out += [(150, "s1", "en", 0, None), (151, "s1", "en", 0, ""), (152, None, None, None, " \n\t"), (153, "s2", "de", 5, "a <M> b c d"), (154, "s9", "de", 5, "one"), (None, "s1", "en", 3, "no id here"), (None, None, None, None, None)]
    out += [out[3], out[3], (7, "s1", "fr", 1, "another text of a used id"), (155, "", "en", 9, "x" * 30000 + " tail of words " * 2000)]
    return spark.createDataFrame(out, SCHEMA)


def clashing(df):
    names = ("_row", "_text", "_count", "_cuts", "_form", "_h1", "_id", "_group", "_g", "_i", "_n", "_h", "_at", "n", "form", "leaf", "root", "path", "position", "n_tokens", "n_bytes", "output", "id", "group", "_levels")
    return df.select("*", *[F.lit("mine").alias(c) for c in names])


def test_every_prefix(library, counter):
    rng = random.Random(1)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14)))
        want = [n(text[:k]) for k in range(len(text) + 1)]
        assert counter.every_prefix(text).tolist() == want, text
        for limit in (0, 1, 2, 3, 5, 8):
            assert counter.measure(text, limit) == (want[-1], max(k for k, c in enumerate(want) if c <= limit)), (text, limit)


def test_settled_characters(library):
    """Where the pattern is used instead of the library, both split alike."""
    import regex

    settled, pieces = regex.compile(f"[{token_counts.SETTLED}]"), regex.compile(token_counts.PIECES)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        if settled.match(c):
            for text in (f"a{c}b", f"1{c}2", f"!{c}!", f"a{c}{c}b"):
                assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == pieces.findall(text), hex(ord(c))


def test_long_piece(library, counter):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij") for _ in range(20000)) + "\n" * 3000
    assert counter.measure(text, 9)[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, docs, library):
    got = token_counts.token_counts(clashing(docs), PATH).toPandas()
    texts = got.text.fillna("")
    assert got.n_tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts.tolist(), add_special_tokens=False)]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in texts] and (got["_row"] == "mine").all() and len(got) == docs.count()
    over = got[got.n_tokens > token_counts.LIMIT]
    assert len(over) > 20 and all(len(library.encode(t[:k], add_special_tokens=False).ids) <= token_counts.LIMIT < len(library.encode(t[: k + 1], add_special_tokens=False).ids) for t, k in zip(over.text, over.limit_chars, strict=True))
    assert (got[got.n_tokens <= token_counts.LIMIT].limit_chars == texts[got.n_tokens <= token_counts.LIMIT].str.len()).all()
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_questions_to_stored_prefixes(spark, docs, library):
    few = docs.where("doc_id < 40 or doc_id = 150")
    held = token_counts.prefix_tokens(clashing(few), PATH)
    chars, budget = F.lit(25), F.lit(12)
    got = held.select("text", token_counts.tokens_of(F.col("prefix_tokens"), chars).alias("n"), token_counts.chars_within(F.col("prefix_tokens"), budget).alias("chars")).collect()
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in got:
        if r["text"] is None:
            assert r["n"] is None and r["chars"] is None
        else:
            assert r["n"] == n(r["text"][:25]) and r["chars"] == max(k for k in range(min(len(r["text"]), 80) + 1) if n(r["text"][:k]) <= 12)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None or text == "" or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    h = [int(sha(f"42:{doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs):
    many = docs.unionByName(docs.where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 1000))
    out = fill_in_middle.fill_in_middle(clashing(many)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).toPandas()
    value = lambda v: None if pd.isna(v) else int(v)
    for r in out.itertuples(index=False):
        got = (r.n, r.form, value(r.prefix_chars), value(r.middle_chars), r.output)
        assert got == brute_fim(value(r.doc_id), r.text)
        assert r.back == (r.text or "")
    assert out.form.value_counts().to_dict().keys() == {"plain", "spm", "psm"} and (out["group"] == "mine").all() and len(out) == many.count()
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_cuts_of_any_number(monkeypatch):
    """Every cut of texts whose words and white space run over chunks and pieces; shared passages hit the cache."""
    monkeypatch.setattr(fill_in_middle, "PIECE", 700)
    monkeypatch.setattr(fill_in_middle, "LONGEST", 90)
    monkeypatch.setattr(fill_in_middle, "CUT_BITS", 4)
    rng, cache = random.Random(3), fill_in_middle.ChunkCache()
    passage = "".join(rng.choice("ab \n\té中") for _ in range(4000))
    for k in range(12):
        text = "x" * (37 * k) + passage[k * 11 :] + " " * (k * 60)
        assert "".join(fill_in_middle.chunks(text)) == text
        units, before = UNIT.findall(text), len(cache)
        t = fill_in_middle.Tokens(text, cache)
        assert t.n == len(units)
        ends = [0]
        for u in units:
            ends.append(ends[-1] + len(u))
        assert [t.end(j) for j in range(t.n + 1)] == ends
        assert k == 0 or len(cache) - before < 0.5 * before


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "CACHE_CHARS", 2000)
    cache = fill_in_middle.ChunkCache()
    for i in range(300):
        cache[f"chunk {i} " * 5]
        assert sum(map(len, cache)) <= 2100


def brute_tree(leaves, fan_out=3):
    """(root, path of each leaf as lists of siblings left and right)."""
    level, at, found = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for j, p in enumerate(at):
            run = p - p % fan_out
            found[j].append(("".join(level[run:p]), "".join(level[p + 1 : run + fan_out])))
            at[j] = p // fan_out
        level = [sha("".join(level[k : k + fan_out])) for k in range(0, len(level), fan_out)]
    return level[0], found


def brute_manifest(table, fan_out=3):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(said(r[0]) + said(r[1]) + said(r[2]) + said(r[3]) + said(r[4]))
    groups = {}
    for r in table:
        groups.setdefault(r[1], []).append((r[0], leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: brute_tree([x[1] for x in groups[g]], fan_out) for g in names}
    root, top = brute_tree([trees[g][0] for g in names], fan_out)
    out = []
    for g, up in zip(names, top, strict=True):
        for (doc_id, h, r), own in zip(groups[g], trees[g][1], strict=True):
            path = own + up
            changed = r[:4] + (r[4].replace("\n", ""),) if r[4] is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else r
            top_hash = leaf(changed)
            for left, right in path:
                top_hash = sha(left + top_hash + right)
            out.append((doc_id, h, trees[g][0], root, sha("".join(a + b for a, b in path)), top_hash, top_hash == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_query(spark, docs, tmp_path, duck):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).toPandas()
    want = brute_manifest([tuple(r) for r in docs.collect()])
    assert rows(got) == rows(pd.DataFrame(want, columns=COLUMNS))
    assert 0 < got.verified.mean() < 1
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert rows(duck(merkle.OP13_SQL, documents=once.toArrow())) == rows(pd.DataFrame(brute_manifest([tuple(r) for r in once.collect()]), columns=COLUMNS).astype({"doc_id": int}))


@pytest.mark.parametrize(("fan_out", "height", "n"), [(2, 2, 70), (3, 1, 82), (3, 2, 81), (5, 1, 26), (3, 5, 1)])
def test_rounds_of_blocks(spark, monkeypatch, fan_out, height, n):
    """Many rounds over several ranges, one group far larger than the others, lone leaves."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 9)
    table = [(i, "hot" if i % 4 else f"g{i % 12}" if i % 3 else None, "en", i, f"text {i}\n") for i in range(n)]
    docs = spark.createDataFrame(table, SCHEMA)
    out = merkle.manifest(clashing(docs), fan_out=fan_out, height=height)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("folds")).toPandas()
    want = pd.DataFrame(brute_manifest(table, fan_out), columns=COLUMNS)
    same = ["doc_id", "leaf", "subroot", "root", "proof_sha256"]
    assert out.folds.all() and rows(out[same]) == rows(want[same])


def test_positions_and_order(spark, docs):
    out = merkle.manifest(docs.repartition(7)).select("source", "position", "doc_id", "leaf").toPandas()
    for _, g in out.groupby("source", dropna=False):
        g = g.sort_values("position")
        assert g.position.tolist() == list(range(len(g)))
        keys = [(not pd.isna(i), -1 if pd.isna(i) else i, h) for i, h in zip(g.doc_id, g.leaf, strict=True)]
        assert keys == sorted(keys)


def test_empty_manifest(spark, docs):
    assert merkle.manifest(docs.limit(0)).count() == 0

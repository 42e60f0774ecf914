"""The corpus pipeline against its stages' brute-force twins on small tables."""

import random

import pandas as pd
import pytest

import corpus_pipeline
from incidentry.llm import toxicity


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, labels, items):
    """(kept after each stage) by plain loops; the toxicity model is learnt by the same learner on the same rows."""
    y = dict(labels)
    train = [(t, y[i]) for i, t in docs.items() if i in y]
    ratio = {k: sum(v == k for v in y.values()) / max(1, sum(v == k for _, v in train)) for k in (0, 1)}
    model = toxicity.learn([t for t, _ in train], [v for _, v in train], ratio[0] / ratio[1])
    f = toxicity.Features()
    kept = {i: t for i, t in docs.items() if model.score(toxicity.bag(t, f)) < 0.3}
    holders = {}
    for i in sorted(kept):
        for line in (kept[i] or "").split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), []).append(i)
    drop = lambda i, line: len(k := line.strip(" \t\n\x0b\x0c\r").lower()) >= 10 and len(set(holders[k])) > 1 and i != min(holders[k])
    kept = {i: "\n".join(x for x in (t or "").split("\n") if not drop(i, x)) for i, t in kept.items()}
    sets = {i: shingles(t) for i, t in kept.items()}
    comp = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    word = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    windows = {tuple(w[k : k + min(10, len(w))]) for t in items if (w := word(t)) for k in range(len(w) - min(10, len(w)) + 1)}
    hit = lambda t: any(tuple(w[k : k + n]) in windows for w in [word(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return {i for i, t in kept.items() if not hit(t)}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(4)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(12)) + "." for _ in range(n))
    docs = [[i, text(rng.randrange(1, 6)), "en", f"s{i % 3}"] for i in range(240)]
    passage = text(2)
    for i, d in enumerate(docs):
        if i % 4 == 0:
            d[1] += "\nyou awful vermin here. vermin again"
        if i % 9 == 1:
            d[1] += "\nthe very same line in many documents"
        if i % 11 == 2:
            d[1] = docs[2][1] + f" tail{i}" if i > 2 else text(6)
        if i % 17 == 3:
            d[1] += "\n" + passage
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"])
    frame["n_chars"] = frame.text.str.len()
    labels = pd.DataFrame({"doc_id": range(0, 240), "quality": 1, "toxic": [int(i % 4 == 0) for i in range(240)]})
    root = tmp_path_factory.mktemp("sf")
    frame.to_parquet(root / "documents.parquet")
    labels.to_parquet(root / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [passage]}).to_parquet(root / "benchmark.parquet")
    return str(root), frame, labels, [passage]


def test_pipeline(spark, tables):
    root, frame, labels, items = tables
    got = corpus_pipeline.run(spark, root).toPandas()
    want = brute(dict(zip(frame.doc_id, frame.text, strict=True)), list(zip(labels.doc_id, labels.toxic, strict=True)), items)
    before_mix = spark.read.parquet(root + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before_mix = stage(spark, before_mix, root)
        assert tuple(before_mix.columns) == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in before_mix.select("doc_id").collect()} == want
    assert set(got.doc_id) <= want and (got.copies <= 2).all()
    assert got["size"].mul(got.copies).sum() >= 0.9 * min(1.5, 2) * sum(len(t.split()) for t in [r["text"] for r in before_mix.collect()]) * 0.9


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]

"""MinHash near-dedup with sequential Bayesian verification.

Copies (equal word sequences) are collapsed first.  One representative of each goes through
banded MinHash; in every bucket it is paired with the bucket's hub only.  Pairs are pruned by
comparing their signatures in batches: after each batch the posterior of the similarity,
under a uniform prior, decides whether it can still reach the threshold at the chosen miss
probability.  Survivors are verified exactly on their full shingle sets, and verified links
give components.

Hubs alone would lose links, so a second round pairs all members of a bucket that are still
in different components, again pruned in batches.  A bucket that is one component needs no
more pairs: a group of thousands of near copies costs thousands of pairs, not millions.
Large buckets are dealt out in chunks, so no group is gathered in one task; signatures go
there first, and texts follow only where pairs survive.  Keys that many rows share are
joined by broadcast, so no bucket is one task's work.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import join_hot, stored, table
from .hashing import WordHasher, lowered, mix

ROWS_PER_BAND = 8
#: Probability that a pair at the threshold shares no band, and that the posterior prunes it wrongly.
MISS = 1e-6
#: Signature values compared before each posterior check.
BATCH = 43
#: Members of a component in one chunk; buckets of up to SMALL members are paired by a join.
CHUNK, SMALL = 512, 48


def bands_for(percent: int, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def least_matches(percent: int, hashes: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m matches is pruned.

    Values are one byte, so values of different shingles agree once in 256.  The posterior
    of the match probability under a uniform prior on [1/256, 1] is a truncated Beta; m is the least
    count for which P(similarity >= threshold | matches) is at least ``miss``.
    """
    grid = np.linspace(1 / 256, 1, 4001)[1:-1]
    reach = grid >= 1 / 256 + (percent / 100) * 255 / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        m = np.arange(n + 1)[:, None]
        log_l = m * np.log(grid) + (n - m) * np.log1p(-grid)
        w = np.exp(log_l - log_l.max(1, keepdims=True))
        tail = w[:, reach].sum(1) / w.sum(1)
        out.append((n, int(np.argmax(tail >= miss))))
    return out


class Hasher:
    """Shingle hashes, signatures and band keys of texts."""

    def __init__(self, shingle: int, bands: int, rows: int = ROWS_PER_BAND):
        self.shingle, self.bands, self.rows = shingle, bands, rows
        rng = np.random.default_rng(20240229)
        n = bands * rows
        self.a = rng.integers(1, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        self.of_band = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.of_place = rng.integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)
        self.words = WordHasher()

    def shingles(self, raw: bytes) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles of lower-cased text."""
        words = self.words.words(raw)
        if not len(words):
            return np.zeros(0, np.uint64)
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        total = np.full(n, np.uint64(k))
        for i in range(k):
            total += words[i : i + n] * self.of_place[i]
        return np.unique(mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), np.uint32(2**32 - 1))
        for i in range(0, len(low), 2048):
            np.minimum(best, (low[i : i + 2048, None] * self.a + self.b).min(0), out=best)
        return best

    def keys(self, signature: np.ndarray) -> np.ndarray:
        s = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return mix((s * self.of_band).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    @staticmethod
    def small(signature: np.ndarray) -> bytes:
        return ((signature * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def shingle_set(text: str | None, k: int) -> set:
    """The shingles of a text, as tuples of words: exact."""
    w = lowered(text).split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else set(zip(*[w[i:] for i in range(k)], strict=False))


def profiles(docs: DataFrame, hasher: Hasher) -> DataFrame:
    """(id, th, nid, n, fp, bands, sig) of (id, th, text); fp is the hash of the word sequence, null without words."""

    @pandas_udf("struct<n:long,fp:binary,bands:array<long>,sig:binary>")
    def profile(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            raw = lowered(t)
            s = hasher.shingles(raw)
            if not len(s):
                out.append((0, None, [], b""))
                continue
            signature = hasher.signature(s)
            out.append((len(s), hashlib.md5(b" ".join(raw.split())).digest(), hasher.keys(signature), hasher.small(signature)))
        return pd.DataFrame(out, columns=["n", "fp", "bands", "sig"])

    got = docs.select("id", "th", profile("text").alias("p")).select("id", "th", "p.*")
    return stored(got.withColumn("nid", F.monotonically_increasing_id()), "profiles")


def similar_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(edges: DataFrame) -> DataFrame:
    """(nid, comp) of the nodes of ``edges`` (a, b): the smallest node reachable.

    Each round hooks every component to the smallest label next to it and halves the
    paths, so rounds grow with the logarithm of the longest chain.  Only (node, label) rows
    and (component, label) rows move; labels are written each round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("nid")).distinct().select("nid", F.col("nid").alias("comp"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("near"))
        hooks = labels.join(near, "nid").groupBy("comp").agg(F.min("near").alias("to")).select("comp", F.least("comp", "to").alias("to"))
        hooks = stored(hooks, "hooks")
        for _ in range(2):
            jump = hooks.select(F.col("comp").alias("to"), F.col("to").alias("then"))
            hooks = hooks.join(jump, "to").select("comp", F.col("then").alias("to"))
        labels = stored(labels.join(hooks, "comp").select("nid", F.col("to").alias("comp"), (F.col("to") != F.col("comp")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("nid", "comp")


def pruned(pairs: DataFrame, reps: DataFrame, hasher: Hasher, percent: int) -> DataFrame:
    """(a, b, m): pairs of which the posterior leaves a chance, with their matching signature values."""
    limits = least_matches(percent, hasher.bands * hasher.rows)

    @pandas_udf("int")
    def matches(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), -1)
        if len(left):
            x = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), -1)
            y = np.frombuffer(b"".join(right), np.uint8).reshape(len(left), -1)
            alive, count, at = np.arange(len(left)), np.zeros(len(left), int), 0
            for n, least in limits:
                count[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1)
                alive, at = alive[count[alive] >= least], n
            out[alive] = count[alive]
        return pd.Series(out)

    side = lambda name: reps.select(F.col("nid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(similar_size("n_a", "n_b", percent))
    return both.select("a", "b", matches("s_a", "s_b").alias("m")).where("m >= 0")


def star_pairs(reps: DataFrame, members: DataFrame, hasher: Hasher, percent: int) -> DataFrame:
    """(a, b, m): members and the hubs of their buckets, where the posterior leaves a chance."""
    pairs = members.where(F.col("nid") != F.col("hub")).select(F.col("nid").alias("a"), F.col("hub").alias("b")).distinct()
    return pruned(pairs, reps, hasher, percent)


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose nodes are in different components, so far."""
    label = lambda name: labels.select(F.col("nid").alias(name), F.col("comp").alias(f"c_{name}"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def surviving(i: int, ok: np.ndarray, sig: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Of the rows ``ok``, those that the posterior leaves as partners of row ``i``, likeliest first."""
    c = np.flatnonzero(ok)
    count, at = np.zeros(len(c), int), 0
    for upto, least in limits:
        if not len(c):
            break
        count += (sig[c, at:upto] == sig[i, at:upto]).sum(1)
        c, count, at = c[count >= least], count[count >= least], upto
    return c[np.argsort(-count, kind="stable")]


class Chunks:
    """Two chunks of a component's neighbourhood that meet in a task."""

    COLUMNS = ("nid", "comp", "n", "mine", "other")

    def __init__(self, t: pa.Table, percent: int):
        self.nid, self.comp, self.n, self.mine, self.other = (np.asarray(t.column(c).to_pylist()) for c in self.COLUMNS)
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(self.nid), -1)
        # A chunk meets itself in the group (p, p) and others in (p, q); pairs inside a chunk come from its own group only.
        self.crossing, self.percent = bool((self.mine != self.mine[0]).any()), percent

    def partners(self, i: int) -> np.ndarray:
        """Rows of other components that a straggler may be linked with; two stragglers meet once, the smaller first."""
        n, k = self.n, self.n[i]
        ok = (self.comp != self.comp[i]) & (~self.other | (self.nid > self.nid[i])) & (np.minimum(n, k) * 100 >= np.maximum(n, k) * self.percent)
        return ok & (self.mine != self.mine[i]) if self.crossing else ok


def cross_pairs(reps: DataFrame, members: DataFrame, texts: DataFrame, labels: DataFrame, hasher: Hasher, percent: int) -> DataFrame:
    """(a, b): pairs of a bucket in different components that may be links.

    Small buckets are paired by a join and pruned by the posterior.  In large ones most
    members belong to the main component; the others, the stragglers, meet its members, and
    each other, once for all buckets of that component, in chunks of bounded size.  A member
    is copied once for each chunk of stragglers, a straggler once for each chunk.  First only
    signatures meet; the texts of those that keep a partner follow, and pairs are compared on
    their shingle hashes in the task.  One link of a straggler to a component is enough.
    """
    limits = least_matches(percent, hasher.bands * hasher.rows)
    rows = stored(members.join(labels, "nid", "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp")), "labelled")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("main"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("size")).where(F.col("main") != F.col("most"))
    mixed = stored(mixed.select("key", "_n", "main", "size"), "mixed")
    rows = stored(join_hot(rows, mixed, ["key"], rows.count()), "mixed-rows")
    few = rows.where(F.col("size") <= SMALL)
    left, right = few.select("key", F.col("nid").alias("a"), F.col("comp").alias("ca")), few.select("key", F.col("nid").alias("b"), F.col("comp").alias("cb"))
    small = pruned(left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct(), reps, hasher, percent).select("a", "b")
    roles = stored(rows.where(F.col("size") > SMALL).select("main", "nid", "comp", (F.col("comp") != F.col("main")).alias("other")).distinct(), "roles")
    chunks = lambda c: F.ceil(F.count_if(c) / CHUNK).cast("int")
    sizes = stored(roles.groupBy("main").agg(F.count(F.lit(1)).alias("_n"), chunks(~F.col("other")).alias("own"), chunks(F.col("other")).alias("far")), "chunks")
    # Chunks 0 .. own - 1 hold the main component, the next ones the stragglers; main chunks meet the stragglers' only.
    mine = F.when(F.col("other"), F.col("own") + F.pmod(F.xxhash64("nid"), F.col("far"))).otherwise(F.pmod(F.xxhash64("nid"), F.col("own"))).cast("int")
    partner = F.sequence(F.when(F.col("other"), F.lit(0)).otherwise(F.col("own")), F.col("own") + F.col("far") - 1)
    dealt = join_hot(roles, sizes, ["main"], roles.count()).select("main", "nid", "comp", "other", mine.alias("mine"), partner.alias("partner"))
    dealt = stored(dealt.join(reps.select("nid", "n", "sig"), "nid"), "dealt")
    group = lambda df: df.groupBy("main", "p", "q")
    meeting = dealt.select("*", F.explode("partner").alias("with")).select("main", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q"), *Chunks.COLUMNS, "sig")

    def keep(t: pa.Table) -> pa.Table:
        out = pa.schema([("main", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("nid", pa.int64())])
        if t.num_rows < 2 or not any(t.column("other").to_pylist()):
            return out.empty_table()
        c, wanted = Chunks(t, percent), np.zeros(t.num_rows, bool)
        for i in np.flatnonzero(c.other):
            found = surviving(i, c.partners(i), c.sig, limits)
            wanted[found] = True
            wanted[i] |= len(found) > 0
        return pa.table([t.column(name).filter(pa.array(wanted)) for name in ("main", "p", "q", "nid")], schema=out)

    needed = stored(group(meeting).applyInArrow(keep, "main long, p int, q int, nid long"), "needed")
    with_texts = needed.join(dealt.select("main", *Chunks.COLUMNS, "sig"), ["main", "nid"]).join(texts, "nid")

    def compare(t: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not t.num_rows:
            return out.empty_table()
        c, text, sets, found = Chunks(t, percent), t.column("text"), {}, []

        def hashes(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = hasher.shingles(lowered(text[i].as_py()))
            return sets[i]

        for i in np.flatnonzero(c.other):
            done = set()
            for k in surviving(i, c.partners(i), c.sig, limits):
                if c.comp[k] not in done:
                    both = len(np.intersect1d(hashes(i), hashes(k), assume_unique=True))
                    if 100 * both >= percent * (c.n[i] + c.n[k] - both):
                        done.add(c.comp[k])
                        found.append((c.nid[i], c.nid[k]))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=out)

    return group(with_texts).applyInArrow(compare, "a long, b long").union(small).distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough: 100 * intersection >= percent * union."""

    @pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        kept: dict = {}
        out = []
        for x, y in zip(left, right, strict=True):
            if kept.get("y") != y:
                kept = {"y": y, "set": shingle_set(y, shingle)}
            a, b = shingle_set(x, shingle), kept["set"]
            both = len(a & b)
            out.append(bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    side = lambda name: texts.select(F.col("nid").alias(name), F.col("text").alias(f"t_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(similar("t_a", "t_b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """Add ``n_shingles``, ``component_id`` and ``kept`` to every row.

    A document's set holds its distinct ``shingle``-word shingles (A-Z lower-cased words
    between white space); with fewer words the whole sequence is the only one.  Documents are
    linked if 100 * intersection >= percent * union; ``component_id`` is the smallest id
    reachable, ``kept`` marks rows that have it.

    Null and empty texts have no shingles and are linked with nothing.  A row whose id is
    null is linked with nothing, has a null component and is kept.  Rows that repeat an id
    share nothing but what their texts share; rows that repeat id and text get equal
    results.  An empty table gives an empty result.  Other columns pass through; added
    columns replace columns of their names.
    """
    hasher = Hasher(shingle, bands_for(percent))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    all_profiles = profiles(keyed, hasher)
    linkable = all_profiles.where(F.col("fp").isNotNull() & F.col("id").isNotNull())
    groups = stored(linkable.groupBy("fp").agg(F.min("nid").alias("nid"), F.min("id").alias("first_id")), "groups")
    reps = stored(linkable.join(groups.select("nid"), "nid", "left_semi").select("nid", "id", "th", "n", "bands", "sig"), "reps")
    keys = reps.select("nid", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("nid").alias("hub"), F.max("nid").alias("last"), F.count(F.lit(1)).alias("_n")).where(F.col("hub") != F.col("last"))
    hubs = stored(hubs.select("key", "_n", "hub"), "hubs")
    members = stored(join_hot(keys, hubs, ["key"], reps.count() * hasher.bands), "members")
    star = stored(star_pairs(reps, members, hasher, percent), "star")
    wanted = members.select("nid").distinct().join(reps.select("nid", "id", "th"), "nid")
    texts = stored(wanted.join(keyed, ["id", "th"]).select("nid", "text").dropDuplicates(["nid"]), "texts")
    # Each member's likeliest hub first; its other hubs only where that leaves them in different components.
    first = stored(star.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "first")
    links = stored(verified(first, texts, shingle, percent), "links")
    rest = apart(star.select("a", "b").join(first, ["a", "b"], "left_anti"), components(links))
    links = links.union(stored(verified(rest, texts, shingle, percent), "links"))
    more = stored(cross_pairs(reps, members.select("key", "nid"), texts, components(links), hasher, percent), "cross")
    links = links.union(stored(verified(more, texts, shingle, percent), "links"))
    labels = components(links)
    named = groups.join(labels, "nid", "left").select("fp", "nid", "first_id", F.coalesce("comp", "nid").alias("comp"))
    named = stored(named, "named")
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_text = named.join(smallest, "comp").select("fp", "component_id")
    # Rows without words are linked with nothing: they are kept out of the join, where they would be one key.
    of_row = all_profiles.select("id", "th", "n", "fp")
    result = of_row.where(F.col("fp").isNotNull()).join(of_text, "fp", "left").select("id", "th", "n", F.coalesce("component_id", "id").alias("component_id"))
    result = result.union(of_row.where(F.col("fp").isNull()).select("id", "th", "n", F.col("id").alias("component_id"))).dropDuplicates(["id", "th"])
    keep = [F.col(c) for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    every = docs.select(F.struct(*keep).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_r.id")) & (F.col("_th") == F.col("_r.th"))
    joined = every.join(result.select(F.struct("id", "th", "n", "component_id").alias("_r")), same, "left")
    own = F.col("_id").isNull() | (F.col("_id") == F.col("_r.component_id"))
    return joined.select("_row.*", F.col("_r.n").alias("n_shingles"), F.col("_r.component_id").alias("component_id"), own.alias("kept"))


def op3_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

"""Near copies by exact similarity of word shingles.

A text is the set of its 5-word shingles.  Two texts link when the Jaccard
similarity of their sets is 0.8 or more; groups are the connected ones.  The
first round takes what the vantage-point search over SimHash fingerprints of
these sets proposes (3 bits).  It meets few of the links and no radius meets them
all, so a prefix filter, which loses none, goes on from there: in any order of
all shingles, the first ``n - ceil(0.8 n) + 1`` of both sets have one in common.
Shingles that are frequent in a sample come last in the order, so a line that
many texts share makes few candidates.  The sample only chooses the order and
which shingles are dealt to several tasks.

Texts with equal sets are one row from the start.  Texts that share a shingle of
their prefixes meet in a run.  Star rounds compare each text with one leader of
its runs, which joins large groups in linear work; the last round compares the
pairs of a run that are not joined yet.  Runs are streamed in order of their
shingle, never gathered as arrays; those of the last round over ``TILE_ROWS``
texts are dealt as tiles that hold every pair once.  Sizes, places in the
prefixes and a parity sketch of the sets rule pairs out without loss; what is
left is compared on the whole sets.  A pair that meets in many runs is made where
it meets first: where one of the ``BEFORE`` shingles that come before in both
prefixes is shared, it is left to that run.

Defined cases: null text counts as text without words, and all texts without words
are one group; fewer words than a shingle give one shingle of all words; very long
texts are compared on all their shingles; rows without ``doc_id`` take part like
all others, repeated rows and ids too; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, discard, in_buckets, materialise, out_batch, shared_dir, text_batches
from .simhash import bits_of, components, link_stars

SHINGLE = 5
SEED = 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Texts in the sample that sets the order of shingles, and the texts of it that make a shingle frequent.
SAMPLE, FREQUENT = 5_000, 3
#: A shingle in so many texts of the sample is dealt to tasks in parts.
HOT, WAYS = 50, 64
STAR_ROUNDS = 1
SKETCH_BITS = 512
PAIR_BLOCK = 1 << 15
#: Shingles before a row's own in the prefix by which a run knows the pairs that have met before.
BEFORE = 8
#: Texts of a run that are compared in one task; a tile of a larger run holds two blocks of about half as many.
TILE_ROWS = 8_192
#: Shingles of a group of candidates that are compared in one task; a tile of a larger one holds two blocks of about so many.
TILE_SHINGLES = 2_000_000


def text_hash(text="text"):
    """The key of equal texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    w = np.array([seen[x] if x in seen else seen.setdefault(x, digest(x, SEED)) for x in words], np.uint64)
    k = min(shingle, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(h ^ (h >> np.uint64(33)))


def prefix(s: np.ndarray, hot: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set has at least one in its own prefix."""
    n = len(s)
    if not n:
        return s
    rank = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[at] == s, seen[at], 0)
    return s[np.lexsort((s, rank))][: n - (NUM * n + DEN - 1) // DEN + 1]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set's members in each of some classes: differs in no more bits than the sets in members.

    There are ``SKETCH_BITS`` classes, or the next power of two from the set's size on.
    """
    classes = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else SKETCH_BITS
    odd = np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer classes: its halves laid over each other."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def similar(both, n_a, n_b):
    """Do sets of these sizes with so many members in common link?"""
    return both * (NUM + DEN) >= NUM * (n_a + n_b)


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of the texts, sorted, and their counts; copies count once a task."""
    every = max(1, docs.count() // SAMPLE)
    schema = pa.schema([("s", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for b, texts in text_batches(batches):
            for h, t in zip(b.column(0).to_pylist(), texts):
                if h not in seen:
                    seen.add(h)
                    yield out_batch(schema, s=shingles(t, shingle).view(np.int64))

    some = docs.select(text_hash().alias("h"), "text").where(F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(every)) == 0)
    t = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    s, n = t.column("s").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def keyed(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text) and ``sig`` (hash of its set) of every row.

    The first row of a set in a task has ``n``, ``prefix``, ``wide`` and ``bits``
    (its sketch, and that with ``SKETCH_BITS`` classes) and ``fp`` (its fingerprint) too; later ones have null there, so copies cost nothing more.
    """
    import xxhash

    sent = docs.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("wide", pa.binary()), ("fp", pa.int64())])

    def run(batches):
        texts_seen: dict[int, int] = {}
        sets_seen: set[int] = set()
        for b, texts in text_batches(batches):
            out = {"sig": [], "n": [], "prefix": [], "bits": [], "wide": [], "fp": []}
            for h, t in zip(b.column(1).to_pylist(), texts):
                row = (texts_seen.get(h), None, None, None, None, None)
                if row[0] is None:
                    s = shingles(t, shingle)
                    sig = texts_seen[h] = xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)
                    row = (sig, None, None, None, None, None)
                    if sig not in sets_seen:
                        sets_seen.add(sig)
                        wide = sketch(s)
                        row = (sig, len(s), prefix(s, *sent.value).view(np.int64), folded(wide, SKETCH_BITS // 64).tobytes(), wide.tobytes(), bits_of(s) - (1 << 63))
                for c, x in zip(out.values(), row):
                    c.append(x)
            yield out_batch(schema, doc_id=b.column(0).cast(pa.int64()), h=b.column(1), **out)

    return docs.select("doc_id", text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, sig long, n int, prefix array<long>, bits binary, wide binary, fp long")


def shared(keys: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``token``, ``sig``, ``n``, ``at``: the prefixes' shingles that more than one set has.

    Hot shingles of the sample, at most a fixed share of its own, are dealt in
    parts; of these all rows are kept.
    """
    spark = keys.sparkSession
    hot = order[0][order[1] >= HOT].view(np.int64)
    posts = keys.where("prefix is not null").select("sig", "n", F.posexplode("prefix").alias("at", "token"))
    hot = spark.createDataFrame(pa.table({"token": hot, "hot": np.ones(len(hot), bool)}), "token long, hot boolean")
    part = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("sig"), F.lit(WAYS))).otherwise(0).cast("int")
    dealt = posts.join(F.broadcast(hot), "token", "left").select("token", "sig", "n", "at", part.alias("part")).repartition("token", "part").sortWithinPartitions("token", "n", "sig")
    schema = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def run(batches):
        kept, before = None, None  # the last row so far and the shingle before it
        for b in batches:
            b = b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            t, sig, part = (b.column(i).to_numpy() for i in (0, 1, 4))
            new = np.r_[True, (t[1:] != t[:-1]) | (sig[1:] != sig[:-1])]
            b, t, part = b.filter(pa.array(new)), t[new], part[new]
            as_last = np.r_[before is not None and t[0] == before, t[1:] == t[:-1]]
            as_next = np.r_[t[1:] == t[:-1], False]
            ok = as_last | as_next | (part > 0)
            end = len(t) - 1
            kept, before = b.slice(end), (t[end - 1] if end else before)
            rows = b.filter(pa.array(ok)).slice(0, int(ok[:end].sum())) if end else None
            if rows is not None and rows.num_rows:
                yield pa.RecordBatch.from_arrays(rows.columns[:4], schema=schema)
        if kept is not None and (kept.column(4)[0].as_py() > 0 or kept.column(0)[0].as_py() == before):
            yield pa.RecordBatch.from_arrays(kept.columns[:4], schema=schema)

    return dealt.mapInArrow(run, "token long, sig long, n int, at int")


def mixed(runs: DataFrame, root: DataFrame | None) -> DataFrame:
    """The runs that have members of more than one group, each row with its ``root``."""
    led = runs.withColumn("root", F.col("sig")) if root is None else runs.join(root.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    some = led.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return led.join(some, "token", "left_semi")


def least_common(n_a, n_b):
    """The members that linked sets of these sizes have in common at least."""
    return F.floor((NUM * (n_a + n_b) + NUM + DEN - 1) / (NUM + DEN))


def led(runs: DataFrame, star: int) -> DataFrame:
    """``a``, ``b``: each member of the runs with the leader of a run, where they may link and aren't joined."""
    rank = F.xxhash64("sig", F.lit(star))
    lead = runs.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "sig", "n", "at", "root")).alias("lead"))
    j = runs.join(lead, "token").where("root <> lead.root")
    rest = F.least(F.col("n") - F.col("at"), F.col("lead.n") - F.col("lead.at"))
    least = least_common(F.col("n"), F.col("lead.n"))
    return j.where((rest >= least) & (F.least("n", F.col("lead.n")) >= least)).select(F.col("sig").alias("a"), F.col("lead.sig").alias("b")).distinct()


def vantage_stars(one: DataFrame) -> DataFrame:
    """``a``, ``b``: each set with the set that leads its group of near fingerprints."""
    by_fp = one.groupBy("fp").agg(F.min("sig").alias("b")).checkpoint()
    stars = link_stars(by_fp.select("fp"), by_fp.count())
    # a fingerprint may be a star of both trees; any one of its leaders will do
    lead = stars.groupBy("a").agg(F.min("b").alias("lead_fp"))
    to = one.select("sig", "fp").join(lead.withColumnRenamed("a", "fp"), "fp", "left").select("sig", F.coalesce("lead_fp", "fp").alias("fp"))
    return to.join(by_fp, "fp").where("sig <> b").select(F.col("sig").alias("a"), "b")


def met_before(p: np.ndarray, q: np.ndarray, before: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Do both rows of a pair have one of the shingles just before in common? Then an earlier run holds the pair and passes it by the same rules."""
    same = before[p][:, :, None] == before[q][:, None, :]
    return (same & known[p][:, :, None] & known[q][:, None, :]).any((1, 2))


def cross(sig, n, at, root, block, bits, before, known):
    """Pairs of a tile that may link, aren't joined and haven't met before, a few at a time.

    The texts of the tile's largest group are compared with the others only, and
    texts of one block meet in the tile of that block alone.
    """
    groups, inverse, size = np.unique(root, return_inverse=True, return_counts=True)
    main = inverse == size.argmax()
    order = np.argsort(main, kind="stable")  # the others first
    sig, n, at, root, block, bits, before, known = (x[order] for x in (sig, n, at, root, block, bits, before, known))
    odd, m, apart = int((~main).sum()), len(sig), bool((block != block[0]).any())
    step = max(1, PAIR_BLOCK // m)
    for i in range(0, odd, step):
        x, y = np.arange(i, min(odd, i + step))[:, None], np.arange(i + 1, m)[None, :]
        least = (NUM * (n[x] + n[y]) + NUM + DEN - 1) // (NUM + DEN)
        ok = (y > x) & (root[x] != root[y]) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= least) & (np.minimum(n[x], n[y]) >= least)
        if apart:
            ok &= block[x] != block[y]
        p, q = np.nonzero(ok)
        least, p, q = least[p, q], p + i, q + i + 1
        ok = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= n[p] + n[q] - 2 * least
        if not ok.any():
            continue
        p, q = p[ok], q[ok]
        ok = ~met_before(p, q, before, known)
        if ok.any():
            yield sig[p[ok]], sig[q[ok]]


def crossed(runs: DataFrame, one: DataFrame) -> DataFrame:
    """``a``, ``b``, ``root``: distinct pairs of the runs that may link and aren't joined yet, and a shingle that they meet in."""
    ways = runs.groupBy("token").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias("ways"))
    own = F.pmod(F.xxhash64("sig"), F.col("ways")).cast("int")
    tiles = F.when(F.col("ways") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("ways") - 1), lambda o: F.least(own, o).cast("long") * F.col("ways") + F.greatest(own, o)))
    # a small table of sketches and prefixes by set meets the rows before they are dealt to tiles
    before = F.slice("prefix", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    rows = runs.join(ways, "token").join(one.select("sig", "bits", "prefix"), "sig").select("token", F.explode(tiles).alias("tile"), "sig", "n", "at", "root", own.alias("block"), "bits", before.alias("before"))
    dealt = rows.repartition("token", "tile").sortWithinPartitions("token", "tile")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("root", pa.int64())])

    def run(batches):
        kept = None
        for b in batches:
            b = b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            yield from closed(b.slice(0, cut := last_start(b)))
            kept = b.slice(cut)
        if kept is not None:
            yield from closed(kept)

    def last_start(b) -> int:
        t, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        other = np.flatnonzero((t != t[-1]) | (k != k[-1]))
        return int(other[-1]) + 1 if len(other) else 0

    def closed(b):
        if not b.num_rows:
            return
        t, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]), True])
        sig, n, at, root, block = (b.column(i).to_numpy().astype(np.int64) for i in range(2, 7))
        bits = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(b.num_rows, -1)
        known = np.arange(BEFORE)[None, :] < b.column(8).value_lengths().to_numpy()[:, None]
        before = np.zeros((b.num_rows, BEFORE), np.int64)
        before[known] = b.column(8).flatten().to_numpy()
        for i, j in zip(cuts, cuts[1:]):
            if j - i > 1:
                for x, y in cross(*(v[i:j] for v in (sig, n, at, root, block, bits, before, known))):
                    yield out_batch(schema, a=np.minimum(x, y), b=np.maximum(x, y), root=np.full(len(x), t[i]))

    return dealt.mapInArrow(run, "a long, b long, root long").groupBy("a", "b").agg(F.min("root").alias("root"))


def sketched(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs that their sizes and sketches don't rule out; ``root`` is kept."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for t in (w.slice(i, SLICE) for w in batches for i in range(0, w.num_rows, SLICE)):
            n, m = (t.column(i).to_numpy().astype(np.int64) for i in (5, 6))
            least = (NUM * (n + m) + NUM + DEN - 1) // (NUM + DEN)
            apart = np.zeros(t.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(t.column(3).to_pylist(), t.column(4).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                apart[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)
            ok = pa.array((apart <= n + m - 2 * least) & (np.minimum(n, m) >= least))
            yield out_batch(schema, **{c: t.column(i).filter(ok) for i, c in enumerate(schema.names)})

    x, y = (one.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "root", "wide_a", "wide_b", "n_a", "n_b").mapInArrow(run, "a long, b long, root long")


def linked(docs: DataFrame, one: DataFrame, pairs: DataFrame, written: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Pairs whose whole sets are similar enough, so many that they join all sets that the given pairs do.

    Pairs (a, b) of one ``root`` are compared in one task, so a text travels once
    for each root it has a candidate in: a star's centre, or a shared shingle.
    Larger groups than ``TILE_SHINGLES`` are cut into blocks and compared tile by
    tile, of which a text goes to those that hold a candidate of it.
    """
    spark = docs.sparkSession
    ends = pairs.select("root", F.explode(F.array("a", "b")).alias("sig")).distinct()
    member = ends.join(one.select("sig", "h", "n"), "sig")
    ways = member.groupBy("root").agg(F.ceil((F.sum("n") + 1) / F.lit(TILE_SHINGLES)).alias("ways"))
    member = materialise(spark, member.join(ways, "root").select("sig", "h", "root", F.pmod(F.xxhash64("sig"), F.col("ways")).alias("block")), "near-members", written)
    x, y = (member.select(F.col("sig").alias(k), "root", F.col("block").alias(f"block_{k}")) for k in "ab")
    tile = ["root", "lo", "hi"]
    tiled = pairs.join(x, ["a", "root"]).join(y, ["b", "root"]).select("root", F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi"), "a", "b")
    tiled = materialise(spark, tiled, "near-tiles", written)
    to = ["to_root", "to_lo", "to_hi"]
    need = tiled.select(*(F.col(c).alias(t) for c, t in zip(tile, to)), F.explode(F.array("a", "b")).alias("sig")).distinct().join(member.select("sig", "h").distinct(), "sig")
    # texts in question are found where they are read, so the others aren't shuffled; copies combine before the shuffle
    texts = in_buckets(docs.select(text_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text")), member, "h").groupBy("h").agg(F.first("text").alias("text"))
    texts = texts.join(need, "h").select(*to, "sig", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(here: pa.Table, asked: pa.Table) -> pa.Table:
        sets = {sig: shingles(t, shingle) for sig, t in zip(here.column("sig").to_pylist(), here.column("text").to_pylist())}
        lead = {sig: sig for sig in sets}

        def top_of(x: int) -> int:
            while lead[x] != x:
                lead[x] = x = lead[lead[x]]
            return x

        out = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
            p, q = top_of(a), top_of(b)
            if p == q:  # joined through others already
                continue
            small, large = sorted((sets[a], sets[b]), key=len)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum()) if len(large) else 0
            if similar(both, len(small), len(large)):
                lead[max(p, q)] = min(p, q)
                out.append((a, b))
        return pa.table({"a": [x[0] for x in out], "b": [x[1] for x in out]}, schema=schema)

    return texts.groupBy(*to).cogroup(tiled.groupBy(*tile)).applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text) and ``component`` of every row of ``docs``."""
    spark, written = docs.sparkSession, []
    shared_dir(spark)

    def kept(df: DataFrame, what: str) -> DataFrame:
        return materialise(spark, df, f"near-{what}", written)

    order = frequent(docs, shingle)
    keys = kept(keyed(docs, order, shingle), "keys")
    one = kept(keys.where("n is not null").groupBy("sig").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")), "sigs")
    runs = kept(shared(keys, order), "runs")
    edges = root = None
    for star in [*range(STAR_ROUNDS), None]:
        now = kept(mixed(runs, root), "mixed")
        if star is None:
            pairs = sketched(crossed(now, one), one)
        else:
            pairs = led(now, star)
            pairs = (pairs if star else pairs.unionByName(vantage_stars(one)).distinct()).withColumn("root", F.col("b"))
            pairs = sketched(pairs, one).groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(star))).alias("b")).withColumn("root", F.col("b"))
        found = kept(linked(docs, one, kept(pairs, "pairs"), written, shingle), "links")
        edges = found if edges is None else edges.unionByName(found)
        root = components(edges)
    joined = keys.select("doc_id", "h", "sig").join(root.withColumnRenamed("node", "sig"), "sig", "left")
    found = materialise(spark, joined.select("doc_id", "h", F.coalesce("root", "sig").alias("component")), "near-found")
    discard(spark, written)
    return found

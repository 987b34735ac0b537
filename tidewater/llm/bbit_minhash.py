"""Near-duplicate detection by b-bit MinHash with exact confirmation.

1. Every document becomes the set of its distinct word shingles (64-bit
   hashes).  ``bands * rows`` minima are taken; whole minima give the band keys,
   the low ``bits`` bits of each are packed into the signature.
2. Documents with the same word sequence form a class; only its smallest id
   goes on.  All counting is pre-aggregated, so a class of any size is harmless.
3. Classes that share a band key meet in a bucket.  Each is paired with the
   bucket's smallest id (a star, never all pairs), the signatures' bit counts
   give the collision-corrected similarity, and pairs that may reach the
   threshold are confirmed on their full sets.
4. What a star cannot see are links between members that ended in different
   components.  Buckets that still hold several components are compared block
   by block on their signatures, each pair in the first bucket that it shares;
   the members of promising pairs are confirmed on full sets with a local
   union-find, and only confirmed links that join two components are emitted.
   Blocks are bounded by their members and by the shingles these have together.
5. Components come from large-star/small-star rounds on the link table.

Joins on buckets, leaders and nodes that many rows share are salted by the id
of the other side.  Signatures, texts and components reach the rows of an id
through one row for the id (:func:`attach`), so these joins make no more rows
than there are documents, in however many buckets, stars and blocks these are.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with
probability below 1e-7, and the estimate that leads to confirmation lies six
standard deviations of the signature below the threshold.

Cuts of the lineage are tables in the shared folder.  Defined results: null and
empty texts and texts of white space have empty sets and are linked with
nothing; a text with fewer words than a shingle has one shingle, the whole
sequence; a null doc_id is never a representative (a row whose class has no
other id keeps a null component); repeated rows share a component; rows with
one doc_id and different texts are one node of the link graph.  Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import discard, materialise, release_memory

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Sets of hashed word shingles, minima, signatures and band keys."""

    def __init__(self, width: int = 4, bands: int = 32, rows: int = 4, bits: int = 2, seed: int = 1, cache_limit: int = 200_000):
        self.width, self.bands, self.rows, self.bits, self.cache_limit = width, bands, rows, bits, cache_limit
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.flip = rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32) | np.uint32(1)
        self.mix = (rng.integers(0, 1 << 63, (bands, rows)).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.cache: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "replace").lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > self.cache_limit:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        s = h[:n] * _M1 + np.uint64(width)
        for j in range(1, width):
            s = (s ^ (s >> np.uint64(31))) * _M2 + h[j : n + j]
        s = (s ^ (s >> np.uint64(29))) * _M3
        return np.unique(s ^ (s >> np.uint64(32)))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(20)).astype(np.uint32)
        step = max(1024, 1 << 14)
        best = None
        for a in range(0, len(x), step):
            part = ((x[None, a : a + step] ^ self.flip) * self.odd).min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.astype(np.uint64).reshape(self.bands, self.rows)
        s = ((m + _M1) * self.mix).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * _M2
        s = (s ^ (s >> np.uint64(31))) * _M3
        return (s ^ (s >> np.uint64(29))).view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, packed into 64-bit words, one bit plane after the other."""
        planes = [np.packbits((minima >> np.uint32(b)).astype(np.uint8) & 1, bitorder="little").view(np.int64) for b in range(self.bits)]
        return np.concatenate(planes)

    def estimate(self, equal: np.ndarray) -> np.ndarray:
        """Similarity from the number of equal positions, corrected for chance."""
        chance = 2.0**-self.bits
        return (equal / (self.bands * self.rows) - chance) / (1 - chance)

    def deviation(self, similarity: float) -> float:
        """Standard deviation of the estimate."""
        chance = 2.0**-self.bits
        equal = similarity + (1 - similarity) * chance
        return float(np.sqrt(equal * (1 - equal) / (self.bands * self.rows)) / (1 - chance))


def _digest(table: Iterable[pa.RecordBatch], maker: Shingler) -> Iterator[pa.RecordBatch]:
    for batch in table:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            sizes, keys, sigs, bands, offsets = [], [], [], [], [0]
            for text in part.column(1).to_pylist():
                words = maker.words(text)
                s = maker.shingles(words)
                sizes.append(len(s))
                if len(s):
                    m = maker.minima(s)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sigs.append(maker.signature(m))
                    bands.append(maker.band_keys(m))
                else:
                    keys.append(None)
                offsets.append(len(bands))
            at = np.array(offsets, np.int64)

            def lists(rows, width):
                flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(at * width, pa.int32()), pa.array(flat, pa.int64()))

            words_per = maker.bits * maker.bands * maker.rows // 64
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(sigs, words_per), lists(bands, maker.bands)],
                ["doc_id", "n_shingles", "key", "sig", "bands"],
            )
        release_memory()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted partitions as tuples, batch by batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            yield from zip(*[c.to_pylist() for c in batch.slice(a, 64).columns])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _confirm_stars(batches, maker: Shingler, percent: int):
    """Rows (leader, salt, id, text) sorted so that the leader's own row comes
    first in its group; holds one set at a time besides the leader's."""
    group, own, found = None, None, []
    for leader, salt, node, text in _groups(batches):
        s = maker.shingles(maker.words(text))
        if (leader, salt) != group:
            group, own = (leader, salt), s if node == leader else None
            continue
        if own is not None and _similar(own, s, percent):
            found.append((leader, node))
        if len(found) >= 4096:
            yield _links(found)
            found = []
    yield _links(found)


class Bits:
    """Sets as rows of one bit matrix over the shingles that several of them
    have; None where that would be large."""

    def __init__(self, sets: list[np.ndarray], most: int = 1 << 26):
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        values, count = np.unique(every, return_counts=True)
        values = values[count > 1]
        width = (len(values) + 63) // 64
        self.rows = None
        if width and 8 * width * len(sets) <= most:
            self.rows = np.zeros((len(sets), 8 * width), np.uint8)
            for k, s in enumerate(sets):
                at = np.searchsorted(values, s)
                at = at[values[np.minimum(at, len(values) - 1)] == s]
                np.bitwise_or.at(self.rows[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
            self.rows = self.rows.view(np.uint64)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.rows[others] & self.rows[one]).sum(axis=1, dtype=np.int64)


def _confirm_blocks(batches, maker: Shingler, percent: int, least: float):
    """Rows (bucket, i, j, side, id, comp, sig, bands, text) sorted by (bucket,
    i, j): confirms promising pairs of different components until they are joined."""

    def close(bucket, rows):
        if len(rows) < 2:
            return
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        side, ids, comps = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sig, bands = np.array([r[3] for r in rows], np.int64).view(np.uint64), np.array([r[4] for r in rows], np.int64)
        sets = [r[5] for r in rows]
        size = np.array([len(s) for s in sets])
        bits = Bits(sets)
        left = np.flatnonzero(side == 0)
        for i in left.tolist():
            others = np.flatnonzero((side == 1) if side.any() else (np.arange(len(rows)) > i))
            others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
            others = others[_likely(sig[i : i + 1], bands[i : i + 1], sig[others], bands[others], bucket, maker, least)[0]]
            mine = find(int(comps[i]))
            others = others[[find(c) != mine for c in comps[others].tolist()]]
            if not len(others):
                continue
            if bits.rows is not None:
                common = bits.common(i, others)
                others = others[100 * common >= percent * (size[others] + size[i] - common)]
            for j in others.tolist():
                x, y = find(int(comps[i])), find(int(comps[j]))
                if x != y and (bits.rows is not None or _similar(sets[i], sets[j], percent)):
                    root[max(x, y)] = min(x, y)
                    found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))

    current, rows, found = None, [], []
    for bucket, i, j, side, node, comp, sig, bands, text in _groups(batches):
        if (bucket, i, j) != current:
            if current is not None:
                close(current[0], rows)
            current, rows = (bucket, i, j), []
            if found:
                yield _links(found)
                found = []
        rows.append((side, node, comp, sig, bands, maker.shingles(maker.words(text))))
    if current is not None:
        close(current[0], rows)
    yield _links(found)


def _likely(sig_a, bands_a, sig_b, bands_b, bucket: int, maker: Shingler, least: float) -> np.ndarray:
    """Pairs whose estimate is high enough and that share no band before *bucket*'s."""
    likely = maker.estimate(_equal(sig_a, sig_b, maker)) >= least
    x, y = np.nonzero(likely)
    for a in range(0, len(x), 1 << 16):
        p, q = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
        first = (bands_a[p] == bands_b[q]).argmax(axis=1)
        likely[p, q] = bands_a[p, first] == bucket
    return likely


def _equal(a: np.ndarray, b: np.ndarray, maker: Shingler) -> np.ndarray:
    """Equal positions of all signatures in *a* against all in *b*."""
    per_plane = maker.bands * maker.rows // 64
    equal = np.zeros((len(a), len(b)), np.int64)
    for w in range(per_plane):
        differ = a[:, None, w] ^ b[None, :, w]
        for plane in range(1, maker.bits):
            differ |= a[:, None, w + plane * per_plane] ^ b[None, :, w + plane * per_plane]
        equal += 64 - np.bitwise_count(differ)
    return equal


def _promising(batches, maker: Shingler, least: float):
    """Rows (bucket, i, j, side, id, comp, sig, bands) sorted by (bucket, i, j):
    for each block pair the ids with a likely partner in another component."""

    def close(key, rows):
        if len(rows) < 2:
            return
        side, ids, comp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sig, bands = np.array([r[3] for r in rows], np.int64).view(np.uint64), np.array([r[4] for r in rows], np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        likely = _likely(sig[left], bands[left], sig[right], bands[right], key[0], maker, least) & (comp[left][:, None] != comp[right][None, :])
        a, b = left[likely.any(axis=1)], right[likely.any(axis=0)]
        members = np.unique(np.concatenate((a, b)))
        if len(members):
            same = [pa.array(np.full(len(members), x), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(side[members], pa.int32()), pa.array(ids[members])], ["bucket", "i", "j", "side", "id"])

    current, rows = None, []
    for bucket, i, j, side, node, comp, sig, bands in _groups(batches):
        if (bucket, i, j) != current:
            if current is not None:
                yield from close(current, rows)
            current, rows = (bucket, i, j), []
        rows.append((side, node, comp, sig, bands))
    if current is not None:
        yield from close(current, rows)


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Join many *rows* of a key with its one row in *keyed*, dealing the rows
    of a key over *salts* tasks by the column *by*."""
    left = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = keyed.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt_"]).drop("salt_")


def attach(rows: DataFrame, *keyed: DataFrame, how: str = "inner") -> DataFrame:
    """Distinct *rows* with the columns of *keyed* for their id.  The rows of an
    id are one list while tables are joined and are listed again afterwards."""
    mine = [c for c in rows.columns if c != "id"]
    out = rows.groupBy("id").agg(F.collect_set(F.struct(*mine)).alias("rows_"))
    for one in keyed:
        out = out.join(one, "id", how)
    others = [c for c in out.columns if c != "rows_"]
    return out.select(*others, F.explode("rows_").alias("row_")).select("row_.*", *others)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not its own root:
    the root is the smallest node that can be reached.  Large-star/small-star
    rounds; each round's table is written, so its lineage is short."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b throughout
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, low, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, lows, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b")))
        after = materialise(small.where("a <> b").distinct(), "edges")
        discard(edges)
        edges, now = after, state(after)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def detect(docs: DataFrame, width: int = 4, percent: int = 80, block: int = 1024, star: int = 256, deviations: float = 6.0, block_shingles: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of *docs*."""
    maker = Shingler(width)
    least = percent / 100 - deviations * maker.deviation(percent / 100)
    n_words = maker.bits * maker.bands * maker.rows // 64
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = materialise(
        texts.mapInArrow(lambda b: _digest(b, maker), "doc_id long, n_shingles long, key binary, sig array<bigint>, bands array<bigint>"),
        "digest",
    )
    classes = materialise(
        digest.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("size"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")),
        "classes",
    )
    reps = classes.where("id is not null")
    in_band = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = in_band.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(salted_join(in_band, buckets, "bucket", "id"), "buckets")

    sigs = reps.select("id", "sig")
    pairs = members.where("id <> leader").select("leader", "id")
    leaders = sigs.join(pairs.select(F.col("leader").alias("id")).distinct(), "id").select(F.col("id").alias("leader"), F.col("sig").alias("own"))
    pairs = salted_join(attach(pairs, sigs), leaders, "leader", "id", 8)
    half = n_words // maker.bits
    differ = [
        F.bit_count(
            F.reduce(
                F.array(*[F.col("sig")[w + p * half].bitwiseXOR(F.col("own")[w + p * half]) for p in range(maker.bits)]),
                F.lit(0).cast("long"),
                lambda a, x: a.bitwiseOR(x),
            )
        )
        for w in range(half)
    ]
    k, chance = maker.bands * maker.rows, 2.0**-maker.bits
    estimate = ((k - sum(differ[1:], differ[0])) / k - chance) / (1 - chance)
    stars = materialise(pairs.where(estimate >= least).select("leader", "id"), "stars")

    # texts of all documents that may have to be confirmed, fetched once
    chosen = _texts_of(texts, members.select("id").distinct())

    parts = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("parts"))
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("leader").alias("id"))
    tails = stars.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), "id")
    rows = attach(heads.unionByName(tails), chosen).select("leader", "salt", "id", "text")
    rows = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("id") != F.col("leader"), "id")
    first = materialise(rows.mapInArrow(lambda b: _confirm_stars(b, maker, percent), "a long, b long"), "links")

    found = materialise(components(first), "components")
    roots_of = found.withColumnRenamed("node", "id")
    comps = reps.groupBy("id").agg(F.sum("size").alias("size")).join(roots_of, "id", "left")
    comps = materialise(comps.select("id", F.coalesce("root", "id").alias("comp"), "size"), "comps")
    placed = attach(members.where("m > 2").select("bucket", "id"), comps)
    whole = reps.select("id", "sig", "bands")
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_shingles)).cast("int").alias("blocks")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), blocks).where("x <> y").select("bucket", "blocks")
    rest = attach(salted_join(placed.drop("size"), several, "bucket", "id"), whole)
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["bucket", "i", "j"]
    rest = rest.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "comp", "sig", "bands",
    ).repartition(*key).sortWithinPartitions(*key, "id")
    hopeful = rest.mapInArrow(lambda b: _promising(b, maker, least), "bucket long, i int, j int, side int, id long")
    rows = attach(hopeful, comps.drop("size"), whole, chosen)
    rows = rows.select(*key, "side", "id", "comp", "sig", "bands", "text").repartition(*key).sortWithinPartitions(*key, "id")
    second = materialise(rows.mapInArrow(lambda b: _confirm_blocks(b, maker, percent, least), "a long, b long"), "links")

    if second.isEmpty():
        final = found
    else:
        joined = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
        final = materialise(components(joined), "components")
    for done in (members, stars, chosen, first, comps, second):
        discard(done)
    merged = classes.join(final, F.col("id") == F.col("node"), "left").where("copies > 1 or root is not null")
    roots = merged.select("key", F.coalesce("root", "id").alias("top"))
    out = digest.select("doc_id", "n_shingles", "key").join(roots, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("top", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted representatives, one row for each id."""
    rows = texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
    return materialise(rows.groupBy("id").agg(F.min("text").alias("text")), "texts")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of *docs*, all columns as they are: one document of each group stays.

    A doc_id names a document; of rows that repeat both id and text one stays.
    A row with a null doc_id stands behind all rows with an id: it gets one of
    2**62 or more from its text, so it stays only where its group has no other,
    and of those with one text one stays."""
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.xxhash64(docs["text"]).bitwiseAND((1 << 60) - 1)).alias("doc_id")
    stay = detect(docs.select(own, docs["text"].cast("string").alias("text")), width, percent).where("kept").select("doc_id").distinct()
    named = docs.select(own, F.xxhash64(docs["text"]).alias("hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return named.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")

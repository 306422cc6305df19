"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. A document's set has its distinct 5-word shingles. In round i every element goes to one of
``coordinates`` bins by a hash of that round, and the least hash value of a bin that was empty
before the round becomes the bin's coordinate. After ``coordinates`` rounds, round
``coordinates + j`` puts all elements into bin j. So every coordinate of a non-empty set fills, most
within a few rounds, and the share of equal coordinates is concentrated around the similarity.

Candidates. ``rows`` coordinates make a band key. At similarity 0.75, 48 bands of 5 rows miss a
pair with a probability of 2e-6. Documents with the same set are one class, and classes that
share a band key are candidates.

Exact links. A bucket of n classes has n * n / 2 candidate pairs, which are never listed. Only the
components of the link graph are wanted, so a candidate pair inside one component needs no test:

1. star rounds: each class of a bucket is tested against one class of it, another one each round;
2. components of the links found so far; buckets whose classes all lie in one component are done;
3. after ``star_rounds``, all untested pairs of a bucket whose ends lie in different components
   are tested, if set sizes and sketches allow a link, so no link between components is lost.

Two bits of each of ``COORDINATES`` coordinates are kept to spare tests: at similarity s a share of
0.75 * (1 - s) of them differs, and a pair is passed over only where ``MARGIN`` standard deviations
more than that of the threshold differ (a chance of 3e-6 for a pair at the threshold). A pair with several common bands is
tested in the first one.

Tests use full sets: the texts of both ends are joined to the pair and their sets intersected.

Edge cases: a null or empty text or one without words has an empty set, n_shingles 0 and no link;
fewer than five words make one shingle of the whole sequence; repeated rows get equal results;
a row with a null doc_id links nothing, has a null component_id and is kept; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm.batches import filled, hashes_of, mixed, owner_of, slices, words_of

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 5
STAR_ROUNDS = 3
COORDINATES = 1024
MARGIN = 4.5
SKETCHED_AT_ONCE, SKETCHED_BYTES = 1024, 4 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(starts per text and the end, sorted distinct shingle hashes)."""
    starts, codes, words = words_of(pc.ascii_lower(filled(texts)))
    h = hashes_of(words)[codes]
    n = max(len(h) - size + 1, 0)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = runs * FOLD + h[j : n + j]
    runs = mixed(runs)
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        else:
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = mixed(short * FOLD + x)
            sets.append(short[: int(b > a)])
    ends = np.cumsum([0, *map(len, sets)])
    return ends, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def sketches(starts: np.ndarray, elements: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` values for each set; rows of empty sets are meaningless."""
    n = len(starts) - 1
    owner = owner_of(starts)
    best = np.full(n * coordinates, FULL, np.uint64)
    full = np.zeros(n * coordinates, bool)

    def settle(slot, value):
        np.minimum.at(best, slot, value)
        full[slot] = True

    for i in range(2 * coordinates):
        seed = mixed(np.array([i + 1], np.uint64) * FOLD)
        v = mixed(elements ^ seed)
        if i < coordinates:
            at = ((v >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        else:
            at = i - coordinates
        slot = owner * coordinates + at
        free = ~full[slot]
        settle(slot[free], mixed(v[free] + FOLD))
        if i < 4 or i % 16 == 0:  # elements of full sketches are done
            wanting = ~full.reshape(n, coordinates).all(axis=1)
            kept = wanting[owner]
            owner, elements = owner[kept], elements[kept]
            if not len(owner):
                break
    return best.reshape(n, coordinates)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(-1, bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        keys = mixed(keys * FOLD + parts[:, :, r])
    return keys


def packed_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest two bits of each coordinate, 32 coordinates to an integer."""
    low = np.stack([sketch & np.uint64(1), sketch >> np.uint64(1) & np.uint64(1)], axis=2).astype(np.uint8)
    return np.packbits(low.reshape(len(sketch), -1), axis=1).view(np.int64)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether so few coordinates differ in their two bits that the sets may be similar enough."""
    share = (1 - percent / 100) * 0.75
    most = COORDINATES * share + MARGIN * (COORDINATES * share * (1 - share)) ** 0.5

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x) <= most


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands, bits): set size, a 128-bit digest of the set, band keys, sketch bits."""
    if bands * rows > COORDINATES:
        raise ValueError("bands need more coordinates than a sketch has")

    def sign(batches):
        for batch in slices(batches, "text", SKETCHED_BYTES, SKETCHED_AT_ONCE):
            starts, elements = shingle_sets(batch.column("text"))
            sizes = np.diff(starts)
            sketch = sketches(starts, elements, COORDINATES)
            keys = band_keys(sketch[:, : bands * rows], bands, rows)
            digests = []
            for k in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(elements + np.uint64(k)))])
                digests.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    *map(pa.array, digests),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[sizes > 0].ravel().view(np.int64))),
                    pa.array(list(packed_bits(sketch)), pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands", "bits"],
            )

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose full sets are similar enough."""

    def confirm(batches):
        for batch in slices(batches, "text_b", SKETCHED_BYTES):
            left = batch.column("text_a").dictionary_encode()
            starts_a, sets_a = shingle_sets(left.dictionary)
            starts_b, sets_b = shingle_sets(batch.column("text_b"))
            linked = np.zeros(batch.num_rows, bool)
            for i, code in enumerate(left.indices.to_pylist()):
                x, y = sets_a[starts_a[code] : starts_a[code + 1]], sets_b[starts_b[i] : starts_b[i + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common) > 0
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``links(a, b)``.

    Each round takes the least label among neighbours, hooks whole components to the least label
    that any of their nodes saw, and follows the labels one step; it ends when nothing changes.
    """
    edges = cut_lineage(links.union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        met = labels.join(seen.withColumnRenamed("a", "node"), "node")
        hooks = met.groupBy("label").agg(F.min("seen").alias("hook"))
        hooked = cut_lineage(met.join(hooks, "label").select("node", F.col("label").alias("old"), F.least("label", "seen", "hook").alias("label")))
        ahead = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut_lineage(hooked.join(ahead, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.filter("label <> old").limit(1).count() == 0:
            return labels


def linked_classes(buckets: DataFrame, texts: DataFrame, sketched: DataFrame, percent: int, star_rounds: int) -> DataFrame | None:
    """(node, label) of the classes that have links; None if there are none.

    ``buckets(key, node, n)`` has the buckets of two or more classes, ``texts`` their texts and ``sketched``
    (node, bits, bands) their sketches.
    """
    labels, tested = None, None
    for i in range(star_rounds + 1):
        if labels is None:
            open_ = buckets.withColumn("label", F.col("node"))
        else:
            named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed_keys = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
            open_ = cut_lineage(named.join(mixed_keys, "key"))
        if open_.limit(1).count() == 0:
            break
        if i < star_rounds:
            order = F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "label", "n")
            centre = open_.groupBy("key").agg(F.min(order).alias("c"))
            ends = open_.join(centre, "key").select("node", "label", "n", F.col("c.node").alias("other"), F.col("c.label").alias("other_label"), F.col("c.n").alias("other_n"))
        else:
            open_ = cut_lineage(open_.join(sketched, "node"))
            renamed = {"node": "other", **{c: f"other_{c}" for c in ("label", "n", "bits", "bands")}}
            others = open_.select("key", *[F.col(c).alias(x) for c, x in renamed.items()])
            first_common = F.element_at(F.array_intersect("bands", "other_bands"), 1) == F.col("key")
            ends = open_.join(others, "key").filter("node < other").filter(may_link("bits", "other_bits", percent) & first_common)
        fits = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
        pairs = ends.filter(F.col("label") != F.col("other_label")).filter(fits)
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if i < star_rounds:
            tested = pairs if tested is None else tested.union(pairs)
            for end in ("a", "b"):
                pairs = pairs.join(sketched.select(F.col("node").alias(end), F.col("bits").alias(f"bits_{end}")), end)
            pairs = cut_lineage(pairs.filter(may_link("bits_a", "bits_b", percent)).select("a", "b"))
        if pairs.limit(1).count() == 0:
            continue
        links = cut_lineage(confirmed(pairs, texts, percent))
        if links.limit(1).count() == 0:
            continue
        if labels is None:
            labels = components(links)
            continue
        # components of the components
        of = labels.select("node", "label")
        upper = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        upper = upper.join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        merged = components(upper.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        fresh = merged.select("node", F.col("label").alias("new"))
        moved = of.join(fresh.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        added = fresh.join(of, "node", "left_anti").select("node", F.col("new").alias("label"))
        labels = cut_lineage(moved.union(added))
    return labels


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    signed = cut_lineage(signatures(docs, bands, rows))
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same_set = ["n_shingles", "fp1", "fp2"]
    classes = cut_lineage(named.groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    joined = named.select("doc_id", *same_set).join(classes, same_set, "left")
    member = cut_lineage(joined.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")))

    chosen = member.filter("doc_id = node").select("doc_id").distinct()
    keys = named.join(chosen, "doc_id", "left_semi").select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    shared = keys.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("key")
    buckets = cut_lineage(keys.join(shared, "key").distinct())
    candidates = buckets.select(F.col("node").alias("doc_id")).distinct()
    given = docs.select(F.col("doc_id").cast("long"), "text")
    texts = cut_lineage(given.join(candidates, "doc_id", "left_semi"))

    sketched = cut_lineage(named.join(candidates, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "bits", "bands").distinct())
    labels = linked_classes(buckets, texts, sketched, percent, star_rounds)
    found = member.withColumn("label", F.col("node"))
    if labels is not None:
        found = member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = found.select("doc_id", "n_shingles", F.col("label").alias("component_id")).distinct()
    result = signed.select("doc_id", "n_shingles").join(found, ["doc_id", "n_shingles"], "left")
    own = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))

"""Modified Kneser-Ney letter models by language, kept as sorted hash arrays; no document is scored by its own counts.

An event is a letter, or the end of a text, after the four symbols before it; histories cross word borders (one space between
words), and a short history is filled up with a start mark. A symbol is hashed to ``LETTER_BITS`` bits (code points below 2,048 keep
their number, the others share 2,048 classes), so an n-gram is one number: its context, its ending and their hashes
are shifts and masks of it, and a sorted array of numbers with an array of counts is a model.

Halves. Each language has two models, of the documents of either half (by a hash of doc_id and text), and a document is scored by the model of
the half it is not in. Else a long odd text would explain itself.

Steps. Rows are numbered in packets of about ``PACKET_BYTES``. A packet counts its distinct n-grams and sends them as sorted arrays, one for
each language, half and bucket; a bucket is a hash of the fourth letter, which an n-gram shares with all its contexts and endings of two or
more letters, so all orders but the first are local to a bucket.

1. Count: the arrays of a bucket are merged, ``FAN_IN`` at a time, until one is left. A bucket's task holds FAN_IN packets' arrays, or the bucket.
2. Smooth: counts of counts and letters of all buckets of a model give its discounts (one, two, three or more) and its first order.
3. Look up: the arrays of at most about ``ASKED_AT_ONCE`` packets meet a copy of the bucket and are answered by binary search, with an array
   of log-probabilities in the same order.
4. The answers of a packet meet its texts.

What moves is packets x buckets arrays of a few bytes an n-gram; nothing is gathered on the driver, and no n-gram is a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm.batches import filled, give_back, mixed, slices
from seriloom.llm.kneser_ney import discounts_of, unpacked

ORDER = 5
LETTER_BITS = 12
PLAIN = 2048  # code points below are their own class
BUCKETS = 64
PACKET_BYTES = 24 << 20
COUNTED_BYTES = 1 << 20
FAN_IN = 16
ASKED_AT_ONCE = 32
START, END, SPACE = 10, 13, 32  # white space is in no word
LETTERS = 1 << LETTER_BITS
UNKNOWN = float(np.log(1 / 64))  # an event of a language without a model


def classes(points: np.ndarray) -> np.ndarray:
    far = PLAIN + (mixed(points.astype(np.uint64)) % np.uint64(LETTERS - PLAIN)).astype(np.int64)
    return np.where(points < PLAIN, points, far).astype(np.int64)


def ending(grams: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` symbols of n-grams."""
    return grams & ((1 << (LETTER_BITS * size)) - 1)


def events_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of events of each text, n-gram of each event)."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(filled(texts)))
    joined = pc.binary_join(words, " ")
    some = pc.greater(pc.binary_length(joined), 0).to_numpy(zero_copy_only=False)
    text = "\r".join([*joined.filter(pa.array(some)).to_pylist(), ""])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.zeros(len(some), np.int64)
    if not len(points):
        return sizes, np.zeros(0, np.int64)
    closes = points == END
    ends = np.flatnonzero(closes)
    sizes[some] = np.diff(np.concatenate([[-1], ends]))
    at = np.arange(len(points)) + (ORDER - 1) * (np.cumsum(closes) - closes + 1)
    symbols = np.full(len(points) + (ORDER - 1) * len(ends), START, np.int64)
    symbols[at] = classes(points)
    grams = np.zeros(len(points), np.int64)
    for j in range(ORDER):
        grams = (grams << LETTER_BITS) | symbols[at - (ORDER - 1) + j]
    return sizes, grams


def bucket_of(grams: np.ndarray) -> np.ndarray:
    """By the last symbol but one."""
    return (mixed((ending(grams, 2) >> LETTER_BITS).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def shut(x: np.ndarray) -> bytes:
    """An array as bytes; ascending ones as differences."""
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def opened(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", kind)


def shut_ascending(x: np.ndarray) -> bytes:
    """Differences, byte by byte: all lowest bytes first, so that the many zeros of the higher ones lie together."""
    steps = np.diff(x, prepend=0).astype("<i8")
    return shut(steps.view(np.uint8).reshape(-1, 8).T.copy())


def opened_ascending(data: bytes) -> np.ndarray:
    parts = opened(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(parts.T).view("<i8").ravel())


def groups_of(batch: pa.RecordBatch) -> list[tuple[str, int]]:
    return list(zip(batch.column("model_lang").to_pylist(), batch.column("half").to_pylist()))


def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(packet, slice): the same for every reading of a stored table."""
    first, size = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, "text", COUNTED_BYTES):
        yield first + size // PACKET_BYTES, batch
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0


def packed(docs: DataFrame) -> DataFrame:
    """(packet, slice): the rows of ``docs``, which have a column text, as compressed Arrow streams."""

    def pack(batches):
        for packet, batch in numbered(batches):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([packet]), pa.array([out.getvalue().to_pybytes()])], ["packet", "slice"])

    return docs.mapInArrow(pack, "packet long, slice binary")


class Tally:
    """Distinct n-grams and counts by (language, half). Pieces are summed whenever they outgrow what was summed before, so
    memory stays near twice the distinct n-grams, whatever the number of slices."""

    def __init__(self):
        self.parts: dict[tuple[str, int], list] = {}
        self.waiting: dict[tuple[str, int], int] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        sizes, grams = events_of(batch.column("text"))
        keys = groups_of(batch)
        names = sorted(set(keys))
        index = {k: i for i, k in enumerate(names)}
        owner = np.repeat(np.array([index[k] for k in keys], np.int8 if len(names) < 128 else np.int32), sizes)
        for k, i in index.items():
            found, counts = np.unique(grams[owner == i], return_counts=True)
            if len(found):
                pieces = self.parts.setdefault(k, [])
                pieces.append((found, counts))
                self.waiting[k] = self.waiting.get(k, 0) + len(found)
                if self.waiting[k] > len(pieces[0][0]):
                    self.parts[k], self.waiting[k] = [summed(pieces)], 0

    def by_bucket(self) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        """{(language, half): (n-grams by bucket, then ascending; their counts)}."""
        out = {}
        for k, pieces in self.parts.items():
            grams, counts = summed(pieces)
            order = np.argsort(bucket_of(grams), kind="stable")
            out[k] = grams[order], counts[order]
        return out


def distinct_grams(batches: list[pa.RecordBatch]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Those of a packet's slices."""
    tally = Tally()
    for batch in batches:
        tally.add(batch)
    return tally.by_bucket()


def summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(pieces) == 1:
        return pieces[0]
    grams, where = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([c for _, c in pieces]), len(grams)).astype(np.int64)


ARRAYS = "model_lang string, half int, bucket int, grams binary, counts binary"


def asked_of(docs: DataFrame) -> DataFrame:
    """(packet, model_lang, half, bucket, grams, counts): the distinct n-grams of every packet."""
    names = ["packet", "model_lang", "half", "bucket", "grams", "counts"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def emit(packet, tally):
        for (lang, half), (grams, counts) in tally.by_bucket().items():
            bucket = bucket_of(grams)
            edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                a, z = edges[b], edges[b + 1]
                rows.append((packet, lang, half, int(b), shut_ascending(grams[a:z]), shut(counts[a:z].astype(np.int64))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def count(batches):
        tally, packet = Tally(), None
        for number, batch in numbered(batches):
            if number != packet:
                yield from emit(packet, tally)
                tally, packet = Tally(), number
                give_back()
            tally.add(batch)
        yield from emit(packet, tally)
        tally = None
        give_back()

    return docs.mapInArrow(count, f"packet long, {ARRAYS}")


def merged(asked: DataFrame, packets: int) -> DataFrame:
    """(model_lang, half, bucket, grams, counts): one row for each bucket, by rounds of ``FAN_IN`` arrays each."""

    def merge(table: pa.Table) -> pa.Table:
        pieces = [(opened_ascending(g), opened(c, np.int64)) for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist())]
        grams, counts = summed(pieces)
        first = table.slice(0, 1)
        names = ["model_lang", "half", "bucket", "part", "grams", "counts"]
        arrays = [*[first.column(c).combine_chunks() for c in names[:4]], pa.array([shut_ascending(grams)], pa.binary()), pa.array([shut(counts)], pa.binary())]
        give_back()
        return pa.Table.from_arrays(arrays, names)

    parts = max(-(-packets // FAN_IN), 1)
    rows = asked.select("model_lang", "half", "bucket", F.pmod(F.xxhash64("packet"), F.lit(parts)).alias("part"), "grams", "counts")
    while True:
        rows = rows.groupBy("model_lang", "half", "bucket", "part").applyInArrow(merge, "model_lang string, half int, bucket int, part long, grams binary, counts binary")
        if parts == 1:
            return cut_lineage(rows.drop("part"))
        parts = -(-parts // FAN_IN)
        rows = cut_lineage(rows).withColumn("part", F.pmod("part", F.lit(parts)))


def orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{k: (n-grams of k symbols, ascending; their counts)} for k from ``ORDER`` to 2: counts, below the highest order the number of
    distinct symbols before (plain counts after a start mark)."""
    out = {ORDER: (grams, counts)}
    longer, plain = grams, counts
    for k in range(ORDER - 1, 1, -1):
        found, where = np.unique(ending(longer, k), return_inverse=True)
        plain = np.bincount(where, plain, len(found)).astype(np.int64)
        before = np.bincount(where, minlength=len(found))
        out[k] = found, np.where(found >> (LETTER_BITS * (k - 1)) == START, plain, before)
        longer = found
    return out


def parameters(buckets: DataFrame) -> DataFrame:
    """(model_lang, half, discounts, first): discounts of the orders from 1 up (0, 1, 2, 3 or more), and the probability of each symbol."""

    def count(batches):
        names = ["model_lang", "half", "often", "letters"]
        for batch in batches:
            often, letters = [], []
            for g, c in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist()):
                levels = orders(opened_ascending(g), opened(c, np.int64))
                often.append(np.concatenate([np.bincount(np.minimum(levels[k][1], 5), minlength=6)[1:5] for k in range(2, ORDER + 1)]).tolist())
                pairs = levels[2][0]
                letters.append(shut(np.bincount(ending(pairs, 1), minlength=LETTERS).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("model_lang"), batch.column("half"), pa.array(often, pa.list_(pa.int64())), pa.array(letters, pa.binary())], names)

    def settle(table: pa.Table) -> pa.Table:
        often = np.sum(np.array(table.column("often").to_pylist()), axis=0).reshape(ORDER - 1, 4)
        letters = np.sum([opened(x, np.int64) for x in table.column("letters").to_pylist()], axis=0)
        own = discounts_of([float((letters == i).sum()) for i in range(1, 5)])
        taken = own[np.minimum(letters, 3)]
        uniform = 1.0 / max(int((letters > 0).sum()) + 1, 2)
        first = (letters - taken + taken.sum() * uniform) / max(letters.sum(), 1)
        d = np.concatenate([own, *[discounts_of([float(x) for x in row]) for row in often]])
        head = table.slice(0, 1).select(["model_lang", "half"])
        return head.append_column("discounts", pa.array([d.tolist()], pa.list_(pa.float64()))).append_column("first", pa.array([shut(first)], pa.binary()))

    rows = buckets.mapInArrow(count, "model_lang string, half int, often array<long>, letters binary")
    return rows.groupBy("model_lang", "half").applyInArrow(settle, "model_lang string, half int, discounts array<double>, first binary")


class Bucket:
    """One bucket of a model: a sorted array for each order, and one of its contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discounts: np.ndarray, first: np.ndarray):
        self.first, self.levels = first, {}
        discounts = discounts.reshape(ORDER, 4)
        if not len(grams):
            return
        for k, (found, n) in orders(grams, counts).items():
            taken = discounts[k - 1][np.minimum(n, 3)]
            contexts, start = np.unique(found >> LETTER_BITS, return_index=True)
            self.levels[k] = found, n - taken, contexts, np.add.reduceat(n, start), np.add.reduceat(taken, start)

    def probabilities(self, asked: np.ndarray, k: int = ORDER) -> np.ndarray:
        if k == 1 or not self.levels:
            return self.first[ending(asked, 1)]
        lower = self.probabilities(ending(asked, k - 1), k - 1)
        found, left, contexts, total, less = self.levels[k]
        at = np.minimum(np.searchsorted(found, asked), len(found) - 1)
        own = np.where(found[at] == asked, left[at], 0.0)
        of = np.minimum(np.searchsorted(contexts, asked >> LETTER_BITS), len(contexts) - 1)
        return np.where(contexts[of] == asked >> LETTER_BITS, (own + less[of] * lower) / total[of], lower)


def answers(asked: DataFrame, model: DataFrame, packets: int) -> DataFrame:
    """(packet, model_lang, half, bucket, logs): log-probabilities of each array of n-grams by the model of the other half."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = None
        if right.num_rows:
            r = right.to_pylist()[0]
            grams, counts = (opened_ascending(r["grams"]), opened(r["counts"], np.int64)) if r["grams"] else (np.zeros(0, np.int64),) * 2
            bucket = Bucket(grams, counts, np.array(r["discounts"]), opened(r["first"], np.float64))
        logs = []
        for g in left.column("grams").to_pylist():
            grams = opened_ascending(g)
            p = np.log(bucket.probabilities(grams)) if bucket else np.full(len(grams), UNKNOWN)
            logs.append(shut(p.astype(np.float32)))
        out = left.select(["packet", "model_lang", "half", "bucket"]).append_column("logs", pa.array(logs, pa.binary()))
        give_back()
        return out

    salts = max(-(-packets // ASKED_AT_ONCE), 1)
    left = asked.drop("counts").withColumns({"by": 1 - F.col("half"), "salt": F.pmod(F.xxhash64("packet"), F.lit(salts)).cast("int")})
    right = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = ["model_lang", "by", "bucket", "salt"]
    both = left.groupBy(*key).cogroup(right.withColumnRenamed("half", "by").groupBy(*key))
    return both.applyInArrow(look_up, "packet long, model_lang string, half int, bucket int, logs binary")


def half_of(doc_id: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(2)).cast("int")


def scored(docs: DataFrame, compute: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``compute(rows, events of each text, log-probability of each text)`` over slices of ``docs``, which has the columns text, model_lang
    (not null) and half and must be read alike each time."""
    asked = cut_lineage(asked_of(docs))
    packets = asked.select(F.approx_count_distinct("packet")).first()[0]
    buckets = merged(asked, packets)
    every = parameters(buckets).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    model = cut_lineage(every.join(buckets, ["model_lang", "half", "bucket"], "left"))
    found = answers(asked, model, packets)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = [unpacked(piece) for piece in left.column("slice").combine_chunks()]
        rows = sorted(zip(right.column("model_lang").to_pylist(), right.column("half").to_pylist(), right.column("bucket").to_pylist(), right.column("logs").to_pylist()), key=lambda r: r[:3])
        logs = {}
        for lang, half, _, data in rows:
            logs.setdefault((lang, half), []).append(opened(data, np.float32))
        known = {}
        for k, (grams, _) in distinct_grams(batches).items():
            values = np.concatenate(logs[k]) if k in logs else np.zeros(0, np.float32)
            if len(values) != len(grams):
                raise ValueError("a packet has n-grams that were not asked for: its table was read in another order")
            order = np.argsort(grams)
            known[k] = grams[order], values[order]
        out = []
        for batch in batches:
            sizes, grams = events_of(batch.column("text"))
            keys = groups_of(batch)
            owner, total = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes))
            for k in {k for k, n in zip(keys, sizes) if n}:
                mine = np.array([x == k for x in keys])
                some = mine[owner]
                found, values = known[k]
                total += np.bincount(owner[some], values[np.searchsorted(found, grams[some])].astype(float), len(sizes))
            out.append(compute(batch, sizes, total))
            give_back()
        return pa.Table.from_batches(out) if out else empty

    return packed(docs).groupBy("packet").cogroup(found.groupBy("packet")).applyInArrow(meet, schema)

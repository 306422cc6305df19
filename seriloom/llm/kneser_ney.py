"""Kneser-Ney models over letters: counted, smoothed and looked up by Spark, exact at every size.

An event is a letter, or the end of a sequence, after the ``order - 1`` letters before it (lower-cased, if
asked for); a short history is filled up with a start mark. A sequence is a word, or, with ``across``, a whole
text: its words with one space between them, so that histories cross word borders.

Size. An n-gram is kept as itself, a string of ``order`` symbols, so no two share their counts. Nothing of the model is
gathered on the driver or sent to all tasks but its discounts: counts, continuation counts and totals
of contexts are sums by key, and a probability is joined from the tables of its order and of the next lower one.

Lookup. Documents are packed into slices, and some slices of one task make a packet. A packet asks once for each of its
distinct n-grams, and the answers meet its slices again in a cogroup by packet. A task's memory is bounded by one
packet's texts and n-grams.

Smoothing. The highest order uses counts, lower orders use the number of distinct letters seen
before an n-gram (plain counts for n-grams that begin with the start mark). Discounts of one, two and
three or more are estimated from the counts of counts for each order, and what they take away is
given to the next lower order, down to a uniform share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm.batches import filled, give_back, slices

ORDER = 5
COUNTED_BYTES = 2 << 20
PACKET_BYTES = 24 << 20
MOST_DENSE = 1 << 25
START, END = "\n", "\r"  # white space is in no word


@dataclass
class Events:
    """Events of some texts: ``starts`` per text in words, ``word_starts`` and ``word_events`` per word in events, the n-gram of each event."""

    starts: np.ndarray
    word_starts: np.ndarray
    word_events: np.ndarray
    ids: np.ndarray
    grams: pa.Array


def events_of(texts: pa.Array, order: int, fold_case: bool = True, across: bool = False) -> Events:
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(filled(texts)))
    joined = pc.binary_join(words, " " if across else END)
    some = pc.greater(pc.binary_length(joined), 0)
    sizes = np.where(some.to_numpy(zero_copy_only=False), pc.list_value_length(words).to_numpy(zero_copy_only=False), 0)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if not starts[-1]:
        none = np.zeros(0, np.int64)
        return Events(starts, none, none, none, pa.array([], pa.string()))
    text = END.join([*joined.filter(some).to_pylist(), ""])
    points = np.frombuffer((text.lower() if fold_case else text).encode("utf-32-le"), np.uint32)
    del text, words, joined

    closes = points == ord(END)
    word_ends = np.flatnonzero(closes | (points == ord(" ")))
    word_starts = np.concatenate([[0], word_ends[:-1] + 1])
    sequence = np.cumsum(closes) - closes
    at = np.arange(len(points)) + (order - 1) * (sequence + 1)
    known = np.zeros(0x110000, bool)
    known[points] = known[ord(START)] = True
    letters = np.flatnonzero(known).astype(np.uint32)
    rank = (np.cumsum(known) - 1).astype(np.int32)
    symbols = np.full(len(points) + (order - 1) * int(closes.sum()), rank[ord(START)], np.int32)
    symbols[at] = rank[points]

    n, levels = len(letters), []
    ids, size = symbols[at - order + 1].astype(np.int64), n
    for j in range(1, order):  # n-grams are numbered by (number of the n-gram before the last letter, last letter)
        ids = ids * n + symbols[at - order + 1 + j]
        if size * n <= MOST_DENSE:
            seen = np.zeros(size * n, bool)
            seen[ids] = True
            found, ids = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[ids].astype(np.int64)
        else:
            found, ids = np.unique(ids, return_inverse=True)
        levels.append(found)
        size = len(found)
    rest, columns = np.arange(size), []
    for found in reversed(levels):
        rest, last = np.divmod(found[rest], n)
        columns.append(letters[last])
    columns.append(letters[rest])
    spelt = np.stack(columns[::-1], axis=1).tobytes().decode("utf-32-le")
    grams = pa.array([spelt[i : i + order] for i in range(0, size * order, order)], pa.string())
    return Events(starts, word_starts, word_ends + 1 - word_starts, ids, grams)


def packed(docs: DataFrame) -> DataFrame:
    """(packet, slice): the rows of ``docs``, which have a column text, as compressed Arrow streams."""

    def pack(batches):
        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text", COUNTED_BYTES):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([first + size // PACKET_BYTES]), pa.array([out.getvalue().to_pybytes()])], ["packet", "slice"])
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0

    return docs.mapInArrow(pack, "packet long, slice binary")


def unpacked(piece: pa.Scalar) -> pa.RecordBatch:
    table = pa.ipc.open_stream(piece.as_buffer()).read_all().combine_chunks()
    return table.to_batches()[0]


def gram_rows(slices_of: DataFrame, groups: int = 1, order: int = ORDER, fold_case: bool = True, across: bool = False) -> DataFrame:
    """(packet, gram, counts): each packet's distinct n-grams. Counts are by the column group of the packed rows, from 0 to
    groups - 1; a row of no group, or a table without the column, counts nothing."""
    names = [f"c{g}" for g in range(groups)]

    def counted(batch):
        events = events_of(batch.column("text"), order, fold_case, across)
        columns = [np.zeros(len(events.grams), np.int64)] * groups
        if "group" in batch.schema.names and len(events.ids):
            group = pc.fill_null(batch.column("group").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            of = np.repeat(np.repeat(group, np.diff(events.starts)), events.word_events)
            columns = [np.bincount(events.ids[of == g], minlength=len(events.grams)) for g in range(groups)]
        return pa.table([events.grams, *map(pa.array, columns)], ["gram", *names])

    def summed(packet, tables):
        total = pa.concat_tables(tables).group_by("gram").aggregate([(c, "sum") for c in names])
        total = total.select(["gram", *[f"{c}_sum" for c in names]]).rename_columns(["gram", *names])
        for batch in total.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, packet)), *batch.columns], ["packet", "gram", *names])

    def count(batches):
        tables, packet = [], None
        for batch in batches:
            for number, piece in zip(batch.column("packet").to_pylist(), batch.column("slice")):
                if tables and number != packet:
                    yield from summed(packet, tables)
                    tables = []
                packet = number
                tables.append(counted(unpacked(piece)))
                give_back()
        if tables:
            yield from summed(packet, tables)
        tables = []
        give_back()

    return slices_of.mapInArrow(count, "packet long, gram string, " + ", ".join(f"{c} long" for c in names))


def ngram_counts(docs: DataFrame, groups: int = 1, order: int = ORDER, bits: int | None = None, fold_case: bool = True, across: bool = False) -> DataFrame:
    """(gram, counts) of ``docs(text, group)``; group runs from 0 to groups - 1. ``bits`` has no effect: n-grams are not hashed."""
    rows = gram_rows(packed(docs.select("text", "group")), groups, order, fold_case, across)
    return rows.groupBy("gram").agg(*[F.sum(f"c{g}").alias(f"c{g}") for g in range(groups)])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Amounts to take from counts of 0, 1, 2 and 3 or more (modified Kneser-Ney)."""
    return discounts_of([float((counts == i).sum()) for i in range(1, 5)])


def discounts_of(n: list[float]) -> np.ndarray:
    """The same from the numbers of counts of 1, 2, 3 and 4."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(float(np.clip(x, 0.1, i)) for i, x in enumerate(d, 1))])


def _taken(table: DataFrame, count: str) -> Column:
    found = {r["n"]: r["count"] for r in table.filter(F.col(count).between(1, 4)).groupBy(F.col(count).alias("n")).count().collect()}
    d = discounts_of([float(found.get(i, 0)) for i in range(1, 5)])
    n = F.col(count)
    return F.when(n >= 3, float(d[3])).when(n == 2, float(d[2])).when(n == 1, float(d[1])).otherwise(0.0)


def log_probabilities(rows: DataFrame, groups: int = 1, order: int = ORDER) -> DataFrame:
    """(gram, packets, l0, l1, ...) of ``rows(packet, gram, counts)``: log-probabilities by group of every n-gram in ``rows``, and
    the packets that ask for it. Lower orders are shared by all groups."""
    names = [f"c{g}" for g in range(groups)]
    top = cut_lineage(rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names], F.collect_list("packet").alias("packets")))
    tables = {order: top.withColumn("plain", sum((F.col(c) for c in names[1:]), F.col(names[0])))}
    for k in range(order - 1, 0, -1):
        shorter = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram"))
        below = shorter.agg(F.sum("plain").alias("plain"), F.sum((F.col("plain") > 0).cast("long")).alias("before"))
        tables[k] = cut_lineage(below.withColumn("n", F.when(F.col("gram").startswith(START), F.col("plain")).otherwise(F.col("before"))))

    taken = _taken(tables[1], "n")
    whole = tables[1].agg(F.sum("n"), F.sum(taken), F.sum((F.col("n") > 0).cast("long"))).first()
    total, less, letters = (x or 0 for x in whole)
    uniform = 1.0 / max(letters + 1, 2)
    known = tables[1].select("gram", ((F.col("n") - taken + less * uniform) / total if total else F.lit(uniform)).alias("p"))
    for k in range(2, order + 1):
        counts = ["n"] if k < order else names
        less_of = {c: _taken(tables[k], c) for c in counts}
        context = F.substring("gram", 1, k - 1)
        sums = [x for c in counts for x in (F.sum(c).alias(f"{c}_all"), F.sum(less_of[c]).alias(f"{c}_less"))]
        contexts = tables[k].groupBy(context.alias("context")).agg(*sums)
        lower = known.select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
        joined = tables[k].withColumns({"context": context, "tail": F.substring("gram", 2, k - 1)}).join(contexts, "context").join(lower, "tail")

        def refined(c):
            everything, rest = F.col(f"{c}_all"), F.col(f"{c}_less")
            return F.when(everything > 0, (F.col(c) - less_of[c] + rest * F.col("lower")) / everything).otherwise(F.col("lower"))

        if k < order:
            known = joined.select("gram", refined("n").alias("p"))
    return joined.select("gram", "packets", *[F.ln(refined(c)).cast("float").alias(f"l{g}") for g, c in enumerate(names)])


Compute = Callable[[pa.RecordBatch, Events, np.ndarray, np.ndarray], pa.RecordBatch]


def scored(
    docs: DataFrame, compute: Compute, schema: str, learnt: DataFrame | None = None, groups: int = 1, order: int = ORDER, fold_case: bool = True, across: bool = False
) -> DataFrame:
    """``compute(rows, events, events of each word, log-probability of each word by group)`` over slices of ``docs``, by a model of
    ``learnt(text, group)``, or of ``docs`` itself if it has a column group. ``docs`` must be read alike each time."""
    pieces = packed(docs)
    rows = gram_rows(pieces, groups, order, fold_case, across)
    if learnt is not None:
        counted = gram_rows(packed(learnt.select("text", "group")), groups, order, fold_case, across)
        rows = rows.union(counted.withColumn("packet", F.lit(None).cast("long")))
    logs = [f"l{g}" for g in range(groups)]
    answers = log_probabilities(rows, groups, order).select(F.explode("packets").alias("packet"), "gram", *logs)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.column("gram").combine_chunks()
        values = [right.column(c).to_numpy() for c in logs]
        out = []
        for piece in left.column("slice").combine_chunks():
            batch = unpacked(piece)
            events = events_of(filled(batch.column("text")), order, fold_case, across)
            place = pc.index_in(events.grams, value_set=asked)
            if place.null_count:
                raise ValueError("a packet has n-grams that were not asked for: its table was read in another order")
            place = place.to_numpy(zero_copy_only=False)
            sums = [np.add.reduceat(v[place][events.ids].astype(float), events.word_starts) if len(events.ids) else np.zeros(0) for v in values]
            out.append(compute(batch, events, events.word_events, np.stack(sums)))
            del batch, events, place, sums
            give_back()
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return pieces.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(look_up, schema)


@dataclass
class Model:
    """Counts of a model of words, for looking up a few words."""

    counts: DataFrame
    groups: int
    order: int
    fold_case: bool

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(events of each word, log-probability of each word by group)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros((self.groups, 0))
        events = events_of(pa.array(words), self.order, self.fold_case)
        names = [f"c{g}" for g in range(self.groups)]
        asked = self.counts.sparkSession.createDataFrame([(0, g, *[0] * self.groups) for g in events.grams.to_pylist()], self._schema(names))
        rows = asked.union(self.counts.select(F.lit(None).cast("long"), "gram", *names))
        found = {r.gram: r for r in log_probabilities(rows, self.groups, self.order).filter(F.size("packets") > 0).collect()}
        logs = [np.array([found[g][f"l{i}"] for g in events.grams.to_pylist()])[events.ids] for i in range(self.groups)]
        return events.word_events, np.stack([np.add.reduceat(x, events.word_starts) for x in logs])

    @staticmethod
    def _schema(names: list[str]) -> str:
        return "packet long, gram string, " + ", ".join(f"{c} long" for c in names)


def fit(counts: DataFrame, groups: int = 1, order: int = ORDER, bits: int | None = None, fold_case: bool = True) -> Model:
    """The model of ``ngram_counts`` over words; ``bits`` has no effect."""
    return Model(counts, groups, order, fold_case)

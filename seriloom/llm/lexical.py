"""Ranked lexical search by bit-sliced Bloom signatures.

Index. Documents are dealt into blocks of at most ``BLOCK_DOCS`` with like numbers of distinct terms. A block's
signatures are kept bit-sliced: row r of the matrix is bit r of every document's signature. For each term a document
sets ``PROBES`` bits, and other bits again for "twice or more" and "four times or more", so that the slices of a term
tell, with errors on the high side only, in which documents it is and about how often. ``BITS`` bits for each entry keep false
hits near 3 %. Beside its slices a block has its documents' lengths, highest counts and forward lists (term and count).

Search. For every term of the queries, the slices of its probes are intersected; a document's upper bound for an item is
the sum of the item's weights over those intersections, each times the most that such a count can be worth at
the document's length. A task keeps the 20 best exact scores of each item over its blocks; documents whose bound is below the
20th of them are provably no better and are passed over, all others are scored exactly from their forward lists. What the
tasks found is cut to 20 for each item in salted groups, then as a whole. No document is lost: a passed-over one has 20 better ones in its own task.

Queries. Items are dealt into chunks of about ``CHUNK_BYTES`` of text (an item is never cut), and each chunk is one pass over the
index; a task is sent one chunk, whatever the number of items. A chunk's document frequencies are summed from the blocks first.

Terms are compared by 64-bit hashes; two of q query terms and v distinct terms of a corpus are taken for one with a
probability of about q * v / 2**64.

Edge cases: a null or empty text has no terms, counts in no statistic and gets no row, and such an item gets no rows; repeated
rows are documents of their own, with ranks of their own; a null doc_id comes after all others of its score; items are told apart by
row, so repeated items give repeated rows; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm.batches import filled, give_back, hashes_of, mixed, owner_of, slices, without_empty

TOP = 20
BITS, PROBES = 8, 3
BLOCK_DOCS = 1024
BLOCKS_PER_TASK = 32
CHUNK_BYTES = 1 << 18
SALTS = 16
LEVELS = (1, 2, 4)  # counts that have bits of their own
SAMPLE = 64  # documents of the highest bounds are scored first, to raise the limit for the others
NO_ID = np.iinfo(np.int64).max

# A-Z to a-z, every other ASCII character but 0-9 and a-z to a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts per text and the end, code of each term, distinct terms)."""
    plain = pa.array([t.encode().translate(FOLDED) for t in filled(texts).to_pylist()], pa.binary()).cast(pa.string())
    starts, flat = without_empty(pc.ascii_split_whitespace(plain))
    coded = flat.dictionary_encode()
    return starts, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def probes(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits, one row for each hash, that stand for terms which occur ``level`` times or more."""
    seeds = mixed(np.arange(1, PROBES + 1, dtype=np.uint64) + np.uint64(level << 8))
    return (mixed(hashes[:, None] ^ seeds) % np.uint64(bits)).astype(np.int64)


def signatures(n_docs: int, docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The bit-sliced signatures of entries (document, term, count): a row of packed documents for each bit."""
    matrix = np.zeros((bits, n_docs), bool)
    for level in LEVELS:
        some = counts >= level
        at = probes(hashes[some], level, bits)
        matrix[at.ravel(), np.repeat(docs[some], PROBES)] = True
    return np.packbits(matrix, axis=1)


def _packed(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", kind)


#: Arrays of a block: id and whether there is one, terms, highest count and entries of each document; hash and number of documents of each term;
#: term and count of each entry; slices.
ARRAYS = {"ids": np.int64, "named": bool, "sizes": np.int64, "highest": np.int64, "entries": np.int64, "terms": np.uint64, "dfs": np.int64, "codes": np.int32, "counts": np.int32, "slices": np.uint8}


def index(docs: DataFrame) -> DataFrame:
    """One row for each block of ``docs(doc_id, text)``: n_docs, n_terms, bits and its packed arrays."""

    def build(batches):
        for batch in slices(batches, "text"):
            starts, codes, terms = terms_of(batch.column("text"))
            sizes = np.diff(starts)
            hashes, width = hashes_of(terms), max(len(terms), 1)
            entries, counts = np.unique(owner_of(starts) * width + codes, return_counts=True)
            doc, term = np.divmod(entries, width)
            distinct = np.bincount(doc, minlength=len(sizes))
            ids = batch.column("doc_id")
            named, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            likes = np.ceil(np.log2(np.maximum(distinct, 32))).astype(np.int64)
            for like in np.unique(likes[sizes > 0]):
                group = np.flatnonzero((likes == like) & (sizes > 0))
                for first in range(0, len(group), BLOCK_DOCS):
                    yield block(group[first : first + BLOCK_DOCS], doc, term, counts, hashes, sizes, ids, named, distinct)
            give_back()

    def block(members, doc, term, counts, hashes, sizes, ids, named, distinct):
        place = np.full(len(sizes), -1, np.int64)
        place[members] = np.arange(len(members))
        own = np.flatnonzero(place[doc] >= 0)
        used, codes = np.unique(term[own], return_inverse=True)
        order = np.argsort(hashes[used])
        rank = np.empty(len(used), np.int64)
        rank[order] = np.arange(len(used))
        codes, found = rank[codes], hashes[used][order]
        at, times = place[doc[own]], counts[own]
        highest = np.zeros(len(members), np.int64)
        np.maximum.at(highest, at, times)
        marks = np.bincount(at, minlength=len(members)) + sum(np.bincount(at[times >= level], minlength=len(members)) for level in LEVELS[1:])
        bits = 1 << max(int(BITS * marks.max() - 1).bit_length(), 8)
        arrays = [
            ids[members], named[members], sizes[members], highest, distinct[members], found, np.bincount(codes, minlength=len(used)),
            codes, times, signatures(len(members), at, found[codes], times, bits),
        ]
        columns = [pa.array([_packed(x.astype(kind))], pa.binary()) for x, kind in zip(arrays, ARRAYS.values())]
        facts = [pa.array([x], pa.int64()) for x in (len(members), int(sizes[members].sum()), bits)]
        return pa.RecordBatch.from_arrays([*facts, *columns], ["n_docs", "n_terms", "bits", *ARRAYS])

    schema = "n_docs long, n_terms long, bits long, " + ", ".join(f"{c} binary" for c in ARRAYS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, schema)


def frequencies(blocks: DataFrame, asked: np.ndarray) -> np.ndarray:
    """Number of documents that hold each of the sorted term hashes ``asked``."""

    def count(batches):
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                terms = _unpacked(terms, np.uint64)
                at = np.minimum(np.searchsorted(terms, asked), max(len(terms) - 1, 0))
                held = np.flatnonzero(terms[at] == asked) if len(terms) else np.zeros(0, np.int64)
                total[held] += _unpacked(dfs, np.int64)[at[held]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = blocks.select("terms", "dfs").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    found = np.zeros(len(asked), np.int64)
    found[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return found


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a count is worth at a document's length, per unit of weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def bounds(slices_of: np.ndarray, bits: int, asked: np.ndarray, highest: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(terms x documents): the most that each term can be worth in each document, by the signatures alone."""
    n = len(highest)
    most = [worth(np.minimum(highest, step - 1), m) for step in LEVELS[1:]] + [worth(highest, m)]
    out, before = np.zeros((len(asked), n), np.float32), 0
    rows = np.arange(len(asked))
    for level, value in zip(LEVELS, most):
        at = probes(asked[rows], level, bits)
        both = slices_of[at[:, 0]]
        for j in range(1, PROBES):
            both = both & slices_of[at[:, j]]
        some = both.any(axis=1)
        rows, both = rows[some], both[some]
        out[rows] += np.unpackbits(both, axis=1, count=n) * (value - before).astype(np.float32)
        before = value
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by ascending id."""
    if len(scores) > 4 * top:
        limit = np.partition(scores, len(scores) - top)[len(scores) - top]
        some = np.flatnonzero(scores >= limit)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def passes(blocks: DataFrame, terms: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): at least the ``top`` best documents of each item, found task by task. ``weights`` has each item's places in
    the sorted hashes ``terms`` and their weights."""

    def search(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in weights]
        dense = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x = {c: _unpacked(row[c], kind) for c, kind in ARRAYS.items() if c != "dfs"}
                ids = np.where(x["named"], x["ids"], NO_ID)
                m = 100 - 25 + (25 * x["sizes"] * n_docs) // n_terms
                limits = bounds(x["slices"].reshape(row["bits"], -1), row["bits"], terms, x["highest"], m)
                # entries of asked terms alone
                at = np.minimum(np.searchsorted(terms, x["terms"]), len(terms) - 1)
                asked = np.where(terms[at] == x["terms"], at, -1)[x["codes"]]
                some = np.flatnonzero(asked >= 0)
                owner = np.repeat(np.arange(len(ids)), x["entries"])[some]
                asked, value = asked[some], worth(x["counts"][some].astype(np.int64), m[owner])
                starts = np.searchsorted(owner, np.arange(len(ids) + 1))

                def exact(docs):
                    sizes = starts[docs + 1] - starts[docs]
                    ends = np.cumsum(sizes)
                    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[docs] - ends + sizes, sizes)
                    total = np.concatenate([[0], np.cumsum(dense[asked[entry]] * value[entry])])
                    return total[ends] - total[ends - sizes]

                for i, (places, w) in enumerate(weights):
                    if not len(places):
                        continue
                    bound = w.astype(np.float32) @ limits[places]
                    bound = bound.astype(np.float64) * (1 + 1e-4) + 1  # more than float32 can be off
                    scores, held = best[i]
                    floor = scores[-1] if len(scores) == top else 1
                    open_ = np.flatnonzero(bound >= floor)
                    if not len(open_):
                        continue
                    dense[places] = w
                    parts = [open_]
                    if len(open_) > 2 * SAMPLE:
                        high = np.argpartition(bound[open_], len(open_) - SAMPLE)
                        parts = [open_[high[-SAMPLE:]], open_[high[:-SAMPLE]]]
                    for part in parts:
                        floor = scores[-1] if len(scores) == top else 1
                        part = part[bound[part] >= floor]
                        found = exact(part)
                        good = found >= floor
                        all_scores, all_ids = np.concatenate([scores, found[good]]), np.concatenate([held, ids[part[good]]])
                        keep = best_of(all_scores, all_ids, top)
                        scores, held = all_scores[keep], all_ids[keep]
                    best[i] = scores, held
                    dense[places] = 0
                del x, limits
                give_back()
        for i, (scores, held) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i)), pa.array(held, mask=held == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return blocks.mapInArrow(search, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    blocks = cut_lineage(index(docs))
    n_blocks, n_docs, n_terms = blocks.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first()
    tasks = -(-n_blocks // BLOCKS_PER_TASK)
    named = cut_lineage(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("key")))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(-(-size // chunk_bytes), 1)
    kind = named.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for chunk in range(chunks if n_blocks else 0):
        rows = named.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == chunk).select("key", "item_id", "text").toArrow()
        if not rows.num_rows:
            continue
        starts, codes, terms = terms_of(rows.column("text").combine_chunks())
        hashes = hashes_of(terms)
        order = np.argsort(hashes)
        df = frequencies(blocks, hashes[order])
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        held = np.flatnonzero(df)
        place = np.full(len(hashes), -1)
        place[order[held]] = np.arange(len(held))
        weights = []
        for a, b in zip(starts[:-1], starts[1:]):
            used, times = np.unique(place[codes[a:b]], return_counts=True)
            used, times = used[used >= 0], times[used >= 0]
            weights.append((used, weight[held][used] * times))
        if not len(held):
            continue
        found = passes(blocks.coalesce(tasks), hashes[order][held], weights, n_docs, n_terms, top)
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        for by in (["item", "salt"], ["item"]):
            ranked = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
        asked = spark.createDataFrame(pa.table({"item": pa.array(np.arange(rows.num_rows)), "item_id": rows.column("item_id")}))
        result = result.union(cut_lineage(found.join(asked, "item").select("item_id", "rank", "doc_id", "score")))
    return result


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), sized AS (SELECT row, doc_id, len(words)::BIGINT AS n, words FROM docs WHERE len(words) > 0
), sums AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized
), entries AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(words) AS term FROM sized) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM entries, sums GROUP BY term
), asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, * FROM benchmark)) GROUP BY ALL
), scored AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN entries USING (term) JOIN sized USING (row), sums GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""

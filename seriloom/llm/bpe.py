"""Byte-level BPE by a global distinct-word shuffle.

A *unit* is a run of white space with the run of other characters after it (or a part of one that
the pattern can never match across), so that every match of the pre-token pattern lies inside one
unit and can be found in it alone. Encoding takes these steps:

1. Texts are exploded into units. A block of documents keeps its positions as codes into the
   block's own list of distinct units: the positions of a unit are gathered before anything moves.
2. The distinct units of all blocks are shuffled by a hash of the unit, packed by (block, bucket);
   the task of a bucket encodes each of its distinct units once.
3. The ids go back to the blocks they came from and are put in place by position.

A frequent word is sent once for each block, not once for each use, so no key is hot. A task holds
one block, or the distinct units of one bucket; ``buckets`` grows with the shuffle partitions.

Both sides of step 3 read ``docs``, so it must be a stored table (or give the same rows in the
same order each time); a digest of each block's units is compared, and a difference is an error.

Decoding joins ids with the token-byte table. The table has one row for each id of the
vocabulary, a number fixed by the vocabulary file (50,256 here), so it is sent to every task.

Edge cases: a null text is an empty text and has no ids; a null id column value decodes to empty
bytes; repeated rows and null doc_ids are kept row by row; an id that the vocabulary lacks is an
error. Extra columns are ignored by ``encode``; ``decode`` keeps the columns named in ``keep``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriloom.llm.batches import filled, give_back, hashes_of, slices, without_empty

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20

# The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "\x1f"


def units_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(starts per text and the end, units): units of a text, joined, are the text."""
    texts = filled(texts)
    # single spaces and line ends between other characters: plain splits do
    odd = pc.match_substring_regex(texts, f"[{WHITE}][{WHITE}]|{MARK}").to_numpy(zero_copy_only=False)
    plain = pc.replace_substring(texts.filter(pa.array(~odd)), " ", f"{MARK} ")
    plain = pc.split_pattern(pc.replace_substring(plain, "\n", f"{MARK}\n{MARK}"), MARK)
    if odd.any():
        unit = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        other = pa.array([unit.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()], plain.type)
        order = np.empty(len(odd), np.int64)
        order[~odd] = np.arange((~odd).sum())
        order[odd] = np.arange(odd.sum()) + (~odd).sum()
        plain = pa.concat_arrays([plain, other]).take(pa.array(order))
    return without_empty(plain)


def packed(codes: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8)
    return planes.reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _blocks(batches, buckets: int, block_bytes: int):
    """(block number, rows, starts, codes, distinct units, bucket of each, digest) of a task's documents."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", block_bytes):
        starts, units = units_of(batch.column("text"))
        coded = units.dictionary_encode()
        hashes = hashes_of(coded.dictionary)
        digest = int(hashes.sum(dtype=np.uint64).view(np.int64)) ^ len(units)
        yield block, batch, starts, coded.indices.to_numpy(), coded.dictionary, (hashes % np.uint64(buckets)).astype(np.int64), digest
        block += 1


def positions(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: its doc_ids, units of each document, code of each unit, bucket of each code."""

    def pack(batches):
        for block, batch, starts, codes, words, bucket, digest in _blocks(batches, buckets, block_bytes):
            row = {
                "block": block,
                "digest": digest,
                "doc_ids": batch.column("doc_id").to_pylist(),
                "n": [len(codes), len(words)],
                "lengths": packed(np.diff(starts)),
                "codes": packed(codes),
                "buckets": packed(bucket),
            }
            yield pa.RecordBatch.from_pylist([row], schema)

    names = ["block", "digest", "doc_ids", "n", "lengths", "codes", "buckets"]
    kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 3
    schema = pa.schema(list(zip(names, kinds)))
    ddl = "block long, digest long, doc_ids array<long>, n array<long>, lengths binary, codes binary, buckets binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, ddl)


def distinct_units(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, block, digest, n, lengths, words): a block's distinct units by bucket, in the order of their codes."""

    def pack(batches):
        for block, _, _, _, words, bucket, digest in _blocks(batches, buckets, block_bytes):
            order = np.argsort(bucket, kind="stable")
            words = words.cast(pa.binary()).take(pa.array(order)).to_pylist()
            ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            rows = []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                own = words[ends[k] : ends[k + 1]]
                joined = pa.Codec("zstd").compress(b"".join(own), asbytes=True)
                rows.append((k, block, digest, len(own), packed(np.array([len(w) for w in own])), joined))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

    names = ["bucket", "block", "digest", "n", "lengths", "words"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])))
    ddl = "bucket int, block long, digest long, n long, lengths binary, words binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, ddl)


def _encoder(vocabulary: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_units(units: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(block, bucket, digest, n, lengths, ids): every distinct unit of a bucket is encoded once."""

    def encode(batches):
        encoder, known, of = None, {}, None
        for batch in batches:
            encoder = encoder or _encoder(vocabulary, pattern)
            for row in batch.to_pylist():
                if row["bucket"] != of:  # rows come sorted by bucket
                    known, of = {}, row["bucket"]
                ends = np.cumsum(unpacked(row["lengths"], row["n"]))
                joined = pa.Codec("zstd").decompress(row["words"], int(ends[-1]), asbytes=True)
                found, start = [], 0
                for end in ends.tolist():
                    word = joined[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoder.encode_ordinary(word.decode("utf-8"))
                    found.append(ids)
                    start = end
                flat = np.fromiter((i for ids in found for i in ids), np.int64)
                done = (row["block"], of, row["digest"], [len(found), len(flat)], packed(np.array([len(x) for x in found])), packed(flat))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, done))], schema)
        known.clear()
        give_back()

    names = ["block", "bucket", "digest", "n", "lengths", "ids"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()])))
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = units.repartition(n, "bucket").sortWithinPartitions("bucket")
    return runs.mapInArrow(encode, "block long, bucket int, digest long, n array<long>, lengths binary, ids binary")


def put_in_place(_key, rows, dictionary):
    """(doc_id, ids) of a block from its positions and the ids of its distinct units."""
    row = rows.to_pylist()[0]
    n_units, n_words = row["n"]
    parts = sorted(dictionary.to_pylist(), key=lambda x: x["bucket"])
    if any(x["digest"] != row["digest"] for x in parts) or sum(x["n"][0] for x in parts) != n_words:
        raise ValueError("docs gave other rows when it was read again; store it first")
    sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if parts:
        sizes = np.concatenate([unpacked(x["lengths"], x["n"][0]) for x in parts])
        ids = np.concatenate([unpacked(x["ids"], x["n"][1]) for x in parts])
    # units lie bucket by bucket; inside a bucket they follow the codes
    order = np.argsort(unpacked(row["buckets"], n_words), kind="stable")
    first, size = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
    first[order], size[order] = np.cumsum(sizes) - sizes, sizes
    codes = unpacked(row["codes"], n_units)
    long = size[codes]
    ends = np.concatenate([[0], np.cumsum(long)])
    at = np.repeat((first[codes] - ends[:-1]).astype(np.int32), long)
    at += np.arange(len(at), dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum(unpacked(row["lengths"], len(row["doc_ids"])))])
    lists = pa.ListArray.from_arrays(pa.array(ends[starts], pa.int32()), pa.array(ids[at].astype(np.int32)))
    del at, long, ends, codes, ids
    give_back()
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": lists})


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``.

    ``vocabulary_path`` names a rank file that the driver can read; its content goes to the tasks.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = positions(docs, buckets, block_bytes).groupBy("block")
    right = encode_units(distinct_units(docs, buckets, block_bytes), vocabulary, pattern).groupBy("block")
    return left.cogroup(right).applyInArrow(put_in_place, "doc_id long, ids array<int>")


def token_bytes(vocabulary_path: str) -> dict[int, bytes]:
    """The token-byte table: id to bytes."""
    import base64

    with open(vocabulary_path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def joined_bytes(ids: pa.Array, table: pa.Array) -> list[pa.Buffer | bytes]:
    """Bytes of each list of ids, by taking the rows of the table."""
    flat = ids.flatten()
    if len(flat) and (pc.max(flat).as_py() >= len(table) or pc.min(flat).as_py() < 0):
        raise ValueError("an id is not in the vocabulary")
    taken = table.take(flat)
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    at, data = np.zeros(1, np.int64), memoryview(b"")
    if len(taken):
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :]
        data = memoryview(taken.buffers()[2])
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return [data[at[a] : at[b]] for a, b in zip(ends[:-1], ends[1:])]


def byte_table(vocabulary_path: str) -> pa.Array:
    known = token_bytes(vocabulary_path)
    return pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.large_binary())


def decode(encoded: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded`` (binary): ids joined with the token-byte table."""
    table = byte_table(vocabulary_path)

    def join(batches):
        for batch in batches:
            parts = [bytes(x) for x in joined_bytes(batch.column("ids"), table)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(parts, pa.binary())], [*keep, "decoded"]
            )

    kept = [f for f in encoded.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(kept, key=lambda f: keep.index(f.name)))
    return encoded.select(*keep, *([] if "ids" in keep else ["ids"])).mapInArrow(join, f"{schema}, decoded binary")


def digests(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``decode`` and both digests."""
    both = decode(encoded, vocabulary_path, ("doc_id", "ids"))
    ids_text = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_text.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

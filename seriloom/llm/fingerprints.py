"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame operations only.

Sketch. A document's set has its distinct 5-word shingles (words as they are, one space between them). Each shingle is
hashed to 60 bits by a digest, and the ``k`` least hashes, ascending, are the sketch. A set of fewer than k
shingles is kept whole, so what is told of small sets is exact.

Merging. The sketch of a union is the k least hashes of both sketches (``merged``), so parts of a document, or
documents of a group, are sketched apart and brought together by ``merge_parts``; its rows are cut to k per salted key
before a key's rows meet.

Estimates. Among the k least hashes of the union, the share that both sketches hold is the ``resemblance``
(standard error at most 0.5 / sqrt(k)). ``distinct`` is (k - 1) over the k-th hash as a fraction of the hash range, and
``containment`` of A in B is the resemblance times the union's number of shingles over A's. Two empty sets are equal (1.0).

Neighbours. ``next_of`` finds each document's next one by descending doc_id without a window over all: ids are dealt
into ranges, and the ends of the ranges are linked.

Edge cases: a null text is empty and has an empty fingerprint; fewer than five words are one shingle; a text without
words equals every other such text; rows with one doc_id are one link of the ring, their text there is the one with
the least beginning (as long as is needed) and sketch; null doc_ids are the last document; a single
document is its own next; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage

K = 128
SHINGLE = 5
HEX_DIGITS = 15  # of a hash
RANGE = float(16**HEX_DIGITS)
SALTS = 64


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The shingles of a text in order, or its few words as one."""
    clean = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    runs = F.regexp_extract_all(clean, F.lit(f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{size - 1}}}))"), F.lit(1))
    few = F.filter(F.array(clean), lambda x: x != "")
    return F.when(F.regexp_count(clean, F.lit(" ")) >= size - 1, runs).otherwise(few)


def sketch(text: Column, k: int = K) -> Column:
    """The ``k`` least hashes of a text's shingles, ascending."""

    def hashed(shingle: Column) -> Column:
        return F.conv(F.substring(F.md5(shingle), 1, HEX_DIGITS), 16, 10).cast("long")

    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles(text), hashed))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, column): one sketch for each key, of all sketches that ``parts`` has for it."""
    hashes = parts.select(key, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    for by in ([key, "salt"], [key]):  # a key's hashes are cut in salted groups first
        hashes = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("place") <= k)
    lists = hashes.groupBy(F.col(key).alias("of")).agg(F.sort_array(F.collect_list("h")).alias(column))
    keys = parts.select(key).distinct().join(lists, F.col(key).eqNullSafe(F.col("of")), "left")
    return keys.select(key, F.coalesce(column, F.array().cast("array<long>")).alias(column))


def _union(a: Column, b: Column, k: int) -> Column:
    everything = F.sort_array(F.array_union(a, b))
    return F.when((F.size(a) < k) & (F.size(b) < k), everything).otherwise(F.slice(everything, 1, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over size of the union."""
    union = _union(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * RANGE / F.greatest(F.element_at(a, -1), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second one holds."""
    union = _union(a, b, k)
    whole = F.when((F.size(a) < k) & (F.size(b) < k), F.size(union).cast("double")).otherwise(distinct(union, k))
    share = resemblance(a, b, k) * whole / distinct(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def spelt(a: Column) -> Column:
    """A sketch as a string: its hashes in hex digits of a fixed width."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HEX_DIGITS, "0")), "")


def next_of(ids: DataFrame) -> DataFrame:
    """``ids``, which has distinct doc_ids, with next_id: the next lower doc_id, or the highest after the last. Null is the last one."""
    dealt = cut_lineage(ids.repartitionByRange("doc_id").withColumn("stretch", F.spark_partition_id()))
    ends = dealt.groupBy("stretch").agg(F.max(F.struct("doc_id")).alias("end"))
    # one row for each range
    along = Window.partitionBy(F.lit(0)).orderBy("stretch")
    highest = F.last("end").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("stretch", F.coalesce(F.lag("end").over(along), highest).alias("before"))
    inside = Window.partitionBy("stretch").orderBy(F.asc_nulls_first("doc_id"))
    placed = dealt.withColumn("previous", F.lag(F.struct("doc_id")).over(inside)).join(ends, "stretch")
    return placed.select(*ids.columns, F.coalesce("previous", "before")["doc_id"].alias("next_id"))


def _keyed(rows: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` with the columns KEY: a doc_id, whether it is null, and a salt that parts the rows of the null one."""
    return rows.withColumns({"key": F.coalesce(key, F.lit(0)), "absent": F.col(key).isNull(), "salt": salt})


def _every_salt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that each meet one salt of the null key's."""
    salts = F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return _keyed(rows, key, F.explode(salts))


KEY = ["key", "absent", "salt"]


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the beginning of the next document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = _keyed(given, "doc_id", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0).cast("int"))
    third = F.expr("char_length(text) div 3").cast("int")
    ring = cut_lineage(next_of(given.groupBy("doc_id").agg(F.max(third).alias("most"))))

    # both joins use the same columns of ``given``, so its one exchange serves them both
    # each document goes to the one before it: as much of its beginning as is needed there, and its sketch
    wanted = _every_salt(ring.select(F.col("doc_id").alias("to"), "most", "next_id"), "next_id").select("to", "most", *KEY)
    sent = given.join(wanted, KEY)
    sent = sent.select("to", F.struct(F.expr("substring(text, 1, most)").alias("beginning"), sketch(F.col("text"), k).alias("sketch"), F.col("doc_id").alias("next_id")).alias("following"))
    sent = _every_salt(sent, "to").groupBy(*KEY).agg(F.min("following").alias("following"))

    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 3), substring(following.beginning, 1, cast(char_length(text) div 3 as int)))")
    met = given.join(sent, KEY).select("doc_id", "text", edited.alias("edited"), F.col("following.sketch").alias("s_next"), F.col("following.next_id").alias("next_id"))
    made = met.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("s"), sketch(F.col("edited"), k).alias("s_edited"), "s_next", "next_id",
    )
    s, s_edited, s_next = F.col("s"), F.col("s_edited"), F.col("s_next")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelt(s).alias("fingerprint"),
        spelt(s_edited).alias("edited_fingerprint"),
        resemblance(s, s_edited, k).alias("near_edited"),
        resemblance(s, s_next, k).alias("near_next"),
        F.round(distinct(s, k)).cast("long").alias("n_shingles"),
        containment(s, s_edited, k).alias("held_by_edited"),
        "next_id",
    )


def sql(k: int = K) -> str:
    """The rows of ``compare_with_edits`` of distinct doc_ids, as DuckDB SQL."""
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), linked AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, CASE WHEN lead(text) OVER w IS NULL THEN first_value(doc_id) OVER w ELSE lead(doc_id) OVER w END AS next_id
  FROM docs WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)
), texts AS (
  SELECT doc_id, next_id, n, text, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) AS edited FROM linked
), words AS (
  SELECT doc_id, 0 AS kind, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts
  UNION ALL SELECT doc_id, 1, regexp_extract_all(edited, '[^\\x20\\x09-\\x0D]+') FROM texts
), sketches AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE}
    THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: substr(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), 1, {HEX_DIGITS}))
    WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, {HEX_DIGITS})] ELSE [] END))[1:{k}] AS s FROM words
), met AS (
  SELECT t.*, a.s, b.s AS e, c.s AS x FROM texts t JOIN sketches a ON a.kind = 0 AND a.doc_id IS NOT DISTINCT FROM t.doc_id
  JOIN sketches b ON b.kind = 1 AND b.doc_id IS NOT DISTINCT FROM t.doc_id JOIN sketches c ON c.kind = 0 AND c.doc_id IS NOT DISTINCT FROM t.next_id
), united AS (
  SELECT *, CASE WHEN len(s) < {k} AND len(e) < {k} THEN list_sort(list_distinct(s || e)) ELSE list_sort(list_distinct(s || e))[1:{k}] END AS se,
    CASE WHEN len(s) < {k} AND len(x) < {k} THEN list_sort(list_distinct(s || x)) ELSE list_sort(list_distinct(s || x))[1:{k}] END AS sx FROM met
), figures AS (
  SELECT *, CASE WHEN len(se) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(se, list_intersect(s, e))) / len(se) END AS near_edited,
    CASE WHEN len(sx) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sx, list_intersect(s, x))) / len(sx) END AS near_next,
    CASE WHEN len(s) < {k} THEN len(s)::DOUBLE ELSE {k - 1} * {RANGE!r}::DOUBLE / greatest(('0x' || s[{k}])::BIGINT, 1) END AS d,
    CASE WHEN len(s) < {k} AND len(e) < {k} THEN len(se)::DOUBLE WHEN len(se) < {k} THEN len(se)::DOUBLE
      ELSE {k - 1} * {RANGE!r}::DOUBLE / greatest(('0x' || se[{k}])::BIGINT, 1) END AS du FROM united
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
  near_edited, near_next, round(d)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN 1.0::DOUBLE ELSE least(near_edited * du / d, 1.0::DOUBLE) END AS held_by_edited, next_id
FROM figures
"""

"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark SQL functions only.

A sketch is the sorted array of the k smallest distinct hashes of five-word shingles.
Sketches of parts merge into that of the whole; two sketches estimate resemblance and
containment, one estimates its number of distinct shingles. Below k shingles all three
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import NULL_ID, materialize, pick, public_id

K, SHINGLE = 128, 5
BUCKET_BITS = 8
#: Texts of one id are dealt into windows by so many bits of their hashes.
CHAIN_BITS = 16


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of the word shingles, in order; fewer words are one shingle, no words none."""
    hashed = F.transform(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    # the array is bound once, as the only element of an outer array: it is not computed again for each shingle
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    one = lambda h: F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    none = F.array().cast("array<long>")
    return F.flatten(F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= words, many(h)).when(F.size(h) > 0, one(h)).otherwise(none)))


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    return smallest(shingle_hashes(text, words), k)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; two empty sketches are alike, one empty is unlike."""
    both = F.array_intersect(a, b)
    joined = F.transform(F.array(merge(a, b, k)), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u)))
    return F.element_at(joined, 1)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """The sketch as hexadecimal text: 16 digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_lower(ids: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc, next): for every id the next one downwards, the largest after the smallest.

    Works level by level on buckets of ids, each 2 ** ``bits`` times wider than the last: within a
    bucket by a window, across buckets through their largest and smallest ids, of which
    there are that many times fewer at each level. No window spans the whole table.
    """
    span = ids.agg(F.min("doc"), F.max("doc")).first()
    if span[0] is None:
        return ids.select("doc", F.col("doc").alias("next"))
    low, high = span
    # at each level a node is a bucket of the last: (lo, hi) are its smallest and largest ids
    level = ids.select("doc").distinct().select(F.col("doc").alias("lo"), F.col("doc").alias("hi"), F.col("doc").alias("at"))
    pairs, width = None, 1
    while True:
        w = Window.partitionBy(F.shiftright("at", bits)).orderBy(F.col("at").desc())
        step = level.withColumn("next", F.lead("hi").over(w))
        found = step.where("next is not null").select(F.col("lo").alias("doc"), "next")
        pairs = found if pairs is None else pairs.unionByName(found)
        width <<= bits
        # buckets below and above zero never become one: the last of each sign are joined by hand
        if low // width == high // width:
            break
        if low // width == -1 and high // width == 0:
            ends = ids.agg(F.min(F.when(F.col("doc") >= 0, F.col("doc"))), F.max(F.when(F.col("doc") < 0, F.col("doc")))).first()
            pairs = pairs.unionByName(ids.sparkSession.createDataFrame([tuple(ends)], "doc long, next long"))
            break
        level = level.groupBy(F.shiftright("at", bits).alias("up")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi", F.col("up").alias("at"))
    around = ids.sparkSession.createDataFrame([(low, high)], "doc long, next long")
    return pairs.unionByName(around)


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch, n_shingles) of every row; equal texts have equal sketches, null counts as empty."""
    s = F.col("sketch")
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), sketch(F.coalesce(F.col("text").cast("string"), F.lit("")), k, words).alias("sketch"))
    return rows.withColumn("n_shingles", distinct_shingles(s, k))


def _chains(rows: DataFrame, bits: int = CHAIN_BITS) -> tuple[DataFrame, DataFrame]:
    """(ends, inside) of rows that share ids: each id's first and last text, and all its rows but the last with the text after each.

    Texts of an id stand in order of their hash. Of rows with one id and text, all but one
    are followed by their own text; the others go to windows of 2 ** -``bits`` of an id's
    texts, whose ends are joined by their hashes alone. So no window holds all of an id.
    """
    # written, so that a row's number is the same wherever it is used
    rows = materialize(rows.withColumns({"h": F.xxhash64("text"), "u": F.monotonically_increasing_id()}), "shared-ids")
    last = rows.groupBy("doc", "h").agg(F.max("u").alias("last"))
    rows = rows.join(last, ["doc", "h"])
    again = rows.where("u <> last").select("doc", "text", F.col("text").alias("after"))
    once = rows.where("u = last").select("doc", "h", "text", F.shiftright("h", 64 - bits).alias("hb"))
    w = Window.partitionBy("doc", "hb").orderBy("h")
    near = once.withColumns({"after": F.lead("text").over(w), "nth": F.row_number().over(w)})
    heads = near.where("nth = 1").select("doc", "hb", F.col("text").alias("head"))
    steps = heads.select("doc", "hb").withColumn("up", F.lead("hb").over(Window.partitionBy("doc").orderBy("hb")))
    first = heads.join(heads.groupBy("doc").agg(F.min("hb").alias("hb")), ["doc", "hb"]).select("doc", F.col("head").alias("text"))
    ends = near.where("after is null").select("doc", "hb", "text").join(steps, ["doc", "hb"])
    jumps = ends.where("up is not null").join(heads.select("doc", F.col("hb").alias("up"), F.col("head").alias("after")), ["doc", "up"]).select("doc", "text", "after")
    inside = near.where("after is not null").select("doc", "text", "after").unionByName(jumps).unionByName(again)
    tails = ends.where("up is null").select("doc", "text")
    return first.join(tails.withColumnRenamed("text", "tail"), "doc"), inside


def edited_neighbours(docs: DataFrame, k: int = K, words: int = SHINGLE, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text replaces the last floor(n_chars / 3) code points by the first as
    many (or all) of the document next in descending id; after the last comes the first.
    Rows go once by id bucket, where a window finds the next row; only the smallest id
    of each bucket is looked up elsewhere. Rows that share an id follow each other in the
    order of their texts' hashes, and don't meet in one window; null ids come after all
    others; a null text counts as empty; a lone row is its own neighbour. Long texts are
    one row like others. Other columns, whatever their names, are ignored; an empty table
    gives no rows.
    """
    rows = pick(docs, doc=id_col, text=text_col).select(
        F.coalesce(F.col("doc").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    shared = rows.groupBy("doc").count().where("count > 1").select("doc")
    inside = None
    ends = rows.withColumn("tail", F.lit(None).cast("string"))  # of an id with one row that is its text
    if not shared.isEmpty():  # ids that several rows have are taken as one row, with the texts at both its ends
        first, inside = _chains(rows.join(shared, "doc", "left_semi"))
        ends = ends.join(shared, "doc", "left_anti").unionByName(first)
    ends = ends.withColumn("b", F.shiftright("doc", bits))
    w = Window.partitionBy("b").orderBy(F.col("doc").desc())
    near = ends.withColumns({"after": F.lead("text").over(w), "nth": F.row_number().over(w)})
    # the first row of each bucket, for the last row of the bucket above it
    heads = near.where("nth = 1").select(F.col("b").alias("hb"), F.col("text").alias("head"))
    above = next_lower(rows.select(F.shiftright("doc", bits).alias("doc")).distinct(), bits).select(F.col("doc").alias("b"), F.col("next").alias("hb"))
    own = F.coalesce("tail", "text").alias("text")
    open_ends = near.where("after is null").select("b", "doc", own)
    closed = open_ends.join(above, "b").join(heads, "hb").select("doc", "text", F.col("head").alias("after"))
    both = near.where("after is not null").select("doc", own, "after").unionByName(closed)
    if inside is not None:
        both = both.unionByName(inside)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("after", F.lit(1), cut)))
    done = both.select(
        "doc",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, words).alias("s"),
        sketch(F.col("edited"), k, words).alias("e"),
        sketch(F.col("after"), k, words).alias("x"),
    )
    return done.select(
        public_id("doc").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("x"), k).alias("near_next"),
    )

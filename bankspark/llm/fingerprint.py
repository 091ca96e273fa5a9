"""Order MinHash fingerprints with DataFrame functions only.

A text's words (A-Z lower-cased, runs of non-separators) give overlapping word k-mers. A k-mer's
occurrences are numbered, and (k-mer, number) is hashed to one of 2 * TUPLES bins; the minimal
hash of each bin is kept with its place. Two bins make one tuple, in the order in which the
two k-mers stand in the text, and the tuple is hashed. Equal tuples thus mean that the two texts share the same
minimal k-mers in the same order, which falls with edit distance and not only with
the loss of common words.

Everything happens inside array expressions of one row: no row per k-mer is made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.shared import stage

TUPLES = 32
BINS = 2 * TUPLES
#: Bits of a word's place (Spark strings end at 2^31 bytes, so at 2^30 words), and of a hash next to bin and place.
PLACE = 30
VALUE = 64 - PLACE - (BINS - 1).bit_length()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BUCKET = 1_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _kmers(words: Column, k: int) -> Column:
    """Hash and place of every k-mer in one long; the whole of a shorter text is its only k-mer."""
    last = F.greatest(F.size(words) - k, F.lit(0))

    def one(i: Column) -> Column:
        h = F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        return F.shiftleft(h, PLACE).bitwiseOR(i.cast("long"))

    return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), one))


def _numbered(sorted_kmers: Column) -> Column:
    """Bin, hash of (k-mer, occurrence number) and place of every k-mer of a sorted array.

    The number of a repeated k-mer is its distance from the first equal one, found by halving steps
    that begin at the array's size.
    """
    powers = F.array(*[F.lit(1 << b) for b in range(PLACE - 1, -1, -1)])
    bits = F.length(F.bin(F.size(sorted_kmers)))

    def one(x: Column, j: Column) -> Column:
        kmer = F.shiftright(x, PLACE)
        again = F.coalesce(F.shiftright(F.get(sorted_kmers, j - 1), PLACE) == kmer, F.lit(False))

        def back(at: Column, step: Column) -> Column:
            to = at - step
            return F.when(F.coalesce(F.shiftright(F.get(sorted_kmers, to), PLACE) == kmer, F.lit(False)),
                          to).otherwise(at)

        first = F.aggregate(F.slice(powers, F.lit(PLACE + 1) - bits, bits), j, back)
        # halving steps reach the first equal one: each power of two is taken at most once
        number = F.when(again, j - first).otherwise(F.lit(0))
        h = F.xxhash64(kmer, number)
        bin_ = F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)).cast("long"), PLACE + VALUE)
        value = F.shiftleft(F.shiftrightunsigned(h, 64 - VALUE), PLACE)
        return bin_.bitwiseOR(value).bitwiseOR(x.bitwiseAND(F.lit((1 << PLACE) - 1)))

    return F.transform(sorted_kmers, one)


def _minima(ordered: Column) -> Column:
    """First entry of each bin of an array sorted by (bin, hash)."""
    shift = PLACE + VALUE
    return F.filter(ordered, lambda x, j: F.coalesce(
        F.shiftrightunsigned(F.get(ordered, j - 1), shift) != F.shiftrightunsigned(x, shift), F.lit(True)))


def _tuples(by_bin: Column) -> Column:
    """One hash per pair of bins in text order; null where both bins are empty."""
    value_of = lambda x: F.shiftright(x.bitwiseAND(F.lit((1 << (PLACE + VALUE)) - 1)), PLACE)
    place_of = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))

    def one(i: Column) -> Column:
        a, b = F.try_element_at(by_bin, 2 * i), F.try_element_at(by_bin, 2 * i + 1)
        swap = F.coalesce(place_of(a) > place_of(b), F.lit(False))
        h = F.xxhash64(F.when(swap, F.lit(1)).otherwise(F.lit(0)), value_of(a), value_of(b))
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), one)


def signatures(df: DataFrame, columns: dict[str, str], k: int = 3) -> DataFrame:
    """Add signature columns: ``columns`` maps text columns to names of arrays of 32-bit tuple hashes.

    An array of ``TUPLES`` entries, null where the text has no k-mer for the pair of bins. An
    empty, blank or null text has nulls only. The steps are separate projections, so that each array
    is made once and then read by position.
    """
    out = df
    tmp = {f"_a{i}": (text, name) for i, (text, name) in enumerate(columns.items())}
    for step in (lambda t, c: _words(F.col(c)), lambda t, c: F.sort_array(_kmers(F.col(t), k)),
                 lambda t, c: F.sort_array(_numbered(F.col(t))), lambda t, c: _minima(F.col(t)),
                 lambda t, c: F.map_from_arrays(F.transform(F.col(t), lambda x: F.shiftrightunsigned(
                     x, PLACE + VALUE).cast("int")), F.col(t)),
                 lambda t, c: _tuples(F.col(t))):
        out = out.withColumns({t: step(t, text) for t, (text, _) in tmp.items()})
    return out.withColumnsRenamed({t: name for t, (_, name) in tmp.items()})


def as_text(sig: Column) -> Column:
    """Fingerprint string: 8 hex digits per tuple, dashes for empty ones."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(
        F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("--------"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among those that one of the two has; 1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False))))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def _bucket(value: Column, limits: list[int]) -> Column:
    """Number of limits at or below ``value``, by halving steps over one constant array."""
    if not limits:
        return F.lit(0)
    # one text constant, folded to an array by the optimizer: the plan has no node per limit
    cuts = F.split(F.lit(",".join(map(str, limits))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(limits).bit_length() - 1, -1, -1)])

    def ahead(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(cuts, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), ahead)


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text, _bucket, _ghost: documents in buckets of consecutive ids, and in each bucket a ghost
    of the first document after it (after the last bucket: of the very first), so the successor
    of every document is in its own bucket.

    Order: doc_id (null first), then the hash of the text. Buckets are cut at approximate quantiles of
    doc_id (the cuts only balance the work). A bucket has ``rows_per_bucket`` rows, or the square root of all
    rows where that is more, so that neither the list of cuts nor a bucket outgrows the other: 1e10 documents
    give 1e5 cuts and buckets of 1e5 rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = d.count()
    parts = max(1, n // max(rows_per_bucket, math.isqrt(n)))
    cuts = d.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    limits = sorted({int(c) for c in cuts})
    d = d.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(F.col("doc_id"), limits)))
    d = d.withColumn("_order", F.xxhash64("text"))
    # first document of each bucket (one row per bucket), as a ghost of the bucket before it
    firsts = d.groupBy("_bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"),
                                                     F.col("_order").alias("o"))).alias("f"))
    ring = Window.orderBy("_bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(whole)).alias("_to"),
                           F.col("f.i").alias("_i"), F.col("f.o").alias("_o"))
    firsts = stage(firsts, "bucket-firsts")
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # three numbers a bucket, at most as many rows as the square root of the table's: 2 MB at 1e10 documents
    ghosts = (d.join(F.broadcast(firsts), (key == F.col("_i")) & (F.col("_order") == F.col("_o")))
              .groupBy("_to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"),
                                  F.first("_order").alias("_order"))
              .select("doc_id", "text", F.col("_to").alias("_bucket"), "_order", F.lit(1).alias("_ghost")))
    return d.withColumn("_ghost", F.lit(0)).unionByName(ghosts)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """Every document, its edited text and its successor compared by fingerprints.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all)
    of the next document in ascending doc_id (after the last: the first). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; empty texts have likeness 1 to each other and 0 to others; one document is its
    own successor; repeated ids follow each other; an empty table gives no rows.
    """
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_order")
    d = with_next(docs).withColumn("_next", F.lead("text").over(w))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    d = d.select("doc_id", "text", "_bucket", "_ghost", "_order", n.cast("long").alias("n_chars"),
                 edited.alias("_edited"))
    d = signatures(d, {"text": "_sig", "_edited": "_sig_edited"}, k)
    d = d.select("doc_id", "_bucket", "_ghost", "_order", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
                 "_sig", "_sig_edited").withColumn("_sig_next", F.lead("_sig").over(w))
    return d.where("_ghost = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_sig")).alias("fingerprint"),
        as_text(F.col("_sig_edited")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_sig_edited")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_sig_next")).alias("near_next"))

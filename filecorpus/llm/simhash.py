"""Document fingerprints (SimHash) with DataFrame functions only.

A term is two neighbouring words (lower case; the word itself in a text of one), and its
weight is how often it occurs. The 64-bit hashes of a term, one for each half of the
fingerprint, vote on every bit: a bit is set if terms with more than half of the weight have
it. To count votes, two bits of a hash are spread into the two halves of one integer, so 32
sums hold 64 counters of 32 bits and stay inside one hash aggregation.

Likeness of two fingerprints is the cosine that their share of differing bits estimates,
``cos(pi * differing / 128)``, from 0 (half or more differ) to 1 (equal).

``within_radius`` finds fingerprints by permuted block tables: cut into ``radius + key`` equal
blocks, two fingerprints that differ in at most ``radius`` bits agree in some ``key`` blocks,
so one table for each choice of ``key`` blocks, joined on them, finds every such pair.
"""

from __future__ import annotations

from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.llm.common import parts, query, table
from filecorpus.staging import stage

HALVES = (17, 71)  # seeds
BITS = 64 * len(HALVES)
LOW = 0xFFFFFFFF
ID_PART_ROWS = 200_000


def term_hashes(text: Column, seed: int) -> Column:
    """One hash for each occurrence of a term; a text without words has one, that of ''."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    one_less = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, 1, one_less),
        F.slice(words, 2, one_less),
        lambda a, b: F.xxhash64(F.lit(seed), a, b),
    )
    single = F.array(F.xxhash64(F.lit(seed), F.coalesce(F.get(words, F.lit(0)), F.lit(""))))
    return F.when(n > 1, pairs).otherwise(single)


def fingerprints(rows: DataFrame, texts: list[str], outputs: list[str]) -> DataFrame:
    """Replace each column of ``texts`` by its fingerprint, 32 hexadecimal digits.

    A null text counts as empty, and all texts without words share a fingerprint. Rows stay
    apart even if they are equal. Rows that are already dealt out by some of the other columns
    are not moved.
    """
    row, place, each = "__row", "__text", "__term"
    others = [c for c in rows.columns if c not in texts]
    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    # Both hashes of a term come from one: the second mixes the first once more.
    pieces = F.array(
        *(
            F.struct(
                F.lit(i).alias("place"),
                term_hashes(F.coalesce(F.col(c), F.lit("")), HALVES[0]).alias("terms"),
            )
            for i, c in enumerate(texts)
        )
    )
    by_text = numbered.select(row, *others, F.explode(pieces).alias("p"))
    terms = by_text.select(
        row, *others, F.col("p.place").alias(place), F.explode("p.terms").alias(each)
    ).withColumn("__second", F.xxhash64(F.lit(HALVES[1]), F.col(each)))
    spread = F.lit((1 << 32) | 1)
    votes = [
        F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(spread)).alias(f"__v{half}_{i}")
        for half, hashed in enumerate((each, "__second"))
        for i in range(32)
    ]
    counted = terms.groupBy(row, place, *others).agg(F.count("*").alias("__all"), *votes)
    printed = counted.select(
        row,
        place,
        *others,
        F.concat(*(_hex(_majority(half)) for half in range(len(HALVES)))).alias("__print"),
    )
    if len(texts) == 1:
        return printed.select(*others, F.col("__print").alias(outputs[0]))
    return (
        printed.groupBy(row, *others)
        .agg(
            *(
                F.max(F.when(F.col(place) == i, F.col("__print"))).alias(o)
                for i, o in enumerate(outputs)
            )
        )
        .drop(row)
    )


def _majority(half: int) -> Column:
    """The bits whose votes are more than half of all."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        votes = F.col(f"__v{half}_{i}")
        for at, count in (
            (i, votes.bitwiseAND(F.lit(LOW))),
            (i + 32, F.shiftrightunsigned(votes, 32)),
        ):
            one = F.shiftleft(F.lit(1).cast("long"), at)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("__all"), one).otherwise(F.lit(0)))
    return bits


def _hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def differing_bits(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return sum(
        (
            F.bit_count(_word(a, half).bitwiseXOR(_word(b, half)))
            for half in range(len(HALVES))
        ),
        start=F.lit(0),
    )


def _word(fingerprint: Column, half: int) -> Column:
    """One half as a long; ``conv`` gives the unsigned value, which two parts make signed."""
    digits = F.substring(fingerprint, 16 * half + 1, 16)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def likeness(a: Column, b: Column) -> Column:
    angle = differing_bits(a, b) * F.lit(pi / BITS)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.cos(angle), F.lit(0.0)))


def next_ids(docs: DataFrame, *, part_rows: int = ID_PART_ROWS) -> DataFrame:
    """``doc_id, next_id, n_chars`` for each distinct id, in ascending order (null first).

    After the last comes the first. ``n_chars`` is that of the longest text with the id. Only
    ids move: ranges of them are ordered each on its own, and of each range the first id
    goes to the range before.
    """
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    ids = docs.groupBy("doc_id").agg(F.max(length).alias("n_chars"))
    ids = stage(ids, "ids")
    ranged = stage(
        ids.repartitionByRange(parts(ids.count(), part_rows), "doc_id").withColumn(
            "part", F.spark_partition_id()
        ),
        "ordered-ids",
    )
    # A struct is not null where the id in it is, so the end of a range shows.
    within = Window.partitionBy("part").orderBy("doc_id")
    following = F.lead(F.struct("doc_id")).over(within)
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    by_part = Window.orderBy("part")  # one row for each range
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_next = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(by_part), F.first("first").over(every)).alias("wrap"),
    )
    return (
        ranged.withColumn("following", following)
        .join(of_next, "part")
        .select(
            "doc_id",
            F.coalesce("following", "wrap").getField("doc_id").alias("next_id"),
            "n_chars",
        )
    )


def with_edits(docs: DataFrame, following: DataFrame) -> DataFrame:
    """``doc_id, text, next_id, n_chars, edited`` and the columns of ``KEY``.

    ``edited`` is the text with its last quarter (rounded down) replaced by as many first
    characters of the next document's text, or by all of it if it is shorter. Rows that share an id are followed by the same
    document, and where several rows share the next id, the smallest beginning counts.
    """
    # The same columns on both ways, so that both share one shuffle.
    texts = docs.select(
        *_plain_key(F.col("doc_id")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    doc_id = F.when(~F.col(KEY[1]), F.col(KEY[0])).alias("doc_id")
    # Of the next text only what the edit needs goes on.
    wanted = following.select(
        F.col("doc_id").alias("to_id"),
        F.col("next_id"),
        F.floor(F.col("n_chars") / 4).alias("n"),
        *_plain_key(F.col("next_id")),
    )
    beginnings = (
        texts.join(wanted, KEY)
        .select("to_id", "next_id", F.expr("substring(text, 1, cast(n as int))").alias("beginning"))
        .groupBy("to_id", "next_id")
        .agg(F.min("beginning").alias("beginning"))
        .select(*_plain_key(F.col("to_id")), "next_id", "beginning")
    )
    joined = texts.join(beginnings, KEY)
    counted = joined.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "taken", F.floor(F.col("n_chars") / 4).cast("int")
    )
    edited = F.expr(
        "concat(substring(text, 1, cast(n_chars - taken as int)), substring(beginning, 1, taken))"
    )
    return counted.select(*KEY, doc_id, "text", "next_id", "n_chars", edited.alias("edited"))


# The columns by which rows with an id, null or not, meet. They stay with the rows, so what is
# grouped by them and more needs no further shuffle.
KEY = ["__id", "__no_id"]


def _plain_key(doc_id: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias(KEY[0]), doc_id.isNull().alias(KEY[1])]


def within_radius(
    queries: DataFrame, fingerprints_: DataFrame, radius: int = 3, key: int = 2
) -> DataFrame:
    """Pairs ``a, b, distance`` of distinct fingerprints that differ in at most ``radius`` bits.

    Both inputs have a column ``fingerprint``; null ones pair with nothing. Equal
    fingerprints are one row, whatever the number of documents, so groups of copies cost
    nothing; an equal pair is found too.
    """
    blocks = radius + key
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), key))

    def tables(df: DataFrame, name: str) -> DataFrame:
        distinct = df.filter("fingerprint is not null").select("fingerprint").distinct()
        bits = F.concat(
            *(
                F.lpad(F.conv(F.substring("fingerprint", 8 * i + 1, 8), 16, 2), 32, "0")
                for i in range(BITS // 32)
            )
        )
        cut = [F.substring("bits", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        keys = F.array(*(F.xxhash64(F.lit(t), *(cut[i] for i in c)) for t, c in enumerate(choices)))
        return distinct.withColumn("bits", bits).select(
            F.col("fingerprint").alias(name), F.explode(keys).alias("block")
        )

    distance = differing_bits(F.col("a"), F.col("b"))
    # Spark knows the size before rows are multiplied, and might broadcast by that.
    return (
        tables(queries, "a")
        .hint("merge")
        .join(tables(fingerprints_, "b"), "block")
        .withColumn("distance", distance)
        .filter(F.col("distance") <= radius)
        .select("a", "b", "distance")
        .distinct()
    )


def near_counts(documents: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint, n_near`` of the queries: the documents within the radius, all counted.

    Both inputs have a column ``fingerprint``. Copies are counted before anything is joined.
    """
    copies = documents.groupBy(F.col("fingerprint").alias("b")).agg(F.count("*").alias("n"))
    return (
        within_radius(queries, copies.select(F.col("b").alias("fingerprint")), radius)
        .join(copies, "b")
        .groupBy(F.col("a").alias("fingerprint"))
        .agg(F.sum("n").alias("n_near"))
    )


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to an edited and to the next text.

    Documents whose id is divisible by 50 also have the number of other documents whose
    fingerprint differs in at most three bits.
    """
    docs = table(spark, sf_dir, "documents")
    rows = with_edits(docs, next_ids(docs)).withColumn("edited_sha256", F.sha2("edited", 256))
    printed = stage(
        fingerprints(rows, ["text", "edited"], ["fingerprint", "edited_fingerprint"]),
        "fingerprints",
    )
    of_next = printed.groupBy(F.col("doc_id").alias("id")).agg(
        F.min("fingerprint").alias("next_fingerprint")
    )
    asked = F.col("doc_id") % 50 == 0
    near = near_counts(printed, printed.filter(asked).select("fingerprint"))
    # Only the documents that ask meet their counts.
    own = printed.filter(asked).select("doc_id", "fingerprint").join(near, "fingerprint")
    own = own.groupBy(F.col("doc_id").alias("asked_id"), F.col("fingerprint").alias("asked")).agg(
        (F.max("n_near") - 1).alias("n_near")
    )
    return (
        printed.join(of_next, F.col("next_id").eqNullSafe(F.col("id")))
        .join(
            own, (F.col("doc_id") == F.col("asked_id")) & (F.col("fingerprint") == F.col("asked")), "left"
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
            "n_near",
        )
    )

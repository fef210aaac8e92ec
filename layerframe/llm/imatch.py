"""Document fingerprints by I-Match with randomised lexicons.

Terms are words in lower case. The lexicon holds those within a band of inverse
document frequency. Randomised lexicons are nested: each level keeps half of
the terms of the one before, by hash, and each level is dealt into subsets.
All words of a text are looked up. A fingerprint begins with a hash of all
sorted distinct terms that the text has in the lexicon; then come its hashes
by subset at several levels. The first is that at which about two dozen of its
terms are left, by their number, or the sparsest below that at which any are;
the others are the sparser ones up to where a text of so many terms has hardly
any left, so that texts of any two lengths are compared at the densest level
that both have. A changed word spoils only the subset it is in.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table
from .common import small_side, text_or_empty

LOWEST_IDF = 3.0
HIGHEST_IDF = 6.9
SUBSETS = 32
LEVELS = 5
"""So many levels are hashed, from a text's own on."""
LEVEL_SHIFT = 4
"""Level 0 holds texts of fewer than 2 to this power (times 2) distinct terms."""


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; may hold empty strings."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def term_of(word: Column) -> Column:
    return F.xxhash64(word)


def lexicon(docs: DataFrame, lowest: float = LOWEST_IDF, highest: float = HIGHEST_IDF) -> DataFrame:
    """Hashes of the terms whose ln(documents / documents with it) is in a band.

    Terms of a single document are left out. The table is written. A term in the
    band is in at least a share e^-highest of the documents, so there are at
    most e^highest times the mean number of distinct terms of a document.
    """
    texts = docs.select(text_or_empty("text").alias("text"))
    words = texts.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counts = words.where("word <> ''").groupBy(term_of(F.col("word")).alias("term")).count()
    total = docs.agg(F.count("*").alias("total"))
    band = counts.crossJoin(F.broadcast(total)).where(
        (F.col("count") > 1)
        & (F.col("count") <= F.col("total") * exp(-lowest))
        & (F.col("count") >= F.col("total") * exp(-highest))
    )
    spark = docs.sparkSession
    return written_table(band.select("term"), new_shared_path(spark, "lexicon"))


def level_of(terms: Column) -> Column:
    """How often the lexicon is halved for a text of these distinct terms.

    By their number, and never so often that none of them is left.
    """
    most = F.length(F.bin(F.shiftright(F.size(terms).cast("long"), LEVEL_SHIFT))).cast("int") - 1
    left = F.filter(F.sequence(most, F.lit(0)), lambda level: F.exists(terms, lambda t: in_level(t, level)))
    return F.coalesce(F.get(left, F.lit(0)), F.lit(0))


def in_level(term: Column, level: Column) -> Column:
    return term.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1) == 0


def terms_at(terms: Column, level: Column) -> Column:
    return F.filter(terms, lambda t: in_level(t, level))


def hash_of(terms: Column) -> Column:
    """Eight hexadecimal digits for terms in order; none for no terms."""
    digits = F.substring(F.lpad(F.hex(F.xxhash64(terms)), 16, "0"), 9, 8)
    return F.when(F.size(terms) > 0, digits).otherwise(F.lit(""))


def hashes_of(terms: Column) -> Column:
    """The hash of the terms in each subset.

    ``terms`` has to be a column of the rows: subsets are taken of it in a lambda,
    where an expression is worked out anew each time.
    """

    def subset(i: Column) -> Column:
        return hash_of(F.filter(terms, lambda t: F.pmod(F.shiftright(t, 40), F.lit(SUBSETS)) == i))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), subset), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among those either text has, from 0 to 1.

    Compared is the level of the text with more terms, at which the other has
    hashes too, or has none of its terms left. Equal fingerprints are fully
    alike; empty ones are those of texts without words.
    """
    own, other = F.split(a, r"\|"), F.split(b, r"\|")
    gap = own[0].cast("int") - other[0].cast("int")

    def at_level(parts: Column, sparser: Column) -> Column:
        return F.split(F.coalesce(F.get(parts, sparser + 2), F.lit("")), ",")

    left = at_level(own, F.greatest(-gap, F.lit(0)))
    right = at_level(other, F.greatest(gap, F.lit(0)))
    pairs = F.transform(
        F.arrays_zip(left.alias("x"), right.alias("y")),
        lambda p: F.struct(F.coalesce(p["x"], F.lit("")).alias("x"), F.coalesce(p["y"], F.lit("")).alias("y")),
    )
    either = F.size(F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != "")))
    alike = F.size(F.filter(pairs, lambda p: (p["x"] != "") & (p["x"] == p["y"])))
    return F.when(a == b, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(alike / either)


def fingerprints(
    rows: DataFrame, keys: list[str], texts: list[str], terms: DataFrame, keep: list[str] | None = None
) -> DataFrame:
    """A fingerprint of each of several text columns, by unique keys.

    Returned are the keys, the columns ``keep`` and, for text column ``t``,
    ``t_fingerprint``. Null texts
    count as empty. A text without words of the lexicon is known by its other
    words; one without words has a fingerprint without hashes. ``terms`` is a written lexicon: broadcast if it is small, as its
    bound promises. Rows that are dealt out by some of the keys stay where they are.
    """
    keep = keep or []
    sides = F.array(
        *[F.struct(F.lit(i).alias("kind"), text_or_empty(t).alias("text")) for i, t in enumerate(texts)]
    )
    sided = rows.select(*keys, *keep, F.explode(sides).alias("side"))
    sided = sided.select(*keys, *keep, "side.kind", "side.text")
    # A null word comes first, so that texts without words keep their row.
    words = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(words_of(F.col("text"))))
    first = F.col("word").isNull() & (F.col("kind") == 0)
    looked = sided.select(*keys, *keep, "kind", F.explode(words).alias("word")).select(
        *keys, *[F.when(first, F.col(c)).alias(c) for c in keep],
        "kind", F.when(F.col("word").isNotNull(), term_of(F.col("word"))).alias("term"),
        (F.col("word") == "").alias("blank"),
    )
    looked = looked.where(F.col("term").isNull() | ~F.col("blank")).drop("blank")
    known = small_side(terms.withColumn("known", F.lit(True)))
    looked = looked.join(known, "term", "left")
    sums = [F.max(c).alias(c) for c in keep]
    for i, t in enumerate(texts):
        own = F.col("kind") == i
        sums += [
            F.collect_set(F.when(own & F.col("known"), F.col("term"))).alias(f"{t}_terms"),
            F.collect_set(F.when(own & F.col("known").isNull(), F.col("term"))).alias(f"{t}_others"),
        ]
    gathered = looked.groupBy(*keys).agg(*sums)
    chosen = gathered.select(
        *keys, *keep,
        *[
            F.when(F.size(f"{t}_terms") > 0, F.col(f"{t}_terms")).otherwise(F.col(f"{t}_others")).alias(f"{t}_terms")
            for t in texts
        ],
    )
    levelled = chosen.select("*", *[level_of(F.col(f"{t}_terms")).alias(f"{t}_level") for t in texts])
    # Columns one after the other, each from the one before, sorted once.
    levelled = levelled.withColumns({f"{t}_terms": F.array_sort(f"{t}_terms") for t in texts})
    for step in range(LEVELS):
        before = "terms" if not step else f"at_{step - 1}"
        levelled = levelled.withColumns(
            {f"{t}_at_{step}": terms_at(F.col(f"{t}_{before}"), F.col(f"{t}_level") + step) for t in texts}
        )
    return levelled.select(
        *keys, *keep,
        *[
            F.concat_ws(
                "|",
                F.col(f"{t}_level").cast("string"),
                hash_of(F.col(f"{t}_terms")),
                *[hashes_of(F.col(f"{t}_at_{step}")) for step in range(LEVELS)],
            ).alias(f"{t}_fingerprint")
            for t in texts
        ],
    )

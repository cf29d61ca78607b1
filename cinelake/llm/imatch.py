"""Document fingerprints by I-Match, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies within a band (an inverse-document-frequency band).  It is
dealt by hash into SUBSETS randomised subsets, so that each of its terms is in one of them.  A text's fingerprint has
one hash for each subset of which the text holds terms: the hash of these terms in order.

Terms are not joined with the lexicon one by one.  A text's terms have a document frequency of one at least, so what is
not in the lexicon stands above the band (a bounded list) or only in this text (few terms, with one holder each).  An
edited text has the terms of its two sources, and two words at most that its cuts made; only these are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_checkpoint

#: A term belongs to the subset that the first BITS bits of its hash name.
BITS = 9
SUBSETS = 1 << BITS
#: Terms below the band are those with a single holder.
LEAST_DOCS, MOST_SHARE = 2, 0.05
BLOCK = 512
SPACES = "[\\x09-\\x0D\\x20]+"
NO_ID = -(1 << 62)


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), SPACES)


def terms_of(text: Column) -> Column:
    """The hashed words of a text, and that of the empty word where white space stands at an end."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def all_terms_hash(text: Column) -> Column:
    """One hash of all sorted distinct words: the fingerprint of texts without lexicon terms."""
    return F.xxhash64(F.array_sort(F.array_distinct(F.split(F.trim(F.lower(text)), SPACES))))


def block_of(key: Column) -> Column:
    return F.coalesce(F.floor(key / BLOCK), F.lit(NO_ID))


def counted_terms(docs: DataFrame) -> DataFrame:
    """``_t, _df, _id``: each term of all texts with its document frequency and its holder's least id."""
    rows = docs.select("_id", F.explode(F.array_distinct(terms_of(F.col("_text")))).alias("_t"))
    return rows.groupBy("_t").agg(F.count("*").alias("_df"), F.min("_id").alias("_id"))


def above_band(counted: DataFrame, n_docs: int) -> DataFrame:
    """One row with the terms above the band, and the empty word, as ``_above``.

    At most (terms of a text / MOST_SHARE) terms are above the band whatever the number of texts, so that the row
    is small enough to be broadcast.
    """
    above = counted.filter(F.col("_df") > max(4.0, MOST_SHARE * n_docs))
    return above.agg(F.concat(F.collect_list("_t"), F.array(F.xxhash64(F.lit("")))).alias("_above"))


def single_terms(counted: DataFrame) -> DataFrame:
    """``_b, _single``: for each block of ids, the terms below the band by their holder's id."""
    low = counted.filter(F.col("_df") < LEAST_DOCS).select(block_of(F.col("_id")).alias("_b"), F.coalesce("_id", F.lit(NO_ID)).alias("_id"), "_t")
    held = low.repartition("_b").groupBy("_b", "_id").agg(F.collect_list("_t").alias("_ts"))
    return held.groupBy("_b").agg(F.map_from_entries(F.collect_list(F.struct("_id", "_ts"))).alias("_single"))


def next_blocks(blocks: DataFrame) -> DataFrame:
    """``_b, _nb``: each block with the next lower one (the highest after the lowest).

    Windows run within groups of blocks; only a row for each group, a quarter of a million ids, meets in one task.
    """
    keys = blocks.select("_b", F.floor(F.col("_b") / BLOCK).alias("_g"))
    tops = keys.groupBy("_g").agg(F.max("_b").alias("_t"))
    order = W.orderBy(F.col("_g").desc())
    tops = tops.select("_g", F.lead("_t").over(order).alias("_next"), F.first("_t").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_first"))
    inner = F.lead("_b").over(W.partitionBy("_g").orderBy(F.col("_b").desc()))
    return keys.withColumn("_in", inner).join(tops, "_g").select("_b", F.coalesce("_in", "_next", "_first").alias("_nb"))


def with_next(docs: DataFrame, facts: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds ``_next_text`` (and the like of what ``facts`` adds), of the row that follows in the order of descending ids (after the last: the first).

    Windows run within blocks of ids (``_b``); the last row of a block takes the first row of the next block.
    """
    blocked = docs.withColumn("_b", block_of(F.col("_id")))
    order = [F.col("_id").desc_nulls_last(), F.col("_text").desc_nulls_last()]
    heads = blocked.groupBy("_b").agg(F.max_by(F.struct("_id", "_text"), F.struct(F.coalesce("_id", F.lit(NO_ID)), "_text")).alias("_h"))
    heads = facts(heads.select("_b", "_h._id", "_h._text"))
    own = facts(blocked)
    names = [c for c in own.columns if c not in ("_b", "_id")]
    heads = next_blocks(blocked.select("_b").distinct()).join(heads.select(F.col("_b").alias("_nb"), *[F.col(c).alias(f"_h{c}") for c in names]), "_nb")
    heads = heads.withColumnRenamed("_b", "_hb").drop("_nb")
    # Each column is led by itself: a struct of them would be made, and shuffled, besides them.
    over = W.partitionBy("_b").orderBy(*order)
    follow = own.select("*", *[F.lead(c).over(over).alias(f"_n{c}") for c in names])
    joined = follow.join(heads, F.col("_b") == F.col("_hb"))
    return joined.select(*own.columns, *[F.coalesce(f"_n{c}", f"_h{c}").alias(f"_next{c}") for c in names])


def edit_parts(text: Column, after: Column) -> tuple[Column, Column]:
    """The first two thirds of a text, and as much of the next text as the last third has."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut)


def cut_words(text: Column, after: Column) -> Column:
    """Hashes of the words of the edited text that a cut may have made: across the joint, and at the end."""
    first, second = (words_of(p) for p in edit_parts(text, after))
    return F.array(F.xxhash64(F.concat(F.element_at(first, -1), F.element_at(second, 1))), F.xxhash64(F.element_at(second, -1)))


def strange_words(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """``_b, _strange``: for each block of ids, the cut words that are no lexicon terms (nor above the band)."""
    rows = with_next(docs).select("_b", F.explode(cut_words(F.col("_text"), F.col("_next_text"))).alias("_t")).distinct()
    lost = rows.join(counted.filter(F.col("_df") >= LEAST_DOCS).select("_t"), "_t", "left_anti")
    return lost.groupBy("_b").agg(F.collect_set("_t").alias("_strange"))


def fingerprint(kept: Column, text: Column) -> Column:
    """For each subset with terms among ``kept``: three digits for the subset, eight for the hash of its sorted terms."""
    number = lambda t: F.shiftrightunsigned(t, 64 - BITS).cast("int")
    shown = lambda s: F.hex(F.shiftleft(s["r"].cast("long") + SUBSETS, 32).bitwiseOR(s["h"].bitwiseAND(0xFFFFFFFF)))
    state = lambda r, h, done: F.struct(r.alias("r"), h.alias("h"), done.alias("done"))

    def step(s: Column, t: Column) -> Column:
        done = F.when(s["r"] < 0, F.lit("")).otherwise(F.concat(s["done"], shown(s), F.lit(":")))
        return F.when(s["r"] == number(t), state(s["r"], F.xxhash64(s["h"], t), s["done"])).otherwise(state(number(t), F.xxhash64(t), done))

    hashes = F.aggregate(F.array_sort(kept), state(F.lit(-1), F.lit(0).cast("long"), F.lit("")), step, lambda s: F.concat(s["done"], shown(s)))
    return F.when(F.size(kept) > 0, hashes).otherwise(F.concat(F.lit("400"), F.lpad(F.hex(all_terms_hash(text)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which either text has terms; equal fingerprints have 1."""
    x, y = F.split(a, ":"), F.split(b, ":")
    subsets = lambda h: F.transform(h, lambda e: F.substring(e, 1, 3))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(subsets(x), subsets(y)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and that to the next text.

    A null text counts as empty; empty texts share a fingerprint of their own.  Repeated rows follow each other in
    the order of ids; null ids come last.  A single row is its own next.  Texts of any length count whole; an empty
    table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    counted = shared_checkpoint(counted_terms(own))
    above, single = above_band(counted, own.count()), single_terms(counted)

    def facts(rows: DataFrame) -> DataFrame:
        lone = F.coalesce(F.element_at("_single", F.coalesce("_id", F.lit(NO_ID))), F.array().cast("array<long>"))
        rows = rows.join(single, "_b", "left").select("_b", "_id", "_text", lone.alias("_lone")).crossJoin(F.broadcast(above))
        rows = rows.withColumn("_kept", F.array_except(terms_of(F.col("_text")), F.concat("_above", "_lone")))
        return rows.select("_b", "_id", "_text", "_lone", fingerprint(F.col("_kept"), F.col("_text")).alias("_fp"))

    rows = with_next(own, facts).join(strange_words(own, counted), "_b", "left").crossJoin(F.broadcast(above))
    text, after = F.col("_text"), F.col("_next_text")
    cut = F.filter(cut_words(text, after), lambda t: F.coalesce(F.array_contains("_strange", t), F.lit(False)))
    rows = rows.select("_id", "_text", "_fp", "_next_fp", F.concat("_above", "_lone", "_next_lone", cut).alias("_not"), F.concat(*edit_parts(text, after)).alias("_edit"))
    rows = rows.withColumn("_kept", F.array_except(terms_of(F.col("_edit")), "_not"))
    out = rows.select("_id", "_text", "_edit", "_fp", "_next_fp", fingerprint(F.col("_kept"), F.col("_edit")).alias("_edit_fp"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.char_length("_text").cast("long").alias("n_chars"),
        F.sha2("_edit", 256).alias("edited_sha256"),
        F.col("_fp").alias("fingerprint"),
        F.col("_edit_fp").alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edit_fp")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )

"""Interaction audit of corpus filters: what each filter removes alone, after the others, in every order.

Each document becomes a mask of the filters that it fails.  All orders of the filters are then read off the counts of the
masks of a part, so the work after one pass over the texts doesn't depend on the number of orders.

The duplicate filter refines a partition of the documents: they are split by length in code points, then by the hashes of
successive blocks of text, and a class of one row is dropped before the next block is looked at.  The texts of the classes
that survive all blocks are compared in full, so a hash decides nothing; rows of an id above the class's smallest fail.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

FILTERS = "ABCDE"
#: First code point (from 1) and length of the blocks; the last one runs to the end.
BLOCKS = ((1, 64), (65, 448), (513, 3584), (4097, None))
#: Parts of a class of very many rows.
SALTS = 64
SPACE = " \t\n\x0b\x0c\r"


def conditions(text: Column, words: Column, n_words: Column) -> dict[str, Column]:
    """The filters that look at one text: too few words, too few distinct ones, too many capitals, symbols."""
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def measured(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Per row: doc_id, part (lang; null: empty), body, mask of the filters A to D, n_chars and the hashes of its blocks; ``hash_bits`` under 64 is for tests."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    trimmed = F.btrim("body", F.lit(SPACE))
    cut = body.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    mask = F.lit(0)
    for i, fails in enumerate(conditions(F.col("body"), F.col("words"), F.size("words").cast("long")).values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    hashes = [F.shiftrightunsigned(F.xxhash64(F.substring("body", at, n) if n else F.expr(f"substring(body, {at})")), 64 - hash_bits) if hash_bits else F.lit(0).cast("long") for at, n in BLOCKS]
    return cut.select("doc_id", "part", "body", mask.alias("mask"), F.length("body").cast("long").alias("n_chars"), *[h.alias(f"h{k}") for k, h in enumerate(hashes)]).withColumn("label", F.xxhash64("n_chars", *[f"h{k}" for k in range(len(BLOCKS))]))


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (class, salt, ...) without those of a class of one; a class of very many rows meets its count in ``SALTS`` parts."""
    dealt = rows.repartition("class", "salt")
    parts = dealt.groupBy("class", "salt").agg(F.count("*").alias("n"))
    crowd = parts.groupBy("class").agg(F.sum("n").alias("n")).where("n > 1")
    return dealt.join(parts.join(crowd, "class", "left_semi").select("class", "salt"), ["class", "salt"], "left_semi")


def copies(facts: DataFrame, docs: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """The rows (doc_id, label) of ``facts`` whose text a smaller doc_id has too; and, where unlike texts share a label, the distinct
    (doc_id, label, body) of those classes that have it so, else nothing.

    Null ids are neither smaller nor larger than any id.
    """
    hashes = [f"h{k}" for k in range(len(BLOCKS))]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = facts.where("doc_id is not null").select("doc_id", "label", "n_chars", *hashes).distinct().select("*", F.col("n_chars").alias("class"), salt.alias("salt"))
    for k, h in enumerate([*hashes, None]):
        rows = stage(_crowded(rows), "classes", settle=k == 0)
        if h:
            rows = rows.withColumn("class", F.xxhash64("class", h))
    rows = rows.select("doc_id", "label", "salt")
    keys = stage(rows.select("label", "salt").distinct(), "keys")
    texts = measured(docs, hash_bits).where("doc_id is not null").select("doc_id", "label", "body", salt.alias("salt")).join(keys, ["label", "salt"], "left_semi")
    groups = stage(texts.groupBy("label", "body").agg(F.min("doc_id").alias("lo")).groupBy("label").agg(F.min("lo").alias("lo"), F.count("*").alias("n_texts")), "groups", settle=True)
    same = rows.join(keys.join(groups.where("n_texts = 1"), "label"), ["label", "salt"]).where("doc_id > lo").select("doc_id", "label")
    mixed = groups.where("n_texts > 1").select("label")
    if not mixed.limit(1).count():
        return same, None
    texts = texts.join(mixed, "label", "left_semi")
    first = texts.groupBy("label", "body").agg(F.min("doc_id").alias("lo"))
    return same, texts.join(first, ["label", "body"]).where("doc_id > lo").select("doc_id", "label", "body").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of a part that fail exactly the filters of ``mask``; bit i is filter ``FILTERS[i]``.

    A null text is empty.  Rows of one id are counted each; equal texts under one id aren't copies of each other.  An id
    is good (toxic) if any row of ``labels`` gives it quality (toxic) 1; ids without labels and null ids are neither.
    """
    bit = 1 << FILTERS.index("E")
    facts = stage(measured(docs, hash_bits).drop("body"), "facts")
    same, mixed = copies(facts, docs, hash_bits)
    rows = facts.groupBy("doc_id", "label", "part", "mask").agg(F.count("*").alias("n"))
    if mixed is not None:
        told = measured(docs, hash_bits).join(mixed.select("label").distinct(), "label", "left_semi").groupBy("doc_id", "label", "part", "mask", "body").agg(F.count("*").alias("n"))
        hit = mixed.withColumn("copy", F.lit(bit))
        told = told.join(hit, ["doc_id", "label", "body"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"), "n")
        rows = rows.join(mixed.select("label").distinct(), "label", "left_anti")
    marked = rows.join(same.distinct().withColumn("copy", F.lit(bit)), ["doc_id", "label"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"), "n")
    if mixed is not None:
        marked = marked.unionByName(told)
    by_id = marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = by_id.where("doc_id is not null").join(flags, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    return known.unionByName(by_id.where("doc_id is null").select("part", "mask", no.alias("good"), no.alias("toxic"), "n")).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``counts`` (part, mask, good, toxic, n) -> one row per part, order of the filters and step.

    kept and removed by this step, redundant (fails this filter, removed before), unique_fails (fails this filter alone),
    good_lost and toxic_lost (of the removed), shapley (the filter's removals summed over all orders).  A part without
    documents has no rows; there are at most 2 ** filters counts a part, whatever its size.
    """
    order = lambda x, i: sum(1 << filters.index(c) for c in x[:i])
    plan = [F.struct(F.lit("".join(p)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << filters.index(p[i])).alias("bit"), F.lit(order(p, i)).alias("before")) for p in permutations(filters) for i in range(len(filters))]
    per_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    at = parts.select("part", "masks", F.explode(F.array(*plan)).alias("p")).select("part", "masks", "p.*")

    def total(field: str, where) -> Column:
        return F.aggregate(F.filter("masks", lambda m: where(m["mask"])), F.lit(0).cast("long"), lambda acc, m: acc + m[field])

    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    steps = at.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    shares = steps.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters in ``docs`` (doc_id, text, lang), by lang (null: empty); an empty table gives no rows."""
    return interactions(stage(mask_counts(docs, labels), "masks"))

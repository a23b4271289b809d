"""Observable flags packed into the bits of a LONG (bits 0 to 63, the last one in the sign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_OBSERVABLES = 64


def mask_from_indices(indices: Column) -> Column:
    """XOR of ``1 << i`` over an array of flag numbers; a number named twice cancels."""
    return F.aggregate(
        F.coalesce(indices, F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseXOR(
            F.when(
                (i < 0) | (i >= MAX_OBSERVABLES),
                F.raise_error(F.concat(F.lit("observable does not fit a 64-bit mask: "), i.cast("string"))).cast("long"),
            ).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))
        ),
    )


def mask_from_bits(bits: Column) -> Column:
    """Mask of a 0/1 array, position 0 in the lowest bit."""
    return mask_from_indices(F.filter(F.transform(bits, lambda b, i: F.when(b != 0, i)), lambda i: i.isNotNull()))


def bits_from_mask(mask: Column, size: int) -> Column:
    """The lowest ``size`` bits as an array of 0/1."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")).cast("int"),
    )


def mask_text(mask: Column) -> Column:
    """Numbers of the set bits joined with ``;``."""
    numbers = F.filter(
        F.sequence(F.lit(0), F.lit(MAX_OBSERVABLES - 1)),
        lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1,
    )
    return F.array_join(numbers.cast("array<string>"), ";")


def flag_words(flags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words: flag numbers of any size (column ``obs``, one row each) as an array of
    LONGs of 64 flags, number 0 in the lowest bit of the first. A number that stands there
    twice cancels; an even number of each gives an empty array. Combines before the shuffle."""
    word, bit = F.expr("obs div 64").cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("obs", F.lit(64)).cast("int"))
    words = flags.groupBy(*keys, word.alias("word")).agg(F.bit_xor(bit).alias("bits"))
    found = words.where("bits <> 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    every = flags.select(*keys).distinct()
    return every.join(found, keys, "left").select(*keys, F.coalesce(F.when(F.col("m").isNotNull(), filled), F.array().cast("array<bigint>")).alias("words"))


def flags_of_words(words: Column) -> Column:
    """Numbers of the set flags, ascending."""
    each = F.transform(
        words,
        lambda w, i: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(MAX_OBSERVABLES - 1)), lambda k: F.call_function("shiftright", w, k).bitwiseAND(F.lit(1).cast("long")) == 1),
            lambda k: k + i * 64,
        ),
    )
    return F.flatten(each)

"""Encoding, decoding and projection of genotype calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.model import BASES, IUPAC, IUPAC_BASES, WIDE_BASES, bases_of, code_of, iupac_dimension, literal_map


def normalise_missing(g: Column) -> Column:
    """Negative and NaN calls are missing."""
    return F.when(g >= 0, g)


def clean_calls(g: Column) -> Column:
    """Anything but 0, 1 and 2 is missing."""
    return F.when(g.isin(0, 1, 2), g)


def encode_012(first: Column, second: Column, ref: Column) -> Column:
    """The number of alleles that are not the reference; missing if either is."""
    return (first != ref).cast("int") + (second != ref).cast("int")


def encode_iupac_012(code: Column, ref: Column) -> Column:
    """0 for the reference base, 2 for another lone base, 1 for two bases, missing for no code."""
    bases = bases_of(F.upper(code))
    return F.when(bases == ref, 0).when(F.length(bases) == 1, 2).when(F.length(bases) == 2, 1)


def decode_code(number: Column) -> Column:
    """0 to 9 to IUPAC; anything else N."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in IUPAC]), number.cast("int")), F.lit("N"))


def iupac_to_int(code: Column) -> Column:
    """IUPAC to 0 to 9, -1 for anything else."""
    return F.coalesce(F.try_element_at(literal_map({c: i for i, c in enumerate(IUPAC)}), F.upper(code)), F.lit(-1))


def collapse_haploid(code: Column, ref: Column, alt: Column, mode: str = "ref_alt") -> Column:
    """One base for a two-base code: the reference if it is one of them, else the alternative, else the first (``ref_alt``); the first (``first_base``); or ``N``."""
    bases = bases_of(F.upper(code))
    if mode == "N":
        picked = F.lit("N")
    elif mode == "first_base":
        # First base of each two-base code.
        picked = F.element_at(literal_map({"W": "A", "R": "A", "M": "A", "K": "G", "Y": "C", "S": "C"}), F.upper(code))
    else:
        picked = F.when(F.contains(bases, ref), ref).when(F.contains(bases, alt), alt).otherwise(F.substring(bases, 1, 1))
    return F.when(F.length(bases) == 2, picked).otherwise(F.coalesce(bases, F.lit("N")))


def haploid_fold(g: Column, to: int = 1) -> Column:
    """Above 0 becomes 1 (scoring) or 2 (decoding); missing stays."""
    return F.when(g > 0, to).otherwise(g)


def one_hot(g: Column, classes: int = 3) -> Column:
    """Array of 0 and 1, all -1 for missing; with two classes above 1 folds to 1; a call out of range fails."""
    call = F.when(g > 1, 1).otherwise(g) if classes == 2 else g
    checked = F.when(call >= classes, F.raise_error(F.lit("call out of range")).cast("int")).otherwise(call)
    return F.when(g.isNull(), F.array(*[F.lit(-1)] * classes)).otherwise(F.array(*[(checked == k).cast("int") for k in range(classes)]))


def base_to_int(value: Column) -> Column:
    """A, C, G, T to 0 to 3; digits 0 to 9 pass through; else -1."""
    at = F.instr(F.lit(BASES), F.upper(value)) - 1
    return F.when(value.rlike("^[0-9]$"), value.try_cast("int") if hasattr(value, "try_cast") else value.cast("int")).when(F.length(value) == 1, at).otherwise(-1)


def alt_mask(alt: Column) -> Column:
    """Array of four booleans, which bases an ALT list (comma-joined) names; all tokens count."""
    tokens = F.split(F.upper(alt), ",")
    return F.array(*[F.array_contains(F.transform(tokens, lambda t: F.trim(t)), b) for b in BASES])


def zygosity(code: Column, ref: Column, alt: Column) -> Column:
    """As ``encode_iupac_012`` after calls with bases outside the reference and alternatives are missing."""
    bases = F.split(bases_of(F.upper(code)), "")
    allowed = F.split(F.concat(ref, F.replace(alt, F.lit(","), F.lit(""))), "")
    return F.when(F.size(F.array_except(bases, allowed)) == 0, encode_iupac_012(code, ref))


def locus_name(name: Column, locus_id: Column) -> Column:
    """P20: the name, else Locus_{id+1}."""
    return F.coalesce(name, F.concat(F.lit("Locus_"), (locus_id + 1).cast("string")))


def normalise_symbol(code: Column) -> Column:
    """Upper case; ``-``, ``.`` and ``?`` are N."""
    return F.translate(F.upper(code), "-.?", "NNN")


def base_counts(calls: DataFrame) -> DataFrame:
    """A10: ``locus_id``, ``base``, ``n`` over all calls (column ``iupac``): a lone base counts two, each base of a pair one.

    Every call counts; the reference stops after 5,000 calls of a locus.
    """
    spark = calls.sparkSession
    coded = calls.groupBy("locus_id", F.upper("iupac").alias("code")).agg(F.count(F.lit(1)).alias("calls"))
    return coded.join(F.broadcast(iupac_dimension(spark)), "code").groupBy("locus_id", "base").agg(F.sum(F.col("calls") * F.col("weight")).alias("n"))


def _best(counts: Column, allowed: Column) -> Column:
    """The most frequent allowed base, ties in the order A, C, G, T; null if none is allowed. ``counts``: array of four."""
    ranked = F.transform(F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.contains(allowed, F.substring(F.lit(BASES), i + 1, 1))), lambda i: F.struct((-F.get(counts, i)).alias("n"), i.alias("i")))
    return F.substring(F.lit(BASES), F.try_element_at(F.array_sort(ranked), F.lit(1))["i"] + 1, 1)


def repair_alleles(loci: DataFrame, counts: DataFrame) -> DataFrame:
    """``locus_id``, ``ref``, ``alt`` fit for decoding, from metadata (``ref``; ``alt`` comma-joined) and base counts.

    The reference is the first valid token; an ambiguous one becomes its most frequent
    base. The alternative is the most frequent candidate other than the reference; if
    nothing remains of a single token, that token's first base. What is still missing comes
    from the ranking of counted bases; if that is empty too, both are N or equal. Ties go A, C, G, T.
    """
    wide = counts.groupBy("locus_id").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(b) for b in BASES])
    joined = loci.join(wide, "locus_id", "left").withColumn("c", F.array(*[F.coalesce(F.col(b), F.lit(0)) for b in BASES]))
    valid = literal_map(IUPAC_BASES | WIDE_BASES)
    tokens = lambda c: F.filter(F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), ","), F.trim), lambda t: F.map_contains_key(valid, t) & (t != "N"))
    spelled = lambda c: F.array_join(F.transform(tokens(c), lambda t: F.element_at(valid, t)), "")
    first = F.try_element_at(tokens(F.col("ref")), F.lit(1))
    step = joined.withColumn("r", F.when(first.isNotNull(), _best(F.col("c"), F.element_at(valid, first)))).withColumn("cand", spelled(F.col("alt"))).withColumn("one", F.size(tokens(F.col("alt"))) == 1)
    rest = F.translate(F.col("cand"), "N", "")
    others = F.when(F.col("r").isNotNull(), F.replace(rest, F.col("r"), F.lit(""))).otherwise(rest)
    step = step.withColumn("a", F.when(others != "", _best(F.col("c"), others)).when(F.col("one"), F.substring("cand", 1, 1)))
    seen = F.concat(*[F.when(F.get("c", F.lit(i)) > 0, b).otherwise("") for i, b in enumerate(BASES)])
    step = step.withColumn("seen", seen)
    step = step.withColumn("r", F.coalesce("r", F.when(F.col("seen") != "", _best(F.col("c"), F.col("seen")))))
    left = F.when(F.col("r").isNotNull(), F.replace("seen", F.col("r"), F.lit(""))).otherwise(F.col("seen"))
    step = step.withColumn("a", F.coalesce("a", F.when(left != "", _best(F.col("c"), left))))
    return step.select("locus_id", F.coalesce("r", "a", F.lit("N")).alias("ref"), F.coalesce("a", "r", F.lit("N")).alias("alt"))


def decode_012(g: Column, ref: Column, alt: Column) -> Column:
    """0 the reference, 2 the alternative (else the reference), 1 their IUPAC code (else the reference), anything else N."""
    pair = F.when(ref < alt, F.concat(ref, alt)).otherwise(F.concat(alt, ref))
    het = F.coalesce(F.when(ref == alt, ref), code_of(pair), ref)
    return F.when(g == 0, ref).when(g == 1, het).when(g == 2, F.coalesce(alt, ref)).otherwise("N")


def flatten_metrics(reports: DataFrame, id_columns: Sequence[str], maps: str = "metrics") -> DataFrame:
    """A map column as ``metric``, ``value`` rows."""
    return reports.select(*id_columns, F.explode(maps).alias("metric", "value"))

"""Names, keys, orders and durations as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.model import literal_map

# Normalised aliases and the model that each names.
MODEL_ALIASES = {
    "mostfrequent": "MostFrequent",
    "imputemostfrequent": "MostFrequent",
    "mostfreq": "MostFrequent",
    "mostfrequentbaseline": "MostFrequent",
    "refallele": "RefAllele",
    "imputerefallele": "RefAllele",
    "autoencoder": "Autoencoder",
    "imputeautoencoder": "Autoencoder",
    "vae": "VAE",
    "imputevae": "VAE",
    "nlpca": "NLPCA",
    "imputenlpca": "NLPCA",
    "ubp": "UBP",
    "imputeubp": "UBP",
}
# Masking strategies and their titles.
STRATEGY_TITLES = {
    "random": "Random",
    "random weighted": "Random Weighted",
    "random weighted inv": "Random Weighted Inv",
    "nonrandom": "Nonrandom",
    "nonrandom weighted": "Nonrandom Weighted",
}
# Words that mark a data set as genomic.
GENOMIC_TERMS = ("vcf", "phylip", "phy", "genepop", "rad-seq", "ddrad", "double-digest-rad", "genotyping-by-sequencing", "stacks", "ipyrad", "pyrad", "radseq", "gbs")


def dataset_key(text: Column) -> Column:
    """Results, dataset, sim, run or rep with its number, lower-cased, underscores dropped; null for none."""
    found = F.regexp_extract(text, r"(?i)((?:results|dataset|sim|run|rep)_?\d+)", 1)
    return F.nullif(F.replace(F.lower(found), F.lit("_"), F.lit("")), F.lit(""))


def model_name(text: Column) -> Column:
    """The canonical name of a model alias, else UnknownModel."""
    return F.coalesce(F.try_element_at(literal_map(MODEL_ALIASES), F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))), F.lit("UnknownModel"))


def strategy_name(text: Column) -> Column:
    """The title of a masking strategy, else Unknown."""
    return F.coalesce(F.try_element_at(literal_map(STRATEGY_TITLES), F.lower(F.trim(text))), F.lit("Unknown"))


def is_genomic(*columns: Column, terms: tuple[str, ...] = GENOMIC_TERMS) -> Column:
    """Whether any column, lower-cased, holds one of the terms."""
    return F.lower(F.concat_ws(" ", *columns)).rlike("|".join(terms))


def skip_file(name: Column, size: Column, extensions: tuple[str, ...], max_mb: float) -> Column:
    """Struct of ``skip`` and ``reason`` by extension and size; an unknown size is no reason."""
    extension = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    mb = size.cast("double") / (1024 * 1024)
    reason = F.when(extension == "", "No Extension").when(~extension.isin(*extensions), F.concat(F.lit("Bad Extension ("), extension, F.lit(")"))).when(mb > max_mb, F.concat(F.lit("Too Large ("), F.format_string("%.2f", mb), F.lit(" MB)"))).otherwise("")
    return F.struct((reason != "").alias("skip"), reason.alias("reason"))


def duration(seconds: Column) -> Column:
    """hours, minutes and seconds as far as they are needed; n/a for null and non-finite, negative as 0."""
    value = F.greatest(F.lit(0.0), seconds.cast("double"))
    hours = F.floor(value / F.lit(3600.0))
    minutes = F.floor((value - hours * 3600) / F.lit(60.0))
    rest = value - hours * 3600 - minutes * 60
    written = F.when(hours >= 1, F.format_string("%dh %dm %05.2fs", hours, minutes, rest)).when(minutes >= 1, F.format_string("%dm %05.2fs", minutes, rest)).otherwise(F.format_string("%.3fs", rest))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (F.abs(seconds.cast("double")) == float("inf")), "n/a").otherwise(written)


def natural_order(text: Column) -> list[Column]:
    """Sort keys that put item2 before item10."""
    return [F.regexp_extract(text, r"^(\D*)", 1), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")), F.lit(-1)), text]


def report_order(report: DataFrame) -> DataFrame:
    """``place`` of each report row: classes in natural order, then accuracy and the averages."""
    last = literal_map({"accuracy": 1, "macro avg": 2, "weighted avg": 3})
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce(F.try_element_at(last, F.col("label")), F.lit(0)), *natural_order(F.col("label")))
    return report.withColumn("place", F.row_number().over(order))

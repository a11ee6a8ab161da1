"""Archive locations of public series accessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the public archive keeps a series.
ARCHIVE_ROOT = "https://ftp.ncbi.nlm.nih.gov/geo/series"
ACCESSION = r"^GSE[0-9]+$"


def series_bucket(accession: Column) -> Column:
    """Folder of a series: its number in thousands, NULL for an invalid accession."""
    upper = F.upper(accession)
    number = F.regexp_extract(upper, "([0-9]+)$", 1).cast("decimal(38,0)")
    thousands = F.floor(number / F.lit(1000)).cast("string")
    return F.when(upper.rlike(ACCESSION), F.concat(F.lit("GSE"), thousands, F.lit("nnn")))


def accession_urls(df: DataFrame, accession: str, *, strict: bool = True) -> DataFrame:
    """Family and raw-archive URLs; an invalid accession is an error, or NULLs if not strict."""
    upper = F.upper(F.col(accession))
    bucket = series_bucket(F.col(accession))
    if strict:
        bad = F.concat(F.lit("not a series accession: "), F.col(accession))
        bucket = F.coalesce(bucket, F.raise_error(bad).cast("string"))
    base = F.concat_ws("/", F.lit(ARCHIVE_ROOT), bucket, upper)
    known = bucket.isNotNull()
    return df.select(
        upper.alias("accession"),
        bucket.alias("bucket"),
        F.when(known, F.concat(base, F.lit("/soft/"), upper, F.lit("_family.soft.gz"))).alias("family_soft"),
        F.when(known, F.concat(base, F.lit("/suppl/"), upper, F.lit("_RAW.tar"))).alias("raw_tar"),
    )

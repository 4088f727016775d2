"""Tables from files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lamina.sources.store import Store
from lamina.sources.table import Table


def from_file(
    spark: SparkSession, path: str, filename: str, fmt: str = "parquet", lower: bool = False, compression: object = None, chunksize: object = None, yes: bool = False, append: bool = False, **options: object
) -> Table:
    """A store at ``path`` from a file that Spark reads (parquet, csv, json, orc, fits); ``append`` adds to one that is there.

    ``lower`` makes the names lower case. The data are read and written by partition, whatever their size.
    """
    if fmt == "fits":
        from lamina.sources.fits import FitsSource

        spark.dataSource.register(FitsSource)
    if fmt == "csv":
        options = {"header": True, "inferSchema": True, **options}
    df = spark.read.format(fmt).options(**{k: str(v) for k, v in options.items()}).load(filename)
    if lower:
        df = df.toDF(*[c.lower() for c in df.columns])
    if append:
        table = Store.open(spark, path, "r+")
        table.append(df)
        return table
    return Store.create_from_dataframe(spark, path, df, compression=compression, chunksize=chunksize, yes=yes)


def from_fits(spark: SparkSession, path: str, filename: str, ext: int = 1, lower: bool = False, compression: object = None, chunksize: object = None, yes: bool = False) -> Table:
    """A store from a table extension of a FITS file."""
    return from_file(spark, path, filename, "fits", lower, compression, chunksize, yes, ext=ext)

"""The tables that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Other names under which columns of spectra tables come.
ALIASES = {"peaks_mz": "ms2_mzs", "peaks_intensity": "ms2_intensities", "canonical_smiles": "normalized_smiles", "full_inchikey": "inchikey"}


def with_common_names(df: DataFrame) -> DataFrame:
    """Columns that come under another name get the common one, unless it is taken."""
    rename = {a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(rename)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself; a clear error names the columns that it lacks. Nothing is read."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df

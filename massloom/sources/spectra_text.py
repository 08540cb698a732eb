"""Text formats of spectra (MSP and MGF), read and written as text blocks that Spark splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from massloom.functions.chem import energy_of_text


def _field(block: Column, *names: str) -> Column:
    """The value behind ``name:`` or ``name=`` at the start of a line, whatever the case; null if absent or blank."""
    value = F.trim(F.regexp_extract(block, rf"(?im)^(?:{'|'.join(names)})[:=][ \t]*(.*)$", 1))
    return F.when(value != "", value)


def _peaks(block: Column) -> Column:
    """The lines of two numbers, in order."""
    line = r"(?m)^[ \t]*([0-9][0-9.eE+-]*)[ \t;,]+([0-9][0-9.eE+-]*)"
    number = lambda i: F.regexp_extract_all(block, F.lit(line), i)
    return F.zip_with(number(1), number(2), lambda m, x: F.struct(m.cast("double").alias("mz"), x.cast("double").alias("i")))


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of MSP text: blocks set off by blank lines, ``name: value`` lines, then peaks. Blocks without peaks stay out.

    Lines may end in CR LF. A structure may stand in a field of its own or, as ``SMILES=``, in the comments.
    """
    raw = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", "\r", "").alias("b"))
    b = F.col("b")
    in_comment = F.regexp_extract(b, r'(?im)^comments?:.*"?smiles=([^"\s]+)', 1)
    return raw.select(
        _field(b, "name").alias("name"),
        _field(b, "db#", "id").alias("spectrum_id"),
        _field(b, "inchikey").alias("inchikey"),
        F.coalesce(_field(b, "smiles"), F.when(in_comment != "", in_comment)).alias("smiles"),
        _field(b, "precursormz").try_cast("double").alias("precursor_mz"),
        _field(b, "precursor_type", "adduct").alias("adduct"),
        energy_of_text(_field(b, "collision_energy")).alias("collision_energy"),
        _field(b, "num peaks").try_cast("int").alias("num_peaks"),
        _peaks(b).alias("peaks"),
    ).where(F.size("peaks") > 0)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of MGF text: blocks from ``BEGIN IONS`` to ``END IONS``. The adduct is the bracketed ion in the name, else by polarity."""
    raw = spark.read.text(path, lineSep="END IONS").select(F.regexp_replace("value", "\r", "").alias("b")).where(F.col("b").contains("BEGIN IONS"))
    b = F.col("b")
    named = F.regexp_extract(_field(b, "name"), r"(\[[^\]]+\]\d*[+-])", 1)
    by_mode = F.when(F.lower(_field(b, "ionmode")).startswith("neg"), "[M-H]-").otherwise("[M+H]+")
    return raw.select(
        _field(b, "spectrumid", "title").alias("spectrum_id"),
        _field(b, "name").alias("name"),
        _field(b, "smiles").alias("smiles"),
        F.regexp_extract(_field(b, "pepmass"), r"^([0-9.eE+-]+)", 1).try_cast("double").alias("precursor_mz"),
        F.coalesce(F.when(named != "", named), by_mode).alias("adduct"),
        _peaks(b).alias("peaks"),
    ).where(F.size("peaks") > 0)


def _lines(peaks: Column) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["i"].cast("string"))), "\n")


def write_msp(df: DataFrame, path: str) -> None:
    """Writes ``spectrum_id``, ``inchikey``, ``smiles``, ``precursor_mz``, ``adduct`` and ``peaks`` as MSP; null fields are left out."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    head = F.concat_ws("\n", line("DB#", "spectrum_id"), line("InChIKey", "inchikey"), line("SMILES", "smiles"), line("PrecursorMZ", "precursor_mz"),
        line("Precursor_type", "adduct"), F.concat(F.lit("Num Peaks: "), F.size("peaks").cast("string")))
    df.select(F.concat(head, F.lit("\n"), _lines(F.col("peaks"))).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def write_mgf(df: DataFrame, path: str) -> None:
    """Writes ``spectrum_id``, ``smiles``, ``precursor_mz``, ``adduct`` and ``peaks`` as MGF; null fields are left out."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    head = F.concat_ws("\n", F.lit("BEGIN IONS"), line("PEPMASS", "precursor_mz"), line("NAME", "adduct"), line("SMILES", "smiles"), line("SPECTRUMID", "spectrum_id"))
    df.select(F.concat(head, F.lit("\n"), _lines(F.col("peaks")), F.lit("\nEND IONS")).alias("value")).write.mode("overwrite").text(path)

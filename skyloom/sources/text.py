"""Text formats and catalogue normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import _c
from skyloom.functions.timecode import filename_mjd

CARD, BLOCK = 80, 2880


def whitespace_table(lines: DataFrame, columns: Sequence[str], types: dict[str, str], line: str = "value", na_values: Sequence[str] = ("nan", "None", "-"),
                     hex_columns: Sequence[str] = (), rounding: dict[str, int] | None = None) -> DataFrame:
    """Rows of a whitespace-separated table; ``#`` lines are comments, hex columns become integers."""
    rows = lines.filter(~F.trim(line).startswith("#") & (F.trim(line) != "")).withColumn("_p", F.split(F.trim(line), r"\s+"))
    out = []
    for i, name in enumerate(columns):
        raw = F.get("_p", F.lit(i))
        raw = F.when(~raw.isin(*na_values), raw)
        if name in hex_columns:
            value = F.conv(F.regexp_replace(raw, "^0[xX]", ""), 16, 10).cast("long")
        else:
            value = raw.try_cast(types.get(name, "string"))
        if rounding and name in rounding:
            value = F.round(value, rounding[name])
        out.append(value.alias(name))
    keep = [c for c in lines.columns if c != line]
    return rows.select(*keep, *out)


def formatted_lines(df: DataFrame, columns: Sequence[str], formats: dict[str, str], out: str = "value") -> DataFrame:
    """One formatted text line per row over a subset of columns; NULL prints as nan."""
    parts = [F.coalesce(F.format_string(formats.get(c, "%s"), F.col(c)), F.lit("nan")) if c in formats else F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]
    parts = [F.when(F.col(c).isNull(), F.lit("nan")).otherwise(p) for c, p in zip(columns, parts)]
    return df.select(F.concat_ws(" ", *parts).alias(out))


def header_cards(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, key, value) from the 80-byte cards of the first header of each file.

    ``files`` is what the binary-file source yields.  Only the header is decoded.
    """
    text = F.decode(F.col(content), "ISO-8859-1")
    head = F.substring_index(text, "END" + " " * 77, 1)
    count = F.floor(F.length(head) / CARD).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    # Each card is cut from the header by position.
    cards = files.select(path, head.alias("_h"), F.explode(index).alias("_i")).select(path, F.substr(F.col("_h"), F.col("_i") * CARD + 1, F.lit(CARD)).alias("_card"))
    is_value = F.substring("_card", 9, 2) == "= "
    body = F.trim(F.substring("_card", 11, 70))
    quoted = F.trim(F.regexp_replace(F.regexp_extract(body, r"^'((?:[^']|'')*)'", 1), "''", "'"))
    plain = F.trim(F.substring_index(body, "/", 1))
    return cards.filter(is_value).select(path, F.trim(F.substring("_card", 1, 8)).alias("key"), F.when(body.startswith("'"), quoted).otherwise(plain).alias("value"))


def header_table(cards: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """One row per file with a column for each wanted keyword."""
    return cards.groupBy(path).pivot("key", list(keys)).agg(F.first("value"))


def manifest_frames(lines: DataFrame, cam: int, ccd: int, start: float | None = None, end: float | None = None, line: str = "value") -> DataFrame:
    """Manifest lines of one detector inside a time window read from the file name."""
    out = lines.filter(F.col(line).contains(f"-{cam}-{ccd}-")).withColumn("mjd", filename_mjd(line))
    if start is not None:
        out = out.filter(F.col("mjd") >= start)
    return out.filter(F.col("mjd") <= end) if end is not None else out


def variability_class(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Type and Prob of the last class column with a positive value, else 'None' and 0."""
    label, prob = F.lit("None"), F.lit(0.0)
    for c in classes:
        hit = F.coalesce(F.col(c) > 0, F.lit(False))
        label, prob = F.when(hit, F.lit(c)).otherwise(label), F.when(hit, F.col(c)).otherwise(prob)
    return df.withColumns({"Type": label, "Prob": prob})


def variable_catalogue(df: DataFrame, catalog: str, ra: str, dec: str, ident: str, kind: Column | None = None, prob: Column | None = None) -> DataFrame:
    """The common columns (ra, dec, Type, Prob, ID, Catalog); rotation types lose their colon."""
    t = kind if kind is not None else F.col("Type")
    t = F.when(t == "ROT:", F.lit("ROT")).otherwise(t)
    p = prob if prob is not None else F.lit(1.0)
    return df.select(F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"), t.alias("Type"), p.cast("double").alias("Prob"), F.col(ident).cast("string").alias("ID"), F.lit(catalog).alias("Catalog"))


def psf_kron_flag(psf, kron) -> Column:
    """1 for point-like (difference below 0.05), 2 for nearly so (below 0.1), else 0."""
    d = _c(psf) - _c(kron)
    return F.when(d < 0.05, 1).when(d < 0.1, 2).otherwise(0)


def class_star_flag(value) -> Column:
    """1 from 0.9, 2 above 0.7, else 0."""
    v = _c(value)
    return F.when(v >= 0.9, 1).when(v > 0.7, 2).otherwise(0)


def combined_class_flag(*columns) -> Column:
    """Any class 3 (galaxy) gives 0, else any class 1 (star) gives 1, else 2."""
    arr = F.array(*[_c(c).cast("int") for c in columns])
    return F.when(F.array_contains(arr, 3), 0).when(F.array_contains(arr, 1), 1).otherwise(2)


def clean_magnitude(col, bad: float = 99.0) -> Column:
    """The survey's filler value becomes NULL."""
    return F.nullif(_c(col), F.lit(bad))


# Fixed layout of the orbit catalogue: (name, first column, width), one-based.
ORBIT_COLUMNS = [("designation", 1, 7), ("magnitude_H", 9, 5), ("magnitude_G", 15, 5), ("epoch_packed", 21, 5), ("mean_anomaly_degrees", 27, 9), ("argument_of_perihelion_degrees", 38, 9),
                 ("longitude_of_ascending_node_degrees", 49, 9), ("inclination_degrees", 60, 9), ("eccentricity", 71, 9), ("mean_daily_motion_degrees", 81, 11), ("semimajor_axis_au", 93, 11)]
ORBIT_TEXT = {"designation", "epoch_packed"}
ORBIT_OPTIONAL = {"magnitude_H", "magnitude_G"}


def orbit_catalogue(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fixed-width orbits; bad numbers are NULL and rows without a full orbit are dropped."""
    cols = []
    for name, start, width in ORBIT_COLUMNS:
        raw = F.trim(F.substring(line, start, width))
        cols.append((raw if name in ORBIT_TEXT else raw.try_cast("double")).alias(name))
    need = [n for n, _, _ in ORBIT_COLUMNS if n not in ORBIT_TEXT | ORBIT_OPTIONAL]
    return lines.select(*cols).dropna(subset=need)


def table_from_lines(lines: DataFrame, schema: str, line: str = "value", sep: str = ",") -> DataFrame:
    """Rows parsed from text lines."""
    return lines.select(F.from_csv(line, schema, {"sep": sep}).alias("_r")).select("_r.*")


def update_row(df: DataFrame, where: Column, values: dict[str, object]) -> DataFrame:
    """Replace values in the rows that meet ``where``."""
    return df.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def append_row(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """One more row; missing columns are NULL."""
    one = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(one)

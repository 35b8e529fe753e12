"""Rows that fail to parse: every column as nullable text, rules into error arrays, rows split by empty arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrid.runtime import lookup_join

#: The form of a number in a triplet line, the order of the reasons.
NUMBER = r"\A[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
DIGITS = r"\A[0-9]+\z"
REASONS = ("broken_quote", "field_count", "bad_index", "index_range", "bad_value")


def with_errors(df: DataFrame, rules: list[tuple[str, Column]], name: str = "errors") -> DataFrame:
    """Add the array of the reasons whose rule holds, in the order of the rules; empty for a valid row. A null rule doesn't hold."""
    return df.withColumn(name, F.filter(F.array(*[F.when(rule, F.lit(reason)) for reason, rule in rules]), lambda x: x.isNotNull()))


def split_rows(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid, failed): failed rows keep all columns, with `errors` and its first element as `reason`.

    Every input row is in exactly one of the two. An empty table gives two empty tables.
    """
    e = with_errors(df, rules, "errors")
    return e.where(F.size("errors") == 0).drop("errors"), e.where(F.size("errors") > 0).withColumn("reason", F.col("errors")[0])


def whole_number(text: Column) -> Column:
    """The digits of text as a long; null if there are other characters or too many digits."""
    return F.when(text.rlike(DIGITS), F.regexp_replace(text, r"\A0+(?=[0-9])", "").try_cast("bigint"))


def triplet_lines(raw: DataFrame, header: str = "hdr", number: str = "line_no", line: str = "raw_line", key: str = "line_id") -> DataFrame:
    """The triplet lines of many matrix files, tokenised: all columns of raw, `fields` array<string>, `quoted_ok`, `n_rows`, `n_cols`.

    Comments and blank lines are left out, as is the first other line of each file (smallest number, then key), which gives
    n_rows and n_cols. A null line is a triplet line. Files with a null header are one file. Of a file without a
    dimension line, n_rows and n_cols are null. The dimension lines are found by partial minima and joined back as a
    lookup table, salted where there are too many files to broadcast, so that one large file is no hot spot.
    """
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    lines = raw.withColumn("__text", text).where(F.col(line).isNull() | ~(F.col("__text").startswith("%") | F.col("__text").rlike(r"\A[ \t]*\z")))
    lines = lines.withColumn("__file", F.concat(F.lit("f"), F.col(header))).withColumn("__file", F.coalesce("__file", F.lit("null")))
    unquoted = F.regexp_replace("__text", '(?<![^ \t])"[^"]*"(?![^ \t])', "Q")
    dims = lines.where(F.col("__text").isNotNull()).groupBy("__file").agg(F.min(F.struct(F.col(number).alias("a"), F.col(key).alias("b"), F.col("__text").alias("c"))).alias("d"))
    parts = F.regexp_extract_all(F.col("d.c"), F.lit(r"([^ \t\"]+)"), F.lit(1))
    dims = dims.select("__file", F.col("d.b").alias("__dim"), whole_number(F.get(parts, F.lit(0))).alias("n_rows"), whole_number(F.get(parts, F.lit(1))).alias("n_cols"))
    joined = lookup_join(lines, dims, ["__file"]).where(F.col("__dim").isNull() | ~F.col(key).eqNullSafe(F.col("__dim")))
    fields = F.transform(F.regexp_extract_all(F.col("__text"), F.lit('("[^"]*"|[^ \t"]+)'), F.lit(1)), lambda x: F.regexp_replace(x, '"', ""))
    return joined.withColumn("quoted_ok", ~unquoted.contains('"')).withColumn("fields", fields).drop("__text", "__file", "__dim")


def split_triplets(raw: DataFrame, header: str = "hdr", number: str = "line_no", line: str = "raw_line", key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """(valid, failed) triplet lines of raw. valid: header, row, column, value (and key); failed: key, reason, errors and the line.

    Reasons and their order are those of REASONS; later rules are also evaluated, so `errors` holds all that apply to the
    fields as they were tokenised. Clashing column names of raw (row, column, value, fields, ...) don't matter: only the
    four named columns are read.
    """
    lines = triplet_lines(raw.select(F.col(header).alias("hdr"), F.col(number).alias("line_no"), F.col(line).alias("raw_line"), F.col(key).alias("line_id")))
    field = lambda i: F.get(F.col("fields"), F.lit(i))
    lines = lines.withColumns({"__r": field(0), "__c": field(1), "__v": field(2)})
    digits = lambda c: F.coalesce(F.col(c).rlike(DIGITS), F.lit(False))
    inside = lambda c, top: F.coalesce(whole_number(F.col(c)).between(1, F.col(top)), F.lit(False))
    finite = F.coalesce(F.col("__v").rlike(NUMBER) & (F.col("__v").try_cast("double") < float("inf")), F.lit(False))
    three = F.coalesce(F.size("fields") == 3, F.lit(False))
    rules = [("broken_quote", ~F.col("quoted_ok")), ("field_count", ~three), ("bad_index", three & ~(digits("__r") & digits("__c"))), ("index_range", three & digits("__r") & digits("__c") & ~(inside("__r", "n_rows") & inside("__c", "n_cols"))), ("bad_value", three & ~finite)]
    valid, failed = split_rows(lines, rules)
    valid = valid.select("line_id", "hdr", whole_number(F.col("__r")).alias("row"), whole_number(F.col("__c")).alias("column"), F.col("__v").cast("double").alias("value"))
    return valid, failed.select("line_id", "hdr", "line_no", "raw_line", "reason", "errors")

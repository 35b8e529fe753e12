"""How often and in how many records every distinct term occurs: heavy terms in local arrays, the rest by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrid.runtime import materialize, release

#: Terms that are counted in local arrays: at most so many, of at most so many bytes, each with at least this share of all rows.
HEAVY_TERMS, HEAVY_BYTES, HEAVY_SHARE = 4096, 256, 1e-3
#: Counters a task keeps while it looks for heavy terms.
COUNTERS = 8192


def joined_words(line: Column, words: int = 2, sep: str = "_") -> Column:
    """The first words of a line (separated by blanks and tabs) joined by sep; null for a null or blank line."""
    text = F.regexp_replace(line, r"\A[ \t]+|[ \t]+\z", "")
    return F.when(text != "", F.array_join(F.slice(F.split(text, "[ \t]+"), 1, words), sep))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries counters of a split's short terms: every term with a share above 1 / COUNTERS of the split stays. The null term counts all rows."""
    kept: dict[str, int] = {}
    rows = 0
    for b in batches:
        term = b.column("term")
        rows += len(term)
        term = term.filter(pc.less_equal(pc.binary_length(term), HEAVY_BYTES))
        for name, n in ((x["values"], x["counts"]) for x in pc.value_counts(term).to_pylist()):
            kept[name] = kept.get(name, 0) + n
        if len(kept) > 2 * COUNTERS:
            cut = sorted(kept.values(), reverse=True)[COUNTERS]
            kept = {t: n - cut for t, n in kept.items() if n > cut}
    top = sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:COUNTERS]
    top = [(t, n) for t, n in top if n > 1 or len(top) < COUNTERS]  # in a split of many terms what occurs once isn't heavy
    yield pa.RecordBatch.from_arrays([pa.array([None, *(t for t, _ in top)], pa.string()), pa.array([rows, *(n for _, n in top)], pa.int64())], names=["term", "n"])


def heavy_terms(terms: DataFrame) -> list[str]:
    """Terms found to be frequent: sorted, at most HEAVY_TERMS. Which ones are taken affects speed only, never a count. One pass; bounded counters are shuffled."""
    found, path = materialize(terms.mapInArrow(_candidates, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "candidates")
    total = found.where("term IS NULL").agg(F.sum("n")).first()[0] or 0
    top = found.where(F.col("term").isNotNull() & (F.col("n") >= max(2, HEAVY_SHARE * total))).orderBy(F.desc("n"), "term").limit(HEAVY_TERMS)
    out = sorted(r.term for r in top.select("term").collect())
    release(terms.sparkSession, path)
    return out


def _local_counts(heavy: int):
    """Rows (code, lines) of a record's heavy terms are added into arrays that come out once, at the end of the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, records = np.zeros(heavy, np.int64), np.zeros(heavy, np.int64)
        for b in batches:
            code = b.column("code").to_numpy()
            lines += np.bincount(code, b.column("lines").to_numpy(), heavy).astype(np.int64)
            records += np.bincount(code, minlength=heavy)
        at = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lines[at]), pa.array(records[at])], names=["code", "lines", "records"])

    return run


def term_frequencies(df: DataFrame, term: Column, record: str, line: list[str]) -> DataFrame:
    """For every term that isn't null: term, n_lines, n_records.

    A line is a distinct (record, *line, term), so copied rows count once; a null record id or line number is one of its own. Heavy
    terms are found first, by bounded counters over the raw rows, and the rows are split by term before anything is shuffled:

    * heavy: the term becomes a code (the broadcast list is bounded in number and bytes). Copies are dropped by (code, record, line), numbers
      only, within each split first; what is left, one row for a code and record, is added into exact arrays of each split.
    * light, of at most HEAVY_BYTES: rows are shuffled once, by term, and counted where they are: no such term is frequent.
    * longer terms aren't listed: they are shuffled by all columns and reduced step by step, so a frequent one is no hot spot either.

    The lines are read twice: for the counters, and to write the three parts, each by itself. An empty table gives no rows.
    """
    spark = df.sparkSession
    keys = ["record", *(f"__l{i}" for i in range(len(line)))]
    lines = df.select(term.alias("term"), F.col(record).alias("record"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(line)]).where("term IS NOT NULL")
    heavy = heavy_terms(lines.select("term"))
    listed = spark.createDataFrame(list(zip(heavy, range(len(heavy)), strict=True)), "term string, code int")
    known = F.col("code").isNotNull()
    part = F.when(known, 0).when(F.octet_length("term") <= HEAVY_BYTES, 1).otherwise(2)
    coded, _ = materialize(lines.join(F.broadcast(listed), "term", "left").select(F.when(~known, F.col("term")).alias("term"), "code", *keys, part.alias("part")), "lines", "part")
    of = lambda n: coded.where(F.col("part") == n)
    count = lambda x, by: x.groupBy(*by).agg(F.count("*").alias("lines"))
    total = lambda x, by: x.groupBy(by).agg(F.sum("lines").alias("n_lines"), F.sum("records").alias("n_records"))

    often = count(of(0).select("code", *keys).distinct(), ["code", "record"]).select("code", "lines")
    often = total(often.mapInArrow(_local_counts(len(heavy)), "code int, lines long, records long"), "code")
    out = often.join(F.broadcast(listed), "code").select("term", "n_lines", "n_records")
    for x in (of(1).select("term", *keys).repartition("term"), of(2).select("term", *keys)):
        out = out.unionByName(total(count(x.distinct(), ["term", "record"]).select("term", "lines", F.lit(1).alias("records")), "term"))
    return out


def with_marks(counts: DataFrame, records: DataFrame, fewest: int = 3, share: float = 0.5) -> DataFrame:
    """Add `rare` (in fewer than `fewest` records) and `common` (in more than `share` of all records); records: their distinct ids."""
    whole = records.agg(F.count("*").alias("__whole"))
    return counts.join(F.broadcast(whole)).withColumns({"rare": F.col("n_records") < fewest, "common": F.col("n_records") > share * F.col("__whole")}).drop("__whole")

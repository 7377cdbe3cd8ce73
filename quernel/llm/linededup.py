"""Repeated passages of lines, found by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.store import free_name, join_groups, saved


def _with(value: Column, f) -> Column:
    """f(value), with value worked out once: a column named beforehand may be put into each turn of a lambda.

    Inside, get() takes one element; slice() would copy the whole array each time.
    """
    return F.transform(F.array(value), f)[0]


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def window_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, text_hash, pos, window) of each run of ``size`` lines; runs of blank lines only are left out."""
    each = F.transform(_lines(text), lambda x: F.struct(F.unhex(F.md5(x)).alias("h"), F.length(F.translate(x, "\r\t ", "")).cast("int").alias("n")))

    def run(own: Column, i: Column) -> Column:
        several = [F.get(own, i + j) for j in range(size)]
        full = F.greatest(*[x.n for x in several]) > 0 if size > 1 else several[0].n > 0
        return F.struct(i.alias("pos"), F.when(full, F.unhex(F.md5(F.concat(*[x.h for x in several])))).alias("window"))

    # an outer explode, as others get a filter that works the array out once more
    runs = _with(each, lambda own: F.when(F.size(own) >= size, F.transform(F.sequence(F.lit(0), F.size(own) - size), lambda i: run(own, i))))
    found = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), runs.alias("runs"))  # no text beside each run
    return found.select("id", "text_hash", F.explode_outer("runs").alias("run")).select("id", "text_hash", "run.pos", "run.window").where("window is not null")


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, text_hash, starts): where windows begin that also occur earlier, by doc_id and then by line; in order."""
    found = saved(window_occurrences(docs, key, text, size), "windows")
    place = F.struct("id", "text_hash", "pos")
    groups = saved(
        found.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated"
    )
    again = join_groups(found, groups, "window", "n", how="inner").where(~place.eqNullSafe(F.col("first")))
    return again.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of the text, plus n_lines and n_removed.

    A window is ``size`` consecutive lines (cut at line feeds, compared as they are, by MD5). Of all
    occurrences of a window in the whole table the first, by doc_id (null first) and then by line, stays; the
    lines that later ones cover are removed together. So a repeated passage of three lines or more goes, each
    removed line still stands in an earlier place, and a text without repeated windows is unchanged. Texts of
    fewer lines than a window, windows of blank lines only, empty and null texts (null: no lines) are left
    alone. Rows equal in doc_id and text are one place, and are cleaned alike. Columns named n_lines or
    n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    own, i, h, starts = (free_name(docs, x) for x in ("own_hash", "its_id", "its_hash", "starts"))
    later = later_windows(docs, key, text, size).select(F.col("id").alias(i), F.col("text_hash").alias(h), F.col("starts").alias(starts))
    joined = docs.withColumn(own, F.xxhash64(text)).join(later, F.col(key).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left")

    def kept(x: Column) -> Column:
        """Lines between what the windows cover: a gap ends at each start, and begins size lines after the last one."""
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(x.starts)),
            lambda k: F.struct(
                F.when(k > 0, F.get(x.starts, k - 1) + size).otherwise(0).alias("a"), F.when(k < F.size(x.starts), F.get(x.starts, k)).otherwise(F.size(x.lines)).alias("z")
            ),
        )
        return F.flatten(F.transform(F.filter(gaps, lambda g: g.z > g.a), lambda g: F.transform(F.sequence(g.a, g.z - 1), lambda k: F.get(x.lines, k))))

    both = _with(F.struct(_lines(text).alias("lines"), F.col(starts).alias("starts")), lambda x: _with(kept(x), lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(k).alias("n"))))
    clean = free_name(docs, "clean")
    n = F.when(F.col(text).isNotNull(), F.size(_lines(text))).otherwise(0).cast("long")
    out = joined.withColumn("n_lines", n).withColumn(clean, F.when(F.col(starts).isNotNull(), both))
    removed = F.when(F.col(starts).isNotNull(), F.col("n_lines") - F.col(f"{clean}.n")).otherwise(0).cast("long")
    out = out.withColumn("n_removed", removed).withColumn(text, F.when(F.col(starts).isNotNull(), F.col(f"{clean}.text")).otherwise(F.col(text)))
    return out.drop(own, i, h, starts, clean)

"""Converted documents: Markdown files as sections with their headings' path, and chunks that end where sections end.

A heading is a line of one to six # and a blank, outside of fenced code. The path of a section is the stack of headings above it:
the last heading of each level that no heading of a smaller level has followed. Only headings and fences are put in order by a
window; texts are joined to them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 6
_HEADING = r"^#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$"
_FENCE = r"^[ \t]{0,3}(?:```|~~~)"


def artifacts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of whole files; \\r\\n counts as \\n."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("text"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sections(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section_no, level, title, headings, first_line, n_lines, text): the sections of each text, in order.

    What stands before the first heading is section 0 with level 0 and no title, if it has a line that is not blank; the others are
    numbered from 1. ``headings`` is the path from the outermost heading to the section's own. Lines count from 0, the heading's line is a section's first. Null and blank texts have
    no section. ``key`` must be unique and not null.
    """
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    marked = F.filter(F.transform(_lines(F.col("_text")), lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda m: m["line"].rlike(_HEADING) | m["line"].rlike(_FENCE))
    marks = known.select(key, F.explode(marked).alias("m")).select(key, "m.at", "m.line")
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(_FENCE)
    headings = marks.withColumn("fences", F.count_if(fence).over(before)).where(~fence & (F.col("fences") % 2 == 0))
    headings = headings.withColumn("level", F.length(F.regexp_extract("line", "^#+", 0))).withColumn("title", F.regexp_extract("line", _HEADING, 1))
    last = [F.max(F.when(F.col("level") == k, F.struct("at", "title"))).over(before) for k in range(1, LEVELS + 1)]
    rows = headings.withColumns({f"_h{k}": h for k, h in enumerate(last, 1)}).withColumn("section_no", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    stack = []
    for k in range(1, LEVELS + 1):
        open_ = F.col(f"_h{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_h{j}").isNull() | (F.col(f"_h{k}.at") > F.col(f"_h{j}.at")))
        stack.append(F.when(open_, F.col(f"_h{k}.title")))
    rows = rows.withColumn("headings", F.array_compact(F.array(*stack)))
    end = F.lead("at").over(Window.partitionBy(key).orderBy("at"))
    own = rows.select(key, F.struct("section_no", "level", "title", "headings", F.col("at").alias("first_line"), end.alias("end")).alias("s"))
    grouped = own.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    both = known.join(grouped, key, "left")
    first = F.coalesce(F.col("s")[0]["first_line"], F.lit(None).cast("int"))
    lead = F.struct(F.lit(0).alias("section_no"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"), F.lit(0).alias("first_line"), first.alias("end"))
    each = both.select(key, _lines(F.col("_text")).alias("l"), F.explode(F.concat(F.array(lead), F.coalesce("s", F.array().cast(own.schema["s"].dataType.simpleString().join(["array<", ">"]))))).alias("s"))
    n = F.coalesce(F.col("s.end"), F.array_size("l")) - F.col("s.first_line")
    out = each.withColumn("n_lines", n).withColumn("text", F.array_join(F.slice("l", F.col("s.first_line") + 1, F.greatest(F.col("n_lines"), F.lit(0))), "\n"))
    return out.where("s.section_no > 0 or text rlike '[^ \\\\t\\\\n]'").select(key, "s.section_no", "s.level", "s.title", "s.headings", "s.first_line", "n_lines", "text")


def section_chunks(parts: DataFrame, size: int, key: str = "path") -> DataFrame:
    """(key, section_no, chunk_no, headings, chunk): sections in pieces of at most ``size`` characters, none of which goes over a section's end."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size))
    return parts.select(key, "section_no", "headings", "text", F.posexplode(starts).alias("chunk_no", "start")).select(key, "section_no", "chunk_no", "headings", F.substring("text", F.col("start"), F.lit(size)).alias("chunk"))

"""Quality rules with thresholds that adapt to each language and source.

The measures of a document are whole numbers (shares in thousandths), computed by built-in
functions row by row. Their distribution per language and source is kept in a mergeable quantile
sketch: a log-linear histogram whose bucket is a value without all but its six leading bits, so
that a quantile is off by 1/32 of its value at most. Histograms merge by adding counts, so
the sketch is an ordinary aggregate with a map-side part, a hot source costs no more than any other,
and those of a language or of everything come from the same counts.

A document fails a rule beyond the fence ``q75 + 3 * (q75 - q25) + slack`` (and, for the word length,
below ``q25 - 3 * (q75 - q25) - slack``). The slack keeps ordinary documents where a group is
nearly constant. A group of fewer than ``least_docs`` documents uses its language's sketch, or that
of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACE_RE, WHITE, cut_lineage, fresh, let, written

#: measure: slack above, slack below (None: no lower fence)
RULES: dict[str, tuple[int, int | None]] = {
    "symbol_share": (50, None),
    "upper_share": (200, None),
    "dup_line_share": (300, None),
    "word_length": (200, 200),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RULES]


def _split_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_RE)).otherwise(F.array().cast("array<string>"))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash is there twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(o: Column) -> Column:
        same = lambda x, j: F.get(o, j)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(o, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - v, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return let(let(ordered, repeated), total)


def _repeat_words(words: Column, width: int) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
    )
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, width)).otherwise(0))
    return F.when(F.size(words) >= width, counted).otherwise(0).cast("long")


def with_measures(docs: DataFrame, width: int = 5, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """``docs`` and its measures; columns of the same names, and ``kept``, are replaced. A null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, width).alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    spoken = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    of_words, of_lines, upper = fresh([*docs.columns, *MEASURES], "_words", "_lines", "_upper")
    out = docs.drop(*MEASURES, "kept").withColumns(
        {
            of_words: let(_split_words(text), words),
            of_lines: let(spoken, lines),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            upper: F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        }
    )
    chars = F.greatest(F.col(f"{of_words}.word_chars"), F.lit(1))
    return (
        out.withColumns(
            {
                "n_words": F.col(f"{of_words}.n_words"),
                "word_chars": F.col(f"{of_words}.word_chars"),
                "n_dup_lines": F.col(f"{of_lines}.dup"),
                "n_repeat_words": F.col(f"{of_words}.n_repeat_words"),
                "symbol_share": F.floor(F.col("n_symbols") * 1000 / chars),
                "upper_share": F.floor(F.col(upper) * 1000 / chars),
                "dup_line_share": F.floor(F.col(f"{of_lines}.dup") * 1000 / F.greatest(F.col(f"{of_lines}.n"), F.lit(1))),
                "word_length": F.floor(F.col(f"{of_words}.word_chars") * 100 / F.greatest(F.col(f"{of_words}.n_words"), F.lit(1))),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated))
        .drop(of_words, of_lines, upper)
    )


def bucket(value: Column) -> Column:
    """The value without all but its six leading bits: the lower end of its histogram bucket."""
    size = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, size), size))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in RULES]))
    return (
        measured.where("not base_failed")
        .select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), pairs.alias("x"))
        .groupBy("lang", "source", "x.measure", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(counts: DataFrame, least_docs: int = 50) -> DataFrame:
    """(lang, source, <measure>_hi, <measure>_lo): one row for each language and source of the sketch."""
    counts = cut_lineage(counts)
    levels = None
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        part = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*keys, "measure")
        ranked = part.withColumns({"upto": F.sum("n").over(order.orderBy("bucket")), "total": F.sum("n").over(order)})
        at = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket")))
        cut = ranked.groupBy(*keys, "measure", "total").agg(at(1).alias("q25"), at(3).alias("q75"))
        cut = cut.toDF(*[c if c in ("lang", "source", "measure") else f"{c}{level}" for c in cut.columns])
        groups = counts.select("lang", "source", "measure").distinct() if levels is None else levels
        levels = groups.join(cut, [*keys, "measure"], "left")
    pick = lambda q: F.when(F.col("total0") >= least_docs, F.col(f"{q}0")).when(F.col("total1") >= least_docs, F.col(f"{q}1")).otherwise(F.col(f"{q}2"))
    chosen = levels.select("lang", "source", "measure", pick("q25").alias("q25"), pick("q75").alias("q75"))
    reach = 3 * (F.col("q75") - F.col("q25"))
    columns = []
    for m, (above, below) in RULES.items():
        columns.append(F.max(F.when(F.col("measure") == m, F.col("q75") + reach + above)).alias(f"{m}_hi"))
        columns.append(F.max(F.when(F.col("measure") == m, F.col("q25") - reach - (below or 0))).alias(f"{m}_lo"))
    return chosen.groupBy("lang", "source").agg(*columns)


def judge(measured: DataFrame, limits: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """``measured`` and ``kept``; a document whose group has no fences is judged by the base rules alone.

    The fences go to every task while there are at most ``most_broadcast`` groups (under
    20 MB); beyond that it is a shuffled join, whose hot sources adaptive execution splits.
    """
    names = dict(zip(limits.columns, fresh(measured.columns, *[f"_{c}" for c in limits.columns]), strict=True))
    limits = cut_lineage(limits.withColumnsRenamed(names))
    side = F.broadcast(limits) if limits.count() <= most_broadcast else limits
    on = (F.coalesce("lang", F.lit("")) == F.col(names["lang"])) & (F.coalesce("source", F.lit("")) == F.col(names["source"]))
    failed = F.col("base_failed")
    for m, (_, below) in RULES.items():
        failed = failed | F.coalesce(F.col(m) > F.col(names[f"{m}_hi"]), F.lit(False))
        if below is not None:
            failed = failed | F.coalesce(F.col(m) < F.col(names[f"{m}_lo"]), F.lit(False))
    return measured.join(side, on, "left").withColumn("kept", ~failed).drop(*names.values())


def quality_rules(docs: DataFrame, keep_text: bool = False, least_docs: int = 50) -> DataFrame:
    """Measures and verdict of every row of ``docs``.

    With ``keep_text`` all columns of ``docs`` stay (those with the names of measures, and ``kept``, are replaced), and the
    texts are written once beside their measures, which are then read alone for the sketches; else only doc_id, lang and
    source stay. Null lang or source count as an empty name; a null text has no words and fails the base rules;
    repeated rows each count and are each judged.
    """
    measured = with_measures(docs if keep_text else docs.select("doc_id", "text", "lang", "source"))
    measured = written(measured) if keep_text else cut_lineage(measured.select("doc_id", "lang", "source", *MEASURES))
    return judge(measured, fences(sketch(measured), least_docs))

"""Personal data by candidate spans and gradient boosting, in DataFrame operations only.

Generators of high recall propose spans, which may overlap: the base patterns (e-mail address, IP address, card and phone number),
and wider ones for other spellings: an address with its signs spelled out, defanged and version-6 IP addresses, sixteen digits inside a longer
run of digits, numbers with other separators, phone numbers without a country code. A match's place is the running sum of the lengths of
the pieces between matches and of the matches before it.

Every candidate has a few small numbers for its form (digits, groups, separators, check digits) and its context (neighbours, words
before it). Boosted trees are trained on base matches, which pass or fail their checks, each taken once with and once without the outcome of the
checks, so that form and context count by themselves; and on short examples of the wider spellings that are built from a rule.
Training sees counts by distinct feature vector, whose number does not grow with the input beyond the ranges of the features.
Margins are calibrated on held-out documents by isotonic regression, and a kind's threshold is the lowest margin that is
right in ``sure`` of the cases. Trees become nested conditions over columns.

Base spans always stay. Of other spans that overlap in a chain the one with the highest margin is taken, and none if a base span is in the chain.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import quoted, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: (kind, base, what a text must have at least, pattern). Quantifiers that can't give back are possessive: no recursion and one pass over a text of any form.
_LOCAL = r"[A-Za-z0-9._%+-]"
_AT = r"(?: ?[\[({<] ?(?:at|At|AT|@) ?[\])}>] ?| ?@ ?| ?\x{FF20} ?| (?:at|AT) )"
_DOT = r"(?: ?[\[({<] ?(?:dot|Dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)"
GENERATORS = (
    (EMAIL, True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (IP, True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (CARD, True, "[0-9][ -]?[0-9]", r"[0-9](?:[ -]?+[0-9])++"),
    (PHONE, True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    (EMAIL, False, r"@|\x{FF20}|\b(?:at|At|AT)\b", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,5}}+"),
    (IP, False, r"[0-9](?:\[|\(|\{| ?\. ?)", r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)| \. )[0-9]{1,3}+){3}(?![0-9])"),
    (IP, False, ":", r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"),
    (CARD, False, "[0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ ./\x{2013}\x{00A0}_-]?[0-9]{4}){3}(?![0-9])"),
    (CARD, False, "3[47][0-9]", r"(?<![0-9])3[47][0-9]{2}[ ./-]?[0-9]{6}[ ./-]?[0-9]{5}(?![0-9])"),
    (PHONE, False, "[0-9]{2}[ )./-]", r"(?<![0-9A-Za-z+.,-])(?:\(0[0-9]{1,5}\)|0[0-9]{1,6}|\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ ./-]{1,3}+[0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,4}+(?![0-9A-Za-z.,-][0-9])"),
)
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
_PARTS = rf"^(?:{_PART}(?:\.|$)){{4}}$"
#: Words before a candidate: of the four kinds, and those of other numbers.
WORDS = (
    "e-?mail|mail|kontakt|contact|contacto|correo|courriel|adresse|address|write|schreib",
    r"ip|host|server|serveur|servidor|addr|client|login|ping|from",
    r"card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit|pay|cc",
    r"tel|phone|fon|telefon|tel[ée]fono|t[ée]l[ée]phone|call|mobile?|mobil|fax|sms|whatsapp|ruf|anruf|cell",
    r"isbn|issn|version|release|order|invoice|rechnung|bestell|date|datum|fecha|section|serial|sku|part|item|total|sum|page|chapter|build|v",
)
#: Features of a candidate, in the order of the vector.
FEATURES = ("kind", "digits", "groups", "checked", "separators", "left", "right", "words", "fits", "near", "spelled", "shape", "length")
UNKNOWN = -1
_BEFORE, _AFTER = 24, 6


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _beside(x: Column) -> Column:
    """0 white space, an end or brackets and quotes; 1 other signs; 2 a letter or digit."""
    return F.when(x.rlike(r"[\p{L}\p{N}]"), 2).when(x.rlike(r"""[^\s()\[\]"'<>,;:]"""), 1).otherwise(0)


def _checked(kind: int, base: bool, hit: Column) -> Column:
    """Whether a match passes the checks of its kind."""
    digits = _digits(hit)
    if kind == EMAIL:
        return F.lit(True) if base else hit.rlike(r"[A-Za-z]{2,6}$")
    if kind == IP:
        return hit.rlike(_PARTS) if base else F.when(F.instr(hit, ":") > 0, True).otherwise(F.regexp_replace(hit, "[^0-9]+", ".").rlike(_PARTS))
    if kind == CARD:
        known = F.length(hit) <= 40
        return known & F.when(known, F.length(digits).between(16 if base else 15, 19) & F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(8 if base else 7, 15)


def _features(kind: Column, checked: Column, hit: Column, before: Column, after: Column) -> Column:
    """The feature vector as an array of small numbers, from the beginning of a match and what is beside it."""
    digits = F.length(_digits(hit))
    gaps = F.regexp_extract_all(hit, F.when(kind == EMAIL, "[^A-Za-z0-9]+").otherwise("[^0-9]+"), F.lit(0))
    words = reduce(lambda out, i: F.when(before.rlike(rf"(?i)(?<!\p{{L}})(?:{WORDS[i]})\p{{L}}{{0,4}}[^\p{{L}}]{{0,6}}$"), i + 1).otherwise(out), [4, 3, 2, 1, 0], F.lit(0))
    ends = F.length(F.when(kind == EMAIL, F.regexp_extract(hit, "[A-Za-z]*$", 0)).otherwise(F.regexp_extract(hit, "[0-9]*$", 0)))
    shape = (
        F.when(hit.rlike(r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})$"), 1)
        .when(hit.rlike(r"^\(?[0-9]{3}\)?[ .-]+[0-9]{3}[ .-][0-9]{4}$"), 2)
        .when(hit.rlike(r"^[0-9]{4}[^0-9]?[0-9]{4}[^0-9]?[0-9]{4}[^0-9]?[0-9]{4}$"), 3)
        .when(hit.rlike(r"^\(?0[0-9]"), 4)
        .otherwise(0)
    )
    values = {
        "kind": kind,
        "digits": F.least(digits, F.lit(20)),
        "groups": F.least(F.array_size(gaps), F.lit(9)),
        "checked": checked,
        "separators": F.least(F.array_size(F.array_distinct(gaps)), F.lit(3)),
        "left": _beside(F.substring(before, -1, 1)),
        "right": _beside(F.substring(after, 1, 1)),
        "words": words,
        "fits": words == kind + 1,
        "near": before.rlike(r"[0-9][^0-9]{0,3}$") | after.rlike(r"^[^0-9]{0,3}[0-9]"),
        "spelled": hit.rlike(r"[\[({<].*[\])}>]|\+| (?:at|AT|dot|DOT) ").cast("int") + hit.rlike(r"[\[({<] ?(?:at|At|AT|@|dot|Dot|DOT|\.)|\x{FF20}").cast("int"),
        "shape": shape,
        "length": F.least(ends, F.lit(7)),
    }
    return F.array(*(values[n].cast("byte") for n in FEATURES))


_MATCH = "generator tinyint, place int, gap int, size int, checked boolean, hit string, before string, after string"


def _matches(text: Column, number: int) -> Column:
    """What a generator finds in a text, in order: lengths of the piece before each match and of the match, its checks, its beginning and what is beside it."""
    kind, base, least, pattern = GENERATORS[number]
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.greatest(F.array_size(hits), F.lit(0))
    found = F.transform(
        F.arrays_zip(F.slice(pieces, 1, size).alias("g"), hits.alias("h"), F.slice(pieces, 2, size).alias("n")),
        lambda m, i: F.struct(
            F.lit(number).cast("byte").alias("generator"),
            i.alias("place"),
            F.length(m["g"]).alias("gap"),
            F.length(m["h"]).alias("size"),
            _checked(kind, base, m["h"]).alias("checked"),
            F.substring(m["h"], 1, 80).alias("hit"),
            F.substring(m["g"], -_BEFORE, _BEFORE).alias("before"),
            F.substring(m["n"], 1, _AFTER).alias("after"),
        ),
    )
    return F.when(text.rlike(least) & text.rlike(pattern), found)


def candidates(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """(*keep, row, generator, kind, base, checked, start, end, x): every candidate span of each row, and a row of nulls for a row without one.

    ``row`` numbers the rows; places are code points, the end exclusive.
    """
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    none = F.array().cast(f"array<struct<{_MATCH.replace(' ', ':').replace(',:', ',')}>>")
    every = F.concat(*(F.coalesce(_matches(F.col("t"), n), none) for n in range(len(GENERATORS))))
    able = F.col("t").rlike(r"[0-9@]|\x{FF20}|::|\b(?:at|At|AT)\b")
    rows = docs.select(*keep, whole.alias("t")).select("*", F.monotonically_increasing_id().alias("row"))
    own = [c for c in rows.columns if c != "t"]
    found = rows.select(*own, F.explode_outer(F.when(able, every)).alias("m")).select(*own, "m.*")
    generator = F.col("generator")
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in GENERATORS)), generator + 1)
    base = F.element_at(F.array(*(F.lit(b) for _, b, *_ in GENERATORS)), generator + 1)
    found = found.select(*own, "generator", "place", "gap", "size", "checked", "hit", "before", "after", kind.alias("kind"), base.alias("base"))
    x = F.when(generator.isNotNull(), _features(F.col("kind"), F.col("checked"), F.col("hit"), F.col("before"), F.col("after")))
    found = found.select(*own, "generator", "kind", "base", "checked", "place", "gap", "size", x.alias("x"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "generator").orderBy("place"))
    return found.select(*own, "generator", "kind", "base", "checked", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"), "x")


# ------------------------------------------------------------------- training

#: Words around the examples: those that tell the kind, and those that tell against it.
_TELLING = {EMAIL: ("email: ", "contact ", "Kontakt: ", "write to "), IP: ("ip ", "server ", "host: ", "from "), CARD: ("card: ", "visa ", "Karte ", "carte: "), PHONE: ("tel: ", "call ", "Telefon ", "fax: ")}
_AGAINST = ("version ", "order ", "isbn ", "invoice ", "date ", "page ")
_NEUTRAL = ("the ", "und ", "de la ", "x. ", "")
_RIGHT = {
    EMAIL: ("ann.lee[at]mail.example.com", "bob (at) example (dot) org", "eve @ example.net", "kim AT example DOT com", "joe{at}web.example.de", "pat@ example.com", "sam＠example.com", "liz <at> example <dot> fr"),
    IP: ("10[.]2[.]33[.]4", "192(.)168(.)7(.)1", "172[dot]16[dot]0[dot]9", "2001:db8:0:1:2:3:4:5", "fe80::1:2a3b", "2001:db8::8a2e:370:7334", "8{.}8{.}4{.}4"),
    CARD: ("4111.1111.1111.1111", "5500/0000/0000/0004", "3782 822463 10005", "371449635398431", "4111_1111_1111_1111", "12 4111111111111111", "6011111111111117 4111111111111111"),
    PHONE: ("(017) 555-7713", "030 1234567", "0171/555 66 77", "(415) 555-2671", "089-5550123", "415 555 2671", "04 91 55 01 23", "0211 / 555 12 34"),
}
_WRONG = {
    EMAIL: ("look at home.then", "met at noon.We", "was at school.and", "3 @ 4.50", "2 @ 1.99", "stay at sea.level", "sold at 12.50"),
    IP: ("300[.]2[.]33[.]4", "1 . 2 . 3 . 999", "5(.)666(.)7(.)8", "12::34"),
    CARD: ("4111.1111.1111.1112", "5500/0000/0000/0005", "3782 822463 10006", "1234567890123456", "1111 2222 3333 4445", "12 4111111111111112"),
    PHONE: ("01/02/2003", "03.04.2005", "05-06-2007", "250 300 400", "300 400", "0.5 0.25", "02 03", "550-600 20", "012 2003"),
}


def examples() -> list[tuple[int, int, str, int]]:
    """(kind, 1 if personal data, text, weight): every spelling among words for, against and neither; look-alikes without words for them."""
    out = []
    for kind in range(4):
        for text in _RIGHT[kind]:
            out += [(kind, 1, f"{w}{text} and", 2) for w in _TELLING[kind]] + [(kind, 1, f"{w}{text}. So", 1) for w in _NEUTRAL]
            if kind in (CARD, PHONE):
                out += [(kind, 0, f"{w}{text} and", 1) for w in _AGAINST if kind == PHONE]
        for text in _WRONG[kind]:
            out += [(kind, 0, f"{w}{text} and", 2) for w in (*_NEUTRAL, *_AGAINST)] + [(kind, 0, f"{w}{text}.", 1) for w in _TELLING[kind]]
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted trees: each a nested tuple (feature, cut, left, right) or a leaf's value; and a threshold for each kind."""

    first: float
    trees: tuple
    thresholds: tuple[float, ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.first + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def margin(self, x: str) -> Column:
        """The margin of a feature vector as nested conditions."""

        def grown(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            feature, cut, left, right = tree
            return f"case when {name}[{feature}] <= {cut} then {grown(left)} else {grown(right)} end"

        name = f"`{x}`"
        return F.expr(" + ".join([f"{self.first!r}D", *map(grown, self.trees)]))

    def passes(self, margin: Column, kind: Column) -> Column:
        limit = F.element_at(F.array(*(F.lit(t) for t in self.thresholds)), kind + 1)
        return margin >= limit


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), float(tree))
    feature, cut, left, right = tree
    return np.where(x[:, feature] <= cut, _values(left, x), _values(right, x))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float, ridge: float):
    """A tree of Newton steps: the split with the largest gain on each level."""
    total, best = slope.sum() ** 2 / (curve.sum() + ridge), (1e-6, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            a, b = slope[left].sum(), curve[left].sum()
            gain = a**2 / (b + ridge) + (slope.sum() - a) ** 2 / (curve.sum() - b + ridge) - total
            if gain > best[0] + 1e-12:
                best = (gain, (f, int(cut), left))
    if best[1] is None:
        return float(rate * slope.sum() / (curve.sum() + ridge))
    f, cut, left = best[1]
    return (f, cut, _grow(x[left], slope[left], curve[left], depth - 1, rate, ridge), _grow(x[~left], slope[~left], curve[~left], depth - 1, rate, ridge))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[float, tuple]:
    """Gradient boosting on weighted counts of both outcomes for each distinct feature vector (logistic loss)."""
    first = float(np.log((yes.sum() + 1) / (no.sum() + 1)))
    margin, trees = np.full(len(x), first), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(x, yes - (yes + no) * p, (yes + no) * p * (1 - p), depth, rate, ridge))
        margin = margin + _values(trees[-1], x)
    return first, tuple(trees)


def calibrated(margin: np.ndarray, yes: np.ndarray, no: np.ndarray, sure: float) -> float:
    """The margin from which on the isotonic fit of the outcomes is ``sure``, halfway to the next lower one seen; infinite if there is none."""
    blocks: list[list[float]] = []  # lowest and highest margin, yes, all; neighbours whose shares fall are pooled
    for i in np.argsort(margin, kind="stable"):
        if blocks and blocks[-1][1] == margin[i]:
            blocks[-1][2:] = [blocks[-1][2] + yes[i], blocks[-1][3] + yes[i] + no[i]]
        else:
            blocks.append([margin[i], margin[i], yes[i], yes[i] + no[i]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, more, n = blocks.pop()
            blocks[-1][1:] = [high, blocks[-1][2] + more, blocks[-1][3] + n]
    at = next((k for k, (_, _, y, n) in enumerate(blocks) if n > 0 and y >= sure * n), None)
    if at is None:
        return float(np.inf)
    return float((blocks[at][0] + blocks[at - 1][1]) / 2 if at else blocks[at][0] - 1e-6)


def _counts(rows: DataFrame, most_vectors: int) -> np.ndarray:
    """(features..., held out, yes, no) by distinct vector: at most ``most_vectors`` of them, the first by a hash."""
    own = rows.groupBy("x", "held").agg(F.sum(F.col("yes") * F.col("weight")).alias("yes"), F.sum((1 - F.col("yes")) * F.col("weight")).alias("no"))
    found = own.orderBy(F.xxhash64("x"), "x", "held").limit(most_vectors).collect()
    return np.array([[*r["x"], r["held"], r["yes"], r["no"]] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES) + 3)


def train(found: DataFrame, sure: float = 0.95, most_vectors: int = 20_000) -> Trees:
    """Trees from ``candidates`` and the examples. At most ``most_vectors`` counts of distinct feature vectors come to the driver."""
    spark, at = found.sparkSession, FEATURES.index("checked")
    masked = F.transform("x", lambda v, i: F.when(i == at, F.lit(UNKNOWN).cast("byte")).otherwise(v))
    judged = found.where("base").select("x", F.col("checked").cast("int").alias("yes"), (F.pmod(F.xxhash64("row"), F.lit(3)) == 0).cast("int").alias("held"), F.lit(1).alias("weight"))
    judged = judged.unionByName(judged.withColumn("x", masked))
    given = spark.createDataFrame(examples(), "k int, yes int, text string, weight int")
    shown = candidates(given, "text", "k", "yes", "weight").where("kind = k and not base").select("x", "yes", F.lit(0).alias("held"), "weight")
    n = len(FEATURES)
    own, seeds = _counts(judged, most_vectors), _counts(shown, most_vectors)
    fit, held = own[own[:, n] == 0], own[own[:, n] == 1]
    share = seeds[:, n + 1 :].sum() / max(fit[:, n + 1 :].sum(), 1)  # base matches weigh as much as the examples, however many there are
    fit = np.concatenate((fit * np.array([1.0] * (n + 1) + [min(share, 1.0)] * 2), seeds))
    first, trees = boost(fit[:, :n], fit[:, n + 1], fit[:, n + 2])
    model = Trees(first, trees, (np.inf,) * len(KINDS))
    hold = np.concatenate((held * np.array([1.0] * (n + 1) + [min(2 * share, 1.0)] * 2), seeds))
    hold = hold[hold[:, at] != UNKNOWN]  # as in use, checks are known
    limits = []
    for kind in range(len(KINDS)):
        own = hold[hold[:, 0] == kind]
        limits.append(calibrated(model.margins(own[:, :n]), own[:, n + 1], own[:, n + 2], sure))
    return Trees(first, trees, tuple(limits))


# ------------------------------------------------------------------- selection


def select(found: DataFrame, model: Trees) -> DataFrame:
    """The spans to redact of ``candidates``: base spans that pass their checks, and others that pass their threshold, by the rule of the module."""
    kept = [c for c in found.columns if c not in ("x", "generator", "checked")]
    margin = F.when(F.col("base"), float("inf")).otherwise(model.margin("x"))
    passed = found.withColumn("margin", margin).where(F.when(F.col("base"), F.col("checked")).otherwise(F.col("checked") & model.passes(F.col("margin"), F.col("kind"))))
    by_start = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    chained = passed.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(by_start))
    best = Window.partitionBy("row", "chain").orderBy(F.desc("margin"), F.desc(F.col("end") - F.col("start")), "kind", "start")
    return chained.withColumn("n", F.row_number().over(best)).where("base or n = 1").select(*kept)


def _spans(rows: Column) -> Column:
    """kind:start:end, by kind, then start, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    one = lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(rows), one), ",")


def personal_data(docs: DataFrame, text: str = "text", sure: float = 0.95, most_vectors: int = 20_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) for each row of ``docs``.

    ``n_...`` and ``base_spans`` are of base spans, ``spans`` has the added ones, too; spans are written kind:start:end (code points, end exclusive) by kind, then
    start, and joined by commas. Null and empty texts have none. Repeated rows and rows without doc_id get their results each. Other columns are ignored.

    Candidates, a few numbers each, are written once; texts are read once and never moved. Windows run over the
    candidates of one text, the only unit that is taken together.
    """
    found = written(candidates(docs, text, quoted("doc_id").cast("long").alias("doc_id")))
    model = train(found.where("generator is not null"), sure, most_vectors)
    chosen = select(found.where("generator is not null"), model)
    every = found.select("doc_id", "row").distinct().select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("kind", "int"), ("base", "boolean"), ("start", "int"), ("end", "int"))))
    span = F.struct("kind", "start", "end")
    return (
        chosen.unionByName(every)
        .groupBy("row", "doc_id")
        .agg(
            *(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{name}") for k, name in enumerate(KINDS)),
            _spans(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"),
            _spans(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"),
        )
        .drop("row")
    )


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id unique and not null) with every span of ``personal_data`` in ``text`` replaced by its kind in brackets.

    Where spans overlap, the first by start (the longer one, if they start alike) is replaced, and of the next what is left of it.
    """
    spans = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), (-F.split(s, ":")[2].cast("int")).alias("end"), F.split(s, ":")[0].alias("kind")))
    whole = quoted(text)
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(-s["end"] <= a["at"], a).otherwise(
            F.struct((-s["end"]).alias("at"), F.concat(a["out"], F.substring(whole, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole))),
    )
    joined = docs.join(found.select("doc_id", F.col("spans")), "doc_id", "left")
    return joined.withColumn(text, F.when(whole.isNull(), None).otherwise(F.when(F.coalesce("spans", F.lit("")) == "", whole).otherwise(done))).drop("spans")

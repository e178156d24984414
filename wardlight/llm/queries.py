"""The registered queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan as _license
from .fingerprints import document_fingerprints
from .hard_negatives import hard_negatives
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .pii import personal_data
from .quality_classifier import quality_classifier
from .quality_rules import RULES, quality_rules
from .resampling import BUCKETS, LEAST_WORDS, resample
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts

TOKEN_LIMIT = 4096

#: Target weights of the mixing query and of the pipeline's mixing stage.
MIX_WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 5, "reference": 3, "forum": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 4, "src1": 2},
}
MIX_PERCENT = 90
MIX_EPOCHS = 3
MIX_SEED = 17


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def domain_of(source: str = "source") -> Column:
    """The domain that a source belongs to, by the number in its name."""
    number = F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint)"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "reference").otherwise("forum")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are taken in which epoch, to reach the target weights."""
    return mix(documents(spark, sf_dir), domain_of(), percent=MIX_PERCENT, max_epochs=MIX_EPOCHS, weights=MIX_WEIGHTS, seed=MIX_SEED)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, by 5-word shingles at similarity 0.75."""
    return near_duplicates(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 100-byte strings which start earlier cover."""
    return suffix_dedup(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of all documents."""
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and how much of each fits the limit."""
    return token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), limit=TOKEN_LIMIT)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole texts and whole lines of all documents are."""
    return _license.license_scan(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return quality_rules(documents(spark, sf_dir)).drop("lang", "source")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), length=1024, ranks=tokenizer_file("byte_bpe_50k.tiktoken"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated passages of three lines or more."""
    text = F.coalesce("text", F.lit(""))
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256")
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return document_fingerprints(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, with the label of every seventh made wrong."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", wrong)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents with at least 20 words, drawn towards the texts of ``benchmark``."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# ------------------------------------------------------------------------ SQL

_WS = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')"


def _mix_sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"when {level} = '{k}' then {v}" for k, v in MIX_WEIGHTS[level].items())
        return f"case {cases} else 1 end"

    def level(name: str, above: list[str], budget: str) -> str:
        keys, up = ", ".join([*above, name]), ", ".join(above)
        part = f"partition by {up}" if up else ""
        join = f"join {budget} b using ({up})" if up else f"cross join {budget} b"
        return f"""
n_{name} as (select {keys}, sum(offer) as offer, {weight(name)} as weight from leaves group by {keys}),
o_{name} as (select n.*, b.budget from n_{name} n {join}),
s_{name} as (select *, coalesce(sum(offer) over (w rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over (w rows between current row and unbounded following) as heavier from o_{name}
  window w as ({part} order by offer::double / weight, {name})),
t_{name} as (select *, offer::hugeint * heavier <= (budget - before)::hugeint * weight as settled from s_{name}),
u_{name} as (select *, budget - coalesce(sum(case when settled then offer end) over ({part}), 0) as rest,
  sum(case when not settled then weight end) over ({part}) as weights from t_{name}),
g_{name} as (select {keys}, case when settled then offer else (rest::hugeint * weight) // weights end::bigint as budget from u_{name})"""

    return f"""
with docs as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, len({_WORDS}) as n_tokens,
  case coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) % 3 when 0 then 'web' when 1 then 'reference' else 'forum' end as domain
  from documents where doc_id is not null),
own as (select * from docs where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {MIX_EPOCHS} as offer from own group by all),
root as (select (coalesce(sum(tokens), 0) * {MIX_PERCENT} // 100)::bigint as budget from leaves),
{level("domain", [], "root")},{level("lang", ["domain"], "g_domain")},{level("source", ["domain", "lang"], "g_lang")},
plan as (select domain, lang, source, tokens, budget as target from leaves join g_source using (domain, lang, source) where budget > 0),
epochs as (select o.*, p.tokens, p.target, unnest(range(0, ((p.target - 1) // p.tokens)::bigint + 1)) as epoch from own o join plan p using (domain, lang, source)),
ordered as (select *, epoch * tokens + coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch
  order by md5('{MIX_SEED}:' || epoch || ':' || doc_id), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as place from epochs)
select doc_id, domain, lang, source, epoch::integer as epoch, n_tokens::bigint as n_tokens, place::bigint as start, least(n_tokens, target - place)::bigint as n_taken
from ordered where place < target"""


def _quality_sql() -> str:
    def bucket(x: str) -> str:
        size = f"greatest(length(bin({x})) - 6, 0)"
        return f"case when {x} < 64 then {x} else ({x} >> {size}) << {size} end"

    rows = " union all ".join(f"select lang, source, '{m}' as measure, {bucket(m)} as bucket, count(*) as n from good group by all" for m in RULES)
    cuts = []
    for i, keys in enumerate(("lang, source, measure", "lang, measure", "measure")):
        cuts.append(f"""
p{i} as (select {keys}, bucket, sum(n) as n from counts group by all),
r{i} as (select *, sum(n) over (partition by {keys} order by bucket) as upto, sum(n) over (partition by {keys}) as total from p{i}),
c{i} as (select {keys}, min(total) as total{i}, min(case when upto * 4 >= total then bucket end) as q25{i}, min(case when upto * 4 >= total * 3 then bucket end) as q75{i} from r{i} group by all)""")
    pick = lambda q: f"case when total0 >= 50 then {q}0 when total1 >= 50 then {q}1 else {q}2 end"
    limits = ", ".join(
        f"max(case when measure = '{m}' then q75 + 3 * (q75 - q25) + {above} end) as {m}_hi, max(case when measure = '{m}' then q25 - 3 * (q75 - q25) - {below or 0} end) as {m}_lo"
        for m, (above, below) in RULES.items()
    )
    failed = " or ".join(f"coalesce({m} > {m}_hi, false)" + (f" or coalesce({m} < {m}_lo, false)" if below is not None else "") for m, (_, below) in RULES.items())
    return f"""
with w as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, {_WORDS} as words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
grams as (select r, i, list_slice(words, i, i + 4) as g from (select r, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
m as (select r, doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(covered.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as upper, len(lines) as n_lines
  from w left join covered using (r)),
measured as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_symbols * 1000 // greatest(word_chars, 1) as symbol_share,
  (upper * 1000 // greatest(word_chars, 1))::bigint as upper_share, n_dup_lines * 1000 // greatest(n_lines, 1) as dup_line_share, word_chars * 100 // greatest(n_words, 1) as word_length from m),
good as (select * from measured where not base_failed),
counts as ({rows}),{",".join(cuts)},
chosen as (select lang, source, measure, {pick("q25")} as q25, {pick("q75")} as q75 from c0 join c1 using (lang, measure) join c2 using (measure)),
limits as (select lang, source, {limits} from chosen group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_share, upper_share, dup_line_share, word_length,
  not (base_failed or {failed}) as kept from measured left join limits using (lang, source)"""


_LINES_SQL = """
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, pos, list_slice(lines, pos + 1, pos + 3) as three from (select doc_id, lines, unnest(range(0, len(lines) - 2)) as pos from d where len(lines) >= 3)
  where regexp_matches(array_to_string(list_slice(lines, pos + 1, pos + 3), ''), '[^\\x20\\x09-\\x0D]')),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by three order by doc_id, pos) as k from w) where k > 1),
gone as (select distinct doc_id, unnest(range(pos, pos + 3)) as p from later),
runs as (select doc_id, count(*) as n, sum(case when q is null or p > q + 1 then 1 else 0 end) as r, list(p) as ps
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as q from gone) group by doc_id),
kept as (select d.doc_id, len(lines) as n_lines, coalesce(n, 0) as n_removed, coalesce(r, 0) as n_runs,
  coalesce(array_to_string(list_filter(lines, lambda x, i: ps is null or not list_contains(ps, i - 1)), chr(10)), '') as rest from d left join runs using (doc_id))
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, n_removed::bigint as n_removed, n_runs::bigint as n_runs, length(rest)::bigint as kept_chars, sha256(rest) as kept_sha256 from kept"""


_LICENSE_SQL = """
with given(license, text) as (values {texts}),
listed(license, digest) as (values {digests}),
spelled(word, other) as (values ('https', 'http'), ('licence', 'license'), ('licenced', 'licensed'), ('licences', 'licenses'), ('sublicence', 'sublicense'),
  ('acknowledgement', 'acknowledgment'), ('merchantibility', 'merchantability'), ('v2', 'version 2'), ('v3', 'version 3'), ('favour', 'favor'), ('authorised', 'authorized'),
  ('organisation', 'organization'), ('initialise', 'initialize'), ('behaviour', 'behavior'), ('whilst', 'while'), ('wilful', 'willful')),
spelling as (select map_from_entries(list((word, other))) as m from spelled),
raw as (select row_number() over () as r, doc_id, text, null as license from documents union all select -row_number() over (), null, text, license from given),
cut as (select r, unnest(string_split(lower(text), chr(10))) as line, generate_subscripts(string_split(lower(text), chr(10)), 1) as k from raw),
said as (select r, k, regexp_extract_all(line, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') as words from cut
  where not regexp_matches(line, '^[ \\t*#/;%<!-]*(portions )?(copyright[ \\t:,-]*(\\(c\\)|©|&copy;|(19|20)[0-9][0-9]|by |[<\\[{{(] ?(year|yyyy))|©|&copy;|\\(c\\)[ \\t,-]*(copyright|(19|20)[0-9][0-9]|[<\\[{{] ?(year|yyyy)))')),
own as (select r, k, ' ' || array_to_string(list_transform(words, lambda w: coalesce(replace(m[w], ' ', '  '), w)), '  ') || ' ' as words from said, spelling where len(words) > 0),
whole as (select r, string_agg(words, '' order by k) filter (words <> ' all  rights  reserved ') as words, count(*) as n from own group by r),
phrased as (select 'line' as kind, r, words from own union all select 'text', r, coalesce(words, case when n > 0 then ' all  rights  reserved ' end) from whole),
clean as (select kind, r, trim(replace(replace(replace(replace(replace(replace(words, ' sub  license ', ' sublicense '), ' non  commercial ', ' noncommercial '),
  ' per  cent ', ' percent '), ' version  2  0 ', ' version  2 '), ' version  3  0 ', ' version  3 '), '  ', ' ')) as words from phrased),
known as (select digest, min(license) as license from (select sha256(c.words) as digest, w.license from clean c join raw w using (r) where c.kind = 'text' and c.r < 0 union all select digest, license from listed) group by digest),
found as (select w.doc_id, string_agg(distinct k.license, ',' order by k.license) as names from clean c join raw w using (r) join known k on k.digest = sha256(c.words) where c.kind = 'line' and c.r > 0 and w.doc_id is not null group by w.doc_id)
select w.doc_id, case when w.text is not null then sha256(coalesce(c.words, '')) end as text_digest, k.license as text_license, coalesce(f.names, '') as line_licenses
from raw w left join clean c on c.r = w.r and c.kind = 'text' left join known k on k.digest = sha256(c.words) left join found f on f.doc_id = w.doc_id where w.r > 0"""


_NEGATIVES_SQL = """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, a.label, b.vec_id, b.label as other, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where label = other qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where label <> other and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3"""


_RESAMPLING_SQL = f"""
with letters(n, m) as (values ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
texts as (select 1 as own, row_number() over () as r, doc_id, coalesce(text, '') as text from documents union all select 0, row_number() over (), null, coalesce(text, '') from benchmark),
w as (select own, r, doc_id, regexp_extract_all(translate(text, n, m), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from texts, letters),
runs as (select own, r, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as feature from w),
counted as (select own, r, feature, count(*) as n from runs group by all),
steps as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step),
bytes as (select feature, list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(hex(feature), 2 * i + 1, 2))::bigint) as b from (select distinct feature from counted)),
hashed as (select feature, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from bytes, steps),
placed as (select own, r, bucket, n from counted join hashed using (feature)),
totals as (select sum(n) filter (own = 1) as s_all, coalesce(sum(n) filter (own = 0), 0) as t_all from placed),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + {BUCKETS}) / ((s + 1)::double * (t_all + {BUCKETS}))))::bigint as gain
  from (select bucket, coalesce(sum(n) filter (own = 1), 0) as s, coalesce(sum(n) filter (own = 0), 0) as t from placed group by bucket), totals),
weights as (select r, floor(sum(n * gain)::double / sum(n))::bigint as weight from placed join gains using (bucket) where own = 1 group by r),
scores as (select doc_id, greatest(2 * len(words) - 1, 0)::bigint as n_features, len(words) as n_words, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from w left join weights using (r) where own = 1),
ranked as (select *, n_words >= {LEAST_WORDS} and doc_id is not null as able, row_number() over (partition by n_words >= {LEAST_WORDS} and doc_id is not null order by score desc, doc_id) as place from scores)
select doc_id, n_features, weight, score, case when able and place <= (select 25 * count(*) // 100 from ranked where able) then place end as rank from ranked"""


def _license_sql() -> str:
    """The texts and digests are those that the query is given; the rest is the SQL's own."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in _license.known_texts())
    digests = ", ".join(f"({quote(name)}, '{digest}')" for name, digest in sorted(_license.DIGESTS.items()))
    return _LICENSE_SQL.format(texts=texts, digests=digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    own = (
        op1_source_mixing,
        op2_minhash_near_dedup,
        op3_suffix_dedup,
        op4_quality_classifier,
        op5_token_counts,
        op6_license_scan,
        op7_quality_rules,
        op8_packing,
        op9_line_dedup,
        op10_fingerprints,
        op11_hard_negatives,
        op12_pii,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {
        "op1_source_mixing": _mix_sql(),
        "op6_license_scan": _license_sql(),
        "op7_quality_rules": _quality_sql(),
        "op9_line_dedup": _LINES_SQL,
        "op11_hard_negatives": _NEGATIVES_SQL,
        "op13_importance_resampling": _RESAMPLING_SQL,
    }

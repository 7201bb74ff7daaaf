"""Registered queries of the keyword engine, with their SQL side by side."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checks, text
from ..functions.lexicons import AUDIT_COLUMNS, ROOTS
from ..lineage import settled, shared_path
from ..operators import audit, clusters, keywords, review, review_log, suffixes
from ..operators.roots import roots_in
from ..sources import sinks, tables, tagged
from ..sources.charsets import encoded
from ..streaming import frequencies
from . import oracle as o
from .corpus import FINDINGS, MODIFIERS, SITES, body_of, dealt_edges, keyword_edges, keyword_edges_sql, keyword_records, record_bodies, record_texts
from .pipelines import rules_by_term

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
E_ = o.FREQS
WORDS_SQL = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"


def query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _freqs(spark: SparkSession, d: str) -> DataFrame:
    return keywords.document_frequency(dealt_edges(spark, d))


def _words(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()


def _part_names(spark: SparkSession, d: str) -> DataFrame:
    """Variants of part names: plain, plural, hyphenated, initials, name (initials)."""
    p = spark.read.parquet(f"{d}/part.parquet").where(F.col("p_name").isNotNull())
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    ini = F.array_join(F.transform(F.split(n, " "), lambda w: F.substring(w, 1, 1)), "")
    v = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("s"))).when(k == 2, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 3, ini).otherwise(F.concat(n, F.lit(" ("), ini, F.lit(")")))
    return p.select("p_partkey", v.alias("v"))


PARTS_SQL = """ini AS (SELECT p_partkey, p_name AS n, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS i FROM part WHERE p_name IS NOT NULL),
parts AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n WHEN 1 THEN n || 's' WHEN 2 THEN replace(n, ' ', '-') WHEN 3 THEN i ELSE n || ' (' || i || ')' END AS v FROM ini)"""


# Frequencies and filters.
@query("a1_document_frequency", f"WITH {E_} SELECT * FROM freqs")
def a1(spark, d):
    return _freqs(spark, d)


@query("a1_frequency_ignore_case", f"WITH e AS ({keyword_edges_sql()}) SELECT lower(trim(kw_raw)) AS term, count(DISTINCT rec_seq) AS freq FROM e GROUP BY 1")
def a1_ci(spark, d):
    return keywords.document_frequency(dealt_edges(spark, d), ignore_case=True)


@query("a1_arriving_records", f"WITH {E_} SELECT * FROM freqs")
def a1_arriving(spark, d):
    """The records as a stream of files, a third of them exported twice, file by file: the same frequencies as at once."""
    source, folder, checkpoint = (shared_path(spark) for _ in range(3))
    e = keyword_edges(spark, d).select(F.col("rec_seq").cast("string").alias("doc_id"), "kw_raw")
    again = e.where(F.crc32(F.col("doc_id").cast("binary")) % 3 == 0)
    e.write.parquet(source)
    again.write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(source)
    frequencies.follow(stream, folder, checkpoint).awaitTermination()
    return frequencies.kept_frequency(spark, folder)


@query("p1_min_occurrence", f"WITH {E_} SELECT * FROM freqs WHERE freq >= 20")
def p1(spark, d):
    return keywords.at_least(_freqs(spark, d), 20)


@query("a8_run_counters", f"WITH {E_} SELECT (SELECT count(DISTINCT rec_seq) FROM edges) AS documents, count(*) AS unique_keywords, count(*) FILTER (WHERE freq >= 2) AS candidate_terms FROM freqs")
def a8(spark, d):
    e = keyword_edges(spark, d)
    return keywords.run_counters(e.select("rec_seq").distinct(), _freqs(spark, d))


# Scalar rules, on words and lines of documents and on part names.
@query("e1_clean_syntax", "SELECT turn, conv_id, regexp_replace(regexp_replace(trim(text), '^[''\"`]+|[''\"`]+$', '', 'g'), '\\s+', ' ', 'g') AS cleaned FROM conversations")
def e1(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("turn", "conv_id", text.clean_syntax(F.col("text")).alias("cleaned"))


@query("e2_clean_heading", f"WITH {PARTS_SQL} SELECT p_partkey, trim(regexp_replace(trim(replace('*' || v || '/therapy & use, ' || v || '/x', '*', '')), '/[^,;]+', '', 'g')) AS heading FROM parts")
def e2(spark, d):
    v = F.concat(F.lit("*"), "v", F.lit("/therapy & use, "), "v", F.lit("/x"))
    return _part_names(spark, d).select("p_partkey", text.clean_heading(v).alias("heading"))


@query("e3_split_mixed", f"WITH {PARTS_SQL}, s AS (SELECT p_partkey, replace(v || '；； ' || v || ' ;x;;' || v, '；', ';') AS t FROM parts) SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(t, '[;\\n\\r]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS kws FROM s")
def e3(spark, d):
    v = F.concat("v", F.lit("；； "), "v", F.lit(" ;x;;"), "v")
    return _part_names(spark, d).select("p_partkey", F.array_join(text.split_mixed(v), "|").alias("kws"))


@query("e4_acronym_alignment", f"WITH {PARTS_SQL} SELECT p_partkey, {o.aligned('i', 'v')} AS with_own, {o.aligned('v', 'n')} AS as_acronym FROM parts JOIN ini USING (p_partkey)")
def e4(spark, d):
    name = F.col("p_name")
    ini = F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")
    p = _part_names(spark, d).join(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), "p_partkey")
    return p.select("p_partkey", text.aligned(ini, F.col("v")).alias("with_own"), text.aligned(F.col("v"), name).alias("as_acronym"))


@query("e5_decouple_parentheses", f"WITH {PARTS_SQL}, s AS (SELECT p_partkey, {o.decouple('v')} AS d FROM parts) SELECT p_partkey, d.full_phrase AS full_phrase, d.acronym AS acronym, d.valid AS valid FROM s")
def e5(spark, d):
    return _part_names(spark, d).select("p_partkey", text.decouple(F.col("v")).alias("x")).select("p_partkey", "x.*")


@query("e6_hyphen_forms", f"WITH {PARTS_SQL} SELECT p_partkey, trim(replace(v, '-', ' ')) AS spaced, trim(replace(v, '-', '')) AS closed FROM parts")
def e6(spark, d):
    s, c = text.hyphen_forms(F.col("v"))
    return _part_names(spark, d).select("p_partkey", s.alias("spaced"), c.alias("closed"))


@query("e7_resolve_hyphens", f"WITH {o.VOCABULARY}, {E_}, q AS (SELECT term AS t FROM freqs) SELECT t AS term, {o.hyphen('t')} AS hyphen_resolved FROM q")
def e7(spark, d):
    f = _freqs(spark, d)
    return keywords.resolve_hyphens(f, "term", f, keywords.seed_vocabulary(spark)).select("term", "hyphen_resolved")


@query("p8_protected_words", f"WITH {WORDS_SQL} SELECT w, {o._protected('w')} AS protected FROM words")
def p8(spark, d):
    return _words(spark, d).select("w", text.is_protected(F.col("w")).alias("protected"))


@query("e8_word_lemma", f"WITH {WORDS_SQL} SELECT w, {o.lemma_word('w')} AS lemma FROM words")
def e8(spark, d):
    return _words(spark, d).select("w", text.lemma_word(F.col("w")).alias("lemma"))


_SUFFIXES = ", ".join(f"('{a}', '{b}', {n}, {str(w).lower()})" for a, b, n, w in suffixes.ENGLISH)


@query("e8_suffix_table", f"""WITH {WORDS_SQL}, low AS (SELECT DISTINCT lower(w) AS w FROM words), rules(suffix, put, least, whole) AS (VALUES {_SUFFIXES}),
met AS (SELECT w, arg_max((suffix, put), (CASE WHEN whole THEN 1 ELSE 0 END, length(suffix))) AS r FROM low JOIN rules ON CASE WHEN whole THEN w = suffix ELSE suffix(w, suffix) AND length(w) >= least END WHERE NOT {o._protected('w')} GROUP BY 1)
SELECT low.w, CASE WHEN r IS NULL THEN {o.lemma_word('low.w')} ELSE left(low.w, length(low.w) - length(r[1])) || r[2] END AS lemma FROM low LEFT JOIN met USING (w)""")
def e8_table(spark, d):
    """All words of documents in the singular by a table of suffixes and irregular nouns."""
    words = _words(spark, d).select(F.lower("w").alias("w")).distinct()
    return suffixes.lemmas(words, "w", suffixes.english(spark))


@query("e9_phrase_lemma", f"WITH {PARTS_SQL} SELECT p_partkey, {o.lemma_phrase('v')} AS lemma FROM parts")
def e9(spark, d):
    return _part_names(spark, d).select("p_partkey", text.lemma_phrase(F.col("v")).alias("lemma"))


@query("e10_roots", f"WITH {E_} SELECT term, array_to_string({o.roots('term')}, ',') AS roots FROM freqs")
def e10(spark, d):
    return _freqs(spark, d).select("term", F.array_join(text.roots_of(F.col("term")), ",").alias("roots"))


def _leads(freqs: DataFrame, keys) -> DataFrame:
    """(term, freq, lead, lead_freq): each term with the most frequent other term under any of its keys.

    keys: an array of strings, nulls dropped. Of a key's terms one stays before the join, so rows grow as the terms.
    """
    k = freqs.select("term", "freq", F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))
    best = k.groupBy("k").agg(F.min_by(F.struct("term", "freq"), F.struct(-F.col("freq"), "term")).alias("b"))
    met = k.join(best, "k").where(F.col("term") != F.col("b.term"))
    return met.select("term", "freq", F.col("b.term").alias("lead"), F.col("b.freq").alias("lead_freq")).distinct()


def _leads_sql(keys: str, source: str = "freqs") -> str:
    """CTEs up to prs(term, freq, lead, lead_freq)."""
    return f"""ks AS (SELECT DISTINCT term, freq, k FROM (SELECT term, freq, unnest({keys}) AS k FROM {source}) WHERE k IS NOT NULL),
top AS (SELECT k, arg_min(term, (-freq, term)) AS lead, max(freq) AS lead_freq FROM ks GROUP BY k),
prs AS (SELECT DISTINCT term, freq, lead, lead_freq FROM ks JOIN top USING (k) WHERE term <> lead)"""


@query("e11_shared_roots", f"WITH {E_}, {_leads_sql(o.roots('term'))} SELECT term AS a, lead AS b, array_to_string(list_sort(list_intersect({o.roots('term')}, {o.roots('lead')})), ',') AS shared FROM prs")
def e11(spark, d):
    met = _leads(_freqs(spark, d), text.roots_of(F.col("term")))
    return met.select(F.col("term").alias("a"), F.col("lead").alias("b"), F.array_join(F.array_sort(text.shared_roots(F.col("term"), F.col("lead"))), ",").alias("shared"))


@query("e12_root_count", f"WITH {E_}, r AS (SELECT term, unnest({o.roots('term')}) AS root FROM freqs) SELECT a.root, count(r.term) AS terms, {len(ROOTS)}::BIGINT AS roots FROM (SELECT unnest({o._LIST(ROOTS)}) AS root) a LEFT JOIN r ON r.root = a.root GROUP BY 1")
def e12(spark, d):
    """How many terms of the corpus each root is in, of all roots."""
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    met = _freqs(spark, d).select("term", F.explode(text.roots_of(F.col("term"))).alias("root"))
    return roots.join(met, "root", "left").groupBy("root").agg(F.count("term").alias("terms"), F.lit(len(ROOTS)).cast("long").alias("roots"))


@query("e10_root_table", f"""WITH {WORDS_SQL}, low AS (SELECT DISTINCT lower(w) AS w FROM words), r AS (SELECT DISTINCT left(w, 4 + length(w) % 3) AS root FROM low WHERE length(w) >= 8),
g AS (SELECT DISTINCT w, w[i:i + n - 1] AS root FROM (SELECT w, n, unnest(range(1, length(w) - n + 2)) AS i FROM low, (VALUES (4), (5), (6)) t(n) WHERE length(w) >= n))
SELECT root, count(*) AS words, min(w) AS first_word, max(w) AS last_word FROM g JOIN r USING (root) GROUP BY 1""")
def e10_table(spark, d):
    """Thousands of roots, the heads of all long words of documents, in all words: each met by the index of its rarest gram."""
    words = _words(spark, d).select(F.lower("w").alias("w")).distinct()
    heads = words.where(F.length("w") >= 8).select(F.substring("w", F.lit(1), 4 + F.length("w") % 3).alias("root")).distinct()
    return roots_in(words, heads, "w").groupBy("root").agg(F.count(F.lit(1)).alias("words"), F.min("w").alias("first_word"), F.max("w").alias("last_word"))


# Pairs to inspect: terms with a word, root, concept or descriptor in common, one of them the most frequent under it.
_PAIR_KEYS = f"list_concat(list_transform(string_split(term, ' '), lambda w: 'w ' || w), list_transform({o.roots('term')}, lambda r: 'r ' || r), ['c ' || concept_id, 'd ' || descriptor_id])"
_PAIRS = f"{o.VOCABULARY}, {E_}, known AS (SELECT term, freq, concept_id, descriptor_id FROM freqs LEFT JOIN vocabulary ON vterm = term), {_leads_sql(_PAIR_KEYS, 'known')}"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    known = keywords.lookup(_freqs(spark, d), "term", keywords.seed_vocabulary(spark))
    named = lambda p, xs: F.transform(xs, lambda x: F.concat(F.lit(p), x))
    own = F.array(F.concat(F.lit("c "), "concept_id"), F.concat(F.lit("d "), "descriptor_id"))
    return _leads(known, F.concat(named("w ", F.split("term", " ")), named("r ", text.roots_of(F.col("term"))), own))


_ACR = "(freq + lead_freq) % 5 = 0"
_INSPECTED = "SELECT x, y, len(c) > 0 AS is_blocked, CASE WHEN len(c) > 0 THEN 'HIGH_RISK' ELSE 'SAFE' END AS risk_level, array_to_string(c, ',') AS conflicts, "


def _inspected(spark, d, acronym, custom=None):
    seen = checks.inspect_pair(F.col("term"), F.col("lead"), acronym, custom)
    return _pairs(spark, d).select(F.col("term").alias("x"), F.col("lead").alias("y"), seen.alias("s")).select("x", "y", "s.is_blocked", "s.risk_level", F.array_join("s.conflicts", ",").alias("conflicts"), "s.reason")


@query("e14_inspect_pairs", f"WITH {_PAIRS}, c AS (SELECT term AS x, lead AS y, {_ACR} AS acr, {o.conflicts('term', 'lead', _ACR)} AS c FROM prs) {_INSPECTED} {o.reason('c', 'acr')} AS reason FROM c")
def e14(spark, d):
    return _inspected(spark, d, (F.col("freq") + F.col("lead_freq")) % 5 == 0)


CUSTOM = ("occult", "stage two", "renal biopsy")


@query("e15_custom_risk_terms", f"WITH {_PAIRS}, c AS (SELECT term AS x, lead AS y, {o.conflicts('term', 'lead', custom=CUSTOM)} AS c FROM prs) {_INSPECTED} {o.reason('c')} AS reason FROM c")
def e15(spark, d):
    return _inspected(spark, d, False, ["Occult", *CUSTOM[1:]])


@query("e13_risk_tokens", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9\\-]+'))) AS tokens FROM conversations")
def e13(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.size(checks.risk_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("e16_arbitrate", f"WITH {PARTS_SQL}, q AS (SELECT v AS a, {o.lemma_phrase('v')} AS b, p_partkey % 3 AS fa, p_partkey % 4 AS fb, p_partkey, CASE p_partkey % 7 WHEN 0 THEN upper(v) WHEN 1 THEN {o.lemma_phrase('v')} WHEN 2 THEN 'x' END AS c FROM parts) SELECT p_partkey, CASE WHEN {o.SHORT_UPPER('a')} AND NOT {o.SHORT_UPPER('b')} THEN b WHEN {o.SHORT_UPPER('b')} AND NOT {o.SHORT_UPPER('a')} THEN a WHEN fa > fb THEN a WHEN fb > fa THEN b WHEN lower(a) = lower(c) THEN a WHEN lower(b) = lower(c) THEN b WHEN length(a) <= length(b) THEN a ELSE b END AS target FROM q")
def e16(spark, d):
    k, lemma = F.col("p_partkey"), text.lemma_phrase(F.col("v"))
    canonical = F.when(k % 7 == 0, F.upper("v")).when(k % 7 == 1, lemma).when(k % 7 == 2, "x")
    return _part_names(spark, d).select("p_partkey", checks.arbitrate(F.col("v"), lemma, k % 3, k % 4, canonical).alias("target"))


@query("p5_p6_acronym_tests", f"WITH {PARTS_SQL} SELECT p_partkey, {o.SHORT_UPPER('upper(v)')} AS upper_short, {o.SHORT_WORD('v')} AS candidate FROM parts")
def p5(spark, d):
    return _part_names(spark, d).select("p_partkey", text.is_short_upper(F.upper("v")).alias("upper_short"), text.is_short_word(F.col("v")).alias("candidate"))


# Vocabulary.
@query("s13_seed_vocabulary", f"WITH {o.VOCABULARY}, {E_} SELECT vterm AS term, descriptor_id, concept_id, canonical_name, coalesce(freq, 0) AS freq FROM vocabulary LEFT JOIN freqs ON term = vterm")
def s13(spark, d):
    """The entries of the seed vocabulary with the records of the corpus that have their term."""
    return keywords.seed_vocabulary(spark).join(_freqs(spark, d), "term", "left").select("term", "descriptor_id", "concept_id", "canonical_name", F.coalesce("freq", F.lit(0)).alias("freq"))


@query("j1_vocabulary_lookup", f"WITH {o.VOCABULARY}, {E_} SELECT term, vterm IS NOT NULL AS matched, descriptor_id, concept_id, canonical_name FROM freqs LEFT JOIN vocabulary ON vterm = lower(trim(term))")
def j1(spark, d):
    return keywords.lookup(_freqs(spark, d), "term", keywords.seed_vocabulary(spark)).select("term", "matched", "descriptor_id", "concept_id", "canonical_name")


@query("e20_synonym_relation", f"""WITH {_PAIRS}, m AS (SELECT term AS term1, lead AS term2, x.descriptor_id AS d1, y.descriptor_id AS d2, x.concept_id AS c1, y.concept_id AS c2
 FROM prs LEFT JOIN vocabulary x ON x.vterm = term LEFT JOIN vocabulary y ON y.vterm = lead)
 SELECT term1, term2, coalesce(c1 = c2, false) AS is_synonym, CASE WHEN c1 = c2 THEN 'Tier 1' WHEN d1 = d2 THEN 'Tier 2' ELSE 'Tier 3' END AS tier, CASE WHEN c1 = c2 THEN c1 END AS concept_id, CASE WHEN d1 = d2 THEN d1 END AS descriptor_id,
 CASE WHEN d1 IS NULL OR d2 IS NULL THEN 'One or both terms not found in MeSH index' WHEN c1 = c2 THEN 'True synonyms under MeSH Concept ' || c1 WHEN d1 = d2 THEN 'Related concepts under MeSH Descriptor ' || d1 || ' (Broad/Narrow relation)' ELSE 'Distinct MeSH descriptors' END AS reason FROM m""")
def e20(spark, d):
    pairs = _pairs(spark, d).select(F.col("term").alias("term1"), F.col("lead").alias("term2"))
    return keywords.synonym_relation(pairs, keywords.seed_vocabulary(spark))


# Links, closure, clusters.
def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(freqs, clusters, rules) of a corpus."""
    f = _freqs(spark, d)
    return f, *clusters.build_clusters(f, keywords.seed_vocabulary(spark))


def _props(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(term properties, freqs) of a corpus."""
    f = settled(_freqs(spark, d))
    return settled(clusters.term_properties(f, keywords.seed_vocabulary(spark))), f


@query("p7_j2_term_properties", f"WITH {o.VOCABULARY}, {E_}, {o.PROPS} SELECT * FROM props")
def p7(spark, d):
    return _props(spark, d)[0]


@query("j3_j4_hyphen_plural_links", f"WITH {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS} SELECT * FROM h UNION ALL SELECT * FROM l")
def j3(spark, d):
    return clusters.hyphen_and_plural_links(*_props(spark, d))


@query("j5_acronym_links", f"WITH {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS} SELECT * FROM a")
def j5(spark, d):
    return clusters.acronym_links(_props(spark, d)[0])


@query("j6_descriptor_links", f"WITH {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS} SELECT term AS src, lead AS dst, CASE WHEN concept_id = lead_concept THEN 'MeSH Concept (' || concept_id || ')' ELSE 'MeSH Descriptor (' || descriptor_id || ')' END AS rule_source, {o.SHORT_UPPER('term')} AS is_acr FROM g WHERE term <> lead")
def j6(spark, d):
    return clusters.descriptor_links(_props(spark, d)[0])


# A vocabulary that grows with the tables: the terms of parts under a descriptor for each site and finding, with concepts for
# groups of modifiers, and an entry for each part and supplier that sold it, which no keyword has.
_M, _S, _F = "l_partkey * 7 % 26", "(l_partkey * 13 + l_partkey // 26) % 32", "(l_partkey * 17 + l_partkey // 832) % 25"
_WIDE = f"""triples AS (SELECT DISTINCT {_M} AS mi, {_S} AS si, {_F} AS fi FROM lineitem),
named3 AS (SELECT *, {o._LIST(MODIFIERS)}[1 + mi] || ' ' || {o._LIST(SITES)}[1 + si] || ' ' || {o._LIST(FINDINGS)}[1 + fi] AS t FROM triples),
vocabulary AS (SELECT t AS vterm, 'D' || si || '-' || fi AS descriptor_id, 'M' || si || '-' || fi || '.' || mi // 5 AS concept_id, upper(t) AS canonical_name FROM named3
 UNION ALL SELECT 'item ' || l_partkey || ' of ' || l_suppkey, 'I' || l_partkey, 'I' || l_partkey || '.' || l_suppkey, 'item' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""


def wide_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(term, descriptor_id, concept_id, canonical_name) of that vocabulary."""
    sold, p = spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_partkey")
    m, s, f = p * 7 % 26, (p * 13 + F.floor(p / 26)) % 32, (p * 17 + F.floor(p / 832)) % 25
    triples = sold.select(m.cast("int").alias("m"), s.cast("int").alias("s"), f.cast("int").alias("f")).distinct()
    nth = lambda words, i: F.get(F.array(*map(F.lit, words)), F.col(i))
    term = F.concat_ws(" ", nth(MODIFIERS, "m"), nth(SITES, "s"), nth(FINDINGS, "f"))
    of = F.concat_ws("-", "s", "f")
    named = triples.select(term.alias("term"), F.concat(F.lit("D"), of).alias("descriptor_id"), F.concat(F.lit("M"), of, F.lit("."), F.expr("m div 5").cast("string")).alias("concept_id"))
    part, by = p.cast("string"), F.col("l_suppkey").cast("string")
    items = sold.select("l_partkey", "l_suppkey").distinct().select(
        F.concat(F.lit("item "), part, F.lit(" of "), by).alias("term"), F.concat(F.lit("I"), part).alias("descriptor_id"), F.concat(F.lit("I"), part, F.lit("."), by).alias("concept_id"), F.lit("item").alias("canonical_name")
    )
    return named.withColumn("canonical_name", F.upper("term")).unionByName(items)


@query("j1_wide_vocabulary", f"WITH {_WIDE}, {E_} SELECT term, freq, descriptor_id, concept_id, canonical_name FROM freqs JOIN vocabulary ON vterm = lower(trim(term)) UNION ALL SELECT 'entries', count(*), NULL, NULL, NULL FROM vocabulary")
def j1_wide(spark, d):
    """Terms that a large vocabulary knows, and the number of its entries."""
    v = wide_vocabulary(spark, d)
    known = keywords.lookup(_freqs(spark, d), "term", v).where("matched").select("term", "freq", "descriptor_id", "concept_id", "canonical_name")
    none = F.lit(None).cast("string")
    return known.unionByName(v.agg(F.count(F.lit(1)).alias("freq")).select(F.lit("entries").alias("term"), "freq", *(none.alias(c) for c in ("descriptor_id", "concept_id", "canonical_name"))))


@query("j6_wide_vocabulary", f"WITH {_WIDE}, {E_}, {o.PROPS}, {o.LINKS} SELECT term AS src, lead AS dst, CASE WHEN concept_id = lead_concept THEN 'MeSH Concept (' || concept_id || ')' ELSE 'MeSH Descriptor (' || descriptor_id || ')' END AS rule_source, {o.SHORT_UPPER('term')} AS is_acr FROM g WHERE term <> lead")
def j6_wide(spark, d):
    """Links of thousands of terms under descriptors with many terms and several concepts each."""
    f = settled(_freqs(spark, d))
    return clusters.descriptor_links(clusters.term_properties(f, wide_vocabulary(spark, d)))


@query("g1_term_links", f"WITH {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS} SELECT * FROM links")
def g1(spark, d):
    p, f = _props(spark, d)
    return clusters.term_links(p, f)


@query("g2_closed_links", f"WITH RECURSIVE {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS}, {o.CLOSED} SELECT * FROM closed")
def g2(spark, d):
    p, f = _props(spark, d)
    return clusters.close_links(clusters.term_links(p, f))


@query("g2_functional_graph", """WITH RECURSIVE n AS (SELECT max(c_custkey) + 1 AS n FROM customer), links AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS src, CAST((c_custkey * c_custkey + 13) % n AS VARCHAR) AS dst, 'x' AS rule_source, false AS is_acr FROM customer, n WHERE (c_custkey * c_custkey + 13) % n <> c_custkey), """ + o.CLOSED + " SELECT src, dst FROM closed")
def g2_graph(spark, d):
    """Every customer points at another: long tails into cycles."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    c = c.join(F.broadcast(c.agg((F.max("c_custkey") + 1).alias("n"))))
    to = (F.col("c_custkey") * F.col("c_custkey") + 13) % F.col("n")
    links = c.where(to != F.col("c_custkey")).select(F.col("c_custkey").cast("string").alias("src"), to.cast("string").alias("dst"), F.lit("x").alias("rule_source"), F.lit(False).alias("is_acr")).distinct()
    return clusters.close_links(links).select("src", "dst")


RULE_COLS = "raw_term, target_term, tier, rule_source, clinical_safety_check, raw_frequency, selected_for_export"


@query("g3_link_rules", f"WITH RECURSIVE {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS}, {o.CLOSED}, {o.RULES0} SELECT {RULE_COLS} FROM rules0")
def g3(spark, d):
    p, f = _props(spark, d)
    return clusters.link_rules(clusters.close_links(clusters.term_links(p, f)), f)


@query("g4_morpheme_rules", f"{o.CLUSTER_PATH} SELECT {RULE_COLS} FROM rules WHERE rule_source LIKE 'Medical Morpheme%'")
def g4(spark, d):
    return _built(spark, d)[2].where(F.col("rule_source").startswith("Medical Morpheme"))


@query("cluster_rules", f"{o.CLUSTER_PATH} SELECT {RULE_COLS} FROM rules")
def cluster_rules(spark, d):
    return _built(spark, d)[2]


@query("a4_g5_clusters", f"{o.CLUSTER_PATH} SELECT * FROM clusters ORDER BY combined_freq DESC, variant_count DESC, target_term")
def a4(spark, d):
    return clusters.ordered(_built(spark, d)[1])


@query("o3_nested_variants", f"{o.CLUSTER_PATH} SELECT c.target_term, coalesce(string_agg(r.raw_term, '|' ORDER BY r.raw_frequency DESC, r.raw_term), '') AS variants FROM clusters c LEFT JOIN rules r ON r.target_term = c.target_term GROUP BY 1")
def o3(spark, d):
    _, c, r = _built(spark, d)
    return clusters.nested(c, r).select("target_term", F.array_join(F.transform("variants", lambda v: v["raw_term"]), "|").alias("variants"))


for _mode, _cols in (("combined", "combined_freq DESC, variant_count DESC"), ("variants", "variant_count DESC, combined_freq DESC"), ("frequency", "target_raw_freq DESC, variant_count DESC")):
    query(f"o1_o2_top_{_mode}", f"{o.CLUSTER_PATH} SELECT * FROM clusters ORDER BY {_cols}, target_term LIMIT 10")(lambda spark, d, m=_mode: clusters.ordered(_built(spark, d)[1], m, 10))


@query("rules_by_term", f"{o.BY_TERM} SELECT {RULE_COLS} FROM rules")
def by_term(spark, d):
    return rules_by_term(_freqs(spark, d), keywords.seed_vocabulary(spark))


# Audit and exports.
@query("a5_dual_metrics", f"{o.CLUSTER_PATH}, {o.METRICS} SELECT * FROM metrics")
def a5(spark, d):
    return audit.dual_metrics(keyword_edges(spark, d), audit.mapping_of(_built(spark, d)[2]))


@query("a6_k4_audit_table", f"{o.CLUSTER_PATH}, {o.METRICS} {o.AUDIT}")
def a6(spark, d):
    return audit.audit_rows(_built(spark, d)[2], keyword_edges(spark, d))


@query("a6_audit_by_term", f"{o.BY_TERM}, {o.METRICS} {o.AUDIT}")
def a6_term(spark, d):
    return audit.audit_rows(by_term(spark, d), keyword_edges(spark, d))


@query("p2_k1_k2_thesaurus_lines", f"{o.CLUSTER_PATH} SELECT raw_term || chr(9) || target_term AS line FROM rules WHERE selected_for_export AND lower(trim(raw_term)) <> lower(trim(target_term))")
def k1(spark, d):
    return audit.pair_lines(_built(spark, d)[2])


@query("k3_synonym_pairs", f"{o.CLUSTER_PATH} SELECT raw_term || ';' || target_term AS line FROM rules WHERE lower(trim(raw_term)) <> lower(trim(target_term))")
def k3(spark, d):
    return audit.pair_lines(_built(spark, d)[2], include_unselected=True, separator=";")


# Review.
@query("a7_panel", f"{o.CLUSTER_PATH} SELECT (SELECT count(*) FROM freqs) AS terms, (SELECT count(*) FROM clusters WHERE variant_count > 0) AS clusters, count(*) AS variants, count(*) FILTER (WHERE selected_for_export) AS selected, count(*) FILTER (WHERE tier LIKE 'Tier 3%') AS tier_3 FROM rules")
def a7(spark, d):
    return review.panel(*_built(spark, d))


@query("p3_search", f"{o.CLUSTER_PATH} SELECT c.* FROM clusters c WHERE contains(lower(target_term), 'qol') OR EXISTS (SELECT 1 FROM rules r WHERE r.target_term = c.target_term AND contains(lower(r.raw_term), 'qol'))")
def p3(spark, d):
    return review.search(*_built(spark, d)[1:], "QoL")


@query("p4_scope_variants", f"{o.CLUSTER_PATH} SELECT * FROM clusters WHERE variant_count > 0")
def p4(spark, d):
    return review.scope(_built(spark, d)[1], "variants")


@query("p4_scope_blocked", f"{o.CLUSTER_PATH} SELECT * FROM clusters WHERE has_blocked_variants")
def p4b(spark, d):
    return review.scope(_built(spark, d)[1], "blocked")


_SEL = f"{o.CLUSTER_PATH} SELECT raw_term, target_term, tier, rule_source, clinical_safety_check, raw_frequency, "


@query("r1_approve_safe", f"{_SEL} tier NOT LIKE 'Tier 3%' AS selected_for_export FROM rules")
def r1(spark, d):
    return review.approve_safe(_built(spark, d)[2])


@query("r2_exclude_tier_3", f"{_SEL} selected_for_export AND tier NOT LIKE 'Tier 3%' AS selected_for_export FROM rules")
def r2(spark, d):
    return review.exclude_tier_3(_built(spark, d)[2])


@query("r4_cluster_all", f"{_SEL} target_term = 'depression' OR selected_for_export AS selected_for_export FROM rules")
def r4(spark, d):
    return review.set_cluster(_built(spark, d)[2], "depression", "all")


@query("r4_cluster_none", f"{_SEL} target_term <> 'prostate cancer' AND selected_for_export AS selected_for_export FROM rules")
def r4n(spark, d):
    return review.set_cluster(_built(spark, d)[2], "prostate cancer", "none")


@query("r4_cluster_safe", f"{_SEL} CASE WHEN target_term = 'depression' THEN tier NOT LIKE 'Tier 3%' ELSE selected_for_export END AS selected_for_export FROM rules")
def r4s(spark, d):
    return review.set_cluster(_built(spark, d)[2], "depression", "safe")


def _draft(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("adt", False, None), ("prostate cancers", True, "cancer of the gland"), ("no such term", True, None)], "raw_term string, selected boolean, target string")


_OVER = "o(rt, s, t) AS (VALUES ('adt', false, NULL), ('prostate cancers', true, 'cancer of the gland'), ('no such term', true, NULL))"


@query("p9_j11_r6_overrides", f"{o.CLUSTER_PATH}, {_OVER} SELECT raw_term, coalesce(t, target_term) AS target_term, tier, rule_source, clinical_safety_check, raw_frequency, coalesce(s, selected_for_export) AS selected_for_export FROM rules LEFT JOIN o ON rt = raw_term")
def p9(spark, d):
    return review.apply_overrides(_built(spark, d)[2], _draft(spark))


@query("r5_toggle", f"{o.CLUSTER_PATH} SELECT raw_term, target_term, tier, rule_source, clinical_safety_check, raw_frequency, CASE WHEN raw_term = 'adt' THEN false ELSE selected_for_export END AS selected_for_export FROM rules")
def r5(spark, d):
    none = spark.createDataFrame([], "raw_term string, selected boolean, target string")
    return review.apply_overrides(_built(spark, d)[2], review.toggle(review.toggle(none, "adt", True), "adt", False))


# Each event is a reviewer's action on every keyword of the record of its number, in three batches by user.
_ACTIONS = """acts AS (SELECT DISTINCT (user_id % 3, event_id) AS place, lower(trim(kw_raw)) AS raw, event_type = 'error' AS reset, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS selected,
  CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'Group ' || user_id % 20 END AS target FROM events JOIN edges ON rec_seq = event_id),
resets AS (SELECT raw, max(place) FILTER (WHERE reset) AS r FROM acts GROUP BY 1), live AS (SELECT acts.* FROM acts JOIN resets USING (raw) WHERE r IS NULL OR place >= r),
chosen AS (SELECT raw, arg_max(selected, place) FILTER (WHERE selected IS NOT NULL) AS s, arg_max(target, place) FILTER (WHERE target IS NOT NULL) AS t FROM live GROUP BY 1),
reviewed AS (SELECT raw_term, coalesce(t, target_term) AS target_term, coalesce(s, selected_for_export) AS selected_for_export FROM rules LEFT JOIN chosen ON raw = raw_term)"""


@query("r5_a5_review_log", f"{o.CLUSTER_PATH}, {_ACTIONS}, {o.METRICS.replace('FROM rules', 'FROM reviewed')} SELECT * FROM metrics")
def review_by_log(spark, d):
    """The counts that a review keeps, after three batches of actions recorded in its log."""
    folder, edges = shared_path(spark), keyword_edges(spark, d)
    review_log.start(folder, _built(spark, d)[2], edges)
    kind, group = F.col("event_type"), F.concat(F.lit("Group "), (F.col("user_id") % 20).cast("string"))
    met = spark.read.parquet(f"{d}/events.parquet").join(edges, F.col("event_id") == F.col("rec_seq"))
    actions = met.select(
        (F.col("user_id") % 3).alias("batch"), F.col("event_id").alias("seq"), text.fold(F.col("kw_raw")).alias("raw_term"), F.when(kind == "click", True).when(kind == "view", False).alias("selected"),
        F.when(~kind.isin("click", "view", "error"), group).alias("target"), (kind == "error").alias("reset"),
    ).distinct()
    kept = shared_path(spark)  # the records are met with the events once, not once a batch
    actions.write.partitionBy("batch").parquet(kept)
    for batch in range(3):
        review_log.record(folder, spark.read.schema(actions.schema).parquet(kept).where(F.col("batch") == batch).drop("batch"))
    return review_log.metrics(spark, folder)


# Sources: tagged texts made of the corpus and parsed back.
_KWS = f"e AS ({keyword_edges_sql()}), k AS (SELECT rec_seq AS rec, list_sort(list(DISTINCT kw_raw)) AS raw FROM e GROUP BY 1), kw AS (SELECT rec, list_transform(raw, lambda x: trim(x)) AS kws FROM k)"
_FLAT = lambda c: f"array_to_string(list_sort(list_distinct({c})), '|')"


def _parsed(parse, template: str):
    return lambda spark, d: parse(tagged.lines_of(record_texts(spark, d, template))).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


query("s2_s3_web_of_science", f"""WITH {_KWS}, n AS (SELECT *, row_number() OVER (PARTITION BY rec // 64 ORDER BY rec) AS place FROM kw)
SELECT CASE WHEN rec % 7 <> 0 THEN 'WOS:' || rec ELSE 'wos_doc_' || place END AS doc_id, {_FLAT("CASE WHEN rec % 5 <> 0 THEN kws[1:(len(kws) + 1) // 2] ELSE kws END")} AS keywords, rec % 5 = 0 AS is_de_fallback, {_FLAT('kws')} AS combined FROM n""")(
    lambda spark, d: tagged.parse_wos(tagged.lines_of(record_texts(spark, d, "wos"))).select("doc_id", F.array_join("keywords", "|").alias("keywords"), "is_de_fallback", F.array_join("combined_keywords", "|").alias("combined"))
)
query("s4_pubmed", f"WITH {_KWS} SELECT 'PMID:' || rec AS doc_id, {_FLAT('kws')} AS keywords FROM kw")(_parsed(tagged.parse_pubmed, "pubmed"))
query("s5_cnki_text", f"WITH {_KWS} SELECT 'title ' || rec AS doc_id, {_FLAT('kws')} AS keywords FROM kw")(_parsed(tagged.parse_cnki, "cnki"))
query("s6_cnki_refworks", f"WITH {_KWS} SELECT 'title ' || rec AS doc_id, {_FLAT('kws')} AS keywords FROM kw")(_parsed(tagged.parse_cnki, "refworks"))


@query("s1_detect_formats", "SELECT f AS format, count(DISTINCT l_orderkey // 64) AS files FROM lineitem, (VALUES ('wos_plaintext'), ('pubmed_medline'), ('cnki_refworks'), ('cnki_text')) t(f) GROUP BY 1")
def s1(spark, d):
    both = [record_texts(spark, d, t).withColumn("path", F.concat(F.lit(t), "path")) for t in ("wos", "pubmed", "refworks", "cnki")]
    lines = tagged.lines_of(functools.reduce(DataFrame.unionByName, both))
    return tagged.detect_formats(lines).groupBy("format").agg(F.count(F.lit(1)).alias("files"))


def _vos_lines(spark: SparkSession, d: str) -> DataFrame:
    """Part names as term files, one for each size: repeated terms, missing counts, strengths on every other line."""
    p = spark.read.parquet(f"{d}/part.parquet")
    line = F.concat("p_name", F.lit("\t"), F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise((F.col("p_partkey") % 50).cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\t"), (F.col("p_partkey") % 8 / 4).cast("string"))).otherwise(""))
    return p.select(F.lpad(F.col("p_size").cast("string"), 4, "0").alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"))


@query("s9_vos_terms", "SELECT p_partkey AS line_no, p_name AS term, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_partkey % 50 END AS occurrences, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 8) / 4.0 ELSE 0.0 END::DOUBLE AS total_link_strength FROM part")
def s9(spark, d):
    return tables.vos_terms(_vos_lines(spark, d)).drop("path")


@query("s11_vos_frequencies", "SELECT lower(p_name) AS term, arg_max(CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_partkey % 50 END, (p_size, p_partkey)) AS freq FROM part GROUP BY 1")
def s11(spark, d):
    return tables.vos_frequencies(_vos_lines(spark, d))


@query("s10_vos_records", "SELECT 'vos_term_' || row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS doc_id, p_name AS keyword FROM part")
def s10(spark, d):
    return tables.vos_records(_vos_lines(spark, d)).select("doc_id", F.get("keywords", F.lit(0)).alias("keyword"))


_SCOPUS = f"{_KWS}, r AS (SELECT *, row_number() OVER (PARTITION BY rec // 64 ORDER BY rec) AS n FROM kw)"


_SCOPUS_CELLS = ("eid", "doi", "a", "i")


def _scopus_cells(r) -> list:
    """Their values for a record of (kws) with the number r."""
    half = F.floor((F.size("kws") + 1) / 2).cast("int")
    return [F.when(r % 3 == 0, F.concat(F.lit("E"), r.cast("string"))).otherwise(""), F.when(r % 3 < 2, F.concat(F.lit("10.1/"), r.cast("string"))), F.array_join(F.slice("kws", F.lit(1), half), "; "), F.concat(F.array_join("kws", ";"), F.lit("; ;"))]


def _scopus_rows(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rec_seq")
    return keyword_records(spark, d).select("path", r.alias("rec"), *(c.alias(n) for n, c in zip(_SCOPUS_CELLS, _scopus_cells(r))))


@query("s8_scopus_records", f"""WITH {_SCOPUS}
SELECT CASE WHEN rec % 3 = 0 THEN 'E' || rec WHEN rec % 3 = 1 THEN '10.1/' || rec ELSE 'scopus_' || n END AS doc_id, {_FLAT('kws')} AS keywords FROM r""")
def s8(spark, d):
    return tables.scopus_records(_scopus_rows(spark, d)).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


#: Records of a written file; files grow in number with the records.
_OF_FILE = 4096


def _folder_of(bodies: DataFrame, head: dict[str, str] | None = None, kinds: list[str] | None = None, compression: str = "none") -> str:
    """A folder with a file for each path and kind of (path, rec_seq, kind, body), or of (path, rec_seq) and a column of bodies a kind; bodies are in their order after the head of their kind.

    Bodies lack their last line end. A row holds a file of at most _OF_FILE bodies, so Spark writes one file a row: rows of a path are in one task, where its records come together without
    an exchange or a sort of their texts. Spark's text writer adds the line end of the last body. Tasks put their files where they stay, so the driver moves none.
    """
    path = shared_path(bodies.sparkSession)
    keys = [c for c in ("path", "kind") if c in bodies.columns]
    names = [c for c in bodies.columns if c not in ("rec_seq", *keys)]
    files = bodies.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rec_seq", *names))).alias("all"))
    joined = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "\n")
    if "kind" not in keys:
        files = files.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), joined(n).alias("value")) for n in names))).alias("x")).select("x.*")
    else:
        files = files.select("kind", joined("body").alias("value"))
    value = F.col("value")
    for kind, text_ in (head or {}).items():
        value = F.when(F.col("kind") == kind, F.concat(F.lit(text_), value)).otherwise(value)
    files = files.withColumn("value", value)
    files = encoded(files, "value", kinds) if kinds else files
    files.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).option("compression", compression).text(path)
    return path


def _scopus_body():
    """A quoted row, with line ends, quotes and separators in its first cell."""
    r = F.col("rec_seq")
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    title = F.concat(F.lit('a "title", of\n\ntwo lines '), r.cast("string"))
    return F.concat_ws(",", cell(title), *map(cell, _scopus_cells(r)))


_SCOPUS_HEAD = "Title,EID,DOI,Author Keywords,Index Keywords\n"
_SCOPUS_FILE = f"SELECT CASE WHEN rec % 3 = 0 THEN 'E' || rec WHEN rec % 3 = 1 THEN '10.1/' || rec ELSE 'scopus_' || row_number() OVER (PARTITION BY rec // 4096 ORDER BY rec) END AS doc_id, {_FLAT('kws')} AS keywords FROM kw"


@query("s8_scopus_files", f"WITH {_KWS} {_SCOPUS_FILE}")
def s8_files(spark, d):
    """CSV files of all rows, with line ends in cells, written and read back; rows without an id take their number in their file."""
    bodies = keyword_records(spark, d, _OF_FILE).select("path", F.lit("scopus").alias("kind"), "rec_seq", _scopus_body().alias("body"))
    return tables.read_scopus(spark, _folder_of(bodies, {"scopus": _SCOPUS_HEAD})).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@query("s12_vocabulary_xml", """WITH e AS (SELECT lower(p_name || ' ' || (p_size % 4)) AS term, 'D' || p_partkey AS descriptor_id, 'M' || p_partkey || '.0' AS concept_id, p_brand AS canonical_name, p_type AS concept_name, p_partkey AS rec, 0 AS c FROM part
 UNION ALL SELECT lower(p_type), 'D' || p_partkey, 'M' || p_partkey || '.1', p_brand, p_type || 's', p_partkey, 1 FROM part),
x AS (SELECT term, arg_max(struct_pack(descriptor_id, concept_id, canonical_name, concept_name), (rec, c)) AS v FROM e GROUP BY 1),
o AS (SELECT lower(p_brand) AS term, arg_min(struct_pack(d := 'D' || p_partkey, n := p_brand), p_partkey) AS v FROM part WHERE lower(p_brand) NOT IN (SELECT term FROM x) GROUP BY 1)
SELECT term, v.descriptor_id AS descriptor_id, v.concept_id AS concept_id, v.canonical_name AS canonical_name, v.concept_name AS concept_name FROM x UNION ALL SELECT term, v.d, v.d, v.n, NULL FROM o""")
def s12(spark, d):
    """Descriptor records of parts written as compressed XML files and read back."""
    k = F.col("p_partkey").cast("string")
    tag = lambda t, *inside: F.concat(F.lit(f"<{t}>"), *inside, F.lit(f"</{t}>"))
    concept = lambda i, name, term: tag("Concept", tag("ConceptUI", F.lit("M"), k, F.lit(f".{i}")), tag("ConceptName", tag("String", name)), tag("TermList", tag("Term", tag("String", term))))
    size = F.concat("p_name", F.lit(" "), (F.col("p_size") % 4).cast("string"))
    xml = tag("DescriptorRecord", tag("DescriptorUI", F.lit("D"), k), tag("DescriptorName", tag("String", F.col("p_brand"))), tag("ConceptList", concept(0, F.col("p_type"), size), concept(1, F.concat("p_type", F.lit("s")), F.col("p_type"))))
    path = shared_path(spark)
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", xml.alias("record"), F.lpad(F.floor(F.col("p_partkey") / 512).cast("string"), 9, "0").alias("of"))
    records = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "record"))), lambda x: x["record"]), "\n")
    files = parts.groupBy("of").agg(tag("DescriptorRecordSet", records).alias("value"))  # 512 records a file
    files.write.partitionBy("of").option("compression", "gzip").text(path)
    return tables.read_vocabulary_xml(spark, path)


@query("j10_targets", f"WITH RECURSIVE {o.VOCABULARY}, {E_}, {o.PROPS}, {o.LINKS}, {o.CLOSED}, {o.RULES0} SELECT * FROM targets0")
def j10(spark, d):
    p, f = _props(spark, d)
    return clusters.targets_of(f, clusters.close_links(clusters.term_links(p, f)))


@query("r3_reset", f"{_SEL} selected_for_export FROM rules")
def r3(spark, d):
    return review.apply_overrides(_built(spark, d)[2], _draft(spark).limit(0))


# Files: written to the shared folder and read back.
@query("s7_charset_fallback", f"WITH {_KWS} SELECT CASE WHEN rec // 64 % 3 = 1 THEN '题名 í ' ELSE '题名 ß𠀀 ' END || rec AS doc_id, {_FLAT('kws')} AS keywords FROM kw")
def s7(spark, d):
    """Chinese exports in UTF-8, GBK and GB18030, file by file; titles in the other two have what GBK lacks."""
    n = F.expr("rec_seq div 64 % 3")
    kind = F.when(n == 0, "UTF-8").when(n == 1, "GBK").otherwise("GB18030")
    title = F.when(n == 1, "题名 í ").otherwise("题名 ß𠀀 ")
    bodies = record_bodies(spark, d, "cnki", _OF_FILE, "").select("path", kind.alias("kind"), "rec_seq", F.replace("body", F.lit("title "), title).alias("body"))
    return tables.read_cnki(spark, _folder_of(bodies, kinds=["GBK", "GB18030"])).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


_S15 = [
    f"SELECT 'Web of Science' AS source_database, CASE WHEN rec % 7 <> 0 THEN 'WOS:' || rec ELSE 'wos_doc_' || row_number() OVER (PARTITION BY rec // 4096 ORDER BY rec) END AS doc_id, {_FLAT('CASE WHEN rec % 5 <> 0 THEN kws[1:(len(kws) + 1) // 2] ELSE kws END')} AS keywords FROM kw",
    *(f"SELECT '{name}', '{head}' || rec, {_FLAT('kws')} FROM kw" for name, head in (("PubMed", "PMID:"), ("CNKI", "title "), ("CNKI", "title "))),
    f"SELECT 'Scopus', doc_id, keywords FROM ({_SCOPUS_FILE})",
    "SELECT 'VOSviewer', 'vos_term_' || row_number() OVER (PARTITION BY p_partkey // 4096 ORDER BY p_partkey), p_name FROM part",
]


@query("s15_read_records", f"WITH {_KWS} {' UNION ALL '.join(_S15)}")
def s15(spark, d):
    """One folder with files of all six formats, each file read by what it holds."""
    of = {**{t: body_of(t, "") for t in ("wos", "pubmed", "refworks", "cnki")}, "scopus": _scopus_body()}
    records = keyword_records(spark, d, _OF_FILE).select("path", "rec_seq", *(b.alias(k) for k, b in of.items()))
    terms = _vos_lines(spark, d).select(F.floor(F.col("line_no") / _OF_FILE).cast("string").alias("path"), F.lit("vos").alias("kind"), F.col("line_no").alias("rec_seq"), F.col("line").alias("body"))
    path = [_folder_of(records, {"scopus": _SCOPUS_HEAD}, compression="gzip"), _folder_of(terms.repartition("path"), {"vos": "label\toccurrences\ttotal link strength\n"}, compression="gzip")]
    found = tables.read_records(spark, path)
    return found.select("source_database", "doc_id", F.array_join("keywords", "|").alias("keywords"))


def _file_lines(spark: SparkSession, write, name: str) -> DataFrame:
    """(n, line) of the file that a sink writes; rule sets are bounded by the vocabulary."""
    path = f"{shared_path(spark)}-{name}"
    write(path)
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("n", "line")).select(F.col("n").cast("long").alias("n"), "line")


def _file_sql(head: str | None, line: str, where: str) -> str:
    body = f"SELECT row_number() OVER (ORDER BY target_term, raw_term) - {0 if head else 1} AS n, {line} AS line FROM rules WHERE {where}"
    return f"{o.CLUSTER_PATH} {body}" + (f" UNION ALL SELECT 0, '{head}'" if head else "")


_MERGES = "lower(trim(raw_term)) <> lower(trim(target_term))"
query("k1_vosviewer_file", _file_sql("label' || chr(9) || 'replace by", "raw_term || chr(9) || target_term", f"selected_for_export AND {_MERGES}"))(lambda spark, d: _file_lines(spark, lambda p: sinks.write_vosviewer(_built(spark, d)[2], p), "v.txt"))
query("k2_citespace_file", _file_sql(None, "raw_term || chr(9) || target_term", f"selected_for_export AND {_MERGES}"))(lambda spark, d: _file_lines(spark, lambda p: sinks.write_citespace(_built(spark, d)[2], p), "c.alias"))
query("k3_bibliometrix_file", _file_sql("' || chr(65279) || 'old_term;new_term", "raw_term || ';' || target_term", _MERGES))(lambda spark, d: _file_lines(spark, lambda p: sinks.write_bibliometrix(_built(spark, d)[2], p, True), "b.csv"))


_CELL = lambda c: f"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '[,\"\\r\\n]') THEN '\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"' ELSE CAST({c} AS VARCHAR) END"
_AUDIT_LINE = " || ',' || ".join(_CELL(c) for c in ("raw_term", "target_term", "tier", "rule_source", "clinical_safety_check", "raw_sum", "doc_count", "reduction", "export_status"))


@query("k5_audit_file", f"{o.CLUSTER_PATH}, {o.METRICS}, au AS ({o.AUDIT}) SELECT row_number() OVER (ORDER BY target_term, raw_term) AS n, {_AUDIT_LINE} AS line FROM au UNION ALL SELECT 0, chr(65279) || '{','.join(AUDIT_COLUMNS)}'")
def k5(spark, d):
    """The lines of the audit table's file."""
    return _file_lines(spark, lambda p: sinks.write_audit(_built(spark, d)[2], p, keyword_edges(spark, d)), "audit.csv")


@query("k6_s14_vocabulary_json", """SELECT lower(p_name) AS term, 'D' || min(p_partkey) AS descriptor_id, 'M"' || min(p_partkey) || '\\' AS concept_id, CASE WHEN min(p_partkey) % 3 > 0 THEN arg_min(p_type, p_partkey) || ' é' END AS canonical_name FROM part GROUP BY 1""")
def k6(spark, d):
    """A vocabulary of part names as a JSON file, and the file as a vocabulary."""
    path = shared_path(spark)
    key = F.min("p_partkey").cast("string")
    name = F.when(F.min("p_partkey") % 3 > 0, F.concat(F.min_by("p_type", "p_partkey"), F.lit(" é")))
    entries = spark.read.parquet(f"{d}/part.parquet").where("p_name IS NOT NULL").groupBy(F.lower("p_name").alias("term"))
    sinks.write_vocabulary(entries.agg(F.concat(F.lit("D"), key).alias("descriptor_id"), F.concat(F.lit('M"'), key, F.lit("\\")).alias("concept_id"), name.alias("canonical_name")), path)
    return tables.read_vocabulary_json(spark, path).select("term", "descriptor_id", "concept_id", "canonical_name")


@query("s14_roots_and_words", f"SELECT 'root' AS kind, unnest({o._LIST(ROOTS)}) AS value UNION ALL SELECT 'word', lower(w) FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)")
def s14(spark, d):
    """Root and word-list files with comments, blank lines and other case."""
    roots, words = shared_path(spark), shared_path(spark)
    entries = json.dumps({r: {"category": "c", "meaning": r, "examples": [r + "a"]} for r in ROOTS})
    spark.createDataFrame([(entries,)], "line string").coalesce(1).write.text(roots)
    names = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split(F.initcap("p_name"), " ")).alias("line"))
    names.unionByName(spark.createDataFrame([("# a comment",), ("",), ("  ",)], "line string")).write.text(words)
    return tables.read_roots_json(spark, roots).select(F.lit("root").alias("kind"), F.col("root").alias("value")).unionByName(tables.read_word_list(spark, words).select(F.lit("word").alias("kind"), F.col("word").alias("value")))


@query("k7_draft_file", f"{o.CLUSTER_PATH} SELECT raw_term, CASE WHEN raw_frequency % 3 > 0 THEN selected_for_export END AS selected, CASE WHEN raw_frequency % 2 = 0 THEN target_term END AS target FROM rules")
def k7(spark, d):
    """A draft with a choice, a target, both or none for each rule written, and read back."""
    f = F.col("raw_frequency")
    draft = _built(spark, d)[2].select("raw_term", F.when(f % 3 > 0, F.col("selected_for_export")).alias("selected"), F.when(f % 2 == 0, F.col("target_term")).alias("target"))
    return sinks.read_draft(spark, sinks.write_draft(draft, shared_path(spark)))

"""The registered queries in DuckDB's SQL, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from ..functions.checks import BYPASSED, PASSED, SLIPPED
from ..functions.lexicons import ACRONYM_STOP_WORDS, PROTECTED_ENDINGS, PROTECTED_WORDS, RISK_TERMS, ROOTS, SEED_VOCABULARY, TIER_1, TIER_2, TIER_3
from .corpus import keyword_edges_sql

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = lambda xs: "[" + ", ".join(map(_Q, xs)) + "]"

VOCABULARY = "vocabulary(vterm, descriptor_id, concept_id, canonical_name) AS (VALUES " + ", ".join("(" + ", ".join(map(_Q, r)) + ")" for r in SEED_VOCABULARY) + ")"
FREQS = f"edges AS ({keyword_edges_sql()}), freqs AS (SELECT lower(trim(kw_raw)) AS term, count(*) AS freq FROM (SELECT DISTINCT rec_seq, kw_raw FROM edges) WHERE trim(kw_raw) <> '' GROUP BY 1)"


def _protected(w: str) -> str:
    return f"(lower({w}) IN ({', '.join(map(_Q, PROTECTED_WORDS))}) OR regexp_matches(lower({w}), '({'|'.join(PROTECTED_ENDINGS)})$'))"


def lemma_word(w: str) -> str:
    low = f"lower({w})"
    cut = lambda n: f"left({low}, length({low}) - {n})"
    return (
        f"CASE WHEN {_protected(w)} THEN {w} WHEN {low} LIKE '%ses' AND {low} NOT LIKE '%sses' AND (({cut(3)} || 'sis') IN ({', '.join(map(_Q, PROTECTED_WORDS))}) OR length({low}) > 5) THEN {cut(3)} || 'sis'"
        f" WHEN {low} LIKE '%ies' AND length({low}) > 4 THEN {cut(3)} || 'y' WHEN {low} LIKE '%es' AND length({low}) > 4 THEN CASE WHEN regexp_matches({low}, '(ches|shes|xes|zes|sses)$') THEN {cut(2)} ELSE {cut(1)} END"
        f" WHEN {low} LIKE '%s' AND NOT regexp_matches({low}, '(ss|us|is)$') THEN {cut(1)} ELSE {w} END"
    )


def lemma_phrase(x: str) -> str:
    parts = f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
    return f"CASE WHEN len({parts}) = 0 THEN '' ELSE array_to_string(list_concat(({parts})[1:-2], [{lemma_word(f'(({parts})[-1])')}]), ' ') END"


def initials(words: str) -> str:
    return f"lower(array_to_string(list_transform({words}, lambda w: w[1]), ''))"


def aligned(a: str, p: str) -> str:
    bare = f"regexp_replace({a}, '[^A-Za-z0-9]', '', 'g')"
    words = f"regexp_extract_all({p}, '[A-Za-z0-9]+')"
    content = f"list_filter({words}, lambda w: NOT list_contains({_LIST(ACRONYM_STOP_WORDS)}, lower(w)))"
    return (
        f"(length({bare}) BETWEEN 1 AND 8 AND len({words}) > 0 AND (lower({bare}) = {initials(words)} OR (len({content}) > 0 AND lower({bare}) = {initials(content)})"
        f" OR (length({bare}) >= 2 AND regexp_matches({bare}, '^[a-z]') AND len({content}) > 1 AND lower({bare}) = lower(({words})[1][1]) || {initials(f'({content})[2:]')})))"
    )


PAREN = "'^(.*?)\\s*[(（](.*?)[)）]$'"


_CONTENT = lambda p: f"list_filter(regexp_extract_all({p}, '[A-Za-z0-9]+'), lambda w: NOT list_contains({_LIST(ACRONYM_STOP_WORDS)}, lower(w)))"


def decouple(x: str) -> str:
    """A struct of full_phrase, acronym, valid; x is a trimmed column."""
    outer, inner = f"trim(regexp_extract({x}, {PAREN}, 1))", f"trim(regexp_extract({x}, {PAREN}, 2))"
    both = f"regexp_matches({x}, {PAREN})"
    make = lambda f, a, v: "{'full_phrase': " + f + ", 'acronym': " + a + f", 'valid': {v}" + "}"
    return f"CASE WHEN {both} AND {aligned(inner, outer)} THEN {make(outer, inner, 'true')} WHEN {both} AND {aligned(outer, inner)} THEN {make(inner, outer, 'true')} ELSE {make(x, 'NULL', 'false')} END"


def conflicts(x: str, y: str, acr: str = "false", custom: tuple[str, ...] = ()) -> str:
    a, b = (f"list_distinct(regexp_extract_all(lower({t}), '[a-zA-Z0-9\\-]+'))" for t in (x, y))
    terms = {*RISK_TERMS, *custom}
    lex = _LIST(sorted(terms))
    phrases = _LIST(sorted(t for t in terms if " " in t))
    delta = f"list_filter(list_distinct(list_concat({a}, {b})), lambda t: list_contains({a}, t) <> list_contains({b}, t))"
    return (
        f"CASE WHEN {acr} THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_concat(list_filter({delta}, lambda t: list_contains({lex}, t)),"
        f" list_filter({phrases}, lambda p: contains(lower(trim({x})), p) <> contains(lower(trim({y})), p))))) END"
    )


def reason(c: str, acr: str = "false") -> str:
    return f"CASE WHEN {acr} THEN {_Q(BYPASSED)} WHEN len({c}) > 0 THEN {_Q(SLIPPED)} || array_to_string({c}, ', ') || ')' ELSE {_Q(PASSED)} END"


ROOT_LIST = _LIST(sorted(r for r in ROOTS if len(r) >= 4))


def roots(x: str) -> str:
    return f"list_filter({ROOT_LIST}, lambda r: contains(lower({x}), r))"


def hyphen(x: str, vocabulary: bool = True) -> str:
    """A scalar expression with lookups in freqs and vocabulary."""
    s, c = f"trim(replace({x}, '-', ' '))", f"trim(replace({x}, '-', ''))"
    f = lambda t: f"coalesce((SELECT freq FROM freqs f WHERE f.term = lower({t})), 0)"
    known = f"WHEN EXISTS (SELECT 1 FROM vocabulary WHERE vterm = lower({s})) THEN {s} WHEN EXISTS (SELECT 1 FROM vocabulary WHERE vterm = lower({c})) THEN {c}" if vocabulary else ""
    return f"CASE WHEN NOT contains({x}, '-') THEN {x} {known} WHEN {f(s)} < {f(c)} THEN {c} ELSE {s} END"


SHORT_UPPER = lambda x: f"(length(trim({x})) <= 5 AND trim({x}) = upper(trim({x})) AND trim({x}) <> lower(trim({x})))"
SHORT_WORD = lambda x: f"regexp_matches(trim({x}), '^[\\p{{L}}\\p{{N}}]{{1,6}}$')"

PROPS = f"""p0 AS (SELECT term, freq, {decouple('term')} AS d FROM freqs),
p1 AS (SELECT term, freq, d.full_phrase AS base_term, d.valid OR {SHORT_UPPER('term')} OR {SHORT_WORD('term')} AS is_acronym FROM p0),
p2 AS (SELECT *, {hyphen('base_term')} AS hyphen_resolved FROM p1),
p3 AS (SELECT *, {lemma_phrase('hyphen_resolved')} AS lemmatized FROM p2),
props AS (SELECT p3.*, coalesce(a.descriptor_id, b.descriptor_id) AS descriptor_id, coalesce(a.concept_id, b.concept_id) AS concept_id, coalesce(a.canonical_name, b.canonical_name) AS canonical_name
          FROM p3 LEFT JOIN vocabulary a ON a.vterm = lower(trim(lemmatized)) LEFT JOIN vocabulary b ON b.vterm = lower(trim(base_term)))"""

LINKS = f"""h AS (SELECT term AS src, hyphen_resolved AS dst, 'Hyphen Resolution' AS rule_source, false AS is_acr FROM props WHERE NOT is_acronym AND hyphen_resolved <> term AND hyphen_resolved IN (SELECT term FROM freqs)),
l AS (SELECT term AS src, lemmatized AS dst, 'Lemmatization' AS rule_source, false AS is_acr FROM props WHERE NOT is_acronym AND lemmatized <> term AND lemmatized IN (SELECT term FROM freqs) AND term NOT IN (SELECT src FROM h)),
ph AS (SELECT term, freq, regexp_extract_all(term, '[A-Za-z0-9]+') AS ws, {_CONTENT('term')} AS cs FROM props WHERE NOT is_acronym),
pk AS (SELECT term, freq, unnest([{initials('ws')}, CASE WHEN len(cs) > 0 THEN {initials('cs')} END, CASE WHEN len(cs) > 1 THEN lower(ws[1][1]) || {initials('cs[2:]')} END]) AS k, unnest([false, false, true]) AS low FROM ph WHERE len(ws) > 0),
ac AS (SELECT term, regexp_replace(term, '[^A-Za-z0-9]', '', 'g') AS bare FROM props WHERE is_acronym),
a AS (SELECT ac.term AS src, arg_min(pk.term, (-pk.freq, pk.term)) AS dst, 'Acronym Decoupling' AS rule_source, true AS is_acr FROM ac JOIN pk ON pk.k = lower(ac.bare)
      WHERE length(bare) BETWEEN 1 AND 8 AND (NOT low OR (length(bare) >= 2 AND regexp_matches(bare, '^[a-z]'))) GROUP BY ac.term),
g AS (SELECT *, first_value(term) OVER w AS lead, first_value(concept_id) OVER w AS lead_concept FROM props WHERE NOT is_acronym AND descriptor_id IS NOT NULL WINDOW w AS (PARTITION BY descriptor_id ORDER BY freq DESC, term)),
hla AS (SELECT * FROM h UNION ALL SELECT * FROM l UNION ALL SELECT * FROM a),
links AS (SELECT * FROM hla UNION ALL SELECT term, lead, CASE WHEN concept_id = lead_concept THEN 'MeSH Concept (' || concept_id || ')' ELSE 'MeSH Descriptor (' || descriptor_id || ')' END, {SHORT_UPPER('term')} FROM g WHERE term <> lead AND term NOT IN (SELECT src FROM hla))"""

CLOSED = """walk(src, node, path) AS (SELECT src, dst, [src] FROM links UNION ALL SELECT w.src, k.dst, list_append(w.path, w.node) FROM walk w JOIN links k ON k.src = w.node WHERE NOT list_contains(w.path, w.node)),
ends AS (SELECT src, arg_max(node, len(path)) AS dst FROM walk GROUP BY src),
closed AS (SELECT k.src, e.dst, k.rule_source, k.is_acr FROM links k JOIN ends e ON e.src = k.src WHERE e.dst <> k.src)"""

RULES0 = f"""r0 AS (SELECT *, {conflicts('src', 'dst', 'is_acr')} AS c FROM closed WHERE lower(trim(src)) <> lower(trim(dst))),
rules0 AS (SELECT src AS raw_term, dst AS target_term, CASE WHEN len(c) > 0 THEN {_Q(TIER_3)} WHEN regexp_matches(rule_source, 'Lemmatization|Hyphen|Syntax|Concept') THEN {_Q(TIER_1)} ELSE {_Q(TIER_2)} END AS tier, rule_source,
  CASE WHEN len(c) > 0 THEN 'Blocked: ' || {reason('c', 'is_acr')} ELSE 'Passed' END AS clinical_safety_check, f.freq AS raw_frequency, len(c) = 0 AS selected_for_export FROM r0 JOIN freqs f ON f.term = src),
targets0 AS (SELECT t AS target_term, coalesce(f.freq, 0) AS target_raw_freq FROM (SELECT dst AS t FROM closed UNION SELECT term FROM freqs WHERE term NOT IN (SELECT src FROM closed)) LEFT JOIN freqs f ON f.term = t)"""


def _summary(targets: str, rules: str) -> str:
    return f"""SELECT t.target_term, t.target_raw_freq, count(r.raw_term) AS variant_count, count(r.raw_term) FILTER (WHERE r.selected_for_export) AS selected_variant_count,
  CAST(t.target_raw_freq + coalesce(sum(r.raw_frequency) FILTER (WHERE r.selected_for_export), 0) AS BIGINT) AS combined_freq, CAST(t.target_raw_freq + coalesce(sum(r.raw_frequency), 0) AS BIGINT) AS total_potential_freq,
  coalesce(bool_or(r.tier = {_Q(TIER_3)}), false) AS has_blocked_variants FROM {targets} t LEFT JOIN {rules} r ON r.target_term = t.target_term GROUP BY 1, 2"""


# Pairs of a lone term and an active target with a common root, by place in the pass.
ABSORB = f"""c0 AS ({_summary('targets0', 'rules0')}),
active AS (SELECT target_term, row_number() OVER (ORDER BY combined_freq DESC, target_raw_freq DESC, target_term) AS pos FROM c0 WHERE variant_count > 0 OR target_raw_freq >= 2),
lone AS (SELECT c0.target_term AS term, c0.target_raw_freq AS freq, coalesce(a.pos, 1e9) AS pos FROM c0 LEFT JOIN active a ON a.target_term = c0.target_term WHERE variant_count = 0),
lr AS (SELECT *, unnest({roots('term')}) AS root FROM lone), ar AS (SELECT *, unnest({roots('target_term')}) AS root FROM active),
pairs AS (SELECT l.term, l.freq, l.pos, a.target_term, a.pos AS tpos, min(l.root) AS root FROM lr l JOIN ar a ON l.root = a.root AND l.term <> a.target_term GROUP BY ALL),
one AS (SELECT term, freq, arg_min(target_term, tpos) AS target, arg_min(root, tpos) AS root FROM pairs WHERE tpos < pos GROUP BY term, freq),
two AS (SELECT term, freq, arg_min(target_term, tpos) AS target, arg_min(root, tpos) AS root FROM pairs WHERE tpos > pos AND term NOT IN (SELECT term FROM one) AND term NOT IN (SELECT target FROM one) GROUP BY term, freq),
took AS (SELECT * FROM one UNION ALL SELECT * FROM two),
m0 AS (SELECT *, {conflicts('term', 'target')} AS c FROM took WHERE target NOT IN (SELECT term FROM took)),
rules AS (SELECT * FROM rules0 UNION ALL SELECT term, target, {_Q(TIER_3)}, 'Medical Morpheme (' || root || ')', CASE WHEN len(c) > 0 THEN 'Blocked: ' || {reason('c')} ELSE 'Peripheral Morpheme: shared root ''' || root || ''' (Manual confirmation required)' END, freq, false FROM m0),
targets AS (SELECT * FROM targets0 WHERE target_term NOT IN (SELECT term FROM took)),
clusters AS ({_summary('targets', 'rules')})"""

CLUSTER_PATH = f"WITH RECURSIVE {VOCABULARY}, {FREQS}, {PROPS}, {LINKS}, {CLOSED}, {RULES0}, {ABSORB}"

BY_TERM = f"""WITH {VOCABULARY}, {FREQS.replace('freqs AS', 'freqs0 AS')}, freqs AS (SELECT * FROM freqs0 WHERE freq >= 2),
q0 AS (SELECT term, freq, {decouple('term')} AS d FROM freqs), q1 AS (SELECT term, freq, d.full_phrase AS base FROM q0), q2 AS (SELECT *, {hyphen('base')} AS h FROM q1), q3 AS (SELECT *, {lemma_phrase('h')} AS lemma FROM q2),
q4 AS (SELECT q3.*, v.descriptor_id, v.canonical_name, coalesce(f.freq, 0) AS lemma_freq FROM q3 LEFT JOIN vocabulary v ON v.vterm = lower(trim(lemma)) LEFT JOIN freqs f ON f.term = lower(lemma)),
q5 AS (SELECT term AS raw_term, CASE WHEN {SHORT_UPPER('term')} AND NOT {SHORT_UPPER('lemma')} THEN lemma WHEN {SHORT_UPPER('lemma')} AND NOT {SHORT_UPPER('term')} THEN term WHEN freq > lemma_freq THEN term WHEN lemma_freq > freq THEN lemma
   WHEN lower(term) = lower(canonical_name) THEN term WHEN lower(lemma) = lower(canonical_name) THEN lemma WHEN length(term) <= length(lemma) THEN term ELSE lemma END AS target_term,
   CASE WHEN descriptor_id IS NOT NULL THEN 'MeSH (' || descriptor_id || ')' WHEN lemma <> term THEN 'Lemmatization' ELSE 'Direct' END AS rule_source, freq AS raw_frequency FROM q4),
q6 AS (SELECT *, {conflicts('raw_term', 'target_term')} AS c FROM q5),
rules AS (SELECT raw_term, target_term, CASE WHEN len(c) > 0 THEN {_Q(TIER_3)} WHEN regexp_matches(rule_source, 'Lemmatization|Hyphen|Punctuation|Syntax') THEN {_Q(TIER_1)} ELSE {_Q(TIER_2)} END AS tier, rule_source,
   CASE WHEN len(c) > 0 THEN 'Blocked: ' || {reason('c')} ELSE 'Passed' END AS clinical_safety_check, raw_frequency, len(c) = 0 AS selected_for_export FROM q6)"""

METRICS = """mapping AS (SELECT lower(trim(raw_term)) AS raw, max(lower(trim(target_term))) AS canonical FROM rules WHERE selected_for_export GROUP BY 1),
named AS (SELECT DISTINCT e.rec_seq, e.kw_raw, lower(trim(coalesce(m.canonical, e.kw_raw))) AS canonical FROM edges e LEFT JOIN mapping m ON m.raw = lower(trim(e.kw_raw))),
metrics AS (SELECT canonical, count(*) AS raw_sum, count(DISTINCT rec_seq) AS doc_count, count(*) - count(DISTINCT rec_seq) AS reduction FROM named WHERE canonical <> '' GROUP BY canonical)"""
AUDIT = """SELECT raw_term, target_term, tier, rule_source, clinical_safety_check, coalesce(raw_sum, raw_frequency) AS raw_sum, coalesce(doc_count, raw_frequency) AS doc_count, coalesce(reduction, 0) AS reduction,
 CASE WHEN selected_for_export THEN 'Included' ELSE 'Excluded/Review Needed' END AS export_status FROM rules LEFT JOIN metrics ON canonical = lower(trim(target_term))"""

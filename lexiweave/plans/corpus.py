"""A keyword corpus of our own, derived from line items the same way on Spark and in SQL.

A part names a term of a modifier, a site and a finding; its line items write the term in several ways: plain, plural,
hyphenated, closed up, as initials, with initials in parentheses, without its modifier, in other case. Some line
items carry a term of the seed vocabulary. Terms grow with the parts, up to the 20,800 that the lists make, in all ways of writing: 11,006 at scale 0.01 and 27,299 at 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import SEED_VOCABULARY

MODIFIERS = [
    "acute", "chronic", "early", "late", "advanced", "recurrent", "metastatic", "localized", "severe", "mild", "juvenile", "adult", "familial",
    "sporadic", "primary", "secondary", "benign", "rare", "common", "occult", "silent", "diffuse", "focal", "bilateral", "refractory", "stage two",
]
SITES = [
    "renal", "hepatic", "gastric", "cardiac", "pulmonary", "cutaneous", "ocular", "thyroid", "pancreatic", "bladder", "cervical", "ovarian", "spinal", "vascular", "skeletal", "lymphatic",
    "nasal", "dental", "tracheal", "colonic", "adrenal", "pelvic", "retinal", "splenic", "uterine", "aortic", "cranial", "pleural", "dermal", "muscular", "prostatic", "neuronal",
]
FINDINGS = [
    "tumor", "biopsy", "surgery", "therapy", "imaging", "screening", "infection", "inflammation", "fibrosis", "stenosis", "resistance", "toxicity", "survival",
    "recurrence", "marker", "lesion", "carcinoma", "metastasis", "transplant", "symptom", "disorder", "fatigue", "diagnosis", "sample", "ectomy of node",
]
SEED_TERMS = [row[0] for row in SEED_VOCABULARY]
#: Ways of writing a term: the first row of WAYS whose bound is above the line item's number modulo 32.
WAYS = 32


def _nth(words: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), n.cast("int"))


def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_seq, kw_raw): a keyword for each line item, in its order's record."""
    p, line = F.col("l_partkey"), F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")
    way = line % WAYS
    m, s, f = _nth(MODIFIERS, p * 7 % 26), _nth(SITES, (p * 13 + F.floor(p / 26)) % 32), _nth(FINDINGS, (p * 17 + F.floor(p / 832)) % 25)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("rec_seq"), way.alias("way"), m.alias("m"), s.alias("s"), f.alias("f"), _nth(SEED_TERMS, line % len(SEED_TERMS)).alias("seed"))
    term = F.concat_ws(" ", "m", "s", "f")
    initials = F.upper(F.concat(F.substring("m", 1, 1), F.substring("s", 1, 1), F.substring("f", 1, 1)))
    plural = F.when(F.col("f").endswith("y"), F.concat(F.regexp_replace("f", "y$", ""), F.lit("ies"))).otherwise(F.concat("f", F.lit("s")))
    words = (
        F.when(F.col("way") < 14, term)
        .when(F.col("way") < 17, F.concat_ws(" ", "m", "s", plural))
        .when(F.col("way") < 19, F.concat_ws(" ", "m", F.concat_ws("-", "s", "f")))
        .when(F.col("way") < 20, F.concat_ws(" ", "m", F.concat("s", "f")))
        .when(F.col("way") < 22, initials)
        .when(F.col("way") < 23, F.concat(term, F.lit(" ("), initials, F.lit(")")))
        .when(F.col("way") < 24, F.initcap(term))
        .when(F.col("way") < 25, F.concat(F.lit(" "), term, F.lit(" ")))
        .when(F.col("way") < 27, F.concat_ws(" ", "s", "f"))
        .when(F.col("way") < 28, F.concat_ws("-", "m", "s", "f"))
        .when(F.col("way") < 31, F.col("seed"))
        .otherwise(F.upper("seed"))
    )
    return lines.select("rec_seq", words.alias("kw_raw"))


def keyword_edges_sql() -> str:
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    initials = "upper(m[1] || s[1] || f[1])"
    ways = [
        (14, "t"), (17, "m || ' ' || s || ' ' || CASE WHEN f LIKE '%y' THEN left(f, length(f) - 1) || 'ies' ELSE f || 's' END"), (19, "m || ' ' || s || '-' || f"), (20, "m || ' ' || s || f"), (22, initials),
        (23, f"t || ' (' || {initials} || ')'"), (24, "array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"), (25, "' ' || t || ' '"), (27, "s || ' ' || f"), (28, "m || '-' || s || '-' || f"), (31, "seed"), (32, "upper(seed)"),
    ]
    cases = " ".join(f"WHEN way < {n} THEN {x}" for n, x in ways)
    return f"""SELECT rec_seq, CASE {cases} END AS kw_raw FROM (SELECT *, m || ' ' || s || ' ' || f AS t FROM (
  SELECT l_orderkey AS rec_seq, (l_orderkey * 31 + l_linenumber * 7 + l_partkey) % {WAYS} AS way, {words(SEED_TERMS)}[1 + (l_orderkey * 31 + l_linenumber * 7 + l_partkey) % {len(SEED_TERMS)}] AS seed,
  {words(MODIFIERS)}[1 + l_partkey * 7 % 26] AS m, {words(SITES)}[1 + (l_partkey * 13 + l_partkey // 26) % 32] AS s, {words(FINDINGS)}[1 + (l_partkey * 17 + l_partkey // 832) % 25] AS f FROM lineitem))"""


#: Line items that one task brings together, as records and as pairs that are compared: tasks grow in number with them, so that what one of them holds does not.
PER_TASK, PAIRS_PER_TASK = 1 << 18, 1 << 20


def _tasks(spark: SparkSession, sf_dir: str, per: int) -> int:
    return -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // per)


def dealt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_edges, the keywords of a record in one task: what is distinct by record needs no other exchange, and no table of a whole split's pairs before it."""
    tasks = _tasks(spark, sf_dir, PAIRS_PER_TASK)
    edges = keyword_edges(spark, sf_dir)
    return edges.repartition(tasks, "rec_seq") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else edges.repartition("rec_seq")


def keyword_records(spark: SparkSession, sf_dir: str, per: int = 64, prefix: str = "") -> DataFrame:
    """(path, rec_seq, kws): the sorted keywords of each record, `per` orders a path. One exchange brings the records of a path together, and what groups by path needs no other."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _tasks(spark, sf_dir, PER_TASK))
    path = F.concat(F.lit(prefix), F.floor(F.col("rec_seq") / per).cast("string"))
    edges = keyword_edges(spark, sf_dir).withColumn("path", path).repartition(tasks, "path")
    # The number first: what sorts the groups of a task then compares numbers, not paths.
    return edges.groupBy("rec_seq", "path").agg(F.sort_array(F.collect_set("kw_raw")).alias("kws")).select("path", "rec_seq", "kws")


def body_of(template: str, end: str = "\n") -> Column:
    """The tagged text of a record up to its last line end, which is `end`; template is wos, pubmed, refworks or cnki."""
    rec, kws = F.col("rec_seq").cast("string"), F.col("kws")
    half = F.floor((F.size(kws) + 1) / 2).cast("int")
    return {
        "wos": F.concat(
            F.lit("PT J\n"), F.when(F.col("rec_seq") % 5 != 0, F.concat(F.lit("DE "), F.array_join(F.slice(kws, F.lit(1), half), ";\n   "), F.lit("\n"))).otherwise(""),
            F.lit("ID "), F.array_join(kws, "; "), F.lit("\n"), F.when(F.col("rec_seq") % 7 != 0, F.concat(F.lit("UT WOS:"), rec, F.lit("\n"))).otherwise(""), F.lit("ER\n" + end),
        ),
        "pubmed": F.concat(F.lit("PMID- "), rec, F.lit("\nTI  - A study\n"), F.array_join(F.transform(kws, lambda k, i: F.concat(F.when(i % 2 == 0, F.lit("OT  - ")).otherwise(F.lit("MH  - *")), k, F.when(i % 2 == 0, "").otherwise("/therapy"))), "\n"), F.lit("\n" + end)),
        "refworks": F.concat(F.lit("RT Journal\nT1 title "), rec, F.lit("\nK1 "), F.array_join(kws, "；；"), F.lit("\n" + end)),
        "cnki": F.concat(F.lit("【来源篇名】title "), rec, F.lit("\n【关键词】"), F.array_join(kws, ";;"), F.lit(end)),
    }[template]


def record_bodies(spark: SparkSession, sf_dir: str, template: str, per: int = 64, end: str = "\n") -> DataFrame:
    """(path, rec_seq, body): the tagged text of each record, `per` orders a path."""
    return keyword_records(spark, sf_dir, per, "part-").select("path", "rec_seq", body_of(template, end).alias("body"))


def record_texts(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """(path, text): tagged text of all records, one file for each 64 orders."""
    files = record_bodies(spark, sf_dir, template)
    return files.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_seq", "body"))), lambda x: x["body"]), "").alias("text"))

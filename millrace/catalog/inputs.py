"""Inputs of the registered queries: the given tables, with noise that makes
every cleaning rule fire, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cleaning import CLEANERS
from millrace.operators.quota import Source, union_sources

SEED = 42
MIN_WORDS = 10
VAL_RATIO = 0.1
WEB, MATH = "web", "math"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(k: str) -> str:
    """SQL for the whole ``text`` with noise added, chosen by the integer expression ``k``."""
    odd_blanks = "\t\r\n\u00a0x\u2003y\u0085z\u001c."
    return f"""CASE ({k}) % 12
        WHEN 0 THEN text || ' see https://a.example.com/x?y=1#top and http://h:8080/z%20b'
        WHEN 1 THEN 's3://commoncrawl/crawl-data/CC-MAIN-2024-10/x.warc.gz tail\n' || text
        WHEN 2 THEN 'crawl CC-MAIN-2024-10 ' || text || ' CC-MAIN-24-1'
        WHEN 3 THEN text || ' <urn:uuid:0af1-22bc> <urn:uuid:0AF1>'
        WHEN 4 THEN text || '{odd_blanks}'
        WHEN 5 THEN text || ' www.a.example.org/p.html end'
        WHEN 6 THEN text || ' , odd ; spaces  !'
        WHEN 7 THEN 'file report-v1.pdf run.cgi ' || text
        WHEN 8 THEN text || ' ( ) (x) () (ab) (é )'
        ELSE text
    END"""


# Rows beside the given ones, in both sources: (ord, text).
EDGES = (
    (-4, None),
    (-3, ""),
    (-2, "ten words are one too few for this filter ok"),
    (-1, "eleven words are just enough to get through this filter here"),
)


def _with_edges(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.sparkSession.createDataFrame(EDGES, "ord bigint, text string"))


def web_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_edges(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("ord"), F.expr(noisy("doc_id")).alias("text")
        )
    )


def math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_edges(
        table(spark, sf_dir, "conversations").select(
            F.expr("conv_id * 1000 + turn").alias("ord"),
            F.expr(noisy("conv_id * 7 + turn")).alias("text"),
        )
    )


def sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    return [
        Source(WEB, web_rows(spark, sf_dir), ["ord"], CLEANERS["web"]),
        Source(MATH, math_rows(spark, sf_dir), ["ord"], CLEANERS["math"]),
    ]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept examples of both sources: their written tables, numbered."""
    return union_sources(sources(spark, sf_dir), [None, None], MIN_WORDS)


# The same in SQL. The patterns, in the plain form of the cleaning rules.
_W = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WEB_RULES = [
    (r"https?://[a-zA-Z0-9./?=&_-]+", ""),
    (r"s3://commoncrawl/crawl-data/[^\n]*\n?", ""),
    (r"CC-MAIN-\p{Nd}{4}-\p{Nd}{2}", ""),
    (r"<urn:uuid:[a-f0-9-]+>", ""),
    (f"[{_W}]+", " "),
]
_MATH_RULES = [
    (f"https?://[^{_W}]+", ""),
    (f"[{_W}]+", " "),
    (rf"www\.[^{_W}]+\.[\p{{L}}\p{{N}}_]+", ""),
    (f"[{_W}]([.,;:!?])", r"\1"),
    (r"[a-zA-Z0-9_\-\.]+\.(pdf|cgi)", ""),
    (rf"\([{_W}]*\)", ""),
    (rf"\([{_W}]*[^\n][{_W}]*\)", ""),
    (f"[{_W}]+", " "),
]


def _chain(text: str, rules: list[tuple[str, str]]) -> str:
    out = f"coalesce({text}, '')"
    for pattern, new in rules:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out}, ' ')"


def web_sql(text: str) -> str:
    return _chain(text, _WEB_RULES)


def math_sql(text: str) -> str:
    return _chain(text, _MATH_RULES)


WORDS_SQL = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END"

_EDGES_SQL = ", ".join(
    f"({ord_}, {'NULL' if text is None else repr(text)})" for ord_, text in EDGES
)


def raw_sql(table_name: str, key: str, number: str, edges: bool = True) -> str:
    """The rows of a source as a subquery with ``ord`` and ``text``."""
    more = f" UNION ALL SELECT * FROM (VALUES {_EDGES_SQL}) AS e(ord, text)" * edges
    return f"(SELECT {key} AS ord, {noisy(number)} AS text FROM {table_name}{more})"


RAW_WEB = raw_sql("documents", "doc_id", "doc_id")
RAW_MATH = raw_sql("conversations", "conv_id * 1000 + turn", "conv_id * 7 + turn")


def cleaned_cte(web: str = RAW_WEB, math: str = RAW_MATH) -> str:
    return f"""cleaned AS (
    SELECT 0 AS source_no, '{WEB}' AS domain, ord, {web_sql("text")} AS text FROM {web} AS w
    UNION ALL
    SELECT 1, '{MATH}', ord, {math_sql("text")} FROM {math} AS m
)"""


def examples_cte(cleaned: str, taken: str) -> str:
    return f"""{cleaned},
kept AS (SELECT * FROM cleaned WHERE {WORDS_SQL} > {MIN_WORDS}),
numbered_kept AS (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS idx FROM kept),
examples AS (
    SELECT domain || '_' || idx AS id, domain, text,
           CAST(row_number() OVER (ORDER BY source_no, ord) - 1 AS BIGINT) AS pos
    FROM {taken}
)"""


CLEANED_CTE = cleaned_cte()
EXAMPLES_CTE = examples_cte(CLEANED_CTE, "numbered_kept")

"""Vocabularies, token ids, windows, padding, masks, next-token pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import EXAMPLES_CTE, examples
from millrace.functions import table_functions
from millrace.functions.tokens import FALLBACK_PAD_ID, truncate_at_eos
from millrace.operators import metrics, tokenizing

HASH_VOCAB = 50_000
TOP_VOCAB = 500
UNK_ID = TOP_VOCAB
LENGTH, STRIDE = 128, 16
PAD_ID = FALLBACK_PAD_ID
EOS_ID, MIN_LENGTH, MAX_LENGTH, SMALL_VOCAB = 7, 20, 100, 64


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


class ReversedHashTokenizer:
    """A caller's tokenizer: one id per word, from its length and last letter."""

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[len(w) * 128 + ord(w[-1]) % 128 for w in t.split(" ") if w] for t in texts]


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_hash(examples(spark, sf_dir), HASH_VOCAB)


def vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.vocabulary(examples(spark, sf_dir), TOP_VOCAB)


def _encoded(df: DataFrame) -> DataFrame:
    return df.select("id", F.size("ids").alias("n_tokens"), joined("ids").alias("ids"))


def encode_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    vocab = tokenizing.vocabulary(rows, TOP_VOCAB)
    return _encoded(tokenizing.encode_vocab(rows, vocab, UNK_ID))


def encode_vocab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    vocab = tokenizing.vocabulary(rows, TOP_VOCAB)
    return _encoded(tokenizing.encode_by_join(rows, vocab, UNK_ID))


def encode_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(hashed(spark, sf_dir))


def encode_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(tokenizing.encode_with(examples(spark, sf_dir), ReversedHashTokenizer))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.fragments(hashed(spark, sf_dir), LENGTH, STRIDE, PAD_ID)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir).select(
        "original_id", "domain", "fragment_idx", joined("input_ids").alias("input_ids")
    )


def fragments_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fragments by the SQL table function."""
    table_functions.register(spark)
    rows = spark.sql(
        f"""SELECT id AS original_id, domain, w.fragment_idx, w.input_ids
            FROM {{coded}}, LATERAL token_windows(ids, {LENGTH}, {STRIDE}, {PAD_ID}) AS w""",
        coded=hashed(spark, sf_dir),
    )
    return rows.select(
        "original_id", "domain", "fragment_idx", joined("input_ids").alias("input_ids")
    )


def fragment_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pads = F.size(F.filter("input_ids", lambda t: t == PAD_ID))
    return cut(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.sum(F.size("input_ids")).alias("n_slots"),
        F.sum(pads).alias("n_pads"),
    )


def fragment_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir).select(
        "original_id", "fragment_idx", joined("attention_mask").alias("attention_mask")
    )


def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.next_token_pairs(hashed(spark, sf_dir)).select("id", "pos", "input", "target")


def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenizing.encode_hash(examples(spark, sf_dir), SMALL_VOCAB)
    kept = truncate_at_eos(
        F.col("ids"), (F.col("pos") % 5).cast("int"), EOS_ID, MIN_LENGTH, MAX_LENGTH
    )
    return rows.select("id", F.array_join(kept.cast("array<string>"), ",").alias("tokens"))


def _ids_sql(vocab: int) -> str:
    return (
        "list_transform(string_split(text, ' '), "
        f"lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {vocab})"
    )


TOKENS_CTE = f"""{EXAMPLES_CTE},
tokens AS (SELECT id, domain, pos, {_ids_sql(HASH_VOCAB)} AS ids FROM examples)"""


def windows_sql(source: str, keep: str = "") -> str:
    """CTEs ``counted`` and ``cuts`` over ``source`` with id, domain and ids."""
    step = LENGTH - STRIDE
    return f"""counted AS (
    SELECT *, CASE WHEN len(ids) <= {LENGTH} THEN 1
        ELSE 1 + CAST(ceil((len(ids) - {LENGTH}) / {step}.0) AS BIGINT) END AS k
    FROM {source}),
numbered AS (SELECT *, unnest(range(k)) AS j FROM counted),
cuts AS (
    SELECT id AS original_id, domain, {keep} CAST(j AS INTEGER) AS fragment_idx,
           ids[j * {step} + 1 : j * {step} + {LENGTH}] AS win
    FROM numbered)"""


PADDED = f"list_concat(win, list_transform(range({LENGTH} - len(win)), lambda i: {PAD_ID}))"
MASK = (
    f"list_concat(list_transform(win, lambda t: 1), "
    f"list_transform(range({LENGTH} - len(win)), lambda i: 0))"
)


def _encoded_sql(cte: str) -> str:
    return f"""WITH {cte}
        SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, array_to_string(ids, ',') AS ids
        FROM tokens"""


_VOCAB = f"""words AS (
    SELECT id, unnest(string_split(text, ' ')) AS token,
           generate_subscripts(string_split(text, ' '), 1) AS place
    FROM examples),
vocab AS (
    SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER) AS token_id
    FROM (SELECT token, count(*) AS n FROM words GROUP BY token)
    ORDER BY n DESC, token LIMIT {TOP_VOCAB})"""

_ENCODED_VOCAB = f"""WITH {EXAMPLES_CTE}, {_VOCAB}
    SELECT id, CAST(count(*) AS INTEGER) AS n_tokens,
           string_agg(CAST(coalesce(token_id, {UNK_ID}) AS VARCHAR), ',' ORDER BY place) AS ids
    FROM words LEFT JOIN vocab USING (token) GROUP BY id"""

_FRAGMENTS = f"""WITH {TOKENS_CTE}, {windows_sql("tokens")}
    SELECT original_id, domain, fragment_idx, array_to_string({PADDED}, ',') AS input_ids
    FROM cuts"""

QUERIES = {
    "vocab_top": vocab_top,
    "encode_vocab": encode_vocab,
    "encode_vocab_join": encode_vocab_join,
    "encode_hash": encode_hash,
    "encode_custom": encode_custom,
    "fragments": fragments,
    "fragments_in_sql": fragments_in_sql,
    "fragment_padding": fragment_padding,
    "fragment_mask": fragment_mask,
    "next_token_pairs": next_token_pairs,
    "truncate_at_eos": stop_rule,
}

ORACLES = {
    "vocab_top": f"WITH {EXAMPLES_CTE}, {_VOCAB} SELECT token, n, token_id FROM vocab",
    "encode_vocab": _ENCODED_VOCAB,
    "encode_vocab_join": _ENCODED_VOCAB,
    "encode_hash": _encoded_sql(TOKENS_CTE),
    "encode_custom": _encoded_sql(
        f"""{EXAMPLES_CTE}, tokens AS (
            SELECT id, list_transform(string_split(text, ' '),
                lambda w: len(w) * 128 + unicode(right(w, 1)) % 128) AS ids
            FROM examples)"""
    ),
    "fragments": _FRAGMENTS,
    "fragments_in_sql": _FRAGMENTS,
    "fragment_padding": f"""WITH {TOKENS_CTE}, {windows_sql("tokens")}
        SELECT domain, count(*) AS n_fragments,
               CAST(sum(len({PADDED})) AS BIGINT) AS n_slots,
               CAST(sum({LENGTH} - len(win)) AS BIGINT) AS n_pads
        FROM cuts GROUP BY domain""",
    "fragment_mask": f"""WITH {TOKENS_CTE}, {windows_sql("tokens")}
        SELECT original_id, fragment_idx, array_to_string({MASK}, ',') AS attention_mask
        FROM cuts""",
    "next_token_pairs": f"""WITH {TOKENS_CTE}, steps AS (
            SELECT id, ids, unnest(range(len(ids) - 1)) AS i FROM tokens)
        SELECT id, CAST(i AS INTEGER) AS pos, CAST(ids[i + 1] AS INTEGER) AS input,
               CAST(ids[i + 2] AS INTEGER) AS target
        FROM steps""",
    "truncate_at_eos": f"""WITH {EXAMPLES_CTE},
        gen AS (SELECT id, pos % 5 AS plen, {_ids_sql(SMALL_VOCAB)} AS ids FROM examples),
        stops AS (
            SELECT *, list_min(list_filter(range(1, len(ids) + 1),
                lambda i: ids[i] = {EOS_ID} AND plen + i > {MIN_LENGTH})) AS cut
            FROM gen)
        SELECT id, array_to_string(ids[1 : least(coalesce(cut, {MAX_LENGTH}), {MAX_LENGTH})], ',')
            AS tokens
        FROM stops""",
}

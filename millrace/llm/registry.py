"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import conversation_trie, decontaminate, embedding_dedup, fill_middle, language_model, line_dedup, mixing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity
from millrace.session import pin, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_spread_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count all documents, then recount them after two edits each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    change = lambda pos, removed, new: F.struct(
        pos.cast("int").alias("pos"), F.lit(removed).alias("removed"), new.alias("inserted")
    )
    edits = F.array(
        change(F.floor(size / 3), 12, F.lit(" (edited)")),
        change(F.floor(size / 2), 0, F.concat(F.lit("rev"), F.col("doc_id").cast("string"), F.lit(" "))),
    )
    counted = token_counts.count_tokens(docs).withColumn("edits", edits)
    return token_counts.recount(counted).select(
        "doc_id",
        "n_tokens",
        F.col("recounted.n_tokens").alias("n_tokens_edited"),
        F.length("recounted.text").cast("long").alias("n_chars_edited"),
        F.col("recounted.encoded_chars").alias("encoded_chars"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_corpus(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_corpus(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in fives share the first turns of the first of them, each a number of its own."""
    turns = pin(conversation_trie.ranked_turns(_table(spark, sf_dir, "conversations")), "turns")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    members = turns.select("conv_id").distinct()
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).withColumnRenamed("conv_id", "base")
    heads = members.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(first, "base").where(F.col("pos") <= shared)
    rebuilt = turns.where(F.col("pos") > shared).union(heads.select(*turns.columns))
    return conversation_trie.trie_of(rebuilt, members)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fim = F.col("fim")
    back = fill_middle.restored(fim.output, fim.form)
    return fill_middle.rearrange(docs).select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(fim.output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_source_mix": op1_source_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_model": op7_language_model,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH lines AS (
    SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
    FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
),
spread AS (
    SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') != ''
    GROUP BY 1 HAVING count(DISTINCT source) >= 5
),
marked AS (
    SELECT doc_id, i, line, trim(line, ' ') IN (SELECT line FROM spread) AS gone FROM lines
),
kept AS (
    SELECT doc_id, count(*) AS n_lines, sum(CAST(gone AS INTEGER)) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean
    FROM marked GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN text IS NOT NULL THEN md5(clean) END AS clean_md5
FROM documents d LEFT JOIN kept USING (doc_id)""",
    # Exact where a label has no more rows than a leaf, as in the correctness runs.
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
      ON a.label = b.label AND a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op11_conversation_trie": """
WITH turns AS (
    SELECT conv_id, row_number() OVER (
               PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
           ) AS pos,
           {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM turns),
members AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::UBIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::UBIGINT)),
                                 lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9 AS h
    FROM ids
),
rebuilt AS (
    SELECT members.conv_id, pos, t FROM members JOIN turns ON turns.conv_id = base WHERE pos <= h
    UNION ALL
    SELECT conv_id, pos, t FROM members JOIN turns USING (conv_id) WHERE pos > h
),
whole AS (
    SELECT conv_id, coalesce(list(t ORDER BY pos) FILTER (t IS NOT NULL), []) AS w FROM members LEFT JOIN rebuilt USING (conv_id) GROUP BY 1
),
prefixes AS (SELECT conv_id, w, d, w[1:d] AS p FROM whole, unnest(range(len(w) + 1)) AS u(d)),
nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(w) = d), '') AS ends
    FROM prefixes GROUP BY p, d
),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sums AS (
    SELECT p[1:k] AS p, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves,
           sum(CASE WHEN d > 0 THEN (n - 1) * strlen(p[d].text) ELSE 0 END) AS saved
    FROM full_nodes, unnest(range(d + 1)) AS u(k) GROUP BY 1
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM full_nodes a JOIN sums ON sums.p = a.p LEFT JOIN nodes b ON a.d > 0 AND b.p = a.p[1:a.d - 1]""",
    "op12_fill_in_middle": r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
    FROM documents
),
drawn AS (
    SELECT *, len(u) AS n,
           CAST('0x' || hex[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || hex[9:16] AS BIGINT) % (len(u) + 1) AS c2,
           CAST('0x' || hex[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || hex[25:32] AS BIGINT) % 100 AS c4
    FROM units
),
parts AS (
    SELECT doc_id, text, n,
           array_to_string(u[1:least(c1, c2)], '') AS p,
           array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(u[greatest(c1, c2) + 1:n], '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 50
                THEN 'plain' WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts""",
    "op13_suffix_dedup": """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents
),
windows AS (SELECT r, i, md5(substr(hx, 2 * i + 1, 400)) AS w FROM docs, unnest(range(0, n - 199)) AS u(i)),
repeated AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
numbered AS (
    SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span
    FROM (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true) AS fresh FROM repeated)
),
spans AS (SELECT r, span, min(i) AS b, max(i) + 200 AS e FROM numbered GROUP BY r, span),
bounds AS (
    SELECT r, b, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS after FROM spans
    UNION ALL
    SELECT docs.r, n, coalesce(max(e), 0) FROM docs LEFT JOIN spans ON spans.r = docs.r GROUP BY docs.r, n
),
kept AS (
    SELECT r, string_agg(substr(hx, 2 * after + 1, 2 * (b - after)), '' ORDER BY after) AS hx, sum(b - after) AS n
    FROM bounds JOIN docs USING (r) GROUP BY r
),
counts AS (SELECT r, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(docs.n AS BIGINT) AS n_bytes, CAST(docs.n - kept.n AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN counts USING (r)""",
    "op8_benchmark_decontamination": f"""
WITH items AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
           array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
),
docs AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
found AS (
    SELECT doc_id, item_id, i, sizes.n AS n
    FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - sizes.n + 2)) AS u(i)
    JOIN windows ON windows.n = sizes.n AND windows.t = array_to_string(w[i:i + sizes.n - 1], ' ')
),
hit AS (SELECT DISTINCT doc_id, j FROM found, unnest(range(i, i + n)) AS u(j)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY 1),
names AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY 1
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

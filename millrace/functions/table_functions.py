"""SQL table functions, declared in SQL, so that the planner sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# ``token_windows(ids, length, stride, pad_id)``: one row per window; none for null ids.
_TOKEN_WINDOWS = """
CREATE OR REPLACE TEMPORARY FUNCTION token_windows(ids ARRAY<INT>, length INT, stride INT, pad_id INT)
RETURNS TABLE (fragment_idx INT, input_ids ARRAY<INT>, attention_mask ARRAY<INT>)
RETURN
    SELECT fragment_idx,
           concat(part, array_repeat(token_windows.pad_id, token_windows.length - size(part))),
           concat(array_repeat(1, size(part)), array_repeat(0, token_windows.length - size(part)))
    FROM (
        SELECT j AS fragment_idx,
               slice(token_windows.ids, j * (token_windows.length - token_windows.stride) + 1,
                     token_windows.length) AS part
        FROM explode(
            CASE WHEN token_windows.stride < 0 OR token_windows.stride >= token_windows.length
                THEN raise_error('need 0 <= stride < length')
            WHEN token_windows.ids IS NULL THEN CAST(array() AS ARRAY<INT>)
            ELSE sequence(0, greatest(0, CAST(ceil(try_divide(size(token_windows.ids) - token_windows.length,
                     token_windows.length - token_windows.stride)) AS INT)))
            END) AS t(j))"""


def register(spark: SparkSession) -> None:
    """Make the table functions callable from SQL."""
    spark.sql(_TOKEN_WINDOWS)

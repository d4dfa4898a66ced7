"""Token counts: how many ids each text has, without keeping the ids.

Arrow batches are cut into runs of about equal bytes, so a run of short texts and one long text
cost a task alike, and a long text goes to the library in units cut at safe boundaries
(``units``), never whole. Only lengths leave the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.shared import ship, slices
from quittance.llm.units import encoder


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, by the byte-level tokenizer whose JSON is given.

    Special strings within a text count as the library counts them by default. Every row yields
    one row: a missing or empty text has 0 bytes and tokens, repeated rows and ids stay repeated,
    a missing id stays missing. Other columns are never read.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).count
        for batch in batches:
            found = [n for _, texts in slices(batch, 1) for n in count(texts)]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes.cast(pa.int64()), pa.array(found, pa.int64())],
                [id_column, "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint"
    return (
        docs.select(id_column, text_column)
        .mapInArrow(counted, schema)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

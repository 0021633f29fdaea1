"""Token counts of whole texts: batches of like bytes inside an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pileflow.llm.common import Batches
from pileflow.llm.tokens import PieceCount


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row.

    Null texts count as empty: 0 bytes, 0 tokens; texts of any length are counted whole. Repeated rows stay, rows with null ids too, and an empty
    table gives no rows; other columns are left out, so their names can't clash.
    ``limit``: over_limit is n_tokens > limit. A scan with one narrow output: no shuffle, nothing grows with the input.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        counter = PieceCount(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.counts(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

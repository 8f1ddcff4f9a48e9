"""Token counts: pieces are counted once per distinct pre-token, then summed over documents.

Within a task, each run of about 3 MB of text gives a relation of distinct
pre-tokens and, per document, the pre-tokens' occurrences.  The pieces of each
distinct pre-token are counted once (and remembered across runs in a bounded
memo), joined back to the occurrences by position, and summed per document.  No
ids of documents are formed and nothing is shuffled: a join across tasks would
move every (document, pre-token) pair, which outweighs counting a pre-token
once more in another task.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any
length are handled in full; repeated rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces, spans, work


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, limit: int = 1024, path: str | None = None) -> DataFrame:
    """Columns `keep` (default doc_id), n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row.

    path: a byte-level BPE file of the tokenizers library, or a sentencepiece
    .model, on every executor (default: the public 50k vocabulary).
    """
    keep = ["doc_id"] if keep is None else keep
    if {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError("a kept column would clash with the result")

    def by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = pieces.model(path)
        memo = spans.Memo(lambda some: [len(m.ids(p)) for p in some])
        for batch, buf, offsets in spans.chunks(batches, "__text"):
            starts = m.split(buf, offsets)
            distinct, index = spans.distinct_spans(buf, starts, np.append(starts[1:], len(buf)))
            counts = np.array(memo.values_of(distinct), np.int64)
            total = np.concatenate([[0], np.cumsum(counts[index])]) if len(distinct) else np.zeros(1, np.int64)
            at = np.searchsorted(starts, offsets)
            yield batch, np.diff(offsets), total[at[1:]] - total[at[:-1]]

    def by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch, buf, offsets in spans.chunks(batches, "__text"):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
            yield batch, np.diff(offsets), np.array([len(x) for x in m.encode(texts, num_threads=1)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, size, n in (by_words if (path or "").endswith(".model") else by_pieces)(batches):
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "__text"]
            made = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + made, names=[x for x, _ in kept] + ["n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "n_bytes long, n_tokens long, over_limit boolean"])
    return work.map_arrow(rows, run, schema)

"""Token counts: huge texts are encoded in overlapping chunks and spliced where both encodings must agree.

Why a splice is exact: the byte-level pre-tokeniser never joins a character that is not white space to white space
after it, and a match that starts at white space depends only on what follows. So between such two characters
every encoding has a boundary, and what stands before it has no influence on the tokens after it. (Special strings
hold no white space.) A splice is made only at such a position that is also a token boundary of both chunks;
where the overlap has none, the chunk is encoded anew with twice the overlap, at last with the whole rest.

Null and empty texts have no tokens; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lettermill.llm.common import text_batches

#: Texts of more characters are cut into chunks of so many.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
TOKEN_LIMIT = 1024


def load_tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def stable(text: str, i: int) -> bool:
    """Whether text between i - 1 and i is a boundary whatever stands around."""
    return 0 < i < len(text) and text[i].isspace() and not text[i - 1].isspace()


def count_chunked(tokenizer: Tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text, from encodings of at most chunk + overlap characters as far as boundaries allow."""
    encode = lambda a, b: [(s + a, e + a) for s, e in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]
    total, start = 0, 0  # tokens before start are counted; start is a splice
    while True:
        end = start + chunk
        widened = overlap
        while True:
            if end + widened >= len(text):
                return total + len(encode(start, len(text)))
            left = encode(start, end + widened)
            right = encode(end - widened, end + 2 * widened)
            ends, starts = {e for _, e in left}, {s for s, _ in right}
            # The last character of either encoding may belong to a longer match.
            common = [i for i in ends & starts if stable(text, i) and end - widened < i < end + widened]
            if common:
                splice = max(common)
                total += bisect_left([s for s, _ in left], splice)
                start = splice
                break
            widened = min(2 * widened, end - start) if widened < end - start else 2 * widened
            end = max(end, start + widened)


def count_texts(tokenizer: Tokenizer, texts: list[str], chunk: int = CHUNK_CHARS) -> list[int]:
    counts = [0] * len(texts)
    short = [i for i, text in enumerate(texts) if len(text) <= chunk]
    for i, encoding in zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
        counts[i] = len(encoding)
    for i, text in enumerate(texts):
        if len(text) > chunk:
            counts[i] = count_chunked(tokenizer, text, chunk)
    return counts


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; a row-local pass without a shuffle.

    path: a byte-level tokenizer file, readable on every executor.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        tokenizer = load_tokenizer(path)
        for batch in batches:
            counts: list[int] = []
            for _, texts in text_batches(batch):
                counts += count_texts(tokenizer, texts, chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", "text", size).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

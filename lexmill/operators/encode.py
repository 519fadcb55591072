"""Tokenizer training and corpus encoding with SentencePiece."""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..functions.udfs import slices

PAD, UNKNOWN, BEGIN, END = 0, 1, 2, 3
#: Ids are stored in two bytes.
MAX_VOCABULARY = 65535
#: Texts that are encoded at once, and their bytes unless it is one text.
SLICE, SLICE_BYTES = 200, 1 << 20
#: Most distinct words that a tokenizer is trained from, the most frequent first; their counts are those of all documents.
WORDS = 1_000_000


def word_counts(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(word, count) over all documents: the `words` most frequent, ties by code point."""
    each = docs.select(F.explode(F.split(text, SPACE + "+")).alias("word")).filter("word <> ''")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(words)


def train_tokenizer(docs: DataFrame, vocabulary: int = 8192, coverage: float = 0.9995, text: str = "text", words: int = WORDS) -> bytes:
    """A BPE model (serialised). Merges never cross white space, so it is trained from words and how often all documents hold them;
    the driver reads `words` words at most."""
    import sentencepiece

    if vocabulary > MAX_VOCABULARY:
        raise ValueError(f"vocabulary must be at most {MAX_VOCABULARY}")
    model = io.BytesIO()
    # the trainer reads counted words from a file only; nothing but this process reads it
    with tempfile.NamedTemporaryFile("w", suffix=".tsv", encoding="utf-8") as counted:
        for r in word_counts(docs, text, words).toLocalIterator():
            counted.write(f"{r['word']}\t{r['count']}\n")
        counted.flush()
        sentencepiece.SentencePieceTrainer.train(
            input=counted.name, input_format="tsv", model_writer=model, vocab_size=vocabulary, model_type="bpe", character_coverage=coverage,
            normalization_rule_name="nmt_nfkc_cf", split_digits=True, byte_fallback=True, pad_id=PAD, unk_id=UNKNOWN, bos_id=BEGIN, eos_id=END, hard_vocab_limit=False, minloglevel=2,
        )
    return model.getvalue()


def public_tokenizer(path: str) -> bytes:
    """A serialised SentencePiece model from a file of the driver's; a few MB, which encode_corpus hands to every worker."""
    return Path(path).read_bytes()


def encode_corpus(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds tokens, the ids of the stripped text and the model's end id; texts without ids are dropped. One model is loaded in each worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        end = processor.eos_id() if processor.eos_id() >= 0 else END
        for batch in batches:
            for part in slices(batch, SLICE, SLICE_BYTES):  # Python's numbers take many times the room of an array's
                ids = processor.encode([(t or "").strip() for t in part.to_pylist()], out_type=int, num_threads=1)
                yield pa.array([np.array([*x, end], dtype=np.int32) if x else None for x in ids], pa.list_(pa.int32()))

    # else the filter would be pushed down and run the encoder a second time, in a second worker of each task
    return docs.withColumn("tokens", run.asNondeterministic()(text)).filter(F.col("tokens").isNotNull())


def conversation_encoder(model: bytes):
    """An id function for chat.tokenizer_ids."""
    held: list = []

    def encode(text: str) -> list[int]:
        if not held:
            import sentencepiece

            held.append(sentencepiece.SentencePieceProcessor(model_proto=model))
        return held[0].encode(text, out_type=int)

    return encode

"""Token counts by a tokenizer file, in Arrow functions that return lengths only.

Texts are split at boundaries that no token can cross. A fragment that comes again, in the same text or another, is encoded
once in a worker's lifetime (its memory is of bounded size); fragments that are new in an Arrow batch go to the library in
batches of about equal bytes, so that a very long text is no batch of its own and no worker waits for it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.llm.pieces import batches

#: Fragments that a worker remembers at most, and characters of the longest that it remembers.
MEMORY, LONGEST = 700_000, 48
#: Bytes of a batch for the library, and texts' bytes that are split before any of them is encoded.
BATCH, BYTES = 256 << 10, 4 << 20


class Counter:
    """Counts tokens by the library of a file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.memory: dict[str, int] = {"": 0}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
            self.split = None
            return
        from tokenizers import Tokenizer

        with open(path) as file:
            steps = json.load(file).get("pre_tokenizer") or {}
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.lengths = lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        steps = steps.get("pretokenizers", [steps])
        drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        # White space that the pre-tokenizer drops is no part of a token; else a single space starts a token.
        self.split = self._dropped if drops else re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])").split if steps[-1].get("type") == "ByteLevel" else None

    @staticmethod
    def _dropped(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.split is None:
            return self._encoded(texts)
        cut, memory = [self.split(t) for t in texts], self.memory
        new = set().union(*cut).difference(memory)
        if len(memory) + len(new) > MEMORY:  # only what these texts need stays
            self.memory = memory = {f: memory[f] for f in {"", *set().union(*cut)} if f in memory}
        found = sorted(new, key=len)
        found = dict(zip(found, self._encoded(found)))
        memory.update((f, n) for f, n in found.items() if len(f) <= LONGEST)
        return [sum(n if (n := memory.get(f)) is not None else found[f] for f in parts) for parts in cut]

    def _encoded(self, texts: list[str]) -> list[int]:
        """Lengths by the library, in batches of about BATCH bytes."""
        out, start, total = [], 0, 0
        for k, text in enumerate(texts):
            total += len(text) if text.isascii() else len(text.encode())
            if total >= BATCH:
                out += self.lengths(texts[start : k + 1])
                start, total = k + 1, 0
        return out + self.lengths(texts[start:]) if start < len(texts) else out


@lru_cache(maxsize=4)
def load(path: str) -> Counter:
    """The counter of a path, once for each worker."""
    return Counter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each row of docs, null ids and repeated rows too.

    A null text counts as empty: no bytes and no tokens. An empty table gives no rows; columns besides doc_id and text are
    not read. Texts are read whole; over_limit says that a text has more than `limit` tokens.
    """
    path = path or default_path()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        counter = load(path)
        for batch in (b for whole in given for b in batches([whole], 4096, BYTES)):
            texts = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            tokens = counter.counts([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

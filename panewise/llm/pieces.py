"""Encoding and decoding with a SentencePiece model of the merge type (BPE).

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece that they would make, then by place; the
best pair merges until none is left (what is no piece falls back to bytes). A text is cut where no piece of the vocabulary
can reach across: before a space that follows another character, around line ends, and between a letter and a mark if the
vocabulary allows. The parts cannot influence each other, so that a task merges a part once for as long as it remembers it
(its memory is of bounded size, and given back with the task but for a few common parts: workers live on under other
operators). In each Arrow batch, the parts that are new are also encoded by the sentencepiece library
and must agree.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
codecs.register_error("panewise_bytewise", lambda error: ("\ufffd", error.start + 1))
#: Parts that a task remembers at most, and characters of the longest part that it remembers.
MEMORY, LONGEST = 200_000, 48
#: Parts, of those that came again, that stay for a worker's next task at most.
KEPT = 50_000
#: Rows of an output batch at most, and texts' bytes from which on a batch ends sooner.
ROWS, BYTES = 256, 512 << 10
#: Marks before which a text is cut after a letter.
MARKS = ".,;:!?|"


class Model:
    """A merge-type model file, without its library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only merge-type models that leave texts as they are, without pieces of the user's own")
        self.library = SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        text = lambda p: b"" if p.type == kinds.CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode()
        self.surface = [text(p) for p in proto.pieces]
        self.spaced = [p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p[1:] + p[:-1] for p in self.ids):
            raise ValueError("a piece reaches across a cut")
        plain = any(a.isalpha() and b in MARKS for p in self.ids for a, b in zip(p, p[1:]))
        inner = f" \n{re.escape(MARKS)}"
        self.cut = re.compile(("" if plain else rf" *[^{inner}]*[^\W\d_](?![^{inner}])|") + "\n| *[^ \n]+| +")
        self.memory: dict[str, bytes] = {}
        self.again: set[str] = set()

    def merge(self, part: str) -> list[str]:
        """The symbols of a part, its spaces as U+2581, when no pair on the agenda is left."""
        symbols, scores = list(part.replace(" ", SPACE)), self.scores
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := scores.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            one, two = symbols[a], symbols[b]
            if not one or not two or len(one) + len(two) != size:
                continue  # one of them has merged since
            symbols[a], symbols[b] = one + two, ""
            right[a] = c = right[b]
            if c >= 0:
                left[c] = a
                if (s := scores.get(symbols[a] + symbols[c])) is not None:
                    heappush(agenda, (s, a, c, size + len(symbols[c])))
            if (c := left[a]) >= 0 and (s := scores.get(symbols[c] + symbols[a])) is not None:
                heappush(agenda, (s, c, a, size + len(symbols[c])))
        return [s for s in symbols if s]

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(part):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def parts(self, text: str) -> list[str]:
        """The text's parts in order; line ends are parts of their own."""
        return self.cut.findall((" " if self.prefix else "") + text.replace(SPACE, " ")) if text else []

    def learn(self, new: list[str], check: bool = True) -> dict[str, bytes]:
        """The ids of parts as bytes; with `check` the library must give the same ids."""
        found = [self.part_ids(p) for p in new]
        if check and new:
            # A line end before a part keeps the library's own prefix away from it.
            head = len(self.library.encode("\n"))
            for p, ours, theirs in zip(new, found, self.library.encode(["\n" + p for p in new], num_threads=1)):
                if ours != theirs[head:]:
                    raise ValueError(f"the library encodes {p!r} as {theirs[head:]}, not {ours}")
        return {p: array("i", i).tobytes() for p, i in zip(new, found)}

    def encode(self, texts: list[str], check: bool = True) -> list[np.ndarray]:
        """Ids of each text, without begin or end ids."""
        cut, memory = [self.parts(t) for t in texts], self.memory
        every = set().union(*cut)
        long = {p for p in every if len(p) > LONGEST}
        every -= long
        new = every.difference(memory)
        self.again |= every - new
        if len(memory) + len(new) > MEMORY:  # what has come again since the last time stays, or else what this batch needs
            kept = self.again if len(self.again) + len(new) < 0.8 * MEMORY else every - new
            self.memory = memory = {p: memory[p] for p in kept}
            self.again = set()
        memory.update(self.learn(list(new), check))
        if not long:
            get = memory.__getitem__
        else:
            extra = self.learn(list(long), check)
            get = lambda p: memory[p] if p in memory else extra[p]
        return [np.frombuffer(b"".join(map(get, parts)), dtype=np.int32) for parts in cut]

    def forget(self) -> None:
        """Gives back the memory of parts, but for KEPT that came again, and what Arrow holds in reserve."""
        self.memory = {p: self.memory[p] for p in islice((p for p in self.again if p in self.memory), KEPT)}
        self.again = set()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character become U+FFFD one by one."""
        surface, first = self.surface, 0
        while first < len(ids) and not surface[ids[first]]:
            first += 1
        raw = b"".join(map(surface.__getitem__, ids))
        if self.prefix and first < len(ids) and self.spaced[ids[first]]:
            raw = raw[1:]
        return raw.decode(errors="panewise_bytewise")


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """The model at a path, once for each worker."""
    return Model(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def batches(rows: list[pa.RecordBatch], count: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose last column is text: at most `count` rows, and no more than `most` bytes unless one row has them."""
    for batch in rows:
        sizes, start, total = [size or 0 for size in pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist()], 0, 0
        for k, size in enumerate(sizes):
            if k > start and (k - start >= count or total + size > most):
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def column(kind: pa.DataType, values: np.ndarray) -> pa.Array:
    """Numbers as they lie in memory; pa.array() and fill_null() load pandas, which takes 23 MB of each worker."""
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(values)])


def starts(sizes: Iterable[int]) -> np.ndarray:
    return np.cumsum([0, *sizes], dtype=np.int32)


def lists(ids: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*ids, np.array([], dtype=np.int32)])
    return pa.ListArray.from_arrays(column(pa.int32(), starts(map(len, ids))), column(pa.int32(), values))


def strings(texts: list[str]) -> pa.Array:
    raw = [t.encode() for t in texts]
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(starts(map(len, raw))), pa.py_buffer(b"".join(raw)))


def encoded(docs: DataFrame, model_path: str | None = None, check: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): a row for each row of docs, null ids and repeated rows too.

    A null text counts as empty: no ids, and an empty decoded text. An empty table gives no rows; columns besides doc_id and
    text are not read. A text of any length is read whole.
    """
    path = model_path or default_path()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        model = load(path)
        try:
            for batch in (b for whole in given for b in batches([whole])):
                ids = model.encode([t or "" for t in batch.column(1).to_pylist()], check)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids), strings([model.decode(i.tolist()) for i in ids])], names=["doc_id", "ids", "decoded"])
        finally:
            model.forget()

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query op4 from those of encoded()."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Packing documents into training sequences with harmonic classes."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches

CACHED_WORDS, CACHED_CHARS = 600_000, 64
JOINED = 400  # words in one text for the tokenizer
SPECIAL = "<|"
RUN = re.compile(r"[^\w \n]{2}|_")
# Latin letters and digits: normal form C and lower case keep each one letter, but for U+0130
PLAIN = "0-9A-Za-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c != "\u0130")
MARK = re.compile(f"(?<=[{PLAIN}])([.,])")
KINDS = bytes(32 if c in b" \n" else 95 if c == 95 else 97 if chr(c).isalnum() else 33 for c in range(128)) + bytes([33]) * 128
_LOADED: dict[str, "Encoder"] = {}

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, with the ids of single words remembered.

    The tokenizer's own pre-splitting never reaches across white space, so the ids of a text are
    those of its words between spaces and line feeds in turn. Nor does it join a letter with a
    mark after it, or mind the case of ASCII, so marks are set apart and words lower-cased first;
    not after other letters than PLAIN, whose normal form or lower case may end in a mark.
    Words of letters alone are one pre-token each and go to the tokenizer many at once; the ids
    that end a pre-token part them again. The store of words is bounded: a full one is emptied.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Remember words, letters alone in few calls, others one by one."""
        words, single, rest = self.words, [], []
        for w in new:
            (single if w.isalpha() and (w.isascii() or w.lower().isalpha()) else rest).append(w)
        parts = [single[at : at + JOINED] for at in range(0, len(single), JOINED)]
        for at in range(0, len(parts), 50):
            some = parts[at : at + 50]
            for part, ids in zip(some, self._plain([" ".join(part) for part in some])):
                stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(stops) != len(part):  # a letter that this tokenizer's tables do not count as one
                    words.update(zip(part, (i.tobytes() for i in self._plain(part))))
                    continue
                raw = ids.tobytes()
                words.update((w, raw[i:j]) for w, i, j in zip(part, [0, *stops], stops))
        words.update(zip(rest, (i.tobytes() for i in self._plain(rest))))

    @staticmethod
    def eased(text: str) -> str:
        """A text with the same ids and fewer different words: marks that stand alone are set apart,
        and ASCII is in lower case. Two marks side by side are one pre-token and stay together."""
        plain = text.isascii()
        if plain:
            kinds = text.encode().translate(KINDS)
            runs = b"!!" in kinds or b"_" in kinds
        else:
            runs = RUN.search(text) is not None
        if not runs:
            text = text.replace(",", " ,").replace(".", " .") if plain else MARK.sub(r" \1", text)
        return text.lower() if plain and SPECIAL not in text else text

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [self.eased(t).replace("\n", " ").split(" ") for t in texts]
        every = set().union(*split)
        new = every - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, new = {"": b""}, every - {""}
        self._learn(sorted(new))
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        for w in [w for w in new if len(w) > CACHED_CHARS]:
            del self.words[w]
        return out


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Packer:
    """Fills sequences of one worker.

    Document lengths are put in reciprocal-capacity classes: class i holds lengths over
    capacity/(i+1) up to capacity/i, and each bin of class i takes just i documents, whole. What a
    bin then has left is filled from one document at a time, the filler, which alone is cut. Of
    longer documents whole sequences are cut first. Bins that are incomplete at the end give their
    documents back, which are laid end to end; so padding is at most a worker's last sequence.
    """

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = {}
        self.filler: tuple | None = None
        self.short: tuple[int, int] | None = None  # a sequence that waits for a filler, and where it goes on

    def put(self, doc_id, ids: bytes):
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            yield self.row((doc_id, start, self.capacity, total, ids[4 * start : 4 * (start + self.capacity)]), self.new(), 0)
            start += self.capacity
        if start == total:
            return
        piece = (doc_id, start, total - start, total, ids[4 * start :])
        if self.filler is None:
            self.filler = piece
            if self.short:
                yield from self.fill(*self.short)
            return
        count = self.capacity // piece[2]
        bin_ = self.open.setdefault(count, [])
        bin_.append(piece)
        if len(bin_) == count:
            del self.open[count]
            sequence, offset = self.new(), 0
            for p in bin_:
                yield self.row(p, sequence, offset)
                offset += p[2]
            yield from self.fill(sequence, offset)

    def fill(self, sequence: int, offset: int):
        """Fill a sequence from the filler, as far as it goes."""
        self.short = None
        if offset < self.capacity and self.filler:
            doc_id, start, length, total, ids = self.filler
            take = min(length, self.capacity - offset)
            yield self.row((doc_id, start, take, total, ids[: 4 * take]), sequence, offset)
            offset += take
            self.filler = (doc_id, start + take, length - take, total, ids[4 * take :]) if take < length else None
        if offset < self.capacity:
            self.short = sequence, offset

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def row(piece: tuple, sequence: int, offset: int) -> tuple:
        doc_id, start, length, total, ids = piece
        return doc_id, start, length, zlib.crc32(ids), total, sequence, offset, ids

    def end(self):
        """What incomplete bins hold, end to end, longest first."""
        rest = [*([self.filler] if self.filler else []), *(p for count in sorted(self.open) for p in self.open[count])]
        sequence, offset = self.short or (None, self.capacity)
        self.open, self.filler, self.short = {}, None, None
        for doc_id, start, length, total, ids in rest:
            while length:
                if offset == self.capacity:
                    sequence, offset = self.new(), 0
                take = min(length, self.capacity - offset)
                yield self.row((doc_id, start, take, total, ids[: 4 * take]), sequence, offset)
                start, length, ids, offset = start + take, length - take, ids[4 * take :], offset + take


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids.

    A document is its ids and then `end_id`; null and empty texts are `end_id` alone, so every
    row of docs has a piece. Workers pack their own partition, without a shuffle: sequence ids are
    the partition's number times 2**33 and up, so a retried task gives the same rows. Repeated
    rows are packed each; columns besides doc_id and text are not read. ids (binary, little-endian
    unsigned 32 bit) is added with `with_ids`.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    names = [f.name for f in SCHEMA][: 8 if with_ids else 7]
    last = end_id.to_bytes(4, "little")

    def each(batches):
        from pyspark import TaskContext

        code, packer = encoder(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 33)

        def out(rows):
            columns = list(zip(*rows)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) for k, f in enumerate(SCHEMA) if f.name in names], names=names)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield out([r for d, ids in zip(b.column(0).to_pylist(), code.texts(texts)) for r in packer.put(d, ids + last)])
        yield out(list(packer.end()))

    kinds = ", ".join(f"`{n}` {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, kinds)

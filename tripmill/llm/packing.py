"""Harmonic packing of documents into token sequences.

The classes of a capacity C are the lengths C/2, C/3, ... rounded down: class j holds pieces that fill a slot of C // j
tokens, and a sequence of class j holds exactly j of them. A document is cut so that each piece
fills the slot of its class up to a share ``slack``: whole capacities first, then the largest slot that the
rest covers, and so on; a rest that comes within ``slack`` below a slot stays in one piece.

Every worker fills the sequences of each class by itself, so nothing is shuffled and no count is global. When its rows
end, the pieces that wait in unfilled sequences (fewer than j for class j, so a bounded number of tokens)
are laid end to end, cut at each capacity, and the last stretch is cut into powers of two, which
need no padding. Cuts and slots depend on the rows of a partition alone: a task that
is run again gives the same result.

Results by case: null text is an empty one and has one token, the separator; repeated rows are packed once per row;
an empty table has no pieces.
"""

from __future__ import annotations

import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripmill.llm.common import by_the_megabyte, text_bytes

CAPACITY = 4096
SEPARATOR = 2
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, piece_class int"
)
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_class"]
ROWS_PER_BATCH = 20_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts. The vocabulary's rules never look across ASCII white space, so a text's ids are those of
    its words, one after the other, and words are remembered. Two generations of about ``remember`` bytes at most
    are kept: when the younger is full it becomes the older, and what is still used moves over.

    New words are encoded many at a time. A word of letters is one unit of the vocabulary's rules and ends in its only
    token marked as a word's end; closing punctuation is a unit of its own, and case is folded by the rules. Of letters
    up to U+00FF the rules make one spelling each, whatever stands beside them, so such units go to the vocabulary's merges
    directly. Other words are encoded with a control character between them, whose token occurs in no other word; words
    that hold the character are encoded alone."""

    MARK = b"\x01"
    CLOSING = string.punctuation

    ENTRY = 190  # bytes of a remembered word besides its text and ids, about

    def __init__(self, path: str, remember: int = 80 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.young: dict[bytes, bytes] = {}
        self.weight = 0
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        (self.mark,) = self.plain(self.MARK.decode())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.merges = self.tokenizer.model
        self.spelling = {point: self.spelled(chr(point)) for point in range(256) if chr(point).isalpha()}

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def spelled(self, letter: str) -> str:
        ((unit, _),) = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter))
        return unit

    def remember_cut(self, words: list[bytes], coded: np.ndarray, ends: list[int], gap: int) -> None:
        begin, data = 0, coded.tobytes()
        for word, end in zip(words, ends, strict=True):
            self.keep(word, data[4 * begin : 4 * end])
            begin = end + gap

    def keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.weight += len(word) + len(ids) + self.ENTRY

    def add(self, words: list[bytes]) -> None:
        lettered, others, far = [], [], {}
        young, old, tokenize, spelling = self.young, self.old, self.merges.tokenize, self.spelling
        for word in words:
            text = word.decode()
            core = text.rstrip(self.CLOSING)
            small = core.lower()
            if not small.isalpha():
                others.append(word)
                continue
            near = core.isascii() or max(core) <= "\xff"
            key = (small if near else core).encode()
            if key not in young:
                if (ids := old.get(key)) is None and near:
                    unit = small if small.isascii() else small.translate(spelling)
                    ids = array("I", [token.id for token in tokenize(unit)]).tobytes()
                if ids is None:
                    far[key] = None
                else:
                    self.keep(key, ids)
            if key != word:
                lettered.append((word, key, text[len(core) :]))
        if far:
            coded = np.array(self.plain(b" ".join(far).decode()), np.uint32)
            self.remember_cut(list(far), coded, (np.flatnonzero(self.ends[coded]) + 1).tolist(), 0)
        for word, key, tail in lettered:
            if tail not in self.tails:
                self.tails[tail] = np.array(self.plain(tail), np.uint32).tobytes()
            self.keep(word, young[key] + self.tails[tail])
        together = [word for word in others if self.MARK not in word]
        if together:
            coded = np.array(self.plain((b" %s " % self.MARK).join(together).decode()), np.uint32)
            self.remember_cut(together, coded, np.append(np.flatnonzero(coded == self.mark), len(coded)).tolist(), 1)
        for word in others:
            if self.MARK in word:
                self.keep(word, np.array(self.plain(word.decode()), np.uint32).tobytes())

    def ids(self, text: bytes) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Words that are not remembered are encoded once for all of the texts."""
        young, old = self.young, self.old
        split = [text.split() for text in texts]
        found = [list(map(young.get, words)) for words in split]
        absent: dict[bytes, None] = {}
        for words, coded in zip(split, found, strict=True):
            absent.update(dict.fromkeys([word for word, ids in zip(words, coded, strict=True) if ids is None]))
        new = []
        for word in absent:
            if (ids := old.get(word)) is None:
                new.append(word)
            else:
                self.keep(word, ids)
        for begin in range(0, len(new), 10_000):
            self.add(new[begin : begin + 10_000])
        whole = [
            np.frombuffer(b"".join([young[word] if ids is None else ids for word, ids in zip(words, coded, strict=True)]), np.uint32)
            for words, coded in zip(split, found, strict=True)
        ]
        if self.weight > self.remember:
            self.old, self.young, self.weight = young, {}, 0
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        return whole


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: Spark uses a process for many tasks, and its words stay known."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def cuts(length: int, capacity: int = CAPACITY, slack: float = 0.03) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        close = capacity // rest  # the class of the smallest slot that holds the rest whole
        if rest >= (1 - slack) * (capacity // close):
            pieces.append((rest, close))
            break
        slot = capacity // (close + 1)
        if slot == 0:
            pieces.append((rest, close))
            break
        pieces.append((slot, close + 1))
        rest -= slot
    return pieces


class Bins:
    """The open sequences of one worker."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next = capacity, worker << 32
        self.open: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}

    def close(self, pieces, kind: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, kind
            offset += len(ids)
        self.next += 1

    def put(self, doc: int, ids: np.ndarray, slack: float) -> Iterator[tuple]:
        start, total = 0, len(ids)
        for length, kind in cuts(total, self.capacity, slack):
            waiting = self.open.setdefault(kind, [])
            piece = ids[start : start + length]
            waiting.append((doc, start, total, piece if kind == 1 else piece.copy()))  # a view would keep the whole document
            start += length
            if len(waiting) == kind:
                yield from self.close(self.open.pop(kind), kind)

    def finish(self) -> Iterator[tuple]:
        """What waits, end to end: full sequences, then powers of two."""
        waiting = [piece for kind in sorted(self.open) for piece in self.open[kind]]
        left = sum(len(piece[3]) for piece in waiting)
        rooms = [self.capacity] * (left // self.capacity)
        rest = left % self.capacity
        rooms += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        at = 0
        for room in rooms:
            filled = []
            while room:
                doc, start, total, ids = waiting[at]
                filled.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    waiting[at] = (doc, start + room, total, ids[room:])
                else:
                    at += 1
                room -= len(filled[-1][3])
            yield from self.close(filled, 0)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: float = 0.03, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece. ``path``: the tokenizer's file, by default the public word vocabulary. ``capacity``
    must be a power of two. ``piece_class`` is j, or 0 for pieces that a worker laid end to end."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, bins = encoder(path), Bins(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int32() if name == "piece_class" else pa.int64()) for column, name in zip(zip(*rows, strict=True), COLUMNS, strict=True)], names=COLUMNS
            )
            rows.clear()
            return made

        for part in (part for batch in batches for part in by_the_megabyte(batch)):
            raw, offsets = text_bytes(part.column("text"))
            data, ends = raw.tobytes(), offsets.tolist()
            texts = words.ids_of([data[begin:end] for begin, end in zip(ends[:-1], ends[1:], strict=True)])
            for doc, ids in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                rows.extend(bins.put(doc, np.append(ids, np.uint32(separator)), slack))
                if len(rows) >= ROWS_PER_BATCH:
                    yield flush()
        rows.extend(bins.finish())
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

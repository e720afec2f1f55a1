"""Sum-of-squares packing of token sequences, online in every task.

Each task packs the documents of its own input split as they come, so token ids are never shuffled. A document longer
than a window fills whole windows first; its rest goes where the sum of squared counts of partially filled
windows, over all fill levels, becomes smallest. The counts are one array with an entry per level.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table

WINDOW = 2048
END_ID = 1
#: Beyond so many partially filled windows a task joins their contents, cutting pieces where a window is full.
MAX_OPEN = 1024
#: Pieces of text whose ids a worker remembers: twice so many at most, the longest unused ones go first.
CACHE_PIECES = 400_000
_FLUSH_IDS = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


_KNOWN: dict[str | None, list[dict[bytes, bytes]]] = {}
_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_OTHER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
#: Letters whose lower case and canonical form are certain: such a piece goes to the model as it is.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
# The byte-level alphabet writes a byte as its own Latin-1 character, others as those from 256 on.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _pieces(texts: pa.Array) -> wa.Words:
    """Runs between white space, cut further between Latin-1 letters and other ASCII characters.

    The tokenizer's own pattern always splits there, but for a contraction after an apostrophe.
    """
    raw, offsets = wa.text_bytes(texts)
    letter, other = _LETTER[raw], _OTHER[raw]
    # letters of two bytes from U+00C0 to U+00FF, but for the signs of multiplication and division
    latin = (raw[:-1] == 0xC3) & ((raw[1:] & 0xDF) != 0x97)
    letter_end, letter_start = letter.copy(), letter.copy()
    letter_end[1:] |= latin
    letter_start[:-1] |= latin
    cut = np.zeros(len(raw), bool)
    cut[1:] = (letter_end[:-1] & other[1:]) | (other[:-1] & letter_start[1:] & (raw[:-1] != ord("'")))
    return wa.split_words(raw, offsets, wa.NOT_SPACE, wa.LOWER, cut)


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextTokens:
    """Ids of texts, each different piece encoded once.

    Holds for a vocabulary that lowers case, drops white space, and tells letters, digits and the rest apart before
    it joins anything, with a mark at the end of each run. Its added tokens are found as they stand, before all else;
    what lies between them is encoded by itself.
    """

    def __init__(self, path: str | None) -> None:
        self.tokenizer = tokenizer(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # of tokens that start at one place the longest
        self.added = dict(sorted(added.items(), key=lambda t: -len(t[0])))
        self.mark = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        # of the worker, not of the task: pieces seen lately, and those before them
        self.known = _KNOWN.setdefault(path, [{}, {}])

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of at least these pieces."""
        if len(self.known[0]) > CACHE_PIECES:
            self.known[:] = [{}, self.known[0]]
        recent, before = self.known
        model, rest = self.tokenizer.model, []
        for piece in pieces:
            if piece in recent:
                continue
            if piece in before:
                recent[piece] = before[piece]
                continue
            if not piece.isalpha():
                lowered = piece.decode().lower()
                if not _PLAIN.fullmatch(lowered):
                    rest.append(piece)
                    continue
                letters = lowered.encode().decode("latin-1").translate(_BYTE_LETTERS)
            else:
                letters = piece.decode()
            recent[piece] = pack(*[t.id for t in model.tokenize(letters)])
        for piece, found in zip(rest, self.tokenizer.encode_batch([p.decode() for p in rest], add_special_tokens=False)):
            recent[piece] = pack(*found.ids)
        return recent

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts cut at added tokens: the segments, the id that follows each, and the index of each text's first one."""
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= np.asarray(pc.fill_null(pc.match_substring(texts, token), False))
        if not marked.any():
            return texts, np.full(len(texts), END_ID), np.arange(len(texts) + 1)
        segments: list[str | None] = []
        closing, first = [], [0]
        for text, cut in zip(texts.to_pylist(), marked.tolist()):
            found = self.mark.split(text) if cut else [text]
            segments += found[::2]
            closing += [*(self.added[t] for t in found[1::2]), END_ID]
            first.append(len(segments))
        return pa.array(segments, pa.large_string()), np.array(closing), np.array(first)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by ``END_ID``, and where each text starts."""
        segments, closing, texts_first = self.split(texts)
        words = _pieces(segments)
        vocabulary = words.vocabulary.to_pylist()
        known = self.learn(vocabulary)
        closing_ids, closing = np.unique(closing, return_inverse=True)
        parts = [*map(known.__getitem__, vocabulary), *map(pack, closing_ids.tolist())]
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        codes = np.insert(words.codes, words.rows[1:], len(vocabulary) + closing)
        lengths = sizes[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(first[codes] - before[:-1], lengths) + np.arange(before[-1])]
        return ids, before[words.rows + np.arange(len(words.rows))][texts_first]


class Packer:
    """Windows of one task. A piece is ``(document, start, ids, document's ids in all)``."""

    def __init__(self, window: int, max_open: int) -> None:
        self.window, self.max_open = window, max_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.closed: list[list[tuple]] = []

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.closed.append([(document, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.place((document, whole, ids[whole:].copy(), len(ids)))

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level, room = self.level, self.window - size
        # change of the sum of squares, less 1: by a new window, or by one of each fill that moves up
        gain = 2 * level[size:]
        gain[1:] += 1 - 2 * level[1 : room + 1]
        gain[room] -= 1  # a window that gets full leaves the count
        gain[1:][level[1 : room + 1] == 0] = np.iinfo(np.int64).max
        # of equal gains the fullest window
        best = room - int(np.argmin(gain[::-1]))
        window = self.open[best].pop() if best else []
        level[best] -= bool(best)
        window.append(piece)
        if best + size == self.window:
            self.closed.append(window)
        else:
            level[best + size] += 1
            self.open[best + size].append(window)
        if level.sum() > self.max_open:
            self.join()

    def join(self) -> None:
        """Fill windows one after the other from all open ones; at most one stays open."""
        pieces = [p for windows in self.open for w in windows for p in w]
        self.level[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        current, used = [], 0
        for document, start, ids, total in pieces:
            while len(ids):
                part = ids[: self.window - used]
                current.append((document, start, part, total))
                used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                if used == self.window:
                    self.closed.append(current)
                    current, used = [], 0
        if used:
            self.level[used] += 1
            self.open[used].append(current)

    def finish(self) -> None:
        self.join()
        self.closed += [w for windows in self.open for w in windows]


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    id_column: str = "doc_id",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian 32-bit numbers. A null or empty text is the closing id alone. Repeated rows are packed
    each. Every id is in exactly one piece. A sequence is identified by its task and a number there;
    all but one per task are full. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = (
        f"`{id_column}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint,"
        " sequence_id bigint, offset bigint"
    )
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens = Packer(window, max_open), TextTokens(vocabulary)
        sequence = TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            nonlocal sequence
            rows: list[list] = [[] for _ in schema]
            for pieces in packer.closed:
                offset = 0
                for document, start, ids, total in pieces:
                    row = (document, start, len(ids), ids.tobytes(), total, sequence, offset)
                    for column, value in zip(rows, row):
                        column.append(value)
                    offset += len(ids)
                sequence += 1
            packer.closed = []
            return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                ids, starts = tokens(part.column("text"))
                for i, document in enumerate(part.column(id_column).to_pylist()):
                    packer.add(document, ids[starts[i] : starts[i + 1]])
                    if len(packer.closed) * window > _FLUSH_IDS:
                        yield flushed()
                # pieces that wait are copies; the slice's ids can go
                if packer.closed:
                    yield flushed()
        packer.finish()
        if packer.closed:
            yield flushed()

    return docs.select(id_column, "text").mapInArrow(run, out)


def digest_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(pack_documents(table(spark, sf_dir, "documents")))

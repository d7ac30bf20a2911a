"""Packing by vector bin packing: a dot-product heuristic under several limits at once.

Each piece demands tokens, one segment and its loss-bearing tokens; each sequence has a limit on all three. An open
sequence takes, of the pieces that fit, the one whose demand has the largest dot product with what the sequence
has left (both as shares of the limits): pieces are drawn to the limits that are still wide. When none fits, a document
may be cut to fill the rest (``cut=True``), or the sequence closes (whole examples, ``cut=False``).

Each task packs its own rows in blocks of a fixed number of open pieces and carries what is left of a block to
the next, so there is no shuffle, memory doesn't grow with the input, and only a task's last sequence is short. That one is cut into
lengths that are powers of two, which need no padding. Sequence ids are the task's partition and a counter:
a task that is run again gives the same rows.

Defined cases: a null or empty text is the end token alone; a null doc_id is kept as null; repeated rows are packed as often as
they come; an empty table gives no rows; a document of any length is cut; of pieces that are as good the first to come is taken; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import freed, kept_by, slices

#: Tokens, segments and loss-bearing tokens that a sequence holds.
LIMITS = (2048, 512, 2048)
#: The same for turns of conversations, of which half a sequence at most may bear loss.
TURN_LIMITS = (2048, 64, 1024)
#: Pieces among which a sequence chooses.
BLOCK = 2048
#: Texts over so many characters are tokenized in parts, cut where no token can cross.
PART = 1 << 20
#: Pieces of text whose ids a worker remembers, before it begins anew; texts that are tokenized together, and their characters; rows of an answer.
#: A worker holds all of this beside two tokenizers, and an executor has a worker for each core.
REMEMBERED = 300_000
TEXTS, CHARACTERS, ROWS = 2000, 1 << 20, 1000
END = 1


#: Characters that some engine takes for white space, and a few more that are not seen.
_BLANK = ((0x00, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_BLANKS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _BLANK)


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes; each distinct piece of a batch is tokenized once.

    No match of the byte-level pre-tokenizer goes from a visible character on to white space. So a text is cut into
    pieces before each blank or line feed that follows a visible character, and the pieces' ids joined are the text's.
    The pieces are told apart by Arrow's dictionary encoding. New ones are tokenized many in a row, and their ids cut
    where a token begins with a blank or line feed; those with other white space are tokenized one by one. A tokenizer of
    another kind gets whole texts.
    """

    #: Two of them in a row, of which the second would begin a piece, for RE2.
    double = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _BLANK) + "][ \n]"
    begin = re.compile(f"(?<=[^{_BLANKS}])(?=[ \n])")
    plain = re.compile(f"[ \n][^{_BLANKS}]+")
    letters = re.compile(" [A-Za-z]+")
    joint = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
    #: Stands before each piece; a text that holds it is a piece of its own.
    MARK = "\x1f"
    #: Pieces that are tokenized in a row.
    ROW = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.speller = Tokenizer.from_file(path), Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        kind = settings["pre_tokenizer"] or {}
        self.by_piece = settings["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"]
        # Words of ASCII letters need no cutting by the pre-tokenizer, only the byte-level sign of the blank.
        self.speller.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Adds the ids of new pieces to ``known``."""
        words, others, single = [], [], []
        for piece in pieces:
            (words if self.letters.fullmatch(piece) else others if self.plain.fullmatch(piece) else single).append(piece)
        for group, tokenizer, sign in ((words, self.speller, " \u0120"), (others, self.tokenizer, None)):
            rows = [group[at : at + self.ROW] for at in range(0, len(group), self.ROW)]
            joined = ["".join(row).replace(" ", sign)[1:] if sign else "".join(row) for row in rows]
            for row, encoded in zip(rows, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, "<u4")
                at = (4 * np.flatnonzero(self.begins[ids])).tolist()
                if len(at) == len(row):
                    raw = ids.tobytes()
                    self.known.update(zip(row, map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)])), strict=True))
                else:
                    single.extend(row)
        self.known.update(zip(single, self._encode(single), strict=True))

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.by_piece and len(text) - at > PART:
            m = self.joint.search(text, at + PART)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _pieces(self, texts: list[str]) -> pa.LargeListArray:
        if not self.by_piece:
            return pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), pa.array(texts, pa.large_string()))
        mark = self.MARK
        double = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.double).to_pylist()
        if any(mark in t for t in texts):
            cut = [[t] if mark in t else (self.begin.sub(mark, t).split(mark)) for t in texts]
            return pa.array(cut, pa.large_list(pa.large_string()))
        marked = [self.begin.sub(mark, t) if d else t.replace(" ", mark + " ").replace("\n", mark + "\n") for t, d in zip(texts, double, strict=True)]
        return pc.split_pattern(pa.array(marked, pa.large_string()), mark).cast(pa.large_list(pa.large_string()))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not texts:
            return []
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in self._parts(text):
                parts.append(part)
                owner.append(i)
        lists = self._pieces(parts)
        coded = lists.values.dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := [piece for piece in pieces if piece not in self.known]:
            self._learn(new)
        found = list(map(self.known.__getitem__, pieces))
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(sizes) - sizes
        count = sizes[codes]
        end = np.cumsum(count)
        out = ids[np.arange(count.sum()) + np.repeat(begin[codes] - (end - count), count)]
        # Where each part begins among the tokens, then each text.
        edges = np.concatenate(([0], end))[lists.offsets.to_numpy()]
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        at = edges[first].tolist()
        return [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


def ids_of(path: str) -> Ids:
    """The worker's tokenizer, kept between tasks."""
    kept = kept_by("packing")
    if path not in kept:
        kept[path] = Ids(path)
        freed()
    return kept[path]


class Packer:
    """Fills sequences one after another from a block of pieces; ``demand`` is in tokens, segments, loss-bearing tokens."""

    def __init__(self, limits: tuple[int, ...] = LIMITS, cut: bool = True, block: int = BLOCK):
        self.limits, self.cut, self.block = np.array(limits, np.int64), cut, block
        self.pieces: list[tuple] = []  # (what, start, length, loss)
        self.sequence = 0

    def add(self, what, start: int, length: int, loss: int) -> Iterator[tuple]:
        """(what, start, length, sequence, offset) of pieces that got their place."""
        if not self.cut and (length > self.limits[0] or loss > self.limits[2]):
            raise ValueError(f"an example of {length} tokens, {loss} of them loss-bearing, is over the limits {tuple(self.limits)}")
        self.pieces.append((what, start, length, loss))
        if len(self.pieces) >= self.block:
            yield from self.pack(self.block // 4)

    def pack(self, leave: int = 0) -> Iterator[tuple]:
        """Fills sequences while more than ``leave`` pieces wait."""
        pieces = self.pieces
        demand = np.array([[n, 1, loss] for _, _, n, loss in pieces], np.float64).reshape(-1, 3)
        shares = demand / self.limits
        open_ = np.ones(len(pieces), bool)
        waiting = len(pieces)
        while waiting and (waiting > leave or leave == 0):
            if leave == 0 and self.cut and demand[open_, 0].sum() < self.limits[0]:
                break
            left = self.limits.astype(np.float64)
            offset = 0
            while left[0] > 0 and left[1] > 0:
                fits = open_ & (demand <= left).all(1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, shares @ (left / self.limits), -1.0)))
                    what, start, n, loss = pieces[i]
                    open_[i] = False
                    waiting -= 1
                elif self.cut and waiting and left[2] > 0:
                    i = int(np.argmax(np.where(open_, demand[:, 0], -1.0)))
                    what, start, whole, whole_loss = pieces[i]
                    n = int(min(left[0], left[2], whole))
                    loss = min(whole_loss, n)
                    pieces[i] = (what, start + n, whole - n, whole_loss - loss)
                    demand[i] = [whole - n, 1, whole_loss - loss]
                    shares[i] = demand[i] / self.limits
                    if whole == n:
                        open_[i] = False
                        waiting -= 1
                else:
                    break
                yield what, start, n, self.sequence, offset
                offset += n
                left -= (n, 1, loss)
            self.sequence += 1
        self.pieces = [p for p, o in zip(pieces, open_, strict=True) if o]

    def finish(self) -> Iterator[tuple]:
        """Places all that waits; with ``cut``, the last tokens go to sequences of 1024, 512, ... tokens."""
        yield from self.pack()
        rest = self.pieces
        self.pieces = []
        total = sum(p[2] for p in rest)
        size = 1 << max(0, int(self.limits[0]).bit_length() - 1)
        at = 0
        while total:
            while size > total:
                size >>= 1
            offset = segments = 0
            while offset < size and segments < self.limits[1]:
                what, start, n, loss = rest[at]
                take = min(n, size - offset)
                yield what, start, take, self.sequence, offset
                offset, segments = offset + take, segments + 1
                if take == n:
                    at += 1
                else:
                    rest[at] = (what, start + take, n - take, max(0, loss - take))
            total -= offset
            self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, limits: tuple[int, int, int] = LIMITS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    ``tokenizer`` is the path of a tokenizer file that all executors can read.
    Of a piece, all tokens bear loss but the first, which nothing precedes in its segment.
    """
    size = limits[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = ids_of(tokenizer), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        last = np.array([end], "<u4").tobytes()
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [
                pa.array([r[0][0] for r in rows], pa.int64()),
                pa.array([r[0][3] + r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(r[0][1][4 * r[1] : 4 * (r[1] + r[2])]) for r in rows], pa.int64()),
                pa.array([r[0][2] for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array([r[2] - 1 for r in rows], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[0][1], "<u4")[r[1] : r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        def encoded(b: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            texts, size = [], 0
            doc_ids, column = b.column("doc_id").to_pylist(), b.column("text")
            for i in range(len(doc_ids)):
                texts.append(column[i].as_py() or "")
                size += len(texts[-1])
                if len(texts) >= TEXTS or size >= CHARACTERS or i + 1 == len(doc_ids):
                    for k, ids in enumerate(encode.batch(texts)):
                        yield doc_ids[i + 1 - len(texts) + k], ids + last
                    texts, size = [], 0

        for b in batches:
            for doc_id, ids in encoded(b):
                n = len(ids) // 4
                # A full sequence has one segment and as many tokens as the limit; the tail waits for others.
                full = n // size if limits[2] >= size - 1 else 0
                for k in range(full):
                    held.append(((doc_id, ids, n, 0), k * size, size, packer.sequence, 0))
                    packer.sequence += 1
                if n > full * size:
                    tail = (doc_id, ids[4 * full * size :], n, full * size)
                    held.extend(packer.add(tail, 0, n - full * size, n - full * size - 1))
                if len(held) >= ROWS:
                    yield made(held)
                    held = []
        held.extend(packer.finish())
        for at in range(0, len(held), ROWS):
            yield made(held[at : at + ROWS])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack_turns(turns: DataFrame, tokenizer: str, limits: tuple[int, int, int] = TURN_LIMITS, end: int = END) -> DataFrame:
    """One row for each piece of a turn of conversations (conv_id, turn, role, text), under limits that all bind: conv_id, turn, start, length, loss_tokens, sequence_id, offset.

    All tokens of an assistant's turn bear loss, its end token too; those of other roles none. A turn that fits no sequence is cut.
    A null text is the end token alone; null ids are kept; repeated rows are packed as often as they come; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = ids_of(tokenizer), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        names = ["conv_id", "turn", "start", "length", "loss_tokens", "sequence_id", "offset"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = ([r[0][0] for r in rows], [r[0][1] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[2] * r[0][2] for r in rows], [base + r[3] for r in rows], [r[4] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for part in (s for b in batches for s in slices(b)):
            rows: list[tuple] = []
            sizes = [len(ids) // 4 + 1 for ids in encode.batch([t or "" for t in part.column("text").to_pylist()])]
            for conv, turn, role, n in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role")), sizes, strict=True):
                bears = int(role == "assistant")
                rows.extend(packer.add((conv, turn, bears), 0, n, n * bears))
            if rows:
                yield made(rows)
        if rows := list(packer.finish()):
            yield made(rows)

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "conv_id long, turn long, start long, length long, loss_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Whole instruction examples (example_id, tokens, loss_tokens) to sequences: adds sequence_id and offset.

    A null count is 0; an example over the limits raises ``ValueError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False)
        base = TaskContext.get().partitionId() << 40

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

        for b in batches:
            rows: list[tuple] = []
            for i, n, loss in zip(*(b.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens")), strict=True):
                rows.extend(packer.add((i, loss or 0), 0, n or 0, loss or 0))
            if rows:
                yield made(rows)
        if rows := list(packer.finish()):
            yield made(rows)

    picked = examples.select(*(F.col(c).cast("long").alias(c) for c in ("example_id", "tokens", "loss_tokens")))
    return picked.mapInArrow(run, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")

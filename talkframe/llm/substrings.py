"""Repeated passages by recompression.

Words are named by hashes, and rounds rename what stands next to each other: a run of equal
symbols becomes one symbol, then a left symbol and the right symbol behind it become one, where a
bit of a symbol's name says whether it is left or right. A name is a hash of the names it was made
from, the same for all documents, so equal passages have equal symbols inside; only symbols whose making
looked beyond a passage's edge may differ. Every symbol carries the stretch of words that its
making looked at. A window that holds this whole stretch shows the same symbol wherever it occurs.

Names are counted by Spark over all documents, one Spark round for each height of symbols: a window
that holds the stretch of a symbol found only once cannot occur twice and is given up. Higher
symbols are made only of documents that still have windows. The windows left after the last height
are named by 96 bits over their words and counted in the same way; those found twice are repeats, and the
words they cover go.

Documents travel in blocks of bounded text. In a round every block sends each name once to the
part that counts it, however often it holds it, and gets back one bit for each; a name that a third
of all documents share is a third of the blocks' messages, not of the positions.

Cases: a null or empty text has no words; a text shorter than a window loses nothing; rows are
judged one by one, so rows that share an id or are repeated each count as occurrences and each have a result row; an
empty table gives an empty result; other input columns are not looked at. One document's words are
held in memory by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.session import cut, runs_in_tasks, widen

runs_in_tasks(__name__)

WINDOW = 35
#: Heights at which names are counted: rounds of renaming, and the words a symbol may reach.
HEIGHTS = ((4, 8),)
#: Bytes of text in a block, beyond which a new one begins; a longer document is a block of its own.
BLOCK_BYTES = 2_000_000
#: Bytes of text that one task works on, about, beyond the session's number of tasks.
TASK_BYTES = 64 << 20
#: Names that one part of a count receives, about: at least, so long as all cores have work, and at most.
PART_NAMES = (50_000, 2_000_000)

FAR = np.int64(1) << 40
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """The name of what is made of two names, or of a name and a count."""
    return mixed(mixed(a + np.uint64(kind)) * np.uint64(MULTIPLIERS[0]) + b)


class Symbols:
    """Symbols of several documents in order: name, words ``lo`` to ``hi``, and the words ``from_`` to ``to`` their making looked at.

    Words are numbered through all documents of a block; a making that looked at a document's edge reaches far away.
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        at = np.arange(len(names), dtype=np.int64)
        self.names, self.doc, self.lo, self.hi, self.from_, self.to = names, doc, at, at, at, at

    def _around(self) -> tuple[np.ndarray, np.ndarray]:
        """From where the symbol before was made, and to where the one behind."""
        same = self.doc[1:] == self.doc[:-1]
        return np.r_[-FAR, np.where(same, self.from_[:-1], -FAR)], np.r_[np.where(same, self.to[1:], FAR), FAR]

    def _merge(self, first: np.ndarray, names: np.ndarray, from_: np.ndarray, to: np.ndarray) -> None:
        """Symbols that begin at ``first`` (flags) run up to the next one; ``from_`` and ``to`` are given for all old symbols."""
        at = np.flatnonzero(first)
        self.names, self.doc, self.lo, self.hi = names, self.doc[at], self.lo[at], self.hi[np.r_[at[1:], len(first)] - 1]
        self.from_, self.to = np.minimum.reduceat(from_, at), np.maximum.reduceat(to, at)

    def runs(self, most: int) -> None:
        """Runs of equal symbols of at most ``most`` words become one. A run's ends are seen at the symbols around it."""
        if not len(self.names):
            return
        new = np.r_[True, (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1])]
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(new)])
        words = self.hi[at + count - 1] - self.lo[at] + 1
        short = (words <= most) | (count == 1)
        # symbols of a run that is too long stay apart, and count as if their making had looked far away
        first = new | np.repeat(~short, count)
        before, behind = self._around()
        run = np.repeat(np.arange(len(at)), count)
        long = ~short[run]
        from_, to = np.where(long, -FAR, np.minimum(self.from_, before)), np.where(long, FAR, np.maximum(self.to, behind))
        k = np.where(short & (count > 1), count, 1)[run][first].astype(np.uint64)
        names = self.names[first]
        self._merge(first, np.where(k > 1, joined(names, k, 1), names), from_, to)

    def pairs(self, most: int, round_: int) -> None:
        """A left symbol and the right one behind it become one, if they have at most ``most`` words."""
        n = len(self.names)
        if not n:
            return
        right = (mixed(self.names + np.uint64(round_ * 0x632BE59B + 7)) >> np.uint64(63)).astype(bool)
        pair = np.r_[~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]) & (self.hi[1:] - self.lo[:-1] < most), False]
        second = np.r_[False, pair[:-1]]
        before, behind = self._around()
        # a left symbol looks at the one behind it, a right one at the one before it
        from_ = np.where(right, np.minimum(self.from_, before), self.from_)
        to = np.where(right, self.to, np.maximum(self.to, behind))
        behind_name = np.r_[self.names[1:], np.uint64(0)]
        names = np.where(pair, joined(self.names, behind_name, 2), self.names)
        self._merge(~second, names[~second], from_, to)

    def climb(self, begin: int, end: int, most: int) -> Symbols:
        for k in range(begin, end):
            self.runs(most)
            self.pairs(most, k)
        return self


class Block:
    """The documents of one block as words and their names."""

    def __init__(self, row: dict):
        data, at, self.texts = zstandard.decompress(row["data"], max_output_size=max(1, sum(row["sizes"]))), 0, []
        for size in row["sizes"]:
            self.texts.append(data[at : at + size].split())  # bytes.split() cuts at space and 0x09 to 0x0D
            at += size
        sizes = [len(t) for t in self.texts]
        known: dict[bytes, int] = {}
        index = np.array([known.setdefault(w, len(known)) for t in self.texts for w in t], np.int64)
        halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in known), ">u8").astype(np.uint64).reshape(-1, 2)
        self.a, self.b = halves[index, 0], halves[index, 1]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.ends = np.cumsum(sizes, dtype=np.int64)

    def windows(self, window: int) -> np.ndarray:
        """Flags of the words from which a whole window runs inside one document."""
        n = len(self.doc)
        flags = np.zeros(n, bool)
        if n >= window:
            flags[: n - window + 1] = self.doc[: n - window + 1] == self.doc[window - 1 :]
        return flags

    def window_names(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the words of each window, in their order: two sums over powers of two odd numbers."""

        def rolled(h: np.ndarray, multiplier: int) -> np.ndarray:
            inverse = np.uint64(pow(multiplier, -1, 1 << 64))
            up = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(h) - 1), np.uint64(multiplier))])[: len(h)]
            down = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(h) - 1), inverse)])[: len(h)]
            sums = np.r_[np.uint64(0), np.cumsum(h * up)]
            return mixed((sums[starts + window] - sums[starts]) * down[starts])

        return rolled(self.a, MULTIPLIERS[0]), (rolled(self.b, MULTIPLIERS[1]) >> np.uint64(32)).astype(np.uint32)


class Sent:
    """The distinct names of a block in order, as it sends them to the parts and gets them back."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None):
        b = np.zeros(len(a), np.uint32) if b is None else b
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        at = np.flatnonzero(new)
        self.a, self.b, self.twice = a[order][at], b[order][at], np.diff(np.r_[at, len(a)]) > 1
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.cumsum(new) - 1

    def cuts(self, parts: int) -> np.ndarray:
        part = ((self.a >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def messages(self, block: int, parts: int, wide: bool) -> Iterator[dict]:
        cuts = self.cuts(parts).tolist()
        for part, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if e > s:
                yield {"part": part, "block": block, "a": self.a[s:e].tobytes(), "b": self.b[s:e].tobytes() if wide else b"", "bits": np.packbits(self.twice[s:e]).tobytes()}

    def answered(self, replies: list[dict], parts: int) -> np.ndarray:
        """For every name that was given, whether it occurs twice."""
        cuts = self.cuts(parts)
        flags = np.zeros(len(self.a), bool)
        for r in replies:
            s, e = cuts[r["part"]], cuts[r["part"] + 1]
            flags[s:e] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=e - s).astype(bool)
        return flags[self.place]


MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("bits", pa.binary())])
MESSAGE_SQL = "part int, block bigint, a binary, b binary, bits binary"
REPLY = "block bigint, part int, bits binary"


def in_blocks(most: int) -> Callable:
    """Task function: documents packed into blocks, in the order they come."""

    def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        data = zstandard.compress(b"".join(texts), 3)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["ids", "sizes", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1]) + 1
                if size >= most:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return run


def blocks_of(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, sizes, data): documents in blocks of about ``most`` bytes of text, compressed."""
    rows = widen(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")))
    packed = rows.mapInArrow(in_blocks(most), "ids array<bigint>, sizes array<int>, data binary")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def count(messages: pd.DataFrame) -> pd.DataFrame:
    """One part of a count: which of each block's names occur twice, in any blocks. A block's note to itself is handed back."""
    notes, messages = messages[messages["part"] < 0], messages[messages["part"] >= 0].reset_index(drop=True)
    replies = notes[["block", "part", "bits"]]
    if len(messages):
        each = [len(x) // 8 for x in messages["a"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(messages["bits"], each)])
        a = np.frombuffer(b"".join(messages["a"]), np.uint64)
        wide = b"".join(messages["b"])
        order = np.lexsort((np.frombuffer(wide, np.uint32), a)) if wide else np.argsort(a, kind="stable")
        new = np.ones(len(a), bool)
        new[1:] = a[order][1:] != a[order][:-1]
        if wide:
            b = np.frombuffer(wide, np.uint32)[order]
            new[1:] |= b[1:] != b[:-1]
        at = np.flatnonzero(new)
        found = np.add.reduceat(twice[order].astype(np.int64) + 1, at) > 1
        shared = np.empty(len(a), bool)
        shared[order] = np.repeat(found, np.diff(np.r_[at, len(a)]))
        ends = np.cumsum(each)
        bits = [np.packbits(shared[e - n : e]).tobytes() for e, n in zip(ends, each)]
        replies = pd.concat([replies, messages[["block", "part"]].assign(bits=bits)])
    return replies


def counted(messages: DataFrame, tasks: int) -> DataFrame:
    """(block, replies) of the blocks that sent messages or have a note."""
    told = messages.groupBy("part").applyInPandas(count, REPLY)
    return told.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))


def answers(row: dict) -> tuple[list[dict], list[dict]]:
    """Replies to a block's names, and its notes to itself."""
    replies = row.get("replies") or []
    return [r for r in replies if r["part"] >= 0], [r for r in replies if r["part"] < 0]


def noted(block: int, flags: np.ndarray, parts: int) -> dict:
    """A block's flags as a note; it goes to one of the parts' neighbours, so that notes are spread as well."""
    return {"part": -1 - block % parts, "block": block, "a": b"", "b": b"", "bits": zstandard.compress(np.packbits(flags).tobytes())}


def open_windows(block: Block, notes: list[dict], window: int) -> np.ndarray:
    """The windows that are not given up: all, before the first note."""
    flags = block.windows(window)
    for note in notes:
        packed = zstandard.decompress(note["bits"], max_output_size=len(flags) // 8 + 1)
        flags &= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(flags)).astype(bool)
    return flags


def symbols_of(block: Block, flags: np.ndarray, heights: tuple) -> Symbols:
    """Symbols after the rounds of the last of the heights, of the documents that still have windows."""
    some = np.zeros(len(block.texts), bool)
    some[block.doc[flags]] = True
    keep = some[block.doc]
    made = Symbols(block.a[keep], block.doc[keep])
    at = np.flatnonzero(keep)
    made.lo = made.hi = made.from_ = made.to = at
    done = 0
    for rounds, most in heights:
        made.climb(done, rounds, most)
        done = rounds
    return made


def given_up(flags: np.ndarray, made: Symbols, shared: np.ndarray, window: int) -> np.ndarray:
    """``flags`` without the windows that hold all that the making of a symbol found only once looked at."""
    once = ~shared & (made.to - made.from_ < window)
    edges = np.zeros(len(flags) + 1, np.int64)
    np.add.at(edges, np.maximum(made.to[once] - window + 1, 0), 1)
    np.add.at(edges, made.from_[once] + 1, -1)
    return flags & (np.cumsum(edges)[: len(flags)] == 0)


def step(heights: tuple, at: int, parts: tuple[int, ...], window: int) -> Callable:
    """Task function of round ``at``: takes the answers to the round before, sends the names of its own height, or of windows after the last height."""

    def tell(row: dict) -> Iterator[dict]:
        block = Block(row)
        replies, notes = answers(row)
        flags = open_windows(block, notes, window)
        if at:
            made = symbols_of(block, flags, heights[:at])
            flags = given_up(flags, made, Sent(made.names).answered(replies, parts[at - 1]), window)
        if not flags.any():
            return
        if at < len(heights):
            yield from Sent(symbols_of(block, flags, heights[: at + 1]).names).messages(row["block"], parts[at], False)
        else:
            yield from Sent(*block.window_names(np.flatnonzero(flags), window)).messages(row["block"], parts[at], True)
        yield noted(row["block"], flags, parts[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in batch.slice(i, 1).to_pylist():
                    made = list(tell(row))
                    if made:
                        yield pa.RecordBatch.from_pylist(made, MESSAGE)

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def shorten(parts: int, window: int) -> Callable:
    """Task function: the documents without the words of windows that occur twice."""

    def texts(row: dict) -> Iterator[dict]:
        block = Block(row)
        replies, notes = answers(row)
        gone = np.zeros(len(block.doc), bool)
        if replies:
            starts = np.flatnonzero(open_windows(block, notes, window))
            starts = starts[Sent(*block.window_names(starts, window)).answered(replies, parts)]
            edges = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
            gone = np.cumsum(edges)[:-1] > 0
        for doc_id, words, end in zip(row["ids"], block.texts, block.ends):
            lost = gone[end - len(words) : end]
            left = [w for w, x in zip(words, lost) if not x] if lost.any() else words
            yield {"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept": b" ".join(left)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in batch.slice(i, 1).to_pylist():
                    yield pa.RecordBatch.from_pylist(list(texts(row)), KEPT)

    return run


def part_numbers(blocks: DataFrame, heights: tuple) -> tuple[int, tuple[int, ...]]:
    """From the size of all texts: tasks for work on blocks, and parts for the count after each height and for that of the windows."""
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, x: t + x))).first()[0] or 0
    enough = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, most = PART_NAMES
    words = total // 6
    names = [words // max(1, rounds) for rounds, _ in heights] + [words]
    return max(enough, total // TASK_BYTES), tuple(max(1, n // most, min(n // least, enough)) for n in names)


def without_repeats(docs: DataFrame, window: int = WINDOW, heights: tuple = HEIGHTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the words of repeated windows, joined by one space."""
    blocks = blocks_of(docs, block_bytes)
    tasks, parts = part_numbers(blocks, heights)
    rows = blocks
    for at in range(len(parts)):
        told = counted(rows.mapInArrow(step(heights, at, parts, window), MESSAGE_SQL), tasks)
        rows = blocks.repartition(tasks, "block").join(told, "block", "left")
    done = rows.mapInArrow(shorten(parts[-1], window), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))

"""Packing token streams into fixed windows, online and in bounded space.

Every partition keeps a fixed number of open windows. A document first gives off whole windows; its
rest goes best-fit into the open window with the least room that still holds it. When none holds it,
the fullest window is emitted: as it stands if its room is a few tokens, else topped up with the
rest's first ids. Windows still open at the end of a partition are taken apart and packed again, many
partitions to a task, until one task remains, which cuts freely and pads one sequence only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean, worker long"
#: Separates words that are tokenized together.
MARK = "\x01"
#: ASCII characters that a tokenizer may cut off the end of a word as a token of its own; no apostrophe.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts that a tokenizer must read word by word as it reads them whole.
PROBES = ["a b", "A\tb\nC\x0bd\x0ce\rf", "don't, can't. it's, 'tis", "x,%%% y.*** (z) \"q\"", "caf\u00e9, caf\u00e9 e\u0301. a\u0308,b", "1,234.5 a1. b-c-", "\u6587\u5b57. \u0130x \U0001f600!", "</s>. <|endoftext|> [INST],", "...a ,,, a...b, a\u0338= =\u0338"]


def ends_in_letter(word: bytes) -> bool:
    """Whether a word's last character is a letter of an old script, or an ASCII digit."""
    if word[-1:].isalnum():
        return True
    last = word[-3:].decode("utf-8", "ignore")[-1:]
    return last.isalpha() and last < "\u2000"


class WordTokenizer:
    """Token ids of whole texts, put together from remembered words.

    A word is remembered in lower case, and punctuation after its last letter apart from the rest of it. That is sound for
    tokenizers that drop ASCII white space, with no token across it, lower-case ASCII letters and cut between
    letter and punctuation. So a tokenizer is tried first, on PROBES and on the first texts; one that reads any of
    these otherwise encodes whole texts.
    """

    def __init__(self, path: str, remembered: int = 600_000, tried: int = 8):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.remembered, self.known, self.older = remembered, {b"": b""}, {}
        self.mark, self.tried, self.by_word = self.encode(MARK), 0, True
        self.by_word = all(np.array_equal(x, self.encode(t)) for t, x in zip(PROBES, self([t.encode() for t in PROBES]), strict=True))
        self.tried = tried

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            plain = [w for w in some if MARK.encode() not in w] if len(self.mark) == 1 else []
            ids = self.encode(f" {MARK} ".join(w.decode() for w in plain))
            cut = np.flatnonzero(ids == self.mark[0]) if plain else []
            if plain and len(cut) == len(plain) - 1:
                data = ids.tobytes()
                starts, ends = [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(data)]
                for w, a, b in zip(plain, starts, ends, strict=True):
                    self.known[w] = data[a:b]
            for w in some:
                if w not in self.known:
                    self.known[w] = self.encode(w.decode()).tobytes()

    def _need(self, words: set[bytes]) -> None:
        """Make all words known: from the older half of the memory, from their parts, or from the tokenizer."""
        new, parted, known, older = [], [], self.known, self.older
        for w in words:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
                continue
            core = w.rstrip(TAIL)
            if len(core) < len(w) and ends_in_letter(core):
                parted.append((w, core, w[len(core) :]))
            else:
                new.append(w)
        for p in {p for _, *both in parted for p in both}:
            if p in older and p not in known:
                known[p] = older[p]
            elif p not in known:
                new.append(p)
        self._learn(list(dict.fromkeys(new)))
        for w, core, tail in parted:
            known[w] = known[core] + known[tail]

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 64):
            some = [t or b"" for t in texts[i : i + 64]]
            if self.by_word:
                split = [t.lower().split() for t in some]
                if len(self.known) > self.remembered:
                    self.known, self.older = {b"": b""}, self.known
                known = self.known
                self._need({w for words in split for w in words if w not in known})
            for j, text in enumerate(some):
                if not self.by_word:
                    yield self.encode(text.decode())
                    continue
                found = np.frombuffer(b"".join([known[w] for w in split[j]]), "<u4")
                if self.tried > 0 and len(text) < 1 << 16:
                    self.tried -= 1
                    whole = self.encode(text.decode())
                    self.by_word = np.array_equal(found, whole)
                    found = whole
                yield found


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """The open windows of one partition."""

    def __init__(self, width: int, windows: int, max_pad: int, base: int, keep_ids: bool = False):
        self.width, self.windows, self.max_pad, self.next_id = width, windows, max_pad, base
        self.open: list[list] = []  # [room, pieces]
        self.done: list[tuple] = []
        self.keep_ids = keep_ids

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.next_id, at, ids.tobytes() if self.keep_ids else None, False))
            at += len(ids)
        self.next_id += 1

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.width:
            self.emit([(doc_id, start, ids[: self.width], total)])
            start, ids = start + self.width, ids[self.width :]
        while len(ids):
            fitting = [w for w in self.open if w[0] >= len(ids)]
            if fitting:
                best = min(fitting, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [self.width, []])
            else:
                best = min(self.open, key=lambda w: w[0])
                if best[0] <= self.max_pad:
                    self.open.remove(best)
                    self.emit(best[1])
                    continue
            piece, rest = ids[: best[0]], ids[best[0] :]
            best[1].append((doc_id, start, piece, total))
            best[0] -= len(piece)
            start, ids = start + len(piece), rest
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1])

    def leftovers(self) -> list[tuple]:
        rows = [(d, s, len(ids), 0, total, 0, 0, ids.tobytes(), True) for _, pieces in self.open for d, s, ids, total in pieces]
        self.open = []
        return rows

    def finish(self) -> None:
        """Join what is open, largest pieces first, cutting at window ends: one sequence is padded."""
        rest = sorted((p for _, pieces in self.open for p in pieces), key=lambda p: -len(p[2]))
        self.open, room, pieces = [], self.width, []
        for doc_id, start, ids, total in rest:
            while len(ids):
                part = ids[:room]
                pieces.append((doc_id, start, part, total))
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                if not room:
                    self.emit(pieces)
                    room, pieces = self.width, []
        if pieces:
            self.emit(pieces)


def _batch(rows: list[tuple], worker: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [worker] * len(rows)], schema.types, strict=True)], schema=schema)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    width: int = 2048,
    end_id: int = 1,
    windows: int = 16,
    max_pad: int = 16,
    fan_in: int = 32,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of every row's token ids (null text: none, then ``end_id``), packed into sequences.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids when
    ``keep_ids``. Every id lies in exactly one piece; repeated rows are packed as often as they occur;
    a null doc_id stays null. An empty table gives no rows. Sequences other than the last are filled to
    within ``max_pad`` tokens. The order of rows inside a partition is the order they are placed in.
    """
    prepare(df.sparkSession)
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in PIECES.split(", "))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        encode, packer, end = tokenizer(tokenizer_path), Packer(width, windows, max_pad, worker << 28, keep_ids), np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encode(batch.column(1).to_pylist()), strict=True):
                packer.place(doc_id, 0, np.concatenate([ids, end]), len(ids) + 1)
            yield _batch(packer.done, worker, schema)
            packer.done = []
        yield _batch(packer.leftovers(), worker, schema)

    def again(step: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            worker = TaskContext.get().partitionId()
            packer = Packer(width, windows, max_pad, (step << 56) | (worker << 28), keep_ids)
            for batch in batches:
                for row in batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                    packer.place(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
                yield _batch(packer.done, worker, schema)
                packer.done = []
            if last:
                packer.finish()
                yield _batch(packer.done, worker, schema)
            else:
                yield _batch(packer.leftovers(), worker, schema)

        return merge

    text = F.col("text").cast("string").cast("binary")
    packed = df.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(first, PIECES).checkpoint()
    done, parts, step = [packed.where("not open")], packed.rdd.getNumPartitions(), 0
    while True:
        parts, step = max(1, -(-parts // fan_in)), step + 1
        group = (F.col("worker") / fan_in).cast("long")
        left = packed.where("open").withColumn("worker", group)
        left = left.repartitionByRange(parts, "worker") if parts > 1 else left.coalesce(1)
        left = left.sortWithinPartitions("worker", F.desc("length"), "doc_id", "start", "ids")
        packed = left.mapInArrow(again(step, parts == 1), PIECES).checkpoint()
        done.append(packed.where("not open"))
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("open", "worker", *([] if keep_ids else ["ids"]))


def op9_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))

"""Best-fit packing of documents into sequences by bin completion.

1. One scan tokenises each text, appends the end id and cuts only documents longer than a sequence into pieces.  The
   pieces, with their ids, are written once to the shared folder.
2. Pieces are counted by length: at most ``capacity`` rows, whatever the corpus.  ``completion.pack`` solves that
   histogram and gives patterns, each with how often it is used.
3. Each piece gets its rank among pieces of its length, by salted counting, so that a length that a third of all pieces
   share is never sorted in one task.  The rank says which copy of which pattern the piece goes to.

Edge cases: a null or empty text is one piece that holds the end id only.  Rows that repeat a ``doc_id`` are packed as
documents of their own.  An empty table packs into nothing.  Other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconry.llm.common import stored
from beaconry.llm.completion import pack

CAPACITY, END_ID, TOKENIZER, SALTS = 4096, 1, "word_bpe_49k.json", 64
CACHED_WORDS, CACHED_LETTERS, ENCODED_TOGETHER, SLICE_BYTES = 200_000, 48, 2_000, 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of each blank-separated chunk as little-endian 32-bit words; the tokenizer never joins across blanks.

    Chunks not seen before are encoded together, which costs a fraction of encoding them one by one.  Two generations
    of ``CACHED_WORDS`` chunks each bound the memory: a chunk that is met again moves to the young one, and when that
    is full, it becomes the old one and the old one goes.  Longer chunks are encoded anew each time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own cost time and memory
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(chunks), ENCODED_TOGETHER):
            some = chunks[at : at + ENCODED_TOGETHER]
            for chunk, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                yield chunk, np.array(coded.ids, "<u4").tobytes()

    def of_texts(self, texts: list[str]) -> list[bytes]:
        parts = [text.replace("\n", " ").split(" ") for text in texts]
        known, new = {}, []
        for chunk in set().union(*parts):
            ids = self.young.get(chunk)
            if ids is None and (ids := self.old.get(chunk)) is not None:
                self.young[chunk] = ids
            if ids is None:
                new.append(chunk)
            else:
                known[chunk] = ids
        for chunk, ids in self._encoded(new):
            known[chunk] = ids
            if len(chunk) <= CACHED_LETTERS:
                self.young[chunk] = ids
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        return [b"".join(map(known.__getitem__, words)) for words in parts]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, token_ids``: ids are little-endian unsigned 32-bit numbers."""
    names = ["doc_id", "piece", "start", "length", "token_ids"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(rows) -> Iterator[tuple]:
        for doc_id, ids in rows:
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, piece, at // 4, len(part) // 4, part

    def coded(batch, words: WordIds) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            texts = words.of_texts([t or "" for t in part.column("text").to_pylist()])
            yield from ((i, ids + end) for i, ids in zip(part.column("doc_id").to_pylist(), texts))

    def run(batches):
        words = WordIds(path)
        for batch in batches:
            held, size = [], 0
            for row in cut(coded(batch, words)):
                held.append(row)
                size += len(row[-1])
                if size >= SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, piece int, start long, length long, token_ids binary"))


class Placer:
    """Which sequence and offset the piece of a given length and rank gets."""

    def __init__(self, counts: dict[int, int], capacity: int):
        starts: dict[int, list] = {s: [] for s in counts}
        taken: Counter = Counter()
        base = 0
        for bin_, times in pack(counts, capacity):
            offset, slots = 0, {}
            for size in bin_:
                slots.setdefault(size, []).append(offset)
                offset += size
            for size, offsets in slots.items():
                starts[size].append((taken[size], base, offsets))
                taken[size] += len(offsets) * times
            base += times
        self.by_size = {s: (np.array([e[0] for e in rows]), rows) for s, rows in starts.items()}
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k, (size, r) in enumerate(zip(length.tolist(), rank.tolist())):
            begins, rows = self.by_size[size]
            first, base, offsets = rows[int(np.searchsorted(begins, r, side="right")) - 1]
            sequence[k] = base + (r - first) // len(offsets)
            offset[k] = offsets[(r - first) % len(offsets)]
        return sequence, offset


def assign(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with a ``length`` from 1 to ``capacity`` and a unique long ``item``.

    Other columns are kept.  Rows that fill a sequence alone get negative sequence ids of their own.
    """
    items = items.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    whole, part = items.filter(F.col("length") == capacity), items.filter(F.col("length") < capacity)
    sizes = part.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placer = items.sparkSession.sparkContext.broadcast(Placer(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "salt").orderBy("item")
    ranked = (part.withColumn("rank", F.row_number().over(inner) - 1).join(before, ["length", "salt"])
              .withColumn("rank", F.col("rank") + F.col("before")).drop("before"))

    def run(batches):
        for batch in batches:
            found = placer.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, "sequence_id", "offset"])

    both = ranked.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    placed = ranked.mapInArrow(run, both.schema).drop("rank", "salt")
    alone = whole.drop("salt").withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """The stored pieces with their ids, and the placement of each piece, both by ``item``."""
    found = pieces(docs, path or tokenizer_path(), capacity, end_id).withColumn("item", F.monotonically_increasing_id())
    found = stored(found, "pieces")
    narrow = found.select("item", "doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return found, assign(narrow, capacity)


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, token_ids, doc_starts``: the packed sequences themselves; a group holds one sequence at most."""
    rows = placed.select("item", "sequence_id", "offset").join(found.select("item", "token_ids"), "item")
    parts = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["token_ids"])).alias("token_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("doc_starts"))

"""Byte pair encoding and decoding with a lexicon of frequent words.

1. One scan counts blank-separated words: each task keeps a mergeable summary of bounded size (counts that outgrow it are
   lowered together, so a word is at most ``words seen / SUMMARY`` short), a combining aggregate adds them up.
2. The most frequent, at most ``LEXICON_WORDS`` in whole classes of like counts, become a minimal acyclic transducer: words that end alike share states.  Arcs carry
   how many words come before, so their sum along a path numbers the word, and the number leads to its token ids.
   The transducer is one flat file in the shared folder; Spark hands it to each executor, whose tasks map it into memory.
3. A second scan walks all distinct words of a slice through the transducer at once, a byte at a time.  Unseen words are
   normalised, cut and merged exactly: in each round every word merges the pair of lowest rank, all words together.

The lexicon decides only how fast a word is encoded: its ids come from the same exact merges.  Special tokens are found
in the raw text first, as the tokenizers library does; letters that Python's tables and the library's may see differently go
through the library's own normalizer and splitter.

Edge cases: a null or empty text has no ids and decodes to the empty text.  Rows that repeat an id are encoded each for
itself.  An empty table gives an empty one; other columns are kept by ``encode`` and ``decode``.
"""

from __future__ import annotations

import json
import mmap
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconry.llm.common import shared_folder, stored

TOKENIZER, LEXICON_WORDS, SUMMARY = "word_bpe_49k.json", 100_000, 200_000
SLICE_CHARS, CACHED_WORDS = 2_000_000, 150_000

#: Code points on whose class and case Python and the library agree: up to Cyrillic, punctuation, ideographs, Hangul.
_KNOWN = regex.compile(r"[\u0000-՗ -⁯　-鿿가-힣]*")
_BLANK = regex.compile(r"\p{White_Space}+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Exact ids of words by the merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.tokens = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in data["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.letters = {ord(c): b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.width = max(self.tokens) + 1
        keys = np.array([a * self.width + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.result = keys[order], order.astype(np.int64), np.array([c for _, _, c in pairs], np.int64)
        self.library = Tokenizer.from_file(path)

    def pieces(self, word: str) -> list[bytes]:
        """The bytes of each piece that is merged for itself."""
        if _KNOWN.fullmatch(word):
            if not word.isascii():
                word = unicodedata.normalize("NFC", word)
            # A final sigma is a matter of context only to Python.
            return [p.encode() for p in self.cut.findall(_BLANK.sub(" ", word).replace("Σ", "σ").lower())]
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return [bytes(self.letters[ord(c)] for c in p) for p, _ in cut]

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; a word may hold anything, blanks too."""
        found: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for word in words:
            own, at = [], 0
            for mark in self.marks.finditer(word) if self.marks and "<" in word else ():
                own += [found.setdefault(p, len(found)) for p in self.pieces(word[at : mark.start()])]
                own.append(-1 - self.special[mark.group()])
                at = mark.end()
            own += [found.setdefault(p, len(found)) for p in self.pieces(word[at:] if at else word)]
            parts.append(own)
        ids, ends = self.merged(list(found))
        cuts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        marks = {-1 - i: np.array([i], np.int64) for i in self.special.values()}
        none = np.empty(0, np.int64)
        return [cuts[own[0]] if len(own) == 1 and own[0] >= 0 else np.concatenate([cuts[k] if k >= 0 else marks[k] for k in own]) if own else none for own in parts]

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece begins.

        Every token comes from one merge only, so a new pair always ranks behind the merge that made it, and all places of
        the lowest pair of a piece may be merged in one round, from left to right.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[raw]
        stops = np.cumsum(lengths)
        ids[stops - 1] = self.final[raw[stops - 1]]
        done_ids, done_piece = [], []
        piece = np.repeat(np.arange(len(pieces)), lengths)
        none = len(self.keys)
        while len(ids):
            rank = np.full(len(ids), none, np.int64)
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & (piece[:-1] == piece[1:])
            rank[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            span = np.diff(np.concatenate((starts, [len(ids)])))
            least = np.repeat(np.minimum.reduceat(rank, starts), span)
            over = least == none
            if over.any():
                done_ids.append(ids[over])
                done_piece.append(piece[over])
                ids, piece, rank, least = ids[~over], piece[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            first = rank == least
            if (first[1:] & first[:-1]).any():  # a run of one letter: every other place, from its left end
                where = np.arange(len(first))
                begin = np.maximum.accumulate(np.where(first & ~np.concatenate(([False], first[:-1])), where, -1))
                first &= (where - begin) % 2 == 0
            ids[first] = self.result[rank[first]]
            keep = ~np.concatenate(([False], first[:-1]))
            ids, piece = ids[keep], piece[keep]
        owners = np.concatenate(done_piece) if done_piece else np.empty(0, np.int64)
        order = np.argsort(owners, kind="stable")
        out = np.concatenate(done_ids)[order] if done_ids else np.empty(0, np.int64)
        return out, np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(pieces))))).astype(np.int64)


class Transducer:
    """A minimal acyclic automaton over bytes whose arcs add up to the number of a word among all words in order.

    One flat array of 32-bit numbers: a header, the first arc of each state, whether it ends a word, then label, target and
    words skipped of each arc, then where the ids of each word begin, then all ids.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<i4", 4)
        sizes = [int(head[0]) + 1, int(head[0]), int(head[1]), int(head[1]), int(head[1]), int(head[2]) + 1, int(head[3])]
        places = np.cumsum([4, *sizes]) * 4
        self.first, self.ends, self.label, self.target, self.skipped, self.begin, self.ids = (
            np.frombuffer(buffer, "<i4", n, p) for n, p in zip(sizes, places.tolist()))
        # Arcs lie by state and label, so their keys are in order already.
        self.keys = np.repeat(np.arange(sizes[1], dtype=np.int64), np.diff(self.first)) << 8 | self.label

    @classmethod
    def opened(cls, path: str) -> "Transducer":
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not in the lexicon; all words take a step at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1, np.int64)
        alive = np.arange(len(words))
        state, total, depth = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(alive):
            over = lengths[alive] == depth
            if over.any():
                ended = alive[over]
                out[ended] = np.where(self.ends[state[over]] == 1, total[over], -1)
                alive, state, total = alive[~over], state[~over], total[~over]
            if not len(alive) or not len(self.keys):
                break
            key = state << 8 | raw[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state, total = self.target[at].astype(np.int64), total[hit] + self.skipped[at]
            depth += 1
        return out


def compiled(words: dict[bytes, np.ndarray]) -> bytes:
    """The flat transducer of words and their ids, built in order: a state is merged with an equal one once no later word can change it."""
    known: dict[tuple, int] = {}  # (ends a word, arcs) to its number
    states: list[tuple] = []
    path: list[list] = [[False, []]]  # open states along the last word

    def closed(upto: int) -> None:
        while len(path) > upto:
            ends, arcs = path.pop()
            shape = (ends, tuple(arcs))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            path[-1][1][-1] = (path[-1][1][-1][0], known[shape])

    before = b""
    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(before), len(word)) and before[shared] == word[shared]:
            shared += 1
        closed(shared + 1)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        before = word
    closed(1)
    root = (path[0][0], tuple(path[0][1]))
    # The root comes first; targets were numbered before the states that point to them.
    states = [root, *states]
    held = [0] * len(states)
    for k in [*range(1, len(states)), 0]:
        held[k] = int(states[k][0]) + sum(held[t + 1] for _, t in states[k][1])
    label, target, skipped, first = [], [], [], [0]
    for ends, arcs in states:
        passed = int(ends)
        for byte, to in arcs:
            label.append(byte)
            target.append(to + 1)
            skipped.append(passed)
            passed += held[to + 1]
        first.append(len(label))
    begin = np.concatenate(([0], np.cumsum([len(words[w]) for w in ordered])))
    ids = np.concatenate([words[w] for w in ordered]) if ordered else np.empty(0, np.int64)
    parts = [[len(states), len(label), len(ordered), len(ids)], first, [int(e) for e, _ in states], label, target, skipped, begin, ids]
    return b"".join(np.asarray(p, "<i4").tobytes() for p in parts)


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def _sliced(texts: pa.Array):
    """Runs of rows of some ``SLICE_CHARS`` characters: where each begins and its texts."""
    held, size, begin = [], 0, 0
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield begin, held
            held, size, begin = [], 0, k + 1
    if held:
        yield begin, held


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, summary: int = SUMMARY) -> list[str]:
    """The most frequent blank-separated words of all texts, by mergeable summaries of at most ``summary`` words a task."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in _sliced(batch.column("text")):
                for text in texts:
                    counts.update(_split(text))
                if len(counts) > 2 * summary:
                    floor = sorted(counts.values(), reverse=True)[summary]
                    counts = Counter({w: n - floor for w, n in counts.items() if n > floor})
        best = counts.most_common(summary)
        for at in range(0, len(best), 10_000):
            part = best[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long").filter("word <> '' AND length(word) <= 64")
    counted = stored(found.groupBy("word").agg(F.sum("n").alias("n"))
                     .withColumn("size", F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")), "words")
    # Whole classes of counts from the top, so that no task and no sort sends more than the lexicon holds to the driver.
    least, taken = None, 0
    for r in counted.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        if taken + r.n > words:
            break
        least, taken = r.size, taken + r.n
    return [] if least is None else sorted(r.word for r in counted.filter(F.col("size") >= least).select("word").collect())


def published(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and have Spark bring it to every executor; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "lexicon") + f"/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def encode(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text; every other column is kept, ``ids`` replaced."""
    path = path or tokenizer_path()
    docs = docs.drop("ids")
    frequent = frequent_words(docs, words)
    exact = Merger(path).encode(frequent)
    name = published(docs.sparkSession, compiled({w.encode(): ids for w, ids in zip(frequent, exact)}))
    schema = docs.withColumn("ids", F.array(F.lit(0))).schema

    def run(batches):
        merger, lexicon = Merger(path), Transducer.opened(SparkFiles.get(name))
        # Rows of the table of known words; the lexicon's come first, unseen ones are added until there are too many.
        for_words: dict[str, int] = {}
        begin, ids = lexicon.begin.astype(np.int64), lexicon.ids
        lexical = len(begin) - 1
        flat, ends = np.asarray(ids), begin
        for batch in batches:
            for at, texts in _sliced(batch.column("text")):
                parts = [_split(t) for t in texts]
                if len(for_words) > CACHED_WORDS:
                    for_words.clear()
                    flat, ends = np.asarray(ids), begin
                new = list(set().union(*parts).difference(for_words))
                numbers = lexicon.numbers([w.encode() for w in new])
                unseen = np.flatnonzero(numbers < 0)
                merged = merger.encode([new[k] for k in unseen])
                numbers[unseen] = len(ends) - 1 + np.arange(len(unseen))
                flat = np.concatenate([flat, *merged]).astype(np.int32) if len(merged) else flat
                ends = np.concatenate((ends, ends[-1] + np.cumsum([len(m) for m in merged], dtype=np.int64))) if len(merged) else ends
                for_words.update(zip(new, numbers.tolist()))
                counts = np.array([len(p) for p in parts], np.int64)
                number = np.fromiter((for_words[w] for p in parts for w in p), np.int64, int(counts.sum()))
                lengths = ends[number + 1] - ends[number]
                first = np.cumsum(lengths) - lengths
                out = flat[np.repeat(ends[number] - first, lengths) + np.arange(int(lengths.sum()))]
                stops = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
                column = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, column], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the tokens of ``ids`` joined by a space, special ones too; ``decoded`` is replaced."""
    path = path or tokenizer_path()
    rows = rows.drop("decoded")
    schema = rows.withColumn("decoded", F.lit("")).schema

    def run(batches):
        tokens = Merger(path).tokens
        table = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                flat = table.take(ids.flatten())
                stops = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
                said = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat), " ")
                yield pa.RecordBatch.from_arrays([*part.columns, said], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).drop("text")
    said = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return decode(coded, path).select("doc_id", F.size("ids").alias("n_tokens").cast("long").alias("n_tokens"), said.alias("ids_sha256"),
                                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

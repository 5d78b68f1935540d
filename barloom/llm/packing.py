"""Best-fit packing of tokenized documents into fixed-length sequences.

Bound-certified repacking.  Pieces of documents are dealt to partitions by a
hash; each partition runs best-fit decreasing and certifies its bin count with
dual-feasible-function lower bounds.  Partitions whose count exceeds the bound
exchange the documents of their bins that are not full, together with every
partition's emptiest bin, and best-fit decreasing runs again over the pool,
dealt anew.  A round's result is taken only if it needs fewer bins.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

CAPACITY = 4096
SEPARATOR_ID = 1
#: Pieces that one task packs at a time; also the size a partition of the pool aims at.
PIECES_PER_PARTITION = 40_000
ROUNDS = 4
#: Words whose ids a Python worker remembers, in each of two generations.
CACHED_WORDS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", round int, part int, bin int, offset long, fill long, bins int, bound int"


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary splits texts at white space first, so a text's ids are its
    words' ids joined, and words met before are looked up.  That holds for the
    characters in ``PLAIN``, which normalise one by one; a text with any other
    character, or one that may spell a special token, goes to the tokenizer whole.
    """

    PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
    MARKS = ".,!?;:"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        # the vocabulary's byte alphabet: printable bytes stand for themselves, the others for characters from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_word(self, word: str) -> bytes:
        """A word of letters only is one piece to the vocabulary's model, which takes it in the byte alphabet."""
        if not word.isascii():
            word = "".join([self.alphabet[b] for b in word.encode()])
        ids = [x.id for x in self.split(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bool:
        try:
            return "<|" not in text and not text.encode("latin-1").translate(None, self.PLAIN)
        except UnicodeEncodeError:
            return False

    def _recall(self, words: set[str]) -> set[str]:
        """The words that neither generation knows; those of the old one move to the new."""
        words = words.difference(self.known)
        again = words.intersection(self.old)
        self.known.update((w, self.old[w]) for w in again)
        return words - again

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [x.lower().split() if self.plain(x) else None for x in texts]
        if len(self.known) > CACHED_WORDS:
            self.old, self.known = self.known, {}
        new = self._recall({w for ws in words if ws for w in ws})
        # letters and one mark are two parts to the vocabulary, whose ids join
        marked = {w for w in new if w[-1] in self.MARKS and w[:-1].isalpha()}
        base = self._recall({w[:-1] for w in marked} | (new - marked) | set(self.MARKS))
        letters = [w for w in base if w.isalpha()]
        self.known.update([(w, self._encode_word(w)) for w in letters])
        rest = list(base.difference(letters))
        self.known.update(zip(rest, self._encode(rest), strict=True))
        get = self.known.__getitem__
        self.known.update([(w, get(w[:-1]) + get(w[-1])) for w in marked])
        return [b"".join(map(get, ws)) if ws is not None else self._encode([x])[0] for x, ws in zip(texts, words, strict=True)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by SEPARATOR_ID.

    A null or empty text has the one id SEPARATOR_ID.  Only documents longer
    than ``capacity`` are cut.  Repeated rows give repeated pieces; null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        end = SEPARATOR_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                rows: list[tuple] = []
                for doc, raw in zip(ids, tokenizer([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - s)
                        rows.append((doc, k, s, length, zlib.crc32(raw[4 * s : 4 * (s + length)])))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on bins over two families of dual feasible functions.

    Threshold functions, for every t up to half the capacity: lengths over
    capacity - t count as a whole bin, those below t as nothing.  Rounding
    functions, for k = 1..32: (k+1) * x / capacity is rounded down unless
    whole, in units of 1/k bin.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    amount, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    middle = amount[capacity - t] - amount[t - 1]
    large = number[capacity] - number[capacity - t]
    best = max(-(-int(amount[-1]) // capacity), int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        total = int((count * np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)).sum())
        best = max(best, -(-total // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill.

    Open bins are kept by free space; a bit mask over free spaces finds the
    tightest one that fits.
    """
    where, offset = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            b, space = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += need
        space -= need
        if space:
            by_space[space].append(b)
            mask |= 1 << space
    return where, offset, np.asarray(fill, dtype=np.int64)


def _pack_parts(pieces: DataFrame, number: int, turn: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each of ``number`` parts, with the part's bin count and bound on each row."""
    parts = max(1, -(-number // PIECES_PER_PARTITION))
    columns = [c.split()[0] for c in PLACED.split(", ")]

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        pdf = pdf.assign(bin=where, offset=offset, fill=fill[where], bins=len(fill), bound=lower_bound(lengths, capacity))
        return pdf[columns]

    dealt = pieces.select(
        *PIECES.replace(" long", "").replace(" int", "").split(", "),
        F.lit(turn).alias("round"),
        F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)).cast("int").alias("part"),
    )
    return dealt.groupBy("part").applyInPandas(run, PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Sequences for pieces (doc_id, piece, start, length, ids_crc32) of 1 to ``capacity`` tokens.

    Adds sequence_id (unique to a sequence, otherwise any number) and offset,
    gapless from 0 within a sequence.  The driver sees counts only.  An empty
    table gives an empty one; repeated rows are packed as often as they come.
    """
    scratch = Scratch(pieces.sparkSession)
    number = pieces.count()
    placed = scratch.save(_pack_parts(pieces, number, 0, capacity), "packed-0")
    for turn in range(1, rounds + 1):
        # a part's emptiest bin is open to exchange even where the part meets its bound
        emptiest = placed.groupBy("round", "part").agg(F.min(F.struct("fill", "bin")).alias("e")).select("round", "part", F.col("e.bin").alias("emptiest"))
        marked = placed.join(emptiest, ["round", "part"]).withColumn(
            "open", ((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)) | ((F.col("bin") == F.col("emptiest")) & (F.col("fill") < capacity))
        )
        held, given = marked.filter("not open"), marked.filter("open")
        now = given.agg(F.count("*").alias("pieces"), F.count_distinct("round", "part", "bin").alias("bins"), F.sum("length").alias("tokens")).first()
        if not now["pieces"] or now["bins"] <= -(-now["tokens"] // capacity):
            break
        again = scratch.save(_pack_parts(given, now["pieces"], turn, capacity), f"pool-{turn}")
        bins = again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if bins >= now["bins"]:
            scratch.drop(f"pool-{turn}")
            break
        placed = scratch.save(held.select(placed.columns).unionByName(again), f"packed-{turn}")
        scratch.drop(f"packed-{turn - 1}", f"pool-{turn}")
    sequence = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 26) + F.col("bin")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize documents (doc_id, text) once, into the shared scratch folder, and pack them."""
    pieces = Scratch(docs.sparkSession).save(tokenize_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)

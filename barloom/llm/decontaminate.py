"""Benchmark decontamination by a hash set of normalised test n-grams.

Text is normalised byte by byte: A-Z to lower case, every other ASCII
character that is not a letter or digit to a separator, the rest kept.  Words
get numbers from the benchmark's own vocabulary, and a window of words is the
byte string of their numbers; looking a window up in the set compares that
whole string, so every hit is verified.  Windows holding a word that no
benchmark item has are skipped, which leaves few windows to look up.

The set is broadcast only if the benchmark has at most ``SET_WINDOWS`` words,
which bounds its windows; a larger benchmark is met by a join on windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

WINDOW = 10
#: Words, and so windows, of a benchmark whose set is broadcast; a window takes about 200 bytes of Python objects.
SET_WINDOWS = 500_000

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    c if c >= 0x80 or c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_SEPARATORS = "".join(chr(c) for c in range(128) if chr(c).encode().lower() not in [bytes([x]) for x in _WORD])


def normalise(text: str | None) -> bytes:
    """Same length in UTF-8 bytes as the text; words are runs without spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


class WindowSet:
    """The windows of all benchmark items, and which items have each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.sizes: set[int] = set()
        owners: dict[bytes, set[str]] = defaultdict(set)
        for name, text in items:
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normalise(text).split()], dtype=np.int32)
            if len(ids):
                size = min(window, len(ids))
                self.sizes.add(size)
                for i in range(len(ids) - size + 1):
                    owners[ids[i : i + size].tobytes()].add(name)
        self.owners = {k: tuple(v) for k, v in owners.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), dtype=np.int32, count=len(words))
        seen = np.concatenate([[0], np.cumsum(ids > 0)])
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        found: set[str] = set()
        for size in self.sizes:
            if size > len(words):
                continue
            for i in np.flatnonzero(seen[size:] - seen[:-size] == size).tolist():
                owners = self.owners.get(ids[i : i + size].tobytes())
                if owners:
                    edge[i] += 1
                    edge[i + size] -= 1
                    found.update(owners)
        return np.cumsum(edge[:-1]) > 0, found


def _word_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the maximal runs of hit words."""
    spans: list[tuple[int, int]] = []
    at, last = 0, -2
    for k, word in enumerate(raw.split()):
        at = raw.index(word, at)
        if hit[k]:
            if last == k - 1:
                spans[-1] = (spans[-1][0], at + len(word))
            else:
                spans.append((at, at + len(word)))
            last = k
        at += len(word)
    return spans


def cut(text: str, window_set: WindowSet) -> str:
    """The text without its hit spans; repeated, as what a cut brings together may hit anew."""
    while True:
        raw = normalise(text)
        words = raw.split()
        hit, _ = window_set.scan(words)
        if not hit.any():
            return text
        text = _without(text, _word_spans(raw, hit))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its UTF-8 bytes."""
    whole, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in spans:
        kept.append(whole[at:start])
        at = end
    return b"".join([*kept, whole[at:]]).decode("utf-8", "surrogatepass")


def cut_words(text: str | None, places) -> str | None:
    """The text without the words at the places (from 0)."""
    if text is None or not len(places):
        return text
    raw = normalise(text)
    hit = np.zeros(len(raw.split()), dtype=bool)
    hit[np.asarray(places, dtype=np.int64)] = True
    return _without(text, _word_spans(raw, hit))


def benchmark_set(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", limit: int = SET_WINDOWS) -> WindowSet | None:
    """The window set, or None if the benchmark has over ``limit`` words.

    Null texts have no windows; a null id counts as the empty name.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    if (items.agg(F.sum(F.size(_joined_words(F.col("t"))))).first()[0] or 0) > limit:
        return None
    return WindowSet([(r["i"], r["t"]) for r in items.toLocalIterator()], window)


def _joined_words(text):
    """The words of a text as an array."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.translate(folded, _SEPARATORS, " " * len(_SEPARATORS)), " "), "")


def _joined_windows(ws, size):
    """Structs (i, w) of the windows of ``size`` words: where each starts, and its words."""
    starts = F.when(F.size(ws) >= size, F.sequence(F.lit(0), F.size(ws) - size))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.slice(ws, i + 1, size)).alias("w")))


def _met(texts: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text: str) -> DataFrame:
    """(key, item, i, n): the windows of texts (key, ws: their words) that an item has; i is the first of n words."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), _joined_words(F.coalesce(F.col(item_text), F.lit(""))).alias("ws")).filter("size(ws) > 0")
    items = items.withColumn("n", F.least(F.lit(window), F.size("ws")))
    owned = items.select("item", "n", F.explode(_joined_windows(F.col("ws"), F.col("n"))).alias("x")).select("item", "n", F.col("x.w").alias("w")).distinct()
    found = benchmark.sparkSession.createDataFrame([], texts.select("key", F.lit("").alias("item"), F.lit(0).alias("i"), F.lit(0).alias("n")).schema)
    for size in sorted(r[0] for r in items.select("n").distinct().collect()):  # at most `window` sizes
        own = texts.select("key", F.explode(_joined_windows(F.col("ws"), F.lit(size))).alias("x")).select("key", "x.i", "x.w")
        found = found.unionAll(own.join(owned.filter(F.col("n") == size), "w").select("key", "item", "i", "n"))
    return found


def _scan_joined(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """scan_documents for a benchmark too large to broadcast: documents' windows join the benchmark's."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"), _joined_words(F.coalesce(F.col(text_col), F.lit(""))).alias("ws"))
    # equal texts are scanned once; each met window counts once for its items, and once for its words
    met = _met(keyed.groupBy("key").agg(F.first("ws").alias("ws")), benchmark, window, item_col, item_text)
    items = met.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    words = met.select("key", "i", "n").distinct().select("key", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    return keyed.select("doc_id", "key", F.size("ws").cast("long").alias("n_words")).join(items, "key", "left").join(words, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _remove_joined(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str) -> DataFrame:
    """remove_spans for a benchmark too large to broadcast: rounds of a join on windows and a cut, until nothing is hit."""
    scratch = Scratch(docs.sparkSession)
    mark = F.lit(False).alias("__hit")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"), F.col(text_col).alias("__text"), mark)
    turn, kept = 0, scratch.save(whole, "cut-0")

    def cut_at(texts, starts):
        return texts.combine(starts, lambda t, s: cut_words(t, [] if s is None else s))

    while True:
        keyed = kept.select(F.sha2(F.coalesce("__text", F.lit("")), 256).alias("key"), _joined_words(F.coalesce("__text", F.lit(""))).alias("ws"))
        met = _met(keyed.groupBy("key").agg(F.first("ws").alias("ws")), benchmark, window, "item_id", "text").select("key", "i", "n").distinct()
        hits = scratch.save(met.select("key", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("at")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("hit")), f"hits-{turn}")
        if hits.isEmpty():
            break
        joined = kept.withColumn("key", F.sha2(F.coalesce("__text", F.lit("")), 256)).join(hits, "key", "left")
        new = F.when(F.col("hit").isNotNull(), F.pandas_udf(cut_at, "string")("__text", "hit")).otherwise(F.col("__text"))
        turn += 1
        kept = scratch.save(joined.select("__own", new.alias("__text"), (F.col("__hit") | F.col("hit").isNotNull()).alias("__hit")), f"cut-{turn}")
        scratch.drop(f"cut-{turn - 1}", f"hits-{turn - 1}")
    left = kept.filter(~F.col("__hit") | (F.size(_joined_words(F.col("__text"))) > 0))
    return left.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__own.`{c}`").alias(c) for c in docs.columns])


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = SET_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids of items with occurring windows).

    A word in any occurrence of a window is hit.  Null and empty texts have no
    words and no hits; repeated rows are scanned as often as they come; an
    empty benchmark hits nothing.
    """
    found = benchmark_set(benchmark, window, item_col, item_text, limit)
    if found is None:
        return _scan_joined(docs, benchmark, window, id_col, text_col, item_col, item_text)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words, hits, items = [], [], []
                for text in part.column(1).to_pylist():
                    ws = normalise(text).split()
                    hit, owners = windows.scan(ws)
                    words.append(len(ws))
                    hits.append(int(hit.sum()))
                    items.append(sorted(owners))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "n_hit", "items"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", limit: int = SET_WINDOWS) -> DataFrame:
    """The documents without the words that benchmark windows hit; documents left without a word go.

    Documents that nothing hits stay as they are, those without words too.
    All columns are kept.  A benchmark of over ``limit`` words is met by joins on windows instead of a broadcast set.
    """
    found = benchmark_set(benchmark, window, limit=limit)
    if found is None:
        return _remove_joined(docs, benchmark, window, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def cleaned(texts):
        windows = shared.value

        def one(text):
            if text is None or not text:
                return text
            new = cut(text, windows)
            return new if new == text or normalise(new).split() else None

        return texts.map(one)

    # not deterministic to the planner: the filter below must not scan the texts again
    cleaned = F.pandas_udf(cleaned, "string").asNondeterministic()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), cleaned(F.col(text_col)).alias("new"))
    kept = whole.filter(F.col("new").isNotNull() | F.col(f"own.`{text_col}`").isNull())
    return kept.select(*[F.col("new").alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def items_digest(items):
    """Lower-case hex SHA-256 of the sorted ids joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


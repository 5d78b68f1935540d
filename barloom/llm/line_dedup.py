"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are normalised (lower case, white space as single spaces) and equal ones
meet by a 64-bit hash first, which names the line from then on.  A line's
shingles are its runs of ``WIDTH`` characters at every position.
Its signature is the ``SKETCH`` least of all of them in one order for all
lines (k minimum values): first those that start with a rare character, by
their hashes, so that only lines with few of these need the others hashed.

A band is a window of the sorted ranks: ``BANDS`` fixed marks are sorted in
among a line's ranks, and each mark's band is the ``RUN`` entries that follow
it, marks included, so lines of few shingles have windows of fewer of them.
Windows of so many shingles tell lines of a small vocabulary apart, so the
lines in shared bands grow with the near copies, not with the square of the lines.
The marks lie among the rare shingles where a line has enough of these, else
among those of two tiers or all; lines near a limit have both kinds.  Lines of
under ``SKETCH`` shingles have runs of their signature as bands.

Each band is searched in work linear in its lines: sorted by two values of the
signature, a line meets its ``NEIGHBOURS`` predecessors and the first line.
So bands of up to ``NEIGHBOURS`` + 1 lines are searched whole, and in larger
ones near lines stand next to each other, as they share values.  Bands
of over ``BLOCK`` lines are dealt into blocks by the line's hash, anew for each
band.  What this leaves over in bands that still hold several components is
searched after it: each such band's hub meets the lines of other components,
and then all lines of different components meet, block by block.  There a pair
becomes a row only if the parity sketches of its lines allow the similarity, a
test that loses none.  Pairs whose signatures share three fifths of their values are verified by the
exact Jaccard similarity of all shingles; connected components keep one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import Scratch, input_partitions, small_enough
from barloom.llm.components import connected_components

WIDTH = 5
SKETCH = 10
#: Marks among a line's ranks, and entries that make the band of a mark.
BANDS = 12
RUN = 6
#: Ranks that a kind of band needs, and under which a line has the next kind too; lines that share four fifths of their shingles so have one in common.
ENOUGH, FEW = 16, 24
#: Shingles from which on a line has windows as bands; with under SKETCH it has runs of ROWS too.
LEAST = 8
ROWS = 3
SIMILARITY = 0.8
#: Lines before its own that a line is compared with in each band.
NEIGHBOURS = 8
#: Lines of a band that one task sorts together; a larger band is dealt into blocks.
BLOCK = 4096
#: Lines of an open band that meet all of its lines at a time.
REST_BLOCK = 2048
#: Longs of a line's parity sketch.
PARITY = 8
#: Characters that start the shingles which come first, and second, in the order of signatures; then all others.
_TIERS = (r"[bgkpvwxyz0-9\x{80}-\x{10ffff}]", "[acdflmu]", r"[^abcdfgklmpuvwxyz0-9\x{80}-\x{10ffff}]")
_PACKED = [f"p{k}" for k in range(SKETCH // 2)]
_BANDS = [f"b{k}" for k in range(2 * BANDS)]
#: Places of a piece of a line whose shingles are found in it.
_STEP = 16
#: Pieces within one line: those places, and what follows them in the last shingle.
_PIECES = "(?=([^\\n]{1,%d}))[^\\n]{1,%d}" % (_STEP + WIDTH - 1, _STEP)
#: Keeps pairs of exactly the similarity, whatever the rounding of the products.
_ROUNDING = 1e-9
#: What stands in a packed signature where a line has fewer values.
_NONE = 2**31 - 1


def normalised(line: Column) -> Column:
    """A lower-case line with runs of white space as one space and none at the ends."""
    odd = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit(" ")) | F.contains(line, F.lit("\r"))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\s ]+", " ")).otherwise(line))


def _starting(norm: Column, start: str) -> Column:
    """The WIDTH characters from every place on where the pattern ``start`` has one and so many follow."""
    # a lookbehind over the one character matched, as a lookahead before it would be tried at every place;
    # Java steps back over whole characters beyond the basic plane only if the lookbehind names one
    return F.regexp_extract_all(norm, F.lit("(?s)%s(?<=(?=(%s))[^\U0010FFFF])" % (start, "." * WIDTH)), F.lit(1))


def _ranks(found: Column, tier: int) -> Column:
    """Distinct places in the order of signatures: the tier, then 29 bits of the hash."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftrightunsigned(F.xxhash64(x), 35).cast("int") + F.lit(tier << 29)))


def shingles(norm: Column) -> Column:
    """The 32-bit hashes of the runs of WIDTH characters at every position of a normalised line; a shorter line stands whole.

    The line is cut first, as finding a place in a short text is cheap; each
    piece goes on over the start of the next, so no run is lost at a cut.
    """

    def of_piece(piece: Column) -> Column:
        runs = F.array(*[F.hash(F.substring(piece, at + 1, WIDTH)) for at in range(_STEP)])
        number = F.char_length(piece) - (WIDTH - 1)
        return F.when(number >= _STEP, runs).otherwise(F.slice(runs, 1, F.greatest(number, F.lit(0))))

    every = F.flatten(F.transform(F.regexp_extract_all(norm, F.lit(_PIECES), F.lit(1)), of_piece))
    return F.array_distinct(F.when(F.char_length(norm) < WIDTH, F.array(F.hash(norm))).otherwise(every))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, norm): the normalised lines with a word of each document; k1 is the line's hash."""
    norms = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.lower(text_col), "\n")).alias("line")).select("doc_id", normalised(F.col("line")).alias("norm"))
    return norms.filter("norm <> ''").select("doc_id", F.xxhash64("norm").alias("k1"), "norm")


def _marks(kind: int) -> list[int]:
    """The marks of a kind of band, dealt over the ranks of the first ``kind`` + 1 tiers."""
    shares = ((BANDS,), (BANDS // 2, BANDS - BANDS // 2), (BANDS // 5, (BANDS - BANDS // 5) // 2, BANDS - BANDS // 5 - (BANDS - BANDS // 5) // 2))[kind]
    return [(tier << 29) + (k << 29) // share for tier, share in enumerate(shares) for k in range(share)]


def _windows(signed: DataFrame) -> DataFrame:
    """Adds b0.. to (r0, r1, r2, n0, n1, n2), the ranks of each tier and their numbers so far: the bands of the line's kind, then those of the next kind or nulls."""
    n0, n1, n2 = (F.col(f"n{k}") for k in range(3))
    own = F.when(n0 >= ENOUGH, 0).when(n1 >= ENOUGH, 1).when(n2 >= LEAST, 2)
    more = F.when((n0 >= ENOUGH) & (n0 < FEW), 1).when((n0 < ENOUGH) & (n1 >= ENOUGH) & (n1 < FEW), 2)

    def row(kind: str) -> Column:
        entries = [F.sort_array(F.concat(*[f"r{t}" for t in range(k + 1)], F.array(*[F.lit(m) for m in _marks(k)]))) for k in range(3)]
        return F.when(F.col(kind) == 0, entries[0]).when(F.col(kind) == 1, entries[1]).when(F.col(kind) == 2, entries[2])

    kept = [c for c in signed.columns if c not in ("r0", "r1", "r2", "n0", "n1", "n2")]
    def windows(kind: str, entries: str) -> Column:
        marks = [F.array(*[F.lit(m) for m in _marks(k)]) for k in range(3)]
        dealt = F.when(F.col(kind) == 0, marks[0]).when(F.col(kind) == 1, marks[1]).when(F.col(kind) == 2, marks[2])
        # a function over the marks, as code for each of them would be too long to be compiled
        return F.transform(dealt, lambda m, k: F.xxhash64(F.col(kind), k, F.slice(entries, F.array_position(entries, m).cast("int") + 1, RUN)))

    rows = signed.select("*", own.alias("own"), more.alias("more")).select(*kept, "own", "more", row("own").alias("x"), row("more").alias("y"))
    # the row goes on from its start, so the last marks have whole windows
    round_ = rows.select(*kept, "own", "more", *[F.concat(c, F.slice(c, 1, RUN)).alias(c) for c in ("x", "y")])
    bands = round_.select(*kept, windows("own", "x").alias("x"), windows("more", "y").alias("y"))
    return bands.select(*kept, *[F.get(c, F.lit(k)).alias(f"b{k + at}") for c, at in (("x", 0), ("y", BANDS)) for k in range(BANDS)])


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct normalised line: k1, doc_id (the smallest), p0.. (the signature, two values in a long) and b0.. (bands).

    The signature is the SKETCH least ranks of all the line's shingles.  Those
    of a later tier are ranked only where the tiers before have too few.  A
    line with fewer shingles has all of them.
    """
    own = _lines(docs, id_col, text_col)
    none, size = F.array().cast("array<int>"), F.lit(0)
    for tier, start in enumerate(_TIERS):
        found = _ranks(_starting(F.col("norm"), start), tier)
        if tier == 2:
            found = F.when(F.char_length("norm") < WIDTH, _ranks(F.array("norm"), tier)).otherwise(found)
        own = own.select("*", (found if tier == 0 else F.when(size < FEW, found).otherwise(none)).alias(f"r{tier}"))
        size = size + F.size(f"r{tier}")
        own = own.select("*", size.alias(f"n{tier}"))
        size = F.col(f"n{tier}")
    least = F.slice(F.sort_array(F.concat("r0", "r1", "r2")), 1, SKETCH)
    signed = _windows(own.select("doc_id", "k1", "r0", "r1", "r2", "n0", "n1", "n2", least.alias("s")))
    value = lambda k: F.coalesce(F.get("s", F.lit(k)), F.lit(_NONE)).cast("long")
    packed = [F.shiftleft(value(2 * k), 32).bitwiseOR(value(2 * k + 1)).alias(p) for k, p in enumerate(_PACKED)]
    flat = signed.select("doc_id", "k1", *packed, *_BANDS)
    return flat.groupBy("k1").agg(F.min("doc_id").alias("doc_id"), *[F.min(p).alias(p) for p in (*_PACKED, *_BANDS)])


def _unpacked(table: DataFrame) -> DataFrame:
    """k1, s (the signature's values, _NONE after the last), n (their number) and m0, m1: a set of the values modulo 128."""
    flat = table.select("k1", F.array(*[v for p in _PACKED for v in (F.shiftright(p, 32), F.col(p).bitwiseAND(F.lit(_NONE)))]).alias("s"))
    masks = []
    for high in (0, 64):
        bits = [F.expr(f"if(s[{k}] <> {_NONE} and (s[{k}] & 64) = {high}, shiftleft(1L, cast(s[{k}] & 63 as int)), 0L)") for k in range(SKETCH)]
        mask = bits[0]
        for other in bits[1:]:
            mask = mask.bitwiseOR(other)
        masks.append(mask)
    number = F.array_position("s", F.lit(_NONE).cast("long"))
    return flat.select("*", F.when(number > 0, number - 1).otherwise(SKETCH).cast("int").alias("n"), masks[0].alias("m0"), masks[1].alias("m1"))


def _banded(table: DataFrame) -> DataFrame:
    """k1 and band: the line's windows, and in lines of under SKETCH shingles hashes of neighbouring values.

    Those are runs of ROWS; of two as well in signatures too small for those to survive
    a differing shingle, and the whole signature where it is smaller still.
    """
    windows = table.select("k1", F.explode(F.array(*_BANDS)).alias("band")).filter("band is not null")
    n = F.col("n")
    runs = F.transform(F.sequence(F.lit(0), n - ROWS), lambda k: F.struct(k.alias("at"), F.lit(ROWS).alias("rows")))
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.struct(k.alias("at"), F.lit(2).alias("rows")))
    one = F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("rows")))
    places = F.when(n >= 8, runs).when(n >= ROWS, F.concat(runs, pairs)).when(n == 2, pairs).otherwise(one)
    # the last value is there only in lines of SKETCH shingles and more
    short = table.filter(F.col(_PACKED[-1]).bitwiseAND(F.lit(_NONE)) == _NONE)
    dealt = _unpacked(short).select("k1", "s", F.inline(places))
    value = lambda k: F.get("s", k)
    at = F.col("at")
    band = F.xxhash64("rows", value(at), F.when(F.col("rows") > 1, value(at + 1)), F.when(F.col("rows") > 2, value(at + 2)))
    return windows.unionAll(dealt.select("k1", band.alias("band")))


def shared_bands(table: DataFrame) -> DataFrame:
    """(band, lines) of the bands that several lines have."""
    return _banded(table).groupBy("band").agg(F.count("*").alias("lines")).filter("lines > 1")


def band_members(table: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(band, lines, rest, k1, m0, m1) of the lines in shared bands: rest are two values of the signature, the same two for all lines of a band."""
    shared = shared_bands(table) if shared is None else shared
    shared = F.broadcast(shared) if small_enough(shared, 16) else shared.hint("shuffle_hash")
    own = _banded(table).join(shared, "band")
    sketches = _unpacked(table).select("k1", "s", "m0", "m1")
    two = F.pmod("band", F.lit(SKETCH // 2)).cast("int") * 2
    return own.join(sketches, "k1").select("band", "lines", F.shiftleft(F.get("s", two), 32).bitwiseOR(F.get("s", two + 1)).alias("rest"), "k1", "m0", "m1")


def candidates(table: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK, *, members: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of lines that meet in a band and whose signatures share three fifths of their values.

    Bands of up to ``neighbours`` + 1 lines are searched whole, larger ones in
    part: what is left of these is for ``hub_pairs`` and ``rest_pairs``.

    At a similarity of 0.8 a value of one line is in the other with 2 * 0.8 / 1.8 = 0.89,
    so the second test misses about 0.5 % there (a binomial of SKETCH draws), less
    above.  It counts values in sets of 128 bits, where few fall together.
    """
    members = band_members(table) if members is None else members
    members = members.select("band", "rest", "k1", "m0", "m1", F.when(F.col("lines") > block, F.pmod(F.xxhash64("k1", "band"), F.ceil(F.col("lines") / block))).otherwise(0).alias("block"))
    order = Window.partitionBy("band", "block").orderBy("rest", "k1")
    earlier = {j: [F.lag(c, j).over(order).alias(f"{c}_{j}") for c in ("k1", "m0", "m1")] for j in range(1, neighbours + 1)}
    earlier[0] = [F.first(c).over(order).alias(f"{c}_0") for c in ("k1", "m0", "m1")]
    size = lambda x, y: F.bit_count(x) + F.bit_count(y)
    met = members.select("k1", "m0", "m1", size(F.col("m0"), F.col("m1")).alias("n"), *[c for own in earlier.values() for c in own])

    def alike(j: int) -> Column:
        other, m0, m1 = (F.col(f"{c}_{j}") for c in ("k1", "m0", "m1"))
        shares = size(m0.bitwiseAND(F.col("m0")), m1.bitwiseAND(F.col("m1")))
        return F.when((other != F.col("k1")) & (5 * shares >= 3 * F.least(size(m0, m1), F.col("n"))), other)

    pairs = met.select(F.col("k1").alias("y"), F.explode(F.array(*[alike(j) for j in earlier])).alias("x")).filter("x is not null")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _share(x, y) -> Column:
    """Whether two lines' signatures (m0, m1) share three fifths of their values."""
    size = lambda a, b: F.bit_count(a) + F.bit_count(b)
    both = size(x["m0"].bitwiseAND(y["m0"]), x["m1"].bitwiseAND(y["m1"]))
    return 5 * both >= 3 * F.least(size(x["m0"], x["m1"]), size(y["m0"], y["m1"]))


def large_bands(members: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(band, k1, m0, m1) of the bands that ``candidates`` does not search whole."""
    return members.filter(F.col("lines") > neighbours + 1).select("band", "k1", "m0", "m1").distinct()


def _parity(found: str) -> Column:
    """The parity sketch of a column of sets: each shingle flips one of 64 * PARITY bits.

    Two sketches differ in no more bits than the sets in shingles, as common shingles flip the same bits.
    """
    return F.struct(*[F.expr(f"aggregate(filter({found}, h -> (h & {(PARITY - 1) << 6}) = {w << 6}), 0L, (a, h) -> a ^ shiftleft(1L, h & 63))").alias(f"q{w}") for w in range(PARITY)])


def _near(x, y, similarity: float) -> Column:
    """Whether set sizes and parity sketches (n, q) allow the similarity: |x ^ y| <= (|x| + |y|) (1 - t) / (1 + t) where it is t or more."""
    differ = F.lit(0)
    for w in range(PARITY):
        differ = differ + F.bit_count(x["q"][f"q{w}"].bitwiseXOR(y["q"][f"q{w}"]))
    sizes = F.least(x["n"], y["n"]) >= (similarity - _ROUNDING) * F.greatest(x["n"], y["n"])
    return sizes & (differ <= (x["n"] + y["n"]) * ((1 - similarity) / (1 + similarity) + _ROUNDING))


def open_bands(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of bands that hold several components, with the root of their own."""
    kept = [c for c in members.columns if c != "root"]
    rooted = members.join(roots, members["k1"] == roots["node"], "left").select(*kept, F.coalesce("component", "k1").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    return rooted.join(mixed, "band", "left_semi")


def hub_pairs(open_: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of each open band's hub, the line in most of them, with the lines of other components: linear in the lines.

    ``open_`` is as of ``open_bands``, with the lines' sketches (n, q).
    """
    met = open_.groupBy("k1").agg(F.count("*").alias("met"))
    hubs = open_.join(met, "k1").groupBy("band").agg(F.max(F.struct("met", "k1", "m0", "m1", "root", "n", "q")).alias("hub"))
    own = F.struct("m0", "m1", "n", "q")
    near = open_.join(hubs, "band").filter((F.col("root") != F.col("hub.root")) & _share(own, F.col("hub")) & _near(own, F.col("hub"), similarity))
    return near.select(F.least("k1", "hub.k1").alias("a"), F.greatest("k1", "hub.k1").alias("b")).distinct()


def _blocks(open_: DataFrame, line: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """A band's lines dealt into blocks (band, part, x), and all of its lines for each block (band, part, y)."""
    sizes = open_.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = open_.join(sizes, "band")
    # tasks are dealt by number, as these few bytes are much work
    tasks = input_partitions(open_.sparkSession)
    x = sized.select("band", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int").alias("part"), F.struct(*line).alias("x")).repartition(tasks, "band", "part")
    y = sized.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.struct(*line).alias("y")).repartition(tasks, "band", "part")
    return x.hint("merge"), y


def with_partner(open_: DataFrame, block: int = REST_BLOCK) -> DataFrame:
    """The members of open bands that have a line of another component there with which their signature shares three fifths."""
    x, y = _blocks(open_, ["k1", "root", "m0", "m1"], block)
    own, other = F.col("y"), F.col("x")
    meets = (x["band"] == y["band"]) & (x["part"] == y["part"]) & (own["root"] != other["root"]) & _share(own, other)
    return y.join(x, meets, "left_semi").select("band", "y.*").distinct()


def rest_pairs(open_: DataFrame, similarity: float = SIMILARITY, block: int = REST_BLOCK) -> DataFrame:
    """All pairs of lines of different components in one band whose signatures share three fifths and whose sketches allow the similarity.

    A band's lines are dealt into blocks, and each block meets all of the
    band's lines in an equi-join, whose condition keeps what qualifies.  So the
    comparisons are quadratic in the lines of open bands, but not the rows.
    """
    x, y = _blocks(open_, ["k1", "root", "m0", "m1", "n", "q"], block)
    a, b = F.col("x"), F.col("y")
    near = (x["band"] == y["band"]) & (x["part"] == y["part"]) & (a["k1"] < b["k1"]) & (a["root"] != b["root"]) & _share(a, b) & _near(a, b, similarity)
    return y.join(x, near).select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b")).distinct()


def line_texts(pairs: DataFrame, table: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, n, set, q) of the lines in pairs, read from their first documents: the number of shingles, their hashes and the parity sketch.

    The lists of wanted lines and documents are broadcast where their counted
    size is small, so that only wanted lines leave their tasks; else they join.
    """
    wanted = pairs.select(F.col("a").alias("k1")).unionAll(pairs.select(F.col("b").alias("k1"))).distinct()
    homes = table.select("k1", "doc_id").join(wanted, "k1").select("doc_id").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if small_enough(homes, 24):
        texts = texts.join(F.broadcast(homes), texts["doc_id"].eqNullSafe(homes["doc_id"]), "left_semi")
    if small_enough(wanted, 8):
        wanted = F.broadcast(wanted)
    own = _lines(texts, "doc_id", "text").select("k1", "norm").join(wanted, "k1", "left_semi").dropDuplicates(["k1"])
    # the generator has the set made once
    sets = own.select("k1", F.explode(F.array(shingles(F.col("norm")))).alias("set"))
    return sets.select("k1", F.size("set").alias("n"), "set", _parity("set").alias("q"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of k1 whose lines' shingle sets have the Jaccard similarity; ``texts`` is as of ``line_texts``."""
    side = lambda x, key: texts.select(F.col("k1").alias(key), F.col("n").alias(f"n{x}"), F.col("set").alias(x))
    met = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")
    even = met.filter(F.least("nx", "ny") >= (similarity - _ROUNDING) * F.greatest("nx", "ny"))
    # |x & y| >= t |x | y|, with |x | y| = |x| + |y| - |x & y|
    return even.filter((1 + similarity) * F.size(F.array_intersect("x", "y")) >= (similarity - _ROUNDING) * (F.col("nx") + F.col("ny"))).select("a", "b")


def components(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, doc_id, component, keeper): the distinct lines and their components; keeper marks the one line kept of each.

    doc_id is the smallest document that has the line.  A component's keeper is
    its line with the smallest (doc_id, k1).
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(line_table(docs, id_col, text_col), "lines")
    scratch.release()
    shared = scratch.save(shared_bands(table), "bands")
    scratch.release()
    members = scratch.save(band_members(table, shared), "band-members")
    scratch.drop("bands")
    scratch.release()
    pairs = scratch.save(candidates(table, members=members), "line-pairs")
    scratch.release()
    texts = scratch.save(line_texts(pairs, table, docs, id_col, text_col).select("k1", "n", "set"), "texts")
    scratch.release()
    parts = scratch.save(connected_components(verified(pairs, texts, similarity), "lines"), "parts-near")
    scratch.release()
    # what the search of large bands leaves over: first hubs, then all that are still apart
    members = scratch.save(with_partner(open_bands(large_bands(members), parts)), "open-bands")
    lines = scratch.save(members.select("k1").distinct(), "open-lines")
    scratch.drop("band-members")
    scratch.release()
    if not lines.isEmpty():
        open_texts = scratch.save(line_texts(lines.select(F.col("k1").alias("a"), F.col("k1").alias("b")), table, docs, id_col, text_col), "texts-open")
        scratch.release()
        for step, meet in (("hubs", hub_pairs), ("rest", rest_pairs)):
            met = meet(open_bands(members, parts).join(open_texts.select("k1", "n", "q"), "k1"), similarity)
            more = scratch.save(met.join(pairs, ["a", "b"], "left_anti"), f"pairs-{step}")
            scratch.release()
            if not more.isEmpty():
                links = verified(more, open_texts, similarity).unionAll(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
                parts = scratch.save(connected_components(links, f"lines-{step}"), f"parts-{step}")
                scratch.release()
    named = table.select("k1", "doc_id").join(parts, table["k1"] == parts["node"], "left").select("k1", "doc_id", F.coalesce("component", "k1").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "k1"))["k1"].alias("first"))
    found = scratch.save(named.join(first, "component").select("k1", "doc_id", "component", (F.col("k1") == F.col("first")).alias("keeper")), "line-components")
    scratch.drop(*[name for name in scratch.paths if name != "line-components"])
    return found


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with text_col cleaned, and n_lines and n_dropped (lines with a word, and those of them removed).

    Of the lines of a component the one of the smallest doc_id stays, at its
    first place there; lines without a word always stay, unless no line with
    a word does.  Null and empty texts stay as they are.  Rows that repeat a
    doc_id count as one document and keep the same lines; null ids count as
    one document, before all others.  All columns are kept; former n_lines and
    n_dropped columns are replaced.
    """
    kept = components(docs, similarity, id_col, text_col).filter("keeper").groupBy("doc_id").agg(F.collect_list("k1").alias("__kept"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(*[F.col(f"`{c}`") for c in rest])
    joined = base.join(kept.withColumnRenamed("doc_id", "__doc"), base[id_col].eqNullSafe(F.col("__doc")), "left").withColumn("__rows", F.split(text_col, "\n"))
    # a document that keeps as many lines as it has needs no look at them
    counted = joined.withColumn("__some", F.size(F.filter("__rows", lambda x: F.trim(x) != "")))
    known = counted.withColumn("__whole", F.coalesce(F.size("__kept") == F.col("__some"), F.lit(False)))

    def key(line: Column) -> Column:
        return F.transform(F.array(normalised(F.lower(line))), lambda n: F.when(n != "", F.xxhash64(n)))[0]

    keyed = known.withColumn("__keys", F.when(~F.col("__whole"), F.transform("__rows", key)))
    places = F.filter(F.transform("__keys", lambda k, i: F.struct(k.alias("key"), i.alias("place"))), lambda x: x["key"].isNotNull())
    marks = F.transform(F.coalesce("__kept", F.array().cast("array<bigint>")), lambda k: F.struct(k.alias("key"), F.lit(-1).alias("place")))
    ordered = keyed.withColumn("__order", F.sort_array(F.concat(marks, places)))
    # in the order of (key, place) a line stays if the mark of its key, kept here, stands right before it
    before = lambda i: F.get("__order", i - 1)
    first = F.filter("__order", lambda x, i: (x["place"] >= 0) & F.coalesce((before(i)["place"] == -1) & (before(i)["key"] == x["key"]), F.lit(False)))
    chosen = ordered.withColumn("__stays", F.transform(first, lambda x: x["place"])).withColumn("__bare", F.filter(F.transform("__keys", lambda k, i: F.when(k.isNull(), i)), lambda i: i.isNotNull()))
    worded = F.size("__keys") - F.size("__bare")
    left = F.when(F.size("__stays") > 0, F.array_join(F.transform(F.sort_array(F.concat("__stays", "__bare")), lambda i: F.get("__rows", i)), "\n")).when(worded > 0, "").otherwise(F.col(text_col))
    same = F.struct(F.col(text_col).alias("text"), F.col("__some").cast("long").alias("lines"), F.lit(0).cast("long").alias("dropped"))
    cut = F.struct(left.alias("text"), worded.cast("long").alias("lines"), (worded - F.size("__stays")).cast("long").alias("dropped"))
    none = F.struct(F.col(text_col).alias("text"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("dropped"))
    result = F.when(F.col("__whole"), same).when(F.col("__keys").isNull(), none).otherwise(cut)
    # rows of a generator: what follows cannot make the planner compute the texts again
    made = chosen.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(rest)], F.inline(F.array(result)).alias("__text", "n_lines", "n_dropped"))
    return made.select(*[F.col("__text" if c == text_col else f"__{k}").alias(c) for k, c in enumerate(rest)], "n_lines", "n_dropped")

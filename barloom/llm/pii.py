"""Personal data and secrets replaced by keyed surrogates, in DataFrame functions only.

One pattern finds the entities.  An entity's canonical form (digits of a phone
or card number, lower-cased e-mail, ...) and a secret key give a SHA-256, from
which every letter and digit of the surrogate is drawn, so one entity has one
surrogate everywhere, however it is written.  Surrogates keep the type, the
layout, letter case, script, a given name's gender, and the checksums of card
and account numbers.  Tables with entities in plain text are deleted again;
what stays for the result's sake names them by a keyed hash.
Surrogates that two entities share, or that are themselves an entity of the
corpus, are found over all distinct entities and drawn anew.  Where drawing
anew does not settle it, as few forms are left, a surrogate gets longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

# fixed values: the patterns of the entities, in the order in which they are tried
_MALE = r"Mr|Mister|Herrn?|Monsieur|Señor|Sr|Don|Господин|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Госпожа|г-жа"
_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_./+=~-]{6,}",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "male": rf"(?<!\p{{L}})(?:{_MALE})\.? {_NAME}(?: {_NAME})?",
    "female": rf"(?<!\p{{L}})(?:{_FEMALE})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this has no entity; it is cheap to test.
HINT = rf"[0-9@=:]|(?<!\p{{L}})(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}"
#: Draws of a surrogate in the entity's own layout; each one after these adds a character.
REDRAWS = 20
#: Draws after which a clash is an error: there are over 10^40 longer forms by then.
MOST_DRAWS = 60
_LATIN = [c + v for c in "bdfglmnrstv" for v in "aeio"]
_CYRILLIC = [c + v for c in "бвдлмнрст" for v in "аео"]


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the whole entity fits."""
    first, *others = [(name, entity.rlike(f"^(?:{pattern})$")) for name, pattern in PATTERNS.items()]
    return reduce(lambda c, x: c.when(x[1], x[0]), others, F.when(first[1], first[0]))


def canonical(kind: Column, entity: Column) -> Column:
    """What two ways of writing an entity have in common."""
    name = F.regexp_replace(entity, r"^\S+ ", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(entity, r"^[A-Za-z_-]+\s*[=:]\s*[\"']?", ""))
        .when(kind.isin("male", "female"), name)
        .otherwise(entity)
    )


def _draw(seed: Column, place: Column, sides: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(sides)).cast("int")


def _like(text: Column, seed: Column) -> Column:
    """Letters and digits drawn anew by their place, of the same case and script; other characters stay."""
    hexadecimal = text.rlike("^[0-9a-f]+$")

    def one(c, i):
        from_range = lambda first, sides: F.char(F.lit(ord(first)) + _draw(seed, i, sides)) if ord(first) < 256 else F.substring(
            F.lit("".join(chr(ord(first) + k) for k in range(sides))), _draw(seed, i, sides) + 1, F.lit(1)
        )
        return (
            F.when(c.rlike("[0-9]"), from_range("0", 10))
            .when(c.rlike("[a-f]") & hexadecimal, from_range("a", 6))
            .when(c.rlike("[a-z]"), from_range("a", 26))
            .when(c.rlike("[A-Z]"), from_range("A", 26))
            .when(c.rlike("[а-я]"), from_range("а", 32))
            .when(c.rlike("[А-Я]"), from_range("А", 32))
            .when(c.rlike("[α-ω]"), from_range("α", 17))
            .when(c.rlike(r"\p{Ll}"), from_range("a", 26))
            .when(c.rlike(r"\p{Lu}"), from_range("A", 26))
            .when(c.rlike(r"\p{L}"), F.substring(F.lit("".join(chr(0x4E00 + 7 * k) for k in range(128))), _draw(seed, i, 128) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string, from the right, every second digit doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.cast("int"), F.lit(0)) * (1 + F.pmod(i, F.lit(2))))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)), F.lit(10))


def _digits(number: Column, seed: Column, keep: Column) -> Column:
    """Digits drawn anew by their place but for the first ``keep``; the checksum of a sound card number is restored."""
    drawn = F.array_join(F.transform(F.split(number, ""), lambda c, i: F.when(i < keep, c).otherwise(_draw(seed, i, 10).cast("string"))), "")
    base = F.substring(drawn, F.lit(1), F.char_length(drawn) - 1)
    check = F.pmod(10 - _luhn(F.concat(base, F.lit("0"))), F.lit(10)).cast("string")
    return F.when((F.char_length(number) >= 13) & (_luhn(number) == 0), F.concat(base, check)).otherwise(drawn)


def _remainder(account: Column) -> Column:
    """Remainder modulo 97 of an account number: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(account: Column, seed: Column) -> Column:
    """An account number of the same country and layout; a sound one's check digits are made to fit."""
    country, rest = F.substring(account, 1, 2), _like(F.substring(account, F.lit(5), F.lit(40)), seed)
    check = F.lpad((98 - _remainder(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.concat(country, F.when(_remainder(account) == 1, check).otherwise(_like(F.substring(account, 3, 2), seed)), rest)


def _name(kind: Column, word: Column, given: Column, seed: Column) -> Column:
    """A name of the same script; given names end as the gender's names mostly do."""

    def made(table, female, male):
        pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in table]), _draw(seed, F.lit(k), len(table)) + 1)
        stem = F.initcap(F.concat(pick(1), pick(2), pick(3)))
        return F.concat(stem, F.when(given & (kind == "female"), F.lit(female)).when(given, F.lit(male)).otherwise(pick(4)))

    return F.when(word.rlike(r"\p{IsCyrillic}"), made(_CYRILLIC, "на", "н")).otherwise(made(_LATIN, "na", "n"))


def surrogate_form(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    seed = lambda what: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, what, attempt.cast("string")), 256)
    whole = seed(canon)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    lower_domain = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1)
    # a mail domain has one surrogate for all its addresses, whatever the attempt
    site = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), lower_domain), 256)
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda c, i: (1 + _draw(whole, i, 254)).cast("string")), ".")
    words = F.split(canon, " ")
    # a family name has one surrogate, whoever of the family is named, so a redraw of a full name changes its given name
    family = lambda w: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("name"), w, F.when(F.size(words) > 1, "0").otherwise(attempt.cast("string"))), 256)
    given = lambda i: (i == 0) & (F.size(words) > 1)
    names = F.array_join(F.transform(words, lambda w, i: _name(kind, w, given(i), F.when(given(i), seed(w)).otherwise(family(w)))), " ")
    # a country code and a card number's first digit say what it is, not whose
    country = F.when(kind == "phone", F.greatest(F.char_length(canon) - 10, F.lit(0))).when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    # too few forms are left in the entity's own layout: characters are added, so that the forms never run out
    letters = F.translate(whole, "0123456789", "ghijklmnop")
    drawn = (
        F.when(kind.isin("phone", "card", "ssn"), F.translate(whole, "abcdef", "012345"))
        .when(kind == "ip", F.regexp_replace(F.translate(whole, "abcdef", "012345"), "(.)", ".$1"))
        .when(kind.isin("iban", "cloud_key"), F.upper(letters))
        .when(kind.isin("male", "female") & canon.rlike(r"\p{IsCyrillic}"), F.translate(whole, "0123456789abcdef", "абвгдежзиклмнопр"))
        .otherwise(letters)
    )
    more = F.when(attempt > REDRAWS, F.substring(drawn, F.lit(1), F.when(kind == "ip", 2).otherwise(1) * (attempt - REDRAWS))).otherwise("")
    return (
        F.when(kind == "email", F.concat(_like(local, whole), more, F.lit("@"), _like(lower_domain, site), F.lit("."), top))
        .when(kind.isin("phone", "card", "ssn"), F.concat(_digits(canon, whole, country), more))
        .when(kind == "ip", F.concat(octets, more))
        .when(kind.isin("male", "female"), F.concat(names, more))
        .when(kind == "cloud_key", F.concat(F.substring(canon, 1, 4), _like(F.substring(canon, F.lit(5), F.lit(40)), whole), more))
        .when(kind == "iban", F.concat(_iban(canon, whole), more))
        .otherwise(F.concat(_like(canon, whole), more))
    )


def written(kind: Column, entity: Column, canon: Column, form: Column) -> Column:
    """A surrogate's canonical form in the layout of the entity it replaces."""
    place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9]", ""))
    laid = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(form, place(i) + 1, F.lit(1))).otherwise(c)), "")
    spaced = F.trim(F.regexp_replace(form, "(.{4})", "$1 "))
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(laid, F.substring(form, F.char_length(canon) + 1, F.char_length(form))))
        .when(kind == "iban", F.when(F.instr(entity, " ") > 0, spaced).otherwise(form))
        .when((kind == "email") & (entity == F.upper(entity)), F.upper(form))
        .when(kind.isin("secret", "male", "female"), F.concat(F.substring(entity, F.lit(1), F.char_length(entity) - F.char_length(canon)), form))
        .otherwise(form)
    )


def find_entities(text: Column) -> Column:
    """The entities of a text in order: structs (kind, canon, entity)."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def one(e):
        kind = kind_of(e)
        return F.struct(kind.alias("kind"), canonical(kind, e).alias("canon"), e.alias("entity"))

    return F.transform(F.coalesce(found, F.array().cast("array<string>")), one)


def _hidden(kind: Column, canon: Column, key: str) -> Column:
    """An entity's keyed hash, by which tables outside the texts name it."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("hidden"), kind, canon), 256)


def collisions(entities: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """(kind, canon, attempt): the entities whose first surrogate clashes, and the attempt that does not.

    entities: distinct (kind, canon).  A surrogate clashes if it is an entity
    of the corpus itself, its own included, or another entity's surrogate; of
    entities that share one the smallest keeps it.  The table is as a rule
    empty; it is never collected.  No clash is left: from REDRAWS on forms get
    longer, and a clash after MOST_DRAWS is an error.
    """
    own = scratch or Scratch(entities.sparkSession)
    before = set(own.paths)
    try:
        return _settled(entities, key, own)
    finally:
        # these tables hold real entities beside their surrogates
        own.drop(*[name for name in own.paths if name != "settled" and name not in before])


def _settled(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    form = lambda df: df.withColumn("form", surrogate_form(F.col("kind"), F.col("canon"), key, F.col("attempt")))
    now = scratch.save(form(entities.withColumn("attempt", F.lit(0))), "surrogates-0")
    turn = 0
    while True:
        keepers = now.groupBy("kind", "form").agg(F.min(F.struct("attempt", "canon"))["canon"].alias("keeper"), F.count("*").alias("sharers")).filter("sharers > 1")
        shared = now.join(keepers.select("kind", "form", "keeper"), ["kind", "form"]).filter("canon <> keeper").select("kind", "canon")
        real = now.join(entities.select("kind", F.col("canon").alias("form")), ["kind", "form"], "left_semi").select("kind", "canon")
        # names come from a short list of syllables; that one of them occurs somewhere does not point to anyone
        clash = shared.unionAll(real.filter("kind not in ('male', 'female')")).distinct()
        turn += 1
        clash = scratch.save(clash, f"clash-{turn}")
        if clash.isEmpty():
            return scratch.save(now.filter("attempt > 0").select("kind", "canon", "attempt"), "settled")
        if turn > MOST_DRAWS:
            raise RuntimeError(f"{clash.count()} entities share a surrogate or have that of an entity after {MOST_DRAWS} draws")
        moved = form(now.join(clash, ["kind", "canon"]).select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        now = scratch.save(now.join(clash, ["kind", "canon"], "left_anti").select("kind", "canon", "attempt", "form").unionByName(moved.select("kind", "canon", "attempt", "form")), f"surrogates-{turn}")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with every entity in text_col replaced, and n_entities and entity_kinds (kinds with their counts).

    Null texts stay null and empty ones empty, with no entities; texts without
    entities stay as they are.  All columns are kept, and rows that repeat are
    treated alike; former n_entities and entity_kinds columns are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    scratch = Scratch(docs.sparkSession)
    found = find_entities(F.col(text_col))
    each = docs.filter(F.col(text_col).rlike(HINT)).select(F.explode(found).alias("e")).select("e.kind", "e.canon").distinct()
    try:
        moved = collisions(scratch.save(each, "entities"), key, scratch)
        again = Scratch(docs.sparkSession).save(moved.select("kind", _hidden(F.col("kind"), F.col("canon"), key).alias("hidden"), "attempt"), "collided")
    finally:
        scratch.drop(*list(scratch.paths))
    base = docs.select(*[F.col(f"`{c}`") for c in rest], found.alias("__found"))
    if again.isEmpty():
        base = base.withColumn("__again", F.lit(None).cast("array<struct<kind:string,hidden:string,attempt:int>>"))
    else:  # texts with a clashing entity learn its attempt by the text's hash
        hits = docs.filter(F.col(text_col).rlike(HINT)).select(F.md5(F.col(text_col)).alias("__md5"), F.explode(found).alias("e")).select("__md5", "e.kind", _hidden(F.col("e.kind"), F.col("e.canon"), key).alias("hidden")).distinct()
        told = hits.join(again, ["kind", "hidden"]).groupBy("__md5").agg(F.collect_list(F.struct("kind", "hidden", "attempt")).alias("__again"))
        base = base.withColumn("__md5", F.md5(F.col(text_col))).join(told, "__md5", "left").drop("__md5")

    def new(e):
        hidden = F.when(F.size("__again") > 0, _hidden(e["kind"], e["canon"], key))
        tries = F.filter("__again", lambda a: (a["kind"] == e["kind"]) & (a["hidden"] == hidden))
        attempt = F.coalesce(F.get(F.transform(tries, lambda a: a["attempt"]), F.lit(0)), F.lit(0))
        return written(e["kind"], e["entity"], e["canon"], surrogate_form(e["kind"], e["canon"], key, attempt))

    made = base.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", new)))
    between = F.split(text_col, ANY)
    text = F.when(
        F.size("__found") > 0,
        F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get("__new", i), F.lit("")))), ""),
    ).otherwise(F.col(text_col))
    kinds = F.transform("__found", lambda e: e["kind"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter("__found", lambda e: e["kind"] == k)).alias("value"))))
    out = {c: F.col(f"`{c}`") for c in rest} | {text_col: text}
    return made.select(*[out[c].alias(c) for c in rest], F.size("__found").cast("long").alias("n_entities"), counts.alias("entity_kinds"))

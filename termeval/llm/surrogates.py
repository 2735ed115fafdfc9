"""Personal data: keyed surrogates of the same type and format.

Found entities are replaced by made-up ones that depend on a secret key, the
type and the entity alone, so that one person stays one person in all documents.
Letters stay letters of the same case, digits stay digits and separators stay; names
get names of the same gender and script. A surrogate that another entity has, or that
is itself an entity of the corpus, is drawn again, so different entities stay
different and no real one is brought in.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise

# Titles by which names and their gender are found.
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("m", "cyrillic"): ["Господин"],
    ("f", "cyrillic"): ["Госпожа"],
}
# Given names, and syllables of which family names are made.
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar"],
    ("f", "latin"): ["Ada", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег", "Павел"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
}
SYLLABLES = {
    "latin": ["bar", "cor", "dan", "fel", "gar", "hol", "kin", "lam", "mar", "nor", "pel", "ran", "sol", "tam", "ver", "wil"],
    "cyrillic": ["бар", "вол", "гор", "дан", "кор", "лан", "мар", "нов", "пол", "рам", "сол", "тар", "фел", "хол", "чер", "шар"],
}
_NAME = r"[ \x{A0}](?:\p{Lu}[\p{L}'’-]+)(?: \p{Lu}[\p{L}'’-]+)?"
# The kinds of entity; of two that start in one place the first is taken.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<=\b(?i:password|token|secret|api_key)[ ]{0,2}[=:][ ]{0,2}\"?)[A-Za-z0-9+/_-]{8,}",
    "card": r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d.]\d|\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
} | {
    f"name {gender} {script}": r"(?<!\p{L})(?:" + "|".join(titles) + r")\.?" + _NAME
    for (gender, script), titles in TITLES.items()
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
UNIT = r"[\p{L}\p{N}]"
# Draws in vain after which a surrogate gets one character more, as its format may be used up.
DRAWS_A_LENGTH = 12
# Every entity holds one of these; a text without any needs no further search.
SIGNS = [*(title for titles in TITLES.values() for title in titles), "AKIA"]
# Or one of these, in any case.
KEYWORDS = ["password", "token", "secret", "api_key"]


def kind(surface: Column) -> Column:
    """The type of an entity that ``ENTITY`` found."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        # A secret's look-behind has nothing to look at here.
        whole = r"AKIA[0-9A-Z]{16}" if name == "secret" else pattern
        found = F.when(surface.rlike(rf"^(?:{whole})$"), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit("secret"))


def canonical(surface: Column, of_kind: Column) -> Column:
    """What forms of one entity share: letters in lower case and digits; of a name all but the title,
    with the blank that tells a given name and a family name from one word."""
    titled = F.regexp_replace(surface, r"^\p{L}+\.?[ \x{A0}]", "")
    plain = F.when(of_kind.startswith("name"), titled).otherwise(surface)
    # Dots tell addresses apart.
    kept = F.when(of_kind.isin("ip", "email"), F.lower(plain)).when(
        of_kind.startswith("name"), F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N} ]", "")
    )
    return F.coalesce(kept, F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]", ""))


def _draw(key: str, salt: Column, attempt: Column, place: Column, below: Column) -> Column:
    """A keyed number from 0 for one place of one entity."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), salt, attempt.cast("string"), place.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), below)


def _picked(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _like(c: Column, number: Column) -> Column:
    """A letter or digit like ``c``: same case, same script, digits for digits; else ``c``."""

    out = c
    for first, last in (("а", "я"), ("А", "Я"), ("α", "ω"), ("a", "z"), ("A", "Z"), ("0", "9")):
        size = ord(last) - ord(first) + 1
        drawn = F.substring(
            F.lit("".join(map(chr, range(ord(first), ord(last) + 1)))), (F.pmod(number, F.lit(size)) + 1).cast("int"), F.lit(1)
        )
        out = F.when((c >= first) & (c <= last), drawn).otherwise(out)
    return out


def _with_card_digit(digits: Column) -> Column:
    """The card number with a last digit that fits the others (every second one is doubled)."""

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    places = F.sequence(F.lit(1), F.lit(15))
    total = F.aggregate(F.transform(places, part), F.lit(0), lambda z, x: z + x)
    return F.concat(F.substring(digits, 1, 15), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _with_check_digits(account: Column) -> Column:
    """The account number (country, two digits, the rest) with digits that make its remainder by 97 right."""
    rest, country = F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 2)
    turned = F.split(F.concat(rest, country, F.lit("00")), "")

    def onwards(z: Column, c: Column) -> Column:
        letter = (c >= "a") & (c <= "z")
        # Letters count from 10 on, as two digits.
        return F.when(letter, (z * 100 + F.ascii(c) - 87) % 97).when(c != "", (z * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(z)

    remainder = F.aggregate(turned, F.lit(0), lambda z, c: F.coalesce(onwards(z, c).cast("int"), z))
    return F.concat(country, F.lpad((98 - remainder).cast("string"), 2, "0"), rest)


def _address(canon: Column, attempt: Column, at) -> Column:
    """An address of the same private network, if it is one, or any; in vain ones go on to a larger network."""
    net = F.regexp_extract(canon, r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 0)
    net = F.when(net == "", net).when(attempt >= 2 * DRAWS_A_LENGTH, "").when(attempt >= DRAWS_A_LENGTH, "10.").otherwise(net)
    left = F.when(net == "", 4).when(net.rlike(r"\..+\.$"), 2).otherwise(3)
    octets = F.transform(F.sequence(F.lit(1), left), lambda i: (at(i, 254) + 1).cast("string"))
    return F.concat(net, F.array_join(octets, "."))


def _surrogate(key: str, of_kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate of ``canon``."""
    salt = F.concat_ws("|", of_kind, canon)

    def at(place, below: int = 1_000_003) -> Column:
        return _draw(key, salt, attempt, F.lit(place) if not isinstance(place, Column) else place, F.lit(below))

    # Characters of the domain's last part and of separators stay, as do a card's first digit
    # and an account's country.
    ending = F.when(of_kind == "email", F.length(F.substring_index(canon, ".", -1)) + 1).otherwise(F.lit(0))
    kept = F.when(of_kind.isin("card", "phone"), 1).when(of_kind == "iban", 2).when((of_kind == "secret") & canon.startswith("akia"), 4).otherwise(0)
    # What is written in hexadecimal digits stays so.
    hexadecimal = (of_kind == "secret") & canon.rlike("^[0-9a-f]+$")

    def drawn_at(i: Column) -> Column:
        c, number = F.substring(canon, i, F.lit(1)), at(i)
        letter = F.substring(F.lit("abcdef"), (F.pmod(number, F.lit(6)) + 1).cast("int"), F.lit(1))
        return F.when(hexadecimal & (c >= "a"), letter).otherwise(_like(c, number))

    # Longer ones begin with further characters like the first.
    longer = F.floor(attempt / DRAWS_A_LENGTH).cast("int")
    first = F.substring(canon, 1, 1)
    ahead = F.when(
        longer > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: _like(first, at(-i))), "")
    ).otherwise("")
    places = F.sequence(F.lit(1), F.length(canon))
    drawn = F.array_join(
        F.transform(
            places,
            lambda i: F.when((i <= kept) | (i > F.length(canon) - ending), F.substring(canon, i, F.lit(1))).otherwise(
                drawn_at(i)
            ),
        ),
        "",
    )
    drawn = F.when(of_kind == "card", _with_card_digit(drawn)).when(of_kind == "iban", _with_check_digits(drawn)).otherwise(drawn)
    found = F.when(of_kind == "ip", _address(canon, attempt, at)).otherwise(F.concat(ahead, drawn))
    for (gender, script), given in GIVEN.items():
        syllables = SYLLABLES[script]
        # Every fourth draw in vain makes family names longer, so names never run out.
        family = F.array_join(
            F.transform(F.sequence(F.lit(1), F.lit(3) + F.floor(attempt / 4).cast("int")), lambda i: _picked(syllables, at(i))), ""
        )
        # A name of one word after the title is a family name.
        before = F.when(canon.contains(" "), F.concat(_picked(given, at(0)), F.lit(" "))).otherwise("")
        found = F.when(of_kind == f"name {gender} {script}", F.concat(before, F.initcap(family))).otherwise(found)
    return found


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``surrogate`` of every entity, all surrogates of a kind different.

    ``entities`` has distinct ``kind`` and ``canon``. Entities whose surrogate is
    taken, or is an entity itself, draw again; the least of those that draw the
    same keeps it. Where a format is used up, surrogates get longer. Names of all genders and scripts count as one kind here. A
    surrogate is what is shown, so for a name of one word the family name alone.
    """
    pending = materialise(entities.withColumn("attempt", F.lit(0)), "entities")
    alike = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    originals = pending.select(alike.alias("alike"), F.lower("canon").alias("form"))
    given = None
    while not pending.isEmpty():
        drawn = pending.withColumn(
            "surrogate", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
        ).withColumns({"alike": alike, "form": F.lower("surrogate")})
        drawn = materialise(drawn, "surrogates")
        winners = drawn.groupBy("alike", "form").agg(F.min(F.struct("kind", "canon")).alias("first"))
        winners = winners.select("alike", "form", "first.*")
        won = drawn.join(winners, ["alike", "form", "kind", "canon"], "left_semi").join(originals, ["alike", "form"], "left_anti")
        if given is not None:
            won = won.join(given, ["alike", "form"], "left_anti")
        won = materialise(won.select("kind", "canon", "surrogate", "alike", "form"), "surrogates")
        pending = materialise(
            pending.join(won, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "entities"
        )
        given = won if given is None else given.unionByName(won)
    empty = entities.select("kind", "canon", F.col("canon").alias("surrogate")).limit(0)
    return empty if given is None else given.drop("alike", "form")


def rendered(surface: Column, of_kind: Column, surrogate: Column) -> Column:
    """The surrogate in the form of ``surface``: its separators, its cases, its title.

    Characters that a longer surrogate has more come first.
    """
    title = F.regexp_extract(surface, r"^\p{L}+\.?[ \x{A0}]", 0)
    name = F.concat(title, surrogate)
    letters = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    more = F.length(letters) - F.length(F.regexp_replace(surface, r"[^\p{L}\p{N}]", ""))
    places = F.sequence(F.lit(1), F.length(surface))

    def one(i: Column) -> Column:
        c = F.substring(surface, i, F.lit(1))
        n = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        new = F.substring(letters, n + more, F.lit(1))
        new = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)
        return F.when(c.rlike(UNIT), new).otherwise(c)

    plain = F.concat(F.substring(letters, F.lit(1), more), F.array_join(F.transform(places, one), ""))
    return F.when(of_kind == "ip", surrogate).when(of_kind.startswith("name"), name).otherwise(plain)


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``df`` with surrogates in ``text_col``, and ``n_entities int``.

    Null and empty texts, and texts without an entity, stay as they are, with 0
    entities. Repeated rows come out as often as they went in and alike. A column
    of ``df`` named ``n_entities`` is replaced.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    signs = text.rlike("[0-9@]")
    for sign in SIGNS:
        signs = signs | text.contains(sign)
    for keyword in KEYWORDS:
        signs = signs | F.lower(text).contains(keyword)
    has = F.coalesce(signs & text.rlike(ENTITY), F.lit(False))
    plain = df.where(~has).withColumn("n_entities", F.lit(0))
    # Few texts hold an entity; only these are written, dealt and joined. Their columns
    # travel as one, so that none of their names can clash.
    row, name = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.sha2(F.to_json(F.struct(F.col(id_col), text)), 256)
    held = df.where(has).select(row.alias("row"), text.alias("text"), found.alias("found"), name.alias("name"))
    held = materialise(held, "held-texts")
    each = held.select("name", F.posexplode("found").alias("place", "surface"))
    surfaces = each.select("surface").distinct().withColumn("kind", kind(F.col("surface")))
    surfaces = materialise(surfaces.withColumn("canon", canonical(F.col("surface"), F.col("kind"))), "surfaces")
    made = surrogates(surfaces.select("kind", "canon").distinct(), key)
    shown = surfaces.join(made, ["kind", "canon"]).select(
        "surface", rendered(F.col("surface"), F.col("kind"), F.col("surrogate")).alias("shown")
    )
    new = (
        each.join(shown, "surface")
        .groupBy("name")
        .agg(F.sort_array(F.collect_set(F.struct("place", "shown"))).alias("shown"))
    )
    between = F.split(F.col("text"), ENTITY, -1)
    whole = F.array_join(
        F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(F.col("shown"), i)["shown"], F.lit("")))), ""
    )
    changed = {text_col: whole, "n_entities": F.size("found")}
    columns = [changed.get(c, F.col("row")[c]).alias(c) for c in plain.columns]
    return plain.unionByName(held.join(new, "name").select(columns))

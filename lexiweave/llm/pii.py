"""Surrogates for personal data, in DataFrame functions only.

Each detected entity is reduced to parts (kind, key): the key is the value without what formatting
may vary, so mentions of one entity share it. Every distinct part gets a keyed surrogate of its
kind (same length, letter case, script, separators; names keep gender and script), candidates are
checked against each other and against all original keys, and losers draw again: surrogates stay
distinct wherever originals are, and equal wherever they are equal, over the whole corpus. A word of a
name has one surrogate whatever title, place or gender a mention gives it.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, stable

# Titles that announce a name, by the gender they carry.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
# Given names to draw from, by script and gender.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irina", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dominique", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Nicola", "Pat", "Robin", "Sam", "Sasha", "Taylor", "Toni"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Максим"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Ольга"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Тоня", "Лёша"],
    ("greek", "m"): ["Άρης", "Γιώργος", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"],
    ("greek", "n"): ["Αλέξη", "Βίκυ", "Γωγώ", "Ντίνα", "Πόπη", "Ρένα", "Σάκη", "Τάσο"],
}
# Syllables for family names, and endings for given names past the lists.
SYLLABLES = {
    "latin": ["ba", "ber", "dor", "fel", "gan", "hol", "jor", "kel", "lan", "mar", "nov", "per", "ros", "sal", "tor", "vel"],
    "cyrillic": ["ба", "бер", "дор", "вел", "ган", "хол", "жор", "кел", "лан", "мар", "нов", "пер", "рос", "сал", "тор", "фел"],
    "greek": ["βα", "βερ", "δορ", "φελ", "γαν", "χολ", "ζορ", "κελ", "λαν", "μαρ", "νοβ", "περ", "ροσ", "σαλ", "τορ", "ξελ"],
}
ENDINGS = {("latin", "m"): "o", ("latin", "f"): "a", ("latin", "n"): "i", ("cyrillic", "m"): "ий", ("cyrillic", "f"): "ия", ("cyrillic", "n"): "и", ("greek", "m"): "ος", ("greek", "f"): "α", ("greek", "n"): "ι"}

_ALL_TITLES = [t for ts in TITLES.values() for t in ts]
_LOUD_TITLES = [t.upper() for t in _ALL_TITLES]
_AFTER_TITLE = r")(?:\.\s{0,3}|\s{1,3})"
_TITLE = r"(?<!\p{L})(?:" + "|".join(_ALL_TITLES + _LOUD_TITLES) + _AFTER_TITLE
_LOUD_TITLE = r"(?<!\p{L})(?:" + "|".join(_LOUD_TITLES) + _AFTER_TITLE
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key) {0,2}[=:] {0,2}[\"']?"
#: What may follow a secret without being part of it.
_AFTER = r"""\s"'`.,;:!?)\]}>"""
# A word of a name: letters, with apostrophes and hyphens inside; a possessive s is left out.
_NAME = r"\p{Lu}(?:\p{L}+|(?=['’-]\p{L}))(?:['’-](?!s(?!\p{L}))\p{L}+)*+"
# Small words inside family names.
PARTICLES = ["van", "von", "der", "den", "de", "da", "di", "du", "del", "la", "le", "dos", "bin", "al", "zu", "ten"]
_INITIALS = r"(?:\p{Lu}\. ?)"
_GAP = r"[ \t]{1,3}"
_MORE_NAME = rf"(?:{_GAP}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_INITIALS}{{0,3}}{_NAME})*+"
# After a title in capitals a name in capitals has three words at most, for all words of such a text may have them.
_LOUD_WORD = r"\p{Lu}{2,}(?:['’-](?!S(?!\p{L}))\p{Lu}+)*+(?!\p{L})"
_LOUD_NAME = rf"{_INITIALS}{{0,3}}{_LOUD_WORD}(?:{_GAP}{_LOUD_WORD}){{0,2}}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]"

# Kind and pattern of each entity; where two could start at one place, the earlier wins. Each starts with what makes
# most places of a text fail at once; titles and keywords belong to the match.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("secret", r"A(?<![A-Za-z0-9]A)KIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", rf"""(?=[PpSsTtAa]){_KEYWORD}(?=[^\s"'`]{{8}})[^\s"'`]*[^{_AFTER}]"""),
    ("iban", r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", rf"(?=\d)(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    (
        "ipv6",
        rf"(?={_HEX})(?<![\p{{L}}\d:.])(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?:{_HEX}{{1,4}}:){{2,6}}(?::{_HEX}{{1,4}}){{1,5}}|(?i:fe80|f[cd]{_HEX}{{2}}|[23]{_HEX}{{3}}):(?::{_HEX}{{1,4}}){{1,6}})(?![\p{{L}}\d:])",
    ),
    (
        "phone",
        r"\+(?<![\d+]\+)\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|\((?<!\d\()\d{3}\) ?\d{3}-\d{4}(?!\d)"
        r"|0(?<![\d.+-]0)0[1-9]\d{0,2}[ .-](?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?=\d)(?<![\p{L}\d.+-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-]|\.\d)",
    ),
    ("card", r"[3-6](?<![\d+.-][3-6])\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])"),
    ("ssn", r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("name", rf"(?=[{''.join(sorted({t[0] for t in _ALL_TITLES}))}])(?:{_LOUD_TITLE}{_LOUD_NAME}|{_TITLE}{_INITIALS}{{0,3}}{_NAME}{_MORE_NAME})"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What any match has, cheap to look for: a digit, an at sign, a keyword's sign, a key's head or a title.
_HINT = rf"[0-9@=]|AKIA|::|(?i:password|passwd|secret|token|api_?key) {{0,2}}:|(?:{'|'.join(_ALL_TITLES + _LOUD_TITLES)})(?:\.|\s)\s{{0,3}}\p{{Lu}}"
#: What stands before the value inside a match.
_BEFORE = rf"""^(?:{_KEYWORD}(?=[^\s"'`]{{8}})|{_TITLE}(?=\p{{Lu}}))"""

_COMPACT = ("iban", "phone", "card", "ssn")
#: Draws in the entity's own form; later ones are longer by a character for each further draw.
OWN_FORM = 8
#: Values drawn in one task.
DRAWS = 4096


def _kind_of(value: Column, after_title: Column) -> Column:
    """The kind of a match, from its own form; a name is what follows a title."""
    return (
        F.when(after_title & value.rlike(r"^\p{Lu}[^\d]*$"), "name")
        .when(value.contains("@"), "email")
        .when(value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(value.rlike(rf"^{_HEX}*:[0-9A-Fa-f:]+$"), "ipv6")
        .when(value.rlike(r"^\+|^\(|^00[1-9][^a-z]*$|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$"), "card")
        .otherwise("secret")
    )


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).try_cast("int")


def _like(value: Column, seed: Column, fixed: Column) -> Column:
    """Each letter or digit of value past `fixed` characters replaced by one of its class, 32 characters a keyed SHA-256."""
    hexes = value.rlike("^(?=.*[a-f])[0-9a-f]{8,}$|^[0-9a-f]*:[0-9a-f:]+$")

    def block(j: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", seed, j.cast("string")), 256)

        def one(c: Column, i: Column) -> Column:
            b = _byte(digest, i)
            pick = lambda s: F.substring(F.lit(s), b % len(s) + 1, F.lit(1))
            return (
                F.when(i + j * 32 < fixed, c)
                .when(c.rlike("[0-9a-f]") & hexes, pick("0123456789abcdef"))
                .when(c.rlike("[0-9]"), pick("0123456789"))
                .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike(r"\p{N}"), pick("0123456789"))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(F.substring(value, j * 32 + 1, F.lit(32)), ""), one), "")

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(value) - 1, F.lit(0)) / 32).try_cast("int"))
    return F.array_join(F.transform(blocks, block), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits; 0 modulo 10 for a valid one."""
    n = F.length(digits)
    terms = F.transform(
        F.split(digits, ""),
        lambda c, i: F.when((n - i) % 2 == 0, F.when(c.try_cast("int") * 2 > 9, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)).otherwise(c.try_cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The IBAN remainder of a compact value: 1 for a valid one."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    number = lambda c: F.conv(c, 36, 10).try_cast("int")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(number(c) > 9, (a * 100 + number(c)) % 97).otherwise((a * 10 + number(c)) % 97))


def _pick(values: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), b % len(values) + 1)


def candidate(kind: Column, key: Column, role: Column, attempt: Column, secret: str) -> Column:
    """The surrogate that the keyed hash draws for (kind, key) at this attempt; role is m, f, n or family for a name."""
    seed = F.concat_ws("|", F.lit(secret), kind, key, attempt.cast("string"))
    digest = F.sha2(seed, 256)
    # Past the draws of its own form the value grows, so that no form runs out.
    more = F.substring(F.translate(F.sha2(F.concat_ws("|", seed, F.lit("more")), 256), "abcdef", "012345"), F.lit(1), F.greatest(attempt - (OWN_FORM - 1), F.lit(0)))
    free = F.concat(_like(key, seed, F.when(key.rlike("^AKIA[0-9A-Z]{16}$"), 4).when(kind == "ipv6", 1).otherwise(0)), more)
    octets = F.array_join(F.array(*((_byte(digest, F.lit(i)) % (223 if not i else 254) + 1).cast("string") for i in range(4))), ".")
    local = F.concat(_like(F.substring_index(key, "@", 1), seed, F.lit(0)), more)
    host = _like(F.regexp_replace(F.substring_index(key, "@", -1), r"\.[^.]+$", ""), F.concat(seed, F.lit("|host")), F.lit(0))
    email = F.concat(local, F.lit("@"), host, F.lit("."), F.substring_index(key, ".", -1))
    number = _like(key, seed, F.when(kind == "card", 1).otherwise(0))
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(F.when(_luhn(key) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(number), more)
    # A phone keeps its country code: the key has "+code|rest".
    rest = _like(F.substring_index(key, "|", -1), seed, F.lit(0))
    rest = F.concat((_byte(digest, F.lit(0)) % 8 + 2).cast("string"), F.substring(rest, 2, 32), more)
    phone = F.concat(F.substring_index(key, "|", 1), F.lit("|"), rest)
    account = _like(key, seed, F.lit(4))
    blank = F.concat(F.substring(account, 1, 2), F.lit("00"), F.substring(account, 5, 64))
    iban = F.when(_mod97(key) == 1, F.concat(F.substring(account, 1, 2), F.lpad((98 - _mod97(blank)).cast("string"), 2, "0"), F.substring(account, 5, 64))).otherwise(account)
    script = F.element_at(F.split(kind, ":"), -1)

    def made(script: str) -> Column:
        syllable = lambda i: _pick(SYLLABLES[script], _byte(digest, F.lit(i)))
        further = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(SYLLABLES[script], _byte(digest, i % 28 + 2))), "")
        return F.initcap(F.concat(syllable(0), syllable(1), further))

    given = reduce(
        lambda a, sg: a.when(
            (script == sg[0]) & (role == sg[1]),
            F.when(attempt < 3, _pick(GIVEN[sg], _byte(digest, F.lit(0)))).otherwise(F.concat(made(sg[0]), F.lit(ENDINGS[sg]))),
        ),
        GIVEN,
        F.when(F.lit(False), ""),
    )
    family = reduce(lambda a, s: a.when(script == s, made(s)), SYLLABLES, F.when(F.lit(False), ""))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when(kind == "ssn", F.concat(number, more))
        .when(kind.startswith("name:"), F.when(role == "family", family).otherwise(given))
        .otherwise(free)
    )


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """df over as many tasks as its draws ask for; an exchange that is small in bytes would end in one task."""
    most = 8 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(most, -(-rows // DRAWS)), "kind", "key")


def surrogates(entities: DataFrame, secret: str, max_rounds: int = 64) -> DataFrame:
    """(kind, key, surrogate) for distinct (kind, key): one to one in each class of kinds, and never an original.

    entities: (kind, key, role), role being given:m, given:f, given:n or family for kinds name:<script>, and ignored
    for others, one row a mention. A word that more mentions have as a given name than as a family name is one, of the gender
    that those mentions agree on, else of none. In each round the undecided draw; a drawn value goes to its smallest key unless it is taken or is itself
    an original key, and the others draw again, after OWN_FORM draws in a longer form (but for IBANs and IP addresses,
    whose form is fixed). Names are one class, whatever their script and place, and are compared in lower case, as
    their keys are. Work per round is a few joins on the undecided. An error says that a fixed form has run out.
    """
    is_name = F.col("kind").startswith("name:")
    space = F.when(is_name, "name").otherwise(F.col("kind"))
    form = F.when(F.col("space") == "name", F.lower("surrogate")).otherwise(F.col("surrogate")).alias("form")
    has = lambda r: F.count_if(F.col("role") == r)
    m, f, n = has("given:m"), has("given:f"), has("given:n")
    given = m + f + n > has("family")
    role = F.when(given & (m > 0) & (f == 0), "m").when(given & (f > 0) & (m == 0), "f").when(given, "n").otherwise("family")
    todo = stable(entities.groupBy("kind", "key").agg(role.alias("role")).withColumn("space", space).withColumn("attempt", F.lit(0)))
    originals = todo.select("space", F.col("key").alias("form")).distinct()
    done, rows = [], todo.count()
    for _ in range(max_rounds):
        if not rows:
            break
        drawn = _dealt(todo, rows).withColumn("surrogate", candidate(F.col("kind"), F.col("key"), F.col("role"), F.col("attempt"), secret))
        fresh = drawn.withColumn("form", form).join(originals, ["space", "form"], "left_anti")
        for earlier in done:
            fresh = fresh.join(earlier.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = fresh.groupBy("space", "surrogate").agg(F.min(F.struct("key", "kind")).alias("w")).select("space", F.col("w.kind").alias("kind"), F.col("w.key").alias("key"), "surrogate")
        won = stable(won)
        done.append(won)  # a round's rows are written once
        todo = stable(todo.join(won, ["kind", "key"], "left_anti").withColumn("attempt", F.col("attempt") + 1).select("kind", "key", "role", "space", "attempt"))
        rows = todo.count()
    if rows:
        raise RuntimeError(f"no distinct surrogates within {max_rounds} draws: a fixed form has too few values")
    if not done:
        return todo.select("kind", "key", F.lit("").alias("surrogate"))
    return reduce(DataFrame.unionByName, done).select("kind", "key", "surrogate")


def _with_surrogates(mentions: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """mentions with the surrogate of their (kind, key).

    A key with more than its share of the rows, as an address that stands in a third of all texts, is not an exchange's key: there are
    at most 4 such keys for each shuffle partition, so these are broadcast and the others joined.
    """
    most = 4 * max(1, int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(1000, rows // most)
    hot = stable(mentions.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("kind", "key"))
    if hot.isEmpty():
        return mentions.join(known, ["kind", "key"])
    few, many = known.join(F.broadcast(hot), ["kind", "key"]), mentions.join(F.broadcast(hot), ["kind", "key"], "left_anti")
    return mentions.join(F.broadcast(few), ["kind", "key"]).unionByName(many.join(known, ["kind", "key"]))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(kind: Column, value: Column, title: Column) -> Column:
    """array<struct<kind, key, role, value, tail>>: one for each word of a name, hyphens part words, else one; tail follows the part."""
    loud = F.upper(title)
    of = lambda g: loud.isin([t.upper() for t in TITLES[g]])
    gender = F.when(of("m"), "m").when(of("f"), "f").otherwise("n")
    tokens = F.regexp_extract_all(value, F.lit(r"[^\s-]+[\s-]*"), F.lit(0))
    part = lambda k, v, r, m, t: F.struct(k.alias("kind"), v.alias("key"), r.alias("role"), m.alias("value"), t.alias("tail"))

    def word(t: Column, i: Column) -> Column:
        own = F.regexp_extract(t, r"^[^\s-]+", 0)
        more = F.exists(F.slice(tokens, i + 1, F.size(tokens)), lambda x: x.rlike(r"\s"))
        role = F.when(more, F.concat(F.lit("given:"), gender)).otherwise("family")
        kept = own.isin(PARTICLES) | ~own.rlike(r"\p{L}")
        sort = F.when(kept, "keep").when(own.rlike(r"^(?:\p{Lu}\.)+$"), "initial").otherwise(F.concat(F.lit("name:"), _script(own)))
        return part(sort, F.lower(own), role, own, F.substring(t, F.length(own) + 1, F.length(t)))

    bare = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    dialled = F.regexp_replace(value, "^00", "+")
    code = F.regexp_extract(dialled, r"^\+\d{1,3}?(?=[ .(-])|^\+\d", 0)
    key = (
        F.when(kind.isin("email", "ipv6"), F.lower(value))
        .when(kind == "phone", F.concat(code, F.lit("|"), F.regexp_replace(F.substring(dialled, F.length(code) + 1, F.lit(64)), r"\D", "")))
        .when(kind.isin("iban", "card", "ssn"), bare)
        .otherwise(value)
    )
    return F.when(kind == "name", F.transform(tokens, word)).otherwise(F.array(part(kind, key, F.lit(None).cast("string"), value, F.lit(""))))


def _render(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the form of this mention: its separators and its letter case."""
    chars = F.split(value, "")
    digits = F.regexp_replace(surrogate, r"[+|]", "")
    compact = F.when(kind == "phone", F.when(value.startswith("00"), F.concat(F.lit("00"), digits)).otherwise(digits)).otherwise(surrogate)
    places = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    spread = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(compact, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)), ""
    )
    spread = F.concat(spread, F.substring(compact, places + 1, F.length(compact)))
    # An email's local part may have grown: the letter case is that of its first characters and of its host.
    grown = F.length(surrogate) - F.length(value)
    local = F.length(F.substring_index(value, "@", 1))
    under = F.concat(F.substring(value, F.lit(1), local), F.repeat(F.lit("0"), grown), F.substring(value, local + 1, F.length(value)))
    cased = F.array_join(F.transform(F.split(under, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    shout = (F.upper(value) == value) & (F.length(value) > 1)
    return (
        F.when(kind == "email", cased)
        .when(kind.isin(*_COMPACT), spread)
        .when(kind.startswith("name:") | (kind == "ipv6"), F.when(shout, F.upper(surrogate)).otherwise(surrogate))
        .otherwise(surrogate)
    )


def _other_initials(value: Column, secret: str) -> Column:
    """Each Latin capital of a run of initials moved on by a keyed number of letters, 1 to 25; others become X."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("initial"), value), 256), 1, 4), 16, 10).try_cast("int") % 25 + 1
    at = lambda c: F.instr(F.lit(letters), c)
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c == ".", c).when(at(c) > 0, F.substring(F.lit(letters), (at(c) - 1 + by) % 26 + 1, F.lit(1))).otherwise("X")), "")


#: The session's setting that holds the key of surrogates.
KEY_SETTING = "spark.lexiweave.surrogateKey"


def session_key(spark: SparkSession) -> str:
    """The key that the session is configured with; without one, a random key that is drawn once and holds for this session alone."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymize(docs: DataFrame, secret: str, text_col: str = "text", count_col: str = "n_entities", kinds_col: str = "entity_kinds") -> DataFrame:
    """docs with surrogates in text_col, and columns count_col (int) and kinds_col (string, sorted, comma-joined) of what was found.

    Who knows `secret` can try out originals, so it is a parameter without a default: keep it as one keeps a password (`session_key` takes it from the session).
    A name is what follows one of TITLES, also in capitals: any number of capitalised words, with initials and particles between
    them; names without a title are not seen, but where one of the same text has its words. A name keeps what follows
    it, a possessive s or a quote, and its hyphens part words. A secret reaches to white space or a quote.
    Texts without
    entities pass through as they are and are not shuffled. Null text stays null with no entities; so does a row
    with null id. Rows with equal id and text change equally and come out once each. Other columns are kept, whatever their names,
    but one named as count_col or kinds_col is replaced; an empty table gives an empty result.
    """
    docs = docs.drop(count_col, kinds_col)
    k, th, found_col, txt = "__lw_k", "__lw_th", "__lw_found", F.col(text_col)
    has = F.coalesce(txt.rlike(_HINT) & txt.rlike(ENTITY), F.lit(False))
    names = docs.columns
    plain = docs.where(~has).select(*(F.col(c) for c in names), F.lit(0).alias(count_col), F.lit("").alias(kinds_col))
    idc = id_key("doc_id") if "doc_id" in names else F.lit(0).cast("long")
    # Texts with entities are settled with their matches, so that all later steps search nothing again.
    every = F.when(txt.rlike(_HINT), F.regexp_extract_all(txt, F.lit(ENTITY), F.lit(0)))
    hit = stable(docs.withColumns({k: idc, th: F.xxhash64(txt), found_col: every}).where(F.size(found_col) > 0))
    found = hit.select(k, th, F.posexplode(found_col).alias("pos", "match"))
    found = found.distinct().withColumn("before", F.regexp_extract("match", _BEFORE, 0)).withColumn("value", F.substring("match", F.length("before") + 1, F.length("match")))
    titled = F.col("before").rlike(rf"^{_TITLE}$")
    found = found.withColumn("title", F.when(titled, F.regexp_extract("before", r"^\p{L}+", 0)).otherwise(""))
    found = found.withColumn("kind", F.when(~titled & (F.col("before") != ""), "secret").otherwise(_kind_of(F.col("value"), titled)))
    pieces = found.select(k, th, "pos", F.col("kind").alias("label"), "before", F.posexplode(_parts(F.col("kind"), F.col("value"), F.col("title"))).alias("sub", "part"))
    pieces = stable(pieces.select(k, th, "pos", "sub", "before", "label", "part.*"))
    drawn = ~F.col("kind").isin("keep", "initial")
    mentions = pieces.where(drawn)
    known = surrogates(mentions.select("kind", "key", "role"), secret)
    rendered = _with_surrogates(mentions, known, pieces.count()).withColumn("new", _render(F.col("kind"), F.col("value"), F.col("surrogate"))).drop("surrogate")
    kept = F.when(F.col("kind") == "keep", F.col("value")).otherwise(_other_initials(F.col("value"), secret))
    rendered = rendered.unionByName(pieces.where(~drawn).withColumn("new", kept))
    mention = F.struct("value", "new")
    shouted = F.struct(F.upper("value").alias("value"), F.upper("new").alias("new"))
    whole = rendered.groupBy(k, th, "pos", "label", "before").agg(
        F.concat("before", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "new", "tail"))), lambda x: F.concat(x["new"], x["tail"])), "")).alias("new"),
        F.flatten(F.collect_list(F.when(F.col("kind").startswith("name:"), F.array(mention, shouted)))).alias("names"),
    )
    lists = whole.groupBy(k, th).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("__lw_new"),
        F.count(F.lit(1)).try_cast("int").alias("__lw_n"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("__lw_kinds"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("__lw_names"),
    )
    # Bare mentions of a name found in the same text take the same surrogate; no surrogate is an original, so none is replaced again.
    spread = lambda g: F.aggregate(
        "__lw_names", g, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["value"], F.lit(r"\E(?![\p{L}\p{N}])")), n["new"])
    )
    gaps = F.split(txt, ENTITY, -1)
    pieces_of = F.transform(gaps, lambda g, i: F.concat(F.when(F.size("__lw_names") > 0, spread(g)).otherwise(g), F.coalesce(F.get("__lw_new", i), F.lit(""))))
    changed = hit.join(lists, [k, th]).withColumn(text_col, F.array_join(pieces_of, ""))
    return plain.unionByName(changed.select(*names, F.col("__lw_n").alias(count_col), F.col("__lw_kinds").alias(kinds_col)))

"""Personal data replaced by surrogates, in DataFrame operations only.

Detected entities get keyed replacements of their own kind: a digit for a
digit, a letter of the same script and case for a letter, a given name of the
same gender, a card or account number whose checksum holds or fails as before.
The replacement hangs on the entity's normal form, so all its mentions, however
written, change alike (coreference). A person is a given name and a surname,
replaced each by itself: "Paul Smith" and "Mr Smith" keep their surname in
common. Distinct entities keep distinct replacements, and none equals an entity
of the corpus: what clashes is drawn again, and after some draws from a wider
form, until a check over the whole corpus finds no clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, stored

# Forms of address and the gender they carry.
MALE_TITLES = "Mr|Herr|Señor|Monsieur|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Señora|Madame|Госпожа"
NEUTRAL_TITLES = "Dr|Prof|Professor|Doctor|Доктор"
# Given names that are found, and that replace given names, by gender and script.
GIVEN = {
    ("m", "latin"): "adam alexander andreas anthony antonio bruno carl carlos charles daniel david edward emil felix frank francisco franz georg george hans heinrich henry hugo ivan jack james jean john jonas jorge josé juan karl kevin lars louis luca luis manuel marco mark martin matthew max michael miguel nils oliver oscar pablo paul pedro peter philippe pierre rafael richard robert samuel stefan steven thomas tomas victor walter william".split(),
    ("f", "latin"): "alba alice amelia ana anna berta camille carmen catherine charlotte chloé clara claudia diana elena elizabeth emily emma flora greta hanna heidi helen ines ingrid irene isabel jane jennifer jessica julia karin katharina laura lena linda lisa lucia margaret maria marie martina monika nadia nancy nora olga olivia patricia paula petra rosa sabine sara sofia sophie susan teresa ursula vera victoria".split(),
    ("m", "cyrillic"): "александр алексей андрей антон борис виктор глеб денис дмитрий егор иван кирилл лев михаил николай олег павел пётр сергей юрий".split(),
    ("f", "cyrillic"): "алла анна вера галина дарья екатерина елена жанна зоя ирина лидия мария наталья нина ольга светлана татьяна юлия".split(),
}
LATIN, UPPER, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: (characters, what replaces one): letters in general, and vowels for vowels in names.
LETTERS = [("[a-zà-ÿĀ-ſ]", LATIN), ("[A-Z]", UPPER), ("[а-яё]", CYRILLIC), ("[α-ωά-ώ]", GREEK)]
NAME_LETTERS = [("[aeiouyà-æè-ïò-öø-ÿ]", "aeiou"), ("[a-zà-ÿĀ-ſ]", "bcdfghklmnprstvz"), ("[аеёиоуыэюя]", "аеиоу"), ("[а-яё]", "бвгдзклмнпрст"), ("[αεηιουωά-ώ]", "αειο"), ("[α-ω]", "βγδζθκλμνπρστφχ")]
# Calling codes of one and of two digits; all others have three.
CALLING = "^(1|7|2[07]|3[0-469]|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_WORD = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*"
_GIVEN = "|".join(n.capitalize() for names in GIVEN.values() for n in names)
_END = r"(?![\p{L}\p{N}])"
#: What must not stand before a mention.
EDGE = r"(?<![\p{L}\p{N}])"
#: (kind, pattern); where two could match at one place the earlier one does.
PATTERNS = [
    ("secret", rf"(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36}}){_END}"),
    ("iban", rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"),
    ("phone", rf"\+?[0-9]{{1,3}}[ .-]?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}{_END}"),
    ("phone", rf"\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[.-][0-9]{{4}}{_END}"),
    ("phone", rf"[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}{_END}"),
    ("phone", rf"(?:\+|00(?=[1-9]))(?=(?:[ .()/-]{{0,2}}[0-9]){{7}})[0-9]{{1,12}}(?:[ ./-]?\(?[0-9]{{1,12}}\)?){{0,6}}+{_END}"),
    ("phone", rf"0[1-9][0-9]{{1,4}}(?: ?/ ?|[ -])[0-9]{{3,4}}[ -]?[0-9]{{3,5}}{_END}"),
    ("card", rf"[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,7}}{_END}"),
    ("ssn", rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}"),
    ("ip", r"(?<!\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"),
    ("name", rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}}"),
    ("name", rf"(?:{_GIVEN})(?: {_WORD}){{1,2}}"),
]
_EMAIL = r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++\p{L}{2,}+"
REST = EDGE + "(?:" + "|".join(p for _, p in PATTERNS) + ")"
ANY = EDGE + "(?:" + "|".join([_EMAIL, *(p for _, p in PATTERNS)]) + ")"
#: Draws from an entity's own form; each one after them is from a wider form.
NARROW = 3


def mentions(text: Column) -> Column:
    """All mentions in the order of the text; texts without an @ are not searched for addresses."""
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains("@"), find(ANY)).otherwise(find(REST))


def kind_of(surface: Column) -> Column:
    out = F.lit("other")  # a mention without a kind would be lost from the text
    for kind, pattern in reversed([("email", _EMAIL), *PATTERNS]):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def parts_of(kind: Column, surface: Column) -> Column:
    """Array of (kind, norm, before, said): what a mention is made of, and the text that stands before each part.

    norm is what all mentions of an entity share: digits, without the 1 of a
    ten-digit number; lower case without spaces; a given name with its gender.
    """
    digits = F.regexp_replace(surface, "[^0-9]", "")
    abroad = F.when(surface.startswith("+"), digits).when(digits.startswith("00"), F.substr(digits, F.lit(3)))
    phone = F.when((F.length(F.coalesce(abroad, digits)) == 11) & F.coalesce(abroad, digits).startswith("1"), F.substr(F.coalesce(abroad, digits), F.lit(2)))
    phone = F.coalesce(phone, F.concat(F.lit("+"), abroad), digits)
    norm = (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "secret", surface)
        .otherwise(F.lower(F.replace(surface, F.lit(" "), F.lit(""))))
    )
    part = lambda k, n, before, said: F.struct(k.alias("kind"), n.alias("norm"), before.alias("before"), said.alias("said"))
    title = F.regexp_extract(surface, rf"^((?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.? )", 1)
    words = F.split(F.substr(surface, F.length(title) + 1), " ")
    titled = F.when(title.rlike(f"^({FEMALE_TITLES})[. ]"), "f").when(title.rlike(f"^({MALE_TITLES})[. ]"), "m")

    def gender(name: Column) -> Column:
        listed = F.lit(None).cast("string")
        for (g, _), names in GIVEN.items():
            listed = F.when(name.isin(names), g).otherwise(listed)
        return F.coalesce(listed, titled, F.when(name.rlike("[aая]$"), "f").otherwise("m"))

    def one(word: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        name = F.lower(word)
        return part(F.when(last, "surname").otherwise("given"), F.when(last, name).otherwise(F.concat(gender(name), F.lit(":"), name)), F.when(i == 0, title).otherwise(" "), word)

    return F.when(kind == "name", F.transform(words, one)).otherwise(F.array(part(kind, norm, F.lit(""), surface)))


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below ``n`` for place ``i``: three hex digits of a digest of 128."""
    return (F.conv(F.substr(digest, (i * 3) % 126 + 1, F.lit(3)), 16, 10).cast("int") % n).cast("int")


def _letter(alphabet: str, v: Column) -> Column:
    return F.substr(F.lit(alphabet), v + 1, F.lit(1))


def _redrawn(text: Column, digest: Column, keep, letters=LETTERS) -> Column:
    """Each digit and letter of ``text`` drawn again within its class, but where ``keep(place)`` holds."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for chars, alphabet in reversed(letters):
            out = F.when(c.rlike(chars), _letter(alphabet, _draw(digest, i, len(alphabet)))).otherwise(out)
        return F.when(keep(i), c).when(c.between("0", "9"), _draw(digest, i, 10).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _never(i: Column) -> Column:
    return F.lit(False)


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string, modulo ten."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """Remainder of a lower-case account number read with a = 10 to z = 35."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of a normal form, itself in normal form. Past NARROW attempts forms grow by a place each time."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)
    more = F.sha2(digest, 512)
    wide = F.greatest(attempt - NARROW + 1, F.lit(0))
    longer = F.substr(F.regexp_replace(F.concat(F.conv(F.substr(more, F.lit(1), F.lit(12)), 16, 10), F.conv(F.substr(more, F.lit(13), F.lit(12)), 16, 10)), "^[0-9]{3}", ""), F.lit(1), wide)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    host = _redrawn(host, F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512), _never)
    email = F.concat(_redrawn(local, digest, _never), longer, F.lit("@"), host, F.lit("."), F.substring_index(domain, ".", -1))
    body = F.concat(_redrawn(F.substr(norm, F.lit(1), F.length(norm) - 1), digest, lambda i: i == 0), longer)
    sound = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    last = F.when(_luhn(norm) == 0, sound).otherwise((sound + 1 + _draw(digest, F.lit(41), 9)) % 10)
    octets = F.split(norm, r"\.")
    private = F.when(norm.startswith("10."), 1).when(norm.startswith("192.168."), F.when(wide == 0, 2).otherwise(1)).otherwise(0)
    octet = lambda c, i: F.when(i < private, F.when((wide > 0) & (private == 1), "10").otherwise(c)).otherwise((_draw(digest, i, 254) + 1).cast("string"))
    ip = F.array_join(F.transform(octets, octet), ".")
    ip = F.when(wide < 3, ip).otherwise(F.concat_ws(":", F.concat(F.lit("fd"), F.substr(digest, F.lit(1), F.lit(2))), *(F.substr(digest, F.lit(3 + 4 * k), F.lit(4)) for k in range(7))))
    gender, name = F.substring_index(norm, ":", 1), F.substring_index(norm, ":", -1)
    script = F.when(name.rlike("[а-яё]"), "cyrillic").otherwise("latin")
    given = F.lit(None).cast("string")
    for (g, s), names in GIVEN.items():
        pool = F.array(*map(F.lit, names))
        # beyond the names themselves, names made of several
        made = F.array_join(F.transform(F.sequence(F.lit(0), wide), lambda k: F.get(pool, _draw(digest, k, len(names)))), "")  # noqa: B023
        given = F.when((gender == g) & (script == s), made).otherwise(given)
    ending = F.length(F.regexp_extract(norm, "(ова|ева|ина|ская|ский|ов|ев|ин)$", 1))
    stem = F.substr(norm, F.lit(1), F.length(norm) - ending)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1))), lambda k: F.when(norm.rlike("[а-яё]"), _letter("аеиоурстлн", _draw(more, k, 10))).otherwise(_letter("aeiourstln", _draw(more, k, 10)))), "")
    surname = F.concat(_redrawn(stem, digest, _never, NAME_LETTERS), F.when(wide > 0, letters).otherwise(""), F.substr(norm, F.length(norm) - ending + 1))
    country = F.when(norm.startswith("+"), F.length(F.regexp_extract(F.substr(norm, F.lit(2)), CALLING, 1)) + 1).otherwise(0)
    account = F.concat(_redrawn(F.substr(norm, F.lit(5)), digest, _never), longer)
    check = F.lit(98) - _mod97(F.concat(account, F.substr(norm, F.lit(1), F.lit(2)), F.lit("00")))
    valid = _mod97(F.concat(F.substr(norm, F.lit(5)), F.substr(norm, F.lit(1), F.lit(4)))) == 1
    check = F.when(valid, check).otherwise((check + 1 + _draw(digest, F.lit(41), 90)) % 97 + 2)
    secret = F.substr(digest, F.lit(1), F.length(norm))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", F.concat(body, last.cast("string")))
        .when(kind == "ip", ip)
        .when(kind == "phone", F.concat(_redrawn(norm, digest, lambda i: i < country), longer))
        .when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), account))
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), secret).when(norm.rlike("^[0-9A-F]+$"), F.upper(secret)).otherwise(_redrawn(norm, digest, lambda i: i < 4)))
        .when(kind == "given", F.concat(gender, F.lit(":"), given))
        .when(kind == "surname", surname)
        .otherwise(F.concat(_redrawn(norm, digest, _never), longer))
    )


def poured(kind: Column, norm: Column, said: Column, made: Column) -> Column:
    """``made`` written as the mention is: its separators, its case, what its normal form leaves out. What is longer goes on at the end."""
    of_digits = kind.isin("phone", "card", "ssn")
    made = F.when(kind == "given", F.substring_index(made, ":", -1)).when(kind == "phone", F.ltrim(made, F.lit("+"))).otherwise(made)
    extra = F.when(kind == "phone", F.length(F.regexp_replace(said, "[^0-9]", "")) - F.length(F.ltrim(norm, F.lit("+")))).otherwise(0)
    start = F.struct(F.lit("").alias("out"), (-extra).cast("int").alias("used"))

    def step(a: Column, c: Column) -> Column:
        fill = F.when(of_digits, c.between("0", "9")).otherwise(c != " ")
        put = F.substr(made, a["used"] + 1, F.lit(1))
        put = F.when(a["used"] < 0, c).when((c != F.lower(c)) & (kind != "secret"), F.upper(put)).otherwise(put)
        return F.struct(F.concat(a["out"], F.when(fill, put).otherwise(c)).alias("out"), (a["used"] + fill.cast("int")).alias("used"))

    whole = F.aggregate(F.split(said, ""), start, step, lambda a: F.concat(a["out"], F.substr(made, F.greatest(a["used"], F.lit(0)) + 1)))
    shouted = (said == F.upper(said)) & (said != F.lower(said)) & (kind != "secret")
    return F.when(kind == "ip", made).when(shouted, F.upper(whole)).otherwise(whole)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made) for distinct (kind, norm): replacements distinct within a kind and foreign to the corpus.

    Each round draws for what has none yet. A draw that is an entity, or taken,
    or also drawn by an entity of lesser normal form, is lost; what is settled
    stays. Rounds end: after NARROW draws the forms grow by a place in each round,
    so clashes fall at least to a tenth, and two hex digits of an address at a time
    once addresses of four numbers are used up.
    """
    real = entities.select("kind", F.col("norm").alias("made"))
    todo, settled, attempt = entities.select("kind", "norm"), None, 0
    while True:
        drawn = stored(todo.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key)))
        free = drawn.join(real, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        won = stored(free.groupBy("kind", "made").agg(F.min("norm").alias("norm")).select("kind", "norm", "made"))
        settled = won if settled is None else settled.unionByName(won)
        todo = drawn.select("kind", "norm").join(won.select("kind", "norm"), ["kind", "norm"], "left_anti")
        if todo.isEmpty():
            return settled
        attempt += 1


def replace_entities(docs: DataFrame, key: str = "surrogates", whole: bool = False) -> DataFrame:
    """doc_id, text with replacements, n_entities: one row for each row of ``docs`` that holds an entity, or with ``whole`` for each row.

    Rows without one, null and empty texts included, are as they should be; with
    ``whole`` they are returned as they are, n_entities 0. Texts of any length
    are searched whole. Rows equal in doc_id and text change alike and are
    returned each. The same key gives the same replacements of the same corpus.
    An empty table gives an empty result.

    Texts are searched once and kept with their mentions; only texts with a
    mention are shuffled. Distinct entities come from partial aggregates, and
    mentions of an entity that is everywhere meet its replacement by broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(seen.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.coalesce(mentions(F.col("text")), F.array().cast("array<string>")).alias("surfaces")))
    found = seen.where(F.size("surfaces") > 0)
    said = found.select("row", F.posexplode("surfaces").alias("pos", "surface"))
    said = said.select("row", "pos", F.posexplode(parts_of(kind_of(F.col("surface")), F.col("surface"))).alias("part", "p")).select("row", "pos", "part", "p.*")
    counts = stored(said.groupBy("kind", "norm").agg(F.count("*").alias("n")))
    made = assign(counts.select("kind", "norm"), key)
    new = join_heavy(said, made, ["kind", "norm"], heavy_keys(counts, ["kind", "norm"]))
    new = new.select("row", "pos", "part", F.concat("before", poured(F.col("kind"), F.col("norm"), F.col("said"), F.col("made"))).alias("new"))
    lists = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "new"))).alias("news"))
    between = F.when(F.col("text").contains("@"), F.split("text", ANY, -1)).otherwise(F.split("text", REST, -1))
    pieces = found.select("doc_id", "row", F.size("surfaces").cast("long").alias("n_entities"), between.alias("pieces")).join(lists, "row")
    woven = F.transform("news", lambda x: F.concat(F.when(x["part"] == 0, F.get(F.col("pieces"), x["pos"])).otherwise(""), x["new"]))
    out = pieces.select(F.col("doc_id").cast(kind).alias("doc_id"), F.concat(F.array_join(woven, ""), F.element_at("pieces", -1)).alias("text"), "n_entities")
    if not whole:
        return out
    return out.unionByName(seen.where(F.size("surfaces") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))

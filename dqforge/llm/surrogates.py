r"""PII surrogates (DataFrame functions only).

1. *Detect.*  One pattern finds mentions: e-mail addresses, secrets (long hex
   strings and key prefixes), IBANs, IPv4 addresses, social-security numbers,
   phone numbers, card numbers, and names behind a title or beginning with a
   listed given name.
2. *Entities.*  A mention names one or two entities (type, canonical form):
   lower case, digits without separators, national number without country code.
   So the same e-mail, number or surname is the same entity in every text and
   spelling (coreference).
3. *Surrogates.*  Every entity gets one keyed replacement of its type: digits for
   digits, letters of the same script and case, hex for hex, valid octets, the
   card's first digit and the validity of its check digit, a given name of the
   same gender and script.
4. *Collision checks.*  Over the table of distinct entities: two entities of a type
   never share a surrogate, and no surrogate is an original of the corpus; the
   later one draws again until that holds.
5. *Rewrite.*  Texts with mentions meet their entities' surrogates by a digest of
   the text (copies meet once), and each mention is filled into its own format:
   separators, country code and case stay.  Other texts are not shuffled.

Entities are pre-aggregated before they are shuffled, so a very common address
or a hot source is one row of the entity table.

Defined results: a null text stays null (no mention); texts without a mention are
returned unchanged; repeated rows are rewritten alike; all columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

# Titles by gender, given names by gender (Latin, Cyrillic, Greek).
MALE_TITLES = ["Mr.", "Herr", "Señor", "Monsieur", "Господин", "господин", "Κύριος"]
FEMALE_TITLES = ["Mrs.", "Ms.", "Miss", "Frau", "Señora", "Madame", "Госпожа", "госпожа", "Κυρία"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Klaus", "Jürgen", "Pierre", "Jean",
              "José", "Carlos", "Juan", "Иван", "Сергей", "Дмитрий", "Γιώργος", "Νίκος"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Ursula", "Monika", "Sabine", "Marie",
                "Nathalie", "María", "Carmen", "Lucía", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη"]
_NAME = r"\p{Lu}[\p{L}'’-]++"
_ALT = lambda words: "|".join(w.replace(".", r"\.") for w in words)
# a domain reaches to its last label that begins with two letters (punycode or letters), linear and without recursion
_LABEL = r"[\p{L}\p{N}-]++"
_SKIP = rf"(?:\.(?!\p{{L}}{{2}}){_LABEL})*+"
_DOMAIN = (rf"{_LABEL}(?:{_SKIP}\.(?=\p{{L}}{{2}}){_LABEL}(?={_SKIP}\.\p{{L}}{{2}}))*+{_SKIP}"
           r"\.(?:[xX][nN]--[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+|\p{L}{2,}+)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# The one- and two-digit country codes of telephone numbers (all others have three digits).
_COUNTRY = (r"^\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66"
            r"|81|82|84|86|90|91|92|93|94|95|98|\d{3})")

#: type -> pattern, in order of precedence
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{_DOMAIN}",
    "secret": r"(?<![\p{L}\p{N}_-])(?:(?:sk|pk)[-_][A-Za-z0-9_-]{20,}+|(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}"
              r"|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+)(?![\p{L}\p{N}_])"
              r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)(?!\p{{L}})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
             r"|\d{3}[.-]\d{3}[.-]\d{4})(?!\p{N})",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![ -]?\p{N})",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_ALT(MALE_TITLES + FEMALE_TITLES)}) {_NAME}(?: {_NAME})?"
            rf"|(?:{_ALT(MALE_NAMES + FEMALE_NAMES)}) {_NAME})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_LATIN = ["ba", "den", "fo", "gar", "hel", "jo", "kam", "lin", "mor", "nel", "or", "pas", "ro", "sten", "ti", "ul", "van", "wes", "yor", "zen"]
_CYRILLIC = ["ба", "вер", "гор", "дан", "жи", "зор", "кам", "лин", "мор", "нел", "ор", "пав", "рос", "сен", "тим", "ул", "фед", "хар", "чер", "яр"]
_GREEK = ["βα", "γαρ", "δεν", "ζα", "θε", "καλ", "λιν", "μορ", "νελ", "ξε", "παν", "ρο", "στα", "τιμ", "φω", "χρι", "ψα", "ωρ", "ελ", "αν"]
_ENDINGS = {  # script -> (male, female, surname)
    "latin": (["o", "us", "an", "ert"], ["a", "ia", "ine", "ette"], ["son", "er", "mann", "ez"]),
    "cyrillic": (["ий", "ан", "ор", "ей"], ["а", "ия", "ина", "ея"], ["енко", "ук", "ич", "ян"]),
    "greek": (["ος", "ης", "ας", "ων"], ["α", "η", "ία", "ώ"], ["ίδου", "άκη", "ού", "έα"]),
}


def _type(s: Column) -> Column:
    out = F.lit("name")
    for t in reversed([t for t in PATTERNS if t != "name"]):
        out = F.when(s.rlike(f"^(?:{PATTERNS[t]})$"), t).otherwise(out)
    return out


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def _country(s: Column) -> Column:
    """Leading +country code of a phone number ('' if there is none), separated or not."""
    return F.regexp_extract(s, _COUNTRY, 0)


def _name_parts(s: Column):
    """(title or '', given name or '', surname, gender) of a name mention."""
    title = F.regexp_extract(s, rf"^(?:{_ALT(MALE_TITLES + FEMALE_TITLES)}) ", 0)
    words = F.split(F.substring(s, F.char_length(title) + 1, F.char_length(s)), " ")
    given = F.when(F.size(words) > 1, F.element_at(words, 1)).otherwise(F.lit(""))
    male = F.when(title != "", title.rlike(f"^(?:{_ALT(MALE_TITLES)}) $")).otherwise(given.isin(MALE_NAMES))
    return title, given, F.element_at(words, -1), F.when(male, "given_m").otherwise("given_f")


def _script(s: Column) -> Column:
    return (F.when(s.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin"))


def _entity(kind: Column, canonical: Column) -> Column:
    return F.concat(kind, F.lit(":"), canonical)


def _canonical(s: Column, kind: Column) -> Column:
    digits = F.regexp_replace(F.substring(s, F.char_length(_country(s)) + 1, F.char_length(s)), r"[^0-9]", "")
    return (F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", F.replace(s, F.lit(" "), F.lit("")))
            .when(kind.isin("email"), F.lower(s)).otherwise(s))


def entities(s: Column) -> Column:
    """array<string>: the entities ('type:canonical') that a mention names."""
    kind = _type(s)
    _, given, surname, gender = _name_parts(s)
    names = F.filter(F.array(F.when(given != "", _entity(gender, F.lower(given))), _entity(F.lit("surname"), F.lower(surname))),
                     lambda e: e.isNotNull())
    return F.when(kind == "name", names).otherwise(F.array(_entity(kind, _canonical(s, kind))))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Check digit of a number without its last digit."""
    d = F.reverse(_chars(digits))
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))), F.lit(0), lambda a, b: a + b)
    return F.pmod(-total, F.lit(10))


def _pick(values, h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The entity's replacement, a pure function of key, type, canonical form and attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")).cast("binary"), 256)
    at = lambda i, n: F.pmod(F.xxhash64(seed, i), F.lit(n))
    number = lambda s: F.array_join(F.transform(_chars(s), lambda c, i: at(i, 10).cast("string")), "")
    letter = lambda c, i: (F.when(c.rlike("[0-9]"), at(i, 10).cast("string"))
                           .when(c.rlike("[a-z]"), F.char((at(i, 26) + 97).cast("int")))
                           .when(c.rlike("[A-Z]"), F.char((at(i, 26) + 65).cast("int")))
                           .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", at(i, 27)))
                           .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", at(i, 24)))
                           .when(c.rlike(r"\p{IsLatin}"), _pick("àáâäèéêëìíîïòóôöùúûü", at(i, 20)))
                           .otherwise(c))
    spelled = lambda s: F.array_join(F.transform(_chars(s), letter), "")
    body, last = F.substring(canonical, F.lit(1), F.char_length(canonical) - 1), F.substring(canonical, -1, 1)
    new = F.concat(F.substring(canonical, 1, 1), number(F.substring(body, F.lit(2), F.char_length(body))))
    card = F.concat(new, F.pmod(_luhn(new) + last.cast("int") - _luhn(body), F.lit(10)).cast("string"))
    octets = F.array_join(F.transform(F.split(canonical, r"\."), lambda c, i: (at(i, 254) + 1).cast("string")), ".")
    top = F.regexp_extract(canonical, r"\.[^.]*$", 0)
    hexed = F.array_join(F.transform(_chars(canonical), lambda c, i: F.substring(F.lit("0123456789abcdef"), (at(i, 16) + 1).cast("int"), F.lit(1))), "")
    prefix = F.regexp_extract(canonical, r"^(?:(?:sk|pk)[-_]|AKIA|ASIA|gh[pousr]_|github_pat_|eyJ)", 0)
    rest = lambda s, p: F.substring(s, F.char_length(p) + 1, F.char_length(s))
    secret = (F.when(canonical.rlike("^[0-9a-f]+$"), hexed).when(canonical.rlike("^[0-9A-F]+$"), F.upper(hexed))
              .otherwise(F.concat(prefix, spelled(rest(canonical, prefix)))))
    # names: syllables of the script, one more with every third attempt, and an ending by gender
    size = 1 + F.pmod(F.xxhash64(seed, F.lit(-2)), F.lit(2)) + F.floor(attempt / 3)
    script = _script(canonical)

    def spoken(syllables):
        places = F.sequence(F.lit(1).cast("long"), size.cast("long"))
        return F.array_join(F.transform(places, lambda i: _pick(syllables, F.xxhash64(seed, i))), "")

    def name(which: int):
        out = None
        for s, syllables in (("latin", _LATIN), ("cyrillic", _CYRILLIC), ("greek", _GREEK)):
            made = F.concat(spoken(syllables), _pick(_ENDINGS[s][which], F.xxhash64(seed, F.lit(-1))))
            out = F.when(script == s, made) if out is None else out.when(script == s, made)
        return out
    return (F.when(kind == "email", F.concat(spelled(F.substring(canonical, F.lit(1), F.char_length(canonical) - F.char_length(top))), top))
            .when(kind == "ip", octets).when(kind == "card", card).when(kind == "secret", secret)
            .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), spelled(F.substring(canonical, F.lit(3), F.char_length(canonical)))))
            .when(kind == "given_m", name(0)).when(kind == "given_f", name(1)).when(kind == "surname", name(2))
            .otherwise(number(canonical)))


def _fill(surface: Column, core: Column, mark: str) -> Column:
    """``core``'s characters in the places of the surface's characters that match ``mark``."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(acc, c):
        hit = c.rlike(mark)
        return F.struct(F.when(hit, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
                        F.concat(acc["out"], F.when(hit, F.substring(core, acc["i"], F.lit(1))).otherwise(c)).alias("out"))
    return F.aggregate(_chars(surface), start, step, lambda acc: acc["out"])


def _cased(new: Column, old: Column) -> Column:
    many = F.char_length(old) > 1
    return F.when(many & (F.upper(old) == old), F.upper(new)).otherwise(
        F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.char_length(new))))


def render(s: Column, table: Column) -> Column:
    """A mention with its entities replaced; ``table`` maps entities to surrogates."""
    kind = _type(s)
    core = table[_entity(kind, _canonical(s, kind))]
    code = _country(s)
    title, given, surname, gender = _name_parts(s)
    name = F.concat(title, F.when(given != "", F.concat(_cased(table[_entity(gender, F.lower(given))], given), F.lit(" "))).otherwise(F.lit("")),
                    _cased(table[_entity(F.lit("surname"), F.lower(surname))], surname))
    shaped = F.array_join(F.transform(F.arrays_zip(_chars(s).alias("old"), _chars(core).alias("new")), lambda p: F.when(
        p["old"] == F.lower(p["old"]), p["new"]).otherwise(F.upper(p["new"]))), "")
    return (F.when(kind == "name", name).when(kind.isin("ip", "secret"), core).when(kind == "email", shaped)
            .when(kind == "iban", _fill(s, core, "[A-Z0-9]"))
            .otherwise(F.concat(code, _fill(F.substring(s, F.char_length(code) + 1, F.char_length(s)), core, "[0-9]"))))


def surrogate_table(found: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """``found(entity)`` (distinct) -> (entity, surrogate) without collisions.

    An entity draws again while a smaller entity of its type has its surrogate, or while its
    surrogate is itself an original (the latter for at most ``rounds`` draws, where a corpus holds
    nearly every value of a type)."""
    spark = found.sparkSession
    split = found.select("entity", F.substring_index("entity", ":", 1).alias("kind"),
                         F.expr("substring(entity, locate(':', entity) + 1)").alias("canonical"))
    # one pool for names: a new surname shall not be somebody's given name
    pool = F.when(F.col("kind").isin("given_m", "given_f", "surname"), "name").otherwise(F.col("kind"))
    done = None
    todo = kept(split.withColumn("pool", pool), "pii-entities")
    originals = todo.select("pool", F.col("canonical").alias("taken")).distinct()
    settled = spark.createDataFrame([], "pool string, taken string")
    attempt = 0
    while True:
        drawn = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), key))
        first = drawn.groupBy("pool", "surrogate").agg(F.min("entity").alias("winner"))
        taken = settled if attempt >= rounds else settled.unionByName(originals)
        free = (drawn.join(first, ["pool", "surrogate"]).filter(F.col("entity") == F.col("winner"))
                .join(taken.select(F.col("pool").alias("p"), "taken"), (F.col("pool") == F.col("p")) & (F.col("surrogate") == F.col("taken")), "left_anti"))
        free = kept(free.select("entity", "pool", "surrogate"), "pii-surrogates")
        done = free if done is None else done.unionByName(free)
        settled = settled.unionByName(free.select("pool", F.col("surrogate").alias("taken")))
        todo = kept(todo.join(free.select("entity"), "entity", "left_anti"), "pii-entities")
        if not todo.take(1):
            return done.select("entity", "surrogate")
        attempt += 1


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every mention replaced; all columns stay as they are, plus ``__mentions``
    (number of mentions replaced) as the last one."""
    names = docs.columns
    own, text = [f"c{i}" for i in range(len(names))], F.col(f"c{names.index(text_col)}")
    # the one search of all texts; only texts with mentions are read beside it again
    base = kept(docs.toDF(*own).withColumn("found", F.coalesce(mentions(text), F.array().cast("array<string>"))), "pii-mentions")
    touched = base.filter(F.size("found") > 0).withColumn("at", F.md5(text.cast("binary")))
    named = touched.select("at", F.explode(F.array_distinct(F.flatten(F.transform("found", entities)))).alias("entity")).distinct()
    named = kept(named, "pii-found")
    table = surrogate_table(named.select("entity").distinct(), key)
    maps = (named.join(table, "entity").groupBy(F.col("at").alias("of"))
            .agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("map")))
    gaps = F.split(text, ANY, -1)
    parts = F.zip_with(gaps, F.transform("found", lambda s: render(s, F.col("map"))),
                       lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    columns = [F.array_join(parts, "").alias(c) if n == text_col else F.col(c) for c, n in zip(own, names)]
    changed = touched.join(maps, F.col("at") == F.col("of")).select(*columns, F.size("found").alias("mentions"))
    same = base.filter(F.size("found") == 0).select(*own, F.lit(0).alias("mentions"))
    return changed.unionByName(same).toDF(*names, "__mentions")

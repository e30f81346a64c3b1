"""PII surrogates: detected entities get keyed, type-consistent replacements. DataFrame functions only.

A surrogate is the entity's image under a keyed permutation of its own format's space (digits stay digits, vowels stay
vowels of the same alphabet), so two entities of a kind never share one, and reruns and larger tables agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pack, unpack

#: Titles by gender, and given names by script and gender: fixed lists that detection and surrogates share.
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Госпожа", "Κυρία"]}
GIVEN = {
    ("latin", "m"): ["Adam", "Carlos", "Daniel", "David", "Felix", "Jack", "Jean", "John", "Jorge", "Lukas", "Martin", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"],
    ("latin", "f"): ["Alice", "Anna", "Camille", "Carmen", "Claire", "Elena", "Emma", "Hannah", "Julia", "Laura", "Maria", "Marie", "Mary", "Nina", "Olivia", "Sarah", "Sofia", "Susan"],
    ("cyrillic", "m"): ["Алексей", "Андрей", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: Classes of characters that a permutation keeps apart, by what they are used for. Characters of no class stay.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
NAME_LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäãåèéêëìíîïòóôöõøùúûü", "çñßłšž", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσστφχψ", "άέήίόύώ"]
MAIL_LETTERS = [DIGITS, LOWER, "àáâäãåçèéêëìíîïñòóôöõøùúûüß", "абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
#: Rounds of the permutation.
ROUNDS = 8

_WORD = r"\p{Lu}[\p{L}'’\-]+"
_ANY_WORD = r"\p{L}[\p{L}'’\-]+"
_SECRET_KEY = r"(?i:token|secret|api[_\-]?key|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET_VALUE = r"[A-Za-z0-9_\-/+]{8,}"
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_SURE_TITLES = "|".join(t for ts in TITLES.values() for t in ts if t != "Miss")  # "Miss Universe" is no name
_ALL_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
#: What introduces a full name.
_CUE = r"(?i:my name is|name is|named|contact|dear|signed by|written by|regards,|sincerely,|attn:|author:)\s{1,3}"
_NOT_NAMES = r"(?!(?i:The|And|Of|In|On|At|To|For|Is|Was|Has|Will|With|From|Said|Or|But|Who)\b)"
#: Every entity, at the start of a word only. Possessive and bounded repeats keep the scan linear.
PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(
    [
        _SECRET_KEY + _SECRET_VALUE,
        r"[0-9a-fA-F]{32,}(?![\p{L}\p{N}])",
        r"[\p{L}\p{N}._%+\-]{1,200}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}",
        r"(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
        r"\d{3}-\d{2}-\d{4}(?!\d)",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        r"(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d|\.\d)",
        r"\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{2,4}(?:[ .\-]\d{2,4}){1,2}?(?!\d)",
        r"\+(?:\d{8,15}|\d{1,3}(?:[ .\-]\d{1,4}){2,5})(?!\d)",
        r"\(\d{2,4}\) ?\d{3,4}[ \-]\d{3,4}(?!\d)",
        r"\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)",
        rf"(?i:{_ALL_TITLES})\.? (?i:{_ALL_GIVEN}) {_NOT_NAMES}{_ANY_WORD}",
        rf"(?i:{_SURE_TITLES})\.? {_NOT_NAMES}{_WORD}(?: {_NOT_NAMES}{_WORD})?",
        rf"Miss {_NOT_NAMES}{_WORD} {_NOT_NAMES}{_WORD}",
        rf"{_CUE}(?:(?i:{_ALL_TITLES})\.? )?{_NOT_NAMES}{_WORD} {_NOT_NAMES}{_WORD}",
    ]
) + ")"
_LEAD = rf"^((?:{_CUE})?(?:(?i:{_ALL_TITLES})\.? )?)"


def _in(c: Column, words: list[str]) -> Column:
    return F.lower(c).isin([w.lower() for w in words])


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, mod 10."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    one = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, twice(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + b) % 10


def _mod97(iban: Column) -> Column:
    """The check sum of an IBAN in capitals without separators; 1 if it holds."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _piece(kind: Column, norm: Column, form: Column) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"), form.alias("form"))


def pieces_of(m: Column) -> Column:
    """A mention as array<struct<kind, norm, form>>: what is replaced as one, and literal parts of kind keep.

    norm is what two mentions of one entity have in common: e-mail addresses in lower case, numbers without
    separators, each part of a name by itself in lower case. Numbers that look like cards, IBANs or IP addresses but
    fail their check sums or ranges are kept as a whole.
    """
    keep = lambda x: _piece(F.lit("keep"), F.lit(""), x)
    compact = F.upper(F.regexp_replace(m, r"[^0-9A-Za-z]", ""))
    one = lambda kind, norm: F.array(_piece(F.lit(kind), norm, m))
    checked = lambda holds, kind, norm: F.when(holds, one(kind, norm)).otherwise(F.array(keep(m)))
    value = F.regexp_extract(m, f"({_SECRET_VALUE})$", 1)
    key = F.substring(m, F.lit(1), F.char_length(m) - F.char_length(value))
    lead = F.regexp_extract(m, _LEAD, 1)
    names = F.split(F.substring(m, F.char_length(lead) + 1, F.char_length(m)), " ")
    given, surname = F.element_at(names, 1), F.element_at(names, -1)
    title = F.regexp_extract(lead, rf"(?i:({_ALL_TITLES}))\.? $", 1)
    female = _in(title, TITLES["f"]) | ((title == "") & _in(given, [n for (_, g), ns in GIVEN.items() if g == "f" for n in ns]))
    sort = F.concat(F.lit("name-"), script_of(surname), F.lit("-"))
    last = _piece(F.concat(sort, F.lit("s")), F.lower(surname), surname)
    first = _piece(F.concat(sort, F.when(female, "f").otherwise("m")), F.lower(given), given)
    named = F.when(F.size(names) == 2, F.array(keep(lead), first, keep(F.lit(" ")), last)).otherwise(F.array(keep(lead), last))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return (
        F.when(m.rlike(f"^{_SECRET_KEY}"), F.array(keep(key), _piece(F.lit("secret"), value, value)))
        .when(m.rlike(r"^[0-9a-fA-F]{32,}$"), one("secret", m))
        .when(m.contains("@"), one("email", F.lower(m)))
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), checked(F.forall(octets, lambda x: x < 256), "ip", F.array_join(F.transform(octets, lambda x: x.cast("string")), ".")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), one("ssn", compact))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), checked(_mod97(compact) == 1, "iban", compact))
        .when(m.rlike(r"^\d(?:[ \-]?\d){12,18}$"), checked(_luhn(compact) == 0, "card", compact))
        .when(m.rlike(r"^[+(\d]"), one("phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), compact)))
        .otherwise(named)
    )


# --- surrogates: a keyed permutation of each format's space ---------------------------------------------------------


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(values: Column, sizes: Column, salt: Column) -> Column:
    """A permutation of all arrays of whole numbers 0 <= values[i] < sizes[i], which the salt chooses.

    An alternating Feistel network: in each round one half of the places is shifted, each place within its own size,
    by hash bytes of the other half, which stays; every round can be undone, so the whole is one to one. Places of
    size 1 stay what they are; an array of one place is shifted by the salt alone.
    """
    half = F.floor(F.size(sizes) / 2).cast("int")

    def round_(v: Column, r: Column) -> Column:
        other = F.filter(v, lambda x, i: (i < half) != (F.pmod(r, F.lit(2)) == 0))
        h = F.sha2(F.concat_ws(",", salt, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)
        byte = lambda h, i: F.conv(F.substring(h, F.pmod(i, F.lit(42)) * 3 + 1, F.lit(3)), 16, 10).cast("int")
        return _bind(h, lambda h: F.transform(v, lambda x, i: F.when((i < half) == (F.pmod(r, F.lit(2)) == 0), F.pmod(x + byte(h, i), F.element_at(sizes, i + 1))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, round_)


def shuffled(text: Column, classes: list[str], salt: Column) -> Column:
    """text under a permutation that keeps each character in its class; characters of no class stay."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    alphabet = lambda c: reduce(lambda out, a: F.when(F.instr(F.lit(a), c) > 0, F.lit(a)).otherwise(out), reversed(classes), c)
    letters = F.transform(chars, alphabet)

    def write(letters: Column) -> Column:
        numbers = F.zip_with(chars, letters, lambda c, a: F.instr(a, c) - 1)
        return F.array_join(F.zip_with(permuted(numbers, F.transform(letters, F.char_length), salt), letters, lambda n, a: F.substring(a, n + 1, F.lit(1))), "")

    return _bind(letters, write)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The image of an entity under the permutation that key, kind, format and attempt choose; format as norm's.

    Cards keep length and first digit and pass the Luhn check; phones with + keep their first digit; IBANs keep the
    country and pass their check; e-mail addresses keep the shape and the last domain label; IP addresses stay IP
    addresses; secrets keep shape and alphabet. Listed given names become listed ones of the same gender and script;
    other names keep script, length, the pattern of vowels and consonants and the last letter, which marks gender.
    """
    n = F.char_length(norm)
    salt = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"))
    end = lambda at: F.substring(norm, F.lit(at), n)
    digits = lambda c: shuffled(c, [DIGITS], salt)
    stem = F.concat(F.substring(norm, 1, 1), digits(F.substring(norm, F.lit(2), n - 2)))
    card = _bind(stem, lambda c: F.concat(c, F.pmod(F.lit(10) - _luhn(F.concat(c, F.lit("0"))), F.lit(10)).cast("string")))
    phone = F.when(norm.startswith("+"), F.concat(F.substring(norm, 1, 2), digits(end(3)))).otherwise(digits(norm))
    octets = F.transform(F.split(norm, r"\."), lambda x: x.cast("int"))
    first = F.element_at(octets, 1)
    usual = first.between(1, 223)  # other first numbers are special ranges and stay
    moved = permuted(F.concat(F.array(F.when(usual, first - 1).otherwise(0)), F.slice(octets, 2, 3)), F.array(F.when(usual, 223).otherwise(1), *[F.lit(256)] * 3), salt)
    ip = _bind(moved, lambda v: F.concat_ws(".", F.when(usual, v[0] + 1).otherwise(first).cast("string"), *[v[k].cast("string") for k in (1, 2, 3)]))
    tld = F.regexp_extract(norm, r"(\.[^.]*)$", 1)
    email = F.concat(shuffled(F.substring(norm, F.lit(1), n - F.char_length(tld)), MAIL_LETTERS, salt), tld)
    bban = shuffled(end(5), [DIGITS, UPPER], salt)
    iban = _bind(bban, lambda b: F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), shuffled(norm, [HEX], salt)).otherwise(shuffled(norm, [DIGITS, LOWER, UPPER], salt))
    names = F.concat(shuffled(F.substring(norm, F.lit(1), n - 1), NAME_LETTERS, salt), F.substring(norm, n, F.lit(1)))
    shift = F.conv(F.substring(F.sha2(salt, 256), 1, 6), 16, 10).cast("int")
    for (s, g), listed in GIVEN.items():
        known = F.array(*[F.lit(x.lower()) for x in listed])
        at = F.array_position(known, norm).cast("int")
        turned = F.element_at(known, F.pmod(at - 1 + 1 + F.pmod(shift, F.lit(len(listed) - 1)), F.lit(len(listed))) + 1)
        names = F.when((kind == f"name-{s}-{g}") & (at > 0), turned).otherwise(names)
    return (
        F.when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "ssn", digits(norm))
        .when(kind == "email", email)
        .when(kind == "iban", iban)
        .when(kind == "secret", secret)
        .otherwise(names)
    )


def assign(entities: DataFrame, key: str, tries: int = 4) -> DataFrame:
    """(kind, norm, sur) of distinct entities (kind, norm): no two of a kind share sur, and no sur is an entity as far
    as the format has room.

    The first permutation gives each entity its surrogate, distinct by construction. The collision check looks for
    surrogates that are entities of the corpus themselves; these few try up to tries further permutations for one that
    is neither an entity nor anyone's surrogate. One that finds none, in a format whose space is about used up, keeps
    the first surrogate, which is still nobody else's, or changes it with another such entity if it is itself. Nothing
    fails, whatever the number of entities, and all others have the same surrogates in every corpus.
    """
    offered = lambda rows, attempt: rows.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("sur"))
    taken = entities.select("kind", F.col("norm").alias("sur"))
    first = cut(offered(entities.select("kind", "norm"), 0))
    open_ = cut(first.join(taken, ["kind", "sur"], "left_semi").select("kind", "norm"))
    taken = taken.union(first.select("kind", "sur"))
    better = None
    for attempt in range(1, tries + 1):
        if not open_.limit(1).count():
            break
        offer = cut(offered(open_, attempt))
        good = cut(offer.join(taken, ["kind", "sur"], "left_anti").select("kind", "norm", "sur"))
        better = good if better is None else better.union(good)
        taken = taken.union(good.select("kind", "sur"))
        open_ = offer.join(good, ["kind", "norm"], "left_anti").select("kind", "norm")
    if better is None:
        return first
    better = better.unionByName(_turned(open_.join(first, ["kind", "norm"])))
    return first.join(better.withColumnRenamed("sur", "other"), ["kind", "norm"], "left").select("kind", "norm", F.coalesce("other", "sur").alias("sur"))


def _turned(rows: DataFrame) -> DataFrame:
    """(kind, norm, sur) of the rows that are their own surrogates, and of one more of their format each: surrogates
    handed on among them. About one row a format is its own surrogate, however many the format has."""
    shape = reduce(lambda c, x: F.regexp_replace(c, *x), ((r"\d", "9"), (r"\p{Ll}", "a"), (r"\p{Lu}", "A")), F.col("norm"))
    rows = rows.withColumn("shape", shape)
    own = rows.where("norm = sur")
    extra = rows.where("norm != sur").groupBy("kind", "shape").agg(F.min(F.struct("norm", "sur")).alias("x")).select("kind", "x.norm", "x.sur", "shape").join(own, ["kind", "shape"], "left_semi")
    within = Window.partitionBy("kind", "shape").orderBy("norm")
    following = F.coalesce(F.lead("sur").over(within), F.first("sur").over(within))
    return own.unionByName(extra).withColumn("next", following).select("kind", "norm", F.col("next").alias("sur"))


def rendered(kind: Column, form: Column, sur: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its case."""
    at = lambda i: F.char_length(F.regexp_replace(F.substring(form, F.lit(1), i), r"[^0-9A-Za-z+]", ""))
    one = lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9A-Za-z+]"), F.substring(sur, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))
    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(form)), one), "")
    upper, lower = (form == F.upper(form)) & (F.char_length(form) > 1), form == F.lower(form)
    return (
        F.when(kind == "keep", form)
        .when(kind.isin("card", "phone", "ssn", "iban"), filled)
        .when(kind == "email", F.when(upper, F.upper(sur)).otherwise(sur))
        .when(kind.startswith("name"), F.when(upper, F.upper(sur)).when(lower, sur).otherwise(F.concat(F.upper(F.substring(sur, 1, 1)), F.substring(sur, F.lit(2), F.char_length(sur)))))
        .otherwise(sur)
    )


def _alone(parts: DataFrame) -> DataFrame:
    """(i, k, names) of the documents with named people: a pattern of their names' parts standing alone."""
    forms = F.array_distinct(F.flatten(F.collect_list(F.array("form", F.initcap("norm"), F.upper("norm")))))
    quoted = F.array_join(F.transform(F.array_sort(forms), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|")
    return parts.groupBy("i", "k").agg(F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}_])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}_])")).alias("names"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every entity of text replaced by its surrogate, plus n_replaced.

    Entities: secrets after a key word or as 32 and more hexadecimal digits, e-mail and IP addresses, phone numbers,
    social security numbers, IBANs and cards with valid check sums, people's names behind a title or a cue ("contact",
    "my name is", ..), whatever their case if the given name is a listed one. A part of such a name that stands alone
    elsewhere in the same text, capitalised or in capitals, is the same person's and replaced alike. Not detected:
    names with neither title nor cue anywhere in their text, names in scripts other than Latin, Cyrillic and Greek.

    The same entity gets the same surrogate in every document (coreference), different entities of a kind different
    ones. The same key gives the same result. Null text stays null, empty text and text without entities as they are.
    Rows that repeat id and text are treated alike; null ids are allowed; an empty table gives an empty one. A column
    of docs named n_replaced is replaced, others stay, whatever their names.

    Entities are made distinct before they meet; only rows with entities join their surrogates and shuffle.
    """
    docs = docs.drop("n_replaced")
    own = pack(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64("text"))
    distinct = lambda pattern: F.array_distinct(F.regexp_extract_all("text", pattern, F.lit(0)))
    found = own.select(F.col("id").alias("i"), F.col("key").alias("k"), distinct(F.lit(PATTERN)).alias("ms")).where(F.size("ms") > 0)
    mentions = cut(found.select("i", "k", F.explode("ms").alias("m")).distinct())
    pieces = cut(mentions.select("i", "k", "m", F.posexplode(pieces_of(F.col("m"))).alias("at", "p")).select("i", "k", "m", "at", "p.*"))
    named = pieces.where("kind like 'name-%'")
    people = cut(_alone(named))
    at_home = (F.col("id").eqNullSafe(F.col("i"))) & (F.col("key") == F.col("k"))
    alone = own.join(people, at_home).select("i", "k", F.explode(distinct(F.col("names"))).alias("m")).distinct()
    whose = named.groupBy(F.col("i").alias("ni"), F.col("k").alias("nk"), "norm").agg(F.max("kind").alias("kind"))
    alone = alone.join(whose, F.col("i").eqNullSafe(F.col("ni")) & (F.col("k") == F.col("nk")) & (F.lower("m") == F.col("norm")))
    every = pieces.unionByName(alone.select("i", "k", "m", F.lit(0).alias("at"), "kind", "norm", F.col("m").alias("form")))
    entities = cut(pieces.where("kind != 'keep'").select("kind", "norm").distinct())
    surs = assign(entities, key).select(F.col("kind").alias("ek"), F.col("norm").alias("en"), "sur")
    done = every.join(surs, (F.col("kind") == F.col("ek")) & (F.col("norm") == F.col("en")), "left").select("i", "k", "m", "at", (F.col("kind") != "keep").alias("new"), rendered(F.col("kind"), F.col("form"), F.col("sur")).alias("r"))
    done = done.groupBy("i", "k", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]), "").alias("r"), F.max("new").alias("new"))
    maps = done.groupBy("i", "k").agg(F.map_from_entries(F.collect_list(F.struct("m", "r"))).alias("map"), F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("news"))
    maps = maps.join(people.select(F.col("i").alias("pi"), F.col("k").alias("pk"), "names"), F.col("i").eqNullSafe(F.col("pi")) & (F.col("k") == F.col("pk")), "left").select("i", "k", "map", "news", "names")
    joined = own.join(maps, at_home, "left")
    pattern = F.coalesce("names", F.lit(PATTERN))
    all_ = F.regexp_extract_all("text", pattern, F.lit(0))
    new = F.array_append(F.transform(all_, lambda m: F.element_at("map", m)), F.lit(""))
    replaced = F.array_join(F.zip_with(F.split("text", pattern, -1), new, lambda gap, r: F.concat(gap, r)), "")
    has = F.col("map").isNotNull()
    n = F.when(has, F.size(F.filter(all_, lambda m: F.element_at("news", m)))).otherwise(F.lit(0))
    return joined.select(*unpack(docs.columns, **{text_col: F.when(has, replaced).otherwise(F.col("text")), "n_replaced": n}))

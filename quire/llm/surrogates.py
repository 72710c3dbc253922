"""PII: surrogate generation, in DataFrame operations only.

Entities are found by one regular expression: e-mail addresses, payment cards, phone numbers
(international, North American, and the national forms 06 12 34 56 78 and 030 1234567), social
security numbers, IBANs, IPv4 and IPv6 addresses, and names: one to three capitalised words
after a title, or one or two after a common given name (FIRST). Where a text names someone, the
words of the name are found everywhere else in it as well. Names without either aren't found.
An entity's surrogate is drawn by SHA-256 under a secret key from its type and normal form, so
that the same entity has the same surrogate wherever it stands (coreference) and nothing else
leads back to it:

* characters keep their class: digits, and letters of the Latin, Cyrillic or Greek script in
  either case; punctuation stays. Host names keep their labels' form under example.com;
  address octets stay below 256; a phone's country code or trunk prefix stays, as do an IBAN's
  country, and the validity of a card's and an IBAN's check digits;
* given names keep their gender, by the title or the name itself, and their script; surnames
  their script. Names are mapped word by word, so "Ms. Ada Byron", "Ms. Byron" and "Ada" agree.

Collision checks: the distinct entities of the corpus are counted by surrogate; where two have
the same one, or one equals an entity that occurs, all but the least entity draw again
(attempt 1, 2, ...) until every surrogate is distinct. Only these redrawn entities, if any,
are joined back, by document.

Defined results: null stays null, empty stays empty; a text without entities stays as it is,
whatever its length; long texts are searched whole. Rows that repeat have equal results, as
have equal texts under different, null or repeated keys. Of entities that clash, the one of the
lowest kind and normal form keeps its surrogate. An empty table gives no rows. Columns of df
with an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import settled

_MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Signor|Господин|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Signora|Госпожа|Κυρία"
_EITHER = "Dr|Prof"
_TITLE = f"{_MALE}|{_FEMALE}|{_EITHER}"
#: Common given names, which begin a name without a title.
FIRST = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Hans Jürgen Klaus Wolfgang Stefan Pierre Jean Jacques François José Juan Carlos Miguel Luis Giovanni Giuseppe Иван Сергей Дмитрий Алексей Николай Γιώργος Δημήτρης Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Anna Ursula Monika Petra Sabine Marie Isabelle Nathalie Sophie María Carmen Ana Isabel Giulia Francesca Мария Ольга Елена Наталья Татьяна Μαρία Ελένη Κατερίνα".split(),
}
_NAME = r"\p{Lu}[\p{L}]+(?:-\p{Lu}\p{L}+)?"
#: By type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9-])(?<![0-9]\.)(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[ -]?[0-9]{1,3})?(?![0-9])|(?<![0-9-])(?<![0-9]\.)[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]|\.[0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
    r"|(?<![0-9.,-])[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9-])|(?<![0-9.,-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})(?![ .-]?[0-9])|(?<![0-9.,-])0[1-9][0-9]{1,3}[ /][0-9]{6,8}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{'|'.join(FIRST['m'] + FIRST['f'])})(?: {_NAME}){{1,2}})(?!\p{{L}})",
}
UNION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: One of these characters or words stands in every entity. Words are looked for only where a
#: capital letter begins one, as most of a text is passed over by that.
HINT = r"[0-9@]|::|(?<!\p{L})(?=\p{Lu})" + f"(?:{'|'.join([_TITLE, *FIRST['m'], *FIRST['f']])})[. ]"

#: Surrogate given names by script and gender; surnames are built from syllables.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Dario Emil Felix Gustav Hugo Ivan Jonas Karl Leon Marco Nico Oscar Paul".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Frida Greta Helena Irma Julia Klara Luisa Marta Nina Olga Petra".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Майя Нина Ольга Полина Раиса".split(),
    ("greek", "m"): "Άγγελος Βασίλης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λάμπρος Μάριος Νίκος Πέτρος Σπύρος Στέλιος Τάσος Φώτης Χρήστος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θεοδώρα Ιωάννα Κατερίνα Λένα Μαρία Νίκη Όλγα Σοφία Χαρά".split(),
}
SYLLABLES = {
    "latin": "ba ben da del fa for ga gel ha hol ka kel la lin ma mer na nor pa per ra ros sa sol ta tor va ver wa win za zel".split(),
    "cyrillic": "ба бел да дер га гор ка ков ла лен ма мир на нов па пет ра рос са сол та тар ва вер за зор жа жур ша шов ча чер".split(),
    "greek": "βα βελ γα γορ δα δελ ζα ζερ θα θορ κα κελ λα λιν μα μερ να νορ ξα ξερ πα περ ρα ρος σα σολ τα τορ φα φερ χα χορ".split(),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        out = F.when(entity.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def normal(kind: Column, form: Column) -> Column:
    """What makes two mentions the same entity: letters in lower case, numbers without
    separators."""
    return F.when(kind.isin("card", "phone", "iban"), F.regexp_replace(form, r"[ ().-]", "")).otherwise(F.lower(form))


def drawn(secret: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(secret), *parts), 256)


def at(seed: Column, i: Column) -> Column:
    """The i-th number (from 0) of a seed: 16 bits of it, or of its hash for later ones."""
    block = F.sha2(F.concat(seed, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(block, (i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(choices: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))


def letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def same_form(text: Column, seed: Column) -> Column:
    """Digits and letters by others of their class; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n, out = at(seed, i), c
        for script, p in (("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}"), ("latin", r"\p{IsLatin}")):
            low = letter(LETTERS[script], n)
            out = F.when(c.rlike(p), F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low)).otherwise(out)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def email_surrogate(entity: Column, seed: Column) -> Column:
    local, host = F.split_part(entity, F.lit("@"), F.lit(1)), F.split_part(entity, F.lit("@"), F.lit(2))
    labels = F.split(host, r"\.")
    extra = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    example = F.when(F.upper(host) == host, "EXAMPLE").otherwise("example")
    top = F.element_at(labels, -1)
    top = F.when(F.lower(top).isin("com", "org", "net"), top).otherwise(F.when(F.upper(host) == host, "COM").otherwise("com"))
    # the local part's form, with two letters more, which widens what can be drawn
    fresh = F.concat(same_form(local, seed), F.translate(F.substring(F.sha2(F.concat(seed, F.lit("l")), 256), 1, 2), "0123456789", "ghijklmnop"))
    fresh = F.when(F.upper(local) == local, F.upper(fresh)).otherwise(fresh)
    renewed = F.transform(extra, lambda x, i: same_form(x, F.sha2(F.concat(seed, F.lit("h"), i.cast("string")), 256)))
    return F.concat(fresh, F.lit("@"), F.array_join(F.concat(renewed, F.array(example, top)), "."))


def ip_surrogate(entity: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, r"\."), lambda x, i: F.when(i == 0, at(seed, i) % 223 + 1).otherwise(at(seed, i) % 256).cast("string")), ".")


def with_digits(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order by those of ``digits``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    return F.aggregate(
        chars,
        start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"))).otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"],
    )


def digits_drawn(count: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.when(i == 0, at(seed, i) % 9 + 1).otherwise(at(seed, i) % 10).cast("string")), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that still lack the check digit."""
    doubled = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def card_surrogate(entity: Column, seed: Column) -> Column:
    plain = F.regexp_replace(entity, "[^0-9]", "")
    n = F.char_length(plain)
    valid = (luhn_sum(F.substring(plain, F.lit(1), n - 1)) + F.substring(plain, n, F.lit(1)).cast("int")) % 10 == 0
    body = digits_drawn(n - 1, seed)
    check = (10 - luhn_sum(body) % 10) % 10
    last = F.when(valid, check).otherwise((check + 1 + at(seed, F.lit(40)) % 9) % 10)
    return with_digits(entity, F.concat(body, last.cast("string")))


def phone_surrogate(entity: Column, seed: Column) -> Column:
    code = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])|^\+(?:1|7|[2-9][0-9])|^0[1-9]", 0)
    rest = F.substring(entity, F.char_length(code) + 1, F.char_length(entity))
    return F.concat(code, with_digits(rest, digits_drawn(F.char_length(F.regexp_replace(rest, "[^0-9]", "")), seed)))


def check_97(plain: Column) -> Column:
    """The two check digits that belong to an IBAN, as a number."""
    moved = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 2), F.lit("00"))
    digits = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(digits, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return 98 - rest


def iban_surrogate(entity: Column, seed: Column) -> Column:
    plain = F.regexp_replace(entity, " ", "")
    fresh = F.concat(F.substring(plain, 1, 2), F.lit("00"), same_form(F.substring(plain, F.lit(5), F.char_length(plain)), seed))
    valid = check_97(plain) % 97 == F.substring(plain, 3, 2).cast("int") % 97
    check = F.when(valid, check_97(fresh)).otherwise((check_97(fresh) + 1 + at(seed, F.lit(60)) % 95) % 97)
    out = F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(fresh, F.lit(5), F.char_length(plain)))
    return F.when(entity.contains(" "), F.regexp_replace(out, "(.{4})(?=.)", "$1 ")).otherwise(out)


def ip6_surrogate(entity: Column, seed: Column) -> Column:
    """Other groups of as many digits; those that begin with 0 keep it, so that none is longer."""

    def one(c: Column, i: Column) -> Column:
        digit = F.substring(F.lit("123456789abcdef"), (at(seed, i) % 15 + 1).cast("int"), F.lit(1))
        return F.when(c.isin(":", "0"), c).otherwise(F.when(c.rlike("[A-F]"), F.upper(digit)).otherwise(digit))

    return F.array_join(F.transform(F.filter(F.split(entity, ""), lambda c: c != ""), one), "")


def word_surrogate(word: Column, kind: Column, seed: Column) -> Column:
    """A surname of four syllables, or a given name and a part of three syllables, which
    widens what can be drawn."""
    out = F.lit("")
    for script, syllables in SYLLABLES.items():
        part = [pick(syllables, at(seed, F.lit(k))) for k in range(4)]
        n = at(seed, F.lit(0))
        either = F.when(n % 2 == 0, pick(GIVEN[script, "f"], F.floor(n / 2))).otherwise(pick(GIVEN[script, "m"], F.floor(n / 2)))
        given = F.when(kind == "given_f", pick(GIVEN[script, "f"], n)).when(kind == "given_m", pick(GIVEN[script, "m"], n)).otherwise(either)
        full = F.when(kind == "surname", F.initcap(F.concat(*part))).otherwise(F.concat(given, F.lit("-"), F.initcap(F.concat(*part[1:]))))
        out = F.when(script_of(word) == script, full).otherwise(out)
    return F.when((F.char_length(word) > 1) & (F.upper(word) == word), F.upper(out)).otherwise(out)


def surrogate(kind: Column, form: Column, seed: Column) -> Column:
    return (
        F.when(kind == "email", email_surrogate(form, seed))
        .when(kind == "card", card_surrogate(form, seed))
        .when(kind == "ip", ip_surrogate(form, seed))
        .when(kind == "ip6", ip6_surrogate(form, seed))
        .when(kind == "phone", phone_surrogate(form, seed))
        .when(kind == "ssn", with_digits(form, digits_drawn(F.lit(9), seed)))
        .when(kind == "iban", iban_surrogate(form, seed))
        .otherwise(word_surrogate(form, kind, seed))
    )


def found(text: Column, pattern: Column) -> Column:
    """The matches of the pattern in order, as they stand."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, F.lit(0))), none)


def atoms(form: Column, kind: Column) -> Column:
    """What of an entity has a surrogate of its own: of a name its words without the title, with
    their roles, else the whole."""
    title = rf"^(?:{_TITLE})\.?$"

    def words(all_: Column) -> Column:
        first = F.element_at(all_, 1)
        titled = first.rlike(title) & (F.size(all_) > 1)
        own = F.when(titled, F.slice(all_, 2, 4)).otherwise(all_)
        given = F.element_at(own, 1)
        female = F.when(first.rlike(rf"^(?:{_FEMALE})\.?$"), True).when(first.rlike(rf"^(?:{_MALE})\.?$"), False).when(given.isin(FIRST["f"]), True).when(given.isin(FIRST["m"]), False)
        role = F.when(female, "given_f").when(~female, "given_m").otherwise("given")
        return F.transform(own, lambda w, i: F.struct(F.when(i == F.size(own) - 1, "surname").otherwise(role).alias("kind"), w.alias("form"), F.lower(w).alias("norm")))

    whole = F.array(F.struct(kind.alias("kind"), form.alias("form"), normal(kind, form).alias("norm")))
    return F.when(kind == "name", words(F.split(form, " "))).otherwise(whole)


def mentioned(df: DataFrame, text: str) -> DataFrame:
    """df with __quire_p, the pattern of a row's entities, and __quire_m, its mentions in order:
    structs of form, kind and atoms. Where a text has names, their words are part of its
    pattern."""
    t = F.col(text)
    first = df.withColumn("__quire_f", found(t, F.lit(UNION)))
    named = F.filter(F.transform("__quire_f", lambda m: F.struct(m.alias("form"), kind_of(m).alias("kind"))), lambda m: m["kind"] == "name")
    known = first.withColumn("__quire_n", F.array_distinct(F.flatten(F.transform(named, lambda m: atoms(m["form"], m["kind"])))))
    words = F.array_distinct(F.transform("__quire_n", lambda a: a["form"]))
    longer = F.concat(F.lit(UNION + r"|(?<![\p{L}-])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}-])"))
    known = known.withColumn("__quire_p", F.when(F.size("__quire_n") > 0, longer).otherwise(F.lit(UNION)))
    forms = known.withColumn("__quire_f", F.when(F.size("__quire_n") > 0, found(t, F.col("__quire_p"))).otherwise(F.col("__quire_f")))

    def mention(m: Column) -> Column:
        kind = kind_of(m)
        # a single word is part of a name found elsewhere in the text, and has the role it has there
        part = F.filter("__quire_n", lambda a: a["form"] == m)
        own = F.when((kind == "name") & (F.size(part) > 0), F.slice(part, 1, 1)).otherwise(atoms(m, kind))
        return F.struct(m.alias("form"), kind.alias("kind"), own.alias("atoms"))

    return forms.withColumn("__quire_m", F.transform("__quire_f", mention)).drop("__quire_f", "__quire_n")


def replaced(mention: Column, secret: str, redrawn: Column | None) -> Column:
    """A mention's surrogate; redrawn maps kind and norm to attempts above 0."""

    def attempt(a: Column) -> Column:
        return F.lit(0) if redrawn is None else F.coalesce(F.try_element_at(redrawn, F.concat_ws(":", a["kind"], a["norm"])), F.lit(0))

    seeded = F.transform(mention["atoms"], lambda a: F.struct(a["kind"].alias("kind"), a["form"].alias("form"), drawn(secret, a["kind"], a["norm"], attempt(a).cast("string")).alias("seed")))
    parts = F.transform(seeded, lambda x: surrogate(x["kind"], x["form"], x["seed"]))
    head = F.split(mention["form"], " ")
    title = F.when((mention["kind"] == "name") & (F.size(head) > F.size(mention["atoms"])), F.slice(head, 1, 1))
    return F.array_join(F.concat(F.coalesce(title, F.array().cast("array<string>")), parts), " ")


def redraws(entities: DataFrame, secret: str, rounds: int = 64) -> DataFrame | None:
    """The entities (kind, norm) that need an attempt above 0, with it; None if none does.

    ``entities`` has one row (kind, norm, form) for each. Surrogates are compared in normal
    form, with each other and with the entities that occur. In a clash the entity of the
    lowest attempt, then norm, keeps its surrogate, unless that is an entity itself."""
    rows = entities.withColumn("attempt", F.lit(0))
    real = entities.select(F.col("norm").alias("drawn")).distinct().withColumn("real", F.lit(True))
    for k in range(rounds):
        seed = drawn(secret, F.col("kind"), F.col("norm"), F.col("attempt").cast("string"))
        rows = settled(rows.withColumn("drawn", normal(F.col("kind"), surrogate(F.col("kind"), F.col("form"), seed))))
        first = rows.groupBy("drawn").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = first.join(real, "drawn", "left").where("n > 1 or real").select("drawn", "first", F.coalesce("real", F.lit(False)).alias("real"))
        clash = settled(clash)
        if clash.isEmpty():
            return rows.where("attempt > 0").select("kind", "norm", "attempt") if k else None
        redo = F.col("first").isNotNull() & (F.col("real") | (F.struct("attempt", "kind", "norm") != F.col("first")))
        rows = rows.join(clash, "drawn", "left").select("kind", "norm", "form", (F.col("attempt") + F.coalesce(redo, F.lit(False)).cast("int")).alias("attempt"))
    raise ValueError("the space of surrogates is too small for the entities of this table")


def replace_pii(df: DataFrame, secret: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with its text's entities replaced, and entity_kinds (the kind of each mention, in
    order). All entities of the table are checked for collisions first."""
    names = [c for c in df.columns if c != "entity_kinds"]
    atoms_of = F.explode(F.flatten(F.transform("__quire_m", lambda m: m["atoms"])))
    own = mentioned(df.select(F.col(text)), text).select(atoms_of.alias("a"))
    entities = settled(own.select("a.*").groupBy("kind", "norm").agg(F.min("form").alias("form")))
    again = redraws(entities, secret)
    rows = mentioned(df.select(*names), text)
    if again is not None:
        # Documents that hold a redrawn entity get a map of attempts, by document.
        held = mentioned(df.select(F.col(key).alias("__quire_k"), F.col(text).alias("__quire_t")), "__quire_t")
        held = held.select("__quire_k", atoms_of.alias("a")).select("__quire_k", "a.kind", "a.norm").distinct()
        maps = held.join(again, ["kind", "norm"]).groupBy("__quire_k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "norm"), "attempt"))).alias("__quire_again"))
        rows = rows.join(settled(maps), rows[key].eqNullSafe(F.col("__quire_k")), "left").drop("__quire_k")
    fresh = F.transform("__quire_m", lambda m: replaced(m, secret, F.col("__quire_again") if again is not None else None))
    pieces = F.split(F.col(text), F.col("__quire_p"), -1)
    joined = F.array_join(F.zip_with(pieces, fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rows = rows.withColumn(text, F.when(F.size("__quire_m") > 0, joined).otherwise(F.col(text)))
    return rows.withColumn("entity_kinds", F.transform("__quire_m", lambda m: m["kind"])).select(*names, "entity_kinds")

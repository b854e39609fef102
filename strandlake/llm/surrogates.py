"""Operator 3: surrogates for personal data (native).

One pattern finds e-mail addresses, telephone numbers, IPv4 addresses, card numbers, social security numbers, access keys,
assigned secrets, personal names, and surnames after a title. Every distinct entity of the corpus gets one replacement, drawn
by a secret key, of its own kind:

* letters become letters of the same script and case, digits digits, everything else stays (the top-level domain, the country
  code, a card's first digit and a secret's keyword too); IP octets keep their number of digits while such
  addresses are left; a card number that
  passes the Luhn test has a replacement that passes it; hexadecimal secrets stay hexadecimal;
* a name gets a given name of the same gender and script and a surname of the same script: a listed one at the first
  ``LISTED`` attempts, then one spelled with letters of the script, so that replacements never run out.

Names are found by the listed given names, followed by any capitalised word, or both in capitals; names with other given
names are found after a title only. A surname after a title is an entity of its own, apart from full names that have it.

Coreference: spellings of one entity share a normal form (digits of numbers, small letters of addresses, capitalised names),
the normal form is replaced, and the replacement is spelled as the entity is: digits go into its grouping, capitals stay
capitals. Distinctness: the replacement is a function of the normal form alone; a check over all distinct ones draws again
(with the next attempt number) for any whose replacement is another's, or is itself an entity of the corpus, until none is
left. As a spelling can be undone, different entities have different replacements in any spelling. Partial sums make the
entity table, so a hot entity is no hot row there; entity rows meet their replacements in a join that may be split where it is
skewed.

Nulls: a null text stays null with n_entities 0. Blank texts are unchanged. Rows that repeat are repeated; equal
texts have equal results. An empty table gives an empty result. Extra columns are kept by :func:`replace`; where one has the
name of a result, the result's name gets underscores before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh, let, stash

# Common given names by script and gender, and surnames by script.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amanda Ana Ananya Anna Barbara Carmen Catherine Chloe Charlotte Claire Elena Elizabeth Emily Emma Eva Fatima Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Laura Linda Lucy Margaret Maria Marie Martha Mary Mei Monica Nancy Olivia Patricia Priya Rachel Sarah Sofia Sophie Susan Victoria Yuki".split(),
    ("latin", "m"): "Adam Ahmed Alexander Andrew Anthony Arjun Benjamin Brian Carlos Charles Christopher Daniel David Edward Frank George Henry Hiroshi Hugo James Jan John Joseph Juan Kevin Lars Lucas Luis Mark Martin Matthew Michael Mohammed Oliver Omar Paul Peter Pierre Raj Richard Robert Samuel Steven Thomas Walter Wei William".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Дмитрий Иван Михаил Сергей".split(),
    ("greek", "f"): "Άννα Αικατερίνη Βασιλική Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
SURNAMES = {
    "latin": "Adams Baker Bauer Becker Bell Bernard Brown Carter Clark Cooper Costa Davies Dubois Evans Fischer Garcia Green Hall Harris Hill Hughes Jackson Jones King Klein Lambert Lewis Lopez Martinez Meyer Miller Moore Moreau Morris Navarro Parker Phillips Richter Roberts Rossi Ruiz Schmidt Schneider Scott Simon Smith Taylor Torres Turner Walker Ward Weber White Wilson Wolf Wood Wright Young Zimmermann".split(),
    "cyrillic": "Волков Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Попов Семёнов Соколов Фёдоров".split(),
    "greek": "Αγγέλου Βλάχος Γεωργίου Δημητρίου Ιωάννου Καραγιάννης Νικολάου Οικονόμου Παπαδάκης Χρήστου".split(),
}

_LISTED = [n for names in GIVEN.values() for n in names]
NAME = r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:" + "|".join(_LISTED) + r") \p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: In capitals; a month and a verb are left out.
CAPITALS = r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:" + "|".join(n.upper() for n in _LISTED if n not in ("Jan", "Mark")) + r") \p{Lu}{2,}(?![\p{L}\p{N}])"
TITLE = r"(?:Mrs|Mr|Ms|Dr|Prof)\.? "
TITLED = r"(?<![\p{L}\p{N}])" + TITLE + f"(?!{NAME})" + r"\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?<![\p{L}\p{N}])(?i:password|passwd|secret|token|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?[A-Za-z0-9_+/-]{8,}"
ACCESS = r"(?<![\p{L}\p{N}])AKIA[A-Z0-9]{16}(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}])(?=\+\d(?:[ ()-]*\d){6})\+\d{1,3}[ -]?(?:\(\d{1,4}\)|\d{1,4})(?:[ -]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
SOCIAL = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{4}[ -]?){3}\d{4}(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
KINDS = {"email": EMAIL, "secret": SECRET, "access_key": ACCESS, "phone": PHONE, "card": CARD, "social": SOCIAL, "ip": IP, "surname": TITLED, "name": f"{NAME}|{CAPITALS}"}
#: Every pattern starts outside a word: said once, as most places of a text are inside one.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"

#: Letters that stand for each other, by script and case.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]

#: Capitals and small letters of the alphabets, one for one.
BIG, SMALL = ALPHABETS[1] + ALPHABETS[4] + ALPHABETS[6] + ALPHABETS[8], ALPHABETS[0] + ALPHABETS[3] + ALPHABETS[5] + ALPHABETS[7]
#: Country calling codes of one and two digits; the others have three.
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def draw(seed: Column, i: Column, n: int) -> Column:
    """A number below ``n``, the i-th drawn from the seed."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long") % n).cast("int")


def spelled(text: Column, seed: Column, alphabets: list[str]) -> Column:
    """``text`` with each letter and digit drawn anew from its own alphabet."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for a in alphabets:
            out = F.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), draw(seed, i, len(a)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_sum(digits: Column, n: Column) -> Column:
    """The Luhn sum of ``n`` digits, the last one counted once."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(entity: Column, seed: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    fresh_ = F.concat(F.substring(entity, 1, 1), spelled(F.substring(entity, F.lit(2), F.length(entity) - 1), seed, ALPHABETS[2:3]))
    zero = F.concat(F.substring(fresh_, F.lit(1), F.length(fresh_) - 1), F.lit("0"))
    check = F.pmod(-luhn_sum(F.regexp_replace(zero, "[^0-9]", ""), F.lit(16)), F.lit(10))
    valid = F.concat(F.substring(zero, F.lit(1), F.length(zero) - 1), check.cast("string"))
    return F.when(luhn_sum(digits, F.lit(16)) % 10 == 0, valid).otherwise(fresh_)


#: Attempts at which a name's replacement has a listed surname and an octet its number of digits; a telephone number keeps its
#: country code four times as long. The later draws are from so many values that they do not run out.
LISTED = 4


def _ip(entity: Column, seed: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        kept = F.when(F.length(o) == 1, 1 + draw(seed, i, 9)).when(F.length(o) == 2, 10 + draw(seed, i, 90)).otherwise(100 + draw(seed, i, 155))
        return F.when(attempt < LISTED, kept).otherwise(1 + draw(seed, i, 254)).cast("string")

    return F.array_join(F.transform(F.split(entity, r"\."), octet), ".")


def _phone(entity: Column, seed: Column, attempt: Column) -> Column:
    country = F.when(attempt < 4 * LISTED, F.regexp_extract(entity, CALLING, 0)).otherwise(F.regexp_extract(entity, r"^\+", 0))
    rest = spelled(F.substring(entity, F.length(country) + 2, F.length(entity)), seed, ALPHABETS[2:3])
    # an area code does not start with 0 or 1
    return F.concat(country, (2 + draw(seed, F.lit(-1), 8)).cast("string"), rest)


#: Upper and lower case letters of a script, and how many letters a spelled surname has (26^10 surnames, 24^10, 28^10).
LETTERS = {"latin": (ALPHABETS[1], ALPHABETS[0]), "cyrillic": (ALPHABETS[6], ALPHABETS[5]), "greek": (ALPHABETS[8], ALPHABETS[7])}
SPELLED = 10


def _name(entity: Column, seed: Column, attempt: Column) -> Column:
    given = F.substring_index(entity, " ", 1)
    out = F.lit(None).cast("string")
    for (script, _), names in GIVEN.items():
        pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), draw(seed, F.lit(i), len(values)) + 1)
        upper, lower = LETTERS[script]
        new = spelled(F.lit(upper[0] + lower[0] * (SPELLED - 1)), seed, [upper, lower])
        surname = F.when(attempt < LISTED, pick(SURNAMES[script], 1)).otherwise(new)
        out = F.when(given.isin(names), F.concat_ws(" ", pick(names, 0), surname)).otherwise(out)
    return out


def _surname(entity: Column, seed: Column, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for script, names in SURNAMES.items():
        upper, lower = LETTERS[script]
        listed = F.element_at(F.array(*map(F.lit, names)), draw(seed, F.lit(1), len(names)) + 1)
        new = F.when(attempt < LISTED, listed).otherwise(spelled(F.lit(upper[0] + lower[0] * (SPELLED - 1)), seed, [upper, lower]))
        out = new if script == "latin" else F.when(entity.rlike(rf"^\p{{Is{script.capitalize()}}}"), new).otherwise(out)
    return out


def normal(entity: Column, kind: Column) -> Column:
    """What the spellings of one entity have in common."""
    return (
        F.when(kind == "email", F.translate(entity, BIG, SMALL))
        .when(kind.isin("phone", "card", "social"), F.regexp_replace(entity, "[^0-9+]", ""))
        .when(kind == "surname", F.regexp_replace(entity, f"^{TITLE}", ""))
        .when(kind == "name", F.initcap(F.lower(entity)))
        .otherwise(entity)
    )


def respelled(entity: Column, kind: Column, new: Column) -> Column:
    """The replacement ``new`` of the entity's normal form, spelled as the entity is; :func:`normal` of it is ``new`` again."""
    digits = F.regexp_replace(new, "[^0-9]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    grouped = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(c))
    cased = F.zip_with(F.split(entity, ""), F.split(new, ""), lambda c, x: F.when(F.instr(F.lit(BIG), c) > 0, F.translate(x, SMALL, BIG)).otherwise(x))
    return (
        F.when(kind == "email", F.array_join(cased, ""))
        .when(kind.isin("phone", "card", "social"), F.array_join(grouped, ""))
        .when(kind == "surname", F.concat(F.regexp_extract(entity, f"^{TITLE}", 0), new))
        .when((kind == "name") & (entity == F.upper(entity)), F.upper(new))
        .otherwise(new)
    )


def surrogate(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement that attempt number ``attempt`` (from 0) gives an entity's normal form."""
    seed = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, entity, attempt.cast("string")), 256)

    def of(s: Column) -> Column:
        domain = F.regexp_extract(entity, r"\.\p{L}{2,}$", 0)
        email = F.concat(spelled(F.substring(entity, F.lit(1), F.length(entity) - F.length(domain)), s, ALPHABETS), domain)
        word = F.regexp_extract(entity, "^[^=:]+[=:][ ]*[\"']?", 0)
        value = F.substring(entity, F.length(word) + 1, F.length(entity))
        secret = F.concat(word, F.when(value.rlike("^[0-9a-f]+$"), spelled(value, s, ["abcdef", ALPHABETS[2]])).otherwise(spelled(value, s, ALPHABETS[:3])))
        access = F.concat(F.lit("AKIA"), spelled(F.substring(entity, 5, 16), s, ALPHABETS[1:3]))
        return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "access_key", access).when(kind == "phone", _phone(entity, s, attempt)).when(kind == "card", _card(entity, s)).when(kind == "social", spelled(entity, s, ALPHABETS[2:3])).when(kind == "ip", _ip(entity, s, attempt)).when(kind == "surname", _surname(entity, s, attempt)).otherwise(_name(entity, s, attempt))

    return let(seed, of)


def entity_table(entities: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """entity, kind, surrogate of the distinct values of ``entities`` (one column, ``entity``)."""
    spellings = entities.distinct().withColumn("kind", kind_of(F.col("entity")))
    spellings = cut(spellings.withColumn("form", normal(F.col("entity"), F.col("kind"))))
    forms = forms_table(spellings.groupBy("form", "kind").agg(F.lit(0).alias("attempt")), key, attempts)
    new = forms.select(F.col("form").alias("_form"), F.col("kind").alias("_kind"), F.col("surrogate").alias("_new"))
    met = spellings.join(new, (F.col("form") == F.col("_form")) & (F.col("kind") == F.col("_kind")))
    return met.select("entity", "kind", respelled(F.col("entity"), F.col("kind"), F.col("_new")).alias("surrogate"))


def forms_table(e: DataFrame, key: str, attempts: int) -> DataFrame:
    """form, kind, surrogate: distinct normal forms with distinct replacements, none of which is a form itself."""
    for _ in range(attempts):
        e = e.withColumn("surrogate", surrogate(F.col("form"), F.col("kind"), key, F.col("attempt")))
        e = cut(e.withColumn("_rank", F.row_number().over(Window.partitionBy("surrogate").orderBy("attempt", "form", "kind"))))
        real = e.select(F.col("form").alias("_real")).distinct()
        met = e.join(real, e["surrogate"] == real["_real"], "left")
        met = met.withColumn("again", (F.col("_rank") > 1) | F.col("_real").isNotNull())
        bad = met.where("again").limit(1).count()
        e = met.select("form", "kind", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "surrogate")
        if not bad:
            return e.select("form", "kind", "surrogate")
        e = cut(e.drop("surrogate"))
    raise ValueError(f"after {attempts} attempts some entities still share a replacement: too few replacements of their kind")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the entities of the text replaced, n_entities, and kinds (of each, in order)."""
    n_entities, kinds = fresh(docs, "n_entities", "kinds")
    mark, number, found, sur, kind = fresh(docs, "_mark", "_id", "_found", "_sur", "_kind")
    marked = docs.withColumn(mark, F.md5(F.col(text)))
    found_rows = marked.select(F.col(mark).alias(number), F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), 1).alias(found)).where(F.size(found) > 0)
    # equal texts need one list; texts are told apart by a 128-bit hash
    lists = stash(found_rows.distinct())
    rows = lists.select(F.col(number).alias("number"), F.posexplode(found).alias("pos", "entity"))
    table = entity_table(rows.select("entity"), key)
    met = rows.join(table, "entity").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate", "kind"))).alias("m"))
    # written down, and met by a sort whatever the size: a text in very many rows can be split in that join
    met = stash(met.select(F.col("number").alias(number), F.col("m.surrogate").alias(sur), F.col("m.kind").alias(kind)))
    parts = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(F.zip_with(parts, F.col(sur), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    out = marked.join(met.hint("merge"), F.col(mark) == F.col(number), "left")
    new = F.when(F.col(sur).isNotNull(), rebuilt).otherwise(F.col(text)).alias(text)
    counts = F.coalesce(F.size(sur), F.lit(0)).cast("long").alias(n_entities), F.coalesce(F.col(kind), F.array().cast("array<string>")).alias(kinds)
    return out.select(*(new if c == text else F.col(c) for c in docs.columns), *counts)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_entities, kinds. The key of the query is public; a deployment gives its own."""
    return replace(documents(spark, sf_dir).select("doc_id", "text"), "strandlake")

"""Surrogates for personal data. Built-in functions only.

Entities are found by pattern. Every distinct entity of the corpus gets one surrogate, made by a keyed digest from the
entity itself, so equal entities have equal surrogates in all documents (coreference). A surrogate keeps the kind and
the format: length, signs, letter case, script, vowels and consonants, the country code of a phone number, the top level
domain, the range of IP numbers, the country and the valid check digits of a card number or IBAN; of a name the titles and
the last letter of each word, which carry the gender. Every word of a name has its own surrogate, so all mentions of a
surname agree, and words of a titled name are also replaced where they stand alone in the same document. Surrogates that meet another surrogate or an entity of the corpus are made anew with
the next attempt number until all are distinct. Where a format has too few surrogates, attempts from NARROW on are longer:
octets of an IP number have three digits, everything else gets one more letter or digit, and another every WIDER attempts.

Defined cases: null texts stay null and empty ones empty; a text without entities is untouched; repeated rows are treated
alike; texts of any length are searched whole; the table of entities grows with the corpus and is only ever joined by
shuffles; columns beside the text stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import pinned, prepare

# Titles, patterns by kind in order of precedence, and the alphabets that letters are drawn from.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Professeur", "Mx", "Dra")
TITLE = "(?:(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES) + r")\b\.? )+"
HEX = "[0-9A-Fa-f]{1,4}"
KINDS = (
    ("email", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.[\p{L}]{2,}"),
    ("access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("iban", r"(?<![\p{L}\d])(?=[A-Z]{2}(?:[A-Z ]*\d){8})[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\p{L}\d])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\d])"),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"),
    (
        "ipv6",
        rf"(?<![\p{{L}}\d:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|::(?:{HEX}:){{0,6}}{HEX}|(?:{HEX}:){{1,7}}:)(?![\p{{L}}\d:]|\.\d)",
    ),
    (
        "phone",
        r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|"
        r"(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?[ .-]?\d{2,14}(?:[ .-]\d{2,8}){0,4}(?![\p{L}\d])|"
        r"(?<![\p{L}\d]|\d[.-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\d]|[.-]\d)|"
        r"(?<![\p{L}\d]|\d[.-])(?=\(?(?:[ ./()-]{0,2}\d){9,15}(?![\p{L}\d]))(?:\(0\d{1,4}\)|0\d{1,4})[ ./-]{1,2}(?:\d{3,9}(?:[ ./-]\d{2,6}){0,3}|\d{2}(?:[ ./-]\d{2}){3})(?![\p{L}\d])",
    ),
    ("secret", r"(?<![\p{L}\d])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{16,64}(?![\p{L}\d])"),
    ("name", rf"\b{TITLE}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"),
)
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâäáéèêëíìîïóòôöúùûü", "ÀÂÄÁÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
HEX_ALPHABETS = ("0123456789", "abcdef", "ABCDEF")
ENTITY = "|".join(pattern for _, pattern in KINDS)
#: What every entity contains; most texts are done with this.
HINT = rf"[0-9@]|::|{TITLE}"
NAME = dict(KINDS)["name"]
#: Attempts that keep the length, attempts for each further length, and a guard against endless rounds.
NARROW, WIDER, MAX_ATTEMPTS = 16, 4, 64
#: The country code of a phone number, by its length where no sign ends it.
CALLING_CODE = r"^\+(?:\d{1,3}(?=[ .(-])|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def has_entity(text: Column) -> Column:
    return F.when(text.rlike(HINT), text.rlike(ENTITY)).otherwise(F.lit(False))


def name_words(entity: Column) -> Column:
    """The words of a name with its titles."""
    return F.split(F.regexp_replace(entity, rf"\A{TITLE}", ""), " ")


def is_name(entity: Column) -> Column:
    return entity.rlike(rf"\A(?:{NAME})\z")


def entity_pattern(text: Column) -> Column:
    """The pattern of the entities of a text: also the words of its titled names, where they stand alone."""
    names = F.filter(F.regexp_extract_all(text, F.lit(ENTITY), 0), is_name)
    words = F.array_distinct(F.flatten(F.transform(names, name_words)))
    # Longest first, so that a word is never taken for the begin of a longer one.
    words = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    alone = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(words) > 0, alone).otherwise(F.lit(ENTITY))


def entities(text: Column, pattern: Column | None = None) -> Column:
    """The entities of a text in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY) if pattern is None else pattern, 0)


def units(entity: Column) -> Column:
    """What gets a surrogate of its own: the words of a name, any other entity as a whole."""
    return F.when(is_name(entity), name_words(entity)).otherwise(F.array(entity))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def _shifted(char: Column, alphabets: tuple[str, ...], byte: Column) -> Column:
    """Another letter of the alphabet that ``char`` belongs to."""
    out = char
    for letters in alphabets:
        at = F.instr(F.lit(letters), char)
        moved = F.substring(F.lit(letters), F.pmod(at + byte % (len(letters) - 1), F.lit(len(letters))) + 1, 1)
        out = F.when(at > 0, moved).otherwise(out)
    return out


def _byte(stream: Column, at: Column) -> Column:
    """Byte ``at`` (from 0) of the digest stream, an int."""
    return F.conv(F.substring(stream, 2 * F.pmod(at, F.lit(128)) + 1, 2), 16, 10).cast("int")


def _luhn(number: Column) -> Column:
    """The check sum of a card number, signs skipped."""
    digits = F.reverse(F.regexp_replace(number, r"\D", ""))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda k: F.substring(digits, k, 1).cast("int") * F.when(k % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10


def _mod97(iban: Column) -> Column:
    """The check sum of an IBAN, blanks skipped; 1 if it is valid."""
    plain = F.regexp_replace(iban, " ", "")
    chars = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda total, c: (total * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def with_surrogate(table: DataFrame, key: str) -> DataFrame:
    """``table(entity, kind, attempt)`` with the column ``surrogate``."""
    seed = F.concat_ws("\u0001", F.lit(key), "kind", "attempt", "entity")
    stream = F.concat(F.sha2(F.concat(seed, F.lit("0")).cast("binary"), 512), F.sha2(F.concat(seed, F.lit("1")).cast("binary"), 512))
    rows = table.withColumn("_stream", stream)
    n, entity = F.length("entity"), F.col("entity")
    kept_begin = (
        F.when(F.col("kind") == "access_key", 4)
        .when(F.col("kind") == "iban", 4)
        .when(F.col("kind") == "phone", F.length(F.regexp_extract("entity", CALLING_CODE, 0)))
        .when(F.col("kind") == "name", F.length(F.regexp_extract("entity", rf"^{TITLE}", 0)))
        .otherwise(0)
    )
    kept_end = F.when(F.col("kind") == "email", F.length(F.regexp_extract("entity", r"\.[^.]*$", 0))).otherwise(0)
    rows = rows.withColumns({"_begin": kept_begin, "_end": n - kept_end})

    def moved(at):
        char = F.substring(entity, at, 1)
        byte = _byte(F.col("_stream"), at - 1)
        letter = F.when(F.col("kind").isin("secret", "ipv6"), _shifted(char, HEX_ALPHABETS, byte)).otherwise(_shifted(char, ("0123456789", *ALPHABETS), byte))
        word_end = (F.col("kind") == "name") & F.substring(entity, at + 1, 1).isin("", " ")
        return F.when((at <= F.col("_begin")) | (at > F.col("_end")) | word_end, char).otherwise(letter)

    def octet(part, at):
        value, byte = part.cast("int"), _byte(F.col("_stream"), at) + 256 * _byte(F.col("_stream"), at + 16)
        least = F.when(F.length(part) == 3, 100).when(F.length(part) == 2, 10).otherwise(1)
        many = F.when(F.length(part) == 3, 156).when(F.length(part) == 2, 90).otherwise(9)
        same = least + F.pmod(value + 1 + F.pmod(byte, many - 1) - least, many)
        return F.when(F.col("attempt") < NARROW, same).otherwise(100 + byte % 156).cast("string")

    plain = F.array_join(F.transform(F.sequence(F.lit(1), n), moved), "")
    rows = rows.withColumn("_plain", F.when(F.col("kind") == "ip", F.array_join(F.transform(F.split("entity", r"\."), octet), ".")).otherwise(plain))
    open_ = F.concat(F.substring("_plain", F.lit(1), n - 1), F.lit("0"))
    checked = F.concat(F.substring("_plain", F.lit(1), n - 1), F.pmod(10 - _luhn(open_), F.lit(10)).cast("string"))
    valid_card = F.when(F.col("kind") == "card", _luhn(entity) == 0).otherwise(F.lit(False))
    zeros = F.concat(F.substring("_plain", 1, 2), F.lit("00"), F.substring("_plain", F.lit(5), n))
    numbered = F.concat(F.substring("_plain", 1, 2), F.lpad((98 - _mod97(zeros)).cast("string"), 2, "0"), F.substring("_plain", F.lit(5), n))
    valid_iban = F.when(F.col("kind") == "iban", _mod97(entity) == 1).otherwise(F.lit(False))
    same = F.when(valid_card, checked).when(valid_iban, numbered).otherwise(F.col("_plain"))

    # Further characters go where the kind can be longer; a number with check digits is no valid one then.
    more = F.when(F.col("attempt") < NARROW, 0).otherwise(F.floor((F.col("attempt") - NARROW) / WIDER) + 1).cast("int")
    lettered = F.col("kind").isin("email", "name")
    letters, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")
    extra = F.transform(F.sequence(F.lit(1), more), lambda k: F.substring(F.when(lettered, letters).otherwise(digits), _byte(F.col("_stream"), 128 - k) % F.when(lettered, 26).otherwise(10) + 1, 1))
    extra = F.when(more > 0, F.array_join(extra, "")).otherwise(F.lit(""))
    at = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "name", n - 1).otherwise(n)
    longer = F.concat(F.substring(same, F.lit(1), at), extra, F.substring(same, at + 1, n))
    rows = rows.withColumn("surrogate", F.when((more == 0) | (F.col("kind") == "ip"), same).otherwise(longer))
    return rows.select("entity", "kind", "attempt", "surrogate")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``(entity, kind, surrogate)`` for the distinct entities of ``found(entity)``, all surrogates distinct and new.

    Of entities whose surrogates meet, the smallest keeps its own; the rest, and those that meet an entity of the corpus,
    go to the next attempt. Each round is an aggregate and two joins over the table of entities.
    """
    known = pinned(found.distinct().withColumn("kind", F.coalesce(kind_of(F.col("entity")), F.lit("name"))))
    table = pinned(with_surrogate(known.withColumn("attempt", F.lit(0)), key))
    for _ in range(MAX_ATTEMPTS):
        first = table.groupBy("surrogate").agg(F.min("entity").alias("_first"))
        taken = known.select(F.col("entity").alias("surrogate"), F.lit(True).alias("_taken"))
        judged = table.join(first, "surrogate").join(taken, "surrogate", "left")
        judged = pinned(judged.withColumn("_again", (F.col("entity") != F.col("_first")) | F.coalesce("_taken", F.lit(False))))
        if not judged.where("_again").limit(1).count():
            return judged.select("entity", "kind", "surrogate")
        kept = judged.where("not _again").select("entity", "kind", "attempt", "surrogate")
        retry = with_surrogate(judged.where("_again").select("entity", "kind", (F.col("attempt") + 1).alias("attempt")), key)
        table = pinned(kept.union(retry))
    raise RuntimeError(f"surrogates are not distinct after {MAX_ATTEMPTS} attempts")


def pseudonymized(docs: DataFrame, key: str = "canopy", counter: str | None = None) -> DataFrame:
    """``docs`` with surrogates in place of the entities in ``text``; ``counter`` names a column for their number.

    Only texts with entities are shuffled. They are keyed by their digest, so equal texts share one row of the join.
    """
    prepare(docs.sparkSession)
    columns = docs.columns
    plain = docs.where(~F.coalesce(has_entity(F.col("text")), F.lit(False)))
    hit = docs.where(has_entity(F.col("text")))
    pairs = pinned(hit.select(F.sha2(F.col("text").cast("binary"), 256).alias("_key"), F.explode(F.array_distinct(F.flatten(F.transform(entities(F.col("text")), units)))).alias("entity")).distinct())
    table = surrogates(pairs.select("entity"), key)
    # Written, so that the join below has an exchange on either side and a text that many rows share can be split.
    maps = pinned(pairs.join(table, "entity").groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("_map")))
    own = hit.select(F.struct(*columns).alias("_row"), F.sha2(F.col("text").cast("binary"), 256).alias("_key")).join(maps, "_key")
    text = F.col("_row.text")
    own = own.withColumn("_pattern", entity_pattern(text))
    name = lambda e: F.concat(F.regexp_extract(e, rf"\A{TITLE}", 0), F.array_join(F.transform(name_words(e), lambda w: F.element_at("_map", w)), " "))
    new = F.transform(entities(text, F.col("_pattern")), lambda e: F.when(is_name(e), name(e)).otherwise(F.element_at("_map", e)))
    own = own.select("_row", F.split(text, F.col("_pattern"), -1).alias("_between"), new.alias("_new"))
    woven = F.array_join(F.zip_with("_between", "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = own.select(*(woven.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns), *([F.size("_new").alias(counter)] if counter else []))
    return plain.select(*columns, *([F.lit(0).alias(counter)] if counter else [])).union(done)

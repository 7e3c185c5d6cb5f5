"""PII: detected entities receive keyed surrogates.

One pattern finds all entities of a text; the text is split at them and joined again
with a surrogate for each. A surrogate is drawn from SHA-512 of key, type and canonical
form, so an entity has the same surrogate in every document and spelling (coreference). A
name is replaced word by word, so ``Mr. John Smith`` and ``Mr. Smith`` share the surname's
surrogate. Names are found after a title, or where a given name of ``GIVEN`` begins them.

Surrogates keep type and format: digit for digit, letter for letter in its script and
case, signs and spaces where they were. A word of a name becomes a made-up one of
syllables in its script; given names that are female by the table or by a closing vowel
end in one again, titles and country codes stay; card numbers keep their first digit and a
valid check digit; mail addresses move to a reserved domain.

Collision checks: the distinct entities of the whole corpus are listed with their
surrogates. A surrogate shared by two entities, or equal to a real entity of the type, is
drawn again with the next attempt until none is left. From ``LENGTHEN`` on every attempt
adds characters, so an alphabet too small for its entities is no obstacle. Only entities
with a later attempt are joined back to their documents.

Defined cases: null text stays null; a text without entities is unchanged, an empty one
too; repeated rows get equal results; an empty table gives an empty result; other columns
are kept as they are (``n_chars`` follows the new text in ``anonymize``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, let, table

KEY = "tessella-surrogates"
#: The attempt from which on surrogates grow.
LENGTHEN = 6
#: Documents with an entity of a later attempt up to which these are broadcast; beyond, they are joined by shuffle.
BROADCAST_DOCS = 50_000

# Titles before a name, Latin and Cyrillic.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Sr|господин|госпожа"
# Given names that begin a name without a title.
FEMALE = "Alice Anna Camille Carmen Claire Elena Elizabeth Emma Isabel Jane Jennifer Julia Karen Katharina Laura Linda Lucia Maria Marie Mary Monika Nathalie Petra Ruth Sabine Sarah Sophie Susan Ursula Анна Елена Мария Ольга".split()
MALE = "Antonio Carlos David François Hans Jacques James Jean John José Juan Jürgen Karl Klaus Luc Luca Michael Miguel Paul Pedro Peter Pierre Robert Stefan Thomas William Алексей Иван Никита Пётр Сергей".split()
GIVEN = "|".join(sorted(FEMALE + MALE))
# Onsets, vowels and endings (after a vowel: female, other) of made-up names.
SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v w z br tr".split(), "a e i o u".split(), "na la ra sa ta da".split(), "n r l s k m t rd ld nd".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), "на ла ра са та да".split(), "н р л в м к".split()),
}
# The pattern of each type, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"""(?i:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9+/_\-]{6,}["']?""",
    "cloud_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3}(?![\p{L}\p{N}_]))?|[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2} \d{3}|[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}|\d{3}[.\-]\d{3}[.\-]\d{4}|\d{3} \d{3} \d{4}|0\d(?: \d{2}){4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)",
    "card": r"\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5}",
    "name": rf"(?=[\p{{Lu}}г])(?:(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+)?|(?:{GIVEN})[ \-]\p{{Lu}}\p{{Ll}}+)",
}
TYPES = tuple(PATTERNS)
_EDGE = r"(?<![\p{L}\p{N}_.+\-@])"
ALL = _EDGE + "(?:" + "|".join(PATTERNS.values()) + r")(?![\p{L}\p{N}_@])(?!\.\d)"
#: A text with none of these has no entity; it spares most texts the long pattern.
HINT = rf"[0-9@=:]|(?=[\p{{Lu}}г])(?:AKIA|ASIA|(?:{TITLES})\.? \p{{Lu}}|(?:{GIVEN})[ \-]\p{{Lu}})"

# Alphabets by script and case, vowels apart from other letters.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèù", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")


def entities(text: Column) -> Column:
    """All entities of a text in order, repeats included."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(none)


def type_of(entity: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        fits = entity.rlike(f"^(?:{pattern})$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def prefix_of(entity: Column, kind: Column) -> Column:
    """The part that stays: what tells the type, not the person."""
    keep = (
        F.when(kind == "secret", F.regexp_extract(entity, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)", 1))
        .when(kind == "cloud_key", F.substring(entity, 1, 4))
        .when(kind == "iban", F.substring(entity, 1, 2))
        # the country code as far as its length is known without a separator
        .when(kind == "phone", F.regexp_extract(entity, r"^(\+(?:[17]|\d\d))", 1))
        .when(kind == "card", F.substring(entity, 1, 1))
    )
    return F.coalesce(keep, F.lit(""))


def canonical(entity: Column, kind: Column) -> Column:
    """One form for all spellings of an entity."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(F.startswith(entity, F.lit("+")), "+").otherwise(""), digits))
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(entity, r"^[A-Za-z_]+\s*[=:]\s*[\"']?|[\"']$", ""))
        .otherwise(entity)
    )


def _number(digest: Column, i: Column) -> Column:
    """The i-th of the digest's values from 0 to 65535, read over and over."""
    return F.conv(F.substring(digest, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def parts_of(entity: Column, kind: Column) -> Column:
    """What gets a surrogate of its own, as structs of kind, canon and entity: the words of a name, else all."""
    bare = F.regexp_replace(entity, rf"^(?:{TITLES})\.? ", "")
    each = F.transform(F.regexp_extract_all(bare, F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0)), lambda w: F.struct(F.lit("name").alias("kind"), w.alias("canon"), w.alias("entity")))
    return F.when(kind == "name", each).otherwise(F.array(F.struct(kind.alias("kind"), canonical(entity, kind).alias("canon"), entity.alias("entity"))))


def _fill(body: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each digit and letter of ``body`` by a keyed one of its kind; all else stays."""

    def one(i: Column) -> Column:
        def of(c: Column) -> Column:
            # only letters and digits count, so that spellings with other separators agree
            k = F.length(F.regexp_replace(F.substring(body, F.lit(1), i), r"[^\p{L}\p{N}]", ""))

            def drawn(n: Column) -> Column:
                out = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(hexadecimal & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), n % 6 + 1, F.lit(1)))
                for letters in ALPHABETS:
                    out = out.when(c.isin(*letters), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
                return out.otherwise(F.when(c.rlike(r"\p{L}"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))).otherwise(c))

            return let(_number(digest, k), drawn)

        return let(F.substring(body, i, F.lit(1)), of)

    return F.when(F.length(body) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), one), ""))


def _made_up(word: Column, digest: Column, attempt: Column) -> Column:
    """A name of two syllables or more, and an ending that keeps a female given name one."""
    female = word.isin(*FEMALE) | (word.rlike("[aая]$") & ~word.isin(*MALE))

    def of(script: str) -> Column:
        onsets, vowels, her, other = ([F.lit(x) for x in group] for group in SYLLABLES[script])

        def pick(group: list[Column], i: Column) -> Column:
            return F.get(F.array(*group), _number(digest, i) % len(group))

        count = 2 + _number(digest, F.lit(0)) % 2 + F.floor(attempt / 3).cast("int")
        body = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(pick(onsets, 2 * i), pick(vowels, 2 * i + 1))), "")
        return F.initcap(F.concat(body, F.when(female, pick(her, F.lit(1))).otherwise(pick(other, F.lit(1)))))

    return F.when(word.rlike("[А-яЁё]"), of("cyrillic")).otherwise(of("latin"))


def _luhn(number: Column) -> Column:
    """The card number with its last digit set right; separators stay."""

    def digit(digits: Column) -> Column:
        n = F.length(digits)
        doubled = F.transform(F.sequence(F.lit(1), n - 1), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
        return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10, F.lit(10)).cast("string")

    check = let(F.regexp_replace(number, "[^0-9]", ""), digit)
    return F.concat(F.regexp_replace(number, r"[0-9]([^0-9]*)$", ""), check)


def surrogate(entity: Column, kind: Column, attempt: Column) -> Column:
    """The surrogate of a part; another attempt gives another one."""

    def with_digest(v: Column) -> Column:
        body = F.substring(entity, F.length(v["prefix"]) + 1, F.length(entity))
        longer = F.translate(F.substring(v["digest"], F.lit(65), F.greatest(F.lit(0), attempt - (LENGTHEN - 1))), "abcdef", "135790")
        filled = F.concat(_fill(body, v["digest"], F.regexp_replace(body, "[\"']$", "").rlike("^[0-9a-f]+$")), longer)
        octets = F.array_join(F.array(*[(_number(v["digest"], F.lit(i)) % 254 + 1).cast("string") for i in range(4)]), ".")
        octets = F.concat(octets, F.when(longer != "", F.concat(F.lit(":"), longer)).otherwise(""))
        # short local parts would soon repeat: a keyed host name keeps addresses apart
        host = F.concat(F.lit("@m"), F.substring(v["digest"], 97, 8), longer)
        domain = F.concat(host, F.get(F.array(*[F.lit(f".example.{x}") for x in ("com", "net", "org")]), _number(v["digest"], F.lit(0)) % 3))
        mail = F.concat(F.regexp_replace(filled, "@.*$", ""), domain)
        out = F.when(kind == "ip", octets).when(kind == "email", mail).when(kind == "name", _made_up(entity, v["digest"], attempt))
        return out.when(kind == "card", _luhn(F.concat(v["prefix"], filled))).otherwise(F.concat(v["prefix"], filled))

    digest = F.sha2(F.concat_ws("\x1f", F.lit(KEY), kind, canonical(entity, kind), attempt.cast("string")), 512)
    return let(F.struct(prefix_of(entity, kind).alias("prefix"), digest.alias("digest")), with_digest)


def entity_parts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, kind, canon and entity of each part of each entity of the texts, once a text."""
    found = docs.select(*keep, F.explode(F.array_distinct(entities(F.col("text")))).alias("e"))
    found = found.select(*keep, F.explode(parts_of(F.col("e"), type_of(F.col("e")))).alias("p"))
    return found.select(*keep, "p.kind", "p.canon", "p.entity")


def entity_table(docs: DataFrame) -> DataFrame:
    """(kind, canon, entity): the distinct parts of all texts, with one spelling each."""
    return entity_parts(docs).groupBy("kind", "canon").agg(F.min("entity").alias("entity"))


def assign(found: DataFrame) -> DataFrame:
    """``found`` with attempt and surrogate, distinct within a type and equal to no real entity.

    A round draws only for what is still open; the first of several with one surrogate keeps it.
    """
    found = materialize(found, "entities")
    real = found.select("kind", F.col("canon").alias("taken"))
    columns = ("kind", "canon", "entity", "attempt", "surrogate", "taken")
    settled: DataFrame | None = None
    still, attempt = found, 0
    while True:
        drawn = still.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), F.lit(attempt)))
        drawn = materialize(drawn.withColumn("taken", canonical(F.col("surrogate"), F.col("kind"))), "surrogates")
        used = real if settled is None else real.union(settled.select("kind", "taken"))
        owner = drawn.groupBy("kind", "taken").agg(F.min("canon").alias("owner"))
        free = drawn.join(used, ["kind", "taken"], "left_anti").join(owner, ["kind", "taken"]).filter("canon = owner").select(*columns)
        free = materialize(free, "free")
        settled = free if settled is None else settled.union(free)
        still = materialize(drawn.join(free, ["kind", "canon"], "left_anti").select("kind", "canon", "entity"), "open")
        if not still.limit(1).count():
            return settled.drop("taken")
        attempt += 1


def replaced(text: Column, attempts: Column | None = None) -> Column:
    """The text with a surrogate for each entity. ``attempts``: array of (kind, canon, attempt)."""

    def part(p: Column) -> Column:
        if attempts is None:
            return surrogate(p["entity"], p["kind"], F.lit(0))
        mine = F.filter(attempts, lambda a: (a["kind"] == p["kind"]) & (a["canon"] == p["canon"]))
        return surrogate(p["entity"], p["kind"], F.coalesce(F.get(mine, F.lit(0))["attempt"], F.lit(0)))

    def one(e: Column) -> Column:
        title = F.regexp_extract(e, rf"^((?:{TITLES})\.? )", 1)
        between = F.regexp_extract(F.substring(e, F.length(title) + 1, F.length(e)), r"[ \-]", 0)
        return let(type_of(e), lambda kind: let(F.transform(parts_of(e, kind), part), lambda new: F.when(kind == "name", F.concat(title, F.get(new, F.lit(0)), F.when(F.size(new) > 1, F.concat(between, F.get(new, F.lit(1)))).otherwise(""))).otherwise(F.get(new, F.lit(0)))))

    def spliced(found: Column) -> Column:
        parts = F.split(text, ALL, -1)
        new = F.concat(F.transform(found, one), F.array(F.lit("")))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, b)), ""))

    return let(entities(text), spliced)


def anonymize(docs: DataFrame) -> DataFrame:
    """The documents with surrogates in their texts; all columns stay."""
    later = materialize(assign(entity_table(docs)).filter("attempt > 0"), "later")
    if later.limit(1).count():
        # by the text's hash: equal texts have equal entities, and a clash only adds attempts of others
        found = entity_parts(docs.select("text", F.xxhash64("text").alias("th")), "th").select("th", "kind", "canon").distinct()
        attempts, th = fresh(docs, "__attempts"), fresh(docs, "__th")
        of_text = found.join(later.select("kind", "canon", "attempt"), ["kind", "canon"]).groupBy(F.col("th").alias(th)).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(attempts))
        of_text = materialize(of_text, "later-texts")
        if of_text.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
            of_text = F.broadcast(of_text)
        empty = F.array().cast("array<struct<kind:string,canon:string,attempt:int>>")
        columns = docs.columns
        docs = docs.join(of_text, F.xxhash64(docs["text"]) == F.col(th), "left")
        docs = docs.withColumn("text", replaced(F.col("text"), F.coalesce(attempts, empty))).select(*columns)
    else:
        docs = docs.withColumn("text", replaced(F.col("text")))
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the new text, and how many entities the old one had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_entities", F.coalesce(F.size(entities(F.col("text"))), F.lit(0)).cast("long"))
    return anonymize(counted).select("doc_id", "text", "n_entities")

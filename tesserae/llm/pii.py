"""Replacing personal data by surrogates, with DataFrame operations only.

Entities (e-mail addresses, phone numbers, IP addresses, payment cards, US
social security numbers, IBANs, secrets and long hexadecimal keys, names after a
title) are found by one pattern, in one scan. A name that a document has after a
title is an entity wherever the document has it again, with another title or
none, with a capital first letter or in capitals, and in small letters beside
another of its names; a small word alone ("may") is none. Each distinct entity of the table gets one surrogate made from a keyed
hash, of its own type: the same length, letters, digits, script and separators,
a valid check digit (cards) or check digits (IBANs) where it had them, the same
country code (phones, IBANs), valid octets, and for names syllables of the same
script. Mentions that differ only in separators or case get matching
surrogates, and a name has one surrogate whatever its title and whether it is
given or family name; its ending fits the gender that the titles before it as a
given name tell, if they agree. So coreference stays.

Surrogates are checked against each other and against all entities of their
kind: where two meet, all but one are made anew with a further attempt, until
none do. Later attempts have more syllables, digits or letters, so distinct
entities stay distinct however many there are; only then is a length changed.

The texts cross no shuffle but for those with entities; an entity that much of
the table mentions is joined by split tasks. Patterns have no unbounded
repetition that Java's matcher would recurse for, so texts of any length pass.
Null texts stay null and have no entities; empty texts stay empty. Repeated rows
are replaced alike. Rows without doc_id have -1. Columns other than doc_id and
text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import row_id
from .storage import write_table

#: Attempts from which on a surrogate gets longer, by one place an attempt.
WIDEN = 8

#: Titles by the gender they tell.
MALE = "Mr|Sir|Herr|Hr|Sr|Señor|Monsieur|M|г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Sra|Señora|Madame|Mme|Mlle|г-жа|Κυρία"
NEUTRAL = "Dr|Prof"
NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"

#: The pattern of each kind, in order of preference; group 1 is what goes. Each starts where no letter or digit is ahead of it.
PATTERNS: dict[str, str] = {
    "email": r"(?<![._%+\-])([\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9\-]++\.))++[A-Za-z]{2,})",
    "secret": r"(?<!_)(?:(?i)(?:api[_ -]?key|access[_ -]?key|token|secret|password|passwd|pwd|key))\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_\-]{8,}={0,2})",
    "hex": r"([0-9a-fA-F]{32,128})(?![\p{L}\p{N}])",
    "ip": r"(?<!\.)((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?[\p{L}\p{N}])",
    "ssn": r"(?<!-)(\d{3}-\d{2}-\d{4})(?![\p{L}\p{N}\-])",
    "card": r"(?<!-)(\d(?:[ \-]?\d){12,18})(?![\p{L}\p{N}])",
    "phone": r"((?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "iban": r"([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "name": rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\s({NAME}(?: {NAME}){{0,2}})",
}
#: Country codes of phone numbers of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
APART = r"(?<![\p{L}\p{N}])"
ANY = APART + "(?:" + "|".join(PATTERNS.values()) + ")"

#: Alphabets and name syllables by script.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Latin": "abcdefghijklmnopqrstuvwxyz"}
SYLLABLES = {
    "Cyrillic": ("ба ве да ди же ко ла ли ма ми не ни по ра ри ро са се та те фе хо".split(), "на ла ра".split(), "н р в".split()),
    "Greek": ("βα βε γι γο δα δε θε κα κο λα λι μα με νι νο πα ρε ρο σα τα τε φι".split(), "να λα ρα".split(), "ς ν ρ".split()),
    "Latin": ("ba be co da del du fa fe gi gil ha jo ka lin lo ma mer mo na nor pe ra ro sa su tam te va vel wi".split(), "na la ra".split(), "n r s".split()),
}


def _pick(values: list[str] | str, h: Column, i: Column | int) -> Column:
    """One of the values by a hash of h and i."""
    at = F.pmod(F.xxhash64(h, i if isinstance(i, Column) else F.lit(i)), F.lit(len(values))).cast("int")
    if isinstance(values, str):
        return F.substring(F.lit(values), at + 1, F.lit(1))
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def _alike(norm: Column, h: Column) -> Column:
    """As long as norm, each digit by a digit and each letter by one of its script and case."""

    def one(c: Column, i: Column) -> Column:
        latin = ALPHABETS["Latin"]
        out = F.when(c.between("0", "9"), _pick("0123456789", h, i)).when(c.between("a", "z"), _pick(latin, h, i)).when(c.between("A", "Z"), _pick(latin.upper(), h, i)).when(c < "\x80", c)
        for script, letters in ALPHABETS.items():
            out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{Lu}}]"), _pick(letters.upper(), h, i)).when(c.rlike(rf"\p{{Is{script}}}"), _pick(letters, h, i))
        return out.when(c.rlike(r"\p{L}|\p{M}"), _pick(latin, h, i)).otherwise(c)

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _digits(norm: Column, h: Column, kept: Column | int) -> Column:
    """The first `kept` characters of norm, then as many digits as norm has."""
    rest = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.when(i <= kept, F.substring(norm, i, F.lit(1))).otherwise(_pick("0123456789", h, i)))
    return F.array_join(rest, "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (F.pmod(i, F.lit(2)) + 1))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)), F.lit(10))


def _card(norm: Column, h: Column) -> Column:
    """Keeps the first digit; ends in a valid check digit if norm does."""
    made = _digits(norm, h, 1)
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(norm) == 0, F.concat(body, check)).otherwise(made)


def _phone(norm: Column, h: Column) -> Column:
    """Keeps the country code after a plus, else the first digit."""
    return _digits(norm, h, F.greatest(F.length(F.regexp_extract(norm, COUNTRY, 0)), F.lit(1)))


def _mod97(iban: Column) -> Column:
    """The number that an IBAN's letters and digits make, its first four last, modulo 97; 1 for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    each = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(each, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _iban(norm: Column, h: Column, spare: Column) -> Column:
    """Keeps the country; has valid check digits if norm does."""
    made = F.concat(F.substring(norm, 1, 2), _alike(F.substring(norm, F.lit(3), F.length(norm)), h), spare)
    country, body = F.substring(made, 1, 2), F.substring(made, F.lit(5), F.length(made))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(_mod97(norm) == 1, F.concat(country, check, body)).otherwise(made)


def _ip(h: Column) -> Column:
    first = F.pmod(F.xxhash64(h, F.lit(1)), F.lit(222)) + 1
    rest = [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(254)) + 1 for i in (2, 3, 4)]
    return F.concat_ws(".", *(x.cast("string") for x in (first, *rest)))


def _name(norm: Column, sex: Column, attempt: Column, h: Column) -> Column:
    """Syllables of norm's script, more for long names and later attempts, an ending by gender, in two halves where norm has a hyphen or apostrophe."""
    count = F.when(F.length(norm) > 6, 3).otherwise(2) + attempt
    cut = F.regexp_extract(norm, "['’-]", 0)

    def made(syllables: list[str], female: list[str], male: list[str]) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(syllables, h, i)), "")
        tail = F.when(sex == "f", _pick(female, h, 0)).when(sex == "m", _pick(male, h, 0)).otherwise(_pick(syllables, h, 0))
        half = F.concat(cut, F.initcap(F.concat(_pick(syllables, h, -1), _pick(syllables, h, -2))))
        return F.concat(F.initcap(F.concat(body, tail)), F.when(cut != "", half).otherwise(F.lit("")))

    cyrillic, greek = (F.lit(rf"^\p{{Is{x}}}") for x in ("Cyrillic", "Greek"))
    return F.when(F.regexp_like(norm, cyrillic), made(*SYLLABLES["Cyrillic"])).when(F.regexp_like(norm, greek), made(*SYLLABLES["Greek"])).otherwise(made(*SYLLABLES["Latin"]))


def surrogate(kind: Column, norm: Column, sex: Column, attempt: Column, h: Column) -> Column:
    """The surrogate of a normalised entity at an attempt. h: its keyed hash, as a column, since each letter asks for it."""
    more = F.greatest(attempt - WIDEN, F.lit(0))
    spare = F.array_join(F.transform(F.sequence(F.lit(0), more), lambda i: F.when(i > 0, _pick("0123456789", h, -i)).otherwise("")), "")
    top = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    email = F.concat(spare, _alike(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), h), top)
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: _pick("0123456789abcdef", h, i)), "")
    return (
        F.when(kind == "email", email).when(kind == "ip", _ip(h)).when(kind == "name", _name(norm, sex, attempt, h))
        .when(kind == "iban", _iban(norm, h, spare)).otherwise(F.concat(
            F.when(kind == "card", _card(norm, h)).when(kind == "ssn", F.concat(F.lit("9"), F.substring(_digits(norm, h, 1), 2, 8)))
            .when(kind == "phone", _phone(norm, h)).when(kind == "hex", hexes).otherwise(_alike(norm, h)), spare))
    )


def _norm(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", "")).when(kind.isin("email", "hex", "name"), F.lower(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)
    )


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _part(kind: Column, raw: Column, sex: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw"), _norm(kind, raw).alias("norm"), (F.lit(None).cast("string") if sex is None else sex).alias("sex"))


def parts(entity: Column) -> Column:
    """array<struct<kind, raw, norm, sex>> of a matched string; kind null for what stays (a title, the name of a secret)."""
    still = F.lit(None).cast("string")
    kind, core = _kind(entity), F.lit("")
    for name, pattern in reversed(PATTERNS.items()):
        core = F.when(kind == name, F.regexp_extract(entity, f"^{pattern}$", 1)).otherwise(core)
    ahead = F.substring(entity, F.lit(1), F.length(entity) - F.length(core))
    title = F.regexp_extract(entity, r"^(\S+?)\.?\s", 1)
    told = F.when(title.rlike(f"^(?:{MALE})$"), F.lit("m")).when(title.rlike(f"^(?:{FEMALE})$"), F.lit("f"))
    kind = F.when((kind == "secret") & core.rlike("^[0-9a-fA-F]{32,128}$"), F.lit("hex")).otherwise(kind)
    words = F.split(core, " ")
    last = F.size(words) - 1
    names = F.flatten(F.transform(words, lambda w, i: F.array(_part(F.lit("name"), w, F.when(i < last, told)), _part(still, F.when(i == last, F.lit("")).otherwise(F.lit(" "))))))
    return F.concat(F.array(_part(still, ahead)), F.when(kind == "name", names).otherwise(F.array(_part(kind, core))))


def _again(gap: Column, names: Column) -> Column:
    """Parts of a text between matches: names of the document that come again are entities, the rest stays."""
    still = F.lit(None).cast("string")
    one = F.concat(F.lit("(?iu:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    pattern = F.concat(F.lit(APART + r"(?:(?=\p{Lu})"), one, F.lit("|"), one, F.lit("(?= "), one, F.lit(")|(?<=" + APART), one, F.lit(" )"), one, F.lit(")"))
    kept, hits = F.split(gap, pattern, -1), F.regexp_extract_all(gap, pattern, F.lit(0))
    each = F.flatten(F.zip_with(kept, hits, lambda k, x: F.array(_part(still, F.coalesce(k, F.lit(""))), _part(F.when(x.isNotNull(), F.lit("name")), F.coalesce(x, F.lit(""))))))
    return F.when(F.size(names) > 0, each).otherwise(F.array(_part(still, gap)))


def _refill(raw: Column, made: Column) -> Column:
    """made's digits in raw's separators, those it has more of at the end."""
    at = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"\D", ""))
    filled = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(made, at(i), F.lit(1))).otherwise(c)), "")
    return F.concat(filled, F.substring(made, F.length(F.regexp_replace(raw, r"\D", "")) + 1, F.length(made)))


def _rendered(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate as this mention writes it."""
    spaced = F.array_join(F.regexp_extract_all(made, F.lit(".{1,4}"), F.lit(0)), " ")
    small = (kind == "name") & (raw == F.lower(raw))
    capital = (raw == F.upper(raw)) & (kind.isin("email", "hex") | (kind == "name") & (F.length(raw) > 1))
    return F.when(kind.isin("phone", "card", "ssn"), _refill(raw, F.regexp_replace(made, r"\D", ""))).when(small, F.lower(made)).when(capital, F.upper(made)).when((kind == "iban") & raw.contains(" "), spaced).otherwise(made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, made: a surrogate for each distinct entity, no two of a kind alike in any case and none that is an entity itself.

    entities: kind, norm and sex (m, f or null), in any number of rows each.
    """
    told = F.when(F.max(F.col("sex") == "m") & ~F.coalesce(F.max(F.col("sex") == "f"), F.lit(False)), "m").when(F.max(F.col("sex") == "f") & ~F.coalesce(F.max(F.col("sex") == "m"), F.lit(False)), "f")
    all_of = write_table(entities.groupBy("kind", "norm").agg(told.alias("sex")), "entities")
    now = all_of.withColumn("attempt", F.lit(0))
    while True:
        hashed = now.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", F.col("attempt").cast("string")).cast("binary"), 256))
        made = hashed.withColumn("made", surrogate(*(F.col(c) for c in ("kind", "norm", "sex", "attempt", "h")))).drop("h")
        made = write_table(made.withColumn("same", _norm(F.col("kind"), F.col("made"))), "surrogates")
        keeps = made.groupBy("kind", "same").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "same", "first.norm")
        taken = made.select("kind", F.col("same").alias("norm")).join(all_of, ["kind", "norm"], "left_semi").distinct().select("kind", F.col("norm").alias("same"), F.lit(True).alias("taken"))
        bad = made.join(keeps.withColumnRenamed("norm", "first"), ["kind", "same"], "left").join(taken, ["kind", "same"], "left")
        again = F.coalesce("taken", F.lit(False)) | (F.col("first").isNotNull() & (F.col("first") != F.col("norm")))
        now = bad.select("kind", "norm", "sex", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again"))
        if not now.where("again").limit(1).count():
            return made.select("kind", "norm", "made")
        now = now.drop("again")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (sorted, distinct) for every row of docs.

    key: the secret that surrogates are made with; the same key gives the same
    surrogates for the same set of entities.
    """
    found = docs.select(F.monotonically_increasing_id().alias("rid"), row_id(), "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("matched"))
    has = F.coalesce(F.size("matched") > 0, F.lit(False))
    found = found.select("rid", "doc_id", F.when(~has, F.col("text")).alias("text"), has.alias("has"), F.when(has, F.col("matched")).alias("matched"), F.when(has, F.split("text", ANY, -1)).alias("gaps"))
    found = write_table(found, "found")
    clean = found.where("not has").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.expr("array()").cast("array<string>").alias("kinds"))
    marked = found.where("has").select("rid", "doc_id", "gaps", F.transform("matched", parts).alias("entities"))
    named = F.array_distinct(F.transform(F.filter(F.flatten("entities"), lambda p: (p["kind"] == "name") & (F.length(p["raw"]) > 1)), lambda p: p["raw"]))
    marked = marked.withColumn("names", named)
    each = F.zip_with("gaps", "entities", lambda g, e: F.concat(_again(g, F.col("names")), F.coalesce(e, F.expr("array()").cast(_PARTS))))
    pieces = write_table(marked.select("rid", "doc_id", F.posexplode(F.flatten(each)).alias("pos", "p")).select("rid", "doc_id", "pos", "p.*").where("raw <> '' or kind is not null"), "pieces")
    entities = pieces.where("kind is not null")
    made = assign(entities.select("kind", "norm", "sex"), key)
    shown = entities.join(made, ["kind", "norm"]).select("rid", "doc_id", "pos", "kind", _rendered(F.col("kind"), F.col("raw"), F.col("made")).alias("raw"))
    shown = shown.unionByName(pieces.where("kind is null").select("rid", "doc_id", "pos", "kind", "raw"))
    whole = shown.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("all"), F.count("kind").alias("n_entities"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return whole.select("doc_id", F.array_join(F.transform("all", lambda p: p["raw"]), "").alias("text"), "n_entities", "kinds").unionByName(clean)


_PARTS = "array<struct<kind: string, raw: string, norm: string, sex: string>>"

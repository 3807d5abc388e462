"""Surrogates for personal data, with SQL functions only.

Entities: e-mail addresses (domain names of up to 127 labels), phone numbers, IPv4 addresses, card numbers, quoted or bare
hexadecimal secrets, IBANs, and names after a title.  Phone numbers are + and 8 to 15 digits
with or without separators, and national forms: an area code in brackets or with a leading
zero, or ten digits in groups like 415-555-2671.  Each is replaced by a surrogate of its
own type and format, drawn from a keyed hash of type and canonical form, so the same entity
gets the same surrogate everywhere (in upper or lower case, with any separators), and nobody
without the key can tell which.  Titles give the gender of a name; letters stay in their
script and case.  A surrogate that two entities would share, or that equals an entity found
anywhere, is drawn again until all are distinct; names and addresses get longer each time, so
their number is not limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.textkit import stored
from stepwell.session import new_folder

# --- what counts as personal data; Java regular expressions; repeated groups are bounded ----

MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Doña", "Госпожа")
_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES) + ")"

# what may stand between the digits of a number
_GAP = r"[ \u00A0\u2010-\u2013./()-]{0,3}"

PATTERNS = {
    # bounded as addresses are: 254 characters in all, labels of 63, 127 labels; Java matches a
    # group without bound by recursion, and surrogates are built character by character
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,254}+@(?:[\p{L}0-9-]{1,63}+\.){1,126}[\p{L}]{2,63}",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    # a North American number has ten digits after the 1; the last form has any separators
    "phone": rf"\+(?:1(?:{_GAP}[0-9]){{10}}|[0-9](?:{_GAP}[0-9]){{7,14}})(?![0-9])|"
    r"\+[0-9]{1,3}[^\p{L}0-9\n]{1,6}[0-9]{2,4}[^\p{L}0-9\n]{1,6}[0-9]{3,4}[-. ]?[0-9]{3,4}(?![0-9])",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])",
    "card": r"(?<![\p{L}0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}0-9]|[.-][0-9])",
    "national": r"\([2-9][0-9]{2}\)[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\(0[0-9]{1,5}\)[ .-]{0,2}[0-9]{2,8}(?:[ -]?[0-9]{2,5}){1,3}(?![0-9])"
    r"|\([1-9][0-9]{1,2}\)[ .-]{0,2}(?=(?:[ -]?[0-9]){7,9}(?![0-9]))[0-9]{2,5}(?:[ -]?[0-9]{2,4}){1,3}"
    r"|(?<![\p{L}0-9])(?<![0-9][-.,:/+])(?:"
    r"00[1-9](?:[ ./()-]{0,3}[0-9]){7,13}"
    r"|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})"
    r"|0[1-9][0-9]{1,4}(?: ?[/-] ?| )(?=(?:[ -]?[0-9]){5,9}(?![0-9]))[0-9]{2,8}(?:[ -]?[0-9]{2,5}){0,3}"
    r"|0[1-9][0-9]{8,10}"
    r"|[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4})(?![0-9])",
    "secret": r"(?<![\p{L}0-9])(?=[0-9]{0,60}[A-Fa-f])(?=[A-Fa-f]{0,60}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}0-9])",
    # the capital comes first, so that few places look back for a title
    "name": rf"\p{{Lu}}(?<=(?<![\p{{L}}]){_TITLE}\.? .)\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# every entity has one of these in or before it; a text without any is not searched further
HINT = rf"[0-9@]|{_TITLE}\.? \p{{Lu}}"

# country codes of one and of two digits; all others have three
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

# alphabets per script; letters outside them become Latin ones
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
HEX_LETTERS = "abcdef"
# beginnings and endings of surrogate names, per script and gender
NAME_STARTS = {"latin": "Bal Cor Dal Fen Gar Hal Jor Kel Lor Mar Nor Per Ral Sel Tor Vel".split(), "cyrillic": "Бал Вор Гал Дор Ждан Зор Кал Лад Мир Нор Пол Рад Сел Тор Фед Яр".split()}
NAME_MIDDLES = {"latin": "an el im ar on ir al en or is un ed ol in er as".split(), "cyrillic": "ан ел им ар он ир ал ен ор ис ун ед ол ин ер ас".split()}
NAME_ENDS = {("latin", "m"): "o us ard win".split(), ("latin", "f"): "a ina elle ia".split(), ("cyrillic", "m"): "ий ор ан ей".split(), ("cyrillic", "f"): "ия ина ана ея".split()}

# surrogates drawn again that are kept in the plan itself; more are joined by row
FEW = 500


def kind_of(entity: Column) -> Column:
    """Type of a matched text, by its form."""
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(F.startswith(entity, F.lit("+")), "phone")
        .when(entity.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), "card")
        .when(entity.rlike(r"^([0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(entity.rlike(r"^[(0-9]"), "phone")
        .otherwise("name")
    )


def canonical(entity: Column, kind: Column) -> Column:
    """The form under which spellings of one entity meet."""
    return (
        F.when(kind == "phone", F.regexp_replace(entity, "[^+0-9]", ""))
        .when(kind == "card", F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .otherwise(F.lower(entity))
    )


def _stream(secret: str, kind: Column, of: Column, attempt: Column) -> Column:
    """512 keyed bits as hexadecimal digits."""
    seed = lambda half: F.concat_ws("|", F.lit(secret), kind, of, attempt.cast("string"), F.lit(half))
    return F.concat(F.sha2(seed("0"), 256), F.sha2(seed("1"), 256))


def _streams(secret: str, kind: Column, of: Column, attempt: Column) -> Column:
    """Keyed bits of the entity, and of its domain alone if it is an address."""
    domain = F.when(kind == "email", _stream(secret, F.lit("domain"), F.substring_index(of, "@", -1), F.lit(0)))
    return F.struct(_stream(secret, kind, of, attempt).alias("own"), domain.alias("domain"), attempt.alias("attempt"))


def _added(attempt: Column, one) -> Column:
    """``one(place)`` for as many places as there were attempts before, from the stream's end."""
    places = F.slice(F.sequence(F.lit(0), attempt), F.lit(2), attempt)
    return F.array_join(F.transform(places, lambda i: one(F.lit(64) - i)), "")


def _number(stream: Column, at: Column) -> Column:
    """A number below 256 from place ``at`` of the stream; places start over at 64."""
    return F.conv(F.substr(stream, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, value: Column, latin: str = LATIN) -> Column:
    """A letter of the script and case of ``c``."""
    pick = lambda letters: F.substr(F.lit(letters), F.pmod(value, F.lit(len(letters))) + 1, F.lit(1))
    new = F.when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), pick(GREEK)).otherwise(pick(latin))
    return F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)


def _reformed(entity: Column, stream: Column, first: Column, latin: str = LATIN) -> Column:
    """Replace digits by digits and letters by letters but the ``first`` ones; keep the rest.

    A character's draw depends on how many letters and digits stand before it, so
    separators do not matter.
    """

    def one(c, i):
        ordinal = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), r"[^\p{L}0-9]", ""))
        value = _number(stream, ordinal)
        drawn = F.when(c.rlike("[0-9]"), F.pmod(value, F.lit(10)).cast("string")).when(c.rlike(r"\p{L}"), _letter(c, value, latin)).otherwise(c)
        return F.when(ordinal < first, c).otherwise(drawn)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _email(entity: Column, streams: Column) -> Column:
    """New local part; the domain gets the same stand-in wherever it occurs.

    Every label but the last is replaced, and a name reserved for examples ends the domain
    (if it does not do so already), so no mail can go out.
    """
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    labels = F.split(domain, r"\.")
    ending = F.when(domain.rlike(r"(?i)(^|\.)example\.(com|net|org)$"), 2).otherwise(1)
    inner = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - ending), ".")
    top = F.lower(F.element_at(labels, -1))
    end = F.concat(F.lit("example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))
    end = F.when(domain == F.upper(domain), F.upper(end)).otherwise(end)
    head = F.when(inner == "", "").otherwise(F.concat(_reformed(inner, streams["domain"], F.lit(0)), F.lit(".")))
    more = _added(streams["attempt"], lambda at: _letter(F.lit("a"), _number(streams["own"], at)))
    more = F.when(local == F.upper(local), F.upper(more)).otherwise(more)
    return F.concat(_reformed(local, streams["own"], F.lit(0)), more, F.lit("@"), head, end)


def _name(entity: Column, streams: Column, gender: Column) -> Column:
    """A made-up name of as many parts, in the script and gender of the old one."""
    stream, cyrillic = streams["own"], entity.rlike(r"\p{IsCyrillic}")

    def pick(options: list[str], at: int | Column) -> Column:
        place = at if isinstance(at, Column) else F.lit(at)
        return F.element_at(F.split(F.lit(" ".join(options)), " "), F.pmod(_number(stream, place), F.lit(len(options))) + 1)

    def made(script: str, at: int) -> Column:
        end = F.when(gender == "f", pick(NAME_ENDS[script, "f"], at + 3)).otherwise(pick(NAME_ENDS[script, "m"], at + 3))
        more = _added(streams["attempt"], lambda place: pick(NAME_MIDDLES[script], place - at))
        return F.concat(pick(NAME_STARTS[script], at), pick(NAME_MIDDLES[script], at + 1), pick(NAME_MIDDLES[script], at + 2), more, end)

    one = lambda at: F.when(cyrillic, made("cyrillic", at)).otherwise(made("latin", at))
    return F.when(F.contains(entity, F.lit(" ")), F.concat(one(0), F.lit(" "), one(8))).otherwise(one(0))


def surrogate(entity: Column, kind: Column, gender: Column, streams: Column) -> Column:
    """The stand-in for one matched text."""
    stream, nothing = streams["own"], F.lit(0)
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda _, i: (F.pmod(_number(stream, i), F.lit(254)) + 1).cast("string")), ".")
    # characters that stay: the country code or leading zeros of a number, the country of an account
    dialled = canonical(entity, F.lit("phone"))
    prefix = F.length(F.concat(F.regexp_extract(dialled, rf"^\+({_COUNTRY})", 1), F.regexp_extract(dialled, "^0{0,2}", 0)))
    first = F.when(kind == "phone", prefix).when(kind == "iban", 2).otherwise(nothing)
    return (
        F.when(kind == "email", _email(entity, streams))
        .when(kind == "ip", octets)
        .when(kind == "secret", _reformed(entity, stream, nothing, HEX_LETTERS))
        .when(kind == "name", _name(entity, streams, gender))
        .otherwise(_reformed(entity, stream, first))
    )


def _found(text: Column) -> Column:
    all_of = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(HINT), all_of).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    """What stands between the matches; one piece more than there are matches."""
    return F.when(text.rlike(HINT), F.split(text, ANY, -1)).otherwise(F.array(F.coalesce(text, F.lit(""))))


def _genders(pieces: Column, entities: Column) -> Column:
    """Gender by the title before each match; empty where there is none."""
    female = r"(?<![\p{L}])(?:" + "|".join(FEMALE_TITLES) + r")\.? $"
    male = r"(?<![\p{L}])(?:" + "|".join(MALE_TITLES) + r")\.? $"
    near = lambda i: F.right(F.element_at(pieces, i + 1), F.lit(24))
    return F.transform(entities, lambda e, i: F.when(kind_of(e) != "name", "").when(near(i).rlike(female), "f").when(near(i).rlike(male), "m").otherwise(""))


def redraws(entities: DataFrame, secret: str, rounds: int = 20) -> DataFrame:
    """(kind, of, attempt) of the entities whose first surrogate is taken.

    ``entities``: distinct kind, of, gender, entity, so every surrogate that can be written is
    looked at.  Of the entities that share a surrogate the first keeps it; one that equals an
    entity of the corpus is drawn again as well, in all its spellings and genders.
    """
    attempts = entities.select("kind", "of", "gender", "entity", F.lit(0).alias("attempt"))
    for _ in range(rounds):
        drawn = attempts.withColumn("_s", _streams(secret, F.col("kind"), F.col("of"), F.col("attempt")))
        drawn = drawn.withColumn("_n", surrogate(F.col("entity"), F.col("kind"), F.col("gender"), F.col("_s")))
        drawn = stored(drawn.withColumn("new", canonical(F.col("_n"), F.col("kind"))).drop("_s", "_n"))
        shared = drawn.groupBy("kind", "new").agg(F.min("of").alias("owner"), F.max("of").alias("last")).filter("owner <> last")
        losers = drawn.join(shared.select("kind", "new", "owner"), ["kind", "new"]).filter("of <> owner").select("kind", "of")
        originals = entities.select("kind", F.col("of").alias("new"))
        known = drawn.join(originals, ["kind", "new"], "left_semi").select("kind", "of")
        again = stored(losers.union(known).distinct())
        if again.isEmpty():
            break
        again = again.withColumn("more", F.lit(1))
        attempts = stored(
            drawn.drop("new").join(again, ["kind", "of"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
        )
    else:
        raise RuntimeError("surrogates still collide; there are too few of a type")
    return drawn.filter("attempt > 0").select("kind", "of", "attempt").distinct()


def pseudonymise(docs: DataFrame, secret: str = "surrogate-key", text: str = "text", details: bool = False) -> DataFrame:
    """Replace the entities of ``text`` in every row; all other columns pass through.

    With ``details``, ``entities`` (kind, old, new per match, in order) is added; a column of
    that name is replaced.  NULL texts stay NULL, texts without entities stay as they are.
    Equal texts get equal results, and reruns with one key agree.  An empty table gives an
    empty result.
    """
    names = [c for c in docs.columns if not (details and c == "entities")]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[text].alias("_text"))
    spelled = (
        rows.select(_found(F.col("_text")).alias("_e"), _pieces(F.col("_text")).alias("_p"))
        .select(F.explode(F.arrays_zip(F.col("_e").alias("entity"), _genders(F.col("_p"), F.col("_e")).alias("gender"))).alias("_m"))
    )
    named = spelled.select("_m.entity", "_m.gender").withColumn("kind", kind_of(F.col("entity")))
    distinct = stored(named.distinct().withColumn("of", canonical(F.col("entity"), F.col("kind"))))
    again = stored(redraws(distinct, secret))
    count = again.count()
    if count <= FEW:
        known = {(r["kind"], r["of"]): r["attempt"] for r in again.collect()}
        matched = rows.withColumns({"_e": _found(F.col("_text")), "_p": _pieces(F.col("_text"))})
        attempt = lambda _: F.lit(0)
        if known:
            table = F.create_map(*[x for (k, of), n in sorted(known.items()) for x in (F.lit(f"{k}|{of}"), F.lit(n))])
            attempt = lambda m: F.coalesce(F.try_element_at(table, F.concat(m["k"], F.lit("|"), m["of"])), F.lit(0))
    else:
        matched = _joined(rows, again)
        attempt = lambda m: m["a"]
    # entity by entity: type, canonical form, keyed bits, surrogate
    tried = F.col("_a") if "_a" in matched.columns else F.array().cast("array<int>")
    each = F.arrays_zip(F.col("_e").alias("e"), _genders(F.col("_p"), F.col("_e")).alias("g"), tried.alias("a"))
    each = F.transform(each, lambda m: F.struct(m["e"].alias("e"), m["g"].alias("g"), m["a"].alias("a"), kind_of(m["e"]).alias("k")))
    each = F.transform(each, lambda m: F.struct(m["e"].alias("e"), m["g"].alias("g"), m["a"].alias("a"), m["k"].alias("k"), canonical(m["e"], m["k"]).alias("of")))
    each = F.transform(each, lambda m: F.struct(m["e"].alias("e"), m["g"].alias("g"), m["k"].alias("k"), _streams(secret, m["k"], m["of"], attempt(m)).alias("s")))
    new = F.transform(each, lambda m: F.struct(m["k"].alias("kind"), m["e"].alias("old"), surrogate(m["e"], m["k"], m["g"], m["s"]).alias("new")))
    matched = matched.withColumn("_m", new).withColumn("_n", F.transform("_m", lambda m: m["new"]))
    glued = F.array_join(F.flatten(F.zip_with("_p", "_n", lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    clean = F.when(F.size("_e") == 0, F.col("_text")).otherwise(glued)
    columns = [clean.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names]
    if details:
        columns.append(F.col("_m").alias("entities"))
    return matched.select(columns)


def _joined(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Attempts looked up by a join, for any number of redrawn surrogates."""
    spark = rows.sparkSession
    path = new_folder(spark)
    rows.withColumns({"_id": F.monotonically_increasing_id(), "_e": _found(F.col("_text")), "_p": _pieces(F.col("_text"))}).write.parquet(path)
    fixed = spark.read.parquet(path)
    each = fixed.select("_id", F.posexplode("_e").alias("at", "entity"))
    each = each.withColumn("kind", kind_of(F.col("entity"))).withColumn("of", canonical(F.col("entity"), F.col("kind")))
    tried = each.join(again, ["kind", "of"], "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("attempt", F.lit(0)).alias("n")))).alias("_t"))
    both = fixed.join(tried, "_id", "left")
    return both.withColumn("_a", F.coalesce(F.transform("_t", lambda t: t["n"]), F.array().cast("array<int>")))

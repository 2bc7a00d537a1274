"""PII: detected entities get keyed surrogates of their own type and form.

All on the JVM: DataFrame functions only. One pattern finds e-mail addresses,
phone, card, account and social-security numbers, IP addresses, secrets (long
hex strings) and people named with a title. Phone numbers are those in groups
of 3-3-4 digits, North American ones run together, and all that begin with +
and a country's code; national numbers of other groupings are not told from
other numbers. A name is all capitalised words and initials after the title. An entity's canonical form (digits
of a number, lower-cased address, a name's part) and a key give its surrogate
by SHA-256, so the same entity is the same surrogate in all documents
and spellings; the surrogate is written in the form of each mention: its
punctuation, case, number of digits, script and, for names, gender. Card
and account numbers stay valid or invalid by their check digits.

A person who was named with a title in a text is replaced there without it
too: the whole name as it was written, and the surname by itself.

Collisions are checked over the whole corpus: the distinct entities, with
surrogates that another entity has too, or that are themselves an entity of
the corpus, are tried again with the next attempt until all differ. Only the
entities that needed another attempt are looked up when texts are written;
that table is broadcast if it is counted to be small, otherwise it is joined
through the mentions.

A very long text is one row as any other, and is gone through whole.

Defined results: a null text stays null, an empty one empty; a text without
entities comes back as it is; of entities that tie for a surrogate the least
in code point order gets it; repeated rows and entities give equal results;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage

KEY = "weft-demonstration-key"
BROADCAST_EXCEPTIONS = 50_000

_MALE_TITLES = r"Mr\.?|Herr|Señor|Sr\.|Monsieur|г-н"
_FEMALE_TITLES = r"Mrs\.?|Ms\.?|Frau|Señora|Sra\.|Madame|Mme\.?|г-жа"
_TITLE = rf"(?:{_FEMALE_TITLES}|{_MALE_TITLES}|(?:Prof\.|Professor)(?: Dr\.)?|Dr\.)"
# Names: words with inner capitals, apostrophes (but not 's) and hyphens; initials; particles. A name goes on as long as its parts do.
_PARTICLE = r"(?:von|van|vom|zu|der|den|ter|ten|de|del|della|di|da|dos|du|la|le|bin|ibn)"
_DOTTED = r"\p{Lu}\p{Ll}?\.(?:-?\p{Lu}\.)*"
_INITIAL = rf"(?:{_DOTTED}|\p{{Lu}}(?![\p{{L}}\p{{M}}'’\-]))"
_JOINT = r"(?:\-|['’](?!(?:s|d|ll|ve|re)(?!\p{L})))"
_WORD = rf"(?!(?:Jr|Sr|II|III|IV)(?!\p{{L}}))(?:\p{{Ll}}{{1,3}}['’\-])?\p{{Lu}}(?:[\p{{L}}\p{{M}}]+|(?={_JOINT}\p{{L}}))(?:{_JOINT}\p{{L}}[\p{{L}}\p{{M}}]*)*"
_PART = rf"(?:(?:{_PARTICLE}|{_INITIAL}) )*{_WORD}"
_NAME = rf"(?:{_PART}(?: {_PART})*(?: {_DOTTED})*|{_INITIAL}(?: {_DOTTED})*)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]*[\p{L}\p{N}])+"
_HEX = r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_IP = rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\p{{N}})(?!\.\p{{N}})"
# All eight groups, or fewer with a double colon.
_IPV6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]{0,40}::)(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4})(?![\p{L}\p{N}:])"
_CARD = r"(?<!\p{N})(?:\d{13,19}|\d{4}(?:[ .\-]\d{4}){3}(?:[ .\-]\d{3})?|\d{4}[ .\-]\d{6}[ .\-]\d{4,5}|\d{4}[ .\-]\d{4}[ .\-]\d{5}|\d{6}[ .\-]\d{13})(?!\p{N})"
_SSN = r"(?<![\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{N}\-])"
_GROUPED = r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"
# In groups of 3-3-4, with the last two or all run together, or after a country's code in any groups.
_PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:{_GROUPED}|\+(?:[ .\-/]?\(?\d\)?){{7,15}}|(?:\(\d{{3}}\)[ .\-]?|\d{{3}}[ .\-])\d{{7}}|(?<![_.,])1?[2-9]\d{{2}}[2-9]\d{{6}}(?![.,]?\p{{N}}))(?!\p{{N}})"
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_PERSON = rf"(?<!\p{{L}}){_TITLE} {_NAME}"
# Each alternative needs what the lookahead before it asks for, and each mention what the first one does: within words, nearly
# all places are passed over by one look instead of nine. They change no match.
_START = r"(?=[0-9:+(]|[\p{L}\p{N}._%\-](?<!\p{L}.))"
PATTERN = _START + "(?:" + "|".join([
    _EMAIL, rf"(?=[0-9a-fA-F]{{8}}){_HEX}", rf"(?=[A-Z]{{2}}\d){_IBAN}", rf"(?=[0-9a-fA-F]{{0,4}}:){_IPV6}", rf"(?=\d)(?:{_IP}|{_CARD}|{_SSN})", rf"(?=[0-9+(]){_PHONE}", rf"(?=[MDHFSPг]){_PERSON}",
]) + ")"

#: Every mention has one of these; texts without any are passed over by this one cheap search.
HINT = r"[@0-9]|::|[MDHFSPг](?:r|s|err|rau|eñor|onsieur|adame|me|-)|[a-fA-F]{32}"

# Surrogate names, our own choice: fixed values.
MALE = "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah Oscar Paul".split()
FEMALE = "Anna Berta Clara Diana Emma Flora Greta Helen Ida Julia Karin Laura Maria Nora Olga Paula".split()
EITHER = "Alex Chris Dana Eli Jamie Kim Lee Lou Noa Robin Sam Sascha Sky Terry Toni Val".split()
STEMS = "Al Bran Cor Dal Eck Fal Gor Hol Jan Kel Lin Mar Nor Ost Pal Ros Sal Tor Val Wes".split()
ENDS = "berg den feld garth holt ing ley man ner rick sen son stead stein ton ville wald wick wood worth".split()
MALE_CYRILLIC = "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split()
FEMALE_CYRILLIC = "Алла Вера Галина Дарья Елена Жанна Инна Кира Лидия Мария Нина Ольга".split()
STEMS_CYRILLIC = "Бел Вол Гор Дуб Зим Кал Лоб Мор Нос Пет Род Сок".split()


def _sql_list(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once: a lambda's argument, where an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind(mention: Column) -> Column:
    """What an extracted mention is."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^{_TITLE} "), "person")
        .when(mention.contains(":"), "ipv6")
        .when(mention.rlike("^[0-9a-fA-F]{32,128}$"), "secret")
        .when(mention.rlike("^[A-Z]{2}"), "iban")
        .when(mention.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when((digits >= 13) & ~mention.startswith("+"), "card")
        .otherwise("phone")
    )


def units(mention: Column) -> Column:
    """The entities of a mention: array of struct(kind, canon); a person has a given name, if there are two, and a surname."""
    return _let(kind(mention), lambda k: _units(mention, k))


def _units(mention: Column, k: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    canon = (
        F.when(k == "email", F.lower(mention))
        .when(k.isin("secret", "ipv6"), F.lower(mention))
        .when(k == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(k == "ip", mention)
        .when((k == "phone") & (mention.rlike(f"^{_GROUPED}$") | ~mention.startswith("+")), F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1))))
        .when(k == "phone", F.regexp_replace(F.regexp_replace(F.regexp_replace(mention, r"\(0\)", ""), r"\D", ""), _COUNTRY, ""))
        .otherwise(digits)
    )
    one = F.array(F.struct(k.alias("kind"), canon.alias("canon")))
    people = F.transform(_names(mention), lambda x: F.struct(x["kind"].alias("kind"), _canon_name(x["kind"], x["raw"], mention).alias("canon")))
    return F.when(k == "person", people).otherwise(one)


def _names(mention: Column) -> Column:
    """The parts of a person's name as written: array of struct(kind, raw); particles belong to the surname."""
    sex = F.when(mention.rlike(rf"^(?:{_FEMALE_TITLES}) "), "female").when(mention.rlike(rf"^(?:{_MALE_TITLES}) "), "male").otherwise("either")
    given = lambda text: F.transform(
        F.filter(F.split(text, " "), lambda x: (x != "") & ~x.rlike(f"^{_PARTICLE}$")), lambda x: F.struct(F.concat(F.lit("given_"), sex).alias("kind"), x.alias("raw"))
    )

    def parts(name: Column) -> Column:
        tail = F.regexp_extract(name, rf"((?: {_DOTTED})*)$", 1)
        core = F.substr(name, F.lit(1), F.length(name) - F.length(tail))
        surname = F.regexp_extract(core, rf"(?:^| )((?:{_PARTICLE} )*{_WORD})$", 1)
        before = F.substr(core, F.lit(1), F.length(core) - F.length(surname))
        last = F.filter(F.array(F.struct(F.lit("surname").alias("kind"), surname.alias("raw"))), lambda x: x["raw"] != "")
        return F.concat(given(before), last, given(tail))

    return _let(F.regexp_replace(mention, rf"^{_TITLE} ", ""), parts)


def _canon_name(kind_: Column, raw: Column, mention: Column) -> Column:
    plain = F.replace(raw, F.lit("’"), F.lit("'"))
    cased = F.when((F.length(plain) > 2) & (F.upper(plain) == plain) & ~plain.contains("."), F.initcap(plain)).otherwise(plain)
    # One family, two endings.
    return F.when((kind_ == "surname") & _is_female_form(raw, mention), F.regexp_replace(cased, "а$", "")).otherwise(cased)


def _is_female_form(raw: Column, mention: Column) -> Column:
    return mention.rlike(rf"^(?:{_FEMALE_TITLES}) ") & raw.rlike(r"\p{IsCyrillic}$") & raw.endswith("а")


def _hash(what: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits."""
    base = F.concat_ws("|", F.lit(key), what, attempt.cast("string"), canon)
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(base, F.lit("|2")), 256))


def _number(h: Column, i: Column) -> Column:
    """The i-th of 32 numbers below 65536 in a hash, around and around."""
    return F.conv(F.substr(h, (F.pmod(i, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.expr(_sql_list(words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _chars(text: Column, of) -> Column:
    """Join of `of(character, place)` over a text's characters."""
    return F.array_join(F.transform(F.split(text, ""), of), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check; a valid number has one that ends in 0."""
    # From the right, every second digit counts double.
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of an account number read as digits, letters as 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def surrogate(what: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical form, in canonical form."""
    return _let(_hash(what, canon, attempt, key), lambda h: _surrogate(what, canon, attempt, key, h))


def _surrogate(what: Column, canon: Column, attempt: Column, key: str, h: Column) -> Column:
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    digit = lambda i: (_number(h, i) % 10).cast("string")
    any_digits = _chars(canon, lambda c, i: digit(i))
    local = F.substring_index(canon, "@", 1)
    mail = F.concat(
        _chars(local, lambda c, i: F.when(c.rlike(r"\d"), digit(i)).when(c.rlike(r"\p{L}"), F.substr(letters, (_number(h, i) % 26 + 1).cast("int"), F.lit(1))).otherwise(c)),
        F.lit("@mail"),
        F.substr(F.sha2(F.concat_ws("|", F.lit(key), attempt.cast("string"), F.substring_index(canon, "@", -1)), 256), F.lit(1), F.lit(6)),
        F.lit(".example."),
        F.when(canon.rlike(r"\.(com|net|org)$"), F.substring_index(canon, ".", -1)).otherwise("com"),
    )
    octets = F.array_join(
        F.transform(
            F.split(canon, r"\."),
            lambda o, i: F.when(attempt > 8, _number(h, i) % 256).when(F.length(o) == 3, 100 + _number(h, i) % 156).when(F.length(o) == 2, 10 + _number(h, i) % 90).otherwise(_number(h, i) % 10).cast("string"),
        ),
        ".",
    )
    def with_check(body: Column) -> Column:
        end = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
        other = F.pmod(end + 1 + _number(h, F.lit(31)) % 9, F.lit(10))
        return F.concat(body, F.when(_luhn(canon) % 10 == 0, end).otherwise(other).cast("string"))

    card = _let(F.substr(any_digits, F.lit(1), F.length(canon) - 1), with_check)
    phone = _chars(canon, lambda c, i: F.when((F.length(canon) == 10) & (F.substr(canon, F.lit(4), F.lit(3)) == "555") & i.isin(3, 4, 5), c).otherwise(digit(i)))
    secret = _chars(canon, lambda c, i: F.substr(F.lit("0123456789abcdef"), (_number(h, i) / F.pow(F.lit(16), F.floor(i / 32)) % 16 + 1).cast("int"), F.lit(1)))
    hexes = _chars(canon, lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("123456789abcdef"), (_number(h, i) % 15 + 1).cast("int"), F.lit(1))))
    account = _chars(F.substr(canon, F.lit(5)), lambda c, i: F.when(c.rlike(r"\d"), digit(i)).otherwise(F.upper(F.substr(letters, (_number(h, i) % 26 + 1).cast("int"), F.lit(1)))))
    country = F.substr(canon, F.lit(1), F.lit(2))

    def with_check_97(body: Column) -> Column:
        """Check digits that hold if the original's do."""
        good = 98 - _mod97(F.concat(body, country, F.lit("00")))
        other = F.pmod(good + 1 + _number(h, F.lit(30)) % 95, F.lit(97))
        check = F.when(_mod97(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1, good).otherwise(other)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    iban = _let(account, with_check_97)
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    stem = F.concat(_pick(STEMS, _number(h, F.lit(0))), _pick(ENDS, _number(h, F.lit(1))))
    # A second part once the plain names don't suffice, then a third.
    more = F.concat(stem, F.when(attempt > 2, F.concat(F.lit("-"), _pick(STEMS, _number(h, F.lit(2))), _pick(ENDS, _number(h, F.lit(3))))).otherwise(""), F.when(attempt > 6, F.concat(F.lit("-"), _pick(STEMS, _number(h, F.lit(4))), _pick(ENDS, _number(h, F.lit(5))))).otherwise(""))
    stem_c = F.concat(_pick(STEMS_CYRILLIC, _number(h, F.lit(0))), F.lit("ов"))
    more_c = F.concat(F.when(attempt > 0, F.concat(_pick(STEMS_CYRILLIC, _number(h, F.lit(1))), F.lit("о"))).otherwise(""), F.when(attempt > 2, F.concat(F.lower(_pick(STEMS_CYRILLIC, _number(h, F.lit(2)))), F.lit("о"))).otherwise(""), F.when(attempt > 0, F.lower(stem_c)).otherwise(stem_c))
    second = lambda words: F.when(attempt > 1, F.concat(F.lit("-"), _pick(words, _number(h, F.lit(1))))).otherwise("")
    third = lambda words: F.when(attempt > 3, F.concat(F.lit("-"), _pick(words, _number(h, F.lit(2))), F.lower(_pick(words, _number(h, F.lit(3)))))).otherwise("")
    # Names grow with the attempts, so that there is always one left.
    longer = lambda words: F.when(attempt > 8, F.array_join(F.transform(F.sequence(F.lit(9), F.greatest(attempt, F.lit(9))), lambda i: F.lower(_pick(words, _number(h, i)))), "")).otherwise("")
    given = lambda words: F.concat(_pick(words, _number(h, F.lit(0))), second(words), third(words), longer(words))
    more, more_c = F.concat(more, longer(ENDS)), F.concat(more_c, longer(STEMS_CYRILLIC), F.when(attempt > 8, "ов").otherwise(""))
    return (
        F.when(what == "email", mail)
        .when(what == "ip", octets)
        .when(what == "ipv6", hexes)
        .when(what == "card", card)
        .when(what == "phone", phone)
        .when(what == "ssn", any_digits)
        .when(what == "secret", secret)
        .when(what == "iban", iban)
        .when(what == "surname", F.when(cyrillic, more_c).otherwise(more))
        .when(what == "given_female", F.when(cyrillic, given(FEMALE_CYRILLIC)).otherwise(given(FEMALE)))
        .when(what == "given_male", F.when(cyrillic, given(MALE_CYRILLIC)).otherwise(given(MALE)))
        .otherwise(F.when(cyrillic, given(MALE_CYRILLIC)).otherwise(given(EITHER)))
    )


def _like(mention: Column, made: Column) -> Column:
    """Fill the digits (or letters and digits) of a mention with those of a surrogate, from the right."""
    marks = r"[^\p{L}\p{N}]"
    chars = F.split(mention, "")
    # How many of the characters up to each one are filled.
    seen = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), marks, "")))
    shift = F.length(made) - F.length(F.regexp_replace(mention, marks, ""))
    pairs = F.arrays_zip(chars.alias("c"), seen.alias("n"))
    return _let(shift, lambda by: F.array_join(F.transform(pairs, lambda p: F.when(p["c"].rlike(marks) | (p["n"] + by < 1), p["c"]).otherwise(F.substr(made, p["n"] + by, F.lit(1)))), ""))


def render(mention: Column, made: Column) -> Column:
    """The surrogates `made` of a mention's entities, written as the mention is."""
    return _let(kind(mention), lambda k: _render(mention, made, k))


def _render(mention: Column, made: Column, k: Column) -> Column:
    one = F.element_at(made, 1)
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    cased = F.when(upper, F.upper(one)).otherwise(one)
    title = F.regexp_extract(mention, rf"^({_TITLE} )", 1)

    def part(x: Column, made_: Column) -> Column:
        letter = F.when(F.substr(made_, F.lit(1), F.lit(1)) == F.substr(x["raw"], F.lit(1), F.lit(1)), F.upper(F.substr(made_, F.lit(2), F.lit(1)))).otherwise(F.substr(made_, F.lit(1), F.lit(1)))
        shout = (F.length(x["raw"]) > 2) & (F.upper(x["raw"]) == x["raw"])
        name = F.concat(made_, F.when((x["kind"] == "surname") & _is_female_form(x["raw"], mention), "а").otherwise(""))
        initial = F.concat(letter, F.when(x["raw"].endswith("."), ".").otherwise(""))
        return F.when((x["kind"] != "surname") & x["raw"].rlike(f"^{_INITIAL}$"), initial).when(shout, F.upper(name)).otherwise(name)

    person = F.concat(title, F.array_join(F.zip_with(_names(mention), made, part), " "))
    return F.when(k == "person", person).when(k.isin("email", "secret", "ipv6"), cased).when(k == "ip", one).otherwise(_like(mention, one))


def _mentions(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("mentions"))


def entities(docs: DataFrame) -> DataFrame:
    """kind and canon of each distinct entity."""
    found = _mentions(docs).where(F.size("mentions") > 0).select(F.explode(F.array_distinct("mentions")).alias("m")).distinct()
    return found.select(F.explode(units(F.col("m"))).alias("u")).select("u.kind", "u.canon").distinct()


def exceptions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon and attempt of the entities whose first surrogate was taken."""
    known = stage(entities(docs), "pii-entities")
    taken = None
    left = known.select("kind", "canon")
    done = []
    for attempt in count():  # the spaces grow with the attempts
        tried = left.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        tried = tried.join(known.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_anti")
        if taken is not None:
            tried = tried.join(taken, ["kind", "made"], "left_anti")
        won = tried.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        won = stage(won.select("kind", "canon", "made", F.lit(attempt).alias("attempt")), "pii-won")
        done.append(won)
        taken = won.select("kind", "made") if taken is None else taken.unionByName(won.select("kind", "made"))
        left = stage(left.join(won, ["kind", "canon"], "left_anti"), "pii-left")
        if not left.limit(1).count():
            break
    out = done[1:] or [done[0].limit(0)]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].select("kind", "canon", "attempt")


def _untitled(text: Column) -> Column:
    """The text, with the names of its titled people replaced where they stand without a title: whole names first, then surnames."""
    bare = lambda x: F.regexp_replace(x, rf"^{_TITLE} ", "")
    last = lambda x: F.regexp_extract(bare(x), rf"({_WORD})$", 1)
    people = F.filter(F.arrays_zip(F.col("mentions").alias("m"), F.col("made").alias("s")), lambda x: x["m"].rlike(rf"^{_TITLE} "))
    pairs = F.flatten(F.transform(people, lambda x: F.array(F.struct(bare(x["m"]).alias("a"), bare(x["s"]).alias("b")), F.struct(last(x["m"]).alias("a"), last(x["s"]).alias("b")))))
    pairs = F.array_distinct(F.filter(pairs, lambda x: (F.length(x["a"]) > 2) & (x["b"] != "")))
    pairs = F.reverse(F.array_sort(F.transform(pairs, lambda x: F.struct(F.length(x["a"]).alias("n"), x["a"].alias("a"), x["b"].alias("b")))))
    mark = r"[\p{L}\p{M}\p{N}]"
    again = F.aggregate(pairs, text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(rf"(?<!{mark})\Q"), x["a"], F.lit(rf"\E(?!{mark})")), x["b"]))
    return F.when(F.size(pairs) > 0, again).otherwise(text)


def anonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the text with surrogates, and the number of mentions, of every row of `docs` (doc_id, text)."""
    odd = stage(exceptions(docs, key), "pii-exceptions")
    n_odd = odd.count()
    rows = _mentions(docs)
    entry = F.struct(F.concat_ws("|", "kind", "canon").alias("key"), F.col("attempt").alias("value"))
    if not n_odd:
        rows = rows.withColumn("odd", F.lit(None).cast("map<string,int>"))
    elif n_odd <= BROADCAST_EXCEPTIONS:
        rows = rows.crossJoin(F.broadcast(odd.agg(F.map_from_entries(F.collect_list(entry)).alias("odd"))))  # one row
    else:
        rows = rows.withColumn("tkey", F.xxhash64("text"))
        used = rows.where(F.size("mentions") > 0).select("doc_id", "tkey", F.explode(F.array_distinct("mentions")).alias("m")).select("doc_id", "tkey", F.explode(units(F.col("m"))).alias("u"))
        used = used.select("doc_id", "tkey", "u.kind", "u.canon").distinct().join(odd, ["kind", "canon"])
        used = used.groupBy(F.col("doc_id").alias("o_id"), F.col("tkey").alias("o_key")).agg(F.map_from_entries(F.collect_set(entry)).alias("odd"))
        rows = rows.join(used, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("tkey") == F.col("o_key")), "left")

    def write(m: Column) -> Column:
        made = F.transform(
            units(m),
            lambda u: surrogate(u["kind"], u["canon"], F.coalesce(F.try_element_at(F.col("odd"), F.concat_ws("|", u["kind"], u["canon"])), F.lit(0)), key),
        )
        return _let(made, lambda x: render(m, x))

    made = F.transform("mentions", write)
    pieces = F.split("text", PATTERN, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.get("made", i - 1)).otherwise(""), p)), "")
    # One pass: what has no mention is handed on as it is.
    rows = rows.withColumn("made", made)
    return rows.select("doc_id", F.when(F.size("mentions") > 0, _untitled(joined)).otherwise(F.col("text")).alias("text"), F.size("mentions").cast("long").alias("n_entities"))

"""Personal data replaced by keyed surrogates, with built-in functions only.

Mentions are found by patterns. Each has a type and a canonical form: the digits
of a number, an address in lower case, a key or a password as it is, a name in
lower case. The surrogate of a canonical form depends on a secret key, the type
and the form only, so the same thing is replaced alike everywhere, however it is
written; it keeps what the type needs (length, separators, a card's first digit
and check digit, a number's country code, a domain's ending, title, gender and
script of a name). All canonical forms of the table are checked: where two have
the same surrogate, or a surrogate is itself a form of the table, one of them
tries again, until all surrogates are distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Signor|г-н|господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|госпожа"
_EITHER = "Dr|Prof|Doctor|Professor|Professeur|Doktor|Docteur|Доктор|Профессор"
_LETTER = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]"
_GIVEN = rf"(?=\p{{Lu}}){_LETTER}(?:{_LETTER}+|(?=['’]))(?:['’-]{_LETTER}+)*"
_SETTING = "password|passwd|pwd|secret|token|api[_-]?key"
_HEX = "[0-9A-Fa-f]{1,4}"

PATTERNS = {
    "email": r"(?<![\w\p{L}.%+-])[\w\p{L}.%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,24}(?![\p{L}0-9-])",
    "secret": rf"(?<![A-Za-z])(?i:(?:{_SETTING})\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[a-z+/_-]{{0,200}}\d)"
    r"|(?:password|passwd|pwd)\s{0,3}=\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,40}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:.])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|(?:\d{4}-){3}\d{1,7}|(?:\d{4} ){3}\d{1,7})(?!\d)",
    "male": rf"(?<!\p{{L}})(?=[MHSг])(?:{_MALE})\.? {_GIVEN}(?: {_GIVEN})?",
    "female": rf"(?<!\p{{L}})(?=[MFSг])(?:{_FEMALE})\.? {_GIVEN}(?: {_GIVEN})?",
    "either": rf"(?<!\p{{L}})(?=[DPДП])(?:{_EITHER})\.? {_GIVEN}(?: {_GIVEN})?",
}
"""What a mention of each type looks like; earlier types win.

Names are those after a title, in Latin, Greek or Cyrillic letters; ``either`` has
the titles that go with both genders.
"""

NUMBERS = ("phone", "ssn", "card")
NAMES = ("male", "female", "either")

_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_MAYBE = (
    rf"[@0-9]|(?=[MHFSDPгДП])(?:{_MALE}|{_FEMALE}|{_EITHER})\.? \p{{Lu}}"
    r"|(?=[Pp])(?i:password|passwd|pwd)\s{0,3}=|::"
)
"""Few texts pass this, and only those are searched with all patterns."""
_LEAD = {
    "secret": r"^([A-Za-z_-]+\s{0,3}[=:]\s{0,3}[\"']?)",
    "key": r"^(AKIA)",
    "male": rf"^((?:{_MALE})\.? )",
    "female": rf"^((?:{_FEMALE})\.? )",
    "either": rf"^((?:{_EITHER})\.? )",
}

_SCRIPTS = {"latin": r"\p{IsLatin}", "greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}"}

# Given names by gender and script, and syllables of family names.
_NAMES = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("female", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helena Ida Julia Laura Maria Nora Olga Paula Rosa".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Марк Никита Олег Павел Роман Степан Юрий".split(),
    ("male", "greek"): "Άγγελος Βασίλης Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος Στέφανος Φώτης Χάρης Ορέστης".split(),
    ("female", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θεοδώρα Ιωάννα Κατερίνα Μαρία Νίκη Ουρανία Σοφία Φωτεινή Χριστίνα".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София Юлия".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa ga go ka ke la le lo ma me mi mo na ne no pa ra re ri ro sa se so ta te vo".split(),
    "greek": "βα βε βο δα δε δο φα γα γο κα κε λα λε λο μα με μι μο να νε νο πα ρα ρε ρι ρο σα σε σο τα τε θα θε θο".split(),
    "cyrillic": "ба бе бо да де до фа га го ка ке ла ле ло ма ме ми мо на не но па ра ре ри ро са се со та те во".split(),
}


def mentions_of(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def type_of(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()])


def _by_type(kind: Column, values: dict[str, Column], other: Column) -> Column:
    return reduce(lambda rest, t: F.when(kind == t, values[t]).otherwise(rest), values, other)


def lead_of(mention: Column, kind: Column) -> Column:
    """What stays of a mention: the name of a setting, or a title."""
    return _by_type(kind, {t: F.regexp_extract(mention, p, 1) for t, p in _LEAD.items()}, F.lit(""))


def canonical(mention: Column, kind: Column) -> Column:
    """The form that all ways of writing the same thing share."""
    core = F.substring(mention, F.length(lead_of(mention, kind)) + 1, F.length(mention))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    forms = {t: digits for t in NUMBERS} | {t: F.lower(core) for t in NAMES}
    forms |= {"email": F.lower(mention), "ipv6": F.lower(mention), "iban": F.regexp_replace(mention, " ", "")}
    return _by_type(kind, forms, core)


def _noise(key: str, *parts: Column) -> Column:
    """128 bytes in hexadecimal that depend on a key and some texts."""
    text = F.concat_ws("\u001f", *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}\u001f{i}\u001f"), text).cast("binary"), 256) for i in range(4)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _byte(noise: Column, i: Column) -> Column:
    return F.conv(F.substring(noise, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(core: Column, noise: Column, low: Column) -> Column:
    """Letters and digits replaced by others of their kind; the rest stays."""

    def sign(i: Column) -> Column:
        own, byte = F.substring(core, i, F.lit(1)), _byte(noise, i)

        def of(signs: str, n: Column | int) -> Column:
            return F.substring(F.lit(signs), F.pmod(byte, n if isinstance(n, Column) else F.lit(n)) + 1, F.lit(1))

        letters = "abcdefghijklmnopqrstuvwxyz"
        return (
            F.when(own.rlike("[0-9]"), of("0123456789", 10))
            .when(own.rlike("[a-z]"), of(letters, low))
            .when(own.rlike("[A-Z]"), of(letters.upper(), 26))
            .when(own.rlike(r"\p{L}"), of(letters, low))
            .otherwise(own)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(core), F.lit(1))), sign), "")


def _digits(noise: Column, n: Column) -> Column:
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.pmod(_byte(noise, i), F.lit(10)).cast("string"),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """The check sum of a card number, 0 for a valid one."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        own = F.substring(digits, i, F.lit(1)).cast("int")
        twice = own * 2
        twice = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(own)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(total, F.lit(10))


def _name(core: Column, kind: Column, key: str, attempt: Column) -> Column:
    """A given name of the gender and a made-up family name, both in the script.

    A family's name depends on the family alone, so its members keep sharing it;
    only after many attempts is another made. Given names of later
    attempts are two, and then made-up ones, as many as are needed.
    """
    family, given = F.regexp_extract(core, r"(\S+)$", 1), F.regexp_extract(core, r"^(\S+) ", 1)
    tries = attempt.cast("int")
    family_noise = _noise(key, F.lit("family"), family, F.floor(tries / 16).cast("string"))
    given_noise = _noise(key, F.lit("given"), given, attempt)

    def made(script: str, noise: Column, syllables: int) -> Column:
        parts = F.array(*[F.lit(s) for s in _SYLLABLES[script]])
        drawn = [
            F.element_at(parts, F.pmod(_byte(noise, F.lit(i)), F.lit(len(_SYLLABLES[script]))) + 1)
            for i in range(syllables)
        ]
        return F.initcap(F.concat(*drawn))

    def called(script: str, noise: Column) -> Column:
        lists = [F.array(*[F.lit(n) for n in _NAMES[g, script]]) for g in ("male", "female")]

        def one(i: int) -> Column:
            place = F.pmod(_byte(noise, F.lit(i)), F.lit(16)) + 1
            is_male = (kind == "male") | ((kind == "either") & (F.pmod(_byte(noise, F.lit(9)), F.lit(2)) == 0))
            return F.when(is_male, F.element_at(lists[0], place)).otherwise(F.element_at(lists[1], place))

        return (
            F.when(tries < 1, one(0))
            .when(tries < 4, F.concat_ws("-", one(0), one(1)))
            .otherwise(F.concat_ws("-", one(0), made(script, noise, 4)))
        )

    def by_script(make: Callable[[str], Column]) -> Column:
        known = [F.when(core.rlike(rf"^[^\p{{L}}]*{letters}"), make(name)) for name, letters in _SCRIPTS.items()]
        return F.coalesce(*known)

    last = _let(family_noise, lambda noise: by_script(lambda script: made(script, noise, 6)))
    first = _let(given_noise, lambda noise: by_script(lambda script: called(script, noise)))
    return F.when(given == "", last).otherwise(F.concat_ws(" ", first, last))


def surrogate(form: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The canonical form of what stands in for a canonical form."""
    noise = _noise(key, kind, form, attempt)
    named = F.lower(_name(form, kind, key, attempt))
    return F.when(kind.isin(*NAMES), named).otherwise(_let(noise, lambda x: _drawn(form, kind, x)))


def _drawn(form: Column, kind: Column, noise: Column) -> Column:
    """What a noise makes of a canonical form, but for names."""
    n = F.length(form)
    stem, ending = F.regexp_extract(form, r"^(.*)\.", 1), F.regexp_extract(form, r"(\.[^.]*)$", 1)
    everything = F.lit(26)
    hexadecimal = F.when(form.rlike("^[0-9a-f]+$"), F.lit(6)).otherwise(everything)
    octets = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(noise, i), F.lit(254)) + 1).cast("string")
        ),
        ".",
    )
    drawn = _digits(noise, n)
    body = F.concat(F.substring(form, 1, 1), F.substring(drawn, F.lit(2), n - 2))
    sum_without = _luhn(F.concat(body, F.lit("0")))
    check = F.pmod(F.lit(10) - sum_without, F.lit(10)).cast("string")
    card = F.when(_luhn(form) == 0, F.concat(body, check)).otherwise(
        F.concat(F.substring(form, 1, 1), F.substring(drawn, F.lit(2), n))
    )
    area = (F.pmod(_byte(noise, F.lit(90)), F.lit(8)) + 2).cast("string")
    lead = F.when(n > 10, n - 10).otherwise(F.lit(0))
    phone = F.concat(F.substring(form, F.lit(1), lead), area, F.substring(drawn, F.lit(1), n - lead - 1))
    return _by_type(
        kind,
        {
            "email": F.concat(_shaped(stem, noise, everything), ending),
            "ip": octets,
            "card": card,
            "phone": phone,
            "ssn": drawn,
            "iban": F.concat(F.substring(form, 1, 2), _shaped(F.substring(form, F.lit(3), n), noise, everything)),
            "ipv6": _shaped(form, noise, F.lit(6)),
        },
        _shaped(form, noise, hexadecimal),
    )


def rendered(mention: Column, kind: Column, form: Column) -> Column:
    """A surrogate written as the mention was."""

    def filled(signs: str) -> Column:
        """The surrogate's signs in the places that such signs have in the mention."""

        def sign(i: Column) -> Column:
            own = F.substring(mention, i, F.lit(1))
            before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), f"[^{signs}]", ""))
            return F.when(own.rlike(f"[{signs}]"), F.substring(form, before, F.lit(1))).otherwise(own)

        places = F.sequence(F.lit(1), F.greatest(F.length(mention), F.lit(1)))
        return F.array_join(F.transform(places, sign), "")

    lead = lead_of(mention, kind)
    core = F.substring(mention, F.length(lead) + 1, F.length(mention))
    cased = F.when(F.upper(mention) == mention, F.upper(form)).otherwise(form)
    # Capital after a blank or a hyphen; a name in capitals stays in capitals.
    words = F.transform(F.split(form, "-"), lambda w: F.initcap(w))
    name = F.when((F.upper(core) == core) & (F.length(core) > 1), F.upper(form)).otherwise(F.array_join(words, "-"))
    return _by_type(
        kind,
        {
            **{t: filled("0-9") for t in NUMBERS},
            "iban": filled("0-9A-Z"),
            "email": cased,
            "ipv6": cased,
            **{t: F.concat(lead, name) for t in NAMES},
        },
        F.concat(lead, form),
    )


FORMS_A_TASK = 1_000


def surrogates(forms: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, form, surrogate) for distinct (kind, form); surrogates are distinct.

    In each round a form gets its surrogate if no form of the table is like it, no
    earlier round gave it away, and no smaller form has it in this one; the others
    go to the next round. A round is written to the shared folder.
    """
    spark = forms.sparkSession

    def written(df: DataFrame) -> DataFrame:
        return written_table(df, new_shared_path(spark, "surrogates"))

    def spread(df: DataFrame) -> DataFrame:
        # Rows are few bytes and much work each, so they are dealt out by number.
        return df.repartition(max(1, -(-df.count() // FORMS_A_TASK)), "kind", "form")

    known = written(forms.select("kind", "form").distinct())
    taken = known.select("kind", F.col("form").alias("surrogate"))
    waiting, done = known, []
    for attempt in range(rounds):
        tried = written(
            spread(waiting).withColumn("surrogate", surrogate(F.col("form"), F.col("kind"), key, F.lit(str(attempt))))
        )
        first = tried.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        good = first.join(taken, ["kind", "surrogate"], "left_anti")
        for earlier in done:
            good = good.join(earlier, ["kind", "surrogate"], "left_anti")
        done.append(written(good.select("kind", "form", "surrogate")))
        waiting = written(waiting.join(done[-1], ["kind", "form"], "left_anti"))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise ValueError("surrogates still collide: a type has more forms than its format has room for")


def _own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_replaced")]


def replace_mentions(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with mentions of personal data in ``text`` replaced.

    ``n_replaced`` is added (a column of that name is replaced). Texts without
    mentions, null and empty ones stay as they are. Rows are matched by their
    texts, so repeated rows and ids do no harm. The same key gives the same
    surrogates for the same table.
    """
    spark = docs.sparkSession
    text = F.col("text")
    found = docs.select(mentions_of(text).alias("mentions"), F.sha2(text.cast("binary"), 256).alias("key"))
    found = found.where(F.size("mentions") > 0).select("key", F.posexplode("mentions").alias("at", "mention"))
    found = found.withColumn("kind", type_of(F.col("mention")))
    found = written_table(
        found.withColumn("form", canonical(F.col("mention"), F.col("kind"))).distinct(),
        new_shared_path(spark, "mentions"),
    )
    given = written_table(surrogates(found, key), new_shared_path(spark, "given"))
    new = found.join(given, ["kind", "form"]).select(
        "key", "at", rendered(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("new")
    )
    by_text = new.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("__new")
    )
    own = _own_columns(docs)
    hit = F.size(mentions_of(text)) > 0
    gaps = F.split(text, _ANY, -1)
    pieces = F.zip_with(gaps, "__new", lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    changed = (
        docs.where(hit)
        .withColumn("__key", F.sha2(text.cast("binary"), 256))
        .join(by_text.withColumnRenamed("key", "__key"), "__key")
        .select(*own, F.array_join(pieces, "").alias("text"), F.size("__new").cast("long").alias("n_replaced"))
    )
    unchanged = docs.where(text.isNull() | ~hit).select(*own, text, F.lit(0).cast("long").alias("n_replaced"))
    return changed.unionByName(unchanged).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "n_replaced"], "n_replaced"
    )

"""Surrogates for personal data, in DataFrame operations only.

Entities are found by pattern (e-mail, telephone, IPv4, IBAN, payment card, US social security number, and names after a
title). A surrogate is a keyed function (HMAC-SHA-256) of an entity's normal form, so one entity has one surrogate in
all texts. It keeps the format: digits become digits, letters become letters of the same script and case, separators
stay; cards keep their check digit right, an IBAN its country, length and valid check digits, a telephone its country
code, addresses stay in range, names get a given name of the same gender and script. The normal form has no separators
and no case; a name has two, of the family and of the given name in the family. Digits and letters are permuted within
their shape, names are drawn. Surrogates that two normal forms share, or that are normal forms of the corpus
themselves, are drawn again (redrawn() says what happens where a shape has no room).
Nulls stay null; an empty text and a text without findings stay as they are; repeated rows are treated one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

# fixed values: titles by gender, and letters that surrogates draw from
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don Sir г-н господин κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña г-жа госпожа κυρία".split(),
    "n": "Dr Prof Mx".split(),
}
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", r"\p{IsLatin}"),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщыэюя", r"\p{IsCyrillic}"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsGreek}"),
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("latin", "n"): "Alex Andrea Charlie Dana Eden Francis Jamie Kim Lee Morgan Noa Quinn Robin Sam Sasha Toni".split(),
    ("cyrillic", "m"): "Иван Пётр Олег Антон Борис Виктор Глеб Денис".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура".split(),
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Ανδρέας".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία".split(),
    ("greek", "n"): "Άλεξ Κυριακή Φώτης".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi wa we wi za zo".split(),
    "cyrillic": "ба бо ва во га го да до жа за зо ка ко ла ло ма мо на но па по ра ро са со та то фа ха ча ша".split(),
    "greek": "βα γα δα ζα θα κα λα μα να πα ρα σα τα φα χα ψα βο γο δο κο λο μο νο πο ρο σο το".split(),
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_INITIAL = "[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts})) + "]"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9][\p{L}0-9-]*(?:\.[\p{L}0-9-]+)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z+])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # with a country code, an area code in brackets, or nine digits and more in groups that are not those of one large number; else 555-1234
    "phone": r"(?<![0-9A-Za-z.-])(?:\+(?=(?:[ .()-]{0,2}[0-9]){8})[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\+[0-9]{8,15}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?![0-9]{1,3}(?:[ .][0-9]{3})+(?![0-9]|[ .-][0-9]))[0-9]{3,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{5,8}|[0-9]{3}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "name": rf"(?={_INITIAL})(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
_NUMERIC = "ip card ssn phone".split()
PATTERN = "|".join([f"(?:{PATTERNS[k]})" for k in PATTERNS if k not in _NUMERIC] + [f"(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in _NUMERIC)})"])


def kind(e: Column) -> Column:
    """The type of an entity: the first whose pattern it matches whole."""
    out = F.lit("phone")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal digits."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in k)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in k)), inner), 256)


def _number(digits: Column, i: Column | int) -> Column:
    """The i-th number below 65,536 of hexadecimal digits."""
    return F.conv(F.substring(digits, F.lit(4) * i + 1, F.lit(4)), 16, 10).cast("int")


def _draws(key: str, word: Column, attempt: Column, what: str) -> Column:
    """Digits of which a word draws sixteen numbers."""
    return hmac(key, F.concat_ws("|", F.lit(what), F.lower(word), attempt.cast("string")))


def _bound(value: Column, f) -> Column:
    """f(value), which is worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normal(e: Column) -> Column:
    """An entity that is no name without separators and case; points of addresses and mails stay."""
    k = kind(e)
    return F.when(k.isin("email", "ip"), F.lower(e)).when(k == "iban", F.regexp_replace(e, " ", "")).when(k == "ssn", e).otherwise(F.regexp_replace(e, "[^0-9+]", ""))


#: Calling codes of three digits and of one; all others have two.
_CODE = r"^\+((?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]|[17]|[0-9]{2})"
#: Rounds of the permutation.
FEISTEL = 8


def _symbols(k: Column, norm: Column) -> Column:
    """The parts of a normal form as (c, r, v): text, how many values it may have (0: it stays), and which it has.

    Stay: the last label of a mail's host, the country and check digits of an IBAN, a card's check digit, and a
    telephone's country code. An address has four parts of 256 values.
    """
    parts = F.when(k == "ip", F.split(norm, r"\.")).otherwise(F.split(norm, ""))
    first = F.when(k == "iban", 4).when(k == "phone", F.length(F.regexp_extract(norm, _CODE, 1)) + F.when(norm.startswith("+"), 1).otherwise(0)).otherwise(0)
    last = F.when(k == "email", F.length(F.regexp_extract(norm, r"^(.*)\.", 1))).when(k == "card", F.length(norm) - 1).otherwise(F.length(norm))

    def one(c: Column, i: Column) -> Column:
        radix, value = F.when(c.rlike("^[0-9]$"), 10), F.when(c.rlike("^[0-9]+$"), c.cast("int"))
        for letters, block in SCRIPTS.values():
            radix = radix.when(c.rlike(rf"^[\p{{L}}&&{block}]$"), len(letters))
            at = F.instr(F.lit(letters), F.lower(c))
            value = value.when(c.rlike(rf"^[\p{{L}}&&{block}]$"), F.when(at > 0, at - 1).otherwise(F.ascii(c) % len(letters)))
        radix = F.when(k == "ip", 256).when((i < first) | (i >= last), 0).otherwise(F.coalesce(radix, F.lit(0)))
        return F.struct(c.alias("c"), radix.alias("r"), F.coalesce(value, F.lit(0)).alias("v"))

    return F.transform(parts, one)


def permuted(key: str, k: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate's normal form: a keyed permutation of all normal forms of that shape, another for each attempt.

    A Feistel network over the characters: in turn those at even and at odd places move on by numbers that the others
    give, so unlike forms of one shape have unlike surrogates.
    """

    def turn(acc: Column, r: Column) -> Column:
        moves = lambda s, i: (s["r"] > 0) & (i % 2 == r % 2)
        others = F.array_join(F.transform(acc, lambda s, i: F.when(moves(s, i), F.lit("?")).when(s["r"] > 0, s["v"].cast("string")).otherwise(s["c"])), ",")
        message = F.concat_ws("|", k, attempt.cast("string"), r.cast("string"), others)
        digits = F.concat(hmac(key, F.concat(F.lit("0|"), message)), hmac(key, F.concat(F.lit("1|"), message)))

        def moved(h: Column) -> Column:
            step = lambda s, i: F.pmod(s["v"] + _number(h, F.floor(i / 2).cast("int") % 32), s["r"]).cast("int")
            return F.transform(acc, lambda s, i: F.when(moves(s, i), F.struct(s["c"].alias("c"), s["r"].alias("r"), step(s, i).alias("v"))).otherwise(s))

        return _bound(digits, moved)

    def shown(s: Column) -> Column:
        out = F.when(s["r"] == 0, s["c"]).when(s["r"].isin(10, 256), s["v"].cast("string"))
        for letters, _ in SCRIPTS.values():
            low = F.substring(F.lit(letters), s["v"] + 1, F.lit(1))
            out = out.when(s["r"] == len(letters), F.when(s["c"].rlike(r"^\p{Lu}$"), F.upper(low)).otherwise(low))
        return out

    fresh = F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL - 1)), _symbols(k, norm), turn)
    text = _bound(F.transform(fresh, shown), lambda x: F.when(k == "ip", F.array_join(x, ".")).otherwise(F.array_join(x, "")))
    return _bound(text, lambda t: F.when(k == "card", _luhn(norm, t)).when(k == "iban", _checked(t)).otherwise(t))


def _luhn(norm: Column, fresh: Column) -> Column:
    """fresh with a last digit that makes the sum by Luhn's rule what it was modulo 10."""

    def total(d: Column) -> Column:
        back = F.transform(F.reverse(F.split(d, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
        return F.aggregate(back, F.lit(0), lambda a, x: a + x) % 10

    last = F.pmod(F.substring(fresh, -1, 1).cast("int") + total(norm) - total(fresh), F.lit(10))
    return F.concat(F.substring(fresh, F.lit(1), F.length(fresh) - 1), last.cast("string"))


def _checked(iban: Column) -> Column:
    """An IBAN with the check digits that its country and account ask for."""
    account, country = F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2)
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def formatted(e: Column, k: Column, fresh: Column) -> Column:
    """A surrogate's normal form in the format of the entity: its separators and its case."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"[^A-Z0-9+]", ""))
        at = F.when(k.isin("email", "ssn"), i).otherwise(before)
        new = F.substring(fresh, at + 1, F.lit(1))
        return F.when(k.isin("email", "ssn") | c.rlike(r"[A-Z0-9+]"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)).otherwise(c)

    return F.when(k == "ip", fresh).otherwise(F.array_join(F.transform(F.split(e, ""), one), ""))


def _words(e: Column) -> tuple[Column, Column, Column]:
    """The title, the words after it, and the gender the title has."""
    title = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0)
    gender = F.when(title.rlike(f"^(?:{'|'.join(TITLES['m'])})\\.? $"), "m").when(title.rlike(f"^(?:{'|'.join(TITLES['f'])})\\.? $"), "f").otherwise("n")
    return title, F.split(F.substring(e, F.length(title) + 1, F.length(e)), " "), gender


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _family(key: str, word: Column, attempt: Column) -> Column:
    """A family name of four syllables; drawn again, of one more each time."""

    def made(digits: Column) -> Column:
        out = F.lit(None).cast("string")
        for script, parts in SYLLABLES.items():
            of = F.array(*map(F.lit, parts))
            text = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda i: F.element_at(of, _number(digits, i % 16) % len(parts) + 1)), "")
            out = F.coalesce(out, F.when(_script(word) == script, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))))
        return out

    return _bound(_draws(key, word, attempt, "family"), made)


def _given(key: str, word: Column, gender: Column, attempt: Column) -> Column:
    """A given name; drawn again, a double one, of as many as it takes."""

    def made(digits: Column) -> Column:
        out = F.lit(None).cast("string")
        for (script, g), names in GIVEN.items():
            of = F.array(*map(F.lit, names))
            drawn = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(of, _number(digits, i % 16) % len(names) + 1))
            out = F.coalesce(out, F.when((_script(word) == script) & (gender == g), F.array_join(drawn, "-")))
        return out

    return _bound(_draws(key, word, attempt, "given"), made)


def units(e: Column) -> Column:
    """What of an entity is drawn as one: (kind, normal form, gender); a name's family, and its given name in that family."""
    _, words, gender = _words(e)
    unit = lambda k, n, g: F.struct(k.alias("kind"), n.alias("norm"), g.alias("gender"))
    family = unit(F.lit("family"), F.lower(F.element_at(words, -1)), F.lit(""))
    given = unit(F.lit("given"), F.lower(F.concat_ws(" ", words)), gender)
    return F.when(kind(e) != "name", F.array(unit(kind(e), normal(e), F.lit("")))).when(F.size(words) > 1, F.array(family, given)).otherwise(F.array(family))


def drawn_unit(key: str) -> Column:
    """The normal form of the surrogate of the columns kind, norm, gender and attempt."""
    k, n, t = F.col("kind"), F.col("norm"), F.col("attempt")
    words = F.split(n, " ")
    given = F.concat_ws(" ", F.lower(_given(key, F.element_at(words, 1), F.col("gender"), t)), F.element_at(words, -1))
    return F.when(k == "family", F.lower(_family(key, n, t))).when(k == "given", given).otherwise(permuted(key, k, n, t))


def surrogate(key: str, e: Column, attempts: Column) -> Column:
    """The replacement of an entity; attempts counts by unit how often it was drawn again."""

    def one(u: Column) -> Column:
        many = lambda i: F.coalesce(F.try_element_at(attempts, F.get(u, F.lit(i))), F.lit(0))
        k = F.element_at(u, 1)["kind"]
        title, words, gender = _words(e)
        family = _family(key, F.element_at(words, -1), many(0))
        name = F.concat(title, F.when(F.size(words) > 1, F.concat(_given(key, F.element_at(words, 1), gender, many(1)), F.lit(" "), family)).otherwise(family))
        fresh = _bound(permuted(key, k, F.element_at(u, 1)["norm"], many(0)), lambda n: formatted(e, k, n))
        return F.when(k == "family", name).otherwise(fresh)

    return _bound(units(e), one)


def found(text: Column) -> Column:
    """All entities in order; a text without digit, @ and title is told at a glance."""
    some = text.rlike("[0-9@]") | text.rlike(PATTERNS["name"])
    return F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


#: Times that a shape's colliding surrogates are drawn again before the shape counts as full.
REDRAWS = 6


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """(unit, attempt) of the units of entities(entity) whose first surrogate is another's or is a unit itself.

    Each round draws the colliding ones again, but the smallest of those that share one, and checks all of them. Names
    get longer with each draw, so that ends. A shape of digits and letters that still has collisions after REDRAWS
    rounds is full: too many of its values occur for all to get one that doesn't. Its units all keep their first
    surrogates, which are distinct as those of a permutation, but may be values that another text really has.
    """
    unit = F.struct("kind", "norm", "gender")
    real = stored(entities.select(F.explode(units(F.col("entity"))).alias("u")).select("u.*").distinct())
    shape = F.concat(F.col("kind"), F.lit(" "), F.regexp_replace(F.regexp_replace("norm", "[0-9]", "9"), r"\p{L}", "a"))
    known = stored(real.withColumn("attempt", F.lit(0)).withColumn("s", drawn_unit(key)).withColumn("shape", F.when(~F.col("kind").isin("family", "given"), shape)))
    on, full, rounds = ["kind", "gender", "s"], None, 0
    while True:
        shared = known.groupBy(*on).agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("keep"))
        bad = shared.join(real.select("kind", "gender", F.col("norm").alias("s"), F.lit(True).alias("real")), on, "left").where("n > 1 or real")
        bad = stored(bad.select(*on, F.when(F.col("real").isNull(), F.col("keep.norm")).alias("spared")))
        if bad.isEmpty():
            return known.where("attempt > 0").select(unit.alias("unit"), "attempt")
        if rounds == REDRAWS:
            full = stored(known.join(bad, on, "left_semi").where("shape is not null").select("shape").distinct())
            known = stored(known.join(full, "shape", "left_anti"))
            bad = bad.where(F.col("kind").isin("family", "given"))
        rounds += 1
        marked = known.join(bad, on).where("spared is null or spared <> norm").select("kind", "norm", "gender", F.lit(1).alias("more"))
        known = known.drop("s").join(marked, ["kind", "norm", "gender"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
        known = stored(known.withColumn("s", drawn_unit(key)))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, types) for docs(doc_id, text): types counts entities by type."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    same = F.struct(F.xxhash64("text").alias("x"), F.hash("text").alias("y"))  # a text's own key, whether it has a doc_id or not
    mentions = stored(rows.select(same.alias("same"), F.explode(F.array_distinct(found(F.col("text")))).alias("entity")))
    again = stored(redrawn(mentions.select("entity").distinct(), key))
    # only texts with a unit that was drawn again need the list of those
    within = mentions.select("same", F.explode(units(F.col("entity"))).alias("unit"))
    exact = stored(within.join(again, "unit").groupBy("same").agg(F.map_from_entries(F.collect_set(F.struct("unit", "attempt"))).alias("attempts")))
    out = rows.withColumn("same", same).join(exact, "same", "left").withColumn("e", found(F.col("text")))
    first = F.create_map().cast("map<struct<kind:string,norm:string,gender:string>,int>")
    attempts = F.coalesce("attempts", first)
    new = F.transform("e", lambda x: surrogate(key, x, attempts))
    gaps = F.split(F.col("text"), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.size("e") > 0, joined).otherwise(F.col("text"))
    kinds = F.transform("e", kind)
    types = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return out.select("doc_id", text.alias("text"), F.coalesce(F.greatest(F.size("e"), F.lit(0)), F.lit(0)).alias("n_entities"), F.when(F.size("e") > 0, types).alias("types"))

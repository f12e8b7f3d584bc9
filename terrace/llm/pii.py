"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns. Each distinct entity of the whole table receives one
keyed surrogate of its own type: digits for digits, letters of the same script for
letters, given names of the same gender, upper and lower case and punctuation as
found. A surrogate is checked against all others and against all real entities, so
different entities stay different; the same entity has the same surrogate wherever,
and however punctuated, it stands. Addresses of one domain keep sharing one.

What collides is drawn again. After ``DRAWS`` draws addresses and names grow longer,
which always ends; numbers, whose format is fixed, are then dealt out among
themselves in keyed order, which always ends too, as where real numbers fill a format
no other value is left.
"""

from __future__ import annotations

from functools import reduce
from itertools import count as attempts

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.indexing import row_index

#: Draws in the entity's own format, before it grows or numbers are exchanged.
DRAWS = 4

# What an entity looks like (Java patterns), in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}(?:\p{L}+|(?=['’]\p{L}{2}))(?:['’\-]\p{L}{2,}){0,4}"
# Parts of addresses by the lengths that their format allows, which also bounds the pattern's depth.
_LABEL = r"[\p{L}\p{N}\-]{1,63}"
_MALE_TITLE = r"(?:Mr\.?|Herr|Monsieur|Señor|Sr\.|господин|Господин)"
_FEMALE_TITLE = r"(?:Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Mlle\.?|Señora|Sra\.|госпожа|Госпожа)"
_OTHER_TITLE = r"(?:Dr\.|Prof\.)"
PATTERNS = {
    "email": rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}._%+\-]{{0,63}}+@{_LABEL}(?:\.{_LABEL}){{0,125}}\.\p{{L}}{{2,63}}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    "card": r"(?<![\d+])(?:\d{16}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(\d{1,4}\)(?:[ .\-]?\d{2,4}){2,4}|\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){3,7}(?: [0-9A-Z]{1,3})?|\d{11,30})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_MALE_TITLE}|{_FEMALE_TITLE}|{_OTHER_TITLE}) {_NAME}(?: {_NAME})?",
}
# The same, but tried only where one can start: an address at a word's first character, a number at a digit or sign.
_NUMBERS = ("card", "phone", "ssn", "ip")
ANY = "|".join(
    [
        rf"(?<![\p{{L}}\p{{N}}_])(?:{PATTERNS['email']})",
        f"(?:{PATTERNS['secret']})",
        rf"(?=[\d+(])(?:{'|'.join(PATTERNS[k] for k in _NUMBERS)})",
        f"(?:{PATTERNS['iban']})",
        f"(?:{PATTERNS['name']})",
    ]
)

# Alphabets of surrogate letters, and given names and syllables of surrogate names, by script.
ALPHABETS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшыэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Han": "安白陈丁方高何江金李林马宁钱孙唐王文吴夏杨叶于张周",
    "Latin": "abcdefghijklmnopqrstuvwxyz",
}
GIVEN = {
    ("m", "Latin"): "adam bruno carl david emil felix hugo ivan jonas leo martin oscar paul simon thomas victor".split(),
    ("f", "Latin"): "anna bella clara diana elena freya greta helen irene julia laura maria nora olivia sara vera".split(),
    ("x", "Latin"): "alex andrea charlie dominique eden gabriel jamie jules kim lou marion noel robin sam toni yves".split(),
    ("m", "Cyrillic"): "антон борис виктор глеб денис иван кирилл лев максим олег павел роман".split(),
    ("f", "Cyrillic"): "алина вера галина дарья елена ирина лариса мария нина ольга софья юлия".split(),
    ("x", "Cyrillic"): "саша женя валя".split(),
}
SYLLABLES = {
    "Latin": "bar bel cor dan der fal gar hal ker lan lor mar mel nor pal ran rin sal sel tan tor val ver win".split(),
    "Cyrillic": "бар вел гор дан дол зар кор лан лес мар мел нор пал рин сол тар тов вин".split(),
}
_DIGITS = {"card", "ssn"}
_FIXED_FORMAT = ("card", "ssn", "phone", "ip", "iban", "secret")
#: A word that may be part of a person's name.
_MENTION = rf"(?<!\p{{L}}){_NAME}"
#: Country calling codes; none is the start of another, so digits alone tell where one ends.
_CALLING_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: The national prefix that some write within an international number and none dials.
_TRUNK = r"(?<=^\+\d{1,3}[ .\-]{0,1})\(0\)"


def _in_full(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def kind_of(entity: Column) -> Column:
    """The type of a found entity: the first pattern that it fits in full."""
    return F.coalesce(*(F.when(_in_full(entity, p), F.lit(k)) for k, p in PATTERNS.items()))


def _letters(word: Column) -> Column:
    return F.coalesce(*(F.when(word.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in ALPHABETS if s != "Latin"), F.lit("Latin"))


def _tokens(name: Column) -> Column:
    """The names after the title."""
    return F.split(F.regexp_replace(name, rf"^(?:{_MALE_TITLE}|{_FEMALE_TITLE}|{_OTHER_TITLE}) ", ""), " ")


def _gender(name: Column) -> Column:
    return F.when(name.rlike(f"^{_MALE_TITLE} "), "m").when(name.rlike(f"^{_FEMALE_TITLE} "), "f").otherwise("x")


def domain_of(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def canons(entity: Column, kind: Column, givens: Column, families: Column) -> Column:
    """What an entity stands for, whatever its punctuation and case: an array of ``type:value``.

    A name has one for each of its parts, an address one for itself and one for its
    domain. A name of one part is a family name, unless the text has it as a given name
    only (``givens`` and ``families``: the parts of the text's longer names).
    """
    digits = F.regexp_replace(entity, r"\D", "")
    phone = F.concat(F.regexp_extract(entity, r"^\+?", 0), F.regexp_replace(F.regexp_replace(entity, _TRUNK, ""), r"\D", ""))
    tokens, lower = _tokens(entity), F.lower(entity)
    last = F.lower(F.get(tokens, F.size(tokens) - 1))
    family = F.concat(F.lit("family:"), last)
    given = F.concat(F.lit("given_"), _gender(entity), F.lit(":"), F.lower(F.get(tokens, F.lit(0))))
    is_given = F.array_contains(givens, last) & ~F.array_contains(families, last)
    one = lambda value: F.array(F.concat(kind, F.lit(":"), value))
    return (
        F.when(kind == "name", F.when(F.size(tokens) > 1, F.array(given, family)).when(is_given, F.array(given)).otherwise(F.array(family)))
        .when(kind == "email", F.array(F.concat(F.lit("email:"), lower), F.concat(F.lit("domain:"), domain_of(lower))))
        .when(kind == "phone", one(phone))
        .when(kind.isin(*_DIGITS), one(digits))
        .when(kind == "iban", one(F.lower(F.regexp_replace(entity, " ", ""))))
        .otherwise(one(lower))
    )


def _stream(canon: Column, key: str, attempt: int, length: Column) -> Column:
    """Keyed pseudo-random hexadecimal digits, two for each of ``length`` places."""
    block = lambda j: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(attempt)), j.cast("string"), canon).cast("binary"), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 32).cast("int")), block), "")


def _draw(stream: Column, i: Column | int, n: int) -> Column:
    """A number below ``n`` (at most 256) from place ``i`` of a stream."""
    at = F.lit(2 * i + 1) if isinstance(i, int) else i * 2 + 1
    return (F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int") * n / 256).cast("int")


def _shaped(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """``value`` with each letter and digit drawn anew from its own kind and script."""

    def drawn(c: Column, i: Column) -> Column:
        pick = lambda alphabet: F.substring(F.lit(alphabet), _draw(stream, i, len(alphabet)) + 1, F.lit(1))
        out = F.when(c.rlike(r"\p{N}"), pick("0123456789"))
        for script, alphabet in ALPHABETS.items():
            if script != "Latin":
                out = out.when(c.rlike(rf"\p{{Is{script}}}"), pick(alphabet))
        out = out.when(c.rlike(r"\p{L}"), pick(ALPHABETS["Latin"])).otherwise(c)
        return F.when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef")).otherwise(out) if hexadecimal is not None else out

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a card number."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _kind(canon: str = "canon") -> Column:
    return F.substring_index(canon, ":", 1)


def _value(canon: str = "canon") -> Column:
    return F.expr(f"substring({canon}, instr({canon}, ':') + 1)")


def _kept_part(kind: Column, value: Column) -> Column:
    """The start of a number that its surrogate keeps: country, calling code, issuer, prefix."""
    return (
        F.when(kind == "card", F.substring(value, 1, 1))
        .when(kind == "phone", F.regexp_extract(value, _CALLING_CODE, 0))
        .when(kind == "iban", F.substring(value, 1, 2))
        .when(kind == "secret", F.regexp_extract(value, r"^(?:akia|gh[pousr]_|sk-)", 0))
        .otherwise("")
    )


def surrogate(canon: Column, key: str, attempt: int) -> Column:
    """The ``attempt``-th surrogate value of a ``type:value``.

    Of an address it is the part before the ``@``; a phone number's has no plus sign.
    Addresses, domains and names grow with later attempts, so they never run out.
    """
    kind, value = F.substring_index(canon, ":", 1), F.substring(canon, F.instr(canon, ":") + 1, F.length(canon))
    grown = "a" * max(0, attempt - DRAWS + 1)
    stream = _stream(canon, key, attempt, F.length(value) + len(grown))
    shaped = lambda text, *how: _shaped(text, stream, *how)
    digits = shaped(value)
    rest = lambda text, start: F.substring(text, F.length(start) + 1, F.length(text))
    kept = _kept_part(kind, value)
    card = F.concat(kept, rest(digits, kept))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    fixed = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    phone = F.concat(F.translate(kept, "+", ""), rest(F.translate(digits, "+", ""), F.translate(kept, "+", "")))
    octets = F.concat_ws(".", (_draw(stream, 0, 223) + 1).cast("string"), *(_draw(stream, i, 256).cast("string") for i in (1, 2, 3)))
    local = shaped(F.concat(F.substring_index(value, "@", 1), F.lit(grown)))
    host = shaped(F.concat(F.regexp_replace(value, r"\.[^.]+$", ""), F.lit(grown)))
    domain = F.concat(host, F.lit("."), F.substring_index(value, ".", -1))
    secret = F.concat(kept, rest(shaped(value, value.rlike("^[0-9a-f]+$")), kept))
    iban = F.concat(kept, rest(digits, kept))
    names = _stream(canon, key, attempt, F.lit(16))
    cyrillic = _letters(value) == "Cyrillic"

    def chosen(words: list[str], at: int) -> Column:
        return F.get(F.array(*map(F.lit, words)), _draw(names, at, len(words)))

    def spelled(script: str, first: int, n: int) -> Column:
        return F.concat(*(chosen(SYLLABLES[script], first + i) for i in range(n)))

    # A name list is short: later attempts add syllables, as many as it takes.
    tail = attempt
    given = reduce(
        lambda acc, g: F.when(
            kind == f"given_{g}",
            F.when(cyrillic, F.concat(chosen(GIVEN[g, "Cyrillic"], 0), *([spelled("Cyrillic", 1, min(tail, 15))] if tail else []))).otherwise(
                F.concat(chosen(GIVEN[g, "Latin"], 0), *([spelled("Latin", 1, min(tail, 15))] if tail else []))
            ),
        ).otherwise(acc),
        "mfx",
        F.lit(None).cast("string"),
    )
    family = F.when(cyrillic, spelled("Cyrillic", 0, min(3 + tail, 15))).otherwise(spelled("Latin", 0, min(3 + tail, 15)))
    return (
        F.when(kind == "card", F.when(_luhn(value) == 0, fixed).otherwise(card))
        .when(kind == "ssn", digits)
        .when(kind == "phone", phone)
        .when(kind == "ip", octets)
        .when(kind == "email", local)
        .when(kind == "domain", domain)
        .when(kind == "secret", secret)
        .when(kind == "iban", iban)
        .when(kind == "family", family)
        .otherwise(given)
    )


def _exchanged(todo: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """``(canon, space, value)``: numbers of one format dealt out among themselves, each the next one's in keyed order.

    A number that is left alone in its format takes another real one of the format,
    if there is any; real values are never anyone else's surrogates.
    """
    kind, value = _kind(), _value()
    shape = F.concat_ws("\x1f", kind, _kept_part(kind, value), F.when(kind == "card", _luhn(value) == 0), F.regexp_replace(F.regexp_replace(value, r"\p{L}", "a"), r"\d", "0"))
    # An address of four numbers has one format, whatever their lengths.
    shape = F.when(kind == "ip", F.lit("ip")).otherwise(shape)
    mixed = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("deal"), "canon").cast("binary"), 256)
    dealt = durable(row_index(todo.select("canon", "space", "real", shape.alias("shape"), mixed.alias("mixed")), ["shape", "mixed", "canon"], "k"))
    ends = durable(dealt.groupBy("shape").agg(F.min("k").alias("first"), F.max("k").alias("last")))
    placed = dealt.join(maybe_broadcast(ends, 128), "shape")
    next_one = placed.where("first < last").select("canon", "space", F.when(F.col("k") < F.col("last"), F.col("k") + 1).otherwise(F.col("first")).alias("k"))
    out = next_one.join(dealt.select("k", F.col("real").alias("value")), "k").select("canon", "space", "value")
    alone = durable(placed.where("first = last").select("canon", "space", "shape"))
    if alone.isEmpty():
        return out
    others = real.where(kind.isin(*_FIXED_FORMAT)).select(F.col("canon").alias("other"), F.col("real"), shape.alias("shape"), mixed.alias("mixed"))
    found = others.join(alone, "shape").where("other != canon").groupBy("canon", "space").agg(F.min(F.struct("mixed", "real")).alias("least"))
    return out.union(found.select("canon", "space", "least.real"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``(canon, value)``: a surrogate for each distinct ``canon``, different from all others and from every real one of its type.

    Where two draw the same value, the smaller keeps it and the others draw again. The
    local part of an address must differ from others of its domain only. A given name
    of unknown gender takes the surrogate of the same name where its gender is known.
    Where real values fill a fixed format, see ``_exchanged``.
    """
    kind, value = _kind(), _value()
    # Phones are compared by the digits that are written out, addresses within their domain.
    real_value = F.when(kind == "phone", F.translate(value, "+", "")).when(kind == "email", F.substring_index(value, "@", 1)).otherwise(value)
    space = F.when(kind == "email", F.concat(F.lit("@"), domain_of(value))).otherwise(kind)
    every = durable(entities.select("canon").distinct().select("canon", space.alias("space"), real_value.alias("real")))
    known = every.where(kind.isin("given_m", "given_f")).groupBy("real").agg(F.max("canon").alias("known"))
    unknown = every.where(kind == "given_x").join(known, "real").select("canon", "known")
    alias = durable(unknown)
    # Written before values are drawn: each shuffle that ends has the rest of a plan optimised again, the long expressions too.
    todo, done = durable(every.join(alias, "canon", "left_anti")), []
    for attempt in attempts():
        if attempt == DRAWS:
            numbers = durable(todo.where(kind.isin(*_FIXED_FORMAT)))
            if not numbers.isEmpty():
                done.append(durable(_exchanged(numbers, every, key)))
                todo = durable(todo.join(done[-1], "canon", "left_anti"))
                if todo.isEmpty():
                    break
        drawn = durable(todo.select("canon", "space", surrogate(F.col("canon"), key, attempt).alias("value")))
        taken = reduce(DataFrame.union, [d.select("space", "value") for d in done], every.select("space", F.col("real").alias("value"))).distinct()
        free = drawn.join(taken, ["space", "value"], "left_anti")
        done.append(durable(free.groupBy("space", "value").agg(F.min("canon").alias("canon"))))
        todo = durable(todo.join(done[-1], "canon", "left_anti"))
        if todo.isEmpty():
            break
    out = reduce(DataFrame.union, [d.select("canon", "value") for d in done])
    return out.union(alias.join(out.withColumnRenamed("canon", "known"), "known").select("canon", "value"))


def _filled(entity: Column, digits: Column) -> Column:
    """``entity`` with its digits replaced by ``digits``, in order."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(r"\d")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(acc["rest"], 1, 1)).otherwise(c)).alias("out"),
            F.when(is_digit, F.substring(acc["rest"], F.lit(2), F.length(acc["rest"]))).otherwise(acc["rest"]).alias("rest"),
        )

    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))
    return F.aggregate(F.split(entity, ""), start, step, lambda acc: acc["out"])


def _cased(found: Column, value: Column) -> Column:
    """``value`` with upper-case letters where ``found`` has them."""
    upper = lambda o: (o != F.lower(o)) & (o == F.upper(o))
    each = F.zip_with(F.split(found, ""), F.split(value, ""), lambda o, v: F.when(upper(o), F.upper(v)).otherwise(F.coalesce(v, F.lit(""))))
    return F.when(upper(found), F.upper(value)).otherwise(F.array_join(each, ""))


def _named(found: Column, value: Column) -> Column:
    return F.when(found == F.upper(found), F.upper(value)).otherwise(F.initcap(value))


def rendered(entity: Column, kind: Column, wanted: Column, values: Column) -> Column:
    """The surrogate text of a found entity; ``wanted`` are its ``canons``, ``values`` maps them to surrogate values."""
    value = F.element_at(values, F.get(wanted, F.lit(0)))
    digits = F.regexp_replace(value, r"\D", "")
    phone = F.translate(_filled(F.regexp_replace(entity, _TRUNK, "(\x01)"), digits), "\x01", "0")
    tokens = _tokens(entity)
    title = F.regexp_extract(entity, rf"^(?:{_MALE_TITLE}|{_FEMALE_TITLE}|{_OTHER_TITLE}) ", 0)
    names = F.array_join(F.zip_with(tokens, wanted, lambda t, w: _named(t, F.element_at(values, w))), " ")
    local, domain = F.substring_index(entity, "@", 1), domain_of(entity)
    address = F.concat(_cased(local, value), F.lit("@"), _cased(domain, F.element_at(values, F.get(wanted, F.lit(1)))))
    spaced = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("out"), value.alias("rest")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c == " ", c).otherwise(F.upper(F.substring(acc["rest"], 1, 1)))).alias("out"),
            F.when(c == " ", acc["rest"]).otherwise(F.substring(acc["rest"], F.lit(2), F.length(acc["rest"]))).alias("rest"),
        ),
        lambda acc: acc["out"],
    )
    return (
        F.when(kind.isin(*_DIGITS), _filled(entity, digits))
        .when(kind == "phone", phone)
        .when(kind == "ip", value)
        .when(kind == "iban", spaced)
        .when(kind == "name", F.concat(title, names))
        .when(kind == "email", address)
        .otherwise(_cased(entity, value))
    )


def _mentions(piece: Column, values: Column) -> Column:
    """``piece`` with the words replaced that are parts of the text's names, wherever they stand."""

    def said(word: Column) -> Column:
        part = lambda kind: F.element_at(values, F.concat(F.lit(f"{kind}:"), F.lower(word)))
        return F.coalesce(*(_named(word, part(k)) for k in ("family", "given_m", "given_f", "given_x")), word)

    words = F.transform(F.regexp_extract_all(piece, F.lit(_MENTION), 0), said)
    return F.array_join(F.zip_with(F.split(piece, _MENTION, -1), words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its surrogate; ``count`` names an added column of entities found.

    ``key`` is the secret that surrogates are drawn with. Documents without entities
    pass untouched and are never shuffled. A person found by a title is replaced in the
    rest of the text too, where a part of the name stands without one.

    Defined cases: a null text stays null, an empty one empty; texts of any length are
    read whole; repeated rows stay and change alike; other columns are kept whatever
    their names; an empty table gives an empty result.
    """
    counts = [count] if count else []
    kept = [c for c in docs.columns if c not in counts]
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    has = F.coalesce(column(text).rlike(ANY), F.lit(False))
    clean = docs.where(~has).select(*map(column, kept), *(F.lit(0).cast("long").alias(c) for c in counts))
    # Entities are taken out once; a text that has some stands by its row's number from here on.
    found = F.transform(F.regexp_extract_all(column(text), F.lit(ANY), 0), lambda e: F.struct(e.alias("text"), kind_of(e).alias("kind")))
    row = F.struct(*map(column, kept)).alias("row")
    dirty = durable(docs.where(has).select(row, found.alias("found"), F.monotonically_increasing_id().alias("at")))
    tokens = F.transform(F.filter("found", lambda e: e["kind"] == "name"), lambda e: F.transform(_tokens(e["text"]), F.lower))
    full = F.filter(tokens, lambda t: F.size(t) > 1)
    parts = [F.transform(full, lambda t: F.get(t, F.lit(0))).alias("givens"), F.transform(full, lambda t: F.get(t, F.lit(1))).alias("families")]
    wanted = F.transform("found", lambda e: canons(e["text"], e["kind"], F.col("givens"), F.col("families"))).alias("wanted")
    read = dirty.select("row", "found", "at", *parts).select("row", "found", "at", wanted)
    each = durable(read.select("at", F.explode(F.array_distinct(F.flatten("wanted"))).alias("canon")))
    values = assign(each, key)
    maps = durable(each.join(values, "canon").groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("canon", "value"))).alias("values")))
    joined = read.join(maps, "at")
    said = F.zip_with("found", "wanted", lambda e, w: rendered(e["text"], e["kind"], w, F.col("values")))
    pieces = F.split(F.col("row").getField(text), ANY, -1)
    people = F.filter(F.map_keys("values"), lambda c: c.startswith("family:") | c.startswith("given_"))
    named = F.map_filter("values", lambda c, v: c.startswith("family:") | c.startswith("given_"))
    pieces = F.when(F.size(people) == 0, pieces).otherwise(F.transform(pieces, lambda p: _mentions(p, named)))
    new = F.array_join(F.zip_with(pieces, said, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    columns = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept]
    replaced = joined.select(*columns, *(F.size("found").cast("long").alias(c) for c in counts))
    return replaced.union(clean)

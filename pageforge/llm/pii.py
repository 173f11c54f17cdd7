"""PII surrogates: every detected entity gets a keyed replacement of its own kind, by built-in functions only.

Detected are mail addresses, phone and card numbers, IPv4 addresses, IBANs,
social security numbers, secrets (cloud keys, values behind password, token,
secret or key) and names behind a title, to their last capitalised word. An entity's *norm* (lower case,
without separators) stands for all its spellings, so one person keeps one
replacement everywhere.

Replacements keep the form: separators, case, script, country code, mail suffix,
label and title stay; digits become digits, letters letters of the same
alphabet, octets octets; card numbers keep their check sum's verdict; names come
from pools of the title's gender and the name's script. All but names are keyed
permutations (four Feistel rounds over the characters, SHA-256 of key and half),
so different entities of one form cannot meet.

Collision checks run over the table of distinct entities: a replacement that is
itself an entity of the corpus, or that two entities share, is drawn again in
the next round (names grow by a part each round). Only entities drawn again need
a lookup when texts are rewritten; the rest is computed inside the row.

Defined results: null and empty texts come back as they are; repeated rows and
rows without a doc_id are treated alike; texts without an entity come back
unchanged; all columns of the input are kept, ``n_entities`` is added (an input
column of that name gives way).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import let, release, settle

MALE, FEMALE, ANY = r"Mr|Herr|Monsieur|Señor|Sr|Г-н", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа", r"Dr|Prof"
_TITLE = rf"(?:{MALE}|{FEMALE}|{ANY})\.?"
# Words of a name: capitals inside, hyphens and apostrophes (but not a possessive 's), initials before more of the name.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:[-'’](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*+)*+"
_PARTICLES = r"(?:(?:van|von|vom|zu|zur|der|den|ter|ten|de|del|della|di|da|du|dos|das|la|le|bin|ibn|al|el|['’]t) |[dl]['’]|(?:al|el)-){0,4}"
_INITIALS = rf"(?:\p{{Lu}}\.-?)+(?= ?{_PARTICLES}\p{{Lu}})"
_NAME = rf"{_PARTICLES}(?:{_INITIALS}(?:{_WORD})?|{_WORD})"
_TITLES = rf"(?:{_TITLE} )+"
_NATIONAL = (
    r"0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})|0[1-9] \d{4} \d{4}"
    r"|(?:\(0[1-9]\d{0,3}\) ?|0[1-9]\d{1,3}[ .-])\d{3,4}[ .-]?\d{3,4}"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
# Kind -> pattern, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "secret": rf"(?<!\w){_LABEL}[A-Za-z0-9_/+-]{{8,}}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w.])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\d(?:[ .-]\d{2,4}){2,5})(?!\w)"
    r"|(?<![\w.])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"
    rf"|(?<![\w.])(?<!\d-)(?:{_NATIONAL})(?!\w)",
    "name": rf"(?<!\w){_TITLES}{_NAME}(?: {_NAME})*+",
}
_TOKEN = rf"{_INITIALS}|{_WORD}"
# Every pattern begins where no word character stands before; asked once, that settles most places.
ANY_ENTITY = r"(?<!\w)(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
# A text without any of these has no entity.
HINT = rf"[0-9@=:]|(?<!\w)(?:AKIA|{_TITLE} {_PARTICLES}\p{{Lu}})"

# Alphabets whose letters stand in for each other.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
LETTERS = "".join(ALPHABETS)

POOLS = {
    "surname": "Albrecht Baker Carter Dupont Ellis Fischer Garcia Hughes Ibarra Jensen Keller Lambert Moreau Novak Ortega Parker Quinn Rossi Schmidt Turner",
    "given_m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lucas Martin Noah Oscar Paul Robert Simon Thomas Victor",
    "given_f": "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Theresa Vera",
    "given_n": "Alex Charlie Dominique Eden Jamie Jules Kim Lou Morgan Noel Quincy Robin Sacha Sam Taylor Toni Val",
}
CYRILLIC_POOLS = {
    "surname": "Антонов Беляев Волков Громов Дьяков Ершов Жуков Зимин Климов Лебедев Морозов Носов Орлов Петров Родин",
    "given_m": "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман",
    "given_f": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга",
    "given_n": "Валя Женя Саша Шура",
}
# Rounds in which a replacement keeps its form; each one after them makes it a character longer.
SAME_FORM = 6
# Distinct entities per task that draws replacements, and most such tasks.
DRAWN_ROWS, DRAWN_TASKS = 2_000, 10_000


def _matches(text: Column) -> Column:
    """All entities of a text as they are spelled, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY_ENTITY), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _draw(seed: Column, i: Column, radix: Column) -> Column:
    return F.pmod(F.xxhash64(seed, i), radix.cast("long")).cast("int")


def _feistel(values: Column, radices: Column, key: str, kind: Column, attempt: Column) -> Column:
    """A keyed permutation of tuples: value i stays below radix i."""
    half = F.floor(F.size(values) / 2).cast("int")
    part = lambda a, left: F.slice(a, 1, half) if left else F.slice(a, half + 1, F.size(values) - half)

    def turn(level: int, left: Column, right: Column) -> Column:
        if level == 4:
            return F.concat(left, right)
        on_right = level % 2 == 0
        seed = _digest(key, kind, attempt, F.lit(level), F.array_join(left if on_right else right, ","))
        moved, r = (right, part(radices, False)) if on_right else (left, part(radices, True))
        new = let(seed, lambda s: F.transform(moved, lambda v, i: (v + _draw(s, i, F.get(r, i))) % F.get(r, i)))
        return let(new, lambda m: turn(level + 1, left, m) if on_right else turn(level + 1, m, right))

    return let(part(values, True), lambda a: let(part(values, False), lambda b: turn(0, a, b)))


def _radix(c: Column) -> Column:
    """Size of a character's alphabet, 0 for others."""
    out = F.lit(0)
    for a in ALPHABETS:
        out = F.when(F.instr(F.lit(a), c) > 0, len(a)).otherwise(out)
    return out


def _shift_text(body: Column, key: str, kind: Column, attempt: Column) -> Column:
    """A text whose letters and digits are permuted within their alphabets."""

    def of(chars: Column) -> Column:
        known = F.filter(chars, lambda c: F.instr(F.lit(LETTERS), c) > 0)

        def rebuilt(k: Column) -> Column:
            start = lambda c: F.instr(F.lit(LETTERS), c) - sum_before(c)
            values = F.transform(k, sum_before)
            radices = F.transform(k, _radix)
            moved = _feistel(values, radices, key, kind, attempt)
            fresh = let(moved, lambda m: F.transform(k, lambda c, i: F.substring(F.lit(LETTERS), start(c) + F.get(m, i), F.lit(1))))
            return let(fresh, lambda f: _refill(chars, f))

        return let(known, rebuilt)

    def sum_before(c: Column) -> Column:
        """Place of a character in its alphabet, from 0."""
        out = F.lit(0)
        for a in ALPHABETS:
            out = F.when(F.instr(F.lit(a), c) > 0, F.instr(F.lit(a), c) - 1).otherwise(out)
        return out

    return let(_chars(body), of)


def _refill(template: Column, fresh: Column) -> Column:
    """The template's known characters replaced in order; capitals stay capitals."""

    def step(acc: Column, c: Column) -> Column:
        known = F.instr(F.lit(LETTERS), F.lower(c)) > 0
        new = F.get(fresh, acc["k"])
        new = F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(new)).otherwise(new)
        return F.struct(
            F.concat(acc["s"], F.when(known, F.coalesce(new, c)).otherwise(c)).alias("s"),
            (acc["k"] + known.cast("int")).alias("k"),
        )

    return F.aggregate(template, F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda a: a["s"])


def _fitted(raw: Column, fresh: Column) -> Column:
    """``raw`` with its known characters replaced in order, and what is left of the new ones behind it."""

    def of(f: Column) -> Column:
        room = F.size(F.filter(_chars(raw), lambda c: F.instr(F.lit(LETTERS), F.lower(c)) > 0))
        return F.concat(_refill(_chars(raw), f), F.array_join(F.slice(f, room + 1, F.greatest(F.size(f) - room, F.lit(0))), ""))

    return let(fresh, of)


def _luhn(digits: Column) -> Column:
    """Check sum of a digit array, modulo 10."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def kind_of(raw: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(raw.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def norm_of(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share. Names are handled by word."""
    digits = F.regexp_replace(raw, r"\D", "")
    phone = F.concat(F.regexp_extract(raw, r"^(\+\d{1,3})[ .(-]", 1), F.lit("|"), F.regexp_replace(F.regexp_replace(raw, r"^\+\d{1,3}(?=[ .(-])", ""), r"\D", ""))
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", phone)
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_extract(raw, r"([A-Za-z0-9_/+-]{8,})$", 1))
        .otherwise(raw)
    )


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of a norm, itself in normal form."""
    # A form all of whose members are real has no free one, however often it is drawn; a longer one has.
    more = F.greatest(attempt - (SAME_FORM - 1), F.lit(0))
    shift = lambda body: _shift_text(body, key, kind, attempt)
    keep = lambda head, size: F.concat(F.substring(norm, 1, size), shift(F.concat(F.substring(norm, F.lit(size + 1), F.char_length(norm)), F.repeat(F.lit("0"), more))))
    suffix = F.regexp_extract(norm, r"(\.[^.]+)$", 1)
    mail = F.concat(shift(F.concat(F.repeat(F.lit("a"), more), F.regexp_extract(norm, r"^(.*)\.[^.]+$", 1))), suffix)
    phone = F.concat(F.regexp_extract(norm, r"^([^|]*\|)", 1), shift(F.concat(F.regexp_extract(norm, r"\|(.*)$", 1), F.repeat(F.lit("0"), more))))

    def card(d: Column) -> Column:
        body = F.concat(F.slice(d, 1, F.size(d) - 1), F.array_repeat(F.lit(0), more))
        moved = _feistel(body, F.transform(body, lambda _: F.lit(10)), key, kind, attempt)
        # The last digit gives the new number the check sum of the old one.
        last = lambda m: F.pmod(_luhn(d) - _luhn(F.concat(m, F.array(F.lit(0)))), F.lit(10))
        return let(moved, lambda m: F.concat(F.array_join(m, ""), last(m).cast("string")))

    octets = F.concat(F.transform(F.split(norm, r"\."), lambda o: o.cast("int")), F.array_repeat(F.lit(0), more))
    address = let(octets, lambda o: F.array_join(_feistel(o, F.transform(o, lambda _: F.lit(256)), key, kind, attempt), "."))

    def named(pool: dict[str, str], name: str) -> Column:
        names = F.array(*[F.lit(x) for x in pool[name].split()])
        pick = lambda i: F.get(names, _draw(_digest(key, kind, attempt, norm), i, F.size(names)))
        return F.array_join(F.transform(F.sequence(F.lit(0), attempt), pick), "-")

    name = F.lit(None).cast("string")
    for k in POOLS:
        by_script = F.when(norm.rlike(r"\p{IsCyrillic}"), named(CYRILLIC_POOLS, k)).otherwise(named(POOLS, k))
        name = F.when(kind == k, by_script).otherwise(name)
    return (
        F.when(kind == "email", mail)
        .when(kind == "phone", phone)
        .when(kind == "card", let(F.transform(_chars(norm), lambda c: c.cast("int")), card))
        .when(kind == "ip", address)
        .when(kind == "key", keep("AKIA", 4))
        .when(kind == "iban", keep("land", 2))
        .when(kind.isin("ssn", "secret"), shift(F.concat(norm, F.repeat(F.lit("0"), more))))
        .otherwise(name)
    )


def _gender(raw: Column) -> Column:
    return (
        F.when(raw.rlike(rf"^(?:{FEMALE})(?!\w)"), "given_f").when(raw.rlike(rf"^(?:{MALE})(?!\w)"), "given_m").otherwise("given_n")
    )


def _untitled(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^{_TITLES}(?={_PARTICLES}\p{{Lu}})", "")


def _renamed(raw: Column, new: Column) -> Column:
    """A name with its words replaced in order; titles, particles and separators stay, words in capitals stay so."""

    def of(rest: Column) -> Column:
        old = F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0))
        cased = F.zip_with(new, old, lambda n, o: F.when(o.rlike(r"^\p{Lu}{2}") & (F.upper(o) == o), F.upper(n)).otherwise(n))
        between = F.split(rest, _TOKEN, -1)
        # Initials written to the next word get a space, as their names are whole.
        between = F.transform(between, lambda b, i: F.when((b == "") & (i > 0) & (i < F.size(between) - 1), F.lit(" ")).otherwise(b))
        body = F.array_join(F.flatten(F.zip_with(between, cased, lambda b, n: F.array(b, F.coalesce(n, F.lit(""))))), "")
        return F.concat(F.substring(raw, F.lit(1), F.char_length(raw) - F.char_length(rest)), body)

    return let(_untitled(raw), of)


def _parts(raw: Column) -> Column:
    """Entities of one match: array of (kind, norm); a name has one per word, the first of several being a given name."""
    kind = kind_of(raw)

    def of(k: Column) -> Column:
        words = F.regexp_extract_all(_untitled(raw), F.lit(_TOKEN), F.lit(0))
        kinds = lambda i: F.when((i == 0) & (F.size(words) > 1), _gender(raw)).otherwise(F.lit("surname"))
        plain = lambda w: F.lower(F.translate(w, "’.", "'"))
        name = F.transform(words, lambda w, i: F.struct(kinds(i).alias("kind"), plain(w).alias("norm")))
        return F.when(k == "name", name).otherwise(F.array(F.struct(k.alias("kind"), norm_of(k, raw).alias("norm"))))

    return let(kind, of)


def _rewritten(raw: Column, drawn: Column, key: str) -> Column:
    """The match with its entities replaced; ``drawn`` lists (kind, norm, attempt) of those drawn again."""

    def attempt(p: Column) -> Column:
        hit = F.filter(drawn, lambda d: (d["kind"] == p["kind"]) & (d["norm"] == p["norm"]))
        return F.coalesce(F.get(hit, 0)["attempt"], F.lit(0))

    def of(parts: Column) -> Column:
        new = F.transform(parts, lambda p: let(p, lambda q: surrogate(q["kind"], q["norm"], attempt(q), key)))
        kind = F.get(parts, 0)["kind"]

        def filled(n: Column) -> Column:
            whole = F.get(n, 0)
            fresh = lambda s: F.filter(_chars(s), lambda c: F.instr(F.lit(LETTERS), F.lower(c)) > 0)
            keep = lambda head: F.concat(head, _fitted(F.substring(raw, F.char_length(head) + 1, F.char_length(raw)), fresh(F.regexp_replace(whole, r"^[^|]*\|", ""))))
            longer = F.char_length(whole) > F.char_length(raw)
            return (
                F.when(kind == "phone", keep(F.regexp_extract(raw, r"^(\+\d{1,3})(?=[ .(-])", 1)))
                .when((kind == "email") & longer, whole)
                .when(kind.isin("card", "ssn", "iban", "email"), _fitted(raw, fresh(whole)))
                .when(kind == "secret", F.concat(F.regexp_extract(raw, rf"^({_LABEL})", 1), whole))
                .when(kind.isin("ip", "key"), whole)
                .otherwise(_renamed(raw, n))
            )

        return let(new, filled)

    return let(_parts(raw), of)


def _mentions(docs: DataFrame) -> DataFrame:
    """Settled (text_hash, kind, norm), each once per text."""
    each = docs.select(docs["text"].alias("text")).select(F.xxhash64("text").alias("th"), F.explode(_matches(F.col("text"))).alias("raw"))
    return settle(each.select("th", F.explode(_parts(F.col("raw"))).alias("p")).select("th", "p.*").distinct(), "mentions")


def drawn_again(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first replacement collides; attempt is the first free round.

    Rounds end: once they make replacements longer, every round has at least ten times the room of the one before.
    """
    spark = mentions.sparkSession
    every = settle(mentions.select("kind", "norm").distinct(), "entities")
    real = every.select("kind", F.lower("norm").alias("new"))
    pending, taken, again = every, None, None
    for attempt in count():
        new = F.lower(surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key)).alias("new")
        # Drawing is costly and the table small: without this one file, so one task, would hold it all.
        tasks = max(1, min(DRAWN_TASKS, pending.count() // DRAWN_ROWS))
        drawn = settle(pending.repartition(tasks, "norm").select("kind", "norm", new), "drawn")
        free = drawn.join(real, ["kind", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "new"], "left_anti")
        good = settle(free.groupBy("kind", "new").agg(F.min("norm").alias("norm")), "free")
        taken = good.select("kind", "new") if taken is None else taken.unionByName(good.select("kind", "new"))
        if attempt:
            found = good.select("kind", "norm", F.lit(attempt).alias("attempt"))
            again = found if again is None else again.unionByName(found)
        pending = settle(drawn.select("kind", "norm").join(good.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pending")
        if pending.isEmpty():
            return again if again is not None else spark.createDataFrame([], "kind string, norm string, attempt int")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """The documents with surrogates for all entities, and ``n_entities``."""
    mentions = _mentions(docs)
    again = settle(drawn_again(mentions, key), "drawn-again")
    release(docs.sparkSession)
    names = [c for c in docs.columns if c != "n_entities"]
    # Names of our own that no column of the input has.
    own = max(map(len, names), default=0) * "_"
    drawn, th, new_text = f"{own}_drawn", f"{own}_th", f"{own}_new"
    kind = "array<struct<kind:string,norm:string,attempt:int>>"
    if again.isEmpty():
        out = docs.withColumn(drawn, F.array().cast(kind))
    else:
        listed = mentions.join(again, ["kind", "norm"]).groupBy(F.col("th").alias(th))
        listed = listed.agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(drawn))
        out = docs.join(listed, F.xxhash64(docs["text"]) == F.col(th), "left")
        out = out.withColumn(drawn, F.coalesce(drawn, F.array().cast(kind)))

    def rewritten(raws: Column) -> Column:
        between = F.split(docs["text"], ANY_ENTITY, -1)
        new = F.transform(raws, lambda r: _rewritten(r, F.col(drawn), key))
        text = let(between, lambda b: F.array_join(F.flatten(F.zip_with(b, new, lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), ""))
        return F.struct(
            F.when(F.size(raws) > 0, text).otherwise(docs["text"]).alias("text"), F.size(raws).cast("long").alias("n")
        )

    out = out.withColumn(new_text, let(_matches(F.coalesce(docs["text"], F.lit(""))), rewritten))
    return out.select(*[F.col(new_text)["text"].alias("text") if c == "text" else docs[c] for c in names], F.col(new_text)["n"].alias("n_entities"))

"""Personal data replaced by keyed surrogates of the same type, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, fresh, let, written

KEY = "kinweave"
#: Surrogates changed after a collision that are sent to every task at most; more are joined by a shuffle.
CHANGED = 10_000
#: First names of surrogates, by gender and script; titles tell both.
NAMES = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera", "Alice", "Emma", "Irene", "Lena", "Marta", "Paula", "Rosa"),
    ("m", "latin"): ("Adam", "Carlos", "David", "Emil", "Felix", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor", "Hugo", "Karl"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Олег", "Павел"),
}
TITLES_F, TITLES_M, TITLES_X = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Г-жа|Κυρία", "Mr|Herr|Monsieur|Señor|Господин|Г-н|Κύριος", "Dr|Prof|Professor"
TITLE = rf"(?:{TITLES_F}|{TITLES_M}|{TITLES_X})\.? "
#: Small letters of the scripts that surrogates are spelt in; a name of another script is spelt in its own letters.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: Draws after which surrogates grow by a letter or digit a draw, so that short ones never run out.
GROWS = 3
#: Patterns by type; an earlier one wins where two begin at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,190}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.,])0[0-9]{2,4}[ /\-][0-9]{6,8}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk_(?:live|test)_[A-Za-z0-9]{16,99}|xox[abprs]-[A-Za-z0-9\-]{10,99})(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7})(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE}\p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity has; the other texts are not searched further.
HINT = rf"[0-9@]|::|gh[pousr]_|sk_|xox|{TITLE}"


def kind(value: Column) -> Column:
    """The type of what a pattern has found; null for a long number that fails the check digit of cards."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        fits = F.regexp_like(value, F.lit(f"^(?:{p})$"))
        if name == "card":
            fits = fits & (_luhn(F.regexp_replace(value, "[^0-9]", "")) == 0)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def mentions(text: Column) -> Column:
    """Every entity of a text in order, and long numbers that are none; empty where there are none."""
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def canonical(value: Column, of: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, small letters of the rest."""
    compact = F.regexp_replace(value, r"[ .()\-]", "")
    return F.when(of.isin("phone", "card", "ssn"), F.regexp_replace(value, "[^0-9]", "")).when(of == "iban", compact).when(of == "token", value).otherwise(F.lower(value))


def name_parts(value: Column) -> Column:
    """Struct of a titled name: title, given (empty for a lone family name), family, and gender by the title (f, m or x)."""
    title = F.regexp_extract(value, rf"^({TITLE})", 1)
    rest = F.regexp_replace(value, rf"^{TITLE}", "")
    two = F.instr(rest, " ") > 0
    gender = F.when(F.regexp_like(title, F.lit(rf"^(?:{TITLES_F})\.? ")), "f").when(F.regexp_like(title, F.lit(rf"^(?:{TITLES_M})\.? ")), "m").otherwise("x")
    return F.struct(title.alias("title"), F.when(two, F.substring_index(rest, " ", 1)).otherwise("").alias("given"), F.substring_index(rest, " ", -1).alias("family"), gender.alias("gender"))


def entities_of(value: Column, of: Column) -> Column:
    """Array of (of, value) that a mention consists of: a name's family name, and its given name by gender, are entities of their own."""
    part = lambda o, v: F.struct(o.alias("of"), v.alias("value"))
    names = lambda n: F.filter(F.array(part(F.lit("family"), n["family"]), part(F.concat(F.lit("given_"), n["gender"]), n["given"])), lambda e: e["value"] != "")
    return F.when(of == "name", let(name_parts(value), names)).otherwise(F.array(part(of, value)))


def _stream(of: Column, canon: Column, attempt: Column, key: str, blocks: int = 4) -> Column:
    """256 hex digits that the key, the type, the entity and the attempt determine."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}|{i}|"), of, F.lit("|"), attempt.cast("string"), F.lit("|"), canon), 256) for i in range(blocks)])


def _draw(stream: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a stream, i from 0."""
    return F.conv(F.substring(stream, (i * 4) % 252 + 1, F.lit(4)), 16, 10).cast("int") % n


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Sum of a string of digits by which card numbers are checked."""
    back = F.transform(F.reverse(_chars(digits)), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x) % 10


def _letters(value: Column, s: Column, upto: Column | None = None) -> Column:
    """Each letter and digit drawn anew in its case, class and script; the rest, and what is after ``upto``, stays. Letters of scripts
    without an alphabet here are drawn from the value's own."""
    own = F.filter(_chars(value), lambda c: c.rlike(r"^\p{L}$"))

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _draw(s, i, len(letters)) + 1, F.lit(1))
        new = F.when(c.rlike("^[0-9]$"), pick("0123456789"))
        for small, script in zip(ALPHABETS, ("IsLatin", "IsCyrillic", "IsGreek")):
            new = new.when(c.rlike(rf"^[\p{{Lu}}&&\p{{{script}}}]$"), pick(small.upper())).when(c.rlike(rf"^[\p{{L}}&&\p{{{script}}}]$"), pick(small))
        new = new.when(c.rlike(r"^\p{L}$"), F.element_at(own, F.pmod(F.conv(F.substring(s, (i * 4) % 252 + 1, F.lit(4)), 16, 10).cast("int"), F.size(own)) + 1)).otherwise(c)
        return new if upto is None else F.when(i < upto, new).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _digits_into(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``."""
    at = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _grown(value: Column, s: Column, attempt: Column) -> Column:
    """``value`` with as many more letters in its script as draws went beyond GROWS; they repeat its last letter's place in the stream."""
    more = F.greatest(attempt - GROWS, F.lit(0))
    tail = F.lower(F.repeat(F.substring(value, -1, 1), F.least(more, F.lit(40))))
    return F.concat(value, F.when(more > 0, _letters(tail, F.reverse(s))).otherwise(""))


def _iban(value: Column, s: Column) -> Column:
    """Country and format stay, the account is drawn, the two check digits are those of it."""
    country = F.substring(value, F.lit(1), F.lit(2))
    account = _letters(F.substring(value, F.lit(5), F.length(value)), s)
    digits = lambda t: F.array_join(F.transform(_chars(t), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    whole = digits(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")))
    rest = F.aggregate(_chars(whole), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def surrogate(value: Column, of: Column, attempt: Column, key: str, types: tuple[str, ...] | None = None) -> Column:
    """The replacement of an entity (of ``entities_of``): the same type, format, script, case and, of given names, gender; by key and entity only.

    ``types``: those that ``of`` may be, all if None; what others need is left out of the expression.
    """
    canon = canonical(value, of)

    def made(s: Column) -> Column:
        n = F.length(canon)
        digits = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _draw(s, i, 10).cast("string")), "")
        # the first digits of a number, a country or an issuer, stay
        code = F.when((of == "phone") & (n > 10), 1).when(of == "card", 1).otherwise(0)
        kept = lambda d: F.concat(F.substring(canon, F.lit(1), code), F.substring(d, code + 1, n))
        body = lambda k: F.substring(k, F.lit(1), n - 1)
        checked = lambda k: F.when(_luhn(canon) == 0, F.concat(body(k), ((10 - _luhn(F.concat(body(k), F.lit("0")))) % 10).cast("string"))).otherwise(k)
        more = lambda d: F.when(attempt > 4 * GROWS, F.substring(F.reverse(d), F.lit(1), attempt - 4 * GROWS)).otherwise("")
        number = lambda: let(digits, lambda d: F.concat(_digits_into(value, kept(d)), more(d)))
        hexed = lambda: let(F.substring(F.concat(s, s), F.lit(1), F.length(value)), lambda h: F.when(value == F.lower(value), h).otherwise(F.upper(h)))
        start = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_|sk_live_|sk_test_|xox[abprs]-)", 1)
        front = F.when(attempt > GROWS, _letters(F.repeat(F.lit("a"), F.least(attempt - GROWS, F.lit(40))), F.reverse(s))).otherwise("")
        branches = {
            ("phone", "ssn"): number,
            ("card",): lambda: let(digits, lambda d: _digits_into(value, let(kept(d), checked))),
            ("ip",): lambda: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(s, i, 254) + 1).cast("string")), "."),
            ("ip6",): lambda: F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == ":", c).otherwise(F.substring(s, i % 250 + 1, F.lit(1)))), ""),
            ("secret",): hexed,
            ("token",): lambda: F.concat(start, _letters(F.substring(value, F.length(start) + 1, F.length(value)), s)),
            ("email",): lambda: F.concat(front, _letters(value, s, F.length(value) - F.length(F.substring_index(value, ".", -1)))),
            ("iban",): lambda: _iban(value, s),
            ("family",): lambda: _grown(_letters(value, s), s, attempt),
            ("given_f", "given_m", "given_x"): lambda: _given(value, of, s, attempt),
        }
        out = F.lit(None).cast("string")
        for names, build in branches.items():
            if types is None or set(names) & set(types):
                out = F.when(of.isin(*names), build()).otherwise(out)
        return out

    return let(_stream(of, canon, attempt, key), made)


def _given(value: Column, of: Column, s: Column, attempt: Column) -> Column:
    """A given name of the gender and script at the first draws; spelt letter by letter after GROWS collisions, or in a script without a list."""
    spelt = _grown(_letters(value, s), s, attempt)
    latin, cyrillic = F.regexp_like(value, F.lit(r"^\p{IsLatin}")), F.regexp_like(value, F.lit(r"^\p{IsCyrillic}"))
    out = F.lit(None).cast("string")
    for script, fits in (("latin", latin), ("cyrillic", cyrillic)):
        both = NAMES["f", script] + NAMES["m", script]
        for gender, names in (("given_f", NAMES["f", script]), ("given_m", NAMES["m", script]), ("given_x", both)):
            pick = F.element_at(F.array(*map(F.lit, names)), _draw(s, F.lit(60), len(names)) + 1)
            out = F.when(fits & (of == gender), pick).otherwise(out)
    out = F.when((F.length(value) > 1) & (value == F.upper(value)), F.upper(out)).otherwise(out)
    return F.when(attempt < GROWS, F.coalesce(out, spelt)).otherwise(spelt)


def _entities(docs: DataFrame) -> DataFrame:
    """of, canon, value: the distinct entities of all texts, with one mention each."""
    m = docs.select(F.explode(mentions(F.col("text"))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    m = m.select("value", kind(F.col("value")).alias("of")).where("of is not null").select(F.inline(entities_of(F.col("value"), F.col("of"))))
    return m.select("of", canonical(F.col("value"), F.col("of")).alias("canon"), "value").groupBy("of", "canon").agg(F.min("value").alias("value"))


def assigned(docs: DataFrame, key: str = KEY, make=surrogate, most: int = 50) -> DataFrame:
    """of, canon, attempt of every entity such that no two of a type share a surrogate and none has another's real value.

    Every round checks all entities; of those that collide the least keeps its surrogate, the others draw again.
    """
    t = _entities(docs).withColumn("attempt", F.lit(0))
    for _ in range(most):
        new = make(F.col("value"), F.col("of"), F.col("attempt"), key)
        t = written(t.select("of", "canon", "value", "attempt").withColumn("new", let(new, lambda n: canonical(n, F.col("of")))), "entities")
        same = t.groupBy("of", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = t.select("of", F.col("canon").alias("new"), F.lit(True).alias("real"))
        checked = t.join(same, ["of", "new"], "left").join(real, ["of", "new"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("canon") != F.col("first"), F.lit(False))
        if checked.where(again).isEmpty():
            return t
        t = checked.withColumn("attempt", F.col("attempt") + again.cast("int")).select("of", "canon", "value", "attempt")
    raise RuntimeError("the surrogates of a type are too few for its entities")


def replace(docs: DataFrame, key: str = KEY, make=surrogate) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``n_entities`` replaced in it (in place of a column of that name).

    Mentions of one entity get one surrogate in every document; see ``assigned`` for distinctness. Where a text has a titled full name, the
    bare name elsewhere in it is replaced likewise (and not counted). Texts without entities, empty and null ones stay as they are
    (0 entities); an empty table gives none. Rows are kept as they are, repeated or not; other columns stay.
    """
    changed = assigned(docs, key, make).where("attempt > 0").select(F.concat_ws("|", "of", "canon").alias("entity"), "attempt")
    found = mentions(F.col("text"))
    new_name, again_name, row_name = (fresh(docs, x) for x in ("_new", "_again", "_row"))
    if changed.isEmpty():
        again = lambda of, canon: F.lit(0)
        rows = docs
    else:
        if bounded(changed, CHANGED * 64, 64):
            rows = docs.withColumn(again_name, changed.agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt")))).scalar())
        else:
            rows = written(docs.withColumn(row_name, F.monotonically_increasing_id()), "rows")  # numbered once, whatever is run again
            each = F.flatten(F.transform(F.filter(found, lambda v: kind(v).isNotNull()), lambda v: F.transform(entities_of(v, kind(v)), lambda e: F.concat_ws("|", e["of"], canonical(e["value"], e["of"])))))
            named = rows.select(row_name, F.explode(F.array_distinct(each)).alias("entity"))
            rows = rows.join(named.join(changed, "entity").groupBy(row_name).agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias(again_name)), row_name, "left")
        again = lambda of, canon: F.coalesce(F.try_element_at(F.col(again_name), F.concat_ws("|", of, canon)), F.lit(0))

    def made(v: Column, of: Column, types: tuple[str, ...]) -> Column:
        attempt = again(of, canonical(v, of))
        return surrogate(v, of, attempt, key, types) if make is surrogate else make(v, of, attempt, key)

    given = lambda n: made(n["given"], F.concat(F.lit("given_"), n["gender"]), ("given_f", "given_m", "given_x"))
    full = lambda n: F.concat(F.when(n["given"] != "", F.concat(given(n), F.lit(" "))).otherwise(""), made(n["family"], F.lit("family"), ("family",)))

    def rewritten(f: Column) -> Column:
        name = lambda v: let(name_parts(v), lambda n: F.concat(n["title"], full(n)))
        new = lambda v: let(kind(v), lambda of: F.when(of.isNull(), v).when(of == "name", name(v)).otherwise(made(v, of, tuple(t for t in PATTERNS if t != "name"))))
        people = F.array_distinct(F.transform(F.filter(f, lambda v: F.regexp_like(v, F.lit(rf"^{TITLE}\S+ \S+$"))), lambda v: let(name_parts(v), lambda n: F.struct(F.concat(n["given"], F.lit(" "), n["family"]).alias("old"), full(n).alias("new")))))
        bare = lambda part, p: F.when(F.size(p) == 0, part).otherwise(F.aggregate(p, part, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["old"], F.lit(r"\E(?![\p{L}\p{N}])")), x["new"])))
        joined = lambda parts, p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(f)), lambda i: F.concat(bare(F.get(parts, i), p), F.when(i < F.size(f), new(F.get(f, i))).otherwise(""))), "")
        text = let(F.split("text", ANY, -1), lambda parts: let(people, lambda p: joined(parts, p)))
        return F.when(F.size(f) > 0, F.struct(text.alias("text"), F.size(F.filter(f, lambda v: kind(v).isNotNull())).alias("n"))).otherwise(F.struct(F.col("text"), F.lit(0).alias("n")))

    rows = rows.withColumn(new_name, let(found, rewritten))
    kept = [F.col(new_name)["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_entities"]
    return rows.select(*kept, F.col(new_name)["n"].cast("long").alias("n_entities"))

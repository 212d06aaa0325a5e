"""PII: surrogates for detected entities (DataFrame functions only).

Entities are found by one pattern, normalized, and gathered once.  Each distinct
entity gets a surrogate from a keyed digest that keeps its type and format:
digits stay digits, letters letters of their case and script, separators and
country codes stay, card numbers keep their Luhn remainder, names keep gender
and script.  Surrogates are checked against each other and against all originals
of their kind; those that collide are drawn again, so different entities stay
different.  The same entity has the same surrogate in every document, however
its mentions are written.

Whoever has the key can compute the surrogates again: name a secret one in
the setting `spark.ledgerloom.pii.key` (KEY is for tests and trials).

Texts are searched once; only documents with mentions are shuffled.  Defined
results: a null text stays null; equal mentions get equal surrogates; a text
without mentions is returned unchanged.  After WIDEN draws the surrogates of
kinds of any length grow, so they cannot run out; where all surrogates of a
kind of fixed length are taken, MOST_DRAWS rounds end in an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, nested, table

KEY, KEY_SETTING = "replace this key", "spark.ledgerloom.pii.key"
#: Draws after which surrogates grow where their kind allows it, and draws after which a kind counts as exhausted.
WIDEN, MOST_DRAWS = 4, 100

MALE = "Mr Herr Monsieur M Sr Señor".split()
FEMALE = "Mrs Ms Miss Frau Mme Mlle Madame Sra Señora".split()
NEUTRAL = "Dr Prof".split()
_LONG = [t for t in (*MALE, *FEMALE, *NEUTRAL) if len(t) > 1]
_TITLE = "(?:" + "|".join(sorted({*_LONG, *(t.upper() for t in _LONG)}, key=lambda t: (-len(t), t))) + r"|M(?=\.))\.?"
_WORD = r"\p{Lu}[\p{L}'’\-]++"
_LOCAL = r"\p{L}\p{N}._%+\-"
#: A secret in hex digits; it is the same in either case.
HEX = "^[0-9A-Fa-f]{32,}$"
#: Patterns by kind, in order of precedence.
PATTERNS = {
    "name": rf"(?<!\p{{L}}){_TITLE} {_WORD}(?: {_WORD})?",
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?<![\p{L}\p{N}])(?:AKIA[A-Z0-9]{16}|[0-9A-Fa-f]{32,}+)(?![\p{L}\p{N}])|(?<=[=: \"'])(?=[A-Za-z0-9+/_\-]{8})(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key) ?[=:] ?[\"']?)[A-Za-z0-9+/_\-]{8,}+",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|3[0-9]{3}[ \-][0-9]{6}[ \-][0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[\- ][0-9]{4}(?![0-9])|(?<![0-9\-.])[0-9]{3}[\-. ][0-9]{3}[\-. ][0-9]{4}(?![0-9\-])",
}
#: Where a mention can begin: at a digit, + or (, not after a letter, or before a colon; a cheap test that most places fail.
BEGIN = r"(?=[0-9+(]|(?<!\p{L})|[0-9A-Fa-f]{1,4}:)"
ANY = f"{BEGIN}(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What a text needs to have a mention at all; cheaper than ANY.
TRIGGER = rf"[0-9@]|[0-9A-Fa-f]{{32}}|AKIA|[=:] ?[\"']?[A-Za-z0-9+/_\-]{{8}}|{_TITLE} \p{{Lu}}"

#: Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se ta te vo".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се та те во".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε τα τε χο".split(),
    "armenian": "բա բե բո գա գե գո դա դե դո զա զե կա կե կո լա լե լո մա մե մո նա նե նո պա պո ռա ռե ռո սա սե տա տո".split(),
}
ENDINGS = {
    ("latin", "m"): "n ldo rt nus".split(), ("latin", "f"): "lia na ra ssa".split(), ("latin", "n"): "n l r s".split(),
    ("cyrillic", "m"): "н лд рт с".split(), ("cyrillic", "f"): "лия на ра са".split(), ("cyrillic", "n"): "н л р с".split(),
    ("armenian", "m"): "ն կ մ ր".split(), ("armenian", "f"): "նա րա սա լա".split(), ("armenian", "n"): "ն լ ր ս".split(),
    ("greek", "m"): "ς νος ρος λος".split(), ("greek", "f"): "λια να ρα σα".split(), ("greek", "n"): "ν λι ρι ς".split(),
}


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hex digits that depend on all arguments."""
    parts = [F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), F.lit(half)).cast("binary") for half in ("a", "b")]
    return F.concat(*[F.sha2(p, 512) for p in parts])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: str, n: Column) -> Column:
    return F.substr(F.lit(options), F.pmod(n, F.lit(len(options))) + 1, F.lit(1))


def _drawn(options: str, stream: Column, n: Column) -> Column:
    """n characters of options."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: _pick(options, _byte(stream, 127 - k))), "")).otherwise("")


#: Parts of a name: runs of letters, and the marks between them.
NAME_PARTS = r"['’\-]+|[^'’\-]+"


def _swapped(norm: Column, stream: Column, keep: Column, letters_hex: bool = False) -> Column:
    """Every character of norm from number `keep` on replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        if letters_hex:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n)).when(c.rlike("[A-F]"), _pick("ABCDEF", n)).otherwise(c)
        swapped = F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        swapped = swapped.when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуф", n)).when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνοπρστυφ", n)).when(c.rlike(r"\p{L}"), _pick("àâäçéèêëíîïñóôöúûü", n))
        return F.when(i < keep, c).otherwise(swapped.otherwise(c))

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _digits(norm: Column, stream: Column, keep: Column) -> Column:
    """Digits of norm replaced from number `keep` on; the first of them is 2 to 9."""
    return F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when((i < keep) | ~c.rlike("[0-9]"), c).when(i == keep, _pick("23456789", _byte(stream, i))).otherwise(_pick("0123456789", _byte(stream, i)))), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo 10 (0: valid)."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The replacement of a normalized entity."""
    s = _stream(key, kind, norm, attempt)
    n = F.char_length(norm)
    card = F.substr(_swapped(norm, s, F.lit(1)), F.lit(1), n - 1)
    ipv4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.lit(1) + F.pmod(_byte(s, i), F.lit(254))).cast("string")), ".")
    wider = F.greatest(attempt - WIDEN, F.lit(0))
    more_letters = _drawn("abcdefghijklmnopqrstuvwxyz", s, wider)
    more_digits = _drawn("0123456789", s, wider)
    tail = F.char_length(F.regexp_extract(norm, r"(\.[^.]*)$", 1))
    email = F.concat(more_letters, _swapped(F.substr(norm, F.lit(1), n - tail), s, F.lit(0)), F.substr(norm, n - tail + 1, tail))
    hexes = F.concat(_swapped(norm, s, F.lit(0), letters_hex=True), more_digits)

    def piece(of: str | None, part: Column, i: Column, ending: str | None, last: Column) -> Column:
        """A made-up word for one part of a name."""
        start = i * 11
        length = (2 if ending else 3) + F.least(attempt, F.lit(20))
        if of is None:  # a script without syllables here: the part's own letters, drawn anew
            return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(part), F.lit(3)) + attempt), lambda k: F.substr(part, F.pmod(_byte(s, start + k), F.char_length(part)) + 1, F.lit(1))), "")
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.get(_array(SYLLABLES[of]), F.pmod(_byte(s, start + k), F.lit(32)))), "")
        return F.concat(syllables, F.when(last, F.get(_array(ENDINGS[of, ending]), F.pmod(_byte(s, F.lit(60)), F.lit(4)))).otherwise("")) if ending else syllables

    def by_script(ending: str | None) -> Column:
        parts = F.regexp_extract_all(norm, F.lit(NAME_PARTS), F.lit(0))
        n_parts = F.size(parts)
        longer = F.exists(parts, lambda y: y.rlike(r"^\p{L}{2}"))

        def one(x: Column, i: Column) -> Column:
            last = i == n_parts - 1
            made = F.when(x.rlike(r"^['’\-]+$") | (x.rlike(r"^\p{L}$") & longer), x)  # marks, and particles of one letter
            for script, name in (("IsCyrillic", "cyrillic"), ("IsGreek", "greek"), ("IsArmenian", "armenian"), ("IsLatin", "latin")):
                made = made.when(x.rlike(rf"^\p{{{script}}}"), piece(name, x, i, ending, last))
            return made.otherwise(piece(None, x, i, ending, last))

        return F.array_join(F.transform(parts, one), "")

    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", ipv4)
        .when(kind == "card", F.concat(card, F.pmod(luhn(norm) - luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")))
        .when(kind == "phone", F.concat(F.when(norm.startswith("+"), _digits(norm, s, F.when(norm.rlike(r"^\+[17]"), 2).otherwise(3))).otherwise(_digits(norm, s, F.lit(0))), more_digits))
        .when(kind == "ssn", _digits(norm, s, F.lit(0)))
        .when(kind.isin("ipv6", "mac"), _swapped(norm, s, F.lit(0), letters_hex=True))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), hexes)
        .when(kind == "secret", F.concat(_swapped(norm, s, F.when(norm.startswith("AKIA"), 4).otherwise(0)), more_letters))
        .when(kind == "iban", _swapped(norm, s, F.lit(2)))
        .when(kind == "given-m", by_script("m"))
        .when(kind == "given-f", by_script("f"))
        .when(kind == "given-n", by_script("n"))
        .otherwise(by_script(None))
    )


def rendered(kind: Column, raw: Column, core: Column) -> Column:
    """A surrogate in the format of a mention: its separators and its case."""
    digits = F.regexp_replace(core, "[^0-9]", "")
    n_digits = F.char_length(F.regexp_replace(raw, "[^0-9]", ""))
    placed = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.char_length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    placed = F.concat(placed, F.substr(digits, n_digits + 1, F.char_length(digits)))
    cased = F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(F.substr(raw, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(core, F.char_length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    of_raw = F.regexp_extract_all(raw, F.lit(NAME_PARTS), F.lit(0))
    capital = lambda x, i: F.when(F.coalesce(F.get(of_raw, i), F.lit("A")).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2), F.char_length(x)))).otherwise(x)
    person = F.when((F.upper(raw) == raw) & (F.char_length(raw) > 1), F.upper(core)).otherwise(F.array_join(F.transform(F.regexp_extract_all(core, F.lit(NAME_PARTS), F.lit(0)), capital), ""))
    hexes = F.when(raw.rlike("[A-F]") & ~raw.rlike("[a-f]"), F.upper(core)).otherwise(cased)
    return F.when((kind == "secret") & raw.rlike(HEX), hexes).when(kind.isin("phone", "card", "ssn"), placed).when(kind.isin("email", "ipv6", "mac"), cased).when(kind == "iban", spaced).when(kind.isin("ipv4", "secret"), core).otherwise(person)


def _kind(mention: Column) -> Column:
    found = F.when(mention.rlike("@"), "email").when(mention.rlike(HEX), "secret")
    for kind in ("ipv6", "mac", "ipv4", "ssn"):
        found = found.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    found = found.when(mention.rlike(rf"^{_TITLE} \p{{Lu}}"), "name").when(mention.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$") & ~mention.startswith("AKIA"), "iban")
    return found.when(mention.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|3[0-9]{3}[ \-][0-9]{6}[ \-][0-9]{5})$"), "card").when(mention.rlike(r"^[+(0-9][0-9 ().\-]+$"), "phone").otherwise("secret")


def _parts(kind: Column, m: Column) -> Column:
    """A mention as an array of (p, kind, norm, raw); kind is null for text that stays."""

    def part(p: int, k: Column, norm: Column, raw: Column) -> Column:
        return F.struct(F.lit(p).alias("p"), k.alias("kind"), norm.alias("norm"), raw.alias("raw"))

    none = F.lit(None).cast("string")
    title = F.regexp_extract(m, rf"^({_TITLE} )", 1)
    words = F.split(F.substr(m, F.char_length(title) + 1, F.char_length(m)), " ")
    plain = F.lower(F.regexp_replace(title, r"[. ]", ""))
    gender = F.when(plain.isin(*map(str.lower, MALE)), "given-m").when(plain.isin(*map(str.lower, FEMALE)), "given-f").otherwise("given-n")
    given, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    surname = part(3, F.lit("surname"), F.lower(last), last)
    full = F.array(part(0, none, none, title), part(1, gender, F.lower(given), given), part(2, none, none, F.lit(" ")), surname)
    short = F.array(part(0, none, none, title), surname)
    norm = F.when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), F.regexp_replace(m, "[^0-9]", ""))).when(kind.isin("card", "ssn"), F.regexp_replace(m, "[^0-9]", ""))
    norm = norm.when(kind.isin("email", "ipv6", "mac"), F.lower(m)).when((kind == "secret") & m.rlike(HEX), F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    return F.when(kind == "name", F.when(F.size(words) > 1, full).otherwise(short)).otherwise(F.array(part(0, kind, norm, m)))


def resolve(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, core) of distinct entities (kind, norm): no core twice in a kind, none that is an original of it."""
    spark = entities.sparkSession
    originals = materialize(entities.distinct(), "entities")
    pending = originals.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    for _ in range(MOST_DRAWS):
        drawn = pending.withColumn("core", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        first = drawn.groupBy("kind", "core").agg(F.min("norm").alias("first"))
        free = first.join(originals.select("kind", F.col("norm").alias("core")), ["kind", "core"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "core"), ["kind", "core"], "left_anti")
        tried = materialize(drawn.join(free, ["kind", "core"], "left").withColumn("fits", F.coalesce(F.col("norm") == F.col("first"), F.lit(False))), "surrogates")
        fits = tried.where("fits").select("kind", "norm", "core")
        done = fits if done is None else done.unionByName(fits)
        pending = tried.where("not fits").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done
    raise ValueError("the surrogates of a kind are exhausted")


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document: `row` (its columns), text (with surrogates), n_entities, kinds (of its mentions, sorted)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    rows = nested(docs)
    text = F.col("row.text")
    mentions = F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = rows.withColumn("mentions", mentions).withColumn("rid", F.monotonically_increasing_id())
    found = materialize(found, "mentions")  # so that texts are searched once; a second search would cost more than this table
    some = F.coalesce(F.size("mentions"), F.lit(0)) > 0
    hit = found.where(some)
    kinds = hit.select("rid", F.posexplode("mentions").alias("i", "m")).withColumn("kind", _kind(F.col("m")))
    parts = kinds.select("rid", "i", F.col("kind").alias("of"), F.explode(_parts(F.col("kind"), F.col("m"))).alias("x")).select("rid", "i", "of", "x.*")
    surrogates = resolve(parts.where("kind is not null").select("kind", "norm"), key)
    pieces = parts.join(surrogates, ["kind", "norm"], "left").withColumn("piece", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(rendered(F.col("kind"), F.col("raw"), F.col("core"))))
    per_mention = pieces.groupBy("rid", "i").agg(F.array_sort(F.collect_list(F.struct("p", "piece"))).alias("x"), F.first("of").alias("of"))
    per_doc = per_mention.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", F.array_join("x.piece", "").alias("piece")))).alias("y"), F.array_sort(F.collect_set("of")).alias("kinds"))
    joined = F.array_join(F.transform(F.split(text, ANY, -1), lambda g, i: F.concat(g, F.coalesce(F.get(F.col("y"), i)["piece"], F.lit("")))), "")
    changed = hit.join(per_doc, "rid").select("row", joined.alias("text"), F.size("mentions").cast("long").alias("n_entities"), "kinds")
    same = found.where(~some).select("row", text.alias("text"), F.lit(0).cast("long").alias("n_entities"), F.expr("cast(array() as array<string>)").alias("kinds"))
    return same.unionByName(changed)


def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    found = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "n_entities", "kinds")

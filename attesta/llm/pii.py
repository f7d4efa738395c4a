"""Personal data replaced by keyed surrogates. Built-in functions only.

Entities are found by one regular expression, made for each text of the kinds whose signs it has (most texts have none and
aren't searched). A surrogate is made by a keyed permutation of the entity's own characters within their kinds (digits,
letters of a script, vowels and consonants of a name), so it has the entity's format, equal entities get equal surrogates
everywhere, and different ones of a kind get different ones. `collisions` checks that on the whole corpus; should any value
share a surrogate nevertheless, it alone gets a new one. No value is its own surrogate, and letters of any script move.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import _forget, _write, materialise, own_name, small, table

#: The session's setting that holds the secret key.
KEY_SETTING = "spark.attesta.pii.key"
#: Rounds in which colliding values get new surrogates of their own length; longer ones after that.
ROUNDS = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX4 = r"[0-9A-Fa-f]{1,4}"
#: Titles before names: of women, of men, of both.
FEMALE = ["Mrs", "Ms", "Miss", "Lady", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Srta", "Doña", "Госпожа", "Doamna", "doamna", "Doamnei", "doamnei", "Domnișoara", "domnișoara", "D-na", "d-na", "Dna", "dna"]
MALE = ["Mr", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Domnul", "domnul", "Domnului", "domnului", "D-l", "d-l", "Dl", "dl"]
BOTH = ["Dr", "Prof"]
#: Small words inside names.
PARTICLES = ["de", "del", "la", "van", "von", "der", "den", "di", "da", "dos"]
_TITLE = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE + BOTH)})\.? "
_WORD = r"[\p{Lu}\p{Lo}\p{IsGeorgian}][\p{L}'’-]*\p{L}"
#: What is found, in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z])(?:[Pp]assword|PASSWORD|passwd|[Ss]ecret|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![\w:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.-])\d{3}\.\d{3}\.\d{4}(?![\w-])"
    r"|(?<![\w.(/-])(?!\d{2}[-/]\d{2}[-/]\d{4}(?!\d))(?=(?:[ /-]?\d){9,13}(?!\d))0\d{1,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"{_TITLE}{_WORD}(?:(?: (?:{'|'.join(PARTICLES)}))* {_WORD}){{0,3}}",
}
KINDS = list(PATTERNS)

#: Characters that stand for each other.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
PLAIN = [DIGITS, LOWER, UPPER]
NAME = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
#: Ranges of code points whose other letters stand for each other, by script; those of Latin and Cyrillic in two parts.
RANGES = [
    (0xDF, 0x17F), (0x180, 0x24F), (0x1E01, 0x1EFF), (0x370, 0x3FF), (0x1F00, 0x1FFF), (0x430, 0x45F), (0x460, 0x52F), (0x561, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A),
    (0x671, 0x6D3), (0x710, 0x72F), (0x780, 0x7A5), (0x7CA, 0x7EA), *((k, k + 0x7F) for k in range(0x900, 0xE00, 0x80)), (0xE01, 0xE30), (0xE81, 0xEB0), (0xF40, 0xF6C),
    (0x1000, 0x102A), (0x10D0, 0x10FA), (0x1200, 0x137F), (0x1780, 0x17B3), (0x1820, 0x1878), (0x2C30, 0x2C5F), (0x2C81, 0x2CE3), (0x2D30, 0x2D67),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3105, 0x312F), (0xAB70, 0xABBF),
]
#: Ranges that hold nothing but letters without case; moved by their code points, so plans don't hold thousands of letters.
LARGE = [(0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xA016, 0xA48C), (0x1401, 0x166C)]
_STATED = set("".join(NAME))


def _letters(first: int, last: int) -> str:
    """Letters of a range that are small or without case, if case changes one into one."""
    own = (chr(c) for c in range(first, last + 1))
    fits = lambda c: unicodedata.category(c) == "Lo" or (unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)
    return "".join(c for c in own if c not in _STATED and fits(c))


NAME += [x for x in (_letters(*r) for r in RANGES) if len(x) > 4]
#: Last letters of names that don't end in an a, and letters of secrets that could be taken for hex: they stay so.
NOT_A = [re.sub("[aаα]", "", a) for a in NAME]
NOT_HEX = [DIGITS, "abcdef", "ghijklmnopqrstuvwxyz", UPPER]


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration holds; where it holds none, a random one for the rest of the session, so
    surrogates can't be undone by who knows this code. Configure one to get the same surrogates again."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, found)
    return found


def _let(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def _digest(key: str, turn: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{turn}|"), text), 256)


def _moved(text: Column, digest: Column, alphabets: list[str]) -> Column:
    """Each character moved within its alphabet by two hex digits of the digest; others stay."""
    every, sizes = "".join(alphabets), [len(a) for a in alphabets]
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    bounds = F.array(*[F.lit(x) for x in starts])

    def char(c: Column, k: Column, d: Column) -> Column:
        by = F.conv(F.substring(d, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        at = F.instr(F.lit(every), c) - 1
        own = F.size(F.filter(bounds, lambda x: x <= at)) - 1
        start = F.get(bounds, own)
        to = F.substring(F.lit(every), start + (at - start + by) % F.get(F.array(*map(F.lit, sizes)), own) + 1, F.lit(1))
        out = F.when((c != "") & (at >= 0), to)
        for first, last in LARGE if len(every) > 256 else ():
            moved = first + (F.ascii(c) - first + by) % (last - first + 1)
            out = out.when(F.ascii(c).between(first, last), F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE"))
        return out.otherwise(c)

    return _let(digest, lambda d: F.array_join(F.transform(F.split(text, ""), lambda c, k: char(c, k, d)), ""))


def _shifted(text: Column, key: str, alphabets: list[str]) -> Column:
    """Every character one to four places on in its alphabet: what has a character of any alphabet is another text."""
    by = 1 + hashlib.sha256(key.encode()).digest()[0] % 4
    return _moved(text, F.lit(f"{by:02x}" * 32), alphabets)


def permuted(text: Column, key: str, alphabets: list[str] = PLAIN) -> Column:
    """A keyed permutation of texts of one length and one pattern of alphabets: four Feistel turns over its halves. A text that would
    stay as it is is shifted, so none does; should it meet another's surrogate, `settled` tells them apart."""
    half = lambda s: F.floor(F.length(s) / 2).cast("int")
    left, right = lambda s: F.substring(s, F.lit(1), half(s)), lambda s: F.substring(s, half(s) + 1, F.length(s))
    step = lambda x, other, turn: _moved(x, _digest(key, turn, other), alphabets)
    mixed = lambda s: _let(
        step(left(s), right(s), 1),
        lambda a: _let(step(right(s), a, 2), lambda b: _let(step(a, b, 3), lambda a2: F.concat(a2, step(b, a2, 4)))),
    )
    return _let(text, lambda s: _let(mixed(s), lambda made: F.when(made != s, made).otherwise(_shifted(s, key, alphabets))))


def _luhn(digits: Column) -> Column:
    """The check digit that makes `digits` and it pass the Luhn test."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice")),
        lambda a, c: F.when(c == "", a).otherwise(
            F.struct((a["sum"] + F.when(a["twice"], F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int"))).alias("sum"), (~a["twice"]).alias("twice"))
        ),
    )
    return (10 - total["sum"] % 10) % 10


def _refilled(text: Column, chars: Column, rx: str) -> Column:
    """text with its characters that match rx replaced, in order, by those of chars."""
    return F.aggregate(
        F.split(text, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(rx), F.struct(F.concat(a["out"], F.substring(chars, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )["out"]


def _card(text: Column, key: str) -> Column:
    """All digits but the last permuted; the last keeps its distance from the right check digit, so valid stays valid."""

    def made(d: Column) -> Column:
        head = F.substring(d, F.lit(1), F.length(d) - 1)
        off = (F.substring(d, F.length(d), F.lit(1)).cast("int") - _luhn(head) + 10) % 10
        return _let(permuted(head, key, [DIGITS]), lambda h: F.concat(h, ((_luhn(h) + off) % 10).cast("string")))

    return _let(_let(F.regexp_replace(text, r"\D", ""), made), lambda new: _refilled(text, new, "^[0-9]$"))


def _iban(text: Column, key: str) -> Column:
    """The country stays, the account is permuted, and the check digits keep their distance from the right ones, so valid
    stays valid; check digits that no account can have stay as they are."""

    def right(account: Column, country: Column) -> Column:
        rest = F.aggregate(
            F.split(F.concat(account, country, F.lit("00")), ""),
            F.lit(0),
            lambda a, c: F.when(c == "", a).when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
        )
        return F.lit(98) - rest

    def made(d: Column) -> Column:
        country, check, account = F.substring(d, 1, 2), F.substring(d, 3, 2).cast("int"), F.substring(d, F.lit(5), F.length(d))
        new_check = lambda n: F.when(check.between(2, 98), (right(n, country) + check - right(account, country) - 2 + 97) % 97 + 2).otherwise(check)
        return _let(permuted(account, key), lambda n: F.concat(country, F.lpad(new_check(n).cast("string"), 2, "0"), n))

    return _let(_let(F.replace(text, F.lit(" "), F.lit("")), made), lambda new: _refilled(text, new, "^[^ ]$"))


def _ip(text: Column, key: str) -> Column:
    """The address as two halves of two numbers, permuted. Numbers with a zero before them (00 to 09) are permuted among such,
    so each written form has a surrogate of its own."""
    padded = lambda o, k: F.length(F.get(o, k)) > F.length(F.get(o, k).cast("long").cast("string"))
    size = lambda o, k: F.when(padded(o, k), 10).otherwise(256).cast("long")
    part = lambda o, k: F.get(o, k).cast("long") * size(o, k + 1) + F.get(o, k + 1).cast("long")
    mixed = lambda x, other, turn, n: (x + F.conv(F.substring(_digest(key, turn, other.cast("string")), 1, 8), 16, 10).cast("long")) % n
    one = lambda x, o, k: F.concat(F.when(padded(o, k), "0").otherwise(""), x.cast("string"))
    shown = lambda x, o, k: F.concat(one(F.floor(x / size(o, k + 1)), o, k), F.lit("."), one(x % size(o, k + 1), o, k + 1))
    low, high = lambda o: size(o, 0) * size(o, 1), lambda o: size(o, 2) * size(o, 3)
    return _let(
        F.split(text, r"\."),
        lambda o: _let(
            mixed(part(o, 0), part(o, 2), 1, low(o)),
            lambda a: _let(
                mixed(part(o, 2), a, 2, high(o)),
                lambda b: _let(mixed(a, b, 3, low(o)), lambda a2: _let(mixed(b, a2, 4, high(o)), lambda b2: F.concat(shown(a2, o, 0), F.lit("."), shown(b2, o, 2)))),
            ),
        ),
    )


def name_word(word: Column, key: str) -> Column:
    """A word of a name permuted within vowels and consonants of its script, its capitals kept. A last `a`, which many
    women's names have, stays, and other last letters don't become one. A word has one surrogate, wherever it stands."""
    low = F.lower(word)
    apart = F.length(low) > 2
    body = F.when(apart, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    last = F.when(apart, F.substring(low, -1, 1)).otherwise(F.lit(""))
    tail = F.when(last.isin("", "a", "а", "α"), last).otherwise(_moved(last, _digest(key, 5, body), NOT_A))
    cased = lambda new: F.array_join(F.zip_with(F.split(new, ""), F.split(word, ""), lambda n, c: F.when(c == F.lower(c), n).otherwise(F.upper(n))), "")
    return _let(F.concat(permuted(body, key, NAME), tail), cased)


def _name(text: Column, key: str) -> Column:
    """Title and particles stay; each other word has its surrogate."""
    title = F.regexp_extract(text, rf"^(?:{_TITLE})?", 0)
    words = F.split(F.substring(text, F.length(title) + 1, F.length(text)), " ")
    return F.concat(title, F.array_join(F.transform(words, lambda w: F.when(w.isin(PARTICLES), w).otherwise(name_word(w, key))), " "))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity; a word alone is a name's. What fits none (a part of a longer string
    that another kind's pattern ended) counts as a secret if it has one's sign, else as a number to call."""
    out = None
    for kind, rx in PATTERNS.items():
        whole = entity.rlike(f"^(?:{rx})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.when(entity.rlike(r"^[\p{L}'’-]+$"), "name").when(entity.rlike("[=:]"), "secret").otherwise("phone")


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """What stands in for an entity of a kind."""
    keep = lambda rx, f: F.concat(F.regexp_extract(entity, rx, 1), f(F.regexp_extract(entity, rx, 2)), F.regexp_extract(entity, rx, 3))
    plain = lambda name: lambda x: permuted(x, f"{key}|{name}")
    plain_secret = lambda x: F.when(x.rlike("^[0-9a-z]+$"), permuted(x, f"{key}|secret", NOT_HEX)).otherwise(permuted(x, f"{key}|secret"))
    secret = lambda x: F.when(x.rlike("^[0-9a-f]+$"), permuted(x, f"{key}|hex", [HEX])).otherwise(plain_secret(x))
    return (
        F.when(kind == "email", keep(r"^()(.*)(\.[A-Za-z]+)$", plain("email")))
        .when(kind == "secret", keep(r"(?s)^(.*?[=:]\s{0,3}[\"']?)(.*)()$", secret))
        .when(kind == "key", keep(r"^(AKIA)(.*)()$", plain("key")))
        .when(kind == "iban", _iban(entity, f"{key}|iban"))
        .when(kind == "ip6", permuted(entity, f"{key}|ip6", [HEX, "ABCDEF"]))
        .when(kind == "phone", keep(r"(?s)^(\+\d{1,3}(?=\D)|0)?(.*)()$", plain("phone")))
        .when(kind == "ip", _ip(entity, f"{key}|ip"))
        .when(kind == "card", _card(entity, f"{key}|card"))
        .when(kind == "name", _name(entity, f"{key}|name"))
        .otherwise(permuted(entity, f"{key}|ssn"))
    )


def pieces(text: Column) -> Column:
    """The text cut at its entities, so that every second piece is one; null where it has none.

    Only the kinds whose signs a text has (an @, a digit, = or :, a title) are looked for. Words of names behind titles are
    also found where they stand without one. Entities are marked by a character that the text doesn't have, and it is cut there.
    """
    digit, separator, titled = text.rlike("[0-9]"), text.rlike("[=:]"), text.rlike(PATTERNS["name"])
    digits = "|".join(PATTERNS[k] for k in ("key", "iban", "ip6", "phone", "ssn", "ip", "card"))
    words = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda n: F.split(F.regexp_replace(n, f"^{_TITLE}", ""), " "))
    words = F.array_sort(F.array_distinct(F.filter(F.flatten(words), lambda w: (F.length(w) > 2) & ~w.isin(PARTICLES))), lambda a, b: F.length(b) - F.length(a))
    bare = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
    wanted = [F.when(F.contains(text, F.lit("@")), PATTERNS["email"]), F.when(separator, PATTERNS["secret"]), F.when(digit, digits), F.when(titled, PATTERNS["name"]), F.when(titled & (F.size(words) > 0), bare)]
    rx = F.concat_ws("|", *wanted)
    mark = F.when(F.contains(text, F.lit("\u0001")), F.concat(F.lit("\u0001"), F.md5(text))).otherwise(F.lit("\u0001"))
    marked = F.regexp_replace(text, rx, F.concat(mark, F.lit("$0"), mark))
    cut = _let(marked, lambda m: F.when(F.contains(m, mark), F.split(m, mark, -1)))
    return F.when(F.contains(text, F.lit("@")) | digit | separator | titled, cut)


def entities(cut: Column) -> Column:
    """array<struct<value, kind>> of pieces, in order; null stays null."""
    own = F.filter(cut, lambda p, k: k % 2 == 1)
    return F.transform(own, lambda e: F.struct(e.alias("value"), kind_of(e).alias("kind")))


def found(text: Column) -> Column:
    """array<struct<value, kind>> of a text's entities, in order; null where it has none."""
    return entities(pieces(text))


def dictionary(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, value, surrogate) of all distinct entities of the corpus."""
    own = docs.select(F.explode(found(F.col(text))).alias("e")).select("e.kind", "e.value").distinct()
    return own.withColumn("surrogate", surrogate(F.col("value"), F.col("kind"), key))


def collisions(made: DataFrame) -> DataFrame:
    """(kind, surrogate, n) that stand for several entities which differ in more than the case of their letters."""
    return made.groupBy("kind", "surrogate").agg(F.countDistinct(F.lower("value")).alias("n")).where("n > 1")


def _longer(value: Column, kind: Column, key: str, n: int) -> Column:
    """n more letters (of names and the like) or digits for a value: where the texts of its length and pattern are used up."""
    more = F.substring(F.sha2(F.concat(F.lit(f"{key}|more|"), value), 256), 1, n)
    return F.when(kind.isin("email", "secret", "key", "name"), F.translate(more, HEX, LOWER[:16])).otherwise(F.translate(more, HEX, "0123456789012345"))


def settled(made: DataFrame, key: str) -> DataFrame | None:
    """(kind, value, surrogate) of the values whose surrogate another one has, with new ones that nothing else has; None
    without any. made: the dictionary, a table. Of each group the smallest value keeps its surrogate. After ROUNDS turns, when
    the texts of a pattern must be used up, surrogates grow by letters or digits, more with each turn."""
    out, k = None, 0
    while not collisions(made).isEmpty():
        k += 1
        shared = collisions(made).select("kind", "surrogate")
        first = made.join(shared, ["kind", "surrogate"]).groupBy("kind", "surrogate").agg(F.min(F.lower("value")).alias("first"))
        moved = made.join(first, ["kind", "surrogate"]).where(F.lower("value") != F.col("first")).select("kind", "value")
        new = surrogate(F.col("value"), F.col("kind"), f"{key}|again{k}")
        if k > ROUNDS:
            new = F.concat(new, _longer(F.col("value"), F.col("kind"), key, 2 * (k - ROUNDS)))
        moved = materialise(moved.withColumn("surrogate", new), "moved")
        rest = lambda df: df.join(moved.select("kind", "value"), ["kind", "value"], "left_anti")  # noqa: E731, B023
        made = materialise(rest(made).unionByName(moved), "dictionary")
        out = moved if out is None else materialise(rest(out).unionByName(moved), "settled")
    return out


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", counts: bool = False) -> DataFrame:
    """docs with every entity in `text` replaced; n_chars, where there, follows the new text. With counts, n_<kind> columns are
    added (those of docs are replaced).

    A text without entities stays as it is; null stays null, empty stays empty; repeated rows stay repeated. Other columns
    stay, whatever they are called. Texts are searched once: their pieces go to the shared folder, the corpus's entities are
    checked for collisions from there, and rows are changed one by one. An empty table gives no rows.
    """
    key = key or session_key(docs.sparkSession)
    row, cut, new = (own_name(docs, n) for n in ("_row", "_pieces", "_new"))
    base = docs.withColumn(cut, pieces(F.col(text))).withColumn(text, F.when(F.col(cut).isNull(), F.col(text))).withColumn(row, F.monotonically_increasing_id())
    base = materialise(base, "pii")
    own = base.where(F.col(cut).isNotNull()).select(F.explode(entities(F.col(cut))).alias("e")).select("e.kind", "e.value").distinct()
    made, where = _write(own.withColumn("surrogate", surrogate(F.col("value"), F.col("kind"), key)), "dictionary")
    other = settled(made, key)
    _forget(docs.sparkSession, where)
    of = lambda e: surrogate(e["value"], e["kind"], key)
    if other is None:
        replaced = F.transform(entities(F.col(cut)), of)
    else:
        each = base.where(F.col(cut).isNotNull()).select(row, F.posexplode(entities(F.col(cut))).alias("at", "e")).select(row, "at", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        met = each.join(small(other), ["kind", "value"]).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias(new))
        base = base.join(met, row, "left")
        replaced = F.transform(entities(F.col(cut)), lambda e, k: F.coalesce(F.element_at(F.col(new), k), of(e)))
    joined = F.array_join(F.transform(cut, lambda p, k: F.when(k % 2 == 1, F.get(F.col(new), F.floor(k / 2).cast("int"))).otherwise(p)), "")
    out = base.withColumn(new, replaced).withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(joined))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast("long"), F.col("n_chars")))
    if counts:
        kinds = F.coalesce(F.transform(entities(F.col(cut)), lambda e: e["kind"]), F.expr("cast(array() as array<string>)"))
        out = out.withColumns({f"n_{kind}": (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long") for kind in KINDS})
    return out.drop(row, cut, new)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)

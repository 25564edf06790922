"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern and rewritten in place: the text between them stays as it is. An entity consists of
atoms, what refers to the same thing wherever it occurs: a mailbox, a domain, the digits of a number, a given name, a
part of a family name. A surrogate depends on a key and on the atom alone, so the same person, address or number has the
same surrogate in every document and in every way of writing (coreference). Digits of phone numbers, cards, social
security numbers and addresses go through keyed Feistel permutations of numbers of that length, network addresses within
their class (public, private, loopback, ...), so different ones stay different; mailboxes, account numbers and names get
the shape, script and gender of the original from a keyed digest, and check digits are right again.

A distributed check over all different atoms finds surrogates that two atoms share, or that are atoms of the texts
themselves, and gives those a further attempt, each in a larger space, until all are apart (distinctness). Only texts
with such atoms are joined.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

#: The session's setting for the key.
KEY_SETTING = "spark.taxeval.pii.key"
ROUNDS = 6
#: Attempts within the length of the original; later ones are longer.
SAME_LENGTH = 6
#: Atoms that got a further attempt are broadcast up to this number.
FEW = 100_000

# Forms of address by gender and script; given names by gender and script; parts of family names.
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Señor", "Sr", "Monsieur"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"),
    ("n", "latin"): ("Dr", "Prof"),
    ("m", "cyrillic"): ("Господин",),
    ("f", "cyrillic"): ("Госпожа",),
}
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Noel", "Oscar", "Paul"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Elsa", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula"),
    ("n", "latin"): ("Alex", "Andrea", "Chris", "Dominique", "Eden", "Jamie", "Jordan", "Kim", "Lou", "Morgan", "Nikita", "Robin", "Sam", "Sascha", "Toni", "Val"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Юрий"),
    ("f", "cyrillic"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to"),
    "cyrillic": ("ба", "бе", "бо", "да", "де", "до", "фа", "фе", "га", "го", "ха", "хо", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то"),
    "greek": ("βα", "βε", "βο", "δα", "δε", "δο", "φα", "φε", "γα", "γο", "χα", "χο", "κα", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε", "το"),
}
# Words of family names that stay as they are.
PARTICLES = ("al", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "la", "le", "ten", "ter", "van", "von", "zu", "zum")
# 16-bit beginnings (from, to) of addresses that aren't public.
RESERVED = ((0, 255), (2560, 2815), (25664, 25727), (32512, 32767), (43518, 43518), (44048, 44063), (49320, 49320), (57344, 65535))
PUBLIC = 65536 - sum(b - a + 1 for a, b in RESERVED)


def run_of(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: Letters that stand for letters of a script, by the script's name in patterns; in scripts without case only once.
LETTERS = {
    "IsLatin": run_of("a", "z"), "IsCyrillic": run_of("а", "я"), "IsGreek": run_of("α", "ρ") + run_of("σ", "ω"), "IsArmenian": run_of("ա", "ֆ"), "IsGeorgian": run_of("ა", "ჰ"), "IsHebrew": run_of("א", "ת"),
    "IsArabic": run_of("ب", "غ") + run_of("ف", "ي"), "IsDevanagari": run_of("क", "ह"), "IsThai": run_of("ก", "ฮ"), "IsHiragana": run_of("か", "の"), "IsKatakana": run_of("カ", "ノ"), "IsHangul": run_of("가", "갛"), "IsHan": run_of("一", "俿"),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX = "[0-9A-Fa-f]{1,4}"
WORD = r"\p{Lu}[\p{L}\p{M}]*(?:['’][\p{L}\p{M}]+)*(?:-\p{L}[\p{L}\p{M}]*(?:['’][\p{L}\p{M}]+)*)*"
PARTS = "(?:(?:" + "|".join(PARTICLES) + ") ){0,3}"
TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
#: Entities in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{2,6}}|(?:{HEX}:){{2,6}}:{HEX})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}-])(?:(?:[3-6]\d|2[2-7])\d{11,17}|(?:[3-6]\d|2[2-7])\d\d \d{4} \d{4} \d{4}|(?:[3-6]\d|2[2-7])\d\d-\d{4}-\d{4}-\d{4})(?![\p{L}\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE} {PARTS}{WORD}(?: {PARTS}{WORD}){{0,3}}(?![\p{{L}}\p{{N}}])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: What each text with an entity holds, fast to test: a sign, some digits, colons between digits, or a form of address.
SOME_DIGITS = "[0-9](?:[0-9.() -]{5}|[0-9][A-Z0-9 ]{10})"
SOME_COLONS = "[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"
SOME_TITLE = rf"\b{TITLE} [\p{{Lu}}a-z]"
#: Kinds of atoms whose surrogates mustn't be atoms of the texts themselves.
APART = ("mailbox", "phone", "ssn", "card", "iban", "ipv6", "family-latin", "family-cyrillic", "family-greek")


def digits_of(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from the right."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def modulo_97(s: Column) -> Column:
    """Of digits and capital letters, which count as 10 to 35."""
    chars = F.regexp_extract_all(s, F.lit("[0-9A-Z]"), F.lit(0))
    return F.aggregate(chars, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def kind_of(e: Column) -> Column:
    """The kind of an entity that the pattern has found; null: left alone (a long number that fails the card check)."""
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike("^[0-9A-Fa-f]{1,4}:"), "ipv6")
        .when(e.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^\d"), F.when(luhn(digits_of(e)) % 10 == 0, "card"))
        .otherwise("name")
    )


def atom(kind: Column | str, value: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.alias("value"))


def let(x: Column, use) -> Column:
    """use(x), with x evaluated once."""
    return F.transform(F.array(x), use)[0]


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    of = F.lit("n")
    for (gender, _), titles in TITLES.items():
        of = F.when(bare.isin(*titles), gender).otherwise(of)
    return of


def country_code(e: Column) -> Column:
    """The country code of a phone number that is set off by a sign."""
    return F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)


def words_of(e: Column) -> Column:
    """The words of a name as (word, at): at 0 the form of address, 1 a given name, 2 the family name, 3 a particle."""
    parts = F.split(e, " ")
    at = lambda w, i: F.when(i == 0, 0).when(w.isin(*PARTICLES), 3).when(i == F.size(parts) - 1, 2).otherwise(1)
    return F.transform(parts, lambda w, i: F.struct(w.alias("word"), at(w, i).alias("at")))


def groups_of(e: Column, kind: Column) -> Column:
    """The atoms of an entity, as (kind, value), in groups: of a name those of each word, of an address mailbox and
    domain, of others one; none for network addresses, whose permutation needs no check."""
    domain = F.lower(F.substring_index(e, "@", -1))
    single = (
        F.when(kind == "phone", phone_atom(e)).when(kind.isin("ssn", "card"), atom(kind, digits_of(e)))
        .when(kind == "iban", atom(kind, F.replace(e, F.lit(" "), F.lit("")))).when(kind == "ipv6", atom(kind, F.lower(e)))
    )
    title = F.split(e, " ")[0]
    given = lambda w: F.array(atom(F.concat_ws("-", F.lit("given"), gender_of(title), script_of(w)), F.lower(w)))
    family = lambda w: F.transform(F.split(w, "-"), lambda x: atom(F.concat(F.lit("family-"), script_of(x)), F.lower(x)))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    name = F.transform(words_of(e), lambda x: F.when(x["at"] == 1, given(x["word"])).when(x["at"] == 2, family(x["word"])).otherwise(none))
    return F.when(kind == "email", F.array(F.array(atom("mailbox", F.lower(e))), F.array(atom("domain", domain)))).when(kind == "name", name).when(kind == "ip", F.array(none)).otherwise(F.array(F.array_compact(F.array(single))))


def atoms_of(e: Column, kind: Column) -> Column:
    return F.coalesce(F.flatten(groups_of(e, kind)), F.array().cast("array<struct<kind:string,value:string>>"))


def phone_atom(e: Column) -> Column:
    """Country code and digits, so that all ways of writing a number are one."""
    country = country_code(e)
    return atom("phone", F.concat(country, F.lit(":"), digits_of(F.substr(e, F.length(country) + 1))))


class Surrogates:
    """Expressions for the surrogates under a key."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key

    def digest(self, *parts) -> Column:
        """64 hex digits."""
        return F.sha2(F.concat_ws("|", F.lit(self.key), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)

    @staticmethod
    def number(hexes: Column, at: int | Column, size: int) -> Column:
        return F.conv(F.substr(hexes, F.lit(at) if isinstance(at, int) else at, F.lit(size)), 16, 10).cast("long")

    def permuted(self, a: Column, b: Column, most_a: Column, most_b: Column, *tag) -> Column:
        """(a, b) with a < most_a and b < most_b, one to one under the key: a Feistel network of two unequal halves."""

        def step(s, i):
            f = lambda x: self.number(self.digest(*tag, i.cast("string"), x.cast("string")), 1, 15)
            even = i % 2 == 0
            return F.struct(F.when(even, (s["a"] + f(s["b"])) % most_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + f(s["a"])) % most_b).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)

    def permuted_digits(self, digits: Column, *tag) -> Column:
        """As many digits (2 to 19), one to one."""
        n = F.length(digits)
        half = F.floor(n / 2).cast("int")
        a, b = F.left(digits, half), F.right(digits, n - half)
        size = lambda k: F.pow(F.lit(10), k).cast("long")
        made = self.permuted(a, b, size(half), size(n - half), *tag, n.cast("string"))
        return F.concat(F.lpad(made["a"].cast("string"), half, F.lit("0")), F.lpad(made["b"].cast("string"), n - half, F.lit("0")))

    @staticmethod
    def overlaid(e: Column, chars: Column, what: str) -> Column:
        """e with its characters of a class replaced, in order; what is left of chars comes last."""
        none = F.lit("")
        return F.array_join(F.zip_with(F.split(e, what, -1), F.regexp_extract_all(chars, F.lit(what), F.lit(0)), lambda s, d: F.concat(F.coalesce(s, none), F.coalesce(d, none))), "")

    def shaped(self, text: Column, hexes: Column) -> Column:
        """Letters for letters of the same case and script, digits for digits; other characters stay."""

        def one(i):
            c, n = F.substr(text, i, F.lit(1)), self.number(hexes, (i - 1) % 31 * 2 + 1, 4).cast("int")
            of = F.when(c.rlike("[0-9]"), "0123456789")
            for script, own in LETTERS.items():
                of = of.when(c.rlike(rf"(?=\p{{L}})\p{{{script}}}"), own)
            made = let(of.otherwise(c), lambda own: F.substr(own, n % F.length(own) + 1, F.lit(1)))
            return F.when(c.rlike(r"\p{Lu}"), F.upper(made)).otherwise(made)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")

    def hex_shaped(self, text: Column, hexes: Column) -> Column:
        """Hex digits for hex digits; colons stay."""
        one = lambda i: F.when(F.substr(text, i, F.lit(1)) == ":", ":").otherwise(F.substr(hexes, (i - 1) % 64 + 1, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")

    def picked(self, words: Column, hexes: Column, size: Column) -> list | Column:
        """So many of the words."""
        return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.element_at(words, (self.number(hexes, 5 * k + 1, 5) % F.size(words) + 1).cast("int")))

    def of_atom(self, kind: Column, value: Column, attempt: Column) -> Column:
        """The surrogate of an atom; the space of later attempts is larger."""
        return let(self.digest(kind, attempt.cast("string"), value), lambda h: self._of_atom(kind, value, attempt, h))

    def _of_atom(self, kind: Column, value: Column, attempt: Column, h: Column) -> Column:
        more = F.right(F.translate(h, "abcdef", "012345"), F.greatest(attempt - SAME_LENGTH, F.lit(0)))  # one more digit each time
        # Numbers: a card keeps its first digit and gets a right check digit.
        digits = F.when(kind == "phone", F.substring_index(value, ":", -1)).when(kind == "card", F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        tag = F.concat(kind, F.when(kind == "phone", F.substring_index(value, ":", 1)).otherwise(""))
        number = F.concat(self.permuted_digits(digits, tag, attempt.cast("string")), more)
        card = let(F.concat(F.left(value, F.lit(1)), number), lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        # Mailboxes, and account numbers with right check digits after the country.
        shaped = F.concat(self.shaped(F.when(kind == "iban", F.substr(value, F.lit(5))).otherwise(F.substring_index(value, "@", 1)), h), more)
        land = F.left(value, F.lit(2))
        iban = let(shaped, lambda x: F.concat(land, F.lpad((98 - modulo_97(F.concat(x, land, F.lit("00")))).cast("string"), 2, F.lit("0")), x))
        end = F.when(value.rlike(r"\.(com|org|net)$"), F.right(value, F.lit(3))).otherwise("com")
        ipv6 = F.concat(F.when(value.rlike("^f[cde]"), F.left(value, F.lit(4))).otherwise("2001"), self.hex_shaped(F.regexp_extract(value, "^[0-9a-f]+(:.*)$", 1), h))
        # Names: given names of the list, one more joined each time; family names of syllables.
        names, syllables = F.lit(None).cast("string"), F.lit(None).cast("string")
        for (gender, script), own in GIVEN.items():
            names = F.when(kind == f"given-{gender}-{script}", " ".join(own)).otherwise(names)
        for script, own in SYLLABLES.items():
            syllables = F.when(F.endswith(kind, F.lit(script)), " ".join(own)).otherwise(syllables)
        given = F.array_join(self.picked(F.split(names, " "), h, F.least(attempt, F.lit(11)) + 1), "-")
        made = F.initcap(F.array_join(self.picked(F.split(syllables, " "), h, F.least(attempt + 5, F.lit(12))), ""))
        return (
            F.when(kind.isin("phone", "ssn"), number).when(kind == "card", card).when(kind == "mailbox", shaped).when(kind == "iban", iban)
            .when(kind == "domain", F.concat(F.lit("m"), F.left(h, F.least(F.lit(60), attempt + 10)), F.lit(".example."), end)).when(kind == "ipv6", ipv6)
            .when(names.isNotNull(), given).otherwise(made)
        )

    def ip(self, e: Column) -> Column:
        """An address of the same class: public ones among the public ones, others within their range."""
        ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in RESERVED])
        size = lambda r: r["b"] - r["a"] + 1
        o = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
        high = o[0] * 256 + o[1]
        own = F.get(F.filter(ranges, lambda r: high.between(r["a"], r["b"])), F.lit(0))
        rank = F.aggregate(ranges, high, lambda v, r: v - F.when(high > r["b"], size(r)).otherwise(0))
        # Public: (rank of the first half, second half); reserved: (place in the range and third byte, last byte).
        public = own.isNull()
        a = F.when(public, rank).otherwise((high - own["a"]) * 256 + o[2])
        b = F.when(public, o[2] * 256 + o[3]).otherwise(o[3])
        made = self.permuted(a, b, F.when(public, PUBLIC).otherwise(size(own) * 256), F.when(public, 65536).otherwise(256), F.concat(F.lit("ip"), F.coalesce(own["a"].cast("string"), F.lit(""))))

        def text(m):
            back = F.aggregate(ranges, m["a"], lambda v, r: F.when(v >= r["a"], v + size(r)).otherwise(v))
            first = F.when(public, back).otherwise(own["a"] + F.floor(m["a"] / 256).cast("long"))
            last = F.when(public, m["b"]).otherwise(m["a"] % 256 * 256 + m["b"])
            return let(F.array(first, last), lambda x: F.concat_ws(".", *[y.cast("string") for i in (0, 1) for y in (F.shiftright(x[i], 8), x[i] % 256)]))

        return let(made, text)

    @staticmethod
    def cased(word: Column, like: Column) -> Column:
        """In capitals, if the original is."""
        return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).otherwise(word)

    @staticmethod
    def recased(text: Column, like: Column) -> Column:
        """Capital letters where the original has them."""

        def make(t: Column) -> Column:
            one = lambda i: F.when(F.substr(like, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(t, i, F.lit(1)))).otherwise(F.substr(t, i, F.lit(1)))
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), one), "")

        return let(text, make)

    def of(self, e: Column, kind: Column, known) -> Column:
        """The surrogate of an entity of a kind, from the surrogates known(atom) of its atoms; null kinds stay."""

        def make(groups):
            one = groups[0][0]
            email = F.concat(self.recased(one, F.substring_index(e, "@", 1)), F.lit("@"), groups[1][0])
            country = country_code(e)
            phone = F.concat(country, self.overlaid(F.substr(e, F.length(country) + 1), one, "[0-9]"))
            word = lambda x, parts: F.when(F.size(parts) == 0, x["word"]).otherwise(self.cased(F.array_join(parts, "-"), x["word"]))
            name = F.array_join(F.zip_with(words_of(e), groups, word), " ")
            return (
                F.when(kind == "email", email).when(kind == "phone", phone).when(kind.isin("ssn", "card"), self.overlaid(e, one, "[0-9]"))
                .when(kind == "iban", self.overlaid(e, one, "[0-9A-Z]")).when(kind == "ipv6", one).when(kind == "name", name)
            )

        return F.when(kind.isNull(), e).when(kind == "ip", self.ip(e)).otherwise(let(F.transform(groups_of(e, kind), lambda g: F.transform(g, known)), make))


def may_hold(text: Column) -> Column:
    """Whether a text can hold an entity at all; most texts can't, and are spared the full pattern."""
    return F.contains(text, F.lit("@")) | text.rlike(SOME_DIGITS) | text.rlike(SOME_COLONS) | text.rlike("(?U)" + SOME_TITLE)


def found_in(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def rewritten(text: Column, surrogate) -> Column:
    """The text with surrogate(e, kind) in place of each entity e."""
    between = F.split(text, ANY, -1)
    kinds = F.transform(found_in(text), lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    joined = F.zip_with(between, F.transform(kinds, lambda x: surrogate(x["e"], x["kind"])), lambda gap, e: F.concat(gap, F.coalesce(e, F.lit(""))))
    return F.when(may_hold(text), F.array_join(joined, "")).otherwise(text)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def collisions(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(kind, value, surrogate) of the atoms that need another attempt than the first, so that no two atoms of a kind
    share a surrogate, and none is an atom of the texts itself where its kind says so."""
    make, text = Surrogates(key), F.col(text_col)
    entities = docs.filter(may_hold(text)).select(F.explode(found_in(text)).alias("entity")).distinct()
    e = F.col("entity")
    # Rows are few bytes but costly: they are dealt out by number, which adaptive execution leaves alone.
    n = tasks(docs.sparkSession)
    seen = entities.repartition(n, "entity").select(F.explode(atoms_of(e, kind_of(e))).alias("a")).select("a.kind", "a.value").distinct().repartition(n, "kind", "value")
    kind, value = F.col("kind"), F.col("value")
    now = materialize(seen.select("kind", "value", F.lit(0).alias("attempt"), make.of_atom(kind, value, F.lit(0)).alias("surrogate")), "atoms")
    # Mailboxes are apart within their domain; numbers and names within their kind, phone numbers within their country.
    space = F.when(kind == "mailbox", F.substring_index(value, "@", -1)).when(kind == "phone", F.substring_index(value, ":", 1)).otherwise("")
    own = F.when(kind == "mailbox", F.substring_index(value, "@", 1)).when(kind == "phone", F.substring_index(value, ":", -1)).otherwise(value)
    taken = now.filter(kind.isin(*APART)).select("kind", space.alias("space"), own.alias("low"), F.lit(True).alias("taken"))
    while True:
        low = now.withColumn("space", space).withColumn("low", F.lower("surrogate"))
        # Of each surrogate one atom keeps it; losers are found by their own name, so that no surrogate is a hot key.
        won = low.groupBy("kind", "space", "low").agg(F.min(F.struct("attempt", "value")).alias("w")).select("kind", F.col("w.value").alias("value"), F.lit(True).alias("won"))
        shared = low.join(won, ["kind", "value"], "left")
        apart, free = shared.filter(kind.isin(*APART)).join(taken, ["kind", "space", "low"], "left"), shared.filter(~kind.isin(*APART)).withColumn("taken", F.lit(None).cast("boolean"))
        bad = F.col("won").isNull() | F.coalesce("taken", F.lit(False))
        judged = materialize(apart.select(*low.columns, "won", "taken").unionByName(free.select(*low.columns, "won", "taken")).select("kind", "value", "attempt", "surrogate", bad.alias("bad")), "atoms")
        if judged.filter("bad").isEmpty():
            return judged.filter("attempt > 0").select("kind", "value", "surrogate")
        again = judged.filter("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).repartition(n, "kind", "value")
        more = again.withColumn("surrogate", make.of_atom(kind, value, F.col("attempt")))
        now = materialize(judged.filter("not bad").select("kind", "value", "attempt", "surrogate").unionByName(more), "atoms")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates for the entities in its texts; all other columns and texts stay as they are, whatever the
    columns are called.

    Null and empty texts stay; whole texts are rewritten, of whatever length. Repeated rows get equal texts. Which
    atoms need a further attempt depends on all texts of docs; of atoms that would share a surrogate, the first by name
    keeps it. No rows: no rows. The key must be kept secret: who has it can invert the permutations of numbers.
    """
    make, text = Surrogates(key), F.col(text_col)
    first = lambda a: make.of_atom(a["kind"], a["value"], F.lit(0))
    other = collisions(docs, text_col, key)
    few = other.limit(FEW + 1).count()
    if not few:
        return docs.withColumn(text_col, rewritten(text, lambda e, kind: make.of(e, kind, first)))
    # Only texts that hold such an atom: by digest, so that ids play no part.
    digest, known = fresh(docs, "_digest"), fresh(docs, "_known")
    sha = F.unhex(F.sha2(text, 256))
    atoms = F.flatten(F.transform(found_in(text), lambda e: atoms_of(e, kind_of(e))))
    hits = docs.filter(may_hold(text)).select(sha.alias(digest), F.explode(F.array_distinct(atoms)).alias("a")).select(digest, "a.kind", "a.value")
    hits = hits.join(F.broadcast(other) if few <= FEW else other, ["kind", "value"]).distinct()
    name = lambda kind, value: F.concat_ws("|", kind, value)
    maps = hits.groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("value")), "surrogate"))).alias(known))
    joined = docs.withColumn(digest, sha).join(materialize(maps, "surrogate-maps"), digest, "left")
    look_up = lambda a: F.coalesce(F.try_element_at(F.col(known), name(a["kind"], a["value"])), first(a))
    return joined.withColumn(text_col, rewritten(text, lambda e, kind: make.of(e, kind, look_up))).select(*docs.columns)


def session_key(spark: SparkSession) -> str:
    """The key that KEY_SETTING names; where it is unset, a random one for this session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.transform(found_in(F.col("text")), lambda e: kind_of(e))
    none = F.array().cast("array<string>")
    counts = docs.withColumn("_kinds", F.when(may_hold(F.col("text")), F.filter(kinds, lambda k: k.isNotNull())).otherwise(none))
    made = pseudonymize(counts, session_key(spark))
    count = lambda k: F.size(F.filter(F.coalesce("_kinds", none), lambda x: x == k)).cast("long").alias(f"n_{k}")
    return made.select("doc_id", F.size(F.coalesce("_kinds", none)).cast("long").alias("n_entities"), *map(count, KINDS), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
